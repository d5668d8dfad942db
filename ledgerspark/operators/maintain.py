"""Derived data and its upkeep: what to compact, what to keep, and views that are rebuilt when their source moved."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators.graph import reachable
from ledgerspark.operators.windows import since_full
from ledgerspark.shared import cut, discard
from ledgerspark.sources.blobs import Store


def compaction_due(packs: DataFrame, now: Column, many: int = 64, quiet_s: int = 300) -> DataFrame:
    """(repo_id, n, newest, due): repos with many packs, or with two at least and none in the last quiet_s seconds."""
    n = packs.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("newest"))
    quiet = F.coalesce(F.col("newest") <= now - F.expr(f"INTERVAL {quiet_s} SECONDS"), F.lit(True))
    return n.withColumn("due", (F.col("n") >= many) | ((F.col("n") >= 2) & quiet))


def chain_plan(chain: DataFrame, by: str, token: str, full: Column, at: str, now: Column, max_age_days: int = 7, most: int = 32) -> DataFrame:
    """(by, since, action): the next link of each chain, full if there is none, the last full one is old, or many others
    followed it, else incremental."""
    state = since_full(chain, [by], token, full)
    newest = chain.groupBy(by).agg(F.max(F.when(full, F.col(at))).alias("full_at"))
    old = F.col("full_at").isNull() | (F.col("full_at") <= now - F.expr(f"INTERVAL {max_age_days} DAYS"))
    return state.join(newest, by).select(by, "since", F.when(old | (F.col("since") >= most), "full").otherwise("incremental").alias("action"))


def history_only(objects: DataFrame) -> DataFrame:
    """Everything but contents."""
    return objects.filter(F.col("kind") != "blob")


def compact(df: DataFrame, path: str, by: str | None = None, target_bytes: int = 128 << 20, row_bytes: int = 200) -> None:
    """Rewrite a table of many small files as files of about target_bytes."""
    n = max(1, -(-df.count() * row_bytes // target_bytes))
    (df.repartition(n, by) if by else df.repartition(n)).write.mode("overwrite").parquet(path)


class Packs:
    """The packs of a store as tables: objects(oid, dst array<string>, ..) in one Parquet folder for each pack below `at`, and
    which of them are in force in numbered manifests, each made by creating the next number exclusively."""

    def __init__(self, spark: SparkSession, store: Store, at: str) -> None:
        self.spark, self.store, self.at = spark, store, at

    def manifest(self) -> tuple[int, list[str]]:
        """(number, names) of the manifest in force; (0, []) if there is none."""
        names = self.store.names("manifest")
        if not names:
            return 0, []
        last = max(names)
        return int(last.removesuffix(".json")), json.loads(self.store.fetch("manifest", last))

    def put(self, number: int, names: list[str]) -> bool:
        """False if somebody else has put this number."""
        return self.store.put_if_absent("manifest", f"{number:016d}.json", json.dumps(sorted(names)).encode())

    def write(self, objects: DataFrame) -> str:
        name = uuid.uuid4().hex
        objects.write.parquet(f"{self.at}/{name}")
        return name

    def read(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.at}/{n}" for n in names])

    def delete(self, names: list[str]) -> None:
        for n in names:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{n}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def consolidate(packs: Packs, tips: Callable[[], DataFrame], tries: int = 3) -> dict[str, int | bool]:
    """One pack of all that the tips reach in place of all packs in force; what nothing reaches is left behind.

    Build: the objects that tips()(node) reach, each once, as a new pack. Prove: the tips are read again, and whatever they
    reach by now must be in the new pack, or in packs that came meanwhile. Swap: the next manifest, with the new pack and those,
    is created exclusively, so that a manifest which came first makes it start anew. Only then are the old packs deleted. A
    failure before the swap leaves everything as it was; after it, old packs that nobody lists."""
    for _ in range(tries):
        number, old = packs.manifest()
        if not old:
            return {"swapped": False, "packs_before": 0, "packs_after": 0, "objects_before": 0, "objects_after": 0}
        have = packs.read(old)
        edges = have.select(F.col("oid").alias("src"), F.explode("dst").alias("dst"))
        live = reachable(edges, tips())
        built = packs.write(have.join(live.select(F.col("node").alias("oid")), "oid", "left_semi").dropDuplicates(["oid"]))
        number_now, names_now = packs.manifest()
        came = [n for n in names_now if n not in old]
        after = packs.read([built, *came])
        known = packs.read([*old, *came])
        lacking = reachable(known.select(F.col("oid").alias("src"), F.explode("dst").alias("dst")), tips()).join(known.select(F.col("oid").alias("node")), "node", "left_semi").join(after.select(F.col("oid").alias("node")), "node", "left_anti")
        if number_now == number + len(came) and all(n in names_now for n in old) and lacking.isEmpty() and packs.put(number_now + 1, [built, *came]):
            n = [packs.read(x).select("oid").distinct().count() for x in (old, [built])]
            packs.delete(old)
            return {"swapped": True, "packs_before": len(old), "packs_after": 1 + len(came), "objects_before": n[0], "objects_after": n[1]}
        packs.delete([built])
    return {"swapped": False, "packs_before": len(old), "packs_after": len(old), "objects_before": 0, "objects_after": 0}


class SingleFlight:
    """One run of a job at a time for each key: a call while it runs makes it run once more afterwards, however many calls
    came, and returns at once."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.running: set[str] = set()
        self.again: set[str] = set()

    def run(self, key: str, job: Callable[[], object]) -> int:
        """How often the job ran by this call."""
        with self.lock:
            if key in self.running:
                self.again.add(key)
                return 0
            self.running.add(key)
        n = 0
        try:
            while True:
                job()
                n += 1
                with self.lock:
                    if key not in self.again:
                        return n
                    self.again.discard(key)
        finally:
            with self.lock:
                self.running.discard(key)
                self.again.discard(key)


def remote_packs(packs: DataFrame, replica: Column, most_bytes: int, least_pack: int = 1 << 20) -> DataFrame:
    """The packs(repo_id, name, size_bytes) that a replica leaves at the store: those over least_pack of repos whose packs come
    to over most_bytes. Sums are pre-aggregated, so a repo with very many packs is many tasks."""
    big = packs.groupBy("repo_id").agg(F.sum("size_bytes").alias("s")).filter(F.col("s") > most_bytes).select("repo_id")
    return packs.filter(replica & (F.col("size_bytes") > least_pack)).join(big, "repo_id", "left_semi")


class Views:
    """Views over a log, rebuilt when its change token moved. The token is read before the source, so that a view is never
    newer than it says; a failed build leaves the old one in place."""

    def __init__(self) -> None:
        self.builders: dict[str, Callable[[], DataFrame]] = {}
        self.made: dict[str, tuple[object, DataFrame]] = {}

    def register(self, name: str, build: Callable[[], DataFrame]) -> None:
        self.builders[name] = build

    def get(self, name: str, token: object) -> DataFrame:
        old = self.made.get(name)
        if old is not None and old[0] == token:
            return old[1]
        new = cut(self.builders[name]())
        self.made[name] = (token, new)
        if old is not None:
            discard(old[1])
        return new
