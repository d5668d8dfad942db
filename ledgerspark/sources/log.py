"""The log of a repository on a store: numbered entries and a snapshot, written by compare-and-swap, read as tables.

Layout: <root>/<repo>/refs/wal/<16 digits>.json, some of them gzip whatever their name, and <root>/<repo>/refs/snapshot.json.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.codec import gunzip_col, gzip_if_smaller
from ledgerspark.operators.relational import sequence_gaps
from ledgerspark.operators.windows import latest
from ledgerspark.shared import cut, discard, union_all
from ledgerspark.sources.blobs import SharedStore, Store

ENTRY = "seq long, updates array<struct<Name:string,Old:string,New:string>>, events array<struct<Name:string,Payload:string>>, packs array<struct<name:string,data:string,idx:string>>, ts long"
SNAPSHOT = "seq long, default_branch string, public boolean, refs array<struct<name:string,target:string>>, ts long"
_REPO = r"([^/]+)/refs/"
_ENTRY_FILE = re.compile(r"(.+?)/refs/wal/([0-9]+)\.json", re.S)


def entry_name(seq: int) -> str:
    return f"refs/wal/{seq:016d}.json"


def read_entries(spark: SparkSession, root: str) -> DataFrame:
    """(repo, seq, updates, events, packs, ts) of all entries of all repos below root; the number is the file's name's,
    names that are no number are ignored. An unreadable entry has nulls in all but repo and seq.

    Files are listed and read by the executors, the folders below root shared out among them and then the files, so that
    the driver knows none of them. Only where pyarrow has no file system for root does the driver list them."""
    try:
        SharedStore(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
        named = files.select(F.regexp_extract("path", _REPO, 1).alias("repo"), F.regexp_extract("path", r"/refs/wal/(\d+)\.json$", 1).alias("seq"), "content").filter("seq <> ''")
    else:
        n = _tasks(spark)
        folders = spark.range(1, numPartitions=1).mapInArrow(_folders(root), "folder string")
        files = folders.repartition(n, "folder").mapInArrow(_entry_files(root), "repo string, seq string, name string")
        named = files.repartition(n, "name").mapInArrow(_contents(root), "repo string, seq string, content binary")
    body = F.from_json(F.decode(gunzip_col("content"), "UTF-8"), ENTRY)
    return named.select("repo", F.col("seq").cast("long").alias("seq"), body.alias("e")).select("repo", "seq", "e.updates", "e.events", "e.packs", "e.ts")


#: Rows and bytes that a batch of listed or read files has.
_BATCH, _BATCH_BYTES = 4096, 8 << 20


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _folders(root: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = SharedStore(root)
        for rb in batches:
            if rb.num_rows:
                names = (name for name, is_dir in store.below() if is_dir)
                while some := list(islice(names, _BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["folder"])

    return run


def _entry_files(root: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = SharedStore(root)
        for rb in batches:
            found = (m for folder in rb.column("folder").to_pylist() for name in store.files(folder) if (m := _ENTRY_FILE.fullmatch(name)))
            while some := list(islice(found, _BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array([m[g] for m in some], pa.string()) for g in (1, 2, 0)], ["repo", "seq", "name"])

    return run


def _contents(root: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = SharedStore(root)
        for rb in batches:
            at, data, size = 0, [], 0
            names = rb.column("name").to_pylist()
            for i, name in enumerate(names):
                data.append(store.read(name))
                size += len(data[-1])
                if size >= _BATCH_BYTES or i + 1 == len(names):
                    part = rb.slice(at, len(data))
                    yield pa.RecordBatch.from_arrays([part.column("repo"), part.column("seq"), pa.array(data, pa.binary())], ["repo", "seq", "content"])
                    at, data, size = i + 1, [], 0

    return run


def write_entries(bodies: DataFrame, root: str) -> int:
    """Writes bodies(repo, seq, data), one row per entry, as files below root, which all executors must share; gives
    their number. If all executors are on one machine, one task writes: a file system makes one file at a time, and more
    writers take no less time but wait for it in the kernel, at full load."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = SharedStore(root)
        for rb in batches:
            for repo, seq, data in zip(rb.column("repo").to_pylist(), rb.column("seq").to_pylist(), rb.column("data").to_pylist(), strict=True):
                store.put(repo, entry_name(seq), data)
            yield pa.RecordBatch.from_arrays([pa.array([rb.num_rows], pa.int64())], ["n"])

    spark = bodies.sparkSession
    if spark.sparkContext.master.startswith("local") and SharedStore(root).local:
        bodies = bodies.coalesce(1)
    return bodies.select("repo", "seq", "data").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]


def read_written(spark: SparkSession, root: str, n: int) -> DataFrame:
    """read_entries() in one pass over the files, and an error unless n entries come out with their updates."""
    seen = Observation()
    out = cut(read_entries(spark, root).observe(seen, F.count("updates").alias("n")))
    if seen.get["n"] != n:
        raise RuntimeError(f"{n} entries written to {root}, {seen.get['n']} read back")
    return out


def through_store(bodies: DataFrame, root: str, *, at_once: int = 1 << 16, most: int = 16, stretch: int = 4096) -> DataFrame:
    """bodies(repo, seq, data), one row per entry, written as files below root and read back as read_entries() has them, with
    an error if any is lost.

    A file takes a block of the disk, however small it is, so the log goes through the store in slices of about at_once
    entries, or in `most` slices if they would be more; the files of one are deleted when they are read. A slice has whole
    logs, or whole stretches of so many numbers of a longer one."""
    spark, seen = bodies.sparkSession, Observation()
    # the files of a folder are written by one task, one after the other
    bodies = bodies.withColumn("_of", F.xxhash64("repo", F.floor(F.col("seq") / stretch)))
    bodies = cut(bodies.observe(seen, F.count(F.lit(1)).alias("n")).repartition(_tasks(spark), "_of").sortWithinPartitions("repo", "seq"))
    slices = min(most, max(1, -(-seen.get["n"] // at_once)))
    of = F.pmod("_of", F.lit(slices))
    out = []
    for i in range(slices):
        at = f"{root}/{i}"
        n = write_entries(bodies.filter(of == i), at)
        if n:
            out.append(read_written(spark, at, n))
            out[-1].select("repo").distinct().foreachPartition(_remover(at))
    discard(bodies)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return union_all(out) if out else spark.createDataFrame([], f"repo string, {ENTRY}").select("repo", "seq", "updates", "events", "packs", "ts")


def _remover(root: str):  # noqa: ANN202
    def run(rows) -> None:  # noqa: ANN001
        store = SharedStore(root)
        for r in rows:
            store.remove(r["repo"])

    return run


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "snapshot.json").load(root)
    body = F.from_json(F.decode(gunzip_col("content"), "UTF-8"), SNAPSHOT)
    return files.select(F.regexp_extract("path", _REPO, 1).alias("repo"), body.alias("s")).select("repo", "s.*")


def current_refs(entries: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """(repo, name, target): the snapshot's refs, and what the entries after it changed."""
    ups = entries.select("repo", "seq", F.posexplode("updates").alias("pos", "u"))
    ups = ups.select("repo", "seq", "pos", F.col("u.Name").alias("name"), F.nullif(F.nullif(F.col("u.New"), F.lit("0" * 40)), F.lit("")).alias("target"))
    if snapshots is not None:
        base = snapshots.select("repo", F.col("seq").alias("base"))
        ups = ups.join(base, "repo", "left").filter("base IS NULL OR seq > base").drop("base")
        kept = snapshots.select("repo", "seq", F.posexplode("refs").alias("pos", "r")).select("repo", "seq", "pos", F.col("r.name").alias("name"), F.col("r.target").alias("target"))
        ups = ups.unionByName(kept)
    return latest(ups, ["repo", "name"], ["seq", "pos"], "target").select("repo", "name", "target")


def replay_events(entries: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, seq, pos, name, old, new, ts, complete) of the changes after each repo's seq in after(repo, seq); complete
    is false if an entry between that and the last one is missing."""
    start = after.select("repo", F.col("seq").alias("after"))
    mine = entries.join(start, "repo").filter("seq > after")
    marks = mine.select("repo", "seq").unionByName(start.select("repo", F.col("after").alias("seq")))
    lost = sequence_gaps(marks, ["repo"], "seq").select("repo").distinct().withColumn("gap", F.lit(True))
    rows = mine.select("repo", "seq", "ts", F.posexplode("updates").alias("pos", "u")).join(lost, "repo", "left")
    return rows.select("repo", "seq", "pos", F.col("u.Name").alias("name"), F.col("u.Old").alias("old"), F.col("u.New").alias("new"), "ts", F.col("gap").isNull().alias("complete"))


def inline_packs(entries: DataFrame) -> DataFrame:
    """(repo, name, seq, data, idx): packs that ride in entries, of each name the one of the last entry."""
    rows = entries.select("repo", "seq", F.explode("packs").alias("p"))
    last = rows.groupBy("repo", F.col("p.name").alias("name")).agg(F.max(F.struct("seq", "p")).alias("m"))
    return last.select("repo", "name", "m.seq", F.try_to_binary("m.p.data", F.lit("base64")).alias("data"), F.try_to_binary("m.p.idx", F.lit("base64")).alias("idx"))


def prunable(entries: DataFrame, snapshots: DataFrame, flushed: DataFrame) -> DataFrame:
    """(repo, seq) of entries that the snapshot covers and whose inline packs all are among flushed(repo, name)."""
    covered = entries.join(snapshots.select("repo", F.col("seq").alias("upto")), "repo").filter("seq <= upto")
    waiting = covered.select("repo", "seq", F.explode("packs").alias("p")).select("repo", "seq", F.col("p.name").alias("name"))
    waiting = waiting.join(flushed.select("repo", "name").distinct(), ["repo", "name"], "left_anti").select("repo", "seq").distinct()
    return covered.select("repo", "seq").join(waiting, ["repo", "seq"], "left_anti")


class LogWriter:
    """Commits batches of transactions to one repository's log, from the driver. A batch becomes one entry, made by
    creating the next number exclusively; who loses the race reads on and checks again."""

    def __init__(self, store: Store, repo: str, tries: int = 4) -> None:
        self.store, self.repo, self.tries = store, repo, tries
        self.seq, self.refs = 0, {}
        self.sync()

    def sync(self) -> None:
        snap = self.store.get(self.repo, "refs/snapshot.json")
        if snap is not None:
            s = json.loads(snap)
            if s["seq"] > self.seq:
                self.seq, self.refs = s["seq"], {r["name"]: r["target"] for r in s["refs"]}
        from ledgerspark.functions.codec import maybe_gunzip

        while (raw := self.store.get(self.repo, entry_name(self.seq + 1))) is not None:
            for u in json.loads(maybe_gunzip(raw)).get("updates") or []:
                self._apply(self.refs, u["Name"], u["New"])
            self.seq += 1

    @staticmethod
    def _apply(refs: dict, name: str, new: str | None) -> None:
        if new and new != "0" * 40:
            refs[name] = new
        else:
            refs.pop(name, None)

    def commit(self, txs: list[list[dict]], ts: int = 0) -> list[bool]:
        """Which of the transactions (lists of {Name, Old, New}) were accepted: each as a whole, against the state that
        the accepted ones before it left."""
        none = lambda v: v if v and v != "0" * 40 else None
        for _ in range(self.tries):
            self.sync()
            refs, verdict, ups = dict(self.refs), [], []
            for tx in txs:
                staged = dict(refs)
                ok = True
                for u in tx:
                    if none(staged.get(u["Name"])) != none(u["Old"]):
                        ok = False
                        break
                    self._apply(staged, u["Name"], u["New"])
                verdict.append(ok)
                if ok:
                    refs = staged
                    ups += tx
            if not ups:
                return verdict
            entry = {"seq": self.seq + 1, "updates": ups, "ts": ts}
            if self.store.put_if_absent(self.repo, entry_name(self.seq + 1), gzip_if_smaller(json.dumps(entry).encode())):
                self.seq, self.refs = self.seq + 1, refs
                return verdict
        raise RuntimeError("the log moves on too fast")

    def snapshot(self, ts: int = 0) -> None:
        """The sequence number is taken before the refs, so that a reader replays too much rather than too little."""
        seq = self.seq
        refs = [{"name": n, "target": t} for n, t in sorted(self.refs.items())]
        self.store.put(self.repo, "refs/snapshot.json", json.dumps({"seq": seq, "default_branch": "main", "public": False, "refs": refs, "ts": ts}).encode())
