"""State machines whose next state depends on what was accepted before, one per key.

fold() is the one driver: rows are placed by key, sorted by Spark within partitions (which spills), and streamed in Arrow
batches through a step function. Memory is the state of one key, never its rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ledgerspark.operators.replay import components

Step = Callable[[Any, dict], tuple[Any, list[tuple]]]


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], init: Callable[[tuple], Any], step: Step, schema: str, end: Callable[[Any], list[tuple]] | None = None) -> DataFrame:
    """Rows that step gives, of columns `schema`: state, rows = step(state, row) for the rows of each key in order; init
    makes a key's first state, end may give rows from its last. Rows of equal order come in any order."""
    placed = df.withColumn("_key", F.struct(*keys)).repartition("_key").sortWithinPartitions(*keys, *order).drop("_key")
    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, out = None, None, []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in out_schema]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)
            out.clear()
            return made

        for rb in batches:
            for row in rb.to_pylist():
                k = tuple(row[c] for c in keys)
                if k != at:
                    if at is not None and end:
                        out.extend(end(state))
                    state, at = init(k), k
                state, rows = step(state, row)
                out.extend(rows)
            if len(out) > 20_000:
                yield batch()
        if at is not None and end:
            out.extend(end(state))
        yield batch()

    return placed.mapInArrow(run, schema)


def cas_commit(txs: DataFrame) -> DataFrame:
    """(repo, arrival, tx_id, ok) of transactions (repo, arrival, tx_id, updates array<struct<name, old, new>>): each is
    accepted if all its updates find what they expect in the state that the accepted ones before it left; a refused
    one changes nothing. A null old means that the name must not exist, a null new deletes.

    Transactions meet through the names that they share, so the names that transactions of several tie together make up
    components, and each of them is a sequence of its own: a busy repo is many tasks."""
    names = txs.select("repo", "arrival", "tx_id", F.explode("updates").alias("u")).select("repo", "arrival", "tx_id", F.xxhash64("repo", "u.name").alias("node"))
    own = F.xxhash64("repo", F.coalesce(F.get("updates", F.lit(0))["name"], F.concat(F.lit("tx "), "tx_id")))
    hub = names.groupBy("repo", "arrival", "tx_id").agg(F.min("node").alias("b"), F.max("node").alias("top")).filter("b <> top")
    ties = names.join(hub, (names["repo"].eqNullSafe(hub["repo"])) & (names["arrival"].eqNullSafe(hub["arrival"])) & (names["tx_id"].eqNullSafe(hub["tx_id"]))).select(F.col("node").alias("a"), "b")
    roots = components(ties)
    parts = txs.withColumn("node", own).join(roots, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("node", "root")

    def step(state: dict, row: dict) -> tuple[dict, list[tuple]]:
        staged: dict = {}
        ok = True
        for u in row["updates"] or []:
            n = u["name"]
            if (staged[n] if n in staged else state.get(n)) != u["old"]:
                ok = False
                break
            staged[n] = u["new"]
        if ok:
            state.update(staged)
            for n in [n for n, v in staged.items() if v is None]:
                state.pop(n, None)
        return state, [(row["repo"], row["arrival"], row["tx_id"], ok)]

    return fold(parts, ["repo", "part"], ["arrival", "tx_id"], lambda k: {}, step, "repo string, arrival long, tx_id string, ok boolean")


def group_entries(txs: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """(repo, arrival, entry): transactions (repo, arrival, bytes) packed in order into entries of at most most_bytes; one
    that is larger by itself has an entry of its own. Where an entry ends depends on all before it: a repo is one sequence by
    its nature, streamed through one task with two numbers of state."""

    def step(state: tuple[int, int], row: dict) -> tuple[tuple[int, int], list[tuple]]:
        entry, used = state
        n = row["bytes"] or 0
        if entry == 0 or (used and used + n > most_bytes):
            entry, used = entry + 1, 0
        return (entry, used + n), [(row["repo"], row["arrival"], entry)]

    return fold(txs, ["repo"], ["arrival"], lambda k: (0, 0), step, "repo string, arrival long, entry long")


def token_bucket(requests: DataFrame, rate: float, burst: int | None = None) -> DataFrame:
    """(subject, at, id, ok): requests (subject, at timestamp, id) against a bucket per subject that holds burst tokens
    (4 * rate + 1 if not given) and gains rate a second. A rate of 0 or less lets everything pass."""
    most = max(1, int(4 * rate) + 1 if burst is None else burst)
    rows = requests.select("subject", "at", "id", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))

    def step(state: tuple[float, int | None], row: dict) -> tuple[tuple[float, int | None], list[tuple]]:
        tokens, last = state
        us = row["us"]
        if rate <= 0 or us is None:
            return state, [(row["subject"], row["at"], row["id"], rate <= 0)]
        if last is not None:
            tokens = min(most, tokens + max(0, us - last) / 1e6 * rate)
        ok = tokens >= 1
        return (tokens - ok, us), [(row["subject"], row["at"], row["id"], ok)]

    return fold(rows, ["subject"], ["at", "id"], lambda k: (float(most), None), step, "subject long, at timestamp_ntz, id long, ok boolean")


def lru_cache(reads: DataFrame, most_bytes: int) -> DataFrame:
    """(reader, at, block, hit): reads (reader, at, block, bytes) through a cache per reader that keeps the blocks used
    last, at most most_bytes of them but always one."""

    def step(state: tuple[OrderedDict, int], row: dict) -> tuple[tuple[OrderedDict, int], list[tuple]]:
        kept, used = state
        b = row["block"]
        hit = b in kept
        if hit:
            kept.move_to_end(b)
        else:
            kept[b] = row["bytes"] or 0
            used += kept[b]
            while used > most_bytes and len(kept) > 1:
                used -= kept.popitem(last=False)[1]
        return (kept, used), [(row["reader"], row["at"], b, hit)]

    return fold(reads, ["reader"], ["at", "block", "bytes"], lambda k: (OrderedDict(), 0), step, "reader long, at long, block long, hit boolean")


def negative_cache(lookups: DataFrame, ttl_s: int) -> DataFrame:
    """(subject, at, id, asked): of lookups (subject, at timestamp, id, found), whether each was really asked: one that
    found nothing answers for its subject for ttl_s seconds."""
    rows = lookups.select("subject", "at", "id", "found", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))

    def step(until: int | None, row: dict) -> tuple[int | None, list[tuple]]:
        asked = until is None or row["us"] is None or row["us"] >= until
        if asked:
            until = None if row["found"] or row["us"] is None else row["us"] + ttl_s * 1_000_000
        return until, [(row["subject"], row["at"], row["id"], asked)]

    return fold(rows, ["subject"], ["at", "id"], lambda k: None, step, "subject long, at timestamp_ntz, id long, asked boolean")
