"""A stream of inserts, updates and deletes, applied as complete transactions in commit order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerspark.keys import clean_key
from ledgerspark.shared import cut, discard


def assemble(copies: DataFrame) -> DataFrame:
    """One row (repo, seq, updates) per log entry, of copies(repo_id, seq, updates, received_at).

    Copies without updates (null or an empty array) say nothing. Of the others, the first received one counts (nulls
    last; of equal times the smallest updates). Object ids are cleaned: zero, blank and null mean "none". Rows without
    a repo or seq have no place in the order and are left out."""
    ups = F.transform(
        "updates",
        lambda u: F.struct(u["Name"].alias("name"), clean_key(u["Old"]).alias("old"), clean_key(u["New"]).alias("new")),
    )
    rows = copies.select(clean_key("repo_id").alias("repo"), "seq", ups.alias("updates"), F.coalesce("received_at", F.lit("9999-12-31").cast("timestamp_ntz")).alias("at"))
    rows = rows.filter("repo IS NOT NULL AND seq IS NOT NULL AND size(updates) > 0")
    return rows.groupBy("repo", "seq").agg(F.min(F.struct("at", "updates"))["updates"].alias("updates"))


def watermarks(entries: DataFrame, first: int | None = 1) -> DataFrame:
    """(repo, watermark, last, held): the last seq before the first gap, the last seq, and how many entries are held
    behind the gap. first: the seq with which every log begins (watermark first - 1 if it is missing), or None if each
    begins with its own smallest one. By equi-joins on (repo, seq), so that one busy repo stays spread."""
    seqs = entries.select("repo", "seq").distinct()
    if first is not None:
        seqs = seqs.filter(F.col("seq") >= first)
    after = seqs.select("repo", (F.col("seq") - 1).alias("seq"))
    ends = seqs.join(after, ["repo", "seq"], "left_anti").groupBy("repo").agg(F.min("seq").alias("e"))
    ranges = seqs.groupBy("repo").agg(F.min("seq").alias("a"), F.max("seq").alias("last"))
    mark = F.col("e") if first is None else F.when(F.col("a") == first, F.col("e")).otherwise(F.lit(first - 1).cast("long"))
    marks = ranges.join(ends, "repo").select("repo", mark.alias("watermark"), "last")
    held = seqs.join(marks, "repo").filter("seq > watermark").groupBy("repo").agg(F.count(F.lit(1)).alias("held"))
    return marks.join(held, "repo", "left").fillna(0, ["held"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of an edge list (a, b) of bigints: root is the smallest node of the node's connected component;
    roots themselves have no row. Alternating large-star and small-star steps (Kiveris et al. 2014), each a
    pre-aggregated minimum per node and an equi-join with it, until the stars don't change any more."""
    def stars(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = cut(e.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")))
        return out, (seen.get["n"], seen.get["h"])

    at, mark = stars(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        new, now = stars(small.filter("a <> b"))
        discard(at)
        at, same = new, now == mark
        mark = now
        if same:
            return at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if mark[0]:
        raise RuntimeError("components did not settle")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root"))


def replay(copies: DataFrame, *, hold_gaps: bool = False, first: int | None = 1) -> DataFrame:
    """The refs that exist after all entries of a log, columns repo_id, name, target (all string).

    copies(repo_id, seq, updates array<struct<Name,Old,New>>, received_at) as received: in any order, repeated, some
    without updates (see assemble). The entries of a repo count in order of seq; within one, the updates count in array
    order, each against the state that the ones before it left. Old must equal the ref's target (none: no such ref),
    or the whole entry has no effect; so does an entry with an update without a name. New none deletes. With
    hold_gaps, entries behind the first missing seq of their repo are held back (see watermarks) and only the state
    up to the contiguous watermark is given; otherwise missing entries are passed over.

    Entries conflict only through the refs that they share. The refs that multi-ref entries tie together form
    components, which share no entry; each is replayed on its own, so that one busy repo is spread over many
    tasks. The rows of a component are sorted by Spark (which spills) and streamed through the fold, whose memory
    is the component's live refs. A component is one sequence by its nature: it is not split.
    """
    entries = assemble(copies)
    if hold_gaps:
        # an entry of which only empty copies came is there, but says nothing: the watermark counts every seq received
        got = copies.select(clean_key("repo_id").alias("repo"), "seq").filter("repo IS NOT NULL AND seq IS NOT NULL")
        entries = entries.join(watermarks(got, first).select("repo", "watermark"), "repo").filter("seq <= watermark").drop("watermark")
    ups = cut(
        entries.select("repo", "seq", F.posexplode("updates").alias("pos", "u"), F.size("updates").alias("n")).select(
            "repo", "seq", "pos", "n", F.col("u.name").alias("name"), F.col("u.old").alias("old"), F.col("u.new").alias("new"), F.xxhash64("repo", "u.name").alias("node")
        )
    )
    ties = ups.filter("n > 1").select("repo", "seq", "node")
    hub = ties.groupBy("repo", "seq").agg(F.min("node").alias("b"))
    roots = components(ties.join(hub, ["repo", "seq"]).select(F.col("node").alias("a"), "b"))
    placed = ups.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node"))
    ordered = placed.select("part", "repo", "seq", "pos", "name", "old", "new").repartition("part").sortWithinPartitions("part", "repo", "seq", "pos")
    return ordered.mapInArrow(_fold, "repo_id string, name string, target string")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State of one component at a time, and of one entry within it."""
    schema = pa.schema([("repo_id", pa.string()), ("name", pa.string()), ("target", pa.string())])
    part, entry = None, None
    refs: dict[tuple[str, str], str] = {}
    staged: dict[tuple[str, str], str | None] = {}
    ok = True
    out: list[tuple[str, str, str]] = []

    def settle() -> None:
        if ok:
            for k, v in staged.items():
                if v is None:
                    refs.pop(k, None)
                else:
                    refs[k] = v

    def batch() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], schema=schema)
        out.clear()
        return b

    for rb in batches:
        for p, repo, seq, name, old, new in zip(*[rb.column(c).to_pylist() for c in ("part", "repo", "seq", "name", "old", "new")], strict=True):
            if (p, repo, seq) != entry:
                settle()
                staged, ok, entry = {}, True, (p, repo, seq)
                if p != part:
                    out.extend((*k, v) for k, v in refs.items())
                    refs.clear()
                    part = p
            if ok:
                k = (repo, name)
                ok = name is not None and (staged[k] if k in staged else refs.get(k)) == old
                staged[k] = new
        if len(out) > 20_000:
            yield batch()
    settle()
    out.extend((*k, v) for k, v in refs.items())
    yield batch()
