"""References to records that do not exist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.shared import all_of, skew_join, union_all

#: A composite key of k columns has 2^k - 1 masks, each with a join of its own.
MAX_COLUMNS = 6


def find_orphans(
    refs: DataFrame,
    targets: DataFrame,
    on: Sequence[str],
    *,
    match: str = "simple",
    ref_time: str | None = None,
    target_time: str | None = None,
) -> DataFrame:
    """The rows of refs that refer to nothing, with a column `kind`.

    refs and targets name the key columns alike (`on`). Rows of refs are grouped by the mask of their non-null key
    columns; each mask is held against the targets on just these columns:

    * match="simple": a row with any null in the key refers to nothing and is no orphan.
    * match="partial": the non-null columns must be found together in one target row.
    * match="full": a key with some, but not all columns null is an orphan of kind `malformed`.

    A row whose key is null as a whole is never an orphan. kind is `missing` if no target has the key or, with both
    times given, `late` if the earliest known time of the target is after the time of the row (both not null).
    The targets may repeat keys, they are reduced to one row per key before the join. Hot keys of refs are joined
    apart (skew_join). All columns of refs are kept, whatever their names, but for one called kind, which the result's
    replaces; repeated rows of refs give repeated rows. Empty tables are fine: without targets every reference is
    missing.
    """
    on = list(on)
    if not 1 <= len(on) <= MAX_COLUMNS:
        raise ValueError(f"1 to {MAX_COLUMNS} key columns are possible")
    if match not in ("simple", "partial", "full"):
        raise ValueError(match)
    # columns go by number inside, so that no name can clash
    keep = [c for c in refs.columns if c != "kind" or c in on or c == ref_time]
    at = {c: f"c{i}" for i, c in enumerate(keep)}
    rows = refs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    keys = [at[c] for c in on]
    timed = ref_time is not None and target_time is not None
    since = F.col(f"`{target_time}`") if timed else F.lit(None).cast("timestamp_ntz")
    known = targets.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)], since.alias("since"))
    every = (1 << len(on)) - 1
    out = []
    for mask in range(1, every + 1):
        have = [k for i, k in enumerate(keys) if mask >> i & 1]
        if mask != every and match == "simple":
            continue
        mine = rows.filter(all_of([F.col(k).isNotNull() if k in have else F.col(k).isNull() for k in keys]))
        if mask != every and match == "full":
            out.append(mine.withColumn("kind", F.lit("malformed")))
            continue
        there = known.filter(all_of([F.col(k).isNotNull() for k in have])).groupBy(*have)
        there = there.agg(F.min("since").alias("since")).withColumn("there", F.lit(True))
        kind = F.when(F.col("there").isNull(), "missing")
        if timed:
            kind = kind.when(F.col("since") > F.col(at[ref_time]), "late")
        held = skew_join(mine, there, have, "left").withColumn("kind", kind)
        out.append(held.filter(F.col("kind").isNotNull()).select(*at.values(), "kind"))
    named = [F.col(n).alias(c) for c, n in at.items() if c != "kind"]
    return union_all(out).select(*named, "kind")


def orphan_report(orphans: DataFrame, by: Sequence[str], record: Sequence[str], time: str) -> DataFrame:
    """Orphan records per group and month: columns by, month (yyyy-MM, null without a time), kind and n. Repeated rows
    of one record count once, in the month of their earliest time."""
    once = orphans.groupBy(*by, *record, "kind").agg(F.min(time).alias("_at"))
    return once.groupBy(*by, F.date_format("_at", "yyyy-MM").alias("month"), "kind").agg(F.count(F.lit(1)).alias("n"))
