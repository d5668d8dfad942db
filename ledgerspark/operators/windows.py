"""Ordered computations that window functions and aggregates can say: folds to a last state, islands, running sums.

Where an order is over a whole table or a busy group, ordered_sum() splits it into ranges whose sums are added up first, so
that no task sees more than a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.shared import all_of, cut


def latest(changes: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Current state of a log of changes: per key the value of its last change by order, keys whose last value is null
    (deleted) left out. A pre-aggregated maximum rather than a sort, so that a hot key is no hot task."""
    last = changes.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("_m"))
    return last.select(*keys, F.col(f"_m.{value}").alias(value), *[F.col(f"_m.{c}").alias(c) for c in order]).filter(F.col(value).isNotNull())


def fan_out_table(oids: DataFrame, oid: str) -> DataFrame:
    """256 rows (bucket, n, upto): object ids by first byte, and running totals. The window is over 256 rows."""
    first = F.conv(F.substring(oid, 1, 2), 16, 10).cast("int")
    n = oids.groupBy(first.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = oids.sparkSession.range(256).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(F.broadcast(n.filter("bucket IS NOT NULL")), "bucket", "left").fillna(0, ["n"])
    return both.withColumn("upto", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))


def since_full(chain: DataFrame, by: Sequence[str], token: str, full: Column) -> DataFrame:
    """Per chain: entries after its last full one (all, if it has none), and the token of that one."""
    marked = chain.withColumn("_full", F.coalesce(full, F.lit(False)))
    last = marked.groupBy(*by).agg(F.max(F.when(F.col("_full"), F.col(token))).alias("last_full"))
    both = marked.join(last, list(by))
    after = F.col("last_full").isNull() | (F.col(token) > F.col("last_full"))
    return both.groupBy(*by, "last_full").agg(F.sum(F.when(after, 1).otherwise(0)).alias("since"))


def keep_last_fulls(chain: DataFrame, by: Sequence[str], token: str, full: Column, keep: int = 2) -> DataFrame:
    """Entries from the keep-th last full one on; chains with fewer fulls stay whole."""
    marked = chain.withColumn("_full", F.coalesce(full, F.lit(False)))
    fulls = marked.filter("_full").select(*by, token)
    # the last full one, the last before that, and so on: pre-aggregated maxima rather than a sorted chain
    last = fulls.groupBy(*by).agg(F.max(token).alias("_cut"))
    for _ in range(keep - 1):
        last = fulls.join(last, list(by)).filter(F.col(token) < F.col("_cut")).groupBy(*by).agg(F.max(token).alias("_cut"))
    return marked.join(last, list(by), "left").filter(F.col("_cut").isNull() | (F.col(token) >= F.col("_cut"))).drop("_cut", "_full")


#: Rows of a range of an ordered computation over a whole table.
RANGE_ROWS = 1 << 20
#: Rows of a key in a stretch of an ordered computation, if its numbers are dense.
STRETCH = 65_536


def increasing(df: DataFrame, by: Sequence[str], order: str, value: str, name: str, stretch: int = STRETCH) -> DataFrame:
    """Strictly increasing tokens: each is the value, or one more than the token before it if that is greater. With i
    the place, token - i is the running maximum of value - i. order is a bigint, unique per key. Keys are computed in
    stretches of the order, whose sizes and maxima are carried on over one row per stretch, so that a busy key is many
    tasks. Rows with a null order come first, in one stretch; a null value counts as the smallest."""
    b = df.withColumn("_b", F.coalesce(F.floor(F.col(order) / stretch), F.lit(-(2**62))))
    whole, before = Window.partitionBy(*by).orderBy("_b"), (Window.unboundedPreceding, -1)
    sizes = b.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(whole.rowsBetween(*before)), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*by, "_b").orderBy(order)
    at = b.join(sizes, [*by, "_b"]).withColumn("_i", F.row_number().over(inner) + F.col("_off"))
    at = at.withColumn("_v", F.coalesce(F.col(value), F.lit(-(2**62))) - F.col("_i"))
    tops = at.groupBy(*by, "_b").agg(F.max("_v").alias("_m"))
    tops = tops.select(*by, "_b", F.max("_m").over(whole.rowsBetween(*before)).alias("_before"))
    both = at.join(tops, [*by, "_b"])
    running = F.max("_v").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, F.greatest(running, F.col("_before")) + F.col("_i")).drop("_b", "_off", "_i", "_v", "_before")


def estimate(events: DataFrame, by: Sequence[str], order: str, observed: str, nudge: Column, stretch: int = STRETCH) -> DataFrame:
    """Running estimate: the last observed number, and one for each nudge since; null before any observation. order is a
    bigint, unique per key; computed in stretches like increasing()."""
    b = events.withColumns({"_b": F.coalesce(F.floor(F.col(order) / stretch), F.lit(-(2**62))), "_x": F.when(nudge & F.col(observed).isNull(), 1).otherwise(0)})
    w = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_g", F.count(observed).over(w))
    v = Window.partitionBy(*by, "_b", "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumns({"_seen": F.first(observed).over(v), "_since": F.sum("_x").over(v)})
    # what a stretch hands on: its last observation and the nudges since, or all its nudges
    last = local.groupBy(*by, "_b").agg(F.max(F.struct("_g", "_since", "_seen")).alias("_l"))
    last = last.select(*by, "_b", F.col("_l._seen").alias("_o"), F.col("_l._since").alias("_k"))
    whole = Window.partitionBy(*by).orderBy("_b")
    last = last.withColumn("_h", F.count("_o").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(*by, "_h").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("_e", F.first("_o").over(island) + F.sum("_k").over(island))
    last = last.select(*by, "_b", F.lag("_e").over(whole).alias("_in"))
    both = local.join(last, [*by, "_b"])
    return both.withColumn("estimate", F.when(F.col("_g") > 0, F.col("_seen") + F.col("_since")).otherwise(F.col("_in") + F.col("_since"))).drop("_b", "_x", "_g", "_seen", "_since", "_in")


def ordered_sum(df: DataFrame, order: Sequence[str], value: str, name: str, by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Running sum of value over the whole table (or each group `by`) in this order, the row itself included. Rows are
    partitioned by ranges of all of by and order, about range_rows each; the sums of ranges, one row for each range and
    group, are added up, and a window runs within each range. Nulls come first, in order as in value, where they add 0."""
    cols = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    n = max(1, -(-df.count() // range_rows))
    placed = cut(df.repartitionByRange(n, *cols).withColumn("_b", F.spark_partition_id()))
    before = placed.groupBy(*by, "_b").agg(F.sum(value).alias("_s"))
    whole = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("_before", F.coalesce(F.sum("_s").over(whole), F.lit(0))).drop("_s")
    same = all_of([F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by])
    w = Window.partitionBy(*by, "_b").orderBy(*cols[len(by) :]).rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0))).alias("p")
    both = inner.join(before.alias("q"), (F.col("p._b") == F.col("q._b")) & same)
    return both.select(*[F.col(f"p.{c}") for c in df.columns if c != name], (F.col(f"p.{name}") + F.col("q._before")).alias(name))


def ranks(df: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Places from 1 in this order, in each group, which should be total; a busy group is many tasks (see ordered_sum)."""
    return ordered_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name, by).drop("_one")


def evict(idle: DataFrame, order: Sequence[str], size: str, used: int, total: int, high: int = 85, low: int = 70) -> DataFrame:
    """Least recently used first, the rows to drop until at most low percent of total is used; none while fewer than
    high percent are."""
    if used * 100 // total < high:
        return idle.limit(0)
    summed = ordered_sum(idle, order, size, "_upto")
    left = F.lit(used) - (F.col("_upto") - F.coalesce(F.col(size), F.lit(0)))
    return summed.filter(F.floor(left * 100 / F.lit(total)) > low).drop("_upto")


def newest_keys(df: DataFrame, key: str, order: str, most: int = 8192) -> DataFrame:
    """A map that keeps the most keys inserted last, by first insertion: top-k over one row per key."""
    return df.groupBy(key).agg(F.min(order).alias("first_at")).orderBy(F.desc("first_at"), F.desc(key)).limit(most)
