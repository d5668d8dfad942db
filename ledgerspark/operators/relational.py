"""Relational operators over metadata tables: look-ups, joins, aggregates, pages, set operations, and changes of tables
expressed as new tables.

Results of "changes" are whole tables; nothing is written. Where one row per key is promised, repeated rows of the input
count once, by a rule that each docstring states. Null keys match nothing, in joins as in look-ups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.operators.windows import ordered_sum
from ledgerspark.shared import all_of, skew_join

# Page sizes and limits of the queries.
AUDIT_LIMIT, AUDIT_MOST, REPO_PAGE, REPO_MOST, COMMIT_PAGE, COMMIT_MOST, RECENT, DUE = 100, 500, 100, 1000, 30, 100, 50, 20


# --- look-ups and filters ---


def lookup(df: DataFrame, **keys: object) -> DataFrame:
    """Rows with these values in these columns."""
    return df.filter(all_of([F.col(k) == F.lit(v) for k, v in keys.items()]))


def search_log(df: DataFrame, exact: dict[str, str], text: str | None, in_columns: Sequence[str], newest: Sequence[str], limit: int) -> DataFrame:
    """Newest rows first, of those with the exact values and with text anywhere in one of the columns, whatever the case;
    % and _ in text stand for any run and any character. A limit out of 1..500 counts as 100."""
    out = lookup(df, **exact) if exact else df
    if text:
        hit = F.lit(False)
        for c in in_columns:
            hit = hit | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
        out = out.filter(hit)
    return out.orderBy(*[F.desc(c) for c in newest]).limit(limit if 0 < limit <= AUDIT_MOST else AUDIT_LIMIT)


def visible_refs(refs: DataFrame, namespace: str | None = None) -> DataFrame:
    """Refs as a reader sees them: the normal view hides all namespaces; a namespace's view has its refs without the
    prefix."""
    if namespace is None:
        return refs.filter(~F.col("name").startswith("refs/namespaces/"))
    prefix = f"refs/namespaces/{namespace}/"
    return refs.filter(F.col("name").startswith(prefix)).withColumn("name", F.expr(f"substring(name, {len(prefix) + 1})"))


def resolve_revision(refs: DataFrame, asked: DataFrame) -> DataFrame:
    """(repo_id, rev, oid) for asked(repo_id, rev): the ref of that name, else the branch, else the tag, else the
    revision itself if it is 4 to 64 hex digits; null if nothing fits. Repeated refs count once (largest target)."""
    tries = asked.select("repo_id", "rev", F.posexplode(F.array(F.col("rev"), F.concat(F.lit("refs/heads/"), "rev"), F.concat(F.lit("refs/tags/"), "rev"))).alias("prio", "name"))
    known = refs.groupBy("repo_id", "name").agg(F.max("target").alias("target")).filter("target IS NOT NULL")
    best = tries.join(known, ["repo_id", "name"]).groupBy("repo_id", "rev").agg(F.min_by("target", "prio").alias("oid"))
    out = asked.distinct().join(best, ["repo_id", "rev"], "left")
    return out.withColumn("oid", F.coalesce("oid", F.when(F.col("rev").rlike("^[0-9a-f]{4,64}$"), F.col("rev"))))


# --- joins ---


def due_jobs(jobs: DataFrame, hooks: DataFrame, now: Column, limit: int = DUE) -> DataFrame:
    """The pending jobs that are due longest and whose hook exists. jobs(id, webhook_id, status, next_attempt_at),
    hooks(id, url); hooks are reduced to one row per id. Top-k after the join, without a total sort."""
    h = hooks.groupBy(F.col("id").alias("webhook_id")).agg(F.max("url").alias("url"))
    mine = jobs.filter((F.col("status") == "pending") & (F.col("next_attempt_at") <= now))
    return skew_join(mine, h, ["webhook_id"], "inner").orderBy("next_attempt_at", "id").limit(limit)


def fan_out(events: DataFrame, hooks: DataFrame, matches: Column) -> DataFrame:
    """One row per event and hook of its repo that subscribes to it; events without a name are skipped. An equi-join on
    repo_id, matches is the rest of the condition."""
    return events.filter(F.col("event") != "").join(hooks, "repo_id").filter(matches)


def referenced(rows: DataFrame, by: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.join(by.select(*on).distinct(), list(on), "left_semi")


def sweep_orphans(listing: DataFrame, known: DataFrame, shared: DataFrame, now: Column, grace_s: int = 3600) -> DataFrame:
    """Files(repo_id, name, modified) older than the grace whose stem no row of known(repo_id, stem) or shared(repo_id,
    stem) has; staged files go by age alone."""
    old = listing.filter(F.col("modified") < now - F.expr(f"INTERVAL {grace_s} SECONDS"))
    stem = F.regexp_replace("name", r"\.(pack|idx|bitmap)$", "")
    staged = old.filter(F.col("name").startswith("staged/"))
    other = old.filter(~F.col("name").startswith("staged/")).withColumn("stem", stem)
    for k in (known, shared):
        other = other.join(k.select("repo_id", "stem").distinct(), ["repo_id", "stem"], "left_anti")
    return staged.unionByName(other.drop("stem"))


def without(rows: DataFrame, others: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key the others don't have; rows with a null in the key stay."""
    return rows.join(others.select(*on).distinct(), list(on), "left_anti")


def object_batch(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Answer (repo_id, oid, op, action) to asked(repo_id, oid, op): bad ids first, then unknown operations; a download
    of what isn't there is missing, an upload of what is there needs nothing."""
    have = stored.select("repo_id", "oid").distinct().withColumn("there", F.lit(True))
    both = asked.join(have, ["repo_id", "oid"], "left")
    action = (
        F.when(~F.coalesce(F.col("oid").rlike("^[a-f0-9]{64}$"), F.lit(False)), "422 oid")
        .when(~F.col("op").isin("download", "upload"), "422 operation")
        .when((F.col("op") == "download") & F.col("there").isNull(), "404")
        .when((F.col("op") == "upload") & F.col("there"), "none")
        .otherwise(F.col("op"))
    )
    return both.select("repo_id", "oid", "op", action.alias("action"))


def missing_parts(packs: DataFrame, files: DataFrame, parts: Sequence[str] = (".pack", ".idx")) -> DataFrame:
    """Packs (repo_id, name) of which a file is not there: one anti-join on (repo, file) for all parts."""
    want = packs.select("repo_id", "name", F.explode(F.array(*[F.concat("name", F.lit(p)) for p in parts])).alias("file"))
    return want.join(files.select("repo_id", "file").distinct(), ["repo_id", "file"], "left_anti").select("repo_id", "name").distinct()


def mirror_diff(local: DataFrame, want: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """What makes local like want: write, delete or skip, by a full outer join on keys that are unique on both sides."""
    a = local.select(*on, F.col(value).alias("have"), F.lit(True).alias("l"))
    b = want.select(*on, F.col(value).alias("want"), F.lit(True).alias("w"))
    both = a.join(b, list(on), "full")
    act = F.when(F.col("w").isNull(), "delete").when(F.col("l").isNull() | ~F.col("have").eqNullSafe(F.col("want")), "write").otherwise("skip")
    return both.select(*on, act.alias("action"), F.coalesce("want", "have").alias("target"))


def moved(current: DataFrame, before: DataFrame, on: Sequence[str], value: str, proven: DataFrame) -> DataFrame:
    """Rows of current that are new or differ from before, and whose value isn't proven."""
    old = before.select(*on, F.col(value).alias("_old"), F.lit(True).alias("_was"))
    new = current.join(old, list(on), "left").filter(F.col("_was").isNull() | ~F.col(value).eqNullSafe(F.col("_old")))
    return new.drop("_old", "_was").join(proven.select(value).distinct(), value, "left_anti").select(*current.columns)


def all_within(wants: DataFrame, tips: DataFrame, by: Sequence[str], on: str) -> DataFrame:
    """Per group, whether each want is among the tips (ok) and how many are not (n_missing)."""
    have = tips.select(*by, on).distinct().withColumn("_there", F.lit(True))
    both = wants.join(have, [*by, on], "left")
    n = F.sum(F.when(F.col("_there").isNull(), 1).otherwise(0))
    return both.groupBy(*by).agg((n == 0).alias("ok"), n.alias("n_missing"))


def sized_entries(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tree entries with the size of blobs; other kinds, and unknown blobs, have 0."""
    s = sizes.groupBy("sha").agg(F.max("size").alias("_size"))
    return entries.join(s, "sha", "left").withColumn("size", F.when(F.col("type") == "blob", F.coalesce("_size", F.lit(0))).otherwise(0).cast("long")).drop("_size")


def same_maps(a: DataFrame, b: DataFrame, by: Sequence[str], key: str, value: str) -> DataFrame:
    """Per group, whether two sides hold the same key-value pairs (same); keys unique within a group and side."""
    x = a.select(*by, key, F.col(value).alias("_a"), F.lit(True).alias("_x"))
    y = b.select(*by, key, F.col(value).alias("_b"), F.lit(True).alias("_y"))
    both = x.join(y, [*by, key], "full")
    equal = F.col("_x").isNotNull() & F.col("_y").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    return both.groupBy(*by).agg(F.bool_and(equal).alias("same"))


def sequence_gaps(seqs: DataFrame, by: Sequence[str], seq: str) -> DataFrame:
    """The missing numbers between the smallest and the largest of each group, as ranges (gap_from, gap_to). Ends and
    beginnings of runs meet by equi-joins on neighbours, so a huge group isn't sorted in one task; k-th end and k-th
    beginning belong together and are few where gaps are."""
    s = seqs.select(*by, F.col(seq).alias("s")).filter("s IS NOT NULL").distinct()
    end = s.join(s.select(*by, (F.col("s") - 1).alias("s")), [*by, "s"], "left_anti").withColumn("e", F.lit(1))
    begin = s.join(s.select(*by, (F.col("s") + 1).alias("s")), [*by, "s"], "left_anti").withColumn("e", F.lit(0))
    marks = begin.unionByName(end).withColumn("next", F.lead("s").over(Window.partitionBy(*by).orderBy("s", "e")))
    return marks.filter("e = 1 AND next IS NOT NULL").select(*by, (F.col("s") + 1).alias("gap_from"), (F.col("next") - 1).alias("gap_to"))


# --- aggregates ---


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """Exact order statistics by nearest rank, position min(n-1, int(n*p)) of the sorted values that aren't null, for every p
    and group, a null group included. Equal
    values are counted before they move, and a running count per group, in ranges of the values, finds the position, so
    that neither one row nor one task has all values of a group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = ordered_sum(counts, [value], "_n", "_upto", by)
    total = counts.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum("_n").alias("n"))
    both = upto.join(total, all_of([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]))
    out = []
    for p in ps:
        rank = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(float(p))))
        name = "p" + f"{p * 100:g}".replace(".", "_")
        out.append(F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col(value))).alias(name))
    return both.groupBy(*by, "n").agg(*out)


def counters(df: DataFrame, cause: str) -> DataFrame:
    """One row with a map from cause to count, in order of causes; zero counts have no entry."""
    n = df.filter(F.col(cause).isNotNull()).groupBy(cause).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(cause).alias("key"), F.col("n").alias("value"))))).alias("counts"))


def first_by(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one with the smallest order (of ties, any with the smallest content). Pre-aggregated by a
    minimum, not sorted."""
    cols = [c for c in df.columns if c not in keys]
    rest = [c for c in cols if c != order]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols]).select(*df.columns)


# --- pages ---


def keyset_page(df: DataFrame, key: str, after: object, limit: int, default: int = REPO_PAGE, most: int = REPO_MOST) -> tuple[DataFrame, DataFrame]:
    """The page of rows with key > after in order of key, and one row `next`: the key from which the page after it
    starts, null at the end. Reads limit + 1 rows as a top-k."""
    n = default if limit <= 0 else min(limit, most)
    over = df.filter(F.col(key) > F.lit(after)).orderBy(key).limit(n + 1)
    page = over.orderBy(key).limit(n)
    keys = F.array_sort(F.collect_list(key))
    nxt = over.agg(F.when(F.count(F.lit(1)) > n, F.get(keys, F.lit(n - 1))).alias("next"))
    return page, nxt


def tree_order(kind: Column, name: Column) -> Column:
    """Sort key of tree entries: names as bytes, folders as if they ended in a slash."""
    return F.when(kind == "tree", F.concat(name, F.lit("/"))).otherwise(name).cast("binary")


# --- changes of tables ---


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """base with the changes in place of rows with equal keys; of several changes of a key the last by order counts."""
    new = changes
    if order is not None:
        cols = [c for c in base.columns if c not in keys]
        new = changes.groupBy(*keys).agg(F.max(F.struct(order, *cols)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])
    return base.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*base.columns))


def insert_ignore(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base and those rows whose key it lacks, one per key (the smallest)."""
    new = rows.join(base.select(*keys).distinct(), list(keys), "left_anti")
    cols = [c for c in base.columns if c not in keys]
    new = new.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])
    return base.unionByName(new.select(*base.columns))


def replace_rows(base: DataFrame, old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base without exactly the old keys and with the new rows; one old key that isn't there and nothing is changed."""
    lost = old.select(*keys).distinct().join(base.select(*keys).distinct(), list(keys), "left_anti")
    if not lost.isEmpty():
        return base
    return upsert(base.join(old.select(*keys).distinct(), list(keys), "left_anti"), new, keys)


def update_where(base: DataFrame, where: Column, **values: Column) -> DataFrame:
    """base with new values in the rows where the condition is true."""
    hit = F.coalesce(where, F.lit(False))
    return base.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(base: DataFrame, where: Column) -> DataFrame:
    return base.filter(~F.coalesce(where, F.lit(False)))


def cascade(tables: dict[str, tuple[DataFrame, str]], keys: Sequence[str]) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys: name -> (table, its key column)."""
    return {n: delete_where(df, F.col(c).isin(list(keys))) for n, (df, c) in tables.items()}


def fork_refs(refs: DataFrame, source: str, target: str) -> DataFrame:
    """Refs with those of source copied to target, namespaced ones left behind."""
    copied = refs.filter((F.col("repo_id") == source) & ~F.col("name").startswith("refs/namespaces/"))
    return refs.unionByName(copied.withColumn("repo_id", F.lit(target)))


def fork_packs(packs: DataFrame, source: str, target: str) -> DataFrame:
    """Packs with those of source lent to target: a pack borrowed already stays its first owner's."""
    owner = F.coalesce(F.nullif(F.trim("blob_repo"), F.lit("")), F.lit(source))
    lent = packs.filter(F.col("repo_id") == source).withColumns({"blob_repo": owner, "repo_id": F.lit(target), "source": F.lit("fork")})
    return packs.unionByName(lent)
