"""Queries of the integrity operators: orphans, hierarchies, copies, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.keys import clean_key, clean_key_sql
from ledgerspark.operators.copies import diff_copies
from ledgerspark.operators.hierarchy import chains, lineage, resolve
from ledgerspark.operators.orphans import find_orphans, orphan_report
from ledgerspark.operators.replay import replay, watermarks
from ledgerspark.plans.registry import Registry, table
from ledgerspark.shared import cut, union_all

R = Registry()
K = clean_key_sql

_ORPHANS_SQL = f"""
with c as (select distinct {K("sha")} k from commits where {K("sha")} is not null),
r as (select {K("id")} k, min(created_at) since from repos where {K("id")} is not null group by 1),
w as (select {K("id")} k, min(created_at) since from webhooks where {K("id")} is not null group by 1),
f as (
  select 'refs' src, {K("repo_id")} repo_id, name row_key, 'missing' kind, cast(null as timestamp) made
  from refs where {K("target")} is not null and {K("target")} not in (select k from c)
  union all
  select 'packs', {K("repo_id")}, name, case when r.k is null then 'missing' else 'late' end, created_at
  from packs left join r on r.k = {K("blob_repo")} where {K("blob_repo")} is not null and (r.k is null or r.since > created_at)
  union all
  select 'deliveries', {K("repo_id")}, id, case when w.k is null then 'missing' else 'late' end, created_at
  from deliveries left join w on w.k = {K("webhook_id")} where {K("webhook_id")} is not null and (w.k is null or w.since > created_at)
)
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    no_time = F.lit(None).cast("timestamp_ntz")
    refs = table(spark, d, "refs").select(F.lit("refs").alias("src"), clean_key("repo_id").alias("repo_id"), F.col("name").alias("row_key"), no_time.alias("at"), clean_key("target").alias("key"))
    packs = table(spark, d, "packs").select(F.lit("packs").alias("src"), clean_key("repo_id").alias("repo_id"), F.col("name").alias("row_key"), F.col("created_at").alias("at"), clean_key("blob_repo").alias("key"))
    sent = table(spark, d, "deliveries").select(F.lit("deliveries").alias("src"), clean_key("repo_id").alias("repo_id"), F.col("id").alias("row_key"), F.col("created_at").alias("at"), clean_key("webhook_id").alias("key"))
    shas = table(spark, d, "commits").select(clean_key("sha").alias("key"))
    repos = table(spark, d, "repos").select(clean_key("id").alias("key"), F.col("created_at").alias("since"))
    hooks = table(spark, d, "webhooks").select(clean_key("id").alias("key"), F.col("created_at").alias("since"))
    return union_all(
        [
            find_orphans(refs, shas, ["key"]),
            find_orphans(packs, repos, ["key"], ref_time="at", target_time="since"),
            find_orphans(sent, hooks, ["key"], ref_time="at", target_time="since"),
        ]
    )


@R.add("p1_found", _ORPHANS_SQL + "select distinct src, repo_id, row_key, kind from f")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src", "repo_id", "row_key", "kind").distinct()


@R.add(
    "p1_report",
    _ORPHANS_SQL + "select src, strftime(made, '%Y-%m') as month, kind, count(*) n from (select src, repo_id, row_key, kind, min(made) made from f group by all) group by all",
)
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d), ["src"], ["repo_id", "row_key"], "at")


_KEYS = f"""d as (select distinct id, {K("webhook_id")} hook, {K("repo_id")} repo from deliveries), w as (select distinct {K("id")} hook, {K("repo_id")} repo from webhooks)"""
_WHOLE = "d.hook is not null and d.repo is not null and not exists (select 1 from w where w.hook = d.hook and w.repo = d.repo)"


def _composite(spark: SparkSession, d: str, match: str) -> DataFrame:
    sent = table(spark, d, "deliveries").select("id", clean_key("webhook_id").alias("hook"), clean_key("repo_id").alias("repo")).distinct()
    hooks = table(spark, d, "webhooks").select(clean_key("id").alias("hook"), clean_key("repo_id").alias("repo"))
    return find_orphans(sent, hooks, ["hook", "repo"], match=match)


@R.add(
    "p1_partial",
    f"""with {_KEYS} select id, hook, repo, 'missing' as kind from d where {_WHOLE}
    or (d.hook is not null and d.repo is null and d.hook not in (select hook from w where hook is not null)) or (d.hook is null and d.repo is not null and d.repo not in (select repo from w where repo is not null))""",
)
def p1_partial(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries whose hook and repo, as far as they are given, no hook has together."""
    return _composite(spark, d, "partial")


@R.add("p1_full", f"with {_KEYS} select id, hook, repo, case when d.hook is null or d.repo is null then 'malformed' else 'missing' end as kind from d where {_WHOLE} or (d.hook is null) <> (d.repo is null)")
def p1_full(spark: SparkSession, d: str) -> DataFrame:
    """The same where hook and repo must both be given, or neither."""
    return _composite(spark, d, "full")


def commit_links(commits: DataFrame) -> DataFrame:
    """(id, parent): the cleaned sha and the first entry of parents that isn't none."""
    first = F.filter(F.transform("parents", clean_key), lambda p: p.isNotNull())
    return commits.select(clean_key("sha").alias("id"), F.try_element_at(first, F.lit(1)).alias("parent"))


#: up: every commit with each one on its chain of parents; c: the commits on loops.
_UP_SQL = f"""
with recursive l as (
  select {K("sha")} id, min(list_filter(list_transform(parents, lambda x: {K("x")}), lambda x: x is not null)[1]) p
  from commits where {K("sha")} is not null group by 1),
e as (select l.id, l.p from l semi join (select id as p from l) m on l.p = m.p),
up(id, anc) as (select id, p from e union select up.id, e.p from up join e on e.id = up.anc),
c as (select id from up where id = anc),
o as (select id, min(anc) filter (anc in (select id from c)) loop, count(*) filter (anc not in (select id from c)) off, count(*) n,
  min(anc) filter (anc not in (select id from e)) top from up group by 1),
f as (select l.id sha, coalesce(o.loop, o.top, l.id) root,
  case when c.id is not null then 0 when o.loop is not null then o.off + 1 else coalesce(o.n, 0) end depth,
  case when c.id is not null then 'cycle' when o.loop is not null then 'below' else 'tree' end state
  from l left join o on o.id = l.id left join c on c.id = l.id)
"""


@R.add("p2_found", _UP_SQL + "select sha, root, depth::bigint depth, state from f")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return resolve(commit_links(table(spark, d, "commits"))).select(F.col("id").alias("sha"), "root", "depth", "state")


@R.add("p2_lineage")
def p2_lineage(spark: SparkSession, d: str) -> DataFrame:
    """The chain of first parents and the descendants of every commit, as intervals (see lineage())."""
    return lineage(commit_links(table(spark, d, "commits"))).withColumnRenamed("id", "sha")


@R.add("p2_below", _UP_SQL + "select f.sha, coalesce(n, 0)::bigint as n_below from f left join (select anc, count(*) n from up where id <> anc group by 1) b on b.anc = f.sha")
def p2_below(spark: SparkSession, d: str) -> DataFrame:
    """How many commits lie below each commit: its interval's, and round a loop the whole component."""
    rows = p2_lineage(spark, d)
    whole = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(whole, "root").select("sha", (F.when(F.col("loop") > 0, F.col("n")).otherwise(F.col("size")) - 1).alias("n_below"))


@R.add(
    "p2_paths",
    _UP_SQL
    + f""", t as (select distinct {K("target")} sha from refs where {K("target")} in (select id from l))
    select t.sha, t.sha as ancestor from t union select t.sha, up.anc from t join up on up.id = t.sha""",
)
def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full chain of every commit that a ref names: (sha, ancestor), itself included."""
    tips = table(spark, d, "refs").select(clean_key("target").alias("sha"))
    return chains(cut(p2_lineage(spark, d)), tips, "sha").select("sha", "ancestor")


_REFS_SQL = "select {k} repo_id, name, max({t}) target from {table} group by 1, 2"


@R.add(
    "p3_found",
    f"""with a as ({_REFS_SQL.format(k=K("repo_id"), t=K("target"), table="refs")}), b as ({_REFS_SQL.format(k=K("repo_id"), t=K("target"), table="refs_mirror")}),
    x as (select coalesce(a.repo_id, b.repo_id) repo_id, coalesce(a.name, b.name) name,
      case when b.repo_id is null then 'only_refs' when a.repo_id is null then 'only_mirror' when a.target is distinct from b.target then 'target' end diff
      from a full outer join b on a.repo_id = b.repo_id and a.name = b.name)
    select * from x where diff is not null""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    served, mirror = (table(spark, d, t).select(clean_key("repo_id").alias("repo_id"), "name", clean_key("target").alias("target")) for t in ("refs", "refs_mirror"))
    found = diff_copies(served, mirror, ["repo_id", "name"], ["target"])
    diff = F.when(F.col("diff") == "only_left", "only_refs").when(F.col("diff") == "only_right", "only_mirror").otherwise("target")
    return found.select("repo_id", "name", diff.alias("diff"))


_PACKS_SQL = f"""(select distinct {K("repo_id")} repo_id, name, size_bytes, source, created_at, {K("blob_repo")} owner from packs)"""


@R.add(
    "p3_changed",
    f"""with a as {_PACKS_SQL}, b as (select repo_id, name, case when size_bytes % 11 = 0 then size_bytes + 1 else size_bytes end size_bytes, case when size_bytes % 7 = 0 then null else source end source, created_at, owner from {_PACKS_SQL}),
    s as (select repo_id, name, 1 as side, {{}} from a union all select repo_id, name, 2, {{}} from b),
    x as (select repo_id, name, array_agg(distinct {{}}) filter (side = 1) as l, array_agg(distinct {{}}) filter (side = 2) as r from s group by 1, 2)
    """.format(*["size_bytes, source, created_at, owner"] * 2, *["[cast(size_bytes as varchar), source, cast(created_at as varchar), owner]"] * 2)
    + """select repo_id, name, array_to_string(list_filter(['size_bytes', 'source', 'created_at', 'owner'], lambda f, i: list_sort(list_distinct(list_transform(l, lambda v: coalesce(v[i], '?')))) <> list_sort(list_distinct(list_transform(r, lambda v: coalesce(v[i], '?'))))), ',') as changed
    from x where list_sort(list_transform(l, lambda v: coalesce(v[1], '?') || '|' || coalesce(v[2], '?') || '|' || coalesce(v[3], '?') || '|' || coalesce(v[4], '?')))
      <> list_sort(list_transform(r, lambda v: coalesce(v[1], '?') || '|' || coalesce(v[2], '?') || '|' || coalesce(v[3], '?') || '|' || coalesce(v[4], '?')))""",
)
def p3_changed(spark: SparkSession, d: str) -> DataFrame:
    """The packs table against a copy in which every eleventh size is off by one and every seventh source is lost: which
    fields of which pack differ."""
    a = table(spark, d, "packs").select(clean_key("repo_id").alias("repo_id"), "name", "size_bytes", "source", "created_at", clean_key("blob_repo").alias("owner"))
    size = F.when(F.col("size_bytes") % 11 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))
    b = a.withColumns({"size_bytes": size, "source": F.when(F.col("size_bytes") % 7 == 0, None).otherwise(F.col("source"))})
    found = diff_copies(a, b, ["repo_id", "name"], ["size_bytes", "source", "created_at", "owner"])
    return found.select("repo_id", "name", F.array_join("changed", ",").alias("changed"))


_MARK_SQL = f"""select repo, coalesce(max(seq) filter (seq = j), 0)::bigint as watermark from (select repo, seq, row_number() over (partition by repo order by seq) j from
    (select distinct {K("repo_id")} repo, seq from wal_entry where {K("repo_id")} is not null and seq >= 1)) group by 1"""


def _replay_sql(also: str = "true") -> str:
    """Updates one by one: base is the state before their entry, cur what the entry makes of it while all is well."""
    return f"""with recursive x as (select {K("repo_id")} repo, seq, arg_min(updates, coalesce(received_at, timestamp '9999-12-31')) updates from wal_entry where {K("repo_id")} is not null and seq is not null and len(updates) > 0 group by 1, 2),
    m as ({_MARK_SQL}), u as (select repo, seq, i, row_number() over (partition by repo order by seq, i) k, updates[i].Name as name, {K("updates[i].Old")} as old, {K("updates[i].New")} as new
      from (select repo, seq, updates, unnest(range(1, len(updates) + 1)) i from x left join m using (repo) where {also})),
    f as (select repo, k, seq, name is not null and old is null as ok, []::struct(n varchar, t varchar)[] as base, case when name is not null and old is null and new is not null then [{{'n': name, 't': new}}] else [] end cur from u where k = 1
      union all select repo, k, seq, ok and good, base, case when ok and good then list_concat(list_filter(cur, lambda s: s.n <> name), case when new is null then [] else [{{'n': name, 't': new}}] end) else cur end from (
        select *, name is not null and old is not distinct from list_filter(cur, lambda s: s.n = name)[1].t as good from (
          select u.repo, u.k, u.seq, u.name, u.old, u.new, u.i = 1 or f.ok as ok, case when u.i > 1 then f.base when f.ok then f.cur else f.base end base, case when u.i > 1 or f.ok then f.cur else f.base end cur
          from f join u on u.repo = f.repo and u.k = f.k + 1)))
    select repo as repo_id, s.n as name, s.t as target from (select repo, unnest(case when ok then cur else base end) s from f where (repo, k) in (select repo, max(k) from u group by 1))"""


@R.add("p5_found", _replay_sql())
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return replay(table(spark, d, "wal_entry"))


@R.add("p5_held", _replay_sql("seq <= watermark"))
def p5_held(spark: SparkSession, d: str) -> DataFrame:
    """The refs at each repo's contiguous watermark: what came behind a gap is held back."""
    return replay(table(spark, d, "wal_entry"), hold_gaps=True)


@R.add(
    "p5_watermark",
    f"""with s as (select distinct {K("repo_id")} repo, seq from wal_entry where {K("repo_id")} is not null and seq >= 1),
    n as (select repo, seq, row_number() over (partition by repo order by seq) i from s)
    select repo, coalesce(max(seq) filter (seq = i), 0)::bigint as watermark, max(seq) as last, count(*) filter (seq <> i) as held from n group by 1""",
)
def p5_watermark(spark: SparkSession, d: str) -> DataFrame:
    return watermarks(table(spark, d, "wal_entry").select(clean_key("repo_id").alias("repo"), "seq").filter("repo IS NOT NULL"))
