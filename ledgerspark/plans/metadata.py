"""Queries of the relational operators, over the metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import predicates as P
from ledgerspark.functions import scalars as X
from ledgerspark.keys import clean_key, clean_key_sql
from ledgerspark.operators import relational as O
from ledgerspark.operators.windows import ranks
from ledgerspark.plans.registry import Registry, table
from ledgerspark.shared import union_all

R = Registry()
K = clean_key_sql
NOW = "2026-06-01"

_REFS = f"(select {K('repo_id')} repo_id, name, max({K('target')}) target from refs group by 1, 2)"
_MIRROR = f"(select {K('repo_id')} repo_id, name, max({K('target')}) target from refs_mirror group by 1, 2)"
_PACKS = f"(select {K('repo_id')} repo_id, name, max(size_bytes) size_bytes, max(source) source, max(created_at) created_at, max({K('blob_repo')}) blob_repo from packs group by 1, 2)"
_REPOS = f"(select {K('id')} id, max(default_branch) default_branch, max(created_at) created_at, bool_or(public) public from repos group by 1)"
_HOOKS = f"(select {K('id')} id, max({K('repo_id')}) repo_id, max(url) url, bool_or(active) active from webhooks group by 1)"
_JOBS = f"(select id, max({K('webhook_id')}) webhook_id, max({K('repo_id')}) repo_id, max(event) event, max(status) status, max(attempts) attempts, max(next_attempt_at) next_attempt_at, max(created_at) created_at from deliveries group by 1)"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def refs_of(spark: SparkSession, d: str, name: str = "refs") -> DataFrame:
    return table(spark, d, name).groupBy(clean_key("repo_id").alias("repo_id"), "name").agg(F.max(clean_key("target")).alias("target"))


def packs_of(spark: SparkSession, d: str) -> DataFrame:
    aggs = [F.max("size_bytes").alias("size_bytes"), F.max("source").alias("source"), F.max("created_at").alias("created_at"), F.max(clean_key("blob_repo")).alias("blob_repo")]
    return table(spark, d, "packs").groupBy(clean_key("repo_id").alias("repo_id"), "name").agg(*aggs)


def repos_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repos").groupBy(clean_key("id").alias("id")).agg(F.max("default_branch").alias("default_branch"), F.max("created_at").alias("created_at"), F.bool_or("public").alias("public"))


def hooks_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "webhooks").groupBy(clean_key("id").alias("id")).agg(F.max(clean_key("repo_id")).alias("repo_id"), F.max("url").alias("url"), F.bool_or("active").alias("active"))


def jobs_of(spark: SparkSession, d: str) -> DataFrame:
    plain = [F.max(c).alias(c) for c in ("event", "status", "attempts", "next_attempt_at", "created_at")]
    return table(spark, d, "deliveries").groupBy("id").agg(F.max(clean_key("webhook_id")).alias("webhook_id"), F.max(clean_key("repo_id")).alias("repo_id"), *plain)


def _side_by_side(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """Numbers (what, n) of one row each as the columns of one row."""
    return union_all(parts).agg(*[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in names])


# --- look-ups, filters, pages ---


@R.add("f1_lookup", f"select * from {_REPOS} where id = 'monorepo-trunk'")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return O.lookup(repos_of(spark, d), id="monorepo-trunk")


@R.add("f2_composite_lookup", f"select * from {_REFS} where repo_id = 'monorepo-trunk' and name = 'refs/heads/s00/main'")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return O.lookup(refs_of(spark, d), repo_id="monorepo-trunk", name="refs/heads/s00/main")


@R.add("f3_list_refs", f"select * from {_REFS} where repo_id = 'monorepo-trunk' order by name")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return O.lookup(refs_of(spark, d), repo_id="monorepo-trunk").orderBy("name")


@R.add("f4_search_log", "select doc_id, title, comment, n_chars from documents where source = 'openatlas' and (title ilike '%mill_%' or comment ilike '%mill_%') order by n_chars desc nulls last, doc_id desc limit 100")
def f4(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "title", "comment", "n_chars", "source")
    return O.search_log(docs, {"source": "openatlas"}, "mill_", ["title", "comment"], ["n_chars", "doc_id"], 501).drop("source")


@R.add("f5_prefix_filter", "select repo_id, name, target from refs where starts_with(name, 'refs/heads/fix/')")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").filter(P.has_any_prefix("name", ["refs/heads/fix/"]))


@R.add(
    "f7_namespace_view",
    f"select repo_id, name, target, 'normal' as seen from {_REFS} where not starts_with(name, 'refs/namespaces/') union all select repo_id, substr(name, 21), target, 'eph' from {_REFS} where starts_with(name, 'refs/namespaces/eph/')",
)
def f7(spark: SparkSession, d: str) -> DataFrame:
    refs = refs_of(spark, d)
    return O.visible_refs(refs).withColumn("seen", F.lit("normal")).unionByName(O.visible_refs(refs, "eph").withColumn("seen", F.lit("eph")))


@R.add(
    "f8_branches",
    f"""select r.repo_id, substr(r.name, 12) as branch, r.target, coalesce(substr(r.name, 12) = p.default_branch, false) as is_default
    from {_REFS} r left join {_REPOS} p on p.id = r.repo_id where starts_with(r.name, 'refs/heads/')""",
)
def f8(spark: SparkSession, d: str) -> DataFrame:
    heads = refs_of(spark, d).filter(F.col("name").startswith("refs/heads/"))
    both = heads.join(repos_of(spark, d).select(F.col("id").alias("repo_id"), "default_branch"), "repo_id", "left")
    branch = X.short_name("name")
    return both.select("repo_id", branch.alias("branch"), "target", F.coalesce(branch == F.col("default_branch"), F.lit(False)).alias("is_default"))


@R.add(
    "f9_resolve_revision",
    f"""with asked as (select distinct repo_id, substr(name, 12) rev from {_REFS} where starts_with(name, 'refs/heads/') union select repo_id, substr(name, 11) from {_REFS} where starts_with(name, 'refs/tags/')
      union select repo_id, name from {_REFS} where starts_with(name, 'refs/namespaces/') union select repo_id, substr(target, 1, 8) from {_REFS} where target is not null),
    r as (select * from {_REFS} where target is not null)
    select a.repo_id, a.rev, coalesce(x.target, h.target, t.target, case when regexp_matches(a.rev, '^[0-9a-f]{{4,64}}$') then a.rev end) as oid from asked a
    left join r x on x.repo_id = a.repo_id and x.name = a.rev left join r h on h.repo_id = a.repo_id and h.name = 'refs/heads/' || a.rev left join r t on t.repo_id = a.repo_id and t.name = 'refs/tags/' || a.rev""",
)
def f9(spark: SparkSession, d: str) -> DataFrame:
    refs = refs_of(spark, d)
    heads = refs.filter(F.col("name").startswith("refs/heads/")).select("repo_id", F.expr("substring(name, 12)").alias("rev"))
    tags = refs.filter(F.col("name").startswith("refs/tags/")).select("repo_id", F.expr("substring(name, 11)").alias("rev"))
    whole = refs.filter(F.col("name").startswith("refs/namespaces/")).select("repo_id", F.col("name").alias("rev"))
    short = refs.filter("target IS NOT NULL").select("repo_id", F.substring("target", 1, 8).alias("rev"))
    return O.resolve_revision(refs, heads.union(tags).union(whole).union(short).distinct())


@R.add("f21_list_hooks", "select id, repo_id, array_to_string(events, ' ') as events, active from webhooks where coalesce(active, false) order by created_at, id")
def f21(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "webhooks").filter(F.coalesce("active", F.lit(False))).orderBy("created_at", "id").select("id", "repo_id", X.join_words("events").alias("events"), "active")


#: The limits of the original.
MAX_INLINE, MAX_EXTERNALS = 10 << 20, 512


@R.add("f22_size_gate", f"select doc_id, octet_length(encode(text)) > {MAX_INLINE} as too_large, case when octet_length(encode(text)) <= {MAX_INLINE} then base64(encode(text)) end as content from documents")
def f22(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("text")
    return table(spark, d, "documents").select("doc_id", (size > MAX_INLINE).alias("too_large"), F.when(size <= MAX_INLINE, X.b64("text")).alias("content"))


@R.add("o1_keyset_page", f"select id, created_at from {_REPOS} where id > 'kelp' order by id limit 100")
def o1(spark: SparkSession, d: str) -> DataFrame:
    return O.keyset_page(repos_of(spark, d).select("id", "created_at"), "id", "kelp", 0)[0]


@R.add("o1_next_cursor", f"select case when count(*) > 100 then list_sort(list(id))[100] end as next from (select id from {_REPOS} where id > 'c' order by id limit 101)")
def o1_next(spark: SparkSession, d: str) -> DataFrame:
    return O.keyset_page(repos_of(spark, d).select("id"), "id", "c", 0)[1]


@R.add("o3_recent_jobs", f"select id, repo_id, status, created_at from {_JOBS} order by created_at desc nulls last, id limit 50")
def o3(spark: SparkSession, d: str) -> DataFrame:
    return jobs_of(spark, d).select("id", "repo_id", "status", "created_at").orderBy(F.desc("created_at"), "id").limit(O.RECENT)


@R.add("o4_two_keys_desc", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 500")
def o4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(O.AUDIT_MOST)


@R.add("o5_pack_order", f"select repo_id, name, row_number() over (partition by repo_id order by created_at nulls first, name) as pos from {_PACKS}")
def o5(spark: SparkSession, d: str) -> DataFrame:
    return ranks(packs_of(spark, d).select("repo_id", "name", "created_at"), ["created_at", "name"], "pos", ["repo_id"]).select("repo_id", "name", "pos")


@R.add(
    "o6_tree_order",
    "select p_name, kind, row_number() over (order by encode(case when kind = 'tree' then p_name || '/' else p_name end), p_partkey) as pos from (select p_partkey, p_name, case when p_partkey % 3 = 0 then 'tree' else 'blob' end kind from part)",
)
def o6(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 3 == 0, "tree").otherwise("blob")
    p = table(spark, d, "part").select("p_partkey", "p_name", kind.alias("kind"))
    return ranks(p.withColumn("place", O.tree_order(F.col("kind"), F.col("p_name"))), ["place", "p_partkey"], "pos").select("p_name", "kind", "pos")


@R.add("o8_numeric_order", "select distinct lpad(seq::varchar, 16, '0') || '.json' as name, seq from wal_entry order by seq")
def o8(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "wal_entry").select(F.concat(F.lpad(F.col("seq").cast("string"), 16, "0"), F.lit(".json")).alias("name")).distinct()
    return named.select("name", F.regexp_extract("name", r"^(\d+)\.json$", 1).cast("long").alias("seq")).orderBy("seq")


# --- joins ---


@R.add("j1_due_jobs", f"select j.id, j.webhook_id, j.next_attempt_at, h.url from {_JOBS} j join {_HOOKS} h on h.id = j.webhook_id where j.status = 'pending' and j.next_attempt_at <= timestamp '{NOW}' order by j.next_attempt_at, j.id limit 20")
def j1(spark: SparkSession, d: str) -> DataFrame:
    return O.due_jobs(jobs_of(spark, d), hooks_of(spark, d), now()).select("id", "webhook_id", "next_attempt_at", "url")


@R.add(
    "j2_fan_out",
    f"""with e as (select id as event_id, repo_id, event from {_JOBS} where event <> ''), h as (select distinct {K('id')} hook, {K('repo_id')} repo_id, events, active from webhooks)
    select e.event_id, e.event, h.hook from e join h using (repo_id) where h.active and (list_contains(h.events, e.event) or list_contains(h.events, '*'))""",
)
def j2(spark: SparkSession, d: str) -> DataFrame:
    events = jobs_of(spark, d).select(F.col("id").alias("event_id"), "repo_id", "event")
    hooks = table(spark, d, "webhooks").select(clean_key("id").alias("hook"), clean_key("repo_id").alias("repo_id"), "events", "active").distinct()
    return O.fan_out(events, hooks, P.hook_matches("active", "events", "event")).select("event_id", "event", "hook")


@R.add("j3_borrowed_packs", f"select repo_id, name, size_bytes from {_PACKS} p where exists (select 1 from {_PACKS} b where b.blob_repo = p.repo_id)")
def j3(spark: SparkSession, d: str) -> DataFrame:
    packs = packs_of(spark, d)
    return O.referenced(packs, packs.select(F.col("blob_repo").alias("repo_id")), ["repo_id"]).select("repo_id", "name", "size_bytes")


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """Files as a store would list them: the pack and index of every delivery's repo and pack, some of them unknown."""
    packs = table(spark, d, "packs").select(clean_key("repo_id").alias("repo_id"), "name", "created_at", "size_bytes").distinct()
    stem = F.when(F.col("size_bytes") % 3 == 0, F.concat("name", F.lit("-old"))).when(F.col("size_bytes") % 7 == 0, F.concat(F.lit("staged/"), "name")).otherwise(F.col("name"))
    return packs.select("repo_id", F.concat(stem, F.when(F.col("size_bytes") % 2 == 0, ".pack").otherwise(".idx")).alias("name"), F.col("created_at").alias("modified"))


_LISTING = f"""(select repo_id, case when size_bytes % 3 = 0 then name || '-old' when size_bytes % 7 = 0 then 'staged/' || name else name end || case when size_bytes % 2 = 0 then '.pack' else '.idx' end as name, created_at as modified
  from (select distinct {K('repo_id')} repo_id, name, created_at, size_bytes from packs))"""


@R.add(
    "j4_orphan_sweep",
    f"""with l as (select *, regexp_replace(name, '\\.(pack|idx|bitmap)$', '') stem from {_LISTING} where modified < timestamp '{NOW}' - interval 1 hour)
    select repo_id, name, modified from l where starts_with(name, 'staged/') or not exists (select 1 from {_PACKS} p where p.repo_id = l.repo_id and p.name = l.stem)
      and not exists (select 1 from {_PACKS} b where b.blob_repo = l.repo_id and b.name = l.stem)""",
)
def j4(spark: SparkSession, d: str) -> DataFrame:
    packs = packs_of(spark, d)
    known = packs.select("repo_id", F.col("name").alias("stem"))
    shared = packs.select(F.col("blob_repo").alias("repo_id"), F.col("name").alias("stem"))
    return O.sweep_orphans(_listing(spark, d), known, shared, now())


@R.add("j5_purge_list", f"select repo_id, name from {_PACKS} p where not exists (select 1 from {_PACKS} b where b.blob_repo = p.repo_id and b.name = p.name)")
def j5(spark: SparkSession, d: str) -> DataFrame:
    packs = packs_of(spark, d)
    return O.without(packs.select("repo_id", "name"), packs.select(F.col("blob_repo").alias("repo_id"), "name"), ["repo_id", "name"])


@R.add(
    "j6_object_batch",
    f"""with a as (select repo_id, case when length(name) % 5 = 0 then name else sha256(name) end oid, case length(name) % 3 when 0 then 'download' when 1 then 'upload' else 'verify' end op from {_REFS}),
    s as (select distinct repo_id, sha256(name) oid from {_MIRROR})
    select a.repo_id, a.oid, op, case when not regexp_matches(a.oid, '^[a-f0-9]{{64}}$') then '422 oid' when op not in ('download', 'upload') then '422 operation' when op = 'download' and s.oid is null then '404'
      when op = 'upload' and s.oid is not null then 'none' else op end as action from a left join s on s.repo_id = a.repo_id and s.oid = a.oid""",
)
def j6(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("name")
    asked = refs_of(spark, d).select("repo_id", F.when(n % 5 == 0, F.col("name")).otherwise(X.sha256_hex("name")).alias("oid"), F.when(n % 3 == 0, "download").when(n % 3 == 1, "upload").otherwise("verify").alias("op"))
    return O.object_batch(asked, refs_of(spark, d, "refs_mirror").select("repo_id", X.sha256_hex("name").alias("oid")))


@R.add("j7_missing_parts", f"select distinct p.repo_id, p.name from {_PACKS} p cross join (values ('.pack'), ('.idx')) t(ext) where not exists (select 1 from {_LISTING} l where l.repo_id = p.repo_id and l.name = p.name || t.ext)")
def j7(spark: SparkSession, d: str) -> DataFrame:
    return O.missing_parts(packs_of(spark, d).select("repo_id", "name"), _listing(spark, d).select("repo_id", F.col("name").alias("file")))


@R.add(
    "j8_mirror_diff",
    f"""select coalesce(a.repo_id, b.repo_id) repo_id, coalesce(a.name, b.name) name, case when b.name is null then 'delete' when a.name is null or a.target is distinct from b.target then 'write' else 'skip' end action,
    coalesce(b.target, a.target) target from {_MIRROR} a full outer join {_REFS} b on a.repo_id = b.repo_id and a.name = b.name""",
)
def j8(spark: SparkSession, d: str) -> DataFrame:
    return O.mirror_diff(refs_of(spark, d, "refs_mirror"), refs_of(spark, d), ["repo_id", "name"], "target")


@R.add(
    "j9_moved_refs",
    f"""select a.* from {_REFS} a left join {_MIRROR} b on a.repo_id = b.repo_id and a.name = b.name where (b.name is null or a.target is distinct from b.target)
    and not exists (select 1 from commits c where {K('c.sha')} = a.target)""",
)
def j9(spark: SparkSession, d: str) -> DataFrame:
    proven = table(spark, d, "commits").select(clean_key("sha").alias("target"))
    return O.moved(refs_of(spark, d), refs_of(spark, d, "refs_mirror"), ["repo_id", "name"], "target", proven)


@R.add(
    "j10_visible_tips",
    f"select m.repo_id, count(*) filter (where t.target is null) = 0 as ok, count(*) filter (where t.target is null) as n_missing from {_MIRROR} m left join (select distinct repo_id, target from {_REFS} where not starts_with(name, 'refs/namespaces/')) t on t.repo_id = m.repo_id and t.target = m.target group by 1",
)
def j10(spark: SparkSession, d: str) -> DataFrame:
    return O.all_within(refs_of(spark, d, "refs_mirror"), O.visible_refs(refs_of(spark, d)), ["repo_id"], "target")


@R.add("j11_covered_wants", f"select r.repo_id, count(*) filter (where c.k is null) = 0 as ok, count(*) filter (where c.k is null) as n_missing from {_REFS} r left join (select distinct {K('sha')} k from commits) c on c.k = r.target group by 1")
def j11(spark: SparkSession, d: str) -> DataFrame:
    refs = refs_of(spark, d)
    known = table(spark, d, "commits").select(clean_key("sha").alias("target")).distinct()
    tips = refs.join(known, "target", "left_semi").select("repo_id", "target")
    return O.all_within(refs, tips, ["repo_id"], "target")


@R.add(
    "j12_externals",
    f"""with p as (select distinct {K('unnest(parents)')} oid from commits), c as (select distinct {K('sha')} k from commits)
    select oid from p where oid is not null and oid not in (select k from c) and oid not in (select target from {_REFS} where target is not null) and oid not in (select target from {_MIRROR} where target is not null)""",
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    commits = table(spark, d, "commits")
    out = commits.select(F.explode("parents").alias("p")).select(clean_key("p").alias("oid")).filter("oid IS NOT NULL").distinct()
    for have in (commits.select(clean_key("sha").alias("oid")), refs_of(spark, d).select(F.col("target").alias("oid")), refs_of(spark, d, "refs_mirror").select(F.col("target").alias("oid"))):
        out = O.without(out, have, ["oid"])
    return out


@R.add(
    "j13_sized_entries",
    """select p.p_partkey, p.p_name as path, case when p_partkey % 4 = 0 then 'tree' else 'blob' end as type, case when p_partkey % 4 = 0 then 0 else coalesce(s.size, 0) end::bigint as size
    from part p left join (select l_partkey, max(l_quantity)::bigint size from lineitem where l_returnflag = 'R' group by 1) s on s.l_partkey = p.p_partkey""",
)
def j13(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("sha"), F.col("p_name").alias("path"), F.when(F.col("p_partkey") % 4 == 0, "tree").otherwise("blob").alias("type"))
    sizes = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("sha"), F.col("l_quantity").cast("long").alias("size"))
    return O.sized_entries(entries, sizes).select("p_partkey", "path", "type", "size")


@R.add("j14_superseded", f"select p.repo_id, p.name from {_PACKS} p where p.source <> 'gc' and p.blob_repo is null and not exists (select 1 from {_PACKS} b where b.blob_repo = p.repo_id and b.name = p.name)")
def j14(spark: SparkSession, d: str) -> DataFrame:
    packs = packs_of(spark, d)
    own = packs.filter("source <> 'gc' AND blob_repo IS NULL").select("repo_id", "name")
    return O.without(own, packs.select(F.col("blob_repo").alias("repo_id"), "name"), ["repo_id", "name"])


@R.add(
    "j15_same_tips",
    f"select coalesce(a.repo_id, b.repo_id) repo_id, bool_and(a.name is not null and b.name is not null and a.target is not distinct from b.target) same from {_REFS} a full outer join {_MIRROR} b on a.repo_id = b.repo_id and a.name = b.name group by 1",
)
def j15(spark: SparkSession, d: str) -> DataFrame:
    return O.same_maps(refs_of(spark, d), refs_of(spark, d, "refs_mirror"), ["repo_id"], "name", "target")


@R.add(
    "j16_sequence_gaps",
    f"""with s as (select distinct {K('repo_id')} repo_id, ts % 1000 as seq from wal_entry), n as (select repo_id, seq, lead(seq) over (partition by repo_id order by seq) nx from s)
    select repo_id, seq + 1 as gap_from, nx - 1 as gap_to from n where nx > seq + 1""",
)
def j16(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "wal_entry").select(clean_key("repo_id").alias("repo_id"), (F.col("ts") % 1000).alias("seq"))
    return O.sequence_gaps(w, ["repo_id"], "seq")


@R.add("j17_key_match", "select a.sig_id, b.sig_id as same_as from signatures a join signatures b on lower(trim(a.email)) = lower(trim(b.email)) and a.sig_id <> b.sig_id")
def j17(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "signatures").select("sig_id", F.lower(F.trim("email")).alias("wire"))
    return s.join(s.withColumnRenamed("sig_id", "same_as"), "wire").filter("sig_id <> same_as").select("sig_id", "same_as")


# --- aggregates ---


@R.add("a1_many_packs", f"select repo_id, count(*) n from {_PACKS} group by 1 having count(*) >= 5")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return packs_of(spark, d).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@R.add("a2_usage", f"select (select count(*) from {_REPOS}) repos, (select coalesce(sum(size_bytes), 0)::bigint from {_PACKS}) pack_bytes, (select coalesce(sum(n_chars), 0)::bigint from documents) large_bytes")
def a2(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        repos_of(spark, d).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("repos")),
        packs_of(spark, d).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("n")).withColumn("what", F.lit("pack_bytes")),
        table(spark, d, "documents").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("n")).withColumn("what", F.lit("large_bytes")),
    ]
    return _side_by_side(parts, ["repos", "pack_bytes", "large_bytes"])


@R.add("a3_is_borrowed", f"select count(*) > 0 as borrowed from {_PACKS} where blob_repo = 'monorepo-trunk'")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return packs_of(spark, d).filter("blob_repo = 'monorepo-trunk'").agg((F.count(F.lit(1)) > 0).alias("borrowed"))


@R.add("a4_placement", f"select repo_id, sum(size_bytes)::bigint total, coalesce(sum(size_bytes), 0) > 100000 as remote from {_PACKS} group by 1")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return packs_of(spark, d).groupBy("repo_id").agg(F.sum("size_bytes").alias("total"), (F.coalesce(F.sum("size_bytes"), F.lit(0)) > 100_000).alias("remote"))


@R.add("a5_quiet", f"select repo_id, max(created_at) newest, max(created_at) <= timestamp '{NOW}' - interval 5 minute as quiet from {_PACKS} group by 1")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return packs_of(spark, d).groupBy("repo_id").agg(F.max("created_at").alias("newest")).withColumn("quiet", F.col("newest") <= now() - F.expr("INTERVAL 5 MINUTES"))


@R.add("a6_counters", "select string_agg(event_type || '=' || n, ',' order by event_type) as counts from (select event_type, count(*) n from events group by 1)")
def a6(spark: SparkSession, d: str) -> DataFrame:
    m = O.counters(table(spark, d, "events"), "event_type")
    return m.select(F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@R.add(
    "a7_commit_telemetry",
    f"""with e as (select {K('repo_id')} repo_id, seq, max(len(updates)) n, max(epoch(received_at) - ts) lag_s from wal_entry group by 1, 2)
    select repo_id, count(*) puts, sum(coalesce(n, 0))::bigint txs, max(n) max_batch, round(sum(coalesce(n, 0)) / count(*), 6) avg_batch from e group by 1""",
)
def a7(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "wal_entry").groupBy(clean_key("repo_id").alias("repo_id"), "seq").agg(F.max(F.when(F.col("updates").isNotNull(), F.size("updates"))).alias("n"))
    txs = F.sum(F.coalesce("n", F.lit(0)))
    return e.groupBy("repo_id").agg(F.count(F.lit(1)).alias("puts"), txs.alias("txs"), F.max("n").cast("long").alias("max_batch"), F.round(txs / F.count(F.lit(1)), 6).alias("avg_batch"))


@R.add(
    "a8_nearest_rank",
    """select l_returnflag, n, v[least(n - 1, floor(n * 0.5::double)::bigint) + 1] as p50, v[least(n - 1, floor(n * 0.95::double)::bigint) + 1] as p95, v[least(n - 1, floor(n * 0.99::double)::bigint) + 1] as p99,
    v[least(n - 1, floor(n * 1.0::double)::bigint) + 1] as p100 from (select l_returnflag, count(*) n, list_sort(list(l_extendedprice)) v from lineitem group by 1)""",
)
def a8(spark: SparkSession, d: str) -> DataFrame:
    return O.nearest_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.95, 0.99, 1.0])


@R.add("a9_median", f"select event, n, v[(n // 2) + 1] as p50, v[least(n - 1, floor(n * 0.95::double)::bigint) + 1] as p95 from (select event, count(attempts) n, list_sort(list(attempts) filter (where attempts is not null)) v from {_JOBS} group by 1 having count(attempts) > 0)")
def a9(spark: SparkSession, d: str) -> DataFrame:
    # floor(n * 0.5) is n // 2
    return O.nearest_rank(jobs_of(spark, d), ["event"], "attempts", [0.5, 0.95])


@R.add("a10_throughput", "select event_type, count(*) n, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 9) as per_s from events group by 1")
def a10(spark: SparkSession, d: str) -> DataFrame:
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / span, 9).alias("per_s"))


@R.add("a11_first_by_content", "select sha256(coalesce(text, '')) as oid, min(doc_id) as doc_id from documents group by 1")
def a11(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(X.sha256_hex(F.coalesce("text", F.lit(""))).alias("oid"), "doc_id")
    return O.first_by(docs, ["oid"], "doc_id")


@R.add("a12_tips", f"select repo_id, substr(sha1(name), 1, 2) as part, string_agg(name || '=' || coalesce(target, ''), ' ' order by name) tips from {_REFS} group by 1, 2")
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Tips as maps, each repo's in up to 256 parts by name hash, so that no row holds all refs of a large repo."""
    tips = F.array_sort(F.collect_list(F.struct("name", F.coalesce("target", F.lit("")).alias("t"))))
    parts = refs_of(spark, d).groupBy("repo_id", F.substring(F.sha1(F.col("name").cast("binary")), 1, 2).alias("part"))
    return parts.agg(F.array_join(F.transform(tips, lambda e: F.concat(e["name"], F.lit("="), e["t"])), " ").alias("tips"))


@R.add("a14_report", f"select count(*) packs, sum(size_bytes)::bigint bytes, count(*) filter (where source = 'gc') gc, count(distinct repo_id) repos, min(created_at) oldest from {_PACKS}")
def a14(spark: SparkSession, d: str) -> DataFrame:
    gc = F.sum(F.when(F.col("source") == "gc", 1).otherwise(0))
    return packs_of(spark, d).agg(F.count(F.lit(1)).alias("packs"), F.sum("size_bytes").alias("bytes"), gc.alias("gc"), F.count_distinct("repo_id").alias("repos"), F.min("created_at").alias("oldest"))


# --- set operations ---


@R.add("u1_union_dedupe", f"select distinct repo_id, name, target from (select * from {_REFS} union all select * from {_MIRROR})")
def u1(spark: SparkSession, d: str) -> DataFrame:
    return refs_of(spark, d).unionByName(refs_of(spark, d, "refs_mirror")).dropDuplicates(["repo_id", "name", "target"])


@R.add("u3_copy_filtered", f"select * from {_REFS} union all select 'copy-of-trunk', name, target from {_REFS} where repo_id = 'monorepo-trunk' and not starts_with(name, 'refs/namespaces/')")
def u3(spark: SparkSession, d: str) -> DataFrame:
    return O.fork_refs(refs_of(spark, d), "monorepo-trunk", "copy-of-trunk")


@R.add("u5_set_equality", f"select (select count(*) from (select * from {_REFS} except all select * from {_MIRROR})) only_left, (select count(*) from (select * from {_MIRROR} except all select * from {_REFS})) only_right")
def u5(spark: SparkSession, d: str) -> DataFrame:
    a, b = refs_of(spark, d), refs_of(spark, d, "refs_mirror")
    parts = [x.exceptAll(y).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(w)) for x, y, w in ((a, b, "only_left"), (b, a, "only_right"))]
    return _side_by_side(parts, ["only_left", "only_right"])


# --- changes of tables ---


@R.add("m10_upsert", f"select repo_id, name, target from {_MIRROR} union all select * from {_REFS} r where not exists (select 1 from {_MIRROR} m where m.repo_id = r.repo_id and m.name = r.name)")
def m10(spark: SparkSession, d: str) -> DataFrame:
    return O.upsert(refs_of(spark, d), refs_of(spark, d, "refs_mirror"), ["repo_id", "name"])


@R.add("m11_insert_ignore", f"select repo_id, name, target from {_REFS} union all select * from {_MIRROR} m where not exists (select 1 from {_REFS} r where m.repo_id = r.repo_id and m.name = r.name)")
def m11(spark: SparkSession, d: str) -> DataFrame:
    return O.insert_ignore(refs_of(spark, d), refs_of(spark, d, "refs_mirror"), ["repo_id", "name"])


@R.add(
    "m12_replace_packs",
    f"""select repo_id, name, size_bytes, source, blob_repo from {_PACKS} where repo_id <> 'monorepo-trunk' or source = 'gc'
    union all select 'monorepo-trunk', 'pack-consolidated', sum(size_bytes)::bigint, 'gc', null from {_PACKS} where repo_id = 'monorepo-trunk' and source <> 'gc'""",
)
def m12(spark: SparkSession, d: str) -> DataFrame:
    packs = packs_of(spark, d).select("repo_id", "name", "size_bytes", "source", "blob_repo")
    old = packs.filter("repo_id = 'monorepo-trunk' AND source <> 'gc'")
    new = old.agg(F.lit("monorepo-trunk").alias("repo_id"), F.lit("pack-consolidated").alias("name"), F.sum("size_bytes").alias("size_bytes"), F.lit("gc").alias("source"), F.lit(None).cast("string").alias("blob_repo"))
    return O.replace_rows(packs, old, new, ["repo_id", "name"])


@R.add(
    "m13_fork",
    f"""select repo_id, name, size_bytes, source, blob_repo from {_PACKS} union all select 'fork-of-trunk', name, size_bytes, 'fork', coalesce(blob_repo, 'monorepo-trunk') from {_PACKS} where repo_id = 'monorepo-trunk'""",
)
def m13(spark: SparkSession, d: str) -> DataFrame:
    return O.fork_packs(packs_of(spark, d).select("repo_id", "name", "size_bytes", "source", "blob_repo"), "monorepo-trunk", "fork-of-trunk")


@R.add(
    "m14_cascade",
    " union all ".join(
        f"select '{n}' as tab, {c} as repo_id, count(*) n from {t} where coalesce({c}, '') <> 'monorepo-trunk' group by all" for n, t, c in (("deliveries", _JOBS, "repo_id"), ("packs", _PACKS, "repo_id"), ("refs", _REFS, "repo_id"), ("repos", _REPOS, "id"), ("webhooks", _HOOKS, "repo_id"))
    ),
)
def m14(spark: SparkSession, d: str) -> DataFrame:
    tables = {"deliveries": (jobs_of(spark, d), "repo_id"), "packs": (packs_of(spark, d), "repo_id"), "refs": (refs_of(spark, d), "repo_id"), "repos": (repos_of(spark, d), "id"), "webhooks": (hooks_of(spark, d), "repo_id")}
    left = O.cascade(tables, ["monorepo-trunk"])
    parts = [df.groupBy(F.lit(n).alias("tab"), F.col(tables[n][1]).alias("repo_id")).agg(F.count(F.lit(1)).alias("n")) for n, df in left.items()]
    return union_all(parts)


@R.add("m15_update_delete", f"select id, case when default_branch = 'master' then 'main' else default_branch end as default_branch, case when default_branch = 'master' then true else public end as public from {_REPOS} where not coalesce(starts_with(id, 'kelp-'), false)")
def m15(spark: SparkSession, d: str) -> DataFrame:
    kept = O.delete_where(repos_of(spark, d), F.col("id").startswith("kelp-"))
    return O.update_where(kept, F.col("default_branch") == "master", default_branch=F.lit("main"), public=F.lit(True)).select("id", "default_branch", "public")


@R.add("m16_retention", f"select id, status, created_at from {_JOBS} where not coalesce(status <> 'pending' and created_at < timestamp '{NOW}' - interval 30 day, false)")
def m16(spark: SparkSession, d: str) -> DataFrame:
    return O.delete_where(jobs_of(spark, d), (F.col("status") != "pending") & X.before_cutoff("created_at", NOW, 30)).select("id", "status", "created_at")


@R.add("m17_last_status", "select user_id, event_type as state, ts as since from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1")
def m17(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return last.select("user_id", F.col("m.event_type").alias("state"), F.col("m.ts").alias("since"))


@R.add("m18_change_token", f"select {K('repo_id')} repo_id, max(seq) as token, count(distinct seq) as n from wal_entry group by 1")
def m18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wal_entry").groupBy(clean_key("repo_id").alias("repo_id")).agg(F.max("seq").alias("token"), F.count_distinct("seq").alias("n"))


@R.add("m19_backfill", f"select id as repo_id, default_branch from {_REPOS} r where not exists (select 1 from wal_entry w where {K('w.repo_id')} = r.id)")
def m19(spark: SparkSession, d: str) -> DataFrame:
    repos = repos_of(spark, d).select(F.col("id").alias("repo_id"), "default_branch")
    return O.without(repos, table(spark, d, "wal_entry").select(clean_key("repo_id").alias("repo_id")), ["repo_id"])


@R.add("m23_transitions", f"select repo_id, seq, u.Name as name, u.New as new, u.Old as old from (select repo_id, seq, unnest(updates) u from wal_entry where len(updates) <= {MAX_EXTERNALS})")
def m23(spark: SparkSession, d: str) -> DataFrame:
    """The table has no externals; updates stand for them."""
    w = table(spark, d, "wal_entry").filter(F.size("updates") <= MAX_EXTERNALS)
    return w.select("repo_id", "seq", F.explode("updates").alias("u")).select("repo_id", "seq", F.col("u.Name").alias("name"), F.col("u.New").alias("new"), F.col("u.Old").alias("old"))
