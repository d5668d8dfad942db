"""Queries of pushes, imports, outbox and upkeep of packs, over the log as received and the metadata tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import codec
from ledgerspark.functions import scalars as X
from ledgerspark.keys import clean_key, clean_key_sql
from ledgerspark.operators import commit, folds, graph, maintain
from ledgerspark.plans.graphs import _EDGES, _reach, commit_edges, commits_of, tips
from ledgerspark.plans.integrity import _replay_sql
from ledgerspark.plans.metadata import _HOOKS, _JOBS, _MIRROR, _PACKS, _REFS, _REPOS, NOW, hooks_of, jobs_of, now, packs_of, refs_of, repos_of
from ledgerspark.plans.registry import Registry, table
from ledgerspark.shared import cut, shared_dir
from ledgerspark.sources import blobs, packs

R = Registry()
K = clean_key_sql


def whole_entries(spark: SparkSession, d: str) -> DataFrame:
    """(repo, seq, updates, events, packs) of every log entry: of its copies the updates of the first one that has any, and
    all events and packs that any of them has."""
    w = table(spark, d, "wal_entry").select(clean_key("repo_id").alias("repo"), "seq", "updates", "events", "packs", F.coalesce("received_at", F.lit("9999-12-31").cast("timestamp_ntz")).alias("at")).filter("repo IS NOT NULL AND seq IS NOT NULL")
    ups = F.transform("updates", lambda u: F.struct(u["Name"].alias("name"), clean_key(u["Old"]).alias("old"), clean_key(u["New"]).alias("new")))
    events = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("events", lambda e: F.struct(e["Name"].alias("name"), e["Payload"].alias("payload")))))))
    brought = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("packs", lambda p: F.struct(p["name"].alias("name")))))))
    first = F.min(F.when(F.size("updates") > 0, F.struct("at", ups.alias("u"))))["u"]
    return w.groupBy("repo", "seq").agg(first.alias("updates"), events.alias("events"), brought.alias("packs"))


def _hooks(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "webhooks").groupBy(clean_key("id").alias("id")).agg(F.max("events").alias("events"))
    return hooks_of(spark, d).join(events, "id").select("id", F.col("repo_id").alias("repo"), "events", "active")


_HOOK = f"(select h.id, h.repo_id as repo, unnest(w.events) as wanted from {_HOOKS} h join (select {K('id')} id, max(events) events from webhooks group by 1) w using (id) where h.active)"
_EVENTS = f"(select distinct {K('repo_id')} repo, seq, e.Name as event, e.Payload as payload from (select repo_id, seq, unnest(events) e from wal_entry) where seq is not null and e.Name <> '')"
_JOBS_MADE = f"(select distinct e.repo, e.seq, e.event, e.payload, h.id from {_EVENTS} e join {_HOOK} h on h.repo = e.repo and h.wanted in (e.event, '*'))"
_STATE = f"""(select repo, name, new as target from (select *, row_number() over (partition by repo, name order by seq desc, i desc) rn from (select repo, seq, i, updates[i].Name as name, {K('updates[i].New')} as new from (
    select repo, seq, updates, unnest(range(1, len(updates) + 1)) i from (select {K('repo_id')} repo, seq, arg_min(updates, coalesce(received_at, timestamp '9999-12-31')) updates from wal_entry where {K('repo_id')} is not null and seq is not null and len(updates) > 0 group by 1, 2)))) where rn = 1 and new is not null)"""


@R.add(
    "m4_applied",
    f"""with s as (select {K('repo_id')} repo, max(seq) seq from wal_entry where {K('repo_id')} is not null and seq is not null group by 1), r as (select repo, count(*) n from {_STATE} group by 1),
    p as (select repo, count(*) n from (select {K('repo_id')} repo, name from packs union select {K('repo_id')}, p.name from (select repo_id, unnest(packs) p from wal_entry where seq is not null) where p.name is not null) group by 1), j as (select repo, count(*) n from {_JOBS_MADE} group by 1)
    select s.repo, s.seq, coalesce(r.n, 0)::bigint refs, coalesce(p.n, 0)::bigint packs, coalesce(j.n, 0)::bigint jobs from s left join r using (repo) left join p using (repo) left join j using (repo)""",
)
def m4(spark: SparkSession, d: str) -> DataFrame:
    """What applying the whole log leaves of each table, by repo."""
    e = cut(whole_entries(spark, d))
    none = spark.createDataFrame([], "repo string, name string, target string")
    out = commit.apply_entries(e, none, packs_of(spark, d).select(F.col("repo_id").alias("repo"), "name"), _hooks(spark, d))
    n = {c: out[t].groupBy("repo").agg(F.count(F.lit(1)).alias(c)) for c, t in (("refs", "refs"), ("packs", "packs"), ("jobs", "outbox"))}
    return out["seqs"].join(n["refs"], "repo", "left").join(n["packs"], "repo", "left").join(n["jobs"], "repo", "left").fillna(0, ["refs", "packs", "jobs"])


_VERDICTS = _replay_sql().rpartition("select repo as repo_id")[0] + ", v as (select u.repo, u.seq, arg_max(f.ok, u.i) ok from f join u on u.repo = f.repo and u.k = f.k group by 1, 2)"


def _pushes(spark: SparkSession, d: str) -> DataFrame:
    return whole_entries(spark, d).filter("size(updates) > 0").withColumns({"arrival": F.col("seq"), "tx_id": F.col("seq").cast("string")})


@R.add("m1_log_verdicts", _VERDICTS + " select repo, seq as arrival, ok from v")
def m1_log(spark: SparkSession, d: str) -> DataFrame:
    """Which entries of the log find what they expect."""
    return folds.cas_commit(_pushes(spark, d).select("repo", "arrival", "tx_id", "updates")).select("repo", "arrival", "ok")


@R.add("m20_pushes", _VERDICTS + f" select v.repo, count(*) n, count(*) filter (ok) n_ok, (select count(*) from {_JOBS_MADE} j semi join (select * from v where ok) w on w.repo = j.repo and w.seq = j.seq where j.repo = v.repo)::bigint jobs from v group by 1")
def m20(spark: SparkSession, d: str) -> DataFrame:
    """Every entry as a push: how many are accepted, and the jobs that these make."""
    verdicts, _, made = commit.apply_pushes(cut(_pushes(spark, d).drop("seq")), _hooks(spark, d))
    n = made.groupBy("repo").agg(F.count(F.lit(1)).alias("jobs"))
    return verdicts.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok")).join(n, "repo", "left").fillna(0, ["jobs"])


@R.add(
    "m21_delete_batches",
    f"""with x as (select {K('repo_id')} repo, seq, arg_min(updates, coalesce(received_at, timestamp '9999-12-31')) u from wal_entry where {K('repo_id')} is not null and seq is not null and len(updates) > 0 group by 1, 2)
    select x.repo, x.seq, case when r.id is not null and len(list_filter(u, lambda y: {K('y.New')} is not null or y.Name is null or y.Name = 'refs/heads/' || coalesce(r.default_branch, 'main'))) = 0 then 'batch' else 'full' end as way from x left join {_REPOS} r on r.id = x.repo""",
)
def m21(spark: SparkSession, d: str) -> DataFrame:
    return commit.route_deletes(_pushes(spark, d), repos_of(spark, d).select(F.col("id").alias("repo"), "default_branch")).select("repo", "seq", "way")


@R.add(
    "m22_claims",
    f"""with k as (select distinct {K('id')} id from repos where {K('id')} is not null), a as (select {K('repo_id')} id, name from packs), f as (select id, min(name) n from a where id is not null group by 1)
    select a.id, a.name, coalesce(a.id not in (select id from k) and a.name is not distinct from f.n and f.n is not null, false) as created from a left join f using (id)""",
)
def m22(spark: SparkSession, d: str) -> DataFrame:
    """Every pack claims its repo, in order of names."""
    known = repos_of(spark, d).select("id").filter("id IS NOT NULL")
    return commit.claim(known, table(spark, d, "packs").select(clean_key("repo_id").alias("id"), "name"), "id", "name")[1]


@R.add("s18_imports", f"select m.repo_id as repo, count(*) n, bool_and(r.repo_id is null) as ok from (select * from {_MIRROR} where starts_with(name, 'refs/') and target is not null and repo_id is not null) m left join (select distinct repo_id, name from {_REFS} where name like '%main') r on r.repo_id = m.repo_id and r.name = m.name group by 1")
def s18(spark: SparkSession, d: str) -> DataFrame:
    """The mirror's refs imported into repos of which only main is there."""
    theirs = refs_of(spark, d, "refs_mirror").filter("repo_id IS NOT NULL").withColumnRenamed("repo_id", "repo")
    return commit.import_refs(theirs, refs_of(spark, d).filter("name LIKE '%main'").withColumnRenamed("repo_id", "repo"))


@R.add("s19_staged", "select doc_id from documents where text <> '' and doc_id % 3 <> 0")
def s19(spark: SparkSession, d: str) -> DataFrame:
    """Texts staged, every third of them with a broken end."""
    t = table(spark, d, "documents").filter("text <> ''").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    staged = t.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.unhex(F.lit("00")))).otherwise(F.col("content")))
    return commit.claim_staged(staged, t, "doc_id", "content").select("doc_id")


_CODE = "case attempts % 3 when 0 then 200 when 1 then 500 end"


@R.add(
    "t5_settled",
    f"""select id, case when status = 'pending' and coalesce({_CODE} between 200 and 299, false) then 'delivered' when status = 'pending' and coalesce(attempts, 0) + 1 >= 5 then 'failed' else status end as status,
    case when status = 'pending' then coalesce(attempts, 0) + 1 else attempts end as attempts,
    case when status = 'pending' and not coalesce({_CODE} between 200 and 299, false) and coalesce(attempts, 0) + 1 < 5 then timestamp '{NOW}' + to_seconds([30, 120, 600, 3600][coalesce(attempts, 0) + 1]) else next_attempt_at end as next_attempt_at from {_JOBS}""",
)
def t5(spark: SparkSession, d: str) -> DataFrame:
    """All pending jobs sent once: by their attempts, a third are answered well, a third badly, a third not at all."""
    jobs = cut(jobs_of(spark, d).select("id", "status", "attempts", "next_attempt_at"))
    code = F.when(F.col("attempts") % 3 == 0, 200).when(F.col("attempts") % 3 == 1, 500)
    return commit.settle_deliveries(jobs, jobs.select("id", code.alias("code")), now())


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts in packs of about a megabyte, with their indexes."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(F.lit("blob").alias("kind"), F.encode("text", "UTF-8").alias("data"), X.object_id("blob", "text").alias("oid"))
    return packs.repack(packs.size_groups(docs.withColumn("size", F.length("data")), "size", 1 << 20), "pack")


_OID = "sha1(('blob ' || octet_length(encode(text)))::blob || '\\x00'::blob || encode(text))"


@R.add("pk7_point_read", f"select distinct {_OID} as oid, sha256(text) as digest from documents where text is not null and lang = 'de'")
def pk7(spark: SparkSession, d: str) -> DataFrame:
    """The German texts out of packs of all of them, through the indexes."""
    asked = table(spark, d, "documents").filter("text IS NOT NULL AND lang = 'de'").select(X.object_id("blob", "text").alias("oid"))
    return packs.point_read(cut(_texts(spark, d)), asked).select("oid", F.sha2("data", 256).alias("digest"))


_TIPS_OF = f"(select repo_id, name, target from {{}} where repo_id is not null and name is not null and regexp_full_match(target, '[0-9a-f]{{{{40}}}}'))"


@R.add("s16_bundle_refs", f"select * from {_TIPS_OF.format(_REFS)}")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """A full bundle for each repo, of the commits that its refs name, read back."""
    heads = refs_of(spark, d).filter("repo_id IS NOT NULL AND name IS NOT NULL AND target IS NOT NULL")
    body = commits_of(spark, d).select(F.col("sha").alias("target"), F.lit("commit").alias("kind"), F.encode(F.concat(F.lit("tree "), F.coalesce("tree", F.lit("")), F.lit("\n\n")), "UTF-8").alias("data"))
    made = packs.bundles(heads.select("repo_id", "target").distinct().join(body, "target").select("repo_id", "kind", "data"), heads, "repo_id")
    return made.select("repo_id", F.explode(codec.bundle_refs_col("content")).alias("r")).select("repo_id", "r.name", F.col("r.oid").alias("target"))


@R.add(
    "s17_incremental",
    f"select count(*)::bigint as objects, (select count(distinct target) from {_MIRROR} where regexp_full_match(target, '[0-9a-f]{{40}}'))::bigint as known, (select count(*) from (select distinct name, target from {_REFS} where name is not null and regexp_full_match(target, '[0-9a-f]{{40}}')))::bigint as refs from (select node from {_reach('refs')} where node not in (select node from {_reach('refs_mirror')}) and node in (select {K('sha')} from commits))",
)
def s17(spark: SparkSession, d: str) -> DataFrame:
    """One bundle of what the refs reach beyond the mirror's, which needs these: its objects, refs and needs counted."""
    beyond = graph.reachable_difference(commit_edges(spark, d), tips(spark, d), tips(spark, d, "refs_mirror"))
    one = F.lit("all").alias("g")
    objects = commits_of(spark, d).join(beyond.select(F.col("node").alias("sha")), "sha", "left_semi").select(one, F.lit("commit").alias("kind"), F.encode(F.concat(F.lit("tree "), "sha", F.lit("\n\n")), "UTF-8").alias("data"))
    made = packs.bundles(objects, refs_of(spark, d).select(one, "name", "target"), "g", tips(spark, d, "refs_mirror").select(one, F.col("node").alias("target")))
    head = F.split(F.decode(F.col("content"), "ISO-8859-1"), "\n\nPACK", 2)
    lines = F.split(F.element_at(head, 1), "\n")
    count = F.conv(F.hex(F.substring(F.encode(F.element_at(head, 2), "ISO-8859-1"), 5, 4)), 16, 10).cast("long")
    return made.select(count.alias("objects"), F.size(F.filter(lines, lambda x: x.startswith("-"))).cast("long").alias("known"), (F.size(F.filter(lines, lambda x: x.rlike("^[0-9a-f]{40} ")))).cast("long").alias("refs"))


@R.add("b1_upkeep", f"select true as swapped, 4::bigint as packs_before, 1::bigint as packs_after, (select count(distinct {K('sha')}) from commits) as objects_before, (select count(*) from {_reach('refs')} where node in (select {K('sha')} from commits)) as objects_after")
def b1(spark: SparkSession, d: str) -> DataFrame:
    """All commits in four packs, consolidated into one of those that the refs reach, proved, swapped in, the old ones deleted."""
    at = f"{shared_dir(spark)}/ledgerspark/store-{uuid.uuid4().hex}"
    store = maintain.Packs(spark, blobs.store_at(spark, at), at)
    objects = cut(commits_of(spark, d).select(F.col("sha").alias("oid"), F.col("parents").alias("dst")))
    names = [store.write(objects.filter(F.pmod(F.xxhash64("oid"), F.lit(4)) == i)) for i in range(4)]
    store.put(1, names)
    return spark.createDataFrame([maintain.consolidate(store, lambda: tips(spark, d))], "swapped boolean, packs_before long, packs_after long, objects_before long, objects_after long")


@R.add("b14_remote_packs", f"with p as {_PACKS}, t as (select repo_id, sum(size_bytes) s from p group by 1) select p.repo_id, p.name from p join t on t.repo_id = p.repo_id where t.s > {5 << 20} and p.size_bytes > {1 << 20}")
def b14(spark: SparkSession, d: str) -> DataFrame:
    """What a replica leaves at the store, of repos of over 5 MiB."""
    return maintain.remote_packs(packs_of(spark, d), F.lit(True), 5 << 20).select("repo_id", "name")


@R.add("g18_patches", "select b.doc_id, sha256(b.text) as digest from documents a join documents b on b.parent_rev_id = a.rev_id and b.page_id = a.page_id where a.text is not null and b.text is not null group by all")
def g18(spark: SparkSession, d: str) -> DataFrame:
    """Every revision out of its parent and the diff between them."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    old = t.select("page_id", F.col("rev_id").alias("parent_rev_id"), F.col("text").alias("old"))
    both = t.select("doc_id", "page_id", "parent_rev_id", "text").join(old, ["page_id", "parent_rev_id"])
    return both.select("doc_id", X.sha256_hex(codec.patch_col("old", codec.diff_col("old", "text"))).alias("digest")).distinct()
