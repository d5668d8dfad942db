"""Queries of streams, sources, codecs and upkeep."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import codec
from ledgerspark.functions import scalars as X
from ledgerspark.keys import clean_key, clean_key_sql
from ledgerspark.operators import folds, maintain
from ledgerspark.operators.replay import assemble
from ledgerspark.plans.bits import fnv, hmac
from ledgerspark.plans.metadata import NOW, now, packs_of
from ledgerspark.plans.registry import Registry, table
from ledgerspark.shared import shared_dir
from ledgerspark.sources import blobs, packs
from ledgerspark.sources import log as logs
from ledgerspark.streaming import events as ev

R = Registry()
K = clean_key_sql
_EV = f"""(select {K('repo_id')} repo, seq, i - 1 as pos, updates[i].Name as ref, {K('updates[i].Old')} as old, {K('updates[i].New')} as new, ts
  from (select *, unnest(range(1, len(updates) + 1)) i from wal_entry where len(updates) > 0))"""


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # a pattern, because a stream takes a plain path for a folder and a table here may be one file
    return ev.read_log_stream(spark, f"{d}/{name}.parque[t]", table(spark, d, name).schema)


@R.add("t1_subscription", f"select repo, seq, pos::int as pos, ref, old, new, ts from {_EV} where repo = 'monorepo-trunk'")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return ev.run_available(ev.subscribe(ev.ref_events(_stream(spark, d, "wal_entry")), "monorepo-trunk"))


@R.add("t2_exactly_once", f"select distinct repo, seq, pos::int as pos, ref from {_EV}")
def t2(spark: SparkSession, d: str) -> DataFrame:
    rows = ev.ref_events(_stream(spark, d, "wal_entry")).withColumn("at", F.timestamp_seconds(F.lit(1_000_000_000)))
    return ev.run_available(ev.once(rows, "at").select("repo", "seq", "pos", "ref"))


@R.add(
    "t3_reset_marker",
    f"""with m as (select {K('repo_id')} repo, max(seq) // 64 * 64 upto from wal_entry group by 1), o as (select repo, min(seq) oldest from (select {K('repo_id')} repo, seq from wal_entry) join m using (repo) where seq > upto group by 1), a as (select *, length(repo) % 5 as af from o)
    select repo, true as reset, null::bigint as seq, null::int as pos from a where oldest > af + 1
    union all select distinct e.repo, false, e.seq, e.pos::int from {_EV} e join a using (repo) where oldest <= af + 1 and e.seq > af""",
)
def t3(spark: SparkSession, d: str) -> DataFrame:
    """Entries up to each repo's last snapshot, one for every 64 entries, count as pruned."""
    w = table(spark, d, "wal_entry")
    seqs = w.select(clean_key("repo_id").alias("repo"), "seq")
    upto = seqs.groupBy("repo").agg((F.floor(F.max("seq") / 64) * 64).alias("upto"))
    oldest = seqs.join(upto, "repo").filter("seq > upto").groupBy("repo").agg(F.min("seq").alias("seq"))
    after = oldest.select("repo", (F.length("repo") % 5).cast("long").alias("after"))
    return ev.with_resets(ev.ref_events(w).select("repo", "seq", "pos").distinct(), oldest, after)


@R.add("t4_resume_after", f"select distinct repo, seq, pos::int as pos, ref, new from {_EV} where repo = 'birch-gateway-15' and seq > 20")
def t4(spark: SparkSession, d: str) -> DataFrame:
    return ev.subscribe(ev.ref_events(table(spark, d, "wal_entry")), "birch-gateway-15", 20).select("repo", "seq", "pos", "ref", "new").distinct()


@R.add("t8_follow_log", f"select {K('repo_id')} repo, count(*) n, max(seq) as last from wal_entry group by 1")
def t8(spark: SparkSession, d: str) -> DataFrame:
    """A follower that adopts each batch of new entries into a table of its own."""
    followed = ev.run_available(_stream(spark, d, "wal_entry").select(clean_key("repo_id").alias("repo"), "seq"))
    return followed.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


@R.add("t10_sessions", """with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end b from events),
    s as (select *, sum(b) over (partition by user_id order by ts, event_id) s from e) select user_id, min(ts) as start, count(*) n from s group by user_id, s""")
def t10(spark: SparkSession, d: str) -> DataFrame:
    return ev.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n")).select("user_id", "start", "n")


@R.add("ext_tumbling_stream", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n from events where time_bucket(interval 1 hour, ts) + interval 1 hour <= (select max(ts) - interval 10 minute from events) group by all")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ev.run_available(ev.tumbling(e, "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add("t9_compaction_due", f"select repo_id, count(*) n, max(created_at) newest, count(*) >= 64 or (count(*) >= 2 and coalesce(max(created_at) <= timestamp '{NOW}' - interval 300 second, true)) as due from (select {K('repo_id')} repo_id, name, max(created_at) created_at from packs group by 1, 2) group by 1")
def t9(spark: SparkSession, d: str) -> DataFrame:
    return maintain.compaction_due(packs_of(spark, d), now())


@R.add(
    "t11_negative_cache",
    """with recursive e as (select user_id subject, ts as "at", event_id id, event_type is distinct from 'error' ok, epoch_us(ts) us, row_number() over (partition by user_id order by ts, event_id) i from events),
    f as (select subject, "at", id, i, true as asked, case when not ok then us + 3600000000 end as until from e where i = 1
      union all select e.subject, e."at", e.id, e.i, f.until is null or e.us >= f.until,
        case when f.until is null or e.us >= f.until then case when not e.ok then e.us + 3600000000 end else f.until end from f join e on e.subject = f.subject and e.i = f.i + 1)
    select subject, "at", id, asked from f""",
)
def t11(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("subject"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("found"))
    return folds.negative_cache(e, 3600)


@R.add("s23_event_frames", f"""select distinct repo, seq, pos::int as pos, 'id: ' || seq || chr(10) || 'event: ref' || chr(10) || 'data: {{"repo":"' || repo || '","seq":' || seq || ',"ref":"' || ref || '","old":"' || coalesce(old, repeat('0', 40)) || '","new":"' || coalesce(new, repeat('0', 40)) || '"}}' || chr(10) || chr(10) as frame from {_EV}""")
def s23(spark: SparkSession, d: str) -> DataFrame:
    return ev.frames(ev.ref_events(table(spark, d, "wal_entry"))).distinct()


@R.add("s20_blocks", "select doc_id, b.i as block, b.i * 1024 as offset, least(1024, n - b.i * 1024) as length from (select doc_id, octet_length(encode(text)) n from documents where text <> ''), lateral (select unnest(range((n - 1) // 1024 + 1)) i) b")
def s20(spark: SparkSession, d: str) -> DataFrame:
    return blobs.blocks(table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size")), block=1024).select("doc_id", "block", "offset", "length")


@R.add("s21_tiered_read", f"select k as oid, min(t) as tier from (select {K('target')} k, 0 t from refs union all select {K('target')}, 1 from refs_mirror union all select {K('sha')}, 2 from commits) where k is not null group by 1")
def s21(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(clean_key(c).alias("oid"), F.lit(t).alias("src")).filter("oid IS NOT NULL") for t, c in (("refs", "target"), ("refs_mirror", "target"), ("commits", "sha"))]
    return blobs.first_tier(parts).select("oid", "tier")


@R.add("s5_listing")
def s5(spark: SparkSession, d: str) -> DataFrame:
    """Every file of the folder of tables, with its size."""
    at = os.path.realpath(d)
    return blobs.listing(spark, os.path.dirname(at)).filter(F.col("repo_id") == os.path.basename(at)).select("name", "size")


@R.add("s27_hooks_as_json", f"select repo_id, count(*) n from (select {K('repo_id')} repo_id, id from webhooks where repo_id is not null) group by 1")
def s27(spark: SparkSession, d: str) -> DataFrame:
    hooks = table(spark, d, "webhooks").filter("repo_id IS NOT NULL").select(clean_key("repo_id").alias("repo_id"), "id", "url", "events", "active")
    saved = hooks.groupBy("repo_id").agg(F.to_json(F.collect_list(F.struct("id", "url", "events", "active"))).alias("body"))
    back = saved.select("repo_id", F.explode(F.from_json("body", "array<struct<id:string,url:string,events:array<string>,active:boolean>>")).alias("h"))
    return back.groupBy("repo_id").agg(F.count("h.id").alias("n"))


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select(F.lit("blob").alias("kind"), F.encode("text", "UTF-8").alias("data"), X.object_id("blob", "text").alias("oid"))


@R.add("s14_pack_round_trip", "select sha1(('blob ' || octet_length(encode(text)))::blob || '\\x00'::blob || encode(text)) as oid, octet_length(encode(text)) as size from documents where text is not null group by all")
def s14(spark: SparkSession, d: str) -> DataFrame:
    """All document texts packed into files of about a megabyte, and read back."""
    grouped = packs.size_groups(_objects(spark, d).withColumn("size", F.length("data")), "size", 1 << 20)
    made = packs.repack(grouped, "pack").select("content", F.lit("p").alias("path"))
    return packs.unpack(made, strict=True).select("oid", "size")


@R.add("s10_log_state", f"select repo, ref as name, new as target from (select *, row_number() over (partition by repo, ref order by seq desc, pos desc) rn from (select distinct * from {_EV})) where rn = 1 and new is not null")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """The log written as files, one per entry and repo, some compressed, and read back into refs."""
    entries = assemble(table(spark, d, "wal_entry"))
    root = f"{shared_dir(spark)}/ledgerspark-log-{uuid.uuid4().hex}"
    up = F.transform("updates", lambda u: F.struct(u["name"].alias("Name"), u["old"].alias("Old"), u["new"].alias("New")))
    body = entries.select("repo", "seq", codec.gzip_col(F.encode(F.to_json(F.struct("seq", up.alias("updates"))), "UTF-8")).alias("data"))
    return logs.current_refs(logs.through_store(body, root))


@R.add("x8_signatures", f"select id, 'sha256=' || {hmac("encode(coalesce(webhook_id, ''))", "encode(coalesce(payload, ''))")} as signature from deliveries")
def x8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "deliveries").select("id", codec.sign_col(F.coalesce("webhook_id", F.lit("")), F.coalesce("payload", F.lit(""))).alias("signature"))


@R.add("x4_weak_tags", f"""select repo_id, name, 'W/"' || ({fnv("b")}) || '"' as etag from (select repo_id, name, encode(concat_ws('/', '/repos', repo_id, name)) b from refs)""")
def x4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").select("repo_id", "name", F.concat(F.lit('W/"'), codec.fnv_col(F.concat_ws("/", F.lit("/repos"), "repo_id", "name")), F.lit('"')).alias("etag"))


@R.add("x11_gzip_round_trip", "select doc_id, sha256(text) as digest from documents")
def x11(spark: SparkSession, d: str) -> DataFrame:
    packed = table(spark, d, "documents").select("doc_id", codec.gzip_col(F.encode("text", "UTF-8")).alias("z"))
    return packed.select("doc_id", X.sha256_hex(codec.gunzip_col("z")).alias("digest"))


@R.add("b7_history_objects", f"select 'commit' as kind, count(distinct {K('sha')}) n from commits union all select 'tree', count(distinct {K('tree')}) from commits")
def b7(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commits")
    every = c.select(F.lit("commit").alias("kind"), clean_key("sha").alias("oid")).union(c.select(F.lit("tree"), clean_key("tree"))).union(table(spark, d, "documents").select(F.lit("blob"), F.sha1(F.encode("text", "UTF-8"))))
    return maintain.history_only(every).groupBy("kind").agg(F.count_distinct("oid").alias("n"))


@R.add(
    "b8_chain_plan",
    f"""with l as (select user_id, max(event_id) filter (where event_type = 'signup') lf, max(ts) filter (where event_type = 'signup') fa from events group by 1),
    s as (select user_id, count(*) filter (where lf is null or event_id > lf) since, any_value(fa) fa from events join l using (user_id) group by 1)
    select user_id, since, case when fa is null or fa <= (select max(ts) from events) - interval 7 day or since >= 32 then 'full' else 'incremental' end as action from s""",
)
def b8(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    at = e.agg(F.max("ts").alias("m")).collect()[0]["m"]
    return maintain.chain_plan(e, "user_id", "event_id", F.col("event_type") == "signup", "ts", F.lit(at).cast("timestamp_ntz"))
