"""Queries of record formats, log upkeep and recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import codec
from ledgerspark.functions import scalars as X
from ledgerspark.keys import clean_key, clean_key_sql
from ledgerspark.operators import graph, relational, windows
from ledgerspark.operators.replay import assemble
from ledgerspark.plans.bits import hmac
from ledgerspark.plans.metadata import packs_of, refs_of, repos_of
from ledgerspark.plans.registry import Registry, table
from ledgerspark.plans.sequences import changes
from ledgerspark.sources import blobs, packs
from ledgerspark.sources import log as logs

R = Registry()
K = clean_key_sql
_CHANGES = f"""(select distinct {K('repo_id')} repo, seq, i - 1 as pos, updates[i].Name as name, {K('updates[i].Old')} as old, {K('updates[i].New')} as new
  from (select repo_id, seq, updates, unnest(range(1, len(updates) + 1)) i from wal_entry where len(updates) > 0))"""
_LATEST = f"(select repo, name, new as target from (select *, row_number() over (partition by repo, name order by seq desc, pos desc) rn from {_CHANGES}) where rn = 1 and new is not null)"


def entries(spark: SparkSession, d: str) -> DataFrame:
    """The log as the reader of log files gives it."""
    e = assemble(table(spark, d, "wal_entry"))
    return e.select("repo", "seq", F.transform("updates", lambda u: F.struct(u["name"].alias("Name"), u["old"].alias("Old"), u["new"].alias("New"))).alias("updates"), F.lit(0).cast("long").alias("ts"))


def snapshots(spark: SparkSession, d: str, upto: int) -> DataFrame:
    """Every repo's refs as of entry `upto`, as one row of an array each, as snapshot files hold them."""
    refs = windows.latest(changes(spark, d).filter(F.col("seq") <= upto), ["repo", "name"], ["seq", "pos"], "new")
    return refs.groupBy("repo").agg(F.lit(upto).cast("long").alias("seq"), F.collect_list(F.struct("name", F.col("new").alias("target"))).alias("refs"))


@R.add("m5_snapshot", f"select repo, count(*) n from (select *, row_number() over (partition by repo, name order by seq desc, pos desc) rn from {_CHANGES} where seq <= 20) where rn = 1 and new is not null group by 1")
def m5(spark: SparkSession, d: str) -> DataFrame:
    return snapshots(spark, d, 20).select("repo", F.size("refs").cast("long").alias("n"))


@R.add("m6_snapshot_and_tail", f"select * from {_LATEST}")
def m6(spark: SparkSession, d: str) -> DataFrame:
    return logs.current_refs(entries(spark, d), snapshots(spark, d, 20))


@R.add(
    "m8_replay_after",
    f"""with e as (select * from {_CHANGES} where seq > 10), s as (select distinct repo, seq from e union select distinct repo, 10 from {_CHANGES}),
    g as (select repo, max(seq) - min(seq) + 1 <> count(*) gap from s group by 1)
    select e.repo, e.seq, e.pos::int as pos, e.name, e.old, e.new, not g.gap as complete from e join g using (repo)""",
)
def m8(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d)
    after = e.select("repo").distinct().withColumn("seq", F.lit(10).cast("long"))
    return logs.replay_events(e, after).drop("ts")


#: Entries from one snapshot of a repo to the next, as in the original.
SNAP_EVERY = 64


def packed(spark: SparkSession, d: str) -> DataFrame:
    """(repo, seq, packs) of every received copy with inline packs. One copy is enough to hold a pack, even one without
    updates."""
    return table(spark, d, "wal_entry").filter("size(packs) > 0").select(clean_key("repo_id").alias("repo"), "seq", "packs")


@R.add(
    "m7_prunable",
    f"""with e as (select distinct repo, seq from {_CHANGES}), s as (select repo, max(seq) // {SNAP_EVERY} * {SNAP_EVERY} upto from e group by 1),
    p as (select {K('repo_id')} repo, seq, unnest(packs) p from wal_entry), f as (select distinct {K('repo_id')} repo, name from packs),
    w as (select p.repo, p.seq from p left join f on f.repo = p.repo and f.name = p.p.name where f.repo is null)
    select e.repo, e.seq from e join s using (repo) where e.seq <= s.upto and not exists (select 1 from w where w.repo = e.repo and w.seq = e.seq)""",
)
def m7(spark: SparkSession, d: str) -> DataFrame:
    """Each repo's snapshot is its last one, at a multiple of SNAP_EVERY; flushed are the packs of the packs table."""
    known = assemble(table(spark, d, "wal_entry")).select("repo", "seq")
    packs_at = packed(spark, d).groupBy("repo", "seq").agg(F.flatten(F.collect_list("packs")).alias("packs"))
    last = (F.floor(F.max("seq") / SNAP_EVERY) * SNAP_EVERY).cast("long")
    snaps = known.groupBy("repo").agg(last.alias("seq"))
    return logs.prunable(known.join(packs_at, ["repo", "seq"], "left"), snaps, packs_of(spark, d).select(F.col("repo_id").alias("repo"), "name"))


@R.add(
    "m9_inline_packs",
    f"""select repo, name, seq, hex(from_base64(data)) as data, hex(from_base64(idx)) as idx from (select repo, seq, p.name as name, p.data as data, p.idx as idx,
    row_number() over (partition by repo, p.name order by seq desc nulls last, p.data desc nulls last, p.idx desc nulls last) rn from (select {K('repo_id')} repo, seq, unnest(packs) p from wal_entry)) where rn = 1""",
)
def m9(spark: SparkSession, d: str) -> DataFrame:
    return logs.inline_packs(packed(spark, d)).select("repo", "name", "seq", F.hex("data").alias("data"), F.hex("idx").alias("idx"))


@R.add("u4_snapshot_union_tail", f"select repo, count(*) n from {_LATEST} group by 1")
def u4(spark: SparkSession, d: str) -> DataFrame:
    return logs.current_refs(entries(spark, d), snapshots(spark, d, 7)).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@R.add("s3_range_read", "select doc_id, hex(encode(text)[11:30]) as part from documents where text is not null")
def s3(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return blobs.read_range(files, 10, 20).select("doc_id", F.hex("content").alias("part"))


@R.add("s6_prefixes", f"select distinct repo_id from (select {K('repo_id')} repo_id from packs union all select {K('repo_id')} from refs) where repo_id is not null")
def s6(spark: SparkSession, d: str) -> DataFrame:
    keys = [table(spark, d, t).select(F.concat(clean_key("repo_id"), F.lit("/"), F.coalesce("name", F.lit(""))).alias("path")) for t in ("packs", "refs")]
    return keys[0].union(keys[1]).select(F.substring_index("path", "/", 1).alias("repo_id")).filter("repo_id IS NOT NULL").distinct()


@R.add(
    "s22_recover_rows",
    f"""select repo_id, case when ends_with(f, '.pack') then 'pack' when starts_with(f, 'lfs/') then 'large' end as kind, count(*) n
    from (select {K('repo_id')} repo_id, unnest([name || '.pack', name || '.idx', 'lfs/' || name]) f from packs) where ends_with(f, '.pack') or starts_with(f, 'lfs/') group by 1, 2""",
)
def s22(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the pack and large-object tables, from nothing but the names of files."""
    files = table(spark, d, "packs").select(clean_key("repo_id").alias("repo_id"), F.explode(F.array(F.concat("name", F.lit(".pack")), F.concat("name", F.lit(".idx")), F.concat(F.lit("lfs/"), "name"))).alias("f"))
    kind = F.when(F.col("f").endswith(".pack"), "pack").when(F.col("f").startswith("lfs/"), "large")
    return files.select("repo_id", kind.alias("kind")).filter("kind IS NOT NULL").groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@R.add("s25_large_objects", "select doc_id, sha256(text) as oid, doc_id % 9 <> 0 as accepted from documents where text is not null")
def s25(spark: SparkSession, d: str) -> DataFrame:
    """Uploads, every ninth of them damaged on the way: kept if the digest is the announced one."""
    up = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.sha256_hex("text").alias("oid"), F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("sent"))
    return up.select("doc_id", "oid", (X.sha256_hex("sent") == F.col("oid")).alias("accepted"))


@R.add("s26_raw_content", f"select r.repo_id, r.name, c.message from {{refs}} r join (select {K('sha')} sha, max(message) message from commits group by 1) c on c.sha = r.target".replace("{refs}", f"(select {K('repo_id')} repo_id, name, max({K('target')}) target from refs group by 1, 2)"))
def s26(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commits").groupBy(clean_key("sha").alias("target")).agg(F.max("message").alias("message"))
    return refs_of(spark, d).join(c, "target").select("repo_id", "name", "message")


_IDENT = r"""regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '[\x00\n\r<>]', '', 'g'), '^[\x00-\x20.,:;''"]+', ''), '[\x00-\x20.,:;''"]+$', '')"""


@R.add("x20_parse_commit", f"select sha, tree, {_IDENT.format('author')} as author, {_IDENT.format('email')} as email, coalesce(\"timestamp\", 0) as ts, coalesce(committer_ts, 0) as committer_ts from commits where tree <> ''")
def x20(spark: SparkSession, d: str) -> DataFrame:
    """Commits written out as a writer writes them, whatever is missing, and parsed."""
    c = table(spark, d, "commits").filter("tree <> ''")
    who = F.concat(X.clean_ident(F.coalesce("author", F.lit(""))), F.lit(" <"), X.clean_ident(F.coalesce("email", F.lit(""))), F.lit("> "))
    line = lambda role, ts: F.concat(F.lit(f"{role} "), who, F.coalesce(ts, F.lit(0)).cast("string"), F.lit(" +0000\n"))
    body = F.concat(F.lit("tree "), "tree", F.lit("\n"), line("author", "timestamp"), line("committer", "committer_ts"), F.lit("\n"), F.coalesce("message", F.lit("")))
    return c.select("sha", codec.commit_col(F.encode(body, "UTF-8")).alias("c")).select("sha", "c.tree", "c.author", "c.email", "c.ts", "c.committer_ts")


@R.add("x21_parse_tree", "select n_nationkey, n_name as name, '100644' as mode, sha1(n_name) as sha from nation")
def x21(spark: SparkSession, d: str) -> DataFrame:
    oid = F.sha1(F.col("n_name").cast("binary"))
    raw = F.concat(F.concat(F.lit("100644 "), "n_name").cast("binary"), F.unhex(F.lit("00")), F.unhex(oid))
    return table(spark, d, "nation").select("n_nationkey", F.explode(codec.tree_col(raw)).alias("e")).select("n_nationkey", "e.name", "e.mode", "e.sha")


@R.add("x24_edges", f"select s as sha, unnest(p) as oid from (select {K('sha')} s, list_filter(list_transform(parents, lambda x: {K('x')}), lambda x: x is not null) p from commits)")
def x24(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commits").select(clean_key("sha").alias("sha"), F.filter(F.transform("parents", clean_key), lambda p: p.isNotNull()).alias("ps"))
    body = F.concat(F.lit("tree x\n"), F.array_join(F.transform("ps", lambda p: F.concat(F.lit("parent "), p, F.lit("\n"))), ""), F.lit("\n\n"))
    e = c.filter(F.size("ps") > 0).select("sha", F.explode(codec.edges_col(F.lit("commit"), F.encode(body, "UTF-8"))).alias("e"))
    return e.filter("e.kind = 'parent'").select("sha", "e.oid")


@R.add("x25_log_records", "select sha, tree, author, email, message from commits where author is not null and email is not null and tree is not null and \"timestamp\" is not null and message is not null and not contains(message, chr(30)) and not contains(message, chr(0))")
def x25(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commits").filter("author IS NOT NULL AND email IS NOT NULL AND tree IS NOT NULL AND timestamp IS NOT NULL AND message IS NOT NULL AND NOT contains(message, char(30)) AND NOT contains(message, char(0))")
    rec = F.concat(F.lit("\x1e"), F.concat_ws("\x00", "sha", "tree", F.lit("p"), "author", "email", F.col("timestamp").cast("string"), "message"))
    return c.select(F.explode(X.log_record(F.concat(F.lit("\x1ebad"), rec))).alias("r")).select("r.sha", "r.tree", "r.author", "r.email", "r.message")


@R.add("x27_frames", f"select repo, seq, name from {_CHANGES} where name is not null")
def x27(spark: SparkSession, d: str) -> DataFrame:
    e = changes(spark, d).filter("name IS NOT NULL")
    return e.select("repo", "seq", F.explode(codec.frames_col(F.encode(F.concat(F.lit("0001"), X.pkt_line("name"), F.lit("0000")), "UTF-8"))).alias("name"))


@R.add("x29_push_commands", f"select repo, seq, coalesce(old, repeat('0', 40)) as old, coalesce(new, repeat('0', 40)) as new, name as ref from {_CHANGES} where name is not null and not contains(name, ' ')")
def x29(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit("0" * 40)
    e = changes(spark, d).filter("name IS NOT NULL AND NOT contains(name, ' ')")
    line = F.concat(F.coalesce("old", zero), F.lit(" "), F.coalesce("new", zero), F.lit(" "), "name", F.lit("\x00side-band-64k\n"))
    got = e.select("repo", "seq", F.explode(codec.push_col(F.encode(F.concat(X.pkt_line(line), F.lit("0000PACK")), "UTF-8"))).alias("c"))
    return got.select("repo", "seq", "c.old", "c.new", "c.ref")


@R.add(
    "x9_capability_links",
    f"select distinct repo_id, name, {hmac("encode('secret')", "encode(repo_id || ':' || name || ':1900000000')")} as signature from (select {K('repo_id')} repo_id, name from packs) where repo_id is not null and name is not null",
)
def x9(spark: SparkSession, d: str) -> DataFrame:
    p = packs_of(spark, d).filter("repo_id IS NOT NULL AND name IS NOT NULL")
    return p.select("repo_id", "name", codec.capability_col("secret", F.col("repo_id"), F.col("name"), 1_900_000_000).alias("signature"))


@R.add("pk6_pack_index", "select sha1(('blob ' || octet_length(encode(text)))::blob || '\\x00'::blob || encode(text)) as oid from documents where text is not null group by 1")
def pk6(spark: SparkSession, d: str) -> DataFrame:
    """Ids as the index files of packs of about a megabyte list them."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(F.lit("blob").alias("kind"), F.encode("text", "UTF-8").alias("data"), X.object_id("blob", "text").alias("oid"))
    made = packs.repack(packs.size_groups(docs.withColumn("size", F.length("data")), "size", 1 << 20), "pack")
    ids = codec._udf(lambda b: [o for o, _, _ in codec.read_index(bytes(b))], "array<string>")
    return made.select(F.explode(ids("idx")).alias("oid"))


@R.add(
    "g14_merge_decision",
    """select p_partkey, case when p_size % 5 = 0 then 'up_to_date' when p_size % 3 = 0 and p_partkey % 2 = 0 then 'fast_forward' when p_size % 3 <> 0 and p_partkey % 7 = 0 then 'refused' when p_partkey % 11 = 0 then 'conflict'
      else 'merge_commit' end as action from part""",
)
def g14(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    return graph.merge_decision(p.select(k, (s % 5 == 0).alias("head_in_base"), (s % 3 == 0).alias("base_in_head"), (k % 2 == 0).alias("may_forward"), (k % 7 == 0).alias("forward_only"), (k % 11 == 0).alias("conflict"))).select("p_partkey", "action")


@R.add("o2_commit_pages", f"select id as sha, (row_number() over (order by ts desc, id) - 1) // 1000 as page from (select {K('sha')} id, max(committer_ts) ts from commits group by 1)")
def o2(spark: SparkSession, d: str) -> DataFrame:
    """Pages over the stable order of all commits, which loses none after a merge."""
    c = table(spark, d, "commits").groupBy(clean_key("sha").alias("sha")).agg(F.max("committer_ts").alias("ts"))
    ranked = windows.ordered_sum(c.select("sha", F.lit(1).alias("one"), (-F.col("ts")).alias("neg")).withColumn("neg", F.coalesce("neg", F.lit(2**62))), ["neg", "sha"], "one", "pos")
    return ranked.select("sha", F.floor((F.col("pos") - 1) / 1000).cast("long").alias("page"))


@R.add("t14_consumer_gaps", f"with s as (select distinct {K('repo_id')} repo, seq from wal_entry where seq is not null and len(updates) > 0), n as (select repo, seq, lead(seq) over (partition by repo order by seq) nx from s) select repo, seq + 1 as gap_from, nx - 1 as gap_to from n where nx - seq > 1")
def t14(spark: SparkSession, d: str) -> DataFrame:
    """What a consumer of changes misses: entries of which no copy, or just empty ones, came."""
    seen = table(spark, d, "wal_entry").filter("size(updates) > 0").select(clean_key("repo_id").alias("repo"), "seq")
    return relational.sequence_gaps(seen, ["repo"], "seq")


@R.add("t6_retry_schedule", "select id, case when status = 'pending' and attempts + 1 >= 5 then 'failed' else status end as status, case when status = 'pending' and attempts + 1 < 5 then [30, 120, 600, 3600][attempts + 1] end as wait_s from deliveries")
def t6(spark: SparkSession, d: str) -> DataFrame:
    """The schedule after one more failure of all pending rows."""
    j = table(spark, d, "deliveries")
    n = F.col("attempts") + 1
    pending = F.col("status") == "pending"
    return j.select("id", F.when(pending & (n >= 5), "failed").otherwise(F.col("status")).alias("status"), F.when(pending & (n < 5), X.next_wait(n)).alias("wait_s"))


@R.add("b9_advertised_list", f"select id as repo_id, lpad(seq::varchar, 10, '0') || '.bundle' as name, row_number() over (partition by id order by seq) as pos from (select distinct {K('repo_id')} id, seq from wal_entry where seq is not null)")
def b9(spark: SparkSession, d: str) -> DataFrame:
    """All links of every chain, numbered in stretches, so that a busy repo is many tasks."""
    w = table(spark, d, "wal_entry").filter("seq IS NOT NULL").select(F.coalesce(clean_key("repo_id"), F.lit("")).alias("id"), "seq").distinct()
    at = windows.increasing(w.withColumn("least", F.lit(1).cast("long")), ["id"], "seq", "least", "pos")
    return at.select(F.nullif("id", F.lit("")).alias("repo_id"), F.concat(F.lpad(F.col("seq").cast("string"), 10, "0"), F.lit(".bundle")).alias("name"), "pos")


