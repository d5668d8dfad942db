"""Queries of predicates and scalar functions over the names, keys and texts of the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import predicates as P
from ledgerspark.functions import scalars as X
from ledgerspark.keys import clean_key_sql
from ledgerspark.plans.bits import CRC, byte_list
from ledgerspark.plans.registry import Registry, table

R = Registry()
K = clean_key_sql
_BAD = P.REF_BAD_CHARS.replace("'", "''")
_PARTS = P.REF_BAD_PARTS
_UPDATES_SQL = "(select repo_id, seq, unnest(updates) u from wal_entry)"


def _updates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wal_entry").select("repo_id", "seq", F.explode("updates").alias("u")).select("repo_id", "seq", "u.*")


@R.add("f6_multi_prefix", "select repo_id, name, target from refs where starts_with(name, 'refs/tags/') or starts_with(name, 'refs/heads/feature/')")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").filter(P.has_any_prefix("name", ["refs/tags/", "refs/heads/feature/"]))


@R.add("f10_ref_name_valid", f"select name, starts_with(name, 'refs/') and not regexp_matches(name, '{_BAD}') and not regexp_matches(name, '{_PARTS}') as ok, count(*) n from refs group by all")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").groupBy("name", P.valid_ref_name("name").alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@R.add("f11_repo_id_valid", f"select repo_id, regexp_matches(repo_id, '{P.REPO_ID}') and repo_id <> '..' and repo_id <> 'api' as ok, count(*) n from deliveries group by all")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "deliveries").groupBy("repo_id", P.valid_repo_id("repo_id").alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "f12_blob_key_valid",
    r"""select key, key <> '' and octet_length(encode(key)) <= 512 and not regexp_matches(key, '[\x00-\x1f\x7f\\]') and not regexp_matches(key, '(^|/)(\.|\.\.)?(/|$)') as ok_name,
    not starts_with(key, '/') and not contains(key, '\') and not regexp_matches(key, '(^|/)\.\.?(/|$)') as ok_prefix
    from (select coalesce(repo_id, '') || '/' || coalesce(name, '') || '.pack' as key from packs)""",
)
def f12(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "packs").select(F.concat(F.coalesce("repo_id", F.lit("")), F.lit("/"), F.coalesce("name", F.lit("")), F.lit(".pack")).alias("key"))
    return keys.select("key", P.valid_blob_name("key").alias("ok_name"), P.valid_prefix("key").alias("ok_prefix"))


@R.add(
    "f13_tree_path_valid",
    r"""select title, not regexp_matches(title, '[\x00-\x1f\x7f]') and len(list_filter(string_split(title, '/'), lambda x: x in ('', '.', '..') or
      regexp_replace(regexp_replace(lower(x), '[. ]+$', ''), ':.*$', '') in ('.git', 'git~1', 'git~2'))) = 0 as ok from (select distinct title from documents)""",
)
def f13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("title").distinct().select("title", P.valid_tree_path("title").alias("ok"))


@R.add("f14_hook_match", "select id, repo_id, coalesce(active and (list_contains(events, 'push') or list_contains(events, '*')), false) as hit from webhooks")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "webhooks").select("id", "repo_id", P.hook_matches("active", "events", F.lit("push")).alias("hit"))


@R.add(
    "f15_scope_check",
    """with g as (select n_name subject, case n_nationkey % 4 when 0 then ['git:read'] when 1 then ['git:write'] when 2 then ['org:read', 'repo:write'] else []::varchar[] end scopes,
      case when n_nationkey % 3 = 0 then r_name end only_repo, unnest([r_name, n_name, '']) repo from nation join region on n_regionkey = r_regionkey),
    a as (select *, unnest(['git:read', 'git:write', 'org:read']) scope from g)
    select subject, scope, repo, (only_repo is null or only_repo = repo) and (list_contains(scopes, scope) or (scope = 'git:read' and list_contains(scopes, 'git:write'))) as ok from a""",
)
def f15(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    k = F.col("n_nationkey") % 4
    some = F.when(k == 0, F.array(F.lit("git:read"))).when(k == 1, F.array(F.lit("git:write"))).when(k == 2, F.array(F.lit("org:read"), F.lit("repo:write"))).otherwise(F.array().cast("array<string>"))
    both = nation.join(region, nation.n_regionkey == region.r_regionkey)
    grants = both.select(F.col("n_name").alias("subject"), some.alias("scopes"), F.when(F.col("n_nationkey") % 3 == 0, F.col("r_name")).alias("only_repo"), F.explode(F.array("r_name", "n_name", F.lit(""))).alias("repo"))
    asked = grants.withColumn("scope", F.explode(F.array(*[F.lit(s) for s in ("git:read", "git:write", "org:read")])))
    return asked.select("subject", "scope", "repo", P.scope_allows("scopes", "only_repo", "scope", "repo").alias("ok"))


@R.add("f16_not_modified", "select name, target, coalesce(target = lag_target, false) as same from (select name, target, max(target) over (partition by name) as lag_target from refs)")
def f16(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "refs")
    tags = refs.groupBy("name").agg(F.max("target").alias("tag"))
    return refs.join(tags, "name").select("name", "target", P.not_modified("target", "tag").alias("same"))


@R.add("f17_cacheable_path", "select name, " + " or ".join(f"contains('/' || name, '{s}')" for s in P.CACHED_SEGMENTS) + " as ok from refs")
def f17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").select("name", P.cacheable_path(F.concat(F.lit("/"), "name")).alias("ok"))


_HOST = "lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/:]+)', 1), '\\.$', ''))"


@R.add(
    "f18_host_allowed",
    f"select url, {_HOST} host, not ({_HOST} in ({', '.join(repr(h) for h in P.INTERNAL_HOSTS)}) or "
    + " or ".join(f"{_HOST} = '{s.removeprefix('.')}' or ends_with({_HOST}, '{s}')" for s in P.INTERNAL_SUFFIXES)
    + ") as ok from webhooks",
)
def f18(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1)
    return table(spark, d, "webhooks").select("url", F.lower(F.regexp_replace(host, r"\.$", "")).alias("host"), P.host_allowed(host).alias("ok"))


@R.add("f19_bundle_name", "select seq, regexp_matches(seq::varchar || '.bundle', '^[0-9]+\\.bundle$') as ok, regexp_matches(repo_id || '.bundle', '^[0-9]+\\.bundle$') as ok_repo from wal_entry")
def f19(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "wal_entry")
    return named.select("seq", P.valid_bundle_name(F.concat(F.col("seq").cast("string"), F.lit(".bundle"))).alias("ok"), P.valid_bundle_name(F.concat("repo_id", F.lit(".bundle"))).alias("ok_repo"))


@R.add("f20_large_oid", "select target, coalesce(regexp_matches(target, '^[a-f0-9]{64}$'), false) as is_large, regexp_matches(sha256(coalesce(target, '')), '^[a-f0-9]{64}$') as digest_ok from refs")
def f20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").select("target", F.coalesce(P.valid_large_oid("target"), F.lit(False)).alias("is_large"), P.valid_large_oid(X.sha256_hex(F.coalesce("target", F.lit("")))).alias("digest_ok"))


@R.add(
    "x1_object_id",
    "select doc_id, sha1(('blob ' || octet_length(encode(text)))::blob || '\\x00'::blob || encode(text)) as oid from documents",
)
def x1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.object_id("blob", "text").alias("oid"))


@R.add("x2_sha256", "select doc_id, sha256(text) as digest from documents")
def x2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.sha256_hex("text").alias("digest"))


#: The table of CRC-32, from its polynomial, and the checksum as a fold over bytes.
_CRC_TABLE = f"list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, list_transform(range(8), lambda k: 0::bigint)), lambda c, z: case when c & 1 = 1 then xor(c >> 1, {CRC}) else c >> 1 end))"


@R.add(
    "x3_crc32",
    f"select doc_id, case when text = '' then 0 when text is not null then xor(list_reduce(list_prepend(4294967295::bigint, {byte_list('encode(text)')}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) end as crc from documents, (select {_CRC_TABLE} tab)",
)
def x3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.crc32("text").alias("crc"))


@R.add("x5_base64", "select doc_id, base64(encode(text)) as enc, text as dec from documents")
def x5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.b64("text").alias("enc")).select("doc_id", "enc", F.decode(X.unb64("enc"), "UTF-8").alias("dec"))


@R.add("x6_hex", "select sha, lower(hex(unhex(trim(sha)))) as back, regexp_matches(lower(trim(sha)), '^[0-9a-f]{40}$') as is_hex from commits")
def x6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commits").select("sha", F.lower(F.hex(F.unhex(F.trim("sha")))).alias("back"), X.is_hex(F.lower(F.trim("sha"))).alias("is_hex"))


@R.add("x10_trailer", "select doc_id, lower(right(hex(encode(text)), 40)) as tail from documents")
def x10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.trailer("text").alias("tail"))


_SHORT = "regexp_replace(case when starts_with({c}, 'refs/namespaces/eph/') then 'refs/' || substr({c}, 21) else {c} end, '^refs/(heads|tags)/', '')"


@R.add(
    "x14_ref_parts",
    f"select name, {_SHORT.format(c='name')} as short, starts_with(name, 'refs/namespaces/eph/') as eph, 'refs/heads/' || {_SHORT.format(c='name')} as branch, 'refs/tags/' || {_SHORT.format(c='name')} as tag from refs",
)
def x14(spark: SparkSession, d: str) -> DataFrame:
    short = X.short_name("name")
    return table(spark, d, "refs").select("name", short.alias("short"), X.is_ephemeral("name").alias("eph"), X.branch_ref(short).alias("branch"), X.tag_ref(short).alias("tag"))


@R.add(
    "x16_clean_path",
    "select distinct name, case when name is null then null else array_to_string(list_filter(string_split(name || '//./', '/'), lambda x: x not in ('', '.')), '/') end as path, string_split(name, '/')[-1] as base from refs",
)
def x16(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "refs").select("name").distinct()
    return names.select("name", X.clean_path(F.concat("name", F.lit("//./"))).alias("path"), X.base_name("name").alias("base"))


@R.add(
    "x18_clean_ident",
    r"""select sha, regexp_replace(regexp_replace(regexp_replace(author, '[\x00\n\r<>]', '', 'g'), '^[\x00-\x20.,:;''"]+', ''), '[\x00-\x20.,:;''"]+$', '') as author,
    regexp_replace(regexp_replace(regexp_replace(email, '[\x00\n\r<>]', '', 'g'), '^[\x00-\x20.,:;''"]+', ''), '[\x00-\x20.,:;''"]+$', '') as email from commits""",
)
def x18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commits").select("sha", X.clean_ident("author").alias("author"), X.clean_ident("email").alias("email"))


@R.add(
    "x19_parse_ident",
    r"""select sha, trim(author) as name, email, coalesce("timestamp", 0) as ts from commits
    where author is not null and email is not null and not contains(author, '<') and not contains(email, '>') and "timestamp" is not null""",
)
def x19(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commits").filter("author IS NOT NULL AND email IS NOT NULL AND NOT contains(author, '<') AND NOT contains(email, '>') AND timestamp IS NOT NULL")
    line = F.concat("author", F.lit(" <"), "email", F.lit("> "), F.col("timestamp").cast("string"), F.lit(" +0000"))
    return c.select("sha", X.parse_ident(line).alias("i")).select("sha", "i.name", "i.email", "i.ts")


@R.add("x28_pkt_line", "select name, lpad(lower(printf('%x', octet_length(encode(name)) + 4)), 4, '0') || name as frame from refs")
def x28(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").select("name", X.pkt_line("name").alias("frame"))


@R.add("x32_word_list", "select id, array_to_string(events, ' ') as joined, len(list_filter(string_split(array_to_string(events, ' '), ' '), lambda x: x <> ''))::int as n from webhooks")
def x32(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "webhooks").select("id", X.join_words("events").alias("joined")).select("id", "joined", F.when(F.col("joined").isNotNull(), F.size(X.split_words("joined"))).alias("n"))


@R.add("x33_epoch", "select sha, (epoch_ms(nullif(committer_ts, 0) * 1000))::timestamp as made, epoch(date_trunc('second', epoch_ms(nullif(committer_ts, 0) * 1000)))::bigint as back from commits")
def x33(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commits").select("sha", X.from_epoch("committer_ts").alias("made")).select("sha", "made", X.to_epoch("made").alias("back"))


@R.add("x34_cutoff", "select id, created_at < timestamp '2026-06-01' - interval 30 day as old from deliveries")
def x34(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "deliveries").select("id", X.before_cutoff("created_at", "2026-06-01", 30).alias("old"))


@R.add("x35_backoff", "select id, attempts, case when attempts between 1 and 4 then [30, 120, 600, 3600][attempts] end as wait_s from deliveries")
def x35(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "deliveries").select("id", "attempts", X.next_wait("attempts").alias("wait_s"))


@R.add("x36_pacing", "select o_orderkey, 1000 + greatest(60, (o_orderkey % 100) * 4) as next_s, floor(((1000 - o_orderkey % 1000) * 100) / 1000)::int as pct from orders")
def x36(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", X.paced(F.lit(1000), F.col("o_orderkey") % 100, 60).alias("next_s"), X.percent_used(F.col("o_orderkey") % 1000, F.lit(1000)).alias("pct"))


@R.add(
    "x38_push_payload",
    f"""select repo_id, seq, p->>'ref' as ref, (p->>'ephemeral')::boolean as eph, (p->>'created')::boolean as created, (p->>'deleted')::boolean as deleted, p->>'after' as after from (
      select repo_id, seq, json_object('ref', {_SHORT.format(c='u.Name')}, 'ephemeral', starts_with(u.Name, 'refs/namespaces/eph/'), 'after', coalesce({K('u.New')}, repeat('0', 40)),
        'created', {K('u.Old')} is null, 'deleted', {K('u.New')} is null) p from {_UPDATES_SQL})""",
)
def x38(spark: SparkSession, d: str) -> DataFrame:
    from ledgerspark.keys import clean_key

    rows = _updates(spark, d).select("repo_id", "seq", X.push_payload("repo_id", "Name", clean_key("Old"), clean_key("New")).alias("p"))
    got = F.from_json("p", "ref string, ephemeral boolean, created boolean, deleted boolean, after string")
    return rows.select("repo_id", "seq", got.alias("g")).select("repo_id", "seq", "g.ref", F.col("g.ephemeral").alias("eph"), "g.created", "g.deleted", "g.after")


@R.add("x39_stable_id", "select id, substr(sha1(id || chr(0) || coalesce(repo_id, '')), 1, 32) as sid from repos join (select id as rid, repo_id from webhooks) w on w.repo_id = repos.id")
def x39(spark: SparkSession, d: str) -> DataFrame:
    hooks = table(spark, d, "webhooks").select(F.col("repo_id").alias("id"), F.col("repo_id"))
    return table(spark, d, "repos").select("id").join(hooks, "id").select("id", X.stable_id("id", F.coalesce("repo_id", F.lit(""))).alias("sid"))


@R.add("x40_defaults", "select id, coalesce(nullif(default_branch, ''), 'main') as branch from repos")
def x40(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repos").select("id", X.default_to("default_branch", "main").alias("branch"))


@R.add("x41_messages", "select repo_id, seq, case when len(updates) = 1 then 'Update ' || updates[1].Name else 'Update ' || len(updates) || ' file(s)' end as message from wal_entry where len(updates) > 0")
def x41(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "wal_entry").filter(F.size("updates") > 0)
    return w.select("repo_id", "seq", X.change_message("Update", F.size("updates"), F.col("updates")[0]["Name"]).alias("message"))
