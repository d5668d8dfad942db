"""Queries of ordered computations: folds of logs, chains, running sums, state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.keys import clean_key, clean_key_sql
from ledgerspark.operators import folds, windows
from ledgerspark.operators.replay import assemble
from ledgerspark.plans.registry import Registry, table

R = Registry()
K = clean_key_sql


def changes(spark: SparkSession, d: str) -> DataFrame:
    """The log as one row per change: repo, seq, pos, name, new."""
    e = assemble(table(spark, d, "wal_entry"))
    return e.select("repo", "seq", F.posexplode("updates").alias("pos", "u")).select("repo", "seq", "pos", F.col("u.name").alias("name"), F.col("u.old").alias("old"), F.col("u.new").alias("new"))


_CHANGES = f"""(select distinct {K('repo_id')} repo, seq, i - 1 as pos, updates[i].Name as name, {K('updates[i].Old')} as old, {K('updates[i].New')} as new
  from (select repo_id, seq, updates, unnest(range(1, len(updates) + 1)) i from wal_entry where len(updates) > 0))"""


@R.add("w1_fan_out_table", f"""select b.bucket::int as bucket, coalesce(n, 0) n, (sum(coalesce(n, 0)) over (order by b.bucket))::bigint upto from (select unnest(range(256)) bucket) b
  left join (select ('0x' || substr(k, 1, 2))::int bucket, count(*) n from (select distinct {K('sha')} k from commits) group by 1) c using (bucket)""")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return windows.fan_out_table(table(spark, d, "commits").select(clean_key("sha").alias("oid")).distinct(), "oid")


@R.add("w2_latest_per_key", f"select repo, name, new, seq, pos::int as pos from (select *, row_number() over (partition by repo, name order by seq desc, pos desc) rn from {_CHANGES}) where rn = 1 and new is not null")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return windows.latest(changes(spark, d), ["repo", "name"], ["seq", "pos"], "new")


@R.add(
    "w3_since_full",
    """with c as (select user_id, event_id token, event_type = 'signup' f from events), l as (select user_id, max(token) filter (where f) last_full from c group by 1)
    select user_id, last_full, count(*) filter (where last_full is null or token > last_full) since from c join l using (user_id) group by all""",
)
def w3(spark: SparkSession, d: str) -> DataFrame:
    return windows.since_full(table(spark, d, "events").select("user_id", F.col("event_id").alias("token"), "event_type"), ["user_id"], "token", F.col("event_type") == "signup")


@R.add("w4_age_of_full", "select user_id, max(ts) filter (where event_type = 'signup') as newest_full, epoch(max(ts) - max(ts) filter (where event_type = 'signup'))::bigint as age_s from events group by 1")
def w4(spark: SparkSession, d: str) -> DataFrame:
    full = F.max(F.when(F.col("event_type") == "signup", F.col("ts")))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(full.alias("newest_full"), F.round((us(F.max("ts")) - us(full)) / 1e6).cast("long").alias("age_s"))


@R.add(
    "w5_keep_fulls",
    """with c as (select user_id, event_id token, event_type, count(*) filter (where event_type = 'signup') over (partition by user_id order by event_id desc) r,
      count(*) filter (where event_type = 'signup') over (partition by user_id) n from events)
    select user_id, token, event_type from c where n < 2 or r < 2 or (r = 2 and event_type = 'signup')""",
)
def w5(spark: SparkSession, d: str) -> DataFrame:
    return windows.keep_last_fulls(table(spark, d, "events").select("user_id", F.col("event_id").alias("token"), "event_type"), ["user_id"], "token", F.col("event_type") == "signup")


@R.add(
    "w6_increasing_tokens",
    f"""with e as (select {K('repo_id')} repo, seq, max(ts) ts from wal_entry where ts is not null and seq is not null group by 1, 2), i as (select *, row_number() over (partition by repo order by seq) i from e)
    select repo, seq, max(ts - i) over (partition by repo order by seq) + i as token from i""",
)
def w6(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "wal_entry").filter("ts IS NOT NULL AND seq IS NOT NULL").groupBy(clean_key("repo_id").alias("repo"), "seq").agg(F.max("ts").alias("ts"))
    return windows.increasing(e, ["repo"], "seq", "ts", "token").drop("ts")


_IDLE = '(select repo_id, max(created_at) as "at", sum(size_bytes)::bigint bytes from packs where created_at is not null group by 1)'


@R.add("w7_evict", f'with t as (select sum(bytes)::bigint s from {_IDLE}), r as (select *, sum(bytes) over (order by "at", repo_id) - bytes as prior from {_IDLE}) select repo_id, "at", bytes from r, t where (s - prior) * 100 // s > 70')
def w7(spark: SparkSession, d: str) -> DataFrame:
    idle = table(spark, d, "packs").filter("created_at IS NOT NULL").groupBy("repo_id").agg(F.max("created_at").alias("at"), F.sum("size_bytes").alias("bytes"))
    used = idle.agg(F.sum("bytes").alias("s")).collect()[0]["s"] or 1
    return windows.evict(idle, ["at", "repo_id"], "bytes", used, used)


@R.add(
    "w8_block_cache",
    """with recursive r as (select l_suppkey reader, l_orderkey * 8 + l_linenumber as "at", l_partkey % 50 as block, l_quantity::bigint bytes from lineitem),
    e as (select *, row_number() over (partition by reader order by "at", block, bytes) i from r),
    f as (select reader, "at", block, i, false hit, [{'b': block, 'n': bytes}] kept from e where i = 1
      union all select reader, "at", block, i, hit, kept[list_min(list_filter(range(1, len(kept) + 1), lambda j: list_sum(list_transform(kept[j:], lambda x: x.n)) <= 500 or j = len(kept))):] from (
        select e.reader, e."at", e.block, e.i, list_contains(list_transform(f.kept, lambda x: x.b), e.block) hit,
          list_append(list_filter(f.kept, lambda x: x.b <> e.block), coalesce(list_filter(f.kept, lambda x: x.b = e.block)[1], {'b': e.block, 'n': e.bytes})) kept
        from f join e on e.reader = f.reader and e.i = f.i + 1))
    select reader, "at", block, hit from f""",
)
def w8(spark: SparkSession, d: str) -> DataFrame:
    reads = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("reader"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), (F.col("l_partkey") % 50).alias("block"), F.col("l_quantity").cast("long").alias("bytes"))
    return folds.lru_cache(reads, 500)


@R.add("w9_newest_keys", "select o_custkey, min(o_orderkey) as first_at from orders group by 1 order by first_at desc, o_custkey desc limit 8192")
def w9(spark: SparkSession, d: str) -> DataFrame:
    return windows.newest_keys(table(spark, d, "orders"), "o_custkey", "o_orderkey")


@R.add(
    "w10_entry_split",
    f"""with recursive t as (select repo_id repo, row_number() over (partition by repo_id order by name) arrival, size_bytes b from (select {K('repo_id')} repo_id, name, max(coalesce(size_bytes, 0)) size_bytes from packs where name is not null group by 1, 2)),
    f as (select repo, arrival, 1::bigint entry, b used from t where arrival = 1
      union all select t.repo, t.arrival, case when f.used > 0 and f.used + t.b > 50000 then f.entry + 1 else f.entry end, case when f.used > 0 and f.used + t.b > 50000 then t.b else f.used + t.b end from f join t on t.repo = f.repo and t.arrival = f.arrival + 1)
    select repo, arrival, entry from f""",
)
def w10(spark: SparkSession, d: str) -> DataFrame:
    packs = table(spark, d, "packs").filter("name IS NOT NULL").groupBy(clean_key("repo_id").alias("repo"), "name").agg(F.max(F.coalesce("size_bytes", F.lit(0))).alias("bytes"))
    txs = windows.ranks(packs, ["name"], "arrival", ["repo"]).select("repo", "arrival", "bytes")
    return folds.group_entries(txs, 50_000)


@R.add(
    "w11_contiguity",
    f"with s as (select distinct {K('repo_id')} repo, seq from wal_entry where seq is not null and epoch(received_at) >= ts), n as (select repo, seq, lead(seq) over (partition by repo order by seq) nx from s) select repo, seq + 1 as gap_from, nx - 1 as gap_to from n where nx - seq > 1",
)
def w11(spark: SparkSession, d: str) -> DataFrame:
    from ledgerspark.operators.relational import sequence_gaps

    # copies that came before they were written, by their clock, are not believed
    return sequence_gaps(table(spark, d, "wal_entry").filter(F.unix_micros(F.col("received_at").cast("timestamp")) >= F.col("ts") * 1_000_000).select(clean_key("repo_id").alias("repo"), "seq"), ["repo"], "seq")


@R.add(
    "w13_estimate",
    """with e as (select user_id, event_id, case when event_type = 'view' then value end obs, event_type = 'click' nudge from events), g as (select *, count(obs) over (partition by user_id order by event_id) g from e)
    select user_id, event_id, round(first_value(obs) over (partition by user_id, g order by event_id) + sum(case when nudge and obs is null then 1 else 0 end) over (partition by user_id, g order by event_id), 6) as estimate from g""",
)
def w13(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("obs"), (F.col("event_type") == "click").alias("nudge"))
    return windows.estimate(e, ["user_id"], "event_id", "obs", F.col("nudge")).select("user_id", "event_id", F.round("estimate", 6).alias("estimate"))


@R.add(
    "m1_cas_commit",
    """with recursive e as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) prev, row_number() over (partition by user_id order by event_id) i from events),
    f as (select user_id, i, event_id, true ok, case when event_type = 'error' then null else event_type end st from e where i = 1
      union all select e.user_id, e.i, e.event_id, case when e.prev = 'error' then null else e.prev end is not distinct from f.st,
        case when (case when e.prev = 'error' then null else e.prev end) is not distinct from f.st then (case when e.event_type = 'error' or e.event_id % 5 = 0 then null else e.event_type end) else f.st end
      from f join e on e.user_id = f.user_id and e.i = f.i + 1)
    select user_id::varchar as repo, event_id as arrival, event_id::varchar as tx_id, ok from f""",
)
def m1(spark: SparkSession, d: str) -> DataFrame:
    """One name per user; each event expects the event before it and sets itself (an error, or every fifth, deletes)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.lag("event_type").over(w).alias("prev"), F.row_number().over(w).alias("i"))
    gone = (F.col("event_type") == "error") | ((F.col("event_id") % 5 == 0) & (F.col("i") > 1))
    u = F.struct(F.lit("state").alias("name"), F.when(F.col("prev") != "error", F.col("prev")).alias("old"), F.when(~gone, F.col("event_type")).alias("new"))
    txs = e.select(F.col("user_id").cast("string").alias("repo"), F.col("event_id").alias("arrival"), F.col("event_id").cast("string").alias("tx_id"), F.array(u).alias("updates"))
    return folds.cas_commit(txs)


@R.add(
    "t7_token_bucket",
    """with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) i from events),
    f as (select user_id, i, event_id, ts, true ok, 2.0::double tk from e where i = 1
      union all select e.user_id, e.i, e.event_id, e.ts, least(3.0::double, f.tk + greatest(0, epoch_us(e.ts) - epoch_us(f.ts)) / 1e6 * 0.0005::double) >= 1,
        least(3.0::double, f.tk + greatest(0, epoch_us(e.ts) - epoch_us(f.ts)) / 1e6 * 0.0005::double) - (case when least(3.0::double, f.tk + greatest(0, epoch_us(e.ts) - epoch_us(f.ts)) / 1e6 * 0.0005::double) >= 1 then 1 else 0 end)
      from f join e on e.user_id = f.user_id and e.i = f.i + 1)
    select user_id as subject, ts as at, event_id as id, ok from f""",
)
def t7(spark: SparkSession, d: str) -> DataFrame:
    return folds.token_bucket(table(spark, d, "events").select(F.col("user_id").alias("subject"), F.col("ts").alias("at"), F.col("event_id").alias("id")), 0.0005, 3)
