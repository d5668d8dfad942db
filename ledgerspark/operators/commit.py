"""What a push, an import or a log entry does to all tables at once, as tables: verdicts, refs, packs and the outbox.

Each operator gives the new rows or the new state of every table it touches; whoever writes them does so in one step (see
streaming.events.apply_log). Transactions are rows (repo, arrival, tx_id, updates array<struct<name, old, new>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.scalars import next_wait
from ledgerspark.operators.folds import cas_commit
from ledgerspark.operators.relational import insert_ignore
from ledgerspark.operators.windows import latest
from ledgerspark.shared import cut

#: Attempts after which a delivery has failed for good.
MOST_ATTEMPTS = 5
OUTBOX = ["repo", "seq", "pos", "event", "payload", "hook_id"]


def outbox(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """(repo, seq, pos, event, payload, hook_id): a job for each event (repo, seq, pos, event, payload) and each active hook
    (id, repo, events, active) of its repo that subscribes to it or to "*". Events without a name make none. The hooks of one
    repo are few next to its events, so they are the side that AQE may broadcast; null and empty lists subscribe to nothing."""
    mine = hooks.filter(F.coalesce("active", F.lit(False))).select(F.col("id").alias("hook_id"), F.col("repo"), F.explode("events").alias("wanted")).filter("wanted IS NOT NULL").distinct()
    named = events.filter("event IS NOT NULL AND event <> ''").select("repo", "seq", "pos", "event", "payload", F.explode(F.array(F.col("event"), F.lit("*"))).alias("wanted"))
    return named.join(mine, ["repo", "wanted"]).select(*OUTBOX).distinct()


def apply_entries(entries: DataFrame, refs: DataFrame, packs: DataFrame, hooks: DataFrame) -> dict[str, DataFrame]:
    """The tables after entries(repo, seq, updates, events, packs), one row per (repo, seq), that the log has accepted:

    * refs(repo, name, target): those before with the updates upserted in order, null targets deleted;
    * packs(repo, name): those before and the entries' own, known names ignored;
    * outbox: the jobs that the entries' events make (see outbox());
    * seqs(repo, seq): how far each repo has come.

    Null arrays stand for empty ones. All four come from the same rows, so that they can be written in one step."""
    ups = entries.select("repo", "seq", F.posexplode("updates").alias("pos", "u")).select("repo", "seq", "pos", F.col("u.name").alias("name"), F.col("u.new").alias("target"))
    base = refs.select("repo", F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("pos"), "name", "target")
    new = entries.select("repo", F.explode("packs.name").alias("name")).filter("name IS NOT NULL").distinct()
    events = entries.select("repo", "seq", F.posexplode("events").alias("pos", "e")).select("repo", "seq", "pos", F.col("e.name").alias("event"), F.col("e.payload").alias("payload"))
    return {
        "refs": latest(base.unionByName(ups), ["repo", "name"], ["seq", "pos"], "target").select("repo", "name", "target"),
        "packs": packs.select("repo", "name").unionByName(new).distinct(),
        "outbox": outbox(events, hooks),
        "seqs": entries.groupBy("repo").agg(F.max("seq").alias("seq")),
    }


def apply_pushes(pushes: DataFrame, hooks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pushes(repo, arrival, tx_id, updates, events, packs) as (verdicts, packs, outbox). What a push brings is stored before
    it is judged, so packs(repo, name) has those of refused ones too; events are sent for accepted ones only, numbered by
    arrival."""
    verdicts = cut(cas_commit(pushes.select("repo", "arrival", "tx_id", "updates")))
    packs = pushes.select("repo", F.explode("packs.name").alias("name")).filter("name IS NOT NULL").distinct()
    ok = pushes.join(verdicts.filter("ok").select("repo", "arrival", "tx_id"), ["repo", "arrival", "tx_id"], "left_semi")
    events = ok.select("repo", F.col("arrival").alias("seq"), F.posexplode("events").alias("pos", "e")).select("repo", "seq", "pos", F.col("e.name").alias("event"), F.col("e.payload").alias("payload"))
    return verdicts, packs, outbox(events, hooks)


def route_deletes(pushes: DataFrame, repos: DataFrame) -> DataFrame:
    """pushes with a column `way`: `batch` for one that only deletes and leaves its repo's default branch alone, which goes
    as one transaction; `full` for any other. repos(repo, default_branch), one row per repo, "main" where it is null; a push
    without updates, and a push to an unknown repo, are `full`."""
    branch = repos.select("repo", F.concat(F.lit("refs/heads/"), F.coalesce("default_branch", F.lit("main"))).alias("_kept"))
    only = F.forall("updates", lambda u: u["new"].isNull() & u["name"].isNotNull() & (u["name"] != F.col("_kept")))
    return pushes.join(branch, "repo", "left").withColumn("way", F.when((F.size("updates") > 0) & F.coalesce(only, F.lit(False)), "batch").otherwise("full")).drop("_kept")


def claim(known: DataFrame, asked: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Claims of names: the table after them, and (key, order, created) for every row of asked: true for the first claim, by
    order, of a name that nobody had; what is there is never overwritten. Null keys claim nothing."""
    rows = asked.filter(F.col(key).isNotNull())
    first = rows.groupBy(key).agg(F.min(order).alias("_first")).join(known.select(key).distinct(), key, "left_anti")
    verdict = asked.join(first, key, "left").select(key, order, (F.coalesce(F.col(order).eqNullSafe(F.col("_first")) & F.col(key).isNotNull() & F.col("_first").isNotNull(), F.lit(False))).alias("created"))
    return insert_ignore(known, rows.select(*known.columns), [key]), verdict


def import_refs(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """(repo, n, ok) of imports of theirs(repo, name, target): only names below refs/ count, with a target, each expected not
    to be there; one that is among ours(repo, name) and the whole import of its repo has no effect."""
    mine = theirs.filter(F.col("name").startswith("refs/") & F.col("target").isNotNull()).select("repo", "name").distinct()
    there = ours.select("repo", "name").distinct().withColumn("_there", F.lit(True))
    return mine.join(there, ["repo", "name"], "left").groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("_there").isNull()).alias("ok"))


def claim_staged(staged: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """The staged uploads that may be kept: those whose last 20 bytes are the stored file's of the same key."""
    tail = lambda c: F.substring(c, -20, 20)
    theirs = stored.select(key, tail(F.col(content)).alias("_tail")).filter(F.col("_tail").isNotNull()).distinct()
    return staged.join(theirs, (staged[key] == theirs[key]) & (tail(staged[content]) == theirs["_tail"]), "left_semi")


def settle_deliveries(jobs: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """jobs(id, status, attempts, next_attempt_at, ..) after answers(id, code), at most one for each: a code of 200 to 299
    delivers; anything else, null for no answer included, is another attempt, tried again after its wait, or failed for good
    after MOST_ATTEMPTS. Jobs that weren't sent, or aren't pending, stay as they are."""
    sent = answers.groupBy("id").agg(F.max("code").alias("_code"), F.lit(True).alias("_sent"))
    hit = F.col("_sent").isNotNull() & (F.col("status") == "pending")
    good = F.coalesce(F.col("_code").between(200, 299), F.lit(False))
    n = F.coalesce("attempts", F.lit(0)) + 1
    status = F.when(hit & good, "delivered").when(hit & (n >= MOST_ATTEMPTS), "failed").otherwise(F.col("status"))
    again = F.when(hit & ~good & (n < MOST_ATTEMPTS), now + F.make_dt_interval(secs=next_wait(n))).otherwise(F.col("next_attempt_at"))
    done = jobs.join(sent, "id", "left").withColumns({"_n": F.when(hit, n).otherwise(F.col("attempts")), "_at": again, "_s": status})
    new = {"status": "_s", "attempts": "_n", "next_attempt_at": "_at"}
    return done.select(*[F.col(new.get(c, c)).alias(c) for c in jobs.columns])
