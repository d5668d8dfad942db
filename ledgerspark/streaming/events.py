"""Streams of ref changes: a log folder as an unbounded table, replay joined to what is live, frames for readers, and
event-time windows. Streams run to the end of what is there with run_available(), so that jobs and tests end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerspark.keys import clean_key
from ledgerspark.operators.commit import apply_entries
from ledgerspark.operators.windows import latest
from ledgerspark.shared import shared_dir

CHANGES = ["repo", "seq", "pos", "ref", "old", "new", "ts"]


def read_log_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; a reader that lags takes more triggers, nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ref_events(entries: DataFrame) -> DataFrame:
    """Log entries (repo_id, seq, updates, ts), batch or stream, as one row per change. (repo, seq) isn't unique, as an
    entry may hold several changes: the key is (repo, seq, pos)."""
    rows = entries.filter(F.size("updates") > 0).select(clean_key("repo_id").alias("repo"), "seq", "ts", F.posexplode("updates").alias("pos", "u"))
    return rows.select("repo", "seq", "pos", F.col("u.Name").alias("ref"), clean_key("u.Old").alias("old"), clean_key("u.New").alias("new"), "ts")


def subscribe(events: DataFrame, repo: str | None = None, after: int | None = None) -> DataFrame:
    """One repo's changes, or everybody's; of one repo only those after a sequence number (the firehose isn't replayed)."""
    if repo is None:
        return events
    out = events.filter(F.col("repo") == repo)
    return out.filter(F.col("seq") > after) if after is not None else out


def once(events: DataFrame, at: str, delay: str = "1 hour") -> DataFrame:
    """A stream without the repeats that at-least-once delivery brings, as long as these are at most delay late."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(["repo", "seq", "pos"])


def frames(events: DataFrame) -> DataFrame:
    """(repo, seq, pos, frame): each change as the text frame that a reader gets."""
    data = F.to_json(F.struct("repo", "seq", "ref", F.coalesce("old", F.lit("0" * 40)).alias("old"), F.coalesce("new", F.lit("0" * 40)).alias("new")))
    return events.select("repo", "seq", "pos", F.concat(F.lit("id: "), F.col("seq").cast("string"), F.lit("\nevent: ref\ndata: "), data, F.lit("\n\n")).alias("frame"))


def with_resets(events: DataFrame, oldest: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, reset, seq, pos): for readers (repo, after) whose next entry was pruned (oldest(repo, seq) is later) one
    reset row, for the others the changes after theirs."""
    state = after.join(oldest.withColumnRenamed("seq", "oldest"), "repo").withColumn("reset", F.col("oldest") > F.col("after") + 1)
    resets = state.filter("reset").select("repo", F.lit(True).alias("reset"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("int").alias("pos"))
    rest = events.join(state.filter("NOT reset").select("repo", "after"), "repo").filter("seq > after")
    return resets.unionByName(rest.select("repo", F.lit(False).alias("reset"), "seq", "pos"))


def tumbling(events: DataFrame, at: str, width: str, by: list[str], *aggs: Column, delay: str = "10 minutes") -> DataFrame:
    """EXT: aggregates per window of event time; on a stream a window is given out once it is `delay` past."""
    rows = events.withWatermark(at, delay) if events.isStreaming else events
    out = rows.groupBy(F.window(at, width).alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), *[c for c in out.columns if c != "w"])


def sessions(events: DataFrame, at: str, gap: str, by: list[str], *aggs: Column, delay: str = "10 minutes") -> DataFrame:
    """EXT: aggregates per session, which a pause of gap ends."""
    rows = events.withWatermark(at, delay) if events.isStreaming else events
    out = rows.groupBy(F.session_window(at, gap).alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input into the shared folder, and read what it wrote."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/ledgerspark/{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}-state").option("path", at).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None]) -> None:
    """Run a stream to the end of its input through apply(batch, number); a batch may come again after a failure, with
    the same number."""
    at = f"{shared_dir(stream.sparkSession)}/ledgerspark/{uuid.uuid4().hex}-state"
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


#: What applying a batch of entries writes, in this order: a batch counts once its seqs are there.
APPLIED = ("changes", "packs", "outbox", "seqs")


def apply_log(stream: DataFrame, hooks: DataFrame, at: str) -> None:
    """Applies a stream of entries(repo, seq, updates, events, packs), as operators.commit.apply_entries takes them, to the end
    of its input: every batch writes its changes of refs, its packs, the jobs of its events and how far each repo came below
    `at`, in folders of its own number, seqs last. A batch that comes again after a failure overwrites what it wrote."""
    spark = stream.sparkSession
    none = spark.createDataFrame([], "repo string, name string, target string")

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist()
        out = apply_entries(df, none, none.select("repo", "name"), hooks)
        ups = df.select("repo", "seq", F.posexplode("updates").alias("pos", "u"))
        out["changes"] = ups.select("repo", "seq", "pos", F.col("u.name").alias("name"), F.col("u.new").alias("target"))
        for t in APPLIED:
            out[t].write.mode("overwrite").parquet(f"{at}/{t}/batch={n}")
        df.unpersist()

    run_batches(stream, batch)


def read_applied(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    """refs, packs, outbox and seqs as of the batches that were applied as a whole."""
    seqs = spark.read.parquet(f"{at}/seqs")
    whole = seqs.select("batch").distinct()
    t = {n: spark.read.parquet(f"{at}/{n}").join(F.broadcast(whole), "batch", "left_semi") for n in ("changes", "packs", "outbox")}
    return {
        "refs": latest(t["changes"], ["repo", "name"], ["seq", "pos"], "target").select("repo", "name", "target"),
        "packs": t["packs"].select("repo", "name").distinct(),
        "outbox": t["outbox"].drop("batch").distinct(),
        "seqs": seqs.groupBy("repo").agg(F.max("seq").alias("seq")),
    }
