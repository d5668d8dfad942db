"""Cutting lineage, and joins that stand a hot key."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, from spark.checkpoint.dir. Where that is unset, a session of one process (tests)
    gets a temporary folder, one for each application; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="ledgerspark-")
        at = _OWN[app]
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df once into the shared folder and go on from the files: lineage ends there, a lost executor costs a
    re-read. Parquet rather than checkpoint(), which computes the last stage twice and stores rows uncompressed."""
    path = f"{shared_dir(df.sparkSession)}/ledgerspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ledgerspark_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables made by cut() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_ledgerspark_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hot_keys(df: DataFrame, on: Sequence[str], most: int = 256, min_rows: int = 50_000) -> DataFrame | None:
    """The keys of df that may overfill a task: the `most` most frequent ones, if they have min_rows rows at least.
    Any other key holds at most 1/most of the rows. Counts are pre-aggregated before the shuffle; at most `most` rows
    come to the driver. None if no key is hot."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    found = counts.orderBy(F.desc("_n")).limit(most).drop("_n").collect()
    return df.sparkSession.createDataFrame(found, df.select(*on).schema) if found else None


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", **limits: int) -> DataFrame:
    """left join right on equally named columns, for a right side with one row per key. Rows of left with a hot key
    (see hot_keys) meet their at most 256 partners as a broadcast, all others as a shuffle join; rows of left with a
    null in the key match nothing and take no part in the shuffle. how: inner, left, left_semi or left_anti."""
    on = list(on)
    whole = F.lit(True)
    for c in on:
        whole = whole & F.col(c).isNotNull()
    keyed = left.filter(whole)
    parts = []
    hot = hot_keys(keyed, on, **limits)
    if hot is None:
        parts.append(keyed.join(right, on, how))
    else:
        few = F.broadcast(hot)
        parts.append(keyed.join(few, on, "left_semi").join(F.broadcast(right.join(few, on, "left_semi")), on, how))
        parts.append(keyed.join(few, on, "left_anti").join(right, on, how))
    if how in ("left", "left_anti"):
        rest = left.filter(~whole)
        if how == "left":
            for f in right.schema:
                if f.name not in on:
                    rest = rest.withColumn(f.name, F.lit(None).cast(f.dataType))
        parts.append(rest.select(*parts[0].columns))
    return union_all(parts)


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
