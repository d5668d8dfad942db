"""Packs as tables: reading them as a data source, and writing rows as packs."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerspark.functions import codec

OBJECTS = "pack string, oid string, kind string, size long, offset long, crc long, data binary"


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """A partition for each pack file: a pack is one chain of deltas and can't be split."""
        found = sorted(glob.glob(os.path.join(self.path, "*.pack"))) if os.path.isdir(self.path) else [self.path]
        return [_File(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            wire = f.read()
        for p in codec.read_pack(wire):
            yield os.path.basename(partition.path), p.oid, p.kind, len(p.data), p.offset, p.crc, p.data


class PackSource(DataSource):
    """spark.read.format("objectpack").load(folder or file): a row for each object of each pack. Register it with
    spark.dataSource.register(PackSource). For folders on a shared or local file system."""

    @classmethod
    def name(cls) -> str:
        return "objectpack"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file://"))


def unpack(files: DataFrame, strict: bool = False) -> DataFrame:
    """Objects of packs given as rows (path, content), as the binaryFile source reads them from any store, with a column
    error. A damaged pack gives one row, with the reason in error and nulls for the object; with strict it fails the
    query. Whatever a pack's objects add up to, none is left out; one of over 64 MiB is damage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pack", "oid", "kind", "size", "offset", "crc", "data", "error"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for rb in batches:
            for path, content in zip(rb.column("path").to_pylist(), rb.column("content"), strict=True):
                try:
                    got = codec.read_pack(content.as_py() or b"")
                except ValueError as e:
                    if strict:
                        raise
                    yield batch([(path, None, None, None, None, None, None, str(e))])
                    continue
                for at in range(0, len(got), 1000):
                    yield batch([(path, p.oid, p.kind, len(p.data), p.offset, p.crc, p.data, None) for p in got[at : at + 1000]])

    return files.select("path", "content").mapInArrow(run, f"{OBJECTS}, error string")


def repack(objects: DataFrame, by: str) -> DataFrame:
    """(by, content, idx, n), a pack and its index as bytes: the objects (kind, data) of each group in one pack, in order of ids, each once. A pack is
    one file, so its objects meet in one task: groups are packs by size, not repositories."""
    kind = objects.schema[by].dataType.simpleString()

    def run(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        each = {codec.oid_of(k, bytes(d)): (k, bytes(d)) for k, d in zip(pdf["kind"], pdf["data"], strict=True)}
        pack = codec.write_pack([each[o] for o in sorted(each)])
        idx = codec.write_index(codec.read_pack(pack), pack[-20:])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "content": [pack], "idx": [idx], "n": [len(each)]})

    return objects.select(by, "kind", "data").groupBy(by).applyInPandas(run, f"{by} {kind}, content binary, idx binary, n long")


def point_read(packs: DataFrame, oids: DataFrame, by: str = "pack") -> DataFrame:
    """(by, oid, kind, data) of the objects oids(oid) in packs(by, content, idx): the indexes say which pack has which, and
    of a pack only the objects asked for are inflated. An object in several packs comes from each."""
    asked = oids.select("oid").filter("oid IS NOT NULL").distinct()
    listed = packs.select(by, F.explode(codec.index_col("idx")).alias("oid"))
    want = listed.join(asked, "oid", "left_semi").groupBy(by).agg(F.collect_set("oid").alias("want"))
    kind = packs.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(rb.num_rows):
                wire, idx = rb.column("content")[i].as_py(), rb.column("idx")[i].as_py()
                want = rb.column("want")[i].as_py()
                for at in range(0, len(want), 1000):
                    got = [(o, codec.read_object(wire, idx, o)) for o in want[at : at + 1000]]
                    yield pa.RecordBatch.from_arrays([pa.repeat(rb.column(by)[i], len(got)), pa.array([o for o, _ in got]), pa.array([g[0] for _, g in got], pa.string()), pa.array([g[1] for _, g in got], pa.binary())], [by, "oid", "kind", "data"])

    # a pack's list of wanted objects is no longer than its index
    return packs.join(want, by).mapInArrow(run, f"{by} {kind}, oid string, kind string, data binary")


def bundles(objects: DataFrame, refs: DataFrame, by: str, before: DataFrame | None = None) -> DataFrame:
    """(by, content): per group one bundle of its refs(by, name, target) and its objects(by, kind, data), whole; with
    before(by, target), the tips of the last bundle, one that needs what these reach: objects are then what the refs reach
    beyond them (see graph.reachable_difference). A bundle is one file, so a group's objects meet in one task, as in repack().
    Groups without refs have none; targets that are no whole ids are left out, as no reader takes them."""
    packed = repack(objects, by)
    heads = refs.filter("name IS NOT NULL AND target RLIKE '^[0-9a-f]{40}$'").groupBy(by).agg(F.collect_set(F.struct("name", "target")).alias("refs"))
    both = heads.join(packed.select(by, "content"), by, "left")
    if before is not None:
        both = both.join(before.filter("target RLIKE '^[0-9a-f]{40}$'").groupBy(by).agg(F.collect_set("target").alias("known")), by, "left")
    else:
        both = both.withColumn("known", F.lit(None).cast("array<string>"))
    kind = refs.schema[by].dataType.simpleString()
    empty = codec.write_pack([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            made = [
                codec.write_bundle([(r["name"], r["target"]) for r in refs], pack or empty, known or ())
                for refs, pack, known in zip(rb.column("refs").to_pylist(), rb.column("content").to_pylist(), rb.column("known").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([rb.column(by), pa.array(made, pa.binary())], [by, "content"])

    return both.mapInArrow(run, f"{by} {kind}, content binary")


def size_groups(objects: DataFrame, size: str, most_bytes: int, salt: str = "oid") -> DataFrame:
    """objects with a column `pack`: groups by hash of the id whose expected size is most_bytes."""
    total = objects.agg(F.coalesce(F.sum(size), F.lit(0)).alias("s")).collect()[0]["s"]
    n = max(1, -(-int(total) // most_bytes))
    return objects.withColumn("pack", F.pmod(F.xxhash64(salt), F.lit(n)).cast("int"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackSource)
