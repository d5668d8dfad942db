"""Differences between two copies of one dataset, by invertible Bloom lookup tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerspark.shared import all_of, cut, union_all

#: The five 64-bit primes and the default seed of Spark's xxhash64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
SEED = 42
#: Each element goes into one cell of each of PARTS parts of its bucket's table.
PARTS = 3
#: Bits of the check hash that choose a cell of a part: so a part has at most 2^20 cells.
BITS = 20
#: Differing keys (8 bytes each) that are sent to every task; more are met by a shuffle.
KEYS_SENT = 1_000_000


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def hash_long(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """XXH64 of 8-byte values, as Spark's xxhash64 has it for a bigint."""
    with np.errstate(over="ignore"):
        h = np.asarray(seed, dtype=np.uint64) + np.uint64(P5) + np.uint64(8)
        h = h ^ (_rotl(x * np.uint64(P2), 31) * np.uint64(P1))
        h = _rotl(h, 27) * np.uint64(P1) + np.uint64(P4)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(P2)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(P3)
        return h ^ (h >> np.uint64(32))


def check_hash(key: np.ndarray, val: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(key, val)."""
    return hash_long(val, hash_long(key, SEED))


def _places(chk: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each element in each part."""
    size = cells // PARTS
    return [(part * size + ((chk >> np.uint64(BITS * part)) & np.uint64(2**BITS - 1)) % np.uint64(size)).astype(np.int64) for part in range(PARTS)]


class Table:
    """An invertible Bloom lookup table of (key hash, row hash) pairs: counts and sums without carry in each cell."""

    def __init__(self, kf: np.ndarray, vf: np.ndarray, cells: int) -> None:
        self.cells = cells
        self.n = np.zeros(cells, np.int64)
        self.sums = [np.zeros(cells, np.uint64) for _ in range(3)]
        chk = check_hash(kf, vf)
        for at in _places(chk, cells):
            self.n += np.bincount(at, minlength=cells)
            for to, x in zip(self.sums, (kf, vf, chk), strict=True):
                np.bitwise_xor.at(to, at, x)

    def minus(self, other: Table) -> Table:
        """What is in one of them only: counts 1 for this one's, -1 for the other's."""
        self.n -= other.n
        for x, y in zip(self.sums, other.sums, strict=True):
            x ^= y
        return self

    def peel(self) -> tuple[np.ndarray, bool]:
        """The key hashes of what is in the table, and whether they are all, that is, whether it came out empty."""
        key, val, chk = self.sums
        found = []
        look = np.flatnonzero(self.n)
        while len(look):
            one = look[np.abs(self.n[look]) == 1]
            one = one[check_hash(key[one], val[one]) == chk[one]]
            if not len(one):
                break
            _, first = np.unique(chk[one], return_index=True)
            one = one[first]
            k, v, c, side = key[one], val[one], chk[one], self.n[one]
            found.append(k)
            touched = _places(c, self.cells)
            for at in touched:
                np.subtract.at(self.n, at, side)
                for to, x in zip(self.sums, (k, v, c), strict=True):
                    np.bitwise_xor.at(to, at, x)
            look = np.unique(np.concatenate(touched))
        whole = not (self.n.any() or any(x.any() for x in self.sums))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64), whole


def differing(kf: np.ndarray, vf: np.ndarray, left: np.ndarray, right: np.ndarray, cells: int) -> np.ndarray:
    """The key hashes of the elements that one side of a bucket has only; with a larger table until one comes out empty, or
    if none may be larger, all of them."""
    while True:
        keys, whole = Table(kf[left], vf[left], cells).minus(Table(kf[right], vf[right], cells)).peel()
        if whole:
            return keys
        if cells >= PARTS << BITS:
            return np.unique(kf)
        cells = min(cells * 4, PARTS << BITS)


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    fields: Sequence[str],
    *,
    rows_per_bucket: int = 16_384,
    cells: int = 3_072,
    salt: int = 0,
) -> DataFrame:
    """Rows that two copies of a dataset don't share: columns on, diff (`only_left`, `only_right` or `values`) and
    changed, the names of the differing fields (empty for rows of one side).

    Null is a value like any other, in keys and fields. A key repeated within a side counts once per distinct row; if
    its rows differ within one side, the sets of rows are compared, and changed has the fields whose sets of values
    differ. Columns that are neither in on nor in fields play no part, whatever their names. Empty sides are fine.

    Only hashes are moved for a start: of each distinct row, repeats reduced before the shuffle, the key's, the row's
    and which sides have it, placed by the row's hash, so that no key is hot. Each task puts what it gets, in buckets of
    at most rows_per_bucket, into an invertible Bloom lookup table for each side; the tables are subtracted and
    peeled, which gives the key hashes of the differences. A bucket with too many of them for its tables gets tables
    four times as large. Then the copies are read once more, and just rows with these key hashes are fetched and compared
    field by field, so that the result doesn't rest on hashes. Two distinct rows of one side with equal hash pairs could
    hide each other (odds below n^2 / 2^128); pass another salt to rule it out.
    """
    on, fields = list(on), list(fields)
    ks, fs = [f"k{i}" for i in range(len(on))], [f"f{i}" for i in range(len(fields))]
    sides = []
    for df, side in ((left, 1), (right, 2)):
        named = df.select(*[F.col(c).alias(k) for c, k in zip(on, ks, strict=True)], *[F.col(c).alias(f) for c, f in zip(fields, fs, strict=True)])
        sides.append(named.withColumns({"side": F.lit(side), "kf": _row_hash(ks, salt)}))
    rows = union_all(sides)
    hashed = rows.select("kf", _row_hash([*ks, *fs], salt + 1).alias("vf"), "side").groupBy("vf", "kf").agg(F.bit_or("side").alias("sides"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            kf, vf = (rb.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("kf", "vf"))
            sides = rb.column("sides").to_numpy(zero_copy_only=False)
            for i in range(0, rb.num_rows, rows_per_bucket):
                at = slice(i, i + rows_per_bucket)
                keys = differing(kf[at], vf[at], sides[at] & 1 > 0, sides[at] & 2 > 0, cells)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["kf"])

    seen = Observation()
    keys = cut(hashed.mapInArrow(run, "kf long").distinct().observe(seen, F.count(F.lit(1)).alias("n")))
    few = F.broadcast(keys) if seen.get["n"] <= KEYS_SENT else keys
    fetched = rows.join(few, "kf", "left_semi")
    # each row once as a whole (part -1) and once for each field with just that; equal ones are reduced before they move
    parts = [F.struct(F.lit(-1).alias("part"), *[F.col(f) for f in fs])]
    parts += [F.struct(F.lit(i).alias("part"), *[(F.col(f) if i == j else F.lit(None).cast(rows.schema[f].dataType)).alias(f) for j, f in enumerate(fs)]) for i in range(len(fs))]
    values = fetched.select(*ks, "side", F.explode(F.array(*parts)).alias("v")).select(*ks, "side", "v.part", *[f"v.{f}" for f in fs])
    values = values.groupBy(*ks, "part", *fs).agg(F.bit_or("side").alias("sides"))
    odd = values.groupBy(*ks).agg(
        F.bit_or("sides").alias("sides"),
        F.bool_or((F.col("part") == -1) & (F.col("sides") < 3)).alias("odd"),
        *[F.bool_or((F.col("part") == i) & (F.col("sides") < 3)).alias(f"odd{i}") for i in range(len(fs))],
    )
    kind = F.when(F.col("sides") == 1, "only_left").when(F.col("sides") == 2, "only_right").otherwise("values")
    changed = F.array_compact(F.array(*[F.when(F.col(f"odd{i}"), F.lit(name)) for i, name in enumerate(fields)])) if fields else F.array().cast("array<string>")
    return odd.filter("odd").select(
        *[F.col(k).alias(c) for k, c in zip(ks, on, strict=True)],
        kind.alias("diff"),
        F.when(F.col("sides") == 3, changed).otherwise(F.array().cast("array<string>")).alias("changed"),
    )


def _row_hash(cols: Sequence[str], salt: int) -> Column:
    """Nulls are told apart from values and from each other's places."""
    return F.xxhash64(F.lit(salt), *[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def table_equal(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row, equal: whether both sides hold the same rows, as sets, null equal to null."""
    same = all_of([F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on])
    l, r = left.select(*on).distinct().alias("l"), right.select(*on).distinct().alias("r")
    odd = l.join(r, same, "left_anti").unionByName(r.join(l, same, "left_anti"))
    return odd.agg((F.count(F.lit(1)) == 0).alias("equal"))
