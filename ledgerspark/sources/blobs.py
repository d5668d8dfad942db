"""A store of named bytes, as tables: listing, reading whole or in ranges, writing once, copying and deleting.

Reading is Spark's binaryFile source, which lists and reads in parallel. Writing goes through the store's own file
system; put_if_absent is the one atomic step, on which the log builds."""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20


def _binary(spark: SparkSession, root: str, pattern: str | None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(root)


def listing(spark: SparkSession, root: str, prefix: str = "", pattern: str | None = None) -> DataFrame:
    """(repo_id, name, size, modified) of the files below root, whose first folder is the repo; names are relative to
    it. The content column is pruned, so that no file is opened."""
    base = root.rstrip("/").removeprefix("file://")
    rel = F.expr(f"substring(path, locate('{base}/', path) + {len(base) + 1})")
    out = _binary(spark, root, pattern).select(rel.alias("_rel"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    out = out.select(F.substring_index("_rel", "/", 1).alias("repo_id"), F.expr("substring(_rel, locate('/', _rel) + 1)").alias("name"), "size", "modified")
    return out.filter(F.col("name").startswith(prefix)) if prefix else out


def prefixes(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, root).select("repo_id").distinct()


def read(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, content) of the files below root."""
    return _binary(spark, root, pattern).select("path", "content")


def read_range(files: DataFrame, offset: int, length: int) -> DataFrame:
    """content cut to a range, shorter at the end of the file."""
    if length <= 0:
        raise ValueError("length must be positive")
    return files.withColumn("content", F.substring("content", offset + 1, length))


def blocks(files: DataFrame, size: str = "size", block: int = BLOCK) -> DataFrame:
    """A row for each aligned block of each file: block, offset and its length."""
    n = F.explode(F.sequence(F.lit(0), F.floor((F.col(size) - 1) / block).cast("long")))
    out = files.filter(F.col(size) > 0).withColumn("block", n).withColumn("offset", F.col("block") * block)
    return out.withColumn("length", F.least(F.lit(block).cast("long"), F.col(size) - F.col("offset")))


def first_tier(tiers: list[DataFrame], key: str = "oid") -> DataFrame:
    """One row per key, from the first tier that has it."""
    from ledgerspark.shared import union_all

    cols = tiers[0].columns
    rows = union_all([t.select(*cols).withColumn("_tier", F.lit(i)) for i, t in enumerate(tiers)])
    rest = [c for c in cols if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), "_tier").alias("_r"), F.min("_tier").alias("tier")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest], "tier")


class Store:
    """What every store does, <root>/<repo>/<name> being a file. get() gives None for a missing file, fetch() an error."""

    root: str

    def put(self, repo: str, name: str, data: bytes) -> None:
        raise NotImplementedError

    def put_if_absent(self, repo: str, name: str, data: bytes) -> bool:
        raise NotImplementedError

    def get(self, repo: str, name: str) -> bytes | None:
        raise NotImplementedError

    def names(self, repo: str) -> list[str]:
        """Names of the files directly below a repo, in order."""
        raise NotImplementedError

    def fetch(self, repo: str, name: str) -> bytes:
        data = self.get(repo, name)
        if data is None:
            raise FileNotFoundError(f"{repo}/{name}")
        return data


def store_at(spark: SparkSession, root: str) -> Store:
    """The store for a root: one on the machine's own file system for file: roots, else on Hadoop's file systems."""
    if ":" not in root or root.startswith("file:"):
        return LocalStore(re.sub("^file:/*", "/", root))
    return HadoopStore(spark, root)


class LocalStore(Store):
    """The store on one file system, which may be mounted on many machines: <root>/<repo>/<name>."""

    def __init__(self, root: str) -> None:
        self.root = root

    def names(self, repo: str) -> list[str]:
        with contextlib.suppress(FileNotFoundError):
            return sorted(n for n in os.listdir(os.path.join(self.root, repo)) if not n.endswith(".part"))
        return []

    def path(self, repo: str, name: str) -> str:
        full = os.path.normpath(os.path.join(self.root, repo, name))
        if not full.startswith(os.path.join(os.path.normpath(self.root), repo) + os.sep):
            raise ValueError(f"bad key {name!r}")
        return full

    def put(self, repo: str, name: str, data: bytes) -> None:
        """Whole or not at all: a temporary file takes the name at the end."""
        to = self.path(repo, name)
        os.makedirs(os.path.dirname(to), exist_ok=True)
        part = f"{to}.{os.getpid()}.part"
        with open(part, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, to)

    def put_if_absent(self, repo: str, name: str, data: bytes) -> bool:
        """False if the name is taken; of several writers one succeeds, and its file is whole when it appears."""
        to = self.path(repo, name)
        os.makedirs(os.path.dirname(to), exist_ok=True)
        part = f"{to}.{os.getpid()}.{id(data)}.part"
        with open(part, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(part, to)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(part)

    def get(self, repo: str, name: str) -> bytes | None:
        with contextlib.suppress(FileNotFoundError), open(self.path(repo, name), "rb") as f:
            return f.read()
        return None

    def copy(self, repo: str, name: str, to: str) -> None:
        os.makedirs(os.path.dirname(self.path(repo, to)), exist_ok=True)
        shutil.copyfile(self.path(repo, name), self.path(repo, to))

    def delete(self, repo: str, name: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(self.path(repo, name))


class HadoopStore(Store):
    """The store on any of Hadoop's file systems, from the driver. put_if_absent writes aside and then renames without
    overwriting, which HDFS does atomically; an object store needs one that refuses to overwrite. Server-side copies are the
    file system's matter."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        sc = spark.sparkContext
        self.root, self._jvm, self._conf = root.rstrip("/"), sc._jvm, sc._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self._conf)

    def _path(self, repo: str, name: str) -> object:
        if not name or name.startswith("/") or any(p in ("", ".", "..") for p in f"{repo}/{name}".split("/")):
            raise ValueError(f"bad key {name!r}")
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{repo}/{name}")

    def _write(self, path: object, data: bytes) -> None:
        out = self._fs.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def put(self, repo: str, name: str, data: bytes) -> None:
        to = self._path(repo, name)
        part = to.suffix(f".{uuid.uuid4().hex}.part")
        self._write(part, data)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(part, to, self._rename("OVERWRITE"))

    def _rename(self, *how: str) -> object:
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        out = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), len(how))
        for i, h in enumerate(how):
            out[i] = kind.valueOf(h)
        return out

    def put_if_absent(self, repo: str, name: str, data: bytes) -> bool:
        to = self._path(repo, name)
        if self._fs.exists(to):
            return False
        part = to.suffix(f".{uuid.uuid4().hex}.part")
        self._write(part, data)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(part, to, self._rename())
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(part, False)

    def get(self, repo: str, name: str) -> bytes | None:
        at = self._path(repo, name)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def get_range(self, repo: str, name: str, offset: int, length: int) -> bytes:
        """A part of a file, shorter at its end."""
        if length <= 0:
            raise ValueError("length must be positive")
        stream = self._fs.open(self._path(repo, name))
        try:
            stream.seek(offset)
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)))
        finally:
            stream.close()

    def names(self, repo: str) -> list[str]:
        at = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{repo}")
        if not self._fs.exists(at):
            return []
        return sorted(n for f in self._fs.listStatus(at) if not (n := f.getPath().getName()).endswith(".part"))

    def copy(self, repo: str, name: str, to: str) -> None:
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(repo, name), self._fs, self._path(repo, to), False, self._conf)

    def delete(self, repo: str, name: str) -> None:
        self._fs.delete(self._path(repo, name), False)


class SharedStore:
    """Writing to, listing and reading a root URI that all executors reach: a mounted folder (file:), or what pyarrow has a file system for.
    A repeated write replaces the file, so that a retried task does no harm."""

    def __init__(self, root: str) -> None:
        from pyarrow import fs

        # Hadoop writes local paths as file:/x too, which pyarrow takes for a relative one
        self.fs, self.root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root) if ":" in root else f"file://{root}")

        self.local = isinstance(self.fs, fs.LocalFileSystem)
        self._made: set[str] = set()

    def put(self, repo: str, name: str, data: bytes) -> None:
        to = f"{self.root}/{repo}/{name}"
        folder = os.path.dirname(to)
        if folder not in self._made:
            self.fs.create_dir(folder, recursive=True)
            if len(self._made) >= 1 << 16:
                self._made.clear()
            self._made.add(folder)
        with self.fs.open_output_stream(to, compression=None) as f:
            f.write(data)

    def below(self, folder: str = "") -> Iterator[tuple[str, bool]]:
        """(name relative to the root, whether it is a folder) of what lies directly below a folder; on a mounted folder one
        by one, so that a large one takes no memory."""
        at = f"{self.root}/{folder}".rstrip("/")
        prefix = f"{folder}/" if folder else ""
        if self.local:
            with os.scandir(at) as found:
                for e in found:
                    yield prefix + e.name, e.is_dir()
        else:
            from pyarrow import fs

            for i in self.fs.get_file_info(fs.FileSelector(at)):
                yield prefix + i.base_name, i.type == fs.FileType.Directory

    def files(self, folder: str) -> Iterator[str]:
        """Names, relative to the root, of all files below a folder, at any depth."""
        todo = [folder]
        while todo:
            for name, is_dir in self.below(todo.pop()):
                if is_dir:
                    todo.append(name)
                else:
                    yield name

    def read(self, name: str) -> bytes:
        if self.local:
            with open(f"{self.root}/{name}", "rb") as f:
                return f.read()
        with self.fs.open_input_stream(f"{self.root}/{name}", compression=None) as f:
            return f.read()

    def remove(self, folder: str) -> None:
        """A folder with all that is in it, if it is there."""
        if self.local:
            shutil.rmtree(f"{self.root}/{folder}", ignore_errors=True)
        else:
            with contextlib.suppress(FileNotFoundError):
                self.fs.delete_dir(f"{self.root}/{folder}")
