"""What the operators of this subpackage share: tables, the shared folder, small byte helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z, all other bytes as they are; UTF-8 stays UTF-8.
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: As LOWER, and each ASCII byte that is neither letter nor digit becomes a space.
LOWER_WORDS = bytes(
    LOWER[c] if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder, since all its
    threads are on this machine; a cluster must name one.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        # with its file system named, since executors' Python opens files by URI
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quintet-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new folder's URI below the shared one."""
    base = shared_dir(spark)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    base = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)


#: Spark's setting that deletes a query's shuffle files when the query ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of an iteration, written below the shared folder and deleted when they are done with.

    Calling it writes a DataFrame and returns what is read back, which cuts the
    lineage and survives lost executors. A query's shuffle files go when its
    table is written; drop() deletes tables, close() all that are left.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, fresh_dir(spark, "tables"), 0
        self.paths: list[tuple[DataFrame, str]] = []
        self.tasks: int | None = None

    def bounded(self, rows: int, each: int) -> None:
        """From now on tables follow so many rows: a task and file for `each` of them, and two a core at least."""
        self.tasks = max(2 * self.spark.sparkContext.defaultParallelism, 1 + rows // each)

    def __call__(self, df: DataFrame) -> DataFrame:
        conf, path = self.spark.conf, f"{self.folder}/{self.n}"
        self.n += 1
        before = conf.get(CLEAN, None)
        conf.set(CLEAN, "true")
        try:
            (df if self.tasks is None else df.coalesce(self.tasks)).write.parquet(path)
        finally:
            conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((found, path))
        return found

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no DataFrame in use reads; others than its own are left alone."""
        for table in tables:
            for own, path in self.paths:
                if own is table:
                    self.delete(path)
            self.paths = [x for x in self.paths if x[0] is not table]

    def close(self, *but: DataFrame) -> None:
        """Delete all tables but these."""
        self.drop(*[t for t, _ in self.paths if not any(t is b for b in but)])

    def delete(self, uri: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def masked(docs: DataFrame):
    """(docs under column names that clash with nothing, their names by the old ones, the way back)."""
    from pyspark.sql import functions as F

    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, lambda df: df.select(*[F.col(m).alias(c) for c, m in names.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_fs(uri: str):
    """(file system, path) of a URI, for Python code on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_whole(folder: str, stem: str, suffix: str, produce) -> tuple[str, int]:
    """Write a file of a name that no other attempt uses; what a manifest lists is whole.

    A retried or speculative task writes a file of its own, and only the attempt
    that Spark counts tells its name, so nothing is renamed or replaced: that
    holds on object stores too. A failed attempt deletes what it wrote.
    produce(out) writes to the open stream. Returns the file's URI and size.
    """
    name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    try:
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            produce(out)
            size = out.tell()
    except BaseException:
        fs.delete_file(f"{path}/{name}")
        raise
    return f"{folder}/{name}", size


def trimmed() -> None:
    """Give freed memory back to the system, so that a worker between tasks holds little."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it
        pass


def utf8(column) -> list[bytes | None]:
    """A string column of a record batch as bytes, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, columns[f.name]) for f in schema)],
        schema=schema,
    )


def by_bytes(batches, column: str, most: int = 8 << 20):
    """Record batches, sliced so that a slice's texts hold about `most` bytes.

    One longer text is a slice of its own; no row is cut or dropped.
    """
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // most
        ends = [*np.flatnonzero(np.diff(part)) + 1, b.num_rows]
        at = 0
        for end in ends:
            yield b.slice(at, end - at)
            at = end
