"""Helpers shared by the training-data operators: shipping the package, shared storage, Arrow row maps."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: "weakref.WeakKeyDictionary" = weakref.WeakKeyDictionary()


#: Bytes of rows that go to a Python worker at once, where the session does not say: texts may be of any length.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark context, so that Python workers can import it; bound their batches."""
    sc = spark.sparkContext
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    if _shipped.get(sc) == sc.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = os.path.join(tempfile.mkdtemp(), f"{package}_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for base, dirs, files in os.walk(os.path.join(root, package)):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _shipped[sc] = sc.applicationId


_kept: dict = {}


def worker_state(name: str | None, key=None, make: Callable | None = None):
    """What a Python worker keeps between its tasks, of one operator at a time: another name's is dropped first.

    Workers outlive stages; without this each would hold the caches of every operator that it has run.
    """
    if name not in _kept:
        _kept.clear()
        free_memory()
    if name is None:
        return None
    own = _kept.setdefault(name, {})
    if key not in own:
        own[key] = make()
    return own[key]


def free_memory() -> None:
    """Give freed memory back to the system: an executor's limit counts what its idle Python workers hold."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


_own: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, None) or "file://" + tempfile.mkdtemp(prefix="shared-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete materialised tables that no later step reads, and let Spark delete the shuffle files that led to them."""
    for t in tables:
        drop_path(t.sparkSession, t._stored_path)
    release(tables[0].sparkSession)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared storage through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: they go when the driver collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


#: Hash values that a bitmap of keys tells apart; it has at most 1 MB.
MARKED = 1 << 23


def marked(docs: DataFrame, keys: DataFrame, key: Column, name: str) -> DataFrame:
    """The documents with a truth value ``name``: false only for those whose ``key``, a hash, is not among ``keys.text_key``.

    The bitmap is broadcast in pieces of 4 KB, so the documents are not shuffled.
    """
    place = lambda x: F.pmod(x, F.lit(MARKED))
    own = keys.select(place(F.col("text_key")).alias("_p"))
    maps = own.groupBy(F.bitmap_bucket_number("_p").alias(f"{name}_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias(f"{name}_m"))
    out = docs.withColumn(f"{name}_p", place(key)).withColumn(f"{name}_b", F.bitmap_bucket_number(f"{name}_p")).join(F.broadcast(maps), f"{name}_b", "left")
    bit = F.bitmap_bit_position(f"{name}_p")
    byte = F.conv(F.hex(F.substring(F.col(f"{name}_m"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return out.withColumn(name, hit).drop(f"{name}_p", f"{name}_b", f"{name}_m")


def join_null_safe(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on one column, where null matches null; the key of the right side goes, its other columns must be new names."""
    other = right.withColumnRenamed(key, f"_right_{key}")
    return left.join(other, F.col(key).eqNullSafe(F.col(f"_right_{key}")), how).drop(f"_right_{key}")


def map_rows(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, Iterable]], schema: str) -> DataFrame:
    """Map each Arrow batch, given as lists by column, to a batch of output columns."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, ARROW[k]) for x, k in zip((out[n] for n in names), kinds)], names)

    kinds = [f.strip().split(" ")[1] for f in schema.split(",")]
    return df.mapInArrow(run, schema)


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
}


def open_store(path: str):
    """An Arrow file system and the path inside it, for a URI of shared storage."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_once(path: str, data: bytes) -> None:
    """Write a file under its final name only when it is whole, so that a repeated or killed task leaves no torn file."""
    store, at = open_store(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex[:8]}.tmp"
    with store.open_output_stream(part, compression=None) as f:
        f.write(data)
    store.move(part, at)


def read_stream(path: str) -> io.RawIOBase:
    store, at = open_store(path)
    return store.open_input_stream(at, compression=None)
