"""What the corpus operators share: durable intermediate tables, range buckets, word splitting, folds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Stands for a null id where ids are ordered or hashed.
NULL_KEY = -(2**63)


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; bytes.split() cuts at exactly the characters that WORD excludes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is unset, a local session (tests) gets a folder of this machine, set once; any other is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pitchloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of durable() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.durable_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (local, HDFS, S3, GCS) and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def release() -> None:
    """Give back what a task has freed: workers are reused, and what several stages leave behind would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


#: What a worker keeps from task to task, by the operator that made it.
worker_caches: dict[str, object] = {}


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, cache: str | None = None) -> DataFrame:
    """mapInArrow with Python's cyclic collector off: the hot loops make millions of strings and no cycles.

    A worker's caches go, but for the one named, when it begins a task of another operator.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [n for n in worker_caches if n != cache]:
            del worker_caches[name]
            release()
        gc.disable()
        try:
            yield from function(batches)
        finally:
            gc.enable()
            release()

    return df.mapInArrow(run, schema)


def in_slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a step holds at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def named(columns: Sequence[str], name: str) -> int:
    """Place of a column: of that very name, or else of that name in another case."""
    return list(columns).index(name) if name in columns else [c.lower() for c in columns].index(name.lower())


def extend(docs: DataFrame, inputs: Sequence[str], added: dict[str, str], function: Callable[..., list[pa.Array]], rows: int = 512) -> DataFrame:
    """docs with columns made by function(an array for each input) from slices of rows.

    Columns of docs that have an added name, in whatever case, give way to it; all others stay, whatever their names.
    """
    names = docs.columns
    fresh = {a.lower() for a in added}
    kept = [i for i, c in enumerate(names) if c.lower() not in fresh]
    at = [named(names, c) for c in inputs]
    numbered = docs.toDF(*[f"_{i}" for i in range(len(names))])
    schema = T.StructType([numbered.schema[f"_{i}"] for i in kept] + T.StructType.fromDDL(", ".join(f"{a} {kind}" for a, kind in added.items())).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, rows):
            made = function(*[batch.column(f"_{i}") for i in at])
            yield pa.RecordBatch.from_arrays([*(batch.column(f"_{i}") for i in kept), *made], [*(f"_{i}" for i in kept), *added])

    needed = [f"_{i}" for i in sorted({*kept, *at})]
    return map_batches(numbered.select(*needed), run, schema).toDF(*[names[i] for i in kept], *added)


def filtered(docs: DataFrame, inputs: Sequence[str], added: dict[str, str], function: Callable[..., list[pa.Array]], condition: Column, rows: int = 512) -> DataFrame:
    """The rows of docs whose added columns meet the condition, with docs' own columns, whatever their names."""
    names = docs.columns
    at = [f"_{named(names, c)}" for c in inputs]
    found = extend(docs.toDF(*[f"_{i}" for i in range(len(names))]), at, added, function, rows)
    return found.where(condition).drop(*added).toDF(*names)


def range_splits(df: DataFrame, key: str, parts: int) -> list[int]:
    """parts - 1 ascending split values of a numeric key, at about equal numbers of rows; a value of many rows repeats."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, at, max(10_000, 20 * parts)).alias("s")).first()["s"]
    return sorted(found or [])


def range_bucket(key: str, splits: Sequence[int], tie: Column | None = None) -> Column:
    """Number of splits below an integer key, so that buckets ascend with it; a null key counts as the least.

    Where a split repeats, its key fills several buckets: its rows are dealt over them by ``tie`` (a hash), ascending, so
    no key is one task's alone. Only key and tie go to Python; the splits are a bounded array (one for each bucket).
    """
    at = np.array(splits, np.int64)

    @F.pandas_udf("int")
    def bucket(x: pd.Series, h: pd.Series) -> pd.Series:
        keys = x.to_numpy(np.int64)
        first = np.searchsorted(at, keys, side="left")
        several = np.searchsorted(at, keys, side="right") - first
        share = (h.to_numpy(np.int64).astype(np.float64) + 2.0**63) / 2.0**64
        return pd.Series((first + np.floor(np.minimum(share, 1 - 2.0**-53) * several)).astype(np.int32))

    return bucket(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)), F.lit(-(2**63)) if tie is None else tie)


def parts_for(df: DataFrame, size: int) -> int:
    """Parts of about so many bytes, by the size that Spark's statistics have of a table."""
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, -(-held // size))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
