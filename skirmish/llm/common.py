"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local
    session, as in tests, gets a temporary folder; any other is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = f"file://{tempfile.mkdtemp(prefix='skirmish-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs one reread, not a rerun of
    everything before, and values that depend on task order stay as written.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more; Spark drops the shuffle files of what led to them."""
    for held in tables:
        spark = held.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in held.inputFiles()}:
            place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()  # its cleaner follows the driver's collector


def give_back() -> None:
    """Return freed memory to the system: Spark keeps worker processes, and what they hold counts beside the next task's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(rows: Iterator) -> Iterator:
    """The rows, and at their end :func:`give_back`."""
    try:
        yield from rows
    finally:
        give_back()


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes each, of one row at least, so that what a task makes of a batch is bounded."""
    for batch in batches:
        step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def rank_in_groups(df: DataFrame, keys: Sequence[str], order: Column, out: str, buckets: int = 256, carry: DataFrame | None = None) -> DataFrame:
    """Number the rows of each group from 0 by the long ``order``, without one task per group.

    ``order`` must be spread over all longs (a hash). Its top bits deal every
    group over ``buckets`` tasks in order; a row's number is its number in its
    bucket plus the sizes of the buckets before it. Null keys form a group.
    Ties in ``order`` are numbered in any order. ``carry`` has the keys and columns to
    add to their rows: they come with the sizes, bucket by bucket, so no group is one key.
    """
    width = 64 - (buckets - 1).bit_length()
    o, b, n, past, r, kb, *own = fresh_names(df, "_o", "_b", "_n", "_before", "_r", "_kb", *(f"_k{i}" for i in range(len(keys))))
    dealt = df.withColumn(o, order).withColumn(b, F.shiftright(o, width))
    sizes = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(past, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    inside = Window.partitionBy(*keys, b).orderBy(o)
    ranked = dealt.withColumn(r, F.row_number().over(inside) - 1)
    more = []
    if carry is not None:
        more = [c for c in carry.columns if c not in keys]
        named = carry.withColumnsRenamed({k: f"{k}_of_carry" for k in keys})
        met = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_of_carry")) for k in keys])
        sizes = sizes.join(named, met).drop(*(f"{k}_of_carry" for k in keys))
    sizes = sizes.select(*(F.col(k).alias(name) for name, k in zip(own, keys, strict=True)), F.col(b).alias(kb), past, *more)
    same = F.col(b) == F.col(kb)
    for name, k in zip(own, keys, strict=True):
        same &= F.col(k).eqNullSafe(F.col(name))
    joined = ranked.join(sizes, same, "left")
    return joined.withColumn(out, (F.col(r) + F.col(past)).cast("long")).select(*df.columns, out, *more)


def with_columns_like(df: DataFrame, columns: Sequence[str] = DOCUMENT_COLUMNS) -> DataFrame:
    return df.select(*columns)


def arrow_schema(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
