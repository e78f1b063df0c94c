"""What held before a row of a log, and sums up to it, without a task a log.

Rows of a key (a log, a name in a log) are cut into ranges; a range is a task's
work, and what the ranges before it left over comes as one row a range. So a
window over a key alone only ever sees a row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skirmish.sources.store import stored

#: Lines of a log, by ``seq``, that one task looks at.
CHUNK = 1 << 20
#: Rows of a log that one task folds, and the quantiles that a log is cut at.
CHUNK_ROWS = 1 << 19
_CUTS = 2048
#: Seconds of a log that one task looks at, where rows come by time.
SECONDS = 1 << 14


def last_known(rows: DataFrame, values: dict[str, Column], bucket: int | Column = CHUNK, keys: Sequence[str] = ("log_id",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Adds columns: each the last value that was not null up to a row, itself included, by ``order``.

    ``bucket`` is the length of a range of ``seq``, or a column that numbers ranges and
    grows with the order. Rows that tie in the order come in any order.
    """
    cut = rows.withColumns({"_b": F.floor(F.col("seq") / bucket) if isinstance(bucket, int) else bucket, **{f"_v_{n}": v for n, v in values.items()}})
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    told = cut.groupBy(*keys, "_b").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_l_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = told.select(*keys, "_b", *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values])
    found = cut.withColumns({f"_v_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values})
    joined = found.join(carried, [*keys, "_b"])
    return joined.select(*rows.columns, *[F.coalesce(f"_v_{n}", f"_c_{n}").alias(n) for n in values])


def running_sum(rows: DataFrame, value: Column, out: str, bucket: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds the sum of ``value`` over the rows of a key up to each, itself included. Rows must not tie in the order."""
    cut = rows.withColumns({"_b": bucket, "_v": value})
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s")).select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_c"))
    joined = cut.withColumn("_v", F.sum("_v").over(inside)).join(carried, [*keys, "_b"])
    return joined.withColumn(out, F.col("_v") + F.col("_c")).select(*rows.columns, out)


def in_chunks(rows: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``chunk``: logs are cut into stretches of about ``size`` rows, at quantiles of ``seq``; rows of one ``seq`` stay together."""
    counted = rows.groupBy("log_id").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("seq", F.lit([k / _CUTS for k in range(1, _CUTS)]), F.lit(4 * _CUTS)).alias("c"))
    each = F.greatest(F.lit(1), F.lit(_CUTS) * size / F.col("n")).cast("int")
    long = counted.where(F.col("n") > size).select("log_id", F.array_distinct(F.filter("c", lambda x, i: (i + 1) % each == 0)).alias("_cuts"))
    met = rows.join(long, "log_id", "left")
    return met.withColumn("chunk", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("seq"))), F.lit(0)).cast("int")).drop("_cuts")


def stored_in_chunks(rows: DataFrame, size: int = CHUNK_ROWS) -> tuple[DataFrame, bool]:
    """``rows`` stored with their ``chunk``, and whether any log is cut; where none is longer than ``size``, quantiles are not asked for."""
    kept = stored(rows, "rows")
    if kept.groupBy("log_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).isEmpty():
        return kept.withColumn("chunk", F.lit(0)), False
    return stored(in_chunks(kept, size), "chunked"), True
