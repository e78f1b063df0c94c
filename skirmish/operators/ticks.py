"""Six-second series: wall-clock buckets counted from a fight's start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 6


def tick(ts: Column, start: Column, width: int = WIDTH) -> Column:
    """The bucket of a time: 0 for the start's and all before. Sixty is a multiple of the width, so buckets align with the clock."""
    return F.greatest(F.lit(0), F.floor(F.unix_timestamp(ts) / width) - F.floor(F.unix_timestamp(start) / width)).cast("long")


def tick_series(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(fight_id, name, metric, tick, value): dps, tank_dps (melee taken), hps and inbound_hps; ticks without value are absent."""
    hit, heal = F.col("kind") == "hit", F.col("kind") == "heal"

    def part(when: Column, name: str, metric: str) -> Column:
        return F.when(when, F.struct(F.col(name).alias("name"), F.lit(metric).alias("metric")))

    metrics = F.array(
        part(hit, "source", "dps"),
        part(hit & F.col("spell").isNull() & ~F.col("source").eqNullSafe(F.col("target")), "target", "tank_dps"),
        part(heal, "source", "hps"),
        part(heal, "target", "inbound_hps"),
    )
    spread = rows.where(hit | heal).select("fight_id", tick(F.col("ts"), F.col("started_on"), width).alias("tick"), "amount", F.explode(metrics).alias("m")).where(F.col("m.name").isNotNull())
    found = spread.groupBy("fight_id", "m.name", "m.metric", "tick").agg(F.sum("amount").alias("value"))
    return found.where("value <> 0")


def dense(series: DataFrame) -> DataFrame:
    """(fight_id, name, metric, values): a list with zeros up to the last tick that has a value."""
    found = series.groupBy("fight_id", "name", "metric").agg(F.map_from_entries(F.collect_list(F.struct("tick", "value"))).alias("m"), F.max("tick").alias("last"))
    return found.select("fight_id", "name", "metric", F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("values"))


def widen(series: DataFrame, n: int) -> DataFrame:
    """Buckets n times as wide."""
    return series.withColumn("tick", F.floor(F.col("tick") / n).cast("long")).groupBy("fight_id", "name", "metric", "tick").agg(F.sum("value").alias("value"))
