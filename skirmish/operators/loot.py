"""Drops: what was looted or left from which mob, in which zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.operators.fights import with_zone


def drops(events: DataFrame, ignore: DataFrame | None = None) -> DataFrame:
    """(log_id, seq, ts, server, zone, mob, item) of loot and rot events with a known source and zone; ``ignore`` lists items."""
    placed = with_zone(events.where(F.col("kind").isin("zone", "loot", "rot")))
    found = placed.where(F.col("kind").isin("loot", "rot") & F.col("source").isNotNull() & F.col("zone").isNotNull())
    found = found.select("log_id", "seq", "ts", "server", "zone", F.col("source").alias("mob"), "item")
    return found if ignore is None else found.join(ignore.select("item").distinct(), "item", "left_anti").select(*found.columns)


def drop_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("zone", "mob", "item").agg(F.count(F.lit(1)).alias("n"))
