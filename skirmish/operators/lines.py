"""Log lines to stamped texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Texts that are dropped as noise, and the first day of the present log format.
NOISE = (
    "Your target is too far away, get closer!",
    "Your target is too close to use a ranged weapon!",
    "You cannot see your target.",
    "You can't reach that, get closer.",
    "You can't use that command right now...",
    "You must first click on the being you wish to attack!",
)
MIN_DATE = "2018-12-18"


def split_lines(lines: DataFrame, log_tz: str = "UTC", min_date: str | None = MIN_DATE, max_date: str | None = None, ignore: tuple[str, ...] = NOISE) -> DataFrame:
    """(log_id, seq, owner, server, ts, text): the stamp is 20 characters from the 6th on, the text starts at the 28th.

    Lines without a valid stamp, outside the dates or with an ignored text are
    dropped. Stamps carry local time; ``log_tz`` says where. The year 1990 stands
    for an unknown date and becomes ``min_date``.
    """
    stamp = F.try_to_timestamp(F.substring("line", 6, 20), F.lit("MMM dd HH:mm:ss yyyy"))
    out = lines.withColumn("ts", F.to_utc_timestamp(stamp, log_tz)).withColumn("text", F.substring(F.col("line"), F.lit(28), F.length("line")))
    out = out.where(F.col("ts").isNotNull() & F.col("line").startswith("["))
    if min_date:
        first = F.to_timestamp(F.lit(min_date))
        out = out.withColumn("ts", F.when(F.year("ts") == 1990, first).otherwise(F.col("ts"))).where(F.col("ts") >= first)
    if max_date:
        out = out.where(F.col("ts") <= F.to_timestamp(F.lit(max_date)))
    if ignore:
        out = out.where(~F.col("text").isin(*ignore))
    return out.select("log_id", "seq", "owner", "server", "ts", "text")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines without a valid stamp, as they are."""
    stamp = F.try_to_timestamp(F.substring("line", 6, 20), F.lit("MMM dd HH:mm:ss yyyy"))
    return lines.where(stamp.isNull() | ~F.col("line").startswith("["))
