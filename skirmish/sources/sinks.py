"""Fight documents, JSON output and writes that happen once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest_fights(fights: DataFrame, participants: DataFrame, attacks: DataFrame | None = None, series: DataFrame | None = None) -> DataFrame:
    """One document a fight: participants by damage, each with its attacks by damage and its dense series."""
    people = participants
    if attacks is not None:
        order = F.array_sort(F.collect_list(F.struct((-F.col("hit_sum")).alias("o"), "attack", "hit_count", "hit_sum", "hit_max", "crit_count", "crit_sum")))
        nested = attacks.groupBy("fight_id", "name").agg(F.transform(order, lambda a: a.dropFields("o")).alias("attacks"))
        people = people.join(nested, ["fight_id", "name"], "left")
    if series is not None:
        nested = series.groupBy("fight_id", "name").agg(F.array_sort(F.collect_list(F.struct("metric", "values"))).alias("series"))
        people = people.join(nested, ["fight_id", "name"], "left")
    columns = [c for c in people.columns if c not in ("fight_id", "rank_in_fight")]
    documents = people.groupBy("fight_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_in_fight", *columns))), lambda p: p.dropFields("rank_in_fight")).alias("participants"))
    return fights.join(documents, "fight_id")


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


#: Parts by key that a table of :func:`write_once` has, and the column that names them.
PARTS = 256
PART = "key_part"


def part_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(PARTS)).cast("int")


def unwritten(df: DataFrame, path: str, key: str) -> DataFrame:
    """The rows of a batch whose key the table at ``path`` does not have, one a key.

    The table is parted by a hash of the key; only the parts that the batch's keys fall
    into are read (there are at most ``PARTS``, so their numbers may come to the driver),
    and of them the key column alone. Only a missing table counts as a first write.
    """
    fresh = df.dropDuplicates([key]).withColumn(PART, part_of(key))
    try:
        there = df.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return fresh
    parts = [r[0] for r in fresh.select(PART).distinct().collect()]
    return fresh.join(there.where(F.col(PART).isin(parts)).select(key, PART), [key, PART], "left_anti")


def write_once(df: DataFrame, path: str, key: str = "fight_id") -> None:
    """Append the rows whose key the table at ``path`` does not have; keys that come twice are written once.

    The table has a column ``key_part`` more. A batch that is written again adds nothing.
    """
    unwritten(df, path, key).repartition(PART).write.mode("append").partitionBy(PART).parquet(path)
