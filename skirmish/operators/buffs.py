"""Buffs on players, from casts and landing texts.

The list of tracked spells is a table of names (``spell``, and ``place`` for its
order), joined with the spell dimension; it is the user's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skirmish.functions.text import strip_rank
from skirmish.sources.spells import SELF_TARGETS

DEATH = "*Died"
SELF_OR_PET = (6, 14)


def tracked_spells(spells: DataFrame, names: DataFrame) -> DataFrame:
    """The dimension's rows of the tracked names, with their place and the name without rank."""
    return names.join(spells.withColumnRenamed("name", "spell"), "spell").withColumn("base", strip_rank(F.col("spell")))


def buff_events(events: DataFrame, tracked: DataFrame) -> DataFrame:
    """(log_id, seq, ts, target, spell, duration_ticks): self casts, landing texts, deaths, shields and rescues.

    A landing text is not counted if its target's last cast was a self spell with
    the same text. Texts that several spells share go to the first by place.
    """
    base = tracked.groupBy("base").agg(*[F.min_by(c, "place").alias(f"t_{c}") for c in ("target", "duration_ticks", "land_self", "land_others")])
    casts = events.where(F.col("kind") == "casting").withColumn("base", strip_rank(F.col("spell"))).join(base, "base", "left")
    own = casts.where(F.col("t_target").isin(*SELF_OR_PET)).select("log_id", "seq", "ts", F.col("source").alias("target"), "spell", F.col("t_duration_ticks").alias("duration_ticks"))

    # the raw lines that land, by full text on the log's owner or by the text after the first word on that word
    lines = events.where(F.col("kind") == "raw").withColumns({"_word": F.regexp_extract("text", r"^\w+", 0), "_rest": F.regexp_replace("text", r"^\w+", "")})
    shared = tracked.where(~F.col("target").isin(*SELF_TARGETS))

    def landing(text: str) -> DataFrame:
        kept = shared.where(F.col(text).isNotNull() & (F.col(text) != "")).groupBy(text).agg(F.min_by(F.struct("place", "base", "duration_ticks"), "place").alias("s"))
        return kept.select(F.col(text).alias("_text"), "s")

    to_self = lines.join(landing("land_self"), F.col("text") == F.col("_text")).select("log_id", "seq", "ts", F.col("owner").alias("target"), "s", "_text", F.lit(True).alias("_self"))
    to_other = lines.join(landing("land_others"), F.col("_rest") == F.col("_text")).select("log_id", "seq", "ts", F.col("_word").alias("target"), "s", "_text", F.lit(False).alias("_self"))
    first = Window.partitionBy("log_id", "seq").orderBy("s.place", F.col("_self").desc())
    landed = to_self.unionByName(to_other).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")

    # the target's last cast before, as of the line
    last = casts.select("log_id", "seq", F.col("source").alias("target"), F.struct("t_target", "t_land_self", "t_land_others").alias("_cast"))
    both = landed.withColumn("_line", F.lit(True)).unionByName(last, allowMissingColumns=True)
    before = Window.partitionBy("log_id", "target").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    marked = both.withColumn("_last", F.last("_cast", ignorenulls=True).over(before)).where("_line")
    same = F.when(F.col("_self"), F.col("_last.t_land_self")).otherwise(F.col("_last.t_land_others")) == F.col("_text")
    marked = marked.where(~F.coalesce(same & F.col("_last.t_target").isin(*SELF_TARGETS), F.lit(False)))
    spread = marked.select("log_id", "seq", "ts", "target", F.col("s.base").alias("spell"), F.col("s.duration_ticks").alias("duration_ticks"))
    return own.unionByName(spread).unionByName(pseudo_buffs(events))


def pseudo_buffs(events: DataFrame) -> DataFrame:
    """Deaths, living shields and rescues as buffs."""
    kind = F.col("kind")
    target = F.when(kind == "death", F.col("name")).otherwise(F.col("target"))
    spell = F.when(kind == "death", DEATH).when(kind == "shield", F.concat(F.lit("*Shielded by "), F.col("source"))).otherwise("*Rescued by DI")
    return events.where(kind.isin("death", "shield", "rescued")).select("log_id", "seq", "ts", target.alias("target"), spell.alias("spell"), F.lit(None).cast("int").alias("duration_ticks"))


def buffs_in_fight(buffs: DataFrame, participants: DataFrame, fights: DataFrame, lead: int = 10, bucket: int = 60) -> DataFrame:
    """(fight_id, name, spell, time): buffs on a participant from ``lead`` seconds before its fight to its end; time counts from the start."""
    span = fights.select("fight_id", "log_id", "started_on", "updated_on", F.explode(F.sequence(F.floor((F.unix_timestamp("started_on") - lead) / bucket), F.floor(F.unix_timestamp("updated_on") / bucket))).alias("_b"))
    people = participants.select("fight_id", "name").join(span, "fight_id")
    given = buffs.select("log_id", F.col("target").alias("name"), "ts", "seq", "spell", F.floor(F.unix_timestamp("ts") / bucket).alias("_b"))
    met = people.join(given, ["log_id", "name", "_b"])
    offset = F.unix_timestamp("ts") - F.unix_timestamp("started_on")
    return met.where((offset >= -lead) & (F.col("ts") <= F.col("updated_on"))).select("fight_id", "name", "spell", "seq", offset.alias("time"))


def stream_buffs(buffs: DataFrame, watermark: str = "5 minutes") -> DataFrame:
    """Buffs of a stream, each once; what is older than the watermark is forgotten."""
    return buffs.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["log_id", "target", "spell", "ts"])
