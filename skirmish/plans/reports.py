"""Reports over fight tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skirmish.functions.text import fmt_num
from skirmish.operators.merge import unmerged
from skirmish.operators.rollups import trash


def per_second(total: Column, duration: Column) -> Column:
    return F.floor(total / F.nullif(duration, F.lit(0))).cast("long")


def short_summary(participants: DataFrame, fights: DataFrame, k: int = 10) -> DataFrame:
    """The first k participants by damage with any: damage, damage per second of the fight, share of the top in percent."""
    rows = participants.where(~F.col("is_target")).join(fights.select("fight_id", "foe", "hp", F.col("duration").alias("fight_duration")), "fight_id")
    fight = Window.partitionBy("fight_id")
    rows = rows.withColumn("rank", F.row_number().over(fight.orderBy(F.col("outbound_hit_sum").desc(), "name"))).withColumn("_top", F.max("outbound_hit_sum").over(fight))
    kept = rows.where((F.col("rank") <= k) & (F.col("outbound_hit_sum") > 0))
    return kept.select("fight_id", "foe", "hp", "rank", "name", F.col("outbound_hit_sum").alias("damage"), per_second(F.col("outbound_hit_sum"), F.col("fight_duration")).alias("dps"), F.floor(F.col("outbound_hit_sum") * 100 / F.nullif(F.col("_top"), F.lit(0))).cast("long").alias("pct_of_top"))


def long_summary(participants: DataFrame, fights: DataFrame, attacks: DataFrame, defenses: DataFrame, spells: DataFrame | None = None, heals: DataFrame | None = None) -> DataFrame:
    """Long form (fight_id, name, section, label, value, per_second, pct): totals, attacks, defenses, hits taken, spells and heals."""
    base = fights.select("fight_id", F.col("duration").alias("_d"))
    none = F.lit(None).cast("long")

    def part(df: DataFrame, section: str, label: Column, value: Column, rate: bool, pct: Column = none) -> DataFrame:
        joined = df.join(base, "fight_id")
        return joined.select("fight_id", "name", F.lit(section).alias("section"), label.alias("label"), value.cast("long").alias("value"), (per_second(value, F.col("_d")) if rate else none).alias("per_second"), pct.cast("long").alias("pct"))

    swings = F.col("inbound_hit_count") + F.col("inbound_miss_count")
    parts = [
        part(participants, "total", F.lit("total"), F.col("outbound_hit_sum"), True),
        part(participants, "taken", F.lit("*hit*"), F.col("inbound_hit_count"), False, F.floor(F.col("inbound_hit_count") * 100 / F.nullif(swings, F.lit(0)))),
        part(attacks, "attack", F.col("attack"), F.col("hit_sum"), True),
        part(defenses, "defense", F.concat(F.lit("*"), F.col("type"), F.lit("*")), F.col("count"), False, F.floor(F.col("count") * 100 / F.nullif(F.col("attempts"), F.lit(0)))),
    ]
    if spells is not None:
        parts.append(part(spells, "spell", F.concat_ws(" ", "type", "spell"), F.col("hit_sum"), False))
    if heals is not None:
        parts.append(part(heals, "healed", F.col("target"), F.col("hit_sum"), False))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def player_board(participants: DataFrame, fights: DataFrame, attacks: DataFrame, died: DataFrame | None = None, k: int = 4) -> DataFrame:
    """Players with damage, their first k attacks per second in one text, the rest as other, and whether they died."""
    by_sum = Window.partitionBy("fight_id", "name").orderBy(F.col("hit_sum").desc(), "attack")
    labelled = attacks.withColumn("_r", F.row_number().over(by_sum)).withColumn("_label", F.when(F.col("_r") <= k, F.col("attack")).otherwise("other")).withColumn("_r", F.least("_r", F.lit(k + 1)))
    sums = labelled.groupBy("fight_id", "name", "_r", "_label").agg(F.sum("hit_sum").alias("s")).where((F.col("_r") <= k) | (F.col("s") > 0))
    sums = sums.join(fights.select("fight_id", F.col("duration").alias("_d")), "fight_id").withColumn("_text", F.concat_ws(" ", fmt_num(per_second(F.col("s"), F.col("_d"))), "_label"))
    notes = sums.groupBy("fight_id", "name").agg(F.expr("listagg(_text, ', ') WITHIN GROUP (ORDER BY _r)").alias("notes"))
    fight = Window.partitionBy("fight_id")
    rows = participants.where(~F.col("is_target")).withColumn("_top", F.max("outbound_hit_sum").over(fight)).where("outbound_hit_sum > 0").drop("duration").join(fights.select("fight_id", F.col("duration").alias("_d")), "fight_id").join(notes, ["fight_id", "name"], "left")
    if died is not None:
        rows = rows.join(died.select("fight_id", "name").distinct().withColumn("_died", F.lit(True)), ["fight_id", "name"], "left")
        rows = rows.withColumn("notes", F.when(F.col("_died"), F.concat(F.lit("DIED - "), F.col("notes"))).otherwise(F.col("notes")))
    return rows.select("fight_id", "name", F.col("outbound_hit_sum").alias("damage"), F.floor(F.col("outbound_hit_sum") * 100 / F.col("_top")).cast("long").alias("pct_of_top"), per_second(F.col("outbound_hit_sum"), F.col("_d")).alias("dps"), "notes")


def pinned_top(participants: DataFrame, pinned: tuple[str, ...], k: int = 6) -> DataFrame:
    """k participants a fight: pinned names with damage first, then the others by rank; shown by rank."""
    names = [n.lower() for n in pinned]
    rows = participants.where(~F.col("is_target"))
    pin = F.lower("name").isin(*names) & (F.col("outbound_hit_sum") > 0) if names else F.lit(False)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("fight_id").orderBy(F.when(pin, 0).otherwise(1), "rank_in_fight")))
    kept = rows.where(F.col("_n") <= k)
    return kept.select("fight_id", F.row_number().over(Window.partitionBy("fight_id").orderBy("rank_in_fight")).alias("slot"), "name", "outbound_hit_sum")


def shares(participants: DataFrame, fights: DataFrame) -> DataFrame:
    """Damage as total, per second, and in permille of the foe's hit points and of the top participant."""
    fight = Window.partitionBy("fight_id")
    rows = participants.where(~F.col("is_target")).withColumn("_top", F.max("outbound_hit_sum").over(fight)).drop("duration").join(fights.select("fight_id", "hp", "duration"), "fight_id")
    part = lambda whole: F.floor(F.col("outbound_hit_sum") * 1000 / F.nullif(F.col(whole), F.lit(0))).cast("long")
    return rows.select("fight_id", "name", F.col("outbound_hit_sum").alias("total"), per_second(F.col("outbound_hit_sum"), F.col("duration")).alias("dps"), part("hp").alias("permille_of_hp"), part("_top").alias("permille_of_top"))


def fight_list(fights: DataFrame, participants: DataFrame) -> DataFrame:
    """Fights with what a list shows: zone, end, hit points, duration, hit points per second and party with its size.

    Fights that timed out as trash are left out; ``place`` numbers a log's fights, newest first.
    """
    target = participants.where("is_target").select("fight_id", F.col("inbound_hit_count").alias("hit_count"))
    people = participants.where(~F.col("is_target")).groupBy("fight_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = fights.join(target, "fight_id", "left").join(people, "fight_id", "left")
    dull = trash(F.col("duration"), F.coalesce("hit_count", F.lit(0)), F.col("hp"))
    kept = rows.where(~(dull & (F.col("status") == "Timeout")))
    zone = F.coalesce("zone", F.lit("Unknown")) if "zone" in fights.columns else F.lit("Unknown")
    party = F.col("party") if "party" in fights.columns else F.lit("Solo")
    newest = Window.partitionBy("log_id").orderBy(F.col("updated_on").desc(), "fight_id")
    return kept.select("fight_id", "log_id", "foe", F.row_number().over(newest).alias("place"), zone.alias("zone"), "updated_on", "status", "hp", "duration", per_second(F.col("hp"), F.col("duration")).alias("hp_per_second"), F.concat(party, F.lit(": "), F.coalesce("_n", F.lit(0))).alias("party"))


def search_fights(fights: DataFrame, participants: DataFrame, text: str) -> DataFrame:
    """Fights whose name or zone holds the text, or with a participant whose name starts with it; case does not matter."""
    low = text.lower()
    hit = participants.where(F.lower("name").startswith(low)).select("fight_id").distinct().withColumn("_p", F.lit(True))
    zone = F.coalesce(F.lower("zone"), F.lit("")).contains(low) if "zone" in fights.columns else F.lit(False)
    joined = fights.join(hit, "fight_id", "left")
    return joined.where(F.lower("foe").contains(low) | zone | F.coalesce("_p", F.lit(False))).drop("_p")


def same_session(fights: DataFrame, chosen: DataFrame, by_zone: bool = False, log_tz: str = "UTC") -> DataFrame:
    """Unmerged fights of the same local day and party (and zone) as one of the ``chosen`` (fight_id), of the same log."""
    keys = ["log_id", "_day", "party", *(["zone"] if by_zone else [])]
    dated = unmerged(fights).withColumn("_day", F.to_date(F.from_utc_timestamp("started_on", log_tz)))
    one = dated.join(chosen.select("fight_id"), "fight_id", "left_semi").select(*keys).distinct()
    return dated.join(one, keys, "left_semi").drop("_day")


def publishable(fights: DataFrame, participants: DataFrame) -> DataFrame:
    """Killed fights that are no trash."""
    hits = participants.where("is_target").select("fight_id", F.col("inbound_hit_count").alias("_hits"))
    joined = fights.join(hits, "fight_id", "left")
    return joined.where((F.col("status") == "Killed") & ~trash(F.col("duration"), F.coalesce("_hits", F.lit(0)), F.col("hp"))).drop("_hits")
