"""Sums per fight and participant, from rows that are in fights (see ``fights.in_fights``).

Each hit is an outbound row of its source and an inbound row of its target; all
tables are one aggregation over such rows, with map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skirmish.functions.text import attack_label

# The order in which a swing can fail.
DEFENSE_ORDER = ("miss", "invul", "block", "riposte", "parry", "dodge", "shield", "unknown", "rune")
_EMPTY = "array<string>"


def _has(mod: str) -> Column:
    return F.array_contains(F.coalesce(F.col("mods"), F.array().cast(_EMPTY)), mod)


def sides(rows: DataFrame) -> DataFrame:
    """Adds ``name`` and ``side`` (out, in): two rows each, one where source and target are the same."""
    out = F.struct(F.col("source").alias("name"), F.lit("out").alias("side"))
    into = F.struct(F.col("target").alias("name"), F.lit("in").alias("side"))
    both = F.when(F.col("source").eqNullSafe(F.col("target")), F.array(out)).otherwise(F.array(out, into))
    spread = rows.drop("name").withColumn("_s", F.explode(both))
    return spread.select("*", "_s.name", "_s.side").drop("_s").where(F.col("name").isNotNull())


def _struck() -> Column:
    """A hit by strikethrough that is no riposte."""
    return (F.col("kind") == "hit") & _has("Strikethrough") & ~_has("Riposte")


def with_unknown_misses(rows: DataFrame) -> DataFrame:
    """A strikethrough that is no riposte means a defense that failed: it adds an inbound miss of unknown type.

    Both rows are made of one: a union of two reads, joined later by the key both are dealt by, can fail as its sides
    are coalesced apart.
    """
    made = F.col("_derived")
    each = rows.select("*", F.explode(F.when(_struck(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("_derived"))
    miss = {"kind": F.lit("miss"), "type": F.lit("unknown"), "amount": F.lit(None).cast("long"), "spell": F.lit(None).cast("string"), "mods": F.array().cast(_EMPTY)}
    return each.withColumns({c: F.when(made, v).otherwise(F.col(c)) for c, v in miss.items()})


def participant_rollup(rows: DataFrame, heals: DataFrame | None = None) -> DataFrame:
    """Counters of every participant: hits, misses, melee, strikes, first and last action, duration and rank by damage.

    The target's duration is the fight's. With ``heals`` (attributed to fights) there
    are the sums of :func:`heals_by_name` too. Others than the target who neither
    dealt nor took damage nor healed are left out.
    """
    both = sides(with_unknown_misses(rows.where(F.col("kind").isin("hit", "miss"))))
    hit, miss = F.col("kind") == "hit", F.col("kind") == "miss"
    out, into = F.col("side") == "out", F.col("side") == "in"
    melee = hit & into & F.col("spell").isNull()

    def total(when: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("amount"))), F.lit(0)).alias(name)

    found = both.groupBy("fight_id", "name", "foe").agg(
        F.count_if(hit & out).alias("outbound_hit_count"),
        total(hit & out, "outbound_hit_sum"),
        F.count_if(miss & out & ~F.col("_derived")).alias("outbound_miss_count"),
        F.count_if(hit & out & _has("Strikethrough")).alias("outbound_strike_count"),
        F.count_if(hit & into).alias("inbound_hit_count"),
        total(hit & into, "inbound_hit_sum"),
        F.count_if(melee).alias("inbound_melee_count"),
        total(melee, "inbound_melee_sum"),
        total(hit & into & _has("Riposte"), "inbound_riposte_sum"),
        F.count_if(hit & into & _has("Strikethrough")).alias("inbound_strike_count"),
        F.count_if(miss & into).alias("inbound_miss_count"),
        F.min_by("ts", "seq").alias("first_action"),
        F.max_by("ts", "seq").alias("last_action"),
        F.max("fight_duration").alias("_whole"),
    )
    if heals is not None:
        healed = heals_by_name(heals)
        sums = [c for c in healed.columns if c.endswith("_sum")]
        foes = rows.groupBy("fight_id").agg(F.first("foe").alias("_foe"), F.max("fight_duration").alias("_long"))
        found = found.join(healed, ["fight_id", "name"], "full").join(foes, "fight_id")
        counters = [c for c, kind in found.dtypes if kind == "bigint" and c not in ("_whole", "_long")]
        found = found.withColumns({c: F.coalesce(c, F.lit(0)) for c in {*counters, *sums}} | {"foe": F.col("_foe"), "_whole": F.col("_long"), "first_action": F.least("first_action", "first_heal"), "last_action": F.greatest("last_action", "last_heal")})
        found = found.drop("_foe", "_long", "first_heal", "last_heal")
    target = F.col("name") == F.col("foe")
    own = F.unix_timestamp("last_action") - F.unix_timestamp("first_action") + 1
    found = found.withColumn("duration", F.when(target, F.col("_whole")).otherwise(F.coalesce(own, F.lit(0)))).withColumn("is_target", target).drop("_whole", "foe")
    active = (F.col("outbound_hit_sum") > 0) | (F.col("inbound_hit_sum") > 0)
    if heals is not None:
        active |= F.col("outbound_heal_sum") > 0
    by_damage = Window.partitionBy("fight_id").orderBy(F.col("outbound_hit_sum").desc(), "name")
    return found.where(F.col("is_target") | active).withColumn("rank_in_fight", F.row_number().over(by_damage))


def attack_rollup(rows: DataFrame) -> DataFrame:
    crit = _has("Critical")
    hits = rows.where(F.col("kind") == "hit").withColumn("attack", attack_label(F.col("type"), F.coalesce(F.col("mods"), F.array().cast(_EMPTY))))
    return hits.groupBy("fight_id", F.col("source").alias("name"), "attack").agg(
        F.count(F.lit(1)).alias("hit_count"),
        F.sum("amount").alias("hit_sum"),
        F.max("amount").alias("hit_max"),
        F.count_if(crit).alias("crit_count"),
        F.coalesce(F.sum(F.when(crit, F.col("amount"))), F.lit(0)).alias("crit_sum"),
    )


def spell_rollup(rows: DataFrame) -> DataFrame:
    """Hits with a spell, and heals (without one: Lifetap), by caster, kind and spell."""
    crit = _has("Critical")
    cast = rows.where(((F.col("kind") == "hit") & F.col("spell").isNotNull()) | ((F.col("kind") == "heal") & F.col("source").isNotNull()))
    full = F.col("full_amount") if "full_amount" in rows.columns else F.lit(None).cast("long")
    return cast.groupBy("fight_id", F.col("source").alias("name"), F.col("kind").alias("type"), F.coalesce("spell", F.lit("Lifetap")).alias("spell")).agg(
        F.count(F.lit(1)).alias("hit_count"),
        F.sum("amount").alias("hit_sum"),
        F.max("amount").alias("hit_max"),
        F.coalesce(F.sum(full), F.lit(0)).alias("full_sum"),
        F.count_if(crit).alias("crit_count"),
        F.coalesce(F.sum(F.when(crit, F.col("amount"))), F.lit(0)).alias("crit_sum"),
        F.count_if(_has("Twincast")).alias("twin_count"),
    )


def heal_rollup(rows: DataFrame) -> DataFrame:
    """By healer and target; heals that landed for nothing are left out."""
    heals = rows.where((F.col("kind") == "heal") & F.col("source").isNotNull())
    found = heals.groupBy("fight_id", F.col("source").alias("name"), "target").agg(F.count(F.lit(1)).alias("hit_count"), F.sum("amount").alias("hit_sum"), F.sum("full_amount").alias("full_sum"))
    return found.where("hit_sum > 0").withColumn("overheal", F.col("full_sum") - F.col("hit_sum"))


def heals_by_name(rows: DataFrame) -> DataFrame:
    """Healing done and received; a heal on oneself is both, once each."""
    heals = rows.where(F.col("kind") == "heal")
    both = F.array(F.struct(F.col("source").alias("name"), F.lit(True).alias("out")), F.struct(F.col("target").alias("name"), F.lit(False).alias("out")))
    spread = heals.select("fight_id", "ts", "amount", "full_amount", F.explode(both).alias("s")).where(F.col("s.name").isNotNull())
    out = F.col("s.out")
    return spread.groupBy("fight_id", F.col("s.name").alias("name")).agg(
        F.min(F.when(out, F.col("ts"))).alias("first_heal"),
        F.max(F.when(out, F.col("ts"))).alias("last_heal"),
        *[F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0)).alias(f"{label}_{n}_sum") for side, label in ((out, "outbound"), (~out, "inbound")) for c, n in (("amount", "heal"), ("full_amount", "full_heal"))]
    )


def defense_rollup(rows: DataFrame, participants: DataFrame) -> DataFrame:
    """Failed swings at each participant by type, with the attempts that were left when it was its type's turn."""
    missed = with_unknown_misses(rows.where((F.col("kind") == "miss") | _struck())).where(F.col("kind") == "miss")
    counts = missed.groupBy("fight_id", F.col("target").alias("name"), "type").agg(F.count(F.lit(1)).alias("count"))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, DEFENSE_ORDER)), F.col("type")), F.lit(0))
    base = participants.select("fight_id", "name", (F.col("inbound_melee_count") + F.col("inbound_miss_count") - F.col("inbound_strike_count")).alias("_base"))
    before = Window.partitionBy("fight_id", "name").orderBy(place, "type").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(base, ["fight_id", "name"]).withColumn("attempts", F.col("_base") - F.coalesce(F.sum("count").over(before), F.lit(0))).drop("_base")


def strike_prone(rows: DataFrame, participants: DataFrame) -> DataFrame:
    """Inbound misses that a strikethrough could have passed."""
    missed = rows.where((F.col("kind") == "miss") & F.col("type").isin("miss", "invul", "rune")).groupBy("fight_id", F.col("target").alias("name")).agg(F.count(F.lit(1)).alias("_n"))
    joined = participants.join(missed, ["fight_id", "name"], "left")
    return joined.select("fight_id", "name", (F.col("inbound_miss_count") - F.coalesce("_n", F.lit(0))).alias("strike_prone_count"))


def death_rollup(deaths: DataFrame) -> DataFrame:
    return deaths.groupBy("fight_id", F.col("died").alias("name")).agg(F.count(F.lit(1)).alias("death_count"))


def trash(duration: Column, hits: Column, hp: Column) -> Column:
    """Whether a fight is too short, has too few hits on its foe or too few hit points."""
    return (duration < 10) | (hits < 5) | (hp < 1000)


def ordered_children(table: DataFrame, by: str, then: str | None = None, within: tuple[str, ...] = ("fight_id", "name")) -> DataFrame:
    """Adds ``place``: a child row's number by its sum, larger ones first, ties by ``then``."""
    order = [F.col(by).desc(), *([F.col(then)] if then else [])]
    return table.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def merge_pets(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows with what a pet deals credited to its owner under ``pet:`` labels, before any sum; what it takes stays its own.

    ``owners`` has (log_id, name, owner). Heals and strikes of a pet stay with it,
    so a strikethrough tag goes from the credited row.
    """
    own = owners.select(F.col("log_id").alias("_l"), F.col("name").alias("_n"), F.col("owner").alias("_owner"))
    joined = rows.join(own, (F.col("log_id") == F.col("_l")) & (F.col("source") == F.col("_n")), "left")
    pet = F.col("_owner").isNotNull() & F.col("kind").isin("hit", "miss")
    mods = F.when(pet, F.array_remove("mods", "Strikethrough")).otherwise(F.col("mods"))
    label = F.when(pet & (F.col("kind") == "hit"), F.concat(F.lit("pet:"), attack_label(F.col("type"), F.coalesce(F.col("mods"), F.array().cast(_EMPTY))))).otherwise(F.col("type"))
    plain = F.when(pet & (F.col("kind") == "hit"), F.filter(mods, lambda m: m.isin("Critical", "Twincast", "Lucky"))).otherwise(mods)
    spell = F.when(pet & F.col("spell").isNotNull(), F.concat(F.lit("pet:"), F.col("spell"))).otherwise(F.col("spell"))
    return joined.withColumns({"type": label, "spell": spell, "mods": plain, "source": F.when(pet, F.col("_owner")).otherwise(F.col("source"))}).drop("_l", "_n", "_owner")
