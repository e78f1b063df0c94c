"""Merged fights: sums over many fights, on a timeline without the gaps between them.

``membership`` has (merge_id, fight_id); everything else is keyed by fight_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skirmish.operators.ticks import WIDTH

LONG = 3000
WIDE = 600
CROWD = 12
OTHER = "*Other"


def timeline(membership: DataFrame, fights: DataFrame, width: int = WIDTH) -> DataFrame:
    """(merge_id, fight_id, offset): where a fight's first tick lies when covered ticks get consecutive numbers.

    Ticks of overlapping fights are shared and ticks that no fight covers vanish,
    so a tick's number is its dense rank among the covered ones.
    """
    at = lambda c: F.floor(F.unix_timestamp(c) / width)
    spans = membership.join(fights.select("fight_id", "started_on", "updated_on"), "fight_id").withColumns({"head": at("started_on"), "tail": at("updated_on")})
    covered = spans.select("merge_id", F.explode(F.sequence("head", "tail")).alias("at")).distinct()
    numbered = covered.withColumn("n", F.row_number().over(Window.partitionBy("merge_id").orderBy("at")) - 1)
    return spans.join(numbered.withColumnRenamed("at", "head"), ["merge_id", "head"]).select("merge_id", "fight_id", F.col("n").cast("long").alias("offset"))


def merged_series(membership: DataFrame, fights: DataFrame, series: DataFrame) -> DataFrame:
    """Series of the merged fights (fight_id is the merge_id), every fight's ticks moved to its place."""
    moved = series.join(timeline(membership, fights), "fight_id").withColumn("tick", F.col("tick") + F.col("offset"))
    return moved.groupBy(F.col("merge_id").alias("fight_id"), "name", "metric", "tick").agg(F.sum("value").alias("value"))


def shifted_buffs(membership: DataFrame, fights: DataFrame, buffs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Buffs (fight_id, name, spell, time) of fights, at their seconds on the merged timeline: moved by whole ticks, and by where in a tick the fights start."""
    at = membership.join(fights.select("fight_id", F.unix_timestamp("started_on").alias("s")), "fight_id")
    first = at.groupBy("merge_id").agg((F.min("s") % width).alias("lead"))
    moved = buffs.join(timeline(membership, fights, width), "fight_id").join(at.select("fight_id", "merge_id", "s"), ["fight_id", "merge_id"]).join(first, "merge_id")
    time = F.col("time") + F.col("offset") * width + F.col("s") % width - F.col("lead")
    return moved.select(F.col("merge_id").alias("fight_id"), "name", "spell", time.alias("time"))


def targets_as_x(series: DataFrame, fights: DataFrame) -> DataFrame:
    """Series of fights' targets under the name that merged targets have."""
    foes = fights.select("fight_id", F.col("foe").alias("_foe"))
    return series.join(foes, "fight_id").withColumn("name", F.when(F.col("name") == F.col("_foe"), "X").otherwise(F.col("name"))).drop("_foe")


def merged_rollup(membership: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Any child table summed over merged fights; columns ending in ``_max`` take the largest."""
    rest = [c for c, kind in table.dtypes if c not in ("fight_id", *keys) and kind in ("bigint", "int")]
    sums = [(F.max(c) if c.endswith("_max") else F.sum(c)).alias(c) for c in rest if c != "rank_in_fight"]
    return table.join(membership, "fight_id").groupBy(F.col("merge_id").alias("fight_id"), *keys).agg(*sums)


def merged_participants(membership: DataFrame, participants: DataFrame, series: DataFrame) -> DataFrame:
    """Counters summed by name (targets merge into X); the duration is six seconds for every tick in which a name did or took something.

    ``series`` are the merged series, with targets named by :func:`targets_as_x` before they were merged.
    """
    named = participants.withColumn("name", F.when(F.col("is_target"), "X").otherwise(F.col("name")))
    sums = merged_rollup(membership, named.drop("duration"), ["name", "is_target"])
    busy = series.where(F.col("metric").isin("dps", "hps", "tank_dps")).groupBy("fight_id", "name").agg((F.count_distinct("tick") * WIDTH).alias("duration"))
    return sums.join(busy, ["fight_id", "name"], "left").withColumn("duration", F.coalesce("duration", F.lit(0)))


def merged_header(membership: DataFrame, fights: DataFrame) -> DataFrame:
    """Start, end, zone, party, hit points, mob count and notes of merged fights."""
    rows = membership.join(fights, "fight_id")
    zone = F.when(F.count_distinct(F.coalesce("zone", F.lit(""))) > 1, "Multiple Zones").otherwise(F.min("zone"))
    first = F.min_by("party", F.struct("started_on", "start_seq"))
    found = rows.groupBy("merge_id").agg(
        F.min("started_on").alias("started_on"),
        F.max("updated_on").alias("updated_on"),
        zone.alias("zone"),
        F.when(first == "Group", F.when(F.bool_or(F.col("party") == "Raid"), "Raid").otherwise("Group")).otherwise(first).alias("party"),
        F.sum("hp").alias("hp"),
        F.count(F.lit(1)).alias("mob_count"),
    )
    mobs = rows.groupBy("merge_id", "foe").agg(F.count(F.lit(1)).alias("n"), F.sum("hp").alias("foe_hp"))
    notes = mobs.groupBy("merge_id").agg(F.expr("listagg(concat(n, ' x ', foe), ', ') WITHIN GROUP (ORDER BY foe_hp DESC, foe)").alias("mob_notes"))
    named = found.join(notes, "merge_id").withColumn("name", F.concat(F.lit("* "), F.col("mob_count"), F.lit(" combined mobs")))
    return named.withColumns({"status": F.lit("Merged"), "total_duration": F.unix_timestamp("updated_on") - F.unix_timestamp("started_on") + 1}).withColumnRenamed("merge_id", "fight_id")


def merged_duration(header: DataFrame, series: DataFrame) -> DataFrame:
    """Adds ``duration``: the covered ticks up to the last in which the target dealt or took damage, at least 1 second, at most the total."""
    target = series.where((F.col("name") == "X") & F.col("metric").isin("dps", "tank_dps")).groupBy("fight_id").agg(((F.max("tick") + 1) * WIDTH).alias("_d"))
    return header.join(target, "fight_id", "left").withColumn("duration", F.greatest(F.lit(1), F.least(F.coalesce("_d", F.lit(0)), "total_duration"))).drop("_d")


def fit_series(header: DataFrame, series: DataFrame) -> DataFrame:
    """Series of very long merges go, those of long ones get 30-second buckets."""
    known = series.join(header.select("fight_id", "duration"), "fight_id").where(F.col("duration") <= LONG)
    tick = F.when(F.col("duration") > WIDE, F.floor(F.col("tick") / 5)).otherwise(F.col("tick")).cast("long")
    return known.withColumn("tick", tick).groupBy("fight_id", "name", "metric", "tick").agg(F.sum("value").alias("value"))


def fold_crowds(participants: DataFrame, crowd: int = CROWD, **shares: float) -> DataFrame:
    """:func:`fold_tail` for merged fights of more than ``crowd`` participants; those of others stay as they are."""
    kept = ["fight_id", "name", "outbound_hit_sum", "inbound_melee_sum", "outbound_heal_sum"]
    counted = participants.withColumn("_n", F.sum(F.when(F.col("is_target"), 0).otherwise(1)).over(Window.partitionBy("fight_id")))
    many = counted.where((F.col("_n") > crowd) & ~F.col("is_target"))
    return fold_tail(many, **shares).unionByName(counted.where((F.col("_n") <= crowd) | F.col("is_target")).select(*kept))


def unmerged(fights: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Fights that a user may merge: those chosen (fight_id), if any are named, and no merged ones (``mob_count``)."""
    plain = fights.where(F.coalesce("mob_count", F.lit(0)) == 0) if "mob_count" in fights.columns else fights
    return plain if chosen is None else plain.join(chosen.select("fight_id").distinct(), "fight_id", "left_semi")


#: The sums that a fight's tail is told by, and what else goes with each.
TAIL = {"outbound_hit_sum": ("damage", 0.05), "inbound_melee_sum": ("tanking", 0.1), "outbound_heal_sum": ("healing", 0.1)}
#: The part of the tail that a series belongs to.
SERIES_PARTS = {"dps": "damage", "tank_dps": "tanking", "inbound_hps": "tanking", "hps": "healing"}


def tail_names(participants: DataFrame, damage: float = 0.05, tank: float = 0.1, heal: float = 0.1) -> DataFrame:
    """(fight_id, name, part, alias): whose share of the largest is too small, by part: damage, tanking or healing. All become ``*Other``."""
    shares = {"outbound_hit_sum": damage, "inbound_melee_sum": tank, "outbound_heal_sum": heal}
    top = participants.groupBy("fight_id").agg(*[F.max(c).alias(f"_{c}") for c in TAIL])
    parts = F.array(*[F.when(F.col(c) < F.col(f"_{c}") * shares[c], F.lit(part)) for c, (part, _) in TAIL.items()])
    low = participants.join(top, "fight_id").select("fight_id", "name", F.explode(F.array_compact(parts)).alias("part"))
    return low.withColumn("alias", F.lit(OTHER))


def renamed(rows: DataFrame, names: DataFrame, column: str = "name", part: Column | None = None) -> DataFrame:
    """Rows of fights with a name column replaced by its alias, where ``names`` (fight_id, name, alias) has one; of its ``part``, if they come in parts."""
    of = names.select(F.col("fight_id").alias("_of_fight"), F.col("name").alias("_of"), F.col("alias").alias("_alias"), *([F.col("part").alias("_of_part")] if part is not None else []))
    met = (F.col("fight_id") == F.col("_of_fight")) & (F.col(column) == F.col("_of"))
    if part is not None:
        met &= part == F.col("_of_part")
    return rows.join(of, met, "left").withColumn(column, F.coalesce("_alias", column)).select(*rows.columns)


def fold_rows(rows: DataFrame, names: DataFrame, part: str | Column, sums: list[str], most: list[str] | None = None) -> DataFrame:
    """Child rows (attacks, defenses, heals, series) with the tail's under one name: ``sums`` add up, of ``most`` the largest stays, the rest are keys."""
    told = renamed(rows, names, part=F.lit(part) if isinstance(part, str) else part)
    keys = [c for c in rows.columns if c not in sums and c not in (most or [])]
    return told.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most or []]).select(*rows.columns)


def fold_series(series: DataFrame, names: DataFrame) -> DataFrame:
    """Series with the tail's as one of ``*Other``, each metric by its own part."""
    part = F.try_element_at(F.create_map(*[F.lit(x) for kv in SERIES_PARTS.items() for x in kv]), F.col("metric"))
    return fold_rows(series, names, part, ["value"])


def fold_tail(participants: DataFrame, damage: float = 0.05, tank: float = 0.1, heal: float = 0.1) -> DataFrame:
    """Small shares folded into one ``*Other``: damage, tanking and healing each against a share of the largest of the fight.

    Needs fight_id, name, outbound_hit_sum, inbound_melee_sum and outbound_heal_sum;
    returns those, for names with anything left. Child rows follow by :func:`fold_rows`
    and :func:`fold_series` with the same names.
    """
    names = tail_names(participants, damage, tank, heal)
    each = [F.struct(F.lit(part).alias("part"), *[(F.col(c) if c == o else F.lit(0).cast("long")).alias(o) for o in TAIL]) for c, (part, _) in TAIL.items()]
    spread = participants.select("fight_id", "name", F.explode(F.array(*each)).alias("r")).select("fight_id", "name", "r.*")
    rows = renamed(spread, names, part=F.col("part")).groupBy("fight_id", "name").agg(*[F.sum(c).alias(c) for c in TAIL])
    return rows.where((F.col("outbound_hit_sum") > 0) | (F.col("inbound_melee_sum") > 0) | (F.col("outbound_heal_sum") > 0))


def raid_membership(fights: DataFrame, templates: DataFrame, stale_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(membership, raids): fights of raids by template; a raid ends with a killed boss and takes no fight that starts over an hour after it began.

    Fights take part if the party was a raid and zone and mob are the template's.
    They are numbered in the order in which they finish. A fight that starts over an
    hour after the one before cannot belong to its raid, so a log's fights are cut
    there (and after boss kills) first, and only such a run, which no gap of an hour
    interrupts, is folded.
    """
    raid = fights.where(F.col("party") == "Raid").join(templates, (fights.zone == templates.zone) & (fights.foe == templates.mob)).drop(templates.zone, templates.mob)
    order = Window.partitionBy("log_id", "raid").orderBy("updated_on", "end_seq")
    rows = raid.withColumn("ended", F.col("ends_on_death") & (F.col("status") == "Killed")).withColumn("began", F.unix_timestamp("started_on"))
    earlier = F.min("began").over(Window.partitionBy("log_id", "raid").orderBy("updated_on", "end_seq").rowsBetween(-1, -1))
    cut = F.lag("ended").over(order) | (F.col("began") - earlier > stale_seconds)
    rows = rows.withColumn("run", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.array_sort(F.collect_list(F.struct("updated_on", "end_seq", "began", "fight_id")))
    empty = F.struct(F.lit(None).cast("long").alias("since"), F.lit(0).alias("n"), F.array().cast("array<struct<fight_id:string,n:int>>").alias("out"))

    def step(state: Column, fight: Column) -> Column:
        stale = fight["began"] - state["since"] > stale_seconds
        n = F.when(stale, state["n"] + 1).otherwise(state["n"])
        since = F.when(stale | state["since"].isNull(), fight["began"]).otherwise(F.least(state["since"], fight["began"]))
        return F.struct(since.alias("since"), n.alias("n"), F.array_append(state["out"], F.struct(fight["fight_id"].alias("fight_id"), n.alias("n"))).alias("out"))

    runs = rows.groupBy("log_id", "raid", "run").agg(inside.alias("fights"))
    placed = runs.select("log_id", "raid", "run", F.inline(F.aggregate("fights", empty, step, lambda s: s["out"])))
    placed = placed.select("fight_id", F.sha2(F.concat_ws("|", "log_id", "raid", "run", "n"), 256).alias("merge_id"))
    found = rows.join(placed, "fight_id").groupBy("merge_id", "log_id", "raid", "zone").agg(F.count(F.lit(1)).alias("cohort_count"), F.bool_or("ended").alias("finished"))
    return placed.select("merge_id", "fight_id"), found


def boss_terminators(combat: DataFrame, templates: DataFrame) -> DataFrame:
    """Combat rows with a ``forced`` end for every other mob of a raid when its boss dies, so that those fights end with it."""
    bosses = templates.where("ends_on_death").select("raid", F.col("mob").alias("_boss"), F.col("zone").alias("_zone"))
    mobs = templates.select(F.col("raid").alias("_raid"), F.col("mob").alias("_mob"))
    died = (F.col("kind") == "death") & (F.col("party") == "Raid")
    ends = combat.where(died).join(bosses, (F.col("name") == F.col("_boss")) & (F.col("zone") == F.col("_zone"))).join(mobs, F.col("raid") == F.col("_raid")).where("_mob <> _boss")
    forced = ends.withColumn("foe", F.col("_mob")).withColumn("kind", F.lit("forced")).select(*combat.columns)
    return combat.unionByName(forced)


def raid_headers(membership: DataFrame, raids: DataFrame, fights: DataFrame) -> DataFrame:
    """Merged headers of raids: named after their template, in its zone, with the number of their mobs."""
    named = raids.select(F.col("merge_id").alias("fight_id"), F.col("raid").alias("_name"), F.col("zone").alias("_zone"), "cohort_count", "finished")
    return merged_header(membership, fights).join(named, "fight_id").withColumns({"name": F.col("_name"), "zone": F.col("_zone")}).drop("_name", "_zone")


def anonymous_aliases(participants: DataFrame, order: Column, heals: DataFrame | None = None) -> DataFrame:
    """(fight_id, name, alias): Player1, Player2, ... as names come up: a participant, its owner, then those it healed, by ``place``. Targets keep theirs.

    ``heals`` has (fight_id, name, target, place).
    """
    named = participants.withColumn("_o", order)
    owner = F.col("pet_owner") if "pet_owner" in participants.columns else F.lit(None).cast("string")
    said = named.where(~F.col("is_target")).select("fight_id", "_o", F.posexplode(F.array("name", owner)).alias("p", "name")).where("name is not null")
    said = said.select("fight_id", "name", F.struct(F.col("_o").cast("long").alias("o"), F.col("p").alias("p"), F.lit(0).cast("long").alias("place")).alias("at"))
    if heals is not None:
        healers = named.where(~F.col("is_target")).select("fight_id", F.col("name").alias("healer"), "_o")
        healed = heals.select("fight_id", F.col("name").alias("healer"), F.col("target").alias("name"), F.col("place").cast("long").alias("place")).join(healers, ["fight_id", "healer"])
        said = said.unionByName(healed.select("fight_id", "name", F.struct(F.col("_o").cast("long").alias("o"), F.lit(2).alias("p"), "place").alias("at")).where("name is not null"))
    target = participants.where("is_target").select("fight_id", "name")
    first = said.join(target, ["fight_id", "name"], "left_anti").groupBy("fight_id", "name").agg(F.min("at").alias("at"))
    alias = F.concat(F.lit("Player"), F.row_number().over(Window.partitionBy("fight_id").orderBy("at", "name")))
    return first.select("fight_id", "name", alias.alias("alias"))


def anonymize(participants: DataFrame, order: Column, heals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(participants, decoder): names and owners by their aliases. Child tables follow by :func:`renamed` with the decoder, column by column."""
    decoder = anonymous_aliases(participants, order, heals)
    out = renamed(participants, decoder)
    return renamed(out, decoder, "pet_owner") if "pet_owner" in participants.columns else out, decoder
