"""A combat log made of the ``events`` table: every event is a line or more of text.

Two seconds lie between events; actors and foes follow from ids, two foes at a
time. Lines go through the same reader, rules and operators as real logs: who is
friend or foe is inferred. Each log tells its players after three events, so what
was hit before waits for its fight to open. Medics heal players and orphans, orphans
and strays one another: only earlier heals tell which fight these count for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.operators import entities
from skirmish.operators.fights import assign_fights, fight_table, in_fights, pending_hits, with_killshots, with_party, with_zone, without_friends
from skirmish.operators.lines import split_lines
from skirmish.operators.merge import boss_terminators
from skirmish.operators.rules import extract_events, normalize_sources, without_corpses
from skirmish.sources.store import spread, stored_once

OWNER = "Larry"
EVENTS_A_LOG = 2000
#: Places of ``seq`` that an event has.
PLACES = 32
#: Columns that come after extraction.
COMBAT = ("log_id", "seq", "ts", "owner", "server", "kind", "source", "target", "amount", "full_amount", "type", "spell", "mods", "name", "killshot", "status", "channel")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, seq, owner, server, line)."""
    i = F.col("event_id")
    amount = F.floor(F.col("value") * 100).cast("long")
    e = spread(table(spark, sf_dir, "events")).select(
        i,
        F.concat(F.lit("eqlog_Larry_"), F.floor(i / EVENTS_A_LOG)).alias("log_id"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + 2 * i), "EEE MMM dd HH:mm:ss yyyy").alias("stamp"),
        F.concat(F.lit("Player"), F.col("user_id") % 12).alias("actor"),
        F.concat(F.lit("Player"), (F.col("user_id") + 1) % 12).alias("other"),
        F.concat(F.lit("Mob"), (F.floor(i / 50) + F.col("user_id") % 2) % 9).alias("foe"),
        "event_type",
        "value",
        amount.alias("amount"),
    )
    actor, other, foe, n = F.col("actor"), F.col("other"), F.col("foe"), F.col("amount")
    tag = F.when(i % 13 == 0, " (Riposte Strikethrough)").when(i % 11 == 0, " (Strikethrough)").when(i % 7 == 0, " (Critical)").otherwise("")
    kind = F.col("event_type")
    text = (
        F.when((kind == "click") & (i % 5 == 0), F.concat(foe, F.lit(" bites "), actor, F.lit(" for "), n, F.lit(" points of damage."), tag))
        .when(kind == "click", F.concat(actor, F.lit(" slashes "), foe, F.lit(" for "), n, F.lit(" points of damage."), tag))
        .when(kind == "error", F.concat(foe, F.lit(" has taken "), n, F.lit(" damage from Plague Bolt by "), actor, F.lit("."), tag))
        .when((kind == "view") & (i % 2 == 0), F.concat(foe, F.lit(" tries to bite "), actor, F.lit(", but "), actor, F.lit(" dodges!")))
        .when(kind == "view", F.concat(actor, F.lit(" tries to slash "), foe, F.lit(", but misses!")))
        .when(kind == "signup", F.concat(actor, F.when(i % 19 == 0, "`s ward").otherwise(""), F.lit(" healed "), other, F.lit(" for "), F.floor(n / 2), F.lit(" ("), n, F.lit(") hit points by Light Touch.")))
        .when(F.col("value") > 100, F.concat(foe, F.lit(" has been slain by "), actor, F.lit("!")))
        .otherwise(F.concat(foe, F.lit(" is pierced by "), actor, F.lit("'s thorns for "), n, F.lit(" points of non-melee damage.")))
    )
    party = F.element_at(F.array(F.lit("You have joined the raid."), F.lit("You have been removed from the raid."), F.lit("You have been removed from the group.")), (F.floor(i / 211) % 3 + 1).cast("int"))
    gem, late = F.concat(F.lit("Gem"), i % 6), i % EVENTS_A_LOG >= 3

    def more(k: int, when, *said):
        return F.when(when, F.struct(F.lit(k).alias("k"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in said]).alias("text")))

    zoned, looted = i % 97 == 0, late & (i % 41 == 0)
    aside = [
        (actor, " tells the group, 'pull now'"),
        (foe, " - a rare creature - scowls at you, ready to attack -- it appears quite formidable. (Lvl: 44)"),
        ("--2 ", gem, " were left on ", foe, "'s corpse.--"),
        ("You have fashioned the items together to create something new: ", gem, " Ring."),
        ("You gain experience! (1.5%)",),
        ("You have gained 1 ability point(s)!  You now have ", i % 50, " ability point(s)."),
        ("You have improved Tin Ear ", i % 5, " at a cost of ", i % 7, " ability points."),
        ("You have become better at Swimming! (", i % 200, ")"),
        (actor, " begins to use Bulwark as a living shield!"),
        (actor, " has been rescued by divine intervention!"),
        (actor, " has captured ", foe, "'s attention!"),
        (actor, " rolled a ", i % 1000 + 1, " on ", gem, "."),
        ("You receive ", i % 9 + 1, " gold and ", i % 10, " copper as your split."),
        ("Outputfile Complete: list", i, ".txt"),
        (actor, "'s Plague Bolt spell fizzles!"),
        (other, " is cured of Plague Bolt by ", actor, "."),
        ("The crowd counts ", i, " coins."),
    ]
    extra = [
        more(0, F.lit(True), text),
        more(1, i % 61 == 0, actor, " has been slain by ", foe, "!"),
        more(2, zoned, "You have entered Zone", F.floor(i / 97) % 5, "."),
        more(2, ~zoned & looted, "--", actor, " has looted a ", gem, " from ", foe, "'s corpse.--"),
        more(2, late & ~zoned & ~looted & (i % 29 == 0), "[65 Ranger] ", actor, " (Human) ZONE: here"),
        more(3, i % 211 == 0, party),
        more(3, (i % 211 != 0) & (i % 53 == 0), actor, " begins casting Plague Bolt Rk. II."),
        more(4, late & (i % 37 == 0), foe, " has taken 7 damage by Creeping Doom."),
        *[more(5, late & (i % 23 == 0) & (F.floor(i / 23) % len(aside) == k), *said) for k, said in enumerate(aside)],
        more(6, late & (i % 31 == 0), actor, " begins casting Shield of Dew Rk. II."),
        more(7, late & (i % 43 == 0), actor, " glistens."),
        *[more(8 + k, i % EVENTS_A_LOG == 2, f"[65 Ranger] Player{k} (Human) ZONE: here") for k in range(12)],
        more(20, late & (i % 89 == 0), foe, " scowls at you, ready to attack -- it appears quite formidable. (Lvl: 44)"),
        more(21, late & (i % 89 == 0), foe, " has taken ", i % 50 + 1, " damage from Plague Bolt by ", actor, "'s corpse."),
        more(23, late & (i % 47 == 0), "You feel dewy."),
        more(24, late & (i % 59 == 0), "Medic", i % 5, " healed ", actor, " for ", i % 90 + 1, " hit points by Light Touch."),
        more(25, late & (i % 19 == 0), "Medic", i % 5, " healed Orphan", i % 7, " for 3 hit points by Light Touch."),
        more(26, late & (i % 13 == 0), "Orphan", i % 7, " healed Stray", i % 4, " for 2 hit points by Light Touch."),
        more(27, late & (i % 17 == 0), "Stray", i % 4, " healed Orphan", (i + 1) % 7, " for 1 hit points by Light Touch."),
        more(22, late & (i % 83 == 0), actor, " has taken 3 damage from Rot by ", foe, "'s corpse."),
    ]
    said = e.select("log_id", "event_id", "stamp", F.explode(F.filter(F.array(*extra), lambda x: x.isNotNull())).alias("x"))
    broken = (F.col("event_id") % 101 == 0) & (F.col("x.k") == 0)
    line = F.when(broken, F.concat(F.lit("[lost] "), F.col("x.text"))).otherwise(F.concat(F.lit("["), F.col("stamp"), F.lit("] "), F.col("x.text")))
    return said.select("log_id", (F.col("event_id") * PLACES + F.col("x.k")).alias("seq"), F.lit(OWNER).alias("owner"), F.lit("test").alias("server"), line.alias("line"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's events, extracted once a session."""
    return stored_once(table(spark, sf_dir, "events"), "events", lambda: extract_events(split_lines(lines(spark, sf_dir))))


def entity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold over who is friend or foe, stored once a session."""
    return stored_once(table(spark, sf_dir, "events"), "entities", lambda: entities.fold_entities(events(spark, sf_dir)))


def combat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow events with zone, party and the foe that was inferred; deaths have who died as foe. Stored once a session."""

    def make() -> DataFrame:
        found, _ = entities.foes_and_changes(entity_states(spark, sf_dir))
        rows = normalize_sources(events(spark, sf_dir).select(*COMBAT))
        rows = with_party(with_zone(rows)).drop("status", "channel").join(found, ["log_id", "seq"], "left")
        rows = rows.withColumn("foe", F.when(F.col("kind") == "death", F.col("name")).otherwise(F.col("foe")))
        return without_corpses(rows)

    return stored_once(table(spark, sf_dir, "events"), "combat", make)


def assigned(rows: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Rows in fights, with hits from before their foe was known; ``templates`` let a raid's end end its fights."""
    acts = rows.where(F.col("kind").isin("hit", "miss", "death"))
    held = assign_fights(with_killshots(acts if templates is None else boss_terminators(acts, templates)))
    return held.unionByName(pending_hits(acts.where(F.col("kind") == "hit"), held))


class Tables:
    """The tables most queries share, built lazily from one log."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.source = table(spark, sf_dir, "events")
        self.events = combat(spark, sf_dir)
        self.changes = entities.foes_and_changes(entity_states(spark, sf_dir))[1]
        self.assigned = stored_once(self.source, "assigned", lambda: assigned(self.events))
        self.fights = stored_once(self.source, "fights", lambda: without_friends(fight_table(self.assigned), self.changes))
        self.rows = in_fights(self.assigned, self.fights)
