"""Fights: sessions of combat around one foe, closed by its death or an idle gap.

Combat rows have (log_id, seq, ts, kind, source, target, foe, ...), where kind is
hit, miss or death; a death's foe is who died. All windows are per log and foe, so
logs and foes spread over tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skirmish.operators.entities import FRIEND, entities_as_of
from skirmish.operators.ordered import CHUNK, CHUNK_ROWS, in_chunks, last_known
from skirmish.sources.store import arrow_schema, stored

GROUP_GAP = 15
RAID_GAP = 120
PENDING = 60


def seconds(ts: str | Column) -> Column:
    return F.unix_timestamp(ts)


def with_zone(events: DataFrame, bucket: int = CHUNK) -> DataFrame:
    """Adds ``zone``: the last zone entered in the log."""
    return last_known(events, {"zone": F.when(F.col("kind") == "zone", F.col("name"))}, bucket)


def with_party(events: DataFrame, bucket: int = CHUNK) -> DataFrame:
    """Adds ``party`` (Solo, Group, Raid or null before any sign of it).

    Experience, raid messages and leaving a raid set it. Leaving a group and group
    chat only move between Group and Solo; as each of them ends in the same state
    from either, the last of them after the last setting decides.
    """
    kind, own = F.col("kind"), F.col("name") == F.col("owner")
    fixed = (
        F.when((kind == "xp") & (F.col("type") == "RaidXP"), "Raid")
        .when((kind == "xp") & (F.col("type") == "GroupXP"), "Group")
        .when((kind == "xp") & (F.col("type") == "SoloXP"), "Solo")
        .when((kind == "party") & (F.col("status") == "RaidJoined"), "Raid")
        .when((kind == "party") & (F.col("status") == "RaidLeft") & own, "Group")
        .when((kind == "chat") & (F.col("channel") == "raid"), "Raid")
    )
    moved = F.when((kind == "party") & (F.col("status") == "GroupLeft") & own, "Solo").when((kind == "chat") & (F.col("channel") == "group"), "Group")

    def mark(party: Column) -> Column:
        return F.when(party.isNotNull(), F.struct(F.col("seq").alias("at"), party.alias("p")))

    out = last_known(events, {"_set": mark(fixed), "_move": mark(moved)}, bucket)
    party = F.when((F.col("_move.at") > F.col("_set.at")) & F.col("_set.p").isin("Solo", "Group"), F.col("_move.p")).otherwise(F.col("_set.p"))
    return out.withColumn("party", party).drop("_set", "_move")


def with_killshots(combat: DataFrame) -> DataFrame:
    """Adds a ``touch`` row for the killer of every death: a foe's kill keeps its own fight open."""
    touch = combat.where((F.col("kind") == "death") & F.col("killshot").isNotNull()).withColumn("foe", F.col("killshot")).withColumn("kind", F.lit("touch"))
    return combat.unionByName(touch)


def fight_key(log_id: Column, foe: Column, start: Column) -> Column:
    return F.sha2(F.concat_ws("|", log_id, foe, start.cast("string")), 256)


def assign_fights(combat: DataFrame, group_gap: int = GROUP_GAP, raid_gap: int = RAID_GAP) -> DataFrame:
    """Combat rows with ``fight_id`` and ``start_seq``; rows outside any fight go.

    A fight opens with a hit or miss that has a source, and holds until its foe dies
    or nothing happens for the gap (that of a raid where ``party`` is Raid). Deaths and touch
    rows keep a fight open but open none; a ``forced`` row ends it without more. Every idle time at or over the gap
    closes a fight at once, whenever the log goes on.
    """
    foe = Window.partitionBy("log_id", "foe").orderBy("seq", F.col("kind") == "forced")
    gap = F.lit(group_gap) if "party" not in combat.columns else F.when(F.col("party") == "Raid", raid_gap).otherwise(group_gap)
    idle = seconds("ts") - seconds(F.lag("ts").over(foe))
    rows = combat.where(F.col("foe").isNotNull() & ~(F.col("kind").isin("hit", "miss") & F.col("source").isNull()))
    rows = rows.withColumn("_new", F.coalesce(F.lag("kind").over(foe).isin("death", "forced") | (idle >= gap), F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(foe.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("log_id", "foe", "_run")
    rows = rows.withColumn("start_seq", F.min(F.when(F.col("kind").isin("hit", "miss"), F.col("seq"))).over(run))
    rows = rows.where((F.col("seq") >= F.col("start_seq")) & (F.col("kind") != "forced")).drop("_new", "_run")
    return rows.withColumn("fight_id", fight_key(F.col("log_id"), F.col("foe"), F.col("start_seq")))


def _sessions(assigned: DataFrame) -> DataFrame:
    """One row a fight that was opened; ``kept`` where it counts."""
    killed = (F.col("kind") == "death") & (F.col("name") == F.col("foe"))
    own = F.when(F.col("seq") >= F.col("start_seq"), F.col("seq"))
    landed = (F.col("kind") == "hit") & (F.col("amount") > 0)
    extra = [F.min_by(c, own).alias(c) for c in ("zone",) if c in assigned.columns] + [F.coalesce(F.max_by(c, own), F.lit("Solo")).alias(c) for c in ("party",) if c in assigned.columns]
    fights = assigned.groupBy("fight_id", "log_id", "foe", "start_seq").agg(
        F.min_by("ts", own).alias("started_on"),
        F.max_by("ts", own).alias("updated_on"),
        F.max("seq").alias("end_seq"),
        F.when(F.bool_or(killed), "Killed").otherwise("Timeout").alias("status"),
        F.coalesce(F.sum(F.when((F.col("kind") == "hit") & (F.col("target") == F.col("foe")), F.col("amount"))), F.lit(0)).alias("hp"),
        F.coalesce(F.bool_or(landed & ((F.col("source") != F.col("foe")) | (F.col("target") != F.col("foe")))), F.lit(False)).alias("_anyone"),
        *extra,
    )
    return fights.withColumn("kept", ((F.col("status") == "Killed") | (F.col("hp") > 0)) & F.col("_anyone")).drop("_anyone")


def fight_table(assigned: DataFrame) -> DataFrame:
    """One row a fight. Those that only timed out without damage to the foe are discarded, and those in which nobody dealt or took any.

    Pending hits (before ``start_seq``) count for the foe's hit points, not for the times.
    """
    fights = _sessions(assigned).where("kept").drop("kept")
    return fights.withColumn("duration", (seconds("updated_on") - seconds("started_on") + 1).cast("long"))


def opened_fights(assigned: DataFrame, fights: DataFrame, gap: int = GROUP_GAP, raid_gap: int = RAID_GAP) -> DataFrame:
    """(fight_id, log_id, foe, start_seq, started_on, end_seq, until, killed, kept, ghost) of every fight that was opened.

    ``until`` is the second at which a kill or the gap ended it; ``kept`` are those of
    ``fights``. A ghost timed out without damage: it is dropped, and never finished.
    """
    every = _sessions(assigned).drop("kept").join(fights.select("fight_id", F.lit(True).alias("kept")), "fight_id", "left")
    idle = F.when(F.col("party") == "Raid", raid_gap).otherwise(gap) if "party" in every.columns else F.lit(gap)
    killed = F.col("status") == "Killed"
    return every.select(
        "fight_id", "log_id", "foe", "start_seq", "started_on", "end_seq", (seconds("updated_on") + F.when(killed, 0).otherwise(idle)).alias("until"),
        killed.alias("killed"), F.coalesce("kept", F.lit(False)).alias("kept"), (~killed & (F.col("hp") <= 0)).alias("ghost"),
    )


def without_friends(fights: DataFrame, changes: DataFrame) -> DataFrame:
    """Fights whose foe was no friend when they ended: players and pets fight before it is known what they are."""
    known = entities_as_of(fights.select("fight_id", "log_id", "foe", "end_seq"), changes, "foe", "end_seq")
    return fights.join(known.where(F.col("type_of") == FRIEND).select("fight_id"), "fight_id", "left_anti")


def with_finish_state(participants: DataFrame, fights: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds each participant's ``class`` and ``pet_owner`` as known when its fight ended."""
    ended = participants.join(fights.select("fight_id", "log_id", F.col("end_seq").alias("_end")), "fight_id")
    known = entities_as_of(ended, changes, "name", "_end")
    return known.select(*participants.columns, F.col("class_of").alias("class"), "pet_owner")


def in_fights(assigned: DataFrame, fights: DataFrame) -> DataFrame:
    """The rows of fights that were kept, with the fight's start and duration."""
    return assigned.join(fights.select("fight_id", "started_on", F.col("duration").alias("fight_duration")), "fight_id")


def pending_hits(hits: DataFrame, assigned: DataFrame, within: int = PENDING) -> DataFrame:
    """Hits without a known foe that name one whose fight starts within a minute, as rows of that fight: they count from its first tick.

    Names and minutes make an equi-join of it; the seconds are checked after.
    """
    named = hits.where(F.col("foe").isNull() & F.col("source").isNotNull() & (F.col("source") != F.col("target")))
    named = named.drop("foe").withColumn("foe", F.explode(F.array("source", "target"))).withColumn("_b", F.explode(F.array(*[F.floor(seconds("ts") / within) + k for k in (0, 1)])))
    opened = assigned.groupBy("log_id", "foe", "fight_id", "start_seq").agg(F.min_by("ts", "seq").alias("_on"))
    opened = opened.withColumn("_b", F.floor(seconds("_on") / within))
    joined = named.join(opened, ["log_id", "foe", "_b"]).where((F.col("seq") < F.col("start_seq")) & (seconds("_on") - seconds("ts") <= within))
    first = Window.partitionBy("log_id", "foe", "seq").orderBy("start_seq")
    return joined.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_b", "_on")


_EXACT = "log_id string, chunk int, seq long, foe string, start_seq long, role string, left string"
_ROLE = ("log_id", "seq", "foe", "start_seq", "role")


class _Replay:
    """The open fights of one log event by event, with timeouts looked at every few seconds only."""

    def __init__(self, group_gap: int, raid_gap: int, every: int, left: str | None = None):
        self.gaps, self.every = (group_gap, raid_gap), every
        # foe -> [start_seq, last second], and when timeouts were looked at last
        self.live, self.checked = json.loads(left) if left else ({}, None)

    def left(self) -> str:
        return json.dumps([self.live, self.checked])

    def take(self, seq: int, t: int, kind: str, foe: str | None, killshot: str | None, party: str | None) -> tuple | None:
        live = self.live
        if self.checked is None or t - self.checked >= self.every or self.checked > t:
            gap = self.gaps[party == "Raid"]
            for old in [f for f, (_, at) in live.items() if at + gap <= t]:
                del live[old]
            self.checked = t
        if kind in ("hit", "miss") and foe is not None:
            fight = live.setdefault(foe, [seq, t])
            fight[1] = t
            return seq, foe, fight[0], kind
        if kind == "death":
            if foe in live:
                return seq, foe, live.pop(foe)[0], "death"
            if killshot in live:
                live[killshot][1] = t
                return seq, killshot, live[killshot][0], "touch"
        return None


def _replayed(rows: DataFrame, seeds: DataFrame | None, gaps: tuple[int, int, int]) -> DataFrame:
    """One pass over the chunks of ``rows``, each from the fights that ``seeds`` (log_id, chunk, seed) left open before it."""
    given = rows.withColumn("seed", F.lit(None).cast("string"))
    if seeds is not None:
        given = given.unionByName(seeds.select("log_id", "chunk", F.lit(-1).cast("long").alias("seq"), "seed"), allowMissingColumns=True)
    schema = arrow_schema(_EXACT)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, replay = None, None
        for rows in batches:
            found: list[tuple] = []
            for log_id, chunk, seq, *event, seed in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if (log_id, chunk) != key:
                    if replay is not None:
                        found.append((*key, None, None, None, None, replay.left()))
                    key, replay = (log_id, chunk), _Replay(*gaps, seed)
                    if seed is not None:
                        continue
                row = replay.take(seq, *event)
                if row:
                    found.append((*key, *row, None))
            yield batch(found)
        if replay is not None:
            yield batch([(*key, None, None, None, None, replay.left())])

    ordered = given.select("log_id", "chunk", "seq", "t", "kind", "foe", "killshot", "party", "seed")
    return ordered.repartition("log_id", "chunk").sortWithinPartitions("log_id", "chunk", "seq").mapInArrow(run, _EXACT)


def assign_fights_exact(events: DataFrame, group_gap: int = GROUP_GAP, raid_gap: int = RAID_GAP, every: int = 5, size: int = CHUNK_ROWS) -> DataFrame:
    """(log_id, seq, foe, start_seq, role, fight_id) with timeouts checked as a live reader does: at most every 5 s, on any event.

    A fight idle for a little longer than the gap can go on if no event came to
    check it, so a row depends on all before it. A log is cut into chunks of ``size``
    rows, all of which are replayed at once as if no fight was open; a chunk is
    replayed again if the one before it left other fights open than it was given,
    until none is. Open fights hand over at once or soon, so that is a pass or two.
    """
    party = F.col("party") if "party" in events.columns else F.lit(None).cast("string")
    narrow = events.select("log_id", "seq", seconds("ts").alias("t"), "kind", "foe", "killshot", party.alias("party"))
    rows = stored(in_chunks(narrow, size), "chunked")
    found, given = stored(_replayed(rows, None, (group_gap, raid_gap, every)), "replayed"), None
    cut = not rows.where("chunk > 0").isEmpty()
    while cut:
        before = found.where("left is not null").select("log_id", (F.col("chunk") + 1).alias("chunk"), F.col("left").alias("seed"))
        seeds = stored(before.join(rows.select("log_id", "chunk").distinct(), ["log_id", "chunk"], "left_semi"), "seeds")
        used = seeds.withColumn("used", F.lit(None).cast("string")).select("log_id", "chunk", "used") if given is None else given.withColumnRenamed("seed", "used")
        stale = stored(seeds.join(used, ["log_id", "chunk"]).where(~F.col("seed").eqNullSafe(F.col("used"))).select("log_id", "chunk"), "stale")
        if stale.isEmpty():
            break
        again = _replayed(rows.join(stale, ["log_id", "chunk"], "left_semi"), seeds.join(stale, ["log_id", "chunk"], "left_semi"), (group_gap, raid_gap, every))
        found, given = stored(found.join(stale, ["log_id", "chunk"], "left_anti").unionByName(again), "replayed"), seeds
    return found.where("left is null").select(*_ROLE).withColumn("fight_id", fight_key(F.col("log_id"), F.col("foe"), F.col("start_seq")))
