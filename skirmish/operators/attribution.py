"""What counts for which fight: heals, casts and deaths, whose rows name no foe.

Fights here are all that were opened (``opened``: :func:`fights.opened_fights`), those
dropped later too: while they are open they take heals like any other.

A heal goes to the open fight last hit, if a member of it heals or is healed; else to
the oldest open fight with such a member; else, if the healer is a friend, to the
newest. Healer and healed are members from then on, so a heal decides about later
ones. Which fights a heal could go to does not depend on that and is joined once. Who
is a member does, so that is a fold over narrow rows, in order; chunks of a log are
folded at once, and again where the chunks before left other members than was given.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skirmish.functions.text import pet_owner
from skirmish.operators.entities import FRIEND, UNKNOWN, entities_as_of
from skirmish.operators.fights import GROUP_GAP, RAID_GAP, opened_fights
from skirmish.operators.ordered import CHUNK_ROWS, SECONDS, last_known, running_sum, stored_in_chunks
from skirmish.sources.store import arrow_schema, stored

BUCKET = 60


def _seconds(ts: str) -> Column:
    return F.unix_timestamp(ts)


def last_fight(events: DataFrame, assigned: DataFrame, opened: DataFrame, bucket: int = SECONDS) -> DataFrame:
    """Adds ``last_fight``: the fight last hit in the log before a row, null once any fight has been finished since.

    A kill finishes a fight where it stands, idle time a gap after its last row; fights
    that are dropped then are not finished. Logs are cut into ranges of time, and only
    (log_id, seq, ts) of the rows are sorted.
    """
    hits = assigned.where(F.col("kind").isin("hit", "miss") & (F.col("seq") >= F.col("start_seq")))
    hits = hits.select("log_id", _seconds("ts").alias("t"), "seq", F.lit(1).alias("turn"), F.struct(F.col("fight_id").alias("f")).alias("mark"))
    # idle time ends a fight before the first row of that second, a kill after its own
    ends = opened.where("kept").select("log_id", F.col("until").alias("t"), F.when(F.col("killed"), F.col("end_seq")).otherwise(-1).alias("seq"), F.lit(2).alias("turn"), F.struct(F.lit(None).cast("string").alias("f")).alias("mark"))
    asked = events.select("log_id", _seconds("ts").alias("t"), "seq", F.lit(0).alias("turn"), F.lit(None).cast("struct<f:string>").alias("mark"))
    rows = asked.unionByName(hits).unionByName(ends)
    found = last_known(rows, {"last": F.col("mark")}, F.floor(F.col("t") / bucket), order=("t", "seq", "turn")).where("turn = 0")
    return events.join(found.select("log_id", "seq", F.col("last.f").alias("last_fight")), ["log_id", "seq"])


def _members(assigned: DataFrame) -> DataFrame:
    """(log_id, foe, start_seq, member, since): who hit, missed or was hit in a fight, or died by its foe, and from which row on. The foe itself is none."""
    named = F.when(F.col("kind").isin("hit", "miss"), F.array("source", "target")).when(F.col("kind") == "touch", F.array("name"))
    names = assigned.select("log_id", "foe", "start_seq", F.greatest("seq", "start_seq").alias("since"), F.explode(named).alias("member"))
    return names.where("member <> foe")


def casters(casts: DataFrame, assigned: DataFrame, opened: DataFrame, friends: DataFrame) -> DataFrame:
    """(fight_id, member, since): friends (log_id, seq, name) who cast while a fight that was last hit is open."""
    known = friends.select("log_id", "seq", F.col("name").alias("source")).distinct()
    placed = last_fight(casts.select("log_id", "seq", "ts", "source"), assigned, opened).where("last_fight is not null").join(known, ["log_id", "seq", "source"], "left_semi")
    held = placed.join(opened.select(F.col("fight_id").alias("last_fight"), "foe", "start_seq", "end_seq", "until", "killed", "ghost"), "last_fight")
    held = held.where(_open_at(F.col("seq"), _seconds("ts"), ghosts=True) & (F.col("source") != F.col("foe")))
    return held.select(F.col("last_fight").alias("fight_id"), F.col("source").alias("member"), F.col("seq").alias("since"))


def _open_at(seq: Column, t: Column, ghosts: bool = False) -> Column:
    """Whether a fight is open at a row. A ghost timed out without damage: no list has it, but the pointer to the fight last hit keeps it."""
    live = (seq > F.col("start_seq")) & F.when(F.col("killed"), seq < F.col("end_seq")).otherwise(t < F.col("until"))
    return live | (F.col("ghost") & (seq > F.col("start_seq"))) if ghosts else live


def _choices(heals: DataFrame, assigned: DataFrame, opened: DataFrame, friends: DataFrame | None) -> DataFrame:
    """(log_id, seq, source, target, foe, start_seq, is_last, listed, friend): every open fight for every heal, by log and minute."""
    asked = last_fight(heals.select("log_id", "seq", "ts", "source", "target"), assigned, opened)
    if friends is None:
        asked = asked.withColumn("friend", F.lit(False))
    else:
        keys = ["log_id", "source", *(["seq"] if "seq" in friends.columns else [])]
        asked = asked.join(friends.withColumnRenamed("name", "source").select(*keys).distinct().withColumn("friend", F.lit(True)), keys, "left")
    of = ("fight_id", "log_id", "foe", "start_seq", "end_seq", "until", "killed", "ghost")
    listed = _open_at(F.col("seq"), _seconds("ts"))
    columns = ("log_id", "seq", "source", "target", "foe", "start_seq", "is_last", "listed", "friend")
    first = asked.join(opened.select(*of).withColumnRenamed("log_id", "_log"), F.col("last_fight") == F.col("fight_id"))
    first = first.where(_open_at(F.col("seq"), _seconds("ts"), ghosts=True)).withColumns({"is_last": F.lit(True), "listed": listed}).select(*columns)
    minutes = F.sequence(F.floor(_seconds("started_on") / BUCKET), F.floor(F.col("until") / BUCKET))
    spread = opened.select(*of, F.explode(minutes).alias("b"))
    others = asked.withColumn("b", F.floor(_seconds("ts") / BUCKET)).join(spread, ["log_id", "b"])
    others = others.where(listed & ~F.col("last_fight").eqNullSafe(F.col("fight_id"))).withColumns({"is_last": F.lit(False), "listed": F.lit(True)}).select(*columns)
    return first.unionByName(others)


_PLACED = "log_id string, chunk int, seq long, foe string, start_seq long, left array<string>"
_ROW = ("log_id", "chunk", "seq", "step", "foe", "start_seq", "source", "target", "is_last", "listed", "friend")
SEED, CHOICE, MEMBER = -1, 0, 1


class _Healing:
    """Who is a member of which fights, row by row, and the heals placed by that. A fight is its foe and first row."""

    def __init__(self, log_id: str, chunk: int):
        self.key, self.out = (log_id, chunk), []
        self.members: dict[tuple, set] = {}
        self.heal: tuple | None = None  # seq, source and target of the heal whose choices are read
        self.best: tuple | None = None  # rank and fight

    def take(self, r: tuple) -> None:
        _, _, seq, step, foe, start, source, target, is_last, listed, friend, seed = r
        if self.heal and (step != CHOICE or seq != self.heal[0]):
            self.place()
        known = self.members.setdefault((foe, start), set())
        if step == SEED:
            known.update(seed)
        elif step == MEMBER:
            known.add(source)
        else:
            self.heal = seq, source, target
            if source in known or target in known:
                rank = (1 if is_last else 2, start)
            elif friend and listed:
                rank = (3, -start)
            else:
                return
            if self.best is None or rank < self.best[0]:
                self.best = rank, (foe, start)

    def place(self) -> None:
        """Heals of the foe itself count for nothing and make no member."""
        if self.best and self.heal[2] != self.best[1][0]:
            seq, *names = self.heal
            fight = self.best[1]
            self.out.append((*self.key, seq, *fight, None))
            self.members[fight].update(n for n in names if n is not None and n != fight[0])
        self.heal = self.best = None

    def left(self) -> list[tuple]:
        """The members at the end of the chunk, a row a fight that is in it."""
        return [(*self.key, None, *fight, sorted(names)) for fight, names in self.members.items()]


def _place(rows: DataFrame, seeds: DataFrame | None, cut: bool) -> DataFrame:
    """One pass over the chunks of ``rows``, each from the members that ``seeds`` (log_id, chunk, foe, start_seq, seed) knew before it; with what each leaves, if logs are ``cut``."""
    given = rows.withColumn("seed", F.lit(None).cast("array<string>"))
    if seeds is not None:
        given = given.unionByName(seeds.withColumns({"seq": F.lit(-1).cast("long"), "step": F.lit(SEED)}), allowMissingColumns=True)
    schema = arrow_schema(_PLACED)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold: _Healing | None = None

        def end() -> list[tuple]:
            fold.place()
            return fold.out + (fold.left() if cut else [])

        for rows in batches:
            out: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if fold is None or fold.key != r[:2]:
                    if fold is not None:
                        out += end()
                    fold = _Healing(*r[:2])
                fold.take(r)
            if fold is not None:
                out += fold.out
                fold.out = []
            yield batch(out)
        if fold is not None:
            yield batch(end())

    ordered = given.select(*_ROW, "seed").repartition("log_id", "chunk").sortWithinPartitions("log_id", "chunk", "seq", "step")
    return ordered.mapInArrow(run, _PLACED)


def _placed(rows: DataFrame, size: int) -> DataFrame:
    """(log_id, seq, foe, start_seq): each heal's fight.

    A log is cut into chunks of ``size`` rows, all of which are placed at once as if
    no fight had members before; those that were given other members than the chunks
    before them left are placed again, until there are none.
    """
    rows, cut = stored_in_chunks(rows, size)
    found, given, keys = stored(_place(rows, None, cut), "placed"), None, ["log_id", "chunk", "foe", "start_seq"]
    while cut:
        before = Window.partitionBy("log_id", "foe", "start_seq").orderBy("chunk")
        lefts = found.where("left is not null").select(*keys, F.lag("left").over(before).alias("seed"))
        seeds = stored(lefts.where(F.size("seed") > 0), "seeds")
        used = seeds.limit(0) if given is None else given
        other = seeds.join(used.withColumnRenamed("seed", "used"), keys, "full").where(~F.col("seed").eqNullSafe(F.col("used")))
        stale = stored(other.select("log_id", "chunk").distinct(), "stale")
        if stale.isEmpty():
            break
        again = _place(rows.join(stale, ["log_id", "chunk"], "left_semi"), seeds.join(stale, ["log_id", "chunk"], "left_semi"), cut)
        found, given = stored(found.join(stale, ["log_id", "chunk"], "left_anti").unionByName(again), "placed"), seeds
    return found.where("left is null").select("log_id", "seq", "foe", "start_seq")


def attribute_heals(heals: DataFrame, assigned: DataFrame, fights: DataFrame, friends: DataFrame | None = None, gap: int = GROUP_GAP, raid_gap: int = RAID_GAP, joined_by: DataFrame | None = None, size: int = CHUNK_ROWS) -> DataFrame:
    """Heals with the fight they count for (fight_id, foe, started_on), of those in ``fights``.

    Heals on the foe itself count for nothing. ``friends`` has (log_id, name), or with
    ``seq`` those who are friends at that heal. ``joined_by`` (fight_id, member, since)
    are members by other acts, as casters are.
    """
    opened = opened_fights(assigned, fights, gap, raid_gap)
    fight = ("log_id", "foe", "start_seq")
    told = _members(assigned)
    if joined_by is not None:
        told = told.unionByName(joined_by.join(opened.select("fight_id", *fight), "fight_id").select(*fight, "member", "since"))
    members = told.groupBy(*fight, F.col("member").alias("source")).agg(F.min("since").alias("seq")).withColumn("step", F.lit(MEMBER))
    rows = _choices(heals, assigned, opened, friends).withColumn("step", F.lit(CHOICE)).unionByName(members, allowMissingColumns=True)
    best = _placed(rows.select(*(c for c in _ROW if c != "chunk")), size).join(fights.select("fight_id", *fight, "started_on"), [*fight]).drop("start_seq")
    return heals.drop("foe", "fight_id", "started_on").join(best, ["log_id", "seq"])


def attribute_casts(casts: DataFrame, assigned: DataFrame, fights: DataFrame, friends: DataFrame, gap: int = GROUP_GAP, raid_gap: int = RAID_GAP) -> DataFrame:
    """(fight_id, member, since): who joined a fight by casting; ``friends`` has (log_id, seq, name)."""
    return casters(casts, assigned, opened_fights(assigned, fights, gap, raid_gap), friends)


def friends_at(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """(log_id, seq, name): sources that were friends at their row; of an unknown pet the owner's type counts."""
    who = entities_as_of(rows.select("log_id", "seq", "source"), changes, "source", "seq")
    who = who.select("log_id", "seq", "source", F.col("type_of").alias("own_type"), F.coalesce("pet_owner", pet_owner(F.col("source"))).alias("owner"))
    who = entities_as_of(who, changes, "owner", "seq")
    kind = F.when(F.col("own_type") == UNKNOWN, F.col("type_of")).otherwise(F.col("own_type"))
    return who.where(kind == FRIEND).select("log_id", "seq", F.col("source").alias("name"))


def placed_heals(events: DataFrame, assigned: DataFrame, fights: DataFrame, changes: DataFrame) -> DataFrame:
    """The heals among ``events`` with their fights; friends who cast are members too."""
    healed, casts = (events.where(F.col("kind") == k).drop("foe") for k in ("heal", "casting"))
    friends = stored(friends_at(healed.unionByName(casts), changes), "friends")
    return attribute_heals(healed, assigned, fights, friends, joined_by=attribute_casts(casts, assigned, fights, friends))


def attribute_deaths(deaths: DataFrame, assigned: DataFrame, fights: DataFrame, gap: int = GROUP_GAP, raid_gap: int = RAID_GAP) -> DataFrame:
    """(fight_id, died, since) of others than a fight's foe: they count for the killer's open fight, without a killer for the one last hit."""
    opened = opened_fights(assigned, fights, gap, raid_gap)
    touched = assigned.where(F.col("kind") == "touch").select("log_id", "seq", "fight_id", F.col("name").alias("died"))
    closing = assigned.where((F.col("kind") == "death")).select("log_id", "seq")
    alone = deaths.where(F.col("killshot").isNull()).join(closing, ["log_id", "seq"], "left_anti")
    placed = last_fight(alone, assigned, opened).where(F.col("last_fight").isNotNull()).select("log_id", "seq", "ts", F.col("last_fight").alias("fight_id"), F.col("name").alias("died"))
    held = placed.join(opened.drop("log_id"), "fight_id").where(_open_at(F.col("seq"), _seconds("ts"), ghosts=True)).select("log_id", "seq", "fight_id", "died")
    return touched.unionByName(held).join(fights.select("fight_id"), "fight_id", "left_semi")


def cohorts(assigned: DataFrame, fights: DataFrame, gap: int = GROUP_GAP, raid_gap: int = RAID_GAP, bucket: int = SECONDS) -> DataFrame:
    """``fights`` with ``cohort_count``: other fights of the log that are open when one ends, dropped ones too.

    A kill ends a fight where it stands. Idle time ends it a gap after its last row,
    before anything else of that second; fights that end together count one another.
    """
    opened = opened_fights(assigned, fights, gap, raid_gap)
    start = F.struct(_seconds("started_on").alias("t"), F.lit(1).alias("turn"), F.col("start_seq").alias("at"), F.lit(1).alias("d"), F.lit(None).cast("string").alias("fight_id"))
    end = F.struct(F.col("until").alias("t"), F.when(F.col("killed"), 1).otherwise(0).alias("turn"), F.when(F.col("killed"), F.col("end_seq")).otherwise(-1).alias("at"), F.lit(-1).alias("d"), F.col("fight_id"))
    marks = opened.select("log_id", F.explode(F.array(start, end)).alias("m")).select("log_id", "m.*")
    moments = marks.groupBy("log_id", "t", "turn", "at").agg(F.sum("d").alias("d"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("ended"))
    known = running_sum(moments, F.col("d"), "open", F.floor(F.col("t") / bucket), ("log_id",), ("t", "turn", "at"))
    found = marks.where("fight_id is not null").join(known.select("log_id", "t", "turn", "at", "open", "ended"), ["log_id", "t", "turn", "at"])
    return fights.join(found.select("fight_id", (F.col("open") + F.col("ended") - 1).alias("cohort_count")), "fight_id")
