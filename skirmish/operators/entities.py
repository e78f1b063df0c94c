"""Who is friend or foe, a player, of which class, and whose pet: from weak evidence.

Most rules are columns: each event gives evidence rows about a name. Only the foe
of a pair depends on all before it and changes both names, so it is a fold, in
order, over narrow rows, with one small record a name; chunks of a log are folded
apart and again where what they were given was wrong. Rosters come in as who events
(``rosters.as_who_events``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skirmish.functions.text import is_pet_name, pet_owner, unlikely_click
from skirmish.operators.ordered import CHUNK, CHUNK_ROWS, last_known, stored_in_chunks
from skirmish.sources.spells import is_pet_target
from skirmish.sources.store import arrow_schema, stored

FRIEND, FOE, UNKNOWN = "Friend", "Foe", "Unknown"
PET_EMOTE_SECONDS = 5
_TOLD = ("log_id", "seq", "name", "type", "is_player", "owner", "class", "level", "foe", "ts", "changed")
_LEADER = r"^My leader is (\w+)\.$"
# What pets tell their master.
_MASTER = r"^(?:Attacking .+? Master|Sorry, Master\.\.\. calming down|Following you, Master|By your command, master|I live again\.\.)\.$"
_NOT_HOSTILE = ("regards you indifferently", "judges you amiably")


def entity_evidence(events: DataFrame, spells: DataFrame | None = None) -> DataFrame:
    """(log_id, seq, turn, ts, name, type, is_player, clears_owner, owner, class, level): what each event tells about a name.

    Nulls tell nothing. A type of ``pet-friend`` only holds for names that are no players.
    What a line tells comes in turns: that the log's owner is a player before all else.
    """
    kind = F.col("kind")
    e = events
    if spells is not None:
        dim = spells.select(F.col("name").alias("_spell"), F.when(F.col("class_count") == 1, F.col("classes")).alias("_class"), "duration_ticks", is_pet_target(F.col("target")).alias("_pet"))
        e = e.join(dim, F.col("spell") == F.col("_spell"), "left")
    else:
        e = e.withColumns({"_class": F.lit(None).cast("string"), "duration_ticks": F.lit(0), "_pet": F.lit(None).cast("boolean")})
    no = F.lit(None)

    def row(when: Column, name: str | Column, type: Column | str | None = None, player=False, clears=False, owner: Column | None = None, cls: Column | None = None, level: Column | None = None) -> Column:  # noqa: A002
        of = F.col(name) if isinstance(name, str) else name
        given = F.lit(type) if isinstance(type, str) or type is None else type
        return F.when(
            when & of.isNotNull(),
            F.struct(
                of.alias("name"),
                given.cast("string").alias("type"),
                (F.lit(player) if isinstance(player, bool) else player).alias("is_player"),
                F.lit(clears).alias("clears_owner"),
                (no if owner is None else owner).cast("string").alias("owner"),
                (no if cls is None else cls).cast("string").alias("class"),
                (no if level is None else level).cast("int").alias("level"),
            ),
        )

    chat = (kind == "chat") & ~F.col("source").contains(".")
    public = F.col("channel").isin("tell", "shout", "say")
    leader = F.regexp_extract("message", _LEADER, 1)
    single = F.col("_class").isNotNull()
    sure = unlikely_click(F.col("spell"), F.col("duration_ticks"))
    cast, hit, heal = kind == "casting", kind == "hit", kind == "heal"
    disc, song = F.col("type") == "Disc", F.col("type") == "Song"
    verb_class = F.when(F.col("type") == "backstab", "ROG").when(F.col("type") == "frenzy", "BER").when((F.col("type") == "shoot") & F.array_contains("mods", "Double_Bow_Shot"), "RNG")
    rows = [
        row(kind == "who", "name", FRIEND, True, True, cls=F.col("class"), level=F.when(F.col("level") > 0, F.col("level"))),
        row(kind == "consider", "name", F.when(~F.col("faction").isin(*_NOT_HOSTILE), FOE), level=F.when(F.col("level") > 0, F.col("level"))),
        row(kind == "party", "name", FRIEND, True, True),
        row(chat & ~public, "source", FRIEND, True),
        row(chat & public & is_pet_name(F.col("source")), "source", FRIEND),
        row(chat & (leader != ""), "source", "pet-friend", owner=leader),
        row(chat & F.col("message").rlike(_MASTER), "source", "pet-friend", owner=F.col("owner")),
        row(heal & F.coalesce("_pet", F.lit(False)) & (F.col("source") != F.col("target")), "target", owner=F.col("source")),
        row(kind == "taunt", "source", FRIEND),
        row(kind == "taunt", "target", FOE),
        row(kind == "loot", "name", FRIEND, True),
        row(cast & disc, "source", FRIEND, True),
        row(cast & song, "source", cls=F.lit("BRD")),
        row(cast & single & (disc | song | sure), "source", cls=F.col("_class")),
        row(hit & verb_class.isNotNull(), "source", cls=verb_class),
        row(hit & single & sure, "source", cls=F.col("_class")),
        row(hit & F.coalesce("_pet", F.lit(False)), "target", owner=F.col("source")),
        row(kind == "shield", "source", cls=F.lit("WAR")),
    ]
    told = F.filter(F.array(*rows), lambda r: r.isNotNull())
    spread = e.select("log_id", "seq", "ts", F.posexplode(told).alias("turn", "r")).select("log_id", "seq", "turn", "ts", "r.*")
    owners = events.groupBy("log_id").agg(F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts"), F.max("owner").alias("name")).where(F.col("name").isNotNull())
    opened = owners.select("log_id", "seq", F.lit(-1).alias("turn"), "ts", "name", F.lit(FRIEND).alias("type"), F.lit(True).alias("is_player"), F.lit(False).alias("clears_owner"), no.cast("string").alias("owner"), no.cast("string").alias("class"), no.cast("int").alias("level"))
    return opened.unionByName(spread)


def pet_emotes(events: DataFrame, spells: DataFrame, within: int = PET_EMOTE_SECONDS) -> DataFrame:
    """(log_id, seq, name, owner): a pet's spell was cast, and within seconds a line ends with its landing text.

    Casts and lines meet per log and window of seconds; a line takes the first cast, a cast the first line.
    """
    texts = spells.where(F.col("land_pet").isNotNull()).select(F.col("name").alias("spell"), "land_pet")
    slot = F.floor(F.unix_timestamp("ts") / within)
    casts = events.where(F.col("kind") == "casting").join(texts, "spell").select("log_id", F.col("seq").alias("c_seq"), F.col("ts").alias("c_ts"), F.col("source").alias("owner"), "land_pet", F.explode(F.array(slot, slot + 1)).alias("_b"))
    lines = events.where(F.col("kind") == "raw").select("log_id", "seq", "ts", "text", slot.alias("_b"))
    met = lines.join(casts, ["log_id", "_b"]).where((F.col("seq") > F.col("c_seq")) & (F.unix_timestamp("ts") - F.unix_timestamp("c_ts") <= within) & F.col("text").endswith(F.col("land_pet")))
    met = met.withColumn("_l", F.row_number().over(Window.partitionBy("log_id", "seq").orderBy("c_seq"))).where("_l = 1")
    met = met.withColumn("_c", F.row_number().over(Window.partitionBy("log_id", "c_seq").orderBy("seq"))).where("_c = 1")
    return met.select("log_id", "seq", F.substring(F.col("text"), F.lit(1), F.length("text") - F.length("land_pet")).alias("name"), "owner")


_STATE = "type string, is_player boolean, owner string, cls string, level int, aggro long, hints string, told boolean"
_FOLDED = f"log_id string, chunk int, seq long, name string, type string, is_player boolean, owner string, class string, level int, foe string, ts long, changed boolean, left struct<{_STATE}>"
_ROW = ("log_id", "chunk", "seq", "ts", "step", "turn", "a", "b", "type", "is_player", "clears_owner", "owner", "cls", "level", "hint", "a_owner", "b_owner", "a_pet", "b_pet")
SEED, EVIDENCE, SWING, HEAL, DEATH = -1, 0, 1, 2, 3
#: After all that :func:`entity_evidence` tells of a line; a line tells one thing at most by then, a landing text or a class.
_LAST_TURN = 1 << 10


class _Known:
    """What is known of one name."""

    __slots__ = ("aggro", "cls", "hints", "level", "owner", "player", "told", "type")

    def __init__(self, owner: str | None):
        self.type, self.player, self.owner, self.cls, self.level, self.aggro = UNKNOWN, False, owner, None, None, None
        self.hints: dict[str, int] = {}  # one entry a class at most
        self.told = False

    @classmethod
    def read(cls, kept: dict) -> _Known:
        k = cls(kept["owner"])
        k.type, k.player, k.cls, k.level, k.aggro, k.told = kept["type"], kept["is_player"], kept["cls"], kept["level"], kept["aggro"], kept["told"]
        k.hints = json.loads(kept["hints"])
        return k

    def kept(self) -> dict:
        return {"type": self.type, "is_player": self.player, "owner": self.owner, "cls": self.cls, "level": self.level, "aggro": self.aggro, "hints": json.dumps(self.hints), "told": self.told}

    def state(self) -> tuple:
        return self.type, self.player, self.owner, self.cls or max(self.hints, key=self.hints.__getitem__, default=None), self.level


def _decide(a: _Known, b: _Known, a_pet: bool, b_pet: bool) -> int:
    """Which of two fighters is the foe: 1 the first, 2 the second, 0 unknown."""
    if a.type == b.type and a.type != UNKNOWN:
        newer = (a.aggro or 0) - (b.aggro or 0)
        if (b.player and not a.player) or newer > 0:
            return 1
        return 2 if (a.player and not b.player) or newer < 0 else 0
    if FRIEND == a.type or FOE == b.type:
        return 2
    if FOE == a.type or FRIEND == b.type:
        return 1
    return 0 if a_pet == b_pet else 2 if a_pet else 1


class _Fold:
    """The fold over one chunk of a log: what is known of each name, and what it tells.

    A line can tell of a name more than once; one row is left of it, with what is known after.
    """

    def __init__(self, log_id: str, chunk: int):
        self.key, self.known, self.out = (log_id, chunk), {}, []
        self.line: tuple | None = None  # seq and time of the line
        self.told: dict[str, tuple] = {}  # by name: the foe, and whether the state changed

    def of(self, name: str, owner: str | None) -> _Known:
        k = self.known.get(name)
        if k is None:
            k = self.known[name] = _Known(owner)
        return k

    def tell(self, name: str, k: _Known, before: tuple | None, foe: str | None = None, always: bool = False) -> None:
        """The state is told if it is not what was told last; between two tellings it does not change."""
        changed = always or not k.told or k.state() != before
        if changed or foe:
            also, had = self.told.get(name, (None, False))
            self.told[name] = (foe or also, changed or had)
        k.told = True

    def end_line(self) -> None:
        for name, (foe, changed) in self.told.items():
            self.out.append((*self.key, self.line[0], name, *self.known[name].state(), foe, self.line[1], changed, None))
        self.told = {}

    def take(self, r: tuple) -> None:
        _, _, _, micros, step, _, a, b, type_, player, clears, owner, cls, level, hint, a_owner, b_owner, a_pet, b_pet = r
        if self.line is None or r[2] != self.line[0]:
            self.end_line()
            self.line = (r[2], micros)
        k = self.of(a, a_owner)
        if step == SWING:
            other = self.of(b, b_owner)
            if other.player:
                k.aggro = micros // 1_000_000
            foe = 0 if a == b or k.owner == b or other.owner == a or (k.player and other.player) else _decide(k, other, a_pet, b_pet)
            if not foe:
                if not k.told:
                    self.tell(a, k, None)
                return
            mine, its = k.state(), other.state()
            k.type, other.type = (FOE, FRIEND) if foe == 1 else (FRIEND, FOE)
            self.tell(b, other, its)
            self.tell(a, k, mine, a if foe == 1 else b)
        elif step == EVIDENCE:
            if type_ == "pet-friend":
                if not k.player:
                    k.type, k.owner = FRIEND, owner
            else:
                k.type = type_ or k.type
                k.owner = owner if owner is not None and not k.player and k.owner is None else k.owner
            k.player = k.player or bool(player)
            k.owner = None if clears else k.owner
            k.cls = cls or k.cls
            k.level = level if level is not None else k.level
            if hint is not None:
                k.hints[hint] = k.hints.get(hint, 0) + 1
            self.tell(a, k, None, always=True)
        elif step == HEAL:
            if b is not None and self.of(b, b_owner).player:
                before, k.type = k.state(), FRIEND
                self.tell(a, k, before)
        else:
            k.aggro = None
            if not k.player:
                before, k.type = k.state(), UNKNOWN
                self.tell(a, k, before)

    def left(self) -> list[tuple]:
        """What is known at the end of the chunk, a row a name that is in it."""
        return [(*self.key, None, name, None, None, None, None, None, None, None, None, k.kept()) for name, k in self.known.items()]


def resolve_foes(events: DataFrame, spells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(foes, changes): the foe of every hit and miss, and the names' states after each event that told of or changed one."""
    return foes_and_changes(fold_entities(events, spells))


def foes_and_changes(folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    return folded.where(F.col("foe").isNotNull()).select("log_id", "seq", "foe"), folded.where("changed").drop("foe", "changed")


def _rows(events: DataFrame, spells: DataFrame | None) -> DataFrame:
    """What the fold takes, in the order of ``_ROW`` but for the chunk."""
    evidence = entity_evidence(events, spells).withColumn("hint", F.lit(None).cast("string"))
    if spells is not None:
        pets = pet_emotes(events, spells)
        told = pets.join(events.select("log_id", "seq", "ts"), ["log_id", "seq"]).withColumn("turn", F.lit(_LAST_TURN))
        evidence = evidence.unionByName(told, allowMissingColumns=True)
        single = spells.where("class_count = 1").select(F.col("name").alias("spell"), F.col("classes").alias("hint"))
        casts = events.where((F.col("kind") == "casting") & F.col("source").isNotNull()).select("log_id", "seq", "ts", F.col("source").alias("name"), "spell")
        evidence = evidence.unionByName(casts.join(single, "spell").drop("spell").withColumn("turn", F.lit(_LAST_TURN)), allowMissingColumns=True)
    facts = evidence.withColumns({"step": F.lit(EVIDENCE), "a": F.col("name")})
    pair = F.col("kind").isin("hit", "miss") & F.col("source").isNotNull() & F.col("target").isNotNull()
    combat = events.where(pair).select("log_id", "seq", "ts", F.lit(SWING).alias("step"), F.col("source").alias("a"), F.col("target").alias("b"))
    heals = events.where((F.col("kind") == "heal") & F.col("source").isNotNull()).select("log_id", "seq", "ts", F.lit(HEAL).alias("step"), F.col("source").alias("a"), F.col("target").alias("b"))
    deaths = events.where(F.col("kind") == "death").select("log_id", "seq", "ts", F.lit(DEATH).alias("step"), F.col("name").alias("a"))
    rows = facts.drop("name").unionByName(combat, True).unionByName(heals, True).unionByName(deaths, True).where(F.col("a").isNotNull())
    pets = {f"{x}_pet": F.coalesce(is_pet_name(F.col(x)), F.lit(False)) for x in "ab"}
    rows = rows.withColumnRenamed("class", "cls").withColumns({"a_owner": pet_owner(F.col("a")), "b_owner": pet_owner(F.col("b")), **pets, "ts": F.unix_micros("ts")})
    return rows.select(*(c for c in _ROW if c != "chunk"))


def _fold(rows: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """One pass over the chunks of ``rows``, each from what ``seeds`` (log_id, chunk, name, seed) knew before it."""
    given = rows.withColumn("seed", F.lit(None).cast(f"struct<{_STATE}>"))
    if seeds is not None:
        given = given.unionByName(seeds.select("log_id", "chunk", F.lit(-1).cast("long").alias("seq"), F.lit(SEED).alias("step"), F.col("name").alias("a"), "seed"), allowMissingColumns=True)
    schema = arrow_schema(_FOLDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold: _Fold | None = None
        for batch in batches:
            out: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fold is None or fold.key != r[:2]:
                    if fold is not None:
                        fold.end_line()
                        out += fold.out + fold.left()
                    fold = _Fold(*r[:2])
                if r[4] == SEED:
                    fold.known[r[6]] = _Known.read(r[-1])
                else:
                    fold.take(r[:-1])
            if fold is not None:
                out += fold.out
                fold.out = []
            yield _batch(out, schema)
        if fold is not None:
            fold.end_line()
            yield _batch(fold.out + fold.left(), schema)

    ordered = given.select(*_ROW, "seed").repartition("log_id", "chunk").sortWithinPartitions("log_id", "chunk", "seq", "step", "turn")
    return ordered.mapInArrow(run, _FOLDED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def fold_entities(events: DataFrame, spells: DataFrame | None = None, size: int = CHUNK_ROWS) -> DataFrame:
    """The rows that :func:`foes_and_changes` tells apart: the fold over who is what, in order, log by log.

    A log is cut into chunks of ``size`` rows, each a task's work with one record a name.
    All chunks are folded at once, as if nothing was known before them; then those for
    which the chunks before left something else than they were given are folded again,
    until there are none. A chunk is right once all before it are, so this ends, and with
    what a fold from the start gives; as most names soon stay what they are, after a few
    passes over few chunks. Where no evidence tells a class, it is that of most casts so far.
    """
    rows, cut = stored_in_chunks(_rows(events, spells), size)
    given = None
    left = stored(_fold(rows, None), "folded")
    while cut:
        states = left.where("left is not null").select("log_id", "chunk", "name", "left")
        before = Window.partitionBy("log_id", "name").orderBy("chunk")
        found = stored(states.withColumn("seed", F.lag("left").over(before)).where("seed is not null").select("log_id", "chunk", "name", "seed"), "seeds")
        if given is None:
            stale = found.select("log_id", "chunk").distinct()
        else:
            other = given.select("log_id", "chunk", "name", F.col("seed").alias("used"))
            stale = found.join(other, ["log_id", "chunk", "name"], "left").where(~F.col("seed").eqNullSafe(F.col("used"))).select("log_id", "chunk").distinct()
        stale = stored(stale, "stale")
        if stale.isEmpty():
            break
        again = _fold(rows.join(stale, ["log_id", "chunk"], "left_semi"), found.join(stale, ["log_id", "chunk"], "left_semi"))
        left, given = stored(left.join(stale, ["log_id", "chunk"], "left_anti").unionByName(again), "folded"), found
    return left.where("left is null").withColumn("ts", F.timestamp_micros("ts")).select(*_TOLD)


def entities_as_of(df: DataFrame, changes: DataFrame, name: str, seq: str) -> DataFrame:
    """Adds type, is_player, pet_owner and class of a name as known at a row's ``seq``; a type falls back to the owner's.

    A name's rows are cut into ranges of its log, so one that is in all of a long log is many tasks.
    """
    state = F.struct("type", "is_player", F.col("owner").alias("pet_owner"), "class")
    marks = changes.select("log_id", F.col("name").alias("_name"), F.col("seq").alias("_seq"), state.alias("_state"))
    rows = df.withColumns({"_name": F.col(name), "_seq": F.col(seq).cast("long"), "_row": F.lit(1)})
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_row", F.coalesce("_row", F.lit(0)))
    named = both.where("_name is not null")
    found = last_known(named, {"_last": F.col("_state")}, F.floor(F.col("_seq") / CHUNK), ("log_id", "_name"), ("_seq", "_row")).where("_row = 1")
    nameless = rows.where("_name is null").withColumn("_last", F.lit(None).cast(found.schema["_last"].dataType))
    found = found.select(*df.columns, "_last").unionByName(nameless.select(*df.columns, "_last"))
    return found.select(*df.columns, F.coalesce("_last.type", F.lit(UNKNOWN)).alias("type_of"), F.coalesce("_last.is_player", F.lit(False)).alias("is_player"), F.col("_last.pet_owner").alias("pet_owner"), F.col("_last.class").alias("class_of"))


def current_entities(changes: DataFrame) -> DataFrame:
    """The last known state of every name of a log; ``updated_on`` is when a class or owner was last told."""
    found = changes.groupBy("log_id", "name").agg(
        F.max_by("type", "seq").alias("type"), F.bool_or("is_player").alias("is_player"), F.max_by("owner", "seq").alias("owner"), F.max_by("class", "seq").alias("class"), F.max_by("level", "seq").alias("level"),
        F.max(F.when(F.col("class").isNotNull() | F.col("owner").isNotNull(), F.col("ts"))).alias("updated_on"),
    )
    owner = found.select(F.col("log_id").alias("_l"), F.col("name").alias("_n"), F.col("type").alias("_t"))
    joined = found.join(owner, (F.col("log_id") == F.col("_l")) & (F.col("owner") == F.col("_n")), "left")
    return joined.withColumn("type", F.when(F.col("type") == UNKNOWN, F.coalesce("_t", "type")).otherwise(F.col("type"))).drop("_l", "_n", "_t")
