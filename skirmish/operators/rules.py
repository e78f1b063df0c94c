"""Typed events from texts: one table of rules, first match wins.

A rule has a kind and forms; a form is one message of the game as a template (see
``messages``) with what fills columns beside its slots: its pattern, a cue (a text that
every such message holds) and columns made of its groups. One automaton over all cues
tells which few patterns a line can match (see ``dispatch``). The number of the first
that does, and its groups, come back as columns; all others are column functions of
these, and forms that fill a column alike share a branch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions.text import class_code, empty_to_null, fix_name, parse_mods
from skirmish.operators.dispatch import Pattern, with_first_match
from skirmish.operators.messages import FRENZY, compile_template

#: Columns of every event beside log_id, seq, owner, server, ts, kind, text.
FAMILY_COLUMNS = {
    "source": "string", "target": "string", "amount": "long", "full_amount": "long", "type": "string", "spell": "string", "mods": "array<string>",
    "name": "string", "killshot": "string", "channel": "string", "message": "string", "status": "string", "class": "string", "level": "int",
    "faction": "string", "strength": "string", "rare": "boolean", "item": "string", "qty": "int", "xp": "decimal(12,6)", "total": "int", "cost": "int",
    "min": "int", "max": "int", "roll": "int", "platinum": "int", "gold": "int", "silver": "int", "copper": "int", "file_name": "string", "x": "int", "y": "int", "z": "int",
}


class Match:
    """What a form's columns are made of: groups of its match, the text, and the log's owner."""

    def __init__(self, found: Callable[[int], Column]):
        self.found, self.text, self.owner = found, F.col("text"), F.col("owner")

    def group(self, n: int) -> Column:
        return empty_to_null(self.found(n))

    def who(self, n: int) -> Column:
        return fix_name(self.found(n), self.owner)


@dataclass(frozen=True)
class Group:
    """A group's text, cast to the type of its column."""

    n: int


@dataclass(frozen=True)
class Who:
    """A group's text as a name."""

    n: int
    without: str | None = None

    def raw(self, m: Match) -> Column:
        found = m.found(self.n)
        return F.replace(found, F.lit(self.without), F.lit("")) if self.without else found


@dataclass(frozen=True)
class Is:
    """The same value for every match."""

    value: object


@dataclass(frozen=True)
class Made:
    """A column made of slots by a function of the match and their group numbers."""

    by: Callable[..., Column]
    of: tuple = ()


Value = Group | Who | Is | Made


@dataclass(frozen=True)
class Form:
    pattern: str
    columns: dict[str, Value]
    cue: str | None = None
    unless: Callable[..., bool] | None = None
    asked: tuple[int, ...] = ()


@dataclass(frozen=True)
class Rule:
    kind: str
    forms: Sequence[Form] = field(default_factory=tuple)


_PEOPLE = ("source", "target", "name", "killshot")


def form(template: str, plain: Sequence[str] = (), unless: Callable[..., bool] | None = None, **columns: Value) -> Form:
    """A form from a message template: slots named like columns fill them, people as names but for those that are ``plain``.

    Other columns are made of slots, which ``Made`` calls by name; those of slots that the
    message has not are null. ``unless`` takes the texts of the slots that it names.
    """
    told = compile_template(template)

    def placed(value: Value) -> Value:
        if not isinstance(value, Made):
            return value
        return Made(value.by, tuple(told.slots[x] for x in value.of)) if set(value.of) <= set(told.slots) else Is(None)

    filled: dict[str, Value] = {name: Who(n) if name in _PEOPLE and name not in plain else Group(n) for name, n in told.slots.items() if name in FAMILY_COLUMNS}
    filled |= {name: placed(value) for name, value in columns.items()}
    for name in ("source", "target"):
        if filled.get(name) == Is(_CORPSE):
            filled[name] = Who(told.slots[name], _CORPSE)
    asked = tuple(told.slots[x] for x in signature(unless).parameters) if unless else ()
    return Form(told.pattern, filled, told.cue, unless, asked)


def _no_outcome(outcome: str) -> bool:
    return outcome.rsplit(" ", 1)[-1] not in _OUTCOMES


_CORPSE = "'s corpse"
_MINE = Made(lambda m: m.owner)
_LIVING = Is(_CORPSE)  # the slot's name without this ending
_TRUE_ZONE = ("an area where levitation effects do not function", "an Arena (PvP) area", "an area where Bind Affinity is allowed", "an area where Bind Affinity is not allowed", "the Drunken Monkey stance adequately")
# The last word of how a swing failed, and the type it counts as.
_OUTCOMES = {
    "miss": "miss", "misses": "miss", "dodge": "dodge", "dodges": "dodge", "parry": "parry", "parries": "parry", "riposte": "riposte", "ripostes": "riposte",
    "block": "block", "blocks": "block", "shield": "shield", "blow": "rune", "INVULNERABLE": "invul",
}


def _one_of(pairs: dict[str, str], word: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), word)


def _self(m: Match, target: int, source: int) -> Column:
    return F.when(m.group(target).isin("himself", "herself", "itself"), m.who(source)).otherwise(m.who(target))


def _mods(kind: str) -> Callable[[Match, int], Column]:
    return lambda m, tag: parse_mods(m.group(tag), kind)


_HIT_MODS, _HEAL_MODS, _MISS_MODS = (Made(_mods(kind), ("tag",)) for kind in ("hit", "heal", "miss"))


def _verb(m: Match, verb: int) -> Column:
    said = m.group(verb)
    plain = F.when(F.substring(said, -3, 3).isin("hes"), F.regexp_replace(said, "es$", "")).otherwise(F.regexp_replace(said, "s$", ""))
    return F.when(said.isin(*FRENZY), F.lit("frenzy")).otherwise(plain)


def _outcome(m: Match, outcome: int) -> Column:
    return _one_of(_OUTCOMES, F.regexp_extract(m.group(outcome), r"(\w+)$", 1))


def _full(m: Match, full: int) -> Column:
    return m.group(full).try_cast("long")


def _body(m: Match, source: int) -> Column:
    """Whose body something was on."""
    return fix_name(F.replace(F.trim(m.found(source)), F.lit(_CORPSE), F.lit("")), m.owner)


_PUBLIC = {"say": "say", "says": "say", "shout": "shout", "shouts": "shout", "auction": "auction", "auctions": "auction", "say out of channel": "ooc", "says out of channel": "ooc"}


def _metal(name: str) -> Made:
    return Made(lambda m: empty_to_null(F.regexp_extract(m.text, rf"(\d+) {name}", 1)).try_cast("int"))


def _word(**pairs: str) -> Made:
    """The value that the slot ``what`` stands for; underlines in names are blanks."""
    told = {k.replace("_", " "): v for k, v in pairs.items()}
    return Made(lambda m, what: _one_of(told, m.group(what)), ("what",))


_QUANTITY = Made(lambda m, count: F.coalesce(m.group(count).try_cast("int"), F.lit(1)), ("count",))
_ITEM = Made(lambda m, item: F.trim(m.group(item)), ("item",))
_CLASS = Made(lambda m, n: class_code(m.group(n)), ("class",))
_SPELL_OR_SONG = _word(casting="Spell", singing="Song", cast_a_spell="Spell", sing_a_song="Song")
_HEALED = {"target": Made(_self, ("target", "source")), "full_amount": Made(_full, ("full",))}
_RECEIVED = {"source": Is(None), "full_amount": Made(_full, ("full",))}
_BODY = Made(_body, ("source",))
_OUTCOME = Made(_outcome, ("outcome",))
_SWUNG_AT = Made(lambda m, n: fix_name(F.regexp_replace(m.found(n), "^on ", ""), m.owner), ("target",))
_CHANNEL = Made(lambda m, to: F.when(m.group(to) == "party", "group").otherwise(m.group(to)), ("to",))
_PERCENT = Made(lambda m: empty_to_null(F.regexp_extract(m.text, r"\d+\.\d+", 0)).try_cast("decimal(12,6)"))
_DOT, _DD, _DS = Is("dot"), Is("dd"), Is("ds")
_JOINED, _LEFT = _word(group="GroupJoined", raid="RaidJoined"), _word(group="GroupLeft", party="GroupLeft", raid="RaidLeft")

_HEALS = (
    ("{source:plain} healed {target} over time for {amount}", _HEALED),
    ("{target:word} has been healed over time for {amount}", _RECEIVED),
    ("You have been healed over time for {amount}", _RECEIVED | {"target": _MINE}),
    ("{source:plain} healed {target} for {amount}", _HEALED),
    (r"{:long}\. {source:plain} healed {target} for {amount}", _HEALED),  # after what the heal looked like
    ("{target} has been healed for {amount}", _RECEIVED),
)
_SPEECH = (
    ("You told {to},", {"source": _MINE, "channel": Is("tell")}),
    ("You say to your {to:word},", {"source": _MINE, "channel": _CHANNEL}),
    ("You tell your {to:word},", {"source": _MINE, "channel": _CHANNEL}),
    ("You tell {to:word}:{:number},", {"source": _MINE, "channel": _CHANNEL}),
    ("You tell {to:word},", {"source": _MINE, "channel": _CHANNEL}),
    ("{source} tells you,", {"channel": Is("tell")}),
    ("{source} tells the {to:word},", {"channel": _CHANNEL}),
    ("{source} tells {to:word}:{:number},", {"channel": _CHANNEL}),
    ("{source} tells {to:word},", {"channel": _CHANNEL}),
    *((f"{{source}} {said},", {"channel": Is(channel)}) for said, channel in _PUBLIC.items()),
)


def _spoken() -> tuple[Form, ...]:
    """Each way to speak, plain and in a tongue; the raid's chat has a blank more before what is said."""
    forms = []
    for opening, columns in _SPEECH:
        gap = " " if opening.endswith("tells the {to:word},") else ""
        endings = [" '{message:long}'", " in {:tongue}, '{message:long}'", *([f" {gap}'{{message:long}}'"] if gap else [])]
        forms += [form(opening + ending, **columns) for ending in endings]
    return tuple(forms)


def _healing() -> tuple[Form, ...]:
    """Each way to tell of a heal, with and without the full amount and the spell; a pack's heals have no tag."""
    forms = []
    for opening, columns in _HEALS:
        for full in (r" \({full}\)", ""):
            for spell in (" by {spell}", *([] if "been" in opening or "over time" in opening else [""])):
                own = dict(columns) if full else columns | {"full_amount": Made(lambda m, n: m.group(n).try_cast("long"), ("amount",))}
                if opening.endswith("has been healed for {amount}"):
                    forms.append(form(f"{opening}{full} hit points{spell}.", **own))
                else:
                    forms.append(form(f"{opening}{full} hit points{spell}.{{tag}}", mods=_HEAL_MODS, **own))
    return tuple(forms)


def _lines(templates: Sequence[str], **columns: Value) -> tuple[Form, ...]:
    return tuple(form(t, **columns) for t in templates)


DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("miss", (form("{source} tries to {:word} {target}, but {outcome}!{tag}", type=_OUTCOME, mods=_MISS_MODS, target=_SWUNG_AT, unless=_no_outcome), form("You try to {:word} {target}, but {outcome}!{tag}", source=_MINE, type=_OUTCOME, mods=_MISS_MODS, target=_SWUNG_AT, unless=_no_outcome))),
    Rule(
        "hit",
        (
            form("{source:long} {verb:strike} {target} for {amount} point[s] of damage.{tag}", target=Made(_self, ("target", "source")), type=Made(_verb, ("verb",)), mods=_HIT_MODS, unless=lambda target: target.startswith("by non-melee")),
            form("{source} hit {target} for {amount} point[s] of {:word} damage by {spell}.{tag}", type=_DD, mods=_HIT_MODS),
            form("{source} hit {target} for {amount} point[s] of non-melee damage.{tag}", type=_DD, mods=_HIT_MODS),
            # quirk kept: what a named caster does to you counts as yours, on the caster
            form("You have taken {amount} damage from {spell} by {target}.{tag}", source=_MINE, type=_DOT, mods=_HIT_MODS),
            form("You have taken {amount} damage from {spell}.{tag}", target=_MINE, source=Is(None), type=_DOT, mods=_HIT_MODS),
            form("You have taken {amount} damage by {spell}.{tag}", target=_MINE, source=Is(None), type=_DOT, mods=_HIT_MODS),
            form("{target} has taken {amount} damage from your {spell}.{tag}", source=_MINE, type=_DOT, mods=_HIT_MODS),
            form("{target} has taken {amount} damage from {spell} by {source}.{tag}", type=_DOT, mods=_HIT_MODS),
            form("{target} has taken {amount} damage from {spell}.{tag}", source=Is(None), type=_DOT, mods=_HIT_MODS),
            form("{target} has taken {amount} damage by {spell}.{tag}", source=Is(None), type=_DOT, mods=_HIT_MODS),
            form("{target} is {:word} by {source} {:word} for {amount} point[s] of non-melee damage.", type=_DS),
            form("YOU are {:word} by {source} {:word} for {amount} point[s] of non-melee damage!", target=_MINE, type=_DS),
            form("{target} was chilled to the bone for {amount} point[s] of non-melee damage.", source=Made(lambda m, n: m.who(n), ("target",)), type=_DS),
        ),
    ),
    Rule("heal", _healing()),
    Rule(
        "casting",
        (
            form("{source} begin[s] {what:casting|singing} {spell:long}.", type=_SPELL_OR_SONG),
            form("{source} activate[s] {spell:long}.", type=Is("Disc")),
            form("{source} begins to {what:cast a spell|sing a song}. <{spell:long}>", type=_SPELL_OR_SONG),
        ),
    ),
    Rule("death", (form("{name:long} died."), form("{name:long} has been slain by {killshot:long}!"), form("You have been slain by {killshot:long}!", name=_MINE), form("You have slain {name:long}!", killshot=_MINE))),
    Rule("chat", _spoken()),
    Rule("zone", (form("You have entered {name:long}.", plain=("name",), unless=lambda name: name in _TRUE_ZONE),)),
    Rule(
        "party",
        (
            *_lines(("You have joined the {what:group|raid}.", "You joined the {what:group|raid}."), name=_MINE, status=_JOINED),
            *_lines(("{name} has joined the {what:group|raid}.", "{name} joined the {what:group|raid}."), status=_JOINED),
            *_lines(("You have left the {what:group|raid}.", "You have been removed from the {what:group|raid}.", "You were removed from the {what:group|raid}."), name=_MINE, status=_LEFT),
            *_lines(("{name} has left the {what:group|raid}.", "{name} has been removed from the {what:group|raid}.", "{name} were removed from the {what:group|raid}."), status=_LEFT),
            form("You remove {name} from the {what:group|party|raid}.", status=_LEFT),
            form("* {name} has {what:left|entered} channel {:word}:{:number}", status=_word(left="ChannelLeft", entered="ChannelJoined")),
        ),
    ),
    Rule(
        "who",
        (
            form(r"{:flags}\[ANONYMOUS\] {name:word}...", plain=("name",), level=Is(0)),
            form(r"{:flags}\[{level} {class:class}\] {name:word}...", plain=("name",), **{"class": _CLASS}),
            form(r"{:flags}\[{level} {:short} \({class:class}\)\] {name:word}...", plain=("name",), **{"class": _CLASS}),
            form(r"Targeted \(Player\): {name:word}", plain=("name",), level=Is(0)),
        ),
    ),
    Rule(
        "consider",
        (
            form(r"{name} - {:long} - {faction:regard} -- {strength:long} \(Lvl: {level}\)", plain=("name",), rare=Is(True)),
            form(r"{name} {faction:regard} -- {strength:long} \(Lvl: {level}\)", plain=("name",), rare=Is(False)),
        ),
    ),
    Rule(
        "loot",
        (
            *_lines(("--You have looted {count:count} {item:thing} from {source:thing}.--", "--You have looted {count:count} {item:thing}.--"), name=_MINE, source=_BODY, item=_ITEM, qty=_QUANTITY),
            *_lines(("--{name:word} has looted {count:count} {item:thing} from {source:thing}.--", "--{name:word} has looted {count:count} {item:thing}.--"), source=_BODY, item=_ITEM, qty=_QUANTITY),
            form("{name:word} grabbed a {item:long} from {source:thing}.", source=_BODY, item=_ITEM, qty=Is(1)),
            form("--{name:word} stole {item:long} from {source:long}!--", qty=Is(1), unless=lambda item: item == "coin"),
        ),
    ),
    Rule(
        "rot",
        (
            form("--You left {count:count} {item:thing} on {source:thing}.--", name=_MINE, source=_BODY, item=_ITEM),
            form("--{name:word} left {count:count} {item:thing} on {source:thing}.--", source=_BODY, item=_ITEM),
            *_lines(("--{count:count} {item:long} was left on {source:thing}.--", "--{count:count} {item:long} were left on {source:thing}.--"), source=_BODY, item=_ITEM),
        ),
    ),
    Rule("craft", (form("You have fashioned the items together to create {:title}: {item:thing}.", name=_MINE),)),
    Rule("xp", tuple(form(f"{gain} {{what:experience|party|raid}}...", type=_word(experience="SoloXP", party="GroupXP", raid="RaidXP"), xp=_PERCENT) for gain in ("You gain", "You gained"))),
    Rule("aaxp", (form(r"You have gained {amount} ability point\(s\)!  You now have {total} ability point\(s\)."),)),
    Rule("aa_purchase", (form('You have gained the ability "{name}" at a cost of {cost} ability point[s].', plain=("name",)), form("You have improved {name} at a cost of {cost} ability point[s].", plain=("name",)))),
    Rule("skill", (form(r"You have become better at {name:long}! \({level}\)", plain=("name",)),)),
    Rule("shield", (form("{target} begins to use {source} as a living shield!", source=_LIVING, target=_LIVING),)),
    Rule("rescued", (form("{target} has been rescued by divine intervention!"),)),
    Rule(
        "taunt",
        (
            *_lines(("You capture {target:long}'s attention!", "You capture {target:long}'s attention with your unparalleled reproach!"), source=_MINE),
            *_lines(("{source:word} has captured {target:long}'s attention!", "{source:word} has captured {target:long}'s attention with an unparalleled approach!", "{source:word} was partially successful in capturing {target:long}'s attention.")),
            form("{source:word} captures the attention of everything in the area!"),
        ),
    ),
    Rule(
        "dice",
        (
            form("**A Magic Die is rolled by {source:word}. It could have been any number from {min} to {max}, but this time it turned up a {roll}."),
            form("{source:word} rolled a {roll} on {item:long}.", min=Is(1), max=Is(1000)),
        ),
    ),
    Rule("coin", tuple(form(f"{opening} {{:number}}...", **{m: _metal(m) for m in ("platinum", "gold", "silver", "copper")}) for opening in ("You receive", "Alive group members received"))),
    Rule("output_file", (form("Outputfile Complete: {file_name:rest}"),)),
    Rule(
        "cast_fail",
        (
            form("Your {spell} spell is interrupted.", source=_MINE, type=Is("interrupt")),
            form("{source}'s {spell} spell is interrupted.", type=Is("interrupt")),
            form("Your {spell} spell fizzles!", source=_MINE, type=Is("fizzle")),
            form("{source}'s {spell} spell fizzles!", type=Is("fizzle")),
        ),
    ),
    Rule("cure", (*_lines(("You are cured of {spell} by {source}.",), target=_MINE), form("{target} is cured of {spell} by {source}."))),
)
#: Not among the defaults: the text has y before x.
LOCATION = Rule("location", (form("Your Location is {y:whole}{:short}, {x:whole}{:short}, {z:whole}..."),))


def _column(name: str, kind: str, forms: Sequence[Form]) -> Column:
    """One column over all forms: forms that fill it alike share one branch, and all names are put right in one place."""
    ways: dict[Value, list[int]] = {}
    for k, form in enumerate(forms):
        if name in form.columns:
            ways.setdefault(form.columns[name], []).append(k)
    match, at = Match(partial(F.get, F.col("_groups"))), F.col("_form")
    branches = [(at.isin(ks), _value(way, match, kind)) for way, ks in ways.items() if not isinstance(way, Who)]
    names = [(at.isin(ks), way.raw(match)) for way, ks in ways.items() if isinstance(way, Who)]
    if names:
        found = reduce(lambda out, x: out.when(*x), names[1:], F.when(*names[0]))
        branches.append((at.isin([k for way, ks in ways.items() if isinstance(way, Who) for k in ks]), fix_name(found, F.col("owner"))))
    return reduce(lambda out, x: out.when(*x), branches, F).cast(kind) if branches else F.lit(None).cast(kind)


def _value(way: Value, match: Match, kind: str) -> Column:
    if isinstance(way, Is):
        return F.lit(way.value).cast(kind)
    if isinstance(way, Group):
        return match.group(way.n).try_cast(kind)
    return way.by(match, *way.of).cast(kind)


def extract_events(lines: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """(log_id, seq, owner, server, ts, kind, text, family columns): kind is ``raw`` where no rule matches.

    A number too large for its column is null. Lines are matched where they are read,
    batch by batch (:func:`dispatch.first_match`): no shuffle, a few patterns a line.
    """
    kinds, forms = zip(*((r.kind, f) for r in rules for f in r.forms), strict=True)
    found = with_first_match(lines, [Pattern(f.pattern, f.cue, f.unless, f.asked) for f in forms], "text", "_form", "_groups")
    kind = F.coalesce(F.get(F.array(*map(F.lit, kinds)), F.col("_form")), F.lit("raw"))
    return found.select("log_id", "seq", "owner", "server", "ts", kind.alias("kind"), "text", *[_column(n, k, forms).alias(n) for n, k in FAMILY_COLUMNS.items()])


def unmatched(events: DataFrame) -> DataFrame:
    """Texts that no rule matched and that hold a digit: candidates for new rules."""
    return events.where((F.col("kind") == "raw") & F.col("text").rlike(r"\d"))


def rule_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def normalize_sources(events: DataFrame) -> DataFrame:
    """Heals of a ward belong to its owner."""
    ward = F.regexp_replace("source", "`s ward$", "")
    return events.withColumn("source", F.when(F.col("kind") == "heal", ward).otherwise(F.col("source")))


def without_corpses(hits: DataFrame, foe: str = "foe") -> DataFrame:
    """Hits by a corpse count for its former self if they land on the foe; others with a foe go."""
    corpse = F.coalesce(F.col("source").endswith("'s corpse"), F.lit(False)) & F.col(foe).isNotNull() & (F.col("kind") == "hit")
    kept = hits.where(~corpse | (F.col("target") == F.col(foe)))
    return kept.withColumn("source", F.when(corpse, F.regexp_replace("source", "'s corpse$", "")).otherwise(F.col("source")))
