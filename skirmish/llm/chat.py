r"""Chat formatting by a declarative template, with column functions only.

A template names the marks around a turn, the roles under the loss, and the
transitions of a finite-state machine over roles. Rows become, conversation by
conversation and in turn order, a list of text segments with a loss flag each:
the marks and the role are not under the loss, the text of a loss role is. Joined,
the segments are the formatted text. Marks inside texts are escaped: a backslash
becomes two, and ``<|`` becomes ``<\|``, so no mark can be forged and reading
back gives the text as it was.

Defined results: a null text or role is empty; equal turns are ordered by role,
then text; a turn without a number comes first; repeated rows are turns each; rows
without a conversation id are one conversation; an empty table gives no rows; other
columns, whatever their names, are not read. A conversation is one value, however
long, so a task holds the one that it formats.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, roles under the loss, and which role may follow which ("" is the start)."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant", "tool"),
        }
    )
    final: tuple[str, ...] = ("assistant",)


CHAT = Template()
_INVALID = "!"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _state(turns: Column, template: Template) -> Column:
    """The state after the last turn: its role, or _INVALID once a role came that may not follow."""
    pairs = [F.lit(x) for a, after in template.follows.items() for b in after for x in (f"{a}>{b}", b)]
    step = F.create_map(*pairs)
    return F.aggregate(turns, F.lit(""), lambda s, t: F.coalesce(F.try_element_at(step, F.concat(s, F.lit(">"), t["role"])), F.lit(_INVALID)))


def format_chats(rows: DataFrame, template: Template = CHAT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, segments, formatted, mask, valid_order, complete): one row a conversation.

    ``mask`` has the places (start, length) in ``formatted`` of the text under the loss.
    """
    given = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(given)).alias("turns"))

    def segments(t: Column) -> Column:
        # a line break in a role is escaped too: the first bare one ends the role
        name = F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n"))
        head = F.struct(F.concat(F.lit(template.start), name, F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss"))
        body = F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss"))
        tail = F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss"))
        return F.array(head, body, tail)

    whole = whole.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), _state(F.col("turns"), template).alias("state"))
    return whole.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        _mask(F.col("segments")).alias("mask"),
        (F.col("state") != _INVALID).alias("valid_order"),
        F.col("state").isin(*template.final).alias("complete"),
    )


def _mask(segments: Column) -> Column:
    """Places of the segments under the loss."""
    place = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        size = F.length(x["text"])
        found = F.array(F.struct(s["at"].alias("start"), size.alias("length")))
        return F.struct((s["at"] + size).alias("at"), F.when(x["loss"], F.concat(s["out"], found)).otherwise(s["out"]).alias("out"))

    return F.aggregate(segments, place, step, lambda s: s["out"])


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) that a formatted text holds."""
    raw = F.slice(F.split(formatted, _literal(template.start)), F.lit(2), F.greatest(F.size(F.split(formatted, _literal(template.start))) - 1, F.lit(0)))

    def turn(t: Column) -> Column:
        body = F.substring(t, F.lit(1), F.length(t) - len(template.end))
        name = F.regexp_extract(body, r"(?s)^((?:\\.|[^\\\n])*)\n", 1)
        rest = F.substring(body, F.length(name) + 1 + len(template.after_role), F.length(body))
        return F.struct(unescape(name).alias("role"), unescape(rest).alias("text"))

    return F.transform(raw, turn)


def _literal(mark: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in mark)


def digest(chats: DataFrame, template: Template = CHAT) -> DataFrame:
    """Counts and checksums of formatted conversations, all read from the formatted text and its mask."""
    read = chats.withColumn("turns", read_back(F.col("formatted"), template))
    masked = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))
    read = read.withColumn("loss", F.array_join(masked, ""))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid_order",
        "complete",
    )
