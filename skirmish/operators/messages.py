r"""Message templates: a log message as the game writes it, with named slots for what varies.

A template is plain text with few marks. ``{name}`` is a slot, ``{name:kind}`` one
of another kind than its own (:data:`KINDS`, or words parted by bars), ``{:kind}``
text that is not kept; ``[...]`` may be absent; ``(a|b)`` is one of several texts;
``{tag}`` is the bracketed list of modifiers at the end of a message; ``...`` at
either end leaves that end open. A backslash takes a mark as it is.

:func:`compile_template` makes a pattern of it, the numbers of its slots, and its
cue: the longest text that every such message holds, which is cheap to look for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

NUMBERS = ("amount", "full", "level", "total", "cost", "min", "max", "roll")
# What a strike is called, and how a creature's regard begins.
VERBS = ("backstab", "bash", "bite", "burn", "claw", "crush", "gore", "hit", "kick", "learn", "maul", "pierce", "punch", "rend", "shoot", "slam", "slash", "slice", "smash", "sting", "strike", "sweep")
FRENZY = ("frenzy on", "frenzies on")
REGARDS = ("glares", "glowers", "judges", "kindly", "looks", "regards", "scowls")


def third_person(verb: str) -> str:
    return verb + ("es" if verb.endswith(("sh", "ch")) else "s")


KINDS = {
    "short": ".+?",
    "long": ".+",
    "plain": "[^.]+?",
    "tongue": "[^,']+",
    "rest": ".*",
    "word": r"\w+",
    "number": r"\d+",
    "whole": r"-?\d+",
    "count": r"an?|\d+",
    "thing": r"[^.]+?",
    "title": "[^:]+",
    "flags": r"[A-Z\s]*",
    "class": r"[\w\s]+",
    "regard": f"(?:{'|'.join(REGARDS)}) .+?",
    "strike": "|".join([*(x for v in VERBS for x in (third_person(v), v)), *FRENZY]),
}
_TAG = r"(?: \(([^()]+)\))?"
_MARKS = re.compile(r"\\(?P<plain>.)|\{(?P<slot>[^}]*)\}|(?P<mark>[\[\]()|])")


@dataclass(frozen=True)
class Compiled:
    pattern: str
    slots: dict[str, int]
    cue: str | None


@cache
def compile_template(template: str) -> Compiled:
    open_start, open_end = template.startswith("..."), template.endswith("...")
    text = template.removeprefix("...").removesuffix("...")
    out: list[str] = []
    slots: dict[str, int] = {}
    runs, depth, at = [""], 0, 0

    def plain(piece: str) -> None:
        out.append(re.escape(piece))
        if not depth:
            runs[-1] += piece

    for found in _MARKS.finditer(text):
        plain(text[at : found.start()])
        at = found.end()
        if found["plain"] is not None:
            plain(found["plain"])
            continue
        runs.append("")
        mark = found["mark"]
        if mark is not None:
            depth += {"[": 1, "(": 1, "]": -1, ")": -1, "|": 0}[mark]
            out.append({"[": "(?:", "(": "(?:", "]": ")?", ")": ")", "|": "|"}[mark])
            continue
        name, _, kind = found["slot"].partition(":")
        if name == "tag":
            slots[name] = len(slots) + 1
            out.append(_TAG)
            continue
        body = KINDS.get(kind or ("number" if name in NUMBERS else "short"), kind)
        if name:
            slots[name] = len(slots) + 1
        out.append(f"({body})" if name else f"(?:{body})")
    plain(text[at:])
    cue = max(runs, key=len)
    pattern = ("" if open_start else "^") + "".join(out) + ("" if open_end else "$")
    return Compiled(pattern, slots, cue if len(cue) > 1 else None)
