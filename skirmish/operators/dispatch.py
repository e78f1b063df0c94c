"""The first of many patterns that matches a text, with few of them tried.

Every pattern may have a cue: a text that all it matches hold. One automaton over the
cues is run along a text once; only patterns whose cue it met, and those without one,
are tried, in their order. Work a text is its length and a pattern or two, however many
patterns there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Pattern:
    """A pattern with its cue; a match is none if ``unless`` holds of the groups it asks for."""

    pattern: str
    cue: str | None = None
    unless: Callable[..., bool] | None = None
    asked: tuple[int, ...] = ()


class Dispatch:
    """Patterns and the automaton over their cues, made once a task."""

    def __init__(self, patterns: Sequence[Pattern]):
        self.patterns = [(re.compile(p.pattern, re.ASCII), p.unless, p.asked) for p in patterns]
        self.always = [k for k, p in enumerate(patterns) if not p.cue]
        by_cue: dict[str, list[int]] = {}
        for k, p in enumerate(patterns):
            if p.cue:
                by_cue.setdefault(p.cue, []).append(k)
        self.cues = ahocorasick.Automaton()
        for cue, ks in by_cue.items():
            self.cues.add_word(cue, ks)
        self.cues.make_automaton()
        self.any_cue = bool(by_cue)

    def first_match(self, text: str) -> tuple[int, tuple] | None:
        """The number and groups of the first pattern that matches."""
        tried = set(self.always)
        if self.any_cue:
            for _, ks in self.cues.iter(text):
                tried.update(ks)
        for k in sorted(tried):
            pattern, unless, asked = self.patterns[k]
            found = pattern.search(text)
            if found and not (unless and unless(*(found[n] or "" for n in asked))):
                return k, found.groups()
        return None


def with_first_match(df: DataFrame, patterns: Sequence[Pattern], text: str, number: str, groups: str) -> DataFrame:
    """Adds the number of the first pattern that matches a text column, and its groups; both null where none does."""
    schema = T.StructType([*df.schema.fields, T.StructField(number, T.IntegerType()), T.StructField(groups, T.ArrayType(T.StringType()))])
    place = df.columns.index(text)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dispatch = Dispatch(patterns)
        for batch in batches:
            found = [None if x is None else dispatch.first_match(x) for x in batch.column(place).to_pylist()]
            told = [pa.array([f and f[0] for f in found], pa.int32()), pa.array([f and (None, *f[1]) for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*batch.schema.names, number, groups])

    return df.mapInArrow(match, schema)
