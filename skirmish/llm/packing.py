"""Packing by shortest-pack-first over the length histogram.

Documents become ids, are cut every ``size`` ids, and the pieces are counted by
length: a histogram of at most ``size`` rows, whatever the corpus. The driver
places lengths longest first, always into the pack with the most room, many
equal packs at a time, and so updates counts of packing patterns instead of
packs. Pieces then get a seeded rank among those of their length, and a join on
length and rank range gives each its sequence and offset.

Defined results: a null or empty text is the end id alone; repeated rows are
packed as often as they come; an empty table gives no rows; a very long text is
many pieces; other columns are not read. A join row stands
for a run of equal lengths in a pattern, so the table it joins has at most
(patterns x 63) rows at size 2048: distinct lengths of one pattern add up to
``size`` at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rank_in_groups
from .tokens import pieces

SIZE = 2048
#: Pieces and runs of a length meet by rank, so many ranks at a time: no length is one key.
RUN = 1 << 14


@dataclass
class Pattern:
    """``count`` sequences, each with these runs of (length, how many), longest first."""

    count: int
    runs: tuple[tuple[int, int], ...]


def pack_histogram(histogram: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Patterns that hold every length of the histogram as often as it counts."""
    open_packs: dict[int, list[Pattern]] = {}
    full: list[Pattern] = []

    def put(count: int, runs: tuple[tuple[int, int], ...], room: int) -> None:
        if room:
            open_packs.setdefault(room, []).append(Pattern(count, runs))
        else:
            full.append(Pattern(count, runs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_packs, default=0)
            if room < length:
                # no pack has room: new sequences, each with as many of this length as an even deal gives it
                put(left, ((length, 1),), size - length)
                break
            pack = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
            used = min(left, pack.count)
            left -= used
            if used < pack.count:
                put(pack.count - used, pack.runs, room)
            if pack.runs[-1][0] == length:
                runs = (*pack.runs[:-1], (length, pack.runs[-1][1] + 1))
            else:
                runs = (*pack.runs, (length, 1))
            put(used, runs, room - length)
    return full + [p for packs in open_packs.values() for p in packs]


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, sequences, first sequence, offset) of every run."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for p in patterns:
        offset = 0
        for length, many in p.runs:
            lo = rank.get(length, 0)
            rank[length] = lo + p.count * many
            rows.append((length, lo, rank[length], p.count, first, offset))
            offset += length * many
        first += p.count
    return rows


def pack(docs: DataFrame, path: str, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, size, doc_id, text), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = places(pack_histogram(histogram, size))
    table = spark.createDataFrame(found, "p_length long, lo long, hi long, n long, first long, p_offset long")
    table = table.withColumn("p_bucket", F.explode(F.sequence(F.expr(f"lo div {RUN}"), F.expr(f"(hi - 1) div {RUN}"))))
    ranked = rank_in_groups(cut, ["length"], F.xxhash64("doc_id", "start", "ids_crc32"), "rank").withColumn("bucket", F.expr(f"rank div {RUN}"))
    same = (F.col("length") == F.col("p_length")) & (F.col("bucket") == F.col("p_bucket"))
    placed = ranked.join(table, same & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        *cut.columns,
        (F.col("first") + nth % F.col("n")).alias("sequence_id"),
        (F.col("p_offset") + F.floor(nth / F.col("n")).cast("long") * F.col("length")).alias("offset"),
    )
