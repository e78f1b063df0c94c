"""Suffix-array dedup: find every byte covered by a string of ``min_bytes`` bytes that starts elsewhere too.

1. Segments. The smallest gram hash among the ``min_bytes`` bytes after a start
   (the leftmost, if several) depends on those bytes alone, so equal strings
   have equal anchors at equal places. Starts in a row with one anchor make a
   segment: the bytes that their strings cover. A segment whose anchor comes
   once in the corpus repeats nothing. Segments equal byte for byte are merged
   and counted; if an anchor has one distinct segment, all its starts repeat.
2. Shards. The distinct segments of the other anchors are dealt by anchor over
   shards of bounded size. Every shard gets a suffix array by Larsson-Sadakane
   refinement (only groups that still tie are sorted again, by twice the depth)
   and common prefixes by Kasai's rule: the prefix shared with the neighbour
   shrinks by one from a start to the next, unless the characters before them
   differ, where it is compared anew. Neighbours that share ``min_bytes`` make a
   class; the starts of a class of two or more repeat.
   A second length is read from the same prefixes: segments are cut for the
   shorter one and reach as far as the longer one, so equal strings of either
   length meet at one anchor.
3. Merging. An anchor with more bytes than a shard holds is dealt over several;
   from each, one string of a class is sent on by its hash, and sorted runs of
   them are merged by binary search: a string found in another run repeats.

Defined results: a null text is empty; texts shorter than ``min_bytes`` keep all;
repeated rows of a text of ``min_bytes`` or more lose all of it; an empty table
gives no rows; texts of any length are cut where they are read. Other columns,
whatever their names, are carried along by :func:`remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_names, giving_back, materialize

MIN_BYTES = 400
#: Bytes of a repeated passage: what 50 words have at least, but for very short ones.
PASSAGE = 256
GRAM = 16
#: Small enough that the arrays of a shard stay in a core's cache.
SHARD = 1 << 17
#: An anchor with more bytes of distinct segments than this is dealt over several shards.
HOT = 1 << 23
_BATCH = 1 << 20
_INNER = bytes(range(0x80, 0xC0))  # bytes of a character after its first
_PLACE = np.uint64((1 << 24) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on; the last GRAM - 1 places have none."""
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    x = x[:-8] * np.uint64(0x9E3779B97F4A7C15) + x[8:]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x


def _segments(data: np.ndarray, ends: np.ndarray, min_bytes: int) -> tuple[np.ndarray, ...]:
    """Text number, first start, number of starts, anchor and its distance for the segments of joined texts."""
    window = min_bytes - GRAM + 1
    hashes = _gram_hashes(data)
    blocks = -(-len(hashes) // window)
    keys = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    keys[: len(hashes)] = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    square = keys.reshape(blocks, window)
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(square, axis=1).ravel()
    least = np.minimum(after[: len(hashes) - window + 1], before[window - 1 : len(hashes)])
    sizes = np.diff(np.r_[0, ends])
    owner = np.repeat(np.arange(len(ends)), sizes)
    starts = np.flatnonzero(np.arange(len(least)) + min_bytes <= ends[owner[: len(least)]])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = (least[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    count = np.diff(np.r_[first, len(starts)])
    begin = starts[first]
    return owner[begin], begin, count, hashes[at[first]].view(np.int64), at[first] - begin


def _joined(column: pa.Array, limit: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Texts of a binary column joined to about ``limit`` bytes, the row of the first, and where each ends."""
    at, held, size = 0, [], 0
    for i, x in enumerate(column):
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size >= limit or i == len(column) - 1:
            yield at, b"".join(held), np.cumsum([len(t) for t in held])
            at, held, size = i + 1, [], 0


def _cut_long(ends: np.ndarray, min_bytes: int, limit: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Ranges of joined texts that are analysed at a time: a long text in pieces that overlap by min_bytes - 1."""
    total = int(ends[-1])
    for lo in range(0, max(total, 1), limit):
        yield lo, min(lo + limit + min_bytes - 1, total)


def segments(docs: DataFrame, min_bytes: int, reach: int) -> DataFrame:
    """(doc_id, text_hash, anchor, digest, at, n, size): every segment of every text of ``docs`` (doc_id, text_hash, text).

    A segment's ``size`` bytes are those of its ``n`` starts' strings of ``reach`` bytes, as far as the text goes.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for row, joined, ends in _joined(batch.column(2), _BATCH):
                begins = np.r_[0, ends[:-1]]
                for lo, hi in _cut_long(ends, min_bytes):
                    if hi - lo < min_bytes:
                        continue
                    data = np.frombuffer(joined, np.uint8)[lo:hi]
                    inside = np.clip(ends - lo, 0, hi - lo)
                    whose, begin, count, anchor, lead = _segments(data, inside, min_bytes)
                    if not len(whose):
                        continue
                    view, begin = memoryview(joined), begin + lo
                    size = np.minimum(count + reach - 1, ends[whose] - begin)
                    seeds = lead << 32 | count
                    found = np.fromiter((digest(view[a : a + n], seed=d) for a, n, d in zip(begin.tolist(), size.tolist(), seeds.tolist(), strict=True)), np.uint64, len(whose))
                    rows = pa.array(whose + row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor), pa.array(found.view(np.int64)), pa.array(begin - begins[whose]), pa.array(count.astype(np.int32)), pa.array(size.astype(np.int32))],
                        ["doc_id", "text_hash", "anchor", "digest", "at", "n", "size"],
                    )

    sent = docs.select("doc_id", "text_hash", F.col("text").cast("binary").alias("text"))
    return sent.mapInArrow(lambda batches: giving_back(find(batches)), "doc_id long, text_hash long, anchor long, digest long, at long, n int, size int")


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks (from 1) by Larsson-Sadakane refinement."""
    n = len(data)
    bits = n.bit_length()
    b, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    depth = min(8, (64 - bits) // 8)
    key = np.arange(n, dtype=np.uint64)  # a start behind its first bytes: sorting values is faster than sorting places
    for i in range(min(depth, n)):
        key[: n - i] |= data[i:].astype(np.uint64) << np.uint64(bits + 8 * (depth - 1 - i))
    key.sort()
    sa, ordered = (key & low).view(np.int64), key >> b
    rank = np.zeros(n + 1, np.uint64)  # the empty suffix has rank 0
    slots = np.arange(n)
    while True:
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(slots)])
        rank[sa[slots]] = np.repeat(slots[first] + 1, size)
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots):
            return sa, rank[:n].view(np.int64)
        tied = sa[slots]
        key = rank[tied] << b | rank[np.minimum(tied + depth, n)]
        if 3 * bits <= 64:
            key = key << b | tied.view(np.uint64)
            key.sort()
            sa[slots], ordered = (key & low).view(np.int64), key >> b
        else:
            order = np.argsort(key)
            sa[slots], ordered = tied[order], key[order]
        depth *= 2


def common_prefixes(data: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """By place in the suffix array: the bytes shared with the suffix before it, exact up to ``limit``.

    Kasai's rule, all starts at a time: where the characters before a suffix and
    its neighbour agree, the shared prefix is one less than at the start before.
    """
    n = len(data)
    before = np.empty(n, np.int64)  # by start: the suffix sorted before it
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    starts = np.arange(n)
    follows = (starts > 0) & (before > 0)
    follows[follows] = data[starts[follows] - 1] == data[before[follows] - 1]
    anew = np.flatnonzero(~follows)
    anew = anew[before[anew] >= 0]
    shared = np.zeros(n, np.int64)
    step = 8
    words = np.zeros(n + 8, np.uint64)
    words[:n] = data
    for shift in (1, 2, 4):
        words[: n + 8 - shift] |= words[shift:] << np.uint64(8 * shift)
    words = words[: n + 1]
    live, depth = anew, 0
    while len(live) and depth < limit + n:
        a, b = live + depth, before[live] + depth
        whole = np.maximum(a, b) + step <= n
        same = whole.copy()
        same[whole] = words[a[whole]] == words[b[whole]]
        ended, live = live[~same], live[same]
        # the first bytes that differ, or the end of the data
        room = n - np.maximum(ended, before[ended]) - depth
        for k in range(step):
            if not len(ended):
                break
            more = room > k
            ended, room = ended[more], room[more]
            more = data[ended + depth + k] == data[before[ended] + depth + k]
            ended, room = ended[more], room[more]
            shared[ended] += 1
        shared[live] += step
        depth += step
    reach = np.where(follows | (before < 0), -1, shared + starts)  # shared + start stays the same along a chain
    reach[before < 0] = starts[before < 0]
    source = np.maximum.accumulate(np.where(reach >= 0, starts, 0))
    return (reach[source] - starts)[sa]


def _classes(data: np.ndarray, lengths: Sequence[int]) -> Iterator[np.ndarray]:
    """For each length, by start: a number that starts of equal strings of that length have in common; starts near the end of data have numbers too."""
    sa, _ = suffix_array(data)
    far = common_prefixes(data, sa, max(lengths))
    for length in lengths:
        out = np.empty(len(data), np.int64)
        out[sa] = np.cumsum(far < length)
        yield out


_FOUND = "anchor long, digest long, lo int, hi int, window long, part int, of int"


def _repeats(rows: DataFrame, lengths: Sequence[int], shard: int) -> DataFrame:
    """By length (of): ranges of starts that repeat within a shard (window null), and one start of each class of an anchor dealt over several."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[6] for r in held), np.uint8)
        counts = np.array([r[3] for r in held])
        ends = np.cumsum([len(r[6]) for r in held])
        begins = np.r_[0, ends[:-1]]
        every = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        owner = np.repeat(np.arange(len(held)), counts)
        parts = np.array([r[5] for r in held])
        out = []
        for length, classes in zip(lengths, _classes(data, lengths), strict=True):
            fits = every + length <= ends[owner]
            starts, whose = every[fits], owner[fits]
            if not len(starts):
                continue
            group = classes[starts]
            copies = np.array([r[4] for r in held])[whose]
            repeats = np.bincount(group, copies)[group] >= 2
            flips = np.flatnonzero(np.diff(np.r_[0, repeats, 0]) | np.r_[1, np.diff(whose) != 0, 1])
            runs = [(a, b) for a, b in zip(flips[:-1].tolist(), flips[1:].tolist(), strict=True) if repeats[a]]
            out += [(*held[w := whose[a]][:2], a0 := int(starts[a] - begins[w]), a0 + b - a - 1, None, None, length) for a, b in runs]
            if (parts[whose] >= 0).any():
                _, one = np.unique(group, return_index=True)
                for k in one[parts[whose[one]] >= 0].tolist():
                    r, at = held[whose[k]], int(starts[k])
                    window = xxhash.xxh3_64_intdigest(data[at : at + length].tobytes(), seed=length)
                    out.append((r[0], r[1], at - int(begins[whose[k]]), at - int(begins[whose[k]]), window - (1 << 64) * (window >> 63), r[5], length))
        names = ["anchor", "digest", "lo", "hi", "window", "part", "of"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if size >= shard and row[0:6:5] != held[-1][0:6:5]:  # another anchor, or another part of one
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield solve(held)

    return rows.select("anchor", "digest", "at", "n", "copies", "part", "content").mapInArrow(lambda batches: giving_back(work(batches)), _FOUND)


def _merged(found: DataFrame) -> DataFrame:
    """Starts whose string another part of their anchor has too, by binary search in sorted runs."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_window(batches):
            window, part = batch.column("window").to_numpy(), batch.column("part").to_numpy()
            anchor = batch.column("anchor").to_numpy()
            keys = window ^ (anchor * np.int64(0x5851F42D4C957F2D - (1 << 63)))
            hit = np.zeros(len(keys), bool)
            runs = [np.flatnonzero(part == p) for p in np.unique(part)]
            ordered = [np.sort(keys[r]) for r in runs]
            for i, mine in enumerate(runs):
                for j, other in enumerate(ordered):
                    if i != j:
                        at = np.minimum(np.searchsorted(other, keys[mine]), len(other) - 1)
                        hit[mine] |= other[at] == keys[mine]
            yield batch.filter(pa.array(hit)).select(["anchor", "digest", "lo", "hi", "of"])

    def batches_by_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows cut only between different windows."""
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([b for b in (rest, batch) if b is not None]).combine_chunks().to_batches()
            if not whole:
                continue
            window = whole[0].column("window").to_numpy()
            cut = int(np.searchsorted(window, window[-1]))
            if cut:
                yield whole[0].slice(0, cut)
            rest = whole[0].slice(cut)
        if rest is not None and rest.num_rows:
            yield rest

    runs = found.where("window is not null").repartition("anchor", "window").sortWithinPartitions("window")
    return runs.mapInArrow(search, "anchor long, digest long, lo int, hi int, of int")


def repeated_spans(docs: DataFrame, min_bytes: int | Sequence[int] = MIN_BYTES, shard: int = SHARD, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, spans): for texts with repeats, their byte ranges [lo, hi) in any order; they may overlap.

    ``min_bytes`` may be several lengths; a range says which it is ``of``.
    """
    lengths = sorted({min_bytes} if isinstance(min_bytes, int) else set(min_bytes))
    reach = lengths[-1]
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    every = materialize(segments(named, lengths[0], reach), "segments")
    anchors = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), F.min("digest").alias("_lo"), F.max("digest").alias("_hi")).where("_n > 1")
    # written, so that the join deals both sides anew and Spark can split an anchor that very many segments share
    anchors = materialize(anchors.select(F.col("anchor").alias("_anchor"), (F.col("_lo") != F.col("_hi")).alias("mixed")), "anchors")
    repeated = materialize(every.join(anchors, F.col("anchor") == F.col("_anchor")).drop("_anchor"), "repeated")
    discard(every)
    # starts of a length: those that have as many bytes before the text's end
    ranges = [F.struct(F.col("at").alias("lo"), (F.col("at") + F.least(F.col("n") - 1 + k, "size")).alias("hi"), F.lit(k).alias("of")) for k in lengths]
    whole = repeated.where("not mixed").select("doc_id", "text_hash", F.inline(F.array(*ranges))).where("hi - lo >= of")

    distinct = repeated.where("mixed").groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash", "at", "n", "size")).alias("one"))
    distinct = materialize(distinct.select("anchor", "digest", "copies", "one.*"), "distinct")
    discard(anchors)
    sizes = distinct.groupBy("anchor").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > hot)
    sizes = sizes.select(F.col("anchor").alias("_anchor"), F.ceil(F.col("bytes") / (hot / 2)).cast("int").alias("parts"))
    dealt = distinct.join(sizes, F.col("anchor") == F.col("_anchor"), "left").drop("_anchor")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"), F.lit(-1)))
    wanted = dealt.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("anchor", "digest", "at", "n", "size", "copies", "part")).alias("cuts"))
    cut = named.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select(F.col("text").cast("binary").alias("text"), F.explode("cuts").alias("c"))
    content = F.substring("text", (F.col("c.at") + 1).cast("int"), F.col("c.size"))
    rows = cut.select("c.*", content.alias("content")).repartition("anchor", "part").sortWithinPartitions("anchor", "part", "digest")
    found = materialize(_repeats(rows, lengths, shard), "repeats")
    discard(distinct)
    verdict = found.where("window is null").select("anchor", "digest", "lo", "hi", "of").union(_merged(found))
    verdict = verdict.select(F.col("anchor").alias("_anchor"), F.col("digest").alias("_digest"), "lo", "hi", "of")
    part = repeated.where("mixed").join(verdict, (F.col("anchor") == F.col("_anchor")) & (F.col("digest") == F.col("_digest")))
    part = part.select("doc_id", "text_hash", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi") + F.col("of")).alias("hi"), "of")
    spans = whole.union(part).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("lo", "hi", "of")).alias("spans"))
    spans = materialize(spans, "spans")  # so that all before is gone when texts are dealt out to meet them
    discard(repeated, found)
    return spans


def _ranges(spans: pa.ListArray) -> Iterator[list[tuple[int, int, int]]]:
    """(lo, hi, of) of every row's spans."""
    lo, hi, of = (c.to_numpy().tolist() for c in spans.flatten().flatten())
    at = 0
    for k in pc.fill_null(pc.list_value_length(spans), 0).to_pylist():
        yield list(zip(lo[at : at + k], hi[at : at + k], of[at : at + k], strict=True))
        at += k


def _runs(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """Maximal runs: spans that overlap or touch are one."""
    runs: list[list[int]] = []
    for lo, hi, _ in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    return runs


def _with_spans(docs: DataFrame, min_bytes: int | Sequence[int]) -> tuple[DataFrame, str]:
    """The documents and their spans, and the name of the column that has them."""
    own, other, of, named = fresh_names(docs, "_id", "_hash", "_text_hash", "_spans")
    spans = repeated_spans(docs, min_bytes).withColumnsRenamed({"doc_id": own, "text_hash": other, "spans": named})
    hashed = docs.withColumn(of, F.xxhash64("text"))
    joined = hashed.join(spans, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(of) == F.col(other)), "left")
    return joined.select(*docs.columns, named), named


def removal_report(docs: DataFrame, min_bytes: int = MIN_BYTES, passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept_chars) per document; the last counts the characters whose first byte is left.

    With ``passage``, n_passage_bytes follows: the bytes covered by a string of
    that length that starts elsewhere too. They are counted, not removed.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept_chars long" + ", n_passage_bytes long" * (passage is not None)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), _ranges(batch.column(2)), strict=True):
                text, runs = text.as_py() or b"", _runs([s for s in spans if s[2] == min_bytes])
                kept, at, chars = hashlib.sha256(), 0, 0
                for lo, hi in [*runs, (len(text), len(text))]:
                    kept.update(text[at:lo])
                    chars += len(text[at:lo].translate(None, _INNER))
                    at = hi
                shared = sum(hi - lo for lo, hi in _runs([s for s in spans if s[2] == passage]))
                rows.append((len(text), sum(hi - lo for lo, hi in runs), len(runs), kept.hexdigest(), chars, shared))
            columns = [pa.array([r[i] for r in rows], pa.string() if i == 3 else pa.int64()) for i in range(5 + (passage is not None))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [c.split()[0] for c in schema.split(", ")])

    found, named = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_bytes if passage is None else (min_bytes, passage))
    sent = found.select("doc_id", F.col("text").cast("binary").alias("text"), named)
    return sent.mapInArrow(report, schema)


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The documents with all columns; ``text`` loses every repeated byte, but no part of a character.

    A document of which nothing but white space would be left is dropped, if
    something was removed from it. ``n_chars`` follows the text, if it is there.
    """
    names = docs.columns
    joined, _ = _with_spans(docs, min_bytes)
    place = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, spans in zip(batch.column(place), _ranges(batch.column(len(names))), strict=True):
                text, runs = text.as_py(), _runs(spans)
                if not runs:
                    texts.append(text)
                    keep.append(True)
                    continue
                data, at, kept = text.encode(), 0, []
                for lo, hi in runs:
                    while lo < len(data) and data[lo] & 0xC0 == 0x80:
                        lo += 1
                    while hi < len(data) and data[hi] & 0xC0 == 0x80:
                        hi -= 1
                    if hi > lo:
                        kept.append(data[at:lo])
                        at = hi
                kept.append(data[at:])
                texts.append(b"".join(kept).decode())
                keep.append(bool(texts[-1].strip()))
            columns = [pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    out = joined.mapInArrow(cut, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
