"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

A text's fingerprint takes, bit by bit, the majority of the XXH64 hashes
(seed 42) of its word shingles. Equal fingerprints are merged first. Two
fingerprints within ``radius`` bits agree wholly on at least two of
``radius + 2`` bit blocks, so each one is dealt to a bucket for every pair of
blocks; a bucket's members, sorted by population count, are compared tile by
tile in numpy, and tile pairs whose population counts differ beyond the radius
are skipped. A bucket beyond ``unit`` members is dealt over several tasks as
pairs of parts. Every bucket reports a spanning forest of its links, never all
pairs, and the forests are joined into components.

Defined results: a text that is null or has no word has fingerprint 0 and links
like any other; fewer words than a shingle make one shingle of them all; an
exact half is a 0 bit. Repeated rows stay in the output, each with its component;
an empty table gives no rows; very long texts are hashed in blocks. Other columns,
whatever their names, are carried along by :func:`one_of_each`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, fresh_names, giving_back, materialize, small_batches
from .components import connected_components

SEED = 42
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLOCK = 1 << 15
_TILE = 256
_SMALL = 48
_HELD = 1 << 20
_SLOTS = 128
_FINE = 512
_LEVELS = 3
_PLANES = _FINE * _LEVELS // 8
_DENSE = 2
_OUT = 1 << 16
_CHUNK = 1 << 14
_NEAREST = 4
_PART = 1 << 13
_PARTS = 8
_FEW = 512


def _hashes(text: bytes | None, words_each: int) -> list[int]:
    words = text.lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words[:-1]), initial=0))
    ends = [a + len(w) for a, w in zip(starts, words, strict=True)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :], strict=False)] or [digest(joined, SEED)]


def _fingerprint(hashes: list[int] | np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = np.array(hashes[at : at + _BLOCK], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_each: int = 4, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if none are named) and ``fingerprint``, a long of 64 bits."""
    names = [c for c in (docs.columns if keep is None else keep) if c != "fingerprint"]
    sent = docs.select(*names, F.col(text).cast("binary").alias("_text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((_fingerprint(_hashes(x.as_py(), words_each)) for x in batch.column(len(names))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found.view(np.int64))], [*names, "fingerprint"])

    return sent.mapInArrow(hashed, docs.select(*names).withColumn("fingerprint", F.lit(0).cast("long")).schema)


def _planes(hashes: np.ndarray) -> bytes:
    """Bits that tell which of ``_FINE`` slots hold one shingle at least, two at least, and so on to ``_LEVELS``."""
    counts = np.bincount((hashes // _SLOTS % _FINE).astype(np.int64), minlength=_FINE)
    return np.packbits(counts >= np.arange(1, _LEVELS + 1)[:, None]).tobytes()


def _sketched(named: DataFrame, words_each: int) -> DataFrame:
    """doc_id, text_hash, fingerprint of the distinct shingles, ``counts``, how many of them fall into each of ``_SLOTS`` slots, and their ``planes``.

    Repeats of a shingle do not count, as they don't in the similarity that candidates are held to. Two texts share no more shingles than the lesser
    counts of all slots sum up to, nor more than the bits that their planes share and the lesser of what goes beyond either's planes.
    """
    sent = named.select("doc_id", "text_hash", F.col("text").cast("binary").alias("_text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.zeros(batch.num_rows, np.uint64)
            counts = np.zeros((batch.num_rows, _SLOTS), np.int32)
            planes: list[bytes] = []
            for i, x in enumerate(batch.column(2)):
                hashes = np.unique(np.array(_hashes(x.as_py(), words_each), np.uint64))
                prints[i] = _fingerprint(hashes)
                hashes = hashes if len(hashes) else np.zeros(1, np.uint64)  # a text without words has one shingle of none
                counts[i] = np.bincount((hashes % _SLOTS).astype(np.int64), minlength=_SLOTS)
                planes.append(_planes(hashes))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * _SLOTS), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints.view(np.int64)), lists, pa.array(planes, pa.binary())], ["doc_id", "text_hash", "fingerprint", "counts", "planes"])

    schema = named.select("doc_id", "text_hash", F.lit(0).cast("long").alias("fingerprint"), F.array(F.lit(0)).alias("counts"), F.lit("").cast("binary").alias("planes")).schema
    return sent.mapInArrow(lambda batches: giving_back(hashed(batches)), schema)


def as_hex(column: str):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def _span(size: int, a: np.ndarray, b: np.ndarray, far: np.ndarray, times: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the links that connect what all of them connect, taking links of fewer bits first; and as often again, of the links that are left."""
    kept, rest = [np.zeros(0, np.int64)], np.arange(len(a))
    for _ in range(times):
        label = np.arange(size)
        taken = [np.zeros(0, np.int64)]
        for bits in np.unique(far[rest]):
            at = rest[far[rest] == bits]
            while True:
                la, lb = label[a[at]], label[b[at]]
                at, high, low = at[la != lb], np.maximum(la, lb)[la != lb], np.minimum(la, lb)[la != lb]
                if not len(at):
                    break
                roots, first = np.unique(high, return_index=True)  # each root is tied to one smaller root
                taken.append(at[first])
                label[roots] = low[first]
                while (label != (up := label[label])).any():
                    label = up
        kept += taken
        rest = np.setdiff1d(rest, np.concatenate(taken), assume_unique=True)
    kept = np.concatenate(kept)
    return a[kept], b[kept], far[kept]


def _forest(values: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each group, all members within ``radius`` of one another; groups are contiguous."""
    counts = np.bitwise_count(values).astype(np.int16)
    order = np.lexsort((counts, groups))
    values, groups, counts = values[order], groups[order], counts[order]
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[starts[1:], len(groups)]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def add(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal held, found
        if len(a):
            found.append((a, b, np.bitwise_count(values[a] ^ values[b])))
            held += len(a)
        if held > _HELD:  # the forest of a forest and more links is the forest of all
            found = [_span(len(values), *(np.concatenate(x) for x in zip(*found, strict=True)))]
            held = 0

    end_of = np.repeat(ends, ends - starts)
    rows = np.flatnonzero(np.repeat(ends - starts, ends - starts) <= _SMALL)
    for gap in range(1, _SMALL):
        rows = rows[rows + gap < end_of[rows]]
        if not len(rows):
            break
        near = rows[counts[rows + gap] - counts[rows] <= radius]
        near = near[np.bitwise_count(values[near] ^ values[near + gap]) <= radius]
        add(near, near + gap)
    for lo, hi in zip(starts, ends, strict=True):
        if hi - lo <= _SMALL:
            continue
        for i in range(lo, hi, _TILE):
            for j in range(i, hi, _TILE):
                if counts[j] - counts[min(i + _TILE, hi) - 1] > radius:
                    break
                x, y = np.nonzero(np.bitwise_count(values[i : min(i + _TILE, hi), None] ^ values[None, j : min(j + _TILE, hi)]) <= radius)
                apart = x + i < y + j
                add(x[apart] + i, y[apart] + j)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, _ = _span(len(values), *(np.concatenate(x) for x in zip(*found, strict=True)))
    return values[a].view(np.int64), values[b].view(np.int64)


def links(distinct: DataFrame, radius: int = 4, unit: int = 8192, column: str = "fingerprint") -> DataFrame:
    """(a, b): pairs of fingerprints within ``radius`` bits whose components are those of all such pairs."""
    cuts = np.linspace(0, 64, radius + 3).round().astype(int)
    value = F.col(column)

    def block(k: int):
        return F.shiftrightunsigned(value, int(cuts[k])).bitwiseAND((1 << int(cuts[k + 1] - cuts[k])) - 1)

    keys = [F.shiftleft(F.shiftleft(block(i), 16) + block(j), 8) + n for n, (i, j) in enumerate(combinations(range(radius + 2), 2))]
    dealt = distinct.select(value.alias("v"), F.explode(F.array(*keys)).alias("k"))
    large = dealt.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > unit).select(F.col("k").alias("_k"), F.ceil(F.col("n") / unit).cast("int").alias("parts"))
    dealt = dealt.join(large, F.col("k") == F.col("_k"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")
    other = F.explode(F.expr("sequence(0, parts - 1)"))
    dealt = dealt.withColumn("own", own).select("v", "k", "own", other.alias("other"))
    dealt = dealt.select("v", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    together = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def out(x: np.ndarray) -> pa.RecordBatch:
            change = np.any(x[1:, 1:] != x[:-1, 1:], axis=1)
            a, b = _forest(np.ascontiguousarray(x[:, 0]).view(np.uint64), np.r_[0, np.cumsum(change)], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            held.append(x)
            rows += len(x)
            if rows < 50_000:
                continue
            x = np.concatenate(held)
            last = np.flatnonzero(np.any(x[:, 1:] != x[-1, 1:], axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on
            if cut:
                yield out(x[:cut])
            held, rows = [x[cut:]], len(x) - cut
        if rows:
            yield out(np.concatenate(held))

    return together.mapInArrow(compare, "a long, b long")


def _packed(counts: pa.Array, planes: pa.Array) -> np.ndarray:
    """Rows of a total, planes and ``_SLOTS`` bytes: slot counts, 255 and more as 255; the total is 0 where they are null."""
    out = np.zeros((len(counts), 8 + _PLANES + _SLOTS), np.uint8)
    known = np.flatnonzero(counts.is_valid().to_numpy(zero_copy_only=False))
    if len(known):
        slots = counts.drop_null().flatten().to_numpy().reshape(len(known), _SLOTS)
        out[known, :8] = np.ascontiguousarray(slots.sum(axis=1, dtype=np.int64)).view(np.uint8).reshape(-1, 8)
        out[known, 8:-_SLOTS] = np.frombuffer(b"".join(planes.take(pa.array(known)).to_pylist()), np.uint8).reshape(len(known), _PLANES)
        out[known, -_SLOTS:] = np.minimum(slots, 255)
    return out


def _room(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of packed rows, the most shingles that either pair can share, and how many both have; -1 where one of them is not known."""
    (ta, pa_, sa), (tb, pb, sb) = ((np.ascontiguousarray(z[:, :8]).view(np.int64).ravel(), np.ascontiguousarray(z[:, 8:-_SLOTS]).view(np.uint64), z[:, -_SLOTS:]) for z in (x, y))

    def bits(planes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(planes).sum(axis=1, dtype=np.int64)

    least = np.minimum(sa, sb)
    most = bits(pa_ & pb) + np.minimum(ta - bits(pa_), tb - bits(pb))
    most = np.where((least == 255).any(axis=1), most, np.minimum(most, least.sum(axis=1, dtype=np.int64)))
    return np.where((ta == 0) | (tb == 0), -1, most), ta + tb


def _likely(packed: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of packed rows leave room for the similarity, and in thousandths how far from one each may be; 0 if not known."""
    fits, far = [np.zeros(0, bool)], [np.zeros(0, np.int64)]
    for at in range(0, len(a), _CHUNK):
        most, both = _room(packed[a[at : at + _CHUNK]], packed[b[at : at + _CHUNK]])
        fits.append((most < 0) | (most >= similarity * (both - most)))
        far.append(np.where(most < 0, 0, 1000 - 1000 * most // np.maximum(both - most, 1)))
    return np.concatenate(fits), np.concatenate(far)


def _longs(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)


def _own_part(v: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    return (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts


def _counts(values: DataFrame, keys: Callable[[np.ndarray], np.ndarray], held: int = 1 << 18) -> DataFrame:
    """(k, n): how many of the longs have a key, a row a key and task as long as a task has at most ``held`` keys; tasks are no more than cores, however many parts the input comes in."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            more, times = np.unique(keys(_longs(batch, 0)), return_counts=True)
            k, at = np.unique(np.concatenate([k, more]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, times]), len(k)).astype(np.int64)
            if len(k) > held:
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])
                k, n = k[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])

    return values.coalesce(values.sparkSession.sparkContext.defaultParallelism).mapInArrow(counted, "k long, n long")


def _gathered(batch: pa.RecordBatch, job: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    """A row a job: of each column the values of the job's rows, joined to one array of bytes."""
    order = np.argsort(job, kind="stable")
    job, row = job[order], row[order]
    starts = np.flatnonzero(np.r_[True, job[1:] != job[:-1]])
    ends = np.r_[starts, len(job)]

    def one_set(values: np.ndarray, width: int) -> pa.Array:
        offsets = pa.py_buffer((ends * width).astype(np.int32).tobytes())
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(values[row].tobytes())])

    sets = [one_set(_longs(batch, i), 8) for i in range(min(batch.num_columns, 3))]
    if batch.num_columns > 3:
        sets.append(one_set(_packed(batch.column(3), batch.column(4)), 8 + _PLANES + _SLOTS))
    return pa.RecordBatch.from_arrays([pa.array(job[starts]), *sets], ["job", "v", "l", "i", "c"][: len(sets) + 1])


def _jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Of rows of :func:`_gathered` sorted by job, each job and its arrays."""
    job, held = None, []
    for batch in batches:
        sets = [batch.column(i) for i in range(1, batch.num_columns)]
        for r, at in enumerate(batch.column(0).to_pylist()):
            if at != job and held:
                yield job, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            job = at
            held.append([np.frombuffer(x[r].as_buffer(), np.uint8).reshape(-1, 8 + _PLANES + _SLOTS) if i == 3 else np.frombuffer(x[r].as_buffer(), np.uint64) for i, x in enumerate(sets)])
    if held:
        yield job, [np.concatenate(x) for x in zip(*held, strict=True)]


def _compared(dealt: DataFrame, pairs: Callable[..., Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]]) -> DataFrame:
    """(a, b, open, far): what ``pairs`` finds in each job."""

    def out(found: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]) -> pa.RecordBatch:
        marks = np.concatenate([np.full(len(a), mark) for a, _, _, mark in found])
        far = np.concatenate([x[2] for x in found]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([x[i] for x in found]).view(np.int64)) for i in (0, 1)), pa.array(marks), pa.array(far)], ["a", "b", "open", "far"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = [], 0
        for job, sets in _jobs(batches):
            if len(sets[0]) < 2:
                continue
            for x in pairs(job, *sets):
                found.append(x)
                rows += len(x[0])
                if rows > _OUT:
                    yield out(found)
                    found, rows = [], 0
        if found:
            yield out(found)

    return dealt.repartition("job").sortWithinPartitions("job").mapInArrow(lambda batches: giving_back(compare(batches)), "a long, b long, open boolean, far int")


def candidates(distinct: DataFrame, radius: int, unit: int = 1 << 16, column: str = "fingerprint", label: str | None = None, similarity: float = 0.0, forest: bool = False, name: str | None = None) -> DataFrame:
    """(a, b, open, far): pairs of fingerprints within ``radius`` bits, each once: in the first bucket that holds both.

    Without ``label``, a bucket with more than ``_DENSE`` pairs a member gives a
    spanning forest of them, marked as open: all other pairs of the bucket are
    between fingerprints of open pairs. A task deals its rows as one array a bucket; buckets beyond ``unit``
    members are dealt as pairs of parts. With ``label`` see :func:`_crowd`. ``far`` is in bits.
    """
    if label is not None:
        return _crowd(distinct, radius, min(unit, _PART), column, label, similarity, forest, name or column)
    cuts = np.linspace(0, 64, radius + 3).round().astype(int)
    shift, mask = cuts[:-1].astype(np.uint64), (np.uint64(1) << np.diff(cuts).astype(np.uint64)) - np.uint64(1)
    first, second = np.array(list(combinations(range(radius + 2), 2))).T
    half = int(np.diff(cuts).max())

    def keys(v: np.ndarray) -> np.ndarray:
        blocks = (v[:, None] >> shift & mask).astype(np.int64)
        return (np.arange(len(first)) << 2 * half | blocks[:, first] << half | blocks[:, second]).ravel()

    sent = distinct.select(F.col(column).alias("v"))
    sizes = _counts(sent, keys).groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > unit)
    large = sorted((r["k"], min(1023, -(-r["n"] // unit))) for r in sizes.collect())  # buckets are as many as there are keys, whatever the input
    large_keys, large_parts = np.array([k for k, _ in large], np.int64), np.array([n for _, n in large], np.int64)

    def parts_of(k: np.ndarray) -> np.ndarray:
        if not len(large_keys):
            return np.ones(len(k), np.int64)
        at = np.minimum(np.searchsorted(large_keys, k), len(large_keys) - 1)
        return np.where(large_keys[at] == k, large_parts[at], 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _longs(batch, 0)
            k, row = keys(v), np.repeat(np.arange(len(v)), len(first))
            parts = parts_of(k)
            own = _own_part(v[row], parts)
            jobs, rows = [], []
            for other in range(parts.max(initial=0)):
                at = np.flatnonzero(parts > other)
                jobs.append(k[at] << 20 | np.minimum(own[at], other) << 10 | np.maximum(own[at], other))
                rows.append(row[at])
            if jobs:
                yield _gathered(batch, np.concatenate(jobs), np.concatenate(rows))

    def pairs(job: int, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        k, i, j = job >> 20, job >> 10 & 1023, job & 1023
        n = k >> 2 * half
        own = _own_part(v, int(parts_of(np.array([k]))[0])) if i != j else None
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, dense = 0, False
        for lo in range(0, len(v), _TILE):
            a, b = np.nonzero(np.bitwise_count(v[lo : lo + _TILE, None] ^ v[None, lo:]) <= radius)
            a, b = a[a < b] + lo, b[a < b] + lo
            if own is not None:
                a, b = a[own[a] != own[b]], b[own[a] != own[b]]
            if not len(a):
                continue
            alike = ((v[a] ^ v[b])[:, None] >> shift & mask) == 0
            one = alike.argmax(axis=1)
            alike[np.arange(len(a)), one] = False
            here = (one == first[n]) & (alike.argmax(axis=1) == second[n])
            a, b = a[here], b[here]
            found.append((a, b, np.bitwise_count(v[a] ^ v[b]).astype(np.int64)))
            held += len(a)
            if held > _HELD:  # the forest of a forest and more links is the forest of all
                found, held, dense = [_span(len(v), *(np.concatenate(x) for x in zip(*found, strict=True)))], 0, True
        if found:
            a, b, far = (np.concatenate(x) for x in zip(*found, strict=True))
            if dense or len(a) > _DENSE * len(np.unique(np.r_[a, b])):
                a, b, far = _span(len(v), a, b, far)
                dense = True
            yield v[a], v[b], far, dense

    dealt = sent.mapInArrow(lambda batches: deal(small_batches(batches, 1 << 18)), "job long, v binary")
    return _compared(dealt, pairs)


def _crowd(distinct: DataFrame, radius: int, unit: int, column: str, label: str, similarity: float, forest: bool, name: str) -> DataFrame:
    """(a, b, open, far): every pair within ``radius`` bits whose labels differ, once, by the long that ``name`` tells.

    Pairs whose ``counts`` and ``planes`` (if the rows have them; null: not known) leave no room for ``similarity`` are left out: most pairs
    of a large group go where they are met. With ``forest`` spanning forests of these come, of those first that may be most alike.
    ``far`` is in bits, or where counts are known, in thousandths of unlikeness.

    Members of a crowd share most of their bits, and so most of the buckets that fingerprints agree on: dealt by buckets, each would
    move, and each pair meet, some hundred times. So rows are dealt over parts of at most about ``unit``, and each pair of
    parts is a job, in which every pair of rows meets once.
    """
    known = "counts" in distinct.columns
    sent = distinct.select(F.col(column).alias("v"), F.col(label).alias("l"), F.col(name).alias("i"), *([F.col("counts").alias("c"), F.col("planes").alias("p")] if known else []))
    rows = sent.count()
    parts = max(1, -(-rows // unit), min(_PARTS, -(-rows // _FEW)))
    times = -(-_PARTS // (2 * parts))  # with more parts, a row is in the forests of more jobs

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, other = np.repeat(np.arange(batch.num_rows), parts), np.tile(np.arange(parts), batch.num_rows)
                own = _own_part(_longs(batch, 2), parts)[row]
                yield _gathered(batch, np.minimum(own, other) * parts + np.maximum(own, other), row)

    def pairs(job: int, v: np.ndarray, labels: np.ndarray, ids: np.ndarray, packed: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        i, j = divmod(job, parts)
        own = _own_part(ids, parts)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for lo in range(0, len(left), _TILE):
            here, there = left[lo : lo + _TILE], right[lo if i == j else 0 :]
            a, b = np.nonzero(np.bitwise_count(v[here][:, None] ^ v[there]) <= radius)
            if i == j:
                a, b = a[a < b], b[a < b]
            a, b = here[a], there[b]
            a, b = a[labels[a] != labels[b]], b[labels[a] != labels[b]]
            far = np.bitwise_count(v[a] ^ v[b]).astype(np.int64)
            if packed is not None:
                fits, far = _likely(packed, a, b, similarity)
                a, b, far = a[fits], b[fits], far[fits]
            if not forest:
                yield ids[a], ids[b], far, False
                continue
            found.append((a, b, far))
            held += len(a)
            if held > _HELD:  # the forests of forests and more links are forests of all
                found, held = [_span(len(v), *(np.concatenate(x) for x in zip(*found, strict=True)), times)], 0
        if found:
            a, b, far = _span(len(v), *(np.concatenate(x) for x in zip(*found, strict=True)), times)
            yield ids[a], ids[b], far, True

    dealt = sent.mapInArrow(lambda batches: deal(small_batches(batches, max(1 << 16, (1 << 25) // parts))), "job long, v binary, l binary, i binary" + (", c binary" if known else ""))
    return _compared(dealt, pairs)


def near_duplicates(docs: DataFrame, words_each: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id) per document: the smallest doc_id reachable over links, itself included.

    ``text_hash`` tells rows of one doc_id apart. A component whose doc_ids are all null has a null id.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    narrow = materialize(fingerprints(named, words_each, keep=["doc_id", "text_hash"]), "fingerprints")
    distinct = narrow.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    nodes = connected_components(links(distinct, radius)).withColumnRenamed("node", "fingerprint")
    linked = distinct.join(nodes, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    found = linked.select("fingerprint", "component").join(least, "component").select("fingerprint", "component_id")
    return narrow.join(found, "fingerprint").select("doc_id", "text_hash", "fingerprint", "component_id")


def _with_shingles(df: DataFrame, words_each: int) -> DataFrame:
    """Adds ``s``: distinct hashes of a text's word shingles (32 bits: sets are what moves most), of all words if they are fewer.

    The words stand in a column of their own: inside the lambda they would be cut anew for every shingle.
    """
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower()), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.greatest(F.size("_w") - words_each, F.lit(0))
    return df.withColumn("s", F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.hash(*[F.get("_w", i + k) for k in range(words_each)])))).drop("_w")


def _ends(pairs: DataFrame, name: str) -> DataFrame:
    """Both ends of pairs (a, b), each once: either side is made distinct before they meet."""
    return pairs.select(F.col("a").alias(name)).distinct().union(pairs.select(F.col("b").alias(name)).distinct()).distinct()


def _true_pairs(pairs: DataFrame, held: DataFrame, words_each: int, similarity: float, texts: DataFrame | None = None) -> DataFrame:
    """Those of the pairs (a, b) of text hashes whose shingles have a Jaccard similarity of ``similarity``; ``held`` has the texts.

    With ``texts``, pairs go before any text moves if even all shingles that their slots could share are too few.
    """
    def joined(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
        both = left.join(right.select(F.col("text_hash").alias("a"), F.col(column).alias("sa")), "a")
        return both.join(right.select(F.col("text_hash").alias("b"), F.col(column).alias("sb")), "b")

    def enough(shared, all_a, all_b):
        return shared >= similarity * (all_a + all_b - shared)

    def total(counts):
        return F.aggregate(counts, F.lit(0), lambda x, y: x + y)

    likely = pairs
    if texts is not None:
        most = total(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)))
        likely = materialize(joined(pairs, texts, "counts").where(enough(most, total(F.col("sa")), total(F.col("sb")))).select("a", "b"), "candidates")
    wanted = _ends(likely, "text_hash")
    shingled = materialize(_with_shingles(held.join(wanted, "text_hash", "left_semi"), words_each).select("text_hash", "s"), "shingles")
    shared = F.size(F.array_intersect("sa", "sb"))
    alike = materialize(joined(likely, shingled, "s").where(enough(shared, F.size("sa"), F.size("sb"))).select("a", "b"), "alike")
    discard(shingled, *([likely] if texts is not None else []))
    return alike


def _nearest(near: DataFrame, k: int = _NEAREST) -> DataFrame:
    """Of links, those among the k nearest of either end: what ties a large group together, mostly.

    The forests of a large group's many buckets have far more; those left out
    come after, if they are between groups that are still apart.
    """
    kept = [near.withColumn("r", F.row_number().over(Window.partitionBy(end).orderBy("far", "a", "b"))).where(F.col("r") <= k).select("a", "b") for end in "ab"]
    return kept[0].union(kept[1]).distinct()


def similar_groups(docs: DataFrame, words_each: int = 5, radius: int = 14, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, component_id) per document: groups of texts whose shingles are alike.

    Pairs within ``radius`` bits are candidates, and those with a Jaccard similarity
    of word shingles below ``similarity`` go. About one pair in twenty of just that
    similarity lies beyond 14 bits and is lost, of closer pairs fewer. Of buckets with very many pairs, those
    that connect it and may be most alike are compared first; then all pairs of theirs that may be
    alike and are not in one group yet. Of texts that share a fingerprint the first goes before;
    then each meets all of its own and of near fingerprints that are not in one group with it.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    narrow = materialize(_sketched(named, words_each), "fingerprints")
    texts = materialize(narrow.groupBy("fingerprint", "text_hash").agg(F.min("doc_id").alias("least"), F.first("counts").alias("counts"), F.first("planes").alias("planes")), "texts")
    first = texts.groupBy("fingerprint").agg(F.min("text_hash").alias("first"))

    def of_texts(near: DataFrame) -> DataFrame:
        named_a, named_b = (first.select(F.col("fingerprint").alias(c), F.col("first").alias(f"f{c}")) for c in "ab")
        return near.join(named_a, "a").join(named_b, "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))

    same = texts.join(first, "fingerprint").where("text_hash <> first").select(F.col("text_hash").alias("a"), F.col("first").alias("b"))
    near = materialize(candidates(first, radius), "near")
    # the texts of all candidates move once, one row a text
    found = _ends(near, "fingerprint").union(texts.join(first, "fingerprint").where("text_hash <> first").select("fingerprint")).distinct()
    wanted = texts.join(found, "fingerprint", "left_semi").select("text_hash")
    held = materialize(named.join(wanted, "text_hash", "left_semi").groupBy("text_hash").agg(F.min("text").alias("text")), "texts")
    crowded = _ends(near.where("open"), "fingerprint")
    members = first.join(crowded, "fingerprint").join(texts.select("fingerprint", F.col("text_hash").alias("first"), "counts", "planes"), ["fingerprint", "first"])
    ties = candidates(members, radius, label="first", similarity=similarity, forest=True, name="first")
    true = _true_pairs(same.union(of_texts(near.where("not open"))).union(_nearest(ties)), held, words_each, similarity, texts)
    nodes = connected_components(true).withColumnRenamed("node", "text_hash")
    labelled = texts.join(nodes, "text_hash", "left").withColumn("label", F.coalesce("component", "text_hash"))
    # what has not been compared: all pairs of dense buckets, and of texts that are not their fingerprint's first
    many = texts.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    either = [near.where("not open").join(many.withColumnRenamed("fingerprint", x), x, "left_semi").select(F.col(y).alias("fingerprint")) for x, y in ("ab", "ba")]
    again = crowded.union(many).union(either[0]).union(either[1]).distinct()
    rest = candidates(labelled.join(again, "fingerprint", "left_semi"), radius, label="label", similarity=similarity, name="text_hash")
    rest = materialize(rest.select("a", "b"), "apart")
    discard(near)
    if not rest.isEmpty():
        true = true.union(_true_pairs(rest, held, words_each, similarity))
        nodes = connected_components(true).withColumnRenamed("node", "text_hash")
    discard(rest, held)
    linked = texts.join(nodes, "text_hash", "left").withColumn("component", F.coalesce("component", "text_hash"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    found = linked.select("text_hash", "component").join(least, "component").select("text_hash", "component_id")
    return narrow.join(found, "text_hash").select("doc_id", "text_hash", "component_id")


def one_of_each(docs: DataFrame, words_each: int = 5, radius: int = 14, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest doc_id, with all its columns."""
    found = similar_groups(docs, words_each, radius, similarity)
    own, other, of = fresh_names(docs, "_id", "_hash", "_text_hash")
    best = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own), F.col("text_hash").alias(other)).distinct()
    # repeated rows of one doc_id: the least text stays; rows without an id stand for themselves
    best = best.groupBy(own, F.when(F.col(own).isNull(), F.col(other)).alias("alone")).agg(F.min(other).alias(other)).drop("alone")
    kept = docs.withColumn(of, F.xxhash64("text")).join(best, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(of) == F.col(other)))
    return kept.dropDuplicates([own, other]).select(*docs.columns)
