"""Vector code compression: product codes by exact k-means over Hilbert-sorted flat blocks.

Vectors of whole numbers are cut into ``PARTS`` equal consecutive parts; each part
position has a codebook of up to ``ENTRIES`` entries.

1. Blocks. A task gathers ``CHUNK`` vectors at a time. For each part position it sorts
   their parts along a Hilbert curve and cuts them into flat blocks of ``BLOCK``, each
   with the smallest and largest value by place (its box) and its sums. Chunks are rows
   of a written table, so nothing is shuffled and a lost executor rereads its chunks.
2. Rounds. The distances of a block's box to the entries leave a shortlist: an entry
   goes if its nearest point of the box is farther than another's farthest, or if it is
   farther than the entry nearest to the block's mean all over the box. A block with one
   entry left adds its stored sums unread; in others, rows meet the shortlist alone, in
   whole numbers. Only sums by entry leave a task.
3. Codes. The last round gives each row its entries, back in the order of the chunk.

Defined results: see :mod:`skirmish.llm.vectors` for the vectors that take part; a
width that is no multiple of ``PARTS`` is filled up with zeros. First entries are the
parts of the smallest ids (null ids last; equal ids by their vectors); fewer vectors
than entries give fewer entries. Ties go to the lower index; unused entries stay. Equal
labels, nulls among themselves, share label_error. A sum beyond 64 bits is null. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, materialize
from .vectors import exact_sums, halves, matrix, rows_at_a_time, spans, whole

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
CHUNK = 8192
BLOCK = 32
_LONG = 1 << 63

Codebooks = list[list[list[int]]]


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Places along a Hilbert curve through the box of ``points``, by exclusive-or and bit swaps of Skilling's transform."""
    n, dims = points.shape
    dims = min(dims, 62)
    if not n or not dims:
        return np.zeros(n, np.uint64)
    bits = min(16, 62 // dims)
    low = points[:, :dims].min(axis=0).astype(np.float64)
    wide = np.maximum(points[:, :dims].max(axis=0).astype(np.float64) - low, 1.0)
    cells = 1 << bits
    x = np.minimum((points[:, :dims].astype(np.float64) - low) / wide * cells, cells - 1).astype(np.uint64).T.copy()
    for bit in reversed(range(1, bits)):
        q, below = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for i in range(dims):
            swap = np.where(x[i] & q, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(x[i] & q, below, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.uint64)
    for bit in reversed(range(1, bits)):
        turn ^= np.where(x[-1] & np.uint64(1 << bit), np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(n, np.uint64)
    for bit in reversed(range(bits)):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return key


def blocks(vectors: DataFrame, width: int, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """One row a chunk: its ids and labels in order and, for the part positions one after the other, order, parts, boxes and sums of the blocks."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, chunk):
            n = batch.num_rows
            parts = np.ascontiguousarray(matrix(batch.column(2), width).reshape(n, PARTS, -1).transpose(1, 0, 2))
            order = np.stack([np.argsort(hilbert_keys(p), kind="stable") for p in parts])
            parts = np.take_along_axis(parts, order[:, :, None], axis=1)
            firsts = np.arange(0, n, block)
            flat = [order.astype(np.int32), parts, np.minimum.reduceat(parts, firsts, axis=1), np.maximum.reduceat(parts, firsts, axis=1)]
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(i)) for i in (0, 1)]
            kind = spans(int(max(abs(int(parts.min())), abs(int(parts.max())))) * block)
            sums = np.add.reduceat(parts.astype(kind), firsts, axis=1)
            high, low = halves(sums.ravel())
            sums = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (high, low)]
            yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in flat), *sums], names=["ids", "labels", "at", "parts", "low", "high", "sum_high", "sum_low"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(lambda b: giving_back(sort(b)), f"ids array<bigint>, labels array<{kind}>, at binary, parts binary, low binary, high binary, sum_high array<bigint>, sum_low array<bigint>")


def shortlist(low: np.ndarray, high: np.ndarray, means: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Blocks x entries: whether a row of the block may be nearest to the entry. All whole numbers of one kind; ``means`` are rounded."""
    e = entries[None, :, :]
    lo, hi = low[:, None, :], high[:, None, :]
    outside = np.maximum(np.maximum(lo - e, e - hi), 0)
    near = (outside * outside).sum(axis=2)
    across = np.maximum(abs(e - lo), abs(hi - e))
    far = (across * across).sum(axis=2)
    apart = means[:, None, :] - e
    first = np.argmin((apart * apart).sum(axis=2), axis=1)
    step = e - entries[first][:, None, :]
    # distance to the entry less distance to the first, where it is least in the box
    less = (e * e - (entries[first] * entries[first])[:, None, :] - 2 * np.maximum(lo * step, hi * step)).sum(axis=2)
    return (near <= far.min(axis=1)[:, None]) & (less <= 0)


class Chunk:
    """A row of :func:`blocks`, worked on part by part."""

    def __init__(self, batch: pa.RecordBatch, row: int, width: int, block: int = BLOCK):
        own = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
        self.ids, self.labels = own["ids"].values, own["labels"].values
        self.n, self.block = len(self.ids), block
        count = -(-self.n // block)
        self.order = np.frombuffer(own["at"].as_py(), np.int32).reshape(PARTS, self.n)
        self.parts = np.frombuffer(own["parts"].as_py(), np.int64).reshape(PARTS, self.n, width // PARTS)
        self.low, self.high = (np.frombuffer(own[k].as_py(), np.int64).reshape(PARTS, count, width // PARTS) for k in ("low", "high"))
        sums = own["sum_high"].values.to_numpy().astype(object) * (1 << 32) + own["sum_low"].values.to_numpy().astype(object)
        self.sums = sums.reshape(PARTS, count, width // PARTS)
        self.sizes = np.minimum(block, self.n - np.arange(count) * block)

    def assign(self, part: int, entries: list[list[int]], distances: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry and squared distance by row, in the blocks' order, and which blocks are settled: they have one entry left.

        Rows of settled blocks have distances only if these are asked for.
        """
        top = max(abs(int(self.low[part].min())), abs(int(self.high[part].max())), *(abs(x) for e in entries for x in e), 1)
        kind = spans(8 * self.parts.shape[2] * top * top)
        values, held = self.parts[part].astype(kind), np.array(entries, kind).reshape(len(entries), -1)
        low, high = self.low[part].astype(kind), self.high[part].astype(kind)
        means = np.floor_divide(self.sums[part], self.sizes[:, None].astype(object)).astype(kind)
        listed = shortlist(low, high, means, held)
        settled = listed.sum(axis=1) == 1
        first = np.argmax(listed, axis=1)
        block_of = np.arange(self.n) // self.block
        entry = first[block_of]
        best = np.full(self.n, -1, kind)
        for j in range(len(entries)):
            wanted = listed[:, j] if distances else listed[:, j] & ~settled
            rows = np.flatnonzero(wanted[block_of])
            if len(rows):
                apart = values[rows] - held[j]
                found = (apart * apart).sum(axis=1)
                better = (best[rows] < 0) | (found < best[rows])
                best[rows[better]], entry[rows[better]] = found[better], j
        return entry, best, settled


def _totals(chunks: DataFrame, books: Codebooks, width: int) -> dict[tuple, int]:
    """Sums by (part, entry, place) of the rows that are nearest to the entry; place -1 is their number."""
    places = width // PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, ENTRIES, places + 1), object)
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = Chunk(batch, row, width)
                for p in range(PARTS):
                    entry, _, settled = chunk.assign(p, books[p])
                    by_block = entry[:: chunk.block]
                    loose = np.flatnonzero(~settled[np.arange(chunk.n) // chunk.block])
                    kind = spans(int(max(abs(int(chunk.low[p].min())), abs(int(chunk.high[p].max())))) * chunk.n)
                    values = chunk.parts[p][loose].astype(kind)
                    for j in range(len(books[p])):
                        whole_blocks = settled & (by_block == j)
                        mine = entry[loose] == j
                        sums[p, j, :-1] += chunk.sums[p][whole_blocks].sum(axis=0) + values[mine].sum(axis=0).astype(object)
                        sums[p, j, -1] += int(chunk.sizes[whole_blocks].sum()) + int(mine.sum())
        at = np.argwhere(sums != 0)
        if len(at):
            names = [pa.array(at[:, i].astype(np.int32)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*names, *halves(sums[tuple(at.T)])], names=["part", "entry", "place", "high", "low"])

    partial = chunks.mapInArrow(lambda b: giving_back(add(b)), "part int, entry int, place int, high long, low long")
    return {(p, j, -1 if i == places else i): v for (p, j, i), v in exact_sums(partial, "part", "entry", "place").items()}


def fit(vectors: DataFrame, chunks: DataFrame, width: int, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks after ``rounds`` rounds over all vectors; a few hundred whole numbers in all."""
    firsts = [r["v"] + [0] * (width - len(r["v"])) for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()]
    places = width // PARTS
    books = [[v[p * places : (p + 1) * places] for v in firsts] for p in range(PARTS)]
    for _ in range(rounds):
        sums = _totals(chunks, books, width)
        for p, book in enumerate(books):
            for j in range(len(book)):
                n = sums.get((p, j, -1), 0)
                if n:
                    book[j] = [sums.get((p, j, i), 0) // n for i in range(places)]
    return books


def encode(chunks: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """(vec_id, label, code, error) of every vector: two hex digits a part, and the squared distances summed over the parts."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = Chunk(batch, row, width)
                codes = np.zeros((chunk.n, PARTS), np.uint8)
                error = np.zeros(chunk.n, object)
                for p in range(PARTS):
                    entry, best, _ = chunk.assign(p, books[p], distances=True)
                    codes[chunk.order[p], p] = entry
                    error[chunk.order[p]] += best.astype(object)
                text = codes.tobytes().hex()
                names = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
                sums = pa.array([e if e < _LONG else None for e in error], pa.int64())
                yield pa.RecordBatch.from_arrays([chunk.ids, chunk.labels, pa.array(names), sums], names=["vec_id", "label", "code", "error"])

    kind = chunks.schema["labels"].dataType.elementType.simpleString()
    return chunks.mapInArrow(lambda b: giving_back(assign(b)), f"vec_id long, label {kind}, code string, error long")


def decode(code: str, books: Codebooks) -> list[int]:
    """The whole numbers that a code stands for."""
    return [x for p in range(PARTS) for x in books[p][int(code[2 * p : 2 * p + 2], 16)]]


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(df: DataFrame, label: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256); see the query's contract."""
    vectors = whole(df, scale, label=label)
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // PARTS)) * PARTS
    chunks = materialize(blocks(vectors, width), "blocks")
    books = fit(vectors, chunks, width)
    coded = materialize(encode(chunks, books, width), "codes")
    whole_sum = F.when(F.count("error") == F.count(F.lit(1)), F.expr("try_sum(error)"))
    per_label = coded.groupBy(F.col("label").alias("_of")).agg(whole_sum.alias("label_error"))
    found = coded.join(per_label, F.col("label").eqNullSafe(F.col("_of")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
