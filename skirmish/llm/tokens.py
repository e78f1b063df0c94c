"""Token ids of whole texts, as fast as repeated words allow.

A tokenizer of the ``tokenizers`` library gives a word the same ids wherever it
stands, if the cuts between words are cuts of the tokenizer too. So each task
cuts texts at such places, has the library encode every distinct word once, and
joins ids by array indexing. The cache is emptied when its words hold
``CACHE`` characters and at the end of a task, so its memory is bounded and
given back.

Ids are those of the plain call: a special token's string in a text becomes that
token's id, unless ``special_as_text`` is set. Such texts are encoded whole.

Two kinds of cuts are known: before a blank between two characters that are not
blank (byte-level vocabularies, whose words carry the blank before them), and at
all white space (vocabularies that drop it). Anything else is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Characters of the words that a worker keeps, each counted with ``_ENTRY`` for what a dictionary entry takes.
CACHE = 50_000_000
_ENTRY = 100
END_ID = 1
_MARK = "\x01"
_UNSAFE = re.compile(r"\s ")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Python's split() takes these four for white space, the library does not.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_BLANKS = re.compile(r"[^\S\x1c-\x1f]+")
_loaded: dict[str, TextEncoder] = {}


class _Words(dict):
    """Numbers words in the order of their first call."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []
        self.held = 0

    def __missing__(self, word):
        self[word] = number = len(self)
        self.fresh.append(word)
        self.held += _ENTRY + len(word)
        return number


class TextEncoder:
    """Ids of texts by the tokenizer file at ``path``."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of its own would only wait
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        before = told.get("pre_tokenizer") or {}
        normal = json.dumps(told.get("normalizer"))
        self.leading = told.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.dropped = "Lowercase" in normal and '"Removed"' in json.dumps(before) and r"\\s\\p{L}" in json.dumps(before) and "Prepend" not in normal
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.marks = [] if special_as_text else [x.content for x in added]
        if any(x.normalized or x.lstrip or x.rstrip or x.single_word for x in added):
            self.leading = self.dropped = False  # such a token may take text around it, so no cut is safe
        if self.leading:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
            self.opens[[i for word, i in vocabulary.items() if word.startswith("Ġ")]] = True
        elif self.dropped:
            found = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
            self.mark = found[0] if len(found) == 1 else None
        self.clear()

    def clear(self) -> None:
        """Forget all words."""
        self.words = _Words()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts.append(self.used + starts)
        self.sizes.append(sizes)
        self.used += len(ids)

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words encoded in one call, and the place of each word's first id and of the end."""
        ids = np.array(self._whole(["".join(texts) if self.leading else f" {_MARK} ".join(texts)])[0], np.uint32)
        if self.leading:
            return ids, np.r_[np.flatnonzero(self.opens[ids]), len(ids)]
        marks = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.r_[0, marks - np.arange(len(marks)), len(ids) - len(marks)]

    def _learn(self) -> None:
        """Encode the words not met before, many joined in one call where their ids can be told apart again."""
        fresh, self.words.fresh = self.words.fresh, []
        for at in range(0, len(fresh), 2000):
            part = fresh[at : at + 2000]
            texts = [w[0] if type(w) is tuple else f" {w}" if self.leading else w for w in part]
            if self.leading:
                joins = [type(w) is not tuple and w != "" and not w[-1].isspace() and " " not in w for w in part]
            else:
                joins = [self.mark is not None and _MARK not in w for w in part]
            starts, sizes = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            where, ids = np.flatnonzero(joins), np.zeros(0, np.uint32)
            if len(where):
                ids, cuts = self._joined([t for t, j in zip(texts, joins, strict=True) if j])
                if len(cuts) == len(where) + 1:
                    starts[where], sizes[where] = cuts[:-1], np.diff(cuts)
                else:
                    joins, ids = [False] * len(part), ids[:0]
            alone = [k for k, j in enumerate(joins) if not j]
            if alone:
                found = self._whole([texts[k] for k in alone])
                sizes[alone] = [len(x) for x in found]
                starts[alone] = len(ids) + np.cumsum(sizes[alone]) - sizes[alone]
                ids = np.concatenate([ids, np.array([i for x in found for i in x], np.uint32)])
            self._store(starts, sizes, ids)

    def _cut(self, text: str) -> list:
        if self.leading:
            words = _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")
            words[0] = (words[0],)
            return words
        if "Σ" not in text and is_normalized("NFC", text):  # the library lower-cases too, but a sigma always alike
            text = text.lower()
        return _BLANKS.split(text) if _SEPARATORS.search(text) else text.split()

    def _marked(self, text: str) -> bool:
        """Whether the text, or what is looked up of it, holds a special token's string."""
        text = text.lower() if self.dropped else text
        return any(mark in text for mark in self.marks)

    def _with_marks(self, texts: list[str | None], marked: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids where some texts hold a special token's string: those whole, the others as ever."""
        apart = set(marked)
        ids, sizes = self.encode([None if i in apart else t for i, t in enumerate(texts)])
        whole = [np.array(x, np.uint32) for x in self._whole([texts[i] for i in marked])]
        at = (np.cumsum(sizes) - sizes)[marked]
        sizes[marked] = [len(x) for x in whole]
        return np.insert(ids, np.repeat(at, sizes[marked]), np.concatenate(whole)), sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text; null is empty."""
        if not (self.leading or self.dropped):
            found = self._whole([t or "" for t in texts])
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        marked = [i for i, text in enumerate(texts) if text and self._marked(text)]
        if marked:
            return self._with_marks(texts, marked)
        if self.words.held > CACHE:
            self.clear()
        number, get = [], self.words.__getitem__
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                words = self._cut(text)
                counts[i] = len(words)
                number.append(np.fromiter(map(get, words), np.int64, len(words)))
        self._learn()
        if not number:
            return np.zeros(0, np.uint32), counts
        self.starts, self.sizes = [np.concatenate(self.starts)], [np.concatenate(self.sizes)]
        words = np.concatenate(number)
        sizes = self.sizes[0][words]
        before = np.cumsum(sizes) - sizes
        take = np.repeat(self.starts[0][words] - before, sizes) + np.arange(sizes.sum())
        owner = np.repeat(np.arange(len(texts)), counts)
        return self.ids[take], np.bincount(owner, sizes, len(texts)).astype(np.int64)


def encoder(path: str) -> TextEncoder:
    """The encoder of a worker process, loaded once."""
    if path not in _loaded:
        _loaded[path] = TextEncoder(path)
    return _loaded[path]


def _parts(column: pa.Array, limit: int = 500_000) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a column in lists of about ``limit`` characters, with the row each starts at."""
    at, held, size = 0, [], 0
    for i, x in enumerate(column):
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size >= limit:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def encode_batches(batches: Iterator[pa.RecordBatch], column: int, path: str, end_id: int = END_ID) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with the ids of all their texts, the end id after each, and each text's number of ids."""
    tokenizer = encoder(path)
    try:
        for batch in batches:
            for at, texts in _parts(batch.column(column)):
                ids, sizes = tokenizer.encode(texts)
                ends = np.cumsum(sizes)
                yield batch.slice(at, len(texts)), np.insert(ids, ends, np.uint32(end_id)), sizes + 1
    finally:
        tokenizer.clear()
        give_back()


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids cut every ``size`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, sizes in encode_batches(batches, 1, path):
            counts = -(-sizes // size)
            whose = np.repeat(np.arange(len(sizes)), counts)
            start = (np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts)) * size
            length = np.minimum(size, sizes[whose] - start)
            at = (np.cumsum(sizes) - sizes)[whose] + start
            sums = np.fromiter((crc32(ids[a : a + n]) for a, n in zip(at, length, strict=True)), np.int64, len(at))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(whose)), pa.array(start), pa.array(length), pa.array(sums), pa.array(sizes[whose])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
