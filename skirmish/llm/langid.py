"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams (1 to 3 letters, over whole texts) per language
in every task, sums them by (language, bucket) in Spark and turns them into a
matrix of log probabilities with add-``alpha`` smoothing. The matrix has
``buckets`` rows and one column a language, so its size does not grow with the
corpus; it is broadcast. Scoring sums matrix rows over a text's buckets, many
texts at a time, in numpy.

Defined results: a null text, a text without a letter, or no training row at
all gives ``und`` with score 0. Ties go to the language first in code-point
order. Texts are cut into blocks inside a task, so a very long text needs no
more memory than a block; its n-grams across block borders are counted.
Columns beside the named ones are carried along by :func:`predict`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = 3
ALPHA = 0.5
#: Naive Bayes counts overlapping n-grams as independent; the score is the posterior at this many n-grams at most.
EFFECTIVE = 64
#: More languages than this are an error: the broadcast matrix has BUCKETS x MAX_LANGUAGES floats at most.
MAX_LANGUAGES = 1000
_BLOCK = 1 << 20
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points and text numbers of lower-cased texts, in blocks that overlap by ORDERS - 1 inside a text.

    The first ORDERS - 1 places of a continued text's block come again; the caller skips them by the third value.
    """
    codes, owners, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        whole = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        for at in range(0, len(whole), _BLOCK):
            part = whole[at : at + _BLOCK + ORDERS - 1]
            codes.append(part)
            owners.append(np.full(len(part), i, np.int32))
            if at + _BLOCK < len(whole):  # only the first _BLOCK places start n-grams
                owners[-1][_BLOCK:] = -1 - i
            size += len(part)
            if size >= _BLOCK:
                yield np.concatenate(codes), np.concatenate(owners)
                codes, owners, size = [], [], 0
    if codes:
        yield np.concatenate(codes), np.concatenate(owners)


def _grams(codes: np.ndarray, owners: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and text numbers of every n-gram that holds a letter; other characters count as one blank."""
    letter = _is_letter()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    whose = np.where(owners < 0, -1 - owners, owners)
    shift = np.uint32(32 - (BUCKETS - 1).bit_length())
    mixed = np.zeros(len(codes), np.uint32)
    some = np.zeros(len(codes), bool)
    for n in range(1, ORDERS + 1):
        end = len(codes) - n + 1
        if end <= 0:
            return
        mixed = mixed[:end] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        some = some[:end] | letter[n - 1 :]
        keep = some & (owners[:end] >= 0) & (whose[:end] == whose[n - 1 :])
        yield (mixed[keep] * np.uint32(0x9E3779B1)) >> shift, whose[:end][keep]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
        names = list(totals)
        number = {x: i for i, x in enumerate(names)}
        lang_of = np.array([number[x] for x in langs], np.int64)
        for codes, owners in _blocks(batch.column(0).to_pylist()):
            for buckets, whose in _grams(codes, owners):
                found = np.bincount(lang_of[whose] * BUCKETS + buckets, minlength=len(names) * BUCKETS)
                for name, row in zip(names, found.reshape(len(names), BUCKETS), strict=True):
                    totals[name] += row
    for name, row in totals.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "bucket", "n"])


class Model:
    """Languages and the (buckets x languages) matrix of log probabilities; no languages if nothing was learned."""

    def __init__(self, langs: list[str], matrix: np.ndarray):
        self.langs, self.matrix = langs, matrix


def train(rows: DataFrame, text: str = "text", lang: str = "lang", alpha: float = ALPHA) -> Model:
    """Learn from every row whose text and language are not null."""
    known = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = known.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.limit(BUCKETS * MAX_LANGUAGES + 1).toPandas()
    langs = sorted(found["lang"].unique())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    matrix = np.zeros((BUCKETS, len(langs)))
    number = {x: i for i, x in enumerate(langs)}
    matrix[found["bucket"].to_numpy(np.int64), found["lang"].map(number).to_numpy(np.int64)] = found["n"].to_numpy()
    matrix += alpha
    return Model(langs, np.log(matrix / matrix.sum(axis=0)).astype(np.float32))


def _classify(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    size = len(model.langs)
    sums, seen = np.zeros((len(texts), max(size, 1))), np.zeros(len(texts), np.int64)
    for codes, owners in _blocks(texts):
        for buckets, whose in _grams(codes, owners):
            if not len(whose):
                continue
            starts = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
            at = whose[starts]
            seen[at] += np.diff(np.r_[starts, len(whose)])
            for k in range(size):
                sums[at, k] += np.add.reduceat(model.matrix[:, k][buckets].astype(np.float64), starts)
    if not size:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    sums *= (np.minimum(seen, EFFECTIVE) / np.maximum(seen, 1))[:, None]
    best = sums.argmax(axis=1)
    shares = np.exp(sums - sums.max(axis=1, keepdims=True))
    score = np.where(seen > 0, 1 / shares.sum(axis=1), 0.0)
    return [model.langs[k] if s else UNKNOWN for k, s in zip(best, seen, strict=True)], score


def predict(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if none are named), then ``lang_pred`` and ``score``; the text alone decides them.

    No column is overwritten: where one has such a name, the new one gets underlines before it.
    """
    shared = spark.sparkContext.broadcast((model.langs, model.matrix))
    names = list(docs.columns if keep is None else keep)
    lang_pred, sure = fresh_names(docs.select(*names), "lang_pred", "score")
    sent = docs.select(*names, *([] if text in names else [F.col(text).alias("_text")]))
    place = names.index(text) if text in names else len(names)
    schema = docs.select(*names).withColumns({lang_pred: F.lit(""), sure: F.lit(0.0)}).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Model(*shared.value)
        for batch in batches:
            langs, scores = _classify(batch.column(place).to_pylist(), learned)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, lang_pred, sure])

    return sent.mapInArrow(score, schema)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
