"""Exact dedup by deterministic block naming, with column functions only.

1. Texts, normalised, are cut into blocks of ``BLOCK`` bytes. Each distinct block gets
   a whole number as its name: blocks are sorted inside buckets of their digests, and
   a name is place x buckets + bucket.
2. Names of adjacent blocks are paired, and distinct pairs sorted and named like blocks,
   until one name is left of each text. A text of one block is done at once, one of n
   after log2(n) levels; level and name together are its identity.
3. Equal texts have equal identities, others not. Digests stand for blocks while rows are
   moved, so blocks themselves move once, and repeats are taken out before they do. Where
   two distinct blocks share a digest (they are compared), digests are made anew by
   another seed.

Every level is a written table: names do not change if an executor is lost. Numbers of
rows shrink by half a level; nothing is grouped but by map-side aggregation, and a hot
block or text meets its name in a join that Spark may split.

Defined results: a null text is empty; all empty texts, and those of white space alone,
are equal; a very long text is cut where it is read. Rows that repeat an id are documents
each; of rows equal in text, size and id one stays. A null id is the largest. Other
columns, whatever their names, are carried by :func:`distinct_documents`. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

BLOCK = 4096
BUCKETS = 1 << 16
#: Bits of an identity that tell its level: texts of up to 2^63 blocks.
LEVELS = 64
WHITE = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """The text without ASCII white space; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _blocks(text: Column, block: int) -> Column:
    """The UTF-8 bytes of a text, cut; an empty text is one empty block. Bytes are cut where they lie, whatever the text's length."""
    data = text.cast("binary")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0)), F.lit(block))
    return F.transform(starts, lambda i: F.substring(data, i + 1, F.lit(block)))


def _digest(x: Column, seed: int) -> Column:
    """128 bits of a block, as two longs."""
    return F.struct(F.xxhash64(F.lit(2 * seed), x).alias("a"), F.xxhash64(F.lit(2 * seed + 1), x).alias("b"))


def digests_hold(docs: DataFrame, block: int, digest: Callable[[Column, int], Column], seed: int) -> bool:
    """Whether no two distinct blocks of ``text`` share a digest: those of one digest are compared byte by byte."""
    each = docs.select(F.explode(_blocks(normalized(F.col("text")), block)).alias("block"))
    distinct = each.groupBy(digest(F.col("block"), seed).alias("d"), "block").agg(F.lit(1).alias("one"))
    return distinct.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0


def _named(rows: DataFrame) -> DataFrame:
    """(row, at, n, name): the names of the distinct (a, b) among ``rows``. ``b`` is null where a text has no second of a pair."""
    distinct = rows.select("a", "b").distinct().withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS)))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("a", "b")).cast("long")
    names = materialize(distinct.select(F.col("a").alias("of_a"), F.col("b").alias("of_b"), (place * BUCKETS + F.col("bucket")).alias("name")), "names")
    met = rows.join(names, F.col("a").eqNullSafe(F.col("of_a")) & F.col("b").eqNullSafe(F.col("of_b")))
    return materialize(met.select("row", "at", "n", "name"), "named")


def _pairs(named: DataFrame) -> DataFrame:
    """Adjacent names of a text beside each other, half as many as before."""
    second = F.col("at") % 2 == 1
    both = [F.max(F.when(~second, F.col("name"))).alias("a"), F.max(F.when(second, F.col("name"))).alias("b")]
    met = named.groupBy("row", F.shiftright("at", 1).alias("at")).agg(F.ceil(F.max("n") / 2).cast("long").alias("n"), *both)
    return materialize(met, "pairs")


def identities(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, digest: Callable[[Column, int], Column] = _digest) -> DataFrame:
    """(row, doc_id, n_chars, sha256, identity, kept): equal identities are equal texts. ``kept`` has the columns to carry.

    The table is written, so that a row's number stays the same.
    """
    docs = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry))).alias("kept"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    seed = 0
    while not digests_hold(docs, block, digest, seed):
        seed += 1
    clean = docs.select("kept", "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), normalized(F.col("text")).alias("clean"))
    digests = F.transform(_blocks(F.col("clean"), block), lambda b: digest(b, seed)).alias("digests")
    rows = materialize(clean.select(F.monotonically_increasing_id().alias("row"), "kept", "doc_id", "n_chars", F.sha2(F.col("clean").cast("binary"), 256).alias("sha256"), digests), "digests")
    blocks = rows.select("row", F.size("digests").cast("long").alias("n"), F.posexplode("digests").alias("at", "d"))
    named = _named(blocks.select("row", "at", "n", "d.a", "d.b"))
    done, level = [], 0
    while True:
        done.append(named.where("n = 1").select(F.col("row").alias("of_row"), (F.col("name") * LEVELS + level).alias("identity")))
        more = named.where("n > 1")
        if more.limit(1).count() == 0:
            break
        named, level = _named(_pairs(more)), level + 1
    found = rows.join(reduce(DataFrame.union, done), F.col("row") == F.col("of_row"))
    return materialize(found.select("row", "doc_id", "n_chars", "sha256", "identity", "kept"), "identities")


def _groups(found: DataFrame) -> DataFrame:
    """Adds keep (row, doc_id of the row that stays) and group_size."""
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = found.groupBy(F.col("identity").alias("of")).agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("keep"))
    return found.join(best, F.col("identity") == F.col("of"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document; see the query's contract."""
    found = _groups(identities(docs, [], text, doc_id, block))
    return found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.col("sha256").alias("text_sha256"))


def distinct_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One document of each text, with all its columns."""
    found = _groups(identities(docs, docs.columns, text, doc_id, block)).where(F.col("row") == F.col("keep.row"))
    return found.select(*(F.col(f"kept.c{i}").alias(c) for i, c in enumerate(docs.columns)))
