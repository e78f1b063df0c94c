"""Document fingerprints: threshold-scaled sketches, with column functions only.

A sketch keeps every hash of a text's word shingles that lies below a fixed
fraction of all hashes; if none does, the least hash alone, so that short texts
have one too. Sketches of parts merge by union (:func:`merge`). As the same
hashes are kept in every text, shared hashes over a sketch's size estimate how
much of a text another contains, however unequal they are.

Defined results: a null text is empty; a text without words has an empty sketch;
two empty sketches are alike (1), an empty and another are not (0); fewer words
than a shingle make one shingle of them all; repeated shingles count once. A very
long text is one value with its sketch; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORDS = 5
#: One of 2^SCALE hashes is kept.
SCALE = 3
#: Bytes of text that a range of neighbours holds, and the number of quantiles that ranges are made of.
RANGE = 24 << 20
CUTS = 2048


def kept(hashes: Column, scale: int = SCALE) -> Column:
    """The sketch of hashes: sorted, without repeats. Hashes are taken as unsigned, so the low ones are those with clear top bits."""
    low = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: F.shiftrightunsigned(h, 64 - scale) == 0)))
    # the least unsigned hash: flipping the sign bit makes the order signed
    flip = F.lit(-(2**63))
    least = F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(flip))).bitwiseXOR(flip)
    return F.when((F.size(low) > 0) | (F.size(hashes) == 0), low).otherwise(F.array(least))


def sketch(df: DataFrame, text: str, out: str, words_each: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Adds the sketch of a text column. The steps stand in columns of their own, so that none is computed twice."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    runs = F.sequence(F.lit(0), F.greatest(F.size("_w") - words_each, F.lit(0)))
    each = F.transform(runs, lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(words_each)]))
    df = df.withColumn("_s", F.when(F.size("_w") > 0, each).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn(out, kept(F.col("_s"), scale)).drop("_w", "_s")


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two parts together; shingles across the cut are in neither."""
    return kept(F.array_union(a, b), scale)


def as_text(sketch_of: Column) -> Column:
    return F.array_join(F.transform(sketch_of, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two sketches."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def containment(a: Column, b: Column) -> Column:
    """The share of the first sketch's hashes that the second has too."""
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def with_next(rows: DataFrame, key: str, carried: list[str], tie: str) -> DataFrame:
    """Adds next_<column> for the carried columns: those of the next row by descending ``key``, after the last the first.

    Keys are cut at their quantiles into ranges of about ``RANGE`` bytes of text, as
    many as shuffles have tasks at least; each range gets a copy of the row that
    follows it and is a task of its own, so one window a range gives all next rows
    and no task sees all. A null key comes last.
    """
    spark = rows.sparkSession
    some = rows.agg(F.percentile_approx(key, F.lit([k / CUTS for k in range(1, CUTS)]), F.lit(20 * CUTS)).alias("c"), F.sum(F.octet_length(F.col(carried[0]))).alias("n")).first()
    parts = min(CUTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(some["n"] or 0) // RANGE)))
    cuts = some["c"] or []
    cuts = sorted({cuts[k * CUTS // parts - 1] for k in range(1, parts)}) if cuts else []
    place = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c < F.col(key))) if cuts else F.lit(0)
    rows = rows.withColumn("_range", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(place))
    firsts = rows.groupBy("_range").agg(F.max(key).alias("first")).orderBy(F.col("_range").desc()).collect()  # at most one row a range
    if not firsts:
        return rows.drop("_range").withColumns({f"next_{c}": F.lit(None).cast(rows.schema[c].dataType) for c in carried})
    # each row once in its range and, if it is the first of a range, again at the end of the one before
    spread = rows.withColumn("_at", F.explode(_places(firsts, key)))
    spread = spread.drop("_range").select("*", "_at._range", "_at._copy").drop("_at")
    spread = spread.repartitionByRange(len(cuts) + 2, "_range")  # ranges do not share a task, as they may by hash
    order = Window.partitionBy("_range").orderBy("_copy", F.col(key).desc_nulls_last(), tie)
    found = spread.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return found.where("not _copy").drop("_range", "_copy")


def _places(firsts: list, key: str) -> Column:
    """The ranges a row goes to, by a map from first keys to the range before."""
    entries = [x for before, row in zip([firsts[-1], *firsts[:-1]], firsts, strict=True) if row["first"] is not None for x in (F.lit(row["first"]), F.lit(before["_range"]))]
    own = F.struct(F.col("_range").alias("_range"), F.lit(False).alias("_copy"))
    before = F.try_element_at(F.create_map(*entries), F.col(key)) if entries else F.lit(None).cast("int")
    if firsts[-1]["first"] is None:
        before = F.coalesce(before, F.when(F.col(key).isNull(), F.lit(firsts[-2]["_range"] if len(firsts) > 1 else -1)))
    return F.when(before.isNull(), F.array(own)).otherwise(F.array(own, F.struct(before.alias("_range"), F.lit(True).alias("_copy"))))


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and how alike they are; see the query's contract."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows = with_next(sketch(rows, "text", "s"), "doc_id", ["text", "s"], "_tie")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = sketch(rows.withColumn("edited", edited), "edited", "e")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("s")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"),
        likeness(F.col("s"), F.col("next_s")).alias("near_next"),
        containment(F.col("s"), F.col("next_s")).alias("contained_in_next"),
    )
