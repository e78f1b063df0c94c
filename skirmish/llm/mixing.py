"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a share of all words by its weight, at most ``most`` times its
own words; what is above is shared again by weight (the level that fills all
shares is found with running sums over the sources). Inside a source, every
document is taken as often as the target holds the source whole; the rest of the
budget goes to documents counted by exact length: each length gives its part,
whole documents only, then a bounded-knapsack dynamic program over what is still
missing (at most ``limit`` words) picks how many documents of each length come on
top. Which documents of a length these are is decided by a seeded hash.

Defined results: a null text has 0 words and is never taken for its words; null
sources are one source, last in order; documents without an id or repeated rows
are documents like others; an empty table gives no rows. Very long texts are
counted where they are read and only their sizes are shuffled. Columns that clash
with those the plan needs are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_names, materialize, rank_in_groups

WEIGHTS = (5, 2, 1)
MOST = 3
LIMIT = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, so windows over all of them are small."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    every = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_rows = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", rest / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    below = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    level = F.first(below, ignorenulls=True).over(all_rows)
    return rows.withColumn("target", F.least("cap", F.coalesce(level * F.col("w"), "cap"))).select("source", "source_size", "target")


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, limit: int = LIMIT) -> np.ndarray:
    """How many documents of each size to take, each once, so that their words come as near below ``budget`` as can be."""
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    # each length's part of the budget, but for the half of ``limit`` that the program below fits
    part = counts * (max(0, budget - limit // 2) / total)
    take = np.minimum(np.floor(part).astype(np.int64), counts)
    left = budget - int((take * sizes).sum())
    by_size = np.argsort(-sizes, kind="stable")
    for i in by_size:
        if left <= limit:
            break
        more = min(int(counts[i] - take[i]), left // int(sizes[i])) if sizes[i] else 0
        take[i] += more
        left -= more * int(sizes[i])
    if left > limit:
        return take
    # bounded knapsack: sums that some choice of the remaining documents reaches, bundles of 1, 2, 4, ... documents
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    last = np.full(left + 1, -1, np.int32)
    bundles: list[tuple[int, int]] = []
    for i in by_size:
        size = int(sizes[i])
        free = min(int(counts[i] - take[i]), left // size) if size else 0
        bundle = 1
        while free > 0 and not reached[left]:
            many = min(bundle, free)
            step = many * size
            fresh = reached[: left + 1 - step] & ~reached[step:]
            last[step:][fresh] = len(bundles)
            reached[step:] |= fresh
            bundles.append((int(i), many))
            free -= many
            bundle *= 2
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, many = bundles[last[at]]
        take[i] += many
        at -= many * int(sizes[i])
    return take


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    sizes, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    times = min(int(target // whole), MOST) if whole else 0
    budget = round(target) - times * whole if times < MOST else 0
    return pd.DataFrame({"source": rows["source"], "size": sizes, "times": times, "extra": fit(sizes, counts, budget)})


def mix(docs: DataFrame, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, key, size, source_size, target, copies, taken) per document; ``key`` hashes id and text."""
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )
    narrow = materialize(narrow, "sizes")
    histogram = narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    wanted = targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))).withColumnRenamed("source", "_source")
    with_targets = histogram.join(wanted, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    plan = with_targets.groupBy("source").applyInPandas(_plan, "source string, size long, times int, extra long")
    plan = materialize(plan.join(wanted, F.col("source").eqNullSafe(F.col("_source"))).select("source", "size", "times", "extra", "source_size", "target"), "mix")
    chosen = rank_in_groups(narrow, ["source", "size"], F.xxhash64(F.lit(seed), "key"), "rank", carry=plan)
    copies = F.col("times") + (F.col("rank") < F.col("extra")).cast("int")
    return chosen.select("doc_id", "key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents of the mix with all their columns, whatever their names, each as often as it is taken.

    Repeated rows share a key; as a row is taken 0 to ``MOST`` times, a key has as
    many numbers of copies at most, and the nth of its rows takes the nth of them.
    """
    key, runs, nth, times, copy = fresh_names(docs, "_key", "_runs", "_nth", "_times", "_copy")
    counted = mix(docs, seed).groupBy("key", "copies").agg(F.count(F.lit(1)).alias("n"))
    plan = counted.groupBy(F.col("key").alias(f"{key}_of_plan")).agg(F.sort_array(F.collect_list(F.struct("copies", "n")), asc=False).alias(runs))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    joined = keyed.join(plan, F.col(key) == F.col(f"{key}_of_plan"))
    joined = joined.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)).cast("long"))
    start = F.struct(F.col(nth).alias("left"), F.lit(-1).alias("copies"))
    found = F.aggregate(
        F.col(runs),
        start,
        lambda s, x: F.when(s["copies"] >= 0, s)
        .when(s["left"] <= x["n"], F.struct(s["left"].alias("left"), x["copies"].alias("copies")))
        .otherwise(F.struct((s["left"] - x["n"]).alias("left"), F.lit(-1).alias("copies"))),
        lambda s: s["copies"],
    )
    joined = joined.withColumn(times, found).where(F.col(times) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
