"""License scans: a trained paragraph classifier, with DataFrame operations only.

Paragraphs (lines) become sparse counts of hashed word n-grams; a multinomial
logistic regression, trained here on phrases built from the families' names and
standard wordings, gives each a family or ``unknown``. Unknown is a class of its
own, learned from sentences that use the same words otherwise, and its threshold
is calibrated: of the phrases held out from training, the least probability that
lets none of the unknown ones through. A family is confirmed only if one of its
templates is found in the paragraph by ``CONFIRM`` of its word pairs.

Paragraphs are lines, and blocks of lines between blank ones. A line is scored if
it holds a cue or could match a template: by the word pairs of the templates
themselves (:func:`required`), so no match is passed over. A block is scored
besides, and counts once if it is of a family that none of its lines is of.
Lines without a cue that no template confirms are none, not unknown. Defined
results: null and empty texts have no paragraph; rows that repeat an id are one
row of the result, with the paragraphs of all; an empty table gives no rows; other
columns are not read; a very long text is split where it is read. Ties go to the
family first by name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce
from itertools import product
from math import ceil
from operator import and_, or_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
FEATURES = 1 << 13
CONFIRM = 0.8

# Names of licence families as they are written, and sentences of their standard texts.
NAMES = {
    "agpl": ["gnu affero general public license", "agpl license", "agpl version 3", "agpl 3.0"],
    "apache-2.0": ["apache license", "apache 2.0 license", "apache software license"],
    "bsd": ["bsd license", "bsd 3 clause license", "bsd 2 clause license", "new bsd license"],
    "cc-by": ["cc by 4.0", "cc by 3.0", "creative commons attribution license", "creative commons attribution 4.0"],
    "cc-by-nc": ["cc by nc 4.0", "cc by nc 3.0", "creative commons attribution noncommercial", "creative commons attribution non commercial"],
    "cc-by-sa": ["cc by sa 4.0", "cc by sa 3.0", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "epl": ["eclipse public license", "epl 2.0 license"],
    "unlicense": ["the unlicense", "unlicense org"],
    "zlib": ["zlib license", "zlib libpng license"],
    "cc0": ["cc0 license", "cc0 1.0 universal", "cc0 public domain dedication", "dedicated to the public domain"],
    "gpl": ["gnu general public license", "gpl license", "gpl version 3", "gpl version 2"],
    "isc": ["isc license", "isc licence terms"],
    "lgpl": ["gnu lesser general public license", "lgpl license", "lgpl version 2.1"],
    "mit": ["mit license", "mit licence", "expat license"],
    "mpl": ["mozilla public license", "mpl 2.0 license"],
    "proprietary": ["all rights reserved", "all rights reserved copyright", "copyright all rights reserved", "proprietary license"],
}
WORDINGS = {
    "agpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "apache-2.0": [
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "epl": ["the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"],
    "gpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "zlib": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
}
FRAMES = ["{}", "licensed under {}", "licensed under the {}", "released under the {}", "this work is licensed under the {}", "this work is licensed under {}", "distributed under the terms of the {}", "the code is available under the {} version 2.0", "spdx license identifier {}", "see the file for the {} text", "{} version 3", "covered by the {}", "published under {}"]
#: Sentences that use the same words without naming a licence.
OTHER = ["{} license", "the driver showed a license", "a license plate was found", "they lost the license to {}", "license fees for {} rose", "the {} license was revoked by the court", "copyright law and {}", "under the terms of the contract {}", "released under pressure from {}", "version 2.0 of the {} plan", "the public {} opened", "the general public saw {}", "creative {} in common", "notice to the public about {}", "permission is granted to enter {}", "a fishing license costs {}", "a copyright question about {}", "the {} was published under another name", "available under {}"]
FILLERS = ["fishing", "radio", "marriage", "house", "the office", "a river", "music", "software", "general", "business", "this work", "an animal", "professor", "museum", "the mill", "trade"]
#: A line with one of these that is of no family is unknown.
CUES = ("licen", "copyright", "creative commons", "public domain", "cc by", "cc-by", "cc0", "gpl")


def normal(text: Column) -> Column:
    """Lower case, words parted by single blanks; a point stays between digits."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?!\p{N})", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def grams(words: Column) -> Column:
    """Words and word pairs."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 2), " "))
    return F.array_distinct(F.concat(words, pairs))


def phrases() -> list[tuple[str, str, int]]:
    """(family, text, fold) for training and calibration: every name in every frame, every wording, and sentences of no licence."""
    known = [(family, frame.format(name)) for family, names in sorted(NAMES.items()) for name, frame in product(names, FRAMES)]
    known += [(family, text) for family, texts in sorted(WORDINGS.items()) for text in texts for _ in range(5)]
    other = [(UNKNOWN, frame.format(word)) for frame, word in product(OTHER, FILLERS)]
    return [(family, text, k % 5) for rows in (known, other) for k, (family, text) in enumerate(rows)]


def _featured(df: DataFrame) -> DataFrame:
    return df.withColumn("_words", F.split(normal(F.col("paragraph")), " ")).withColumn("grams", grams(F.col("_words"))).drop("_words")


class Model:
    """The fitted pipeline, its families in the order of its probabilities, and the calibrated threshold."""

    def __init__(self, fitted: PipelineModel, families: list[str], threshold: float):
        self.fitted, self.families, self.threshold = fitted, families, threshold


def train(spark: SparkSession) -> Model:
    """Fit on four folds of the phrases and calibrate on the fifth; the phrases are all the labelled rows there are."""
    rows = _featured(spark.createDataFrame(phrases(), "family string, paragraph string, fold int").coalesce(1))
    index = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    learner = LogisticRegression(maxIter=25, regParam=0.002, family="multinomial")
    back = IndexToString(inputCol="prediction", outputCol="family_pred", labels=index.labels)
    fitted = Pipeline(stages=[hashed, learner, back]).fit(index.transform(rows).where("fold <> 4"))
    held = _scored(fitted, index.labels, rows.where("fold = 4"))
    through = held.where((F.col("family") == UNKNOWN) & (F.col("family_pred") != UNKNOWN)).agg(F.max("probability_of")).first()[0]
    return Model(fitted, index.labels, max(0.5, through or 0.0))


def _scored(fitted: PipelineModel, families: list[str], rows: DataFrame) -> DataFrame:
    out = fitted.transform(rows)
    return out.withColumn("probability_of", F.array_max(vector_to_array("probability")))


def _pairs(template: str) -> list[str]:
    words = template.split()
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _templates() -> Column:
    """Family -> list of the word pairs of each template."""
    entries = []
    for family in sorted(NAMES):
        pairs = [_pairs(t) for t in NAMES[family] + WORDINGS.get(family, [])]
        entries += [F.lit(family), F.array(*[F.array(*map(F.lit, p)) for p in pairs])]
    return F.create_map(*entries)


def required() -> list[tuple[str, ...]]:
    """Words of which a text holds all of at least one entry if any template is found in it.

    A template of n distinct pairs needs ``CONFIRM`` of them, so of any
    n - needed + 1 pairs one is there: the longest are taken, as their words are rare.
    """
    found = set()
    for template in (t for texts in (*NAMES.values(), *WORDINGS.values()) for t in texts):
        pairs, size = sorted(set(_pairs(template)), key=lambda p: (-len(p), p)), len(_pairs(template))
        needed = ceil(CONFIRM * size - 1e-9)
        found.update(tuple(sorted(p.split())) for p in pairs[: len(pairs) - needed + 1])
    return sorted(found)


def _led(entries: list[tuple[str, ...]]) -> list[tuple[str, list[tuple[str, ...]]]]:
    """The entries by a word that as many as possible have in common, so that few words are looked for in a text that has none of them."""
    groups, left = [], list(entries)
    while left:
        times = Counter(w for words in left for w in words)
        lead = max(sorted(times), key=lambda w: (times[w], len(w)))
        groups.append((lead, [tuple(w for w in words if w != lead) for words in left if lead in words]))
        left = [words for words in left if lead not in words]
    return groups


def _has_cue(low: Column) -> Column:
    return reduce(or_, [low.contains(cue) for cue in CUES])


def _has_required(low: Column, entries: list[tuple[str, ...]]) -> Column:
    every = lambda words: reduce(and_, [low.contains(w) for w in words], F.lit(True))
    return reduce(or_, [low.contains(lead) & reduce(or_, map(every, rests)) for lead, rests in _led(entries)])


def _lowered(text: Column, test: Callable[[Column], Column]) -> Column:
    """The test of the lowered text, which is made once: outside a lambda Spark lowers it anew for each word looked for."""
    return F.exists(F.array(F.lower(text)), test)


def _cued(text: Column) -> Column:
    return _lowered(text, _has_cue)


def _may_match(text: Column) -> Column:
    """Whether a template could be found: a word of normal text is a part of the lowered text."""
    return _lowered(text, lambda low: _has_required(low, required()))


def _scored_at_all(text: Column) -> Column:
    """``_cued`` or ``_may_match``, without looking for words that hold a cue."""
    more = [words for words in required() if not any(cue in w for w in words for cue in CUES)]
    return _lowered(text, lambda low: _has_cue(low) | _has_required(low, more))


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, at, whole, paragraph): lines and, if they have more than one, blocks that hold a cue or could match; ``at`` numbers the blocks from 0."""
    blocks = docs.where(_scored_at_all(F.col(text))).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(F.col(text), r"\n[\x20\t\r]*\n")).alias("at", "block"))
    lines = F.transform(F.split("block", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("paragraph")))
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.col("block").alias("paragraph")))
    every = F.when(F.size(lines) > 1, F.concat(lines, whole)).otherwise(lines)
    found = blocks.where(_scored_at_all(F.col("block"))).select("doc_id", "text_hash", "at", F.explode(every).alias("p")).select("doc_id", "text_hash", "at", "p.*")
    return found.where(_scored_at_all(F.col("paragraph")))


def classify(found: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, at, paragraph, family, probability) and the ``keep`` columns: unknown unless the probability reaches the threshold and a template confirms."""
    scored = _scored(model.fitted, model.families, _featured(found))
    templates = F.try_element_at(_templates(), F.col("family_pred"))
    alike = F.exists(templates, lambda t: F.size(F.array_intersect(t, F.col("grams"))) >= F.lit(CONFIRM) * F.size(t))
    sure = (F.col("family_pred") != UNKNOWN) & (F.col("probability_of") > model.threshold) & F.coalesce(alike, F.lit(False))
    family = F.when(sure, F.col("family_pred")).otherwise(F.lit(UNKNOWN))
    return scored.select("doc_id", "at", "paragraph", family.alias("family"), F.col("probability_of").alias("probability"), *keep)


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, families, n_licensed, n_unknown), a row for every id: families by name, joined by commas, and numbers of paragraphs."""
    found = classify(paragraphs(docs, doc_id, text), model, keep=("text_hash", "whole"))
    known = F.when(F.col("family") != UNKNOWN, F.col("family"))
    of_lines, of_block = F.when(~F.col("whole"), known), F.when(F.col("whole"), known)
    blocks = found.groupBy("doc_id", "text_hash", "at").agg(
        F.collect_set(of_lines).alias("lines"),
        F.max(of_block).alias("block"),
        F.count(of_lines).alias("n_lines"),
        F.count(of_block).alias("n_blocks"),
        F.count_if(~F.col("whole") & (F.col("family") == UNKNOWN) & _cued(F.col("paragraph"))).alias("n_unknown"),
    )
    # a licence that runs over lines: the block is of it, and its lines for themselves are not unknown
    more = F.col("block").isNotNull() & ~F.coalesce(F.array_contains("lines", F.col("block")), F.lit(False))
    blocks = blocks.select(
        "doc_id",
        F.when(more, F.array_append("lines", F.col("block"))).otherwise(F.col("lines")).alias("families"),
        (F.col("n_lines") + F.when(more, F.col("n_blocks")).otherwise(0)).alias("n_licensed"),
        F.when(more, 0).otherwise(F.col("n_unknown")).alias("n_unknown"),
    )
    sums = blocks.groupBy("doc_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))), ",").alias("families"), F.sum("n_licensed").alias("n_licensed"), F.sum("n_unknown").alias("n_unknown"))
    every = docs.select(F.col(doc_id).alias("doc_id")).distinct()
    sums = sums.withColumnRenamed("doc_id", "_of")
    joined = every.join(sums, F.col("doc_id").eqNullSafe(F.col("_of")), "left")
    return joined.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_licensed", "n_unknown")])
