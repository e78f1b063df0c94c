"""The spell dimension, from its two text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions.text import class_names

FIELDS = 165
LEVEL = 254
SELF_TARGETS = (6,)
PET_TARGETS = (14, 38)
# Spell duration in ticks by formula, for a caster of LEVEL; other formulas give the cap itself.
DURATIONS = {
    0: 0,
    1: LEVEL // 2,
    2: LEVEL // 2 + 5,
    3: LEVEL * 30,
    4: 50,
    5: 2,
    6: LEVEL // 2,
    7: LEVEL,
    8: LEVEL + 10,
    9: LEVEL * 2 + 10,
    10: LEVEL * 30 + 10,
    11: (LEVEL + 3) * 30,
    12: LEVEL // 2,
    13: LEVEL * 4 + 10,
    14: LEVEL * 5 + 10,
    15: (LEVEL * 5 + 50) * 2,
    50: 72000,
    3600: 3600,
}


def duration_ticks(formula: Column, cap: Column) -> Column:
    value = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DURATIONS.items() for x in kv]), formula), cap)
    return F.when((cap > 0) & (value > cap), cap).otherwise(value)


def is_pet_target(target: Column) -> Column:
    return target.isin(*PET_TARGETS)


def spells_from_fields(fields: DataFrame, strings: DataFrame | None = None) -> DataFrame:
    """The dimension from rows of split fields (``f``) and of landing texts (id, land_self, land_others, wears_off).

    (id, name, target, duration_ticks, class_mask, class_count, classes, land_self,
    land_others, wears_off, land_pet). Spells of one name are one row: the first
    by id, with the classes of all.
    """
    masks = [F.when(F.get("f", F.lit(36 + k)).cast("int") < 255, 1 << k).otherwise(0) for k in range(16)]
    mask = masks[0]
    for m in masks[1:]:
        mask = mask + m
    number = lambda k: F.get("f", F.lit(k)).cast("int")
    rows = fields.where(F.size("f") == FIELDS).select(number(0).alias("id"), F.trim(F.get("f", F.lit(1))).alias("name"), number(30).alias("target"), duration_ticks(number(11), number(12)).alias("duration_ticks"), mask.alias("class_mask"))
    if strings is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("land_self", "land_others", "wears_off", "land_pet")})
    else:
        rows = rows.join(strings, "id", "left")
        # a landing text that only pets' spells have tells a pet's owner
        others = rows.where(~is_pet_target(F.col("target"))).select("land_others").distinct()
        pets = rows.where(is_pet_target(F.col("target"))).join(others, "land_others", "left_anti").select("id", F.col("land_others").alias("land_pet"))
        rows = rows.join(pets, "id", "left")
    first = [F.min_by(c, "id").alias(c) for c in ("target", "duration_ticks", "land_self", "land_others", "wears_off", "land_pet")]
    found = rows.groupBy("name").agg(F.min("id").alias("id"), F.bit_or("class_mask").alias("class_mask"), *first)
    return found.withColumns({"class_count": F.bit_count("class_mask").cast("int"), "classes": class_names(F.col("class_mask"))})


def read_spells(spark: SparkSession, path: str, strings_path: str | None = None) -> DataFrame:
    """Rows that do not have exactly the 165 fields are left out."""
    fields = spark.read.text(path).select(F.split("value", r"\^").alias("f"))
    strings = None
    if strings_path:
        split = spark.read.text(strings_path).where(~F.col("value").startswith("#")).select(F.split("value", r"\^").alias("s")).where(F.size("s") >= 6)
        strings = split.select(F.get("s", F.lit(0)).try_cast("int").alias("id"), *[F.get("s", F.lit(k)).alias(n) for k, n in ((3, "land_self"), (4, "land_others"), (5, "wears_off"))]).where("id is not null")
    return spells_from_fields(fields, strings)
