"""Roster exports, the player registry and raid templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions.text import class_code, empty_to_null, is_pet_name


def is_roster_name(path: Column) -> Column:
    return path.rlike(r"-20\d{6}-\d{6}\.txt$")


def roster_date(path: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(path, r"(20\d{6}-\d{6})", 1), F.lit("yyyyMMdd-HHmmss"))


def parse_rosters(lines: DataFrame) -> DataFrame:
    """(name, level, class, ts) from (line, path): guild exports start with a name, raid exports with a group number."""
    part = F.split("line", "\t")
    guild = lines.where(F.col("line").rlike(r"^[A-Za-z_]\w*\t\d+\t\w"))
    raid = lines.where(F.col("line").rlike(r"^\d+\t\w+\t\d+\t\w+"))

    def people(df: DataFrame, at: int) -> DataFrame:
        return df.select(part.getItem(at).alias("name"), part.getItem(at + 1).cast("int").alias("level"), class_code(part.getItem(at + 2)).alias("class"), roster_date(F.col("path")).alias("ts"))

    return people(guild, 0).unionByName(people(raid, 1))


def read_rosters(spark: SparkSession, paths: str | list[str], server: str | None = None, as_of: str | None = None, max_age_days: int = 14, limit: int = 20) -> DataFrame:
    """The rosters of a server that were written in the last days, the newest ``limit`` files."""
    lines = spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("written"))
    if server:
        lines = lines.where(F.col("path").contains(f"_{server}-"))
    now = F.to_timestamp(F.lit(as_of)) if as_of else F.current_timestamp()
    lines = lines.where(is_roster_name(F.col("path")) & (F.col("written") >= now - F.make_interval(days=F.lit(max_age_days))))
    newest = lines.select("path", "written").distinct().orderBy(F.col("written").desc()).limit(limit)
    return parse_rosters(lines.join(F.broadcast(newest.select("path")), "path", "left_semi"))  # at most ``limit`` names


def as_who_events(rosters: DataFrame, log_id: Column, seq: Column) -> DataFrame:
    """Roster rows as who events, so that entity resolution takes them like any other."""
    return rosters.select(log_id.alias("log_id"), seq.alias("seq"), "ts", F.lit("who").alias("kind"), "name", "level", "class")


def export_registry(entities: DataFrame) -> DataFrame:
    """Players, and pets of players, whose class or owner is dated: (name, class, owner, updated_on)."""
    players = entities.where("is_player").select(F.col("name").alias("_p")).distinct()
    dated = entities.where(F.col("updated_on").isNotNull()).join(players, F.col("owner") == F.col("_p"), "left")
    return dated.where(F.col("is_player") | F.col("_p").isNotNull()).select("name", "class", "owner", "updated_on")


def registry_text(registry: DataFrame) -> DataFrame:
    """One row, the registry in its text form; a registry is one server's known players."""
    entry = F.concat_ws(":", "name", F.coalesce("class", F.lit("")), F.coalesce("owner", F.lit("")), F.date_format("updated_on", "yyyy-MM-dd"))
    return registry.select(entry.alias("e")).agg(F.expr("listagg(concat(e, ';')) WITHIN GROUP (ORDER BY e)").alias("data"))


def import_registry(data: DataFrame, as_of: Column, column: str = "data") -> DataFrame:
    """(name, class, owner, is_player, updated_on): entries with four fields, of the last 30 days, pet-like names of the last 5."""
    rows = data.select(F.explode(F.split(column, ";")).alias("e")).select(F.split("e", ":").alias("f")).where(F.size("f") == 4)
    rows = rows.select(*[empty_to_null(F.get("f", F.lit(k))).alias(n) for k, n in enumerate(("name", "class", "owner"))], F.try_to_timestamp(F.get("f", F.lit(3)), F.lit("yyyy-MM-dd")).cast("date").alias("updated_on"))
    age = F.datediff(as_of, "updated_on")
    kept = rows.where(F.col("updated_on").isNotNull() & (age <= 30) & ~(is_pet_name(F.col("name")) & (age > 5)))
    return kept.withColumn("is_player", F.col("owner").isNull()).select("name", "class", "owner", "is_player", "updated_on")


def read_raid_templates(spark: SparkSession, path: str) -> DataFrame:
    """(raid, zone, mob, ends_on_death) from XML; raids without a name or zone are left out, one without mobs is its own mob."""
    mob = "Mob array<struct<_EndsOnDeath: string, _VALUE: string>>"
    raids = spark.read.format("xml").option("rowTag", "Raid").schema(f"Name string, Zone string, {mob}").load(path)
    return explode_templates(raids)


def explode_templates(raids: DataFrame) -> DataFrame:
    named = raids.where(F.col("Name").isNotNull() & F.col("Zone").isNotNull())
    spread = named.select(F.col("Name").alias("raid"), F.col("Zone").alias("zone"), F.explode_outer("Mob").alias("m"))
    return spread.select("raid", "zone", F.coalesce("m._VALUE", "raid").alias("mob"), F.coalesce(F.lower("m._EndsOnDeath") == "true", F.lit(False)).alias("ends_on_death"))
