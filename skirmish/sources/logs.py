"""Log files and streams of log chunks to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Servers that a file name may name.
SERVERS = ("test", "beta", "agnarr", "aradune", "bertox", "bristle", "cazic", "coirnav", "drinal", "erollisi", "firiona", "luclin", "mangler", "miragul", "mischief", "phinigel", "povar", "ragefire", "rizlona", "selo", "thornblade", "rathe", "tunare", "vox", "xegony", "zek", "vaniki", "yelinak", "oakwynd", "teek", "tormax")
NOT_STANDARD = ("beta", "mischief", "thornblade", "teek")


def owner_of(path: Column) -> Column:
    """The character whose log a file is, from its name."""
    found = F.regexp_extract(path, r"eqlog_([A-Za-z]+)", 1)
    return F.when(found != "", F.initcap(F.lower(found)))


def server_of(path: Column) -> Column:
    found = F.regexp_extract(path, rf"eqlog_\w+_({'|'.join(SERVERS)})", 1)
    return F.when(found != "", found)


def is_standard_server(server: Column) -> Column:
    return server.isNotNull() & ~server.isin(*NOT_STANDARD)


def named_lines(lines: DataFrame) -> DataFrame:
    """log_id is a file's name without folder, chunk number and compression; owner and server come from it."""
    name = F.regexp_extract(F.col("_path"), r"([^/]+?)(?:\.\d+)?(?:\.gz)?$", 1)
    return lines.withColumns({"log_id": name, "owner": owner_of(name), "server": server_of(name)})


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(log_id, seq, owner, server, line) of plain or gzip logs.

    ``seq`` grows with the place in a file: the block a line was read from, then
    its number in the task. It orders lines of one log and does not count them.
    """
    lines = spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    # one file is read by few tasks; lines of a task share the high bits of the id
    seq = F.col("_block") * (1 << 20) + F.col("_id").bitwiseAND((1 << 33) - 1)
    return named_lines(lines).select("log_id", seq.alias("seq"), "owner", "server", "line")


def stream_logs(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """The same lines from a folder of chunk files that a shipper adds to; a chunk is one file named like its log.

    A chunk is read as one text and split, so ``seq`` orders lines by their chunk, then
    by their place in it. Chunks of a log are ordered by the number that their names end
    with (``.17``, ``.17.gz``). Without one it is the millisecond in which they were
    written: where two may share one, as in stores that count seconds, number them, or
    read whole logs as they grow (``growing.stream_growing``).
    """
    chunks = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("wholetext", True).text(folder)
    place = F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("_at", "line")
    number = F.regexp_extract("_metadata.file_path", r"\.(\d+)(?:\.gz)?$", 1).try_cast("long")
    lines = chunks.select(F.col("_metadata.file_path").alias("_path"), F.coalesce(number, F.unix_millis("_metadata.file_modification_time")).alias("_written"), place)
    return named_lines(lines).select("log_id", (F.col("_written") * (1 << 20) + F.col("_at")).alias("seq"), "owner", "server", "line")


def numbered(lines: DataFrame) -> DataFrame:
    """Dense line numbers from 1 inside each log, where a report needs them."""
    return lines.withColumn("seq", F.row_number().over(Window.partitionBy("log_id").orderBy("seq")).cast("long"))
