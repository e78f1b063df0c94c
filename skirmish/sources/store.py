"""Tables written once and read many times."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session without it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = f"file://{tempfile.mkdtemp(prefix='skirmish-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the folder that driver and executors share, and read back.

    Extraction is the costly step and its columns are large expressions: stored,
    patterns run once a line, later filters are pushed into Parquet instead of
    into the patterns, and a lost executor means a reread.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[tuple, str] = {}


def _state_of(source: DataFrame) -> str:
    """A digest of the files that ``source`` reads, as their file system lists them now: path, length, time of change."""
    spark = source.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    folders: dict[str, list[str]] = {}
    for file in source.inputFiles():
        folders.setdefault(file.rsplit("/", 1)[0], []).append(file)
    told: list[str] = []
    for folder, files in folders.items():
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        wanted = {f.rsplit("/", 1)[1] for f in files}
        for found in place.getFileSystem(conf).listStatus(place):
            if found.getPath().toUri().getRawPath().rsplit("/", 1)[1] in wanted:
                told.append(f"{found.getPath()}|{found.getLen()}|{found.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(told)).encode()).hexdigest()


def stored_once(source: DataFrame, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, stored at its first use in a session and read at later ones.

    The key is what ``source`` reads: its files with their length and time of change,
    so a table rewritten under its name is another one.
    """
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, shared_folder(spark), label, _state_of(source))
    if key in _kept:
        try:
            return spark.read.parquet(_kept[key])
        except AnalysisException:  # its folder was cleared
            del _kept[key]
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    found = make()
    found.write.parquet(path)
    _kept[key] = path
    return spark.read.schema(found.schema).parquet(path)


#: Rows that one task reads by patterns.
SPREAD_ROWS = 100_000


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """Rows dealt over all cores, and over more tasks where that leaves them more than ``rows`` each.

    One small or gzip file is one split, and a split of Parquet is many rows; patterns
    cost far more than the count and the shuffle.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def arrow_schema(ddl: str):
    """The Arrow schema of a schema given as text, for tasks that build batches."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl), prefers_large_types=False)
