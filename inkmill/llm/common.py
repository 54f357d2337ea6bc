"""Shared helpers: reading tables, the shared folder, and tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes that are none of these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_made: dict[str, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all of Spark is on one machine (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not (own := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkmill-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_clean, spark)
    out = spark.read.schema(df.schema).parquet(path)
    _made[path] = out
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more; the rest go when the driver ends."""
    for path in [p for p, df in _made.items() if any(df is t for t in tables)]:
        _delete(_made.pop(path).sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean(spark: SparkSession) -> None:
    try:
        for path in _made:
            _delete(spark, path)
    except Exception:  # the session has gone; its folder belongs to whoever set it
        return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())

