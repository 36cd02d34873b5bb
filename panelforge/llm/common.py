"""What the corpus operators share: tables, and folders that every executor sees."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A folder of our own only where none is set and driver and executors are one process, which need no shared store; elsewhere it is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="panelforge-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


class Scratch:
    """Tables of one query in the shared folder. Writing one cuts the lineage: an executor lost later costs no recomputation of what is in it.

    The folder goes when the driver's Python ends, since the frame a query returns still reads it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.drop)

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.at}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        at, schema = self.path(name), df.schema
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(schema).parquet(at)

    def forget_shuffles(self) -> None:
        """Have Spark delete the shuffle files that no frame can read any more; it does so when the driver collects its garbage, which may else be long after."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self) -> None:
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(self.at)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII text takes the fast built-in, which is the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """SHA-256 of a text, 32 bytes: texts with one key are the same text. Null for null."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def only(df: DataFrame, *cols: str) -> DataFrame:
    """These columns alone, so that further ones with clashing names can't matter."""
    return df.select(*(F.col(f"`{c}`") for c in cols))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
