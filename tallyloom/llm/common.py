"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What stands between words of letters, digits and non-ASCII characters, after lower-casing.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The same rule for UTF-8 bytes: a table for ``bytes.translate`` that lower-cases A-Z and blanks the gaps.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a new one only where none is set and all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_within: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What ``written`` makes in this block is removed when it ends; the function it gives writes tables that stay."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _within.append(path)

    def lasting(df: DataFrame, name: str) -> DataFrame:
        _within.append(shared_folder(spark))
        try:
            return written(df, name)
        finally:
            _within.pop()

    try:
        yield lasting
    finally:
        _within.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{_within[-1] if _within else shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def quoted(name: str) -> str:
    """A column name as it must be written where dots would part it."""
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
