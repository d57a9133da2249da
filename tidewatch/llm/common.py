"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.core import discard, materialize, release, shared_folder  # noqa: F401

#: The six ASCII white-space characters, for ``trim`` and regular expressions.
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no frame has a column of that name."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(col):
    """Lower-case A-Z only; ``lower`` would also change other scripts."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for a registered query or the pipeline; narrows the session's batches to Python (``narrow_batches``)."""
    narrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only where a count proves the size; otherwise let the planner shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def narrow_batches(spark: SparkSession, size: str = "4m") -> None:
    """Send long texts to Python in batches of at most ``size`` bytes, unless the session says otherwise already.

    A setting of the session, so it is the application's choice: the registered queries
    and the pipeline make it, the operators do not.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB", str(64 << 20)):
        spark.conf.set(key, size)
