"""Small helpers shared by the operators: staged tables and text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.session import settings, shared_path

# Texts reach Python so many bytes at a time, not 10,000 rows of any length.
BATCH_BYTES = 2 << 20

# Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts lineage with a plain table that every executor sees, so that a lost
    executor costs a re-read and not a recomputation, and so that several
    consumers see the same rows.
    """
    path = shared_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with settings(df.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on texts reach Python BATCH_BYTES at a time in this session.

    For operators whose result the caller writes: what holds while they are called does not hold while they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def finite_vector(c: Column) -> Column:
    """True for a vector that is not null and holds neither nulls nor non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return c.isNotNull() & ~F.coalesce(F.exists(c, bad), F.lit(True))
