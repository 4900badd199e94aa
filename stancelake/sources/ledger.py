"""Append-only tables of keyed results in committed batches.

A batch is written to a folder of its own and counts only once its entry stands
in the manifest, which is written after it.  A run that is killed leaves at
most a folder that no reader sees; started again, it reads the finished keys
from the committed batches and works on the rest.  A batch id that is committed
already is not written again, so a replayed micro-batch changes nothing.

Everything is read and written by Spark's own readers, so a ledger can lie in
any store that Spark reaches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.joins import small
from ..session import stored, writing

MANIFEST = "batch string, n_rows long, committed_at timestamp"


class Ledger:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], finished: str = "true"):
        """A ledger of rows of ``schema``, each identified by ``keys``, under ``path`` (made when first written).

        ``finished`` is a condition: keys are done only by rows that fulfil it (so failures are tried again)."""
        self.spark, self.path, self.keys, self.finished = spark, path.rstrip("/"), list(keys), finished
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def _read(self, name: str, schema: StructType) -> DataFrame:
        base = f"{self.path}/{name}"
        try:
            return self.spark.read.schema(schema).option("basePath", base).parquet(base)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def batches(self) -> DataFrame:
        """Committed batches: (batch, n_rows, committed_at)."""
        return self._read("manifest", StructType.fromDDL(MANIFEST))

    def committed(self, batch: str) -> bool:
        return not self.batches().filter(F.col("batch") == batch).isEmpty()

    def rows(self) -> DataFrame:
        """Rows of committed batches, with their batch."""
        data = self._read("data", StructType([*self.schema.fields, StructField("batch", StringType())]))
        return data.join(self.batches().select("batch"), "batch", "left_semi").select(*self.schema.names, "batch")

    def read(self) -> DataFrame:
        return self.rows().drop("batch")

    def latest(self) -> DataFrame:
        """Rows of the committed batch whose id is last."""
        last = self.batches().agg(F.max("batch").alias("batch"))
        return self.rows().join(last, "batch", "left_semi").drop("batch")

    def commit(self, rows: DataFrame, batch: str | None = None) -> str:
        """Write a batch, then its entry in the manifest; a committed id is left as it is."""
        if batch is None:
            batch = f"b{uuid.uuid4().hex}"
        elif self.committed(batch):
            return batch
        part = f"{self.path}/data/batch={batch}"
        with writing(self.spark):
            rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields)).write.mode("overwrite").parquet(part)
        n = self.spark.read.schema(self.schema).parquet(part).count()
        entry = self.spark.range(1).select(F.lit(n).cast("long").alias("n_rows"), F.current_timestamp().alias("committed_at"))
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
        return batch

    def todo(self, inputs: DataFrame) -> DataFrame:
        """Inputs whose keys no finished row has (a null key is never finished)."""
        return inputs.join(self.rows().filter(self.finished).select(*self.keys).distinct(), self.keys, "left_anti")

    def bucket(self, batches: int):
        """An even share of the keys, whatever they are."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(batches)).cast("int").alias("bucket__")

    def advance(self, inputs: DataFrame, work: Callable[[DataFrame], DataFrame], batches: int = 8, copy: bool = True, row: str | None = None) -> None:
        """Apply ``work`` to the unfinished inputs, a committed batch at a time.

        ``work`` returns rows with the keys of its input.  Finished keys are skipped before
        any work; what a killed run had committed is not done again.  Inputs are dealt
        by a hash of their keys, so a batch is an even share, whatever the keys.  Inputs
        that are a written table already need no ``copy``: what is left is found from their keys alone, and the rows
        themselves are read where they lie (once, if the table has a folder for each ``bucket``).  ``row`` numbers such a table's rows; of equal
        keys the first is taken.
        """
        keys = inputs if copy else inputs.groupBy(*self.keys).agg(F.min(row).alias(row)) if row else inputs.select(*self.keys).distinct()
        left = stored(self.todo(keys).select("*", self.bucket(batches)), "ledger-todo" if copy else "ledger-keys")
        names = [row] if row else self.keys
        for b in sorted(r[0] for r in left.select("bucket__").distinct().collect()):            # at most one row a batch
            part = left.filter(F.col("bucket__") == b)
            if not copy:
                dealt = inputs.filter(F.col("bucket__") == b) if "bucket__" in inputs.columns else inputs
                part = dealt.join(small(part.select(*names)), names)
            self.commit(work(part.drop("bucket__")))
