"""Token counts of a text column; see ``transducer`` for the method."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transducer import compiled


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, in one pass over the texts, without a shuffle.

    ``tokenizer`` is the path of a public tokenizer file (word splitting, ranked
    merges, end-of-word mark) that every executor has.  Begin and end tokens are
    not added; the special strings of the file count 1 wherever they stand.  A
    null or empty text has 0 bytes and 0 tokens.  Repeated rows and null ids are
    kept as they are; an empty table gives an empty result; other columns are
    ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(tokenizer)
        for b in batches:
            n = pa.array(counter.count_batch(b.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
