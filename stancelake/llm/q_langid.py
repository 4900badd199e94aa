"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from .langid import identify
from .registry import query, table


def held_out():
    """Documents kept from training: crc32 of the id's text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@query("op3_language_id")
def language_id(spark, sf_dir):
    """Language of every whole text of ``documents``; tested on held-out documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, ~held_out()).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
