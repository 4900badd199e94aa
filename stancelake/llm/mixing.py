"""Mixing sources to target weights with hash-threshold histograms.

Each document has a 52-bit hash.  Sizes are summed by source and leading hash
bits (8,192 buckets); the budget of a source falls into one bucket, and only
documents of that boundary bucket are summed again, by their next 13 bits, and
so on down to single hash values.  What is taken is then ``hash < threshold``:
a filter, no sort, no rank over documents.  Thresholds are nested: a larger
budget takes a superset.  A target above the source's size takes whole copies
first, then the threshold's share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, word_count

BITS = 13                       # of the hash per level
SHIFTS = (39, 26, 13, 0)        # 52 bits in four levels


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in order of code points, null last, weigh 1, 2, 3, 1, ... and share
    the total size by weight.  A target stops at ``max_repeats`` times its
    source's size; the excess goes to the others by weight: sources are filled in
    order of size per weight, each capped if the level left by those before it
    is above its cap.  The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    per = per.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    per = per.withColumn("cap", F.col("source_size") * max_repeats)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("total", F.sum("source_size").over(everything))
           .withColumn("all_weight", F.sum("weight").over(everything))
           .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0))))
    level = (F.col("total") - F.col("cap_before")).cast("double") / (F.col("all_weight") - F.col("weight_before"))
    per = per.withColumn("capped", F.col("cap") <= F.col("weight") * level)
    rest_weight = F.col("all_weight") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(everything), F.lit(0))
    rest_total = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    share = F.try_divide(rest_total.cast("double"), rest_weight) * F.col("weight")
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _boundaries(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, threshold): refine only the boundary bucket, level by level."""
    copies = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    state = (targets.withColumn("copies", copies)
             .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
             .withColumn("prefix", F.lit(0).cast("long")))
    kept = ["source", "source_size", "target", "copies"]
    for level, shift in enumerate(SHIFTS):
        s = state.withColumnRenamed("source", "s")
        held = docs.join(s, F.col("source").eqNullSafe(F.col("s")))
        if level:
            held = held.filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = held.groupBy(*kept, "rest", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = Window.partitionBy(*kept).orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("size").over(upto)).filter(F.col("upto") >= F.col("rest"))
        first = F.struct("bucket", "upto", "size", "rest")
        state = (hist.groupBy(*kept).agg(F.min(first).alias("b"))
                 .select(*kept, (F.col("b.rest") - (F.col("b.upto") - F.col("b.size"))).alias("rest"),
                         F.col("b.bucket").alias("prefix"), F.col("b.size").alias("last_size")))
    # the last bucket is one hash value: taken if that comes nearer to the budget
    nearer = F.abs(F.col("last_size") - F.col("rest")) < F.abs(F.col("rest"))
    return state.select(*kept, (F.col("prefix") + nearer.cast("long")).alias("threshold"))


def _hash(id_col: str, text_col: str):
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.md5(text_col)))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long")


def mixing_plan(docs: DataFrame, max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): (doc_id, source, size, h) of every document, and one row per source with its target and threshold."""
    narrow = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                word_count(F.col(text_col)).alias("size"), _hash(id_col, text_col).alias("h")), "mix-sizes")
    targets = staged(source_targets(narrow, max_repeats), "mix-targets")
    return narrow, staged(_boundaries(narrow, targets), "mix-thresholds")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, h, ...) with source_size, target and taken."""
    out = rows.join(plan.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_")))
    taken = F.col("size") * (F.col("copies") + (F.col("h") < F.col("threshold")).cast("long"))
    return out.select(*rows.columns, "source_size", "target", taken.alias("taken"))


def mix_to_weights(docs: DataFrame, max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source") -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted).

    Size is the number of words; a null or empty text has size 0 and is taken
    with 0 words.  A null source is a source of its own.  Rows that repeat an id
    with the same text share a hash and are taken together.  A source whose
    documents are all empty has target 0.  An empty table gives an empty
    result.  Other columns are ignored.
    """
    narrow, plan = mixing_plan(docs, max_repeats, id_col, text_col, source_col)
    return _taken(narrow, plan).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """The mix itself: every taken document once or as often as it is repeated, with the columns of ``docs``.

    Documents without words are not part of a mix.  Texts are not shuffled: the
    plan has one row per source and meets them where they are.
    """
    _, plan = mixing_plan(docs, max_repeats, id_col, text_col, source_col)
    whole = F.struct(*docs.columns).alias("whole")
    rows = docs.select(whole, F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _hash(id_col, text_col).alias("h"))
    taken = _taken(rows, plan).filter("size > 0 and taken > 0")
    times = F.sequence(F.lit(1).cast("long"), (F.col("taken") / F.col("size")).cast("long"))
    return taken.withColumn("time_", F.explode(times)).select("whole.*")
