"""Evaluation against golden labels (Q6: A4, D3, E8-E12, G3, H20, H21).

All methods are evaluated in one pass: their results stand in one table, are
joined with the golden labels once, and are counted into confusion cells
(method, scale, election, gold, predicted), a null prediction being a cell of its own.
Weighted F1 and MAE of every election follow from the cells, and the means over
elections are a grouping set of the same aggregate.  Everything after the cells is tiny.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import three_calculated, three_derived
from .joins import exclude_parties

RESULT_COLS = ("VAA", "Party", "Topic", "Sentence", "Stance")

# Published row of the classifier-only method (fixed values of the reference;
# its 3-label-calculated F1 is printed as '--', i.e. not available).
BASELINE_ROW = {"Method": "classifier only (published)", "avg_F1_l5": 0.29, "avg_F1_l3_der": 0.53,
                "avg_F1_l3_cal": None, "avg_MAE_l5": 1.56, "avg_MAE_l3_der": 0.85}


def golden_from_nested(nested: DataFrame, excluded=()) -> DataFrame:
    """(VAA, Party, map<statement, label>) -> one row per statement."""
    rows = nested.select("VAA", "Party", F.explode("labels").alias("statement", "golden_label"))
    if excluded:
        rows = exclude_parties(rows, excluded, col="Party")                  # C4
    return rows.withColumn("golden_label", F.col("golden_label").cast("int")) \
               .withColumn("golden_label_three", three_derived("golden_label"))


def prepare_results(results: DataFrame, num_labels: int) -> DataFrame:
    """E8 + H20/H21: dedupe full rows, then map the stance to the label scale."""
    r = results.select(*RESULT_COLS).dropDuplicates()                        # E8
    if num_labels == 3:
        return r.withColumn("answer", three_calculated("Stance")).withColumn("answer_three", F.lit(None).cast("int"))
    return r.withColumn("answer", F.col("Stance").cast("int")).withColumn("answer_three", three_derived("Stance"))


def join_golden(results: DataFrame, golden: DataFrame) -> DataFrame:
    """D3: inner join on (VAA, Party, Sentence = statement)."""
    g = golden.withColumnRenamed("statement", "Sentence")
    return results.join(g, on=["VAA", "Party", "Sentence"], how="inner")


def scored_pairs(results: DataFrame, golden: DataFrame) -> DataFrame:
    """(Method, scale, VAA, gold, pred) of all methods, from one scan of their results.

    ``results``: (Method, num_labels, VAA, Party, Topic, Sentence, Stance).  Full duplicates are dropped (E8).
    A run with 5 labels gives the scales l5 and l3_der (H20), one with 3 labels l3_cal (H21).
    """
    r = results.select("Method", "num_labels", *RESULT_COLS).dropDuplicates()
    joined = join_golden(r, golden)
    pair = lambda scale, gold, pred: F.struct(F.lit(scale).alias("scale"), gold.cast("int").alias("gold"), pred.cast("int").alias("pred"))
    five = F.array(pair("l5", F.col("golden_label"), F.col("Stance")),
                   pair("l3_der", F.col("golden_label_three"), F.when(F.col("Stance").isNotNull(), three_derived("Stance"))))
    three = F.array(pair("l3_cal", F.col("golden_label_three"), three_calculated("Stance")))
    return joined.select("Method", "VAA", F.inline(F.when(F.col("num_labels") == 3, three).otherwise(five)))


def confusion(pairs: DataFrame) -> DataFrame:
    """Cells (Method, scale, VAA, gold, pred, cnt); partial counts are combined before the shuffle."""
    return pairs.groupBy("Method", "scale", "VAA", "gold", "pred").agg(F.count(F.lit(1)).alias("cnt"))


def per_election_metrics(pairs: DataFrame) -> DataFrame:
    """E9 + E10: weighted F1 and MAE per (Method, scale, VAA), with n and n_invalid.

    Rows whose prediction is null (a 3-label answer outside {2,3,4}, an unparsed
    reply) are not scored but counted in ``n_invalid``; an election in which
    nothing could be scored stays, with null metrics and n = 0.
    """
    keys = ["Method", "scale", "VAA"]
    told, zero = F.col("pred").isNotNull(), F.lit(0).cast("long")
    # a cell feeds its gold class (support, hits, errors) and its predicted class
    roles = F.array(
        F.struct(F.col("gold").alias("k"), F.when(told, F.col("cnt")).otherwise(0).alias("sup"), zero.alias("prd"),
                 F.when(F.col("gold") == F.col("pred"), F.col("cnt")).otherwise(0).alias("tp"),
                 F.when(told, F.col("cnt") * F.abs(F.col("gold") - F.col("pred"))).otherwise(0).alias("err"),
                 F.when(told, 0).otherwise(F.col("cnt")).alias("inv")),
        F.struct(F.coalesce("pred", "gold").alias("k"), zero.alias("sup"), F.when(told, F.col("cnt")).otherwise(0).alias("prd"),
                 zero.alias("tp"), zero.alias("err"), zero.alias("inv")))
    sums = [F.sum(f"r.{c}").alias(c) for c in ("sup", "prd", "tp", "err", "inv")]
    per_class = confusion(pairs).select(*keys, F.explode(roles).alias("r")).groupBy(*keys, "r.k").agg(*sums)
    f1 = F.when(F.col("sup") + F.col("prd") > 0, 2.0 * F.col("tp") / (F.col("sup") + F.col("prd"))).otherwise(0.0)
    return per_class.groupBy(*keys).agg(
        F.try_divide(F.sum(f1 * F.col("sup")), F.sum("sup")).alias("f1_weighted"),
        F.try_divide(F.sum("err").cast("double"), F.sum("sup")).alias("mae"), F.sum("sup").alias("n"), F.sum("inv").alias("n_invalid"))


def metrics_and_means(pairs: DataFrame) -> DataFrame:
    """E9-E11 in one aggregate: rows of every (Method, scale, VAA), and of (Method, scale) with VAA null, the
    unweighted mean over elections that could be scored (``n_elections``)."""
    m = per_election_metrics(pairs)
    sets = m.groupingSets([["Method", "scale", "VAA"], ["Method", "scale"]], "Method", "scale", "VAA")
    return sets.agg(F.avg("f1_weighted").alias("f1_weighted"), F.avg("mae").alias("mae"), F.sum("n").alias("n"), F.sum("n_invalid").alias("n_invalid"),
                    F.count("f1_weighted").alias("n_elections"), F.grouping("VAA").cast("int").alias("is_mean"))


def mean_over_elections(metrics: DataFrame) -> DataFrame:
    """Unweighted mean over elections."""
    return (metrics.groupBy("Method", "scale")
            .agg(F.avg("f1_weighted").alias("avg_f1"), F.avg("mae").alias("avg_mae"),
                 F.count("f1_weighted").alias("n_elections")))


def method_table(means: DataFrame, with_baseline: bool = True) -> DataFrame:
    """E12 + G3: one row per method, explicit pivot values, plus the baseline."""
    cols = []
    for scale in ("l5", "l3_der", "l3_cal"):
        cols.append(F.max(F.when(F.col("scale") == scale, F.col("avg_f1"))).alias(f"avg_F1_{scale}"))
    for scale in ("l5", "l3_der", "l3_cal"):
        cols.append(F.max(F.when(F.col("scale") == scale, F.col("avg_mae"))).alias(f"avg_MAE_{scale}"))
    table = means.groupBy("Method").agg(*cols)
    if with_baseline:
        spark = means.sparkSession
        schema = ("Method string, avg_F1_l5 double, avg_F1_l3_der double, avg_F1_l3_cal double, "
                  "avg_MAE_l5 double, avg_MAE_l3_der double")
        base = spark.createDataFrame([tuple(BASELINE_ROW.values())], schema)
        table = table.unionByName(base, allowMissingColumns=True)
    return table
