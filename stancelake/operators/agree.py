"""Agreement levels from post scores.

One aggregation serves every threshold and every algorithm:

1. ``band`` = number of topic thresholds a post reaches (0..T).  Group by
   ``keys + band`` and compute counts and sums (map-side partial aggregation,
   so a hot party costs nothing extra in the shuffle).
2. Each band row contributes to the thresholds it reaches; a second tiny
   aggregation gives the totals per ``keys + threshold``.  Band-0 rows keep
   every (key, threshold) pair alive, which is the dense grid D7.
3. Each algorithm is a projection of those totals.

The shuffle volume does not depend on the number of thresholds or
algorithms, and the facts are scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import (ALGORITHMS, FINAL_THRESHOLDS_5, TOPIC_THRESHOLDS, label4,
                                label5, missing, parse_algorithm)
from .joins import first_sentence_per_topic, small

DEFAULT_KEYS = ("election", "screen_name", "topic")
NEUTRAL_LEVEL = 3


def _band(score_topic: Column, thresholds) -> Column:
    ts = sorted(float(t) for t in thresholds)
    band = F.lit(0)
    for i, t in enumerate(ts):
        band = F.when(score_topic >= F.lit(t), F.lit(i + 1)).otherwise(band)
    return F.when(missing(score_topic), F.lit(0)).otherwise(band)


def band_counts(scores: DataFrame, keys=DEFAULT_KEYS, thresholds=TOPIC_THRESHOLDS,
                topic_col: str = "score_topic", sentence_col: str = "score_sentence") -> DataFrame:
    """Step 1: per ``keys + band`` sufficient statistics for all algorithms."""
    w = F.col(topic_col)
    v = F.col(sentence_col)
    l5 = label5(v)
    l4 = label4(v)
    aggs = [F.count(F.lit(1)).alias("n"),
            F.count_if(missing(v)).alias("nv"),
            F.sum(w).alias("sw"),
            F.sum(v * w).alias("svw"),
            F.sum(l5).alias("s5"),
            F.sum(l4).alias("s4")]
    aggs += [F.count_if(l5 == k).alias(f"c5_{k}") for k in range(1, 6)]
    aggs += [F.count_if(l4 == k).alias(f"c4_{k}") for k in range(1, 5)]
    return (scores.select(*keys, _band(w, thresholds).alias("band"), topic_col, sentence_col)
            .groupBy(*keys, "band").agg(*aggs))


STAT_COLS = ["n", "nv", "sw", "svw", "s5", "s4"] + [f"c5_{k}" for k in range(1, 6)] + \
            [f"c4_{k}" for k in range(1, 5)]


def threshold_counts(scores: DataFrame, keys=DEFAULT_KEYS, thresholds=TOPIC_THRESHOLDS,
                     grid: DataFrame | None = None, **cols) -> DataFrame:
    """Step 2: totals per ``keys + threshold_topic`` (dense: zero counts kept).

    ``grid`` (optional) lists extra key rows that must appear even without any
    score row, e.g. every (party, topic) of an election.
    """
    ts = sorted(float(t) for t in thresholds)
    bands = band_counts(scores, keys, ts, **cols)
    ix = F.explode(F.sequence(F.lit(1), F.lit(len(ts)))).alias("ix")
    per = bands.select(*keys, "band", *STAT_COLS, ix)
    sums = [F.expr(f"sum(CASE WHEN ix <= band THEN {c} ELSE 0 END)").alias(c) for c in STAT_COLS]
    totals = per.groupBy(*keys, "ix").agg(*sums)
    thr = F.element_at(F.array(*[F.lit(t) for t in ts]), F.col("ix"))
    totals = totals.withColumn("threshold_topic", thr).drop("ix")
    if grid is not None:
        g = grid.select(*keys).distinct().withColumn(
            "threshold_topic", F.explode(F.array(*[F.lit(t) for t in ts])))
        totals = g.join(totals, on=[*keys, "threshold_topic"], how="left")
        totals = totals.fillna(0, subset=STAT_COLS)
    return totals


# The per-algorithm projections are written as SQL expression text: one
# JVM call per algorithm instead of hundreds of small Column calls.

def _bucket_sql(x: str, thresholds) -> str:
    parts = " ".join(f"WHEN {x} >= {float(t)!r}D THEN {i + 2}"
                     for i, t in reversed(list(enumerate(sorted(thresholds)))))
    return f"CAST(CASE WHEN {x} IS NULL OR isnan({x}) THEN 1 {parts} ELSE 1 END AS INT)"


def _majority_sql(prefix: str, labels, s: str) -> str:
    """The single most frequent label, else half-even mean of all labels."""
    counts = [f"{prefix}{k}" for k in labels]
    top = f"greatest({', '.join(counts)})"
    n_top = " + ".join(f"CAST({c} = {top} AS INT)" for c in counts)
    winner = "CASE " + " ".join(f"WHEN {c} = {top} THEN {k}" for k, c in zip(labels, counts)) + " END"
    return f"CAST(CASE WHEN {n_top} = 1 THEN {winner} ELSE bround({s} / n, 0) END AS INT)"


def algorithm_sql(name: str) -> tuple[str, str]:
    """(avg_agreement, agreement_level) SQL of one algorithm over the totals."""
    k, min_posts = parse_algorithm(name)
    if k == 1:
        # A missing sentence score makes the weighted mean undefined (NaN in
        # the reference), which buckets to label 1.  Rounded to 12 digits so
        # summation order cannot flip a label.
        avg = "round(svw / sw, 12)"
        ok = "n > 0 AND nv = 0"
        level = (f"CASE WHEN {ok} THEN {_bucket_sql(avg, FINAL_THRESHOLDS_5)} "
                 f"WHEN n > 0 THEN 1 ELSE {NEUTRAL_LEVEL} END")
        return f"CASE WHEN {ok} THEN {avg} END", level
    if k == 2:
        level = "CAST(bround(s5 / n, 0) AS INT)"
    elif k == 3:
        level = _majority_sql("c5_", range(1, 6), "s5")
    else:
        m = _majority_sql("c4_", range(1, 5), "s4")
        level = (f"CASE WHEN n < {min_posts} THEN {NEUTRAL_LEVEL} "
                 f"ELSE (CASE WHEN {m} = 3 THEN 4 WHEN {m} = 4 THEN 5 ELSE {m} END) END")
    return "CAST(NULL AS DOUBLE)", f"CASE WHEN n > 0 THEN {level} ELSE {NEUTRAL_LEVEL} END"


def apply_algorithms(totals: DataFrame, keys, algorithms=ALGORITHMS) -> DataFrame:
    """Step 3: one row per algorithm; pure projection, no shuffle."""
    structs = []
    for name in algorithms:
        avg, level = algorithm_sql(name)
        structs.append(f"named_struct('algorithm', '{name}', 'avg_agreement', CAST({avg} AS DOUBLE), "
                       f"'agreement_level', CAST({level} AS INT))")
    out = totals.select(*keys, "threshold_topic", F.col("n").alias("num_tweets"),
                        F.explode(F.expr(f"array({', '.join(structs)})")).alias("r"))
    return out.select(*keys, "r.algorithm", "threshold_topic", "r.avg_agreement",
                      "r.agreement_level", "num_tweets")


def agreement_sweep(scores: DataFrame, statements: DataFrame | None = None,
                    keys=DEFAULT_KEYS, thresholds=TOPIC_THRESHOLDS,
                    algorithms=ALGORITHMS, grid: DataFrame | None = None) -> DataFrame:
    """Agreement table (T7) for every algorithm x threshold in one pass.

    ``statements`` (election, topic, sentence[, topic_ix]) restricts the scores
    to known topics (C2) and supplies the sentence (D1).  Keys must contain
    ``election`` and ``topic`` when statements are given.
    """
    for a in algorithms:
        parse_algorithm(a)               # fail fast on a bad parameter
    if statements is not None:
        lookup = small(first_sentence_per_topic(statements))
        scores = scores.join(lookup.select("election", "topic"), ["election", "topic"], "left_semi")
    totals = threshold_counts(scores, keys, thresholds, grid)
    out = apply_algorithms(totals, keys, algorithms)
    if statements is not None:
        out = out.join(lookup, ["election", "topic"], "inner")
    return out


def label_histogram(scores: DataFrame, keys=DEFAULT_KEYS, thresholds=TOPIC_THRESHOLDS,
                    four_way: bool = False) -> DataFrame:
    """Label counts per key and threshold (5-way, or the 4-way vote)."""
    totals = threshold_counts(scores, keys, thresholds)
    if four_way:
        cols = [F.col(f"c4_{k}").alias(f"n_label_{k}") for k in range(1, 5)]
    else:
        cols = [F.col(f"c5_{k}").alias(f"n_label_{k}") for k in range(1, 6)]
    return totals.select(*keys, "threshold_topic", F.col("n").alias("num_tweets"), *cols)


def hybrid_agreement(filtered: DataFrame, scores: DataFrame, grid: DataFrame,
                     min_posts: int = 3,
                     keys=("election", "party", "topic")) -> DataFrame:
    """E5/Q5: algorithm_4 over model-filtered posts joined to their scores.

    ``filtered``: (election, party, topic, tweet_id) chosen by a topic model.
    ``scores``: (election, screen_name, topic, tweet_id, score_sentence).
    ``grid``: every (election, party, topic) that needs an answer; pairs
    without posts get 3.  No score threshold; a post without a score row
    still counts and gets label 1 (D4).
    """
    s = scores.select("election", F.col("screen_name").alias("party"), "topic", "tweet_id",
                      "score_sentence")
    joined = filtered.select(*keys, "tweet_id").join(s, on=[*keys, "tweet_id"], how="left")
    l4 = label4("score_sentence")
    agg = (joined.groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("n"), F.sum(l4).alias("s4"),
                *[F.count_if(l4 == k).alias(f"c4_{k}") for k in range(1, 5)]))
    m = _majority_sql("c4_", range(1, 5), "s4")
    level = F.expr(f"CASE WHEN n < {int(min_posts)} THEN {NEUTRAL_LEVEL} "
                   f"ELSE (CASE WHEN {m} = 3 THEN 4 WHEN {m} = 4 THEN 5 ELSE {m} END) END")
    res = agg.select(*keys, F.col("n").alias("num_tweets"), level.alias("stance"))
    out = grid.select(*keys).distinct().join(res, on=list(keys), how="left")
    return out.select(*keys, F.coalesce("num_tweets", F.lit(0)).alias("num_tweets"),
                      F.coalesce("stance", F.lit(NEUTRAL_LEVEL)).cast("int").alias("stance"))
