"""Registered queries: agreement sweep and the single algorithms (M0/M1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import ALGORITHMS, TOPIC_THRESHOLDS, label4, label5, remap_algorithm4
from ..operators import agree, topics
from ..operators.topics import DATASETS
from ..sources.fixtures import view, with_views
from . import sqlkit as S
from .registry import query

KEYS = ("election", "screen_name", "topic")
OUT = ["election", "screen_name", "topic", "sentence", "algorithm", "threshold_topic",
       "avg_agreement", "agreement_level", "num_tweets"]


def _sweep(spark, sf, algorithms, thresholds=TOPIC_THRESHOLDS):
    scores = view(spark, sf, "fx_scores")
    statements = view(spark, sf, "fx_statements")
    out = agree.agreement_sweep(scores, statements, KEYS, thresholds, algorithms)
    return out.select(*OUT).withColumn("avg_agreement", F.round("avg_agreement", 6))


def sweep_select(algorithms, thresholds=TOPIC_THRESHOLDS) -> str:
    """Stand-alone DuckDB SELECT of the sweep over fx_scores / fx_statements."""
    unions = "\n  UNION ALL\n  ".join(S.algorithm_select(a, "cnt", KEYS) for a in algorithms)
    return f"""
WITH known AS ({S.known_topics_cte()}),
sc AS (SELECT s.* FROM fx_scores s WHERE EXISTS
       (SELECT 1 FROM known k WHERE k.election = s.election AND k.topic = s.topic)),
cnt AS ({S.counts_cte('sc', KEYS, thresholds)}),
res AS (
  {unions})
SELECT r.election, r.screen_name, r.topic, k.sentence, r.algorithm, r.threshold_topic,
  r.avg_agreement, r.agreement_level, r.num_tweets
FROM res r JOIN known k ON k.election = r.election AND k.topic = r.topic
"""


def _sweep_sql(algorithms) -> str:
    return with_views(sweep_select(algorithms), "fx_scores", "fx_statements")


@query("q2_agreement_sweep", _sweep_sql(ALGORITHMS))
def q2_agreement_sweep(spark, sf):
    """Flagship: T7 for all five algorithms x five topic thresholds."""
    return _sweep(spark, sf, ALGORITHMS)


for _name, _alg in (("e1_weighted_mean", "algorithm_1"),
                    ("e2_label_mean", "algorithm_2"),
                    ("e3_majority", "algorithm_3"),
                    ("e4_majority_min3", "algorithm_4_min_num_tweets_3")):
    query(_name, _sweep_sql([_alg]))(lambda spark, sf, _a=_alg: _sweep(spark, sf, [_a]))


def _histogram_sql() -> str:
    body = f"""
WITH cnt AS ({S.counts_cte('fx_scores', KEYS)})
SELECT election, screen_name, topic, threshold_topic, CAST(n AS BIGINT) AS num_tweets,
  {', '.join(f'CAST(c5_{k} AS BIGINT) AS n_label_{k}' for k in range(1, 6))}
FROM cnt
"""
    return with_views(body, "fx_scores")


@query("e14_label_histogram", _histogram_sql())
def e14_label_histogram(spark, sf):
    return agree.label_histogram(view(spark, sf, "fx_scores"), KEYS)


def _num_tweets_sql() -> str:
    body = f"""
SELECT g.election, g.screen_name, g.topic, g.threshold_topic,
  CAST(count(s.tweet_id) AS BIGINT) AS num_tweets
FROM (SELECT DISTINCT election, screen_name, topic, unnest({S.thresholds_list()}) AS threshold_topic
      FROM fx_scores) g
LEFT JOIN fx_scores s ON s.election = g.election AND s.screen_name = g.screen_name
  AND s.topic = g.topic AND s.score_topic >= g.threshold_topic
GROUP BY ALL
"""
    return with_views(body, "fx_scores")


@query("e15_num_tweets", _num_tweets_sql())
def e15_num_tweets(spark, sf):
    """E15 + D7: posts left after the topic filter, zero rows kept (dense grid)."""
    t = agree.threshold_counts(view(spark, sf, "fx_scores"), KEYS)
    return t.select(*KEYS, "threshold_topic", F.col("n").alias("num_tweets"))


query("d7_dense_grid", _num_tweets_sql())(
    lambda spark, sf: agree.threshold_counts(view(spark, sf, "fx_scores"), KEYS)
    .select(*KEYS, "threshold_topic", F.col("n").alias("num_tweets")))


# ------------------------------------------------ D1, E16, H18/H19 ---------

@query("d1_topic_sentence", with_views("""
WITH st AS (SELECT election, topic, topic_ix, sentence FROM fx_statements
            UNION ALL SELECT election, topic, topic_ix + 1000000, concat('duplicate of ', topic) FROM fx_statements)
SELECT election, topic, min_by(sentence, topic_ix) AS sentence FROM st GROUP BY election, topic
""", "fx_statements"))
def d1_topic_sentence(spark, sf):
    """Topic -> sentence; when a topic is listed twice the first listing wins."""
    st = view(spark, sf, "fx_statements")
    dup = st.select("election", "topic", (F.col("topic_ix") + 1000000).alias("topic_ix"),
                    F.concat(F.lit("duplicate of "), F.col("topic")).alias("sentence"))
    both = st.select("election", "topic", "topic_ix", "sentence").unionByName(dup)
    from ..operators.joins import first_sentence_per_topic
    return first_sentence_per_topic(both)


def _full_sweep_sql() -> str:
    keys = ("dataset", "election", "screen_name", "topic")
    unions = "\n  UNION ALL\n  ".join(S.algorithm_select(a, "cnt", keys) for a in ALGORITHMS)
    parts = " UNION ALL ".join(f"SELECT '{k}' AS dataset, {v} AS m" for k, v in DATASETS.items())
    body = f"""
WITH known AS ({S.known_topics_cte()}),
sc AS (SELECT d.dataset, s.* FROM fx_scores s JOIN fx_calendar c ON c.election = s.election
       JOIN ({parts}) d ON s.created_at >= c.election_ts - to_months(d.m) AND s.created_at < c.election_ts
       WHERE EXISTS (SELECT 1 FROM known k WHERE k.election = s.election AND k.topic = s.topic)),
cnt AS ({S.counts_cte('sc', keys)}),
res AS (
  {unions})
SELECT r.dataset, r.election, r.screen_name, r.topic, r.algorithm, r.threshold_topic,
  r.avg_agreement, r.agreement_level, r.num_tweets
FROM res r
"""
    return with_views(body, "fx_scores", "fx_statements", "fx_calendar")


@query("e16_full_sweep", _full_sweep_sql())
def e16_full_sweep(spark, sf):
    """E16 + C10: the sweep for every dataset window at once.  Posts are
    scored once (largest window); each post is tagged with the windows it
    falls in and the dataset becomes one more group key of the single
    band aggregate."""
    scores = topics.dataset_windows(view(spark, sf, "fx_scores"), view(spark, sf, "fx_calendar"))
    keys = ("dataset", "election", "screen_name", "topic")
    out = agree.agreement_sweep(scores, view(spark, sf, "fx_statements"), keys, TOPIC_THRESHOLDS, ALGORITHMS)
    return out.select("dataset", "election", "screen_name", "topic", "algorithm", "threshold_topic",
                      F.round("avg_agreement", 6).alias("avg_agreement"), "agreement_level", "num_tweets")


@query("h18_h19_buckets", with_views(f"""
SELECT tweet_id, topic, {S.label5('score_sentence')} AS label_5,
  {S.label4('score_sentence')} AS label_4, {S.remap4(S.label4('score_sentence'))} AS label_4_remapped
FROM fx_scores
""", "fx_scores"))
def h18_h19_buckets(spark, sf):
    """Per-post labels with four thresholds (1..5) and three
    thresholds (1..4, then 3 -> 4 and 4 -> 5)."""
    s = view(spark, sf, "fx_scores")
    return s.select("tweet_id", "topic", label5("score_sentence").alias("label_5"),
                    label4("score_sentence").alias("label_4"),
                    remap_algorithm4(label4("score_sentence")).alias("label_4_remapped"))
