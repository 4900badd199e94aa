"""Registered queries: score table from text and the sweep over every dimension."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.labels import ALGORITHMS, TOPIC_THRESHOLDS
from ..operators import agree, textjoin, topics
from ..operators.joins import first_sentence_per_topic
from ..operators.topics import DATASETS
from ..sources.fixtures import view, with_views
from . import sqlkit as S
from .q_topics import MODELS, SUFFIXES
from .registry import query

LOWEST = min(TOPIC_THRESHOLDS)
# The suffix that keeps tags and emoji belongs to the tweet-tuned model only.
PAIRS = [(m, x) for m in MODELS for x in SUFFIXES if x == "" or "covid" in m]
KEYS = ("model", "suffix", "dataset", "election", "screen_name", "topic")


def _variants(spark, sf):
    """Posts in both cleaning variants, without and with tags and emoji; a text that has neither is cleaned once and is of both."""
    tw = view(spark, sf, "fx_tweets").select("election", F.col("user_screen_name").alias("screen_name"), "tweet_id", "user_id", "created_at", "tweet")
    tw = T.once(tw, "marked", F.coalesce(T.has_tags_or_emoji("tweet"), F.lit(False)))
    plain, kept = (F.array(*(F.lit(x) for x in SUFFIXES if (x == "") == tags)) for tags in (True, False))
    first = F.struct(F.when(F.col("marked"), plain).otherwise(F.concat(plain, kept)).alias("suffixes"),
                     F.when(F.col("marked"), T.clean_p1("tweet")).otherwise(T.clean_p1("tweet", False)).alias("tweet"))
    second = F.struct(F.when(F.col("marked"), kept).alias("suffixes"), F.when(F.col("marked"), T.clean_p1("tweet", False)).alias("tweet"))
    return (tw.select("election", "screen_name", "tweet_id", "user_id", "created_at", F.inline(F.array(first, second)))
            .filter(F.col("tweet") != "").filter(T.word_count("tweet") >= T.MIN_NUM_WORDS))


def _posts(spark, sf):
    """``_variants`` with a row for each variant."""
    return _variants(spark, sf).select("election", F.explode("suffixes").alias("suffix"), "screen_name", "tweet_id", "user_id", "created_at", "tweet")


def _held(spark, sf):
    return textjoin.scored_posts(_variants(spark, sf), view(spark, sf, "fx_topic_labels"), PAIRS)


def _posts_sql() -> str:
    parts = [f"SELECT election, {S.lit(x)} AS suffix, user_screen_name AS screen_name, tweet_id, user_id, created_at, "
             f"{S.clean_p1('tweet', tags=x == '')} AS tweet FROM fx_tweets" for x in SUFFIXES]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE tweet <> '' AND {S.h17('tweet')} >= 4"


def _table_sql(least: float) -> str:
    """All pairs, scored and filtered."""
    pairs = " UNION ALL ".join(f"SELECT {S.lit(m)} AS model, {S.lit(x)} AS suffix" for m, x in PAIRS)
    label = ("CASE WHEN contains(model, 'DeBERTa') THEN topic_label WHEN contains(model, 'bart') "
             "THEN concat('This text is about ', topic_label, '.') ELSE concat('This example is ', topic_label, '.') END")
    share = lambda c: f"len(list_intersect(p.tk, l.{c})) / len(l.{c})"
    return f"""
SELECT p.election, l.model, l.suffix, p.screen_name, p.tweet_id, p.user_id, p.created_at, l.topic, {share('t')} AS score_topic,
  l.sentence, {share('s')} AS score_sentence
FROM (SELECT *, {S.tokens('tweet')} AS tk FROM ({_posts_sql()})) p
JOIN (SELECT f.election, f.topic, f.sentence, m.model, m.suffix, {S.tokens(label)} AS t, {S.tokens('f.sentence')} AS s
      FROM fx_topic_labels f CROSS JOIN ({pairs}) m) l ON l.election = p.election AND l.suffix = p.suffix
WHERE len(l.t) > 0 AND {share('t')} >= {S.dbl(least)}
"""


@query("t6_scores_from_text", with_views(f"""
SELECT election, model, suffix, screen_name, tweet_id, user_id, topic, round(score_topic, 6) AS score_topic, sentence,
  round(score_sentence, 6) AS score_sentence FROM ({_table_sql(LOWEST)})
""", "fx_tweets", "fx_topic_labels"))
def t6_scores_from_text(spark, sf):
    """Raw posts -> both cleaning variants -> every (post, topic, model) whose topic score
    reaches the lowest threshold, by the rare-token join, with the sentence's score."""
    out = textjoin.score_table(_held(spark, sf), view(spark, sf, "fx_topic_labels"), PAIRS, LOWEST)
    return out.select("election", "model", "suffix", "screen_name", "tweet_id", "user_id", "topic", F.round("score_topic", 6).alias("score_topic"),
                      "sentence", F.round("score_sentence", 6).alias("score_sentence"))


def _sweep_sql() -> str:
    unions = "\n  UNION ALL\n  ".join(S.algorithm_select(a, "cnt", KEYS) for a in ALGORITHMS)
    windows = " UNION ALL ".join(f"SELECT '{k}' AS dataset, {v} AS m" for k, v in DATASETS.items())
    pairs = " UNION ALL ".join(f"SELECT {S.lit(m)} AS model, {S.lit(x)} AS suffix" for m, x in PAIRS)
    inside = lambda t: (f"FROM {t} x JOIN fx_calendar c ON c.election = x.election JOIN ({windows}) d "  # noqa: E731
                        f"ON x.created_at >= c.election_ts - to_months(d.m) AND x.created_at < c.election_ts")
    body = f"""
WITH posts AS ({_posts_sql()}),
t6 AS ({_table_sql(LOWEST)}),
sc AS (SELECT d.dataset, x.* {inside('t6')}),
grid AS (SELECT DISTINCT m.model, x.suffix, d.dataset, x.election, x.screen_name, k.topic {inside('posts')}
         JOIN ({pairs}) m ON m.suffix = x.suffix JOIN fx_topic_labels k ON k.election = x.election),
cnt AS ({S.counts_cte('sc', KEYS, grid_src='grid')}),
res AS (
  {unions})
SELECT r.model, r.suffix, r.dataset, r.election, r.screen_name, r.topic, k.sentence, r.algorithm, r.threshold_topic,
  r.avg_agreement, r.agreement_level, r.num_tweets
FROM res r JOIN fx_topic_labels k ON k.election = r.election AND k.topic = r.topic
"""
    return with_views(body, "fx_tweets", "fx_topic_labels", "fx_calendar")


@query("e16_sweep_from_text", _sweep_sql())
def e16_sweep_from_text(spark, sf):
    """E16 over every dimension: model x suffix x dataset x party x topic x algorithm x threshold, from raw posts.

    One score table, one band aggregate; parties with posts in a window but
    none left by the filter stay, by the dense grid."""
    calendar = view(spark, sf, "fx_calendar")
    labels = view(spark, sf, "fx_topic_labels")
    held = _held(spark, sf)
    scores = topics.dataset_windows(textjoin.score_table(held, labels, PAIRS, LOWEST), calendar)
    valid = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(x).alias("valid")) for m, x in PAIRS))
    parties = topics.dataset_windows(held, calendar).select("dataset", "suffix", "election", "screen_name").distinct()
    grid = (parties.select("*", F.inline(valid)).filter("suffix = valid").drop("valid")
            .join(labels.select("election", "topic"), "election"))
    totals = agree.threshold_counts(scores, KEYS, TOPIC_THRESHOLDS, grid)
    out = agree.apply_algorithms(totals, KEYS, ALGORITHMS).join(first_sentence_per_topic(labels), ["election", "topic"])
    return out.select(*KEYS, "sentence", "algorithm", "threshold_topic", F.round("avg_agreement", 6).alias("avg_agreement"),
                      "agreement_level", "num_tweets")
