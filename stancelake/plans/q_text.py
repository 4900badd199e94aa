"""Registered queries: post cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.fixtures import view, with_views
from . import sqlkit as S
from .registry import query


def _tweets(spark, sf):
    return view(spark, sf, "fx_tweets")


def _sql_clean(expr: str, min_words: bool) -> str:
    cond = f"WHERE tweet <> ''" + (f" AND {S.h17('tweet')} >= {T.MIN_NUM_WORDS}" if min_words else "")
    body = f"SELECT tweet_id, tweet FROM (SELECT tweet_id, {expr} AS tweet FROM fx_tweets) {cond}"
    return with_views(body, "fx_tweets")


@query("h_clean_p1", _sql_clean(S.clean_p1("tweet"), True))
def h_clean_p1(spark, sf):
    """Q1, profile P1 (classifier input): tags/emoji removed, C5 + C6."""
    return T.clean_posts(_tweets(spark, sf), "P1").select("tweet_id", "tweet")


@query("h_clean_p1_keep_tags", _sql_clean(S.clean_p1("tweet", tags=False), True))
def h_clean_p1_keep_tags(spark, sf):
    """P1 for the ``_with_@#emoji`` suffix: mentions, hashtags and emoji kept."""
    return (T.clean_posts(_tweets(spark, sf), "P1", remove_tags_and_emoji=False)
            .select("tweet_id", "tweet"))


@query("h_clean_p2", _sql_clean(S.clean_p2("tweet"), False))
def h_clean_p2(spark, sf):
    """Profile P2 (LLM stance input): entities decoded, only C5."""
    return T.clean_posts(_tweets(spark, sf), "P2").select("tweet_id", "tweet")


@query("h_clean_p2_emoji", _sql_clean(S.clean_p2("tweet", emoji=True), False))
def h_clean_p2_emoji(spark, sf):
    """Profile P2 with H13 (LLM topic-filtering input)."""
    return (T.clean_posts(_tweets(spark, sf), "P2", remove_tags_and_emoji=True)
            .select("tweet_id", "tweet"))


@query("h_clean_p3", with_views(f"SELECT tweet_id, {S.clean_p3('tweet')} AS tweet FROM fx_tweets",
                                "fx_tweets"))
def h_clean_p3(spark, sf):
    """Profile P3 (H16: URL, newline, CR, whitespace only; no row filter)."""
    return T.clean_posts(_tweets(spark, sf), "P3").select("tweet_id", "tweet")


@query("c5_drop_empty", with_views(
    f"SELECT tweet_id FROM fx_tweets WHERE {S.clean_p1('tweet')} = ''", "fx_tweets"))
def c5_drop_empty(spark, sf):
    """C5 seen from the other side: the posts that become empty under P1."""
    t = _tweets(spark, sf)
    return t.filter(T.clean_p1("tweet") == "").select("tweet_id")


@query("c6_min_words", with_views(
    f"SELECT tweet_id, CAST({S.h17('c')} AS INTEGER) AS n_words FROM "
    f"(SELECT tweet_id, {S.clean_p2('tweet')} AS c FROM fx_tweets) "
    f"WHERE c <> '' AND {S.h17('c')} >= 4", "fx_tweets"))
def c6_min_words(spark, sf):
    """Posts with at least 4 blank-separated words (P2 text)."""
    t = T.once(_tweets(spark, sf).select("tweet_id", "tweet"), "c", T.clean_p2("tweet"))
    t = t.filter(F.col("c") != "").withColumn("n_words", T.word_count("c").cast("int"))
    return t.filter(F.col("n_words") >= T.MIN_NUM_WORDS).select("tweet_id", "n_words")


@query("e6_posts_per_party", with_views(
    f"SELECT election, user_screen_name AS party, CAST(count(*) AS BIGINT) AS num_posts FROM "
    f"(SELECT election, user_screen_name, {S.clean_p1('tweet')} AS c FROM fx_tweets) "
    f"WHERE c <> '' AND {S.h17('c')} >= 4 GROUP BY ALL", "fx_tweets"))
def e6_posts_per_party(spark, sf):
    """Posts per party after P1 cleaning."""
    t = T.clean_posts(_tweets(spark, sf), "P1")
    return (t.groupBy("election", F.col("user_screen_name").alias("party"))
            .agg(F.count(F.lit(1)).alias("num_posts")))


# One query per scalar text function, applied to every raw post.
_SCALARS = {
    "h1_strip_rt_header": (T.strip_rt_header, S.h1),
    "h2_strip_isolates": (T.strip_isolates, S.h2),
    "h3_strip_leading_mentions": (T.strip_leading_mentions, S.h3),
    "h4_strip_hashtags": (T.strip_hashtags, S.h4),
    "h5_strip_urls": (T.strip_urls, S.h5),
    "h6_drop_plus_plus": (T.drop_plus_plus, S.h6),
    "h8_newline_to_space": (T.newline_to_space, S.h8),
    "h9_decode_entities": (T.decode_entities_p2, S.h9),
    "h10_drop_entities": (T.drop_entities_p1, S.h10),
    "h12_lower": (T.lower, S.h12),
    "h13_strip_emoji": (T.strip_emoji, S.h13),
    "h14_squeeze_whitespace": (T.squeeze_whitespace, S.h14),
    "h15_rstrip": (T.rstrip, S.h15),
}

for _name, (_fn, _sql) in _SCALARS.items():
    query(_name, with_views(f"SELECT tweet_id, {_sql('tweet')} AS tweet FROM fx_tweets", "fx_tweets"))(
        lambda spark, sf, _f=_fn: _tweets(spark, sf).select("tweet_id", _f("tweet").alias("tweet")))


@query("h17_word_count", with_views(
    f"SELECT tweet_id, CAST({S.h17('tweet')} AS INTEGER) AS n_words FROM fx_tweets", "fx_tweets"))
def h17_word_count(spark, sf):
    return _tweets(spark, sf).select("tweet_id", T.word_count("tweet").cast("int").alias("n_words"))
