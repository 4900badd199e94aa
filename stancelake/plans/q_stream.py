"""Registered queries: streaming equals batch (M9: K2, K3, G2, E17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.fixtures import view, with_views
from ..streaming import incremental as K
from . import sqlkit as S
from .registry import query


def _landed(spark, sf, name):
    """Land the posts in three arrivals; the third replays the first."""
    loc = K.stream_folder(spark, name)
    posts = view(spark, sf, "fx_tweets")
    early = F.col("created_at") < F.lit("2019-04-01 00:00:00").cast("timestamp")
    K.land_posts(posts, loc["landing"], [early, ~early, early])
    return loc


@query("k2_stream_equals_batch", with_views(
    f"SELECT tweet_id, tweet FROM (SELECT tweet_id, {S.clean_p1('tweet')} AS tweet FROM fx_tweets) "
    f"WHERE tweet <> '' AND {S.h17('tweet')} >= 4", "fx_tweets"))
def k2_stream_equals_batch(spark, sf):
    """Micro-batch cleaning with replay de-duplication, appended to a
    table; read back it equals the batch cleaning (h_clean_p1)."""
    loc = _landed(spark, sf, "k2")
    K.run_clean_stream(spark, loc["landing"], loc["out"], loc["checkpoint"])
    return spark.read.parquet(loc["out"]).select("tweet_id", "tweet")


@query("k3_stream_counts", with_views(
    f"SELECT election, user_screen_name AS party, CAST(count(*) AS BIGINT) AS num_posts FROM "
    f"(SELECT election, user_screen_name, {S.clean_p1('tweet')} AS c FROM fx_tweets) "
    f"WHERE c <> '' AND {S.h17('c')} >= 4 GROUP BY ALL", "fx_tweets"))
def k3_stream_counts(spark, sf):
    """K3: running posts-per-party counts from the stream (final state)."""
    loc = _landed(spark, sf, "k3")
    return K.run_party_counts(spark, loc["landing"], loc["out"], loc["checkpoint"]).latest()


def _scores_sql():
    return with_views(f"""
WITH tw AS (SELECT election, user_screen_name AS screen_name, tweet_id, tweet FROM
            (SELECT election, user_screen_name, tweet_id, {S.clean_p1('tweet')} AS tweet FROM fx_tweets)
            WHERE tweet <> '' AND {S.h17('tweet')} >= 4),
l AS (SELECT election, topic, len(tk) AS n, unnest(tk) AS token
      FROM (SELECT election, topic, {S.tokens('sentence')} AS tk FROM fx_statements)),
p AS (SELECT election, screen_name, tweet_id, unnest({S.tokens('tweet')}) AS token FROM tw)
SELECT p.election, p.screen_name, p.tweet_id, l.topic, round(count(*) / any_value(l.n), 6) AS score
FROM p JOIN l ON p.election = l.election AND p.token = l.token
GROUP BY p.election, p.screen_name, p.tweet_id, l.topic
""", "fx_tweets", "fx_statements")


@query("k2_stream_scores", _scores_sql())
def k2_stream_scores(spark, sf):
    """K2 with scoring per micro-batch (idempotent batch outputs): the
    streamed scores equal the batch lexical scores of the cleaned posts."""
    loc = _landed(spark, sf, "k2s")
    labels = view(spark, sf, "fx_statements").select("election", "topic", F.col("sentence").alias("label_text"))
    s = K.run_score_stream(spark, loc["landing"], labels, loc["out"], loc["checkpoint"]).read()
    return s.select("election", "screen_name", "tweet_id", "topic", F.round("score", 6).alias("score"))


@query("k2_any_lateness", with_views(
    f"SELECT tweet_id, tweet FROM (SELECT tweet_id, {S.clean_p1('tweet')} AS tweet FROM fx_tweets) "
    f"WHERE tweet <> '' AND {S.h17('tweet')} >= 4", "fx_tweets"))
def k2_any_lateness(spark, sf):
    """K2 over any lateness: posts up to 800 days older than those before them, arriving
    newest first, with replays of both ends; every post comes out once."""
    loc = K.stream_folder(spark, "k2-late")
    age = F.col("doc_id") % 5
    posts = view(spark, sf, "fx_tweets").withColumn("created_at", F.col("created_at") - F.make_interval(days=(age * 200).cast("int")))
    for arrivals in ([age == 0, age == 1], [age == 4, age == 0], [age == 2, age == 3, age == 4, age == 0]):     # three runs, each a restart
        K.land_posts(posts, loc["landing"], arrivals)
        K.run_clean_stream(spark, loc["landing"], loc["out"], loc["checkpoint"])
    return spark.read.parquet(loc["out"]).select("tweet_id", "tweet")


@query("e17_stream_progress", with_views(f"""
SELECT 'clean' AS query_name, CAST(a AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS rows_in,
  CAST(count(*) FILTER (WHERE c <> '' AND {S.h17('c')} >= 4) AS BIGINT) AS rows_kept
FROM (SELECT unnest(CASE WHEN early THEN [0, 2] ELSE [1] END) AS a, c FROM
      (SELECT created_at < TIMESTAMP '2019-04-01 00:00:00' AS early, {S.clean_p1('tweet')} AS c FROM fx_tweets))
GROUP BY a
""", "fx_tweets"))
def e17_stream_progress(spark, sf):
    """One row of counts per micro-batch (posts read, posts kept by cleaning), written by
    a streaming listener; three arrivals, each a run of its own, the third a replay."""
    loc = K.stream_folder(spark, "e17")
    posts = view(spark, sf, "fx_tweets")
    early = F.col("created_at") < F.lit("2019-04-01 00:00:00").cast("timestamp")
    for arrival in (early, ~early, early):
        K.land_posts(posts, loc["landing"], [arrival])
        ledger = K.run_clean_stream_observed(spark, loc["landing"], loc["out"], loc["checkpoint"], f"{loc['out']}-progress", max_files=1_000_000)
    return ledger.read().select("query_name", "batch_id", "rows_in", "rows_kept")


@query("k1_resume_ledger", with_views(f"""
SELECT tweet_id, CASE WHEN tweet <> '' AND {S.h17('tweet')} >= 4 THEN md5(tweet) END AS tweet_md5,
  CASE WHEN created_at < TIMESTAMP '2019-04-01 00:00:00' THEN 1 ELSE 2 END AS run
FROM (SELECT tweet_id, created_at, {S.clean_p1('tweet')} AS tweet FROM fx_tweets)
""", "fx_tweets"))
def k1_resume_ledger(spark, sf):
    """A first run over the posts before April commits its batches; a second one over all
    posts reads the finished keys from them and cleans only the rest."""
    path = K.stream_folder(spark, "k1")["out"]
    posts = view(spark, sf, "fx_tweets")
    first = K.clean_resumable(posts.filter(F.col("created_at") < F.lit("2019-04-01 00:00:00").cast("timestamp")), path, batches=3)
    made = first.batches().select("batch", F.lit(1).alias("run")).collect()         # a row a batch
    both = K.clean_resumable(posts, path, batches=3)
    run = F.when(F.col("batch").isin(*[r.batch for r in made]), 1).otherwise(2)
    return both.rows().select("tweet_id", F.md5("tweet").alias("tweet_md5"), run.alias("run"))
