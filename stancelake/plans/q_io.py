"""Registered queries: sources and sinks round trips."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import topics
from ..session import shared_path
from ..sources import io
from ..sources.fixtures import view, with_views
from .registry import query


@query("a1_statements_csv", with_views("SELECT topic, sentence FROM fx_statements", "fx_statements"))
def a1_statements_csv(spark, sf):
    """A8 -> A1: the statement list written as CSV files (header, quoted fields,
    embedded commas/quotes/newlines) and read back with the fixed-schema
    reader (dropna, list position kept)."""
    path = shared_path(spark, "statements-csv")
    io.write_list_csv(view(spark, sf, "fx_statements").select("topic_ix", "topic", "sentence"), path, "topic_ix", files=5)
    return io.load_statements_csv(spark, path).select("topic", "sentence")


@query("a1_statement_order", with_views("""
SELECT topic, sentence, CAST(lag(topic) OVER (PARTITION BY election ORDER BY topic_ix) AS VARCHAR) AS topic_before FROM fx_statements
""", "fx_statements"))
def a1_statement_order(spark, sf):
    """A1/D1 over a folder of many files: every topic is listed again, further on, with another sentence; the
    first listing wins, and each topic knows the one listed before it in its election."""
    path = shared_path(spark, "statements-many")
    st = view(spark, sf, "fx_statements").select("topic_ix", F.concat("election", F.lit("/"), "topic").alias("topic"), "sentence")
    again = st.select((F.col("topic_ix") + 1_000_000).alias("topic_ix"), "topic", F.concat(F.lit("again "), "topic").alias("sentence"))
    io.write_list_csv(st.unionByName(again), path, "topic_ix", files=7)
    back = io.load_statements_csv(spark, path)
    election, topic = F.split_part("topic", F.lit("/"), F.lit(1)), F.split_part("topic", F.lit("/"), F.lit(2))
    first = back.groupBy("topic").agg(F.min_by("sentence", "topic_ix").alias("sentence"), F.min("topic_ix").alias("topic_ix"))
    w = Window.partitionBy("election").orderBy("topic_ix")
    return (first.select(election.alias("election"), topic.alias("topic"), "sentence", "topic_ix")
            .select("topic", "sentence", F.lag("topic").over(w).alias("topic_before")))


@query("a2_scan_scores", with_views("""
SELECT tweet_id, topic, CASE WHEN doc_no % 10 = 0 THEN NULL ELSE round(score_topic, 6) END AS score_topic, round(score_sentence, 6) AS score_sentence
FROM (SELECT s.*, CAST(s.tweet_id AS BIGINT) AS doc_no FROM fx_scores s JOIN fx_calendar c ON c.election = s.election
      WHERE s.created_at >= c.election_ts - to_months(3) AND s.created_at < c.election_ts)
""", "fx_scores", "fx_calendar"))
def a2_scan_scores(spark, sf):
    """A2: score tables of every dataset window, partitioned by election, model, dataset and suffix, scanned for
    one window and model (other folders are pruned); NaN scores become null."""
    path = shared_path(spark, "scores")
    scores = topics.dataset_windows(view(spark, sf, "fx_scores"), view(spark, sf, "fx_calendar"))
    score = F.when(F.col("tweet_id").cast("long") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("score_topic"))
    one = scores.select("tweet_id", "topic", score.alias("score_topic"), "score_sentence", "election", "dataset", F.lit("").alias("suffix"))
    models = F.explode(F.array(F.lit("bart-large-mnli"), F.lit("other-model")))
    io.write_table(one.withColumn("model", models).withColumn("suffix", F.lit("plain")), path, ("election", "model", "dataset", "suffix"), balanced=True)
    back = io.load_scores(spark, path, model="bart-large-mnli", dataset="D3", suffix="plain")
    return back.select("tweet_id", "topic", F.round("score_topic", 6).alias("score_topic"), F.round("score_sentence", 6).alias("score_sentence"))


@query("a2_scan_posts", with_views("""
SELECT tweet_id, user_screen_name, md5(tweet) AS tweet_md5, election FROM fx_tweets
""", "fx_tweets"))
def a2_scan_posts(spark, sf):
    """A2: posts partitioned by election and suffix, scanned for one suffix."""
    path = shared_path(spark, "posts")
    posts = view(spark, sf, "fx_tweets").select("tweet_id", "user_screen_name", "tweet", "election")
    both = posts.withColumn("suffix", F.explode(F.array(F.lit("plain"), F.lit("emoji"))))
    io.write_table(both, path, ("election", "suffix"))
    back = io.load_posts(spark, path, suffix="emoji")
    return back.select("tweet_id", "user_screen_name", F.md5("tweet").alias("tweet_md5"), "election")


@query("a6_topic_partitions", with_views(
    "SELECT election, screen_name, topic, tweet_id FROM fx_scores WHERE score_topic >= 0.9e0", "fx_scores"))
def a6_topic_partitions(spark, sf):
    """Q3 -> A6 -> A3: posts above the threshold written one folder per
    (election, party, topic) and read back by partition discovery (ids and
    topic names stay strings)."""
    path = shared_path(spark, "by-topic")
    f = topics.topic_filter(view(spark, sf, "fx_scores"), 0.9)
    topics.write_by_topic(f, path, partition_cols=("election", "screen_name", "topic"))
    return io.load_by_topic(spark, path).select("election", "screen_name", "topic", "tweet_id")


@query("a7_append_results", with_views("""
SELECT VAA, Party, Topic, CAST(count(*) AS BIGINT) AS copies FROM (
  SELECT election AS VAA, party AS Party, topic AS Topic FROM fx_model_filtered
  UNION ALL SELECT election, party, topic FROM fx_model_filtered)
GROUP BY ALL
""", "fx_model_filtered"))
def a7_append_results(spark, sf):
    """Result rows appended twice to the same table (a re-run) and
    counted per key on read."""
    path = shared_path(spark, "results")
    r = (view(spark, sf, "fx_model_filtered")
         .select(F.col("election").alias("VAA"), F.col("party").alias("Party"), F.col("topic").alias("Topic"),
                 F.col("tweet_id").alias("Sentence"), F.lit(3).alias("Stance")))
    io.append_results(r, path)
    io.append_results(r, path)
    return (spark.read.parquet(path).groupBy("VAA", "Party", "Topic")
            .agg(F.count(F.lit(1)).alias("copies")))


@query("a6_topic_grid", with_views("""
SELECT g.election, g.screen_name, g.topic, CAST(count(s.tweet_id) AS BIGINT) AS num_posts
FROM (SELECT DISTINCT election, screen_name, topic FROM fx_scores) g
LEFT JOIN (SELECT * FROM fx_scores WHERE score_topic >= 0.995e0) s ON s.election = g.election AND s.screen_name = g.screen_name AND s.topic = g.topic
GROUP BY ALL
""", "fx_scores"))
def a6_topic_grid(spark, sf):
    """A6 + D7: posts above a high threshold stored one folder per (election, party, topic); pairs without a post have
    no folder, and the dense grid brings them back as empty on reading."""
    path = shared_path(spark, "by-topic-grid")
    scores = view(spark, sf, "fx_scores")
    topics.write_by_topic(topics.topic_filter(scores, 0.995), path, partition_cols=("election", "screen_name", "topic"))
    return topics.read_by_topic(io.load_by_topic(spark, path), scores.select("election", "screen_name", "topic"))
