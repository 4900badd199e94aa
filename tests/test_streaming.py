"""Streaming equals batch; replayed posts are dropped; restart continues."""

from pyspark.sql import functions as F

from stancelake.functions.text import clean_posts
from stancelake.sources.fixtures import view
from stancelake.streaming import incremental as K

from conftest import SF_SMALL


def test_stream_equals_batch_with_replay_and_restart(spark):
    posts = view(spark, SF_SMALL, "fx_tweets")
    loc = K.stream_folder(spark, "test-k2")
    early = F.col("created_at") < F.lit("2019-04-01 00:00:00").cast("timestamp")
    K.land_posts(posts, loc["landing"], [early])
    K.run_clean_stream(spark, loc["landing"], loc["out"], loc["checkpoint"])
    first = spark.read.parquet(loc["out"]).count()
    # second arrival (the rest) plus a replay of the first: a restart picks up only new files
    K.land_posts(posts, loc["landing"], [~early, early])
    K.run_clean_stream(spark, loc["landing"], loc["out"], loc["checkpoint"])
    got = spark.read.parquet(loc["out"]).select("tweet_id", "tweet")
    batch = clean_posts(posts, "P1").select("tweet_id", "tweet")
    assert 0 < first < got.count()
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_posts_years_apart_come_out_once(spark):
    """Newest first, two years between arrivals, replays of every age, restarts: each post once."""
    posts = view(spark, SF_SMALL, "fx_tweets").withColumn("created_at", F.col("created_at") - F.make_interval(years=(F.col("doc_id") % 3 * 2).cast("int")))
    loc = K.stream_folder(spark, "test-late")
    for arrivals in ([0], [2, 0], [1, 2, 1]):
        K.land_posts(posts, loc["landing"], [F.col("doc_id") % 3 == a for a in arrivals])
        K.run_clean_stream(spark, loc["landing"], loc["out"], loc["checkpoint"])
    got = spark.read.parquet(loc["out"]).select("tweet_id", "tweet")
    batch = clean_posts(posts, "P1").select("tweet_id", "tweet")
    assert got.count() == batch.count() > 0 and got.exceptAll(batch).count() == 0


def test_counts_are_read_whole_while_versions_come(spark):
    posts = view(spark, SF_SMALL, "fx_tweets")
    loc = K.stream_folder(spark, "test-k3")
    early = F.col("created_at") < F.lit("2019-04-01 00:00:00").cast("timestamp")
    K.land_posts(posts, loc["landing"], [early])
    first = K.run_party_counts(spark, loc["landing"], loc["out"], loc["checkpoint"])
    some = first.latest().agg(F.sum("num_posts")).first()[0]
    K.land_posts(posts, loc["landing"], [~early, early])
    K.run_party_counts(spark, loc["landing"], loc["out"], loc["checkpoint"])
    assert some < first.latest().agg(F.sum("num_posts")).first()[0] == clean_posts(posts, "P1").count()


def test_state_has_no_store_for_each_shuffle_partition(spark):
    """Stores are opened and committed in every micro-batch: no more of them than cores, and the session's setting stays."""
    import os
    loc = K.stream_folder(spark, "test-stores")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    K.land_posts(view(spark, SF_SMALL, "fx_tweets"), loc["landing"])
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        K.run_clean_stream(spark, loc["landing"], loc["out"], loc["checkpoint"])
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stores = [x for x in os.listdir(f"{loc['checkpoint']}/state/0".removeprefix("file:")) if x.isdigit()]
    assert 0 < len(stores) <= spark.sparkContext.defaultParallelism < 40
