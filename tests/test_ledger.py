"""Committed batches: what a killed run leaves is not read, replays change nothing, finished keys are skipped."""

from pyspark.sql import functions as F

from stancelake.sources.ledger import Ledger
from stancelake.streaming.incremental import clean_resumable

SCHEMA = "k string, v long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def test_only_committed_batches_count(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), SCHEMA, ["k"])
    assert ledger.read().count() == 0 and ledger.batches().count() == 0 and ledger.latest().count() == 0
    ledger.commit(rows(spark, ("a", 1), ("b", 2)), "one")
    rows(spark, ("lost", 9)).write.parquet(str(tmp_path / "l/data/batch=killed"))        # written, never committed
    assert {(r.k, r.v) for r in ledger.read().collect()} == {("a", 1), ("b", 2)}
    ledger.commit(rows(spark, ("a", 7)), "one")                                          # a replay
    assert ledger.read().count() == 2
    ledger.commit(rows(spark, ("c", 3)), "two")
    assert {r.k for r in ledger.latest().collect()} == {"c"}
    assert {(r.batch, r.n_rows) for r in ledger.batches().collect()} == {("one", 2), ("two", 1)}
    assert {r.k for r in ledger.todo(rows(spark, ("a", 0), ("d", 0), (None, 0), ("lost", 0))).collect()} == {"d", None, "lost"}


def test_failures_are_tried_again(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), SCHEMA, ["k"], finished="v IS NOT NULL")
    ledger.commit(rows(spark, ("a", 1), ("b", None)), "one")
    assert {r.k for r in ledger.todo(rows(spark, ("a", 0), ("b", 0))).collect()} == {"b"}


def test_advance_by_batches(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), SCHEMA, ["k"])
    inputs = rows(spark, *((f"k{i}", i) for i in range(50)))
    ledger.advance(inputs.filter("v < 20"), lambda part: part.withColumn("v", F.col("v") * 2), batches=4)
    first = ledger.batches().count()
    ledger.advance(inputs, lambda part: part.withColumn("v", F.col("v") * 3), batches=4)
    got = {r.k: r.v for r in ledger.read().collect()}
    assert got == {f"k{i}": i * (2 if i < 20 else 3) for i in range(50)} and 1 < first <= 4
    ledger.advance(inputs, lambda part: 1 / 0, batches=4)                                 # nothing left: no work


def test_cleaning_skips_what_is_finished(spark, tmp_path):
    posts = spark.createDataFrame([(str(i), "E", f"some words of post {i}" if i % 3 else "short") for i in range(30)], "tweet_id string, election string, tweet string")
    clean_resumable(posts.filter("cast(tweet_id as int) < 10"), str(tmp_path / "l"), batches=2)
    ledger = clean_resumable(posts, str(tmp_path / "l"), batches=2)
    got = {r.tweet_id: r.tweet for r in ledger.read().collect()}
    assert got == {str(i): f"some words of post {i}" if i % 3 else None for i in range(30)}
    assert ledger.read().count() == 30
