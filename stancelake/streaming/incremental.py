"""Incremental and streaming operators.

* K1/D6 resume: finished work is read by key from the committed batches of a
  ledger and skipped before anything is cleaned or asked.
* K2 periodic save: a Structured Streaming job over the landing folder of new
  posts cleans every micro-batch, drops replayed posts by id, and appends to a
  parquet table (G2) with a checkpoint, so a restart continues where it stopped.
  Ids are keyed state without a watermark: a post is kept however late it comes,
  and a replay is dropped however late it is.  The state (one id a post) lies in
  RocksDB on the executors and in the checkpoint.  ``availableNow`` processes what
  is there and stops, which gives the same rows as the batch job.
* K3 running counts: a streaming aggregate per party, complete output, each
  version a committed batch of a ledger; readers see the last one whole.
* E17 progress: ``observe`` metrics (rows in, posts kept) of each micro-batch,
  written to a table by a streaming listener.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.text import clean_posts
from ..session import settings, shared_path
from ..sources.ledger import Ledger

POST_SCHEMA = ("tweet_id string, user_id string, user_screen_name string, election string, lang string, "
               "created_at timestamp, tweet string")


def resume_todo(inputs: DataFrame, done: DataFrame, keys=("tweet_id",)) -> DataFrame:
    """K1: the input rows whose keys are not in the output yet."""
    return inputs.join(done.select(*keys).distinct(), list(keys), "left_anti")


CLEANED_SCHEMA = "tweet_id string, election string, tweet string"


def clean_resumable(posts: DataFrame, path: str, profile: str = "P1", batches: int = 8) -> Ledger:
    """Clean the posts that no committed batch under ``path`` has yet, and commit them.

    A post that cleaning drops (C5, C6) is kept as a row with a null text, so that it is finished too.
    """
    ledger = Ledger(posts.sparkSession, path, CLEANED_SCHEMA, ["tweet_id"])

    def work(part: DataFrame) -> DataFrame:
        kept = clean_posts(part, profile).select("tweet_id", "tweet")
        return part.select("tweet_id", "election").join(kept, "tweet_id", "left")

    ledger.advance(posts.select("tweet_id", "election", "tweet"), work, batches)
    return ledger


def cleaned_post_stream(spark: SparkSession, landing: str, schema: str = POST_SCHEMA,
                        profile: str = "P1", max_files: int = 64) -> DataFrame:
    """Streaming DataFrame of cleaned posts from a folder, each id once, however late."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(landing)
    observed = raw.observe("incoming", F.count(F.lit(1)).alias("rows_in"))       # E17
    cleaned = clean_posts(observed, profile).observe("cleaned", F.count(F.lit(1)).alias("rows_kept"))
    return cleaned.dropDuplicates(["tweet_id"])


def keyed_state(spark: SparkSession):
    """Settings to start a stream of keyed state under: RocksDB, and as many stores as cores.

    Every micro-batch opens and commits every store and writes a file for it.  Both the micro-batches and the
    session's shuffle partitions grow with the input, so a store for each of those would make their product of commits.
    A store is read row by row: fewer of them hold no more in memory.  A checkpoint keeps the number it began with.
    """
    stores = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return settings(spark, {
        "spark.sql.shuffle.partitions": str(stores),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"})


def run_clean_stream(spark: SparkSession, landing: str, out: str, checkpoint: str,
                     profile: str = "P1", max_files: int = 64) -> dict:
    """K2 + G2: process every file in ``landing`` once, append to ``out``."""
    writer = (cleaned_post_stream(spark, landing, profile=profile, max_files=max_files)
              .writeStream.format("parquet").option("path", out)
              .option("checkpointLocation", checkpoint)
              .outputMode("append").trigger(availableNow=True))
    with keyed_state(spark):
        q = writer.start()
    q.awaitTermination()
    progress = q.lastProgress or {}
    return {"batches": len(q.recentProgress), "observed": progress.get("observedMetrics", {})}


SCORE_SCHEMA = "election string, screen_name string, tweet_id string, topic string, score double"


def run_score_stream(spark: SparkSession, landing: str, labels: DataFrame, out: str, checkpoint: str,
                     profile: str = "P1") -> Ledger:
    """K2 with scoring: each micro-batch of cleaned, de-duplicated posts is
    scored against the statements of its election (J2) and committed to a ledger
    under its number, so a micro-batch replayed after a failure counts once."""
    from ..operators.score import lexical_scores
    ledger = Ledger(spark, out, SCORE_SCHEMA, ["tweet_id", "topic"])

    def score_batch(batch: DataFrame, epoch: int) -> None:
        posts = batch.select("election", F.col("user_screen_name").alias("screen_name"), "tweet_id", "tweet")
        ledger.commit(lexical_scores(posts, labels, ["screen_name", "tweet_id"], ["topic"], post_text="tweet",
                                     on=["election"]), f"epoch-{epoch:012d}")

    q = (cleaned_post_stream(spark, landing, profile=profile).writeStream.foreachBatch(score_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return ledger


COUNTS_SCHEMA = "election string, party string, num_posts long"


def run_party_counts(spark: SparkSession, landing: str, out: str, checkpoint: str,
                     profile: str = "P1") -> Ledger:
    """K3: posts per (election, party), kept current as files arrive; ``latest()`` of the ledger is the table."""
    ledger = Ledger(spark, out, COUNTS_SCHEMA, ["election", "party"])
    counts = (cleaned_post_stream(spark, landing, profile=profile)
              .groupBy("election", F.col("user_screen_name").alias("party"))
              .agg(F.count(F.lit(1)).alias("num_posts")))
    writer = (counts.writeStream.outputMode("complete").foreachBatch(lambda batch, epoch: ledger.commit(batch, f"epoch-{epoch:012d}") and None)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    with keyed_state(spark):
        q = writer.start()
    q.awaitTermination()
    return ledger


PROGRESS_SCHEMA = "query_name string, batch_id long, rows_in long, rows_kept long, batch_ms long"


class ProgressListener(StreamingQueryListener):
    """Observed metrics of every micro-batch of the named queries, as rows of a ledger.

    A listener hears progress on the driver, a row a micro-batch; ``store`` commits what it has heard.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.ledger = Ledger(spark, path, PROGRESS_SCHEMA, ["query_name", "batch_id"])
        self.spark, self.heard = spark, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name and "incoming" in p.observedMetrics:
            kept = p.observedMetrics.get("cleaned")
            self.heard.append((p.name, p.batchId, p.observedMetrics["incoming"].rows_in, kept.rows_kept if kept else None, p.batchDuration))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def store(self) -> Ledger:
        heard, self.heard = self.heard, []
        if heard:
            self.ledger.commit(self.spark.createDataFrame(heard, PROGRESS_SCHEMA))
        return self.ledger


def run_clean_stream_observed(spark: SparkSession, landing: str, out: str, checkpoint: str, progress: str,
                              name: str = "clean", profile: str = "P1", max_files: int = 64) -> Ledger:
    """K2 with E17: as ``run_clean_stream``, and a row of counts per micro-batch in the ledger under ``progress``."""
    import time
    listener = ProgressListener(spark, progress)
    spark.streams.addListener(listener)
    try:
        writer = (cleaned_post_stream(spark, landing, profile=profile, max_files=max_files)
                  .writeStream.queryName(name).format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                  .outputMode("append").trigger(availableNow=True))
        with keyed_state(spark):
            q = writer.start()
        q.awaitTermination()
        # events reach a listener after the query has ended; every micro-batch has one
        expected = sum(1 for p in q.recentProgress if "incoming" in p.observedMetrics)
        for _ in range(100):
            if len(listener.heard) >= expected:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    return listener.store()


def land_posts(posts: DataFrame, landing: str, parts=()) -> None:
    """Write posts into a landing folder as separate arrivals (each filter in
    ``parts`` is one arrival; an arrival may repeat earlier posts)."""
    cols = [c.split(" ")[0] for c in POST_SCHEMA.split(", ")]
    for cond in parts or [F.lit(True)]:
        posts.filter(cond).select(*cols).write.mode("append").parquet(landing)


def stream_folder(spark: SparkSession, name: str) -> dict:
    """Fresh landing/output/checkpoint locations under the shared folder."""
    base = shared_path(spark, name)
    return {"landing": f"{base}/landing", "out": f"{base}/out", "checkpoint": f"{base}/checkpoint"}
