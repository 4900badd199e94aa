"""Sources and sinks with fixed schemas.

Identity that the reference kept in file paths (election, model, dataset,
suffix, party, topic) is held in columns and used as partition keys, so a
filter on them prunes folders instead of opening files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATEMENTS_SCHEMA = "topic string, sentence string"
POSTS_SCHEMA = ("tweet_id string, user_id string, user_screen_name string, lang string, "
                "created_at timestamp, tweet string")
SCORES_SCHEMA = ("created_at timestamp, tweet_id string, tweet string, user_id string, screen_name string, "
                 "topic string, score_topic double, sentence string, score_sentence double")
RESULTS_SCHEMA = "VAA string, Party string, Topic string, Sentence string, Stance int"


def load_statements_csv(spark: SparkSession, path: str, election: str | None = None) -> DataFrame:
    """A1 + C9: statement CSV (UTF-8 with BOM, quoted commas, header), a file or a folder
    of them, rows with any null dropped.  Trailing blanks in a topic are kept.

    ``topic_ix`` is the list position (file, row): files by path, rows as they stand.  A file of
    quoted line breaks is read by one task, in order, so the row number grows with
    the position in it; files are read side by side and no task sees them all.
    """
    df = (spark.read.schema(STATEMENTS_SCHEMA).option("header", True).option("escape", '"')
          .option("multiLine", True).option("encoding", "UTF-8")
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .csv(path))
    position = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    df = df.select("topic", "sentence", position.alias("topic_ix")).dropna("any", subset=["topic", "sentence"])
    if election is not None:
        df = df.withColumn("election", F.lit(election))
    return df


def write_list_csv(df: DataFrame, path: str, order_col: str, files: int | None = None) -> None:
    """A list as CSV files whose path order, and the order of rows in them, is that of ``order_col``; no task sees them all."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    write_table(df.repartitionByRange(n, order_col).sortWithinPartitions(order_col).drop(order_col), path, fmt="csv")


def nan_to_null(df: DataFrame, cols) -> DataFrame:
    """NaN scores become null at the source (NaN >= t is true in Spark)."""
    for c in cols:
        df = df.withColumn(c, F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(F.col(c)))
    return df


def load_scores(spark: SparkSession, path: str, **partition_filter) -> DataFrame:
    """A2: the scores table (T6) partitioned by election/model/dataset/suffix;
    keyword filters prune partitions."""
    df = spark.read.parquet(path)
    for k, v in partition_filter.items():
        df = df.filter(F.col(k) == v)
    return nan_to_null(df, [c for c in ("score_topic", "score_sentence") if c in df.columns])


def load_posts(spark: SparkSession, path: str, **partition_filter) -> DataFrame:
    """A2: posts (T1/T2) partitioned by election/dataset/suffix."""
    df = spark.read.parquet(path)
    for k, v in partition_filter.items():
        df = df.filter(F.col(k) == v)
    return df


def load_by_topic(spark: SparkSession, path: str) -> DataFrame:
    """A3: a table written partitioned by (..., topic); partition values stay
    strings (ids and topic names are not re-typed)."""
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        df = spark.read.option("basePath", path).parquet(path)   # partitions resolved here
        df.schema
    finally:
        spark.conf.set(key, before)
    return df


def append_results(results: DataFrame, path: str) -> None:
    """A7 + G2: append stance rows (VAA, Party, Topic, Sentence, Stance)."""
    results.select("VAA", "Party", "Topic", "Sentence", F.col("Stance").cast("int")) \
        .write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str, partition_cols=(), fmt: str = "parquet",
                mode: str = "overwrite", balanced: bool = False) -> None:
    """Stage outputs (parquet by default, CSV with header on request).

    A writer sorts its task's rows by the partition columns.  ``balanced`` deals rows by these columns first, into
    partitions of even size in bytes (a large folder is split), so that what a task
    sorts is bounded however many rows a split of the source unpacks to."""
    if balanced and partition_cols:
        df = df.hint("rebalance", *(F.col(c) for c in partition_cols))
    w = df.write.mode(mode)
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    if fmt == "csv":
        # as load_statements_csv reads
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.parquet(path)
