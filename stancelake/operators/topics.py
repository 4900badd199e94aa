"""Topic filtering, dataset windows and event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import small

# Dataset Di = the i months before election day (fixed values of the reference).
DATASETS = {"D3": 3, "D4": 4, "D5": 5, "D7": 7}


def topic_threshold(scores: DataFrame, threshold: float, col: str = "score_topic") -> DataFrame:
    """Inclusive threshold on the topic score (pushed to the scan)."""
    return scores.filter(F.col(col) >= F.lit(float(threshold)))


def party_filter(df: DataFrame, party: str, col: str = "screen_name") -> DataFrame:
    """One party (normally a group key instead)."""
    return df.filter(F.col(col) == party)


def event_time(df: DataFrame, fmt: str = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") -> Column:
    """``date_obj`` when present, else ``created_at`` (parsed when it is text)."""
    cols = set(df.columns)
    created = None
    if "created_at" in cols:
        dt = dict(df.dtypes)["created_at"]
        created = (F.try_to_timestamp(F.col("created_at"), F.lit(fmt)) if dt == "string"
                   else F.col("created_at").cast("timestamp"))
    if "date_obj" in cols:
        return F.coalesce(F.col("date_obj").cast("timestamp"), created) if created is not None \
            else F.col("date_obj").cast("timestamp")
    if created is None:
        raise ValueError("no event time column")
    return created


def dataset_windows(posts: DataFrame, calendar: DataFrame, datasets=DATASETS,
                    time_col: str = "created_at") -> DataFrame:
    """Tag each post with every dataset window it falls in.

    One scan serves all windows: the windows are nested, so a post gets the
    array of datasets whose start it is after, exploded.  ``calendar`` is the
    (election, election_ts) table, broadcast after a size check.
    """
    j = posts.join(small(calendar.select("election", "election_ts")), "election")
    t = F.col(time_col)
    end = F.col("election_ts")
    tags = [F.when((t >= end - F.make_ym_interval(F.lit(0), F.lit(m))) & (t < end), F.lit(name))
            for name, m in datasets.items()]
    return (j.withColumn("dataset", F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())))
            .drop("election_ts"))


def normalize_topic(c) -> Column:
    """Path-safe topic names of foreign data ('x or y') back to 'x/y'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.contains(" or "), F.replace(c, F.lit(" or "), F.lit("/"))).otherwise(c)


def topic_filter(scores: DataFrame, threshold: float,
                 keys=("election", "screen_name", "topic")) -> DataFrame:
    """Q3: posts per (election, party, topic) whose topic score reaches the threshold."""
    return topic_threshold(scores, threshold).select(*keys, "tweet_id", "score_topic", "score_sentence")


def write_by_topic(filtered: DataFrame, path: str, mode: str = "overwrite",
                   partition_cols=("dataset", "election", "screen_name", "topic")) -> None:
    """One folder per (dataset, election, party, topic).  Pairs without
    posts have no folder; the dense grid (D7) restores them on read."""
    cols = [c for c in partition_cols if c in filtered.columns]
    # Range partitioning on (partition keys, id) spreads a hot (party, topic)
    # over several writers instead of hashing it into one task.
    spread = cols + (["tweet_id"] if "tweet_id" in filtered.columns else [])
    n = int(filtered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (filtered.repartitionByRange(n, *spread).write.mode(mode).partitionBy(*cols).parquet(path))


def read_by_topic(stored: DataFrame, grid: DataFrame, keys=("election", "screen_name", "topic")) -> DataFrame:
    """A6 + D7 on read: posts per key for every key of ``grid``, 0 where nothing was stored."""
    counts = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_posts"))
    return (grid.select(*keys).distinct().join(counts, list(keys), "left")
            .select(*keys, F.coalesce("num_posts", F.lit(0)).alias("num_posts")))
