"""Join helpers: size-checked broadcast and the lookups D1, D4-D7."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Largest side we are willing to ship to every executor.  Statement lists,
# parameter grids and label profiles are far below it; anything above falls
# back to a shuffle join (with AQE skew splitting).
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 << 20


def small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only after measuring that the rows and their bytes (as JSON text) are bounded."""
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))) + 16
    n, n_bytes = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if n <= max_rows and (n_bytes or 0) <= max_bytes else df


def first_sentence_per_topic(statements: DataFrame,
                             keys=("election", "topic"),
                             order_col: str = "topic_ix") -> DataFrame:
    """One sentence per topic; on duplicates the first listed (by ``order_col``) wins."""
    return (statements.groupBy(*keys)
            .agg(F.min_by("sentence", order_col).alias("sentence")))


def semi(df: DataFrame, keys_df: DataFrame, on) -> DataFrame:
    """Keep rows whose key is in a (checked-small) key table."""
    return df.join(small(keys_df.select(*on).distinct()), on=list(on), how="left_semi")


def anti(df: DataFrame, keys_df: DataFrame, on) -> DataFrame:
    """Drop rows whose key is in the other table."""
    return df.join(keys_df.select(*on).distinct(), on=list(on), how="left_anti")


def exclude_parties(df: DataFrame, parties, col: str = "party") -> DataFrame:
    """C4 on a fixed exclusion list: a NOT IN predicate (pushed to the scan)
    with anti-join semantics for null keys (kept)."""
    c = F.col(col)
    return df.filter(c.isNull() | ~c.isin(*parties))


def top_n_per_group(df: DataFrame, group_cols, order_cols, n: int,
                    rank_col: str = "rank") -> DataFrame:
    """``row_number() <= n``; Spark pushes a partial limit below the shuffle."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)
