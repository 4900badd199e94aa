"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse integer vectors (term -> weight).  Corpus rows are packed into
blocks that hold, for each term, its posting list (rows of the block with a
weight other than 0); query rows are packed into blocks of sparse rows.  Every
(query block, corpus block) cell is one task-sized unit: for each term its
weighted postings are scattered into a dense score array, the k best of each
query are selected by partition, and the cells' lists are merged.  All rows are
scored; nothing is pruned.  Cells grow as queries x rows / (block sizes), which
is the work itself; replication is blocks, not rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 64               # queries accumulated at once: a tile of scores stays in cache
LONG_MAX = 2**63 - 1


def _pack(block: str, id_col: str, weights_col: str):
    """One row per block: ids ascending, and the weights term by term."""
    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(id_col)
        dims = max((len(w) for w in g[weights_col]), default=0)
        m = np.zeros((dims, len(g)), dtype=np.int64)
        for i, w in enumerate(g[weights_col]):
            m[:len(w), i] = w
        return pd.DataFrame({block: [g[block].iloc[0]], "n": [len(g)], "dims": [dims],
                             "ids": [g[id_col].to_numpy(np.int64).tobytes()], "w": [m.tobytes()]})
    return pack


def _accumulate(queries: np.ndarray, postings: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Tiles of scores (first query, queries x rows); both arrays are terms x rows."""
    terms = min(len(queries), len(postings))
    bound = sum(float(np.abs(queries[t].astype(np.float64)).max(initial=0.0))
                * float(np.abs(postings[t].astype(np.float64)).max(initial=0.0)) for t in range(terms))
    kind = np.int32 if bound < 2**31 - 1 else np.int64 if bound < 2**62 else object
    lists = []
    for t in range(terms):
        rows = np.flatnonzero(postings[t])
        dense = 2 * len(rows) >= postings.shape[1]      # a long list is cheaper to add as a whole
        lists.append((None if dense else rows, postings[t] if dense else postings[t][rows]))
    lists = [(rows, w.astype(kind)) for rows, w in lists]
    for first in range(0, queries.shape[1], TILE):
        tile = queries[:, first:first + TILE]
        acc = np.zeros((tile.shape[1], postings.shape[1]), dtype=kind)
        for t, (rows, w) in enumerate(lists):
            if not len(w):
                continue
            for q in np.flatnonzero(tile[t]):           # sparse query rows: only their own terms
                weight = kind(tile[t, q]) if kind is not object else int(tile[t, q])
                if rows is None:
                    acc[q] += weight * w
                else:
                    acc[q, rows] += weight * w
        yield first, acc


def _select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query, ties to the smaller id (ids ascend)."""
    keep = np.flatnonzero(ids != own)
    if len(keep) > k:
        s = scores[keep]
        bar = np.partition(s, len(s) - k)[len(s) - k]   # the k-th best score
        sure = keep[s > bar]
        keep = np.concatenate([sure, keep[s == bar][:k - len(sure)]])
    return ids[keep], scores[keep]


def _cells(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                qids, cids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.c_ids, np.int64)
                q = np.frombuffer(r.q_w, np.int64).reshape(r.q_dims, r.q_n)
                c = np.frombuffer(r.c_w, np.int64).reshape(r.c_dims, r.c_n)
                out = []
                for first, acc in _accumulate(q, c):
                    for i, row in enumerate(acc):
                        ids, s = _select(row, cids, qids[first + i], k)
                        if s.dtype == object:           # beyond long: held at its ends
                            s = np.array([max(-LONG_MAX - 1, min(LONG_MAX, int(x))) for x in s], dtype=np.int64)
                        out.append((np.full(len(ids), qids[first + i]), ids, s.astype(np.int64)))
                if out:
                    a, d, s = (np.concatenate(x) for x in zip(*out))
                    yield pd.DataFrame({"query_id": a, "vec_id": d, "score": s})
    return run


def exhaustive_topk(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", weights_col: str = "weights",
                    rows_per_block: int = 8192, queries_per_block: int = 512) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): each query's k best rows.

    ``rows`` has an id (long) and weights (array<long>, by term); ``is_query`` is
    a condition on them.  A row that is a query is no candidate of its own.
    Rows with a null id or weights take no part; weights shorter than others
    count as 0 beyond their end; an id given more than once counts once, with
    its smallest weights; ties go to the smaller id.  Fewer than k candidates
    give fewer rows; no candidate, or an empty table, none.  Scores beyond long
    are held at its ends.  Other columns are ignored.
    """
    rows = (rows.filter(F.col(id_col).isNotNull() & F.col(weights_col).isNotNull())
            .groupBy(F.col(id_col).cast("long").alias(id_col)).agg(F.min(weights_col).alias(weights_col)))
    n, nq = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    c_blocks, q_blocks = max(1, math.ceil(n / rows_per_block)), max(1, math.ceil(nq / queries_per_block))

    def packed(df: DataFrame, block: str, blocks: int, prefix: str) -> DataFrame:
        df = df.withColumn(block, F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int"))
        out = df.groupBy(block).applyInPandas(_pack(block, id_col, weights_col),
                                              f"{block} int, n int, dims int, ids binary, w binary")
        return out.select(block, *(F.col(c).alias(f"{prefix}_{c}") for c in ("n", "dims", "ids", "w")))

    corpus = packed(rows, "cb", c_blocks, "c").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    queries = packed(rows.filter(is_query), "qb", q_blocks, "q").withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    cells = queries.join(corpus.hint("merge"), ["qb", "cb"])
    best = cells.mapInPandas(_cells(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """Integer weights floor(scale * x) of finite vectors; the others take no part."""
    from .common import finite_vector
    return (vectors.filter(finite_vector(F.col(vector_col)))
            .select(F.col(id_col), F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("weights")))
