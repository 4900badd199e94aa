"""Hard-negative mining by threshold joins with an L2-pruned inverted index.

Rows are integer vectors with a label; anchors are some of the rows.  Two joins
run over (anchor block, row block) cells, each cell a group of its own:

* the best rows with the anchor's label are its positives;
* each (anchor, positive) opens a window of scores, a share of the positive's
  score from below and from above, and wants the best rows of other labels in it.

Both are threshold joins.  A cell holds its rows' weights by dimension groups,
heaviest dimensions first, and every row's norm from each group on (suffix
norms).  For a threshold t the index omits the groups of a row from where
(largest anchor norm) x (suffix norm) is below t: they alone cannot reach t, and
a row whose whole norm cannot is not indexed at all.  Partial scores are
accumulated group by group through the lists of indexed rows; after each group a
row is dropped as soon as no anchor's partial score plus (remaining anchor norm)
x (remaining row norm) reaches its threshold.  What survives is completed by
the omitted groups and compared exactly.  A window that is not full lowers its
threshold and asks again, down to the window's own lower end.  Cells answer at
most ``k`` rows a window; a ranked merge follows.

Every row is met by every anchor block, in blocks; the threshold decides how
much of a cell is computed, never what is found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

GROUP = 8               # dimensions accumulated at once
TILE = 128              # anchors at once: a tile of scores stays small
EXACT = 2.0 ** 53       # whole numbers below are exact in double precision
LONG_MIN, LONG_MAX = -2**63, 2**63 - 1
SHARES = (0.7, 0.5, 0.35, 0.25, 0.15, 0.08, 0.0)    # thresholds tried, as shares of the highest possible score

BLOCK = "{b} int, n int, dims int, kind string, w binary, ids binary, labels binary, keys binary{more}"


# ---- blocks ------------------------------------------------------------------

def _weights(column, n: int) -> np.ndarray:
    """dims x n of whole numbers; short rows are 0 beyond their end."""
    sizes = np.diff(column.offsets.to_numpy())
    dims = int(sizes.max(initial=0))
    out = np.zeros((n, dims), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out.T


def _pack(block: str, windows: bool):
    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("vec_id", "ascending"), ("key", "ascending")])
        w = _weights(t.column("weights").combine_chunks(), t.num_rows)
        top = int(np.abs(w.astype(np.float64)).max(initial=0))
        kind = "<i2" if top < 2**15 - 1 else "<i4" if top < 2**31 - 1 else "<i8"
        cols = {block: pa.array([t.column(block)[0].as_py()], pa.int32()), "n": pa.array([t.num_rows], pa.int32()), "dims": pa.array([len(w)], pa.int32()),
                "kind": [kind], "w": pa.array([np.ascontiguousarray(w).astype(kind).tobytes()], pa.binary())}
        for name, c in (("ids", "vec_id"), ("labels", "label"), ("keys", "key")):
            cols[name] = pa.array([t.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary())
        if windows:
            cols["windows"] = pa.array([t.column("windows").to_pylist()], pa.list_(pa.list_(pa.struct([("no", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))))
        return pa.table(cols)
    return pack


def packed(rows: DataFrame, block: str, blocks: int, windows: bool = False) -> DataFrame:
    more = ", windows array<array<struct<no:bigint,lo:bigint,hi:bigint>>>" if windows else ""
    rows = rows.withColumn(block, F.pmod(F.xxhash64("key", "vec_id"), F.lit(blocks)).cast("int"))
    return rows.groupBy(block).applyInArrow(_pack(block, windows), BLOCK.format(b=block, more=more))


# ---- one cell ----------------------------------------------------------------

class RowIndex:
    """Weights of a block of rows by dimension groups, heaviest first, with suffix norms."""

    def __init__(self, w: np.ndarray, dims: int):
        full = np.zeros((dims, w.shape[1]), dtype=np.int64)
        full[:len(w)] = w
        heft = (full.astype(np.float64) ** 2).sum(axis=1)
        self.order = np.argsort(-heft, kind="stable")
        self.whole = full[self.order]
        self.x = self.whole.astype(np.float64)
        self.groups = [(a, min(a + GROUP, dims)) for a in range(0, dims, GROUP)]
        self.rest = self.suffix_norms(self.x)

    def suffix_norms(self, x: np.ndarray) -> np.ndarray:
        """(groups + 1) x rows: norm of each row's weights from each group on."""
        out = np.zeros((len(self.groups) + 1, x.shape[1]))
        for g in range(len(self.groups) - 1, -1, -1):
            a, b = self.groups[g]
            out[g] = out[g + 1] + (x[a:b] ** 2).sum(axis=0)
        return np.sqrt(out)

    def reaching(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores): rows that may reach the threshold of some query of ``q`` (dims x queries), with all its scores.

        Scores are whole numbers in double precision, exact below 2^53.
        """
        q_rest = self.suffix_norms(q)
        n = self.x.shape[1]
        if not len(self.groups):
            return np.arange(n), np.zeros((q.shape[1], n))
        longest, lowest = q_rest[0].max(initial=0.0), least.min()
        slack = 1e-9 * longest * self.rest[0] + 1e-6
        # the index of a row ends where the rest cannot reach the threshold by itself
        indexed = (longest * self.rest[:-1] + slack >= lowest).sum(axis=0)
        live = np.flatnonzero(indexed > 0)
        acc = np.zeros((q.shape[1], n))
        for g, (a, b) in enumerate(self.groups):
            rows = live[indexed[live] > g]
            if not len(rows):
                break
            acc[:, rows] += q[a:b].T @ self.x[a:b, rows]
            best = (acc[:, rows] + q_rest[g + 1][:, None] * self.rest[g + 1][rows] - least[:, None]).max(axis=0)
            gone = rows[best < -slack[rows]]
            if len(gone):
                live = np.setdiff1d(live, gone, assume_unique=True)
        at = indexed[live]
        best = (acc[:, live] + q_rest[at].T * self.rest[at, live] - least[:, None]).max(axis=0)
        live = live[best >= -slack[live]]
        for g, (a, b) in enumerate(self.groups):            # what the index omitted
            rows = live[indexed[live] <= g]
            if len(rows):
                acc[:, rows] += q[a:b].T @ self.x[a:b, rows]
        return live, acc[:, live]


def fill_windows(q: np.ndarray, q_labels, q_ids, windows, c: np.ndarray, c_ids, c_labels, k: int, same: bool):
    """(query, window, rows, scores) for each window: the k best rows of the block in it, by score, then id.

    ``windows[i]`` lists (no, lo, hi) of query i, both ends included; rows have the
    query's label (``same``) or another, and another id.
    """
    dims = max(len(q), len(c))
    index = RowIndex(c, dims)
    whole = np.zeros((dims, q.shape[1]), dtype=np.int64)
    whole[:len(q)] = q
    whole = whole[index.order]
    qf = whole.astype(np.float64)
    norms, longest = np.sqrt((qf ** 2).sum(axis=0)), index.rest[0].max(initial=0.0)
    exact = norms.max(initial=0.0) * longest < EXACT
    for first in range(0, q.shape[1], TILE):
        open_ = [(i, w) for i in range(first, min(first + TILE, q.shape[1])) for w in windows[i] if w[1] <= w[2]]
        for share in (*SHARES, None):
            if not open_:
                break
            # a threshold above the window finds nothing in it
            t = {(i, w[0]): -math.inf if share is None else share * norms[i] * longest for i, w in open_}
            lowest = {(i, w[0]): float(w[1]) if w[1] > LONG_MIN else -math.inf for i, w in open_}
            t = {x: max(t[x], lowest[x]) for x in t}
            ask = [(i, w) for i, w in open_ if t[i, w[0]] <= w[2]]
            if not ask:
                continue
            at = sorted({i for i, _ in ask})
            least = np.array([min(t[i, w[0]] for j, w in ask if j == i) for i in at])
            rows, scores = index.reaching(qf[:, at], least)
            row_of = {i: n for n, i in enumerate(at)}
            left = [x for x in open_ if t[x[0], x[1][0]] > x[1][2]]
            for i, w in ask:
                bar, last = t[i, w[0]], t[i, w[0]] == lowest[i, w[0]]
                s, r = scores[row_of[i]], rows
                fits = ((c_labels[r] == q_labels[i]) == same) & (c_ids[r] != q_ids[i])
                if exact:
                    s = s[fits].astype(np.int64)
                else:
                    fits &= s + 1e-9 * norms[i] * index.rest[0][r] + 1e-6 >= bar
                    s = np.array([sum(int(x) * int(y) for x, y in zip(whole[:, i], index.whole[:, j])) for j in r[fits]], dtype=object)
                r = r[fits]
                inside = ((s >= w[1]) & (s <= w[2]) & (last | (s >= bar))).astype(bool)
                s, r = s[inside], r[inside]
                if len(r) < k and not last:
                    left.append((i, w))
                    continue
                if len(r) > k:                              # all ties of the k-th score stay for the order by id
                    bound = np.partition(s, len(s) - k)[len(s) - k]
                    s, r = s[s >= bound], r[s >= bound]
                by = np.lexsort((c_ids[r], -s)) if exact else np.array(sorted(range(len(r)), key=lambda j: (-s[j], c_ids[r[j]])), dtype=np.int64)
                by = by[:k]
                yield i, w[0], r[by], s[by]
            open_ = left


FOUND = "anchor_key long, anchor_id long, no long, row_key long, row_id long, score long"


def _cell(k: int, same: bool):
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            a, b = left.to_pylist()[0], right.to_pylist()[0]
            q, c = (np.frombuffer(r["w"], r["kind"]).reshape(r["dims"], r["n"]).astype(np.int64) for r in (a, b))
            q_ids, q_labels, q_keys = (np.frombuffer(a[x], np.int64) for x in ("ids", "labels", "keys"))
            c_ids, c_labels, c_keys = (np.frombuffer(b[x], np.int64) for x in ("ids", "labels", "keys"))
            windows = [[(w["no"], w["lo"], w["hi"]) for w in ws] for ws in a["windows"]]
            for i, no, rows, scores in fill_windows(q, q_labels, q_ids, windows, c, c_ids, c_labels, k, same):
                s = np.array([max(LONG_MIN, min(LONG_MAX, int(x))) for x in scores], dtype=np.int64)
                n = len(rows)
                out.append((np.full(n, q_keys[i]), np.full(n, q_ids[i]), np.full(n, no), c_keys[rows], c_ids[rows], s))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * len(names)
        return pa.table([pa.array(x.astype(np.int64)) for x in cols], names=names)
    return run


def window_join(anchors: DataFrame, blocks: DataFrame, c_blocks: int, q_blocks: int, k: int, same: bool) -> DataFrame:
    """The k best rows of each window: ``FOUND`` with a rank; ``anchors`` has key, vec_id, label, weights and windows."""
    left = packed(anchors, "qb", q_blocks, windows=True).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    right = blocks.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_cell(k, same), FOUND)
    w = Window.partitionBy("anchor_id", "anchor_key", "no").orderBy(F.desc("score"), "row_id", "row_key")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   id_col: str = "vec_id", label_col: str = "label", weights_col: str = "weights",
                   rows_per_block: int = 16_384, anchors_per_block: int = 2_048) -> DataFrame:
    """(anchor_id, positive_id, rank int, negative_id, positive_score, negative_score), all else long.

    ``rows`` has an id, a label and whole-number weights (array<long>);
    ``is_anchor`` is a condition on them.  An anchor's positives are the first
    ``positives`` rows (all, if fewer) of the same label with another id, by score
    (inner product), higher first, ties to the smaller id.  Per positive come the first
    ``negatives`` rows (all, if fewer) of other labels whose score is at least ``low``
    and at most ``high`` percent of the positive's.  An anchor without positives, or a
    window without rows, gives no row; a negative positive score leaves its window empty.

    Rows with a null id, label or weights take no part; weights shorter than others
    count as 0 beyond their end.  Rows equal in id, label and weights count once;
    rows that share an id only are rows of their own, never negatives or positives of
    each other.  Scores beyond long are held at its ends.  An empty table gives an empty
    result; other columns are ignored.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(weights_col).alias("weights"),
                       F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.filter("vec_id is not null and label is not null and weights is not null").dropDuplicates(["vec_id", "label", "weights"])
    rows = staged(rows.withColumn("key", F.xxhash64("vec_id", "label", "weights")), "negatives-rows")
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("is_anchor")).first()
    c_blocks, q_blocks = max(1, math.ceil(n / rows_per_block)), max(1, math.ceil(n_anchors / anchors_per_block))
    blocks = staged(packed(rows.drop("is_anchor"), "cb", c_blocks), "negatives-blocks")
    anchors = rows.filter("is_anchor").drop("is_anchor")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("no"), F.lit(LONG_MIN).cast("long").alias("lo"), F.lit(LONG_MAX).cast("long").alias("hi")))
    best = window_join(anchors.withColumn("windows", whole), blocks, c_blocks, q_blocks, positives, same=True)
    best = staged(best.select("anchor_key", "anchor_id", F.col("rank").cast("long").alias("no"), F.col("row_id").alias("positive_id"),
                              F.col("score").alias("positive_score")), "negatives-positives")
    # whole ends of low * p <= 100 * s <= high * p, in a width that holds the products
    p = F.col("positive_score").cast("decimal(38,0)")
    ends = F.struct("no", F.ceil(p * low / 100).cast("long").alias("lo"), F.floor(p * high / 100).cast("long").alias("hi"))
    windows = best.groupBy(F.col("anchor_key").alias("key"), F.col("anchor_id").alias("vec_id")).agg(F.collect_list(ends).alias("windows"))
    found = window_join(anchors.join(windows, ["key", "vec_id"]), blocks, c_blocks, q_blocks, negatives, same=False)
    return (found.join(best, ["anchor_key", "anchor_id", "no"])
            .select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
