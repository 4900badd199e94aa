"""Scoring posts against candidate labels.

* J2 (native default): share of a label's distinct tokens found in the post.
  Computed as an equi-join on token against the (size-checked, broadcast)
  label vocabulary, so only overlapping (post, label) pairs are produced and
  no post text is ever paired with a label text.
* J1 (pluggable): a caller-supplied batch scorer runs over cells of distinct post
  texts and labels of an election, cogrouped as Arrow tables; model state loads
  once per Python worker.
* J3: cosine to label prototypes (means of labelled vectors, or encoded label
  texts), a blocked matrix product over cells of vectors and prototypes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .cells import cell_join
from .joins import BROADCAST_MAX_ROWS, small

TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"

# Hypothesis template per model family (H24); fixed values of the reference.
TEMPLATE_DEBERTA = "{}"
TEMPLATE_BART = "This text is about {}."
TEMPLATE_OTHER = "This example is {}."
SENTENCE_TEMPLATE = "{}"


def words(c) -> Column:
    """Lower-cased pieces of a text between its separators, repeats and empty ones included."""
    c = F.col(c) if isinstance(c, str) else c
    return F.split(F.lower(c), TOKEN_SPLIT)


def tokens(c) -> Column:
    """Distinct lower-cased word tokens of a text."""
    return F.array_distinct(F.array_remove(words(c), ""))


def template_for(model_col) -> Column:                      # H24
    m = F.col(model_col) if isinstance(model_col, str) else model_col
    return (F.when(m.contains("DeBERTa"), F.lit(TEMPLATE_DEBERTA))
            .when(m.contains("bart"), F.lit(TEMPLATE_BART))
            .otherwise(F.lit(TEMPLATE_OTHER)))


def hypothesis(template: Column, label: Column) -> Column:
    return F.replace(template, F.lit("{}"), label)


def short_model_name(model_col) -> Column:                  # H25
    m = F.col(model_col) if isinstance(model_col, str) else model_col
    return F.element_at(F.split(m, "/"), -1)


def entailment_probability(entail, contra) -> Column:       # H32
    e = F.col(entail) if isinstance(entail, str) else entail
    c = F.col(contra) if isinstance(contra, str) else contra
    return F.lit(1.0) / (F.lit(1.0) + F.exp(c - e))


def lexical_scores(posts: DataFrame, labels: DataFrame, post_keys, label_keys,
                   post_text: str = "tweet", label_text: str = "label_text",
                   on=()) -> DataFrame:
    """``post_keys + label_keys + score`` for every pair sharing a token.

    ``on`` are extra equality keys present in both inputs (e.g. election), so
    a post is only scored against its own election's statements (D2).
    """
    on = list(on)
    lab = (labels.select(*on, *label_keys, tokens(label_text).alias("tk"))
           .select(*on, *label_keys, F.size("tk").alias("n_label_tokens"),
                   F.explode("tk").alias("token")))
    lab = small(lab, BROADCAST_MAX_ROWS)
    pt = posts.select(*on, *post_keys, F.explode(tokens(post_text)).alias("token"))
    hits = pt.join(lab, on=[*on, "token"], how="inner")
    return (hits.groupBy(*on, *post_keys, *label_keys, "n_label_tokens")
            .agg(F.count(F.lit(1)).alias("overlap"))
            .select(*on, *post_keys, *label_keys,
                    (F.col("overlap") / F.col("n_label_tokens")).alias("score")))


# ---------------------------------------------------------------- J1 -------

Scorer = Callable[[list[str], list[str]], list[list[float]] | np.ndarray]


def lexical_scorer(texts: list[str], labels: list[str]) -> list[list[float]]:
    """Twin of J2 in Python (default scorer for J1): per cell, each label token lists its labels, so a text
    only meets the labels that share a token with it."""
    import regex
    split = regex.compile(r"[^\p{L}\p{N}_]+")

    def toks(s):
        return {t for t in split.split(s.lower()) if t}

    sizes, holding = np.zeros(len(labels)), {}
    for k, x in enumerate(labels):
        found = toks(x)
        sizes[k] = max(len(found), 1)
        for t in found:
            holding.setdefault(t, []).append(k)
    out = np.zeros((len(texts), len(labels)))
    for i, x in enumerate(texts):
        for t in toks(x):
            if t in holding:
                out[i, holding[t]] += 1
    return out / sizes


def score_pairs(posts: DataFrame, statements: DataFrame, scorer: Scorer = lexical_scorer,
                post_key: str = "tweet_id", text_col: str = "tweet",
                label_col: str = "topic", label_text_col: str = "sentence",
                template: str = "{}", group_col: str = "election",
                texts_per_cell: int = 1024, labels_per_cell: int = 256) -> DataFrame:
    """Score each post against every label of its group with ``scorer``.

    Returns (group, post_key, label, score).  Each distinct (group, text) is
    scored once against each label, in cells of at most about ``texts_per_cell``
    texts and ``labels_per_cell`` labels; neither side is collected, and there is no limit on
    either.  A null text or label text is not scored; a label listed twice is scored twice.
    """
    # Texts travel to Python once a block of labels; results come back keyed by a
    # digest, so the join back does not shuffle the text again.
    keyed = posts.filter(F.col(text_col).isNotNull()).select(group_col, post_key, text_col, F.sha2(F.col(text_col), 256).alias("digest_"))
    texts = keyed.groupBy(group_col, "digest_").agg(F.any_value(text_col).alias("text_"))
    labels = statements.filter(F.col(label_text_col).isNotNull()).select(
        group_col, F.col(label_col).alias("label_"), hypothesis(F.lit(template), F.col(label_text_col)).alias("hypothesis_"))
    types = dict(posts.dtypes) | dict(statements.dtypes)
    out = pa.schema([(group_col, _arrow(types[group_col])), ("digest_", pa.string()), (label_col, _arrow(types[label_col])), ("score", pa.float64())])

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        n, m = x.num_rows, y.num_rows
        if not n or not m:
            return out.empty_table()
        scores = np.asarray(scorer(x.column("text_").to_pylist(), y.column("hypothesis_").to_pylist()), dtype=np.float64)
        of_text, of_label = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
        return pa.table([x.column(group_col).take(of_text), x.column("digest_").take(of_text), y.column("label_").take(of_label),
                         pa.array(scores.reshape(-1))], schema=out)

    schema = f"{group_col} {types[group_col]}, digest_ string, {label_col} {types[label_col]}, score double"
    scored = cell_join(texts, labels, [group_col], "digest_", "label_", run, schema, texts_per_cell, labels_per_cell)
    return (keyed.select(group_col, post_key, "digest_").join(scored, [group_col, "digest_"])
            .select(group_col, post_key, label_col, "score"))


def _arrow(kind: str) -> pa.DataType:
    return to_arrow_type(StructType.fromDDL(f"x {kind}")["x"].dataType)


# ------------------------------------------------------------- wide form ---

def to_wide(scores_long: DataFrame, post_key="tweet_id") -> DataFrame:
    """I1 + classifier shape (T5): per post, topic labels then sentence labels
    (I1), each block ranked by score descending like classifier output."""
    topic_part = F.struct(F.lit(0).alias("blk"), (-F.col("score_topic")).alias("o"),
                          F.col("topic").alias("label"), F.col("score_topic").alias("score"))
    sent_part = F.struct(F.lit(1).alias("blk"), (-F.col("score_sentence")).alias("o"),
                         F.col("sentence").alias("label"), F.col("score_sentence").alias("score"))
    keys = [post_key] if isinstance(post_key, str) else list(post_key)
    g = scores_long.groupBy(*keys).agg(
        F.array_sort(F.collect_list(topic_part)).alias("t"),
        F.array_sort(F.collect_list(sent_part)).alias("s"))
    both = F.concat("t", "s")                                       # I1
    return g.select(*keys,
                    F.transform(both, lambda x: x["label"]).alias("labels"),
                    F.transform(both, lambda x: x["score"]).alias("scores"))


def lookup_label_score(wide: DataFrame, label_col: Column) -> Column:
    """Score of a label by value; the first position wins."""
    pos = F.array_position(F.col("labels"), label_col)
    return F.when(pos > 0, F.element_at(F.col("scores"), pos.cast("int")))


def wide_to_long(wide: DataFrame, post_key: str = "tweet_id") -> DataFrame:
    """One row per (post, label) with its position."""
    z = F.arrays_zip(F.col("labels").alias("label"), F.col("scores").alias("score"))
    return (wide.select(post_key, F.posexplode(z).alias("pos", "z"))
            .select(post_key, "pos", "z.label", "z.score"))


def rank_labels(long: DataFrame, post_key: str = "tweet_id", k: int = 3) -> DataFrame:
    """top-k labels per post by score (ties by label)."""
    w = Window.partitionBy(post_key).orderBy(F.col("score").desc(), F.col("label"))
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ------------------------------------------------------------------ J3 -----

def prototypes(vectors: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per label, the element-wise mean vector and its norm.

    ``posexplode`` + ``groupBy(label, pos)`` aggregates partially on every
    task, so only labels x dims partial sums cross the shuffle.
    """
    ex = vectors.select(label_col, F.posexplode(vec_col).alias("pos", "x"))
    per = ex.groupBy(label_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("p"))
    arr = per.groupBy(label_col).agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("s"))
    p = F.transform("s", lambda x: x["p"])
    return arr.select(F.col(label_col).alias("proto_label"), p.alias("p")).withColumn(
        "pn", F.sqrt(F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x * x)))


def label_vectors(labels: DataFrame, encode: Callable[[list[str]], list[list[float]]], label_col: str, text_col: str) -> DataFrame:
    """Prototypes of text labels: (proto_label, p) by a caller's text encoder, run by Spark over the label table."""
    kind = dict(labels.dtypes)[label_col]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[float(x) for x in v] for v in encode(b.column(1).to_pylist())], pa.list_(pa.float64()))],
                                             names=["proto_label", "p"])

    rows = labels.filter(F.col(text_col).isNotNull()).select(F.col(label_col).alias("proto_label"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"proto_label {kind}, p array<double>")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of numbers; short rows are 0 beyond their end."""
    flat = column.combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def cosine_scores(vectors: DataFrame, protos: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                  vectors_per_cell: int = 4096, protos_per_cell: int = 512) -> DataFrame:
    """(id, proto_label, score) for every vector and every prototype: their cosine, null where a norm is 0.

    A blocked matrix product: a cell holds a block of vectors and one of prototypes.
    Null vectors take no part; vectors of fewer values than a prototype (or more) are 0 beyond their end.
    """
    # one group, as a value of each row: a constant would make the join a nested loop
    one = lambda c: F.pmod(F.xxhash64(c), F.lit(1)).cast("int").alias("all_")
    a = vectors.filter(F.col(vec_col).isNotNull()).select(one(id_col), F.col(id_col).alias("id_"), F.col(vec_col).cast("array<double>").alias("v_"))
    b = protos.filter(F.col("p").isNotNull()).select(one("proto_label"), F.col("proto_label"), F.col("p").cast("array<double>").alias("p_"))
    kinds = dict(a.dtypes) | dict(b.dtypes)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        v, p = (_matrix(t.column(c)) if t.num_rows else np.zeros((0, 0)) for t, c in ((x, "v_"), (y, "p_")))
        dims = max(v.shape[1], p.shape[1])
        v, p = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (v, p))
        norms = np.sqrt((v * v).sum(axis=1))[:, None] * np.sqrt((p * p).sum(axis=1))[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            s = np.where(norms > 0, (v @ p.T) / norms, np.nan)
        of_v, of_p = np.repeat(np.arange(len(v)), len(p)), np.tile(np.arange(len(p)), len(v))
        return pa.table({id_col: x.column("id_").take(of_v), "proto_label": y.column("proto_label").take(of_p), "score": pa.array(s.reshape(-1), from_pandas=True)})

    schema = f"{id_col} {kinds['id_']}, proto_label {kinds['proto_label']}, score double"
    return cell_join(a, b, ["all_"], "id_", "proto_label", run, schema, vectors_per_cell, protos_per_cell)


def nearest_prototype(vectors: DataFrame, protos: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep=()) -> DataFrame:
    """The prototype with the highest cosine for every vector (ties to the lowest label; none: null).

    Scores come from ``cosine_scores`` and are reduced with map-side combine; neither
    the prototypes nor the vectors are collected, whatever their number.
    """
    scores = cosine_scores(vectors, protos.select("proto_label", "p"), id_col, vec_col)
    best = scores.groupBy(id_col).agg(F.max("score").alias("cosine"),
                                      F.min_by("proto_label", F.struct(-F.coalesce("score", F.lit(-2.0)), "proto_label")).alias("pred_label"))
    return vectors.select(id_col, *keep).join(best, id_col, "left").select(id_col, *keep, "pred_label", "cosine")
