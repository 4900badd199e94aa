"""Blocked joins: every pair once, whatever the block sizes; scorer and prototypes without limits."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stancelake.operators import score
from stancelake.operators.cells import cell_join


@pytest.mark.parametrize("sizes", [(1000, 1000), (7, 3), (1, 1)])
def test_every_pair_of_a_group_once(spark, sizes):
    left = spark.createDataFrame([("hot" if i % 3 else f"g{i % 5}", i) for i in range(40)] + [("lonely", 99)], "g string, a long")
    right = spark.createDataFrame([(g, j) for g in ("hot", "g0", "g3", "other") for j in range(9)], "g string, b long")

    def fn(x, y):
        n, m = x.num_rows, y.num_rows
        return pa.table({"a": x.column("a").take(np.repeat(np.arange(n), m)), "b": y.column("b").take(np.tile(np.arange(m), n))})

    got = sorted(tuple(r) for r in cell_join(left, right, ["g"], "a", "b", fn, "a long, b long", *sizes).collect())
    assert got == sorted(tuple(r) for r in left.join(right, "g").select("a", "b").collect()) and len(got) > 200


def test_scorer_scores_a_text_once_against_every_label(spark, tmp_path):
    log = tmp_path / "scored"
    posts = spark.createDataFrame([("E", str(i), f"text {i % 4}") for i in range(12)] + [("E", "n", None), ("F", "x", "text 0")], "election string, tweet_id string, tweet string")
    labels = spark.createDataFrame([("E", f"t{j}", f"text {j}") for j in range(30)] + [("E", "null", None)], "election string, topic string, sentence string")

    def scorer(texts, hypotheses):
        with open(log, "a") as f:
            f.writelines(f"{t}|{h}\n" for t in texts for h in hypotheses)
        return [[float(h == f"about {t}") for h in hypotheses] for t in texts]

    got = score.score_pairs(posts, labels, scorer, template="about {}", texts_per_cell=2, labels_per_cell=7).collect()
    asked = open(log).read().split("\n")[:-1]
    assert len(asked) == len(set(asked)) == 4 * 30
    assert len(got) == 12 * 30 and sorted((r.tweet_id, r.topic) for r in got if r.score) == sorted((str(i), f"t{i % 4}") for i in range(12))


def test_thousands_of_long_prototypes(spark):
    rng = np.random.default_rng(1)
    labels, vectors = rng.normal(size=(5_000, 768)), rng.normal(size=(6, 768))
    protos = spark.range(5_000).select(F.col("id").alias("proto_label")).mapInArrow(
        lambda bs: (pa.RecordBatch.from_arrays([b.column(0), pa.array(list(labels[b.column(0).to_numpy()]), pa.list_(pa.float64()))], names=["proto_label", "p"]) for b in bs),
        "proto_label long, p array<double>")
    v = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in range(6)] + [(6, [0.0] * 768), (7, None)], "vec_id int, embedding array<double>")
    got = score.cosine_scores(v, protos)
    assert got.count() == 7 * 5_000 and got.filter("score is null").count() == 5_000
    best = {r.vec_id: (r.pred_label, r.cosine) for r in score.nearest_prototype(v, protos).collect()}
    want = (vectors @ labels.T) / np.linalg.norm(vectors, axis=1)[:, None] / np.linalg.norm(labels, axis=1)[None, :]
    for i in range(6):
        assert best[i][0] == int(want[i].argmax()) and best[i][1] == pytest.approx(want[i].max())
    assert best[6][1] is None and best[7] == (None, None)


def test_text_labels(spark):
    labels = spark.createDataFrame([("a", "xx"), ("b", "y"), ("none", None)], "topic string, sentence string")
    protos = score.label_vectors(labels, lambda texts: [[float(t.count("x")), float(t.count("y"))] for t in texts], "topic", "sentence")
    v = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.0, 2.0, 0.0])], "vec_id int, embedding array<double>")
    best = {r.vec_id: r.pred_label for r in score.nearest_prototype(v, protos).collect()}
    assert best == {1: "a", 2: "b"}
