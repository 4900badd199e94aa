"""Weighted F1 / MAE from confusion counts against a pure-Python definition."""

import random

from stancelake.operators import evaluate


def f1_weighted_py(gold, pred):
    labels = sorted(set(gold) | set(pred))
    total = len(gold)
    out = 0.0
    for k in labels:
        tp = sum(1 for g, p in zip(gold, pred) if g == k and p == k)
        sup = sum(1 for g in gold if g == k)
        prd = sum(1 for p in pred if p == k)
        f1 = 2 * tp / (sup + prd) if sup + prd else 0.0
        out += f1 * sup
    return out / total


def test_metrics_match_python(spark):
    rnd = random.Random(7)
    rows = []
    for e in ("E1", "E2", "E3"):
        for _ in range(60):
            g = rnd.randint(1, 5)
            p = g if rnd.random() < 0.4 else rnd.randint(1, 5)
            rows.append(("m", "l5", e, g, p))
    rows.append(("m", "l5", "E1", 3, None))          # invalid prediction: counted, not scored
    df = spark.createDataFrame(rows, "Method string, scale string, VAA string, gold int, pred int")
    got = {r.VAA: r for r in evaluate.per_election_metrics(df).collect()}
    for e in ("E1", "E2", "E3"):
        gs = [g for _, _, ee, g, p in rows if ee == e and p is not None]
        ps = [p for _, _, ee, g, p in rows if ee == e and p is not None]
        assert abs(got[e].f1_weighted - f1_weighted_py(gs, ps)) < 1e-12
        assert abs(got[e].mae - sum(abs(a - b) for a, b in zip(gs, ps)) / len(gs)) < 1e-12
    assert got["E1"].n_invalid == 1


def test_election_without_a_valid_prediction_stays(spark):
    rows = [("m", "l5", "E1", 1, 1), ("m", "l5", "E1", 2, 3), ("m", "l5", "bad", 3, None), ("m", "l5", "bad", 4, None)]
    df = spark.createDataFrame(rows, "Method string, scale string, VAA string, gold int, pred int")
    got = {(r.VAA, r.is_mean): r for r in evaluate.metrics_and_means(df).collect()}
    assert set(got) == {("E1", 0), ("bad", 0), (None, 1)}
    bad, mean = got["bad", 0], got[None, 1]
    assert (bad.f1_weighted, bad.mae, bad.n, bad.n_invalid) == (None, None, 0, 2)
    assert mean.f1_weighted == got["E1", 0].f1_weighted and mean.n_elections == 1 and mean.n_invalid == 2 and mean.mae == 0.5


def test_all_scales_from_one_scan(spark):
    results = spark.createDataFrame([("m", 5, "E", "p", "t", "s", 4), ("m", 5, "E", "p", "t", "s", 4), ("m", 3, "E", "p", "t", "s", 2), ("m", 3, "E", "q", "t", "s", 5),
                                     ("m", 5, "E", "q", "t", "s", None)], "Method string, num_labels int, VAA string, Party string, Topic string, Sentence string, Stance int")
    golden = spark.createDataFrame([("E", "p", "s", 5, 3), ("E", "q", "s", 1, 1)], "VAA string, Party string, statement string, golden_label int, golden_label_three int")
    pairs = evaluate.scored_pairs(results, golden)
    assert sorted((r.scale, r.gold, r.pred) for r in pairs.collect() if r.pred is not None) == [("l3_cal", 3, 1), ("l3_der", 3, 3), ("l5", 5, 4)]
    assert sorted(r.scale for r in pairs.collect() if r.pred is None) == ["l3_cal", "l3_der", "l5"]
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_method_table_has_baseline(spark):
    means = spark.createDataFrame([("m", "l5", 0.5, 1.0, 3)], "Method string, scale string, avg_f1 double, "
                                                              "avg_mae double, n_elections long")
    t = {r.Method: r for r in evaluate.method_table(means).collect()}
    assert t["classifier only (published)"].avg_F1_l5 == 0.29 and t["classifier only (published)"].avg_F1_l3_cal is None
    assert t["m"].avg_F1_l5 == 0.5 and t["m"].avg_F1_l3_der is None
