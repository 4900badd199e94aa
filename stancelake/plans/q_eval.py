"""Registered queries: hybrid method and evaluation (M5, M7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import three_calculated, three_derived
from ..operators import agree, evaluate
from ..operators.joins import first_sentence_per_topic, small
from ..session import shared_path, stored
from ..sources.fixtures import EXCLUDED_PARTIES, view, with_views
from ..sources.ledger import Ledger
from . import sqlkit as S
from .q_agreement import KEYS, sweep_select
from .registry import query

BEST_THRESHOLD = 0.6
METHODS = (  # (name, kind, algorithm or parsing variant, numbers of labels)
    ("sweep algorithm_4 min 3", "sweep", "algorithm_4_min_num_tweets_3", (5,)),
    ("sweep algorithm_3", "sweep", "algorithm_3", (5,)),
    ("model-filtered + sweep stance detector", "hybrid", "algorithm_4_min_num_tweets_3", (5,)),
    ("score-filtered + model stance", "model", "B", (5, 3)),
    ("model-filtered + model stance", "model", "A", (5, 3)),
)
_EXCL = ", ".join(S.lit(p) for p in EXCLUDED_PARTIES)


# ------------------------------------------------------------ Spark side ---

def sweep_results(spark, sf, algorithm, threshold=BEST_THRESHOLD):
    out = agree.agreement_sweep(view(spark, sf, "fx_scores"), view(spark, sf, "fx_statements"),
                                KEYS, [threshold], [algorithm])
    return out.select(F.col("election").alias("VAA"), F.col("screen_name").alias("Party"),
                      F.col("topic").alias("Topic"), F.col("sentence").alias("Sentence"),
                      F.col("agreement_level").alias("Stance"))


def hybrid_table(spark, sf):
    st = view(spark, sf, "fx_statements")
    grid = (view(spark, sf, "fx_tweets").select("election", F.col("user_screen_name").alias("party"))
            .distinct().join(small(st.select("election", "topic")), "election"))
    return agree.hybrid_agreement(view(spark, sf, "fx_model_filtered"), view(spark, sf, "fx_scores"),
                                  grid, min_posts=3)


def hybrid_results(spark, sf):
    h = hybrid_table(spark, sf)
    lookup = small(first_sentence_per_topic(view(spark, sf, "fx_statements")))
    return (h.join(lookup, ["election", "topic"])
            .select(F.col("election").alias("VAA"), F.col("party").alias("Party"),
                    F.col("topic").alias("Topic"), F.col("sentence").alias("Sentence"),
                    F.col("stance").alias("Stance")))


def stance_results(spark, sf, num_labels, variant, filtered, posts):
    from .q_models import model_stance_table
    t = model_stance_table(spark, sf, num_labels, variant, filtered, posts=posts)
    lookup = small(first_sentence_per_topic(view(spark, sf, "fx_statements")))
    return (t.join(lookup, ["election", "topic"])
            .select(F.col("election").alias("VAA"), F.col("party").alias("Party"),
                    F.col("topic").alias("Topic"), F.col("sentence").alias("Sentence"),
                    F.col("stance").alias("Stance")))


RESULTS_LEDGER = "Method string, num_labels int, VAA string, Party string, Topic string, Sentence string, Stance int"
_LEDGERS: dict[tuple[str, str], str] = {}


def results_ledger(spark, sf) -> Ledger:
    """The stance results of every method, each appended once and read by every evaluation of the session.

    Sweep methods come out of one sweep; a model is asked once per distinct prompt, whatever reads its results."""
    from .q_models import j6_model_topics, model_posts, score_pairs
    key = (spark.sparkContext.applicationId, sf)
    path = _LEDGERS.setdefault(key, shared_path(spark, "results"))
    ledger = Ledger(spark, path, RESULTS_LEDGER, ["Method", "num_labels", "VAA", "Party", "Topic"])
    named = lambda df, name, k: df.withColumns({"Method": F.lit(name), "num_labels": F.lit(k)})
    if not ledger.committed("sweep"):
        algorithms = [how for _, kind, how, _ in METHODS if kind == "sweep"]
        out = agree.agreement_sweep(view(spark, sf, "fx_scores"), view(spark, sf, "fx_statements"), KEYS, [BEST_THRESHOLD], algorithms)
        name = F.create_map(*(F.lit(x) for m in METHODS if m[1] == "sweep" for x in (m[2], m[0])))
        ledger.commit(out.select(F.element_at(name, F.col("algorithm")).alias("Method"), F.lit(5).alias("num_labels"), F.col("election").alias("VAA"),
                                 F.col("screen_name").alias("Party"), F.col("topic").alias("Topic"), F.col("sentence").alias("Sentence"),
                                 F.col("agreement_level").alias("Stance")), "sweep")
    left = [(name, kind, how, k) for name, kind, how, labels in METHODS for k in labels if kind != "sweep" and not ledger.committed(f"{kind}-{how}-{k}")]
    posts, pairs = None, {}
    for name, kind, how, k in left:
        if kind == "hybrid":
            out = hybrid_results(spark, sf)
        else:
            # posts are cleaned once for all runs, and the pairs that a variant reads are found once for both numbers of labels
            posts = model_posts(spark, sf) if posts is None else posts
            if how not in pairs:
                pairs[how] = score_pairs(spark, sf) if how == "B" else stored(j6_model_topics(spark, sf, posts), "picked-topics")
            out = stance_results(spark, sf, k, how, pairs[how], posts)
        ledger.commit(named(out, name, k), f"{kind}-{how}-{k}")
    return ledger


def golden(spark, sf):
    g = view(spark, sf, "fx_golden")
    nested = (g.groupBy("VAA", "Party")
              .agg(F.map_from_entries(F.collect_list(F.struct("statement", "golden_label"))).alias("labels")))
    return evaluate.golden_from_nested(nested, EXCLUDED_PARTIES)


def all_pairs(spark, sf):
    return evaluate.scored_pairs(results_ledger(spark, sf).read(), golden(spark, sf))


# ------------------------------------------------------------- SQL side ----

def _hybrid_select() -> str:
    l4 = S.label4("s.score_sentence")
    lv = S.remap4(S.majority("c4_", range(1, 5), "s4"))
    c4 = ", ".join(f"count(*) FILTER (WHERE l4 = {k}) AS c4_{k}" for k in range(1, 5))
    return f"""
WITH j AS (SELECT f.election, f.party, f.topic, f.tweet_id, {l4} AS l4
           FROM fx_model_filtered f LEFT JOIN fx_scores s
             ON s.election = f.election AND s.screen_name = f.party AND s.topic = f.topic
            AND s.tweet_id = f.tweet_id),
agg AS (SELECT election, party, topic, count(*) AS n, sum(l4) AS s4, {c4} FROM j GROUP BY ALL),
grid AS (SELECT DISTINCT t.election, t.user_screen_name AS party, st.topic
         FROM fx_tweets t JOIN fx_statements st ON t.election = st.election)
SELECT g.election, g.party, g.topic, CAST(coalesce(a.n, 0) AS BIGINT) AS num_tweets,
  CAST(CASE WHEN a.n IS NULL OR a.n < 3 THEN 3 ELSE {lv} END AS INTEGER) AS stance
FROM grid g LEFT JOIN agg a ON a.election = g.election AND a.party = g.party AND a.topic = g.topic
"""


def _results_select(kind, how, num_labels=5) -> str:
    if kind == "sweep":
        return (f"SELECT election AS VAA, screen_name AS Party, topic AS Topic, sentence AS Sentence, "
                f"agreement_level AS Stance FROM ({sweep_select([how], [BEST_THRESHOLD])})")
    from .q_models import _SCORE_PAIRS, j6_body, j7_body
    inner = _hybrid_select() if kind == "hybrid" else j7_body(num_labels, how, _SCORE_PAIRS if how == "B" else j6_body())
    return (f"SELECT h.election AS VAA, h.party AS Party, h.topic AS Topic, k.sentence AS Sentence, "
            f"h.stance AS Stance FROM ({inner}) h "
            f"JOIN ({S.known_topics_cte()}) k ON k.election = h.election AND k.topic = h.topic")


_GOLD_SQL = (f"SELECT VAA, Party, statement, golden_label, "
             f"CAST(CASE WHEN golden_label IN (1, 2) THEN 1 WHEN golden_label = 3 THEN 2 ELSE 3 END AS INTEGER)"
             f" AS golden_label_three FROM fx_golden WHERE Party NOT IN ({_EXCL})")


def _all_results_sql() -> str:
    return "\nUNION ALL\n".join(f"SELECT {S.lit(name)} AS Method, {k} AS num_labels, * FROM ({_results_select(kind, how, k)})"
                                for name, kind, how, labels in METHODS for k in labels)


def _pairs_sql() -> str:
    cal = "CASE WHEN r.Stance = 4 THEN 3 WHEN r.Stance = 3 THEN 2 WHEN r.Stance = 2 THEN 1 END"
    der = "CASE WHEN r.Stance IS NULL THEN NULL WHEN r.Stance IN (1, 2) THEN 1 WHEN r.Stance = 3 THEN 2 ELSE 3 END"
    j = (f"(SELECT DISTINCT * FROM ({_all_results_sql()})) r JOIN ({_GOLD_SQL}) g "
         f"ON g.VAA = r.VAA AND g.Party = r.Party AND g.statement = r.Sentence")
    return f"""
SELECT r.Method, unnest(CASE WHEN r.num_labels = 3 THEN [
    {{'scale': 'l3_cal', 'gold': g.golden_label_three, 'pred': {cal}}}] ELSE [
    {{'scale': 'l5', 'gold': g.golden_label, 'pred': r.Stance}},
    {{'scale': 'l3_der', 'gold': g.golden_label_three, 'pred': {der}}}] END) AS x, r.VAA FROM {j}
"""


def _metrics_sql() -> str:
    return f"""
WITH pairs AS (SELECT Method, x.scale AS scale, VAA, x.gold AS gold, x.pred AS pred FROM ({_pairs_sql()})),
valid AS (SELECT * FROM pairs WHERE pred IS NOT NULL),
cls AS (SELECT DISTINCT Method, scale, VAA, gold AS k FROM valid
        UNION SELECT DISTINCT Method, scale, VAA, pred AS k FROM valid),
st AS (SELECT c.Method, c.scale, c.VAA, c.k,
         sum(CASE WHEN v.gold = c.k THEN 1 ELSE 0 END) AS sup,
         sum(CASE WHEN v.pred = c.k THEN 1 ELSE 0 END) AS prd,
         sum(CASE WHEN v.gold = c.k AND v.pred = c.k THEN 1 ELSE 0 END) AS tp
       FROM cls c JOIN valid v ON v.Method = c.Method AND v.scale = c.scale AND v.VAA = c.VAA
       GROUP BY ALL),
f1 AS (SELECT Method, scale, VAA,
         sum(CASE WHEN sup + prd > 0 THEN 2.0 * tp / (sup + prd) ELSE 0 END * sup) / sum(sup) AS f1_weighted
       FROM st GROUP BY ALL),
mae AS (SELECT Method, scale, VAA, avg(abs(gold - pred)) AS mae, count(pred) AS n, count(*) - count(pred) AS n_invalid FROM pairs GROUP BY ALL)
SELECT mae.Method, mae.scale, mae.VAA, f1.f1_weighted, mae.mae, mae.n, mae.n_invalid
FROM mae LEFT JOIN f1 ON f1.Method = mae.Method AND f1.scale = mae.scale AND f1.VAA = mae.VAA
"""


_VIEWS = ("fx_scores", "fx_statements", "fx_model_filtered", "fx_golden", "fx_tweets")


# --------------------------------------------------------------- queries ---

@query("d4_filtered_left_scores", with_views("""
SELECT f.election, f.party, f.topic, f.tweet_id, round(s.score_sentence, 6) AS score_sentence
FROM fx_model_filtered f LEFT JOIN fx_scores s
  ON s.election = f.election AND s.screen_name = f.party AND s.topic = f.topic AND s.tweet_id = f.tweet_id
""", "fx_model_filtered", "fx_scores"))
def d4_filtered_left_scores(spark, sf):
    """Model-filtered posts left-joined to their scores (misses stay, null)."""
    f = view(spark, sf, "fx_model_filtered")
    s = view(spark, sf, "fx_scores").select("election", F.col("screen_name").alias("party"), "topic",
                                             "tweet_id", "score_sentence")
    j = f.join(s, ["election", "party", "topic", "tweet_id"], "left")
    return j.select("election", "party", "topic", "tweet_id",
                    F.round("score_sentence", 6).alias("score_sentence"))


@query("e5_hybrid_agreement", with_views(_hybrid_select(), *_VIEWS))
def e5_hybrid_agreement(spark, sf):
    """E5/Q5: algorithm_4 (min 3) over model-filtered posts, no score threshold."""
    return hybrid_table(spark, sf)


@query("a4_golden_explode", with_views(_GOLD_SQL, "fx_golden"))
def a4_golden_explode(spark, sf):
    """Nested golden map exploded, excluded parties removed."""
    return golden(spark, sf).select("VAA", "Party", "statement", "golden_label", "golden_label_three")


@query("h20_h21_label_maps", with_views(f"""
SELECT VAA, Party, Topic, Stance,
  CAST(CASE WHEN Stance IN (1, 2) THEN 1 WHEN Stance = 3 THEN 2 ELSE 3 END AS INTEGER) AS three_derived,
  CAST(CASE WHEN Stance = 4 THEN 3 WHEN Stance = 3 THEN 2 WHEN Stance = 2 THEN 1 END AS INTEGER) AS three_calculated
FROM ({_results_select('sweep', METHODS[0][2])})
""", *_VIEWS))
def h20_h21_label_maps(spark, sf):
    """H20 (5 -> 3 derived) and H21 (3-label answer -> 1..3, else null)."""
    r = sweep_results(spark, sf, METHODS[0][2])
    return r.select("VAA", "Party", "Topic", "Stance", three_derived("Stance").alias("three_derived"),
                    three_calculated("Stance").alias("three_calculated"))


@query("d3_results_golden", with_views(f"""
SELECT r.VAA, r.Party, r.Sentence, r.Stance, g.golden_label, g.golden_label_three
FROM (SELECT DISTINCT * FROM ({_results_select('sweep', METHODS[0][2])})) r
JOIN ({_GOLD_SQL}) g ON g.VAA = r.VAA AND g.Party = r.Party AND g.statement = r.Sentence
""", *_VIEWS))
def d3_results_golden(spark, sf):
    """D3: results joined with golden labels on (VAA, Party, Sentence)."""
    r = evaluate.prepare_results(sweep_results(spark, sf, METHODS[0][2]), 5)
    j = evaluate.join_golden(r, golden(spark, sf))
    return j.select("VAA", "Party", "Sentence", "Stance", "golden_label", "golden_label_three")


@query("e8_dedupe", with_views(f"""
SELECT DISTINCT * FROM (
  SELECT * FROM ({_results_select('sweep', METHODS[0][2])})
  UNION ALL SELECT * FROM ({_results_select('sweep', METHODS[0][2])})
  UNION ALL SELECT * FROM ({_results_select('sweep', METHODS[1][2])}))
""", *_VIEWS))
def e8_dedupe(spark, sf):
    """A result file appended twice plus a second run: exact duplicates go,
    rows that differ in stance stay."""
    a = sweep_results(spark, sf, METHODS[0][2])
    b = sweep_results(spark, sf, METHODS[1][2])
    return a.unionByName(a).unionByName(b).dropDuplicates()


def _metrics(spark, sf):
    return evaluate.per_election_metrics(all_pairs(spark, sf))


@query("e9_weighted_f1", with_views(
    f"SELECT Method, scale, VAA, round(f1_weighted, 6) AS f1_weighted FROM ({_metrics_sql()})", *_VIEWS))
def e9_weighted_f1(spark, sf):
    """Weighted F1 per method, label scale and election (confusion counts)."""
    return _metrics(spark, sf).select("Method", "scale", "VAA",
                                      F.round("f1_weighted", 6).alias("f1_weighted"))


@query("e10_mae", with_views(
    f"SELECT Method, scale, VAA, round(mae, 6) AS mae, CAST(n AS BIGINT) AS n, CAST(n_invalid AS BIGINT) AS n_invalid FROM ({_metrics_sql()})", *_VIEWS))
def e10_mae(spark, sf):
    """Mean absolute error per method, label scale and election, and what could not be scored."""
    return _metrics(spark, sf).select("Method", "scale", "VAA", F.round("mae", 6).alias("mae"), "n", "n_invalid")


@query("e9_e11_grouping_sets", with_views(f"""
WITH m AS ({_metrics_sql()})
SELECT Method, scale, VAA, round(f1_weighted, 6) AS f1_weighted, round(mae, 6) AS mae, CAST(n AS BIGINT) AS n,
  CAST(n_invalid AS BIGINT) AS n_invalid, 0 AS is_mean FROM m
UNION ALL
SELECT Method, scale, NULL, round(avg(f1_weighted), 6), round(avg(mae), 6), CAST(sum(n) AS BIGINT), CAST(sum(n_invalid) AS BIGINT), 1
FROM m GROUP BY Method, scale
""", *_VIEWS))
def e9_e11_grouping_sets(spark, sf):
    """E9-E11 together: metrics per election and their means over elections, from one aggregate with grouping sets."""
    out = evaluate.metrics_and_means(all_pairs(spark, sf))
    return out.select("Method", "scale", "VAA", F.round("f1_weighted", 6).alias("f1_weighted"), F.round("mae", 6).alias("mae"), "n", "n_invalid", "is_mean")


@query("a7_stance_results", with_views(f"SELECT * FROM ({_all_results_sql()})", *_VIEWS))
def a7_stance_results(spark, sf):
    """The results of all methods as stored: appended in committed batches, read back from the ledger."""
    return results_ledger(spark, sf).read()


@query("e11_mean_over_elections", with_views(f"""
SELECT Method, scale, round(avg(f1_weighted), 6) AS avg_f1, round(avg(mae), 6) AS avg_mae,
  CAST(count(f1_weighted) AS BIGINT) AS n_elections
FROM ({_metrics_sql()}) GROUP BY Method, scale
""", *_VIEWS))
def e11_mean_over_elections(spark, sf):
    """Unweighted mean of the per-election metrics."""
    m = evaluate.mean_over_elections(_metrics(spark, sf))
    return m.select("Method", "scale", F.round("avg_f1", 6).alias("avg_f1"),
                    F.round("avg_mae", 6).alias("avg_mae"), "n_elections")


def _table_sql() -> str:
    cols = []
    for metric, src in (("F1", "f1_weighted"), ("MAE", "mae")):
        for scale in ("l5", "l3_der", "l3_cal"):
            cols.append(f"round(max(CASE WHEN scale = '{scale}' THEN a END), 6) AS avg_{metric}_{scale}"
                        .replace(" a END", f" a_{src} END"))
    body = f"""
SELECT Method, {', '.join(cols)} FROM (
  SELECT Method, scale, avg(f1_weighted) AS a_f1_weighted, avg(mae) AS a_mae
  FROM ({_metrics_sql()}) GROUP BY Method, scale) GROUP BY Method
UNION ALL
SELECT 'classifier only (published)', 0.29e0, 0.53e0, CAST(NULL AS DOUBLE), 1.56e0, 0.85e0, CAST(NULL AS DOUBLE)
"""
    return with_views(body, *_VIEWS)


@query("e12_method_table", _table_sql())
def e12_method_table(spark, sf):
    """E12 + G3: one row per method (explicit pivot) plus the published baseline."""
    t = evaluate.method_table(evaluate.mean_over_elections(_metrics(spark, sf)))
    return t.select("Method", *[F.round(c, 6).alias(c) for c in
                                ("avg_F1_l5", "avg_F1_l3_der", "avg_F1_l3_cal",
                                 "avg_MAE_l5", "avg_MAE_l3_der", "avg_MAE_l3_cal")])
