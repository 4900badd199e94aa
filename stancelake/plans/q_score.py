"""Registered queries: scoring and the classifier output shape (M3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.labels import ALGORITHMS, TOPIC_THRESHOLDS
from ..operators import agree, score, textjoin
from ..operators.joins import small
from ..sources.fixtures import table, view, with_views
from . import sqlkit as S
from .registry import query

KEYS = ("election", "screen_name", "topic")


@query("j2_lexical_scores", f"""
WITH l AS (SELECT item_id, len(tk) AS n, unnest(tk) AS token
           FROM (SELECT item_id, {S.tokens('text')} AS tk FROM benchmark)),
p AS (SELECT doc_id, unnest({S.tokens('text')}) AS token FROM documents)
SELECT p.doc_id, l.item_id, round(count(*) / any_value(l.n), 6) AS score
FROM p JOIN l ON p.token = l.token
GROUP BY p.doc_id, l.item_id
""")
def j2_lexical_scores(spark, sf):
    """Every (document, benchmark passage) pair sharing a token, scored."""
    docs = table(spark, sf, "documents")
    bench = table(spark, sf, "benchmark").withColumnRenamed("text", "label_text")
    out = score.lexical_scores(docs, bench, ["doc_id"], ["item_id"], post_text="text")
    return out.withColumn("score", F.round("score", 6))


def _p1_posts(spark, sf):
    tw = T.clean_posts(view(spark, sf, "fx_tweets"), "P1")
    return tw.select("election", F.col("user_screen_name").alias("screen_name"), "tweet_id", "tweet")


_P1_SQL = (f"SELECT election, user_screen_name AS screen_name, tweet_id, tweet FROM "
           f"(SELECT election, user_screen_name, tweet_id, {S.clean_p1('tweet')} AS tweet FROM fx_tweets) "
           f"WHERE tweet <> '' AND {S.h17('tweet')} >= 4")


def _pipeline_sql() -> str:
    unions = "\n  UNION ALL\n  ".join(S.algorithm_select(a, "cnt", KEYS) for a in ALGORITHMS)
    body = f"""
WITH tw AS ({_P1_SQL}),
known AS ({S.known_topics_cte()}),
l AS (SELECT election, topic, len(tk) AS n, unnest(tk) AS token
      FROM (SELECT k.election, k.topic, {S.tokens('k.sentence')} AS tk FROM known k)),
p AS (SELECT election, screen_name, tweet_id, unnest({S.tokens('tweet')}) AS token FROM tw),
sc AS (SELECT p.election, p.screen_name, p.tweet_id, l.topic,
         count(*) / any_value(l.n) AS score_topic, count(*) / any_value(l.n) AS score_sentence
       FROM p JOIN l ON p.election = l.election AND p.token = l.token
       GROUP BY p.election, p.screen_name, p.tweet_id, l.topic),
grid AS (SELECT DISTINCT tw.election, tw.screen_name, k.topic FROM tw JOIN known k ON tw.election = k.election),
cnt AS ({S.counts_cte('sc', KEYS, grid_src='grid')}),
res AS (
  {unions})
SELECT r.election, r.screen_name, r.topic, k.sentence, r.algorithm, r.threshold_topic,
  r.avg_agreement, r.agreement_level, r.num_tweets
FROM res r JOIN known k ON k.election = r.election AND k.topic = r.topic
"""
    return with_views(body, "fx_tweets", "fx_statements")


@query("text_to_agreement", _pipeline_sql())
def text_to_agreement(spark, sf):
    """Raw posts -> P1 cleaning -> scores that reach the lowest threshold, by the rare-token join ->
    full sweep (dense grid)."""
    tw = _p1_posts(spark, sf)
    st = view(spark, sf, "fx_statements")
    labels = st.select("election", "topic", F.col("sentence").alias("label_text"))
    sc = textjoin.contained_labels(tw, labels, min(TOPIC_THRESHOLDS), ["screen_name", "tweet_id"], ["topic"],
                                   post_text="tweet", on=["election"])
    scores = sc.select("election", "screen_name", "topic", "tweet_id",
                       F.col("score").alias("score_topic"), F.col("score").alias("score_sentence"))
    grid = tw.select("election", "screen_name").distinct().join(
        small(st.select("election", "topic")), "election")
    out = agree.agreement_sweep(scores, st, KEYS, TOPIC_THRESHOLDS, ALGORITHMS, grid=grid)
    return (out.select("election", "screen_name", "topic", "sentence", "algorithm", "threshold_topic",
                       F.round("avg_agreement", 6).alias("avg_agreement"), "agreement_level",
                       "num_tweets"))


@query("j1_scorer_pairs", with_views(f"""
WITH tw AS ({_P1_SQL})
SELECT tw.election, tw.tweet_id, s.topic,
  round(len(list_intersect({S.tokens('tw.tweet')}, {S.tokens('s.sentence')}))
        / len({S.tokens('s.sentence')}), 6) AS score
FROM tw JOIN fx_statements s ON tw.election = s.election
""", "fx_tweets", "fx_statements"))
def j1_scorer_pairs(spark, sf):
    """Pluggable batch scorer over cells of texts and labels (default: lexical twin of J2)."""
    out = score.score_pairs(_p1_posts(spark, sf), view(spark, sf, "fx_statements"),
                            score.lexical_scorer)
    return out.withColumn("score", F.round("score", 6))


@query("d2_pairing", with_views(f"""
WITH tw AS ({_P1_SQL})
SELECT tw.tweet_id, s.topic, concat('This text is about ', s.topic, '.') AS hypothesis
FROM tw JOIN fx_statements s ON tw.election = s.election
""", "fx_tweets", "fx_statements"))
def d2_pairing(spark, sf):
    """D2 + H24: posts x the statements of their election, with the hypothesis
    text for a bart-family model."""
    tw = _p1_posts(spark, sf)
    st = small(view(spark, sf, "fx_statements").select("election", "topic"))
    tmpl = score.template_for(F.lit("facebook/bart-large-mnli"))
    return (tw.join(st, "election")
            .select("tweet_id", "topic", score.hypothesis(tmpl, F.col("topic")).alias("hypothesis")))


def _wide(spark, sf):
    return score.to_wide(view(spark, sf, "fx_scores"), ["election", "tweet_id"])


_WIDE_SQL = """
SELECT election, tweet_id,
  list_concat(list(topic ORDER BY score_topic DESC, topic), list(sentence ORDER BY score_sentence DESC, sentence)) AS labels,
  list_concat(list(score_topic ORDER BY score_topic DESC, topic), list(score_sentence ORDER BY score_sentence DESC, sentence)) AS scores
FROM fx_scores GROUP BY election, tweet_id
"""


@query("i1_concat", with_views(f"""
SELECT tweet_id, CAST(len(labels) AS INTEGER) AS n_labels, md5(array_to_string(labels, '|')) AS labels_md5,
  labels[1] AS top_topic, round(scores[1], 6) AS top_topic_score
FROM ({_WIDE_SQL})
""", "fx_scores"))
def i1_concat(spark, sf):
    """I1 (+ T5 shape): topic labels then sentence labels, each ranked by score."""
    w = _wide(spark, sf)
    return w.select("tweet_id", F.size("labels").cast("int").alias("n_labels"),
                    F.md5(F.array_join("labels", "|")).alias("labels_md5"),
                    F.element_at("labels", 1).alias("top_topic"),
                    F.round(F.element_at("scores", 1), 6).alias("top_topic_score"))


@query("i2_wide_to_long", with_views("""
SELECT tweet_id, topic AS label, round(score_topic, 6) AS score FROM fx_scores
UNION ALL
SELECT tweet_id, sentence AS label, round(score_sentence, 6) AS score FROM fx_scores
""", "fx_scores"))
def i2_wide_to_long(spark, sf):
    """Wide classifier output back to one row per (post, label)."""
    lg = score.wide_to_long(_wide(spark, sf))
    return lg.select("tweet_id", "label", F.round("score", 6).alias("score"))


@query("d9_label_lookup", with_views("""
SELECT tweet_id, topic, round(score_topic, 6) AS score_topic, round(score_sentence, 6) AS score_sentence
FROM fx_scores
""", "fx_scores"))
def d9_label_lookup(spark, sf):
    """Scores of each (topic, sentence) pair looked up by value in the wide
    arrays (first position wins); rebuilds the long table T6."""
    w = _wide(spark, sf)
    st = small(view(spark, sf, "fx_statements").select("election", "topic", "sentence"))
    j = w.join(st, "election")
    out = j.select("tweet_id", "topic",
                   F.round(score.lookup_label_score(j, F.col("topic")), 6).alias("score_topic"),
                   F.round(score.lookup_label_score(j, F.col("sentence")), 6).alias("score_sentence"))
    return out.filter(F.col("score_topic").isNotNull())


@query("f4_rank_labels", with_views("""
SELECT tweet_id, label, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT tweet_id, label, score, row_number() OVER (PARTITION BY tweet_id ORDER BY score DESC, label) AS rank
  FROM (SELECT tweet_id, topic AS label, score_topic AS score FROM fx_scores
        UNION ALL SELECT tweet_id, sentence, score_sentence FROM fx_scores))
WHERE rank <= 3
""", "fx_scores"))
def f4_rank_labels(spark, sf):
    """the three best labels of each post (top-k is the feature)."""
    lg = score.wide_to_long(_wide(spark, sf))
    r = score.rank_labels(lg, "tweet_id", 3)
    return r.select("tweet_id", "label", F.round("score", 6).alias("score"),
                    F.col("rank").cast("int").alias("rank"))


@query("h32_entailment", """
SELECT vec_id, round(1.0 / (1.0 + exp(CAST(embedding[2] AS DOUBLE) - CAST(embedding[1] AS DOUBLE))), 6)
  AS entailment
FROM embeddings
""")
def h32_entailment(spark, sf):
    """Entailment probability from (entailment, contradiction) logits,
    here the first two components of each embedding."""
    e = table(spark, sf, "embeddings")
    p = score.entailment_probability(F.element_at("embedding", 1).cast("double"),
                                     F.element_at("embedding", 2).cast("double"))
    return e.select("vec_id", F.round(p, 6).alias("entailment"))


@query("j3_prototype_cosine", """
WITH ex AS (SELECT vec_id, label, unnest(generate_series(1, len(embedding))) AS pos,
                   CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
proto AS (SELECT label AS proto_label, pos, avg(x) AS p FROM ex GROUP BY ALL),
pn AS (SELECT proto_label, sqrt(sum(p * p)) AS pn FROM proto GROUP BY ALL),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS vn FROM ex GROUP BY ALL),
dots AS (SELECT ex.vec_id, proto.proto_label, sum(x * p) AS dot FROM ex JOIN proto ON ex.pos = proto.pos GROUP BY ALL),
cos AS (SELECT d.vec_id, d.proto_label, dot / (vn * pn) AS cosine
        FROM dots d JOIN pn ON d.proto_label = pn.proto_label JOIN vn ON d.vec_id = vn.vec_id),
best AS (SELECT vec_id, proto_label, cosine,
           row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, proto_label) AS rn FROM cos)
SELECT e.vec_id, e.label, b.proto_label AS pred_label, round(b.cosine, 6) AS cosine
FROM best b JOIN embeddings e ON e.vec_id = b.vec_id WHERE b.rn = 1
""")
def j3_prototype_cosine(spark, sf):
    """Nearest label prototype (element-wise mean vector) by cosine."""
    e = table(spark, sf, "embeddings")
    best = score.nearest_prototype(e, score.prototypes(e), keep=["label"])
    return best.select("vec_id", "label", "pred_label", F.round("cosine", 6).alias("cosine"))


_COS_SQL = """
ex AS (SELECT vec_id, label, unnest(generate_series(1, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
proto AS (SELECT label AS proto_label, pos, avg(x) AS p FROM ex GROUP BY ALL),
pn AS (SELECT proto_label, sqrt(sum(p * p)) AS pn FROM proto GROUP BY ALL),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS vn FROM ex GROUP BY ALL),
dots AS (SELECT ex.vec_id, proto.proto_label, sum(x * p) AS dot FROM ex JOIN proto ON ex.pos = proto.pos GROUP BY ALL)
SELECT d.vec_id, d.proto_label, round(CASE WHEN vn > 0 AND pn > 0 THEN dot / (vn * pn) END, 6) AS score
FROM dots d JOIN pn ON d.proto_label = pn.proto_label JOIN vn ON d.vec_id = vn.vec_id
"""


@query("j3_label_scores", f"WITH {_COS_SQL}")
def j3_label_scores(spark, sf):
    """J3 as a label scorer: the cosine of every vector and every label prototype."""
    e = table(spark, sf, "embeddings")
    out = score.cosine_scores(e, score.prototypes(e))
    return out.withColumn("score", F.round("score", 6))


def _hashed_words(texts):
    """Deterministic stand-in for a text encoder: word counts in 32 cells by first letter."""
    return [[float(sum(ord(w[0].lower()) % 32 == k for w in t.split() if w)) for k in range(32)] for t in texts]


@query("j3_text_labels", with_views("""
WITH w AS (SELECT topic, unnest(string_split_regex(sentence, '[ \t\n\x0b\x0c\r]+')) AS w FROM fx_statements),
lv AS (SELECT topic, ord(lower(w)) % 32 AS k, count(*) AS p FROM w WHERE w <> '' GROUP BY ALL),
ln AS (SELECT topic, sqrt(sum(p * p)) AS pn FROM lv GROUP BY ALL),
ex AS (SELECT vec_id, unnest(generate_series(0, 31)) AS k, CAST(unnest(embedding[1:32]) AS DOUBLE) AS x FROM embeddings),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS vn FROM ex GROUP BY ALL)
SELECT e.vec_id, t.topic, round(coalesce(d.dot, 0) / (vn.vn * ln.pn), 6) AS score
FROM embeddings e CROSS JOIN (SELECT topic FROM fx_statements) t JOIN vn ON vn.vec_id = e.vec_id JOIN ln ON ln.topic = t.topic
LEFT JOIN (SELECT ex.vec_id, lv.topic, sum(ex.x * lv.p) AS dot FROM ex JOIN lv ON lv.k = ex.k GROUP BY ALL) d ON d.vec_id = e.vec_id AND d.topic = t.topic
""", "fx_statements"))
def j3_text_labels(spark, sf):
    """J3 with text labels: statements encoded by a plugged encoder, then scored against every vector (its first 32 values)."""
    protos = score.label_vectors(view(spark, sf, "fx_statements"), _hashed_words, "topic", "sentence")
    e = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    out = score.cosine_scores(e, protos)
    return out.select("vec_id", F.col("proto_label").alias("topic"), F.round("score", 6).alias("score"))
