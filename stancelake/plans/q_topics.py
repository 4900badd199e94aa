"""Registered queries: topic filter, windows, projections, job grid,
translation memory and language detection (M4, M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as T
from ..functions.labels import ALGORITHMS, algorithm_min_posts
from ..operators import score, topics, translate
from ..operators.joins import anti, exclude_parties, semi
from ..session import shared_path
from ..sources.fixtures import EXCLUDED_PARTIES, table, view, with_views
from ..sources.languages import LANGUAGES
from . import sqlkit as S
from .registry import query

MODELS = ("facebook/bart-large-mnli", "MoritzLaurer/DeBERTa-v3-base-mnli-fever-anli",
          "digitalepidemiologylab/covid-twitter-bert-v2-mnli")
SUFFIXES = ("", "_with_@#emoji")
_EXCL = ", ".join(S.lit(p) for p in EXCLUDED_PARTIES)


@query("c1_topic_threshold", with_views(
    "SELECT tweet_id, topic, round(score_topic, 6) AS score_topic FROM fx_scores WHERE score_topic >= 0.6e0",
    "fx_scores"))
def c1_topic_threshold(spark, sf):
    """Inclusive topic-score threshold."""
    s = topics.topic_threshold(view(spark, sf, "fx_scores"), 0.6)
    return s.select("tweet_id", "topic", F.round("score_topic", 6).alias("score_topic"))


@query("q3_topic_filter", with_views(
    "SELECT election, screen_name, topic, tweet_id FROM fx_scores WHERE score_topic >= 0.9e0", "fx_scores"))
def q3_topic_filter(spark, sf):
    """Q3: posts per (election, party, topic) above the configured best threshold (0.9)."""
    return topics.topic_filter(view(spark, sf, "fx_scores"), 0.9).select(
        "election", "screen_name", "topic", "tweet_id")


@query("c2_known_topics", with_views("""
SELECT f.election, f.party, f.topic, f.tweet_id FROM fx_model_filtered f
WHERE EXISTS (SELECT 1 FROM fx_statements s WHERE s.election = f.election AND s.topic = f.topic)
""", "fx_model_filtered", "fx_statements"))
def c2_known_topics(spark, sf):
    """Keep rows whose (election, topic) is in the statement list (semi join)."""
    return semi(view(spark, sf, "fx_model_filtered"), view(spark, sf, "fx_statements"), ["election", "topic"])


@query("c3_party_filter", with_views(
    "SELECT tweet_id, topic FROM fx_scores WHERE screen_name = 'src1'", "fx_scores"))
def c3_party_filter(spark, sf):
    """One party's scores."""
    return topics.party_filter(view(spark, sf, "fx_scores"), "src1").select("tweet_id", "topic")


@query("c4_exclude_parties", with_views(
    f"SELECT tweet_id, user_screen_name AS party FROM fx_tweets WHERE user_screen_name NOT IN ({_EXCL})",
    "fx_tweets"))
def c4_exclude_parties(spark, sf):
    """C4: drop the excluded parties (NOT IN predicate pushed to the scan)."""
    t = view(spark, sf, "fx_tweets").select("tweet_id", F.col("user_screen_name").alias("party"))
    return exclude_parties(t, EXCLUDED_PARTIES, col="party")


def _windows_sql():
    parts = " UNION ALL ".join(f"SELECT '{k}' AS dataset, {v} AS m" for k, v in topics.DATASETS.items())
    return with_views(f"""
SELECT t.tweet_id, d.dataset FROM fx_tweets t JOIN fx_calendar c ON c.election = t.election
JOIN ({parts}) d ON t.created_at >= c.election_ts - to_months(d.m) AND t.created_at < c.election_ts
""", "fx_tweets", "fx_calendar")


@query("c10_dataset_windows", _windows_sql())
def c10_dataset_windows(spark, sf):
    """Every dataset window (D3, D4, D5, D7) each post falls in, one scan."""
    t = view(spark, sf, "fx_tweets").select("tweet_id", "election", "created_at")
    return topics.dataset_windows(t, view(spark, sf, "fx_calendar")).select("tweet_id", "dataset")


@query("c9_dropna", with_views("""
SELECT f.election, f.party, f.topic, f.tweet_id FROM fx_model_filtered f JOIN fx_scores s
  ON s.election = f.election AND s.screen_name = f.party AND s.topic = f.topic AND s.tweet_id = f.tweet_id
""", "fx_model_filtered", "fx_scores"))
def c9_dropna(spark, sf):
    """Rows with any null dropped (here: filtered posts without a score)."""
    f = view(spark, sf, "fx_model_filtered")
    s = view(spark, sf, "fx_scores").select("election", F.col("screen_name").alias("party"), "topic",
                                             "tweet_id", "score_sentence")
    j = f.join(s, ["election", "party", "topic", "tweet_id"], "left").dropna("any")
    return j.select("election", "party", "topic", "tweet_id")


@query("b2_rename_cast", with_views(
    "SELECT CAST(tweet_id AS VARCHAR) AS tweet_id, user_screen_name AS screen_name, CAST(user_id AS VARCHAR) "
    "AS user_id, replace(tweet, chr(10), ' ') AS tweet FROM fx_tweets", "fx_tweets"))
def b2_rename_cast(spark, sf):
    """B2: classifier-output projection: renamed party column, ids as text,
    newlines in stored text replaced by blanks."""
    t = view(spark, sf, "fx_tweets")
    return t.select(F.col("tweet_id").cast("string").alias("tweet_id"),
                    F.col("user_screen_name").alias("screen_name"),
                    F.col("user_id").cast("string").alias("user_id"),
                    T.newline_to_space("tweet").alias("tweet"))


@query("b3_event_time", with_views(
    "SELECT tweet_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS event_time FROM fx_tweets", "fx_tweets"))
def b3_event_time(spark, sf):
    """Event time = date_obj if present, else created_at (parsed if text)."""
    t = view(spark, sf, "fx_tweets")
    return t.select("tweet_id", F.date_format(topics.event_time(t), "yyyy-MM-dd HH:mm:ss").alias("event_time"))


@query("e7_distinct_counts", with_views("""
SELECT election, CAST(count(DISTINCT screen_name) AS BIGINT) AS num_parties,
  CAST(count(DISTINCT topic) AS BIGINT) AS num_topics FROM fx_scores GROUP BY election
""", "fx_scores"))
def e7_distinct_counts(spark, sf):
    """Distinct parties and topics per election."""
    s = view(spark, sf, "fx_scores")
    return s.groupBy("election").agg(F.countDistinct("screen_name").alias("num_parties"),
                                     F.countDistinct("topic").alias("num_topics"))


def _grid_sql():
    models = ", ".join(S.lit(m) for m in MODELS)
    ds = ", ".join(S.lit(d) for d in topics.DATASETS)
    sx = ", ".join(S.lit(x) for x in SUFFIXES)
    al = ", ".join(S.lit(a) for a in ALGORITHMS)
    return with_views(f"""
SELECT election, model, regexp_extract(model, '[^/]*$', 0) AS short_model,
  CASE WHEN contains(model, 'DeBERTa') THEN '{{}}' WHEN contains(model, 'bart') THEN 'This text is about {{}}.'
       ELSE 'This example is {{}}.' END AS template,
  dataset, suffix, algorithm, regexp_extract(algorithm, '_4_min_num_tweets_([0-9])', 1) AS min_posts
FROM (SELECT election, model, dataset, suffix, unnest([{al}]) AS algorithm FROM
       (SELECT election, model, dataset, unnest([{sx}]) AS suffix FROM
         (SELECT election, model, unnest([{ds}]) AS dataset FROM
           (SELECT election, unnest([{models}]) AS model FROM fx_calendar))))
WHERE suffix = '' OR contains(model, 'covid')
""", "fx_calendar")


@query("a5_job_grid", _grid_sql())
def a5_job_grid(spark, sf):
    """A5 + H24/H25/H26: the sweep's job grid per election (model x dataset x
    suffix x algorithm; the emoji suffix only for the tweet-tuned model)."""
    cal = view(spark, sf, "fx_calendar").select("election")

    def arr(vals):
        return F.array(*[F.lit(v) for v in vals])

    g = (cal.withColumn("model", F.explode(arr(MODELS)))
         .withColumn("dataset", F.explode(arr(topics.DATASETS)))
         .withColumn("suffix", F.explode(arr(SUFFIXES)))
         .withColumn("algorithm", F.explode(arr(ALGORITHMS)))
         .filter((F.col("suffix") == "") | F.col("model").contains("covid")))
    return g.select("election", "model", score.short_model_name("model").alias("short_model"),
                    score.template_for("model").alias("template"), "dataset", "suffix", "algorithm",
                    algorithm_min_posts("algorithm").alias("min_posts"))


# ------------------------------------------------------------ translation --

def rule_translator(texts, lang):
    """Deterministic stand-in for a translation service (marks the source)."""
    return [f"[{lang}>en] {t}" for t in texts]


_P2 = (f"SELECT tweet_id, lang, tweet FROM (SELECT tweet_id, lang, {S.clean_p2('tweet')} AS tweet FROM fx_tweets) "
       f"WHERE tweet <> ''")


def _pieces_sql() -> str:
    strip = lambda x: S.h15(S.rx1(x, "^" + S.WS + "+"))
    most = translate.MAX_CHARS - 1
    return f"""CASE WHEN length(tweet) <= {most} THEN [tweet] ELSE
  flatten(list_transform(list_filter(list_transform(regexp_extract_all(tweet, '[^.!?' || chr(10) || ']+[.!?]*|[.!?]+'), lambda x: {strip('x')}), lambda x: x <> ''),
    lambda x: list_transform(range(0, CAST(floor((length(x) - 1) / {most}) AS BIGINT) + 1), lambda i: substr(x, CAST(i * {most} + 1 AS BIGINT), {most})))) END"""


@query("j4_translate_memory", with_views(f"""
WITH p AS ({_P2}),
mem AS (SELECT DISTINCT lang, tweet AS text FROM p WHERE lang <> 'en' AND length(tweet) < 2000),
pc AS (SELECT tweet_id, lang, piece, pos FROM (SELECT tweet_id, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos
       FROM (SELECT tweet_id, lang, {_pieces_sql()} AS ps FROM p WHERE lang IS DISTINCT FROM 'en' AND length(tweet) > 0))),
j AS (SELECT tweet_id, string_agg(concat('[', lang, '>en] ', piece), ' ' ORDER BY pos) AS english,
        bool_and(EXISTS (SELECT 1 FROM mem m WHERE m.lang = pc.lang AND m.text = pc.piece)) AS known
      FROM pc GROUP BY tweet_id)
SELECT p.tweet_id, p.tweet AS original_tweet,
  CASE WHEN p.lang = 'en' THEN p.tweet ELSE coalesce(j.english, '') END AS tweet,
  CASE WHEN p.lang = 'en' THEN 'copied' WHEN j.tweet_id IS NULL THEN 'empty' WHEN j.known THEN 'memory' ELSE 'ok' END AS translation_status
FROM p LEFT JOIN j ON j.tweet_id = p.tweet_id
""", "fx_tweets"))
def j4_translate_memory(spark, sf):
    """J4 + C7 + C12 + H31 + B1: English copied, long texts translated sentence by sentence and
    rejoined, short texts served from a memory built earlier, the rest translated."""
    p = T.clean_posts(view(spark, sf, "fx_tweets"), "P2").select("tweet_id", "lang", "tweet")
    memory = translate.translation_memory(spark)
    known = p.filter((F.col("lang") != "en") & (F.length("tweet") < 2000)).select("lang", F.col("tweet").alias("text")).distinct()
    translate.remember(memory, known.withColumn("translation", F.concat(F.lit("["), F.col("lang"), F.lit(">en] "), F.col("text"))))
    out, _memory = translate.translate(p, rule_translator, memory)
    return out.select("tweet_id", "original_tweet", "tweet", "translation_status")


def _lang_case(col):
    return "CASE " + " ".join(f"WHEN {col} = {S.lit(k)} THEN {S.lit(v)}" for k, v in LANGUAGES.items()) + " ELSE 'auto' END"


@query("d8_language_names", f"""
SELECT doc_id, lang, {_lang_case('lang')} AS language FROM documents
""")
def d8_language_names(spark, sf):
    """Language code -> name ('auto' when unknown)."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", "lang", translate.language_name("lang").alias("language"))


def _tri_sql(src, idc, textc, extra=""):
    return (f"SELECT {idc}{extra}, unnest(list_transform(range(1, len(c) - 1), "
            f"lambda i: c[i] || c[i + 1] || c[i + 2])) AS tri FROM "
            f"(SELECT {idc}{extra}, string_split(lower({textc}), '') AS c FROM {src})")


@query("j5_detect_language", f"""
WITH occ0 AS ({_tri_sql('documents', 'doc_id', 'text', ', lang')}),
counts AS (SELECT lang, tri, count(*) AS c FROM occ0 WHERE doc_id % 2 = 1 AND lang IS NOT NULL GROUP BY ALL),
v AS (SELECT count(DISTINCT tri) AS v FROM counts),
den AS (SELECT lang, sum(c) + (SELECT v FROM v) AS d FROM counts GROUP BY lang),
prof AS (SELECT c.lang, c.tri, ln(c.c + 1) - ln(d.d) AS lp, -ln(d.d) AS unseen FROM counts c JOIN den d ON d.lang = c.lang),
occ AS (SELECT doc_id, tri, count(*) AS k FROM occ0 GROUP BY ALL),
tot AS (SELECT doc_id, sum(k) AS n_tri FROM occ GROUP BY ALL),
pl AS (SELECT o.doc_id, p.lang, p.unseen, sum(o.k * (p.lp - p.unseen)) AS gain FROM occ o JOIN prof p ON p.tri = o.tri GROUP BY ALL),
sc AS (SELECT pl.doc_id, pl.lang, gain + n_tri * unseen AS score FROM pl JOIN tot ON tot.doc_id = pl.doc_id),
best AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) AS rn FROM sc)
SELECT d.doc_id, d.lang, d.doc_id % 2 = 0 AS held_out, coalesce(b.lang, 'none') AS predicted_lang, {_lang_case("coalesce(b.lang, 'none')")} AS predicted_name
FROM documents d LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON b.doc_id = d.doc_id
""")
def j5_detect_language(spark, sf):
    """Trigram language profiles learned from the documents with an odd id, then every
    document's most likely language ('none' without a known trigram); those with an even id are held out."""
    d = table(spark, sf, "documents")
    profile = translate.language_profile(d.filter(F.col("doc_id") % 2 == 1), "text", "lang")
    pred = translate.detect_language(d, profile, "doc_id", "text")
    return d.select("doc_id", "lang", (F.col("doc_id") % 2 == 0).alias("held_out")).join(pred, "doc_id")


@query("h31_translation_join", f"""
SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)),
  lambda p: {S.h15(S.rx1('p', '^' + S.WS + '+'))}), ' ')) AS joined_md5
FROM documents
""")
def h31_translation_join(spark, sf):
    """Translated sentences stripped and joined with one blank
    (here the lines of each document stand in for the sentences)."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(P.translation_join(F.split("text", "\n"))).alias("joined_md5"))


@query("k1_resume_anti", with_views(f"""
WITH p AS (SELECT tweet_id, created_at, tweet FROM (SELECT tweet_id, created_at, {S.clean_p1('tweet')} AS tweet
           FROM fx_tweets) WHERE tweet <> '' AND {S.h17('tweet')} >= 4)
SELECT tweet_id FROM p WHERE NOT EXISTS
  (SELECT 1 FROM p d WHERE d.tweet_id = p.tweet_id AND d.created_at < TIMESTAMP '2019-04-01 00:00:00')
""", "fx_tweets"))
def k1_resume_anti(spark, sf):
    """K1: resume by keys -- posts already scored by an earlier run (those
    before April) are skipped with an anti join on the output keys."""
    path = shared_path(spark, "cleaned-keys")            # cleaned once, read as input and as what an earlier run scored
    T.clean_posts(view(spark, sf, "fx_tweets"), "P1").select("tweet_id", "created_at").write.parquet(path)
    p = spark.read.schema("tweet_id string, created_at timestamp").parquet(path)
    done = p.filter(F.col("created_at") < F.lit("2019-04-01 00:00:00").cast("timestamp")).select("tweet_id")
    return anti(p, done, ["tweet_id"]).select("tweet_id")


@query("b5_normalize_topic", with_views("""
SELECT topic, replace(concat(topic, ' or ', election), ' or ', '/') AS normalized FROM fx_statements
""", "fx_statements"))
def b5_normalize_topic(spark, sf):
    """A path-safe topic name ('a or b', as stored by file-per-topic
    writers) mapped back to the statement topic ('a/b')."""
    st = view(spark, sf, "fx_statements")
    return st.select("topic", topics.normalize_topic(F.concat("topic", F.lit(" or "), "election")).alias("normalized"))
