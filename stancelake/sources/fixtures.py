"""Fixture views derived from the driver tables.

The same SQL text runs in Spark and in DuckDB, so the oracle queries can
inline these views as CTEs.  Rules that keep the two engines equal: only
non-null inputs to ``concat``, no backslashes in literals, arithmetic only
(no hashing, no randomness).

* ``fx_statements``: every ``benchmark`` passage is a statement; its topic is
  ``topic_<item_id>`` and it belongs to election ``E<item_id mod 9>``.
* ``fx_topic_labels``: the statements with a topic text that can be scored, the
  passage's first four words.
* ``fx_tweets``: every ``documents`` row, decorated so that all cleaning
  rules fire (retweet headers, mentions, hashtags, URLs, entities, CJK/emoji).
* ``fx_scores``: the classifier output in long form (T6) for every post that
  survives the 4-word rule, paired with every statement of its election.
  The two scores are arithmetic stand-ins for model probabilities.
* ``fx_model_filtered``: a pseudo-model's topic selection over all posts of an
  election (including the short ones, which have no score row): a pair is
  selected when the pseudo-model's topic probability reaches 0.6.
* ``fx_golden``: golden labels for every (party, statement) of an election.
* ``fx_topic_replies`` / ``fx_stance_replies``: model replies, one per
  conversation turn, covering every parsing branch.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {}

VIEWS["fx_statements"] = """
SELECT item_id AS topic_ix, concat('topic_', item_id) AS topic, text AS sentence,
  concat('E', item_id % 9) AS election
FROM benchmark
"""

VIEWS["fx_topic_labels"] = """
SELECT election, topic, topic_ix, regexp_extract(sentence, '^([^ ]+ ?){1,4}', 0) AS topic_label, sentence
FROM fx_statements
"""

VIEWS["fx_tweets"] = """
SELECT cast(doc_id AS varchar(20)) AS tweet_id, doc_id, source AS user_screen_name,
  concat('u', substr(source, 4)) AS user_id,
  concat('E', cast(substr(source, 4) AS int) % 9) AS election, lang,
  timestamp '2019-01-01 00:00:00' + ((doc_id * 7919) % 210) * interval '1' day AS created_at,
  CASE doc_id % 7
    WHEN 0 THEN concat('RT @aa @bb: ', text)
    WHEN 1 THEN concat('@élu @x_y ', text, ' #Été2019 fin')
    WHEN 2 THEN concat(text, ' https://t.co/ab lost words', chr(10), 'kept next line')
    WHEN 3 THEN concat('x &gt; y &lt; z ++ a &amp; b ', text)
    WHEN 4 THEN concat('漢字 🙏 ', text)
    WHEN 5 THEN 'too short'
    ELSE text END AS tweet
FROM documents
"""

VIEWS["fx_calendar"] = """
SELECT DISTINCT election, timestamp '2019-07-30 00:00:00' AS election_ts FROM fx_tweets
"""

VIEWS["fx_scores"] = """
SELECT t.tweet_id, t.election, t.user_screen_name AS screen_name, t.user_id, t.created_at, s.topic, s.sentence,
  ((t.doc_id * 37 + s.topic_ix * 101) % 1000) / 1000.0e0 AS score_topic,
  ((t.doc_id * 53 + s.topic_ix * 17) % 1000) / 1000.0e0 AS score_sentence
FROM fx_tweets t JOIN fx_statements s ON t.election = s.election
WHERE length(t.tweet) - length(replace(t.tweet, ' ', '')) >= 3
"""

VIEWS["fx_model_filtered"] = """
SELECT election, party, topic, tweet_id FROM (
  SELECT t.election, t.user_screen_name AS party, s.topic, t.tweet_id,
    ((t.doc_id * 11 + s.topic_ix * 7) % 13) / 13.0e0 AS p_topic
  FROM fx_tweets t JOIN fx_statements s ON t.election = s.election)
WHERE p_topic >= 0.6e0
"""

VIEWS["fx_golden"] = """
SELECT p.election AS VAA, p.party AS Party, s.sentence AS statement,
  cast(1 + (p.party_no * 5 + s.topic_ix * 3 + p.party_no % 4) % 5 AS int) AS golden_label
FROM (SELECT DISTINCT election, user_screen_name AS party, cast(substr(user_screen_name, 4) AS int) AS party_no
      FROM fx_tweets) p
JOIN fx_statements s ON p.election = s.election
"""

VIEWS["fx_topic_replies"] = """
SELECT concat(conv_id, '-', turn) AS reply_id,
  CASE (conv_id + turn) % 9
    WHEN 0 THEN '{"text": "x", "selected_topics": ["topic_1", "topic_2"]}'
    WHEN 1 THEN concat('{"selected_topics": ["topic_3" // implied by "abc"', chr(10), ', "topic_9"]}')
    WHEN 2 THEN '{"selected_topics": []}'
    WHEN 3 THEN 'Bad Request'
    WHEN 4 THEN concat('[', chr(39), 'topic_4', chr(39), ', ', chr(39), 'not a topic', chr(39), ']')
    WHEN 5 THEN '["topic_5", "topic_5"]'
    WHEN 6 THEN '["topic_6",]'
    WHEN 7 THEN '[topic_7]'
    ELSE concat('["topic_8",', chr(10), ' "topic_10"] and ["topic_11"]') END AS reply
FROM conversations
"""

VIEWS["fx_stance_replies"] = """
SELECT concat(conv_id, '-', turn) AS reply_id,
  CASE (conv_id + turn) % 12
    WHEN 0 THEN '{"stance": "completely agree", "statement": "s"}'
    WHEN 1 THEN '{"stance": "disagree", "statement": "s"}'
    WHEN 2 THEN '{"stance": "neutral", "statement": "s"}'
    WHEN 3 THEN concat('{"stance": "indirectly disagree",', chr(10), '"statement": "s"}')
    WHEN 4 THEN '{"stance": "neutral leaning towards agree"}'
    WHEN 5 THEN '{"stance": "something else"}'
    WHEN 6 THEN concat('Based on the provided tweets, the stance is ', chr(39), 'agree', chr(39), '.')
    WHEN 7 THEN 'The stance is neutral (but leans towards agree). Stance: neither disagree nor agree'
    WHEN 8 THEN concat('the stance appears to be closer to ', chr(39), 'disagree', chr(39), ' than any other option')
    WHEN 9 THEN 'Based on the provided tweets, I cannot determine a clear stance'
    WHEN 10 THEN 'Bad Request'
    ELSE '{"stance": "undetermined"}' END AS reply
FROM conversations
"""

# Posts and replies on which rules fire that the other fixtures never reach:
# direction marks, runs of white space, nothing left after cleaning, event time as
# text or object, the misspelt word in a reply.
VIEWS["fx_odd_tweets"] = """
SELECT cast(doc_id AS varchar(20)) AS tweet_id, doc_id, source AS user_screen_name,
  CASE doc_id % 6
    WHEN 0 THEN concat('\u2066', text, '\u2069 end\u2066')
    WHEN 1 THEN concat('  lead ', chr(9), chr(9), text, '  ', chr(10), '   next line \u00a0')
    WHEN 2 THEN concat(text, '   ', chr(9))
    WHEN 3 THEN 'https://t.co/only gone'
    WHEN 4 THEN '@aa @bb #tag'
    ELSE text END AS tweet,
  concat('2019-0', cast(1 + doc_id % 9 AS varchar(2)), '-1', cast(doc_id % 10 AS varchar(2)), 'T08:00:0',
    cast(doc_id % 7 AS varchar(2)), '.000000Z') AS created_text,
  CASE WHEN doc_id % 3 = 0 THEN timestamp '2018-12-31 12:00:00' + (doc_id % 50) * interval '1' day END AS date_obj
FROM documents
"""

VIEWS["fx_odd_replies"] = """
SELECT concat(conv_id, '-', turn) AS reply_id,
  CASE (conv_id + turn) % 3
    WHEN 0 THEN '["detention centers", "topic_2"]'
    WHEN 1 THEN concat('["topic_3",', chr(10), ' "Detention Centers"]')
    ELSE '["detention centres"]' END AS reply
FROM conversations
"""

# Creation order: each view may use the ones before it.
VIEW_ORDER = list(VIEWS)

# Parties left out of the evaluation (C4); fixed values of the fixture.
EXCLUDED_PARTIES = ("src3", "src7")


# Plain projections of a driver table: read through, never written, so that their texts are not copied.
PROJECTIONS = ("fx_statements", "fx_topic_labels", "fx_tweets", "fx_topic_replies", "fx_stance_replies", "fx_odd_tweets", "fx_odd_replies")

# Tables whose rows carry long texts or feed per-row heavy work.
TEXT_TABLES = ("documents", "pages", "conversations", "fx_tweets", "fx_odd_tweets", "fx_scores", "fx_model_filtered")


def spread(df: DataFrame) -> DataFrame:
    """Give per-row heavy work at least one partition per core.

    At cluster scale the scan already has thousands of splits and this is a
    no-op (no extra shuffle of the raw text); a small input that arrives as
    one row group (one task) is spread round-robin over the cores.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


_WRITTEN: dict[tuple[str, str], dict[str, str]] = {}
_REGISTERED: dict[str, tuple[str, set[str]]] = {}


def register(spark: SparkSession, sf_dir: str, names: Sequence[str] = tuple(VIEWS)) -> None:
    """Register fixture tables, with the tables they are derived from, as temp views.

    Only what is asked for is derived.  A projection of a driver table stays a view of it.  Any other
    fixture is computed once and written as a parquet table under the shared
    checkpoint folder (a stage output, like the scored-posts table of a real run), then
    read back: every query scans narrow columns of a materialized table instead of
    re-deriving it, and the lineage is cut.  Idempotent per session and folder;
    switching back to a folder seen before reuses its tables.
    """
    from ..session import shared_path
    key = f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}"
    folder, done = _REGISTERED.get(key, ("", set()))
    if folder != sf_dir:
        done = set()
        _REGISTERED[key] = (sf_dir, done)
    written = _WRITTEN.setdefault((key, sf_dir), {})

    def need(name: str) -> None:
        if name in done and spark.catalog.tableExists(name):
            return
        if name not in VIEWS:
            read_table(spark, sf_dir, name).createOrReplaceTempView(name)
        elif name in PROJECTIONS:
            sources(name)
            spark.sql(VIEWS[name]).createOrReplaceTempView(name)
        else:
            if name not in written:
                sources(name)
                path = shared_path(spark, name)
                spark.sql(VIEWS[name]).write.parquet(path)
                written[name] = path
            df = spark.read.parquet(written[name])
            (spread(df) if name in TEXT_TABLES else df).createOrReplaceTempView(name)
        done.add(name)

    def sources(name: str) -> None:
        for other in (*BASE_TABLES, *VIEW_ORDER):
            if re.search(rf"(FROM|JOIN) {other}\b", VIEWS[name]):
                need(other)

    for name in names:
        need(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir, [name])
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def with_views(body: str, *names: str) -> str:
    """DuckDB text: the fixture views a query needs as CTEs, then the body."""
    needed: list[str] = []

    def need(n: str) -> None:
        for dep in VIEW_ORDER:
            if dep == n:
                break
            if dep in VIEWS[n] and dep not in needed:
                need(dep)
        if n not in needed:
            needed.append(n)

    for n in names:
        need(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in VIEW_ORDER if n in needed)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
