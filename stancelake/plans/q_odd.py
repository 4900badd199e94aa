"""Registered queries on odd inputs: rules that the plain fixtures never reach, each changing rows here."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.replies import topics_from_reply
from ..operators import model_steps as ms
from ..operators import score, topics
from ..operators.joins import semi, small
from ..sources.fixtures import view, with_views
from . import sqlkit as S
from .q_models import _FP, _V, _p2_tweets, _stance_prompt_sql, _tok_sql
from .registry import query


def _odd(spark, sf):
    return view(spark, sf, "fx_odd_tweets")


for _name, _fn, _sql in (("h2_direction_marks", T.strip_isolates, S.h2), ("h14_white_space_runs", T.squeeze_whitespace, S.h14),
                         ("h15_right_strip", T.rstrip, S.h15)):
    query(_name, with_views(f"SELECT tweet_id, md5({_sql('tweet')}) AS tweet_md5, {_sql('tweet')} <> tweet AS changed FROM fx_odd_tweets", "fx_odd_tweets"))(
        lambda spark, sf, _f=_fn: _odd(spark, sf).select("tweet_id", F.md5(_f("tweet")).alias("tweet_md5"), (_f("tweet") != F.col("tweet")).alias("changed")))


@query("c5_nothing_left", with_views(f"""
SELECT c = '' AS nothing_left, CAST(count(*) AS BIGINT) AS posts, CAST(count(*) FILTER (WHERE c <> '' AND {S.h17('c')} < 4) AS BIGINT) AS too_short
FROM (SELECT {S.clean_p1('tweet')} AS c FROM fx_odd_tweets) GROUP BY 1
""", "fx_odd_tweets"))
def c5_nothing_left(spark, sf):
    """Posts of which cleaning leaves nothing, beside those it leaves too short."""
    c = _odd(spark, sf).select(T.clean_p1("tweet").alias("c"))
    return c.groupBy((F.col("c") == "").alias("nothing_left")).agg(
        F.count(F.lit(1)).alias("posts"), F.count_if((F.col("c") != "") & (T.word_count("c") < 4)).alias("too_short"))


@query("c2_unknown_topics", with_views("""
SELECT tweet_id, topic FROM (SELECT tweet_id, CASE WHEN CAST(tweet_id AS BIGINT) % 5 = 0 THEN concat('old ', topic) ELSE topic END AS topic, election FROM fx_scores) s
WHERE EXISTS (SELECT 1 FROM fx_statements k WHERE k.topic = s.topic AND k.election = s.election)
""", "fx_scores", "fx_statements"))
def c2_unknown_topics(spark, sf):
    """A fifth of the posts carry topics the statement list doesn't know; they go."""
    old = F.when(F.col("tweet_id").cast("long") % 5 == 0, F.concat(F.lit("old "), "topic")).otherwise(F.col("topic"))
    s = view(spark, sf, "fx_scores").select("tweet_id", "election", old.alias("topic"))
    return semi(s, view(spark, sf, "fx_statements"), ["election", "topic"]).select("tweet_id", "topic")


@query("b3_event_time_text", with_views("""
SELECT tweet_id, strftime(strptime(created_text, '%Y-%m-%dT%H:%M:%S.%fZ'), '%Y-%m-%d %H:%M:%S') AS event_time FROM fx_odd_tweets
""", "fx_odd_tweets"))
def b3_event_time_text(spark, sf):
    """No date_obj, created_at as text: parsed."""
    t = _odd(spark, sf).select("tweet_id", F.col("created_text").alias("created_at"))
    return t.select("tweet_id", F.date_format(topics.event_time(t), "yyyy-MM-dd HH:mm:ss").alias("event_time"))


@query("b3_event_time_object", with_views("""
SELECT tweet_id, strftime(coalesce(date_obj, strptime(created_text, '%Y-%m-%dT%H:%M:%S.%fZ')), '%Y-%m-%d %H:%M:%S') AS event_time FROM fx_odd_tweets
""", "fx_odd_tweets"))
def b3_event_time_object(spark, sf):
    """date_obj where there is one, else created_at as text."""
    t = _odd(spark, sf).select("tweet_id", "date_obj", F.col("created_text").alias("created_at"))
    return t.select("tweet_id", F.date_format(topics.event_time(t), "yyyy-MM-dd HH:mm:ss").alias("event_time"))


@query("i5_spelling", with_views("""
SELECT reply_id, CASE m WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END AS topics FROM
  (SELECT reply_id, CASE WHEN contains(reply, '"topic_2"') THEN 0 WHEN contains(reply, '"topic_3"') THEN 1 ELSE 2 END AS m,
     'detention centres,topic_2' AS t0, 'topic_3,detention centers' AS t1, 'detention centres' AS t2 FROM fx_odd_replies)
""", "fx_odd_replies"))
def i5_spelling(spark, sf):
    """I5: "centers" in a reply becomes "centres" (as written: small letters), then the list is read."""
    r = view(spark, sf, "fx_odd_replies")
    return r.select("reply_id", F.array_join(F.transform(topics_from_reply("reply"), F.lower), ",").alias("topics"))


SMALL_LIMIT = 2_000


def _cut_sql(sep: int, limit: int) -> str:
    return f"""
WITH fp AS ({_FP}),
c AS (SELECT fp.*, {_tok_sql('fp.tweet')} + {sep} AS cost, {_tok_sql(_stance_prompt_sql("''", 's.sentence'))} AS overhead
      FROM fp JOIN fx_statements s ON s.election = fp.election AND s.topic = fp.topic),
r AS (SELECT election, party, topic, tweet_id,
        sum(cost) OVER (PARTITION BY election, party, topic ORDER BY created_at DESC, tweet_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - {sep} + overhead AS prompt_tokens
      FROM c)
SELECT election, party, topic, tweet_id, CAST(prompt_tokens AS BIGINT) AS prompt_tokens FROM r WHERE prompt_tokens <= {limit}
"""


def _cut(spark, sf, sep):
    st = small(ms.prompt_overhead(view(spark, sf, "fx_statements")).select("election", "topic", "overhead"))
    tw = _p2_tweets(spark, sf).select("tweet_id", "created_at", ms.token_count("tweet").alias("n_tok"))
    fp = view(spark, sf, "fx_model_filtered").join(tw, "tweet_id").join(st, ["election", "topic"])
    r = ms.token_budget(fp, SMALL_LIMIT, F.col("overhead"), token_col="n_tok", separator_cost=sep)
    return r.select("election", "party", "topic", "tweet_id", F.col("prompt_tokens").cast("long"))


query("f2_budget_cut", with_views(_cut_sql(3, SMALL_LIMIT), *_V))(lambda spark, sf: _cut(spark, sf, 3))
query("f2_free_separator", with_views(_cut_sql(0, SMALL_LIMIT), *_V))(lambda spark, sf: _cut(spark, sf, 0))


@query("d9_missing_labels", with_views("""
SELECT t.tweet_id, k.topic, round(s.score_topic, 6) AS score_topic, CASE WHEN s.tweet_id IS NULL THEN 'missing' ELSE 'found' END AS status
FROM (SELECT DISTINCT tweet_id, election FROM fx_scores) t JOIN fx_statements k ON k.election = t.election
LEFT JOIN (SELECT * FROM fx_scores WHERE (CAST(tweet_id AS BIGINT) + length(sentence)) % 7 <> 0) s
  ON s.tweet_id = t.tweet_id AND s.topic = k.topic
WHERE t.tweet_id IN (SELECT tweet_id FROM fx_scores WHERE (CAST(tweet_id AS BIGINT) + length(sentence)) % 7 <> 0)
""", "fx_scores", "fx_statements"))
def d9_missing_labels(spark, sf):
    """Labels that the classifier output of a post lacks are reported, not dropped."""
    some = view(spark, sf, "fx_scores").filter((F.col("tweet_id").cast("long") + F.length("sentence")) % 7 != 0)
    j = score.to_wide(some, ["election", "tweet_id"]).join(small(view(spark, sf, "fx_statements").select("election", "topic")), "election")
    value = score.lookup_label_score(j, F.col("topic"))
    status = F.when(F.array_position("labels", F.col("topic")) > 0, "found").otherwise("missing")
    return j.select("tweet_id", "topic", F.round(value, 6).alias("score_topic"), status.alias("status"))


@query("h33_rate_limit", with_views("""
SELECT reply_id, CASE WHEN contains(e, '429') THEN 'rate_limited' ELSE 'error' END AS status
FROM (SELECT reply_id, concat('HTTP ', CASE WHEN length(reply) % 2 = 0 THEN '429 too many requests' ELSE '500' END) AS e FROM fx_stance_replies)
""", "fx_stance_replies"))
def h33_rate_limit(spark, sf):
    """An error that mentions 429 is a rate limit."""
    from ..operators.translate import status_of_error
    r = view(spark, sf, "fx_stance_replies")
    e = F.concat(F.lit("HTTP "), F.when(F.length("reply") % 2 == 0, "429 too many requests").otherwise("500"))
    return r.select("reply_id", status_of_error(e).alias("status"))
