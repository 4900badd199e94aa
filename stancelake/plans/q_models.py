"""Registered queries: language-model steps (M6: F1-F3, E13, H27-H30, I4-I14, J6-J8)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as T
from ..functions.replies import (ALLOWED_PHRASES_A, ALLOWED_PHRASES_B, FALLBACK_LEAD_A, FALLBACK_LEAD_B,
                                 FALLBACK_WORDS, NEUTRAL_WORDS, CANONICAL_OF, OVERRIDES_A, OVERRIDES_B,
                                 STANCE_WORDS_A, STANCE_WORDS_B, stance_from_reply, topics_from_reply)
from ..functions.labels import STANCE_TO_INT, NEUTRAL
from ..operators import model_steps as ms
from ..operators import topics
from ..operators.joins import small
from ..sources.fixtures import view, with_views
from . import sqlkit as S
from .registry import query

GROUP = ("election", "party", "topic")
TOP_N = 10
LIMIT = ms.CONTEXT_LIMITS["mixtral"]


# ------------------------------------------------------------ inputs -------

def _p2_tweets(spark, sf, emoji=False):
    return T.clean_posts(view(spark, sf, "fx_tweets"), "P2", remove_tags_and_emoji=emoji)


def _filtered_posts(spark, sf):
    """Model-filtered ids joined to the full (P2-cleaned) posts."""
    tw = _p2_tweets(spark, sf).select("tweet_id", "tweet", "created_at")
    # the ids pack into few bytes on disk but are many rows: a table of them in memory would grow with the input
    return view(spark, sf, "fx_model_filtered").hint("merge").join(tw, "tweet_id")


_P2 = (f"SELECT tweet_id, user_screen_name, election, created_at, tweet FROM "
       f"(SELECT tweet_id, user_screen_name, election, created_at, {S.clean_p2('tweet')} AS tweet FROM fx_tweets) "
       f"WHERE tweet <> ''")
_FP = (f"SELECT f.election, f.party, f.topic, f.tweet_id, t.tweet, t.created_at "
       f"FROM fx_model_filtered f JOIN ({_P2}) t ON t.tweet_id = f.tweet_id")
_TOPN = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY election, party, topic "
         f"ORDER BY created_at DESC, tweet_id) AS recency_rank FROM ({_FP})) WHERE recency_rank <= {TOP_N}")
_V = ("fx_model_filtered", "fx_tweets", "fx_statements")


def _tok_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, {S.lit(ms.TOKEN_PATTERN)}))"


def _stance_prompt_sql(posts: str, sentence: str, num_labels: int = 5) -> str:
    word, labels = P.STANCE_LABELS_5 if num_labels == 5 else P.STANCE_LABELS_3
    return (f"concat({S.lit(P.STANCE_PROMPT_INTRO)}, {posts}, {S.lit(P.STANCE_PROMPT_AFTER_TWEETS)}, "
            f"{sentence}, {S.lit(P.STANCE_PROMPT_AFTER_STATEMENT)}, {S.lit(f'{word} values: {labels}')}, "
            f"{S.lit(P.STANCE_PROMPT_TAIL)})")


_GROUP_WINDOW = "PARTITION BY election, party, topic"


def _joined_sql(num_labels: int = 5, pairs: str = "fx_model_filtered") -> str:
    """(election, party, topic, batch_no, sentence, num_posts, posts_joined): every group dealt into prompts that fit.

    Equal to the Spark side where no post alone exceeds half the context (there it is cut into pieces)."""
    room = f"({LIMIT + 3} - overhead)"
    return f"""
SELECT election, party, topic, CAST(batch_no AS INTEGER) AS batch_no, any_value(sentence) AS sentence,
  CAST(count(*) AS INTEGER) AS num_posts, string_agg(tweet, {S.lit(P.SEPARATOR)} ORDER BY created_at DESC, tweet_id) AS posts_joined
FROM (SELECT *, CASE WHEN sum(cost) OVER ({_GROUP_WINDOW}) <= {room} THEN 0 ELSE
        floor(coalesce(sum(cost) OVER ({_GROUP_WINDOW} ORDER BY created_at DESC, tweet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              / greatest({room} - max(cost) OVER ({_GROUP_WINDOW}), 1)) END AS batch_no
      FROM (SELECT f.election, f.party, f.topic, f.tweet_id, t.tweet, t.created_at, s.sentence, {_tok_sql('t.tweet')} + 3 AS cost,
              {_tok_sql(_stance_prompt_sql("''", 's.sentence', num_labels))} AS overhead
            FROM ({pairs}) f JOIN ({_P2}) t ON t.tweet_id = f.tweet_id
            JOIN fx_statements s ON s.election = f.election AND s.topic = f.topic))
GROUP BY ALL
"""


# ------------------------------------------------------------ windows ------

@query("d5_filtered_posts_text", with_views(f"SELECT election, party, topic, tweet_id, md5(tweet) AS tweet_md5 "
                                            f"FROM ({_FP})", *_V))
def d5_filtered_posts_text(spark, sf):
    """Filtered ids joined to the cleaned posts (inner on tweet_id)."""
    fp = _filtered_posts(spark, sf)
    return fp.select("election", "party", "topic", "tweet_id", F.md5("tweet").alias("tweet_md5"))


@query("f1_recent_top_n", with_views(
    f"SELECT election, party, topic, tweet_id, CAST(recency_rank AS INTEGER) AS recency_rank FROM ({_TOPN})", *_V))
def f1_recent_top_n(spark, sf):
    """the 10 most recent filtered posts per (election, party, topic)."""
    r = ms.recent_top_n(_filtered_posts(spark, sf), TOP_N)
    return r.select("election", "party", "topic", "tweet_id", F.col("recency_rank").cast("int"))


@query("f2_token_budget", with_views(f"""
WITH fp AS ({_FP}),
c AS (SELECT fp.*, {_tok_sql('fp.tweet')} + 3 AS cost,
        {_tok_sql(_stance_prompt_sql("''", 's.sentence'))} AS overhead
      FROM fp JOIN fx_statements s ON s.election = fp.election AND s.topic = fp.topic),
r AS (SELECT election, party, topic, tweet_id,
        sum(cost) OVER (PARTITION BY election, party, topic ORDER BY created_at DESC, tweet_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 3 + overhead AS prompt_tokens
      FROM c)
SELECT election, party, topic, tweet_id, CAST(prompt_tokens AS BIGINT) AS prompt_tokens
FROM r WHERE prompt_tokens <= {LIMIT}
""", *_V))
def f2_token_budget(spark, sf):
    """most-recent prefix of each (party, topic) whose stance prompt fits
    the local model's context (32,300 tokens)."""
    st = small(ms.prompt_overhead(view(spark, sf, "fx_statements")).select("election", "topic", "overhead"))
    tw = _p2_tweets(spark, sf).select("tweet_id", "created_at", ms.token_count("tweet").alias("n_tok"))
    fp = view(spark, sf, "fx_model_filtered").join(tw, "tweet_id").join(st, ["election", "topic"])
    r = ms.token_budget(fp, LIMIT, F.col("overhead"), token_col="n_tok")
    return r.select("election", "party", "topic", "tweet_id", F.col("prompt_tokens").cast("long"))


@query("f3_char_batches", with_views(f"""
SELECT tweet_id, CAST(chars_before AS BIGINT) AS chars_before,
  CAST(floor(chars_before / {ms.BATCH_CHARS}) AS INTEGER) AS batch_no
FROM (SELECT tweet_id, sum(length(tweet) + 3) OVER (PARTITION BY election, user_screen_name
        ORDER BY created_at, tweet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cb0,
        coalesce(cb0, 0) AS chars_before FROM ({_P2}))
""", "fx_tweets"))
def f3_char_batches(spark, sf):
    """lossless 10,000-character batches of each party's posts in time
    order, via the skew-safe distributed prefix sum."""
    tw = _p2_tweets(spark, sf).withColumnRenamed("user_screen_name", "party")
    b = ms.char_batches(tw)
    return b.select("tweet_id", F.col("chars_before").cast("long"), "batch_no")


def _batches(spark, sf, num_labels: int = 5):
    posts = _p2_tweets(spark, sf).select("tweet_id", "tweet", "created_at")
    return ms.joined_batches(view(spark, sf, "fx_model_filtered"), posts, view(spark, sf, "fx_statements"), LIMIT, num_labels)


@query("e13_join_posts", with_views(
    f"SELECT election, party, topic, batch_no, num_posts, md5(posts_joined) AS posts_md5 FROM ({_joined_sql()})", *_V))
def e13_join_posts(spark, sf):
    """All posts of each group joined with '~|~', newest first, in batches that fit the context."""
    j = _batches(spark, sf)
    return j.select("election", "party", "topic", "batch_no", F.col("num_posts").cast("int"),
                    F.md5("posts_joined").alias("posts_md5"))


# ------------------------------------------------------------ prompts ------

def _stance_prompts(spark, sf, num_labels):
    return _batches(spark, sf, num_labels).withColumn("prompt", P.stance_prompt(F.col("posts_joined"), F.col("sentence"), num_labels))


def _stance_prompt_query_sql(num_labels):
    return with_views(f"""
SELECT j.election, j.party, j.topic, j.batch_no, md5({_stance_prompt_sql('j.posts_joined', 'j.sentence', num_labels)}) AS prompt_md5,
  md5(concat({S.lit(P.INSTRUCTION_OPEN)}, {_stance_prompt_sql('j.posts_joined', 'j.sentence', num_labels)},
             {S.lit(P.INSTRUCTION_CLOSE)})) AS wrapped_md5
FROM ({_joined_sql(num_labels)}) j
""", *_V)


for _k in (5, 3):
    query(f"h28_stance_prompt_{_k}", _stance_prompt_query_sql(_k))(
        lambda spark, sf, _n=_k: _stance_prompts(spark, sf, _n).select(
            "election", "party", "topic", "batch_no", F.md5("prompt").alias("prompt_md5"),
            F.md5(P.instruction_wrap("prompt")).alias("wrapped_md5")))


def _topic_block_sql():
    head, tail = P.TOPIC_PROMPT_ITEM.split("{}")
    return (f"SELECT election, string_agg(concat({S.lit(head)}, lower(topic), {S.lit(tail)}), "
            f"{S.lit(P.TOPIC_PROMPT_ITEM_SEP)} ORDER BY topic_ix) AS block FROM fx_statements GROUP BY election")


def _topic_prompt_sql(block: str, text: str) -> str:
    post = f"replace(replace(replace({text}, '\"', ''), '[', ''), ']', '')"
    return (f"concat({S.lit(P.TOPIC_PROMPT_HEAD)}, {block}, {S.lit(P.TOPIC_PROMPT_MIDDLE)}, {post}, "
            f"{S.lit(P.TOPIC_PROMPT_TAIL)})")


_P2E = (f"SELECT tweet_id, user_screen_name AS party, election, tweet FROM "
        f"(SELECT tweet_id, user_screen_name, election, {S.clean_p2('tweet', emoji=True)} AS tweet FROM fx_tweets) "
        f"WHERE tweet <> ''")


def _topic_prompts(spark, sf):
    st = view(spark, sf, "fx_statements")
    blocks = (st.groupBy("election")
              .agg(F.array_sort(F.collect_list(F.struct("topic_ix", "topic"))).alias("s"))
              .select("election", P.topic_list_block(F.transform("s", lambda x: x["topic"])).alias("block")))
    tw = _p2_tweets(spark, sf, emoji=True).select("tweet_id", F.col("user_screen_name").alias("party"),
                                                  "election", "tweet")
    return tw.join(small(blocks), "election").withColumn("prompt", P.topic_prompt(F.col("block"), F.col("tweet")))


@query("h27_topic_prompt", with_views(f"""
SELECT t.tweet_id, md5({_topic_prompt_sql('b.block', 't.tweet')}) AS prompt_md5,
  CAST(length({_topic_prompt_sql('b.block', 't.tweet')}) AS INTEGER) AS prompt_chars
FROM ({_P2E}) t JOIN ({_topic_block_sql()}) b ON b.election = t.election
""", "fx_tweets", "fx_statements"))
def h27_topic_prompt(spark, sf):
    """Topic-filtering prompt per post (P2 + emoji cleaning, topics of its election)."""
    p = _topic_prompts(spark, sf)
    return p.select("tweet_id", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").cast("int").alias("prompt_chars"))


@query("h29_statement_block", with_views(f"""
SELECT election, md5(concat({S.lit(P.STATEMENTS_OPEN)},
  string_agg(concat('{{"id":', CAST(rn - 1 AS VARCHAR), ',"statement":"', sentence, '"}}'), ',' ORDER BY rn), ']'))
  AS block_md5, CAST(count(*) AS INTEGER) AS num_statements
FROM (SELECT election, sentence, row_number() OVER (PARTITION BY election ORDER BY topic_ix) AS rn FROM fx_statements)
GROUP BY election
""", "fx_statements"))
def h29_statement_block(spark, sf):
    """The statement list block of each election, in list order."""
    st = view(spark, sf, "fx_statements")
    g = st.groupBy("election").agg(F.array_sort(F.collect_list(F.struct("topic_ix", "sentence"))).alias("s"))
    blk = P.statement_block(F.transform("s", lambda x: x["sentence"]))
    return g.select("election", F.md5(blk).alias("block_md5"), F.size("s").cast("int").alias("num_statements"))


# ------------------------------------------------------------ replies ------

def _sql_alt(words):
    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


def _topics_sql():
    r = "reply"
    r = S.rx(r, r' ? // ?implied by "[^\n]*?" ?\n?')
    r = S.rx(r, r' ? // [^\n]*? implies "[^\n]*?" ?\n?')
    r = f"replace(replace({r}, chr(10), ' '), 'centers', 'centres')"
    first = f"regexp_extract({r}, {S.lit(r'\[[^\n]*?\]')}, 0)"
    return f"regexp_replace({first}, {S.lit(r',\s*\]$')}, ']')"


@query("i7_topics_from_reply", with_views(f"""
WITH l AS (SELECT reply_id, {_topics_sql()} AS t FROM fx_topic_replies),
p AS (SELECT reply_id, CASE WHEN t = '' THEN CAST([] AS VARCHAR[])
        WHEN json_valid(t) THEN from_json(t, '["VARCHAR"]')
        WHEN json_valid(replace(t, chr(39), '"')) THEN from_json(replace(t, chr(39), '"'), '["VARCHAR"]')
        ELSE CAST([] AS VARCHAR[]) END AS arr FROM l),
e AS (SELECT reply_id, unnest(arr) AS t FROM p),
k AS (SELECT DISTINCT topic, lower(topic) AS t FROM fx_statements)
SELECT e.reply_id, k.topic FROM e JOIN k ON k.t = e.t
""", "fx_topic_replies", "fx_statements"))
def i7_topics_from_reply(spark, sf):
    """I4-I7 + C8: topics listed by each topic-filtering reply that the
    statement list knows (lower-cased match, duplicates kept)."""
    r = view(spark, sf, "fx_topic_replies").select("reply_id", F.explode(topics_from_reply("reply")).alias("t"))
    known = small(view(spark, sf, "fx_statements").select("topic", F.lower("topic").alias("t")).distinct())
    return r.join(known, "t").select("reply_id", "topic")


def _stance_sql(variant: str) -> str:
    def canon(x):
        parts = [f"WHEN {x} IN ({', '.join(S.lit(w) for w in NEUTRAL_WORDS)}) THEN {S.lit(NEUTRAL)}"]
        parts += [f"WHEN {x} = {S.lit(k)} THEN {S.lit(v)}" for k, v in CANONICAL_OF.items()]
        return "CASE " + " ".join(parts) + f" ELSE {x} END"

    if variant == "A":
        js = f"regexp_extract(reply, {S.lit('\"stance\": \"(' + _sql_alt(STANCE_WORDS_A) + ')\"')}, 1)"
        js_word = canon("js")
        fb = (f"regexp_extract(reply, {S.lit(_sql_alt(FALLBACK_LEAD_A) + ' ([^' + chr(10) + ']*?) ' + chr(39) + '?\"?(' + _sql_alt(FALLBACK_WORDS) + ')' + chr(39) + '?\"?')}, 2)")
        phrases, overrides = ALLOWED_PHRASES_A, OVERRIDES_A
    else:
        js = f"regexp_extract(reply, {S.lit('\"stance\": \"(' + _sql_alt(STANCE_WORDS_B) + '|[^' + chr(10) + ']+)\"')}, 1)"
        js_word = f"CASE WHEN js IN ({', '.join(S.lit(w) for w in STANCE_TO_INT)}) THEN js ELSE {S.lit(NEUTRAL)} END"
        fb = (f"regexp_extract(reply, {S.lit('(' + _sql_alt(FALLBACK_LEAD_B) + '), ([^' + chr(10) + ']*?) ' + chr(39) + '?\"?(' + _sql_alt(FALLBACK_WORDS) + ')' + chr(39) + '?\"?')}, 3)")
        phrases, overrides = ALLOWED_PHRASES_B, OVERRIDES_B
    hit = " OR ".join(f"contains(reply, {S.lit(p)})" for p in phrases)
    over = " ".join(f"WHEN contains(reply, {S.lit(p)}) THEN {S.lit(w)}" for p, w in overrides)
    fallback = f"CASE {over} WHEN fb <> '' THEN {canon('fb')} ELSE {S.lit(NEUTRAL)} END"
    word = f"CASE WHEN js <> '' THEN {js_word} WHEN fb <> '' OR {hit} THEN {fallback} END"
    to_int = "CASE " + " ".join(f"WHEN w = {S.lit(k)} THEN {v}" for k, v in STANCE_TO_INT.items()) + " END"
    status = (f"CASE WHEN js <> '' THEN 'json' WHEN fb <> '' THEN 'fallback' WHEN {hit} THEN 'phrase' "
              f"ELSE 'unparsed' END")
    return with_views(f"""
SELECT reply_id, CAST({to_int} AS INTEGER) AS stance, parse_status FROM (
  SELECT reply_id, {word} AS w, {status} AS parse_status FROM (
    SELECT reply_id, reply, {js} AS js, {fb} AS fb FROM fx_stance_replies))
""", "fx_stance_replies")


for _v, _name in (("A", "i8_stance_a"), ("B", "i9_stance_b")):
    query(_name, _stance_sql(_v))(
        lambda spark, sf, _var=_v: view(spark, sf, "fx_stance_replies")
        .select("reply_id", stance_from_reply(F.col("reply"), _var).alias("p"))
        .select("reply_id", "p.stance", "p.parse_status"))


# ------------------------------------------------------- model round trips --

_CANON = list(STANCE_TO_INT)          # canonical stance words in scale order


def _words(num_labels: int):
    return _CANON if num_labels == 5 else ["disagree", NEUTRAL, "agree"]


def rule_stance_completer_for(num_labels: int = 5):
    """Deterministic stand-in for a stance model: the answer depends only on
    the prompt length (every 7th is a refused call, every 11th a phrase that
    variant A reads as disagree and variant B as neutral)."""
    words = _words(num_labels)

    def complete(prompts):
        out = []
        for p in prompts:
            n = len(p)
            word = "indirectly disagree" if n % 11 == 0 else words[n % len(words)]
            out.append("Bad Request" if n % 7 == 0 else '{"stance": "%s", "statement": "s"}' % word)
        return out
    return complete


rule_stance_completer = rule_stance_completer_for(5)


def rule_topic_completer(prompts):
    """Deterministic stand-in for a topic-filtering model: picks the first
    and last listed topics (plus an unknown one) by prompt length."""
    out = []
    for p in prompts:
        block = p.split("`\"topics\"`: [\n", 1)[1].split("\n]\n", 1)[0]
        topics = re.findall(r'^    "(.*)"', block, flags=re.M)
        n = len(p)
        if n % 3 == 0 or not topics:
            out.append("Bad Request")
        elif n % 3 == 1:
            out.append('{"text": "x", "selected_topics": ["%s"]}' % topics[0])
        else:
            out.append('{"selected_topics": ["%s", "%s", "not a topic"]}' % (topics[0], topics[-1]))
    return out


def _grid(spark, sf):
    st = small(view(spark, sf, "fx_statements").select("election", "topic"))
    return (view(spark, sf, "fx_tweets").select("election", F.col("user_screen_name").alias("party"))
            .distinct().join(st, "election"))


# Which posts a stance model reads: those a score filter keeps, or those a topic model picked.
SCORE_THRESHOLD = 0.6
_SCORE_PAIRS = f"SELECT election, screen_name AS party, topic, tweet_id FROM fx_scores WHERE score_topic >= {S.dbl(SCORE_THRESHOLD)}"


def score_pairs(spark, sf):
    """Q3: posts whose topic score reaches the threshold."""
    kept = topics.topic_filter(view(spark, sf, "fx_scores"), SCORE_THRESHOLD)
    return kept.select("election", F.col("screen_name").alias("party"), "topic", "tweet_id")


def j7_body(num_labels: int = 5, variant: str = "B", pairs: str = "fx_model_filtered") -> str:
    """DuckDB body (fixture views outside) of the model stance job: every post of every group is read."""
    prompt = _stance_prompt_sql("posts_joined", "sentence", num_labels)
    words = _words(num_labels)
    ints = ", ".join(str(STANCE_TO_INT[w]) for w in words)
    return f"""
SELECT g.election, g.party, g.topic, coalesce(r.num_posts, 0) AS num_posts,
  CASE WHEN r.num_posts IS NULL THEN 3 ELSE r.stance END AS stance,
  CASE WHEN r.num_posts IS NULL THEN 'no_posts' WHEN r.stance IS NULL THEN 'unparsed' ELSE 'json' END AS parse_status
FROM (SELECT DISTINCT t.election, t.user_screen_name AS party, s.topic FROM fx_tweets t JOIN fx_statements s ON s.election = t.election) g
LEFT JOIN (SELECT election, party, topic, CAST(sum(num_posts) AS INTEGER) AS num_posts,
             CAST(round_even(sum(s * num_posts) / sum(CASE WHEN s IS NOT NULL THEN num_posts END), 0) AS INTEGER) AS stance
           FROM (SELECT *, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 11 = 0 THEN {2 if variant == 'A' else 3}
                             ELSE [{ints}][n % {len(words)} + 1] END AS s
                 FROM (SELECT *, length({prompt}) AS n FROM ({_joined_sql(num_labels, pairs)})))
           GROUP BY election, party, topic) r
  ON r.election = g.election AND r.party = g.party AND r.topic = g.topic
"""


def stance_posts(spark, sf):
    """The posts that a stance model reads."""
    return _p2_tweets(spark, sf).select("tweet_id", "tweet", "created_at")


def model_posts(spark, sf):
    """The posts as both models read them, cleaned and counted once: ``tweet`` (P2), and ``bare`` where emoji make a difference."""
    posts = T.clean_p2_twice(view(spark, sf, "fx_tweets"))
    return ms.sized_posts(posts.select("election", F.col("user_screen_name").alias("party"), "tweet_id", "created_at", "tweet", "bare"))


def model_stance_table(spark, sf, num_labels: int = 5, variant: str = "B", filtered=None, ledger=None, posts=None):
    posts = stance_posts(spark, sf) if posts is None else posts
    filtered = view(spark, sf, "fx_model_filtered") if filtered is None else filtered
    out = ms.model_stance(filtered, posts, view(spark, sf, "fx_statements"),
                          _grid(spark, sf), rule_stance_completer_for(num_labels), num_labels=num_labels,
                          variant=variant, limit=LIMIT, ledger=ledger)
    return out.select("election", "party", "topic", F.col("num_posts").cast("int"), "stance", "parse_status")


@query("j7_model_stance", with_views(j7_body(5, "B", _SCORE_PAIRS), *_V, "fx_scores"))
def j7_model_stance(spark, sf):
    """J7, variant B: score-filtered posts -> prompts that fit -> stance model (once a distinct
    prompt) -> reply parsing -> stance per (party, statement); pairs without posts are neutral."""
    return model_stance_table(spark, sf, 5, "B", score_pairs(spark, sf))


def j6_body() -> str:
    prompt = _topic_prompt_sql("b.block", "t.tweet")
    return f"""
WITH b AS ({_topic_block_sql()}),
ends AS (SELECT election, arg_min(topic, topic_ix) AS first_t, arg_max(topic, topic_ix) AS last_t
         FROM fx_statements GROUP BY election),
p AS (SELECT t.election, t.party, t.tweet_id, length({prompt}) % 3 AS m FROM ({_P2E}) t
      JOIN b ON b.election = t.election),
picked AS (SELECT p.election, p.party, p.tweet_id, lower(e.first_t) AS t FROM p JOIN ends e ON e.election = p.election
           WHERE p.m IN (1, 2)
           UNION ALL
           SELECT p.election, p.party, p.tweet_id, lower(e.last_t) FROM p JOIN ends e ON e.election = p.election
           WHERE p.m = 2)
SELECT k.election, picked.party, k.topic, picked.tweet_id FROM picked
JOIN fx_statements k ON k.election = picked.election AND lower(k.topic) = picked.t
"""


@query("j6_model_topics", with_views(j6_body(), "fx_tweets", "fx_statements"))
def j6_model_topics(spark, sf, posts=None):
    """Topic prompt per post -> model (distinct prompts) -> reply parsing
    -> topics the statement list knows (C8).  ``posts`` may be those of ``model_posts``."""
    if posts is None:
        posts = _p2_tweets(spark, sf, emoji=True).withColumnRenamed("user_screen_name", "party")
    else:
        posts = posts.withColumn("tweet", F.coalesce("bare", "tweet")).filter(F.col("tweet") != "")             # C5
    return ms.model_topics(posts.select("election", "party", "tweet_id", "tweet"), view(spark, sf, "fx_statements"), rule_topic_completer)


@query("j7_model_stance_a", with_views(j7_body(5, "A", j6_body()), "fx_tweets", "fx_statements"))
def j7_model_stance_a(spark, sf):
    """J6 into J7, variant A: the posts a topic model picked -> stance model -> stance per (party, statement)."""
    posts = model_posts(spark, sf)
    return model_stance_table(spark, sf, 5, "A", j6_model_topics(spark, sf, posts), posts=posts)


@query("g2_replies", with_views(f"""
SELECT md5(p) AS prompt_md5, CASE WHEN length(p) % 3 = 0 THEN 1 ELSE 0 END AS refused, CAST(1 AS BIGINT) AS asked,
  max(CASE WHEN early THEN 1 ELSE 0 END) AS first_run
FROM (SELECT {_topic_prompt_sql('b.block', 't.tweet')} AS p, CAST(t.tweet_id AS BIGINT) % 2 = 0 AS early
      FROM ({_P2E}) t JOIN ({_topic_block_sql()}) b ON b.election = t.election)
GROUP BY p
""", "fx_tweets", "fx_statements"))
def g2_replies(spark, sf):
    """Replies of the topic model in a ledger; a first run over the posts with an even id, then one over
    all posts, which asks only for prompts without a reply: every prompt was asked once."""
    ledger = ms.replies_ledger(spark)
    posts = _p2_tweets(spark, sf, emoji=True).select("election", F.col("user_screen_name").alias("party"), "tweet_id", "tweet")
    statements = view(spark, sf, "fx_statements")
    ms.model_topics(posts.filter(F.col("tweet_id").cast("long") % 2 == 0), statements, rule_topic_completer, ledger=ledger)
    first = [r.batch for r in ledger.batches().select("batch").collect()]       # a row a batch
    ms.model_topics(posts, statements, rule_topic_completer, ledger=ledger)
    return (ledger.rows().groupBy("prompt_md5")
            .agg(F.max((F.col("reply") == "Bad Request").cast("int")).alias("refused"), F.count(F.lit(1)).alias("asked"),
                 F.max(F.col("batch").isin(*first).cast("int")).alias("first_run")))


@query("e17_call_stats", with_views(f"""
SELECT CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (WHERE length(p) % 3 = 0) AS BIGINT) AS refused
FROM (SELECT DISTINCT {_topic_prompt_sql('b.block', 't.tweet')} AS p FROM ({_P2E}) t JOIN ({_topic_block_sql()}) b ON b.election = t.election)
""", "fx_tweets", "fx_statements"))
def e17_call_stats(spark, sf):
    """Model calls and refused calls of a topic-filtering run, from its replies ledger."""
    ledger = ms.replies_ledger(spark)
    posts = _p2_tweets(spark, sf, emoji=True).select("election", F.col("user_screen_name").alias("party"), "tweet_id", "tweet")
    ms.model_topics(posts, view(spark, sf, "fx_statements"), rule_topic_completer, ledger=ledger)
    return ms.call_stats(ledger.read()).select("calls", "refused")
