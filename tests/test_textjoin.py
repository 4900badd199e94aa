"""Containment join by rare-token prefixes: equal to all pairs, on few candidates."""

import random

import pytest
from pyspark.sql import functions as F

from stancelake.functions import text as T
from stancelake.operators import textjoin
from stancelake.operators.score import lexical_scorer
from stancelake.plans import q_scoretable
from stancelake.sources.fixtures import view

from conftest import SF_SMALL

POSTS = "election string, tweet_id string, tweet string, score string"
LABELS = "election string, topic string, label_text string, tokens string"


def brute(posts, labels, threshold):
    out = []
    for e, i, text, _ in posts:
        for f, topic, label, _ in labels:
            if e == f and text is not None and label is not None:
                s = lexical_scorer([text], [label])[0][0]
                if s >= threshold:
                    out.append((e, i, topic, round(s, 9)))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.1, 0.5, 2 / 3, 0.9, 1.0])
def test_join_equals_all_pairs(spark, threshold):
    rng = random.Random(7)
    word = lambda: f"w{min(int(rng.expovariate(0.08)), 60)}"  # noqa: E731  a few very common words
    posts = [(f"E{i % 2}", str(i), " ".join(word() for _ in range(rng.randint(0, 25))), "x") for i in range(150)]
    posts += [("E0", "null", None, "x"), ("E0", "empty", "", "x"), ("E1", "marks", "!!! ...", "x"), ("E0", "all", " ".join(f"w{i}" for i in range(61)), "x")]
    labels = [(f"E{i % 2}", f"t{i}", " ".join(word() for _ in range(rng.randint(1, 9))), "x") for i in range(60)]
    labels += [("E0", "never", "zzz yyy", "x"), ("E0", "none", "?!", "x"), ("E0", "null", None, "x"), ("E1", "W0", "W0 w0, W1", "x")]
    got = textjoin.contained_labels(spark.createDataFrame(posts, POSTS), spark.createDataFrame(labels, LABELS), threshold,
                                    ["tweet_id"], ["topic"], on=["election"])
    got = sorted((r.election, r.tweet_id, r.topic, round(r.score, 9)) for r in got.collect())
    assert got == brute(posts, labels, threshold) and got


def test_empty_sides_and_bad_threshold(spark):
    posts, labels = spark.createDataFrame([("E", "1", "a", "x")], POSTS), spark.createDataFrame([("E", "t", "a", "x")], LABELS)
    join = lambda p, la, t=0.5: textjoin.contained_labels(p, la, t, ["tweet_id"], ["topic"], on=["election"])
    assert join(posts, labels).count() == 1
    assert join(posts.limit(0), labels).count() == 0 and join(posts, labels.limit(0)).count() == 0
    with pytest.raises(ValueError):
        join(posts, labels, 0.0)


def test_candidates_are_few(spark):
    """Below a tenth of all pairs of the posts and statements of an election, for the scores that reach 0.5."""
    posts = q_scoretable._posts(spark, "/root/testdata/sf0.01").filter("suffix = ''").select("election", "tweet_id", "tweet")
    labels = view(spark, "/root/testdata/sf0.01", "fx_statements").select("election", "topic", F.col("sentence").alias("label_text"))
    held = textjoin.held_tokens(posts, ["election"], ["tweet_id"], "tweet")
    prefixes = textjoin.label_prefixes(held, labels, 0.5, ["election"], ["topic"], "label_text")
    candidates = textjoin.candidate_pairs(held, prefixes, ["election"], ["tweet_id"], ["topic"]).count()
    pairs = posts.join(labels, "election").count()
    found = textjoin.contained_labels(posts, labels, 0.5, ["tweet_id"], ["topic"], on=["election"]).count()
    assert 0 < found <= candidates < 0.1 * pairs


def test_sweep_keeps_parties_without_a_score(spark):
    out = q_scoretable.e16_sweep_from_text(spark, SF_SMALL)
    zero = out.filter("num_tweets = 0")
    assert zero.count() > 0 and zero.filter("agreement_level <> 3").count() == 0
    assert {r.suffix for r in out.select("suffix").distinct().collect()} == set(q_scoretable.SUFFIXES)


def test_post_keeps_only_tokens_of_its_labels(spark, monkeypatch):
    posts = spark.createDataFrame([("E", "1", "Aa bb aa cc", "x"), ("F", "2", "bb dd", "x"), ("G", "3", "aa", "x"), ("E", "4", None, "x")], POSTS)
    known = spark.createDataFrame([("E", "aa"), ("E", "bb"), ("F", "dd"), ("F", "aa")], "election string, token string")
    held = lambda: {r.tweet_id: sorted(r.tokens or []) for r in textjoin.held_tokens(posts, ["election"], ["tweet_id"], "tweet", known=known).collect()}
    assert held() == {"1": ["aa", "bb"], "2": ["dd"], "3": [], "4": []}
    labels = spark.createDataFrame([("E", "t", "aa bb", "x"), ("F", "t", "dd zz", "x")], LABELS)
    join = lambda: sorted(map(tuple, textjoin.contained_labels(posts, labels, 0.5, ["tweet_id"], ["topic"], on=["election"]).collect()))
    few = join()
    monkeypatch.setattr(textjoin, "KNOWN_MAX_ROWS", 1)      # a vocabulary too large for every task
    assert held()["1"] == ["aa", "bb", "cc"] and join() == few == [("E", "1", "t", 1.0), ("F", "2", "t", 0.5)]


def test_variants_share_a_text_without_marks(spark, monkeypatch):
    """One row for both variants, unless the text holds a tag or emoji, before or after lower case; equal to cleaning each alone."""
    texts = ["plain words one two", "four words and #tag here", "@aa four words here now", "漢字 four words here now", "Ⓐ four words here now",
             "a\u3000\u3000b four words here", "RT @aa: four words here now", "Ⱥ four words here now", None, "too short"]
    tw = spark.createDataFrame([("E", "p", str(i), "u", None, t) for i, t in enumerate(texts)],
                               "election string, user_screen_name string, tweet_id string, user_id string, created_at timestamp, tweet string")
    monkeypatch.setattr(q_scoretable, "view", lambda *_: tw)
    rows = q_scoretable._variants(spark, "").collect()
    assert sorted((r.tweet_id, len(r.suffixes)) for r in rows) == [("0", 2), *((str(i), 1) for i in (1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7))]
    got = sorted((r.suffix, r.tweet_id, r.tweet) for r in q_scoretable._posts(spark, "").collect())
    alone = [(x, r.tweet_id, r.tweet) for x in q_scoretable.SUFFIXES for r in T.clean_posts(tw, "P1", remove_tags_and_emoji=x == "").collect()]
    assert got == sorted(alone)


def test_sweep_writes_few_tokens(spark):
    """What a post keeps hangs on the labels: a post of thousands of other words keeps none of them."""
    posts = spark.createDataFrame([("E", [""], "p", "1", " ".join(f"w{i}" for i in range(5000)) + " aa bb")],
                                  "election string, suffixes array<string>, screen_name string, tweet_id string, tweet string")
    statements = spark.createDataFrame([("E", "t", "aa bb", "aa cc")], "election string, topic string, topic_label string, sentence string")
    held = textjoin.scored_posts(posts, statements, [("DeBERTa", "")], keep=())
    assert [sorted(r.tokens) for r in held.collect()] == [["aa", "bb"]]
    out = textjoin.score_table(held, statements, [("DeBERTa", "")], 0.5, keep=()).collect()
    assert [(r.score_topic, r.score_sentence) for r in out] == [(1.0, 0.5)]
