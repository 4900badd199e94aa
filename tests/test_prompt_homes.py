"""Prompts as places of texts (findings F1 to F4 of round 4): a text is stored and moved once, however many prompts hold it."""

import os
import random

from pyspark.sql import functions as F

from stancelake.functions import prompts as P
from stancelake.functions import text as T
from stancelake.operators import model_steps as ms
from stancelake.session import ensure_checkpoint_dir
from stancelake.sources.ledger import Ledger


def made(spark, seed=5, n=160, topics=7):
    """Posts of a hot and a small party, some without a time, some long; each in some topics, some twice."""
    rnd = random.Random(seed)
    texts = [(f"{i:04d}", rnd.choice(["hot", "hot", "hot", "cold"]), None if i % 40 == 9 else rnd.randint(0, 30), f"p{i} " + "w " * rnd.choice([1, 5, 20, 60])) for i in range(n)]
    texts = [(i, p, t, x.strip()) for i, p, t, x in texts]
    pairs = [("E", p, f"t{k}", i) for i, p, _, _ in texts for k in range(topics) if rnd.random() < 0.4 for _ in range(2 if rnd.random() < 0.05 else 1)]
    posts = spark.createDataFrame(texts, "tweet_id string, party string, day int, tweet string")
    posts = posts.select("tweet_id", F.expr("timestamp'2019-01-01' + make_interval(0, 0, 0, day)").alias("created_at"), "tweet")
    filtered = spark.createDataFrame(pairs, "election string, party string, topic string, tweet_id string")
    statements = spark.createDataFrame([("E", f"t{k}", "we want " + "it " * k) for k in range(topics)], "election string, topic string, sentence string")
    return texts, pairs, posts, filtered, statements


def brute(texts, pairs, overhead, limit):
    """Every prompt by a loop over its group's posts, newest first."""
    told, out = {i: (t, x) for i, _, t, x in texts}, {}
    tokens = lambda x: len(ms.token_count_py(x)) + 3
    groups = {}
    for _, p, k, i in pairs:
        groups.setdefault((p, k), []).append(i)
    for (p, k), ids in groups.items():
        ids.sort(key=lambda i: (told[i][0] is None, -(told[i][0] or 0), i))
        cost, room, before = [tokens(told[i][1]) for i in ids], limit + 3 - overhead[k], 0
        for i, c in zip(ids, cost):
            batch = 0 if sum(cost) <= room else before // max(room - max(cost), 1)
            out.setdefault((p, k, batch), []).append(told[i][1])
            before += c
    sizes = {g: len(ids) for g, ids in groups.items()}
    return {g: (P.SEPARATOR.join(x), len(x), sizes[g[:2]]) for g, x in out.items()}


def test_prompts_of_any_home_equal_brute_force(spark, monkeypatch):
    texts, pairs, posts, filtered, statements = made(spark)
    overhead = {r.topic: r.overhead for r in ms.prompt_overhead(statements).collect()}
    limit = max(overhead.values()) + 300
    expected = brute(texts, pairs, overhead, limit)
    assert len(expected) > 30 and len({g[:2] for g in expected}) == 14
    for prompts, shares, tokens in ((12, 64, 1 << 24), (1, 2, 1 << 24), (1, 1, 40)):
        monkeypatch.setattr(ms, "HOME_PROMPTS", prompts)
        monkeypatch.setattr(ms, "HOME_TOPICS", shares)
        monkeypatch.setattr(ms, "SLICE_TOKENS", tokens)
        got = {(r.party, r.topic, r.batch_no): (r.posts_joined, r.num_posts, r.group_posts) for r in ms.joined_batches(filtered, posts, statements, limit).collect()}
        assert got == expected


def test_texts_are_stored_once_for_all_their_prompts(spark):
    """What is stored of the prompts has every text about once, and every prompt is asked as it would be built."""
    texts, pairs, posts, filtered, statements = made(spark)
    overhead = {r.topic: r.overhead for r in ms.prompt_overhead(statements).collect()}
    limit = max(overhead.values()) + 300
    sentence = {r.topic: r.sentence for r in statements.collect()}
    a, b, c = P.stance_frame(5)
    expected = sorted({a + x + b + sentence[g[1]] + c for g, (x, _, _) in brute(texts, pairs, overhead, limit).items()})
    grid = filtered.select("election", "party", "topic").distinct()
    shared = ensure_checkpoint_dir(spark)
    before = set(os.listdir(shared))
    ledger = ms.replies_ledger(spark)
    ms.model_stance(filtered, posts, statements, grid, lambda ps: [f'{{"stance": "agree", "x": "{p}"}}' for p in ps], limit=limit, ledger=ledger).collect()
    asked = sorted(r.reply[len('{"stance": "agree", "x": "'):-2] for r in ledger.read().collect())
    assert asked == expected
    stored, = (f"{shared}/{x}" for x in set(os.listdir(shared)) - before if x.startswith("stance-prompts"))
    kept = spark.read.parquet(stored).select(F.explode("texts").alias("x")).agg(F.sum(F.length("x"))).first()[0]
    assert kept < 2 * sum(len(x) for *_, x in texts) < sum(len(x) for x in expected)


def test_posts_cleaned_once_are_as_both_profiles_have_them(spark):
    """Runs of white space around emoji, and the ideographic space, which is of both classes."""
    rnd = random.Random(8)
    parts = ["a", "B", " ", "  ", "\t", "\n", "　", "🙏", "漢", " ", "&gt;", "++", "‍"]
    df = spark.createDataFrame([(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))) for i in range(3000)], "i int, tweet string")
    both = T.clean_p2_twice(df)
    for emoji, got in ((False, both.select("i", "tweet")), (True, both.select("i", F.coalesce("bare", "tweet").alias("tweet")).filter("tweet <> ''"))):
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in T.clean_posts(df, "P2", remove_tags_and_emoji=emoji).collect()}


def test_a_written_table_is_asked_where_it_lies(spark, tmp_path):
    """Of equal keys the first row is worked on, and the texts of a table that is written are not shuffled to find out which."""
    spark.range(200).select(F.concat(F.lit("k"), (F.col("id") % 60).cast("string")).alias("k"), "id", F.repeat(F.lit("x"), 500).alias("text")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    ledger = Ledger(spark, str(tmp_path / "l"), "k string, id long", ["k"])
    plans = []

    def work(part):
        plans.append(part._jdf.queryExecution().optimizedPlan().toString())
        return part.filter(F.length("text") == 500)

    ledger.advance(table.filter("id < 40"), work, batches=3, copy=False, row="id")
    ledger.advance(table, work, batches=3, copy=False, row="id")
    assert {r.k: r.id for r in ledger.read().collect()} == {f"k{i}": i for i in range(60)} and ledger.read().count() == 60
    assert plans and not any("Aggregate" in p or "LeftAnti" in p for p in plans)
