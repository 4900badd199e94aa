"""Windows and model round trips: prefix sums, budget, batching, resume."""

import random

from pyspark.sql import functions as F

from stancelake.operators import model_steps as ms
from stancelake.streaming.incremental import resume_todo


def test_running_sum_skewed_group(spark):
    rnd = random.Random(3)
    # one party holds most rows (hot key), others are small
    rows = [("hot" if rnd.random() < 0.7 else f"p{rnd.randint(0, 5)}", i, rnd.randint(1, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "party string, t long, v long")
    got = {(r.party, r.t): r.before for r in ms.running_sum(df, ["party"], ["t"], "v", "before").collect()}
    acc = {}
    for p, t, v in sorted(rows, key=lambda x: (x[0], x[1])):
        assert got[(p, t)] == acc.get(p, 0)
        acc[p] = acc.get(p, 0) + v


def test_char_batches_lossless(spark):
    rows = [("E", "p", f"2019-01-{d:02d} 00:00:00", str(d), "x" * 3000) for d in range(1, 21)]
    df = spark.createDataFrame(rows, "election string, party string, created_at string, tweet_id string, tweet string")
    df = df.withColumn("created_at", F.to_timestamp("created_at"))
    b = {r.tweet_id: r.batch_no for r in ms.char_batches(df).collect()}
    assert len(b) == 20                                   # nothing lost
    assert b["1"] == 0 and b["4"] == 0 and b["5"] == 1    # 4 * 3003 = 12012 chars before post 5


def test_token_budget_prefix(spark):
    rows = [("E", "p", "t", str(i), f"2019-01-{i + 1:02d} 00:00:00", "w " * 10) for i in range(10)]
    df = spark.createDataFrame(rows, "election string, party string, topic string, tweet_id string, "
                                     "created_at string, tweet string")
    df = df.withColumn("created_at", F.to_timestamp("created_at"))
    kept = ms.token_budget(df, 40, F.lit(0)).collect()
    # each post: 10 tokens + 3 separator tokens; 3 posts = 36 tokens
    assert sorted(r.tweet_id for r in kept) == ["7", "8", "9"]


def test_model_stance_reads_every_post(spark):
    posts = spark.createDataFrame([(str(i), f"2019-01-{i + 1:02d}", f"post{i} " * 40) for i in range(20)] +
                                  [("big", "2019-02-01", " ".join(f"word{i}" for i in range(1000))), ("one", "2019-02-02", "hello")],
                                  "tweet_id string, created_at string, tweet string").withColumn("created_at", F.to_timestamp("created_at"))
    party = lambda i: "a" if len(i) < 3 else i
    filtered = spark.createDataFrame([("E", party(r.tweet_id), "t", r.tweet_id) for r in posts.collect()],
                                     "election string, party string, topic string, tweet_id string")
    statements = spark.createDataFrame([("E", "t", "we want it")], "election string, topic string, sentence string")
    grid = spark.createDataFrame([("E", p, "t") for p in ("a", "big", "one", "none")], "election string, party string, topic string")
    overhead = ms.prompt_overhead(statements).first().overhead
    limit = overhead + 200
    seen = spark.sparkContext.accumulator(0)

    def complete(prompts):
        for p in prompts:
            assert len(ms.token_count_py(p)) <= limit
            seen.add(sum(f"post{i} " in p for i in range(20)) + 1000 * sum(f"word{i} " in p + " " for i in (0, 500, 998)))
        return ['{"stance": "agree", "statement": "s"}'] * len(prompts)

    got = {r.party: r for r in ms.model_stance(filtered, posts, statements, grid, complete, limit=limit).collect()}
    assert seen.value == 3020
    assert {p: r.num_posts for p, r in got.items()} == {"a": 20, "big": 1, "one": 1, "none": 0}
    assert {p: r.parse_status for p, r in got.items()} == {"a": "json", "big": "json", "one": "json", "none": "no_posts"}
    assert got["a"].stance == got["big"].stance == got["one"].stance != 3


def test_complete_distinct_skips_done(spark):
    calls = []

    def complete(prompts):
        calls.extend(prompts)
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("b",), ("a",)], "prompt string")
    first = ms.complete_distinct(df, complete).cache()
    assert first.count() == 2
    again = ms.complete_distinct(df, lambda ps: ["x"] * len(ps), done=first)
    assert sorted(r.reply for r in again.collect()) == ["A", "B"]


def test_resume_run_twice_equals_once(spark):
    inp = spark.createDataFrame([(str(i),) for i in range(10)], "tweet_id string")
    done = inp.filter(F.col("tweet_id") < "5")
    todo = resume_todo(inp, done)
    assert todo.count() == 5
    assert resume_todo(inp, done.unionByName(todo)).count() == 0


def test_translate_statuses_and_memory(spark, tmp_path):
    from stancelake.operators import translate as TR
    log = tmp_path / "asked"

    def translator(texts, lang):
        with open(log, "a") as f:
            f.writelines(f"{t[:20]}\n" for t in texts)
        if any("boom" in t for t in texts):
            raise RuntimeError("HTTP 429 too many requests")
        return [f" <{lang}>{t} " for t in texts]

    long = ". ".join(f"phrase numero {i} du texte" for i in range(400)) + ". " + "y" * 12_000
    posts = spark.createDataFrame(
        [("1", "en", "hello"), ("2", "fr", "bonjour"), ("3", "fr", long), ("4", "de", ""), ("5", "es", "boom"), ("6", "fr", "salut"),
         ("7", "fr", "bonjour"), ("8", "fr", None), ("9", "es", "boom! " * 900 + "fin"), ("10", None, "quoi")], "tweet_id string, lang string, tweet string")
    memory = TR.translation_memory(spark, str(tmp_path / "memory"))
    TR.remember(memory, spark.createDataFrame([("fr", "salut", "hi")], "lang string, text string, translation string"))
    out, _ = TR.translate(posts, translator, memory, retries=1)
    got = {r.tweet_id: (r.tweet, r.translation_status, r.original_tweet) for r in out.collect()}
    assert got["1"][:2] == ("hello", "copied")
    assert got["2"][:2] == got["7"][:2] == ("<fr>bonjour", "ok")
    assert got["4"][:2] == ("", "empty") and got["8"][:2] == ("", "empty")
    assert got["5"][:2] == got["9"][:2] == (None, "rate_limited")
    assert got["6"][:2] == ("hi", "memory") and got["10"][1] == "ok"
    # the long text: every sentence once, in its order, and the last one in slices the service takes
    parts = got["3"][0].split("<fr>")[1:]
    assert got["3"][1] == "ok" and got["3"][2] == long
    assert [x.strip() for x in parts[:400]] == [f"phrase numero {i} du texte." for i in range(400)]
    assert [len(x.strip()) for x in parts[400:]] == [4999, 4999, 2002]
    assert open(log).read().split("\n").count("bonjour") == 1
    # a second run asks for what failed, and for nothing else
    open(log, "w").close()
    again, _ = TR.translate(posts, translator, memory, retries=0)
    assert {r.tweet_id: r.translation_status for r in again.collect()} == {k: "memory" if v[1] == "ok" else v[1] for k, v in got.items()}
    asked = open(log).read().split()
    assert asked and all(x.startswith("boom") for x in asked)


def test_nearest_prototype(spark):
    from stancelake.operators import score as SC
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 1, [0.0, 1.0]), (4, 1, [0.2, 0.8])],
                              "vec_id int, label int, embedding array<double>")
    best = {r.vec_id: r.pred_label for r in SC.nearest_prototype(v, SC.prototypes(v)).collect()}
    assert best == {1: 0, 2: 0, 3: 1, 4: 1}


def test_call_stats(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "prompt string")
    rep = ms.complete_distinct(df, lambda ps: ["Bad Request" if p == "a" else "ok" for p in ps])
    st = ms.call_stats(rep).first()
    assert st.calls == 3 and st.refused == 1 and st.avg_seconds >= 0


def test_detect_language_keeps_every_document(spark, tmp_path):
    from stancelake.plans.catalog import QUERIES
    rows = [(1, "the house and the garden", "en"), (2, "das haus und der garten", "de"), (3, "das alte haus und der garten", "de"), (4, "hi", "en"),
            (5, None, "de"), (6, "the old garden", None), (7, "untold", None), (8, "\u4e00\u4e01\u4e02", "zh")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.predicted_lang, r.predicted_name, r.held_out) for r in QUERIES["j5_detect_language"](spark, str(tmp_path)).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4, 5, 6, 8)} == {
        1: ("en", "english", False), 2: ("de", "german", True), 3: ("de", "german", False), 4: ("none", "auto", True),
        5: ("none", "auto", False), 6: ("en", "english", True), 8: ("none", "auto", True)}
    assert len(got) == 8


def test_detect_language_without_training(spark):
    from stancelake.operators import translate as TR
    docs = spark.createDataFrame([(1, "the house", None)], "doc_id long, text string, lang string")
    got = TR.detect_language(docs, TR.language_profile(docs)).collect()
    assert [(r.doc_id, r.predicted_lang) for r in got] == [(1, "none")]


def brute_budget(rows, limit, overhead, sep):
    out, spent, groups = {}, {}, {}
    for g, i, t, n in rows:
        groups.setdefault(g, {})[i] = (t, n)
    for g, posts in groups.items():
        total = overhead - sep
        for i, (t, n) in sorted(posts.items(), key=lambda x: (-x[1][0] if x[1][0] is not None else 10**12, x[0])):
            total += (n or 0) + sep
            if total > limit:
                break
            out[g, i] = total
    return out


def test_token_budget_of_a_hot_group(spark):
    """Equal to brute force with ties in time at the edge, a free separator, free posts and null times."""
    rnd = random.Random(4)
    for sep, limit, span in ((3, 900, 40), (0, 700, 3), (0, 50, 10**6), (3, 10**6, 50)):
        rows = [("hot" if rnd.random() < 0.7 else f"g{rnd.randint(0, 3)}", f"{k:05d}", None if k % 50 == 7 else rnd.randint(0, span), rnd.choice([0, 1, 5, None])) for k in range(2500)]
        rows += rows[:5]
        df = spark.createDataFrame(rows, "party string, tweet_id string, t long, n long").withColumn("created_at", F.timestamp_seconds(F.col("t") + 1_500_000_000))
        got = ms.token_budget(df, limit, F.lit(20), ["party"], token_col="n", separator_cost=sep)
        assert got.columns == [*df.columns, "prompt_tokens"]
        assert {(r.party, r.tweet_id): r.prompt_tokens for r in got.collect()} == brute_budget(rows, limit, 20, sep)


def test_replies_survive_a_killed_run(spark, tmp_path):
    """A model that dies half-way: started again, finished prompts are not asked, and the rows are those of one run."""
    ledger = ms.replies_ledger(spark, str(tmp_path / "replies"))
    log = tmp_path / "asked"
    prompts = spark.createDataFrame([(f"prompt {i % 30}",) for i in range(90)] + [(None,)], "prompt string")

    def complete(deadly):
        def run(ps):
            with open(log, "a") as f:
                f.writelines(f"{p}\n" for p in ps)
            if deadly and "prompt 3" in ps:
                raise RuntimeError("killed")
            return [p.upper() for p in ps]
        return run

    try:
        ms.complete_distinct(prompts, complete(True), ledger=ledger, batches=6)
        raise AssertionError("the run should have died")
    except Exception as e:  # noqa: BLE001
        assert "killed" in str(e)
    done = {r.reply.lower() for r in ledger.read().collect()}
    assert 0 < len(done) < 30
    open(log, "w").close()
    out = ms.complete_distinct(prompts, complete(False), ledger=ledger, batches=6)
    asked = open(log).read().split("\n")[:-1]
    assert sorted(asked) == sorted({f"prompt {i}" for i in range(30)} - done)
    assert sorted(r.reply for r in out.collect()) == sorted(f"PROMPT {i}" for i in range(30))
    open(log, "w").close()
    assert ms.complete_distinct(prompts, complete(False), ledger=ledger).count() == 30 and open(log).read() == ""


def test_posts_without_text_make_no_prompt(spark):
    posts = spark.createDataFrame([("1", "2019-01-01", None), ("2", "2019-01-02", "yes")], "tweet_id string, created_at string, tweet string").withColumn("created_at", F.to_timestamp("created_at"))
    filtered = spark.createDataFrame([("E", "p", "t", "1"), ("E", "p", "t", "2"), ("E", "q", "t", "1")], "election string, party string, topic string, tweet_id string")
    statements = spark.createDataFrame([("E", "t", "we want it")], "election string, topic string, sentence string")
    got = {r.party: r for r in ms.joined_batches(filtered, posts, statements).collect()}
    assert set(got) == {"p"} and got["p"].posts_joined == "yes" and got["p"].num_posts == 1
