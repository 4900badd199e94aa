"""Work and storage that grow no faster than the input (findings of round 3)."""

import os

from pyspark.sql import functions as F

from stancelake.functions import text as T
from stancelake.operators import model_steps as ms
from stancelake.plans.catalog import QUERIES
from stancelake.session import ensure_checkpoint_dir
from stancelake.sources import fixtures, io

from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_the_fixtures_asked_for_are_derived(spark, tmp_path):
    """Posts are read through, not copied; a score table is written once and alone."""
    folder = str(tmp_path / "sf")
    os.symlink(SF_SMALL, folder)
    shared = ensure_checkpoint_dir(spark)
    before = set(os.listdir(shared))
    assert fixtures.view(spark, folder, "fx_tweets").count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert set(os.listdir(shared)) == before
    assert not fixtures.view(spark, folder, "fx_scores").isEmpty() and not fixtures.view(spark, folder, "fx_scores").isEmpty()
    assert [x.split("-")[0] for x in set(os.listdir(shared)) - before] == ["fx_scores"]


def test_white_space_class_of_the_squeeze(spark):
    """Every code point of the Basic Multilingual Plane, single and doubled, as the class WS has it."""
    ch = F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')")
    texts = spark.range(1, 0x10000).filter("id < 55296 or id > 57343").select(F.concat(F.lit("a"), ch, F.lit("b"), ch, ch, F.lit("c "), ch, F.lit("d")).alias("t"))
    assert texts.filter(T.squeeze_whitespace("t") != F.trim(F.regexp_replace("t", T.WS + "{2,}", " "), F.lit(T.WS_CHARS))).isEmpty()


def test_min_words_cleans_once(spark):
    assert plan(QUERIES["c6_min_words"](spark, SF_SMALL)).count("^RT (@") == 1


def test_resume_cleans_once(spark):
    """The keys are cleaned into a narrow table that both sides of the anti join read."""
    assert "^RT (@" not in plan(QUERIES["k1_resume_anti"](spark, SF_SMALL))


def prompts_left(shared, before, name):
    return [f"{shared}/{d}" for d in set(os.listdir(shared)) - before if d.startswith(name)]


def test_prompts_of_one_slice_at_a_time(spark, monkeypatch):
    """A post stands in the prompts of many statements: they are built and asked a slice at a time, and one slice is stored."""
    posts = spark.createDataFrame([(str(i), f"2019-01-{i + 1:02d}", f"post{i} " * 30) for i in range(20)], "tweet_id string, created_at string, tweet string")
    posts = posts.withColumn("created_at", F.to_timestamp("created_at"))
    topics = spark.range(6).select(F.concat(F.lit("t"), "id").alias("topic"))
    statements = topics.select(F.lit("E").alias("election"), "topic", F.concat(F.lit("we want "), "topic").alias("sentence"))
    grid = topics.select(F.lit("E").alias("election"), F.lit("p").alias("party"), "topic")
    filtered = grid.join(posts.select("tweet_id"), F.lit(True))
    limit = ms.prompt_overhead(statements).first().overhead + 200
    reply = lambda ps: ['{"stance": "agree", "statement": "s"}' if len(p) % 2 else "Bad Request" for p in ps]
    run = lambda: {tuple(r) for r in ms.model_stance(filtered, posts, statements, grid, reply, limit=limit).collect()}
    whole = run()
    monkeypatch.setattr(ms, "SLICE_TOKENS", 1)
    shared = ensure_checkpoint_dir(spark)
    before = set(os.listdir(shared))
    assert run() == whole and len(whole) == 6
    links, = prompts_left(shared, before, "stance-prompt-keys")
    texts, = (x for x in prompts_left(shared, before, "stance-prompts"))
    n, stored = spark.read.parquet(links).count(), spark.read.parquet(texts).count()
    assert n >= 6 and stored < n
    assert not prompts_left(shared, before, "ledger-todo")


def test_batches_for_a_model_are_bounded_in_bytes(spark, tmp_path):
    log = str(tmp_path / "sizes")

    def complete(ps):
        with open(log, "a") as f:
            f.write(f"{sum(map(len, ps))}\n")
        return ["ok"] * len(ps)

    prompts = spark.range(0, 40, 1, 1).select(F.concat(F.repeat(F.lit("x"), 1 << 20), F.col("id").cast("string")).alias("prompt"))
    assert ms.complete_distinct(prompts, complete, batches=1).count() == 40
    sizes = [int(x) for x in open(log)]
    assert sum(sizes) > 40 << 20 and max(sizes) < 12 << 20


def test_balanced_writers_share_a_split(spark, tmp_path):
    """One split of many rows is written by several tasks, none of which sorts it whole."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    df = spark.range(0, 20000, 1, 1).select("id", (F.col("id") % 4).alias("part"), F.md5(F.col("id").cast("string")).alias("x"))
    try:
        spark.conf.set(key, "64k")
        io.write_table(df, str(tmp_path / "t"), ("part",), balanced=True)
    finally:
        spark.conf.set(key, before)
    tasks = {name.split("-")[1] for _, _, names in os.walk(tmp_path / "t") for name in names if name.startswith("part-")}
    assert len(tasks) > 1 and spark.read.parquet(str(tmp_path / "t")).count() == 20000


def test_posts_are_joined_without_a_table_of_ids_in_memory(spark):
    df = QUERIES["d5_filtered_posts_text"](spark, SF_SMALL)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
