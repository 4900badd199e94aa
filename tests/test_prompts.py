"""Prompt text, statement block, wrappers and small lookups on tiny inputs."""

from pyspark.sql import functions as F

from stancelake.functions import prompts as P
from stancelake.operators import topics
from stancelake.operators.translate import language_name


def test_topic_prompt_layout(spark):
    df = spark.createDataFrame([(["Brexit", "NHS"], 'say "no" to [x]')], "t array<string>, post string")
    got = df.select(P.topic_prompt(P.topic_list_block(F.col("t")), F.col("post"))).first()[0]
    assert got.startswith("Write again the topics I'm providing you:\n\n`\"topics\"`: [\n    \"brexit\",\n    \"nhs\"\n]\n")
    assert "\nThen, write the last topic in the list.\n\n" in got
    assert got.endswith('```\n"text_to_analyze": "say no to x"\n```\n')


def test_stance_prompt_five_and_three(spark):
    df = spark.createDataFrame([("a~|~b", "We should act")], "posts string, s string")
    five = df.select(P.stance_prompt(F.col("posts"), F.col("s"), 5)).first()[0]
    three = df.select(P.stance_prompt(F.col("posts"), F.col("s"), 3)).first()[0]
    assert "=== TWEETS BEGIN ===\na~|~b\n=== TWEETS END ===\n\n" in five
    assert 'in response to the statement "We should act" leveraging' in five
    assert "only these five values: 'completely disagree', 'disagree'," in five
    assert "only these three values: 'disagree', 'neither disagree nor agree', and 'agree'." in three
    assert five.endswith("Do not use any external information to draw your conclusions.\n")
    wrapped = df.select(P.instruction_wrap(P.stance_prompt(F.col("posts"), F.col("s"), 5))).first()[0]
    assert wrapped.startswith("[INST] Tweets by") and wrapped.endswith(" [/INST]")


def test_statement_block_and_translation_join(spark):
    df = spark.createDataFrame([(["first", "sec \"q\""], [" a. ", "b　", "c"])], "s array<string>, parts array<string>")
    r = df.select(P.statement_block(F.col("s")).alias("b"), P.translation_join(F.col("parts")).alias("j")).first()
    assert r.b == '\n\nstatements: [{"id":0,"statement":"first"},{"id":1,"statement":"sec "q""}]'
    assert r.j == "a. b c"


def test_language_names(spark):
    df = spark.createDataFrame([("fr",), ("xx",), ("zh-cn",)], "c string")
    assert [r[0] for r in df.select(language_name("c")).collect()] == ["french", "auto", "chinese (simplified)"]


def test_dataset_windows_nested(spark):
    posts = spark.createDataFrame([("1", "E", "2019-07-01 00:00:00"), ("2", "E", "2019-03-15 00:00:00"),
                                   ("3", "E", "2019-01-05 00:00:00"), ("4", "E", "2019-07-30 00:00:00")],
                                  "tweet_id string, election string, created_at string") \
        .withColumn("created_at", F.to_timestamp("created_at"))
    cal = spark.createDataFrame([("E", "2019-07-30 00:00:00")], "election string, election_ts string") \
        .withColumn("election_ts", F.to_timestamp("election_ts"))
    got = {}
    for r in topics.dataset_windows(posts, cal).collect():
        got.setdefault(r.tweet_id, set()).add(r.dataset)
    assert got["1"] == {"D3", "D4", "D5", "D7"}
    assert got["2"] == {"D5", "D7"}
    assert got["3"] == {"D7"}
    assert "4" not in got            # election day itself is outside every window
