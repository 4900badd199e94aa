"""Reply parsing: the expected outcome table of the fixture replies."""

from pyspark.sql import functions as F

from stancelake.functions.replies import stance_from_reply, topics_from_reply
from stancelake.sources.fixtures import view

from conftest import SF_SMALL

# case -> (variant A, variant B); None = unparsed
EXPECTED_STANCE = {0: (5, 5), 1: (2, 2), 2: (3, 3), 3: (2, 3), 4: (4, 3), 5: (None, 3), 6: (4, 4),
                   7: (4, 4), 8: (2, 2), 9: (3, 3), 10: (None, None), 11: (3, 3)}
EXPECTED_TOPICS = {0: ["topic_1", "topic_2"], 1: ["topic_3", "topic_9"], 2: [], 3: [],
                   4: ["topic_4", "not a topic"], 5: ["topic_5", "topic_5"], 6: ["topic_6"], 7: [],
                   8: ["topic_8", "topic_10"]}


def _case(mod):
    parts = F.split("reply_id", "-")
    return (parts[0].cast("int") + parts[1].cast("int")) % mod


def test_stance_variants(spark):
    r = view(spark, SF_SMALL, "fx_stance_replies").withColumn("case", _case(12))
    rows = r.select("case", stance_from_reply(F.col("reply"), "A").alias("a"),
                    stance_from_reply(F.col("reply"), "B").alias("b")).distinct().collect()
    got = {x.case: (x.a.stance, x.b.stance) for x in rows}
    assert got == EXPECTED_STANCE
    status = {x.case: x.a.parse_status for x in rows}
    assert status[10] == "unparsed" and status[6] == "fallback" and status[9] == "phrase"


def test_topics_from_reply(spark):
    t = view(spark, SF_SMALL, "fx_topic_replies").withColumn("case", _case(9))
    got = {x.case: x.t for x in t.select("case", topics_from_reply("reply").alias("t")).distinct().collect()}
    assert got == EXPECTED_TOPICS


def test_python_list_quirks(spark):
    df = spark.createDataFrame([("x ['a', 'b',] y",), ("no list",), ("[1, 2]",), ("[\"centers\"]",)], "r string")
    got = [r[0] for r in df.select(topics_from_reply("r")).collect()]
    assert got[0] == ["a", "b"] and got[1] == [] and got[3] == ["centres"]
