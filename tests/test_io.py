"""Sources and sinks: statement CSV, partitioned topic files, result append."""

import os
import tempfile

from pyspark.sql import functions as F

from stancelake.operators.topics import write_by_topic
from stancelake.sources import io


def test_statements_csv_bom_quotes_trailing_blank(spark):
    d = tempfile.mkdtemp(prefix="stmt-")
    p = os.path.join(d, "s.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write('topic,sentence\n')
        f.write('brexit,"the UK should leave, now"\n')
        f.write('rails services nationalization ,rail should be public\n')
        f.write(',missing topic\n')
    df = io.load_statements_csv(spark, p, election="GB19").orderBy("topic_ix").collect()
    assert [r.topic for r in df] == ["brexit", "rails services nationalization "]
    assert df[0].sentence == "the UK should leave, now"


def test_list_of_many_files_keeps_its_order(spark):
    d = tempfile.mkdtemp(prefix="stmts-")
    st = spark.createDataFrame([(i, f"t{i}", f'say "{i}", twice\nor more ') for i in range(200)], "n long, topic string, sentence string").repartition(9)
    io.write_list_csv(st, d + "/list", "n", files=6)
    assert len([f for f in os.listdir(d + "/list") if f.endswith(".csv")]) == 6
    back = io.load_statements_csv(spark, d + "/list")
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    assert [(r.topic, r.sentence) for r in back.orderBy("topic_ix").collect()] == [(f"t{i}", f'say "{i}", twice\nor more ') for i in range(200)]


def test_topic_partitions_roundtrip_and_append(spark):
    d = tempfile.mkdtemp(prefix="topics-")
    df = spark.createDataFrame([("D3", "E", "p", "t/x", "0012", 0.9, 0.5), ("D3", "E", "p", "t2", "7", 0.8, 0.1)],
                               "dataset string, election string, screen_name string, topic string, tweet_id string, "
                               "score_topic double, score_sentence double")
    write_by_topic(df, d + "/t")
    back = io.load_by_topic(spark, d + "/t")
    assert sorted(r.topic for r in back.collect()) == ["t/x", "t2"]
    assert sorted(r.tweet_id for r in back.collect()) == ["0012", "7"]
    res = spark.createDataFrame([("E", "p", "t", "s", 3)], io.RESULTS_SCHEMA)
    io.append_results(res, d + "/r")
    io.append_results(res, d + "/r")
    assert spark.read.parquet(d + "/r").count() == 2
    assert spark.read.parquet(d + "/r").dropDuplicates().count() == 1


def test_nan_scores_become_null(spark):
    df = spark.createDataFrame([(float("nan"), 0.5)], "score_topic double, score_sentence double")
    r = io.nan_to_null(df, ["score_topic"]).first()
    assert r.score_topic is None and r.score_sentence == 0.5


def test_scores_partition_filter(spark):
    d = tempfile.mkdtemp(prefix="scores-")
    df = spark.createDataFrame([("GB19", "m", "D3", "1", 0.5, float("nan")), ("CA19", "m", "D3", "2", 0.7, 0.1)],
                               "election string, model string, dataset string, tweet_id string, "
                               "score_topic double, score_sentence double")
    io.write_table(df, d + "/s", partition_cols=("election", "model", "dataset"))
    got = io.load_scores(spark, d + "/s", election="GB19", dataset="D3").collect()
    assert len(got) == 1 and got[0].tweet_id == "1" and got[0].score_sentence is None


def test_detect_language_separate_profile(spark):
    from stancelake.operators import translate as TR
    from stancelake.sources.fixtures import table
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    prof = TR.language_profile(docs, "text", "lang")
    pred = TR.detect_language(docs, prof, "doc_id", "text").join(docs.select("doc_id", "lang"), "doc_id")
    n = pred.count()
    hit = pred.filter(F.col("predicted_lang") == F.col("lang")).count()
    assert n == docs.count() and hit / n > 0.95
