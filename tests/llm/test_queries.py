"""Queries of the training-data subpackage against their DuckDB twins, and the pipeline stage by stage."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import brute_sets

import corpus_pipeline
from stancelake.llm import kneser_ney, langid
from stancelake.llm.queries import ORACLES, QUERIES
from stancelake.llm.q_quality import TRUSTED

SF = "/root/testdata/sf0.001"


def norm(rows):
    return sorted("|".join(f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(ORACLES[name])
    cols = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in cur.fetchall()]
    out = QUERIES[name](spark, SF)
    assert sorted(out.columns) == cols
    assert norm(tuple(r) for r in out.select(*cols).collect()) == norm(want)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    good = stages["quality"](spark, docs, SF).cache()
    assert good.columns == columns
    assert ids(good) == ids(kneser_ney.classify(docs, labels, TRUSTED).filter("accepted"))
    clean = docs.join(labels.filter(TRUSTED), "doc_id", "left_semi").count()
    assert good.join(labels.filter(TRUSTED), "doc_id", "left_semi").count() >= 0.95 * clean

    told = stages["language"](spark, good, SF).cache()
    assert told.columns == columns and told.count() >= 0.99 * good.count()
    found = langid.identify(good, F.col("lang").isNotNull()).filter("lang_pred <> 'und' and score >= 0.5")
    assert ids(told) == ids(found)

    single = stages["near_duplicates"](spark, told, SF).cache()
    from test_operators import brute_sets
    _, low = brute_sets([(r.doc_id, r.text) for r in told.collect()])
    assert single.columns == columns and ids(single) == sorted(set(low.values()))

    mixed = stages["mixing"](spark, single, SF)
    assert mixed.columns == columns and 0 < mixed.count()
    assert set(ids(mixed)) <= set(ids(single)) and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3

    packed = stages["packing"](spark, mixed, SF).collect()
    assert sum(r.piece == 0 for r in packed) == mixed.count() and all(0 < r.length <= 1024 for r in packed)


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
