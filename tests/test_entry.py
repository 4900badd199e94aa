"""Driver contract: entry() runs, every query has a twin, a sample matches DuckDB."""

import duckdb
import pytest

import __spark_entry__ as E
from stancelake.sources.fixtures import BASE_TABLES

from conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "agreement_level" in df.columns


def test_every_query_has_oracle_except_streaming():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def _duck(sql):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def _norm(rows):
    def v(x):
        return f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted("|".join(v(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", ["q2_agreement_sweep", "h_clean_p1", "e12_method_table", "i9_stance_b",
                                  "j2_lexical_scores", "f3_char_batches"])
def test_sample_matches_duckdb(spark, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols, rows = _duck(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(cols)
    order = [sdf.columns.index(c) for c in cols]
    srows = [tuple(r[i] for i in order) for r in sdf.collect()]
    assert _norm(srows) == _norm(rows)
