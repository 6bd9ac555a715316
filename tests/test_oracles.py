"""Every registered query with an oracle must equal it at sf0.01."""

import pytest

import __spark_entry__ as E
from scripts.check_oracles import digest
from tests.conftest import SF01

NAMES = sorted(set(E.oracle_sql()) - set(E.LLM_ORACLES))  # tests/llm covers the others


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(rows, df.columns) == digest(orows, ocols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["title", "rank", "next_title", "n", "prob"]


def test_every_query_has_oracle_or_is_listed_rows_only():
    rows_only = set(E.queries()) - set(E.oracle_sql()) - set(E.LLM_QUERIES)
    from jobtrails.plans.catalog import ROWS_ONLY
    assert rows_only == set(ROWS_ONLY)
