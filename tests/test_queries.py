"""Every registered query next to its SQL counterpart."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as spark_entry
from oracle import compare, connect
from weftmark.plans import load_queries
from weftmark.plans.registry import ORACLES, QUERIES

load_queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.columns and df.count() >= 0


def test_every_query_has_sql():
    # an approximate search has a tested recall in place of SQL
    assert set(QUERIES) - set(ORACLES) == {"vector_candidates_lsh"}


def test_entry_has_rows_and_stable_schema(spark):
    df = spark_entry.entry(spark)
    assert df.columns == spark_entry.entry(spark).columns
    assert df.limit(1).count() == 1


def test_entry_without_the_training_data_folders():
    """The queries of the rest are there when those folders are not."""
    code = (
        "import sys\n"
        "sys.modules['corpus_pipeline'] = sys.modules['weftmark.llm'] = None\n"
        "import __spark_entry__ as e\n"
        "assert set(e.queries()) - set(e.oracle_sql()) == {'vector_candidates_lsh'} and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(spark_entry.__file__).parent)
