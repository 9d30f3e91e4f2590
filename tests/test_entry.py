"""Driver contract: entry() runs, every key has an oracle unless it is listed as rows-only."""

import __spark_entry__ as E
from rejoinder.plans.catalog import QUERIES

ROWS_ONLY = {"batch_generate"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "theme" in df.columns and "model" in df.columns


def test_every_key_has_oracle_or_is_rows_only():
    q, o = E.queries(), E.oracle_sql()
    assert set(QUERIES) - set(o) == ROWS_ONLY
    assert set(o) <= set(q) and set(QUERIES) <= set(q)


def test_small_queries_run(spark):
    from tests.conftest import SF_SMALL
    for k in ["schema_report", "alpha_report", "mcnemar_pairs", "entity_diff_item", "semantic_max_stats"]:
        assert E.queries()[k](spark, SF_SMALL).count() >= 0
