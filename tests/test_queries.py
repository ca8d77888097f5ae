"""Every registered query against its SQL twin."""

import pytest
from compare import differences, duck

from answerloom.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


def test_only_training_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"train_per_column"}


def test_view_counts(spark, sf_dir):
    """The documented number of usable rows of the smallest scale."""
    if sf_dir.endswith("sf0.001"):
        counts = {r.split: (r.total_rows, r.usable_rows) for r in QUERIES["row_counts"](spark, sf_dir).collect()}
        assert sum(t for t, _ in counts.values()) == 200 and sum(u for _, u in counts.values()) == 171
        assert counts["eval"][1] == 34


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0 and set(oracle_sql()) < set(queries())
