"""Every registered query against its reference SQL on the smallest tables."""

import pytest
from compare import check, connect

import __spark_entry__ as entry_point
from swathline.plans import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()

# Nothing to report on the smallest raster: it has no tile without signal.
EMPTY_AT_SMALLEST = {"missing_post_tiles"}


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, folder, name):
    text, good, _ = check(spark, duck, folder, name, QUERIES[name], ORACLES.get(name))
    assert good or (name in EMPTY_AT_SMALLEST and text.startswith("ok")), text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"storage_sizes", "simplify_rings", "rf_train_predict", "rf_inspect"}


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 4
    assert sum(r.pixel_count for r in rows) == 1609
