"""Every query of the catalog over the small tables against its SQL, and those without SQL for their rows."""

import pytest

from quantloom.plans import detection, files  # noqa: F401
from quantloom.plans.catalog import ORACLES, QUERIES

from .plain import duck_rows, spark_rows

SMALL = "/root/testdata/sf0.001"
#: These find nothing in so few bars.
LARGER = {"early_detection", "indexed_matches", "hit_rates", "match_context", "outcome_stats", "topk_matches"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_says_what_its_sql_says(spark, name):
    folder = "/root/testdata/sf0.01" if name in LARGER else SMALL
    names, rows = spark_rows(QUERIES[name](spark, folder))
    assert rows, "no rows: the query shows nothing on these tables"
    if name in ORACLES:
        expected_names, expected = duck_rows(ORACLES[name], folder)
        assert names == expected_names
        assert rows == expected
