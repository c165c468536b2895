"""What the physical plans must keep: pruned scans, pushed filters, no cross joins."""

import re

import pytest

from touchline.plans.fixtures import games
from touchline.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark):
    text = plan(QUERIES["fixture_result_binomial"](spark, SF))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert len(read) == 1 and "o_orderpriority" not in read[0] and "o_custkey" not in read[0]


def test_filters_reach_the_scan(spark):
    text = plan(games(spark, SF).filter("game_id > 100 AND game_state_name = 'Final'").select("game_id"))
    assert "GreaterThan(o_orderkey,100)" in text


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_no_products_and_no_row_functions(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
