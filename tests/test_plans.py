"""The plans that Catalyst makes of the operators: pushdown, pruning, top-k, partial aggregates, no needless windows."""

import pytest

from tidewell.plans.catalog import QUERIES

DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = QUERIES[name](spark, DIR)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "op_filter")
    assert "GreaterThan(l_quantity,25.0)" in text and "LessThan(l_discount,0.05)" in text
    assert "Python" not in text and "Exchange" not in text
    text = plan(spark, "op_distinct")
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text


def test_prefixes_need_no_window(spark):
    for name in ("op_take_while", "op_drop_while"):
        assert "Window" not in plan(spark, name) and "Subquery" in plan(spark, name)


@pytest.mark.parametrize("name", ["op_top_k", "op_limit", "term_max", "term_find_first"])
def test_slices_are_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["col_summing_double", "col_teeing", "col_summarizing_double", "col_grouping_by_downstream", "term_sum_double", "col_filtering"])
def test_aggregates_are_partial(spark, name):
    text = plan(spark, name)
    assert "HashAggregate" in text and "partial_" in text and "SortAggregate" not in text


@pytest.mark.parametrize("name", ["op_map", "op_map_multi", "op_peek", "op_reversed", "src_concat"])
def test_no_python(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
