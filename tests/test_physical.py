"""Physical plans: no products, no row-at-a-time Python, filters and columns reach the scans."""

import pytest

from pricewright import plans

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_no_products_and_no_plain_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text


def test_scans_are_pruned(spark):
    text = plan(spark, "agg_best_price")
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line)
    assert "l_discount" not in scan and "l_tax" not in scan and "l_returnflag" in scan
    assert "NOT ((l_returnflag" in scan or "PushedFilters: [" in scan
    history = next(line for line in plan(spark, "src_history").splitlines() if "FileScan parquet" in line)
    assert "GreaterThanOrEqual(ts" in history and "LessThan(ts" in history


def test_best_price_is_combined_before_the_shuffle(spark):
    text = plan(spark, "agg_best_price")
    above, below = text.split("Exchange hashpartitioning", 1)
    assert "partial_min" in below and "partial_min" not in above


def optimized(spark, name):
    return plans.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_a_nested_text_is_parsed_once(spark):
    text = optimized(spark, "cod_nested")
    assert text.count("parseJson") == 1 and "isVariantNull" in text


def test_latencies_do_not_copy_versions_by_instant(spark):
    """The instants of all latencies are swept once; no version is exploded into the instants at which it is seen."""
    text = optimized(spark, "bt_latency_sensitivity")
    assert "explode(filter(" not in text and "Generate explode(lambda" not in text and text.count("MapInArrow") == 1


def test_settlement_is_plain_arithmetic(spark):
    assert "lambda" not in optimized(spark, "fn_ah_settle")
