"""What the plans of queries read and how they spread groups."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_scans_are_pruned_and_filtered(spark):
    text = plan(entry.queries()["s11_pruned_scan"](spark, DATA))
    assert "GreaterThan(l_quantity" in text and "EqualTo(l_returnflag,R)" in text
    assert re.search(r"ReadSchema: struct<(\w+:[^,>]+,?){3}>", text)
    log = plan(entry.queries()["k1_page_order"](spark, DATA))
    assert "comment" not in log and "change_tag" not in log


@pytest.mark.parametrize("name", ["w16_lexicographic_rank", "w14_ranked", "j18_rank_agreement", "l4_baselines"])
def test_no_day_is_ranked_by_one_task(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert not re.search(r"(rank\(.*\)|row_number\(\)) windowspecdefinition\((date|day)#\d+", text)


@pytest.mark.parametrize("name", ["j15_changes_by_day", "t27_title_in_text", "s18_prune", "j10_day_bounds", "p2_found", "p3_found", "p5_found"])
def test_no_pairs_by_nested_loops(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_partial_aggregation_before_shuffles(spark):
    from palimpsest.operators.revisions import first_delivery
    from palimpsest.shared import table

    text = plan(first_delivery(table(spark, DATA, "revisions"), ["page_id"]).groupBy("page_id").agg(F.count("*")))
    assert "partial_min" in text.lower() or text.count("Aggregate") >= 4
