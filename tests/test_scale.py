"""Queries whose work a large table would put into one task, or into one key's aggregates."""

import re

import pytest

from pyspark.sql import functions as F

from ledgerlight.catalogue import QUERIES
from ledgerlight.functions import extract as X
from ledgerlight.plans import spread

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q70_html_sections", "q74_site_sections"])
def test_heavy_rows_are_dealt_over_all_cores(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_dealt_knows_no_size_but_that_of_many_splits_a_core(spark, monkeypatch):
    rows = spark.range(10)
    monkeypatch.setattr(spread, "_size", lambda _: 200 << 20)  # more than spread() deals
    assert spread.dealt(rows).rdd.getNumPartitions() == 25
    monkeypatch.setattr(spread, "_size", lambda _: 1 << 50)
    assert "Exchange" not in _plan(spread.dealt(rows))


def test_sketches_are_not_held_for_each_part(spark, tmp_path):
    held = [x for x in _plan(QUERIES["q93_approximate"](spark, SF)).splitlines() if "Aggregate(" in x and "percentile" in x]
    assert held and not any("l_partkey" in re.search(r"keys?=\[(.*?)\]", x)[1] for x in held)
    li = spark.createDataFrame([(f, k, float(q)) for f in ("A", None) for k, q in ((1, 1), (2, 5), (2, 9), (None, 5))], "l_returnflag string, l_partkey long, l_quantity double")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["q93_approximate"](spark, str(tmp_path)).collect()
    assert {r.l_returnflag for r in got} == {"A", None} and all(r.parts_near and r.median_near for r in got)


@pytest.mark.parametrize("name", ["q45_query_reformulated", "q52_page_terms"])
def test_texts_are_dealt_before_they_are_written(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_what_was_found_is_searched_once(spark):
    """A search within what was found names it once: else a text would be searched again for each of its readings."""
    plan = spark.createDataFrame([("t",)], "t string").select(X.loan_terms(F.col("t"))["min_income"].alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("earning))") == 1


@pytest.mark.parametrize("name", ["q05_rule_failure_summary", "q06_rule_top_failures", "q08_rule_validation", "q55_document_fields", "q5a_document_query"])
def test_customers_are_dealt_before_anything_is_computed(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Repartition") :]
    assert "Filter" not in below and "named_struct" not in below


def test_pages_are_dealt_whatever_their_size(spark, monkeypatch):
    monkeypatch.setattr(spread, "_size", lambda _: 80 << 20)  # more than spread() deals
    assert QUERIES["q71_page_records"](spark, SF).rdd.getNumPartitions() == 10


def test_keys_of_pages_are_dealt_not_their_markup(spark):
    plan = QUERIES["q72_site_records"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "<html>" not in plan[plan.index("Repartition") :]
