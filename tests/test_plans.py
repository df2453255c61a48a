"""Physical-plan properties the analyses rely on at scale."""

import pytest

import __spark_entry__ as entry
from innsight.plans.registry import run
from innsight.sources.catalog import Catalog
from innsight.sources.testdata import testdata_catalog as bound_catalog

from conftest import SF_SMALL


def plan(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(entry.queries()) - set(entry.LLM_QUERIES)))
def test_no_python_in_any_registered_plan(spark, key):
    p = plan(entry.queries()[key](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p
    # no products of any size: one-row aggregates are attached as scalar subqueries
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_listing_page_is_take_ordered(spark):
    cat = bound_catalog(spark, SF_SMALL)
    p = plan(run("list_guest_feedback", {"ano": "2024"}, cat, page=3, limit=20).rows)
    assert "TakeOrderedAndProject" in p and "offset=40" in p


def test_ranking_uses_window_group_limit(spark):
    cat = bound_catalog(spark, SF_SMALL)
    df = run("rank_by_survey_status", {"ano": "1998", "status": "respondido"}, cat).rows
    p = df._jdf.queryExecution().executedPlan().toString()
    # a partial limit per task before the shuffle on the year, the final one after it
    partial = p.index("row_number(), 5, Partial")
    assert "row_number(), 5, Final" in p and p.rfind("Exchange hashpartitioning(ano", 0, partial) > 0


def test_equality_filters_reach_parquet_scan(spark, scratch):
    cat = bound_catalog(spark, SF_SMALL)
    path = f"{scratch}/medical"
    cat.table("medical_attendances").write.parquet(path)
    served = Catalog(spark, {"medical_attendances": spark.read.parquet(path)})
    df = run("rank_medical_occurrences", {"ano": "2024", "mes": "1"}, served).rows
    p = plan(df)
    assert "PushedFilters" in p and "EqualTo(ano,2024)" in p and "EqualTo(mes,1)" in p


def test_partition_pruning_on_item_sales(spark, scratch):
    cat = bound_catalog(spark, SF_SMALL)
    path = f"{scratch}/items"
    cat.table("pos_item_sales").write.partitionBy("ano").parquet(path)
    served = Catalog(spark, {"pos_item_sales": spark.read.parquet(path), "daily_occupancy": cat.table("daily_occupancy")})
    df = run("analyze_item_sales", {"hotel": "resort_alpha", "ano": "1998", "mes": "1"}, served).rows
    assert "PartitionFilters: [isnotnull(ano" in plan(df) and "(ano#" in plan(df)


def test_total_row_is_one_aggregate_over_one_scan(spark):
    p = plan(entry.queries()["a11_total_row"](spark, SF_SMALL))
    assert p.count("FileScan parquet") == 1 and "Expand" in p


def test_month_pivot_aggregates_partially_before_the_shuffle(spark):
    p = plan(entry.queries()["a17_month_pivot"](spark, SF_SMALL))
    assert "partial_sum" in p and "pivotfirst" in p.lower()


def test_status_classes_need_no_join(spark):
    p = plan(entry.queries()["n08_status_class"](spark, SF_SMALL))
    bound = plan(bound_catalog(spark, SF_SMALL).table("employee_sentiment_surveys"))
    assert p.count("HashJoin") == bound.count("HashJoin") and "Generate" in p


def test_department_balance_pushes_both_keys(spark, scratch):
    from pyspark.sql import functions as F
    cat = bound_catalog(spark, SF_SMALL)
    served = {}
    for name in ("overtime_positive", "overtime_negative"):
        path = f"{scratch}/{name}"
        df = cat.table(name)
        df.withColumns({f"{c}__key": F.trim(F.lower(c)) for c in ("hotel", "cr")}).write.parquet(path)
        served[name] = spark.read.parquet(path)
    request = {"hotel": "resort_alpha", "cr": "x", "ano": "1998", "mes": "1"}
    p = plan(run("get_department_overtime_balance", request, Catalog(spark, served)).rows)
    assert p.count("EqualTo(hotel__key,resort_alpha)") == 2 and p.count("EqualTo(cr__key,x)") == 2


@pytest.mark.parametrize("analysis,request_,aggregates", [
    ("count_attendances_by_patient_type", {"ano": "2024"}, 1), ("get_department_overtime_balance", {"ano": "1998"}, 1)])
def test_totals_are_one_aggregation_and_one_sort(spark, analysis, request_, aggregates):
    df = run(analysis, request_, bound_catalog(spark, SF_SMALL)).rows
    p = plan(df)
    bound = sum(plan(bound_catalog(spark, SF_SMALL).table(t)).count("Union") for t in (
        ["medical_attendances"] if "patient" in analysis else ["overtime_positive", "overtime_negative"]))
    assert p.count("Union") == bound and p.count("Expand") == aggregates
    assert p.index("Sort [row_kind") < p.index("Expand")


def test_planning_item_sales_runs_no_job(spark):
    cat = bound_catalog(spark, SF_SMALL)
    cat.table("pos_item_sales"), cat.table("daily_occupancy")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "")
    run("analyze_item_sales", {"hotel": "resort_alpha", "ano": "1998", "mes": "1"}, cat)
    assert not tracker.getJobIdsForGroup("plan-only")
    spark.sparkContext.setJobGroup("", "")
