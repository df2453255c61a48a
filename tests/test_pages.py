"""One-pass envelopes and token pages, against the separate frames and the numbered pages."""

import random

import pytest
from pyspark.sql import functions as F

from innsight import AnalysisError, answer, run
from innsight.operators.listing import behind, order_keys, page
from innsight.plans.spec import Page, page_token
from innsight.sources.catalog import Catalog
from innsight.sources.testdata import testdata_catalog as bound_catalog

from conftest import SF_SMALL

LISTINGS = {
    "list_daily_occupancy": ("daily_occupancy", {"ano": "1997"}),
    "list_guest_feedback": ("guest_feedback", {"ano": "2024", "hotel": "resort_alpha"}),
    "search_feedback_by_keyword": ("guest_feedback", {"hotel": "all_resorts", "ano": "2024", "mes": "1", "palavrachave": "limpeza"}),
    "get_closed_period_indicators": ("business_indicators", {"ano": "1997"}),
    "list_extra_revenue_records": ("extra_revenue", {"hotel": "resort_alpha", "ano": "1997", "mes": "2"}),
    "list_medical_attendances": ("medical_attendances", {"ano": "2024"}),
    "get_survey_status": ("employee_sentiment_surveys", {"ano": "1997"}),
}


@pytest.fixture(scope="module")
def catalog(spark):
    return bound_catalog(spark, SF_SMALL)


@pytest.mark.parametrize("name", LISTINGS)
def test_envelope_reads_its_rows_once(spark, catalog, name):
    table, filters = LISTINGS[name]
    rows = catalog.table(table)
    counter = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            counter.add(b.num_rows)
            yield b
    counted = Catalog(spark, {table: rows.mapInArrow(seen, rows.schema)})
    got = run(name, filters, counted, page=2, limit=7).envelope()
    assert counter.value == rows.count()
    apart = run(name, filters, catalog, page=2, limit=7)
    stats = apart.stats.first()
    assert got["data"] == [r.asDict(recursive=True) for r in apart.rows.collect()]
    assert got["pagination"]["total_records"] == stats["total_records"] and got.get("data_until") == stats["data_until"]


@pytest.mark.parametrize("name,filters", [(n, f) for n, (_, f) in LISTINGS.items()] + [
    ("rank_by_keyword", {"hotel": "all_resorts", "ano": "2024", "mes": "1"}), ("get_resort_adherence", {})])
def test_token_pages_equal_numbered_pages(spark, catalog, name, filters):
    """On tables whose ids are unique, as published ones are (some bindings of the given tables repeat ids)."""
    catalog = Catalog(spark, {t: catalog.table(t).dropDuplicates(["id"]).persist() for t in {
        "employee_sentiment_by_resort", *(t for t, _ in LISTINGS.values())}})
    limit, number, token, whole = 6, 1, None, []
    while True:
        numbered = run(name, filters, catalog, page=number, limit=limit).envelope()
        followed = run(name, filters, catalog, limit=limit, after=token).envelope()
        assert followed["data"] == numbered["data"]
        whole += followed["data"]
        assert followed["pagination"]["total_records"] == numbered["pagination"]["total_records"]
        token = followed["pagination"].get("next")
        if token is None or number == 6:
            break
        number += 1
    assert len(whole) == min(numbered["pagination"]["total_records"], 6 * limit)


def test_tokens_with_nulls_and_ties(spark):
    random.seed(8)
    rows = [(random.choice([None, 1.5, float(2) / 3, -0.0]), random.choice([None, "a", "é", "b\"c"]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, d string, id long").withColumn("day", F.expr("IF(id % 4 = 0, NULL, date_add(DATE'2024-01-01', int(id % 3)))"))
    for order in ([("x", "desc"), ("d", "asc"), ("id", "asc")], [("d", "desc"), ("day", "desc"), ("x", "asc"), ("id", "desc")]):
        want = [r["id"] for r in df.orderBy(*order_keys(order)).collect()]
        got, token = [], None
        while True:
            part = page(df, order, Page(limit=7, after=token)).select("id", *[F.col(c).cast("string").alias(f"k{i}") for i, (c, _) in enumerate(order)]).collect()
            got += [r["id"] for r in part]
            if len(part) < 7:
                break
            token = page_token([part[-1][f"k{i}"] for i in range(len(order))])
        assert got == want
    assert df.where(behind(df, [("id", "asc")], ["59"])).count() == 0


def test_a_page_far_behind_keeps_its_rows_only(catalog):
    numbered = run("list_guest_feedback", {}, catalog, page=10_000, limit=20)
    first = run("list_guest_feedback", {}, catalog, limit=20)
    token = first.envelope()["pagination"]["next"]
    plan = run("list_guest_feedback", {}, catalog, limit=20, after=token).rows._jdf.queryExecution().executedPlan().toString()
    assert "limit=20," in plan.replace("limit=20 ", "limit=20,") and "offset" not in plan
    assert "limit=200000" in numbered.rows._jdf.queryExecution().executedPlan().toString()


def test_bad_tokens_and_error_answers(catalog):
    for bad in ("x", "W10=", page_token(["1"]), page_token(["a", "b", "c"]) + "!"):
        assert "token" in answer("list_guest_feedback", {}, catalog, after=bad)["error"]
    assert "required" in answer("rank_by_keyword", {}, catalog)["error"]
    assert "unknown" in answer("nothing", {}, catalog)["error"]
    assert answer("list_guest_feedback", {"ano": "1890"}, catalog)["pagination"]["total_records"] == 0
    with pytest.raises(AnalysisError):
        run("rank_by_keyword", {}, catalog)
