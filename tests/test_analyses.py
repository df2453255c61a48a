"""Every registered query equals its DuckDB statement (small scale here; the driver uses sf0.01),
plus request validation."""

import pytest

import __spark_entry__ as entry
from innsight.errors import AnalysisError
from innsight.oracle.compare import compare, duckdb_connection
from innsight.plans.registry import run
from innsight.sources.testdata import testdata_catalog as bound_catalog

from conftest import SF_SMALL

QUERIES = {k: f for k, f in entry.queries().items() if k not in entry.LLM_QUERIES}  # theirs are in tests/llm
ORACLE = {k: s for k, s in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF_SMALL)


@pytest.fixture(scope="module")
def catalog(spark):
    return bound_catalog(spark, SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    ok, msg = compare(QUERIES[key](spark, SF_SMALL), con, ORACLE[key], exact=True)
    assert ok, msg


SPARK_TO_DUCKDB = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                   "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_types_match_oracle(spark, con, key):
    """Same column names and types on both sides (the driver compares schemas, not only values);
    e.g. a DuckDB ``sum`` of integers is HUGEINT unless the oracle casts it."""
    spark_types = {f.name: SPARK_TO_DUCKDB.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
                   for f in QUERIES[key](spark, SF_SMALL).schema.fields}
    rel = con.sql(ORACLE[key])
    assert spark_types == dict(zip(rel.columns, [str(t) for t in rel.types]))


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["feedback_type", "total"] and df.count() >= 0


@pytest.mark.parametrize("name,filters", [
    ("summarize_guests_by_month", {"hotel": "resort_alpha"}),
    ("calculate_complaint_per_guest_index", {"hotel": "resort_alpha", "ano": "2024"}),
    ("count_feedback_by_type", {"hotel": "x", "ano": "2024"}),
    ("calculate_attendance_per_guest_index", {"hotel": "all_resorts", "ano": "2024", "mes": "1"}),
    ("get_employee_overtime_balance", {"hotel": "x", "ano": "2024"}),
    ("get_department_overtime_balance", {"hotel": "x", "ano": "2024"}),
    ("rank_by_survey_status", {"ano": "2024"}),
    ("list_daily_occupancy", {"ano": "dois mil"}),
    ("no_such_analysis", {}),
])
def test_invalid_requests_raise_before_any_job(catalog, name, filters):
    with pytest.raises(AnalysisError):
        run(name, filters, catalog)


def test_page_bounds_validated(catalog):
    with pytest.raises(AnalysisError):
        run("list_daily_occupancy", {}, catalog, page=0)


def test_envelope_and_stats(catalog):
    res = run("rank_by_keyword", {"hotel": "resort_alpha", "ano": "2024", "mes": "1"}, catalog, page=1, limit=3)
    env = res.envelope()
    pages = env["pagination"]
    assert env["analysis_executed"] == "rank_by_keyword" and env["filters_used"]["hotel"] == "resort_alpha"
    assert len(env["data"]) <= 3 and pages["total_pages"] == -(-pages["total_records"] // 3)
    assert (pages["page"], pages["limit"]) == (1, 3)
    assert env.get("data_until", "2024-01").startswith("2024-01")


def test_q02_total_row_is_sum_of_detail(catalog):
    rows = run("summarize_guests_by_month", {"ano": "1996"}, catalog).rows.collect()
    detail = [r for r in rows if r.row_kind == "detail"]
    total = [r for r in rows if r.row_kind == "total"][0]
    assert total.total_hospedes == sum(r.total_hospedes for r in detail) and total.dias_apurados is None


def test_q16_total_only_on_first_page(catalog):
    f = {"ano": "2024", "mes": "1"}
    first = run("count_attendances_by_patient_type", f, catalog, page=1, limit=2).rows.collect()
    second = run("count_attendances_by_patient_type", f, catalog, page=2, limit=2).rows.collect()
    assert first[-1].patient_type == "Total" and all(r.patient_type != "Total" for r in second)


def test_q08_nested_indicator_map(catalog):
    row = run("get_closed_period_indicators", {"hotel": "resort_alpha", "year": "1997", "period": "annual"},
              catalog).rows.first()
    assert row.status == "closed" and row.period == "Annual" and set(row.indicators) >= {"complaint", "fb_cogs"}


def test_item_sales_for_a_year_without_data_is_an_error(catalog):
    request = {"hotel": "resort_alpha", "mes": "1"}
    late = run("analyze_item_sales", {**request, "ano": "1980"}, catalog)  # a view: only its rows can tell
    with pytest.raises(AnalysisError):
        late.envelope()
    assert run("analyze_item_sales", {**request, "ano": "1998"}, catalog).envelope()["pagination"]["page"] == 1


def test_yearly_item_sales_tables(catalog, spark):
    items = catalog.table("pos_item_sales")
    for year in (1997, 1998):
        items.where(f"ano = {year}").write.mode("overwrite").saveAsTable(f"pos_item_sales_{year}")
    try:
        from innsight.sources.catalog import Catalog
        stored = Catalog.from_metastore(spark)
        assert stored._years["pos_item_sales"] == {1997, 1998} and stored.has("pos_item_sales_1997")
        served = Catalog(spark, {**stored._entries, "daily_occupancy": catalog.table("daily_occupancy")}, stored._years)
        f = {"hotel": "resort_alpha", "ano": "1998", "mes": "1,2"}
        got = run("analyze_item_sales", f, served)
        assert "source_found" not in got.stats.columns
        assert got.rows.collect() == run("analyze_item_sales", f, catalog).rows.collect()
        with pytest.raises(AnalysisError):  # metadata tells, nothing runs
            run("analyze_item_sales", {**f, "ano": "1999"}, served)
    finally:
        for year in (1997, 1998):
            spark.sql(f"DROP TABLE IF EXISTS pos_item_sales_{year}")


def test_years_of_a_partitioned_table(catalog, spark):
    from innsight.sources import ingest as ing
    from innsight.sources.catalog import Catalog
    ing.publish(spark, catalog.table("pos_item_sales").where("ano IN (1995, 1996)"), "pos_item_sales", partition_by=["ano"])
    try:
        assert Catalog.from_metastore(spark)._years["pos_item_sales"] == {1995, 1996}
    finally:
        ing.drop_target(spark, "pos_item_sales")
        for v in ing.versions(spark, "pos_item_sales"):
            spark.sql(f"DROP TABLE {v}")


def test_indicators_missing_or_new():
    from innsight.plans.indicators import indicator_columns
    assert indicator_columns(["id", "npsreal", "npsmeta"]) == {"nps": ("npsreal", "npsmeta")}
    assert indicator_columns(["grimeta", "water_actual"]) == {"gri": (None, "grimeta"), "water": ("water_actual", None)}
    assert indicator_columns(["id"]) == {}


@pytest.mark.parametrize("columns", [["npsreal", "npsmeta"], ["grimeta", "water_actual"], []])
def test_q08_on_tables_with_other_indicators(spark, columns):
    from innsight.sources.catalog import Catalog
    df = spark.range(1).selectExpr("'1' AS id", "'resort_alpha' AS hotel", "2024L AS ano", "'H1' AS periodo", *[f"0.5D AS {c}" for c in columns])
    row = run("get_closed_period_indicators", {"ano": "2024"}, Catalog(spark, {"business_indicators": df})).rows.first()
    assert len(row.indicators) == (1 if columns == ["npsreal", "npsmeta"] else 2 if columns else 0)


@pytest.mark.parametrize("key", ["q01_list_daily_occupancy", "q04_list_guest_feedback", "q13_list_medical_attendances",
                                 "q21_get_survey_status", "a06_oldest_freshness", "p09_iso_dates",
                                 "a16_listing_stats_occupancy"])
def test_dates_do_not_depend_on_the_session_time_zone(spark, con, key):
    previous = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        ok, msg = compare(QUERIES[key](spark, SF_SMALL), con, ORACLE[key])
    finally:
        spark.conf.set("spark.sql.session.timeZone", previous)
    assert ok, msg


def test_resort_balance_keeps_null_hotels_of_both_sides(spark):
    from innsight.sources.catalog import Catalog
    pos = spark.createDataFrame([(None, 2024, 1, 0.0), ("a", 2024, 1, 3.0)], "hotel string, ano long, mes long, horaspositiva double")
    neg = spark.createDataFrame([(None, 2024, 1, 0.0), ("a", 2024, 1, 1.0)], "hotel string, ano long, mes long, horasnegativas double")
    rows = run("get_department_overtime_balance", {"ano": "2024"}, Catalog(spark, {"overtime_positive": pos, "overtime_negative": neg})).rows.collect()
    assert sorted((str(r.resort_code), r.positive_hours, r.negative_hours) for r in rows) == [
        ("Group", 3.0, 1.0), ("None", 0.0, 0.0), ("None", 0.0, 0.0), ("a", 3.0, 1.0)]
