"""Round trip: bound tables written out as spreadsheet-like CSV text, ingested through the real
pipeline (inference, coercion, ids, folded/date twins, publish), then analysed from the
published views — the answers equal those on the bindings."""

import pytest
from pyspark.sql import functions as F

from innsight.plans.registry import run
from innsight.sources import ingest as ing
from innsight.sources.catalog import Catalog
from innsight.sources.testdata import testdata_catalog as bound_catalog

from conftest import SF_SMALL

TABLES = {
    "guest_feedback": dict(key_columns=("hotel", "cr", "predio", "tipocomentario", "palavrachave"),
                           date_columns=("datapreenchimento",)),
    "daily_occupancy": dict(key_columns=("resort", "empresa"), date_columns=("data",)),
    "medical_attendances": dict(key_columns=("hotel", "cr"), date_columns=("data",)),
}
DIRTY = {"hotel": " Hotel ", "resort": "Resort", "cr": "CR", "data": "Data", "mes": "Mês", "ano": "Ano",
         "nota": " Nóta ", "datapreenchimento": "Data Preenchimento"}


def export_as_sheet(df, path):
    """All cells as text, dirty headers, decimal commas, one CSV file."""
    cols = []
    for name, dtype in df.dtypes:
        if name.endswith("__date"):
            continue
        value = F.col(name).cast("string")
        if dtype == "double":
            value = F.replace(value, F.lit("."), F.lit(","))
        cols.append(value.alias(DIRTY.get(name, name)))
    df.select(*cols).coalesce(1).write.option("header", True).mode("overwrite").csv(path)


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    bound = bound_catalog(spark, SF_SMALL)
    folder = tmp_path_factory.mktemp("landing")
    spark.sql("CREATE DATABASE IF NOT EXISTS roundtrip")
    specs = []
    for name, extra in TABLES.items():
        path = f"{folder}/{name}"
        export_as_sheet(bound.table(name), path)
        specs.append(ing.IngestSpec(f"src-{name}", name, path, tab=name, database="roundtrip", **extra))
    results = ing.ingest_all(spark, specs, max_workers=2)
    assert all(r.ok and r.action == "published" for r in results), [r.error for r in results]
    served = Catalog.from_metastore(spark, "roundtrip")
    assert all(served.has(name) for name in TABLES)
    return bound, served, results


def test_ingested_types_and_twins(ingested):
    _, served, results = ingested
    fb = served.table("guest_feedback")
    types = dict(fb.dtypes)
    assert types["ano"] == "bigint" and types["nota"] == "double" and types["datapreenchimento"] == "string"
    assert "hotel__key" in fb.columns and types["datapreenchimento__date"] == "date"
    assert fb.select("src_id").distinct().count() == fb.count()          # the source id column was kept
    assert fb.select("id").distinct().count() == fb.count()              # generated ids are unique


@pytest.mark.parametrize("name,filters", [
    ("count_feedback_by_type", {"hotel": "resort_beta", "ano": "2024", "mes": "1"}),
    ("rank_by_keyword", {"hotel": "RESORT_GAMMA", "ano": "2024", "mes": "1", "predio": "torre a"}),
    ("summarize_guests_by_month", {"ano": "1997", "resort": "resort_delta"}),
    ("rank_medical_occurrences", {"hotel": "resort_alpha", "ano": "2024", "mes": "1"}),
    ("count_attendances_by_patient_type", {"ano": "2024", "cr": "recep"}),
])
def test_analyses_equal_on_ingested_tables(ingested, name, filters):
    bound, served, _ = ingested
    a = sorted(tuple(r) for r in run(name, filters, bound).rows.collect())
    b = sorted(tuple(r) for r in run(name, filters, served).rows.collect())
    assert a == b and a


def test_folded_filter_uses_the_stored_twin(ingested):
    _, served, _ = ingested
    df = run("count_feedback_by_type", {"hotel": "resort_beta", "ano": "2024", "mes": "1"}, served).rows
    served.spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hotel__key,resort_beta)" in plan
