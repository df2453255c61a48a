"""Infirmary analyses: attendance listing (Q13), complaint ranking (Q14), attendances per
100 guests (Q15), attendances by patient type with a total row (Q16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from innsight.errors import AnalysisError
from innsight.functions.numeric import safe_ratio
from innsight.functions.text import fold_py
from innsight.operators import filters as flt
from innsight.operators.aggregate import ranked_count, with_total
from innsight.operators.combine import scalar_ratio
from innsight.operators.listing import listing, order_keys, page, rename
from innsight.plans.common import date_col, source_columns
from innsight.plans.spec import AnalysisResult, Page
from innsight.sources.catalog import Catalog

# --- fixed values: must equal the analysed system's for the same results -------------------
# Stored column → published name; the listing returns every column.
ATTENDANCE_NAMES = {
    "id": "id", "carimbodedatahora": "timestamp", "data": "attendance_date", "horario": "attendance_time",
    "hospedeouemocionador": "patient_type", "cr": "cost_center", "numerodoapartamento": "room_number",
    "nomecompleto": "patient_name", "responsavelegraudeparentescomenor": "guardian_minor",
    "ocorrenciaqueixa": "chief_complaint", "partedocorpodosintoma": "affected_body_part",
    "pressaoarterial": "blood_pressure", "frequenciacardiaca": "heart_rate",
    "frequenciarespiratoria": "respiratory_rate", "saturacao": "saturation", "temperatura": "temperature",
    "glicemiacapilar": "capillary_glucose", "condutaenfermeiroa": "action_taken",
    "houvetransferenciaparaohospital": "hospital_transfer", "qualmeiodetransferencia": "transfer_method",
    "motivodarecusa": "refusal_reason", "observacao": "observation", "enfermeiroaresponsavel": "attending_nurse",
    "localocorrencia": "occurrence_location", "hotel": "resort_code", "hospedesreal": "actual_guests_on_day",
    "mes": "month", "ano": "year",
}
ALIASES = {
    "resort": "hotel", "unidade": "hotel", "periodo": "mes", "year": "ano", "month": "mes", "day": "dia",
    "paciente": "hospedeouemocionador", "tipodepaciente": "hospedeouemocionador",
    "patienttype": "hospedeouemocionador", "queixa": "ocorrenciaqueixa", "sintoma": "ocorrenciaqueixa",
    "ocorrencia": "ocorrenciaqueixa", "complaint": "ocorrenciaqueixa", "enfermeiro": "enfermeiroaresponsavel",
    "responsavel": "enfermeiroaresponsavel", "nurse": "enfermeiroaresponsavel",
    "partedocorpo": "partedocorpodosintoma", "bodypart": "partedocorpodosintoma",
    "transferencia": "houvetransferenciaparaohospital", "transfer": "houvetransferenciaparaohospital",
}
# filter key → column, matched by folded "contains"
CONTAINS_FILTERS = {
    "hospedeouemocionador": "hospedeouemocionador", "cr": "cr", "ocorrenciaqueixa": "ocorrenciaqueixa",
    "partedocorpodosintoma": "partedocorpodosintoma", "enfermeiroaresponsavel": "enfermeiroaresponsavel",
    "localocorrencia": "localocorrencia", "nomepaciente": "nomecompleto",
}
YES, NO = "Sim", "Não"
# --- end of fixed values ------------------------------------------------------------------


def _transfer_value(v) -> str:
    if isinstance(v, bool):
        return YES if v else NO
    folded = fold_py(str(v).strip())
    if folded in ("true", "sim", "yes", "s", "1"):
        return YES
    if folded in ("false", "nao", "no", "n", "0"):
        return NO
    return str(v).strip()


def _period_preds(df, f: flt.Filters, day=True):
    return [flt.resort_pred(df, "hotel", f.resort("hotel")),
            None if f.integer("ano") is None else flt.eq(df, "ano", f.integer("ano")),
            None if f.month("mes") is None else flt.eq(df, "mes", f.month("mes")),
            None if not day or f.integer("dia") is None else flt.eq(df, "dia", f.integer("dia"))]


def list_medical_attendances(catalog: Catalog, filters: dict, pg: Page) -> AnalysisResult:
    """Q13: attendances matching any of the contains/equality filters, newest first."""
    f = flt.Filters(filters, ALIASES)
    df = catalog.table("medical_attendances")
    known = catalog.domains("medical_attendances")
    preds = [flt.fold_contains(col, f.text(key), df=df, domains=known) for key, col in CONTAINS_FILTERS.items() if f.text(key)]
    transfer = f.raw("houvetransferenciaparaohospital")
    if transfer is not None:
        preds.append(flt.fold_eq(df, "houvetransferenciaparaohospital", _transfer_value(transfer)))
    filtered = flt.where(df, preds + _period_preds(df, f))
    return listing(filtered, [(date_col(df, "data"), "desc"), ("horario", "desc"), ("id", "asc")], pg,
                   lambda rows, *extra: rename(rows, ATTENDANCE_NAMES, source_columns(df), extra))


def _ranked(filtered, key, key_alias, pg):
    grouped = ranked_count(filtered, key, key_alias, "total_attendances")
    rows = page(grouped, [("total_attendances", "desc"), (key_alias, "asc")], pg)
    stats = grouped.agg(F.count(key_alias).alias("total_records"), F.lit(None).cast("string").alias("data_until"))
    return rows, stats


def rank_medical_occurrences(catalog: Catalog, filters: dict, pg: Page) -> AnalysisResult:
    """Q14: attendances per non-empty chief complaint, most frequent first."""
    f = flt.Filters(filters, ALIASES)
    df = catalog.table("medical_attendances")
    filtered = flt.where(df, [flt.not_blank("ocorrenciaqueixa")] + _period_preds(df, f, day=False))
    rows, stats = _ranked(filtered, "ocorrenciaqueixa", "chief_complaint", pg)
    return AnalysisResult(rows, stats, pg)


def calculate_attendance_per_guest_index(catalog: Catalog, filters: dict, pg: Page | None = None) -> AnalysisResult:
    """Q15: leisure/event guest attendances ÷ guests of the month × 100 for one specific resort."""
    f = flt.Filters(filters, ALIASES)
    resort, year, month = f.resort("hotel"), f.integer("ano"), f.month("mes")
    f.require(hotel=resort, ano=year, mes=month)
    if flt.is_all(resort):
        raise AnalysisError("a specific resort is required (all_resorts is not accepted)")
    att = catalog.table("medical_attendances")
    patient = F.col("hospedeouemocionador")
    n = flt.where(att, [flt.fold_eq(att, "hotel", resort), flt.eq(att, "ano", year), flt.eq(att, "mes", month),
                        flt.fold_contains(patient, "lazer") | flt.fold_contains(patient, "eventos")]) \
        .agg(F.count(F.lit(1)).alias("total_attendances_leisure_events_guests"))
    occ = catalog.table("daily_occupancy")
    g = flt.where(occ, [flt.fold_eq(occ, "resort", resort), flt.eq(occ, "ano", year), flt.eq(occ, "mes", month)]) \
        .agg(F.coalesce(F.sum("hosptotal"), F.lit(0)).cast("bigint").alias("total_guests_in_month"))
    rows = scalar_ratio(n, g).select(
        F.lit(resort).alias("resort_code"), F.lit(year).cast("bigint").alias("year"),
        F.lit(month).cast("bigint").alias("month"), "total_attendances_leisure_events_guests",
        "total_guests_in_month",
        safe_ratio("total_attendances_leisure_events_guests", "total_guests_in_month")
        .alias("attendance_per_100_guests_index"))
    stats = rows.agg(F.count(F.lit(1)).alias("total_records"), F.lit(None).cast("string").alias("data_until"))
    return AnalysisResult(rows, stats, None)


def count_attendances_by_patient_type(catalog: Catalog, filters: dict, pg: Page) -> AnalysisResult:
    """Q16: attendances per non-empty patient type, most frequent first; the first page ends
    with a ``Total`` row counting every attendance of the filter (not only the page)."""
    f = flt.Filters(filters, ALIASES)
    df = catalog.table("medical_attendances")
    preds = [flt.not_blank("hospedeouemocionador")] + _period_preds(df, f)
    if f.text("cr"):
        preds.append(flt.fold_contains("cr", f.text("cr"), df=df, domains=catalog.domains("medical_attendances")))
    filtered = flt.where(df, preds)
    rows, stats = _ranked(filtered, "hospedeouemocionador", "patient_type", pg)
    if pg.number == 1 and not pg.after:
        # groups and grand total in one aggregation: the total and the page's best groups are taken
        # together, and one sort of that page puts the total last
        both = with_total(filtered.withColumn("patient_type", F.col("hospedeouemocionador")), ["patient_type"],
                          {"total_attendances": F.count(F.lit(1))}, "patient_type", "Total") \
            .where(F.col("total_attendances") > 0)
        order = [("total_attendances", "desc"), ("patient_type", "asc")]
        first = both.orderBy(*order_keys([("row_kind", "desc"), *order])).limit(pg.limit + 1)
        rows = first.orderBy(*order_keys([("row_kind", "asc"), *order])).drop("row_kind")
    return AnalysisResult(rows, stats, pg)
