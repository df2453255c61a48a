"""Employee-sentiment analyses: resort adherence (Q19), department adherence (Q20), survey
status listing (Q21), ranking of employees by survey status (Q22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from innsight.functions.numeric import percent_columns
from innsight.functions.text import WORKFORCE_CODES
from innsight.operators import filters as flt
from innsight.operators.aggregate import distinct_text
from innsight.operators.listing import listing, rename
from innsight.operators.rank import top_rank
from innsight.plans.common import source_columns
from innsight.plans.spec import AnalysisResult, Page
from innsight.sources.catalog import Catalog

# --- fixed values: must equal the analysed system's for the same results -------------------
# Stored column → published name.
SENTIMENT_NAMES = {
    "dimensaonova": "dimension", "taxageraldeadesao": "overall_adherence_rate", "score": "score",
    "hotel": "resort_code", "mes": "month", "ano": "year", "scorehotelsituacao": "score_status", "notas": "scores",
    "lideresdiretos": "direct_leader", "cr": "department", "nivel": "level", "lideranca": "leadership",
    "destinatario": "employee_name", "cargo": "position", "grupos": "groups", "lideres": "leader",
    "status": "status", "dataehora": "timestamp", "egerente": "is_manager",
}
# Request names of the filters.
ALIASES = {"resort": "hotel", "year": "ano", "month": "mes", "setor": "cr", "department": "cr",
           "nome": "destinatario", "employee": "destinatario", "emocionador": "destinatario"}
# Status words → stored survey statuses ("not answered" covers sent and open surveys).
STATUS_CLASSES = {
    "respondido": ("Respondido",),
    "em aberto": ("Em Aberto",),
    "enviado": ("Enviado",),
    "nao respondido": ("Enviado", "Em Aberto"),
    "não respondido": ("Enviado", "Em Aberto"),
}
# --- end of fixed values ------------------------------------------------------------------
TOP_K, TOP_K_NAMED = 5, 100


def _contains(df, col, value, domains):
    return None if value is None or flt.is_all(value) else flt.fold_contains(col, value, df=df, domains=domains)


def _listing(catalog: Catalog, table: str, f: flt.Filters, contains: dict, order, pg: Page, percent=()):
    df, known = catalog.table(table), catalog.domains(table)
    preds = [_contains(df, "hotel", f.resort("hotel", codes=WORKFORCE_CODES), known)]
    preds += [_contains(df, col, f.text(key), known) for key, col in contains.items()]
    preds += [None if f.integer("ano") is None else flt.eq(df, "ano", f.integer("ano")),
              None if f.month("mes") is None else flt.eq(df, "mes", f.month("mes"))]
    filtered = flt.where(df, preds)
    return listing(filtered, list(order) + [("id", "asc")], pg,
                   lambda rows, *extra: rename(percent_columns(rows, percent), SENTIMENT_NAMES, source_columns(df), extra))


def get_resort_adherence(catalog: Catalog, filters: dict, pg: Page) -> AnalysisResult:
    """Q19: adherence rate (as percent) and score per resort and month, latest first."""
    f = flt.Filters(filters, ALIASES)
    return _listing(catalog, "employee_sentiment_by_resort", f, {}, [("ano", "desc"), ("mes", "desc"), ("taxageraldeadesao", "desc")], pg,
                    percent=("taxageraldeadesao",))


def get_department_adherence(catalog: Catalog, filters: dict, pg: Page) -> AnalysisResult:
    """Q20: adherence rate (as percent) and score per department and leader."""
    f = flt.Filters(filters, ALIASES)
    return _listing(catalog, "employee_sentiment_by_department", f, {"cr": "cr", "lider": "lideresdiretos"},
                    [("ano", "desc"), ("mes", "desc"), ("taxageraldeadesao", "desc"), ("cr", "asc")], pg,
                    percent=("taxageraldeadesao",))


def get_survey_status(catalog: Catalog, filters: dict, pg: Page) -> AnalysisResult:
    """Q21: surveys sent to employees with their answer status, latest first."""
    f = flt.Filters(filters, ALIASES)
    contains = {"cr": "cr", "destinatario": "destinatario", "lider": "lideres", "status": "status", "cargo": "cargo"}
    return _listing(catalog, "employee_sentiment_surveys", f, contains, [("dataehora", "desc")], pg)


def rank_by_survey_status(catalog: Catalog, filters: dict, pg: Page | None = None) -> AnalysisResult:
    """Q22: per (year, employee, department) the number of surveys in the status class, the
    resorts and the months involved; ranked per year, top 5 (100 when an employee is named)."""
    f = flt.Filters(filters, ALIASES)
    year, status = f.integer("ano"), f.text("status")
    f.require(ano=year, status=status)
    statuses = STATUS_CLASSES.get(status.lower(), (status,))
    recipient = f.text("destinatario")
    months = f.months("mes")
    df = catalog.table("employee_sentiment_surveys")
    known = catalog.domains("employee_sentiment_surveys")
    filtered = flt.where(df, [
        flt.eq(df, "ano", year), F.col("status").isin(list(statuses)),
        _contains(df, "hotel", f.resort("hotel", codes=WORKFORCE_CODES), known),
        None if recipient is None else flt.fold_contains("destinatario", recipient, df=df, domains=known),
        flt.int_in(df, "mes", months) if months else None,
    ])
    aggregated = filtered.groupBy("ano", "destinatario", "cr").agg(
        distinct_text("hotel").alias("hotel"), F.count(F.lit(1)).alias("total_ocorrencias"),
        distinct_text("mes").alias("meses_ocorrencias"))
    k = TOP_K_NAMED if recipient else TOP_K
    ranked = top_rank(aggregated, ["ano"], [("total_ocorrencias", "desc"), ("destinatario", "asc"), ("cr", "asc")], k)
    rows = ranked.select(
        F.col("ano").alias("year"), F.col("rank_num").cast("bigint").alias("rank_num"),
        F.col("destinatario").alias("employee_name"), F.col("cr").alias("department"),
        F.col("hotel").alias("resort_code"), "total_ocorrencias",
        F.col("meses_ocorrencias").alias("months_of_occurrence"))
    stats = aggregated.agg(F.count(F.lit(1)).alias("total_records"), F.lit(None).cast("string").alias("data_until"))
    return AnalysisResult(rows, stats, None)
