"""Guest-feedback analyses: listing (Q04), count by type (Q05), keyword ranking (Q06),
search by classified keyword (Q07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from innsight.operators import filters as flt
from innsight.operators.aggregate import ranked_count
from innsight.operators.listing import listing, page, rename
from innsight.plans.common import date_col
from innsight.plans.spec import AnalysisResult, Page
from innsight.sources.catalog import Catalog

# Stored column → published name, of the columns that the listings return.
FEEDBACK_NAMES = {
    "datapreenchimento": "submission_date", "hotel": "resort_code", "cr": "cost_center", "predio": "building",
    "tipocomentario": "feedback_type", "palavrachave": "keyword", "nota": "score", "comentario": "comment",
    "ano": "year", "mes": "month", "dia": "day",
}
ALIASES = {
    "resort": "hotel", "unit": "hotel", "month": "mes", "period": "mes", "year": "ano", "building": "predio",
    "feedbacktype": "tipocomentario", "keyword": "palavrachave", "specifickeyword": "palavrachave",
}
TEXT_FILTERS = ("tipocomentario", "palavrachave", "cr", "predio")


def _preds(df, f: flt.Filters, text_keys=TEXT_FILTERS, day=True):
    preds = [flt.resort_pred(df, "hotel", f.resort("hotel"))]
    preds += [flt.fold_eq(df, k, f.text(k)) for k in text_keys if f.text(k) is not None]
    for key, value in (("ano", f.integer("ano")), ("mes", f.month("mes")), ("dia", f.integer("dia") if day else None)):
        if value is not None:
            preds.append(flt.eq(df, key, value))
    return preds


def list_guest_feedback(catalog: Catalog, filters: dict, pg: Page) -> AnalysisResult:
    """Q04: filtered comments, newest first; the freshness date is repeated on every row."""
    f = flt.Filters(filters, ALIASES)
    df = catalog.table("guest_feedback")
    filtered = flt.where(df, _preds(df, f))
    cols = ["datapreenchimento", "hotel", "cr", "predio", "tipocomentario", "palavrachave", "nota", "comentario",
            "ano", "mes", "dia"]
    return listing(filtered, [(date_col(df, "datapreenchimento"), "desc"), ("id", "asc")], pg,
                   lambda rows, *extra: rename(rows, FEEDBACK_NAMES, cols, extra), date_col(df, "datapreenchimento"), ["data_until"])


def _ranked(df, filtered, key, key_alias, pg):
    grouped = ranked_count(filtered, key, key_alias, _last=F.max(date_col(df, "datapreenchimento")))
    order = [("total", "desc"), (key_alias, "asc")]
    rows = page(grouped.select(key_alias, "total"), order, pg)
    stats = grouped.agg(F.count(key_alias).alias("total_records"),
                        F.substring(F.max("_last").cast("string"), 1, 10).alias("data_until"))
    return AnalysisResult(rows, stats, pg, order=order)


def count_feedback_by_type(catalog: Catalog, filters: dict, pg: Page) -> AnalysisResult:
    """Q05: comments per feedback type, most frequent first; total = distinct types."""
    f = flt.Filters(filters, ALIASES)
    f.require(hotel=f.resort("hotel"), ano=f.integer("ano"), mes=f.month("mes"))
    df = catalog.table("guest_feedback")
    filtered = flt.where(df, _preds(df, f, text_keys=("predio", "cr"), day=False))
    return _ranked(df, filtered, "tipocomentario", "feedback_type", pg)


def rank_by_keyword(catalog: Catalog, filters: dict, pg: Page) -> AnalysisResult:
    """Q06: comments per non-empty classified keyword, most frequent first."""
    f = flt.Filters(filters, ALIASES)
    f.require(hotel=f.resort("hotel"), ano=f.integer("ano"), mes=f.month("mes"))
    df = catalog.table("guest_feedback")
    filtered = flt.where(df, _preds(df, f, text_keys=("tipocomentario", "cr", "predio"), day=False)
                         + [flt.not_blank("palavrachave")])
    return _ranked(df, filtered, "palavrachave", "keyword", pg)


def search_feedback_by_keyword(catalog: Catalog, filters: dict, pg: Page) -> AnalysisResult:
    """Q07: comments whose classified keyword equals the given one (folded), newest first."""
    f = flt.Filters(filters, ALIASES)
    f.require(hotel=f.resort("hotel"), ano=f.integer("ano"), mes=f.month("mes"), palavrachave=f.text("palavrachave"))
    df = catalog.table("guest_feedback")
    filtered = flt.where(df, _preds(df, f, day=False))
    cols = ["datapreenchimento", "hotel", "cr", "predio", "tipocomentario", "nota", "comentario", "palavrachave",
            "ano", "mes"]
    return listing(filtered, [(date_col(df, "datapreenchimento"), "desc"), ("id", "asc")], pg,
                   lambda rows, *extra: rename(rows, FEEDBACK_NAMES, cols, extra), date_col(df, "datapreenchimento"))


__all__ = ["list_guest_feedback", "count_feedback_by_type", "rank_by_keyword", "search_feedback_by_keyword"]
