"""Closed-period business indicators (Q08): listing nested into ``{indicator: {actual, target}}``."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from innsight.functions.text import month_number_py
from innsight.operators import filters as flt
from innsight.operators.listing import listing
from innsight.operators.shape import nest_pairs
from innsight.plans.spec import AnalysisResult, Page
from innsight.sources.catalog import Catalog

# --- fixed values: must equal the analysed system's for the same results -------------------
# Aggregated-period words → stored period code.
PERIOD_CODES = {
    "1st semester": "H1", "first semester": "H1",
    "2nd semester": "H2", "second semester": "H2",
    "year to date": "YTD", "ytd": "YTD", "total year": "YTD",
    "annual": "Annual", "full year": "YTD",
}
# Stored indicator column stem → published indicator name.
INDICATOR_NAMES = {
    "reclamacao": "complaint", "nps": "nps", "gri": "gri", "receitaextra": "extra_revenue",
    "custodealimentos": "food_cost", "cmvdealimentos": "food_cogs", "custodebebidas": "beverage_cost",
    "cmvdebebidas": "beverage_cogs", "custodeaeb": "fb_cost", "cmvaeb": "fb_cogs",
}
# --- end of fixed values ------------------------------------------------------------------

ORDINALS = str.maketrans("ºª", "oa")
ALIASES = {"resortcode": "hotel", "resort": "hotel", "year": "ano", "month": "mes"}


def period_code(value: str) -> str:
    """Aggregated-period words to their code (``º``/``ª`` read as o/a); others unchanged."""
    word = value.strip().lower().translate(ORDINALS)
    return PERIOD_CODES[word] if word in PERIOD_CODES else value


def period_code_column(c: str | Column) -> Column:
    """N7 as a column (standardising a stored period column with the same map as filter values);
    the value is trimmed of spaces before the lookup, others are kept unchanged."""
    col = F.col(c) if isinstance(c, str) else c
    key = F.translate(F.trim(F.lower(col)), "ºª", "oa")
    pairs = [x for k, v in PERIOD_CODES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), col)


def indicator_columns(columns: Sequence[str]) -> dict[str, tuple[str | None, str | None]]:
    """Published indicator → its (actual, target) columns among ``columns``; a missing one is None. Columns that
    are already named ``<indicator>_actual``/``<indicator>_target`` count as well, known or not."""
    present = set(columns)
    pairs = {name: tuple(c if c in present else None for c in (stem + "real", stem + "meta"))
             for stem, name in INDICATOR_NAMES.items()}
    for name in dict.fromkeys(c[:-len("_actual")] for c in columns if c.endswith(("_actual", "_target"))):
        pairs[name] = tuple(new if new in present else old for new, old in
                            zip((name + "_actual", name + "_target"), pairs.get(name, (None, None))))
    return {name: pair for name, pair in pairs.items() if any(pair)}


def get_closed_period_indicators(catalog: Catalog, filters: dict, pg: Page) -> AnalysisResult:
    """Q08: indicator rows of one resort/year/period, each row nested as
    ``(year, resort_code, period, status='closed', indicators map)``."""
    f = flt.Filters(filters, ALIASES)
    df = catalog.table("business_indicators")
    period = f.text("period")
    if period is not None:
        period = period_code(period)
    elif f.text("mes") is not None:
        m = month_number_py(f.text("mes"))
        period = str(m)
    resort = f.resort("hotel")
    year = f.integer("ano")
    filtered = flt.where(df, [
        flt.resort_pred(df, "hotel", resort),
        None if year is None else flt.int_eq(df, "ano", year),
        None if period is None else F.col("periodo") == F.lit(period),
    ])
    def nested(rows, *extra):
        return rows.select(F.col("ano").alias("year"), F.col("hotel").alias("resort_code"), F.col("periodo").alias("period"),
                           F.lit("closed").alias("status"), nest_pairs(indicator_columns(df.columns)).alias("indicators"), *extra)
    return listing(filtered, [("ano", "asc"), ("periodo", "asc"), ("id", "asc")], pg, nested)
