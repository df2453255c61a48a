"""Extra-revenue analyses: record listing (Q09), share of accommodation revenue (Q10), revenue
per guest against targets (Q11a) or per point of sale and month (Q11b), item sales ranking (Q12).

All joins are between aggregates: each side is reduced by a partial ``groupBy`` to at most
(months × categories × points of sale) rows before it meets the other, so the fact tables are
scanned once per side and never joined row by row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from innsight.functions.numeric import money, round_value, safe_ratio
from innsight.operators import filters as flt
from innsight.operators.aggregate import weighted_mean
from innsight.operators.combine import scalar_ratio, segment_join, wide_to_long, with_scalars
from innsight.operators.listing import listing, page, rename
from innsight.plans.common import date_col, source_columns
from innsight.plans.spec import AnalysisResult, Page
from innsight.sources.catalog import Catalog

# Stored column → published name; the listing returns every column.
EXTRA_REVENUE_NAMES = {
    "id": "id", "resort": "resort_code", "mes": "month", "pdv": "point_of_sale", "categoria": "category",
    "meta": "target", "ano": "year", "data": "date", "hospedes": "guests", "vendatotalpdv": "total_pos_sales",
    "metaano": "year_target", "trimestre": "quarter", "semestre": "semester", "metastrimestre": "quarter_targets",
    "metassemestre": "semester_targets", "dia": "day", "hospmeta": "guest_target",
}
ALIASES = {"resort": "hotel", "unidade": "hotel", "mes": "mes", "periodo": "mes", "month": "mes", "year": "ano",
           "day": "dia", "category": "categoria", "order": "ordenacao", "class": "classe"}
CATEGORY_LABELS = {"Lazer": "Leisure", "Eventos": "Events"}
DEC = "decimal(38,4)"  # amounts are added exactly, with four decimals: a currency amount has two


def _per_guest(amount, guests):
    """P5 of an amount per guest: divided in double precision, two decimals."""
    return F.coalesce(round_value(amount.cast("double") / guests.cast("double"), 2), F.lit(0.0))


def _resort_list(f: flt.Filters) -> list[str]:
    return [r for r in f.resorts("hotel")]


def _in_resorts(df, col, resorts):
    """Folded membership of a resort column, dropped when ``all_resorts`` is in the list."""
    if not resorts or any(flt.is_all(r) for r in resorts):
        return None
    return flt.fold_in(df, col, resorts)


def list_extra_revenue_records(catalog: Catalog, filters: dict, pg: Page) -> AnalysisResult:
    """Q09: raw extra-revenue rows of a resort and month, by date then day."""
    f = flt.Filters(filters, ALIASES)
    resort, year, month = f.resort("hotel"), f.integer("ano"), f.month("mes")
    f.require(hotel=resort, ano=year, mes=month)
    df = catalog.table("extra_revenue")
    filtered = flt.where(df, [flt.resort_pred(df, "resort", resort), flt.eq(df, "ano", year),
                              flt.eq(df, "mes", month),
                              None if f.integer("dia") is None else flt.eq(df, "dia", f.integer("dia"))])
    return listing(filtered, [(date_col(df, "data"), "asc"), ("dia", "asc"), ("id", "asc")], pg,
                   lambda rows, *extra: rename(rows, EXTRA_REVENUE_NAMES, source_columns(df), extra))


def calculate_revenue_share(catalog: Catalog, filters: dict, pg: Page | None = None) -> AnalysisResult:
    """Q10: extra revenue ÷ accommodation revenue × 100 for Leisure and Events (always 2 rows);
    the point-of-sale filter applies to extra revenue only."""
    f = flt.Filters(filters, ALIASES)
    resort, year, months = f.resort("hotel"), f.integer("ano"), f.months("mes")
    f.require(hotel=resort, ano=year, mes=months)
    pos = f.items("pdv")

    acc = catalog.table("accommodation_revenue")
    acc_row = flt.where(acc, [flt.resort_pred(acc, "hotel", resort), flt.eq(acc, "ano", year),
                              flt.int_in(acc, "mes", months)]).agg(
        F.sum(F.coalesce(F.col("lazer").cast(DEC), F.lit(0))).alias("acc_Lazer"),
        F.sum(F.coalesce(F.col("eventos").cast(DEC), F.lit(0))).alias("acc_Eventos"))
    ex = catalog.table("extra_revenue")
    sales = F.coalesce(F.col("vendatotalpdv").cast(DEC), F.lit(0))
    ex_row = flt.where(ex, [flt.resort_pred(ex, "resort", resort), flt.eq(ex, "ano", year),
                            flt.int_in(ex, "mes", months), flt.fold_in(ex, "pdv", pos) if pos else None]).agg(
        *[F.sum(F.when(F.col("categoria") == cat, sales)).alias(f"ex_{cat}") for cat in CATEGORY_LABELS])
    one = scalar_ratio(acc_row, ex_row)
    per_cat = [F.struct(F.lit(label).alias("category"),
                        F.coalesce(F.col(f"acc_{cat}"), F.lit(0)).alias("acc"),
                        F.coalesce(F.col(f"ex_{cat}"), F.lit(0)).alias("ex"))
               for cat, label in CATEGORY_LABELS.items()]
    rows = one.select(F.inline(F.array(*per_cat))).select(
        "category", money("acc").alias("accommodation_revenue"), money("ex").alias("extra_revenue"),
        safe_ratio("ex", "acc").alias("extra_revenue_share_percentage"))
    stats = rows.agg(F.count(F.lit(1)).alias("total_records"), F.lit(None).cast("string").alias("data_until"))
    return AnalysisResult(rows, stats, None)


def compare_extra_revenue_per_guest(catalog: Catalog, filters: dict, pg: Page | None = None) -> AnalysisResult:
    """Q11: without ``pdv`` (Q11a) per category revenue per guest vs the guest-weighted target;
    with ``pdv`` (Q11b) per point of sale and category one column per month plus a period total."""
    f = flt.Filters(filters, ALIASES)
    resorts, year, months = _resort_list(f), f.integer("ano"), sorted(f.months("mes"))
    f.require(hotel=resorts, ano=year, mes=months)
    pos = f.items("pdv")
    if pos:
        return _per_pos(catalog, resorts, year, months, pos)
    days = sorted({int(d) for d in f.items("dia") if d.isdigit()})
    return _per_category(catalog, resorts, year, months, days)


def _per_category(catalog, resorts, year, months, days):
    occ = catalog.table("daily_occupancy")
    occ_preds = [_in_resorts(occ, "resort", resorts), flt.eq(occ, "ano", year), flt.int_in(occ, "mes", months),
                 flt.int_in(occ, "dia", days) if days else None]
    guests = wide_to_long(
        flt.where(occ, occ_preds).agg(F.sum(F.coalesce("lazer", F.lit(0))).alias("g_lazer"),
                                      F.sum(F.coalesce("eventos", F.lit(0))).alias("g_eventos")),
        [], {"g_lazer": "Lazer", "g_eventos": "Eventos"}, "categoria", "guests")
    ex = catalog.table("extra_revenue")
    ex_preds = [_in_resorts(ex, "resort", resorts), flt.eq(ex, "ano", year), flt.int_in(ex, "mes", months),
                flt.int_in(ex, "dia", days) if days else None]
    revenue = flt.where(ex, ex_preds).groupBy("categoria").agg(
        F.sum(F.coalesce(F.col("vendatotalpdv").cast(DEC), F.lit(0))).alias("revenue"))
    actual = guests.join(revenue, "categoria", "left")

    mt, gt = catalog.table("monthly_extra_revenue_targets"), catalog.table("guest_targets")
    monthly = flt.where(mt, [flt.eq(mt, "ano", year), _in_resorts(mt, "resort", resorts),
                             flt.int_in(mt, "mes", months)]) \
        .groupBy("mes", "resort", "categoria").agg(F.sum(F.col("meta").cast(DEC)).alias("sum_target_month"))
    weights = flt.where(gt, [flt.eq(gt, "ano", year), _in_resorts(gt, "resort", resorts),
                             flt.int_in(gt, "mes", months)]).select("mes", "resort", "categoria", "hospmeta")
    target = monthly.join(weights, ["mes", "resort", "categoria"]).groupBy("categoria").agg(
        weighted_mean("sum_target_month", "hospmeta").alias("target"))

    # Categories with actuals but no target and targets without actuals both appear.
    both = actual.join(target, "categoria", "full_outer")
    rows = both.select(
        F.col("categoria").alias("category"),
        F.when(F.coalesce("guests", F.lit(0)) > 0,
               _per_guest(F.col("revenue"), F.col("guests"))).otherwise(F.lit(0.0))
        .alias("revenue_per_guest_actual"),
        F.coalesce(round_value("target", 2), F.lit(0.0)).alias("revenue_per_guest_target")).orderBy(F.col("category").asc_nulls_last())
    stats = rows.agg(F.count(F.lit(1)).alias("total_records"), F.lit(None).cast("string").alias("data_until"))
    return AnalysisResult(rows, stats, None)


def _per_pos(catalog, resorts, year, months, pos):
    occ = catalog.table("daily_occupancy")
    monthly_guests = flt.where(occ, [flt.eq(occ, "ano", year), _in_resorts(occ, "resort", resorts),
                                     flt.int_in(occ, "mes", months)]) \
        .groupBy(F.col("mes").cast("bigint").alias("mes")).agg(
            F.sum(F.coalesce("lazer", F.lit(0))).alias("Lazer"), F.sum(F.coalesce("eventos", F.lit(0))).alias("Eventos"))
    guests = wide_to_long(monthly_guests, ["mes"], {c: c for c in CATEGORY_LABELS}, "categoria", "guests") \
        .where(F.col("guests") > 0)

    ex = catalog.table("extra_revenue")
    pos_key = flt.folded(ex, "pdv")
    sales = flt.where(ex, [flt.eq(ex, "ano", year), _in_resorts(ex, "resort", resorts),
                           flt.int_in(ex, "mes", months), flt.fold_in(ex, "pdv", pos)]) \
        .groupBy(F.col("mes").cast("bigint").alias("mes"), pos_key.alias("pdv_key"), "categoria").agg(
            F.sum(F.coalesce(F.col("vendatotalpdv").cast(DEC), F.lit(0))).alias("sales"),
            F.min("pdv").alias("pdv_name"))
    joined = segment_join(guests, sales, ["mes", "categoria"])
    ratio = _per_guest(F.col("sales"), F.col("guests"))
    month_cols = [F.coalesce(F.max(F.when(F.col("mes") == m, ratio)), F.lit(0.0)).alias(f"actual_month_{m}")
                  for m in months]
    extra = []
    if len(months) > 1:
        extra = [F.when(F.sum("guests") > 0,
                        _per_guest(F.sum("sales"), F.sum("guests")))
                 .otherwise(F.lit(0.0)).alias("total")]
    grouped = joined.groupBy("pdv_key", "categoria").agg(F.initcap(F.min("pdv_name")).alias("point_of_sale"),
                                                         *month_cols, *extra)
    rows = grouped.select("point_of_sale", F.col("categoria").alias("category"),
                          *[f"actual_month_{m}" for m in months], *(["total"] if extra else [])) \
        .orderBy("point_of_sale", "category")
    stats = rows.agg(F.count(F.lit(1)).alias("total_records"), F.lit(None).cast("string").alias("data_until"))
    return AnalysisResult(rows, stats, None)


def analyze_item_sales(catalog: Catalog, filters: dict, pg: Page) -> AnalysisResult:
    """Q12: per item Σ value and Σ quantity (items with positive value), value per guest of the
    chosen category; empty when there are no guests. Sorted by total value (``menor`` → ascending)."""
    f = flt.Filters(filters, ALIASES)
    resort, year, months = f.resort("hotel"), f.integer("ano"), sorted(f.months("mes"))
    f.require(hotel=resort, ano=year, mes=months)
    days = sorted({int(d) for d in f.items("dia") if d.isdigit()})
    category = (f.text("categoria") or "").lower()
    if "lazer" in category:
        guest_cols, categories = ["lazer"], ["lazer"]
    elif "eventos" in category:
        guest_cols, categories = ["eventos"], ["eventos"]
    else:
        guest_cols, categories = ["lazer", "eventos"], ["lazer", "eventos"]
    descending = (f.text("ordenacao") or "maior").lower() != "menor"

    # A year with no item sales at all is missing data, not an empty ranking. Metadata tells, or
    # else the stats row does when it is read.
    items, year_known = catalog.of_year("pos_item_sales", year)
    occ = catalog.table("daily_occupancy")
    guest_expr = sum((F.coalesce(F.col(c), F.lit(0)) for c in guest_cols[1:]), F.coalesce(F.col(guest_cols[0]), F.lit(0)))
    guests = flt.where(occ, [flt.resort_pred(occ, "resort", resort), flt.eq(occ, "ano", year),
                             flt.int_in(occ, "mes", months), flt.int_in(occ, "dia", days) if days else None]) \
        .agg(F.coalesce(F.sum(guest_expr), F.lit(0)).alias("total_guests"))

    preds = [flt.eq(items, "ano", year), flt.resort_pred(items, "hotel", resort), flt.int_in(items, "mes", months),
             flt.fold_in(items, "categoria", categories),
             flt.int_in(items, "dia", days) if days else None,
             flt.fold_in(items, "pdv", f.items("pdv")) if f.items("pdv") else None,
             flt.fold_in(items, "classe", f.items("classe")) if f.items("classe") else None]
    per_item = flt.where(items, preds).groupBy(F.col("itemcomanda").alias("item")).agg(
        F.sum(F.coalesce(F.col("valorcomanda").cast(DEC), F.lit(0))).alias("total_venda"),
        F.sum(F.coalesce(F.col("qtdeitemcomanda"), F.lit(0))).alias("total_quantity")) \
        .where(F.col("total_venda") > 0)
    with_guests = with_scalars(per_item, guests).where(F.col("total_guests") > 0)
    direction = "desc" if descending else "asc"
    ranked = page(with_guests, [("total_venda", direction), ("item", "asc")], pg)
    rows = ranked.select(
        "item", F.col("total_quantity").cast("bigint").alias("total_quantity"),
        money("total_venda").alias("total_sales"),
        _per_guest(F.col("total_venda"), F.col("total_guests")).alias("sales_per_guest"))
    stats = with_guests.agg(F.count(F.lit(1)).alias("total_records"), F.lit(None).cast("string").alias("data_until"))
    if not year_known:
        stats = with_scalars(stats, flt.where(items, [flt.eq(items, "ano", year)]).limit(1)
                             .agg((F.count(F.lit(1)) > 0).alias("source_found")))
    return AnalysisResult(rows, stats, pg)


__all__ = ["list_extra_revenue_records", "calculate_revenue_share", "compare_extra_revenue_per_guest",
           "analyze_item_sales"]
