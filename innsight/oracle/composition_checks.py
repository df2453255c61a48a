"""Registered checks of the membership, shape, aggregate, join, rank and paging operators, each
applied on its own to whole bound tables; the SQL states the same rule independently.

Each entry is ``key -> (callable(spark, sf_dir) -> DataFrame, DuckDB SQL)``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from innsight.functions.numeric import money, percent_columns, round_value, safe_ratio
from innsight.functions.text import classes_of, fold, fold_py
from innsight.operators import filters as flt
from innsight.operators.aggregate import distinct_text, ranked_count, weighted_mean, with_total
from innsight.operators.combine import full_balance, scalar_ratio, segment_join, wide_to_long
from innsight.operators.listing import iso_date, page
from innsight.operators.rank import top_rank
from innsight.operators.shape import explode_pairs, month_pivot, nest_pairs
from innsight.oracle.bindings import fold_sql as sql_fold
from innsight.oracle.bindings import half_even, with_tables as W
from innsight.plans.common import date_col, max_iso
from innsight.plans.indicators import INDICATOR_NAMES, indicator_columns, period_code_column
from innsight.plans.sentiment import STATUS_CLASSES
from innsight.plans.spec import Page
from innsight.sources.testdata import testdata_catalog

DEC = "decimal(38,4)"
PERIOD_WORDS = ("1st Semester", " first semester ", "2ND SEMESTER", "ytd", "Total Year", "annual", "Full year", "H1", "7")
# One spelling per class (the accented and plain spellings of a class name are one class).
CLASSES = {k: v for k, v in STATUS_CLASSES.items() if k == fold_py(k)}
MONTHS = list(range(1, 13))


def _t(spark, sf_dir, name):
    return testdata_catalog(spark, sf_dir).table(name)


# --- membership and post-aggregate filters ---------------------------------------------------

def f07_in(spark, sf_dir):
    """plain membership of a status list and of a month list."""
    s = _t(spark, sf_dir, "employee_sentiment_surveys")
    return s.where(F.col("status").isin(list(CLASSES["nao respondido"])) & flt.int_in(s, "mes", [1, 2, 3])) \
        .groupBy("hotel", "ano").agg(F.count(F.lit(1)).alias("n"))


def f13_having(spark, sf_dir):
    """groups kept by a predicate on their aggregate (positive balances per employee)."""
    eb = _t(spark, sf_dir, "employee_overtime_balance")
    return eb.groupBy("hotel", "nome").agg(F.sum(F.col("horas").cast("decimal(38,6)")).alias("total_horas")) \
        .where(F.col("total_horas") > 0).select("hotel", "nome", F.col("total_horas").cast("double"))


def n08_status_class(spark, sf_dir):
    """Every survey counted once per status class that holds its status."""
    s = _t(spark, sf_dir, "employee_sentiment_surveys")
    return s.select("ano", F.explode(classes_of("status", CLASSES)).alias("status_class")) \
        .groupBy("status_class", "ano").agg(F.count(F.lit(1)).alias("n"))


def n07_period_map(spark, sf_dir):
    """Period words of whole tables to their codes; other values stay. The order month gives a word or number."""
    o = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    words = F.array(*[F.lit(w) for w in PERIOD_WORDS])
    word = F.get(words, F.pmod(F.col("o_orderkey"), F.lit(len(PERIOD_WORDS))).cast("int"))
    return o.select(word.alias("period")).groupBy("period").agg(F.count(F.lit(1)).alias("n")) \
        .select("period", period_code_column("period").alias("code"), "n")


def p03_indicator_map(spark, sf_dir):
    """Every indicator pair of the whole table in its long form."""
    df = _t(spark, sf_dir, "business_indicators")
    nested = df.select("id", nest_pairs(indicator_columns(df.columns)).alias("indicators"))
    return explode_pairs(nested, "indicators", ["id"])


# --- output projections ----------------------------------------------------------------------

def p04_percent(spark, sf_dir):
    """Rates as percent with two decimals (only numeric columns are scaled)."""
    r = _t(spark, sf_dir, "employee_sentiment_by_resort")
    return percent_columns(r.select("id", "taxageraldeadesao", "score", "notas"),
                           ["taxageraldeadesao", "score", "notas"])


def p05_rounded(spark, sf_dir):
    """P5: money presentation of sums (null → 0, two decimals) per resort, year and point of sale."""
    ex = _t(spark, sf_dir, "extra_revenue")
    return ex.groupBy("resort", "ano", flt.folded(ex, "pdv").alias("pdv_key")).agg(
        money(F.sum(F.col("vendatotalpdv").cast(DEC))).alias("total_sales"))


def p06_title(spark, sf_dir):
    """Title case of names (words split by spaces)."""
    p = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    return p.select("p_partkey", F.initcap("p_name").alias("name_title"), F.initcap("p_brand").alias("brand_title"))


# --- aggregates ------------------------------------------------------------------------------

def a08_distinct_text(spark, sf_dir):
    """Distinct months and resorts per (year, department) as text, text-ordered."""
    s = _t(spark, sf_dir, "employee_sentiment_surveys")
    return s.groupBy("ano", "cr").agg(distinct_text("mes").alias("months"), distinct_text("hotel").alias("resorts"))


def a11_total_row(spark, sf_dir):
    """Feedback per (resort, type) plus one total row, from one grouping-sets aggregate."""
    gf = _t(spark, sf_dir, "guest_feedback")
    return with_total(gf, ["hotel", "tipocomentario"], {"n": F.count(F.lit(1))}, "hotel", "OVERALL TOTAL")


def _target_join(spark, sf_dir):
    mt, gt = _t(spark, sf_dir, "monthly_extra_revenue_targets"), _t(spark, sf_dir, "guest_targets")
    keys = ["ano", "mes", "resort", "categoria"]
    monthly = mt.groupBy(*keys).agg(F.sum(F.col("meta").cast(DEC)).alias("sum_target_month"))
    return monthly.join(gt.select(*keys, "hospmeta"), keys)


def j03_target_join(spark, sf_dir):
    """Summed monthly targets joined to guest targets on (year, month, resort, category)."""
    return _target_join(spark, sf_dir).select(
        "ano", "mes", "resort", "categoria", F.col("sum_target_month").cast("double").alias("sum_target_month"),
        "hospmeta")


def a14_weighted_mean(spark, sf_dir):
    """Guest-weighted mean of the monthly targets per (year, category)."""
    j = _target_join(spark, sf_dir)
    return j.groupBy("ano", "categoria").agg(
        round_value(weighted_mean("sum_target_month", "hospmeta"), 4)
        .alias("weighted_target"))


def a15_safe_ratio(spark, sf_dir):
    """Events guests per 100 leisure guests per resort-month; 0 when there are none."""
    occ = _t(spark, sf_dir, "daily_occupancy")
    g = occ.groupBy("resort", "ano", "mes").agg(F.sum("eventos").alias("e"), F.sum("lazer").alias("l"))
    return g.select("resort", "ano", "mes", safe_ratio("e", "l").alias("events_per_100_leisure"))


def a17_month_pivot(spark, sf_dir):
    """Sales per (year, category) spread over twelve month columns, 0 where a month is empty."""
    ex = _t(spark, sf_dir, "extra_revenue")
    out = month_pivot(ex, ["ano", "categoria"], "mes", MONTHS, F.sum(F.col("vendatotalpdv").cast(DEC)),
                      prefix="sales_month_", fill=0)
    return out.select("ano", "categoria", *[F.col(f"sales_month_{m}").cast("double") for m in MONTHS])


# --- joins and set shapes --------------------------------------------------------------------

def j01_full_balance(spark, sf_dir):
    """Σ positive and Σ negative hours per (folded department, year), full outer, missing = 0."""
    pos, neg = _t(spark, sf_dir, "overtime_positive"), _t(spark, sf_dir, "overtime_negative")

    def side(df, measure):
        return df.groupBy(F.trim(fold("cr")).alias("cr_key"), "ano").agg(F.sum(measure).alias(measure))

    return full_balance(side(pos, "horaspositiva"), side(neg, "horasnegativas"), ["cr_key", "ano"],
                        ["horaspositiva"], ["horasnegativas"])


def j05_segment_join(spark, sf_dir):
    """Guests per (year, month) unpivoted to categories, joined to sales per category; months
    without guests of a category are dropped."""
    occ, ex = _t(spark, sf_dir, "daily_occupancy"), _t(spark, sf_dir, "extra_revenue")
    monthly = occ.groupBy("ano", "mes").agg(F.sum("lazer").alias("g_lazer"), F.sum("eventos").alias("g_eventos"))
    guests = wide_to_long(monthly, ["ano", "mes"], {"g_lazer": "Lazer", "g_eventos": "Eventos"},
                          "categoria", "guests").where(F.col("guests") > 0)
    sales = ex.groupBy("ano", "mes", "categoria").agg(F.sum(F.col("vendatotalpdv").cast(DEC)).alias("sales"))
    joined = segment_join(guests, sales, ["ano", "mes", "categoria"])
    return joined.select("ano", "mes", "categoria", F.col("sales").cast("double").alias("sales"), "guests",
                         safe_ratio("sales", "guests", scale=1.0).alias("sales_per_guest"))


def u02_outer_categories(spark, sf_dir):
    """Revenue and guest targets per (year, month, category); keys on either side only appear
    with 0 for the missing measure."""
    ex, gt = _t(spark, sf_dir, "extra_revenue"), _t(spark, sf_dir, "guest_targets")
    keys = ["ano", "mes", "categoria"]
    actual = ex.groupBy(*keys).agg(F.sum(F.col("vendatotalpdv").cast(DEC)).cast("double").alias("revenue"))
    target = gt.groupBy(*keys).agg(F.sum("hospmeta").alias("hospmeta"))
    return full_balance(actual, target, keys, ["revenue"], ["hospmeta"])


# --- ranking and paging ----------------------------------------------------------------------

def w01_top_rank(spark, sf_dir):
    """The three best-selling items of every year (row number over the yearly item totals)."""
    items = _t(spark, sf_dir, "pos_item_sales")
    totals = items.groupBy("ano", F.col("itemcomanda").alias("item")).agg(
        F.sum(F.col("valorcomanda").cast(DEC)).alias("total"))
    ranked = top_rank(totals, ["ano"], [("total", "desc"), ("item", "asc")], 3)
    return ranked.select("ano", F.col("rank_num").cast("bigint"), "item", F.col("total").cast("double"))


def l03_page(spark, sf_dir):
    """L3: third page of 20 extra-revenue rows by sales, largest first (id breaks ties)."""
    ex = _t(spark, sf_dir, "extra_revenue")
    rows = page(ex, [("vendatotalpdv", "desc"), ("id", "asc")], Page(limit=20, number=3))
    return rows.select("id", "resort", "pdv", "vendatotalpdv")


# --- freshness, ranked counts, scalar combination, unpivot, null order -------------------------

def a06_oldest_freshness(spark, sf_dir):
    """A6 + P9: per resort the latest feedback and occupancy dates (ISO text) and the older of
    the two (NULL-tolerant)."""
    gf, occ = _t(spark, sf_dir, "guest_feedback"), _t(spark, sf_dir, "daily_occupancy")
    fb = gf.groupBy(F.col("hotel").alias("resort")).agg(max_iso(gf, "datapreenchimento").alias("feedback_until"))
    oc = occ.groupBy("resort").agg(max_iso(occ, "data").alias("occupancy_until"))
    both = fb.join(oc, "resort", "full_outer")
    return both.select("resort", "feedback_until", "occupancy_until",
                       F.least("feedback_until", "occupancy_until").alias("data_until"))


def a09_ranked_count(spark, sf_dir):
    """Comments per non-empty keyword over the whole table, first page by count."""
    gf = _t(spark, sf_dir, "guest_feedback")
    counted = ranked_count(gf.where(flt.not_blank("palavrachave")), "palavrachave", "keyword")
    return page(counted, [("total", "desc"), ("keyword", "asc")], Page(limit=20))


def j04_scalar_ratio(spark, sf_dir):
    """Two independent one-row aggregates (all complaints, all guests) combined 1 × 1."""
    gf, occ = _t(spark, sf_dir, "guest_feedback"), _t(spark, sf_dir, "daily_occupancy")
    complaints = gf.where(F.col("tipocomentario") == F.lit("Reclamação")).agg(
        F.count(F.lit(1)).alias("total_complaints"))
    guests = occ.agg(F.coalesce(F.sum("hosptotal"), F.lit(0)).alias("total_guests"))
    return scalar_ratio(complaints, guests).select(
        "total_complaints", "total_guests",
        safe_ratio("total_complaints", "total_guests").alias("complaints_per_100_guests"))


def j06_wide_to_long(spark, sf_dir):
    """Accommodation revenue columns (leisure, events) as one row per category."""
    acc = _t(spark, sf_dir, "accommodation_revenue")
    return wide_to_long(acc, ["hotel", "ano", "mes"], {"lazer": "Lazer", "eventos": "Eventos"}, "categoria", "revenue")


def l01_null_order(spark, sf_dir):
    """L1: distinct keywords descending, NULL first (the analysed database's DESC order), first
    page of 10."""
    gf = _t(spark, sf_dir, "guest_feedback")
    keywords = gf.select(F.col("palavrachave").alias("keyword")).distinct()
    return page(keywords, [("keyword", "desc")], Page(limit=10))


def p09_iso_dates(spark, sf_dir):
    """Freshness as ISO date text per resort and year, from text timestamps."""
    gf = _t(spark, sf_dir, "guest_feedback")
    return gf.groupBy("hotel", "ano").agg(iso_date(F.max(date_col(gf, "datapreenchimento"))).alias("data_until"))


# --- SQL ---------------------------------------------------------------------------------------

_CLASS_VALUES = ", ".join(f"('{k}', '{v}')" for k, vs in CLASSES.items() for v in vs)
_PIVOT = ", ".join(f"CAST(coalesce(sum(CAST(vendatotalpdv AS DECIMAL(38,4))) FILTER (WHERE mes = {m}), 0) AS DOUBLE)"
                   f" AS sales_month_{m}" for m in MONTHS)
_INITCAP = ("array_to_string(list_transform(string_split(lower({c}), ' '), "
            "lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")

CHECKS = {
    "f07_in": (f07_in, W("""
SELECT hotel, ano, count(*) AS n FROM employee_sentiment_surveys
WHERE status IN ('Enviado', 'Em Aberto') AND mes IN (1, 2, 3) GROUP BY 1, 2""", "employee_sentiment_surveys")),
    "f13_having": (f13_having, W("""
SELECT hotel, nome, CAST(sum(CAST(horas AS DECIMAL(38,6))) AS DOUBLE) AS total_horas
FROM employee_overtime_balance GROUP BY 1, 2 HAVING sum(CAST(horas AS DECIMAL(38,6))) > 0""",
                                 "employee_overtime_balance")),
    "n08_status_class": (n08_status_class, W(f"""
WITH c(status_class, status) AS (VALUES {_CLASS_VALUES})
SELECT c.status_class, s.ano, count(*) AS n FROM employee_sentiment_surveys s JOIN c ON s.status = c.status
GROUP BY 1, 2""", "employee_sentiment_surveys")),
    "n07_period_map": (n07_period_map, f"""
WITH w AS (SELECT list_extract([{', '.join(f"'{x}'" for x in PERIOD_WORDS)}], CAST(o_orderkey % {len(PERIOD_WORDS)} AS INTEGER) + 1)
           AS period FROM orders)
SELECT period, CASE WHEN trim(lower(period)) IN ('1st semester', 'first semester') THEN 'H1'
                    WHEN trim(lower(period)) IN ('2nd semester', 'second semester') THEN 'H2'
                    WHEN trim(lower(period)) IN ('year to date', 'ytd', 'total year', 'full year') THEN 'YTD'
                    WHEN trim(lower(period)) = 'annual' THEN 'Annual' ELSE period END AS code, count(*) AS n
FROM w GROUP BY 1, 2"""),
    "p03_indicator_map": (p03_indicator_map, W("\nUNION ALL\n".join(
        f"SELECT id, '{name}' AS indicator, {stem}real AS actual, {stem}meta AS target FROM business_indicators"
        for stem, name in INDICATOR_NAMES.items()), "business_indicators")),
    "p04_percent": (p04_percent, W("""
SELECT id, CAST(printf('%.2f', taxageraldeadesao * 100) AS DOUBLE) AS taxageraldeadesao, CAST(printf('%.2f', score * 100) AS DOUBLE) AS score, notas
FROM employee_sentiment_by_resort""", "employee_sentiment_by_resort")),
    "p05_rounded": (p05_rounded, W(f"""
SELECT resort, ano, {sql_fold('pdv')} AS pdv_key,
       {half_even('coalesce(sum(CAST(vendatotalpdv AS DECIMAL(38,4))), 0)')} AS total_sales
FROM extra_revenue GROUP BY 1, 2, 3""", "extra_revenue")),
    "p06_title": (p06_title, f"""
SELECT p_partkey, {_INITCAP.format(c='p_name')} AS name_title, {_INITCAP.format(c='p_brand')} AS brand_title
FROM part"""),
    "a08_distinct_text": (a08_distinct_text, W("""
SELECT ano, cr, string_agg(DISTINCT CAST(mes AS VARCHAR), ', ' ORDER BY CAST(mes AS VARCHAR)) AS months,
       string_agg(DISTINCT hotel, ', ' ORDER BY hotel) AS resorts
FROM employee_sentiment_surveys GROUP BY 1, 2""", "employee_sentiment_surveys")),
    "a11_total_row": (a11_total_row, W("""
SELECT hotel, tipocomentario, count(*) AS n, 'detail' AS row_kind FROM guest_feedback GROUP BY 1, 2
UNION ALL
SELECT 'OVERALL TOTAL', NULL, count(*), 'total' FROM guest_feedback""", "guest_feedback")),
    "j03_target_join": (j03_target_join, W("""
WITH m AS (SELECT ano, mes, resort, categoria, sum(CAST(meta AS DECIMAL(38,4))) AS s
           FROM monthly_extra_revenue_targets GROUP BY 1, 2, 3, 4)
SELECT m.ano, m.mes, m.resort, m.categoria, CAST(m.s AS DOUBLE) AS sum_target_month, g.hospmeta
FROM m JOIN guest_targets g ON m.ano = g.ano AND m.mes = g.mes AND m.resort = g.resort AND m.categoria = g.categoria""",
                                           "monthly_extra_revenue_targets", "guest_targets")),
    "a14_weighted_mean": (a14_weighted_mean, W("""
WITH m AS (SELECT ano, mes, resort, categoria, sum(CAST(meta AS DECIMAL(38,4))) AS s
           FROM monthly_extra_revenue_targets GROUP BY 1, 2, 3, 4),
j AS (SELECT m.ano, m.categoria, m.s, g.hospmeta FROM m JOIN guest_targets g
      ON m.ano = g.ano AND m.mes = g.mes AND m.resort = g.resort AND m.categoria = g.categoria)
SELECT ano, categoria,
       CASE WHEN sum(hospmeta) > 0
            THEN CAST(printf('%.4f', CAST(sum(s * hospmeta) AS DOUBLE) / CAST(sum(hospmeta) AS DOUBLE)) AS DOUBLE) END AS weighted_target
FROM j GROUP BY 1, 2""", "monthly_extra_revenue_targets", "guest_targets")),
    "a15_safe_ratio": (a15_safe_ratio, W("""
WITH g AS (SELECT resort, ano, mes, sum(eventos) AS e, sum(lazer) AS l FROM daily_occupancy GROUP BY 1, 2, 3)
SELECT resort, ano, mes, CASE WHEN l > 0 THEN CAST(printf('%.2f', CAST(e AS DOUBLE) / CAST(l AS DOUBLE) * 100) AS DOUBLE) ELSE 0.0 END
       AS events_per_100_leisure
FROM g""", "daily_occupancy")),
    "a17_month_pivot": (a17_month_pivot, W(f"""
SELECT ano, categoria, {_PIVOT} FROM extra_revenue GROUP BY 1, 2""", "extra_revenue")),
    "j01_full_balance": (j01_full_balance, W(f"""
WITH p AS (SELECT trim({sql_fold('cr')}) AS k, ano, sum(horaspositiva) AS v FROM overtime_positive GROUP BY 1, 2),
n AS (SELECT trim({sql_fold('cr')}) AS k, ano, sum(horasnegativas) AS v FROM overtime_negative GROUP BY 1, 2)
SELECT coalesce(p.k, n.k) AS cr_key, coalesce(p.ano, n.ano) AS ano, coalesce(p.v, 0) AS horaspositiva,
       coalesce(n.v, 0) AS horasnegativas
FROM p FULL OUTER JOIN n ON p.k = n.k AND p.ano = n.ano""", "overtime_positive", "overtime_negative")),
    "j05_segment_join": (j05_segment_join, W("""
WITH m AS (SELECT ano, mes, CAST(sum(lazer) AS BIGINT) AS gl, CAST(sum(eventos) AS BIGINT) AS ge
           FROM daily_occupancy GROUP BY 1, 2),
g AS (SELECT ano, mes, 'Lazer' AS categoria, gl AS guests FROM m UNION ALL
      SELECT ano, mes, 'Eventos', ge FROM m),
s AS (SELECT ano, mes, categoria, sum(CAST(vendatotalpdv AS DECIMAL(38,4))) AS sales
      FROM extra_revenue GROUP BY 1, 2, 3)
SELECT s.ano, s.mes, s.categoria, CAST(s.sales AS DOUBLE) AS sales, g.guests,
       CASE WHEN g.guests > 0 THEN CAST(printf('%.2f', CAST(s.sales AS DOUBLE) / CAST(g.guests AS DOUBLE)) AS DOUBLE) ELSE 0.0 END
       AS sales_per_guest
FROM s JOIN g ON s.ano = g.ano AND s.mes = g.mes AND s.categoria = g.categoria WHERE g.guests > 0""",
                                             "daily_occupancy", "extra_revenue")),
    "u02_outer_categories": (u02_outer_categories, W("""
WITH a AS (SELECT ano, mes, categoria, CAST(sum(CAST(vendatotalpdv AS DECIMAL(38,4))) AS DOUBLE) AS revenue
           FROM extra_revenue GROUP BY 1, 2, 3),
t AS (SELECT ano, mes, categoria, sum(hospmeta) AS hospmeta FROM guest_targets GROUP BY 1, 2, 3)
SELECT coalesce(a.ano, t.ano) AS ano, coalesce(a.mes, t.mes) AS mes, coalesce(a.categoria, t.categoria) AS categoria,
       coalesce(a.revenue, 0) AS revenue, CAST(coalesce(t.hospmeta, 0) AS BIGINT) AS hospmeta
FROM a FULL OUTER JOIN t ON a.ano = t.ano AND a.mes = t.mes AND a.categoria = t.categoria""",
                                                     "extra_revenue", "guest_targets")),
    "w01_top_rank": (w01_top_rank, W("""
WITH t AS (SELECT ano, itemcomanda AS item, sum(CAST(valorcomanda AS DECIMAL(38,4))) AS total
           FROM pos_item_sales GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY ano ORDER BY total DESC NULLS FIRST, item ASC NULLS LAST) AS rank_num
      FROM t)
SELECT ano, rank_num, item, CAST(total AS DOUBLE) AS total FROM r WHERE rank_num <= 3""", "pos_item_sales")),
    "l03_page": (l03_page, W("""
SELECT id, resort, pdv, vendatotalpdv FROM extra_revenue
ORDER BY vendatotalpdv DESC NULLS FIRST, id ASC NULLS LAST LIMIT 20 OFFSET 40""", "extra_revenue")),
    "a06_oldest_freshness": (a06_oldest_freshness, W("""
WITH f AS (SELECT hotel AS resort, substr(max(datapreenchimento), 1, 10) AS feedback_until
           FROM guest_feedback GROUP BY 1),
o AS (SELECT resort, CAST(max(data__date) AS VARCHAR) AS occupancy_until FROM daily_occupancy GROUP BY 1)
SELECT coalesce(f.resort, o.resort) AS resort, feedback_until, occupancy_until,
       least(feedback_until, occupancy_until) AS data_until
FROM f FULL OUTER JOIN o ON f.resort = o.resort""", "guest_feedback", "daily_occupancy")),
    "a09_ranked_count": (a09_ranked_count, W("""
SELECT palavrachave AS keyword, count(*) AS total FROM guest_feedback
WHERE palavrachave IS NOT NULL AND palavrachave <> ''
GROUP BY 1 ORDER BY total DESC NULLS FIRST, keyword ASC NULLS LAST LIMIT 20""", "guest_feedback")),
    "j04_scalar_ratio": (j04_scalar_ratio, W("""
WITH c AS (SELECT count(*) AS n FROM guest_feedback WHERE tipocomentario = 'Reclamação'),
g AS (SELECT CAST(coalesce(sum(hosptotal), 0) AS BIGINT) AS g FROM daily_occupancy)
SELECT n AS total_complaints, g AS total_guests,
       CASE WHEN g > 0 THEN CAST(printf('%.2f', CAST(n AS DOUBLE) / CAST(g AS DOUBLE) * 100) AS DOUBLE) ELSE 0.0 END
       AS complaints_per_100_guests
FROM c, g""", "guest_feedback", "daily_occupancy")),
    "j06_wide_to_long": (j06_wide_to_long, W("""
SELECT hotel, ano, mes, 'Lazer' AS categoria, lazer AS revenue FROM accommodation_revenue
UNION ALL
SELECT hotel, ano, mes, 'Eventos', eventos FROM accommodation_revenue""", "accommodation_revenue")),
    "l01_null_order": (l01_null_order, W("""
SELECT DISTINCT palavrachave AS keyword FROM guest_feedback ORDER BY keyword DESC NULLS FIRST LIMIT 10""",
                                         "guest_feedback")),
    "p09_iso_dates": (p09_iso_dates, W("""
SELECT hotel, ano, substr(max(datapreenchimento), 1, 10) AS data_until FROM guest_feedback GROUP BY 1, 2""",
                                       "guest_feedback")),
}
