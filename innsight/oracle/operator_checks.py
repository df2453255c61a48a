"""Registered checks of single operators and of result statistics, on whole bound tables.

Each entry is ``key -> (callable(spark, sf_dir) -> DataFrame, DuckDB SQL)``. The operators are
applied exactly as the analyses apply them; the SQL states the rule independently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from innsight.functions.text import MONTH_NUMBERS, RESORT_CODES, canonical_code, month_number
from innsight.functions.text import fold as fold_col
from innsight.operators import filters as flt
from innsight.oracle.bindings import fold_sql as fold
from innsight.oracle.bindings import with_tables as W
from innsight.plans.registry import run
from innsight.sources.testdata import testdata_catalog


def _table(spark, sf_dir, name):
    return testdata_catalog(spark, sf_dir).table(name)


def f01_fold_equal(spark, sf_dir):
    gf = _table(spark, sf_dir, "guest_feedback")
    return gf.where(flt.fold_eq(gf, "cr", "RECEPÇÃO")).select("id", "hotel", "cr")


def f02_fold_contains(spark, sf_dir):
    ma = _table(spark, sf_dir, "medical_attendances")
    return ma.where(flt.fold_contains("ocorrenciaqueixa", "ÁUSE")).select("id", "ocorrenciaqueixa")


def f03_trim_fold_contains(spark, sf_dir):
    eb = _table(spark, sf_dir, "employee_overtime_balance")
    return eb.where(flt.trim_fold_contains("nome", "CUSTOMER#00000001")).select("id", "nome", "horas")


def f04_trim_fold_equal(spark, sf_dir):
    op = _table(spark, sf_dir, "overtime_positive")
    return op.where(flt.trim_fold_eq(op, "cr", " small ")).select("id", "cr", "horaspositiva")


def f06_cast_equal(spark, sf_dir):
    occ = _table(spark, sf_dir, "daily_occupancy")
    return occ.where(flt.int_eq(occ, "mes", 7) & flt.eq(occ, "ano", "1997")).select("id", "hosptotal")


def f08_fold_in(spark, sf_dir):
    ex = _table(spark, sf_dir, "extra_revenue")
    return ex.where(flt.int_in(ex, "mes", [1, 2, 3]) & flt.fold_in(ex, "pdv", ["brand#1", "BRAND#2", "Brand#3"])) \
        .select("id", "pdv", "mes")


def f09_bounds(spark, sf_dir):
    eb = _table(spark, sf_dir, "employee_overtime_balance")
    return eb.where(flt.at_least("horas", 100) | flt.at_most("horas", -100)).select("id", "horas")


def f10_not_blank(spark, sf_dir):
    gf = _table(spark, sf_dir, "guest_feedback")
    return gf.where(flt.not_blank("palavrachave")).groupBy("hotel").agg(F.count(F.lit(1)).alias("n"))


def f12_or_contains(spark, sf_dir):
    ma = _table(spark, sf_dir, "medical_attendances")
    patient = F.col("hospedeouemocionador")
    return ma.where(flt.fold_contains(patient, "lazer") | flt.fold_contains(patient, "eventos")) \
        .groupBy("hospedeouemocionador").agg(F.count(F.lit(1)).alias("n"))


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def x02_fold_whole_texts(spark, sf_dir):
    """The case and accent fold of every whole document text (as its SHA-256)."""
    return _documents(spark, sf_dir).select("doc_id", F.sha2(fold_col("text"), 256).alias("folded_sha256"))


# Other spellings of the texts' own letters: decomposed, and letters that do not decompose.
RESPELT = (("é", "e\u0301"), ("ç", "c\u0327"), ("ü", "u\u0308"), ("ö", "ø"), ("ä", "æ"), ("ó", "Œ"), ("ñ", "Ł"), ("th", "þ"))


def _respelt(spark, sf_dir):
    text = F.col("text")
    for old, new in RESPELT:
        text = F.replace(text, F.lit(old), F.lit(new))
    return _documents(spark, sf_dir).withColumn("text", text)


def x02b_fold_other_spellings(spark, sf_dir):
    """The fold of every whole text with decomposed accents and letters that become two."""
    return _respelt(spark, sf_dir).select("doc_id", F.sha2(fold_col("text"), 256).alias("folded_sha256"))


def f01b_fold_equal_other_spellings(spark, sf_dir):
    """The first words of the texts, equal in both spellings."""
    def first(df, name):
        return df.select("doc_id", F.element_at(F.split("text", " "), 1).alias(name))
    both = first(_documents(spark, sf_dir), "plain").join(first(_respelt(spark, sf_dir), "other"), "doc_id")
    return both.groupBy(fold_col("plain").alias("word")).agg(
        F.count_if(fold_col("plain") == fold_col("other")).alias("n_equal"), F.count(F.lit(1)).alias("n"))


def f02b_fold_contains_whole_texts(spark, sf_dir):
    """F2 over whole texts: documents whose folded text contains a folded word."""
    d = _documents(spark, sf_dir)
    return d.where(flt.fold_contains("text", "ÉTÉ")).select("doc_id", "lang")


def n02_canonical_code(spark, sf_dir):
    ma = _table(spark, sf_dir, "medical_attendances")
    return ma.select("hotel", canonical_code("hotel").alias("code")).distinct()


def n03_month_number(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    named = o.select(F.lower(F.date_format("o_orderdate", "MMM")).alias("name"),
                     F.date_format("o_orderdate", "MM").alias("mm"))
    return named.groupBy("name", "mm").agg(F.count(F.lit(1)).alias("n")) \
        .select("name", "mm", month_number("name").alias("from_name"), month_number("mm").alias("from_number"), "n")


def _stats(analysis, filters, page=1, limit=50):
    def fn(spark, sf_dir):
        return run(analysis, filters, testdata_catalog(spark, sf_dir), page=page, limit=limit).stats
    return fn


_MONTHS = ", ".join(f"('{k}', {v})" for k, v in MONTH_NUMBERS.items())
_CODES = " ".join(f"WHEN contains({fold('hotel')}, '{c}') THEN '{c}'" for c in RESORT_CODES)

def _respelt_sql(col: str) -> str:
    for old, new in RESPELT:
        col = f"replace({col}, '{old}', '{new}')"
    return col


CHECKS = {
    "f01_fold_equal": (f01_fold_equal, W(f"""
SELECT id, hotel, cr FROM guest_feedback WHERE {fold('cr')} = 'recepcao'""", "guest_feedback")),
    "f02_fold_contains": (f02_fold_contains, W(f"""
SELECT id, ocorrenciaqueixa FROM medical_attendances WHERE contains({fold('ocorrenciaqueixa')}, 'ause')""",
                                             "medical_attendances")),
    "f03_trim_fold_contains": (f03_trim_fold_contains, W(f"""
SELECT id, nome, horas FROM employee_overtime_balance WHERE contains(trim({fold('nome')}), 'customer#00000001')""",
                                                       "employee_overtime_balance")),
    "f04_trim_fold_equal": (f04_trim_fold_equal, W(f"""
SELECT id, cr, horaspositiva FROM overtime_positive WHERE trim({fold('cr')}) = 'small'""", "overtime_positive")),
    "f06_cast_equal": (f06_cast_equal, W("""
SELECT id, hosptotal FROM daily_occupancy WHERE CAST(mes AS INTEGER) = 7 AND ano = 1997""", "daily_occupancy")),
    "f08_fold_in": (f08_fold_in, W(f"""
SELECT id, pdv, mes FROM extra_revenue
WHERE mes IN (1, 2, 3) AND {fold('pdv')} IN ('brand#1', 'brand#2', 'brand#3')""", "extra_revenue")),
    "f09_bounds": (f09_bounds, W("""
SELECT id, horas FROM employee_overtime_balance
WHERE CAST(round(horas) AS BIGINT) >= 100 OR CAST(round(horas) AS BIGINT) <= -100""", "employee_overtime_balance")),
    "f10_not_blank": (f10_not_blank, W("""
SELECT hotel, count(*) AS n FROM guest_feedback WHERE palavrachave IS NOT NULL AND palavrachave <> ''
GROUP BY hotel""", "guest_feedback")),
    "f12_or_contains": (f12_or_contains, W(f"""
SELECT hospedeouemocionador, count(*) AS n FROM medical_attendances
WHERE contains({fold('hospedeouemocionador')}, 'lazer') OR contains({fold('hospedeouemocionador')}, 'eventos')
GROUP BY 1""", "medical_attendances")),
    "x02_fold_whole_texts": (x02_fold_whole_texts, f"""
SELECT doc_id, sha256({fold('text')}) AS folded_sha256 FROM documents"""),
    "x02b_fold_other_spellings": (x02b_fold_other_spellings, f"""
SELECT doc_id, sha256({fold(_respelt_sql('text'))}) AS folded_sha256 FROM documents"""),
    "f01b_fold_equal_other_spellings": (f01b_fold_equal_other_spellings, f"""
WITH w AS (SELECT {fold("string_split(text, ' ')[1]")} AS word, {fold(f"string_split({_respelt_sql('text')}, ' ')[1]")} AS other FROM documents)
SELECT word, count_if(word = other)::BIGINT AS n_equal, count(*) AS n FROM w GROUP BY word"""),
    "f02b_fold_contains_whole_texts": (f02b_fold_contains_whole_texts, f"""
SELECT doc_id, lang FROM documents WHERE contains({fold('text')}, 'ete')"""),
    "n02_canonical_code": (n02_canonical_code, W(f"""
SELECT DISTINCT hotel, CASE {_CODES} ELSE hotel END AS code FROM medical_attendances""", "medical_attendances")),
    "n03_month_number": (n03_month_number, f"""
WITH m(k, v) AS (VALUES {_MONTHS}),
o AS (SELECT lower(strftime(o_orderdate, '%b')) AS name, strftime(o_orderdate, '%m') AS mm, count(*) AS n
      FROM orders GROUP BY 1, 2)
SELECT name, mm, coalesce((SELECT v FROM m WHERE k = name), TRY_CAST(name AS INTEGER)) AS from_name,
       coalesce((SELECT v FROM m WHERE k = mm), TRY_CAST(mm AS INTEGER)) AS from_number, n
FROM o"""),
    # statistics of results: total counts, freshness and summary columns
    "a16_page_stats_feedback_listing": (_stats("list_guest_feedback", {"hotel": "resort_gamma", "ano": "2024"}), W(f"""
SELECT count(*) AS total_records, substr(max(datapreenchimento), 1, 10) AS data_until
FROM guest_feedback WHERE {fold('hotel')} = 'resort_gamma' AND ano = 2024""", "guest_feedback")),
    "a16_ranked_count_stats_keywords": (_stats("rank_by_keyword", {"hotel": "resort_alpha", "ano": "2024", "mes": "1"}),
                                        W(f"""
SELECT count(DISTINCT palavrachave) AS total_records, substr(max(datapreenchimento), 1, 10) AS data_until
FROM guest_feedback WHERE {fold('hotel')} = 'resort_alpha' AND ano = 2024 AND mes = 1
  AND palavrachave IS NOT NULL AND palavrachave <> ''""", "guest_feedback")),
    "a12_department_balance_summary": (_stats("get_department_overtime_balance",
                                              {"hotel": "NATION_4", "ano": "1998", "mes": "3"}), W(f"""
WITH p AS (SELECT trim({fold('cr')}) AS k, sum(horaspositiva) AS v FROM overtime_positive
           WHERE trim({fold('hotel')}) = 'nation_4' AND ano = 1998 AND mes = 3 GROUP BY 1),
n AS (SELECT trim({fold('cr')}) AS k, sum(horasnegativas) AS v FROM overtime_negative
      WHERE trim({fold('hotel')}) = 'nation_4' AND ano = 1998 AND mes = 3 GROUP BY 1),
j AS (SELECT coalesce(p.v, 0) AS pos, coalesce(n.v, 0) AS neg FROM p FULL OUTER JOIN n ON p.k = n.k)
SELECT count(*) AS total_records, CAST(NULL AS VARCHAR) AS data_until,
       coalesce(sum(pos), 0.0) AS total_positive_hours, coalesce(sum(neg), 0.0) AS total_negative_hours,
       coalesce(sum(pos - neg), 0.0) AS resort_overall_balance FROM j""", "overtime_positive", "overtime_negative")),
    "a16_listing_stats_occupancy": (_stats("list_daily_occupancy", {"hotel": "resort_epsilon", "ano": "1999"}), W(f"""
SELECT count(*) AS total_records, CAST(max(data__date) AS VARCHAR) AS data_until FROM daily_occupancy
WHERE {fold('resort')} = 'resort_epsilon' AND ano = 1999""", "daily_occupancy")),
}
