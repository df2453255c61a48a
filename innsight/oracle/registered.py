"""Registered checks: for each key, the analysis request run on the testdata catalog and the
same question stated as DuckDB SQL over the raw tables (through the bindings' SQL).

Requests use the analysed system's default page (limit 50, page 1) unless the key exercises
paging. Every request reads the whole bound tables; filters are the analysis's own parameters.
"""

from __future__ import annotations

from innsight.oracle.bindings import fold_sql as fold, half_even, with_tables as W

# key -> (analysis name, filters, page, limit, shape); shape "long" explodes a nested indicator map
REQUESTS: dict[str, tuple[str, dict, int, int, str | None]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, analysis: str, filters: dict, sql: str | None, page: int = 1, limit: int = 50,
             shape: str | None = None):
    REQUESTS[key] = (analysis, filters, page, limit, shape)
    if sql is not None:
        ORACLE[key] = sql


# --- occupancy -------------------------------------------------------------------------------
register("q01_list_daily_occupancy", "list_daily_occupancy", {"resort": "RESORT_BÉTA", "ano": "1997"}, W(f"""
SELECT resort AS resort_code, empresa AS company, data AS date, hosptotal AS total_guests, lazer AS leisure_guests,
       eventos AS events_guests, mes AS month, ano AS year, dia AS day
FROM daily_occupancy
WHERE {fold('resort')} = 'resort_beta' AND CAST(ano AS INTEGER) = 1997
ORDER BY data__date DESC NULLS FIRST, id ASC NULLS LAST
LIMIT 50""", "daily_occupancy"))

register("q02_summarize_guests_by_month", "summarize_guests_by_month", {"ano": "1998"}, W("""
WITH g AS (
  SELECT resort, CAST(mes AS BIGINT) AS mes, sum(eventos) AS te, sum(lazer) AS tl, sum(hosptotal) AS th,
         count(DISTINCT dia) AS dias
  FROM daily_occupancy WHERE CAST(ano AS INTEGER) = 1998 GROUP BY 1, 2)
SELECT resort, mes, CAST(te AS BIGINT) AS total_eventos, CAST(tl AS BIGINT) AS total_lazer,
       CAST(th AS BIGINT) AS total_hospedes, CAST(dias AS BIGINT) AS dias_apurados, 'detail' AS row_kind
FROM g
UNION ALL
SELECT 'OVERALL TOTAL', NULL, CAST(coalesce(sum(te), 0) AS BIGINT), CAST(coalesce(sum(tl), 0) AS BIGINT),
       CAST(coalesce(sum(th), 0) AS BIGINT), NULL, 'total'
FROM g HAVING count(*) > 0""", "daily_occupancy"))

register("q03_calculate_complaint_per_guest_index", "calculate_complaint_per_guest_index",
         {"hotel": "resort_alpha", "mes": "janeiro", "ano": "2024"}, W(f"""
WITH c AS (SELECT count(*) AS n FROM guest_feedback
           WHERE {fold('hotel')} = 'resort_alpha' AND mes = 1 AND ano = 2024 AND tipocomentario = 'Reclamação'),
o AS (SELECT coalesce(sum(hosptotal), 0) AS g FROM daily_occupancy
      WHERE {fold('resort')} = 'resort_alpha' AND CAST(mes AS INTEGER) = 1 AND CAST(ano AS INTEGER) = 2024),
t AS (SELECT coalesce(sum(meta), 0.0) AS m FROM department_complaint_targets
      WHERE {fold('hotel')} = 'resort_alpha' AND mes = 1 AND ano = 2024)
SELECT 'resort_alpha' AS resort_code, CAST(2024 AS BIGINT) AS year, CAST(1 AS BIGINT) AS month, 'All' AS department,
       CAST(n AS BIGINT) AS total_complaints_in_period, CAST(g AS DOUBLE) AS total_guests_in_period,
       CASE WHEN g > 0 THEN CAST(printf('%.2f', n / CAST(g AS DOUBLE) * 100) AS DOUBLE) ELSE 0.0 END AS complaint_per_guest_index,
       CAST(printf('%.2f', CAST(m AS DOUBLE)) AS DOUBLE) AS complaint_per_guest_index_target
FROM c, o, t""", "guest_feedback", "daily_occupancy", "department_complaint_targets"))

register("q03b_complaint_index_all_resorts_department", "calculate_complaint_per_guest_index",
         {"resort": "All_Resorts", "periodo": "1", "ano": "2024", "setor": " recepção "}, W(f"""
WITH c AS (SELECT count(*) AS n FROM guest_feedback
           WHERE mes = 1 AND ano = 2024 AND tipocomentario = 'Reclamação' AND {fold('cr')} = 'recepcao'),
o AS (SELECT coalesce(sum(hosptotal), 0) AS g FROM daily_occupancy
      WHERE CAST(mes AS INTEGER) = 1 AND CAST(ano AS INTEGER) = 2024),
t AS (SELECT coalesce(sum(meta), 0.0) AS m FROM department_complaint_targets
      WHERE {fold('hotel')} = 'all_resorts' AND mes = 1 AND ano = 2024 AND {fold('cr')} = 'recepcao')
SELECT 'All Resorts' AS resort_code, CAST(2024 AS BIGINT) AS year, CAST(1 AS BIGINT) AS month,
       'recepção' AS department,
       CAST(n AS BIGINT) AS total_complaints_in_period, CAST(g AS DOUBLE) AS total_guests_in_period,
       CASE WHEN g > 0 THEN CAST(printf('%.2f', n / CAST(g AS DOUBLE) * 100) AS DOUBLE) ELSE 0.0 END AS complaint_per_guest_index,
       CAST(printf('%.2f', CAST(m AS DOUBLE)) AS DOUBLE) AS complaint_per_guest_index_target
FROM c, o, t""", "guest_feedback", "daily_occupancy", "department_complaint_targets"))

# --- guest feedback --------------------------------------------------------------------------
register("q04_list_guest_feedback", "list_guest_feedback",
         {"Hotel": "Resort_Gamma", "ano": "2024", "mes": "1", "feedback type": "reclamação"}, W(f"""
WITH f AS (SELECT * FROM guest_feedback
           WHERE {fold('hotel')} = 'resort_gamma' AND {fold('tipocomentario')} = 'reclamacao'
             AND ano = 2024 AND mes = 1),
s AS (SELECT substr(max(datapreenchimento), 1, 10) AS data_until FROM f)
SELECT datapreenchimento AS submission_date, hotel AS resort_code, cr AS cost_center, predio AS building,
       tipocomentario AS feedback_type, palavrachave AS keyword, nota AS score, comentario AS comment,
       ano AS year, mes AS month, dia AS day, s.data_until
FROM (SELECT * FROM f ORDER BY datapreenchimento DESC NULLS FIRST, id LIMIT 50) p, s""", "guest_feedback"))

register("q05_count_feedback_by_type", "count_feedback_by_type",
         {"hotel": "resort_delta", "ano": "2024", "mes": "jan"}, W(f"""
SELECT tipocomentario AS feedback_type, count(*) AS total
FROM guest_feedback WHERE {fold('hotel')} = 'resort_delta' AND ano = 2024 AND mes = 1
GROUP BY 1 ORDER BY total DESC, feedback_type ASC NULLS LAST LIMIT 50""", "guest_feedback"))

register("q06_rank_by_keyword", "rank_by_keyword",
         {"resort": "Resort Épsilon (resort_epsilon)", "year": "2024", "month": "1"}, W(f"""
SELECT palavrachave AS keyword, count(*) AS total
FROM guest_feedback
WHERE {fold('hotel')} = 'resort_epsilon' AND ano = 2024 AND mes = 1
  AND palavrachave IS NOT NULL AND palavrachave <> ''
GROUP BY 1 ORDER BY total DESC, keyword ASC NULLS LAST LIMIT 20 OFFSET 20""", "guest_feedback"), page=2, limit=20)

register("q07_search_feedback_by_keyword", "search_feedback_by_keyword",
         {"hotel": "all_resorts", "ano": "2024", "mes": "1", "keyword": "TEMA 42"}, W(f"""
SELECT datapreenchimento AS submission_date, hotel AS resort_code, cr AS cost_center, predio AS building,
       tipocomentario AS feedback_type, nota AS score, comentario AS comment, palavrachave AS keyword,
       ano AS year, mes AS month
FROM guest_feedback
WHERE ano = 2024 AND mes = 1 AND {fold('palavrachave')} = 'tema 42'
ORDER BY datapreenchimento DESC NULLS FIRST, id LIMIT 50""", "guest_feedback"))

# --- business indicators (long form of the nested map) ---------------------------------------
from innsight.plans.indicators import INDICATOR_NAMES  # noqa: E402


def _indicators_long(where: str) -> str:
    parts = [f"SELECT ano AS year, hotel AS resort_code, periodo AS period, 'closed' AS status, "
             f"'{name}' AS indicator, {stem}real AS actual, {stem}meta AS target FROM p"
             for stem, name in INDICATOR_NAMES.items()]
    return W(f"""WITH p AS (SELECT * FROM business_indicators WHERE {where}
               ORDER BY ano, periodo, id LIMIT 50)
""" + "\nUNION ALL\n".join(parts), "business_indicators")


register("q08_get_closed_period_indicators", "get_closed_period_indicators",
         {"resort_code": "Resort Beta (resort_beta)", "ano": "1998"},
         _indicators_long(f"{fold('hotel')} = 'resort_beta' AND CAST(ano AS INTEGER) = 1998"), shape="long")
register("q08b_indicators_semester", "get_closed_period_indicators",
         {"hotel": "resort_gamma", "year": "1999", "period": "1st Semester"},
         _indicators_long(f"{fold('hotel')} = 'resort_gamma' AND CAST(ano AS INTEGER) = 1999 AND periodo = 'H1'"),
         shape="long")

# --- extra revenue ---------------------------------------------------------------------------
register("q09_list_extra_revenue_records", "list_extra_revenue_records",
         {"hotel": "resort_delta", "ano": "1996", "mes": "março"}, W(f"""
SELECT id, resort AS resort_code, mes AS month, pdv AS point_of_sale, categoria AS category, ano AS year,
       data AS date, hospedes AS guests, vendatotalpdv AS total_pos_sales, dia AS day
FROM extra_revenue WHERE {fold('resort')} = 'resort_delta' AND ano = 1996 AND mes = 3
ORDER BY data__date ASC NULLS LAST, dia ASC NULLS LAST, id ASC NULLS LAST LIMIT 50""", "extra_revenue"))

_D = "DECIMAL(38,4)"
register("q10_calculate_revenue_share", "calculate_revenue_share",
         {"hotel": "resort_alpha", "ano": "1998", "mes": "1,2,março", "pdv": "brand#2, BRAND#7,Brand#13"}, W(f"""
WITH a AS (SELECT sum(coalesce(CAST(lazer AS {_D}), 0)) AS al, sum(coalesce(CAST(eventos AS {_D}), 0)) AS ae
           FROM accommodation_revenue WHERE {fold('hotel')} = 'resort_alpha' AND ano = 1998 AND mes IN (1, 2, 3)),
e AS (SELECT sum(CASE WHEN categoria = 'Lazer' THEN coalesce(CAST(vendatotalpdv AS {_D}), 0) END) AS el,
             sum(CASE WHEN categoria = 'Eventos' THEN coalesce(CAST(vendatotalpdv AS {_D}), 0) END) AS ee
      FROM extra_revenue WHERE {fold('resort')} = 'resort_alpha' AND ano = 1998 AND mes IN (1, 2, 3)
        AND {fold('pdv')} IN ('brand#2', 'brand#7', 'brand#13')),
c AS (SELECT 'Leisure' AS category, coalesce(al, 0) AS acc, coalesce(el, 0) AS ex FROM a, e
      UNION ALL SELECT 'Events', coalesce(ae, 0), coalesce(ee, 0) FROM a, e)
SELECT category, {half_even('acc')} AS accommodation_revenue, {half_even('ex')} AS extra_revenue,
       CASE WHEN acc > 0 THEN CAST(printf('%.2f', CAST(ex AS DOUBLE) / CAST(acc AS DOUBLE) * 100) AS DOUBLE) ELSE 0.0 END
         AS extra_revenue_share_percentage
FROM c""", "accommodation_revenue", "extra_revenue"))

_R2 = "('resort_alpha', 'resort_beta')"
register("q11a_compare_extra_revenue_per_guest", "compare_extra_revenue_per_guest",
         {"hotel": "Resort_Alpha, resort_béta", "ano": "1999", "mes": "6,4,5"}, W(f"""
WITH g AS (SELECT sum(coalesce(lazer, 0)) AS gl, sum(coalesce(eventos, 0)) AS ge FROM daily_occupancy
           WHERE {fold('resort')} IN {_R2} AND ano = 1999 AND mes IN (4, 5, 6)),
gl AS (SELECT 'Lazer' AS categoria, gl AS guests FROM g UNION ALL SELECT 'Eventos', ge FROM g),
r AS (SELECT categoria, sum(coalesce(CAST(vendatotalpdv AS {_D}), 0)) AS revenue FROM extra_revenue
      WHERE {fold('resort')} IN {_R2} AND ano = 1999 AND mes IN (4, 5, 6) GROUP BY 1),
actual AS (SELECT gl.categoria, guests, revenue FROM gl LEFT JOIN r ON gl.categoria = r.categoria),
mt AS (SELECT mes, resort, categoria, sum(CAST(meta AS {_D})) AS stm FROM monthly_extra_revenue_targets
       WHERE ano = 1999 AND {fold('resort')} IN {_R2} AND mes IN (4, 5, 6) GROUP BY 1, 2, 3),
t AS (SELECT mt.categoria, sum(stm * hm.hospmeta) AS sp, sum(hm.hospmeta) AS sw
      FROM mt JOIN guest_targets hm ON mt.mes = hm.mes AND mt.resort = hm.resort AND mt.categoria = hm.categoria
      WHERE hm.ano = 1999 AND {fold('hm.resort')} IN {_R2} AND hm.mes IN (4, 5, 6) GROUP BY 1)
SELECT coalesce(actual.categoria, t.categoria) AS category,
       CASE WHEN coalesce(guests, 0) > 0
            THEN CAST(printf('%.2f', coalesce(CAST(revenue AS DOUBLE) / CAST(guests AS DOUBLE), 0)) AS DOUBLE) ELSE 0.0 END
         AS revenue_per_guest_actual,
       CASE WHEN coalesce(sw, 0) > 0 THEN CAST(printf('%.2f', CAST(sp AS DOUBLE) / CAST(sw AS DOUBLE)) AS DOUBLE) ELSE 0.0 END
         AS revenue_per_guest_target
FROM actual FULL OUTER JOIN t ON actual.categoria = t.categoria""",
    "daily_occupancy", "extra_revenue", "monthly_extra_revenue_targets", "guest_targets"))

_P5 = "('brand#1', 'brand#2', 'brand#3', 'brand#4', 'brand#5')"
register("q11b_extra_revenue_per_guest_by_pos", "compare_extra_revenue_per_guest",
         {"hotel": "resort_gamma", "ano": "2000", "mes": "jan,fev,3", "pdv": "Brand#1,brand#2,BRAND#3,brand#4,brand#5"},
         W(f"""
WITH mg AS (SELECT CAST(mes AS BIGINT) AS mes, sum(coalesce(lazer, 0)) AS gl, sum(coalesce(eventos, 0)) AS ge
            FROM daily_occupancy WHERE ano = 2000 AND {fold('resort')} IN ('resort_gamma') AND mes IN (1, 2, 3)
            GROUP BY 1),
g AS (SELECT mes, 'Lazer' AS categoria, gl AS guests FROM mg UNION ALL SELECT mes, 'Eventos', ge FROM mg),
s AS (SELECT CAST(mes AS BIGINT) AS mes, {fold('pdv')} AS pdv_key, categoria,
             sum(coalesce(CAST(vendatotalpdv AS {_D}), 0)) AS sales, min(pdv) AS pdv_name
      FROM extra_revenue WHERE ano = 2000 AND {fold('resort')} IN ('resort_gamma') AND mes IN (1, 2, 3)
        AND {fold('pdv')} IN {_P5} GROUP BY 1, 2, 3),
j AS (SELECT s.*, g.guests FROM s JOIN g ON s.mes = g.mes AND s.categoria = g.categoria WHERE g.guests > 0)
SELECT upper(left(min(pdv_name), 1)) || lower(substr(min(pdv_name), 2)) AS point_of_sale, categoria AS category,
       {", ".join(f"coalesce(max(CASE WHEN mes = {m} THEN CAST(printf('%.2f', CAST(sales AS DOUBLE) / CAST(guests AS DOUBLE)) AS DOUBLE) END), 0.0) AS actual_month_{m}" for m in (1, 2, 3))},
       CASE WHEN sum(guests) > 0 THEN CAST(printf('%.2f', CAST(sum(sales) AS DOUBLE) / CAST(sum(guests) AS DOUBLE)) AS DOUBLE) ELSE 0.0 END
         AS total
FROM j GROUP BY pdv_key, categoria""", "daily_occupancy", "extra_revenue"))

register("q12_analyze_item_sales", "analyze_item_sales",
         {"hotel": "resort_gamma", "ano": "1999", "mes": "3,4", "categoria": "Lazer"}, W(f"""
WITH g AS (SELECT coalesce(sum(coalesce(lazer, 0)), 0) AS tg FROM daily_occupancy
           WHERE {fold('resort')} = 'resort_gamma' AND ano = 1999 AND mes IN (3, 4)),
i AS (SELECT itemcomanda AS item, sum(coalesce(CAST(valorcomanda AS {_D}), 0)) AS tv,
             sum(coalesce(qtdeitemcomanda, 0)) AS tq
      FROM pos_item_sales WHERE ano = 1999 AND {fold('hotel')} = 'resort_gamma' AND mes IN (3, 4)
        AND {fold('categoria')} IN ('lazer') GROUP BY 1 HAVING sum(coalesce(CAST(valorcomanda AS {_D}), 0)) > 0)
SELECT item, CAST(tq AS BIGINT) AS total_quantity, {half_even('tv')} AS total_sales,
       CAST(printf('%.2f', CAST(tv AS DOUBLE) / CAST(tg AS DOUBLE)) AS DOUBLE) AS sales_per_guest
FROM i, g WHERE tg > 0 ORDER BY tv DESC, item LIMIT 50""", "daily_occupancy", "pos_item_sales"))

register("q12b_item_sales_ascending_filtered", "analyze_item_sales",
         {"resort": "resort_beta", "ano": "2000", "mes": "5,6,7", "classe": "small, Promo",
          "pdv": "brand#3,brand#9,brand#11,brand#20", "ordenacao": "menor"}, W(f"""
WITH g AS (SELECT coalesce(sum(coalesce(lazer, 0) + coalesce(eventos, 0)), 0) AS tg FROM daily_occupancy
           WHERE {fold('resort')} = 'resort_beta' AND ano = 2000 AND mes IN (5, 6, 7)),
i AS (SELECT itemcomanda AS item, sum(coalesce(CAST(valorcomanda AS {_D}), 0)) AS tv,
             sum(coalesce(qtdeitemcomanda, 0)) AS tq
      FROM pos_item_sales WHERE ano = 2000 AND {fold('hotel')} = 'resort_beta' AND mes IN (5, 6, 7)
        AND {fold('categoria')} IN ('lazer', 'eventos') AND {fold('pdv')} IN ('brand#3', 'brand#9', 'brand#11', 'brand#20')
        AND {fold('classe')} IN ('small', 'promo')
      GROUP BY 1 HAVING sum(coalesce(CAST(valorcomanda AS {_D}), 0)) > 0)
SELECT item, CAST(tq AS BIGINT) AS total_quantity, {half_even('tv')} AS total_sales,
       CAST(printf('%.2f', CAST(tv AS DOUBLE) / CAST(tg AS DOUBLE)) AS DOUBLE) AS sales_per_guest
FROM i, g WHERE tg > 0 ORDER BY tv ASC, item LIMIT 50""", "daily_occupancy", "pos_item_sales"))

# --- infirmary -------------------------------------------------------------------------------
_ATT_COLS = """id, data AS attendance_date, horario AS attendance_time, hospedeouemocionador AS patient_type,
       cr AS cost_center, nomecompleto AS patient_name, ocorrenciaqueixa AS chief_complaint,
       partedocorpodosintoma AS affected_body_part, houvetransferenciaparaohospital AS hospital_transfer,
       enfermeiroaresponsavel AS attending_nurse, localocorrencia AS occurrence_location, hotel AS resort_code,
       dia, mes AS month, ano AS year"""
register("q13_list_medical_attendances", "list_medical_attendances",
         {"hotel": "Resort Alpha resort_alpha", "ano": "2024", "mes": "1", "queixa": "náusea", "transfer": "não"}, W(f"""
SELECT {_ATT_COLS} FROM medical_attendances
WHERE contains({fold('ocorrenciaqueixa')}, 'nausea') AND {fold('hotel')} = 'resort_alpha'
  AND {fold('houvetransferenciaparaohospital')} = 'nao' AND ano = 2024 AND mes = 1
ORDER BY data DESC NULLS FIRST, horario DESC NULLS FIRST, id LIMIT 50""", "medical_attendances"))

register("q13b_attendances_contains_filters", "list_medical_attendances",
         {"enfermeiro": "enf. j", "parte do corpo": "CABECA", "cr": "recep", "year": "2024"}, W(f"""
SELECT {_ATT_COLS} FROM medical_attendances
WHERE contains({fold('cr')}, 'recep') AND contains({fold('partedocorpodosintoma')}, 'cabeca')
  AND contains({fold('enfermeiroaresponsavel')}, 'enf. j') AND ano = 2024
ORDER BY data DESC NULLS FIRST, horario DESC NULLS FIRST, id LIMIT 50""", "medical_attendances"))

register("q14_rank_medical_occurrences", "rank_medical_occurrences",
         {"hotel": "resort_beta", "ano": "2024", "mes": "janeiro"}, W(f"""
SELECT ocorrenciaqueixa AS chief_complaint, count(*) AS total_attendances FROM medical_attendances
WHERE ocorrenciaqueixa IS NOT NULL AND ocorrenciaqueixa <> '' AND {fold('hotel')} = 'resort_beta'
  AND ano = 2024 AND mes = 1
GROUP BY 1 ORDER BY total_attendances DESC, chief_complaint LIMIT 50""", "medical_attendances"))

register("q15_calculate_attendance_per_guest_index", "calculate_attendance_per_guest_index",
         {"hotel": "RESORT_GAMMA", "ano": "2024", "mes": "1"}, W(f"""
WITH a AS (SELECT count(*) AS n FROM medical_attendances
           WHERE {fold('hotel')} = 'resort_gamma' AND ano = 2024 AND mes = 1
             AND (contains({fold('hospedeouemocionador')}, 'lazer') OR contains({fold('hospedeouemocionador')}, 'eventos'))),
g AS (SELECT CAST(coalesce(sum(hosptotal), 0) AS BIGINT) AS g FROM daily_occupancy
      WHERE {fold('resort')} = 'resort_gamma' AND ano = 2024 AND mes = 1)
SELECT 'resort_gamma' AS resort_code, CAST(2024 AS BIGINT) AS year, CAST(1 AS BIGINT) AS month,
       n AS total_attendances_leisure_events_guests, g AS total_guests_in_month,
       CASE WHEN g > 0 THEN CAST(printf('%.2f', n / CAST(g AS DOUBLE) * 100) AS DOUBLE) ELSE 0.0 END AS attendance_per_100_guests_index
FROM a, g""", "medical_attendances", "daily_occupancy"))

register("q16_count_attendances_by_patient_type", "count_attendances_by_patient_type",
         {"hotel": "all_resorts", "ano": "2024", "mes": "1", "cr": "recep"}, W(f"""
WITH f AS (SELECT * FROM medical_attendances
           WHERE hospedeouemocionador IS NOT NULL AND hospedeouemocionador <> '' AND ano = 2024 AND mes = 1
             AND contains({fold('cr')}, 'recep')),
g AS (SELECT hospedeouemocionador AS patient_type, count(*) AS total_attendances FROM f GROUP BY 1)
(SELECT * FROM g ORDER BY total_attendances DESC, patient_type LIMIT 50)
UNION ALL
SELECT 'Total', count(*) FROM f HAVING count(*) > 0""", "medical_attendances"))

# --- overtime --------------------------------------------------------------------------------
register("q17_get_employee_overtime_balance", "get_employee_overtime_balance",
         {"hotel": "nation_1", "ano": "1997", "mes": "mar"}, W(f"""
SELECT hotel AS resort_code, ano AS year, mes AS month, cr AS department, nome AS employee_name,
       horas AS balance_hours
FROM employee_overtime_balance
WHERE contains(trim({fold('hotel')}), 'nation_1') AND ano = 1997 AND mes = 3
ORDER BY nome, ano, mes, id LIMIT 50""", "employee_overtime_balance"))

register("q17b_overtime_debt_threshold", "get_employee_overtime_balance",
         {"hotel": "NATION_2", "ano": "1998", "employee": "customer#0000001", "horas": "-50"}, W(f"""
SELECT hotel AS resort_code, ano AS year, mes AS month, cr AS department, nome AS employee_name,
       horas AS balance_hours
FROM employee_overtime_balance
WHERE contains(trim({fold('hotel')}), 'nation_2') AND contains(trim({fold('nome')}), 'customer#0000001')
  AND ano = 1998 AND CAST(round(horas) AS BIGINT) <= -50
ORDER BY horas ASC, nome ASC, id LIMIT 50""", "employee_overtime_balance"))


def _dept_balance(where: str, tail: str) -> str:
    side = """SELECT trim({f}) AS k, min(cr) AS c, sum({m}) AS v FROM {t} WHERE {w} GROUP BY 1"""
    return W(f"""
WITH p AS ({side.format(f=fold('cr'), m='horaspositiva', t='overtime_positive', w=where)}),
n AS ({side.format(f=fold('cr'), m='horasnegativas', t='overtime_negative', w=where)}),
j AS (SELECT coalesce(p.c, n.c) AS department, coalesce(p.v, 0) AS positive_hours, coalesce(n.v, 0) AS negative_hours
      FROM p FULL OUTER JOIN n ON p.k = n.k)
SELECT * FROM j {tail}""", "overtime_positive", "overtime_negative")


register("q18a_get_department_overtime_balance", "get_department_overtime_balance",
         {"hotel": "NATION_3", "ano": "1997", "mes": "5"},
         _dept_balance(f"trim({fold('hotel')}) = 'nation_3' AND ano = 1997 AND mes = 5", ""))
register("q18a2_department_overtime_threshold", "get_department_overtime_balance",
         {"resort": " nation_7 ", "ano": "1998", "horas": "-100"},
         _dept_balance(f"trim({fold('hotel')}) = 'nation_7' AND ano = 1998", "WHERE negative_hours >= 100"))

register("q18b_resort_overtime_ranking", "get_department_overtime_balance", {"ano": "1999", "mes": "junho"}, W("""
WITH p AS (SELECT hotel, sum(horaspositiva) AS v FROM overtime_positive WHERE ano = 1999 AND mes = 6 GROUP BY 1),
n AS (SELECT hotel, sum(horasnegativas) AS v FROM overtime_negative WHERE ano = 1999 AND mes = 6 GROUP BY 1),
d AS (SELECT coalesce(p.hotel, n.hotel) AS resort_code, coalesce(p.v, 0) AS positive_hours,
             coalesce(n.v, 0) AS negative_hours FROM p FULL OUTER JOIN n ON p.hotel = n.hotel)
SELECT * FROM d
UNION ALL
SELECT 'Group', sum(positive_hours), sum(negative_hours) FROM d HAVING count(*) > 1""",
    "overtime_positive", "overtime_negative"))

# --- employee sentiment ----------------------------------------------------------------------
_RES_COLS = """id, hotel AS resort_code, ano AS year, mes AS month, dimensaonova AS dimension,
       CAST(printf('%.2f', taxageraldeadesao * 100) AS DOUBLE) AS overall_adherence_rate, score, scorehotelsituacao AS score_status,
       notas AS scores"""
register("q19_get_resort_adherence", "get_resort_adherence", {"hotel": "src1", "ano": "2024"}, W(f"""
SELECT {_RES_COLS} FROM employee_sentiment_by_resort
WHERE contains({fold('hotel')}, 'src1') AND ano = 2024
ORDER BY ano DESC, mes DESC, taxageraldeadesao DESC, id LIMIT 50""", "employee_sentiment_by_resort"))

register("q20_get_department_adherence", "get_department_adherence",
         {"hotel": "src2", "ano": "2024", "mes": "fev", "setor": "recep"}, W(f"""
SELECT {_RES_COLS}, lideresdiretos AS direct_leader, cr AS department, nivel AS level, lideranca AS leadership
FROM employee_sentiment_by_department
WHERE contains({fold('hotel')}, 'src2') AND contains({fold('cr')}, 'recep') AND ano = 2024 AND mes = 2
ORDER BY ano DESC, mes DESC, taxageraldeadesao DESC, cr ASC, id LIMIT 50""", "employee_sentiment_by_department"))

register("q21_get_survey_status", "get_survey_status",
         {"hotel": "nation_1", "ano": "1997", "mes": "julho", "status": "aberto", "cargo": "garç"}, W(f"""
SELECT id, hotel AS resort_code, ano AS year, mes AS month, cr AS department, destinatario AS employee_name,
       cargo AS position, grupos AS groups, lideres AS leader, status, dataehora AS timestamp, egerente AS is_manager
FROM employee_sentiment_surveys
WHERE contains({fold('hotel')}, 'nation_1') AND contains({fold('status')}, 'aberto')
  AND contains({fold('cargo')}, 'garc') AND ano = 1997 AND mes = 7
ORDER BY dataehora DESC, id LIMIT 50""", "employee_sentiment_surveys"))


def _survey_rank(where: str, k: int) -> str:
    return W(f"""
WITH a AS (SELECT ano, destinatario, cr, string_agg(DISTINCT hotel, ', ' ORDER BY hotel) AS hotel,
                  count(*) AS total_ocorrencias,
                  string_agg(DISTINCT CAST(mes AS VARCHAR), ', ' ORDER BY CAST(mes AS VARCHAR)) AS meses
           FROM employee_sentiment_surveys WHERE {where} GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY ano ORDER BY total_ocorrencias DESC, destinatario, cr) AS rank_num
      FROM a)
SELECT ano AS year, rank_num, destinatario AS employee_name, cr AS department, hotel AS resort_code,
       total_ocorrencias, meses AS months_of_occurrence
FROM r WHERE rank_num <= {k}""", "employee_sentiment_surveys")


register("q22_rank_by_survey_status", "rank_by_survey_status", {"ano": "1998", "status": "não respondido"},
         _survey_rank("ano = 1998 AND status IN ('Enviado', 'Em Aberto')", 5))
register("q22b_survey_rank_named_employee", "rank_by_survey_status",
         {"ano": "1999", "status": "Respondido", "nome": "customer#0000001", "mes": "1,2,3,mar"},
         _survey_rank(f"ano = 1999 AND status IN ('Respondido') AND contains({fold('destinatario')}, "
                      f"'customer#0000001') AND mes IN (1, 2, 3)", 100))

# --- edge cases: an empty result and a page beyond the last ----------------------------------
register("q05b_feedback_types_unknown_resort", "count_feedback_by_type",
         {"hotel": "Resort Zeta", "ano": "2024", "mes": "1"}, W(f"""
SELECT tipocomentario AS feedback_type, count(*) AS total
FROM guest_feedback WHERE {fold('hotel')} = 'resort zeta' AND ano = 2024 AND mes = 1
GROUP BY 1 ORDER BY total DESC, feedback_type LIMIT 50""", "guest_feedback"))

register("q14b_occurrences_page_beyond_last", "rank_medical_occurrences",
         {"ano": "2024", "mes": "1"}, W(f"""
SELECT ocorrenciaqueixa AS chief_complaint, count(*) AS total_attendances FROM medical_attendances
WHERE ocorrenciaqueixa IS NOT NULL AND ocorrenciaqueixa <> '' AND ano = 2024 AND mes = 1
GROUP BY 1 ORDER BY total_attendances DESC, chief_complaint LIMIT 10 OFFSET 990""", "medical_attendances"),
         page=100, limit=10)
