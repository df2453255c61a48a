"""The testdata bindings stated again as DuckDB SQL, independently of the Spark code.

``with_tables(sql, *names)`` prefixes a query with the CTEs it needs; the driver's DuckDB has
the raw tables registered as views, so the oracle runs the same derivations from the same
parquet files and disagreements show up as hash mismatches.
"""

from __future__ import annotations

from innsight.sources.testdata import (
    BODY_PARTS, BUILDINGS, COMPANIES, COMPLAINTS, DEPARTMENTS, FEEDBACK_TYPES, LANG_MONTH, NURSES,
    PATIENT_TYPES, PLACES, RESORT_LABELS, ROLES, SURVEY_STATUS,
)
from innsight.functions.text import RESORT_CODES


def q(v) -> str:
    if v is None:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'"


def fold_sql(col: str) -> str:
    """Lower case without accents, and the letters that do not decompose written out."""
    plain = f"translate(strip_accents(lower({col})), 'ðøđħıłŋŧ', 'dodhilnt')"
    for letter, letters in (("æ", "ae"), ("þ", "th"), ("ß", "ss"), ("ĳ", "ij"), ("œ", "oe")):
        plain = f"replace({plain}, '{letter}', '{letters}')"
    return plain


def pick(values, index_expr: str) -> str:
    """values[index] with a 0-based index expression (DuckDB lists are 1-based)."""
    return f"([{', '.join(q(v) for v in values)}])[({index_expr}) + 1]"


def case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {col} = {q(k)} THEN CAST({q(v)} AS VARCHAR)" for k, v in mapping.items())
    return f"(CASE {whens} END)"


def initcap_word(col: str) -> str:
    return f"(upper(left({col}, 1)) || lower(substr({col}, 2)))"


ORDERS_X = ("(SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS _ridx, "
            "CAST(o_orderdate AS DATE) AS _d FROM orders)")
LINES_X = f"(SELECT * FROM lineitem JOIN {ORDERS_X} ox ON l_orderkey = o_orderkey)"
CATEGORY = ("(CASE WHEN l_returnflag = 'R' THEN 'Outros' WHEN l_linestatus = 'F' THEN 'Lazer' "
            "ELSE 'Eventos' END)")
PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"

SQL: dict[str, str] = {}

SQL["daily_occupancy"] = f"""
SELECT concat_ws(':', {pick(RESORT_LABELS, '_ridx')}, strftime(_d, '%Y-%m-%d')) AS id,
       {pick(RESORT_LABELS, '_ridx')} AS resort, {pick(COMPANIES, '_ridx')} AS empresa,
       strftime(_d, '%Y-%m-%d') AS data, _d AS data__date,
       CAST(hosptotal AS BIGINT) AS hosptotal, CAST(lazer AS BIGINT) AS lazer, CAST(eventos AS BIGINT) AS eventos,
       CAST(month(_d) AS BIGINT) AS mes, CAST(year(_d) AS BIGINT) AS ano, CAST(day(_d) AS BIGINT) AS dia
FROM (
  SELECT _ridx, _d, count(*) AS hosptotal, count(*) FILTER (WHERE o_orderstatus = 'F') AS lazer,
         count(*) FILTER (WHERE o_orderstatus = 'O') AS eventos
  FROM {ORDERS_X} GROUP BY _ridx, _d
  UNION ALL
  SELECT user_id % 5 AS _ridx, CAST(ts AS DATE) AS _d, count(DISTINCT user_id),
         count(DISTINCT CASE WHEN event_type IN ('view', 'click') THEN user_id END),
         count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END)
  FROM events GROUP BY 1, 2
)"""

SQL["accommodation_revenue"] = f"""
SELECT {pick(RESORT_LABELS, '_ridx')} AS hotel, CAST(ano AS BIGINT) AS ano, CAST(mes AS BIGINT) AS mes,
       CAST(lazer AS DOUBLE) AS lazer, CAST(eventos AS DOUBLE) AS eventos
FROM (SELECT _ridx, year(_d) AS ano, month(_d) AS mes,
             sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS lazer,
             sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS eventos
      FROM {ORDERS_X} GROUP BY 1, 2, 3)"""

SQL["guest_targets"] = f"""
SELECT {pick(RESORT_LABELS, '_ridx')} AS resort, CAST(ano AS BIGINT) AS ano, CAST(mes AS BIGINT) AS mes,
       categoria, CAST(hospmeta AS BIGINT) AS hospmeta
FROM (SELECT _ridx, year(_d) AS ano, month(_d) AS mes,
             {case('o_orderstatus', {'F': 'Lazer', 'O': 'Eventos', 'P': 'Outros'})} AS categoria,
             count(*) AS hospmeta
      FROM {ORDERS_X} GROUP BY 1, 2, 3, 4)
WHERE NOT (categoria = 'Eventos' AND mes = 2)"""

SQL["employee_sentiment_surveys"] = f"""
SELECT o_orderkey AS id, n_name AS hotel, CAST(year(o_orderdate) AS BIGINT) AS ano,
       CAST(month(o_orderdate) AS BIGINT) AS mes, c_mktsegment AS cr, c_name AS destinatario,
       {pick(ROLES, 'c_custkey % 3')} AS cargo, 'Grupo ' || c_mktsegment AS grupos,
       'Líder ' || {initcap_word('c_mktsegment')} AS lideres,
       {case('o_orderstatus', SURVEY_STATUS)} AS status,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dataehora,
       CASE WHEN c_acctbal > 5000 THEN 'Sim' ELSE 'Não' END AS egerente
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

SQL["employee_overtime_balance"] = f"""
SELECT concat_ws(':', CAST(o_custkey AS VARCHAR), CAST(ano AS VARCHAR), CAST(mes AS VARCHAR)) AS id,
       n_name AS hotel, CAST(ano AS BIGINT) AS ano, CAST(mes AS BIGINT) AS mes, c_mktsegment AS cr,
       c_name AS nome, CAST(_bal AS DOUBLE) / 1000 AS horas
FROM (SELECT o_custkey, year(o_orderdate) AS ano, month(o_orderdate) AS mes,
             coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0)
             - coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS _bal
      FROM orders GROUP BY 1, 2, 3) g
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

SQL["extra_revenue"] = f"""
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS id,
       {pick(RESORT_LABELS, '_ridx')} AS resort, CAST(month(_d) AS BIGINT) AS mes,
       CASE WHEN l_linenumber % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS pdv,
       {CATEGORY} AS categoria, CAST(year(_d) AS BIGINT) AS ano, strftime(_d, '%Y-%m-%d') AS data,
       _d AS data__date, CAST(l_quantity AS BIGINT) AS hospedes, l_extendedprice AS vendatotalpdv,
       CAST(day(_d) AS BIGINT) AS dia
FROM {LINES_X} lx JOIN part ON l_partkey = p_partkey"""

SQL["monthly_extra_revenue_targets"] = f"""
SELECT {pick(RESORT_LABELS, '_ridx')} AS resort, CAST(ano AS BIGINT) AS ano, CAST(mes AS BIGINT) AS mes,
       categoria, meta
FROM (SELECT _ridx, year(_d) AS ano, month(_d) AS mes, {CATEGORY} AS categoria, l_linenumber,
             sum(l_quantity) / 100 AS meta
      FROM {LINES_X} lx GROUP BY 1, 2, 3, 4, 5)"""

SQL["pos_item_sales"] = f"""
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS id,
       {pick(RESORT_LABELS, '_ridx')} AS hotel, CAST(month(_d) AS BIGINT) AS mes, CAST(day(_d) AS BIGINT) AS dia,
       {CATEGORY} AS categoria, p_brand AS pdv, p_type AS classe, p_name AS itemcomanda,
       CAST({PRICE} * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS valorcomanda,
       CAST(l_quantity AS BIGINT) AS qtdeitemcomanda, CAST(year(_d) AS BIGINT) AS ano
FROM {LINES_X} lx JOIN part ON l_partkey = p_partkey"""

_MEASURES = {
    "reclamacaoreal": "count(*) FILTER (WHERE l_returnflag = 'R')",
    "reclamacaometa": "count(*) FILTER (WHERE l_returnflag = 'A')",
    "npsreal": "count(*) FILTER (WHERE l_linestatus = 'F')",
    "npsmeta": "count(*) FILTER (WHERE l_linestatus = 'O')",
    "grireal": "sum(CAST(l_quantity AS BIGINT))",
    "grimeta": "count(*) * 25",
    "receitaextrareal": f"sum({PRICE})",
    "receitaextrameta": f"sum(CASE WHEN o_orderstatus = 'F' THEN {PRICE} END)",
    "custodealimentosreal": f"sum({PRICE} * CAST(l_discount AS DECIMAL(4,2)))",
    "custodealimentosmeta": f"sum({PRICE} * CAST(l_tax AS DECIMAL(4,2)))",
    "cmvdealimentosreal": f"sum(CASE WHEN l_linenumber = 1 THEN {PRICE} END)",
    "cmvdealimentosmeta": f"sum(CASE WHEN l_linenumber = 2 THEN {PRICE} END)",
    "custodebebidasreal": "count(*) FILTER (WHERE l_linenumber % 2 = 0)",
    "custodebebidasmeta": "count(*) FILTER (WHERE l_linenumber % 2 = 1)",
    "cmvdebebidasreal": f"sum(CASE WHEN o_orderstatus = 'O' THEN {PRICE} END)",
    "cmvdebebidasmeta": f"sum(CASE WHEN o_orderstatus = 'P' THEN {PRICE} END)",
    "custodeaebreal": "count(*) FILTER (WHERE l_linenumber = 3)",
    "custodeaebmeta": "count(*) FILTER (WHERE l_linenumber = 4)",
    "cmvaebreal": f"sum(CASE WHEN l_returnflag = 'N' THEN {PRICE} END)",
    "cmvaebmeta": f"sum(CASE WHEN l_returnflag = 'A' THEN {PRICE} END)",
}
_M = ", ".join(f"{v} AS {k}" for k, v in _MEASURES.items())
_RESUM = ", ".join(f"sum({k}) AS {k}" for k in _MEASURES)
_OUT = ", ".join(f"CAST({k} AS DOUBLE) AS {k}" for k in _MEASURES)
SQL["business_indicators"] = f"""
WITH monthly AS (SELECT _ridx, year(_d) AS ano, month(_d) AS mes, {_M} FROM {LINES_X} lx GROUP BY 1, 2, 3),
allp AS (
  SELECT _ridx, ano, CAST(mes AS VARCHAR) AS periodo, {", ".join(_MEASURES)} FROM monthly
  UNION ALL
  SELECT _ridx, ano, CASE WHEN mes <= 6 THEN 'H1' ELSE 'H2' END AS periodo, {_RESUM} FROM monthly GROUP BY 1, 2, 3
  UNION ALL
  SELECT _ridx, ano, 'Annual' AS periodo, {_RESUM} FROM monthly GROUP BY 1, 2
)
SELECT concat_ws(':', {pick(RESORT_LABELS, '_ridx')}, CAST(ano AS VARCHAR), periodo) AS id,
       {pick(RESORT_LABELS, '_ridx')} AS hotel, CAST(ano AS BIGINT) AS ano, periodo, {_OUT}
FROM allp"""


def _overtime(flag: str, measure: str, dropped: str) -> str:
    cr = f"CASE WHEN l_linenumber % 2 = 0 THEN p_type ELSE {initcap_word('p_type')} || ' ' END"
    return f"""
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS id, n_name AS hotel,
       CAST(year(l_shipdate) AS BIGINT) AS ano, CAST(month(l_shipdate) AS BIGINT) AS mes, {cr} AS cr,
       l_quantity AS {measure}
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
WHERE l_returnflag = '{flag}' AND p_type <> '{dropped}'"""


SQL["overtime_positive"] = _overtime("A", "horaspositiva", "ECONOMY")
SQL["overtime_negative"] = _overtime("R", "horasnegativas", "PROMO")

_EV = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS _k FROM events)"
_TIPO = case("event_type", FEEDBACK_TYPES)
SQL["guest_feedback"] = f"""
SELECT event_id AS id, {pick(RESORT_LABELS, 'user_id % 5')} AS hotel,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS datapreenchimento, {pick(DEPARTMENTS, 'user_id % 7')} AS cr,
       CASE WHEN _k % 10 = 0 THEN NULL WHEN _k % 10 = 5 THEN '' ELSE 'Tema ' || CAST(_k AS VARCHAR) END AS palavrachave,
       value AS nota, {_TIPO} AS tipocomentario,
       {_TIPO} || ': ' || event_type || ' #' || CAST(event_id AS VARCHAR) AS comentario,
       {pick(BUILDINGS, 'event_id % 3')} AS predio, CAST(day(ts) AS BIGINT) AS dia,
       CAST(month(ts) AS BIGINT) AS mes, CAST(year(ts) AS BIGINT) AS ano
FROM {_EV} ev"""

SQL["medical_attendances"] = f"""
SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS data, strftime(ts, '%H:%M:%S') AS horario,
       {case('event_type', PATIENT_TYPES)} AS hospedeouemocionador, {pick(DEPARTMENTS, 'user_id % 7')} AS cr,
       'Paciente ' || CAST(user_id AS VARCHAR) AS nomecompleto,
       CASE WHEN _k % 7 = 0 THEN NULL ELSE {pick(COMPLAINTS, '_k % 5')} END AS ocorrenciaqueixa,
       {pick(BODY_PARTS, '_k % 4')} AS partedocorpodosintoma,
       CASE WHEN value > 300 THEN 'Sim' ELSE 'Não' END AS houvetransferenciaparaohospital,
       {pick(NURSES, 'event_id % 3')} AS enfermeiroaresponsavel, {pick(PLACES, 'user_id % 3')} AS localocorrencia,
       {pick(RESORT_LABELS, 'user_id % 5')} AS hotel, CAST(day(ts) AS BIGINT) AS dia,
       CAST(month(ts) AS BIGINT) AS mes, CAST(year(ts) AS BIGINT) AS ano
FROM {_EV} ev"""

SQL["department_complaint_targets"] = f"""
SELECT s_suppkey AS id, {pick(RESORT_CODES + ('all_resorts',), 's_suppkey % 6')} AS hotel,
       CAST((s_suppkey // 6) % 3 + 1 AS BIGINT) AS mes, CAST(2024 AS BIGINT) AS ano,
       {pick(DEPARTMENTS, 's_suppkey % 7')} AS cr, s_acctbal / 1000 AS meta
FROM supplier"""

_DOCS = f"(SELECT *, CAST({case('lang', LANG_MONTH)} AS BIGINT) AS _mes FROM documents JOIN labels USING (doc_id))"
SQL["employee_sentiment_by_resort"] = f"""
SELECT concat_ws(':', source, CAST(_mes AS VARCHAR)) AS id, source AS hotel, CAST(2024 AS BIGINT) AS ano,
       _mes AS mes, 'Geral' AS dimensaonova, taxageraldeadesao, score,
       CASE WHEN score >= 0.9 THEN 'Bom' ELSE 'Atenção' END AS scorehotelsituacao, notas
FROM (SELECT source, _mes, avg(quality) AS taxageraldeadesao, 1 - avg(toxic) AS score,
             CAST(count(*) AS VARCHAR) AS notas FROM {_DOCS} d GROUP BY 1, 2)"""

SQL["employee_sentiment_by_department"] = f"""
SELECT concat_ws(':', source, CAST(_mes AS VARCHAR), cr) AS id, source AS hotel, CAST(2024 AS BIGINT) AS ano,
       _mes AS mes, 'Geral' AS dimensaonova, taxageraldeadesao, score,
       CASE WHEN score >= 0.9 THEN 'Bom' ELSE 'Atenção' END AS scorehotelsituacao, notas,
       'Líder ' || cr AS lideresdiretos, cr, 'Operacional' AS nivel, 'Direta' AS lideranca
FROM (SELECT source, _mes, {pick(DEPARTMENTS, 'doc_id % 7')} AS cr, avg(quality) AS taxageraldeadesao,
             1 - avg(toxic) AS score, CAST(count(*) AS VARCHAR) AS notas FROM {_DOCS} d GROUP BY 1, 2, 3)"""


def with_tables(sql: str, *names: str) -> str:
    """``WITH <binding> AS (...), ... <sql>``; ``sql`` may start with further CTEs via ``, x AS``."""
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def half_even(amount: str) -> str:
    """P5 of a non-negative exact amount with four decimals: two decimals, ties to even, stated on whole
    ten-thousandths. (Ratios in double precision are stated as ``printf('%.2f', x)``, which rounds the binary
    value, ties to even.)"""
    n = f"CAST({amount} * 10000 AS HUGEINT)"
    up = f"CASE WHEN {n} % 100 > 50 OR ({n} % 100 = 50 AND ({n} // 100) % 2 = 1) THEN 1 ELSE 0 END"
    return f"CAST({n} // 100 + {up} AS DOUBLE) / 100"
