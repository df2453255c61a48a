"""Registered checks of the ingest operators on raw sheets derived from the testdata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.sources import ingest as ing
from innsight.sources.testdata import (
    CUSTOMER_SHEET_HEADER, CUSTOMER_SHEET_SOURCE, CUSTOMER_SHEET_TAB, customer_sheet, lineitem_strings,
)

LINEITEM_TEXT_COLUMNS = ("pedido", "quantidade", "preco", "desconto", "flag", "envio", "linha", "vazia", "misto")


def infer_types_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: one row per column of the text-rendered lineitem (one aggregate over all rows)."""
    return ing.types_frame(lineitem_strings(spark, sf_dir), LINEITEM_TEXT_COLUMNS)


def prepared_sheet_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed, cleaned, id'd rows of the customer sheet."""
    spec = ing.IngestSpec(CUSTOMER_SHEET_SOURCE, "customers", "customer.parquet", tab=CUSTOMER_SHEET_TAB,
                          fmt="table")
    return ing.prepare(customer_sheet(spark, sf_dir), CUSTOMER_SHEET_HEADER, spec).frame


def blank_rows_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data rows, rows blank in every column and rows kept, of the customer sheet."""
    spec = ing.IngestSpec(CUSTOMER_SHEET_SOURCE, "customers", "customer.parquet", tab=CUSTOMER_SHEET_TAB,
                          fmt="table")
    names, kept, _ = ing.dedupe_headers(CUSTOMER_SHEET_HEADER)
    sheet = customer_sheet(spark, sf_dir)
    cells = sheet.select(*[F.col(f"_c{i}").alias(n) for n, i in zip(names, kept)])
    return ing.row_counts(cells, names, ing.WORKBOOK_NULLS if spec.profile == "workbook" else ())


def _lineitem_spec(sf_dir: str) -> ing.IngestSpec:
    return ing.IngestSpec("lineitem-7", "lineitem", f"{sf_dir.rstrip('/')}/lineitem.parquet", tab="Itens", fmt="parquet")


def _lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of lineitem read as an all-string source, with their ids."""
    spec = _lineitem_spec(sf_dir)
    raw, header, _profile = ing.read_source(spark, spec)
    order, line = (header.index(c) for c in ("l_orderkey", "l_linenumber"))
    return raw.select(ing.row_id(spec).alias("id"), F.col(f"_c{order}").cast("bigint").alias("l_orderkey"),
                      F.col(f"_c{line}").cast("bigint").alias("l_linenumber"))


def row_ids_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of every row from its position in the file (several files: tests/test_ingest.py)."""
    return _lineitem_rows(spark, sf_dir)


FILES = ("customer", "nation", "region", "supplier")


def several_files_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a source of several files, which name the file below the source's root."""
    spec = ing.IngestSpec("cadastros-3", "cadastros", f"{sf_dir.rstrip('/')}/{{{','.join(FILES)}}}.parquet", tab="Aba 2", fmt="parquet",
                          multi_file=True)
    raw, _header, _profile = ing.read_source(spark, spec)
    root = ing.source_root(spark, spec.path)
    return raw.select(ing.file_name(root).alias("file"), F.col(ing.POS).alias("line"), ing.row_id(spec, root).alias("id"))


def unique_ids_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, and rows whose position (and so their id) another row has, by the load's own proof."""
    raw, _header, _profile = ing.read_source(spark, _lineitem_spec(sf_dir))
    proof = ing.interval_proof(ing.position_intervals(raw))
    return proof.select(F.col("rows").alias("n_rows"), (F.col("repeated") + F.col("missing") + F.col("repeated_files")).alias("n_repeated_ids"))


ROW_ID_SQL = """
SELECT sha256('lineitem-7:Itens:' || CAST(row_number() OVER () + 1 AS VARCHAR)) AS id,
       CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber
FROM lineitem"""

_TEXT = """
WITH t AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS pedido, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantidade,
         replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',') AS preco,
         CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR) AS desconto, l_returnflag AS flag,
         strftime(l_shipdate, '%d/%m/%Y') AS envio,
         CASE WHEN l_linenumber = 1 THEN ' ' ELSE CAST(l_linenumber AS VARCHAR) END AS linha, '' AS vazia,
         CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE '1' END AS misto
  FROM lineitem),
f AS (SELECT {flags} FROM t)
{rows}"""


def _infer_sql() -> str:
    num = r"'^\s*[-+]?[0-9]+([.,][0-9]*)?\s*$'"
    flags, rows = [], []
    for i, c in enumerate(LINEITEM_TEXT_COLUMNS):
        present = f"({c} IS NOT NULL AND trim({c}) <> '')"
        flags.append(f"coalesce(bool_or({present} AND NOT regexp_matches({c}, {num})), false) AS {c}_t")
        flags.append(f"coalesce(bool_or({present} AND regexp_matches({c}, {num}) AND "
                     f"(contains({c}, '.') OR contains({c}, ','))), false) AS {c}_r")
        rows.append(f"SELECT {i} AS position, '{c}' AS column, CASE WHEN {c}_t THEN 'TEXT' WHEN {c}_r THEN 'REAL' "
                    f"ELSE 'INTEGER' END AS type FROM f")
    return _TEXT.format(flags=", ".join(flags), rows="\nUNION ALL\n".join(rows))


PREPARED_SQL = f"""
SELECT sha256(concat_ws(':', '{CUSTOMER_SHEET_SOURCE}', '{CUSTOMER_SHEET_TAB}', CAST(c_custkey + 2 + c_custkey // 97 AS VARCHAR))) AS id,
       c_custkey AS codigo, trim(c_name) AS nome, CAST(c_nationkey AS BIGINT) AS pais,
       CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS saldor,
       CASE WHEN c_custkey % 13 = 0 THEN c_mktsegment || ' extra' ELSE c_mktsegment END AS segmento
FROM customer"""

BLANK_SQL = """
SELECT CAST(count(*) + count_if(c_custkey % 97 = 96) AS BIGINT) AS data_rows,
       CAST(count_if(c_custkey % 97 = 96) AS BIGINT) AS blank_rows,
       count(*) AS kept_rows
FROM customer"""

CHECKS = {
    "i04_infer_types": (infer_types_check, _infer_sql()),
    "i07_row_ids": (row_ids_check, ROW_ID_SQL),
    "i07b_row_ids_of_several_files": (several_files_check, "\nUNION ALL\n".join(
        f"SELECT '{t}.parquet' AS file, n AS line, sha256('cadastros-3:Aba 2/{t}.parquet:' || CAST(n + 1 AS VARCHAR)) AS id "
        f"FROM (SELECT row_number() OVER () AS n FROM {t})" for t in FILES)),
    "i09_unique_ids": (unique_ids_check, "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_repeated_ids FROM lineitem"),
    "i06_blank_rows": (blank_rows_check, BLANK_SQL),
    "i05_prepare_sheet_rows": (prepared_sheet_check, PREPARED_SQL),
}
