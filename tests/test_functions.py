import random
from decimal import ROUND_HALF_EVEN, Decimal

import duckdb
import pytest

from innsight.functions import (
    canonical_code_py, fold, fold_py, month_number, month_number_py, round_value, safe_ratio,
)
from innsight.functions.numeric import money
from innsight.functions.text import accent_table
from innsight.oracle.bindings import fold_sql, half_even

WORDS = ["Recepção", "GOVERNANÇA", "Ação", "Àéîõü", "Straße", "Æble", "œuvre", "Øst", "naïve", "Ñandú", "", None,
         "Resort_Épsilon", "crème brûlée", "cre\u0300me bru\u0302le\u0301e", "Recepc\u0327a\u0303o", "ÞÓRR ǼON Łódź ıĳ ĐÐħŧŋ ǿ", "ﾊ 한 e\u0301\u0323"]


def test_fold_matches_python_twin_and_duckdb(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    got = [r[0] for r in df.select(fold("w")).collect()]
    assert got == [fold_py(w) for w in WORDS]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INT, w VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(WORDS)))
    assert got == [r[0] for r in con.sql(f"SELECT {fold_sql('w')} FROM t ORDER BY i").fetchall()]
    assert fold_py("cre\u0300me BRU\u0302le\u0301e") == fold_py("Crème brûlée") and fold_py("Straße Æble Øst") == "strasse aeble ost"


def test_accent_table_is_one_to_one():
    src, dst = accent_table()
    assert len(src) == len(dst) and len(set(src)) == len(src) and len(src) > 150
    assert "ß" not in src and "ø" not in src


@pytest.mark.parametrize("value,expected", [
    ("Resort Alpha (resort_alpha)", "resort_alpha"), ("RESORT_BÉTA", "resort_beta"), ("All_Resorts", "all_resorts"),
    ("Hotel X", "Hotel X"), (7, 7)])
def test_canonical_code(value, expected):
    assert canonical_code_py(value) == expected


@pytest.mark.parametrize("value,expected", [
    ("Março", 3), ("marco", 3), (" DEZ ", 12), ("07", 7), ("7", 7), ("julho", 7), ("H1", "H1"), (5, 5)])
def test_month_number(value, expected):
    assert month_number_py(value) == expected


def test_month_number_column(spark):
    df = spark.createDataFrame([("Março",), ("07",), ("x",), (None,)], "m string")
    assert [r[0] for r in df.select(month_number("m")).collect()] == [3, 7, None, None]


def test_round_value_equals_python_round(spark):
    rng = random.Random(1)
    values = [2.675, 1.115, 0.125, 0.375, 1.005, -2.675, -0.125, 0.0, 2.5, 1e15, 9.99e12, 0.285, 123456.785, 5e-324, 0.005, 0.015]
    values += [rng.randrange(10**7) / 1000 for _ in range(20_000)] + [rng.uniform(-1e6, 1e6) for _ in range(5000)]
    values += [rng.randrange(10**6) / 8 for _ in range(5000)] + [(2 * rng.randrange(10**8) + 1) / 200 for _ in range(20_000)]
    values += [10000000000000.123, 2.0 ** 46, 2.0 ** 46 - 2 ** -7, 45035996273704.965] + [rng.uniform(1e13, 1e14) for _ in range(10_000)]
    values += [rng.randrange(10**15, 8 * 10**15) / 128 for _ in range(5000)] + [-rng.randrange(2**45, 2**47) - k / 64 for k in range(64)]
    df = spark.createDataFrame([(x,) for x in values], "x double").coalesce(1)
    for digits in (1, 2, 3, 4):
        got = [r[0] for r in df.select(round_value("x", digits)).collect()]
        assert got == [round(x, digits) for x in values]
    assert spark.createDataFrame([(None,)], "x double").select(round_value("x")).first()[0] is None


def test_money_is_decimal_half_even(spark):
    rng = random.Random(2)
    values = [Decimal(rng.randrange(10**9)).scaleb(-4) for _ in range(5000)] + [Decimal(rng.randrange(10**7) * 10 + 5).scaleb(-3) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "x decimal(38,4)").coalesce(1)
    want = [float(v.quantize(Decimal("0.01"), ROUND_HALF_EVEN)) for v in values]
    assert [r[0] for r in df.select(money("x")).collect()] == want
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, x DECIMAL(38,4))")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values[:500] + values[-500:])))
    assert [r[0] for r in con.execute(f"SELECT {half_even('x')} FROM t ORDER BY i").fetchall()] == want[:500] + want[-500:]


def test_safe_ratio_zero_and_null_denominator(spark):
    df = spark.createDataFrame([(1, 3), (5, 0), (5, None), (0, 4)], "n int, d int")
    got = [r[0] for r in df.select(safe_ratio("n", "d")).collect()]
    assert got == [33.33, 0.0, 0.0, 0.0]


def test_period_code_column_equals_driver_twin(spark):
    from innsight.plans.indicators import period_code, period_code_column
    values = ["1st Semester", " FIRST SEMESTER ", "2nd semester", "YTD", "Full Year", "annual", "H1", "7", "1º semestre",
              "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(period_code_column("v")).collect()]
    assert got == [None if v is None else period_code(v) for v in values]
