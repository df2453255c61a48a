"""Property tests: Spark operators against plain-Python statements of the same rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from innsight.functions.text import fold, fold_py
from innsight.operators.aggregate import with_total
from innsight.sources import ingest as ing

SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
CELL = st.one_of(st.sampled_from(["", " ", "1", "-3", " 12 ", "1,5", "2.", "0.25", "+7", "1e5", "a", "1.234,56",
                                  "٣", "12a", " - 1"]),
                 st.from_regex(r"\A[ 0-9.,+\-]{0,6}\Z"))


def python_type(values):
    """The inference rule in plain Python (digits are ASCII digits)."""
    is_real = False
    for v in values:
        v = "" if v is None else v.strip()
        if v == "":
            continue
        if not re.fullmatch(r"\s*[-+]?[0-9]+([.,][0-9]*)?\s*", v):
            return "TEXT"
        if "." in v or "," in v:
            is_real = True
    return "REAL" if is_real else "INTEGER"


@SETTINGS
@given(st.lists(st.tuples(CELL, CELL), min_size=1, max_size=12))
def test_inference_equals_python_rule(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string")
    types, n, blank = ing.infer_types(df, ["a", "b"])
    assert types == {"a": python_type([r[0] for r in rows]), "b": python_type([r[1] for r in rows])}
    assert n == len(rows)
    assert blank == sum(1 for r in rows if all(not c.strip() for c in r))


LATIN = st.text(alphabet=st.characters(min_codepoint=0x20, max_codepoint=0x24F), max_size=12)


@SETTINGS
@given(st.lists(LATIN, min_size=1, max_size=10))
def test_fold_column_equals_python_twin(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(fold("w")).collect()] == [fold_py(w) for w in words]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(1, 3), st.integers(-5, 5)), min_size=1,
                max_size=20))
def test_total_row_equals_sum_of_groups(spark, rows):
    df = spark.createDataFrame(rows, "k string, m int, v int")
    out = with_total(df, ["k", "m"], {"s": F.sum("v")}, "k", "TOTAL").collect()
    total = [r.s for r in out if r.row_kind == "total"]
    assert total == [sum(r[2] for r in rows)]
    assert sum(r.s for r in out if r.row_kind == "detail") == sum(r[2] for r in rows)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(CELL, CELL), min_size=0, max_size=10))
def test_single_pass_csv_profile_equals_python_rule(spark, rows):
    import csv
    import os
    import tempfile
    folder = tempfile.mkdtemp(prefix="innsight-prop-")
    path = os.path.join(folder, "sheet.csv")
    with open(path, "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerows([["a", "b"], *rows])
    _raw, header, profile = ing.read_source(spark, ing.IngestSpec("p", "t_prop", path))
    assert header == ["a", "b"]
    assert profile.types == {"a": python_type([r[0] for r in rows]), "b": python_type([r[1] for r in rows])}
    assert profile.rows == len(rows)
    assert profile.blank_rows == sum(1 for r in rows if all(not c.strip() for c in r))


RESORTISH = st.one_of(st.sampled_from(["Resort_Alpha", "RESORT_BÉTA", "resort_gamma 2", "x resort_delta",
                                       "Resort Épsilon", "all_resorts", "", "outro"]), LATIN)
MONTHISH = st.one_of(st.sampled_from(["janeiro", "Fev", "MARÇO", "marco", " abr ", "07", "7", "12", "13", "dez",
                                      "x", ""]), st.text(alphabet="0123456789 ", max_size=3))


@SETTINGS
@given(st.lists(RESORTISH, min_size=1, max_size=10))
def test_canonical_code_column_equals_python_twin(spark, values):
    from innsight.functions.text import RESORT_CODES, canonical_code, canonical_code_py
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(canonical_code("v")).collect()]
    assert got == [canonical_code_py(v, RESORT_CODES) for v in values]


@SETTINGS
@given(st.lists(MONTHISH, min_size=1, max_size=10))
def test_month_number_column_equals_python_twin(spark, values):
    from innsight.functions.text import month_number, month_number_py
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(month_number("v")).collect()]
    expected = [m if isinstance(m, int) else None for m in (month_number_py(v) for v in values)]
    assert got == expected


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(-50, 50), st.integers(0, 5)),
                min_size=1, max_size=15))
def test_weighted_mean_equals_python(spark, rows):
    from innsight.operators.aggregate import weighted_mean
    df = spark.createDataFrame([(k, float(v), w) for k, v, w in rows], "k string, v double, w int")
    got = {r.k: r.m for r in df.groupBy("k").agg(weighted_mean("v", "w").alias("m")).collect()}
    for k in got:
        ws = [(v, w) for kk, v, w in rows if kk == k]
        total = sum(w for _, w in ws)
        want = None if total == 0 else sum(v * w for v, w in ws) / total
        assert (got[k] is None and want is None) or abs(got[k] - want) < 1e-9


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(1, 12), st.integers(-9, 9)),
                min_size=0, max_size=20), st.lists(st.integers(1, 12), min_size=1, max_size=4, unique=True))
def test_month_pivot_equals_python(spark, rows, months):
    from innsight.operators.shape import month_pivot
    df = spark.createDataFrame(rows, "k string, m int, v int")
    out = month_pivot(df, ["k"], "m", months, F.sum("v"), prefix="m_", fill=0)
    assert out.columns == ["k"] + [f"m_{m}" for m in months]
    got = {r.k: tuple(r[f"m_{m}"] for m in months) for r in out.collect()}
    want = {k: tuple(sum(v for kk, mm, v in rows if kk == k and mm == m) for m in months)
            for k in {r[0] for r in rows}}
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(LATIN, st.sampled_from(["id", "ID", " Id ", "", "Mês", "Mes", "a.1"])), max_size=12))
def test_header_rules(headers):
    names, kept, warnings = ing.dedupe_headers(headers)
    assert len(names) == len(set(names)) == len(kept) and len(kept) + len(warnings) == len(headers)
    assert "id" not in names and all(re.fullmatch(r"[a-z0-9]+|col_[0-9]+|src_id", n) for n in names)
    for h in headers:
        once = ing.normalise_header(h)
        assert ing.normalise_header(once) == once and re.fullmatch(r"[a-z0-9]*", once)
