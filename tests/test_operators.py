from pyspark.sql import functions as F

from innsight.functions.text import classes_of
from innsight.sources.ingest import row_counts

from innsight.operators.aggregate import distinct_text, weighted_mean, with_total
from innsight.operators.combine import full_balance, wide_to_long
from innsight.operators.listing import order_keys, page, rename
from innsight.operators.rank import top_rank
from innsight.operators.shape import explode_pairs, month_pivot, nest_pairs
from innsight.plans.spec import Page


def test_null_order_follows_source_database(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id int, v int")
    asc = [r.id for r in df.orderBy(*order_keys([("v", "asc")])).collect()]
    desc = [r.id for r in df.orderBy(*order_keys([("v", "desc")])).collect()]
    assert asc == [2, 3, 1] and desc == [1, 3, 2]


def test_page_with_ties_uses_tiebreak(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "id int, g int")
    p2 = page(df, [("g", "asc"), ("id", "asc")], Page(limit=3, number=2))
    assert [tuple(r) for r in p2.collect()] == [(9, 0), (1, 1), (4, 1)]
    beyond = page(df, [("id", "asc")], Page(limit=5, number=9))
    assert beyond.count() == 0


def test_rename_map_fallback_and_twins_hidden(spark):
    df = spark.createDataFrame([(1, "a", "a", "x")], "id int, Hotel string, hotel__key string, `Nota Média` string")
    assert rename(df, {"hotel": "resort_code"}).columns == ["id", "resort_code", "nota_media"]


def test_total_row_equals_sum_of_detail_and_keeps_null_key(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 5), (None, 1, 1), ("b", 1, None)], "r string, m int, v int")
    out = with_total(df, ["r", "m"], {"s": F.sum("v"), "n": F.count_distinct("m")}, "r", "TOTAL")
    got = {(x.r, x.m, x.row_kind): x.s for x in out.collect()}
    assert got[("TOTAL", None, "total")] == 16
    assert got[(None, 1, "detail")] == 1
    assert sum(v for (r, m, k), v in got.items() if k == "detail" and v) == 16


def test_full_balance_keeps_both_sides_and_unmatched_nulls(spark):
    p = spark.createDataFrame([("x", 1.0), ("y", 2.0), (None, 3.0)], "k string, pos double")
    n = spark.createDataFrame([("y", 5.0), ("z", 7.0), (None, 9.0)], "k string, neg double")
    got = sorted((r.k or "", r.pos, r.neg) for r in full_balance(p, n, "k", ["pos"], ["neg"]).collect())
    assert got == [("", 0.0, 9.0), ("", 3.0, 0.0), ("x", 1.0, 0.0), ("y", 2.0, 5.0), ("z", 0.0, 7.0)]


def test_distinct_text_sorted_as_text(spark):
    df = spark.createDataFrame([(1, 2), (1, 10), (1, 1), (1, 10)], "g int, m int")
    assert df.groupBy("g").agg(distinct_text("m").alias("t")).first().t == "1, 10, 2"


def test_weighted_mean_zero_weight_is_null(spark):
    df = spark.createDataFrame([("a", 2.0, 1), ("a", 4.0, 3), ("b", 1.0, 0)], "c string, v double, w int")
    got = {r.c: r.x for r in df.groupBy("c").agg(weighted_mean("v", "w").alias("x")).collect()}
    assert got == {"a": 3.5, "b": None}


def test_top_rank_ties_broken_by_name(spark):
    df = spark.createDataFrame([(2024, "b", 3), (2024, "a", 3), (2024, "c", 5), (2023, "z", 1)], "y int, n string, c int")
    out = top_rank(df, ["y"], [("c", "desc"), ("n", "asc")], 2)
    assert sorted((r.y, r.rank_num, r.n) for r in out.collect()) == [(2023, 1, "z"), (2024, 1, "c"), (2024, 2, "a")]


def test_nest_and_explode_pairs_round_trip(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0, 5.0)], "id int, a_actual double, a_target double, b_actual double, b_target double")
    nested = df.select("id", nest_pairs(["a", "b"]).alias("m"))
    assert nested.first().m["b"]["target"] == 5.0
    assert sorted(tuple(r) for r in explode_pairs(nested, "m", ["id"]).collect()) == [(1, "a", 2.0, 3.0), (1, "b", 4.0, 5.0)]


def test_wide_to_long(spark):
    df = spark.createDataFrame([(1, 10, 20)], "mes int, lazer int, eventos int")
    got = sorted(tuple(r) for r in wide_to_long(df, ["mes"], {"lazer": "Lazer", "eventos": "Eventos"}, "cat", "g").collect())
    assert got == [(1, "Eventos", 20), (1, "Lazer", 10)]


def test_month_pivot_fixed_columns_and_fill(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("a", 3, 1.0), ("b", 2, 4.0)], "k string, m int, v double")
    out = month_pivot(df, ["k"], "m", [1, 2, 3, 4], F.sum("v"), prefix="m_", fill=0)
    assert out.columns == ["k", "m_1", "m_2", "m_3", "m_4"]
    assert sorted(tuple(r) for r in out.collect()) == [("a", 5.0, 0.0, 1.0, 0.0), ("b", 0.0, 4.0, 0.0, 0.0)]
    unfilled = month_pivot(df, ["k"], "m", [2], F.sum("v"))
    assert sorted(tuple(r) for r in unfilled.collect()) == [("a", None), ("b", 4.0)]


def test_status_classes_may_overlap_and_miss(spark):
    classes = {"answered": ("Respondido",), "open": ("Em Aberto",), "not answered": ("Enviado", "Em Aberto")}
    df = spark.createDataFrame([("Em Aberto",), ("Respondido",), ("Cancelado",), (None,)], "s string")
    got = [r.c for r in df.select(classes_of("s", classes).alias("c")).collect()]
    assert got == [["open", "not answered"], ["answered"], [], []]


def test_row_counts_blank_rows(spark):
    df = spark.createDataFrame([("1", "a"), ("", " "), (None, None), ("2", None), ("nan", "NaT")], "x string, y string")
    assert tuple(row_counts(df, ["x", "y"]).first()) == (5, 2, 3)
    assert tuple(row_counts(df, ["x", "y"], ("nan", "NaT")).first()) == (5, 3, 2)
