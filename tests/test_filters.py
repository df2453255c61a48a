import pytest
from pyspark.sql import functions as F

from innsight.errors import AnalysisError
from innsight.operators import filters as flt


def test_keys_normalised_and_aliased_first_non_blank_wins():
    f = flt.Filters({" Hotel ": "", "Resort": "resort_alpha", "Mês": "março", "feedback_type": "x"},
                    {"resort": "hotel", "feedbacktype": "tipocomentario"})
    assert f.text("hotel") == "resort_alpha"
    assert f.month("mes") == 3
    assert f.text("tipocomentario") == "x"


def test_lists_and_errors():
    f = flt.Filters({"mes": "1, fev ,3,,3", "ano": "20x4", "pdv": " a, b "})
    assert f.months("mes") == [1, 2, 3]
    assert f.items("pdv") == ["a", "b"]
    with pytest.raises(AnalysisError):
        f.integer("ano")
    with pytest.raises(AnalysisError):
        f.require(hotel=None, ano=1)


def test_fold_predicates(spark):
    df = spark.createDataFrame([(1, "Recepção "), (2, "recepcao"), (3, None), (4, "Governança")], "id int, cr string")
    ids = lambda p: sorted(r[0] for r in df.where(p).collect())
    assert ids(flt.fold_eq(df, "cr", "RECEPCAO")) == [2]
    assert ids(flt.trim_fold_eq(df, "cr", " recepção")) == [1, 2]
    assert ids(flt.fold_contains("cr", "cep")) == [1, 2]
    assert ids(flt.fold_contains("cr", "r_c", wildcard=True)) == [1, 2]
    assert ids(flt.fold_contains("cr", "r_c")) == []
    assert ids(flt.fold_in(df, "cr", ["GOVERNANÇA", "x"])) == [4]


def test_key_twin_is_used_when_present(spark):
    df = spark.createDataFrame([("Recepção", "recepcao")], "cr string, cr__key string")
    pred = flt.fold_eq(df, "cr", "Recepção")
    assert "cr__key" in str(pred) and df.where(pred).count() == 1


def test_typed_literal_and_int_cast(spark):
    df = spark.createDataFrame([(1, "07"), (2, "7"), (3, "x")], "id int, mes string")
    assert sorted(r[0] for r in df.where(flt.int_eq(df, "mes", 7)).collect()) == [1, 2]
    with pytest.raises(AnalysisError):
        flt.eq(df, "id", "abc")


def test_bounds_round_like_integer_cast(spark):
    df = spark.createDataFrame([(1, 49.6), (2, -50.5), (3, -49.4)], "id int, h double")
    assert sorted(r[0] for r in df.where(flt.at_least("h", 50)).collect()) == [1]
    assert sorted(r[0] for r in df.where(flt.at_most("h", -50)).collect()) == [2]


def test_not_blank(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id int, k string")
    assert [r[0] for r in df.where(flt.not_blank("k")).collect()] == [1]
