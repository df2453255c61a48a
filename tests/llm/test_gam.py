"""The additive model: held-out accuracy, what it may learn from, scores against a plain sum, and interactions."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from innsight.llm import gam as G, queries

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = queries.op11_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    good, bad = ([r["predicted"] for r in held if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.05
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def scores(df):
    return {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in df.collect()}


def test_held_out_labels_and_other_columns_have_no_part(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    want = scores(G.classify(docs, labels))
    assert len(want) == docs.count()
    other = labels.withColumn("quality", F.when(G.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(1))
    assert scores(G.classify(docs.withColumns({"lang": F.lit("x"), "source": F.lit(None)}), other)) == want


def test_scores_are_the_models_and_equal_for_equal_texts(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", "a", "!!! $$$ %%%", "the cat sat. " * 30, "x" * 2_000_000, "é\n" * 50, "\x00"] * 2
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, SCORE string")
    featured = G.with_features(df)
    x = np.array([r["features"] for r in featured.orderBy("doc_id").collect()])
    assert x.shape == (16, len(G.FEATURES)) and np.isfinite(x).all() and (x[0] == 0).all() and (x[0] == x[1]).all()
    model = G.fit(rng.random((500, len(G.FEATURES))), rng.integers(0, 2, 500).astype(float), rounds=5, pair_rounds=3)
    got = {r["doc_id"]: r["score"] for r in G.with_score(featured, model).collect()}
    for i, row in enumerate(x):
        odds = model.intercept + sum(t[sum(c < v for c in cuts)] for v, cuts, t in zip(row, model.cuts, model.tables))
        for (a, b), t in zip(model.pairs, model.pair_tables):
            odds += t[sum(c < row[a] for c in model.pair_cuts[a]), sum(c < row[b] for c in model.pair_cuts[b])]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-odds)))
        assert got[i] == got[(i + 8) % 16]


def test_features_of_a_plain_text():
    got = dict(zip(G.FEATURES, G.features(pa.array(["Ab cd, cd, 1!\n\nAb cd, cd, 1!"]))[0]))
    assert got["longest_word"] == 3 and got["line_repeats"] == 0.5 and got["line_words"] == 4 and got["top_word"] == 0.5
    assert got["distinct_words"] == 3 / 8 and got["capitalised"] == 0.25 and got["upper"] == pytest.approx(2 / 28)


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = G.fit(x[:3000], y[:3000])
    assert model.pairs[0] == (1, 3)
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.85
    alone = G.fit(x[:3000], y[:3000], pairs=0)
    assert np.mean((alone.score(x[3000:]) > 0.5) == y[3000:]) < 0.65


def test_no_labels_one_kind_and_the_sample_bound(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * i) for i in range(400)] + [(None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {s for _, s, _ in scores(G.classify(docs, none)).values()} == {0.5}
    same = spark.createDataFrame([(1, 1), (4, 1), (None, 0), (5, None), (6, 7)], "doc_id long, quality int")
    assert len({s for _, s, _ in scores(G.classify(docs, same)).values()}) == 1
    assert G.classify(docs.limit(0), same).count() == 0
    half = spark.range(400).selectExpr("id AS doc_id", "int(id > 200) AS quality")
    got = scores(G.classify(docs, half, fit_rows=150))
    assert len(got) == 401 and got[390][1] > 0.7 > got[10][1]
