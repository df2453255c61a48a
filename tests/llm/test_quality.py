"""Text statistics against a plain version, EM against held-out labels and a plain posterior."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from innsight.llm import quality as Q, queries

SF = "/root/testdata/sf0.01"


def plain(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


random.seed(14)
TEXTS = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x x x x x x", "a b c d a b c d a b", "l\nl\n l\nl\x0bm", "é 日本 \x1c \x85 z",
         "the " * 40_000, "A|B <#> $%& ***", *[" ".join(random.choices("abcd\n", k=random.randint(1, 80))) for _ in range(200)]]


def test_statistics_equal_the_plain_version(spark):
    rows = [(i, t, 9) for i, t in enumerate([*TEXTS, "same row", "same row"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_WORDS int").selectExpr("*", "1 AS __w", "2 AS quality")
    scored, _ = Q.score(df)
    got = {r["doc_id"]: r for r in scored.collect()}
    for i, t, _ in rows:
        want = plain(t)
        assert {k: got[i][k] for k in want} == want, t
        assert got[i]["text"] == t
        assert got[i]["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_posterior_is_the_models(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    scored, model = Q.score(df.select("doc_id", "text"), keep_text=False)
    names = list(Q.rules())
    for r in scored.collect():
        odds = model.log_odds({n: r[f"vote_{n}"] for n in names})
        assert r["quality"] == pytest.approx(1 / (1 + math.exp(-odds)))
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


def test_held_out_labels(spark):
    """The labels are not used in fitting; good documents stay and bad ones go."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op10_quality_rules(spark, sf).withColumnRenamed("quality", "p")
    j = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    good = j.filter("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = j.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.99 and bad < 0.02


def test_em_recovers_accuracies():
    """Votes drawn from known accuracies with abstentions: the estimates come close."""
    random.seed(2)
    names, right = ["a", "b", "c", "d", "e"], [(0.95, 0.8), (0.9, 0.7), (0.97, 0.6), (0.85, 0.85), (0.5, 0.5)]
    votes = Counter()
    for _ in range(40_000):
        y = random.random() < 0.75
        votes[tuple(-1 if random.random() < 0.2 else int((random.random() < g) if y else not random.random() < b)
                    for g, b in right)] += 1
    model = Q.fit(sorted(votes.items()), names)
    assert model.prior == pytest.approx(0.75, abs=0.03)
    for n, (g, b) in zip(names, right):
        assert model.right[n][0] == pytest.approx(g, abs=0.04) and model.right[n][1] == pytest.approx(b, abs=0.06)


def test_no_votes_and_empty_table(spark):
    scored, model = Q.score(spark.createDataFrame([], "doc_id long, text string"))
    assert scored.count() == 0 and set(model.right) == set(Q.rules())


def test_registered_columns_and_plan(spark):
    got = queries.op10_quality_rules(spark, SF)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got.collect():
        want = plain(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
    plan = Q.with_stats(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_stage_hands_columns_on(spark):
    """Columns named like statistics or outputs keep their values."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr(
        "*", "-7L AS n_words", "'mine' AS kept", "-1.5D AS quality", "'v' AS vote_length")
    out = Q.filter_stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and {(r["n_words"], r["kept"], r["quality"], r["vote_length"]) for r in rows} == {(-7, "mine", -1.5, "v")}
