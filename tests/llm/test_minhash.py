"""Near-duplicate classes against all-pairs comparison."""

import random

import numpy as np
import pyarrow as pa
import pytest

from innsight.llm import minhash as M
from tests_llm_helpers import brute_classes as by_row, shingle_set, words

SF = "/root/testdata/sf0.01"


def compare(df, rows):
    want = by_row(rows)
    got = M.classes(df).collect()
    assert len(got) == len(rows)
    assert sorted((r[0] is None, r[0] or 0, r["class_id"] if r["class_id"] is not None else -1) for r in got) == \
        sorted((d is None, d or 0, want[i] if want[i] is not None else -1) for i, (d, _) in enumerate(rows))


def test_whole_documents_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    compare(df, [(r["doc_id"], r["text"]) for r in df.collect()])


def test_groups_copies_and_edges(spark):
    random.seed(5)
    base = [random.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(random.randrange(300)) for _ in range(240)]
    rows = [(None, None), (0, ""), (1, " \n "), (2, "one two"), (3, "one  two"), (4, "one two three four five"), (4, "other text here")]
    for i in range(60):  # near copies of one text, of each other only in part
        w = list(base)
        for _ in range(random.randrange(0, 8)):
            w[random.randrange(len(w))] = f"new{random.randrange(10**6)}"
        rows.append((10 + i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(20)]  # exact copies
    for i in range(60):  # a long shared passage, yet not similar enough
        rows.append((200 + i, " ".join(base[:150] + [f"own{i}x{k}" for k in range(60)])))
    rows += [(400, rows[-1][1]), (400, rows[-1][1])]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS node", "2 AS `class_id`")
    compare(df, rows)
    kept = M.keep_one(df).collect()
    assert kept[0].asDict().keys() == set(df.columns)
    assert len(kept) == len(M.classes(df).select("component").distinct().collect())
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} <= set(by_row(rows).values())
    again = M.classes(spark.createDataFrame([(r["doc_id"], r["text"]) for r in kept], "doc_id long, text string"))
    assert all(r["class_size"] == 1 for r in again.collect())


def test_cross_blocks(spark, monkeypatch):
    """With tiny blocks every pair of different components is still met."""
    monkeypatch.setattr(M, "BLOCK", 4)
    random.seed(9)
    base = [f"w{random.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(5):
            w[random.randrange(len(w))] = f"x{random.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    compare(spark.createDataFrame(rows, "doc_id long, text string"), rows)


@pytest.mark.parametrize("block", [1024, 7])
def test_copies_of_a_base_that_are_no_copies_of_each_other(spark, monkeypatch, block):
    """Pairs lie on both sides of the threshold, so stars alone leave many components."""
    monkeypatch.setattr(M, "BLOCK", block)
    random.seed(21)
    base = [f"w{random.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(random.randrange(2, 5)):
            w[random.randrange(len(w))] = f"x{random.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    compare(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def with_passage(w, length, times):
    """The words ``w`` with their first ``length`` words repeated."""
    return w[:length] * times + w[length:]


def passage_rows():
    random.seed(31)
    rows = []
    for i in range(12):
        w = [f"b{i}w{random.randrange(10**6)}" for _ in range(300)]
        edited = list(w)
        for k in random.sample(range(120, 290), 5):
            edited[k] = f"e{random.randrange(10**6)}"
        copies = [w, with_passage(w, 60, 100), with_passage(w, 100, 100), with_passage(edited, 60, 100)]
        rows += [(10 * i + k, " ".join(c)) for k, c in enumerate(copies)]
    return rows


def test_copies_that_repeat_a_passage(spark):
    """Links are verified on shingle sets, so a passage repeated a hundred times must not hide a copy."""
    rows = passage_rows()
    assert set(by_row(rows).values()) == {10 * i for i in range(12)}
    compare(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_blocks_link_copies_that_repeat_a_passage():
    """The same in the block path: every node of one key is a component of its own."""
    texts = pa.array([t for _, t in passage_rows()])
    keys, low = M.sketch(texts)
    n = len(texts)
    nodes = pa.array([str(i).encode() for i in range(n)])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.ones(n, np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), nodes, nodes, low, keys, texts],
        names=["key", "side", "band", "node", "component", "sketch", "keys", "text"])
    assert len(M._Block(batch).links(0, n)[0]) == n - 12  # twelve trees


def test_slices_of_keys():
    assert list(M.slices_of_keys([0], 5)) == []
    assert list(M.slices_of_keys([0, 2, 4, 9, 10], 5)) == [(0, 2), (2, 3), (3, 4)]
    assert list(M.slices_of_keys([0, 9], 5)) == [(0, 1)]


def test_empty_table(spark):
    assert M.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_probability_jaccard():
    random.seed(2)
    errors = []
    for _ in range(40):
        a = [f"a{i}" for i in range(200)]
        b = a[:random.randrange(40, 200)]
        x, y = pa.array([" ".join(a)]), pa.array([" ".join(b)])
        sx, sy = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        errors.append((M.signatures(x) == M.signatures(y)).mean() - len(sx & sy) / len(sx | sy))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


@pytest.mark.parametrize("texts", [[None, "", " "], ["a"], ["a b c d e f a b c d e f", None, "ü  b\nc\td", "x" * 1000]])
def test_shingles_equal_plain_sets(texts):
    row, h, count = M.shingles(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert (row == i).sum() == len(shingle_set(t))
        assert count[row == i].sum() == max(len(words(t)) - 4, 1 if words(t) else 0)


def weighted_jaccard(a, b):
    """The probability Jaccard similarity of two dictionaries of weights."""
    return sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())


def test_signature_estimates_weighted_probability_jaccard():
    """Texts that repeat passages: equal registers follow the weighted value, not that of the sets."""
    from collections import Counter
    random.seed(12)
    errors, apart = [], []
    for trial in range(30):
        w = [f"t{trial}w{i}" for i in range(150)]
        a = " ".join(with_passage(w, 60, random.randint(2, 30)))
        b = " ".join(with_passage(w, 30, random.randint(1, 30)))
        bags = [Counter(tuple(x[i:i + 5]) for i in range(len(x) - 4)) for x in (words(a), words(b))]
        x, y = pa.array([a]), pa.array([b])
        weighted = weighted_jaccard(*bags)
        errors.append((M.signatures(x) == M.signatures(y)).mean() - weighted)
        sets = (M.signatures(x, False) == M.signatures(y, False)).mean()
        apart.append(abs(sets - len(bags[0].keys() & bags[1].keys()) / len(bags[0].keys() | bags[1].keys())))
    assert abs(np.mean(errors)) < 0.025 and np.std(errors) < 0.06 and np.mean(apart) < 0.05


def test_weighted_sketch_only_where_a_shingle_repeats():
    texts = pa.array(["a b c d e f g", None, "a b c d e f a b c d e f", "x y"])
    _, low, weighted = M._sketches(texts)
    assert [w is None for w in weighted.to_pylist()] == [True, True, False, True]
    assert weighted[2].as_py() == M._low(M.signatures(texts))[2] and low.to_pylist() == M._low(M.signatures(texts, False))


def test_similarity_to_the_class(spark):
    rows = [(i, t) for i, (_, t) in enumerate(passage_rows()[:8])] + [(20, "alone"), (21, "alone"), (22, None)]
    got = M.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    text_of = {bytes(r["node"]): dict(rows)[r["doc_id"]] for r in got}
    for r in got:
        x, y = pa.array([text_of[bytes(r["node"])]], pa.string()), pa.array([text_of[bytes(r["component"])]], pa.string())
        want = 1.0 if r["node"] == r["component"] else (M.signatures(x) == M.signatures(y)).mean()
        assert abs(r["similarity"] - want) < 0.03  # one byte of each register
    assert min(r["similarity"] for r in got) < 0.7  # a passage a hundred times: far in weights, near in sets


def test_hot_classes_join_like_the_others(spark, monkeypatch):
    monkeypatch.setattr(M, "HOT_PARTS", 3)
    rows = [(i, "one text of six words here") for i in range(30)] + [(100 + i, f"other text number {i} of five") for i in range(9)] + [(200, None)]
    compare(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_a_text_of_a_megabyte(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "short text")]
    compare(spark.createDataFrame(rows, "doc_id long, text string"), rows)
