"""Count-only Viterbi against the tokenizers library's unigram model."""

import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from innsight.llm import token_count as C

MODEL = P.path("piece_bpe_32k.model")


def library(pieces, fallback, unk_id=0):
    t = Tokenizer(models.Unigram(pieces, unk_id=unk_id, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=C.MARK, prepend_scheme="always", split=False)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


random.seed(6)
TEXTS = ["", " ", "  ", "a", " a", "a ", "Hello  world", "\u2603\u2603 x\ny", "<unk>", "a<unk>b", "\ue000<unk>\ue001", "<s></s><0x41>",
         "\u2581x \u2581", "\ue000\ue001", "\U0010fffd mixed\ue123end", "日本語のテキスト", "x" * 3000, "naïve façade éêè",
         *["".join(random.choice(["the ", "in", "er", " ", "\n", "ß", "\ue000", "日", "9", "<unk>", "zq", "é"]) for _ in range(25))
           for _ in range(1500)]]


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_equal_the_library(fallback):
    pieces = C.read_pieces(MODEL)
    want = library(pieces, fallback)
    got = C.UnigramCounter(pieces, byte_fallback=fallback).counts(TEXTS)
    assert got == [want(t) for t in TEXTS]


def test_ties_follow_the_library():
    """Small vocabularies with equal path scores and different piece counts."""
    for seed in range(60):
        random.seed(seed)
        strings = {C.MARK} | {"".join(random.choice("ab" + C.MARK) for _ in range(random.randint(1, 4))) for _ in range(12)}
        strings = {s for s in strings if C.MARK not in s[1:]}
        pieces = [("<unk>", 0.0)] + [(s, float(-random.randint(1, 3) * len(s))) for s in sorted(strings)]
        want, tool = library(pieces, False), C.UnigramCounter(pieces, byte_fallback=False)
        for _ in range(100):
            t = "".join(random.choice("aab c") for _ in range(12))
            assert tool.counts([t]) == [want(t)], (pieces, t)


def test_column(spark, monkeypatch):
    monkeypatch.setattr("innsight.llm.bpe.CACHE_WORDS", 10)
    want = library(C.read_pieces(MODEL), True)
    rows = [(i, t, "old") for i, t in enumerate([None, *TEXTS[:40], "same", "same"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")
    got = {r["doc_id"]: r["n_tokens"] for r in C.count_tokens(df, MODEL).collect()}
    assert got == {i: want(t) if t else 0 for i, t, _ in rows}
    assert C.count_tokens(df.limit(0), MODEL).count() == 0


def test_documents_table(spark):
    want = library(C.read_pieces(MODEL), True)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in C.count_tokens(df, MODEL).collect()}
    assert got == {r["doc_id"]: want(r["text"]) for r in df.collect()}


RUNS = ["def f():\n" + " " * 8 + "return 1", " " * 16, " " * 33 + "x", "a  b   c    ", "  a", "x\n\n    y  ", "\ue000  \ue001 \ue000\ue001   ", "▁▁ ▁x",
        *["".join(random.choice(["  ", "    ", "a", "the", "\n", "\ue000", "ß", "▁"]) for _ in range(20)) for _ in range(500)]]


@pytest.mark.parametrize("fallback", [True, False])
def test_runs_of_spaces_meet_their_pieces(fallback):
    pieces = C.read_pieces(MODEL)
    want, tool = library(pieces, fallback), C.UnigramCounter(pieces, byte_fallback=fallback)
    assert not tool.whole
    texts = [*RUNS, *TEXTS]
    assert tool.counts(texts) == [want(t) for t in texts]
    assert not fallback or tool.counts(RUNS[:1]) == [9]


def test_a_vocabulary_that_reaches_over_a_cut_is_not_cut():
    pieces = [("<unk>", 0.0), (C.MARK, -2.0), ("a", -2.0), ("b", -2.0), ("a" + C.MARK + "b", -1.0)]
    want, tool = library(pieces, False), C.UnigramCounter(pieces, byte_fallback=False)
    assert tool.whole and [tool.counts([t])[0] for t in ("a b", "b a b a", "", " ")] == [want(t) for t in ("a b", "b a b a", "", " ")]


def test_a_text_of_a_megabyte():
    pieces = C.read_pieces(MODEL)
    text = "lorem  ipsum dolor\n" * 60_000
    assert C.UnigramCounter(pieces).counts([text]) == [library(pieces, True)(text)]
