"""Packing: exact cover, tokens, and the schedule against a plain deficit round-robin."""

import math
import random
from collections import defaultdict

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from innsight.llm import packing
from tests_llm_helpers import check_cover

JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def test_documents_table(spark, tok):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    check_cover(packing.pack(df, JSON).collect(), rows, tok)


def test_edge_rows(spark, tok):
    rows = [(1, None, "a"), (2, "", None), (3, "hello " * 9000, "a"), (4, "<|endoftext|>", "b"), (5, "x", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 AS length", "8 AS ids")
    check_cover(packing.pack(df, JSON).collect(), [r[:2] for r in rows], tok)
    twice = packing.pack(df.union(df), JSON).collect()
    assert sum(p["length"] for p in twice) == 2 * sum(p["length"] for p in packing.pack(df, JSON).collect())
    assert packing.pack(df.limit(0), JSON).count() == 0


def round_robin(queues, credit):
    """Plain deficit round-robin: (queue, key, round) in the order of service."""
    deficit, served, r = dict.fromkeys(queues, 0.0), [], 0
    queues = {q: list(v) for q, v in queues.items()}
    while any(queues.values()):
        for q in sorted(queues):
            deficit[q] += credit[q]
            while queues[q] and queues[q][0][1] <= deficit[q] + 1e-9:
                key, n = queues[q].pop(0)
                deficit[q] -= n
                served.append((q, key, r))
        r += 1
    return served


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.25, "c": 0.125}])
def test_schedule_is_deficit_round_robin(spark, targets):
    random.seed(4)
    rows = [((i % 3 << 33) + i, random.choice("aaab" + "c"), random.randint(1, 128)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, queue string, n long")
    plan = packing.schedule(df, targets, length=128, window_tokens=1024).collect()
    total = sum(n for *_, n in rows)
    queues = {q: sorted((k, n) for k, x, n in rows if x == q) for q in "abc"}
    credit = {q: 1024 * (targets[q] if targets else sum(n for _, n in v) / total) for q, v in queues.items()}
    want = round_robin(queues, credit)
    first = {}
    for p in plan:
        at = p["sequence_id"] * 128 + p["offset"] - p["first"]
        first.setdefault(p["key"], (at, p["window"]))
        assert first[p["key"]] == (at, p["window"])
    assert [k for k, _ in sorted(first.items(), key=lambda x: x[1][0])] == [k for _, k, _ in want]
    assert all(first[k][1] == r for _, k, r in want)
    # every window but the last ones keeps to the targets within a packet per queue
    filled = defaultdict(lambda: defaultdict(int))
    size = {k: n for k, _, n in rows}
    for q, k, r in want:
        filled[q][r] += size[k]
    for q in queues:
        ends = max(filled[q])
        for r in range(ends):
            assert abs(sum(filled[q][i] for i in range(r + 1)) - credit[q] * (r + 1)) <= 128
    assert sum(p["length"] for p in plan) == total
    assert max(p["sequence_id"] for p in plan) == math.ceil(total / 128) - 1


def test_ids_equal_the_tokenizers_library(tok):
    random.seed(8)
    enc = packing._encoder(open(JSON, encoding="utf-8").read())
    texts = ["a" * 100_000, "it's 12 ok\n\n  x\t\x85é日本 <|endoftext|>"] + [
        "".join(random.choice(["ab", "the ", " ", "\n", "É", "12", "'s", ".", "　", "ñ", "\x1c", "z"]) for _ in range(30))
        for _ in range(2000)]
    assert [enc.encode_ordinary(t) for t in texts] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_last_stage_keeps_the_ids(spark, tok):
    rows = [(1, "hello world", "a"), (2, "hello " * 3000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_cover(packing.pack_stage(spark, df, "").collect(), [r[:2] for r in rows], tok)


def test_target_mixture_of_the_registered_query(spark, tok):
    """Every window up to the first queue that runs out keeps to the targets, within a packet a queue."""
    from innsight.llm import queries
    sf = "/root/testdata/sf0.01"
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    filled, last = defaultdict(lambda: defaultdict(int)), {}
    for p in queries.op6_packing(spark, sf).collect():
        filled[source[p["doc_id"]]][p["window"]] += p["length"]
    ends = {q: max(w) for q, w in filled.items()}
    assert min(ends.values()) >= 0 and len(set(ends.values())) > 1
    for q, share in queries.MIXTURE.items():
        for r in range(ends[q]):
            assert abs(sum(filled[q][i] for i in range(r + 1)) - share * packing.WINDOW_TOKENS * (r + 1)) <= packing.LENGTH
