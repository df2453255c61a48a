"""Alignment against a plain version with both tokenizer libraries, and the merges against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from innsight.llm import alignment as A, queries
from innsight.llm.packing import byte_level_ranks

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain(texts):
    """Per text (n_a, n_b, n_groups, n_links, groups, n_best, count_sum)."""
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(A_PATH)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    with open(A_PATH, encoding="utf-8") as f:
        raw = {i: x for x, i in byte_level_ranks(f.read()).items()}

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
    out, links = [], []
    for text in texts:
        sides = []
        if text:
            sides = [[(i, raw[i]) for i in t.encode(" " + text, add_special_tokens=False).ids], [(i, piece(i)) for i in sp.encode(text)]]
        if not text or any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
            out.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = []
        for side in sides:
            at, found = 0, {}
            for i, x in side:
                at += len(x)
                found.setdefault(at, []).append(i)
            ends.append(found)
        common = sorted(ends[0].keys() & ends[1].keys())
        mine = [(a, b) for e in common for a in ends[0][e] for b in ends[1][e]]
        written = []
        for side in ends:
            parts, shared = [[]], set(common)
            for e in sorted(side):
                parts[-1] += [str(i) for i in side[e]]
                if e in shared:
                    parts.append([])
            written.append([",".join(x) for x in parts[:-1]])
        out.append((len(sides[0]), len(sides[1]), len(common), len(mine), ";".join(map("|".join, zip(*written)))))
        links.append(mine)
    count = Counter(x for mine in links for x in mine)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    return [(*row, sum(count[x] == most[x[1]] for x in mine), sum(count[x] for x in mine)) for row, mine in zip(out, links)]


random.seed(11)
TEXTS = [None, "", " ", "a", "the cat", "the cat", "the cat sat", "<|endoftext|> <s> </s> <unk>", "x▁y", "日本語 naïve É́", "\x00\x01 \t\n\n  x",
         "   lead", "trail   ", "1234567890" * 50, "ab" * 3000, "word " * 4000, "\U0001f600\U0001f600 <0x41>", "ß" * 500, "　  x",
         *["".join(random.choices(["the ", "of", " and", "\n", "é", "ing ", "12", ".", " ", "Q"], k=random.randint(1, 60))) for _ in range(80)]]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")


@pytest.mark.parametrize("options", [{}, {"group_bytes": 50, "fan_in": 2, "run_links": 40}])
def test_equals_the_plain_version(spark, options):
    """The second case: many small runs, many groups a radix, several rounds of merges."""
    rows = [(i, t, "old", 7, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, GROUPS string, key int, radix string").repartition(5)
    got = {r["doc_id"]: r for r in A.align(df, A_PATH, B_PATH, **options).collect()}
    assert len(got) == len(TEXTS)
    for i, want in enumerate(plain(TEXTS)):
        assert tuple(got[i][c] for c in COLUMNS) == want, TEXTS[i]
        assert got[i]["groups_sha256"] == (hashlib.sha256(want[4].encode()).hexdigest() if want[4] else "")
        assert (got[i]["key"], got[i]["radix"]) == (7, "x")


def test_empty_table_null_keys_and_tokenless(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert A.align(none, A_PATH, B_PATH).count() == 0
    df = spark.createDataFrame([(None, None), (None, ""), (None, "a▁")], "doc_id long, text string")
    assert [tuple(r[c] for c in COLUMNS) for r in A.align(df, A_PATH, B_PATH).collect()] == [(0, 0, 0, 0, "", 0, 0)] * 3


def test_a_long_text(spark):
    text = " ".join(random.choices(["lorem", "ipsum,", "dolor", "1984", "\n", "élan"], k=200_000))
    got = A.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), A_PATH, B_PATH).collect()[0]
    assert tuple(got[c] for c in COLUMNS) == plain([text])[0]


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op13_tokenizer_alignment(spark, sf).collect()}
    for d, want in zip(docs, plain([d["text"] for d in docs])):
        r = got[d["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == (*want[:4], *want[5:])
        assert r["groups_sha256"] == (hashlib.sha256(want[4].encode()).hexdigest() if want[4] else "")


def test_merge_counts_and_marks():
    rng = np.random.default_rng(5)
    for k in (1, 2, 7, 40):
        runs, whole = [], Counter()
        for _ in range(k):
            keys = np.sort(rng.integers(0, 50, rng.integers(1, 400)) * (1 << A.A_BITS) // 3)
            times = rng.integers(1, 1 << 20, len(keys))
            for x, n in zip(keys.tolist(), times.tolist()):
                whole[x] += n
            blob = b"".join(A.pack_blocks([keys, times], records=16))
            assert [np.concatenate(c).tolist() for c in zip(*A.read_blocks([blob]))] == [keys.tolist(), times.tolist()]
            runs.append([blob])
        parts = list(A.with_best(A.counted(A.merged([A.read_blocks(r) for r in runs]))))
        keys, sums, best = (np.concatenate(c).tolist() for c in zip(*parts))
        assert keys == sorted(whole) and dict(zip(keys, sums)) == dict(whole)
        most = {}
        for x, n in whole.items():
            most[x >> A.A_BITS] = max(n, most.get(x >> A.A_BITS, 0))
        assert best == [int(whole[x] == most[x >> A.A_BITS]) for x in keys]
