"""Order MinHash against a plain version, and the neighbour edits against a sorted list."""

import hashlib
import random
import statistics

import numpy as np
import pytest

from innsight.llm import order_minhash as O


def plain_registers(text):
    """The definition, k-mer by k-mer."""
    width = min(O.K, len(text))
    grams = [text[i:i + width] for i in range(len(text) - width + 1)] if width else []
    if not grams:
        return [0] * O.HASHES
    base = [int(O.kmers(g)[0]) for g in grams]
    seen, keyed = {}, []
    for g, h in zip(grams, base):
        seen[g] = seen.get(g, -1) + 1
        keyed.append(int(O.mix(np.array([(h + seen[g] * int(O._GOLDEN)) % 2**64], np.uint64))[0]))
    out = []
    for f in range(O.HASHES):
        order = sorted(range(len(grams)), key=lambda i: (keyed[i] * int(O._FACTORS[f]) % 2**64, i))
        x = f + 1
        for i in sorted(order[:O.L]):
            x = int(O.mix(np.array([(x * int(O._BASE) + base[i]) % 2**64], np.uint64))[0])
        out.append(x >> 32)
    return out


random.seed(11)
TEXTS = ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaaaa", "日本語テキスト日本語テキスト", "é" * 9,
         *["".join(random.choice("abc d") for _ in range(random.randint(1, 200))) for _ in range(40)]]


@pytest.mark.parametrize("cells", [O.CELLS, 50])
def test_registers_equal_the_definition(monkeypatch, cells):
    monkeypatch.setattr(O, "CELLS", cells)
    for t in TEXTS:
        assert O.registers(t).tolist() == plain_registers(t)


def expected(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + nxt[:cut]
        a, b, c = (O.registers(x) for x in (t, edited, nxt))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), O.to_hex(a), O.to_hex(b),
                    O.likeness(a, b), O.likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [
    [(i, t) for i, t in enumerate(TEXTS)],
    [(i * i * 1000, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (None, None), (4000, "again"), (4000, "again")],
    [(7, "only one document here")], [(None, "x")], [(1, None), (1, None)], []])
def test_neighbours(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS n_chars", "1 AS place")
    got = [tuple(r) for r in O.edited_by_next(df).collect()]
    assert sorted(got, key=str) == expected(rows) if rows else not got


def test_documents_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = O.edited_by_next(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected([(r["doc_id"], r["text"]) for r in df.collect()])
    long = [r for r in got if r["n_chars"] > 300]
    assert statistics.mean(r["near_edited"] for r in long) > statistics.mean(r["near_next"] for r in long) + 0.1
    plain = {r["doc_id"]: r["fingerprint"] for r in O.fingerprint(df).collect()}
    assert all(plain[r["doc_id"]] == r["fingerprint"] for r in got)


def test_order_matters():
    """A moved passage keeps the k-mers but lowers the likeness."""
    random.seed(1)
    words = ["".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    a, b = " ".join(words), " ".join(words[100:] + words[:100])
    x = O.likeness(O.registers(a), O.registers(b))
    assert 0.2 < x < 0.85
