"""Merkle manifest against a plain tree in Python and against DuckDB."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from innsight.llm import merkle as M, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, g int, i int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, add=0):
    d, s, l, n, t = row[:5]
    values = [d, s, l, None if n is None else n + add, t]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, fanout):
    """(root, per leaf its (before, after) by level)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for leaf, p in zip(at, paths):
            run = leaf // fanout * fanout
            p.append(("".join(level[run:leaf]), "".join(level[leaf + 1:run + fanout])))
        level = [h("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
        at = [a // fanout for a in at]
    return level[0], paths


def plain(rows, fanout=2):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees.append(plain_tree([x[2] for x in groups[g]], fanout))
    root, tops = plain_tree([t[0] for t in trees], fanout)
    out = []
    for g, (sub, paths), top in zip(names, trees, tops):
        for (*_, leaf, r), path in zip(groups[g], paths):
            whole = path + top
            node = plain_leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf
            for a, b in whole:
                node = h(a + node + b)
            out.append((r[0], leaf, sub, root, h("".join(a + b for a, b in whole)), node, node == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))
                   for r in df.collect()), key=str)


random.seed(3)
CASES = {
    "one": [(1, "s", "en", 3, "abc", "r", 5, 6)],
    "nulls": [(None, None, None, None, None, None, None, None), (7, None, None, None, "", "", 1, 1), (8, "é", "", 2, "日本", "x", 1, 1),
              (None, "s", "en", 1, "x", "", 1, 1), (14, "s", "Z", None, "y", "", 1, 1), (15, "s", "é", 9, "y", "", 1, 1)],
    "repeated": [(4, "s", "en", 1, "same", "", 1, 1)] * 5 + [(4, "s", "en", 1, "other", "", 1, 1), (9, "s", "fr", 1, "q" * 100_000, "", 1, 1)],
    "uneven": [(d, f"s{d % 3}", random.choice(["en", "en", "en", "de", None]), d, f"t{d}", "", 1, 1) for d in random.sample(range(10_000), 301)],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_the_plain_tree(spark, name, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)  # several rounds, and blocks that are cut inside a group
    assert got(M.audit(spark.createDataFrame(CASES[name], SCHEMA))) == plain(CASES[name])


def test_whole_blocks_and_other_fanouts(spark):
    rows = [(d, "s", "en" if d % 5 else "de", d, f"t{d}", "", 1, 1) for d in range(2600)]
    assert got(M.audit(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    some = rows[:100]
    made = M.manifest(spark.createDataFrame(some, SCHEMA), M.FIELDS, ["doc_id"], "lang", fanout=3)
    want = {r[0]: r for r in plain(some, 3)}
    for r in made.withColumn("proof", F.sha2(M.siblings(F.col("path")), 256)).withColumn("folded", M.fold(F.col("leaf"), F.col("path"))).collect():
        assert (r["leaf"], r["subroot"], r["root"], r["proof"]) == want[r["doc_id"]][1:5] and r["folded"] == r["root"]
    with pytest.raises(ValueError):
        M.manifest(spark.createDataFrame(some, SCHEMA), M.FIELDS, ["doc_id"], "lang", fanout=1)


def test_empty_table_and_clashing_names(spark):
    assert M.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "k1 long, leaf string, node int")
    made = M.manifest(df, ["k1", "leaf"], ["k1"], "leaf", carried={"node": F.col("node")})
    assert made.columns == ["k1", "node", *M.OUTPUTS] and made.filter("length(root) = 64").count() == 2


def test_registered_query_equals_duckdb_and_the_plain_tree(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    rows = con.sql("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()
    want = plain(rows)
    assert got(queries.op12_merkle_manifest(spark, sf)) == want
    cols = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert sorted(con.sql(f"SELECT {cols} FROM ({M.duckdb_sql()})").fetchall(), key=str) == want
    assert {v for *_, v in want} == {True, False}


@pytest.mark.parametrize("name", CASES)
def test_sql_equals_the_plain_tree(name):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in CASES[name]])
    cols = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert sorted(con.sql(f"SELECT {cols} FROM ({M.duckdb_sql()})").fetchall(), key=str) == plain(CASES[name])
