"""Brute-force versions shared by the tests."""

import struct
import zlib
from collections import defaultdict

from innsight.llm import packing


def words(text):
    return [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]


def shingle_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(rows):
    """id → least id of its class, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    seen = {}
    for i, (_, t) in enumerate(rows):
        parent[root(i)] = root(seen.setdefault(t or "", i))
    where = {}
    for i in seen.values():
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    for i in seen.values():
        met = {}
        for s in sets[i]:
            for j in where[s]:
                if j < i:
                    met[j] = met.get(j, 0) + 1
        for j, n in met.items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return {i: least.get(root(i)) for i in range(len(rows))}


def check_cover(pieces, rows, tok, ids=True):
    """Each document's ids lie in exactly one piece; every sequence is filled without gaps."""
    want = sorted((d, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in rows)
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        if not ids:  # the ids themselves are gone; their checksum stays
            whole = next(w for d, w in want if d == p["doc_id"])
            part = whole[p["start"]:p["start"] + p["length"]]
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == p["ids_crc32"]
        else:
            part = struct.unpack(f"<{p['length']}I", p["ids"])
            assert zlib.crc32(p["ids"]) == p["ids_crc32"]
        assert p["length"] == len(part) > 0
        docs[p["doc_id"]].append((p["start"], part, p["doc_tokens"]))
    got = []
    for d, parts in docs.items():
        parts.sort()
        joined = [i for _, x, _ in parts for i in x]
        assert [s for s, _, _ in parts] == [sum(len(x) for _, x, _ in parts[:k]) for k in range(len(parts))]
        assert all(n == len(joined) for *_, n in parts)
        got.append((d, tuple(joined)))
    assert sorted(got) == want
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == packing.LENGTH or s == len(sequences) - 1 and at <= packing.LENGTH
