"""BPE against tiktoken, and the exact round trip."""

import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from innsight.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
random.seed(7)
TEXTS = [None, "", "a", " ", "  \n\n x", "it's the end's 123 4567", "Éàü ß 日本語 naïve", "\x00\x85  z",
         "a" * 3000, "ab" * 700 + " " + "aab" * 500, "".join(random.choice("abcdefgh0123 .,\n") for _ in range(20000)),
         "".join(random.choice("etaoinshrdlu") for _ in range(1500)), "<|endoftext|>", "same", "same", " lead", "trail ", "tab\t x", "a  b c", "a\u00a0 b", "x \n\n y z", "é 12 ,. ;", "one two three\n\nfour five"]


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(RANKS)),
                             special_tokens={})


def test_encode_equals_tiktoken_and_decodes(spark, tik):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, `token_ids.` string")
    ids = bpe.encode(df, "text", RANKS, P.PATTERN)
    got = {r["doc_id"]: r for r in bpe.decode(ids, "token_ids", RANKS).collect()}
    for i, t in enumerate(TEXTS):
        want = tik.encode_ordinary(t or "")
        assert list(struct.unpack(f"<{len(want)}I", got[i]["token_ids"])) == want
        assert bytes(got[i]["decoded"]) == (t or "").encode()
    assert got[3]["token_ids."] == "x"
    once = {r["doc_id"]: r for r in bpe.round_trip(df, "text", RANKS, P.PATTERN).collect()}
    assert all(once[i][c] == got[i][c] for i in got for c in ("token_ids", "decoded"))


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, "hello you", b"old", "old")], "doc_id long, text string, TOKEN_IDS binary, decoded string")
    r = bpe.decode(bpe.encode(df, "text", RANKS, P.PATTERN), "token_ids", RANKS).collect()[0]
    assert bytes(r["decoded"]) == b"hello you"
    assert bpe.encode(df.limit(0), "text", RANKS, P.PATTERN).count() == 0


def test_long_words_use_the_same_result(spark, tik, monkeypatch):
    enc = bpe.WordEncoder(bpe.read_ranks(RANKS), P.PATTERN)
    words = ["".join(random.choice("abcde") for _ in range(n)) for n in (2, 5, 40, 90)] * 3 + ["aaaaaaa", "ababab"]
    raw = [w.encode() for w in words]
    assert enc._contract(raw, bpe.LEFTMOST_SQL) == enc._contract(raw, bpe.ALL_OCCURRENCES_SQL)


def test_every_vocabulary_entry_contracts_to_itself(tik):
    """The premise of contracting all occurrences of a pair in one step."""
    ranks = bpe.parse_ranks(bpe.read_ranks(RANKS))
    enc = bpe.WordEncoder(bpe.read_ranks(RANKS), P.PATTERN)
    tokens = [t for t in ranks if len(t) <= bpe.LONG_WORD]
    assert enc._contract(tokens, bpe.LEFTMOST_SQL) == [ranks[t].to_bytes(4, "little") for t in tokens]


def test_bad_ids_and_cache_bound(spark, monkeypatch):
    dec = bpe.RunDecoder(bpe.read_ranks(RANKS))
    with pytest.raises(ValueError):
        dec.decode([struct.pack("<I", 60000)])
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    enc = bpe.WordEncoder(bpe.read_ranks(RANKS), P.PATTERN)
    for t in ("one two three four", "five six seven", "one two"):
        assert b"".join(dec.decode(enc.encode([t]))) == t.encode()
        assert len(enc.known) <= 8


def test_random_white_space(tik):
    enc = bpe.WordEncoder(bpe.read_ranks(RANKS), P.PATTERN)
    texts = ["".join(random.choice(["a", "bc", " ", " ", "\n", "'s", "1", "\u2003", ",", "É", "\x1c"]) for _ in range(12)) for _ in range(3000)]
    got = enc.encode(texts)
    for t, g in zip(texts, got):
        want = tik.encode_ordinary(t)
        assert g == struct.pack(f"<{len(want)}I", *want)
