"""Secret spans against plain regex search over whole texts."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from innsight.llm import queries, secret_scan as S
SF_SMALL = "/root/testdata/sf0.01"  # holds secrets

HEX = "0123456789abcdef"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    for i, r in enumerate(S.ADDED_RULES, 3):
        out += [(m.start(), i, m.end()) for m in re.finditer(r.pattern, text)]
    return sorted(out)


random.seed(3)
PIECES = ["token = ", "Password:", "api_key='", "apikey=", "SECRET  :  \"", "passwd=", "AKIA", "ABCDEFGH1234", "abcdef01" * 4,
          "abcdefg", "x", " ", "\n", "é", "日本", "ghp_" + "a1" * 20, "xoxb-123456789012", "AIza" + "x" * 35, "sk_live_" + "9" * 20,
          "eyJabcdefgh.eyJabcdefgh.abcdefgh12", "-----BEGIN RSA PRIVATE KEY-----", "https://u:p@h/", "token", "ſecret=12345678",
          "to\u212aen=12345678", "=", "longvalue+/_.=-9"]
TEXTS = [None, "", "to", "token=short", "token=short token=longenough1", "f" * 31, "f" * 32, "F" * 40, "a" * 200_000,
         *["".join(random.choices(PIECES, k=random.randint(1, 12))) for _ in range(600)], "dup token=12345678", "dup token=12345678"]


def test_spans_equal_plain_search(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, SPANS int")
    got = {r["doc_id"]: r["spans"] for r in S.scan(df).collect()}
    kinds = [r.kind for r in S.RULES]
    for i, t in enumerate(TEXTS):
        assert [(s["start"], kinds.index(s["kind"]), s["end"]) for s in got[i]] == brute(t), t
    assert S.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("pattern,query", [
    ("abc", b"abc"), ("ab", True), ("a*bcd", b"bcd"), ("(abc|de)", True), ("ABCD+", ("and", [b"abc", b"bcd"])),
    ("[0-9a-f]{32,}", True), ("(abc|xyz)", ("or", [b"abc", b"xyz"])), ("abc.*xyz", ("and", [b"abc", b"xyz"])),
    ("abc[0-9]?def", ("and", [b"abc", b"def"])), ("(?:abc)?def", b"def"), ("ab(c|d)", ("or", [b"abc", b"abd"]))])
def test_derived_queries(pattern, query):
    assert S.trigram_query(pattern) == query


def holds(query, text):
    if query is True:
        return True
    if isinstance(query, bytes):
        return query in text.lower().encode()
    return (all if query[0] == "and" else any)(holds(p, text) for p in query[1])


def test_every_match_satisfies_its_query():
    for r in S.RULES:
        q = S.trigram_query(r.pattern)
        for t in filter(None, TEXTS):
            for m in re.finditer(r.pattern, t):
                assert holds(q, m[0].translate({i: i + 32 for i in range(65, 91)}))


def test_registered_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op8_secret_scan(spark, SF_SMALL).collect()
    assert len(rows) == len(docs) and any(r["n_assign"] for r in rows)
    kinds = [r.kind for r in S.RULES]
    for r in rows:
        spans = brute(docs[r["doc_id"]])
        base = ",".join(f"{kinds[i]}:{a}:{b}" for a, i, b in spans if i < 3)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"] == ",".join(f"{kinds[i]}:{a}:{b}" for a, i, b in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(i == k for _, i, _ in spans) for k in range(3))


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a token=12345678 b", 18), (2, "clean", 5), (3, None, None), (4, "x" + "a1" * 20 + "y", 42)],
                               "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in S.redact_stage(spark, df, "").collect()}
    assert got[1]["text"] == "a <secret> b" and got[1]["n_chars"] == 12
    assert got[2]["text"] == "clean" and got[3]["text"] is None and got[3]["n_chars"] is None
    assert got[4]["text"] == "x<secret>y"
    for t in filter(None, TEXTS):
        spans = brute(t)
        out = S.redact_text(t, spans, "\0")
        covered = set().union(*(range(a, b) for a, _, b in spans))
        assert out.replace("\0", "") == "".join(c for i, c in enumerate(t) if i not in covered)


BODY = ["MIIEpAIBAAKCAQEA" + "".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/", k=48)) for _ in range(6)] + ["q7Zk+A=="]
KINDS = ["RSA PRIVATE KEY", "PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK"]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("newline,lead", [("\n", ""), ("\r\n", ""), ("\\n", ""), ("\n", "    "), ("\n", "> "), (" ", "")])
@pytest.mark.parametrize("headers", [[], ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B", ""]])
@pytest.mark.parametrize("ended", [True, False])
def test_no_part_of_a_private_key_stays(kind, newline, lead, headers, ended):
    last = [f"-----END {kind}-----"] if ended else []
    key = newline.join([f"-----BEGIN {kind}-----", *(lead + x for x in [*headers, *BODY, *last])])
    text = f"before {key}{newline}plain words after the key{newline}more"
    _, (spans,) = S.Scanner(S.RULES).spans(pa.array([text]))
    assert S.redact_text(text, spans, "<secret>") == f"before <secret>{newline}plain words after the key{newline}more"


def test_private_key_cut_off_and_next_to_others():
    def clean(text):
        _, (spans,) = S.Scanner(S.RULES).spans(pa.array([text]))
        return S.redact_text(text, spans, "<secret>")
    head, end = "-----BEGIN PRIVATE KEY-----\n", "\n-----END PRIVATE KEY-----"
    assert clean("a\n" + head + "\n".join(BODY[:2]) + "\n" + BODY[2][:5]) == "a\n<secret>"
    cut = head + "\n".join(BODY)  # its END line is missing, another key follows
    assert clean(cut + "\nsome words between\n" + cut + end + "\nz") == "<secret>\nsome words between\n<secret>\nz"
    assert clean("a header '-----BEGIN PRIVATE KEY-----' in prose stays") == "a header '<secret>' in prose stays"
    assert clean((head + "- " * 50) * 2000).count("<secret>") == 2000


@pytest.mark.parametrize("size", [1, 100, 201, 5_000, 300_000])
def test_logins_of_any_length(size):
    import pyarrow as pa
    scanner = S.Scanner(S.RULES)
    text = f"see https://{'u' * size}:{'p' * size}@host/x and http://a:b c@d"
    _, (spans,) = scanner.spans(pa.array([text]))
    kinds = [(text[a:b], S.RULES[i].kind) for a, i, b in spans]
    assert (f"://{'u' * size}:{'p' * size}@", "url_login") in kinds and sum(k == "url_login" for _, k in kinds) == 1
