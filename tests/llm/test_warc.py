"""WARC round trip, record types, and the order of the merged index."""

import base64
import gzip
import glob
import hashlib
import random
import tempfile

import pytest

from innsight.llm import queries, warc


def expected(rows):
    """page_id, bytes, digest, type, refers_to of (page_id, url, html)."""
    least = {}
    for p, _, h in rows:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    out = []
    for p, _, h in rows:
        raw, first = (h or "").encode(), least.get(h or "")
        revisit = first is not None and p != first
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


random.seed(10)
HTML = ["", None, "x", "<p>é日本</p>", "a\r\n\r\nb", "WARC/1.1\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\n", "\r\n\r\n",
        "WARWARC/1.1\r\n", "y" * 300_000, "\u0000\x0b tab\t"]
URLS = [None, "", "http://a.example.com/x?y#z", "https://www.A.example.com:8080/x", "no url", "http://u@b.org", "http://c.net/a\r\nb"]
ROWS = [(i, random.choice(URLS), random.choice(HTML)) for i in random.sample(range(1000), 120)] + [
    (None, "http://d.org/", "only null"), (None, None, "x"), (5000, "http://e.org/", "same"), (5000, "http://e.org/", "same")]


def fields(index):
    return sorted(((r["id"], r["size"], r["digest"], r["record_type"], r["refers_to"]) for r in index), key=str)


def test_round_trip(spark):
    path = tempfile.mkdtemp(prefix="innsight-warc-") + "/archives"
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(5).selectExpr("*", "1 AS size", "2 AS id")
    index = warc.captures(df, path).collect()
    assert fields(index) == expected(ROWS)
    raw = {f"file://{f}" if not f.startswith("file") else f: gzip.open(f).read() for f in glob.glob(path + "/*.gz")}
    for r in index:  # file and offset lead to the record
        data = next(v for k, v in raw.items() if k.rsplit("/", 1)[1] == r["file"].rsplit("/", 1)[1])
        assert data[r["offset"]:].startswith(warc.VERSION.encode() + f"WARC-Type: {r['record_type']}\r\n".encode())
    keys = [(r["url_key"], r["at"], r["id"] if r["id"] is not None else -1) for r in sorted(index, key=lambda r: r["capture_order"])]
    assert keys == sorted(keys)
    assert len({r["capture_order"] for r in index}) == len(index)
    assert "com,example,a)/x?y" in {r["url_key"] for r in index} and "com,example,a)/x" in {r["url_key"] for r in index}


def test_least_bytes(spark):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")]
    path = tempfile.mkdtemp(prefix="innsight-warc-") + "/archives"
    got = warc.captures(spark.createDataFrame(rows, "page_id long, url string, html string"), path, least_bytes=3).collect()
    assert {r["id"]: r["refers_to"] for r in got} == {1: None, 2: None, 3: None, 4: 3}


def test_empty_table(spark):
    path = tempfile.mkdtemp(prefix="innsight-warc-") + "/archives"
    assert warc.captures(spark.createDataFrame([], "page_id long, url string, html string"), path).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    for _ in range(50):
        runs = [sorted(random.choices(range(20), k=random.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("chunks", [[("f", b""), ("f", b"Content-Length: 9\r\n\r\nab")], [("f", b"junk")],
                                    [("f", b""), ("f", b"Content-Length: 1\r\n\r\nab\r\n\r\n")]])
def test_damaged_archives(chunks):
    with pytest.raises(ValueError):
        list(warc.parse_records(iter(chunks)))


def test_pages_table(spark):
    sf = "/root/testdata/sf0.001"
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = queries.op7_warc(spark, sf).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(pages)


def test_a_hot_url_is_cut_over_ranges(spark):
    """One URL holds nearly all captures: ranges stay small, and the order is global."""
    rows = [(i, "http://hot.example.com/" if i % 50 else f"http://c{i}.org/", f"body {i % 400}") for i in range(3000)]
    path = tempfile.mkdtemp(prefix="innsight-warc-") + "/archives"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), path)
    entries = warc.read_entries(spark, path)
    index = warc.merge_index(entries, range_rows=100).collect()
    assert fields(index) == expected(rows)
    sizes = {}
    for r in index:
        sizes[r["capture_order"] >> 33] = sizes.get(r["capture_order"] >> 33, 0) + 1
    assert len(sizes) > 20 and max(sizes.values()) < 400
    keys = [(r["url_key"], r["at"], r["id"]) for r in sorted(index, key=lambda r: r["capture_order"])]
    assert keys == sorted(keys)


def test_payloads_full_of_version_lines_take_linear_time():
    import time

    def seconds(n):
        block = warc.VERSION.encode() * n
        chunks = [("f", b""), ("f", b"WARC-Type: x\r\nContent-Length: %d\r\n\r\n" % len(block)), *[("f", b"")] * (n - 1), ("f", warc.END.encode())]
        best = 9.0
        for _ in range(3):
            began = time.process_time()
            (record,) = warc.parse_records(iter(chunks))
            best = min(best, time.process_time() - began)
            assert record[3] == block and record[1] == 0
        return best
    assert seconds(160_000) < 20 * seconds(16_000) + 0.1
