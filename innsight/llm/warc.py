"""WARC archives of captures, read back, and their index merged to one global order.

Writing: payloads are compared by SHA-1; of equal ones the capture with the least id is a ``response``
record, the others are ``revisit`` records that refer to it. Every task sorts its records by URL key and
timestamp and writes one compressed archive (a locally sorted run) with Spark's text writer: the
record separator of the format is the writer's line separator. Reading: Spark streams each archive, cut
at the version line; a task joins the cuts to records by their Content-Length, so payloads may hold
anything, and recomputes size and digest. The index entries of an archive are a sorted run again. An archive is one gzip stream:
``offset`` is the record's place in the unpacked stream, which is read from its beginning.

External merge: the entries are stored, dealt to key ranges (URL key, timestamp, id, so that a hot
URL is split by time) of bounded size, and every range merges the runs' parts with a loser tree: one comparison per
level for each entry. ``capture_order`` increases over ranges and within them.

Defined results: null html = empty payload; null url = no target and URL key ''; CR and LF in a URL are
written as %0D and %0A. Rows equal in id and payload are equal captures: all of them are responses. Captures
without an id are responses unless a capture with an id has their payload. An empty table gives an
empty index.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.common import map_in_arrow, quoted, stored

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:capture:"
RANGE_ROWS = 100_000  # index entries that a task merges


def base32_of_hex(sha1_hex: Column) -> Column:
    """RFC 4648 base 32 of a SHA-1 in hex: five hex digits are four base-32 digits."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the right, then path and query, without scheme, port and fragment."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]*)", 1)), "^www\\.", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    return F.when(host == "", bare).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest))


def with_record_types(captures: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``captures`` (id, url, at, payload) with size, digest, and refers_to: the id that a revisit refers to, else
    null. Only digests, ids and counts are aggregated, with partial sums; a digest that many captures share is one row of the
    joined side, so a skewed join splits."""
    rows = captures.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", base32_of_hex(F.sha1("payload")))
    first = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = first.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    return rows.join(shared, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def record(c: DataFrame) -> Column:
    """One WARC record without its version line's predecessor and final separator."""
    line = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(END))
    response = F.col("refers_to").isNull()
    block = F.when(response, F.concat(http, F.col("payload"))).otherwise(http)
    target = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    head = [F.lit(VERSION + "WARC-Type: "), F.when(response, "response").otherwise("revisit"), line,
            F.lit(f"WARC-Record-ID: <{ID}"), name, F.lit(">\r\nWARC-Date: "),
            F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), line,
            F.coalesce(F.concat(F.lit("WARC-Target-URI: "), target, line), F.lit("")),
            F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), line,
            F.coalesce(F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <{ID}"),
                                F.col("refers_to").cast("string"), F.lit(">\r\n")), F.lit("")),
            F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
            F.octet_length(block).cast("string"), F.lit(END), block]
    return F.concat(*head)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html",
          at: Column | None = None, least_bytes: int = 0) -> None:
    """Archives of ``pages`` below ``path``. ``at`` is the capture time (default: seconds counted by the id)."""
    time = F.timestamp_seconds(F.coalesce(quoted(id_col), F.lit(0)) + 1_700_000_000) if at is None else at
    captures = pages.select(quoted(id_col).cast("long").alias("id"), quoted(url).alias("url"), time.alias("at"),
                            F.coalesce(quoted(html), F.lit("")).alias("payload"))
    typed = with_record_types(captures, least_bytes)
    run = typed.withColumn("key", url_key(F.col("url"))).sortWithinPartitions("key", "at", "id")
    run.select(record(run).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def parse_records(chunks: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """(file, offset, headers, block) of the records in (file, text after a version line), in file order."""
    mark = VERSION.encode()
    file, at, start, have, end, need = None, 0, 0, 0, -1, 1 << 62
    parts: list[bytes] = []  # of the record that is read; its head is found once, then bytes are only counted
    headers: dict[str, str] = {}
    for f, chunk in chunks:
        if f != file:
            if parts:
                raise ValueError(f"cut record at the end of {file}")
            file, at = f, len(chunk)  # what stands before the first version line of a file: nothing
            if chunk:
                raise ValueError(f"not an archive: {file}")
            continue
        if not parts:
            start, have, end, need = at, 0, -1, 1 << 62
        else:
            parts.append(mark)  # the payload holds a version line
            have += len(mark)
        parts.append(chunk)
        have += len(chunk)
        at += len(mark) + len(chunk)
        if end < 0:
            head = b"".join(parts)
            parts, end = [head], head.find(b"\r\n\r\n")
            if end >= 0:
                headers = dict(x.split(": ", 1) for x in head[:end].decode().split("\r\n"))
                need = end + 8 + int(headers.get("Content-Length", 1 << 62))
        if have >= need:
            whole = b"".join(parts)
            if have > need or whole[-4:] != END.encode():
                raise ValueError(f"bad record at {start} of {file}")
            yield file, start, headers, whole[end + 4:-4]
            parts = []
    if parts:
        raise ValueError(f"cut record at the end of {file}")


ENTRY = "file string, offset long, id long, url string, at string, record_type string, refers_to long, size long, digest string"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """One index entry per record of the archives below ``path``; an archive is never split, so its entries come in order."""
    chunks = spark.read.option("lineSep", VERSION).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("chunk"))
    names = [c.split()[0] for c in ENTRY.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in ENTRY.split(", ")]

    def number(text: str | None) -> int | None:
        tail = (text or "none").strip("<>").removeprefix(ID)
        return None if tail == "none" else int(tail)

    def entries(batches):
        def pairs():
            for batch in batches:
                yield from zip(batch.column("file").to_pylist(), batch.column("chunk").to_pylist())
        out = []
        for file, offset, h, block in parse_records(pairs()):
            http, _, payload = block.partition(END.encode())
            if h["WARC-Type"] == "response":
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if f"sha1:{digest}" != h["WARC-Payload-Digest"]:
                    raise ValueError(f"bad digest at {offset} of {file}")
            else:  # the size and digest of the full payload are those of the record referred to
                size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
            out.append((file, offset, number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Date"], h["WARC-Type"],
                        number(h.get("WARC-Refers-To")), size, digest))
            if len(out) == 5000:
                yield _batch(out, names, kinds)
                out = []
        if out:
            yield _batch(out, names, kinds)

    return map_in_arrow(chunks, entries, ENTRY)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class LoserTree:
    """Merges sorted lists: inner nodes hold the loser of the match below, the winner is above the root."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = len(runs)
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k else -1

    def _head(self, i: int):
        """Sort key of run i's next item; an ended run loses to all."""
        run, at = self.runs[i], self.at[i]
        return (0, run[at], i) if at < len(run) else (1, i)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._head(b) < self._head(a):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self):
        while self.k and self.at[self.winner] < len(self.runs[self.winner]):
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            node = (w + self.k) // 2
            while node:
                if self._head(self.losers[node]) < self._head(w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def merge_index(entries: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The entries with ``url_key`` and ``capture_order``, globally ordered by URL key, time and id. A task merges one key range
    of about ``range_rows`` entries at most, and Spark hands it the runs' parts one after the other, each in its order."""
    runs = stored(entries.withColumn("url_key", url_key(F.col("url"))), "index-runs")
    order = ["url_key", "at", "id", "file", "offset"]
    ranges = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    ranged = runs.repartitionByRange(ranges, *order).sortWithinPartitions("file", "offset")

    def merge(batches):
        batches = list(batches)  # one key range's small rows
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        lists: dict[str, list] = {}
        for i, (key, at, id_, file, offset) in enumerate(zip(*(table.column(c).to_pylist() for c in order))):
            lists.setdefault(file, []).append(((key, at, id_ is not None, id_ or 0, file, offset), i))
        merged = pa.array([i for _, i in LoserTree(list(lists.values()))], pa.int64())
        base = TaskContext.get().partitionId() << 33
        table = table.take(merged).append_column("capture_order", pa.array(range(base, base + table.num_rows), pa.int64()))
        yield from table.to_batches(max_chunksize=10_000)

    return map_in_arrow(ranged, merge, runs.schema.add("capture_order", "long"))


def captures(pages: DataFrame, path: str, **options) -> DataFrame:
    """Writes the archives of ``pages`` below ``path`` and returns their merged index."""
    write(pages, path, **options)
    return merge_index(read_entries(pages.sparkSession, path))
