"""Document fingerprints sensitive to edit distance: Order MinHash.

Every k-mer of code points carries its occurrence number, so repeats count. For each of HASHES
functions the L k-mers of least hash are selected, put in text order, and their tuple is hashed to one
register. Two texts share a register when the same minimal k-mers stand in the same order, so the
share of equal registers falls with edits and with moved passages alike.

Defined results: null text = empty text. A text shorter than K is its own only k-mer; a text
without k-mers (empty) has registers 0, alike only to another empty text. Fingerprints depend on the
text alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.common import map_in_arrow, quoted, ship, with_arrow
from innsight.llm.minhash import mix

K = 8            # code points of a k-mer
L = 2            # k-mers of a register
HASHES = 32
CELLS = 4_000_000  # hash values held at a time
SLICE_BYTES = 4_000_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def kmers(text: str) -> np.ndarray:
    """The 64-bit hashes of the k-mers in text order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = min(K, len(points))
    n = len(points) - width + 1 if width else 0
    h = np.full(n, np.uint64(width))
    for i in range(width):
        h *= _BASE
        h += points[i:n + i]
    return mix(h)


def numbered(h: np.ndarray) -> np.ndarray:
    """The hashes of (k-mer, occurrence number)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    at = np.arange(len(s))
    first = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], at, 0))
    number = np.empty(len(s), np.uint64)
    number[order] = at - first
    return mix(h + number * _GOLDEN)


def registers(text: str) -> np.ndarray:
    h = kmers(text)
    n = len(h)
    if not n:
        return np.zeros(HASHES, np.uint32)
    x = numbered(h)
    picked = np.empty((HASHES, min(L, n)), np.int64)
    step = max(1, CELLS // n)
    for a in range(0, HASHES, step):
        values = x[None, :] * _FACTORS[a:a + step, None]
        rows = np.arange(len(values))
        for j in range(picked.shape[1]):
            picked[a:a + step, j] = least = values.argmin(axis=1)
            values[rows, least] = _MOST
    picked.sort(axis=1)  # back in text order
    out = np.arange(1, HASHES + 1, dtype=np.uint64)
    for j in range(picked.shape[1]):
        out = mix(out * _BASE + h[picked[:, j]])
    return (out >> np.uint64(32)).astype(np.uint32)


def to_hex(r: np.ndarray) -> str:
    return r.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The other columns of ``df`` and ``out``: the registers in hex, eight digits each."""
    def per_slice(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([to_hex(registers(t or "")) for t in texts.to_pylist()], pa.string())]
    return with_arrow(df, text, [T.StructField(out, T.StringType())], per_slice, SLICE_BYTES)


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` (id, text) in descending order of id within buckets of neighbouring ids (largest ids in bucket 0,
    nulls last), each bucket followed by the first rows of the next one (``guest``); the first follows
    the last. One shuffle; only bucket bounds, at most one id each, come to the driver."""
    spark = df.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    cuts = df.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = np.unique(np.asarray([c for c in cuts if c is not None], np.int64))

    def number(ids) -> np.ndarray:
        up = np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="left")
        return np.where(ids.isna(), len(bounds) + 1, len(bounds) - up)

    @F.pandas_udf("int")
    def bucket(ids):
        import pandas as pd
        return pd.Series(number(ids.astype("Int64")))

    heads = sorted(df.select("id").groupBy(bucket("id").alias("b")).agg(F.max("id").alias("head")).collect())
    before = {int(r["b"]): int(heads[i - 1]["b"]) for i, r in enumerate(heads)}
    head = {int(r["b"]): r["head"] for r in heads}

    @F.pandas_udf("array<int>")
    def places(ids):
        """2 * bucket for the row itself, 2 * bucket + 1 for a guest."""
        import pandas as pd
        ids = ids.astype("Int64")
        out = []
        for b, i in zip(number(ids).tolist(), ids.tolist()):
            guest = head[b] is None if i is pd.NA else i == head[b]
            out.append([2 * b, 2 * before[b] + 1] if guest else [2 * b])
        return pd.Series(out)

    placed = df.withColumn("place", F.explode(places("id")))
    placed = placed.withColumn("bucket", F.floor(F.col("place") / 2).cast("int"))
    return placed.repartition(parts, "bucket").sortWithinPartitions(
        "bucket", (F.col("place") % 2), F.col("id").desc_nulls_last(), F.col("text").desc())


def edited_by_next(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text against its edited form (the last third of its code points replaced by the first as many,
    or all, of the text of the next lower id; after the lowest comes the highest) and against that next text:
    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Rows equal in id follow
    each other by text, descending."""
    rows = df.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    schema = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    names = [c.split()[0] for c in schema.split(", ")]

    def compare(batches):
        last, done = None, None  # last: (bucket, id, text, registers); done: bucket whose guest has come
        for batch in batches:
            out = []
            for place, i, t in zip(*(batch.column(c).to_pylist() for c in ("place", "id", "text"))):
                b, guest = place // 2, place % 2
                if guest and b == done:
                    continue
                here = registers(t)
                if last is not None:
                    _, j, own, mine = last
                    cut = len(own) // 3
                    edited = own[:len(own) - cut] + t[:cut]
                    other = mine if edited == own else registers(edited)
                    out.append((j, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                to_hex(mine), to_hex(other), likeness(mine, other), likeness(mine, here)))
                last, done = (None, b) if guest else ((b, i, t, here), done)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2])],
                    names=names)

    return map_in_arrow(_dealt(rows).select("place", "id", "text"), compare, schema).withColumnRenamed("id", id_col)
