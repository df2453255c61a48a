"""Alignment of two tokenizers over a corpus: byte-exact groups per document, corpus-wide counts of linked id pairs,
and what those counts say about each document.

External spill counting. A task tokenizes its documents both ways, cuts them into groups where a token of each
side ends, and turns the links into records (pair, document, times), sorted in side-major order (B id, A id) and
radix-partitioned by B id into zstd runs. Spark stores the runs in the shared folder and shuffles them:

1. the runs of a radix are dealt to as many groups as their bytes need, so a hot pair or id is split; a k-way heap
   merge over each group's runs counts its pairs, giving one run of (pair, count) per group;
2. those are merged ``FAN_IN`` at a time, round by round, until one run per radix is left. In side-major order all
   pairs of a B id meet there, so its highest count is known when the id ends: best pairs are marked;
3. each group's record runs are merged again, in step with its radix's counts, and contributions stream back per
   document; they are summed by document.

Merges are by blocks: a heap holds the runs' heads, another one the ends of their current blocks; all records up to the
least end are taken at once, so a merge holds one decoded block per run. A task also holds its compressed runs: about
``GROUP_BYTES`` of records, or ``FAN_IN`` runs of distinct pairs of one radix. A lost executor costs its tasks only.

Defined results: null or empty text, and text whose tokens do not join to a space and the text, has no tokens: zeros,
and empty groups. Repeated rows and ids each count. Very long texts are tokenized whole (a slice of their own); a pair whose count ties with the highest of
its B id is best as well. Special tokens' strings are plain text. The other columns are kept,
but for ``text`` and those named like an output, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.common import map_in_arrow, quoted, slices, stored
from innsight.llm.packing import byte_level_ranks

RADIX_BITS = 4
A_BITS = 17               # ids of side A are below 2^17, and so are those of side B
SPAN_BITS = 16            # documents that a run spans: 2^16
RUN_LINKS = 1_000_000     # links that a task holds before it writes its runs
BLOCK_RECORDS = 32_768
GROUP_BYTES = 16_000_000  # compressed records of a group
FAN_IN = 16
SLICE_BYTES = 1_000_000
OUTPUTS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
SUMS = ("n_best", "count_sum")


class Aligner:
    """Both tokenizers, as ids and as bytes; one per worker."""

    def __init__(self, spec: str, model: bytes):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        ranks = byte_level_ranks(spec)
        self.a = tiktoken.Encoding("side-a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << A_BITS:
            raise ValueError("a vocabulary of more than 2^17 entries")
        self.a_len = np.array([len(t) for t in self.a_bytes])
        self.b_len = np.array([len(t) for t in self.b_bytes])
        written = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"]
        self.b_first = len(written)
        written += [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]
        self.written, self.written_len = np.array(written, "S"), np.array([len(x) for x in written])

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of each text on both sides; None where they do not join to a space and the text."""
        out = []
        for t, b in zip(texts, self.b.encode(texts, num_threads=1)):
            whole = " " + t
            a = self.a.encode_ordinary(whole)
            raw = whole.encode()
            same = t and b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else None)
        return out

    def align(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """(groups per document, groups as text, A id and B id of every link); every document has tokens."""
        a, b = (np.concatenate(x) for x in zip(*pairs))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])  # every document has as many bytes on both sides
        ends = np.zeros((2, a_end[-1] + 1), bool)
        ends[0, a_end], ends[1, b_end] = True, True
        a_cut, b_cut = ends[1, a_end], ends[0, b_end]  # tokens that end a group: one of each side
        a_last, b_last = np.flatnonzero(a_cut), np.flatnonzero(b_cut)
        a_first, b_first = (np.concatenate([[0], np.cumsum([len(x) for x in side])]) for side in zip(*pairs))
        groups = np.diff(np.concatenate([[0], np.cumsum(a_cut)])[a_first])
        # text order: by group the A tokens, then the B tokens
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.concatenate([[0], b_last + 1])[np.cumsum(a_cut) - a_cut]] = 2 * a + a_cut
        codes[np.arange(len(b)) + a_last[np.cumsum(b_cut) - b_cut] + 1] = self.b_first + 2 * b + b_cut
        chars = self.written[codes].view(np.uint8)
        text = chars[chars != 0].tobytes()
        at = np.concatenate([[0], np.cumsum(self.written_len[codes])])[a_first + b_first].tolist()
        return groups, [text[x:y - 1] for x, y in zip(at, at[1:])], a[a_last], b[b_last]


_MADE: dict = {}  # worker-local


def _aligner(spec: str, model: bytes) -> Aligner:
    key = hashlib.sha256(spec.encode() + model).digest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Aligner(spec, model)
    return _MADE[key]


def pack_blocks(columns: list[np.ndarray], records: int = BLOCK_RECORDS) -> list[bytes]:
    """zstd blocks of sorted records: the first column (the keys) as differences, each column in its least width."""
    import zstandard
    press, out = zstandard.ZstdCompressor(level=1).compress, []
    for at in range(0, len(columns[0]), records):
        part = [c[at:at + records] for c in columns]
        raw = [struct.pack("<IQB", len(part[0]), int(part[0][0]), len(part))]
        for c in [np.diff(part[0], prepend=part[0][:1]), *part[1:]]:
            width = next(w for w in (1, 2, 4, 8) if int(c.max()) < 1 << 8 * w)
            raw += [bytes([width]), c.astype(f"<u{width}").tobytes()]
        body = press(b"".join(raw))
        out.append(struct.pack("<I", len(body)) + body)
    return out


def read_blocks(blobs: Iterable[bytes]) -> Iterator[list[np.ndarray]]:
    """The columns of each block, one decoded at a time."""
    import zstandard
    plain = zstandard.ZstdDecompressor().decompress
    for blob in blobs:
        at = 0
        while at < len(blob):
            size, = struct.unpack_from("<I", blob, at)
            raw = plain(blob[at + 4:at + 4 + size])
            at += 4 + size
            n, first, count = struct.unpack_from("<IQB", raw)
            place, columns = 13, []
            for _ in range(count):
                width = raw[place]
                columns.append(np.frombuffer(raw, f"<u{width}", n, place + 1).astype(np.int64))
                place += 1 + n * width
            columns[0] = first + np.cumsum(columns[0])
            yield columns


def merged(runs: list[Iterator[list[np.ndarray]]]) -> Iterator[list[np.ndarray]]:
    """The records of sorted runs in the order of their keys (first column), by a heap of the runs' heads. A key's records
    may go on in the next part."""
    blocks: dict[int, list[np.ndarray]] = {}
    heads: list[tuple[int, int]] = []
    ends: list[tuple[int, int]] = []

    def load(r: int) -> None:
        block = next(runs[r], None)
        if block is None:
            blocks.pop(r, None)
            return
        blocks[r] = block
        heapq.heappush(heads, (int(block[0][0]), r))
        heapq.heappush(ends, (int(block[0][-1]), r))

    for r in range(len(runs)):
        load(r)
    while heads:
        limit, parts = ends[0][0], []
        while heads and heads[0][0] <= limit:  # each run with records up to the least end of a block
            _, r = heapq.heappop(heads)
            cut = int(np.searchsorted(blocks[r][0], limit, "right"))
            parts.append([c[:cut] for c in blocks[r]])
            if cut == len(blocks[r][0]):
                load(r)
            else:
                blocks[r] = [c[cut:] for c in blocks[r]]
                heapq.heappush(heads, (int(blocks[r][0][0]), r))
        while ends and ends[0][0] <= limit:
            heapq.heappop(ends)
        columns = [np.concatenate(c) for c in zip(*parts)]
        order = np.argsort(columns[0], kind="stable")
        yield [c[order] for c in columns]


def counted(parts: Iterable[list[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct keys, sums of the second column) of merged records; the last key waits for the next part."""
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    for k, n, *_ in parts:
        k, n = np.concatenate([keys, k]), np.concatenate([sums, n])
        first = np.flatnonzero(np.diff(k, prepend=-1))
        k, n = k[first], np.add.reduceat(n, first)
        if len(k) > 1:
            yield k[:-1], n[:-1]
        keys, sums = k[-1:], n[-1:]
    if len(keys):
        yield keys, sums


def with_best(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """(keys, counts, whether the count is its B id's highest); the last id's pairs (A's vocabulary at most) wait."""
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)

    def marked(k: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        first = np.flatnonzero(np.diff(k >> A_BITS, prepend=-1))
        most = np.repeat(np.maximum.reduceat(n, first), np.diff([*first, len(k)]))
        return [k, n, (n == most).astype(np.int64)]

    for k, n in parts:
        k, n = np.concatenate([keys, k]), np.concatenate([sums, n])
        cut = int(np.searchsorted(k, k[-1] >> A_BITS << A_BITS))
        if cut:
            yield marked(k[:cut], n[:cut])
        keys, sums = k[cut:], n[cut:]
    if len(keys):
        yield marked(keys, sums)


def tokenized(df: DataFrame, text: str, a_path: str, b_path: str, keep_groups: bool, run_links: int) -> tuple[DataFrame, int]:
    """One row per document (its other columns, ``key`` and the outputs but for the counts) and one per run (``radix``,
    ``base`` = key of its first document, ``size``, ``blob``), told apart by ``radix``; and the number of other columns."""
    with open(a_path, encoding="utf-8") as f:
        spec = f.read()  # one or two MB each, sent to the tasks
    with open(b_path, "rb") as f:
        model = f.read()
    made = {*OUTPUTS, *SUMS, "groups", text.lower()}
    keep = [f for f in df.schema.fields if f.name.lower() not in made]
    n = len(keep)
    fields = [("key", pa.int64()), *((c, pa.int64()) for c in OUTPUTS[:4]), ("groups_sha256", pa.string()), ("groups", pa.string()),
              ("radix", pa.int32()), ("base", pa.int64()), ("size", pa.int64()), ("blob", pa.binary())]
    names = [*(f"c{i}" for i in range(n)), *(c for c, _ in fields)]

    def run(batches):
        tool = _aligner(spec, model)
        base, held, links, kinds = 0, [], 0, None  # held: pair key and document of each link, one number

        def runs() -> pa.RecordBatch:
            codes, times = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(codes, np.arange(1 << RADIX_BITS, dtype=np.uint64) << np.uint64(64 - RADIX_BITS)).tolist()
            rows = []
            for r, (x, y) in enumerate(zip(cuts, [*cuts[1:], len(codes)])):
                if x < y:
                    pair = (codes[x:y] >> np.uint64(SPAN_BITS)).astype(np.int64) & ((1 << 64 - RADIX_BITS - SPAN_BITS) - 1)
                    doc = (codes[x:y] & np.uint64((1 << SPAN_BITS) - 1)).astype(np.int64)
                    blob = b"".join(pack_blocks([pair, times[x:y], doc]))
                    rows.append((r, base, len(blob), blob))
            empty = [pa.nulls(len(rows), k) for k in [*kinds, *(k for _, k in fields[:-4])]]
            return pa.RecordBatch.from_arrays([*empty, *(pa.array(c, k) for c, (_, k) in zip(zip(*rows), fields[-4:]))], names=names)

        for batch in batches:
            kinds = [batch.column(i).type for i in range(n)]
            values, keys = batch.column(n + 1), batch.column(n).to_numpy()
            for x, y in slices(pc.fill_null(pc.binary_length(values), 0).to_pylist(), SLICE_BYTES):
                for at in range(x, y, 1 << 14):
                    part, key = values.slice(at, min(y - at, 1 << 14)), keys[at:min(y, at + (1 << 14))]
                    if held and (links >= run_links or int(key[-1]) - base >= 1 << SPAN_BITS):
                        yield runs()
                        held, links = [], 0
                    if not held:
                        base = int(key[0])
                    found = tool.tokens(["" if t is None else t for t in part.to_pylist()])
                    whole = [i for i, p in enumerate(found) if p]
                    counts = np.zeros((4, len(key)), np.int64)
                    texts, sums = [""] * len(key), [""] * len(key)
                    if whole:
                        pairs = [found[i] for i in whole]
                        groups, written, a, b = tool.align(pairs)
                        counts[0, whole], counts[1, whole] = [len(p[0]) for p in pairs], [len(p[1]) for p in pairs]
                        counts[2, whole] = counts[3, whole] = groups  # one token of each side ends with a group
                        for i, w in zip(whole, written):
                            texts[i], sums[i] = w.decode() if keep_groups else "", hashlib.sha256(w).hexdigest()
                        low = (1 << RADIX_BITS) - 1
                        code = ((b & low) << 64 - RADIX_BITS - SPAN_BITS | b >> RADIX_BITS << A_BITS | a).astype(np.uint64)
                        held.append(code << np.uint64(SPAN_BITS) | np.repeat(key[whole] - base, groups).astype(np.uint64))
                        links += len(a)
                    columns = [pa.array(key), *(pa.array(c) for c in counts), pa.array(sums, pa.string()), pa.array(texts, pa.string())]
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).slice(at, len(key)) for i in range(n)), *columns, *(pa.nulls(len(key), k) for _, k in fields[-4:])],
                        names=names)
        if held:
            yield runs()

    plain = df.select(*[quoted(f.name).alias(f"c{i}") for i, f in enumerate(keep)],
                      F.monotonically_increasing_id().alias("key"), quoted(text).alias("text"))
    kind = {pa.int64(): T.LongType(), pa.int32(): T.IntegerType(), pa.string(): T.StringType(), pa.binary(): T.BinaryType()}
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(keep)), *(T.StructField(c, kind[k]) for c, k in fields)])
    return map_in_arrow(plain, run, schema), n


def _by_group(batches, columns: list[str]) -> Iterator[tuple[tuple[int, int], Iterator[tuple]]]:
    """((radix, group), rows) of sorted batches."""
    import itertools

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("radix", "part", *columns)))
    for key, found in itertools.groupby(rows(), lambda r: r[:2]):
        yield key, (r[2:] for r in found)


def _runs_of(rows: Iterator[tuple[int, bytes]]) -> list[Iterator[list[np.ndarray]]]:
    """The runs of (run, blob) rows in order."""
    held: dict[int, list[bytes]] = {}
    for r, blob in rows:
        held.setdefault(r, []).append(blob)
    return [read_blocks(blobs) for blobs in held.values()]


def _blob_rows(key: tuple[int, int], parts: Iterable[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows (radix, run, seq, blob) of a merged run."""
    for seq, columns in enumerate(parts):
        yield pa.RecordBatch.from_pydict({"radix": pa.array([key[0]], pa.int32()), "run": pa.array([key[1]], pa.int64()),
                                          "seq": pa.array([seq], pa.int64()), "blob": pa.array([b"".join(pack_blocks(list(columns)))], pa.binary())})


def _thick(parts: Iterable, records: int = BLOCK_RECORDS * 8) -> Iterator[list[np.ndarray]]:
    """Parts joined to about ``records`` records."""
    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p[0])
        if size >= records:
            yield [np.concatenate(c) for c in zip(*held)]
            held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


PAIR_RUN = "radix int, run long, seq long, blob binary"


def _merge_counts(runs: DataFrame, groups: int, last: bool) -> DataFrame:
    """One run of (pair, count) for every (radix, part) of ``runs`` (radix, part, run, seq, blob); the last merge, of whole
    radices, also marks the best pairs."""
    def merge(batches):
        for key, rows in _by_group(batches, ["run", "blob"]):
            parts = counted(merged(_runs_of(rows)))
            yield from _blob_rows(key, _thick(with_best(parts) if last else parts))
    dealt = runs.select("radix", "part", "run", "seq", "blob").repartition(groups, "radix", "part")
    return map_in_arrow(dealt.sortWithinPartitions("radix", "part", "run", "seq"), merge, PAIR_RUN)


def pair_counts(dealt: DataFrame, most: int, groups: int, fan_in: int = FAN_IN) -> DataFrame:
    """Per radix one run of (pair, count, best), as rows of blobs, from ``dealt`` record runs in at most ``most`` parts a radix."""
    radices = 1 << RADIX_BITS
    counts = _merge_counts(dealt, groups, False)
    while most > fan_in:
        most = -(-most // fan_in)
        counts = _merge_counts(counts.withColumn("part", F.expr(f"run div {fan_in}")), radices * most, False)
    return _merge_counts(counts.withColumn("part", F.lit(0).cast("long")), radices, True)


def contributions(dealt: DataFrame, counts: DataFrame, parts: list[int], groups: int) -> DataFrame:
    """(key, n_best, count_sum) per document and group, streamed from the record runs merged in step with the counts."""
    def stream(batches):
        for _, rows in _by_group(batches, ["base", "run", "blob"]):
            totals, bases, blobs = [], [], []
            for base, _, blob in rows:  # the counts of the radix come first
                if base is None:
                    totals.append(blob)
                else:
                    bases.append(base)
                    blobs.append(blob)
            total, window = read_blocks(totals), [np.empty(0, np.int64)] * 3
            dense = len(bases) << SPAN_BITS
            sums, best = np.zeros(dense, np.int64), np.zeros(dense, np.int64)

            def placed(r, blob):
                for k, n, doc in read_blocks([blob]):
                    yield [k, n, doc + (r << SPAN_BITS)]
            for k, n, doc in merged([placed(r, blob) for r, blob in enumerate(blobs)]):
                window = [c[np.searchsorted(window[0], k[0]):] for c in window]
                while not len(window[0]) or window[0][-1] < k[-1]:
                    window = [np.concatenate(c) for c in zip(window, next(total))]
                at = np.searchsorted(window[0], k)
                np.add.at(sums, doc, n * window[1][at])
                np.add.at(best, doc, n * window[2][at])
            found = np.flatnonzero(sums)
            keys = np.array(bases, np.int64)[found >> SPAN_BITS] + (found & (1 << SPAN_BITS) - 1)
            for x in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys[x:x + 50_000]), "n_best": pa.array(best[found[x:x + 50_000]]),
                                                  "count_sum": pa.array(sums[found[x:x + 50_000]])})

    each = F.array(*[F.lit(p).cast("long") for p in parts])
    copies = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.element_at(each, F.col("radix") + 1) - 1)))
    both = dealt.select("radix", "part", "base", "run", "seq", "blob").unionByName(
        copies.withColumn("base", F.lit(None).cast("long")).select("radix", "part", "base", "run", "seq", "blob"))
    sorted_ = both.repartition(groups, "radix", "part").sortWithinPartitions("radix", "part", F.col("base").asc_nulls_first(), "seq")
    return map_in_arrow(sorted_, stream, "key long, n_best long, count_sum long")


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text", keep_groups: bool = True,
          group_bytes: int = GROUP_BYTES, fan_in: int = FAN_IN, run_links: int = RUN_LINKS) -> DataFrame:
    """The other columns of ``df`` and n_a, n_b, n_groups, n_links, ``groups`` (`a1,a2|b1;a3|b2,b3`, decimal ids; only with
    ``keep_groups``), ``groups_sha256``, ``n_best`` (links whose pair's count is the highest of its B id) and ``count_sum``
    (over links, their pair's count in the corpus). Side A: a byte-level BPE file of ``tokenizers``, side B: a ``sentencepiece`` model."""
    spark = df.sparkSession
    rows, n = tokenized(df, text, a_path, b_path, keep_groups, run_links)
    rows = stored(rows, "alignment")
    runs = rows.filter("radix IS NOT NULL").select("radix", "base", "size", "blob")
    sizes = {r["radix"]: r["size"] for r in runs.groupBy("radix").agg(F.sum("size").alias("size")).collect()}  # 16 rows
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = sum(sizes.values()) or 1
    parts = [max(-(-sizes.get(r, 0) // group_bytes), -(-sizes.get(r, 0) * least // whole), 1) for r in range(1 << RADIX_BITS)]
    each = F.array(*[F.lit(p).cast("long") for p in parts])
    dealt = runs.withColumns({"part": F.pmod(F.xxhash64("base"), F.element_at(each, F.col("radix") + 1)),
                              "run": F.col("base"), "seq": F.lit(0).cast("long")})
    groups = sum(parts)
    counts = stored(pair_counts(dealt, max(parts), groups, fan_in), "alignment-counts")
    sums = contributions(dealt, counts, parts, groups).groupBy("key").agg(*[F.sum(c).alias(c) for c in SUMS])
    docs = rows.filter("radix IS NULL").drop("radix", "base", "size", "blob")
    joined = docs.join(sums, "key", "left")
    names = [f.name for f in df.schema.fields if f.name.lower() not in {*OUTPUTS, *SUMS, "groups", text.lower()}]
    shown = [*OUTPUTS, *(["groups"] if keep_groups else [])]
    return joined.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *shown,
                         *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in SUMS])
