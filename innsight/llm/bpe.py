"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside Spark tasks.

Spark splits the rows; a task needs no other task (no shuffle). Inside a task each word (one match
of the tokenizer's pattern) becomes token-position rows that join the merge table; a recursive
query contracts the leftmost pair of least rank of every word, until no word has a pair left. A word is
contracted once and kept in a bounded per-worker table, since words repeat. Texts are cut at single
spaces first (the pattern never matches across one that stands between two non-spaces): only the distinct chunks of a slice
are matched, and the ids of all its texts are gathered from theirs as arrays. Decoding cuts the id stream before tokens that
start with a space, and into runs of at most two ids; an ordered aggregation over (run, position) joined with the vocabulary
decodes each distinct run of the slice, and the texts' bytes are gathered from the runs'.

Words longer than ``LONG_WORD`` bytes contract, in one step, all non-overlapping occurrences
(leftmost first) of their least-rank pair. That equals one at a time: a new pair formed by a
merge of rank r has a rank above r, because every lower merge inside it was already exhausted.

Defined results: null text = empty text (no ids); empty text = empty ids; null ids = empty bytes;
an id outside the vocabulary raises. Repeated rows and null keys pass through; further columns are
kept, and a column with the output's name is replaced.
"""

from __future__ import annotations

import base64
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.common import quoted, with_arrow

LONG_WORD = 96          # bytes, below 256; only selects the form of the contraction query
CACHE_WORDS = 400_000   # words, and chunks of words, kept by a worker between slices
BATCH_BYTES = 8_000_000  # bytes of text handled at a time
QUERY_WORDS = 50_000    # words in one recursive query

SAFE_CUT = re.compile(r"(?<=\S) (?=\S)").split

# state: one row per word; each step unnests it to (word, position, pair) rows and joins the merges
LEFTMOST_SQL = """
WITH RECURSIVE s(w, toks, fin) AS (
  SELECT w, toks, false FROM words
  UNION ALL
  (WITH cur AS (SELECT w, toks FROM s WHERE NOT fin),
        pairs AS (SELECT w, unnest(toks[:-2])::BIGINT * 16777216 + unnest(toks[2:]) AS pair,
                         unnest(range(1, len(toks))) AS pos
                  FROM cur WHERE len(toks) > 1),
        best AS (SELECT w, min(rank::BIGINT * 256 + pos) AS k
                 FROM pairs JOIN merges USING (pair) GROUP BY w)
   SELECT cur.w,
          CASE WHEN k IS NULL THEN toks
               ELSE toks[:(k % 256) - 1] || [(k // 256)::INT] || toks[(k % 256) + 2:] END,
          k IS NULL OR len(toks) = 2
   FROM cur LEFT JOIN best USING (w)))
SELECT w, toks FROM s WHERE fin
"""

ALL_OCCURRENCES_SQL = """
WITH RECURSIVE s(w, toks, fin) USING KEY (w) AS (
  SELECT w, toks, false FROM words
  UNION
  (WITH cur AS (SELECT w, toks FROM s WHERE NOT fin),
        pairs AS (SELECT w, unnest(toks[:-2])::BIGINT * 16777216 + unnest(toks[2:]) AS pair,
                         unnest(range(1, len(toks))) AS pos
                  FROM cur WHERE len(toks) > 1),
        ranked AS (SELECT w, pos, rank FROM pairs JOIN merges USING (pair)
                   QUALIFY rank = min(rank) OVER (PARTITION BY w)),
        runs AS (SELECT w, pos, rank,
                        pos - row_number() OVER (PARTITION BY w ORDER BY pos) AS run FROM ranked),
        hits AS (SELECT w, pos, rank FROM runs
                 QUALIFY row_number() OVER (PARTITION BY w, run ORDER BY pos) % 2 = 1),
        toks AS (SELECT w, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM cur),
        kept AS (SELECT t.w, t.pos, coalesce(h.rank, t.tok) AS tok, h.rank
                 FROM toks t LEFT JOIN hits h ON h.w = t.w AND h.pos = t.pos
                 LEFT JOIN hits g ON g.w = t.w AND g.pos = t.pos - 1 WHERE g.w IS NULL)
   SELECT w, list(tok ORDER BY pos), count(rank) = 0 FROM kept GROUP BY w))
SELECT w, toks FROM s
"""

DECODE_SQL = "SELECT run, string_agg(chars, '' ORDER BY pos) AS chars FROM tokens JOIN vocab USING (id) GROUP BY run"


def read_ranks(path: str) -> bytes:
    """The rank file (base64 token and rank per line) as bytes; a few hundred KB, shipped to tasks."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in data.splitlines() if line)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(pair of token ids, rank of their concatenation) for every split of every token."""
    pairs, out = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs.append(left * 16777216 + right)
                out.append(rank)
    return pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(out, pa.int32())})


def _connection():
    import duckdb
    return duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False})


def unknown(tool, keys: set, known: str = "known") -> set:
    """The keys that ``tool.known`` lacks. Where they would not fit, its newer half goes first: frequent
    keys were met early."""
    held = getattr(tool, known)
    new = keys - held.keys()
    if len(held) + len(new) > CACHE_WORDS:
        setattr(tool, known, dict(itertools.islice(held.items(), CACHE_WORDS // 2)))
        new = keys - getattr(tool, known).keys()
    return new


def gather(pieces: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The pieces, laid end to end in ``pieces`` with these ``lengths``, in the given order."""
    size = lengths[order]
    begin = (np.cumsum(lengths) - lengths)[order]
    ends = np.cumsum(size)
    return pieces[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that end at these places of ``data`` (bytes)."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _may_touch_space(chunks: pa.Array) -> np.ndarray:
    """Whether a chunk is empty, or begins or ends with a byte that may belong to white space."""
    ends = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset:chunks.offset + len(chunks) + 1]
    raw = np.concatenate([np.frombuffer(chunks.buffers()[2], np.uint8) if chunks.buffers()[2] else np.zeros(0, np.uint8), np.zeros(1, np.uint8)])
    first, last = raw[ends[:-1]], raw[ends[1:] - 1]
    return (ends[1:] == ends[:-1]) | (first <= 32) | (last <= 32) | (first >= 128) | (last >= 128)


class WordEncoder:
    """Encodes distinct words by the recursive query; one per worker and vocabulary."""

    def __init__(self, data: bytes, pattern: str):
        import regex
        self.ranks = parse_ranks(data)
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # chunk → ids of a space and it
        self.words: dict[str, bytes] = {}  # word → its ids
        self.con = _connection()
        self.con.register("merge_rows", merge_table(self.ranks))
        self.con.execute("CREATE TABLE merges AS SELECT pair, rank FROM merge_rows")
        self.con.unregister("merge_rows")

    def _contract(self, words: list[bytes], sql: str) -> list[bytes]:
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        toks = np.asarray(self.byte_ids, np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        offsets = np.zeros(len(words) + 1, np.int32)
        np.cumsum(lengths, out=offsets[1:])
        self.con.register("words", pa.table({
            "w": pa.array(np.arange(len(words), dtype=np.int32)),
            "toks": pa.ListArray.from_arrays(pa.array(offsets), pa.array(toks))}))
        got = self.con.sql(sql).to_arrow_table().combine_chunks()
        self.con.unregister("words")
        order, lists = got["w"].to_numpy(), got["toks"].chunk(0)
        ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4").tobytes()
        out: list[bytes] = [b""] * len(words)
        for w, a, b in zip(order.tolist(), (ends[:-1] * 4).tolist(), (ends[1:] * 4).tolist()):
            out[w] = ids[a:b]
        return out

    def word_ids(self, words: set[str]) -> dict[str, bytes]:
        """Word → ids. A vocabulary entry is its own id: its contraction would end there."""
        new = unknown(self, words, "words")
        short, long = [], []
        for w in new:
            raw = w.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.words[w] = rank.to_bytes(4, "little")
            else:
                (short if len(raw) <= LONG_WORD else long).append((w, raw))
        for group, sql, step in ((short, LEFTMOST_SQL, QUERY_WORDS), (long, ALL_OCCURRENCES_SQL, 1000)):
            for at in range(0, len(group), step):
                part = group[at:at + step]
                self.words.update(zip((w for w, _ in part), self._contract([raw for _, raw in part], sql)))
        return self.words

    def learn(self, chunks: set[str]) -> None:
        """Keeps the ids of a space and the chunk."""
        new = unknown(self, chunks)
        split = {c: [" " + c] if c.isalpha() else self.find(" " + c) for c in new}  # letters alone are one match
        ids = self.word_ids(set(itertools.chain.from_iterable(split.values()))) if new else {}
        for c, words in split.items():
            self.known[c] = ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words])

    def _whole(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that have a space next to another white space: cut by a slower rule."""
        cut = [SAFE_CUT(t) for t in texts]
        heads = [self.find(chunks.pop(0)) for chunks in cut]
        self.learn(set().union(*cut))
        get, first = self.known.__getitem__, self.word_ids(set().union(*heads)).__getitem__
        return [b"".join([*map(first, head), *map(get, chunks)]) for head, chunks in zip(heads, cut)]

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """The ids of every text (null: none) as little-endian unsigned 32-bit integers. A text is its head (up to the
        first cut) and chunks, each after one space between two non-spaces."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        cut = pc.split_pattern(texts, " ")
        begin = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        chunks, order = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        order, begin = order[:begin[-1] - begin[0]], begin - begin[0]
        odd = np.zeros(len(chunks), bool)
        for i in np.flatnonzero(_may_touch_space(coded.dictionary)).tolist():
            odd[i] = not chunks[i] or chunks[i][0].isspace() or chunks[i][-1].isspace()
        slow = np.flatnonzero(np.add.reduceat(odd[order], begin[:-1]) > 0) if len(order) else np.zeros(0, np.int64)
        self.learn({c for c, o in zip(chunks, odd) if not o})
        pieces = [b"" if o else self.known[c] for c, o in zip(chunks, odd)]
        heads = [self.find(chunks[i]) for i in order[begin[:-1]]]
        first = self.word_ids(set().union(*heads))
        pieces += [b"".join([first[w] for w in head]) for head in heads]
        order[begin[:-1]] = len(chunks) + np.arange(len(heads))
        if len(slow):
            order[np.isin(np.repeat(np.arange(len(heads)), np.diff(begin)), slow)] = len(pieces)
            order[begin[slow]] = len(pieces) + 1 + np.arange(len(slow))
            pieces += [b"", *self._whole([texts[int(i)].as_py() for i in slow])]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        ids = gather(np.frombuffer(b"".join(pieces), "<u4"), lengths, order)
        ends = np.concatenate([[0], np.cumsum(lengths[order])])[begin[1:]]
        return binaries(ids.view(np.uint8), 4 * ends)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()


class RunDecoder:
    """Decodes id streams by ordered aggregation over distinct runs of ids."""

    def __init__(self, data: bytes):
        ranks = parse_ranks(data)
        most = max(ranks.values())
        self.opens, self.present = np.zeros((2, most + 1), bool)  # token starts with a space; id is in the vocabulary
        self.opens[[r for t, r in ranks.items() if t[:1] == b" "]] = True
        self.present[list(ranks.values())] = True
        self.con = _connection()
        self.con.register("vocab_rows", pa.table({  # one character per byte
            "id": pa.array(list(ranks.values()), pa.int64()),
            "chars": pa.array([t.decode("latin-1") for t in ranks])}))
        self.con.execute("CREATE TABLE vocab AS SELECT id, chars FROM vocab_rows")
        self.con.unregister("vocab_rows")

    def _bytes_of(self, runs: np.ndarray) -> list[bytes]:
        """The bytes of each run: its first id plus one, and above 32 bits its second one plus one."""
        ids = np.stack([runs & 0xFFFFFFFF, runs >> 32])
        pos, run = np.nonzero(ids)
        self.con.register("tokens", pa.table({"run": run, "pos": pos.astype(np.int8), "id": ids[pos, run] - 1}))
        got = self.con.sql(DECODE_SQL).to_arrow_table()
        self.con.unregister("tokens")
        out = [b""] * len(runs)
        for r, chars in zip(got["run"].to_pylist(), got["chars"].to_pylist()):
            out[r] = chars.encode("latin-1")
        return out

    def decode_array(self, streams: pa.Array) -> pa.Array:
        """The bytes that every id stream (null: empty) stands for."""
        streams = pc.fill_null(streams, b"")
        sizes = pc.binary_length(streams).to_numpy().astype(np.int64) // 4
        ids = np.frombuffer(b"".join(streams.to_pylist()), "<u4").astype(np.int64)
        if len(ids) and (ids.max() >= len(self.present) or not self.present[ids].all()):
            raise ValueError("an id outside the vocabulary")
        ends = np.cumsum(sizes)
        first = self.opens[ids]
        first[(ends - sizes)[sizes > 0]] = True
        start = np.flatnonzero(first)
        length = np.diff(start, append=len(ids))
        parts = (length + 1) // 2
        at = np.repeat(start, parts) + 2 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        second = np.concatenate([ids[1:], [0]])[at] + 1
        runs = ids[at] + 1 | np.where(at + 1 < np.repeat(start + length, parts), second, 0) << 32
        distinct, order = np.unique(runs, return_inverse=True)
        pieces = self._bytes_of(distinct) if len(distinct) else []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        done = gather(np.frombuffer(b"".join(pieces), np.uint8), lengths, order)
        total = np.concatenate([[0], np.cumsum(lengths[order])])
        return binaries(done, total[np.searchsorted(at, ends)])

    def decode(self, streams: list[bytes]) -> list[bytes]:
        return self.decode_array(pa.array(streams, pa.binary())).to_pylist()


_MADE: dict = {}  # worker-local: reused by later tasks of the same Python worker


def _made(kind, *args):
    if (kind, args) not in _MADE:
        _MADE[kind, args] = kind(*args)
    return _MADE[kind, args]


def with_binary(df: DataFrame, source: str, out: str, make, per_array) -> DataFrame:
    """The other columns of ``df`` and binary column ``out`` = ``per_array(make(), values of source)``."""
    return with_arrow(df, source, [T.StructField(out, T.BinaryType())], lambda values: [per_array(make(), values)], BATCH_BYTES)


def encode(df: DataFrame, text: str, ranks_path: str, pattern: str, out: str = "token_ids") -> DataFrame:
    """The other columns of ``df`` and ``out``: the ids of ``text`` as little-endian unsigned 32-bit
    integers (binary). No special tokens: their strings are ordinary text."""
    data = read_ranks(ranks_path)
    return with_binary(df, text, out, lambda: _made(WordEncoder, data, pattern), WordEncoder.encode_array)


def decode(df: DataFrame, ids: str, ranks_path: str, out: str = "decoded") -> DataFrame:
    """``df`` (with ``ids``) and ``out``: the bytes that ``ids`` stand for."""
    data = read_ranks(ranks_path)
    twin = df.withColumn("__ids", F.coalesce(quoted(ids), F.lit(b"")))
    return with_binary(twin, "__ids", out, lambda: _made(RunDecoder, data), RunDecoder.decode_array)


def round_trip(df: DataFrame, text: str, ranks_path: str, pattern: str, out: str = "token_ids",
               back: str = "decoded") -> DataFrame:
    """The other columns of ``df``, ``out`` as of :func:`encode` and ``back`` as of :func:`decode`, in one pass: the
    ids do not leave the worker in between, and one worker holds both tools."""
    data = read_ranks(ranks_path)

    def per_slice(values: pa.Array) -> list[pa.Array]:
        ids = _made(WordEncoder, data, pattern).encode_array(values)
        return [ids, _made(RunDecoder, data).decode_array(ids)]
    return with_arrow(df, text, [T.StructField(out, T.BinaryType()), T.StructField(back, T.BinaryType())],
                      per_slice, BATCH_BYTES)
