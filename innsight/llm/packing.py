"""Mixture-controlled packing of documents into fixed-length token sequences.

Deficit round-robin over source queues: every round (a window of ``window_tokens``) credits each
queue with its target share of the window; a queue's packets (document parts of at most one
sequence) are served while the queue's credit covers them, and the unused credit carries over.
The round of a packet is therefore a function of its end offset in its queue alone: the first round
whose accumulated credit reaches it. So the schedule needs only prefix sums, which are computed per
(queue, input partition) and joined, and deficits carry across windows and partitions exactly.

The served packets, in order of (round, queue, offset), form one stream that is cut every
``length`` tokens: only the last sequence has padding. Stream positions come from the totals of the
(round, queue) cells, summed in two levels; no task and no driver step sees more than a block of them.

Defined results: null text = empty text, which is the end id alone. A null source is the queue ''.
Ids may repeat or be null: rows are told apart by a key given when the tokens are stored. Columns named like an output
(``start``, ``length``, ``window`` and the others of ``pack``) are replaced. A queue
whose target exceeds its supply runs out early and the others go on. Empty table: no pieces.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.common import map_in_arrow, quoted, slices, stored

LENGTH = 2048
WINDOW_TOKENS = 64 * LENGTH
LEAST_CREDIT = 0.01  # tokens a window, for a target of nothing: such a queue comes last but is packed too
ROUNDS_IN_BLOCK = 1024
SLICE_BYTES = 2_000_000
_ENCODERS: dict = {}


def byte_level_ranks(spec: str) -> dict[bytes, int]:
    """Token bytes → id of a byte-level BPE tokenizer file whose ids follow the order of its merges (as those of
    the byte_bpe family do): rank-ordered merging then gives its ids."""
    model = json.loads(spec)
    step, vocab = model["pre_tokenizer"], model["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    ids = [vocab["".join(m)] for m in merges]
    if model["normalizer"] or step["type"] != "ByteLevel" or step["add_prefix_space"] or ids != sorted(ids):
        raise ValueError("not a byte-level BPE tokenizer with ids in the order of merges")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves; others from 256 on
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    known = {"".join(m) for m in merges} | byte.keys()
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token in known}


def _encoder(spec: str):
    if spec not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        _ENCODERS.clear()
        _ENCODERS[spec] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN,
                                            mergeable_ranks=byte_level_ranks(spec), special_tokens={})
    return _ENCODERS[spec]


def packets(df: DataFrame, text: str, tokenizer_path: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """The other columns of ``df``, one row per part of at most ``length`` ids: ``doc_tokens`` (with the
    end id), ``start``, ``n`` and ``ids`` (unsigned little-endian, 16 bits where the vocabulary allows).
    The tokenizer file's vocabulary runs in tiktoken's merge loop: the same ids in a quarter of the time."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()  # one or two MB, sent to the tasks
    made = {"doc_tokens", "start", "n", "ids", text.lower()}
    keep = [f for f in df.schema.fields if f.name.lower() not in made]
    k = len(keep)
    names = [f"c{i}" for i in range(k)]

    def run(batches):
        encoder = _encoder(spec)
        kind = "<u2" if max(encoder.n_vocab, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            source = batch.column(k)
            for a, b in slices(pc.fill_null(pc.binary_length(source), 0).to_pylist(), SLICE_BYTES):
                texts = ["" if t is None else t for t in source.slice(a, b - a).to_pylist()]
                row, total, start, ids = [], [], [], []
                for i, t in enumerate(texts):
                    whole = np.array([*encoder.encode_ordinary(t), end_id], kind)
                    for at in range(0, len(whole), length):
                        row.append(a + i)
                        total.append(len(whole))
                        start.append(at)
                        ids.append(whole[at:at + length].tobytes())
                width = np.dtype(kind).itemsize
                index = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(index) for i in range(k)), pa.array(total, pa.int64()), pa.array(start, pa.int64()),
                     pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=[*names, "doc_tokens", "start", "n", "ids"])

    plain = df.select(*[quoted(f.name).alias(c) for f, c in zip(keep, names)], quoted(text).alias("text"))
    schema = T.StructType([*(T.StructField(c, f.dataType) for f, c in zip(keep, names)),
                           *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "start", "n")),
                           T.StructField("ids", T.BinaryType())])
    return map_in_arrow(plain, run, schema).toDF(*[f.name for f in keep], "doc_tokens", "start", "n", "ids")


def _share(targets: dict[str, float] | None, natural: Column) -> Column:
    """The target share of a queue: as given, else its natural share of what the given ones leave."""
    if not targets:
        return natural
    rest = max(0.0, 1.0 - sum(targets.values())) or 1.0
    named = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    return F.coalesce(F.try_element_at(named, F.col("queue")), rest * natural)


def schedule(queued: DataFrame, targets: dict[str, float] | None = None, length: int = LENGTH,
             window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """(key, window, first, length, sequence_id, offset) of the pieces of ``queued`` (key, queue, n): ``key`` is
    unique, its upper bits (above 33) number the input partitions, and a queue is served in its order."""
    rows = queued.select("key", "queue", "n", F.shiftright("key", 33).alias("part"))
    parts = rows.groupBy("queue", "part").agg(F.sum("n").alias("tokens"))
    total = parts.agg(F.sum("tokens")).first()[0] or 1
    whole = Window.partitionBy("queue")
    natural = F.sum("tokens").over(whole) / F.lit(float(total))
    parts = parts.select("queue", "part", F.greatest(_share(targets, natural) * window_tokens, F.lit(LEAST_CREDIT)).alias("credit"), (
        F.sum("tokens").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("queue", "part").orderBy("key")) - F.col("n")
    served = rows.withColumn("inside", inside).join(parts, ["queue", "part"]).select(
        "key", "queue", "n", "credit", (F.coalesce("before", F.lit(0)) + F.col("inside")).alias("x"))
    # first round whose accumulated credit covers the packet's end
    round_ = F.greatest(F.ceil((F.col("x") + F.col("n")) / F.col("credit")) - 1, F.lit(0)).cast("long")
    served = stored(served.select("key", "queue", "n", "x", round_.alias("window")), "served")

    cells = served.groupBy("window", "queue").agg(F.sum("n").alias("tokens"), F.min("x").alias("x0"))
    cells = cells.withColumn("block", F.floor(F.col("window") / ROUNDS_IN_BLOCK))
    blocks = cells.groupBy("block").agg(F.sum("tokens").alias("tokens"))
    blocks = blocks.select("block", F.coalesce(F.sum("tokens").over(
        Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    cells = cells.withColumn("within", F.coalesce(F.sum("tokens").over(
        Window.partitionBy("block").orderBy("window", "queue").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.join(blocks, "block").select("window", "queue", (F.col("earlier") + F.col("within") - F.col("x0")).alias("shift"))
    placed = served.join(cells, ["window", "queue"]).withColumn("at", F.col("x") + F.col("shift"))
    end = F.col("at") + F.col("n")
    placed = placed.withColumn("sequence_id", F.explode(F.sequence(
        F.floor(F.col("at") / length), F.floor((end - 1) / length))))
    low = F.greatest("at", F.col("sequence_id") * length)
    high = F.least(end, (F.col("sequence_id") + 1) * length)
    return placed.select("key", "window", (low - F.col("at")).alias("first"), (high - low).alias("length"),
                         "sequence_id", (low - F.col("sequence_id") * length).alias("offset"))


def pack(df: DataFrame, tokenizer_path: str, text: str = "text", source: str = "source", end_id: int = 1,
         targets: dict[str, float] | None = None, length: int = LENGTH, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """The pieces: the other columns of ``df``, ``doc_tokens``, ``start`` (ids of its document before it), ``window``,
    ``length``, ``sequence_id``, ``offset``, ``ids_crc32`` and ``ids`` (unsigned 32-bit, little-endian)."""
    made = ["doc_tokens", "start", "window", "length", "sequence_id", "offset", "ids_crc32", "ids"]
    others = [c for c in df.columns if c.lower() not in (*made, text.lower())]
    named = df.select(*[quoted(c).alias(f"o{i}") for i, c in enumerate(others)],
                      F.coalesce(quoted(source).cast("string"), F.lit("")).alias("queue"), quoted(text).alias("text"))
    tokens = stored(packets(named, "text", tokenizer_path, end_id, length)
                    .withColumn("key", F.monotonically_increasing_id()), "tokens")
    plan = schedule(tokens.select("key", "queue", "n"), targets, length, window_tokens)
    joined = tokens.drop("queue").join(plan, "key").drop("key")
    keep = [f for f in joined.schema.fields if f.name not in ("ids", "n", "first")]

    def cut(batches):
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            values, sums = [], []
            for raw, n, first, size in zip(ids, batch.column("n").to_pylist(), batch.column("first").to_pylist(),
                                           batch.column("length").to_pylist()):
                width = len(raw) // n
                part = np.frombuffer(raw, f"<u{width}", size, first * width).astype("<u4").tobytes()
                values.append(part)
                sums.append(zlib.crc32(part))
            columns = {f.name: batch.column(f.name) for f in keep}
            columns["start"] = pc.add(batch.column("start"), batch.column("first"))
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(sums, pa.int64()), pa.array(values, pa.binary())],
                                             names=[*columns, "ids_crc32", "ids"])

    schema = T.StructType([*keep, T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])
    cutted = map_in_arrow(joined, cut, schema)
    return cutted.select(*[F.col(f"o{i}").alias(c) for i, c in enumerate(others)], *made)


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): the kept documents packed, one row per piece with its ids."""
    import public_tokenizers
    return pack(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json")).drop("source")
