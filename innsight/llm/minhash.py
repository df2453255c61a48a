"""Near-duplicate documents: ProbMinHash signatures of word shingles, banding, verification.

1. Each text becomes its five-word shingles with their counts. Every shingle is a Poisson process of its count as rate,
   seeded by its hash, whose arrivals fall on registers; a register keeps the shingle that arrives
   first, and a shingle stops as soon as its next arrival is later than all registers of the document
   (early termination). Equal registers of two texts estimate the probability Jaccard similarity of their weighted shingles.
   The same process at rate 1 estimates the Jaccard similarity of the sets: the one that is verified, however often a text
   repeats a passage. So candidates come from the second signature, and ``similarity`` from the first; where no shingle of a
   text repeats, both are one.
2. Bands of registers are bucket keys. Equal texts are one node, so copies never meet each other.
3. First, every node of a bucket is compared with the bucket's least node only (rows linear in the
   bucket). Accepted links are united. Buckets that then lie in one component need nothing more;
   in the others, nodes of different components are compared and verified in blocks, and only links
   that connect components leave a task. So no candidate pair is left out, and a group of near copies
   costs rows in proportion to its size, not to its square.
4. Every link is verified by the exact Jaccard similarity of the two texts' shingle sets (0.8 or more).

``classes`` gives each row's class: the connected component of its text, named by the least id in it, and ``similarity``: the
estimated probability Jaccard similarity of its text and the class's text of the least digest.

Defined results: null text = empty text; all empty texts are one class; a text of one to four words has one
shingle, all its words. Repeated rows share a class. A class whose ids are all null has a null name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.common import map_in_arrow, quoted, slices, stored, with_arrow

WORDS = 5
THRESHOLD = 0.8
ROWS, BANDS = 6, 30        # registers in a band, bands: a pair at 0.8 is missed with probability 1e-4
REGISTERS = ROWS * BANDS
LEAST_ESTIMATE = 0.65      # of pairs worth verifying: five standard deviations below the threshold
BLOCK = 1024               # nodes of a bucket compared with another as many at a time,
BLOCK_BYTES = 8_000_000    # or fewer: about as many bytes of text
HOT_PARTS = 1024           # a class of more than this part of all rows is a hot one: there are fewer such classes
SLICE_BYTES = 4_000_000
PART_BYTES = 1_000_000     # of texts whose shingles are made at a time

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3  # odd, so powers have inverses modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; those of a part of texts are kept, more only lent."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    size = max(n, PART_BYTES)
    inverse = pow(_BASE, -1, 1 << 64)
    made = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, inverse)]
    if size <= PART_BYTES:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and the n + 1 offsets of the values in them (null: empty)."""
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every word, in text order: one pass of prefix sums over the bytes."""
    raw, offsets = raw_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gap = _SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True  # a text's first byte starts a word of its own
    starts = np.flatnonzero(~gap & (np.r_[True, gap[:-1]] | first[:-1]))
    ends = np.flatnonzero(~gap & (np.r_[gap[1:], True] | first[1:])) + 1
    power, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power, out=sums[1:])
    return np.searchsorted(offsets[1:], starts, side="right"), mix((sums[ends] - sums[starts]) * inverse[starts])


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of every text, sorted by row and hash; texts are read in parts, since
    the work takes some 40 bytes a byte."""
    made = []
    for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), PART_BYTES):
        row, h, count = _shingles(texts.slice(a, b - a))
        made.append((row + a, h, count))
    if not made:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*made))


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, word = word_hashes(texts)
    n = len(word)
    padded = np.r_[word, np.zeros(WORDS - 1, np.uint64)]
    count = np.bincount(row, minlength=len(texts))
    at = np.arange(n) - np.repeat(np.cumsum(count) - count, count)  # position in its text
    length = count[row]
    wanted = np.flatnonzero((at + WORDS <= length) | ((length < WORDS) & (at == 0)))
    h = np.zeros(len(wanted), np.uint64)
    for k in range(WORDS):
        inside = at[wanted] + k < length[wanted]
        h = mix(h * np.uint64(_BASE) + np.where(inside, padded[wanted + k], np.uint64(k + 1)))
    row = row[wanted]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return row[begin], h[begin], np.diff(np.r_[begin, len(h)])


def signatures(texts: pa.Array, weighted: bool = True) -> np.ndarray:
    """REGISTERS values per text; all zero for a text without words. ``weighted``: by the shingles' counts."""
    row, h, count = shingles(texts)
    return _arrivals(len(texts), row, h, count if weighted else np.ones(len(h)))


def _arrivals(texts: int, row: np.ndarray, h: np.ndarray, rate: np.ndarray) -> np.ndarray:
    size = texts * REGISTERS
    earliest, element = np.full(size, np.inf), np.zeros(size, np.uint64)
    time, step = np.zeros(len(h)), 0
    while len(h):
        step += 1
        draw = mix(h + np.uint64(step * int(_GOLDEN) % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / rate
        register = row * REGISTERS + (mix(draw ^ _GOLDEN) % np.uint64(REGISTERS)).astype(np.int64)
        sooner = np.flatnonzero(time < earliest[register])
        np.minimum.at(earliest, register[sooner], time[sooner])
        won = sooner[earliest[register[sooner]] == time[sooner]]
        element[register[won]] = h[won]
        latest = earliest.reshape(-1, REGISTERS).max(axis=1)
        open_ = np.flatnonzero(time < latest[row])  # the others' next arrivals change nothing
        row, h, time, rate = row[open_], h[open_], time[open_], rate[open_]
    return element.reshape(-1, REGISTERS)


def sketch(texts: pa.Array) -> list[pa.Array]:
    """Band keys and one byte per register; null band keys for a text without words."""
    return _sketches(texts)[:2]


def _low(sig: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in mix(sig).astype(np.uint8)]


def _sketches(texts: pa.Array) -> list[pa.Array]:
    """Those of :func:`sketch`, and one byte per register of the weighted signature; null where it is the same."""
    row, h, count = shingles(texts)
    sig = _arrivals(len(texts), row, h, np.ones(len(h)))
    repeats = np.zeros(len(texts), bool)
    repeats[row[count > 1]] = True
    mine = repeats[row]
    which = np.flatnonzero(repeats)
    heavy = _arrivals(len(which), np.searchsorted(which, row[mine]), h[mine], count[mine])
    weighted: list[bytes | None] = [None] * len(texts)
    for i, low in zip(which.tolist(), _low(heavy)):
        weighted[i] = low
    key = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        key[:, b] = np.uint64(b + 1)
        for r in range(ROWS):
            key[:, b] = mix(key[:, b] * np.uint64(_BASE) + sig[:, b * ROWS + r])
    empty = ~sig.any(axis=1)
    keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS),
                                    pa.array(key.ravel().view(np.int64)), mask=pa.array(empty))
    return [keys, pa.array(_low(sig), pa.binary()), pa.array(weighted, pa.binary())]


def _jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of two columns of texts."""
    (ra, ha, _), (rb, hb, _) = shingles(a), shingles(b)
    row, h = np.r_[ra, rb], np.r_[ha, hb]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    both = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=len(a)) if len(h) else 0
    total = np.bincount(row, minlength=len(a))
    return both / np.maximum(total - both, 1)


def _pairs_in_arrow(df: DataFrame, check, columns: list[str], slice_bytes: int) -> DataFrame:
    """The rows (a, b) of ``df`` for which ``check(column arrays)`` holds."""
    def run(batches):
        for batch in batches:
            step = max(1, slice_bytes * batch.num_rows // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                keep = check(*[part.column(c) for c in columns])
                yield part.select(["a", "b"]).filter(pa.array(keep))
    return map_in_arrow(df, run, "a binary, b binary")


def _estimate(x: pa.Array, y: pa.Array) -> np.ndarray:
    return (_bytes2d(x) == _bytes2d(y)).mean(axis=1)


def _bytes2d(x: pa.Array) -> np.ndarray:
    return raw_bytes(x)[0].reshape(len(x), REGISTERS)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``links`` (a, b): the component is its least node. Alternating
    large-star and small-star rounds; every round is a stored table. A hub's rows are
    only joined with one row (its least neighbour), so a skewed join splits them."""
    edges, seen = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"), None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a least node's larger neighbours point to it; now each node points to smaller ones only
        large = stored(large.distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


class _Block:
    """Nodes of one bucket (key, side, band, node, component, sketch, keys, text) that meet each other."""

    def __init__(self, batch: pa.RecordBatch):
        self.side, self.band = batch.column("side").to_numpy(), batch.column("band").to_numpy()
        self.component = batch.column("component").dictionary_encode().indices.to_numpy().copy()
        self.register = _bytes2d(batch.column("sketch"))
        self.keys = np.asarray(batch.column("keys").flatten()).reshape(-1, BANDS)
        row, h, _ = shingles(batch.column("text"))
        self.shingle = np.unique(h, return_inverse=True)[1]
        self.begin = np.searchsorted(row, np.arange(batch.num_rows + 1))
        self.held = np.zeros(int(self.shingle.max(initial=-1)) + 1, bool)

    def links(self, lo: int, hi: int) -> tuple[list[int], list[int]]:
        """Verified links among the rows lo..hi (one key) that connect its different components: each node is compared
        with the later ones, or those of the other side, that are not connected with it yet, that share no
        earlier band with it (they meet there), and whose registers agree enough."""
        left, right = [], []
        second = lo + int(np.searchsorted(self.side[lo:hi], 1))
        band = int(self.band[lo])
        comp = self.component[lo:hi].copy()
        for i in range(lo, second):
            j = np.arange(second if second < hi else i + 1, hi)
            j = j[comp[j - lo] != comp[i - lo]]
            j = j[(self.register[j] == self.register[i]).mean(axis=1) >= LEAST_ESTIMATE]
            if band and len(j):
                j = j[~(self.keys[j, :band] == self.keys[i, :band]).any(axis=1)]
            if not len(j):
                continue
            own = self.shingle[self.begin[i]:self.begin[i + 1]]
            self.held[own] = True
            sizes = self.begin[j + 1] - self.begin[j]
            ids = np.concatenate([self.shingle[self.begin[k]:self.begin[k + 1]] for k in j.tolist()])
            both = np.add.reduceat(self.held[ids].astype(np.int64), np.cumsum(sizes) - sizes)
            self.held[own] = False
            for k in j[both >= THRESHOLD * (len(own) + sizes - both)].tolist():
                if comp[k - lo] != comp[i - lo]:
                    left.append(i)
                    right.append(k)
                    comp[comp == comp[k - lo]] = comp[i - lo]
        return left, right


def _cross_links(batches):
    """Rows sorted by key and side → verified links (a, b) between nodes of different components. Within a key,
    nodes of side 0 meet each other, or, where there are two sides, nodes of different sides."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        key = table["key"].to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
        held = table.slice(last)
        if last:
            yield from _links_of(table.slice(0, last))
    if held is not None:
        yield from _links_of(held)


def _links_of(table: pa.Table):
    key = table["key"].to_numpy()
    begin = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)].tolist() if len(key) else [0]
    rows = max(1, min(BLOCK, BLOCK_BYTES * table.num_rows // max(1, table.nbytes)))
    for first, last in slices_of_keys(begin, rows):
        part = table.slice(begin[first], begin[last] - begin[first]).combine_chunks().to_batches()[0]
        block, left, right = _Block(part), [], []
        for lo, hi in zip(begin[first:last], begin[first + 1:last + 1]):
            a, b = block.links(lo - begin[first], hi - begin[first])
            left += a
            right += b
        node = part.column("node")
        yield pa.RecordBatch.from_arrays([node.take(pa.array(left, pa.int64())), node.take(pa.array(right, pa.int64()))],
                                         names=["a", "b"])


def slices_of_keys(begin: list[int], rows: int):
    """Index ranges over the keys that start at ``begin`` (and end at its last), of about ``rows`` rows."""
    first = 0
    for last in range(1, len(begin)):
        if last == len(begin) - 1 or begin[last + 1] - begin[first] > rows:
            yield first, last
            first = last


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have Jaccard similarity THRESHOLD or more."""
    withtext = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
                .join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y"))
    return _pairs_in_arrow(withtext, lambda x, y: _jaccard(x, y) >= THRESHOLD, ["x", "y"], 2 * SLICE_BYTES)


def sketches(rows: DataFrame) -> DataFrame:
    """(node, size, keys, sketch, weighted) of the distinct texts of ``rows`` (node, text)."""
    sized = rows.withColumn("size", F.octet_length("text").cast("long"))
    sketched = with_arrow(sized, "text", [T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()),
                                          T.StructField("weighted", T.BinaryType())], _sketches, SLICE_BYTES)
    return stored(sketched.dropDuplicates(["node"]), "sketches")


def links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links (a, b) between distinct texts of ``rows`` (node, text) that connect every two near
    duplicates, directly or over others; ``nodes`` as of :func:`sketches`."""
    banded = nodes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    members = stored(banded.join(shared, "key").select("key", "band", "leader", "n", "bytes", "node"), "buckets")
    near = members.select("node").distinct()
    # one row per text of those in a shared bucket; copies collapse before the shuffle
    texts = stored(rows.groupBy("node").agg(F.first("text").alias("text")).join(near, "node", "left_semi"), "texts")
    tips = nodes.join(near, "node", "left_semi").select("node", "sketch")

    stars = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    known = (stars.join(tips.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
             .join(tips.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y"))
    close = _pairs_in_arrow(known, lambda x, y: _estimate(x, y) >= LEAST_ESTIMATE, ["x", "y"], SLICE_BYTES)
    first = stored(_verified(close, texts), "star-links")
    united = stored(components(first), "star-components")

    placed = members.join(united, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .filter("lo <> hi").select("key")
    rest = placed.join(mixed, "key")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.least(F.col("n"), F.col("bytes") / BLOCK_BYTES))).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks)
    # block i meets block j in the key (i, j); within a key the lower block is side 0
    met = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keyed = met.select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "band", "node", "component")
    known = keyed.join(nodes, "node").join(texts, "node")
    dealt = known.select("key", "side", "band", "node", "component", "sketch", "keys", "text") \
        .repartition("key").sortWithinPartitions("key", "side")
    second = stored(map_in_arrow(dealt, _cross_links, "a binary, b binary"), "cross-links")
    return first.union(second)


def _similarities(united: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, similarity) of the nodes of ``united`` that are not their component's own."""
    signed = nodes.select("node", F.coalesce("weighted", "sketch").alias("s"))
    both = united.filter("node <> component").join(signed.withColumnRenamed("s", "x"), "node").join(
        signed.select(F.col("node").alias("component"), F.col("s").alias("y")), "component").select("node", "x", "y")

    def estimate(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(_estimate(batch.column("x"), batch.column("y")))],
                                             names=["node", "similarity"])
    return map_in_arrow(both, estimate, "node binary, similarity double")


def classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: bool = True) -> DataFrame:
    """(id, node, component, class_id, class_size, similarity) of every row: ``node`` is the text's digest,
    ``component`` the least digest of the near-duplicate class, ``class_id`` its least id,
    ``class_size`` its number of rows; ``similarity`` (if asked for) is the estimated probability Jaccard similarity, by shingle counts, of the text and
    the component's (1 for equal texts; texts that are linked over others may be less alike than the threshold)."""
    rows = df.select(quoted(id_col).alias("id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.unhex(F.md5("text")))
    nodes = sketches(rows.select("node", "text"))
    united = components(links(rows.select("node", "text"), nodes))
    extra = []
    if similarity:
        united, extra = stored(united, "components"), ["similarity"]
        united = united.join(_similarities(united, nodes), "node", "left")
    named = stored(rows.select("id", "node").join(united, "node", "left").select(
        "id", "node", F.coalesce("component", "node").alias("component"), *[F.coalesce(c, F.lit(1.0)).alias(c) for c in extra]), "members")
    sizes = stored(named.groupBy("component").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")), "class-sizes")
    # a hot class would meet in one task: the few there can be are broadcast, all others are joined by their key
    hot = F.broadcast(sizes.filter(F.col("class_size") > F.lit(max(HOT_PARTS, named.count() // HOT_PARTS))))
    whole = named.join(hot, "component").unionByName(
        named.join(hot, "component", "left_anti").join(sizes, "component"))
    return whole.select(F.col("id").alias(id_col), "node", "component", "class_id", "class_size", *extra)


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each class: the one of the least id (null only where all are null); where
    several texts or rows have it, the least text digest and any of the equal rows."""
    found = classes(df, id_col, text, similarity=False)
    firsts = found.filter(quoted(id_col).eqNullSafe(F.col("class_id"))).groupBy("component").agg(
        F.min("node").alias("__node"), F.first("class_id").alias("__id")).drop("component")
    marked = df.withColumn("__digest", F.unhex(F.md5(F.coalesce(quoted(text), F.lit("")))))
    chosen = marked.join(firsts, (F.col("__digest") == F.col("__node")) & quoted(id_col).eqNullSafe(F.col("__id")))
    return chosen.dropDuplicates(["__node", "__id"]).select(*[quoted(c) for c in df.columns])


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate class stays."""
    return keep_one(docs)
