"""Quality classifier: a generalised additive model with pairwise interactions over text statistics.

The log odds of a good text are a sum of lookup tables: one per feature over its bins, then one per pair of features over a
grid of bins. Both are learned by cyclic boosting: round after round each table in turn gets a shallow tree (at most four
leaves) fitted to the gradients of the log loss, at a small learning rate; the pairs are those whose grid explains most
of what the single features leave. Scoring is a bin search and an addition per table, vectorised over Arrow batches.

One pass over the texts makes the features and stores them; labels meet only those. The model is fitted in the driver on at
most about ``FIT_ROWS`` labelled rows: beyond that bound, rows are kept by a hash of their place, with equal probability.
Everything else covers all rows. A model is a few thousand numbers, so it goes along with the tasks.

Defined results: null text = empty text; an empty text has zero features and a score like any other. Very long texts are read
whole, by work in proportion to their length. Ties: of equal gains the first feature, cut or pair in order is taken. Rows with null or
other labels than 0 and 1 teach nothing; an id with several labels teaches each. Without labels of both kinds the tables
stay empty and every score is the smoothed prior. Equal texts get equal scores. Repeated rows and null ids pass through; the
other columns are kept, and those named like an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.common import map_in_arrow, quoted, stored, with_arrow

FIT_ROWS = 100_000
BINS = 64
PAIR_BINS = 16
PAIRS = 8
ROUNDS, PAIR_ROUNDS = 150, 40
RATE = 0.1
LEAST_ROWS = 20  # of a leaf
RIDGE = 1.0
THRESHOLD = 0.7
SLICE_BYTES, SLICE_ROWS = 1_000_000, 2_000

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digits", "symbols", "stops", "commas", "exclamations",
    "other_marks", "white_space", "non_ascii", "byte_entropy", "line_words", "line_repeats", "distinct_words", "top_word",
    "trigram_repeats", "capitalised", "short_words", "odd_word_ends")

_CLASSES = (range(65, 91), range(48, 58), b"#*$%&|<>", b".", b",;:", b"!?", b"\"'()[]{}-_/\\=+@^~`", b" \t\n\r\x0b\x0c", range(192, 256))
CLASS_OF = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES):
    CLASS_OF[list(_members), _i] = 1


def word_features(text: str) -> tuple[float, ...]:
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    counts = Counter(words)
    triples = max(len(words) - 2, 1)
    lengths = {w: len(w) for w in counts}
    return (
        math.log1p(len(words)), sum(lengths[w] * k for w, k in counts.items()) / n, max(lengths.values(), default=0),
        len(words) / m, 1 - len(set(lines)) / m if lines else 0.0, len(counts) / n, max(counts.values(), default=0) / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if len(words) > 2 else 0.0,
        sum(k for w, k in counts.items() if w[0].isupper()) / n, sum(k for w, k in counts.items() if lengths[w] < 3) / n,
        sum(k for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?") / n)


def features(values: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    out = np.zeros((len(values), len(FEATURES)))
    texts = ["" if t is None else t for t in values.to_pylist()]
    for at in range(0, len(texts), SLICE_ROWS):
        part = texts[at:at + SLICE_ROWS]
        raw = [t.encode() for t in part]
        sizes = np.array([len(x) for x in raw])
        place = np.repeat(np.arange(len(part)) << 8, sizes) + np.frombuffer(b"".join(raw), np.uint8)
        seen = np.bincount(place, minlength=len(part) << 8).reshape(-1, 256)
        share = seen / np.maximum(sizes, 1)[:, None]
        entropy = -np.sum(share * np.log2(np.where(share > 0, share, 1)), axis=1)
        by_class = share @ CLASS_OF
        by_word = np.array([word_features(t) for t in part])
        out[at:at + len(part)] = np.column_stack([np.log1p(sizes), by_word[:, :3], by_class, entropy, by_word[:, 3:]])
    return out


def with_features(df: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """The other columns of ``df`` and ``out``, an array of doubles in the order of ``FEATURES``."""
    def per_slice(values: pa.Array) -> list[pa.Array]:
        made = features(values)
        offsets = pa.array(np.arange(len(made) + 1) * len(FEATURES), pa.int32())
        return [pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))]
    return with_arrow(df, text, [T.StructField(out, T.ArrayType(T.DoubleType()))], per_slice, SLICE_BYTES)


def shallow_tree(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values over a grid of bins: the best splits along either axis, at most 2^depth leaves."""
    out = np.zeros(grad.shape)

    def split(a: slice, b: slice, left: int) -> None:
        g, h, n = grad[a, b], hess[a, b], rows[a, b]
        whole = (g.sum(), h.sum(), n.sum())
        best = (1e-9, None)
        if left:
            for axis in (0, 1):
                below = [np.cumsum(x.sum(1 - axis))[:-1] for x in (g, h, n)]
                if not len(below[0]):
                    continue
                above = [w - x for w, x in zip(whole, below)]
                gain = below[0] ** 2 / (below[1] + RIDGE) + above[0] ** 2 / (above[1] + RIDGE) - whole[0] ** 2 / (whole[1] + RIDGE)
                gain[(below[2] < LEAST_ROWS) | (above[2] < LEAST_ROWS)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (axis, k + 1))
        if best[1] is None:
            out[a, b] = whole[0] / (whole[1] + RIDGE)
        elif best[1][0] == 0:
            split(slice(a.start, a.start + best[1][1]), b, left - 1)
            split(slice(a.start + best[1][1], a.stop), b, left - 1)
        else:
            split(a, slice(b.start, b.start + best[1][1]), left - 1)
            split(a, slice(b.start + best[1][1], b.stop), left - 1)

    split(slice(0, grad.shape[0]), slice(0, grad.shape[1]), depth)
    return out


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    """Bounds of at most ``bins`` bins of about as many rows each."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(values) else np.empty(0)


@dataclass
class Gam:
    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, j], "left")]
        coarse = {j: np.searchsorted(self.pair_cuts[j], x[:, j], "left") for pair in self.pairs for j in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[a], coarse[b]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.log_odds(x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Gam:
    """The model of features ``x`` (rows, features) and labels ``y`` (0 or 1)."""
    good, width = float(y.sum()), x.shape[1]
    model = Gam(math.log((good + 1) / (len(y) - good + 1)), [cuts_of(x[:, j], BINS) for j in range(width)], [],
                [cuts_of(x[:, j], PAIR_BINS) for j in range(width)])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if not 0 < good < len(y):
        return model
    at = np.full(len(y), model.intercept)

    def boost(bins: list[np.ndarray], shapes: list[tuple[int, int]], tables: list[np.ndarray], times: int) -> None:
        nonlocal at
        rows = [np.bincount(b, minlength=r * c).reshape(r, c) for b, (r, c) in zip(bins, shapes)]
        for _ in range(times):
            for b, shape, n, table in zip(bins, shapes, rows, tables):
                p = _sigmoid(at)
                grad, hess = (np.bincount(b, v, n.size).reshape(shape) for v in (y - p, p * (1 - p)))
                step = RATE * shallow_tree(grad, hess, n)
                table += step.reshape(table.shape)
                at += step.ravel()[b]

    single = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(model.cuts)]
    boost(single, [(len(t), 1) for t in model.tables], model.tables, rounds)

    p = _sigmoid(at)
    coarse = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(model.pair_cuts)]
    wide = [len(c) + 1 for c in model.pair_cuts]
    gains = []
    for a in range(width):
        for b in range(a + 1, width):
            if wide[a] < 2 or wide[b] < 2:
                continue
            cell, shape = coarse[a] * wide[b] + coarse[b], (wide[a], wide[b])
            grad, hess, n = (np.bincount(cell, v, wide[a] * wide[b]).reshape(shape) for v in (y - p, p * (1 - p), np.ones(len(y))))
            gains.append((float(np.sum(grad * shallow_tree(grad, hess, n))), a, b))  # the drop of the loss, to first order
    chosen = sorted(gains, key=lambda g: (-g[0], g[1:]))[:pairs]
    model.pairs = [(a, b) for _, a, b in chosen]
    model.pair_tables = [np.zeros((wide[a], wide[b])) for a, b in model.pairs]
    boost([coarse[a] * wide[b] + coarse[b] for a, b in model.pairs], [t.shape for t in model.pair_tables], model.pair_tables, pair_rounds)
    return model


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def learn(featured: DataFrame, labels: DataFrame, key: str, label: str, fit_rows: int = FIT_ROWS) -> Gam:
    """The model of the labelled rows of ``featured`` (key, features): at most about ``fit_rows`` of them."""
    known = labels.select(F.col(key), F.col(label).cast("int").alias("__y")).filter(F.col("__y").isin(0, 1) & F.col(key).isNotNull())
    rows = stored(featured.select(key, "features").join(known, key).select("features", "__y")
                  .withColumn("place", F.monotonically_increasing_id()), "gam-fit")
    share = fit_rows / max(rows.count(), 1)
    if share < 1:  # an evenly spread hash of the place is below the share
        rows = rows.filter(F.pmod(F.xxhash64("place"), F.lit(1 << 32)) < int(share * (1 << 32)))
    got = rows.orderBy("place").select("features", "__y").toArrow().combine_chunks()
    if not got.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(_matrix(got["features"].chunk(0), len(FEATURES)), got["__y"].to_numpy().astype(float))


def with_score(featured: DataFrame, model: Gam, out: str = "score") -> DataFrame:
    """The other columns of ``featured`` and ``out``, the probability of a good text."""
    keep = [f for f in featured.schema.fields if f.name.lower() not in ("features", out.lower())]
    names = [*(f"c{i}" for i in range(len(keep))), "out"]

    def run(batches):
        for batch in batches:
            scores = model.score(_matrix(batch.column(len(keep)), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=names)
    plain = featured.select(*[quoted(f.name).alias(c) for f, c in zip(keep, names)], F.col("features").alias("source"))
    schema = T.StructType([*(T.StructField(c, f.dataType) for f, c in zip(keep, names)), T.StructField("out", T.DoubleType())])
    return map_in_arrow(plain, run, schema).toDF(*[f.name for f in keep], out)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: the checksum of the id, as text, leaves 2 when divided by four."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document; ``labels`` has doc_id and quality."""
    featured = stored(with_features(docs.select("doc_id", "text")), "gam-features")
    model = learn(featured.filter(~held_out()), labels.filter(~held_out()), "doc_id", "quality", fit_rows)
    scored = with_score(featured, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
