"""Secret scan with a trigram inverted index per block of documents.

From each rule's regex a Boolean query over trigrams is derived: every match must contain those
trigrams (ASCII lower case). Each task indexes its block of texts in one vectorised pass over the
bytes, keeping postings (trigram → documents) only for trigrams that occur in some rule's query,
evaluates the queries by intersecting and uniting postings, and runs the regex on the candidates
only. A rule without mandatory trigrams scans all documents. No shuffle: a block's index is built
and used where the block is.

Defined results: null or empty text has no spans. Rows are independent, so repeated rows get equal
spans; further columns are kept, a column named like the output is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from re import _constants as C, _parser

from innsight.llm.common import quoted, with_arrow

BLOCK_BYTES = 8_000_000  # texts indexed at a time
MOST_STRINGS = 64        # literal alternatives kept apart while a query is derived

# ---- Boolean queries: True (no mandatory trigram), or ("and" | "or", parts), or a trigram (bytes)


def conj(parts: list):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def disj(parts: list):
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", parts)


def of_strings(strings: set[bytes]):
    sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [a for a in sets if not any(b < a for b in sets)]  # a set that holds another adds nothing
    return disj([conj(sorted(a)) for a in sorted(least, key=sorted)])


def _class(items) -> set[bytes] | None:
    """The ASCII characters of a small class in lower case; None if it is large or negated."""
    found = set()
    for op, arg in items:
        if op is C.LITERAL:
            found.add(arg)
        elif op is C.RANGE:
            found.update(range(arg[0], min(arg[1], arg[0] + 9) + 1))
        else:
            return None
    found = {chr(c).lower().encode() for c in found if c < 128} if all(c < 128 for c in found) else set()
    return found if 0 < len(found) <= 8 else None


class _Walk:
    """Collects what every match must contain. ``strings`` are the possible literal texts read since
    the last gap; at a gap their trigrams become a condition."""

    def __init__(self):
        self.must: list = []
        self.strings: set[bytes] = {b""}
        self.exact = True  # no gap yet: ``strings`` are all texts that can match

    def gap(self):
        self.exact = False
        self.must.append(of_strings(self.strings))
        self.strings = {b""}

    def extend(self, more: set[bytes]):
        if len(self.strings) * len(more) > MOST_STRINGS:
            self.gap()
        self.strings = {a + b for a in self.strings for b in more}

    def read(self, tree):
        for op, arg in tree:
            if op is C.LITERAL and arg < 128:
                self.extend({chr(arg).lower().encode()})
            elif op is C.IN and (chars := _class(arg)):
                self.extend(chars)
            elif op is C.SUBPATTERN:
                self.read(arg[-1])
            elif op is C.BRANCH:
                ways = [_derive(way) for way in arg[1]]
                if all(w.exact for w in ways) and sum(len(w.strings) for w in ways) <= MOST_STRINGS:
                    self.extend(set().union(*(w.strings for w in ways)))
                else:
                    self.gap()
                    self.must.append(disj([w.query() for w in ways]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                least, most, body = arg[0], arg[1], _derive(arg[2])
                if (least, most) == (0, 1) and body.exact:
                    self.extend(body.strings | {b""})
                elif least and body.exact:
                    for _ in range(min(least, 4)):
                        self.extend(body.strings)
                    if least != most or least > 4:
                        self.gap()
                else:
                    self.gap()
                    self.must.append(body.query() if least else True)
            elif op is C.AT:
                pass
            else:  # a large class, any character, a reference, a look-around
                self.gap()


    def query(self):
        return conj([*self.must, of_strings(self.strings)])


def _derive(tree) -> _Walk:
    walk = _Walk()
    walk.read(tree)
    return walk


def trigram_query(pattern: str):
    """The Boolean trigram query that every match of ``pattern`` satisfies; True if there is none."""
    return _derive(_parser.parse(pattern)).query()


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams(p) for p in query[1]))


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` of a match must have; other matches are dropped, though the
    search goes on after them."""
    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# A private key from its header to its END line, whatever lies between (but another header). Where the END line is
# missing: the key's own header lines and the base64 lines that follow, or, on the header's line, base64 runs.
# Line breaks may be written as escapes, and lines quoted or indented.
_BREAK = r"(?:\r?\n|\r|(?:\\r)?\\n)"
_LEAD, _TRAIL = r"[ \t>#*|\"']*+", r"[ \t\"',+;)]*+"
_LINE = rf"[A-Za-z0-9+/=]%s(?={_TRAIL}(?:{_BREAK}|\Z))"
PEM = (r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:"
       r"[^-]*+(?:-(?!----BEGIN |----END )[^-]*+)*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
       rf"|(?:{_TRAIL}{_BREAK}{_LEAD}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\n\\]*+"
       r"|[ \t]++(?:Proc-Type|DEK-Info):[ \t]*+[^\s\\]++)*+"
       rf"(?:{_TRAIL}{_BREAK}{_LEAD}{_LINE % '++'}|(?:{_TRAIL}{_BREAK}{_LEAD})++{_LINE % '{16,}+'}"
       r"|[ \t]*+[A-Za-z0-9+/=]{40,}+(?:[ \t]++[A-Za-z0-9+/=]{16,}+)*+(?:[ \t]++[A-Za-z0-9+/]{2,}+={1,2})?+)*+)")

# Fixed values of the base kinds, in their order; then the formats of well-known credentials.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
         r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", PEM),
    Rule("url_login", r"://[^\s/:@]++:[^\s/@]++@"),
)
RULES = BASE_RULES + ADDED_RULES


class BlockIndex:
    """Postings of the wanted trigrams over one block of texts."""

    def __init__(self, wanted: list[bytes]):
        self.number = {t: i + 1 for i, t in enumerate(wanted)}
        self.table = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        for t, i in self.number.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[ord("A"):ord("Z") + 1] += 32

    def build(self, texts: pa.Array) -> None:
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
        offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        self.docs = np.arange(len(texts))
        self.postings: dict[int, np.ndarray] = {}
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
        if len(raw) < 3:
            return
        b = self.lower[raw]
        seen = self.table[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
        at = np.flatnonzero(seen)
        ends = offsets[1:] - offsets[0]
        doc = np.searchsorted(ends, at, side="right")
        inside = at + 2 < ends[doc]
        keys = np.unique(seen[at[inside]].astype(np.int64) * len(texts) + doc[inside])
        number, docs = keys // len(texts), keys % len(texts)
        cuts = np.flatnonzero(np.diff(number)) + 1
        for part, i in zip(np.split(docs, cuts), number[np.r_[0, cuts]] if len(keys) else ()):
            self.postings[int(i)] = part

    def search(self, query) -> np.ndarray:
        """Sorted documents of the block that satisfy the query."""
        if query is True:
            return self.docs
        if isinstance(query, bytes):
            return self.postings.get(self.number[query], self.docs[:0])
        found = None
        for part in query[1]:
            docs = self.search(part)
            if found is None:
                found = docs
            elif query[0] == "and":
                found = np.intersect1d(found, docs, assume_unique=True)
            else:
                found = np.union1d(found, docs)
            if query[0] == "and" and not len(found):
                break
        return found


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(i, r, re.compile(r.pattern), trigram_query(r.pattern)) for i, r in enumerate(rules)]
        self.index = BlockIndex(sorted(set().union(*(trigrams(q) for *_, q in self.rules))))

    def spans(self, texts: pa.Array) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
        """The texts, and for each its (start, rule number, end) in order."""
        self.index.build(texts)
        values = ["" if t is None else t for t in texts.to_pylist()]
        found: list[list] = [[] for _ in values]
        for i, rule, regex, query in self.rules:
            for d in self.index.search(query).tolist():
                for m in regex.finditer(values[d]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[d].append((m.start(), i, m.end()))
        for spans in found:
            spans.sort()
        return values, found


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SCANNERS: dict = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def scan(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "spans") -> DataFrame:
    """The other columns of ``df`` and ``out``: all secrets in ``text`` by start, then rule order; code
    points, end exclusive."""
    def per_slice(texts: pa.Array) -> list[pa.Array]:
        _, found = _scanner(rules).spans(texts)
        return [pa.array([[{"kind": rules[i].kind, "start": a, "end": b} for a, i, b in spans] for spans in found],
                         _ARROW_SPANS)]
    return with_arrow(df, text, [T.StructField(out, SPANS)], per_slice, BLOCK_BYTES)


def redact_text(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, done = [], 0
    for a, _, b in spans:
        if a >= done:  # spans that overlap share one mask
            out += [text[done:a], mask]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "<secret>",
           count: str = "n_secrets") -> DataFrame:
    """``df`` with the secrets in ``text`` replaced by ``mask``, and ``count``, the number of spans. Texts
    without a secret stay as they are (null stays null)."""
    def per_slice(texts: pa.Array) -> list[pa.Array]:
        values, found = _scanner(rules).spans(texts)
        clean = [t if not spans else redact_text(v, spans, mask)
                 for t, v, spans in zip(texts.to_pylist(), values, found)]
        return [pa.array(clean, pa.string()), pa.array([len(s) for s in found], pa.int64())]
    made = with_arrow(df, text, [T.StructField(text, T.StringType()), T.StructField(count, T.LongType())],
                      per_slice, BLOCK_BYTES)
    return made.select(*[quoted(c) for c in df.columns if c.lower() != count.lower()], quoted(count))


def redact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are masked; ``n_chars`` follows the masked text. Clean documents stay."""
    done = redact(docs, count="__n_secrets")
    changed = F.when(F.col("__n_secrets") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", changed).select(*[quoted(c) for c in docs.columns])
