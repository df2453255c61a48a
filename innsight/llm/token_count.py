"""Token counts of a unigram tokenizer without tokenising: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at a position, the
longest (earliest start) first. Dynamic programming over the positions carries the best score and the
number of pieces on that path; no path is kept. Rules of the tokenizer, exactly: a later candidate
replaces the best one only if its score is higher; a character that is no piece of its own may be
unknown, at the least score of the vocabulary minus 10; neighbouring unknowns are one token, or
their bytes where the vocabulary has byte pieces. Spaces become marks, and a text without one at its beginning gets one. A
text is cut before every mark that follows another character: no piece reaches over such a place (a vocabulary with one that does
is not cut at all), so the parts are independent and each distinct one is counted once per worker (a bounded table is
kept). Runs of marks stay whole, since pieces may be such runs.

Defined results: null or empty text has no tokens. Rows are independent; further columns are
kept; a column named like the output is replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from innsight.llm.bpe import unknown
from innsight.llm.common import with_arrow

MARK = "▁"
PARTS = re.compile(f"{MARK}+[^{MARK}]*").findall
SLICE_BYTES = 2_000_000


def read_pieces(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, in the order of the ids."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Counts the tokens of words; ``known`` holds the counts of words met before."""

    def __init__(self, pieces: list[tuple[str, float]], unk_id: int = 0, byte_fallback: bool = True):
        import ahocorasick
        self.known: dict[str, int] = {}
        self.vocabulary = {p for p, _ in pieces}
        self.unk_score = min(s for _, s in pieces) - 10
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in self.vocabulary} if byte_fallback else set()
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unk_id))
        self.automaton.make_automaton()
        self.whole = MARK not in self.vocabulary or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.vocabulary)

    def _unknown_tokens(self, run: str) -> int:
        """Tokens of a run of unknown characters."""
        if run in self.vocabulary:
            return 1
        raw = run.encode("utf-8", "surrogatepass")
        return len(raw) if self.bytes.issuperset(raw) else 1

    def count(self, word: str) -> int:
        n = len(word)
        # at each position, on the best path to it: score, tokens before the open run of unknowns, start of that run (-1: none)
        score, tokens, run = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        matches = self.automaton.iter(word)
        end, piece = next(matches, (n, None))
        for e in range(1, n + 1):
            best, start, unk, single = None, e - 1, True, False
            while end == e - 1:
                length, value, is_unk = piece
                single |= length == 1
                reached = score[e - length] + value
                if best is None or reached > best:
                    best, start, unk = reached, e - length, is_unk
                end, piece = next(matches, (n, None))
            if not single:
                reached = score[e - 1] + self.unk_score
                if best is None or reached > best:
                    best, start, unk = reached, e - 1, True
            score[e] = best
            if unk:
                tokens[e], run[e] = tokens[start], start if run[start] < 0 else run[start]
            else:
                tokens[e] = tokens[start] + 1
                if run[start] >= 0:
                    tokens[e] += self._unknown_tokens(word[run[start]:start])
        return tokens[n] + (self._unknown_tokens(word[run[n]:]) if run[n] >= 0 else 0)

    def counts(self, texts: list[str | None]) -> list[int]:
        cut = []
        for t in texts:
            marked = (t or "").replace(" ", MARK).removeprefix(MARK)  # each part is without its first mark
            if not t:
                cut.append([])
            elif self.whole:
                cut.append([marked])
            elif MARK + MARK in marked or marked.startswith(MARK):
                cut.append([p[1:] for p in PARTS(MARK + marked)])
            else:
                cut.append(marked.split(MARK) if not marked.endswith(MARK) else [*marked[:-1].split(MARK), ""])
        for w in unknown(self, set().union(*cut)):
            self.known[w] = self.count(MARK + w)
        get = self.known.__getitem__
        return [sum(map(get, words)) for words in cut]


_COUNTERS: dict = {}


def count_tokens(df: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens", unk_id: int = 0,
                 byte_fallback: bool = True) -> DataFrame:
    """The other columns of ``df`` and ``out``, the number of tokens of ``text``, by the pieces and scores of the
    sentencepiece model at ``model_path`` read as a unigram vocabulary (some hundred KB, sent to the tasks)."""
    pieces = read_pieces(model_path)
    key = (model_path, unk_id, byte_fallback)

    def per_slice(texts: pa.Array) -> list[pa.Array]:
        if key not in _COUNTERS:
            _COUNTERS[key] = UnigramCounter(pieces, unk_id, byte_fallback)
        return [pa.array(_COUNTERS[key].counts(texts.to_pylist()), pa.int64())]
    return with_arrow(df, text, [T.StructField(out, T.LongType())], per_slice, SLICE_BYTES)
