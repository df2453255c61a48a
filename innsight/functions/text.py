"""Text folding and value canonicalisation, as Spark column expressions and as their
driver-side twins for filter values.

Every column function here is a built-in Catalyst expression (``lower``, ``translate``,
``trim``, ``contains``, map lookups), so it stays inside whole-stage codegen. The Python
twins (``fold_py``...) are applied to the handful of filter values of a request, never to data.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: must equal the analysed system's for the same results -------------------
# Canonical resort codes; a filter value containing one of them (after folding) is replaced
# by it. ``all_resorts`` is the sentinel that removes the resort predicate.
RESORT_CODES = ("resort_alpha", "resort_beta", "resort_gamma", "resort_delta", "resort_epsilon")
ALL_RESORTS = "all_resorts"
# The workforce analyses also know two non-resort units.
WORKFORCE_CODES = ("resort_alpha", "resort_beta", "resort_gamma", "resort_delta", "resort_epsilon", "all_resorts",
                   "corp_hq", "partner_brand")
# Portuguese month names and abbreviations.
MONTH_NUMBERS = {
    "janeiro": 1, "jan": 1,
    "fevereiro": 2, "fev": 2,
    "marco": 3, "março": 3, "mar": 3,
    "abril": 4, "abr": 4,
    "maio": 5, "mai": 5,
    "junho": 6, "jun": 6,
    "julho": 7, "jul": 7,
    "agosto": 8, "ago": 8,
    "setembro": 9, "set": 9,
    "outubro": 10, "out": 10,
    "novembro": 11, "nov": 11,
    "dezembro": 12, "dez": 12,
}
# Letters that do not decompose, as the source's accent stripping writes them.
LETTERS = {"æ": "ae", "ð": "d", "ø": "o", "þ": "th", "ß": "ss", "đ": "d", "ħ": "h", "ı": "i", "ĳ": "ij", "ł": "l", "ŋ": "n",
           "œ": "oe", "ŧ": "t"}
# --- end of fixed values ------------------------------------------------------------------
MARKS = "".join(chr(c) for c in range(0x0300, 0x0370))  # combining marks, as decomposed letters carry them


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(accented, plain) strings for ``translate``, generated by rule.

    Rule: every lower-case letter of the Latin-1 Supplement, Latin Extended-A/B and Latin
    Extended Additional blocks whose canonical decomposition is one ASCII letter followed by
    combining marks maps to that letter. Letters without such a decomposition (ß, æ, œ, ø) are those of
    ``LETTERS``.
    """
    src, dst = [], []
    for cp in chain(range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        ch = chr(cp)
        if ch.lower() != ch:
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
        if base != ch and len(base) == 1 and base.isascii():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


@lru_cache(maxsize=1)
def _letter_table() -> tuple[str, str]:
    """(letters, replacements of one letter each), then the combining marks, which have none. An accented letter that
    becomes several (``ǽ``) goes to its base first."""
    src, dst = accent_table()
    pairs = {**dict(zip(src, dst)), **{a: b for a, b in LETTERS.items() if len(b) == 1}}
    for cp in range(0x00C0, 0x0250):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c))
        if chr(cp).islower() and base != chr(cp) and base in LETTERS:
            pairs[chr(cp)] = LETTERS[base] if len(LETTERS[base]) == 1 else base
    return "".join(pairs) + MARKS, "".join(pairs.values())


LONGER = {a: b for a, b in LETTERS.items() if len(b) > 1}


@lru_cache(maxsize=1)
def _py_table() -> dict[int, str | None]:
    src, dst = _letter_table()
    table = dict(zip(map(ord, src), [*dst, *[None] * len(MARKS)]))
    return {k: LONGER.get(v, v) for k, v in table.items()} | {ord(a): b for a, b in LONGER.items()}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: str | Column) -> Column:
    """Case- and accent-insensitive form: lower case, accented letters plain, combining marks gone (so composed and
    decomposed spellings are one), and letters such as ß and æ written out: one ``translate``, and a replacement for
    each letter that becomes two (a byte search where it is absent)."""
    plain = F.translate(F.lower(_col(c)), *_letter_table())
    for letter, letters in LONGER.items():
        plain = F.replace(plain, F.lit(letter), F.lit(letters))
    return plain


def fold_py(value: Any) -> Any:
    """Driver-side twin of :func:`fold` for a filter value."""
    if not isinstance(value, str):
        return value
    return value.lower().translate(_py_table())


def canonical_code_py(value: Any, codes=RESORT_CODES + (ALL_RESORTS,)) -> Any:
    """First canonical code contained in the folded value, else the value unchanged."""
    return next((code for code in codes if code in fold_py(value)), value) if isinstance(value, str) else value


def canonical_code(c: str | Column, codes=RESORT_CODES) -> Column:
    """Column form of :func:`canonical_code_py` (used to standardise a resort column)."""
    folded = fold(c)
    return F.coalesce(*[F.when(folded.contains(code), F.lit(code)) for code in codes], _col(c))


def month_number_py(value: Any) -> Any:
    """Month of a name, an abbreviation or a number in text; anything else unchanged."""
    if not isinstance(value, str):
        return value
    word = fold_py(value.strip())
    number = MONTH_NUMBERS.get(word)
    return number if number else int(word) if re.fullmatch(r"[+-]?[0-9]+", word) else value


def month_number(c: str | Column) -> Column:
    """Column form of :func:`month_number_py`; unknown text gives NULL."""
    pairs = list(chain.from_iterable((F.lit(k), F.lit(v)) for k, v in MONTH_NUMBERS.items()))
    key = F.replace(F.trim(F.lower(_col(c).cast("string"))), F.lit("ç"), F.lit("c"))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key.try_cast("int"))


def classes_of(c: str | Column, classes: dict) -> Column:
    """N8 as a column: the names of every class (``name → values``) whose values hold ``c``;
    a value may belong to several classes. Pure expressions, no join."""
    col = _col(c)
    hits = [F.when(col.isin(list(values)), F.lit(name)) for name, values in classes.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def snake_name(name: str) -> str:
    """Output name of a column without an entry in its rename map: folded, words joined by ``_``."""
    return "_".join(re.split(r"[ -]", fold_py(name)))
