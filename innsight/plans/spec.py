"""Result envelope and paging of the analyses."""

from __future__ import annotations

import base64
import binascii
import json
import math
from dataclasses import dataclass, field
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from innsight.errors import AnalysisError

DEFAULT_LIMIT = 50


@dataclass(frozen=True)
class Page:
    """``limit`` rows starting at ``(number - 1) * limit``; both must be >= 1. A task keeps the first
    ``number * limit`` rows of its part, so a page far behind costs memory in proportion to its number. With ``after`` (the
    ``next`` token of the page before) the page is the ``limit`` rows behind that page's last row: a task keeps
    ``limit`` rows wherever the page lies, and ``number`` only counts."""

    limit: int = DEFAULT_LIMIT
    number: int = 1
    after: str | None = None

    def __post_init__(self):
        if int(self.limit) < 1 or int(self.number) < 1:
            raise AnalysisError("limit and page must be >= 1")

    @property
    def offset(self) -> int:
        return 0 if self.after else (self.number - 1) * self.limit


def page_token(keys: Sequence[str | None]) -> str:
    """The token of a row: its sort keys as text."""
    return base64.urlsafe_b64encode(json.dumps(list(keys)).encode()).decode()


def token_keys(token: str, count: int) -> list[str | None]:
    try:
        keys = json.loads(base64.urlsafe_b64decode(token.encode()))
    except (binascii.Error, ValueError):
        keys = None
    if not isinstance(keys, list) or len(keys) != count or not all(k is None or isinstance(k, str) for k in keys):
        raise AnalysisError(f"not a page token of this analysis: {token!r}")
    return keys


@dataclass(frozen=True)
class Listing:
    """How a listing's page and statistics come out of one pass over its filtered rows: ``metrics`` are observed below the
    top-n, which sees every row. ``shown(page, *extra)`` projects the page; ``repeated`` metrics are put on every row."""

    filtered: DataFrame
    page_of: Callable[[DataFrame], DataFrame]
    shown: Callable[..., DataFrame]
    metrics: Mapping[str, Column]
    repeated: tuple[str, ...] = ()

    def collect(self, keys: Sequence[Column]) -> tuple[list[dict], list[list], dict]:
        """The page's rows, their sort keys as text, and the metrics."""
        seen = Observation()
        paged = self.page_of(self.filtered.observe(seen, *[c.alias(name) for name, c in self.metrics.items()]))
        named = [f"_key{i}" for i in range(len(keys))]  # of the stored values, which the projection may replace
        keyed = paged.withColumns({n: k.cast("string") for k, n in zip(keys, named)})
        found = [r.asDict(recursive=True) for r in self.shown(keyed, *[F.col(n) for n in named]).collect()]
        got = dict(seen.get)  # empty where the optimizer proved that there are no rows
        stats = {name: got.get(name) for name in self.metrics}
        tokens = [[r.pop(n) for n in named] for r in found]
        return [{**r, **{m: stats[m] for m in self.repeated}} for r in found], tokens, stats


@dataclass(frozen=True)
class AnalysisResult:
    """Lazy result of one analysis.

    ``rows`` is the requested page (or the whole result for unpaged analyses); ``stats`` is a
    one-row DataFrame with ``total_records`` and ``data_until`` plus analysis-specific summary
    columns. Nothing is computed until an action runs on either.
    """

    rows: DataFrame
    stats: DataFrame
    page: Page | None = None
    analysis: str = ""
    filters: Mapping = field(default_factory=dict)
    listing: Listing | None = None
    order: Sequence[tuple[str | Column, str]] = ()   # of a paged result; of a listing over its filtered rows

    def envelope(self) -> dict:
        """Collect the rows and the stats row into the response dictionary.

        Of a paged analysis at most ``limit`` rows reach the driver. An unpaged one returns its whole
        result: one row per resort and month, department or point of sale, never raw rows. A listing reads its filtered
        rows once for both. ``next`` in the pagination is the token of the following page, where one may follow.
        """
        keys = [F.col(c) if isinstance(c, str) else c for c, _ in self.order]
        if self.listing is not None:
            data, tokens, stats = self.listing.collect(keys)
        else:
            stats = self.stats.first().asDict()
            data, tokens = None, []
        if not stats.pop("source_found", True):
            raise AnalysisError(f"no data of the requested year for {self.analysis or 'the analysis'}")
        total = int(stats.pop("total_records") or 0)
        page = self.page or Page()
        if data is None:
            named = [f"_key{i}" for i in range(len(keys))]
            rows = self.rows.select("*", *[k.cast("string").alias(n) for k, n in zip(keys, named)]) if keys else self.rows
            data = [r.asDict(recursive=True) for r in rows.collect()]
            tokens = [[r.pop(n) for n in named] for r in data]
        out = {
            "analysis_executed": self.analysis,
            "filters_used": dict(self.filters),
            "data": data,
            "pagination": {"page": page.number, "limit": page.limit, "total_records": total,
                           "total_pages": math.ceil(total / page.limit)},
        }
        if keys and len(data) == page.limit and (page.after or page.offset + page.limit < total):
            out["pagination"]["next"] = page_token(tokens[-1])
        if (until := stats.pop("data_until", None)) is not None:
            out["data_until"] = until
        if stats:
            out["summary"] = stats
        return out
