"""Table catalog: the analyses ask for tables by name and never know where they live."""

from __future__ import annotations

import re
from typing import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from innsight.errors import AnalysisError
from innsight.sources.versions import VersionLog

# Table names the analyses read.
TABLES = (
    "daily_occupancy", "guest_feedback", "department_complaint_targets", "business_indicators",
    "extra_revenue", "accommodation_revenue", "monthly_extra_revenue_targets", "guest_targets",
    "pos_item_sales", "medical_attendances", "overtime_positive", "overtime_negative",
    "employee_overtime_balance", "employee_sentiment_by_resort", "employee_sentiment_by_department",
    "employee_sentiment_surveys",
)

# Loaded as one table per year (``<name>_<year>``) or as one table partitioned by year.
YEARLY_TABLES = ("pos_item_sales",)


class Catalog:
    """Name → DataFrame. Entries may be DataFrames or zero-argument factories (resolved lazily
    and memoised, so a binding is planned once per catalog)."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]],
                 years: Mapping[str, Iterable[int]] | None = None, domains: Mapping[str, Mapping[str, list[str]]] | None = None):
        """``years``: all years of yearly tables, where metadata tells them; the entry of year ``y`` of ``name`` is
        ``<name>_<y>`` or, without such an entry, a partition of ``name``. ``domains``: by table the distinct values of key
        twins, where they are few."""
        self.spark = spark
        self._entries = dict(tables)
        self._resolved: dict[str, DataFrame] = {}
        self._years = {n: frozenset(ys) for n, ys in (years or {}).items()}
        self._domains = dict(domains or {})

    def has(self, name: str) -> bool:
        return name in self._entries

    def table(self, name: str) -> DataFrame:
        if name not in self._entries:
            raise AnalysisError(f"table {name!r} is not available")
        if name not in self._resolved:
            entry = self._entries[name]
            self._resolved[name] = entry() if callable(entry) else entry
        return self._resolved[name]

    def domains(self, name: str) -> Mapping[str, list[str]]:
        """Key twin → all its values, of the version that :meth:`table` reads."""
        return self._domains.get(name, {})

    def of_year(self, name: str, year: int) -> tuple[DataFrame, bool]:
        """The table that holds a year of ``name`` and whether the year is known to be there. A year that
        metadata knows to be missing is an error; no job runs. Of a source without such metadata (a view) nothing is known
        before its rows are read."""
        known, yearly = self._years.get(name), f"{name}_{year}"
        if self.has(yearly):
            return self.table(yearly), True
        if known is not None and year not in known or not self.has(name):
            raise AnalysisError(f"{name} for year {year} is not available")
        return self.table(name), known is not None

    @classmethod
    def from_metastore(cls, spark: SparkSession, database: str | None = None,
                       names=TABLES) -> "Catalog":
        """Tables (or the published views of :mod:`innsight.sources.ingest`) in a database. A published view is read as the version that
        its log names, so rows, years and domains belong together."""
        prefix = f"{database}." if database else ""
        found = {t.name: t.tableType for t in (spark.catalog.listTables(database) if database else spark.catalog.listTables())}
        yearly = {n for n in found for base in YEARLY_TABLES if re.fullmatch(rf"{base}_\d{{4}}", n)}
        present = {n for n in (*names, *yearly) if n in found}
        logged = {n: VersionLog(spark, n, database).current() for n in present if found[n] == "VIEW"}
        logged = {n: e for n, e in logged.items() if e is not None and e.version in found}
        stored = {n: prefix + (logged[n].version if n in logged else n) for n in present}
        years = {}
        for base in YEARLY_TABLES:
            alone = {int(n[len(base) + 1:]) for n in yearly if n.startswith(base)}
            listed = _years(spark, base, database, found, logged) if base in present else set()
            if listed is not None and (alone or base in present):  # else rows outside the yearly tables can tell only when read
                years[base] = alone | listed
        return cls(spark, {n: (lambda t=t: spark.table(t)) for n, t in stored.items()}, years,
                   {n: e.domains for n, e in logged.items()})


def _years(spark: SparkSession, name: str, database: str | None, found: Mapping[str, str], logged: Mapping) -> set[int] | None:
    """The years of a table from its log or its list of partitions; None if neither tells them."""
    if name in logged:
        values = logged[name].partitions.get("ano")
    elif found[name] == "VIEW":
        values = None
    else:
        qualified = f"{database}.{name}" if database else name
        if "ano" not in [c.name for c in spark.catalog.listColumns(qualified) if c.isPartition]:
            return None
        parts = [dict(p.split("=", 1) for p in r[0].split("/")) for r in spark.sql(f"SHOW PARTITIONS {qualified}").collect()]
        values = [p["ano"] for p in parts]
    return None if values is None else {int(v) for v in values if v.isdigit()}
