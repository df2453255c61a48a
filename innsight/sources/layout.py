"""Layout of a published table: which rows share a file, decided before the rows are written.

A sketch of the layout keys is a weighted sample of rows. Row ``i`` of a task (from 0) is kept with probability
``min(1, k / (i + 1))`` and weight ``max(1, (i + 1) / k)``, so a task keeps about ``k * (1 + ln(n / k))`` of its
``n`` rows without knowing ``n``, and samples merge by union. The profile pass of a load collects one per split; of a table that is
already stored its key columns are counted instead. Weighted quantiles of the merged sketch give static bounds, a binary search puts
each row in its range, and one exchange by that number deals the rows: nothing is evaluated again to find the bounds.

A range that holds more rows than a file, such as a single hot value, is dealt to several files by a hash of the row.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_FILE = 1_000_000
SAMPLE_ROWS = 64          # k of a split's sample
MAX_BOUNDS = 4096         # ranges of keys; beyond, a range has several files
MAX_TUPLES = 200_000      # distinct sampled keys brought to the driver


def sample_sql(mid: str, cells: dict[str, str], wanted: str = "true", k: int = SAMPLE_ROWS) -> str:
    """Aggregate: the sample of a group of rows, as an array of structs of ``cells`` (name → SQL) and ``_w``. ``mid`` is the
    row's ``monotonically_increasing_id``; rows that are not ``wanted`` are left out."""
    place = f"(({mid} & 8589934591) + 1)"
    chance = f"(xxhash64({mid}) & 9223372036854775807) < 9223372036854775807 * ({k}D / {place})"
    fields = "".join(f", '{name}', {sql}" for name, sql in cells.items())
    return f"collect_list(IF(({wanted}) AND {chance}, named_struct('_w', greatest(1D, {place} / {k}D){fields}), NULL))"


@dataclass(frozen=True)
class Layout:
    """Ranges of ``keys``: range ``b`` ends with ``bounds[b]`` (the last one is open) and has ``files[b]`` files."""

    keys: tuple[str, ...]
    schema: T.StructType
    bounds: list[tuple]
    files: list[int]

    def deal(self, df: DataFrame) -> DataFrame:
        """``df`` with a partition per file, sorted by the keys."""
        cut = F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
        starts = [sum(self.files[:b]) for b in range(len(self.files))]
        place = F.element_at(F.lit(starts), F.col("_range") + 1) + F.pmod(cut, F.element_at(F.lit(self.files), F.col("_range") + 1))
        dealt = df.withColumn("_range", self.range_of()).withColumn("_place", place.cast("int")).drop("_range")
        return dealt.repartitionById(sum(self.files), "_place").sortWithinPartitions(
            *[F.col(k).asc_nulls_first() for k in self.keys]).drop("_place")

    def range_of(self) -> Column:
        """The number of bounds below the row's keys, by binary search."""
        if not self.bounds:
            return F.lit(0)
        names = [f"k{i}" for i in range(len(self.keys))]
        kind = T.ArrayType(T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, self.schema.fields)]))
        rows = [{n: v for n, v in zip(names, b) if v is not None} for b in self.bounds]
        bounds = F.from_json(F.lit(json.dumps(rows, default=str)), kind, {"allowNonNumericNumbers": "true"})  # folded to a literal
        own = F.struct(*[F.col(k).alias(n) for k, n in zip(self.keys, names)])

        def step(at: Column, _: Column) -> Column:
            middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
            below = F.element_at(bounds, F.least(middle, F.lit(len(rows) - 1)) + 1) < own
            return F.when(at["lo"] >= at["hi"], at).when(below, F.struct((middle + 1).alias("lo"), at["hi"].alias("hi"))) \
                .otherwise(F.struct(at["lo"].alias("lo"), middle.alias("hi")))
        whole = F.struct(F.lit(0).alias("lo"), F.lit(len(rows)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(rows).bit_length() + 1)), whole, step, lambda at: at["lo"])


def layout_of(sketch: DataFrame, keys: Sequence[str], rows: int, rows_per_file: int = ROWS_PER_FILE,
              weight: str = "_w") -> Layout:
    """The layout for ``rows`` rows with the weighted keys of ``sketch`` (``keys``, ``weight``). Only distinct keys and
    their weights are brought to the driver: all up to ``MAX_TUPLES``, beyond that an evenly hashed part of them."""
    weighed = sketch.groupBy(*keys).agg(F.sum(weight).alias("_weight"))
    schema = T.StructType([weighed.schema[k] for k in keys])
    distinct = weighed.count()
    if distinct > MAX_TUPLES:
        share = MAX_TUPLES / distinct
        weighed = weighed.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 32)) < int(share * (1 << 32)))
    found = weighed.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).collect()
    total = sum(r["_weight"] for r in found) or 1
    target = max(rows_per_file, rows / MAX_BOUNDS)
    bounds, sizes, size = [], [], 0.0
    for i, r in enumerate(found):
        mine = r["_weight"] * rows / total
        if size and size + mine > target:
            bounds.append(tuple(found[i - 1][k] for k in keys))
            sizes.append(size)
            size = 0.0
        size += mine
    sizes.append(size)
    return Layout(tuple(keys), schema, bounds, [max(1, -(-int(s) // rows_per_file)) for s in sizes])
