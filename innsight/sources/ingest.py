"""Ingestion: string tables exported from spreadsheets → typed tables with stable row ids,
staged and published atomically.

Pipeline (driver handles metadata only):

    read header (first line of the first file)    S1/S2    (one tiny job)
    header normalise + duplicate removal          I1, I2   (driver, on column names)
    per-split profile: row count, first row id,   H1, I4, I6  (ONE aggregate pass over the input,
      cell-class counts per column                           checkpointed: one row per split)
      sketch of the layout keys                   K1       (in the same pass)
    intervals of positions proved disjoint        I9       (on the per-split table: no row leaves its task)
    coerce, clean, drop blank rows, ids, twins    I5-I8    (one projection, codegen)
    write versioned table, count check, swap view K1, K4, K2, K5  (the second and last pass)

Row positions are computed without a global sort or window: per input split Spark counts rows
and records the first ``monotonically_increasing_id``; a window over the (small, checkpointed)
per-split table turns counts into offsets, which are joined back. Position = offset + (id - first
id). The same per-split pass counts each column's cell classes, so type inference needs no pass
of its own: a CSV load reads its input twice in total (profile, write).
"""

from __future__ import annotations

import re
import time
import unicodedata
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Iterable, Sequence
from urllib.parse import unquote

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from innsight.functions.text import fold
from innsight.sources.layout import ROWS_PER_FILE, layout_of, sample_sql
from innsight.sources.versions import VersionLog, domains_of

POS = "_pos"          # 0-based line position within its file
FILE = "_file"
HEADER = "_header"    # the line is its file's header
SPLIT_CONFS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
# --- fixed values: must equal the analysed system's for the same results -------------------
NUMBER_PATTERN = r"^\s*[-+]?[0-9]+([.,][0-9]*)?\s*$"
WORKBOOK_NULLS = ("nan", "NaT")
# --- end of fixed values ------------------------------------------------------------------
INTEGER, REAL, TEXT = "INTEGER", "REAL", "TEXT"
SPARK_TYPES = {INTEGER: "bigint", REAL: "double", TEXT: "string"}


class IngestError(RuntimeError):
    """A load failed; the published table is untouched."""


@dataclass(frozen=True)
class IngestSpec:
    """One source of the catalogue."""

    source_id: str
    target: str
    path: str
    profile: str = "sheet"                  # "sheet" (CSV export of a tab) | "workbook"
    tab: str = "Sheet1"
    fmt: str = "csv"                        # "csv" | "parquet" (all-string parquet)
    key_columns: tuple[str, ...] = ()       # normalised names that get a folded ``__key`` twin
    date_columns: tuple[str, ...] = ()      # normalised names that get a typed ``__date`` twin
    partition_by: tuple[str, ...] = ()
    cluster_by: tuple[str, ...] = ()       # rows sorted by these within each written file (min/max skipping)
    database: str | None = None
    multiline: bool = False                 # quoted cells with line breaks (file not splittable)
    multi_file: bool = False                # the source may be cut into several files: ids name the file
    on_empty: str | None = None             # "drop" | "keep"; default: sheet drops, workbook keeps
    keep_versions: int = 2                  # newest versions that stay in any case
    keep_seconds: float = 0                 # a version stays at least so long after it was superseded

    @property
    def empty_action(self) -> str:
        return self.on_empty or ("drop" if self.profile == "sheet" else "keep")


@dataclass
class IngestResult:
    source_id: str
    target: str
    ok: bool = False
    rows: int = 0
    blank_rows: int = 0
    types: dict = field(default_factory=dict)
    warnings: list = field(default_factory=list)
    version: str | None = None
    action: str = ""
    error: str | None = None


# --- I1 / I2: headers (metadata) -------------------------------------------------------------

def normalise_header(name) -> str:
    """The name's letters and digits in lower case, accents removed, ``[a-z0-9]`` only."""
    plain = unicodedata.normalize("NFKD", "" if name is None else str(name).lower())
    return "".join(re.findall("[a-z0-9]", plain))


def header_name(original, position: int) -> str:
    """Column name of a header cell: a name that normalises to empty becomes ``col_<n>`` (1-based
    position); ``id`` is reserved for the generated row id, so a source column ``id`` is ``src_id``."""
    name = normalise_header(original) or f"col_{position + 1}"
    return "src_id" if name == "id" else name


def dedupe_headers(raw: Sequence) -> tuple[list[str], list[int], list[str]]:
    """I2 + D19: column names, the kept column indexes (first occurrence wins) and warnings."""
    all_names = [header_name(original, i) for i, original in enumerate(raw)]
    first = {name: i for i, name in reversed(list(enumerate(all_names)))}
    kept = sorted(first.values())
    warnings = [f"duplicate column ignored after normalising: {raw[i]!r} -> {name!r}"
                for i, name in enumerate(all_names) if first[name] != i]
    return [all_names[i] for i in kept], kept, warnings


# --- S1 / S2 / H1: reading with exact positions ------------------------------------------------

MAX_BROADCAST_SPLITS = 100_000   # one offsets row per split (~100 bytes): at most ~10 MB broadcast


@dataclass
class SourceProfile:
    """Types and row counts of one source, from the per-split pass (no separate inference job)."""

    types: dict
    rows: int          # data rows (header lines excluded), blank rows included
    blank_rows: int    # data rows blank in every kept column
    splits: int
    intervals: DataFrame | None = None   # positions of each split, [first, end), and its rows
    sketch: DataFrame | None = None      # weighted sample of the layout keys' raw cells, under the columns' names


def _profile_aggs(n_cols: int, sampled: int = 0) -> list[Column]:
    """Per split: rows, first row id, and per kept column (projected class ``_k<i>``) the count of
    cells of class 2 (number with a separator) and 3 (text; see :func:`cell_class`) plus the class
    of the split's first row, so the header line (the first row of a file's first split) can be
    taken out of the counts afterwards. Three aggregates per column; the type rule needs no other
    counts. Written as SQL expressions: one call per expression however wide the sheet is."""
    row_max = f"greatest({', '.join(f'_k{i}' for i in range(n_cols))})" if n_cols > 1 else \
        ("_k0" if n_cols else "0")
    exprs = ["count(1) AS _n", "min(_mid) AS _first", "min_by(_line0, _mid) AS _line0"]
    for i in range(n_cols):
        exprs += [f"count_if(_k{i} = 2) AS _k{i}_2", f"count_if(_k{i} = 3) AS _k{i}_3", f"min_by(_k{i}, _mid) AS _h{i}"]
    exprs += [f"count_if({row_max} = 0) AS _blank", f"min_by({row_max}, _mid) AS _hblank"]
    if sampled:
        exprs.append(sample_sql("_mid", {f"_s{j}": f"_s{j}" for j in range(sampled)}, f"{row_max} > 0") + " AS _sample")
    return [F.expr(e) for e in exprs]


def _profile_of(blocks: DataFrame, names: Sequence[str]) -> SourceProfile:
    """Reduce the per-split table (small) to column types and row counts; header lines removed. A file
    whose first line is a header of other or reordered columns fails the load."""
    exprs = ["count(1) AS _splits", "sum(_n) AS _n", "count_if(_headed) AS _headers", "sum(_blank) AS _blank",
             "count_if(_headed AND _hblank = 0) AS _hblank", f"min(IF(_foreign, {FILE}, NULL)) AS _bad"]
    for i in range(len(names)):
        exprs += [f"sum(_k{i}_{v}) - count_if(_headed AND _h{i} = {v}) AS _k{i}_{v}" for v in (2, 3)]
    row = blocks.agg(*[F.expr(e) for e in exprs]).first()
    if row["_bad"] is not None:
        raise IngestError(f"{row['_bad']}: its header has other columns, or another order, than the first file's")
    types = {n: TEXT if row[f"_k{i}_3"] else REAL if row[f"_k{i}_2"] else INTEGER for i, n in enumerate(names)}
    rows = int(row["_n"] or 0) - int(row["_headers"] or 0)
    blank = int(row["_blank"] or 0) - int(row["_hblank"] or 0)
    return SourceProfile(types, rows, blank, int(row["_splits"]))


def _materialise_small(df: DataFrame) -> DataFrame:
    """Compute a small frame once for several later jobs. When the session names a checkpoint
    directory (the shared folder of the cluster) it is checkpointed there, cutting lineage; when
    none is named it is persisted instead (an executor loss recomputes the lost blocks from
    lineage), never written to a folder invented on one machine."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return df.checkpoint(eager=True)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept


def line_kind(blocks: DataFrame, header: Sequence, kept: Sequence[int] = (), numeric: Sequence[bool] = ()) -> DataFrame:
    """``blocks`` with ``_headed`` (the split begins with the header: its first line has the names of
    ``header`` in their order) and ``_foreign`` (its first line is another header). Any other first line is data: a part without a header.

    A first line that shares names with the header is another header on evidence only. For data speaks a number under a
    column whose other cells are numbers (``numeric``, by kept column), unless the number is itself a name. For a header speaks
    a text there, a name in its own place, or that all its cells are names. A value that only happens to be a column's
    name (``Lazer,2`` below ``categoria,lazer``) is data."""
    def names(cells: Column) -> Column:  # one rule for both sides of the comparison
        return F.transform(cells, lambda x: F.regexp_replace(fold(F.coalesce(x, F.lit(""))), "[^a-z0-9]", ""))
    known = names(F.array(*[F.lit(h).cast("string") for h in header]))
    read = names(F.col("_line0"))
    at_start = F.col("_block") == 0
    same = F.slice(read, 1, len(header)) == known
    shared = F.arrays_overlap(F.array_remove(read, ""), F.array_remove(known, ""))
    said = F.array_remove(read, "")
    all_names = F.size(F.array_except(said, known)) == 0
    in_place = F.exists(F.zip_with(read, known, lambda x, y: (x != "") & (x == y)), lambda x: F.coalesce(x, F.lit(False)))
    is_data, is_text = F.lit(False), F.lit(False)
    for i, (place, number) in enumerate(zip(kept, numeric)):
        if number:
            named = F.coalesce(F.array_contains(known, F.get(read, F.lit(place))), F.lit(False))
            is_data = is_data | (F.col(f"_h{i}").isin(1, 2) & ~named)
            is_text = is_text | (F.col(f"_h{i}") == 3)
    foreign = shared & ~is_data & (is_text | all_names | in_place)
    return blocks.withColumn("_headed", at_start & F.coalesce(same, F.lit(False))).withColumn(
        "_foreign", at_start & ~F.col("_headed") & F.coalesce(foreign, F.lit(False)))


def _numeric_columns(blocks: DataFrame, count: int) -> list[bool]:
    """Per kept column: whether no cell is text, first lines of files aside (they may be headers)."""
    if not count:
        return []
    row = blocks.agg(*[F.expr(f"sum(_k{i}_3) - count_if(_block = 0 AND _h{i} = 3) AS _t{i}") for i in range(count)]).first()
    return [not row[i] for i in range(count)]


def profile_splits(df: DataFrame, kept_cols: Sequence[str], names: Sequence[str], null_tokens: Sequence[str] = (),
                   header: Sequence = (), layout: Sequence[str] = ()) -> tuple[DataFrame, SourceProfile]:
    """Add ``_file``, ``_pos`` (0-based line within its file) and ``_header`` to a file-source DataFrame
    and profile it, reading the input once. ``layout``: names (of ``names``) whose cells are sketched.

    The per-split table (one row per input split) is materialised once (:func:`_materialise_small`)
    so the write pass reuses it instead of re-reading the input. The offsets are broadcast when
    the exact split count is at most ``MAX_BROADCAST_SPLITS``; beyond that the join is a shuffle
    keyed by (file, split), each split's rows going to one task. A row of a split that the profile did
    not see in the same place and size (the files were cut otherwise, or changed) fails the query: within
    :func:`ingest` the cuts are pinned, a caller of :func:`read_source` keeps them by :func:`pinned_splits`.
    """
    meta = df.select("*", F.col("_metadata.file_path").alias(FILE),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_mid"))
    line = F.array(*[F.col(c).cast("string") for c in df.columns if not c.startswith("_pad")])
    sketched = [n for n in names if n in layout]
    classes = meta.select(FILE, "_block", "_mid", F.when(F.col("_block") == 0, line).alias("_line0"),
                          *[F.expr(cell_class_sql(c, null_tokens)).alias(f"_k{i}") for i, c in enumerate(kept_cols)],
                          *[F.col(kept_cols[list(names).index(n)]).cast("string").alias(f"_s{j}") for j, n in enumerate(sketched)])
    blocks = _materialise_small(classes.groupBy(FILE, "_block").agg(*_profile_aggs(len(kept_cols), len(sketched))))
    places = [df.columns.index(c) for c in kept_cols]
    several = len(df.inputFiles()) > 1
    kinds = line_kind(blocks, header, places, _numeric_columns(blocks, len(kept_cols)) if several else ())
    profile = _profile_of(kinds, names)
    before = Window.partitionBy(FILE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kinds.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))) \
        .select(FILE, "_block", "_offset", "_first", "_n", "_headed")
    profile.intervals = offsets.select(FILE, F.col("_offset").alias("first"), (F.col("_offset") + F.col("_n")).alias("end"),
                                       F.col("_n").alias("n"))
    if sketched:
        profile.sketch = blocks.select(F.explode("_sample").alias("s")).select(
            F.col("s._w").alias("_w"), *[F.col(f"s._s{j}").alias(n) for j, n in enumerate(sketched)])
    if profile.splits <= MAX_BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    joined = meta.join(offsets, [FILE, "_block"], "left")
    inside = F.col("_mid") - F.col("_first")
    position = F.when((inside >= 0) & (inside < F.col("_n")), F.col("_offset") + inside).otherwise(
        F.raise_error(F.concat(F.lit("input splits differ from the profiled ones: "), F.col(FILE))).cast("long"))
    positioned = joined.withColumn(POS, position).withColumn(HEADER, F.col("_headed") & (F.col(POS) == 0)) \
        .drop("_block", "_mid", "_offset", "_first", "_n", "_headed")
    return positioned, profile


# --- I9: unique positions ---------------------------------------------------------------------

def position_intervals(rows: DataFrame) -> DataFrame:
    """The positions of each file of ``rows`` (``_file``, ``_pos``), as found: least, one past the greatest, and number.
    For sources without a per-split table; only the two metadata columns are read."""
    return rows.groupBy(FILE).agg(F.min(POS).alias("first"), (F.max(POS) + 1).alias("end"), F.count(F.lit(1)).alias("n"))


def interval_proof(intervals: DataFrame, name: Column | None = None) -> DataFrame:
    """One row that tells whether positions are unique and gapless, from intervals (``_file``, ``first``, ``end``, ``n``):
    ``rows``, ``repeated`` (rows in an interval that is covered twice or too short for its rows), ``missing`` (positions
    of no interval, or of one too long for its rows) and ``repeated_files`` (files less distinct ``name``). Where all but ``rows`` are 0, ids
    made of a file's name and the position cannot repeat: no id needs to be compared with another."""
    earlier = Window.partitionBy(FILE).orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(earlier), F.min("first").over(Window.partitionBy(FILE)))
    step = intervals.withColumn("_step", F.col("first") - reached)
    slack = F.col("end") - F.col("first") - F.col("n")
    named = F.col(FILE) if name is None else name
    return step.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.greatest(-F.col("_step"), F.lit(0)) + F.greatest(-slack, F.lit(0))), F.lit(0)).alias("repeated"),
        F.coalesce(F.sum(F.greatest(F.col("_step"), F.lit(0)) + F.greatest(slack, F.lit(0))), F.lit(0)).alias("missing"),
        (F.count_distinct(FILE) - F.count_distinct(named)).alias("repeated_files"))


def require_unique_positions(intervals: DataFrame, source: str, name: Column | None = None) -> int:
    """Fails unless :func:`interval_proof` holds; the number of rows."""
    proof = interval_proof(intervals, name).first()
    if proof["repeated"] or proof["missing"] or proof["repeated_files"]:
        raise IngestError(f"{source}: positions are not unique: {proof['repeated']} repeated, {proof['missing']} missing, "
                          f"{proof['repeated_files']} files of the same name")
    return int(proof["rows"])


def _one_file(spec: IngestSpec, df: DataFrame) -> None:
    """A source that is not declared as several files must be one: its ids do not name the file."""
    files = df.inputFiles()
    if len(files) > 1 and not spec.multi_file:
        raise IngestError(f"{spec.source_id}: {len(files)} files found; declare the source with multi_file=True")


@contextmanager
def pinned_splits(spark: SparkSession):
    """Cuts the input the same way in the profile and the write, though the number of cores may change
    in between: the settings that decide are fixed to their present values."""
    before = {c: spark.conf.get(c, None) for c in SPLIT_CONFS}
    try:
        if before[SPLIT_CONFS[2]] is None:
            spark.conf.set(SPLIT_CONFS[2], str(spark.sparkContext.defaultParallelism))
        yield
    finally:
        if before[SPLIT_CONFS[2]] is None:
            spark.conf.unset(SPLIT_CONFS[2])


def read_source(spark: SparkSession, spec: IngestSpec) -> tuple[DataFrame, list, SourceProfile | None]:
    """All-string rows with ``_file``/``_pos``, the raw header of the first file and, for CSV
    sources, the profile (types, row counts) computed in the same single pass as the positions."""
    if spec.fmt == "parquet":
        df = spark.read.parquet(spec.path)
        data = df.select([F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(df.columns)]
                         + [F.col("_metadata.file_path").alias(FILE),
                            (F.col("_metadata.row_index") + 1).alias(POS), F.lit(False).alias(HEADER)])
        _one_file(spec, df)
        return data, list(df.columns), None
    reader = spark.read.option("header", False).option("inferSchema", False).option("mode", "PERMISSIVE") \
        .option("multiLine", spec.multiline).option("enforceSchema", False)
    df = reader.csv(spec.path)
    files = sorted(df.inputFiles())
    if not files:
        return df, [], None
    _one_file(spec, df)
    first = reader.csv(files[0]).where(F.col("_metadata.file_block_start") == 0).limit(1).collect()
    header = list(first[0]) if first else []
    if not header:
        return df, [], None
    names, kept, _ = dedupe_headers(header)
    layout = {c.removesuffix("__key").removesuffix("__date") for c in (*spec.partition_by, *spec.cluster_by)}
    kept_cols = [df.columns[i] if i < len(df.columns) else None for i in kept]
    padded = df.select("*", *[F.lit(None).cast("string").alias(f"_pad{i}") for i, c in enumerate(kept_cols) if c is None])
    kept_cols = [c if c is not None else f"_pad{i}" for i, c in enumerate(kept_cols)]
    null_tokens = WORKBOOK_NULLS if spec.profile == "workbook" else ()
    positioned, profile = profile_splits(padded, kept_cols, names, null_tokens, header, sorted(layout))
    return positioned.drop(*[c for c in padded.columns if c.startswith("_pad")]), header, profile


def read_raw(spark: SparkSession, spec: IngestSpec) -> tuple[DataFrame, list]:
    """All-string rows with ``_file``/``_pos`` and the raw header of the first file."""
    raw, header, _ = read_source(spark, spec)
    return raw, header


# --- I4 / I6: inference (one aggregate) ------------------------------------------------------

def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _blank_sql(c: str, null_tokens: Sequence[str] = ()) -> str:
    """Blank cell: NULL, only spaces, or one of the profile's null tokens."""
    tokens = "".join(" OR {} = '{}'".format(c, t.replace("'", "''")) for t in null_tokens)
    return f"({c} IS NULL OR trim({c}) = ''{tokens})"


def cell_class_sql(name: str, null_tokens: Sequence[str] = ()) -> str:
    """0 blank, 1 number without separator, 2 number with ``.``/``,``, 3 anything else, as a SQL
    expression over the column ``name``.

    The column type is then ``max`` of the classes: 3 → TEXT, 2 → REAL, otherwise INTEGER
    (an all-blank column is INTEGER). One regex evaluation per cell. Stated once as SQL text so a
    sheet of any width costs one expression per column to plan.
    """
    c = _quoted(name)
    return (f"CASE WHEN {_blank_sql(c, null_tokens)} THEN 0 "
            f"WHEN NOT ({c} RLIKE r'{NUMBER_PATTERN}') THEN 3 "
            f"WHEN contains({c}, '.') OR contains({c}, ',') THEN 2 ELSE 1 END")


def cell_class(c: str, null_tokens: Sequence[str] = ()) -> Column:
    """Column form of :func:`cell_class_sql` for the column named ``c``."""
    return F.expr(cell_class_sql(c, null_tokens))


def _classified(df: DataFrame, columns: Sequence[str], null_tokens: Sequence[str]) -> DataFrame:
    return df.select(*[cell_class(c, null_tokens).alias(c) for c in columns])


def _class_aggs(columns: Sequence[str]) -> list[Column]:
    row_max = F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    return [F.max(c).alias(c) for c in columns] + \
        [F.count(F.lit(1)).alias("__rows"), F.count_if(row_max == 0).alias("__blank_raw")]


def _type_of(code) -> str:
    return TEXT if code == 3 else REAL if code == 2 else INTEGER


def infer_types(df: DataFrame, columns: Sequence[str], null_tokens: Sequence[str] = ()) -> tuple[dict, int, int]:
    """I4: TEXT if any non-blank value is not a number; else REAL if any has a separator; else
    INTEGER (also for an all-blank column). Returns (types, data rows, rows blank in the source).
    One aggregate job with a partial (map-side) aggregate: one small row per task is shuffled."""
    if not columns:
        n = df.count()
        return {}, n, n
    row = _classified(df, columns, null_tokens).agg(*_class_aggs(columns)).first()
    types = {c: _type_of(row[c]) for c in columns}
    return types, int(row["__rows"]), int(row["__blank_raw"] or 0)


def types_frame(df: DataFrame, columns: Sequence[str], null_tokens: Sequence[str] = ()) -> DataFrame:
    """I4 as a lazy DataFrame: one row per column (``position``, ``column``, ``type``)."""
    agg = _classified(df, columns, null_tokens).agg(*[F.max(c).alias(c) for c in columns])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                     F.when(F.col(c) == 3, F.lit(TEXT)).when(F.col(c) == 2, F.lit(REAL))
                     .otherwise(F.lit(INTEGER)).alias("type")) for i, c in enumerate(columns)]
    return agg.select(F.inline(F.array(*rows)))


def row_counts(df: DataFrame, columns: Sequence[str], null_tokens: Sequence[str] = ()) -> DataFrame:
    """I6 as a lazy frame: data rows, rows blank in every column (dropped at load) and rows kept,
    from the same per-cell classes as inference (one aggregate, partial per task)."""
    agg = _classified(df, columns, null_tokens).agg(*_class_aggs(columns))
    return agg.select(F.col("__rows").alias("data_rows"), F.col("__blank_raw").alias("blank_rows"),
                      (F.col("__rows") - F.col("__blank_raw")).alias("kept_rows"))


# --- I5 / I8: coercion ----------------------------------------------------------------------

def coerce_sql(name: str, type_: str, null_tokens: Sequence[str] = ()) -> str:
    """Trim; blank → NULL; decimal comma → dot; INTEGER truncates toward zero; failure → NULL.
    Text cells also get I8 (tab, CR, LF → space). A SQL expression over the column ``name``."""
    c = _quoted(name)
    value = f"CASE WHEN NOT {_blank_sql(c, null_tokens)} THEN trim({c}) END"
    if type_ == TEXT:
        return rf"regexp_replace({value}, r'[\t\r\n]', ' ')"
    as_double = f"try_cast(replace({value}, ',', '.') AS DOUBLE)"
    return as_double if type_ == REAL else f"try_cast({as_double} AS BIGINT)"


def coerce(name: str, type_: str, null_tokens: Sequence[str] = ()) -> Column:
    """Column form of :func:`coerce_sql`."""
    return F.expr(coerce_sql(name, type_, null_tokens))


def source_root(spark: SparkSession, path: str) -> str:
    """The fixed part of a source's path (up to its first wildcard, else the folder or the file's folder), as
    the files' URIs show it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fixed = path
    if (wild := re.search(r"[*?{\[]", path)) is not None:
        fixed = path[:wild.start()].rpartition("/")[0] or "."
    where = hadoop(fixed)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if wild is None and fs.exists(where) and not fs.getFileStatus(where).isDirectory():
        where = where.getParent()
    return re.sub(r"^file:/+", "file:///", fs.makeQualified(where).toUri().toString()).rstrip("/") + "/"


def file_name(root: str) -> Column:
    """The file's path below ``root``."""
    return F.replace(F.regexp_replace(FILE, "^file:/+", "file:///"), F.lit(root), F.lit(""))


def row_id(spec: IngestSpec, root: str = "") -> Column:
    """SHA-256 hex of ``<source>:<tab>:<line number>`` (sheets) or ``<source>:<index>`` (workbooks);
    the line counts blank rows too, so ids survive blank-row changes. A source declared as several files has
    the file's path below ``root`` in every id, so ids do not depend on how many files there are."""
    file = file_name(root)
    parts = [F.lit(spec.source_id)]
    if spec.profile == "workbook":
        parts += [file] if spec.multi_file else []
        parts.append((F.col(POS) - 1).cast("string"))
    else:
        parts.append(F.concat(F.lit(spec.tab + "/"), file) if spec.multi_file else F.lit(spec.tab))
        parts.append((F.col(POS) + 1).cast("string"))
    return F.sha2(F.concat_ws(":", *parts), 256)


def date_twin(c: Column) -> Column:
    """Typed twin of a text date: ``dd/MM/yyyy`` or ISO; unparsable → NULL."""
    text = F.trim(c)
    return F.coalesce(F.try_to_timestamp(text, F.lit("dd/MM/yyyy")).cast("date"),
                      F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


@dataclass
class Prepared:
    frame: DataFrame
    names: list[str]
    types: dict
    rows: int
    blank_rows: int
    warnings: list
    sketch: DataFrame | None = None   # weighted sample of the layout columns, typed like the frame


def _typed(source: DataFrame, names: Sequence[str], types: dict, null_tokens: Sequence[str], spec: IngestSpec,
           first: Sequence[Column] = ()) -> DataFrame:
    """``first``, the typed columns and their twins."""
    typed = source.select(*first, *[coerce(n, types[n], null_tokens).alias(n) for n in names])
    twins = {f"{n}__key": F.trim(fold(F.col(n))) for n in spec.key_columns if n in names}
    twins.update({f"{n}__date": date_twin(F.col(n)) for n in spec.date_columns if n in names})
    return typed.withColumns(twins) if twins else typed


def prepare(raw: DataFrame, header: Sequence, spec: IngestSpec, profile: SourceProfile | None = None) -> Prepared:
    """Typed, cleaned, id'd rows of one source (lazy frame + metadata). Types and counts come from
    ``profile`` when the read already computed them, else from one inference job."""
    names, kept, warnings = dedupe_headers(header)
    null_tokens = WORKBOOK_NULLS if spec.profile == "workbook" else ()
    raw_cols = [c for c in raw.columns if c not in (FILE, POS, HEADER)]
    is_data = ~F.col(HEADER) if HEADER in raw.columns else F.col(POS) >= 1
    source = raw.where(is_data).select(
        FILE, POS, *[(F.col(raw_cols[i]) if i < len(raw_cols) else F.lit(None).cast("string")).alias(n)
                     for n, i in zip(names, kept)])
    if profile is not None:
        types, rows, blank_rows = profile.types, profile.rows, profile.blank_rows
    else:
        types, rows, blank_rows = infer_types(source, names, null_tokens)
    root = source_root(raw.sparkSession, spec.path) if spec.multi_file else ""
    typed = _typed(source, names, types, null_tokens, spec, [row_id(spec, root).alias("id")])
    if names:  # I6: a row survives when any column holds a value
        typed = typed.where(" OR ".join(f"({_quoted(n)} IS NOT NULL AND CAST({_quoted(n)} AS STRING) <> '')"
                                        for n in names))
    else:
        typed = typed.where(F.lit(False))
    sketch = None
    if profile is not None and profile.sketch is not None:
        cells = [n for n in names if n in profile.sketch.columns]
        sketch = _typed(profile.sketch, cells, types, null_tokens, spec, [F.col("_w")])
    return Prepared(typed, names, types, rows, blank_rows, warnings, sketch)


# --- K1 / K2 / K4 / K5: publish ---------------------------------------------------------------

def _qualified(name: str, database: str | None) -> str:
    return f"{database}.{name}" if database else name


def versions(spark: SparkSession, target: str, database: str | None = None) -> list[str]:
    """Published versions of ``target`` (oldest first)."""
    pattern = re.compile(rf"^{re.escape(target)}__v(\d+)$")
    tables = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    found = [(int(m.group(1)), t.name) for t in tables if (m := pattern.match(t.name))]
    return [name for _, name in sorted(found)]


def require_unique(spark: SparkSession, table: str, key: str = "id") -> None:
    """Fails when a key occurs twice (one distributed aggregate of the key column): for tables without positions, whose
    ids :func:`interval_proof` cannot prove unique."""
    twice = spark.table(table).groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise IngestError(f"{table}: {key} {twice[0][0]!r} occurs {twice[0][1]} times")


def publish(spark: SparkSession, df: DataFrame, target: str, database: str | None = None,
            partition_by: Sequence[str] = (), expected_rows: int | None = None, keep: int = 2,
            cluster_by: Sequence[str] = (), unique: str | None = None, rows_per_file: int = ROWS_PER_FILE,
            sketch: DataFrame | None = None, predecessor: int | None = None, keep_seconds: float = 0) -> str:
    """Write ``df`` as a new version, check its count and the uniqueness of ``unique``, commit it to the target's
    :class:`VersionLog`, then point the ``target`` view at it.

    Readers of ``target`` see the old or the new version, never a partial one; on any failure
    the view keeps pointing at the previous version (the half-written version is dropped). ``predecessor``: the number of
    the log that this load started from (default: the last one now); where another load has been published since, this one
    fails. Versions beyond the newest ``keep`` are dropped once they have been superseded for ``keep_seconds`` and nobody holds a lease on them.
    With ``partition_by`` or ``cluster_by`` rows are dealt by ranges of those columns (:mod:`innsight.sources.layout`), about
    ``rows_per_file`` to a file, and sorted in each: a partition has few files whatever the number of input splits, and
    files and row groups cover narrow ranges, so min/max statistics skip them for filters on those
    columns (e.g. year, month and the folded resort key). ``df`` is evaluated once: with a ``sketch`` (weighted keys, from the
    profile pass) and ``expected_rows`` its rows go straight to their files; without, they are staged as they come, and the
    ranges are those of the staged keys.
    """
    log = VersionLog(spark, target, database)
    base = log.last_number() if predecessor is None else predecessor
    version = f"{target}__v{time.time_ns()}"
    qualified = _qualified(version, database)
    stage = f"{qualified}_stage"
    keys = [*partition_by, *[c for c in cluster_by if c not in partition_by]]
    try:
        if keys:
            rows = expected_rows
            if sketch is None or rows is None:
                df.write.format("parquet").mode("errorifexists").saveAsTable(stage)
                df = spark.table(stage)
                sketch, rows = df.select(*keys, F.lit(1.0).alias("_w")), df.count()
            df = layout_of(sketch, keys, rows, rows_per_file).deal(df)
        seen = Observation()
        if keys:  # least and greatest values, on the way to the files
            df = df.observe(seen, *[f(k).cast("string").alias(f"{n}_{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))])
        writer = df.write.format("parquet").mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.saveAsTable(qualified)
        written = spark.table(qualified).count()
        if expected_rows is not None and written != expected_rows:
            raise IngestError(f"{target}: wrote {written} rows, expected {expected_rows}")
        if unique:
            require_unique(spark, qualified, unique)
        values = dict(seen.get) if keys else {}
        twins = [c for c in df.columns if c.endswith("__key")]
        entry = log.commit(base, version, rows=written, partitions=_partition_values(spark, qualified, partition_by),
                           ranges={k: [values.get(f"lo_{i}"), values.get(f"hi_{i}")] for i, k in enumerate(keys)},
                           domains=domains_of(spark.table(qualified), twins))
        try:
            spark.sql(f"CREATE OR REPLACE VIEW {_qualified(target, database)} AS SELECT * FROM {qualified}")
        except Exception:
            log.revoke(entry)
            raise
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {qualified}")
        raise
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {stage}")
    retire(spark, target, database, keep, keep_seconds)
    return version


def _partition_values(spark: SparkSession, table: str, partition_by: Sequence[str]) -> dict[str, list[str]]:
    """The values of each partition column, from the list of partitions."""
    found: dict[str, set[str]] = {c: set() for c in partition_by}
    for row in spark.sql(f"SHOW PARTITIONS {table}").collect() if partition_by else ():
        for part in row[0].split("/"):
            name, value = part.split("=", 1)
            found[name].add(unquote(value))
    return {c: sorted(v) for c, v in found.items()}


def retire(spark: SparkSession, target: str, database: str | None = None, keep: int = 2, keep_seconds: float = 0) -> list[str]:
    """Drops the versions that are older than the newest ``keep``, superseded for ``keep_seconds`` and not leased."""
    log, dropped = VersionLog(spark, target, database), []
    leased, superseded = log.leased(), log.superseded()
    for old in versions(spark, target, database)[:-keep]:
        if old not in leased and time.time() - superseded.get(old, 0) >= keep_seconds:
            spark.sql(f"DROP TABLE IF EXISTS {_qualified(old, database)}")
            dropped.append(old)
    return dropped


def drop_target(spark: SparkSession, target: str, database: str | None = None) -> None:
    spark.sql(f"DROP VIEW IF EXISTS {_qualified(target, database)}")


def ingest(spark: SparkSession, spec: IngestSpec) -> IngestResult:
    """Load one source end to end; never raises (the error is in the result)."""
    with pinned_splits(spark):
        return _ingest(spark, spec)


def _ingest(spark: SparkSession, spec: IngestSpec) -> IngestResult:
    result = IngestResult(spec.source_id, spec.target)
    try:
        predecessor = VersionLog(spark, spec.target, spec.database).last_number()
        raw, header, profile = read_source(spark, spec)
        if not header:
            result.action = "dropped" if spec.empty_action == "drop" else "kept"
            if spec.empty_action == "drop":
                drop_target(spark, spec.target, spec.database)
            result.ok = True
            return result
        prep = prepare(raw, header, spec, profile)
        result.types, result.warnings = prep.types, prep.warnings
        result.blank_rows = prep.blank_rows
        result.rows = prep.rows - prep.blank_rows
        if prep.rows == 0 or (result.rows == 0 and spec.profile == "workbook"):
            result.action = "dropped" if spec.empty_action == "drop" and prep.rows == 0 else "kept"
            if result.action == "dropped":
                drop_target(spark, spec.target, spec.database)
            result.ok = True
            return result
        name = file_name(source_root(spark, spec.path)) if spec.multi_file else None
        require_unique_positions(profile.intervals if profile is not None else position_intervals(raw), spec.source_id, name)
        cluster = [c for c in spec.cluster_by if c in prep.frame.columns]
        whole = prep.sketch is not None and {*spec.partition_by, *cluster} <= set(prep.sketch.columns)
        result.version = publish(spark, prep.frame, spec.target, spec.database, spec.partition_by, expected_rows=result.rows,
                                 cluster_by=cluster, sketch=prep.sketch if whole else None, predecessor=predecessor,
                                 keep=spec.keep_versions, keep_seconds=spec.keep_seconds)
        result.action, result.ok = "published", True
    except Exception as exc:  # one failing source must not stop the catalogue (S6)
        result.error = f"{type(exc).__name__}: {exc}"
    return result


def ingest_all(spark: SparkSession, specs: Iterable[IngestSpec], max_workers: int = 1) -> list[IngestResult]:
    """Load every source; failures are reported per source. ``max_workers > 1`` loads
    several at a time: each source's jobs run in a scheduler pool of its own (fair shares with ``spark.scheduler.mode=FAIR``, as
    :func:`innsight.session.build_session` sets it) under a tag of its own, by which what a failed source left running is cancelled
    while the others go on."""
    specs = list(specs)
    with pinned_splits(spark):
        if max_workers <= 1:
            return [ingest(spark, s) for s in specs]
        with ThreadPoolExecutor(max_workers=max_workers) as pool:  # each load with its own copy of the local properties
            return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(_isolated), spark, s) for s in specs]]


def _isolated(spark: SparkSession, spec: IngestSpec) -> IngestResult:
    """:func:`ingest` in the source's own pool and under its own tag; the thread is left as it was found."""
    name = "ingest-" + re.sub("[^A-Za-z0-9_-]", "-", spec.source_id)
    ctx = spark.sparkContext
    ctx.setLocalProperty("spark.scheduler.pool", name)
    ctx.addJobTag(name)
    try:
        result = ingest(spark, spec)
        if not result.ok:
            ctx.cancelJobsWithTag(name)
        return result
    finally:
        ctx.removeJobTag(name)
        ctx.setLocalProperty("spark.scheduler.pool", None)


def table_exists(spark: SparkSession, name: str, database: str | None = None) -> bool:
    """S5."""
    return spark.catalog.tableExists(_qualified(name, database))
