"""Small helpers shared by the operators: input reading, column projection, shared work folders."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets one of its machine; a
    cluster's tasks would each write to their own disk, so there it is an error."""
    ctx = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or ctx.getConf().get("spark.checkpoint.dir") or ctx.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", ctx.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="innsight-checkpoints-")
    if not ctx.getCheckpointDir():
        ctx.setCheckpointDir(named)
    return named


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table, below the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"innsight-{name}-{uuid.uuid4().hex}")


_OWNER: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def owned() -> Iterator[list[str]]:
    """The folders of the tables that are stored inside this block. They belong to its caller, who may :func:`delete` them
    once every result that reads them has been written; tables stored outside such a block stay."""
    paths: list[str] = []
    token = _OWNER.set(paths)
    try:
        yield paths
    finally:
        _OWNER.reset(token)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts the lineage with a
    table that outlives any executor."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if (paths := _OWNER.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes the folders; the list is empty then."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: where neither PYTHONPATH nor the working folder has it, a zip of
    its sources goes along with the application's files (once)."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, application = os.path.dirname(package), spark.sparkContext.applicationId
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root or application in _SHIPPED:
        return
    _SHIPPED.add(application)
    archive = os.path.join(tempfile.mkdtemp(prefix="innsight-"), "innsight.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)


def map_in_arrow(df: DataFrame, function, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` in total size (a larger single row stands alone)."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def with_arrow(df: DataFrame, source: str, out: list[T.StructField],
               per_slice: Callable[[pa.Array], list[pa.Array]], slice_bytes: int) -> DataFrame:
    """The other columns of ``df`` and the columns ``out`` that ``per_slice`` makes of the values of
    ``source`` (string or binary), by slices of about ``slice_bytes``. No rows are added or lost; a
    column named like one of ``out`` is replaced; any column name may come in."""
    made = {f.name.lower() for f in out} | {source.lower()}
    keep = [f for f in df.schema.fields if f.name.lower() not in made]
    n = len(keep)
    names = [f"c{i}" for i in range(n + len(out))]  # safe in every name lookup

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(n)
            for a, b in slices(pc.fill_null(pc.binary_length(values), 0).to_pylist(), slice_bytes):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(n)), *per_slice(values.slice(a, b - a))],
                    names=names)

    plain = df.select(*[quoted(f.name).alias(c) for f, c in zip(keep, names)], quoted(source).alias("source"))
    schema = T.StructType([T.StructField(c, f.dataType) for f, c in zip([*keep, *out], names)])
    return map_in_arrow(plain, run, schema).toDF(*[f.name for f in [*keep, *out]])
