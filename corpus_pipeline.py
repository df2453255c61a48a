"""The corpus pipeline over ``documents``: quality rules, near-duplicate removal, secret masking, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``; the last returns one row per packed piece.

Tables that only serve a stage's result go when the next stage of the same chain begins, since the result has been written then.
No other tables are touched: results taken from the operators, or of another run, stay readable.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from innsight.llm import minhash, packing, quality, secret_scan  # noqa: E402
from innsight.llm.common import delete, owned, stored, table  # noqa: E402

_CHAINS: list[tuple[tuple, int, list[str]]] = []  # (session and input, stage, folders of the stage's tables)


def _stage(number: int, function):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        for chain in reversed(_CHAINS):  # the latest chain over this input that waits for this stage
            if chain[:2] == (key, number - 1):
                delete(spark, chain[2])
                _CHAINS.remove(chain)
                break
        with owned() as paths:
            result = function(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            _CHAINS.append((key, number, paths))
        return result
    return run_stage


STAGES = [
    ("quality", quality.filter_stage),        # documents that the label model or the base rules reject go
    ("near_duplicates", minhash.dedup_stage),  # one document of each class stays
    ("secrets", secret_scan.redact_stage),    # secrets are masked, all documents stay
    ("packing", packing.pack_stage),          # the kept documents as pieces of token sequences
]
_PLAIN = [function for _, function in STAGES]
STAGES = [(name, _stage(i, function)) for i, (name, function) in enumerate(STAGES)]

# No SQL expresses the label model, the tokenizer or the packing schedule; tests/llm/test_pipeline.py
# compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; only their table is left of the run."""
    docs, before = table(spark, sf_dir, "documents"), []
    for (name, _), function in zip(STAGES, _PLAIN):
        with owned() as paths:
            made = function(spark, docs, sf_dir)
        with owned() as written:
            docs = stored(made, f"pipeline-{name}")
        delete(spark, paths + before)
        before = written
    return docs
