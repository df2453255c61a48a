"""The pipeline's stages, each against a brute-force version on its own input."""

import public_tokenizers as P
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from innsight.llm import quality, secret_scan
from tests_llm_helpers import brute_classes, check_cover

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        out.append(docs)
        if name != "packing":
            assert docs.columns == columns
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    scored, _ = quality.score(raw)
    kept = {r["doc_id"]: r for r in scored.filter("kept").collect()}
    assert {r["doc_id"]: r["text"] for r in out[0].collect()} == {d: r["text"] for d, r in kept.items()}

    rows = [(r["doc_id"], r["text"]) for r in out[0].collect()]
    least = {d: x for (d, _), x in zip(rows, brute_classes(rows).values())}
    texts = dict(rows)
    assert sorted((r["doc_id"], r["text"]) for r in out[1].collect()) == sorted((d, texts[d]) for d in set(least.values()))

    scanner = secret_scan.Scanner(secret_scan.RULES)
    import pyarrow as pa
    before = {r["doc_id"]: r for r in out[1].collect()}
    changed = 0
    for r in out[2].collect():
        b = before.pop(r["doc_id"])
        _, (spans,) = scanner.spans(pa.array([b["text"]]))
        changed += bool(spans)
        assert r["text"] == (secret_scan.redact_text(b["text"], spans, "<secret>") if spans else b["text"])
        assert r["n_chars"] == (len(r["text"]) if spans else b["n_chars"]) and r["source"] == b["source"]
    assert not before and changed

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    check_cover(out[3].collect(), [(r["doc_id"], r["text"]) for r in out[2].collect()], tok, ids=False)


def test_registered(spark):
    assert __spark_entry__.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "packing"]


def test_results_of_operators_survive_a_pipeline_run(spark):
    """A lazy result taken before the run reads its tables after it; the run leaves only its own result."""
    import os
    from innsight.llm import common
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scored, _ = quality.score(docs)
    stage = corpus_pipeline.STAGES[0][1](spark, docs, "/root/testdata/sf0.001")
    before = set(os.listdir(common.checkpoint_dir(spark)))
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert packed.count() > 0 and scored.count() == docs.count() and 0 < stage.count() < docs.count()
    new = set(os.listdir(common.checkpoint_dir(spark))) - before
    assert [x.split("-")[2] for x in new if x.startswith("innsight-pipeline")] == ["packing"] and len(new) == 1


def test_a_cluster_must_name_the_shared_folder():
    import pytest
    from types import SimpleNamespace
    from innsight.llm import common

    def session(master):
        ctx = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None)
        return SimpleNamespace(sparkContext=ctx, conf={})
    assert common.checkpoint_dir(session("local[4]"))
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.checkpoint_dir(session(master))


def test_other_queries_do_not_need_the_tokenizers():
    import subprocess
    import sys
    code = ("import sys; sys.modules['public_tokenizers'] = None\n"
            "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) >= 80, out.stderr[-500:]
