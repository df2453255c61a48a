import csv
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from innsight.sources import ingest as ing
from innsight.sources.ingest import IngestSpec


def write_csv(folder, name, lines):
    path = os.path.join(folder, name)
    with open(path, "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerows(lines)
    return path


def test_dirty_headers():
    names, kept, warnings = ing.dedupe_headers([" Hotel ", "Mês", "Mes", "Receita Extra (R$)", "", "id"])
    assert names == ["hotel", "mes", "receitaextrar", "col_5", "src_id"]
    assert kept == [0, 1, 3, 4, 5] and len(warnings) == 1


def test_type_inference_and_coercion(spark, scratch):
    header = ["ints", "dec", "thousands", "blank", "trail", "signed", "expo", "gaps"]
    lines = [header,
             ["1", "1,5", "1.234,56", "", "12.", " -3 ", "1e5", "4"],
             ["2", "2", "7", " ", "3", "+4", "2", ""],
             ["30", "0.25", "8", "", "1", "5", "3", "6"]]
    spec = IngestSpec("sheet-1", "t_types", write_csv(scratch, "types.csv", lines))
    raw, head = ing.read_raw(spark, spec)
    prep = ing.prepare(raw, head, spec)
    assert prep.types == {"ints": "INTEGER", "dec": "REAL", "thousands": "TEXT", "blank": "INTEGER",
                          "trail": "REAL", "signed": "INTEGER", "expo": "TEXT", "gaps": "INTEGER"}
    got = sorted((r.ints, r.dec, r.thousands, r.blank, r.trail, r.signed, r.expo, r.gaps) for r in prep.frame.collect())
    assert got == [(1, 1.5, "1.234,56", None, 12.0, -3, "1e5", 4), (2, 2.0, "7", None, 3.0, 4, "2", None),
                   (30, 0.25, "8", None, 1.0, 5, "3", 6)]
    assert dict(prep.frame.dtypes)["ints"] == "bigint" and dict(prep.frame.dtypes)["dec"] == "double"


def test_ragged_and_blank_rows_keep_positions_in_ids(spark, scratch):
    lines = [["a", "b", "c"], ["", "", ""], ["1", "x"], ["", " ", ""], ["2", "y", "z", "extra"], ["", "", ""]]
    spec = IngestSpec("sheet-9", "t_blank", write_csv(scratch, "blank.csv", lines), tab="Aba 1")
    raw, head = ing.read_raw(spark, spec)
    prep = ing.prepare(raw, head, spec)
    assert prep.rows == 5 and prep.blank_rows == 3
    got = sorted((r.a, r.b, r.c, r.id) for r in prep.frame.collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    # spreadsheet rows: header = 1, first blank = 2, so "1,x" is row 3 and "2,y,z" row 5
    assert got == [(1, "x", None, sha("sheet-9:Aba 1:3")), (2, "y", "z", sha("sheet-9:Aba 1:5"))]


def test_cells_with_tabs_and_line_breaks(spark, scratch):
    lines = [["texto", "n"], ["a\tb", "1"], ["linha1\nlinha2", "2"], ["c\r\nd", "3"], ["bar\\ra", "4"]]
    spec = IngestSpec("s", "t_cells", write_csv(scratch, "cells.csv", lines), multiline=True)
    raw, head = ing.read_raw(spark, spec)
    got = sorted((r.n, r.texto) for r in ing.prepare(raw, head, spec).frame.collect())
    # the CSV reader already turns a CRLF inside a quoted cell into one line break
    assert got == [(1, "a b"), (2, "linha1 linha2"), (3, "c d"), (4, "bar\\ra")]


def test_positions_exact_across_many_splits_and_ids_stable(spark, scratch):
    n = 30000
    lines = [["line", "valor"]] + [[str(i + 1), f"{i % 97},{i % 10}"] for i in range(n)]
    path = write_csv(scratch, "big.csv", lines)
    spec = IngestSpec("big", "t_big", path)
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        raw, head = ing.read_raw(spark, spec)
        assert raw.rdd.getNumPartitions() > 3
        bad = raw.where(F.col(ing.POS) >= 1).where(F.col("_c0").cast("long") != F.col(ing.POS)).count()
        assert bad == 0
        ids_small = ing.prepare(raw, head, spec).frame.select("id", "line").persist()
        assert ids_small.count() == n  # read under the profiled split size
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
        raw2, head2 = ing.read_raw(spark, spec)
        ids_big = ing.prepare(raw2, head2, spec).frame.select("id", "line")
        assert ids_small.join(ids_big, ["id", "line"]).count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)


def test_workbook_null_tokens_are_blank(spark, scratch):
    lines = [["qtd", "nome", "quando"], ["1", "nan", "NaT"], ["nan", "Ana", "2024-01-02"], ["3", "Bia", "nan"]]
    spec = IngestSpec("wb", "t_wb", write_csv(scratch, "wb.csv", lines), profile="workbook", date_columns=("quando",))
    raw, head = ing.read_raw(spark, spec)
    prep = ing.prepare(raw, head, spec)
    assert prep.types["qtd"] == "INTEGER"
    got = sorted((r.qtd or 0, r.nome, str(r.quando__date)) for r in prep.frame.collect())
    assert got == [(0, "Ana", "2024-01-02"), (1, None, "None"), (3, "Bia", "None")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {r.id for r in prep.frame.collect()} == {sha("wb:0"), sha("wb:1"), sha("wb:2")}


def test_publish_swaps_view_keeps_two_versions_and_rolls_back(spark, scratch):
    path = write_csv(scratch, "occ.csv", [["Resort", "Data", "Hosp Total"], ["Resort Alpha", "01/02/2024", "10"],
                                          ["resort_béta", "2024-02-03", "7"]])
    spec = IngestSpec("occ", "pub_occupancy", path, key_columns=("resort",), date_columns=("data",))
    first = ing.ingest(spark, spec)
    assert first.ok and first.action == "published" and first.rows == 2, first.error
    second = ing.ingest(spark, spec)
    third = ing.ingest(spark, spec)
    assert third.ok and len(ing.versions(spark, "pub_occupancy")) == 2
    view = spark.table("pub_occupancy")
    assert sorted(r.resort__key for r in view.collect()) == ["resort alpha", "resort_beta"]
    assert sorted(str(r.data__date) for r in view.collect()) == ["2024-02-01", "2024-02-03"]
    # a failed load leaves the published view on the last good version
    bad = ing.prepare(*ing.read_raw(spark, spec), spec).frame
    with pytest.raises(ing.IngestError):
        ing.publish(spark, bad, "pub_occupancy", expected_rows=99)
    assert ing.versions(spark, "pub_occupancy")[-1] == third.version
    assert spark.table("pub_occupancy").count() == 2
    assert second.version in ing.versions(spark, "pub_occupancy")


def test_empty_sources(spark, scratch):
    path = write_csv(scratch, "full.csv", [["a"], ["1"]])
    assert ing.ingest(spark, IngestSpec("e", "pub_empty", path)).action == "published"
    header_only = write_csv(scratch, "header.csv", [["a"]])
    res = ing.ingest(spark, IngestSpec("e", "pub_empty", header_only))
    assert res.ok and res.action == "dropped" and not spark.catalog.tableExists("pub_empty")
    ing.ingest(spark, IngestSpec("e", "pub_keep", path, profile="workbook"))
    res = ing.ingest(spark, IngestSpec("e", "pub_keep", header_only, profile="workbook"))
    assert res.action == "kept" and spark.table("pub_keep").count() == 1
    blanks = write_csv(scratch, "blanks.csv", [["a"], [""], [" "]])
    res = ing.ingest(spark, IngestSpec("e", "pub_blank", blanks))
    assert res.action == "published" and spark.table("pub_blank").count() == 0


def test_catalogue_continues_after_a_failure(spark, scratch):
    good = write_csv(scratch, "good.csv", [["x"], ["1"]])
    results = ing.ingest_all(spark, [IngestSpec("bad", "pub_bad", os.path.join(scratch, "missing.csv")),
                                     IngestSpec("good", "pub_good", good)])
    assert [r.ok for r in results] == [False, True] and results[0].error


def test_publish_clusters_rows_for_min_max_skipping(spark, scratch):
    rows = [["Resort", "Mes", "Hosp"]] + [[f"Resort_{'ZYXWV'[i % 5]}", str(12 - i % 12), str(i)] for i in range(60)]
    path = write_csv(scratch, "clustered.csv", rows)
    spec = IngestSpec("clu", "pub_clustered", path, key_columns=("resort",), cluster_by=("resort__key", "mes"))
    res = ing.ingest(spark, spec)
    assert res.ok and res.rows == 60, res.error
    stored = [(r.resort__key, r.mes) for r in spark.table("pub_clustered").collect()]  # one file, file order
    assert stored == sorted(stored)
    plan = spark.table("pub_clustered").where("resort__key = 'resort_x'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(resort__key,resort_x)" in plan


@pytest.mark.parametrize("lines,kw", [
    ([["ints", "dec", "thousands", "blank", "trail", "expo"], ["1", "1,5", "1.234,56", "", "12.", "1e5"],
      ["2", "2", "7", " ", "3", "2"]], {}),
    ([["a", "b", "c"], ["", "", ""], ["1", "x"], ["", " ", ""], ["2", "y", "z", "extra"], ["", "", ""]], {}),
    ([["a", "A", "b"], ["1", "x", ""], ["", "", ""]], {}),
    ([["qtd", "nome"], ["1", "nan"], ["nan", "Ana"], ["NaT", "nan"]], {"profile": "workbook"}),
    ([["n", "v"]], {}),
])
def test_single_pass_profile_equals_inference_job(spark, scratch, lines, kw):
    spec = IngestSpec("p", "t_profile", write_csv(scratch, "p.csv", lines), **kw)
    raw, head, profile = ing.read_source(spark, spec)
    by_job = ing.prepare(raw, head, spec)
    assert (profile.types, profile.rows, profile.blank_rows) == (by_job.types, by_job.rows, by_job.blank_rows)


def test_single_pass_profile_across_splits_and_files(spark, scratch):
    folder = os.path.join(scratch, "many")
    os.makedirs(folder)
    for k in range(3):
        rows = [["line", "valor", "texto"]] + [[str(i), f"{i % 7},5" if k == 1 else str(i % 7), "" if i % 5 else "t"]
                                               for i in range(4000 * (k + 1))] + [["", "", ""]]
        write_csv(folder, f"part{k}.csv", rows)
    spec = IngestSpec("m", "t_many", folder, multi_file=True)
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        raw, head, profile = ing.read_source(spark, spec)
        assert profile.splits > 3
        by_job = ing.prepare(raw, head, spec)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
    assert profile.types == by_job.types == {"line": "INTEGER", "valor": "REAL", "texto": "TEXT"}
    assert (profile.rows, profile.blank_rows) == (by_job.rows, by_job.blank_rows) == (24003, 3)


def test_wide_sheet_profile(spark, scratch):
    width = 120
    lines = [[f"coluna {j}" for j in range(width)]] + \
        [[("" if (i + j) % 9 == 0 else str(i * j) if j % 3 else f"{i},{j}" if j % 2 else f"t{i}") for j in range(width)]
         for i in range(40)]
    spec = IngestSpec("w", "t_wide", write_csv(scratch, "wide.csv", lines))
    raw, head, profile = ing.read_source(spark, spec)
    by_job = ing.prepare(raw, head, spec)
    assert len(profile.types) == width and profile.types == by_job.types
    assert (profile.rows, profile.blank_rows) == (by_job.rows, by_job.blank_rows) == (40, 0)


def test_profile_without_a_named_checkpoint_dir_persists(spark, scratch, monkeypatch):
    conf_type = type(spark.conf)
    real_get = conf_type.get
    monkeypatch.setattr(conf_type, "get", lambda self, key, *a: None if key == "spark.checkpoint.dir"
                        else real_get(self, key, *a))
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: None)
    small = spark.range(5)
    kept = ing._materialise_small(small)
    assert kept.storageLevel.useDisk and kept.count() == 5
    kept.unpersist()
    path = write_csv(scratch, "nockpt.csv", [["a", "b"], ["1", "x"], ["", ""], ["2,5", "y"]])
    raw, head, profile = ing.read_source(spark, IngestSpec("s", "t_nockpt", path))
    assert (profile.types, profile.rows, profile.blank_rows) == ({"a": "REAL", "b": "TEXT"}, 3, 1)


def _rows_read_by_scan(df):
    """Rows the Parquet scan returned (after row-group skipping) for an executed query."""
    df.collect()

    def walk(plan):
        total = 0
        if plan.nodeName().startswith("Scan parquet") and plan.metrics().contains("numOutputRows"):
            total += plan.metrics().apply("numOutputRows").value()
        children = plan.children().iterator()
        while children.hasNext():
            total += walk(children.next())
        if plan.nodeName() == "AdaptiveSparkPlan":
            total += walk(plan.executedPlan())
        return total
    return walk(df._jdf.queryExecution().executedPlan())


def test_clustered_publish_lets_parquet_skip_row_groups(spark):
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    previous = hadoop.get("parquet.block.size")
    hadoop.set("parquet.block.size", str(256 * 1024))  # several row groups in one small file
    try:
        df = spark.range(200000).select((F.col("id") % 50).cast("string").alias("k"), F.col("id").alias("v"),
                                        F.sha2(F.col("id").cast("string"), 256).alias("pad")).coalesce(1)
        ing.publish(spark, df, "rg_plain")
        ing.publish(spark, df, "rg_clustered", cluster_by=["k"])
        plain = _rows_read_by_scan(spark.table("rg_plain").where(F.col("k") == "7"))
        clustered = _rows_read_by_scan(spark.table("rg_clustered").where(F.col("k") == "7"))
    finally:
        if previous is None:
            hadoop.unset("parquet.block.size")
        else:
            hadoop.set("parquet.block.size", previous)
    assert plain == 200000 and clustered < plain / 10


def test_offsets_broadcast_only_within_the_split_bound(spark, scratch, monkeypatch):
    path = write_csv(scratch, "bound.csv", [["a", "b"]] + [[str(i), "x"] for i in range(100)])
    spec = IngestSpec("b", "t_bound", path)
    raw, _, profile = ing.read_source(spark, spec)
    assert profile.splits == 1
    hint = "strategy=broadcast"
    assert hint in raw._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(ing, "MAX_BROADCAST_SPLITS", 0)
    raw2, _, _ = ing.read_source(spark, spec)
    # beyond the bound no broadcast is forced; Spark's own size threshold decides the strategy
    assert hint not in raw2._jdf.queryExecution().analyzed().toString()
    assert sorted(r[ing.POS] for r in raw2.collect()) == list(range(101))


# --- several files -----------------------------------------------------------------------------

def ids_of(spark, spec):
    raw, head, profile = ing.read_source(spark, spec)
    return [tuple(r) for r in ing.prepare(raw, head, spec, profile).frame.collect()]


def test_ids_of_several_parquet_files_are_distinct(spark, scratch):
    path = f"{scratch}/four"
    spark.range(100).selectExpr("CAST(id AS STRING) AS n", "'x' AS t").repartition(4).write.parquet(path)
    spec = IngestSpec("pq", "pub_pq", path, fmt="parquet", multi_file=True)
    res = ing.ingest(spark, spec)
    assert res.ok and res.rows == 100, res.error
    assert spark.table("pub_pq").select("id").distinct().count() == 100
    undeclared = ing.ingest(spark, IngestSpec("pq", "pub_pq2", path, fmt="parquet"))
    assert not undeclared.ok and "multi_file" in undeclared.error


@pytest.mark.parametrize("profile", ["sheet", "workbook"])
def test_ids_name_the_file_below_the_root(spark, scratch, profile):
    for sub in ("north", "south side"):
        os.makedirs(f"{scratch}/{sub}")
        write_csv(f"{scratch}/{sub}", "data.csv", [["a", "b"], ["1", sub], ["2", sub]])
    spec = IngestSpec("f", "t_folders", f"{scratch}/*/data.csv", multi_file=True, profile=profile)
    rows = ids_of(spark, spec)
    assert len({r[0] for r in rows}) == len(rows) == 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = "f:Sheet1/north/data.csv:2" if profile == "sheet" else "f:north/data.csv:0"
    assert sha(want) in {r[0] for r in rows}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_ids_survive_a_second_file(spark, scratch, fmt):
    folder = f"{scratch}/grow"
    os.makedirs(folder)
    df = spark.createDataFrame([("1", "x"), ("2", "y")], "a string, b string").coalesce(1)

    def add():
        before = set(os.listdir(folder))
        if fmt == "csv":
            write_csv(folder, f"{len(before)}.csv", [["a", "b"], ["1", "x"], ["2", "y"]])
        else:
            df.write.mode("append").parquet(folder)
    spec = IngestSpec("g", "t_grow", folder, fmt=fmt, multi_file=True)
    add()
    one = {r[0] for r in ids_of(spark, spec)}
    add()
    two = [r[0] for r in ids_of(spark, spec)]
    assert len(one) == 2 and len(set(two)) == len(two) == 4 and one < set(two)


def test_repeated_ids_are_not_published(spark):
    df = spark.range(10).selectExpr("CAST(id % 9 AS STRING) AS id", "id AS v")
    with pytest.raises(ing.IngestError, match="occurs 2 times"):
        ing.publish(spark, df, "pub_twice", unique="id")
    assert not spark.catalog.tableExists("pub_twice") and not ing.versions(spark, "pub_twice")


def test_part_without_a_header_keeps_its_first_row(spark, scratch):
    write_csv(scratch, "1.csv", [["N\u00ba", "Valor"], ["1", "x"], ["2", "y"]])
    write_csv(scratch, "2.csv", [["3", "z"], ["4", "w"]])
    spec = IngestSpec("h", "pub_parts", scratch, multi_file=True)
    res = ing.ingest(spark, spec)
    assert res.ok and res.rows == 4, res.error
    assert sorted((r[1], r.valor) for r in spark.table("pub_parts").collect()) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]
    assert res.types == {"no": "INTEGER", "valor": "TEXT"}


@pytest.mark.parametrize("second", [["b", "a"], ["a", "c"], ["A", "id"]])
def test_other_header_fails_the_load(spark, scratch, second):
    write_csv(scratch, "1.csv", [["a", "b"], ["1", "x"]])
    write_csv(scratch, "2.csv", [second, ["2", "y"]])
    res = ing.ingest(spark, IngestSpec("h", "pub_foreign", scratch, multi_file=True))
    assert not res.ok and "2.csv" in res.error and not spark.catalog.tableExists("pub_foreign")


def test_same_header_in_another_spelling_is_the_header(spark, scratch):
    write_csv(scratch, "1.csv", [["M\u00eas", "Valor", "", "id"], ["1", "x", "p", "q"]])
    write_csv(scratch, "2.csv", [[" mes ", "VALOR", "", "ID"], ["2", "y", "p", "q"]])
    res = ing.ingest(spark, IngestSpec("h", "pub_spelling", scratch, multi_file=True))
    assert res.ok and res.rows == 2, res.error


def test_changed_splits_fail_in_the_frame(spark, scratch):
    path = write_csv(scratch, "split.csv", [["line", "v"]] + [[str(i), "x" * 20] for i in range(20000)])
    spec = IngestSpec("s", "t_split", path)
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for profiled, read in (("65536", "134217728"), ("134217728", "65536"), ("65536", "50000")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", profiled)
            raw, head, profile = ing.read_source(spark, spec)
            spark.conf.set("spark.sql.files.maxPartitionBytes", read)
            with pytest.raises(Exception, match="splits differ"):
                ing.prepare(raw, head, spec, profile).frame.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)


def test_splits_do_not_depend_on_the_cores(spark):
    with ing.pinned_splits(spark):
        assert spark.conf.get("spark.sql.files.minPartitionNum") == str(spark.sparkContext.defaultParallelism)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_partitioned_publish_has_few_files_and_skips_them(spark):
    """At the default Parquet block size: files stay few though many tasks hold rows of every year, and a filter
    on the clustered column reads a small part of the row groups."""
    n = 200_000
    df = spark.range(n, numPartitions=16).selectExpr(
        "CAST(2020 + id % 7 AS BIGINT) AS ano", "concat('k', lpad(CAST(pmod(xxhash64(id), 100) AS STRING), 2, '0')) AS k", "id AS v")
    ing.publish(spark, df, "pub_layout", partition_by=["ano"], cluster_by=["k"], expected_rows=n, rows_per_file=5000)
    table = spark.table("pub_layout")
    files = len(table.inputFiles())
    assert files <= n // 5000 + 7 * 2
    assert _rows_read_by_scan(table.where("k = 'k42'")) < n / 5
    assert table.count() == n
    hot = spark.range(50_000, numPartitions=4).selectExpr("1L AS ano", "'one' AS k", "id AS v")
    ing.publish(spark, hot, "pub_hot", partition_by=["ano"], cluster_by=["k"], expected_rows=50_000, rows_per_file=5000)
    sizes = [r[0] for r in spark.table("pub_hot").groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) >= 8 and max(sizes) < 10_000


# --- layout from a sketch, uniqueness from intervals ---------------------------------------------

def _evaluations(spark, df):
    """``df`` with a counter of the rows that are evaluated."""
    counter = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            counter.add(b.num_rows)
            yield b
    return df.mapInArrow(seen, df.schema), counter


@pytest.mark.parametrize("with_sketch", [True, False])
def test_publish_evaluates_its_input_once(spark, with_sketch):
    df = spark.range(1000, numPartitions=4).selectExpr("id % 3 AS ano", "concat('k', id % 40) AS k", "id AS v")
    counted, counter = _evaluations(spark, df)
    sketch = df.selectExpr("ano", "k", "1.0D AS _w") if with_sketch else None
    ing.publish(spark, counted, "pub_once", partition_by=["ano"], cluster_by=["k"], expected_rows=1000, rows_per_file=100, sketch=sketch)
    assert counter.value == 1000
    assert spark.table("pub_once").count() == 1000 and not [t.name for t in spark.catalog.listTables() if t.name.endswith("_stage")]


def test_a_load_is_laid_out_by_the_sketch_of_its_profile(spark, scratch, monkeypatch):
    rows = [["Ano", "Resort", "Valor", "Data"]] + [[str(2020 + i % 3), f" Résort_{i % 20} ", str(i), f"{1 + i % 28:02d}/03/2024"] for i in range(6000)]
    rows += [["", "", "", ""]] + [["2021", "hot", str(i), "01/01/2024"] for i in range(6000)]
    spec = IngestSpec("lay", "pub_lay", write_csv(scratch, "lay.csv", rows), key_columns=("resort",), date_columns=("data",),
                      partition_by=("ano",), cluster_by=("resort__key", "data__date"))
    staged, real = [], ing.publish

    def publish(*args, **kw):
        staged.append(kw["sketch"] is None)
        return real(*args, **kw, rows_per_file=500)
    monkeypatch.setattr(ing, "publish", publish)
    monkeypatch.setattr(ing, "require_unique", lambda *a: pytest.fail("ids are compared"))
    res = ing.ingest(spark, spec)
    assert res.ok and res.rows == 12_000 and staged == [False], res.error
    table = spark.table("pub_lay")
    sizes = {r[0]: r[1] for r in table.groupBy(F.input_file_name()).count().collect()}
    assert 20 <= len(sizes) <= 40 and max(sizes.values()) < 1500
    spread = table.withColumn("f", F.input_file_name()).where("resort__key <> 'hot'").groupBy("ano", "resort__key").agg(F.count_distinct("f").alias("n"))
    assert max(r["n"] for r in spread.collect()) <= 3


def test_layout_ranges_keep_the_order_of_the_keys(spark):
    """Nulls, ties, dates and doubles; every row lies in the range that its keys belong to."""
    from innsight.sources.layout import layout_of
    df = spark.range(3000).selectExpr("IF(id % 7 = 0, NULL, id % 5) AS a", "IF(id % 11 = 0, NULL, concat('é\"', id % 13)) AS b",
                                      "date_add(DATE'2024-01-01', int(id % 9)) AS c", "IF(id % 17 = 0, double('NaN'), id / 7.0D) AS d", "id")
    keys = ["a", "b", "c", "d"]
    layout = layout_of(df.select(*keys, F.lit(1.0).alias("_w")), keys, 3000, rows_per_file=100)
    assert len(layout.bounds) >= 25 and sum(layout.files) <= 40
    got = df.withColumn("r", layout.range_of()).orderBy(*[F.col(k).asc_nulls_first() for k in keys]).collect()
    assert [r["r"] for r in got] == sorted(r["r"] for r in got) and {r["r"] for r in got} == set(range(len(layout.bounds) + 1))
    empty = layout_of(df.limit(0).select(*keys, F.lit(1.0).alias("_w")), keys, 0)
    assert empty.bounds == [] and empty.deal(df.limit(0)).count() == 0


def test_sketch_weights_estimate_the_rows(spark):
    from innsight.sources.layout import sample_sql
    df = spark.range(200_000, numPartitions=3).selectExpr("monotonically_increasing_id() AS m", "id < 50000 AS early")
    sample = df.groupBy(F.spark_partition_id().alias("p")).agg(F.expr(sample_sql("m", {"early": "early"})).alias("s"))
    rows = sample.select(F.explode("s").alias("s")).select("s.*").collect()
    assert len(rows) < 3 * 64 * 12
    whole, early = sum(r["_w"] for r in rows), sum(r["_w"] for r in rows if r["early"])
    assert abs(whole / 200_000 - 1) < 0.2 and abs(early / whole - 0.25) < 0.1


@pytest.mark.parametrize("rows,want", [
    ([("f", 0, 10, 10), ("f", 10, 15, 5), ("g", 0, 3, 3)], (18, 0, 0)),
    ([("f", 0, 10, 10), ("f", 8, 15, 7)], (17, 2, 0)),     # overlap
    ([("f", 0, 10, 10), ("f", 12, 15, 3)], (13, 0, 2)),    # gap
    ([("f", 0, 10, 11)], (11, 1, 0)), ([("f", 0, 10, 9)], (9, 0, 1)), ([("f", 0, 4, 4), ("f", 0, 4, 4)], (8, 4, 0)), ([], (0, 0, 0))])
def test_interval_proof(spark, rows, want):
    df = spark.createDataFrame(rows, f"{ing.FILE} string, first long, end long, n long")
    proof = ing.interval_proof(df).first()
    assert (proof["rows"], proof["repeated"], proof["missing"]) == want and proof["repeated_files"] == 0
    if want[1] or want[2]:
        with pytest.raises(ing.IngestError, match="not unique"):
            ing.require_unique_positions(df, "s")


def test_forged_positions_fail_the_load(spark, scratch, monkeypatch):
    spec = IngestSpec("u", "pub_forged", write_csv(scratch, "u.csv", [["a"]] + [[str(i)] for i in range(50)]))
    real = ing.read_source

    def forged(*args):
        raw, header, profile = real(*args)
        profile.intervals = profile.intervals.union(profile.intervals.withColumn("first", F.col("end") - 1))
        return raw, header, profile
    monkeypatch.setattr(ing, "read_source", forged)
    res = ing.ingest(spark, spec)
    assert not res.ok and "not unique" in res.error and not spark.catalog.tableExists("pub_forged")


@pytest.mark.parametrize("second,loads", [(["Lazer", "2"], True), (["Lazer", "Lazer"], False), (["lazer", "categoria"], False), (["x", "Lazer"], False)])
def test_a_value_that_is_a_column_name_is_data(spark, scratch, second, loads):
    write_csv(scratch, "1.csv", [["categoria", "lazer"], ["Eventos", "1"], ["Lazer", "7"]])
    write_csv(scratch, "2.csv", [second, ["Eventos", "3"]])
    res = ing.ingest(spark, IngestSpec("v", f"pub_value_{loads}", scratch, multi_file=True))
    assert res.ok == loads, res.error
    if loads:
        assert sorted((r.categoria, r.lazer) for r in spark.table(f"pub_value_{loads}").collect()) == [
            ("Eventos", 1), ("Eventos", 3), ("Lazer", 2), ("Lazer", 7)]


def test_headerless_text_part_with_a_name_in_another_place(spark, scratch):
    """All columns are text, so only names tell: one name out of place is a value, all names are a header."""
    write_csv(scratch, "1.csv", [["categoria", "lazer"], ["a", "b"]])
    write_csv(scratch, "2.csv", [["Lazer", "sim"], ["c", "d"]])
    res = ing.ingest(spark, IngestSpec("w", "pub_words", scratch, multi_file=True))
    assert res.ok and res.rows == 3, res.error


def test_parallel_loads_are_isolated(spark, scratch, monkeypatch):
    """A failing source's own jobs are cancelled; a slow one next to it goes on, in a pool and under a tag of its own."""
    import threading
    import time
    from pyspark import InheritableThread
    real, seen, cancelled = ing.ingest, {}, threading.Event()

    def slow_job():
        try:
            spark.range(4, numPartitions=4).mapInArrow(lambda batches: (time.sleep(60) or b for b in batches), "id long").count()
        except Exception:
            cancelled.set()

    def load(session, spec):
        seen[spec.source_id] = (spark.sparkContext.getLocalProperty("spark.scheduler.pool"), set(spark.sparkContext.getJobTags()))
        if spec.source_id == "bad":
            job = InheritableThread(target=slow_job, session=spark)
            job.start()
            time.sleep(4)
            return ing.IngestResult("bad", spec.target, error="it failed")
        time.sleep(6)
        return real(session, spec)
    monkeypatch.setattr(ing, "ingest", load)
    specs = [IngestSpec("bad", "pub_iso_bad", "nowhere"), IngestSpec("slow", "pub_iso", write_csv(scratch, "s.csv", [["a"], ["1"], ["2"]]))]
    began = time.time()
    results = ing.ingest_all(spark, specs, max_workers=2)
    assert [r.ok for r in results] == [False, True] and spark.table("pub_iso").count() == 2
    assert seen == {"bad": ("ingest-bad", {"ingest-bad"}), "slow": ("ingest-slow", {"ingest-slow"})}
    assert cancelled.wait(20) and time.time() - began < 55
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None and not spark.sparkContext.getJobTags()
