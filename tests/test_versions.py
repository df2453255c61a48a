"""The version log: commits, leases, retention, years and domains from metadata."""

import threading

import pytest
from pyspark.sql import functions as F

from innsight import AnalysisError, run
from innsight.sources import ingest as ing
from innsight.sources.catalog import Catalog
from innsight.sources.testdata import testdata_catalog as bound_catalog
from innsight.sources.versions import SupersededError, VersionLog, domains_of, leased_table

from conftest import SF_SMALL
from test_ingest import _rows_read_by_scan, write_csv


def frame(spark, n, mark):
    return spark.range(n).selectExpr("id", f"'{mark}' AS mark")


def test_the_slower_of_two_loads_is_refused(spark):
    ing.publish(spark, frame(spark, 3, "first"), "ver_race")
    start = VersionLog(spark, "ver_race").last_number()
    winner = ing.publish(spark, frame(spark, 4, "fast"), "ver_race", predecessor=start)
    with pytest.raises(SupersededError):
        ing.publish(spark, frame(spark, 5, "slow"), "ver_race", predecessor=start)
    assert spark.table("ver_race").first()["mark"] == "fast" and spark.table("ver_race").count() == 4
    assert ing.versions(spark, "ver_race")[-1] == winner and VersionLog(spark, "ver_race").current().version == winner


def test_a_load_that_is_overtaken_fails(spark, scratch, monkeypatch):
    spec = ing.IngestSpec("o", "ver_over", write_csv(scratch, "o.csv", [["a"], ["1"]]))
    real = ing.prepare

    def overtaken(*args):
        ing.publish(spark, spark.range(7).selectExpr("id AS a"), "ver_over")
        return real(*args)
    monkeypatch.setattr(ing, "prepare", overtaken)
    res = ing.ingest(spark, spec)
    assert not res.ok and "another load" in res.error and spark.table("ver_over").count() == 7


def test_commits_are_exclusive(spark):
    log = VersionLog(spark, "ver_threads")
    done, refused = [], []

    def load(i):
        try:
            done.append(log.commit(0, f"v{i}"))
        except SupersededError:
            refused.append(i)
    threads = [threading.Thread(target=load, args=(i,)) for i in range(2)]
    for t in threads:
        t.start()
        t.join()  # the local file system checks before it creates, so the second one follows the first
    assert len(done) == 1 and len(refused) == 1 and log.numbers() == [1]


def test_a_lease_keeps_a_version(spark):
    ing.publish(spark, frame(spark, 1, "old"), "ver_lease")
    with leased_table(spark, "ver_lease") as table:
        for i in range(3):
            ing.publish(spark, frame(spark, 2 + i, "new"), "ver_lease", keep=1)
        assert [r["mark"] for r in table.collect()] == ["old"] and len(ing.versions(spark, "ver_lease")) == 2
    assert len(ing.retire(spark, "ver_lease", keep=1)) == 1 and len(ing.versions(spark, "ver_lease")) == 1
    log = VersionLog(spark, "ver_lease")
    log.take_lease("gone", -5)
    assert log.leased() == set()
    with pytest.raises(LookupError):
        with leased_table(spark, "ver_never"):
            pass


def test_versions_stay_for_their_time(spark):
    for i in range(4):
        ing.publish(spark, frame(spark, 1, str(i)), "ver_age", keep=1, keep_seconds=3600)
    assert len(ing.versions(spark, "ver_age")) == 4
    assert len(ing.retire(spark, "ver_age", keep=2, keep_seconds=0)) == 2


def test_an_entry_tells_partitions_ranges_and_domains(spark):
    df = spark.range(600).selectExpr("IF(id % 100 = 0, NULL, 2020 + id % 3) AS ano", "concat('r', id % 9) AS hotel__key", "concat('n', id) AS nome__key", "id")
    ing.publish(spark, df, "ver_told", partition_by=["ano"], cluster_by=["hotel__key"])
    entry = VersionLog(spark, "ver_told").current()
    assert entry.rows == 600 and entry.partitions == {"ano": ["2020", "2021", "2022", "__HIVE_DEFAULT_PARTITION__"]}
    assert entry.ranges == {"ano": ["2020", "2022"], "hotel__key": ["r0", "r8"]}
    assert entry.domains["hotel__key"] == [f"r{i}" for i in range(9)] and len(entry.domains["nome__key"]) == 600
    assert domains_of(spark.table("ver_told"), ["hotel__key", "nome__key"], most=100) == {"hotel__key": [f"r{i}" for i in range(9)]}


def drop(spark, *names):
    for n in names:
        ing.drop_target(spark, n) if ing.versions(spark, n) else spark.sql(f"DROP TABLE IF EXISTS {n}")
        for v in ing.versions(spark, n):
            spark.sql(f"DROP TABLE {v}")


def test_years_of_published_and_yearly_tables_together(spark):
    items = bound_catalog(spark, SF_SMALL).table("pos_item_sales")
    ing.publish(spark, items.where("ano IN (1995, 1996)"), "pos_item_sales", partition_by=["ano"])
    items.where("ano = 1998").write.mode("overwrite").saveAsTable("pos_item_sales_1998")
    try:
        cat = Catalog.from_metastore(spark)
        assert cat._years["pos_item_sales"] == {1995, 1996, 1998}
        served = Catalog(spark, {**cat._entries, "daily_occupancy": bound_catalog(spark, SF_SMALL).table("daily_occupancy")}, cat._years)
        whole = bound_catalog(spark, SF_SMALL)
        for year in ("1996", "1998"):
            f = {"hotel": "resort_alpha", "ano": year, "mes": "1,2"}
            got = run("analyze_item_sales", f, served)
            assert got.rows.collect() == run("analyze_item_sales", f, whole).rows.collect()
            assert "source_found" not in got.stats.columns  # no scan for the year's presence
        with pytest.raises(AnalysisError):
            run("analyze_item_sales", {"hotel": "resort_alpha", "ano": "1997", "mes": "1"}, served)
    finally:
        drop(spark, "pos_item_sales", "pos_item_sales_1998")


def test_a_plain_table_is_not_read_by_an_older_version_of_its_name(spark):
    items = bound_catalog(spark, SF_SMALL).table("pos_item_sales")
    ing.publish(spark, items.where("ano = 1995"), "pos_item_sales", partition_by=["ano"])
    ing.drop_target(spark, "pos_item_sales")
    items.where("ano = 1997").write.partitionBy("ano").mode("overwrite").saveAsTable("pos_item_sales")
    try:
        cat = Catalog.from_metastore(spark)
        assert cat._years["pos_item_sales"] == {1997} and cat.table("pos_item_sales").select("ano").distinct().first()[0] == 1997
    finally:
        spark.sql("DROP TABLE IF EXISTS pos_item_sales")
        drop(spark, "pos_item_sales")


def test_contains_reaches_the_scan_as_membership(spark):
    """Q17 and Q19 on published tables: values from the log, row groups skipped, the same rows."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    previous = hadoop.get("parquet.block.size")
    hadoop.set("parquet.block.size", str(64 * 1024))
    bound = bound_catalog(spark, SF_SMALL)
    names = ("employee_overtime_balance", "employee_sentiment_by_resort")
    try:
        from innsight.functions.text import fold
        for n in names:
            df = bound.table(n)
            df = df.withColumns({f"{c}__key": F.trim(fold(c)) for c in ("hotel", "cr", "nome") if c in df.columns and f"{c}__key" not in df.columns})
            ing.publish(spark, df, n, cluster_by=["hotel__key"])
        cat = Catalog.from_metastore(spark)
        hotel = sorted(cat.domains(names[0])["hotel__key"])[0]
        for analysis, f in (("get_employee_overtime_balance", {"hotel": hotel, "ano": "1997", "mes": "2"}), ("get_resort_adherence", {"hotel": "SRC1"})):
            rows = run(analysis, f, cat).rows
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "StringContains" not in plan and ("In(hotel__key" in plan or "EqualTo(hotel__key" in plan), plan[:2000]
            assert rows.collect() == run(analysis, f, bound).rows.collect()
        absent = run("get_resort_adherence", {"hotel": "nowhere at all"}, cat)
        assert absent.rows.collect() == [] and absent.envelope()["pagination"]["total_records"] == 0
        table = cat.table(names[0])
        assert _rows_read_by_scan(table.where(F.col("hotel__key").isin([hotel]))) < table.count()
    finally:
        hadoop.unset("parquet.block.size") if previous is None else hadoop.set("parquet.block.size", previous)
        drop(spark, *names)
