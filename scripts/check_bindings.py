"""Compare every Spark testdata binding with its DuckDB statement (whole tables)."""
import sys, time
sys.path.insert(0, ".")
from innsight.session import build_session
from innsight.sources.testdata import testdata_catalog
from innsight.oracle.bindings import SQL
from innsight.oracle.compare import compare, duckdb_connection

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = sys.argv[2:]
spark = build_session("local[8]", shuffle_partitions=8)
spark.sparkContext.setLogLevel("ERROR")
cat = testdata_catalog(spark, sf)
con = duckdb_connection(sf)
bad = 0
for name, sql in SQL.items():
    if only and name not in only:
        continue
    t = time.time()
    ok, msg = compare(cat.table(name), con, f"SELECT * FROM ({sql})")
    bad += not ok
    print(f"{'OK ' if ok else 'BAD'} {name:36s} {time.time()-t:5.1f}s {msg}")
sys.exit(1 if bad else 0)
