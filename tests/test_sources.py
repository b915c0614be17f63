import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from fleetveil.plans import analytics, checks, reporting
from fleetveil.plans.categories import CATEGORY_COLUMNS
from fleetveil.sources import readers, sinks
from fleetveil.sources.readers import SourceTable

SCHEMA = StructType([StructField("guid", StringType()), StructField("n", IntegerType())])


def _gzip_csv(folder, lines):
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / "part.csv.gz", "wt") as out:
        out.write("\n".join(lines) + "\n")
    return str(folder)


@pytest.fixture
def dirty(tmp_path):
    return _gzip_csv(tmp_path / "dirty", ["guid,n", "a,1", "b,not a number", "c,3", "d,4,5,6"])


def test_gzip_csv_infers_types(spark, tmp_path):
    folder = _gzip_csv(tmp_path / "clean", ["guid,n", "a,1", "b,2"])
    rows = readers.read_csv(spark, folder, spread=3)
    assert dict(rows.dtypes) == {"guid": "string", "n": "int"} and rows.count() == 2


def test_tolerant_csv_drops_and_rejects_count(spark, dirty):
    kept = readers.read_csv(spark, dirty, SCHEMA, tolerant=True)
    assert sorted(r.guid for r in kept.collect()) == ["a", "c"]
    good, bad = readers.read_csv_with_rejects(spark, dirty, SCHEMA)
    assert sorted(r.guid for r in good.collect()) == ["a", "c"] and bad.count() == 2


def test_strict_csv_fails(spark, dirty):
    with pytest.raises(Exception):
        readers.read_csv(spark, dirty, SCHEMA).collect()


def test_sample_fraction():
    assert readers.sample_fraction(100, 200) == 1.0
    assert readers.sample_fraction(400, 200) == 0.5


def test_load_samples_large_and_reports_failures(spark, tmp_path, dirty):
    big, bad = tmp_path / "big", tmp_path / "bad"
    spark.range(20_000).withColumn("x", F.rand(1)).write.parquet(str(big))
    bad.mkdir()
    (bad / "broken.parquet").write_text("not parquet")
    size = readers.folder_bytes(spark, str(big))
    report = readers.load_tables(
        spark,
        [
            SourceTable("big", str(big)),
            SourceTable("apps", dirty, "csv", tolerant=True, schema=SCHEMA),
            SourceTable("gone", str(tmp_path / "gone")),
            SourceTable("bad", str(bad)),
        ],
        str(tmp_path / "db"), fractions={"big": 0.25}, seed="7",
    )
    got = {r.table: r for r in report.collect()}
    assert got["big"].status == "sampled" and got["big"].bytes == size
    assert got["big"].fraction == pytest.approx(0.25, abs=0.01)
    assert 4_000 < got["big"].rows < 6_000
    assert spark.read.parquet(str(tmp_path / "db/big")).count() == got["big"].rows
    assert (got["apps"].status, got["apps"].rows) == ("ok", 2)
    assert got["gone"].status == "missing" and got["bad"].status == "failed" and got["bad"].error


def test_a_sample_does_not_depend_on_the_partitioning(spark):
    rows = spark.range(5_000).select("id", F.lit("x").alias("v"))
    kept = [
        {r.id for r in readers.sample_by_key(rows.repartition(n), 0.3, "s", ["id"]).collect()}
        for n in (2, 7)
    ]
    assert kept[0] == kept[1] and 1_300 < len(kept[0]) < 1_700
    assert readers.sample_by_key(rows, 1.0, "s").count() == 5_000


def test_full_load(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    report = readers.load_tables(
        spark, [SourceTable("t", str(tmp_path / "t"))], str(tmp_path / "db")).first()
    assert (report.status, report.rows, report.fraction) == ("ok", 100, 1.0)


def test_write_table_replaces_and_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select(
        F.col("id").alias("guid"), (F.col("id") % 3).alias("dt"), F.rand(1).alias("x"))
    assert sinks.write_table(rows, path, partition_by=["dt"], sort_by=["guid"]) == 1000
    assert sinks.write_table(rows.limit(10), path, partition_by=["dt"], sort_by=["guid"]) == 10
    assert spark.read.parquet(path).count() == 10
    assert (tmp_path / "t" / "dt=0").is_dir()


def test_bucketed_table_folds_without_a_shuffle(spark, tmp_path):
    sinks.create_schema(spark, "fleet_buckets")
    rows = spark.range(1000).select((F.col("id") % 50).alias("guid"), F.col("id").alias("v"))
    n = sinks.write_table(
        rows, str(tmp_path / "b"), "fleet_buckets.t", sort_by=["guid"], bucket_by=("guid", 4))
    assert n == 1000
    folded = spark.table("fleet_buckets.t").groupBy("guid").agg(F.sum("v").alias("s"))
    assert "Exchange" not in folded._jdf.queryExecution().executedPlan().toString()
    assert folded.count() == 50
    with pytest.raises(ValueError):
        sinks.write_table(rows, str(tmp_path / "c"), bucket_by=("guid", 4))
    spark.sql("DROP DATABASE fleet_buckets CASCADE")


def test_results_do_not_depend_on_the_shuffle_width(spark, tables):
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def rows(width):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        return [
            sorted(map(tuple, analytics.run_query(n, tables, sort=False).collect()))
            for n in (5, 12, 15, 18)
        ]

    try:
        assert rows("1") == rows("13")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_export_and_read_back(spark, tmp_path):
    def broken():
        raise ValueError("no such result")

    results = {"one": lambda: spark.range(3).select(F.col("id"), F.lit(0.5).alias("v")),
               "two": broken}
    report = {r.table: r for r in sinks.export_results(spark, results, str(tmp_path)).collect()}
    assert (report["one"].status, report["one"].rows) == ("ok", 3)
    assert report["two"].status == "failed" and "no such result" in report["two"].error
    back = readers.read_results(
        spark, str(tmp_path), {"one": "id long, v double", "absent": "id long"})
    assert list(back) == ["one"] and back["one"].agg(F.sum("v")).first()[0] == 1.5


def test_release_and_summary_sinks(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "laplace", "advance", e, "g", "c", 1.0, 1.5) for e in ("0.5", "inf")],
        "query_num int, mechanism string, variant string, epsilon string, group_key string, "
        "column string, true_value double, noisy_value double")
    with pytest.raises(ValueError, match="true_value"):
        sinks.write_release(rows, str(tmp_path / "r"))
    sinks.write_release(sinks.noisy_only(rows), str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    assert stored.count() == 2 and not any(c.startswith("true_") for c in stored.columns)
    assert (tmp_path / "r/mechanism=laplace/variant=advance/epsilon=inf/query_num=1").is_dir()
    sinks.write_summary(rows, str(tmp_path / "s"), as_csv=True)
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 2


def test_catalog_listing_and_readiness(spark, tmp_path):
    sinks.create_schema(spark, "fleet_test")
    rows = spark.range(2).withColumnRenamed("id", "guid")
    for t in checks.REQUIRED_TABLES[:-1]:
        spark.sql(f"DROP TABLE IF EXISTS fleet_test.{t}")
        rows.write.mode("overwrite").option("path", str(tmp_path / t)).saveAsTable(f"fleet_test.{t}")
    listed = [r.table for r in readers.list_tables(spark, ["fleet_test"]).collect()]
    assert listed == sorted(checks.REQUIRED_TABLES[:-1])
    first = checks.readiness(spark, "fleet_test").first()
    assert first.status == "MISSING TABLES" and first.missing == checks.REQUIRED_TABLES[-1]
    some = checks.readiness(spark, "fleet_test", checks.REQUIRED_TABLES[:2]).first()
    assert some.status == "ALL TABLES EXIST"
    spark.sql("DROP DATABASE fleet_test CASCADE")


def test_stored_layer_answers_like_the_lazy_one(spark, tables, tmp_path):
    names = ["system_batt_dc_events", "sysinfo", "system_cpu_metadata"]
    report = sinks.write_tables({n: tables[n] for n in names}, str(tmp_path)).collect()
    assert {r.status for r in report} == {"ok"}
    stored = {n: spark.read.parquet(str(tmp_path / n)) for n in names}

    def rows(t):
        out = analytics.run_query(1, t, more_than=50).collect()
        return sorted((r.country, r.number_of_systems, round(r.avg_duration, 9)) for r in out)

    assert rows(stored) == rows(tables)


def test_sample_rows(tables):
    got = checks.sample_rows(tables, ["system_cpu_metadata", "system_userwait"], 25)
    assert all(df.count() == 25 for df in got.values())
    again = checks.sample_rows(
        {n: t.repartition(5) for n, t in tables.items() if n in got}, list(got), 25)
    assert all(sorted(map(str, got[n].collect())) == sorted(map(str, again[n].collect())) for n in got)


def test_all_category_pairs_are_listed(spark):
    pairs = spark.range(300).select(
        F.col("id").cast("string").alias("parent_category"), F.lit("s").alias("sub_category"))
    assert checks.category_pairs({"web_usage": pairs}).count() == 300


def test_web_pivot_copy_exists_only_with_its_source(spark, sources):
    assert "system_web_cat_pivot" not in reporting.reporting_tables(sources)
    raw = spark.range(2).withColumnRenamed("id", "guid")
    tables = reporting.reporting_tables({**dict.fromkeys(sources), "web_cat_pivot": raw})
    assert tables["system_web_cat_pivot"].count() == 2


def test_category_columns():
    assert len(set(CATEGORY_COLUMNS)) == 28
    assert CATEGORY_COLUMNS[0] == "content_creation_photo_edit_creation"
    assert "unclassified" in CATEGORY_COLUMNS and "social_communication_live" in CATEGORY_COLUMNS


def test_bound_violations_count_nulls(spark):
    cells = spark.createDataFrame(
        [(1, "c", 5.0), (1, "c", None), (1, "c", 11.0), (1, "other", 99.0)],
        "query_num int, column string, true_value double")
    row = checks.bound_violations(cells, [(1, "c", 0.0, 10.0)]).collect()
    assert [(r.column, r.n_cells, r.n_violations) for r in row] == [("c", 3, 2)]


def test_bounds_of_sums_follow_the_devices_of_the_group(spark):
    cells = spark.createDataFrame(
        [(8, g, c, v) for g, n, v8 in (("a", 3.0, 30.0), ("b", 2.0, 21.0)) for c, v in (("number_of_systems", n), ("days", v8))],
        "query_num int, group_key string, column string, true_value double")
    row = checks.bound_violations(cells, [(8, "days", 0.0, 10.0, True)]).first()
    assert (row.n_cells, row.n_violations) == (2, 1)
    row = checks.bound_violations(cells, [(8, "days", 0.0, 10.0, False)]).first()
    assert (row.n_cells, row.n_violations) == (2, 2)


def test_orders_put_nulls_last(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "v int")
    assert [r.v for r in analytics.ordered(df, [("v", False)]).collect()] == [1, 2, None]
    assert [r.v for r in analytics.ordered(df, [("v", True)]).collect()] == [2, 1, None]


def test_unusual_core_column_name(tables):
    renamed = {**{n: tables[n] for n in ("system_network_consumption",)},
               "sysinfo": tables["sysinfo"].withColumnRenamed("ofcores", "#ofcores")}
    assert "number_of_cores" in analytics.server_like_devices(renamed, cores="#ofcores").columns


def test_csv_files_follow_the_size_of_the_rows(spark, tmp_path):
    rows = spark.range(400_000).selectExpr("id", "uuid() AS text").cache()
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    files = {}
    try:
        spark.conf.set(key, "1m")
        for name, some in (("few", rows.where("id < 4000")), ("many", rows)):
            assert sinks.write_csv(some, str(tmp_path / name)) == some.count()
            files[name] = len(list((tmp_path / name).glob("*.csv.gz")))
    finally:
        spark.conf.set(key, before)
        rows.unpersist()
    assert files["few"] == 1 and files["many"] >= 4
    assert readers.read_csv(spark, str(tmp_path / "many")).count() == 400_000
