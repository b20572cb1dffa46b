import datetime
from quarry.operators import profile, relational
from quarry.session import scratch_path

SCHEMA = "k long, s string, f double, d date, tags array<string>, none string"


def rows(a, b):
    return [(k, f"s{k % 700}" if k % 5 else None, k / 8, datetime.date(2024, 1, 1 + k % 28), [str(k % 3)], None) for k in range(a, b)]


def test_an_append_reads_only_the_new_files(spark):
    data, kept = scratch_path(spark, "data"), scratch_path(spark, "profile")
    read = []

    def some(files):
        read.append(list(files))
        return spark.read.parquet(*files)

    total = 0
    for a, b in ((0, 3000), (3000, 3001), (3001, 9000)):
        spark.createDataFrame(rows(a, b), SCHEMA).repartition(2).write.mode("append").parquet(data)
        files = list(spark.read.parquet(data).inputFiles())
        assert set(profile.update_profile(spark, kept, files, some)) == set(files) - {f for part in read[:-1] for f in part}
        total += len(read[-1])
    assert total == len(files) and profile.update_profile(spark, kept, files, some) == [] and len(read) == 3
    spark.read.parquet(data).createOrReplaceTempView("profiled")
    exact = {r.column_name: r for r in relational.catalog_columns(spark, ["profiled"], exact=True).collect()}
    got = {r.column_name: r for r in profile.merged_profile(spark, kept, "profiled", files).collect()}
    assert list(got) and set(got) == set(exact)
    for c, e in exact.items():
        assert (got[c].table_name, got[c].ordinal, got[c].data_type, got[c].non_null) == (e.table_name, e.ordinal, e.data_type, e.non_null)
        assert abs(got[c].n_distinct - e.n_distinct) <= 4 * profile.relative_error() * e.n_distinct
    gone = profile.merged_profile(spark, kept, "profiled", files[:1]).where("column_name = 'k'").first()
    assert gone.non_null == spark.read.parquet(files[0]).count()  # files that were removed do not count
    info = relational.catalog_info(spark, profile=profile.merged_profile(spark, kept, "profiled", files)).first()
    assert info.column_names == ["k", "s", "f", "d", "tags", "none"] and info.without_values == ["none"]
    spark.catalog.dropTempView("profiled")


def test_an_update_that_ran_twice_counts_once(spark):
    data, kept = scratch_path(spark, "data"), scratch_path(spark, "profile")
    spark.createDataFrame(rows(0, 100), SCHEMA).coalesce(1).write.parquet(data)
    files = list(spark.read.parquet(data).inputFiles())
    for _ in range(2):  # two drivers, neither of which saw the other
        profile.profile_files(spark.read.parquet(*files)).write.mode("append").parquet(kept)
    got = {r.column_name: r.non_null for r in profile.merged_profile(spark, kept, "t").collect()}
    assert got["k"] == 100 and got["none"] == 0


def test_tables_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert profile.profile_files(empty).count() == 0
    empty.createOrReplaceTempView("no_rows")
    info = relational.catalog_info(spark, profile=relational.catalog_columns(spark, ["no_rows"])).first()
    assert info.column_names == empty.columns == info.without_values
    assert relational.schema_text(relational.catalog_info(spark, ["no_rows"])).first()[0] == "Table: no_rows\nColumns: " + ", ".join(empty.columns)
    spark.catalog.dropTempView("no_rows")
