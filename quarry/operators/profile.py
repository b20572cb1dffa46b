"""Column profiles that are kept per file and merged instead of rescanned.

The profile of a table is a small Parquet table with a row for each (file,
column): how many values there are, and a HyperLogLog sketch of them.  Counts
add up and sketches unite, so a table's profile is an aggregate over the rows
of its files, and an append costs a scan of the new files alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LOG_BUCKETS = 12   # 4,096 buckets: one standard error is 1.04 / 64 = 1.6 % of the count
PROFILE_SCHEMA = ("file string, ordinal int, column_name string, data_type string, n_rows long, non_null long, "
                  "sketch binary")


def relative_error(log_buckets: int = LOG_BUCKETS) -> float:
    """Standard error of a distinct count, as a share of it."""
    return 1.04 / 2 ** (log_buckets / 2)


def profile_files(rows: DataFrame, log_buckets: int = LOG_BUCKETS) -> DataFrame:
    """``PROFILE_SCHEMA`` rows of a frame read from files, in one pass.  Values
    that are no whole numbers or texts count by their text."""
    plain = {"tinyint", "smallint", "int", "bigint", "string", "binary"}
    aggs, about = [F.count(F.lit(1)).alias("n_rows")], []
    for k, f in enumerate(rows.schema.fields):
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("array", "map", "struct", "variant"):
            value = F.to_json(F.struct(c))
        elif kind in ("tinyint", "smallint"):
            value = c.cast("int")
        else:
            value = c if kind in plain else c.cast("string")
        aggs += [F.count(c).alias(f"n{k}"), F.hll_sketch_agg(F.when(c.isNotNull(), value), F.lit(log_buckets)).alias(f"s{k}")]
        about.append(F.struct(F.lit(k + 1).alias("ordinal"), F.lit(f.name).alias("column_name"), F.lit(kind).alias("data_type"),
                              F.col("n_rows"), F.col(f"n{k}").alias("non_null"), F.col(f"s{k}").alias("sketch")))
    return rows.groupBy(F.input_file_name().alias("file")).agg(*aggs).select(
        "file", F.explode(F.array(*about)).alias("c")).select("file", "c.*")


def update_profile(spark: SparkSession, path: str, files: list[str], read: Callable[[list[str]], DataFrame],
                   log_buckets: int = LOG_BUCKETS) -> list[str]:
    """Bring the profile at ``path`` up to date with a table's ``files``; returns
    the files that were read, those that it did not have.  ``read`` makes the
    table's rows from some of its files.

    A file is one row group of the profile, written whole or not at all, and a
    run that is lost is simply repeated.  Files are taken as immutable."""
    try:
        known = {r[0] for r in spark.read.schema(PROFILE_SCHEMA).parquet(path).select("file").distinct().toLocalIterator()}
    except AnalysisException:  # no profile yet
        known = set()
    new = sorted(set(files) - known)
    if new:
        profile_files(read(new), log_buckets).write.mode("append").parquet(path)
    return new


def merged_profile(spark: SparkSession, path: str, table_name: str, files: list[str] | None = None) -> DataFrame:
    """The profile of a table from its files' rows: ``(table_name, ordinal,
    column_name, data_type, non_null, n_distinct)``.  With ``files`` only these
    count, so a file that was removed goes out of the profile."""
    rows = spark.read.schema(PROFILE_SCHEMA).parquet(path).dropDuplicates(["file", "ordinal"])
    if files is not None:
        rows = rows.join(spark.createDataFrame([(f,) for f in files], "file string"), "file", "left_semi")
    return rows.groupBy(F.lit(table_name).alias("table_name"), "ordinal", "column_name", "data_type").agg(
        F.sum("non_null").alias("non_null"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
