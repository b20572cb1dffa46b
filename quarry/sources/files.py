"""Files and tables: CSV and text round trips, vector literals, created
tables with appends, and the persisted vector index.

Every write is one distributed write; nothing is looped row by row and
nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T



# ---------------------------------------------------------------- CSV / text

def _csv_ready(df: DataFrame) -> DataFrame:
    """CSV has no array/struct type: nested columns go through ``to_json``."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sink_csv(df: DataFrame, path: str, index_col: str | None = None) -> str:
    """Write a headed CSV.  With ``index_col`` the first column is an unnamed
    row index (as a data frame library writes it)."""
    out = _csv_ready(df)
    if index_col:
        out = out.select(F.col(index_col).alias("_c0"), *out.columns)
    (out.write.mode("overwrite").option("header", True).option("escape", '"')
     .csv(path))
    return path


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
             multi_line: bool = False) -> DataFrame:
    """Read a headed CSV with an explicit schema (no inference pass); cells may
    hold quotes.  Large files are split between tasks; ``multi_line`` is for
    cells with line feeds and reads each file in one task."""
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(path)


def drop_index_col(df: DataFrame) -> DataFrame:
    return df.drop("_c0") if "_c0" in df.columns else df


def parse_vector_literal(text) -> Column:
    """``"[0.1, 2, 3e-4]"`` -> ``array<double>``; the nested one-element form
    ``"[[...]]"`` is unwrapped."""
    t = F.col(text) if isinstance(text, str) else text
    nested = F.ltrim(t).startswith("[[")
    return F.when(nested, F.from_json(t, "array<array<double>>")[0]) \
        .otherwise(F.from_json(t, "array<double>"))


def sink_text(df: DataFrame, col: str, path: str) -> str:
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)
    return path


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


# ---------------------------------------------------------------- tables

def create_table(spark: SparkSession, name: str, schema: T.StructType, location: str) -> str:
    """``CREATE TABLE IF NOT EXISTS ... USING parquet`` at a shared location."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet LOCATION '{location}'")
    return name


def bulk_insert(df: DataFrame, name: str) -> None:
    """Append a frame to a table in one distributed write (by position)."""
    df.write.insertInto(name, overwrite=False)


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Primary-key check: keys that occur more than once (empty when unique)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


# ---------------------------------------------------------------- dense ids

def dense_ids(df: DataFrame, order_col: str, id_col: str = "id") -> DataFrame:
    """Dense 0-based ids in ``order_col`` order without a single-task window.

    Rows are range-partitioned and sorted by the key; per-partition counts
    (one row per partition) give each partition its offset.  ``order_col``
    must be unique so the ids do not depend on partitioning.
    """
    # as many ranges as the session shuffles with, merged by size if they are small
    ordered = (df.repartitionByRange(order_col).sortWithinPartitions(order_col)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = ordered.checkpoint(eager=True)  # pin partition ids before counting
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"),
                                         F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_first",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per partition: bounded by the partition count
    return (ordered.join(F.broadcast(offsets), "_pid")
            .withColumn(id_col, F.col("_off") + F.col("_mid") - F.col("_first"))
            .drop("_pid", "_mid", "_first", "_off"))


# ---------------------------------------------------------------- vector index

def vector_index_build(df: DataFrame, key_col: str, text_col: str, vec_col: str,
                       id_col: str = "id") -> DataFrame:
    """``(id, key, text, vector array<float>)`` with dense ids in key order;
    raises if vectors differ in width."""
    r = df.agg(F.min(F.size(vec_col)).alias("lo"), F.max(F.size(vec_col)).alias("hi")).first()
    if r["lo"] is not None and r["lo"] != r["hi"]:
        raise ValueError(f"vectors differ in width ({r['lo']}..{r['hi']})")
    base = df.select(F.col(key_col), F.col(text_col).alias("text"),
                     F.col(vec_col).cast("array<float>").alias("vector"))
    return dense_ids(base, key_col, id_col).select(id_col, key_col, "text", "vector")


def vector_index_save(index: DataFrame, path: str) -> str:
    """id, text and vector are one table, so they cannot drift apart."""
    index.write.mode("overwrite").parquet(path)
    return path


def vector_index_load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
