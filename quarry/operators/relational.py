"""Relational analytics on the alert/deal tables, the catalog, and running
SQL statements with their errors captured as data."""

from __future__ import annotations

import logging
import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import sqlguard

# ---------------------------------------------------------------- joins / aggregates


def join_alert_deal(alerts: DataFrame, deals: DataFrame) -> DataFrame:
    """Inner equi-join on ``alert_id``; the shared non-key ``deal_number``
    becomes ``deal_number_x`` (alerts) and ``deal_number_y`` (deals)."""
    a = alerts.withColumnRenamed("deal_number", "deal_number_x")
    d = deals.withColumnRenamed("deal_number", "deal_number_y")
    return a.join(d, "alert_id")


def count_per(df: DataFrame, key: str, counted: str, alias: str) -> DataFrame:
    """``COUNT(counted)`` (non-null only) per ``key``: partial + final hash
    aggregate, so a hot key is pre-aggregated in every task."""
    return df.groupBy(key).agg(F.count(counted).alias(alias))


def top_by(df: DataFrame, metric: str, key: str, n: int = 1) -> DataFrame:
    """``ORDER BY metric DESC, key LIMIT n`` (key breaks ties)."""
    return df.orderBy(F.col(metric).desc(), F.col(key).asc()).limit(n)


def result_text(df: DataFrame, order_cols: list[str], max_rows: int = 10_000) -> DataFrame:
    """A small result as one ordered string ``[{...}, {...}]``, nulls kept.

    One cell holds all of it, so the caller's result must be bounded: more than
    ``max_rows`` rows raise an error when the text is made (nothing is cut)."""
    some = df.limit(max_rows + 1)  # enough to tell
    rows = F.collect_list(F.struct(*[F.col(c) for c in order_cols],
                                   F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("_j")))
    text = F.concat(F.lit("["), F.array_join(
        F.transform(F.array_sort(rows), lambda x: x["_j"]), ", "), F.lit("]"))
    too_many = F.raise_error(F.lit(f"result_text: more than {max_rows} rows"))
    return some.agg(F.when(F.count(F.lit(1)) > max_rows, too_many).otherwise(text).alias("result"))


def unread_count(messages: DataFrame, box: str = "mailbox", flag: str = "unread") -> DataFrame:
    return messages.groupBy(box).agg(F.count_if(F.col(flag)).alias("unread"))


def mail_filter(messages: DataFrame) -> DataFrame:
    """Keep messages with sender, subject and body, whose body does not
    mention Microsoft Teams."""
    return messages.where(
        (F.col("sender") != "") & (F.col("subject") != "") & (F.col("body") != "")
        & ~F.lower(F.col("body")).contains("microsoft teams"))


# ---------------------------------------------------------------- catalog

def catalog_tables(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """One row per table: ``(table_name, n_rows, n_cols)``; one distributed
    count per table."""
    names = names if names is not None else sorted(t.name for t in spark.catalog.listTables())
    frames = []
    for n in names:
        t = spark.table(n)
        frames.append(t.agg(F.count(F.lit(1)).alias("n_rows"))
                      .select(F.lit(n).alias("table_name"), "n_rows",
                              F.lit(len(t.columns)).alias("n_cols")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def catalog_columns(spark: SparkSession, names: list[str] | None = None,
                    exact: bool = False) -> DataFrame:
    """Column profile: ``(table_name, ordinal, column_name, data_type,
    non_null, n_distinct)``.  With ``exact=False`` all counts of a table come
    from one aggregate pass, distinct ones by HyperLogLog."""
    names = names if names is not None else sorted(t.name for t in spark.catalog.listTables())
    frames = []
    for n in names:
        t = spark.table(n)
        fields = t.schema.fields
        about = [F.struct(F.lit(n).alias("table_name"), F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
                          F.lit(f.dataType.simpleString()).alias("data_type")) for i, f in enumerate(fields)]
        if exact:
            # a scan of each column alone: several exact distincts in one
            # aggregate would copy every row once per column
            for f, a in zip(fields, about):
                c = F.col(f"`{f.name}`")
                frames.append(t.agg(F.count(c).alias("non_null"), F.count_distinct(c).alias("n_distinct"))
                              .select(a.alias("a"), "non_null", "n_distinct").select("a.*", "non_null", "n_distinct"))
            continue
        aggs = []
        for i, f in enumerate(fields):
            c = F.col(f"`{f.name}`")
            aggs += [F.count(c).alias(f"nn{i}"), F.approx_count_distinct(c).alias(f"nd{i}")]
        stack = F.explode(F.array(*[
            F.struct(a.alias("a"), F.col(f"nn{i}").alias("non_null"), F.col(f"nd{i}").alias("n_distinct"))
            for i, a in enumerate(about)]))
        frames.append(t.agg(*aggs).select(stack.alias("s")).select("s.a.*", "s.non_null", "s.n_distinct"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def catalog_info(spark: SparkSession, names: list[str] | None = None, profile: DataFrame | None = None) -> DataFrame:
    """``(table_name, column_names array<string>, without_values array<string>)``
    in column order.  From the schema alone every column is listed and
    ``without_values`` is null; a column profile (:func:`catalog_columns`, or a
    stored one) tells which of them hold only nulls."""
    if profile is not None:
        cols = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "non_null")))
        name = lambda c: c["column_name"]
        return profile.groupBy("table_name").agg(cols.alias("c")).select(
            "table_name", F.transform("c", name).alias("column_names"),
            F.transform(F.filter("c", lambda c: c["non_null"] == 0), name).alias("without_values"))
    names = names if names is not None else sorted(t.name for t in spark.catalog.listTables())
    rows = [(n, [f.name for f in spark.table(n).schema.fields], None) for n in names]
    return spark.createDataFrame(rows, "table_name string, column_names array<string>, without_values array<string>")


def schema_text(info: DataFrame) -> DataFrame:
    """``Table: t\\nColumns: a, b`` per table, joined by newlines in table
    name order (one row; the catalog is small)."""
    per = info.select("table_name", F.concat(
        F.lit("Table: "), F.col("table_name"), F.lit("\nColumns: "),
        F.array_join(F.col("column_names"), ", ")).alias("t"))
    return per.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("table_name", "t"))), lambda x: x["t"]),
        "\n").alias("schema_text"))


# ---------------------------------------------------------------- SQL with errors as data

def _unique(names: list[str]) -> list[str]:
    """Column names for JSON: a repeated name gets ``_2``, ``_3``, ..."""
    out: list[str] = []
    for n in names:
        k, name = 1, n
        while name in out:
            k += 1
            name = f"{n}_{k}"
        out.append(name)
    return out


def _write_result(spark: SparkSession, sql: str, path: str) -> None:
    """Rows of one statement as JSON (nulls kept, columns by position), with the
    place that Spark's own order gives each row."""
    res = spark.sql(sql)
    names = _unique(res.columns)
    flat = res.toDF(*[f"c{k}" for k in range(len(names))])
    row = F.to_json(F.struct(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)]), {"ignoreNullFields": "false"})
    flat.select(F.monotonically_increasing_id().alias("place"), row.alias("row_json")).write.parquet(path)


def _numbered(rows: DataFrame) -> DataFrame:
    """``place`` -> ``row_no`` from 0 per statement: rows are numbered inside
    their partition, and one count per partition gives its offset."""
    part = F.shiftright("place", 33)
    rows = rows.withColumn("part", part)
    sizes = rows.groupBy("stmt_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("stmt_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("stmt_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, ["stmt_id", "part"]).select(
        "stmt_id", (F.col("start") + F.col("place") - F.col("first")).alias("row_no"), "row_json")


def _own_session(spark: SparkSession) -> SparkSession:
    """A copy of the session, with its views and settings, for statements of
    others: they see no variables, and what they might set stays theirs."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.variable.substitute", "false")
    return own


def sql_batch(spark: SparkSession, statements: DataFrame, sql_col: str = "sql",
              page: int = 1000, parallel: int = 4, functions: tuple[str, ...] = (),
              results: str | None = None) -> DataFrame:
    """Run a table of SQL statements; ``(sql, ok, row_no, row_json, error)`` per
    distinct statement.

    Each distinct statement runs once as its own distributed job; its whole
    result is written under one shared folder, so a run-time error surfaces
    inside the ``try`` and the result survives executor loss.  A successful
    statement contributes one row per result row (``row_no`` is its place, which
    an ``ORDER BY`` makes meaningful), or one row with nulls when its result is
    empty; a failing one contributes one row with ``ok = false`` and the whole
    error text.  A statement that is no plain query is refused (``refused: ...``,
    see :mod:`sqlguard`); ``functions`` names UDFs that it may call.

    Statement texts pass the driver in pages of ``page``, never their results;
    results are read back from storage in one scan and joined on a statement
    number, so neither the number of statements nor the size of a result has a
    limit.

    ``results`` names a shared folder that calls over the same state of the
    tables share: a statement that one of them has run, failures too, is not run
    again.  A statement whose call was lost before it was listed is run anew.
    """
    root = results or scratch_path(spark, "sql")
    own = _own_session(spark)
    schema = f"stmt_id long, {sql_col} string, ok boolean, error string"
    wanted = statements.select(sql_col).distinct()
    todo = wanted

    def list_(done):
        spark.createDataFrame(done, schema).coalesce(1).write.mode("append").parquet(f"{root}/status")

    list_([])
    if results:
        wanted = wanted.withColumnRenamed(sql_col, "of")
        listed = spark.read.schema(schema).parquet(f"{root}/status")
        todo = wanted.join(listed, wanted["of"].eqNullSafe(listed[sql_col]), "left_anti")

    def run_one(k_s):
        k, s = k_s
        try:
            if reason := sqlguard.why_refused(own, s, functions):
                return k, s, False, f"refused: {reason}"
            _write_result(own, s, f"{root}/rows/stmt_id={k}")
        except Exception as e:  # parse, analysis and run-time errors alike
            return k, s, False, str(e).strip() or type(e).__name__
        return k, s, True, None

    numbered = ((uuid.uuid4().int >> 65, r[0]) for r in todo.toLocalIterator())
    # failures are data here, so the client-side error log is quieted
    ctx_log = logging.getLogger("SQLQueryContextLogger")
    level = ctx_log.level
    ctx_log.setLevel(logging.CRITICAL)
    ran = False
    try:
        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            while some := list(islice(numbered, page)):
                done = list(pool.map(run_one, some))
                ran = ran or any(d[2] for d in done)
                list_(done)
    finally:
        ctx_log.setLevel(level)
    status = spark.read.schema(schema).parquet(f"{root}/status")
    if results:
        status = status.join(wanted, status[sql_col].eqNullSafe(wanted["of"]), "left_semi")
        ran = ran or status.where("ok").limit(1).count() > 0
    rows = _numbered(spark.read.schema("place long, row_json string, stmt_id long").parquet(f"{root}/rows")) if ran \
        else spark.createDataFrame([], "stmt_id long, row_no long, row_json string")
    return status.join(rows, "stmt_id", "left").select(sql_col, "ok", "row_no", "row_json", "error")
