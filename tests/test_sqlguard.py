"""Statements of others: what the guard lets through, by the parsed tree."""
import pytest

from quarry.operators import relational, sqlguard
from quarry.session import scratch_path

JM = "java_method('java.lang.System', 'setProperty', 'quarry.test', 'x')"
REFUSED = [
    "WITH z AS (SELECT '== Analyzed Logical Plan ==' AS a) INSERT INTO dst SELECT a FROM z",
    "FROM five INSERT INTO dst SELECT id", "SHOW TABLES", "DESCRIBE five", "EXPLAIN SELECT 1", "SET TIME ZONE 'UTC'",
    "ADD JAR '/x'", "DECLARE v INT", "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'DROP VIEW five'", "CACHE TABLE five",
    f"SELECT {JM}", "SELECT Reflect('java.lang.System', 'exit', 1)", "SELECT (SELECT try_reflect('a', 'b'))",
    f"SELECT * FROM five WHERE EXISTS (SELECT {JM})", f"SELECT transform(array(1), x -> {JM})", f"VALUES ({JM})",
    f"SELECT system.builtin.{JM}", f"SELECT * FROM five |> WHERE {JM} = 'x'", f"SELECT count(*) FILTER (WHERE {JM} = '') FROM five",
    f"SELECT id FROM five ORDER BY {JM}", f"SELECT * FROM five LATERAL VIEW explode(array({JM})) t AS y",
    f"SELECT * FROM range({JM})", f"WITH a AS (SELECT {JM} AS x) SELECT 1", f"SELECT id FROM five GROUP BY id HAVING {JM} = 'x'",
    f"SELECT sum(id) OVER (ORDER BY {JM}) FROM five", "SELECT identifier('java_method')('a', 'b')", "SELECT * FROM identifier('five')",
    "SELECT * FROM parquet.`/tmp`", "SELECT * FROM text.`/etc/passwd`", "SELECT TRANSFORM(id) USING 'cat' AS (b) FROM five",
    "SELECT mine(id) FROM five", "SELECT abs(id) FROM five", "SELECT f2(1)", "SELECT nope.f(1)", "SELECT input_file_name()",
    "SELECT version()", "SELECT * FROM sql_keywords()"]
FINE = [
    "SELECT 1 AS `Insert`, 'a\nInsert x' AS t", "SELECT '${spark.master}' AS s", "SELECT 'DROP TABLE x; java_method()'",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r",
    "SELECT id, row_number() OVER w AS r FROM five WINDOW w AS (PARTITION BY id % 2 ORDER BY id DESC)",
    "SELECT * FROM five UNPIVOT (v FOR k IN (id))", "SELECT * FROM (SELECT id, id % 2 c FROM five) PIVOT (sum(id) FOR c IN (0, 1))",
    "FROM five |> WHERE id > 1 |> AGGREGATE count(*) AS n", "SELECT * FROM range(3) r JOIN LATERAL (SELECT r.id + 1 AS x)",
    "SELECT trim(both 'x' from 'xax'), extract(year from date'2020-01-01'), try_cast('a' as int), '1'::int, 'a' LIKE 'a%', 5 DIV 2",
    "SELECT id FROM five UNION SELECT 9 EXCEPT SELECT 1 INTERSECT SELECT 1", "SELECT * FROM default.dst",
    "SELECT /*+ BROADCAST(a) */ a.id FROM five a NATURAL JOIN five b", "SELECT id, count(*) FROM five GROUP BY GROUPING SETS ((id), ())",
    "SELECT id FROM five TABLESAMPLE (100 PERCENT)", "SELECT id FROM five WHERE id IN (1, 2) OR id <=> null LIMIT 2 OFFSET 1",
    "SELECT filter(array(1, 2), x -> x > 1), map('a', 1)['a'], stack(1, 2), if(true, 1, 2), uuid() IS NULL"]


@pytest.fixture(scope="module")
def things(spark):
    from pyspark.sql import SparkSession
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.range(5).createOrReplaceTempView("five")
    own.sql("CREATE TABLE dst (a STRING) USING parquet LOCATION '" + scratch_path(spark, "dst") + "'")
    own.udf.register("mine", lambda x: x + 1, "long")
    own.udf.register("abs", lambda x: x, "long")  # stands in for Spark's own
    own.sql("CREATE TEMPORARY FUNCTION f2(x INT) RETURNS INT RETURN x + 1")
    yield own
    own.sql("DROP TABLE dst")


def test_refused_and_fine_statements(things):
    rows = relational.sql_batch(things, things.createDataFrame([(x,) for x in REFUSED + FINE], "sql string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sql, []).append(r)
    assert set(by) == set(REFUSED + FINE)
    for s in REFUSED:
        assert len(by[s]) == 1 and not by[s][0].ok and by[s][0].error.startswith("refused: "), s
    for s in FINE:
        assert all(r.ok for r in by[s]), (s, by[s][0].error)
    assert by[FINE[0]][0].row_json == '{"Insert":1,"t":"a\\nInsert x"}'
    assert by[FINE[1]][0].row_json == '{"s":"${spark.master}"}'  # no variable is read
    assert things.table("dst").count() == 0
    assert things._jvm.java.lang.System.getProperty("quarry.test") is None
    assert things.conf.get("spark.sql.variable.substitute") == "true"


def test_a_null_statement_and_functions_that_the_caller_allows(things):
    stmts = things.createDataFrame([(None,), ("SELECT max(mine(id)) AS m FROM five",)], "sql string")
    rows = {r.sql: r for r in relational.sql_batch(things, stmts, functions=("mine",)).collect()}
    assert rows[None].error == "refused: there is no statement" and not rows[None].ok
    assert rows["SELECT max(mine(id)) AS m FROM five"].row_json == '{"m":5}'


def test_reasons(things):
    assert sqlguard.why_refused(things, "SELECT 1") is None
    assert sqlguard.why_refused(things, "SHOW TABLES") == "only queries are run, no ShowTables"
    assert sqlguard.why_refused(things, "SELECT * FROM nope.c") == "there is no table nope.c"
    assert sqlguard.why_refused(things, f"SELECT {JM}") == "function java_method is not on the list"
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        sqlguard.why_refused(things, "SELEC 1")
