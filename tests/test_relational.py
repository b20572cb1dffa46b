from quarry.operators import relational
from quarry.session import scratch_path
from quarry.sources import files, tables


def test_sql_batch_errors_are_rows(spark, sf_small):
    tables.register_alert_views(spark, sf_small)
    texts = ["SELECT model_name, COUNT(alert_id) AS n FROM alerts_table GROUP BY model_name",
             "select nope from alerts_table", "SELECT 1 / 0 AS boom", "DROP TABLE alerts_table",
             "SELECT alert_id FROM alerts_table WHERE alert_id = 'none'"]
    stmts = spark.createDataFrame([(t,) for t in texts + texts[:1]], "sql string")
    by = {}
    for r in relational.sql_batch(spark, stmts).collect():
        by.setdefault(r.sql, []).append(r)
    assert all(r.ok for r in by[texts[0]]) and len(by[texts[0]]) == 5
    for t in texts[1:4]:
        assert len(by[t]) == 1 and not by[t][0].ok and by[t][0].error
    assert "nope" in by[texts[1]][0].error
    empty = by[texts[4]]
    assert len(empty) == 1 and empty[0].ok and empty[0].row_json is None


def test_catalog(spark, sf_small):
    tables.register_alert_views(spark, sf_small)
    t = {r.table_name: r for r in relational.catalog_tables(spark, ["alerts_table", "deals_table"]).collect()}
    assert t["alerts_table"].n_cols == 5 and t["deals_table"].n_rows > 0
    info = relational.catalog_info(spark, ["alerts_table"])
    text = relational.schema_text(info).first().schema_text
    assert text == "Table: alerts_table\nColumns: alert_id, alert_date, trader_id, deal_number, model_name"


def test_key_violations(spark, sf_small):
    d = tables.deals(spark, sf_small)
    assert files.key_violations(tables.alerts(spark, sf_small), "alert_id").count() == 0
    assert files.key_violations(d, "alert_id").count() > 0


def test_csv_crlf_and_vector_literals(spark, tmp_path):
    p = tmp_path / "deals.csv"
    p.write_bytes(b"alert_id,deal_date,price,vec\r\nx1,2023-01-02,10,\"[0.5, 2]\"\r\n"
                  b"x2,2023-12-28,20,\"[[1e-3, 4]]\"\r\n")
    df = files.scan_csv(spark, str(p), "alert_id string, deal_date date, price int, vec string")
    rows = df.select("alert_id", "price", files.parse_vector_literal("vec").alias("v")).orderBy("alert_id").collect()
    assert [(r.alert_id, r.price, r.v) for r in rows] == [("x1", 10, [0.5, 2.0]), ("x2", 20, [0.001, 4.0])]


def test_dense_ids(spark):
    df = spark.createDataFrame([(k,) for k in (50, 10, 40, 20, 30)], "k long").repartition(3)
    got = sorted((r.k, r.id) for r in files.dense_ids(df, "k").collect())
    assert got == [(10, 0), (20, 1), (30, 2), (40, 3), (50, 4)]


def test_sql_batch_reads_only_and_keeps_names_nulls_and_order(spark):
    spark.range(5).createOrReplaceTempView("five")
    spark.sql("CREATE TABLE IF NOT EXISTS dst (k BIGINT) USING parquet LOCATION '" + scratch_path(spark, "dst") + "'")
    refused = ["WITH z AS (SELECT 1 AS k) INSERT INTO dst SELECT * FROM z", "INSERT INTO dst VALUES (1)",
               "DROP VIEW five", "SET x = 1", "CREATE TABLE t2 AS SELECT 1", "CACHE TABLE five", "", "SELECT 1; DROP VIEW five"]
    fine = ["-- a comment\nSELECT id FROM five ORDER BY id DESC", "(SELECT 1 AS a)", "VALUES (1, 2)",
            "SELECT a.id, b.id, NULL AS x FROM five a JOIN five b ON a.id = b.id WHERE a.id = 3",
            "SELECT 'INSERT INTO dst' AS s", "WITH w AS (SELECT id FROM five) SELECT count(*) AS n FROM w"]
    rows = relational.sql_batch(spark, spark.createDataFrame([(x,) for x in refused + fine], "sql string"), page=4).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sql, []).append(r)
    assert set(by) == set(refused + fine)
    assert all(len(by[x]) == 1 and not by[x][0].ok and by[x][0].error for x in refused)
    assert all(r.ok for x in fine for r in by[x])
    assert [r.row_json for r in sorted(by[fine[0]], key=lambda r: r.row_no)] == [f'{{"id":{k}}}' for k in (4, 3, 2, 1, 0)]
    assert by[fine[3]][0].row_json == '{"id":3,"id_2":3,"x":null}'
    assert spark.table("dst").count() == 0 and spark.table("five").count() == 5
    spark.sql("DROP TABLE dst")


def test_result_text_is_bounded_and_never_cut(spark):
    import pytest
    df = spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    assert relational.result_text(df, ["k"]).first().result == '[{"k":1,"v":"x"}, {"k":2,"v":null}]'
    with pytest.raises(Exception, match="more than 1 rows"):
        relational.result_text(df, ["k"], max_rows=1).collect()


def test_calls_that_share_their_results_run_a_statement_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1,), (2,)], "a long").createOrReplaceTempView("shared_results")
    one, two, bad = "SELECT a FROM shared_results ORDER BY a", "SELECT 7 AS b", "SELECT nope FROM shared_results"
    ran, write = [], relational._write_result
    monkeypatch.setattr(relational, "_write_result", lambda s, sql, path: (ran.append(sql), write(s, sql, path)))

    def batch(*texts, results=str(tmp_path / "results")):
        res = relational.sql_batch(spark, spark.createDataFrame([(x,) for x in texts], "sql string"), results=results)
        return sorted((r.sql, r.ok, r.row_no, r.row_json) for r in res.collect() if r.ok) + sorted(r.sql or "" for r in res.collect() if not r.ok)

    first, second = batch(one, bad, None), batch(one, one, two, bad, None)
    assert sorted(ran) == sorted([one, two, bad])
    assert first == [(one, True, 0, '{"a":1}'), (one, True, 1, '{"a":2}'), "", bad]  # only what a call asks for
    assert second == sorted([*first[:2], (two, True, 0, '{"b":7}')]) + ["", bad]
    assert second == batch(one, one, two, bad, None, results=None) and batch(bad) == [bad]
    # rows of a call that was lost before they were listed are not taken
    write(spark, one, str(tmp_path / "results" / "rows" / "stmt_id=5"))
    assert batch(one, two) == second[:3]
