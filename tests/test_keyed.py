import pytest
from pyspark.sql import types as T

from quarry.session import scratch_path
from quarry.sources.keyed import KeyedTable

SCHEMA = T.StructType().add("k", "long").add("v", "string").add("n", "integer")


@pytest.fixture
def table(spark):
    return KeyedTable(spark, scratch_path(spark, "keyed"), SCHEMA, "k")


def frame(spark, *rows):
    return spark.createDataFrame([(*r, None) for r in rows], SCHEMA)


def seen(table):
    return sorted((r.k, r.v) for r in table.rows().collect()), sorted((r.k or 0, r.v, r.reason) for r in table.rejects().collect())


def test_a_key_lands_once_and_rejects_are_kept(spark, table):
    assert seen(table) == ([], [])
    assert table.insert(frame(spark, (1, "a"), (2, "b"), (2, "a"), (None, "x")), "one")
    assert seen(table) == ([(1, "a"), (2, "a")], [(0, "x", "no key"), (2, "b", "key repeated in the batch")])
    assert table.insert(frame(spark, (2, "z"), (3, "c"), (3, "c")), "two")
    rows, rejects = seen(table)
    assert rows == [(1, "a"), (2, "a"), (3, "c")]
    assert rejects[1:] == [(2, "b", "key repeated in the batch"), (2, "z", "key exists"), (3, "c", "key repeated in the batch")]
    assert {(r.batch_id, r.n_rows, r.n_rejected) for r in table.commits().collect()} == {("one", 2, 2), ("two", 1, 2)}


def test_a_batch_sent_twice_adds_its_rows_once(spark, table):
    assert table.insert(frame(spark, (1, "a"), (2, "b")), "one")
    before = seen(table)
    assert not table.insert(frame(spark, (1, "a"), (2, "b")), "one")
    assert seen(table) == before
    table.insert(spark.createDataFrame([], SCHEMA), "none")  # an empty batch is a batch
    assert seen(table) == before and table.commits().count() == 2


def test_a_killed_write_adds_nothing(spark, table, monkeypatch):
    table.insert(frame(spark, (1, "a")), "one")
    two = frame(spark, (2, "b"), (3, "c"), (1, "z"))
    # killed after the rows were written, before the commit
    commits = KeyedTable.commits
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            table.insert(two, "two")
    assert seen(table) == ([(1, "a")], []) and commits(table).count() == 1
    # rows of the lost batch are no keys: another batch may bring them, and the lost one may come again
    assert table.insert(frame(spark, (3, "other")), "three")
    assert table.insert(two, "two")
    rows, rejects = seen(table)
    assert rows == [(1, "a"), (2, "b"), (3, "other")]
    assert rejects == [(1, "z", "key exists"), (3, "c", "key exists")]


def test_names_of_batches_and_keys(spark, table):
    for bad in ("", "a/b", "a=b"):
        with pytest.raises(ValueError):
            table.insert(frame(spark), bad)
    with pytest.raises(ValueError):
        KeyedTable(spark, "x", SCHEMA, "nope")
