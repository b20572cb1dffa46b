import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import toolcalls
from quarry.plans import queries as Q
from quarry.session import scratch_path
from quarry.sources import tables
from quarry.streaming import answers as A, conversations as S


def test_stream_route_equals_batch(spark, sf_small):
    stream = S.stream_route(spark, S.landed_in_files(spark, sf_small)).select("call_id", "route", "reply")
    batch = Q.q_route_tool_call(spark, sf_small)
    assert sorted(stream.collect()) == sorted(batch.collect())


def test_stream_history_equals_batch_over_several_micro_batches(spark, sf_small):
    landed = S.landed_in_files(spark, sf_small, files=4)
    stream = S.stream_history(spark, landed, max_files_per_trigger=1)
    conv = tables.load(spark, sf_small, "conversations")
    batch = toolcalls.conversation_history(conv).select("conv_id", "turn", "n_messages", F.to_json("history").alias("history"))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_late_turns_wait_and_are_shown_in_order(spark, tmp_path):
    path = tmp_path / "conversations.parquet"
    for turns in ([0, 2], [3], [1, 1], [5]):
        spark.createDataFrame([(1, t, "user", "abcdef"[t]) for t in turns],
                              S.CONVERSATION_SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    rows = S.stream_history(spark, str(tmp_path), None, max_files_per_trigger=1).orderBy("turn").collect()
    assert [(r.turn, r.n_messages) for r in rows] == [(0, 1), (1, 2), (2, 3), (3, 4)]  # 5 waits for 4
    assert [m["content"] for m in __import__("json").loads(rows[-1].history)] == ["a", "b", "c", "d"]


def _landed(spark, tmp_path, parts):
    path = str(tmp_path / "conversations.parquet")
    for rows in parts:
        spark.createDataFrame([(1, *r) for r in rows], S.CONVERSATION_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = S.stream_history(spark, str(tmp_path), None, max_files_per_trigger=1)
    return sorted(map(tuple, stream.collect()))


def test_messages_of_one_turn_have_a_row_each_as_in_the_batch_query(spark, tmp_path):
    parts = [[(0, "user", "a"), (2, "user", "d")], [(2, "tool", "c"), (2, None, "x")], [(1, "user", "b2"), (1, "user", "b1")]]
    conv = spark.createDataFrame([(1, *r) for rows in parts for r in rows], S.CONVERSATION_SCHEMA)
    for block in (None, 2):
        batch = toolcalls.conversation_history(conv, None, block_turns=block).select(
            "conv_id", "turn", "n_messages", F.to_json("history", {"ignoreNullFields": "false"}).alias("history"))
        want = sorted(map(tuple, batch.collect()))
        assert len(want) == 6
        got = _landed(spark, tmp_path / str(block), parts)
        assert got == want


def test_a_second_message_after_its_turn_stands_in_later_histories(spark, tmp_path):
    got = _landed(spark, tmp_path, [[(0, "user", "a")], [(1, "user", "c"), (0, "user", "b"), (0, "user", "a")], [(0, "user", "a")]])
    assert [(t, [m["content"] for m in __import__("json").loads(h)]) for _, t, _, h in got] == [
        (0, ["a"]), (0, ["a", "b"]), (1, ["a", "b", "c"])]


def test_landed_copy_follows_the_shuffle_width(spark, tmp_path, monkeypatch):
    conv = spark.range(400).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "string(id) AS text").unionByName(
        spark.createDataFrame([(None, None, "user", "z"), (2, -1, "user", "y")], S.CONVERSATION_SCHEMA))
    conv.write.parquet(str(tmp_path / "conversations.parquet"))
    landed = tables.load(spark, S.landed_in_files(spark, str(tmp_path)), "conversations")
    assert sorted(map(str, landed.collect())) == sorted(map(str, conv.collect()))
    assert S.files_per_class(spark) == 2
    files = landed.where("conv_id = 1").groupBy(F.input_file_name().alias("f")).agg(
        F.count_distinct(F.expr("turn % 4")).alias("classes"), F.count("*").alias("n")).collect()
    assert len(files) == 8  # one conversation, all tasks
    assert all(r.classes == 1 and r.n < 100 for r in files)


def test_messages_without_a_turn_stand_first_as_in_the_batch_query(spark, tmp_path):
    parts = [[(None, "user", "n2"), (0, "user", "a"), (None, "user", "n1")], [(1, None, None)], [(2, "user", "c")]]
    conv = spark.createDataFrame([(1, *r) for rows in parts for r in rows], S.CONVERSATION_SCHEMA)
    batch = toolcalls.conversation_history(conv, None, block_turns=None).select(
        "conv_id", "turn", "n_messages", F.to_json("history", {"ignoreNullFields": "false"}).alias("history"))
    key = lambda r: (r[2], r[3])
    path = str(tmp_path / "conversations.parquet")
    for rows in parts:
        spark.createDataFrame([(1, *r) for r in rows], S.CONVERSATION_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got = S.stream_history(spark, str(tmp_path), None, max_files_per_trigger=1).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, batch.collect()), key=key) and len(got) == 5


def test_a_turn_that_never_comes_expires_into_an_error(spark, tmp_path):
    path, out, ckpt = (str(tmp_path / n) for n in ("conversations.parquet", "out", "ckpt"))

    def land(*rows):
        spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], S.CONVERSATION_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        with S.state_on_disk(spark):
            q = (S.history_frame(S.conversation_stream(spark, str(tmp_path)), None, expire_ms=1).writeStream.format("parquet")
                 .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
            q.awaitTermination()
        rows = spark.read.schema(S.HISTORY_OUT).parquet(out).collect()
        return sorted((r.conv_id, r.turn, [m["content"] for m in json.loads(r.history)], r.error) for r in rows)

    land((1, 0, "a"), (1, 2, "c"), (1, 3, "d"), (1, 6, "g"), (2, 0, "x"))
    got = land((2, 1, "y"))  # another conversation: the first one's timer has run out
    late = "turn 1 did not come"
    assert got[:3] == [(1, 0, ["a"], None), (1, 2, ["a", "c"], late), (1, 3, ["a", "c", "d"], late)]
    assert [r for r in got if r[0] == 2] == [(2, 0, ["x"], None), (2, 1, ["x", "y"], None)]
    got = land((1, 4, "e"), (1, 5, "f"))  # turns go on after the gap, by themselves or when the next timer runs out
    assert [r[1] for r in got if r[0] == 1] == [0, 2, 3, 4, 5, 6]
    got = land((1, 1, "b"), (3, 0, "z"))  # it comes after all: its row, and its place in what is emitted later
    got = land((1, 7, "h"))
    assert (1, 1, ["a", "b"], None) in got and (1, 7, list("abcdefgh"), None) in got
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


class _State:
    def __init__(self, log):
        self.rows, self.log = None, log

    def exists(self):
        return self.rows is not None

    def get(self):
        return self.rows if isinstance(self.rows, tuple) else iter(self.rows)

    def put(self, rows):
        self.log.append(("put", len(rows)))
        self.rows = list(rows)

    def appendList(self, rows):
        self.log.append(("append", len(rows)))
        self.rows = (self.rows or []) + list(rows)

    def update(self, value):
        self.rows = value

    def clear(self):
        self.rows = None


def test_state_grows_by_appends():
    p = S.HistoryProcessor(None)
    shown, waiting = [], []
    p.handle, p.shown, p.waiting, p.due = None, _State(shown), _State(waiting), _State([])
    for some in ([0, 1, 2], [4], [3], [5]):
        list(p.handleInputRows((1,), iter([{"turn": t, "role": "u", "text": str(t)} for t in some]), None))
    assert shown == [("append", 3), ("append", 2), ("append", 1)]  # nothing shown is written again
    assert waiting == [("put", 1)] and p.due.get() == (6,)


def test_answers_in_the_stream_equal_the_batch_also_after_a_lost_batch(spark, sf_small, monkeypatch):
    tables.register_alert_views(spark, sf_small)
    docs = tables.load(spark, sf_small, "documents").select(F.col("doc_id").alias("id"), "text")
    landed = S.landed_in_files(spark, sf_small)
    index, out, ckpt = A.document_index(docs), scratch_path(spark, "answers"), scratch_path(spark, "answers-ckpt")
    stream = lambda: S.conversation_stream(spark, landed, S.files_per_class(spark))
    real, calls = A.replies, []

    def lost(conv, *rest):
        calls.append(1)
        said = real(conv, *rest)
        if len(calls) == 2:  # half of the second batch is written, then the job is lost
            said.limit(20).write.mode("overwrite").parquet(f"{out}/batch_id=1")
            raise RuntimeError("lost")
        return said

    monkeypatch.setattr(A, "replies", lost)
    with pytest.raises(Exception, match="lost"):
        A.run_answers(stream(), index, out, ckpt)
    A.run_answers(stream(), index, out, ckpt)
    assert len(calls) == 1 + 4
    columns = [f.split()[0] for f in A.ANSWER_SCHEMA.split(", ")]
    got = spark.read.schema(A.ANSWER_SCHEMA).parquet(out).select(*columns)
    want = real(tables.load(spark, sf_small, "conversations"), docs).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_all_batches_of_a_run_share_their_sql_results(spark, sf_small, monkeypatch):
    docs = spark.createDataFrame([(1, "some text")], "id long, text string")
    landed, index = S.landed_in_files(spark, sf_small), A.document_index(docs)
    folders = []

    def noted(conv, docs, vectors, sql_results):
        folders.append(sql_results)
        none = F.lit(None).cast("string")
        return conv.select("conv_id", "turn", F.lit(0).alias("seq"), "role", none.alias("call_id"), F.col("text").alias("content"))

    monkeypatch.setattr(A, "replies", noted)
    for _ in range(2):
        A.run_answers(S.conversation_stream(spark, landed, S.files_per_class(spark)), index,
                      scratch_path(spark, "answers"), scratch_path(spark, "answers-ckpt"))
    assert len(folders) == 2 * 4 and None not in folders
    assert len(set(folders[:4])) == len(set(folders[4:])) == 1 and folders[0] != folders[4]  # a new run asks anew
