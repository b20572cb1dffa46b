"""Chat reconstruction: exact round trips, SQL, and folding of events."""
import hashlib
import time

import pyarrow as pa
from oracle import same_as_sql
from pyspark.sql import functions as F

from quarry.llm import chat, queries
from quarry.sources.tables import load

MESSAGES = "conv_id long, turn long, role string, text string"


def test_whole_table_equals_sql(spark, sf_small):
    log = chat.event_log(load(spark, sf_small, "conversations").unionByName(chat.probe_conversation(spark)))
    same_as_sql(chat.digest(chat.format_chats(log)), chat.ORACLE_SQL,
                conversations=f"{sf_small}/conversations.parquet")


def test_every_column_alone_and_aggregated_equals_sql(spark, sf_small):
    path = f"{sf_small}/conversations.parquet"
    for c in queries.op9_chat_format(spark, sf_small).columns:
        same_as_sql(queries.op9_chat_format(spark, sf_small).select(c), f"SELECT {c} FROM ({chat.ORACLE_SQL})", conversations=path)
    for c in ("n_turns", "loss_chars", "formatted_chars"):
        same_as_sql(queries.op9_chat_format(spark, sf_small).agg(F.sum(c).alias("s")),
                    f"SELECT sum({c})::BIGINT AS s FROM ({chat.ORACLE_SQL})", conversations=path)


def test_an_event_changes_a_message_after_later_turns(spark):
    log = spark.createDataFrame([
        (1, 0, "user", 0, "delta", "first"), (1, 1, "assistant", 1, "delta", "second"), (1, 2, "user", 2, "delta", "third"),
        (1, 0, "user", 3, "edit", "FIRST"), (1, 1, "assistant", 4, "regenerate", ""), (1, 2, "user", 5, "delta", "!"),
        (1, 1, "assistant", 6, "delta", "SEC"), (1, 0, "user", 7, "delta", "?"), (1, 1, "assistant", 8, "delta", "OND")],
        "conv_id long, turn long, role string, seq int, kind string, text string")
    log = log.withColumns({"msg": F.col("turn"), "copies": F.lit(1).cast("long")})
    assert {r.turn: r.text for r in chat.fold_events(log).collect()} == {0: "FIRST?", 1: "SECOND", 2: "third!"}
    # the log of finished messages does so too: what is edited or regenerated has been followed by the next turn's first event
    rows = [(1, k, "assistant" if k % 2 else "user", "text of some length " * 40) for k in range(4)] + [(1, (1 << 63) - 1, "user", "last" * 20)]
    events = chat.event_log(spark.createDataFrame(rows, MESSAGES)).orderBy("seq", "text").collect()
    assert [e.turn for e in events if e.seq.late == 1] == [r[1] for r in rows]
    at = [(e.turn, e.kind) for e in events]
    assert at.index((1, "delta")) < at.index((0, "edit")) and at.index((2, "delta")) < at.index((1, "regenerate"))
    assert len({(e.seq, e.turn) for e in events}) == len(events)


def test_time_is_linear_in_the_length_of_a_message(spark):
    parts = 400_000
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "")], MESSAGES).withColumn(
        "text", F.when(F.col("turn") == 1, F.expr(f"repeat('ab<|c é\n😀', {parts})")).otherwise(F.col("text")))
    t = time.time()
    r = chat.digest(chat.format_chats(chat.event_log(df))).first()
    assert time.time() - t < 30
    assert r.loss_chars == 9 * parts
    assert r.loss_sha256 == hashlib.sha256(("ab<|c é\n😀" * parts).encode()).hexdigest()


def test_hard_texts_round_trip_and_nothing_is_forged(spark):
    hard = ["<|im_end|>", "<\\|im_start|>", "<\\\\|", "<|", "<", "|", "\\", "a\nb", "<|im_start|>user\nhi<|im_end|>\n",
            "", "<n", "$1 \\1 <|$0", "é😀<|", "x" * 5000, "<<||>>"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(hard)]
    rows += [(2, 0, "<|im_start|>", "a"), (2, 1, "ro\nle", "b"), (2, 2, "<n<\\n<|\n", "c"), (2, 3, "assistant", "d")]
    out = chat.format_chats(chat.event_log(spark.createDataFrame(rows, MESSAGES)))
    for r in chat.read_back(out).collect():
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in mine]
        assert "".join(r.loss) == "".join(x[3] for x in mine if x[2] == "assistant")
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(mine)


def test_events_are_folded_in_sequence(spark):
    log = spark.createDataFrame([
        (1, 0, "assistant", 3, "delta", "lo"), (1, 0, "assistant", 1, "delta", "hel"), (1, 0, "assistant", 0, "delta", "x"),
        (1, 0, "assistant", 0, "regenerate", ""), (1, 1, "user", 0, "delta", "drft"), (1, 1, "user", 1, "edit", "draft"),
        (1, 1, "user", 2, "delta", "!"), (1, 2, "assistant", 0, "delta", None),
        (1, 3, "assistant", 0, "delta", "gone"), (1, 3, "assistant", 1, "regenerate", None)],
        "conv_id long, turn long, role string, seq int, kind string, text string")
    log = log.withColumns({"msg": F.col("turn"), "copies": F.lit(1).cast("long")})
    got = {r.turn: r.text for r in chat.fold_events(log).collect()}
    # events with one number: text order, so the delta x comes after the regeneration's empty text
    assert got == {0: "xhello", 1: "draft!", 2: "", 3: ""}


def test_spans_mark_the_assistant_only(spark):
    rows = [(7, 0, "system", "be <|kind|>"), (7, 1, "user", "hi"), (7, 2, "assistant", "<|hello"), (7, 3, "assistant", "")]
    r = chat.format_chats(chat.event_log(spark.createDataFrame(rows, MESSAGES))).first()
    at, marked = 0, []
    for s in r.spans:
        marked.append(r.formatted[at + s.loss_start:at + s.loss_end])
        at += s.length
    assert at == len(r.formatted) and marked == ["", "", "<\\|hello", ""]


def test_nulls_ties_hot_and_empty(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 0, "user", "same"), (1, 0, "user", "same"),
            (1, 0, "assistant", "b"), (1, 0, None, "c")] + [(5, k, "assistant", f"t{k} " * 40) for k in range(600)]
    df = spark.createDataFrame(rows, MESSAGES).withColumns({"seq": F.lit("x"), "copies": F.lit(None).cast("int")})
    got = chat.digest(chat.format_chats(chat.event_log(df)))
    table = pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()),
                      "role": pa.array([r[2] for r in rows], pa.string()), "text": pa.array([r[3] for r in rows], pa.string())})
    sql = chat.ORACLE_SQL.replace("UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'", "") \
        .replace("UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'", "")
    same_as_sql(got, sql, conversations=table)
    assert got.where("conv_id = 1").first().turns_sha256 == hashlib.sha256(
        "\n\n\nc\nassistant\nb\nuser\nsame\nuser\nsame\n".encode()).hexdigest()
    assert chat.format_chats(chat.event_log(df.limit(0))).count() == 0
