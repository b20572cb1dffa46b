"""The tool loop inside a stream: turns arrive, their tool calls are routed, SQL
is run, questions are answered, and all messages are appended.

Each micro-batch runs through the same functions as a batch job and writes to a
folder named by its batch id.  A batch that was lost half-way has the same id
and the same turns when the stream is restarted, and overwrites what it left, so
each answer stands in the output once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import context, embed, toolcalls
from ..session import scratch_path, stored
from ..sources import derived, files
from .conversations import CONVERSATION_SCHEMA, conversation_stream

ANSWER_SCHEMA = "conv_id bigint, turn bigint, seq int, role string, call_id string, content string"


def document_index(docs: DataFrame) -> tuple[str, StructType]:
    """``(id, text, embedding)`` of ``docs(id, text)``, stored once for all
    batches: its folder and schema."""
    index = embed.hashed_embedding(docs, "id", "text", carry=("text",))
    return files.vector_index_save(index, scratch_path(docs.sparkSession, "doc-index")), index.schema


def replies(conv: DataFrame, docs: DataFrame, doc_vectors: DataFrame | None = None,
            sql_results: str | None = None) -> DataFrame:
    """Turns ``(conv_id, turn, role, text)`` and what their tool calls add:
    ``ANSWER_SCHEMA`` rows.  SQL of the calls is run and its result becomes a
    tool message; retrieval questions are answered from ``docs(id, text)``.
    Calls are parsed and routed once and stored, since every step below reads
    them.  ``sql_results``: see ``relational.sql_batch``."""
    routed = toolcalls.route_tool_call(toolcalls.parse_tool_call(derived.tool_calls(conv)))
    routed = stored(routed.select("conv_id", "turn", "call_no", "call_id", "route", "reply"), "routed")
    qid = F.col("conv_id") * 1_000_000 + F.col("turn") * 10 + F.col("call_no")
    asked = routed.where(F.col("route") == "retrieval").select(qid.alias("qid"), "call_id", F.col("reply").alias("question"))
    answers = context.first_lines(asked, docs, corpus_vectors=doc_vectors).join(asked, "qid").select("call_id", "answer")
    results, _rows = toolcalls.sql_tool_answer(conv.sparkSession, routed, kept=sql_results)
    return toolcalls.append_reply(conv, routed, answers, results)


def answer_batch(index, out: str, sql_results: str | None = None):
    """The function that a stream calls for each micro-batch."""
    index_path, index_schema = index

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        turns = f"{out}-turns/batch_id={batch_id}"  # read once from the source, several times from here
        batch.write.mode("overwrite").parquet(turns)
        conv = spark.read.schema(CONVERSATION_SCHEMA).parquet(turns)
        known = spark.read.schema(index_schema).parquet(index_path)
        said = replies(conv, known.select("id", "text"), known.select("id", "embedding"), sql_results)
        said.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in ANSWER_SCHEMA.split(", ")]) \
            .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return run


def run_answers(stream: DataFrame, index, out: str, checkpoint: str) -> None:
    """Answer all turns that ``stream`` has; called again with the same
    ``checkpoint`` it goes on where the last run stopped or was lost.  A run
    takes the turns that are there when it starts, and each distinct statement
    of theirs is run once in it, whatever micro-batches hold it, as in the batch
    query; the next run runs its statements anew."""
    answer = answer_batch(index, out, scratch_path(stream.sparkSession, "sql-results"))
    q = (stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_answers(spark: SparkSession, sf_dir: str, docs: DataFrame, max_files_per_trigger: int | None = None) -> DataFrame:
    """The whole loop over the conversations that land in ``sf_dir``.  Views that
    the statements name must be registered before."""
    out, checkpoint = scratch_path(spark, "answers-out"), scratch_path(spark, "answers-ckpt")
    run_answers(conversation_stream(spark, sf_dir, max_files_per_trigger), document_index(docs), out, checkpoint)
    return spark.read.schema(ANSWER_SCHEMA).parquet(out).select(*[f.split()[0] for f in ANSWER_SCHEMA.split(", ")])
