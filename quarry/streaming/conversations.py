"""Structured Streaming over arriving conversation turns.

* :func:`stream_route` - stateless: the batch functions (tool-call
  derivation, JSON parsing, routing) applied to a file stream.
* :func:`stream_history` - stateful: per-conversation history kept between
  micro-batches as list state (``transformWithState``); late turns are put in
  order, turns that never come expire.

Both write to a file sink with a checkpoint in the shared checkpoint folder
(exactly-once, restartable after executor or driver loss) and run with
``trigger(availableNow=True)`` so a backlog is processed and the query ends.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import toolcalls
from ..session import scratch_path
from ..sources import derived, tables

CONVERSATION_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def conversation_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Turns as files land in a table's folder; without a limit a micro-batch
    takes all files that have arrived."""
    r = spark.readStream.schema(CONVERSATION_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    path = tables.table_path(sf_dir, "conversations")
    return r.parquet(path)


def route_frame(conv: DataFrame) -> DataFrame:
    """The same DataFrame function serves batch and stream."""
    routed = toolcalls.route_tool_call(toolcalls.parse_tool_call(derived.tool_calls(conv)))
    return routed.select("conv_id", "turn", "call_no", "call_id", "name", "args_ok", "route", "reply")


def _run_to_files(df: DataFrame, name: str, output_mode: str = "append") -> str:
    spark = df.sparkSession
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    q = (df.writeStream.format("parquet").outputMode(output_mode)
         .option("path", out).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out


def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run_to_files(route_frame(conversation_stream(spark, sf_dir)), "route")
    return spark.read.parquet(out)


HISTORY_OUT = "conv_id bigint, turn bigint, n_messages int, history string, error string"
MESSAGE_STATE = "turn bigint, role string, content string"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _place(entry):
    """Order of ``(turn, role, content)``: null first as in Spark."""
    return tuple(x for v in entry for x in (v is not None, v if v is not None else ""))


class HistoryProcessor(StatefulProcessor):
    """Keeps a conversation's messages as a list that grows by appends, those
    that wait for an earlier turn in another, and the turn that is due."""

    def __init__(self, system_prompt: str | None, first_turn: int = 0, expire_ms: int | None = None):
        self.system = [{"role": "system", "content": system_prompt}] if system_prompt is not None else []
        self.first_turn, self.expire_ms = first_turn, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getListState("shown", MESSAGE_STATE)
        self.waiting = handle.getListState("waiting", MESSAGE_STATE)
        self.due = handle.getValueState("due", "turn bigint")

    def _state(self):
        read = lambda s: [tuple(e) for e in s.get()] if s.exists() else []
        due = self.due.get()[0] if self.due.exists() else self.first_turn
        return sorted(read(self.shown), key=_place), read(self.waiting), due

    def _show(self, conv_id, hist: list, entries: list, error: str | None = None):
        """Rows of messages that are due, each put at its place in ``hist``."""
        for e in sorted(entries, key=_place):
            at = bisect_right(hist, _place(e), key=_place)
            hist.insert(at, e)
            shown = self.system + [{"role": r, "content": x} for _, r, x in hist[:at + 1]]
            yield Row(conv_id=conv_id, turn=e[0], n_messages=len(shown),
                      history=json.dumps(shown, ensure_ascii=False, separators=(",", ":")), error=error)
        if entries:
            self.shown.appendList(sorted(entries, key=_place))

    def _keep(self, waiting: list, before: list, due: int, timer_values) -> None:
        if waiting != before:
            if waiting:
                self.waiting.put(waiting)
            else:
                self.waiting.clear()
        self.due.update((due,))
        if self.expire_ms is not None and (not waiting or not before or waiting[0] != before[0]):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if waiting:
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.expire_ms)

    def handleInputRows(self, key, rows, timerValues):
        hist, before, due = self._state()
        seen, waiting = set(hist) | set(before), list(before)
        for r in rows:
            e = (r["turn"], r["role"], r["text"])
            if e not in seen:  # a message delivered again is not shown again
                seen.add(e)
                waiting.append(e)
        come = {e[0] for e in waiting}
        while due in come:
            due += 1
        ready = [e for e in waiting if e[0] is None or e[0] < due]
        waiting = sorted((e for e in waiting if e[0] is not None and e[0] >= due), key=_place)
        yield from self._show(key[0], hist, ready)
        self._keep(waiting, before, due, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """What waits for a turn that does not come is shown with an error; the
        turns after it go on from there."""
        hist, before, due = self._state()
        if before:
            missing, come, last = due, {e[0] for e in before}, min(e[0] for e in before)
            while last in come:
                last += 1
            ready = [e for e in before if e[0] < last]
            yield from self._show(key[0], hist, ready, f"turn {missing} did not come")
            self._keep(sorted((e for e in before if e[0] >= last), key=_place), [], last, timerValues)

    def close(self) -> None:
        pass


def history_frame(conv: DataFrame, system_prompt: str | None, first_turn: int = 0, expire_ms: int | None = None) -> DataFrame:
    """History at each turn, in turn order whatever order turns arrive in: a turn
    is held in state until all turns before it have come, then its history is
    emitted once, ``(conv_id, turn, n_messages, history, error)``.  Turns count
    from ``first_turn`` without gaps.

    What comes after a missing turn waits for it.  With ``expire_ms`` it waits
    that long in processing time; then it is emitted in order with the ``error``
    that the turn did not come, and later turns go on from there (see
    :func:`state_on_disk` for when that is).

    Different messages of one turn have a row each, in the order of role and
    text as in the batch query.  One that comes after its turn was emitted gets
    its row then and stands at its place in all histories emitted later; rows
    already emitted do not change.  A message without a turn waits for nothing
    and stands before all others, as in the batch query.  A message equal in
    turn, role and text to an earlier one is a repeated delivery and is shown
    once, where the batch query shows each row."""
    return conv.groupBy("conv_id").transformWithState(
        HistoryProcessor(system_prompt, first_turn, expire_ms), HISTORY_OUT, "append",
        "none" if expire_ms is None else "processingTime")


@contextmanager
def state_on_disk(spark: SparkSession):
    """Settings that a stream with list state reads when it starts; they are put
    back afterwards.  The state store is the one that keeps lists on disk.  With
    timers Spark would follow each batch by another one without data, for ever,
    so a run over what is available never ended; without such batches a timer
    that has run out is served by the next batch that brings rows."""
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKS_DB,
                "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_history(spark: SparkSession, sf_dir: str,
                   system_prompt: str | None = toolcalls.DEFAULT_SYSTEM_PROMPT,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Per-conversation history at each arriving turn, kept in state keyed by
    ``conv_id`` (one list per conversation, never one global list)."""
    stream = conversation_stream(spark, sf_dir, max_files_per_trigger)
    with state_on_disk(spark):
        out = _run_to_files(history_frame(stream, system_prompt), "history")
    return spark.read.schema(HISTORY_OUT).parquet(out).drop("error")


LANDED_CLASSES = 4


def files_per_class(spark: SparkSession, files: int = LANDED_CLASSES) -> int:
    """Files of each class of turns: all classes together follow the session's
    shuffle width."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // files)


def landed_in_files(spark: SparkSession, sf_dir: str, files: int = LANDED_CLASSES) -> str:
    """A copy of the conversations in which a conversation's turns lie in
    different files, so that several micro-batches must carry state over.

    Turns are dealt to ``files`` classes by ``turn % files``, which land one
    after the other.  A class is written by ``files_per_class`` tasks, a row's
    task following from its conversation and turn, so a large conversation is
    spread over all of them."""
    to = scratch_path(spark, "landed")
    conv = tables.load(spark, sf_dir, "conversations")
    of = F.coalesce(F.pmod(F.col("turn"), F.lit(files)), F.lit(0))
    for k in range(files):
        (conv.where(of == k).repartition(files_per_class(spark, files), "conv_id", "turn")
         .write.mode("append").parquet(tables.table_path(to, "conversations")))
    return to
