"""Conversations and tool calls: history per turn, JSON argument parsing,
routing, replies, instruction lookup, and SQL tool answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import relational

# The argument that each tool needs.
TOOL_ARGUMENT = {"get_information": "information", "ask_database": "query",
                 "Answer_generic_questions": "message"}
# Parameters with defaults of our own.
DEFAULT_SYSTEM_PROMPT = "You are a service assistant. Call one tool per message."
NO_ANSWER = "No article answers this."
DEFAULT_INSTRUCTIONS = [
    ("get_query", "Ask for the scenario, then offer the SQL query."),
    ("get_information", "Answer from the documents and offer further help."),
    ("ask_database", "Answer with one SQL query over the alert and deal tables."),
]


def explode_tool_calls(messages: DataFrame, calls_col: str = "tool_calls") -> DataFrame:
    """One row per tool call of a message whose ``calls_col`` is
    ``array<struct<id, name, arguments>>`` (a message may hold several);
    ``call_no`` keeps their order.  Messages without calls yield no rows."""
    keep = [c for c in messages.columns if c != calls_col]
    return (messages.select(*keep, F.posexplode(calls_col).alias("call_no", "_c"))
            .select(*keep, "call_no", F.col("_c.id").alias("call_id"),
                    F.col("_c.name").alias("name"), F.col("_c.arguments").alias("arguments")))


def parse_tool_call(calls: DataFrame, args_col: str = "arguments", name_col: str = "name") -> DataFrame:
    """Decode JSON arguments (never ``eval``).

    ``args_ok`` asks for one JSON object, parsed to its end, that holds the
    argument of the named tool as a string (an unknown tool needs none).  A
    field is null if the text is no such object or the field is no string.
    """
    # Parsers stop at the end of the first value.  Inside an array that a mark of
    # the text itself ends, anything after the object shows.
    mark = F.md5(F.col(args_col))
    whole = F.from_json(F.concat(F.lit("["), F.col(args_col), F.lit(',"'), mark, F.lit('"]')), "array<string>")
    alone = (F.size(whole) == 2) & (F.get(whole, F.lit(1)) == mark)
    value = F.try_parse_json(F.when(alone, F.col(args_col)))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    out = calls.withColumns({"_v": value, "_ok": is_object})

    def field(key):
        one = F.try_variant_get(F.col("_v"), f"$.{key}", "variant")
        return F.when(F.col("_ok") & (F.schema_of_variant(one) == "STRING"), F.try_variant_get(F.col("_v"), f"$.{key}", "string"))

    keys = list(dict.fromkeys(TOOL_ARGUMENT.values()))
    out = out.select("*", *[field(k).alias(k) for k in keys])
    need = F.lit(True)
    for tool, key in TOOL_ARGUMENT.items():
        need = F.when(F.col(name_col) == tool, F.col(key).isNotNull()).otherwise(need)
    return out.withColumn("args_ok", F.col("_ok") & need).select(*calls.columns, "args_ok", *keys)


def route_tool_call(parsed: DataFrame, name_col: str = "name") -> DataFrame:
    """``route`` and ``reply`` per call: retrieval question, SQL text, or a
    direct message; unknown tools and malformed arguments go to ``error`` with
    a text.  ``reply`` is never null."""
    n = F.col(name_col)
    known = F.coalesce(n.isin(*TOOL_ARGUMENT), F.lit(False))
    route = F.lit("error")
    reply = F.concat(F.lit("Error: function "), F.coalesce(n, F.lit("without a name")), F.lit(" does not exist"))
    for tool, to in (("get_information", "retrieval"), ("ask_database", "sql"), ("Answer_generic_questions", "message")):
        route = F.when(n == tool, F.lit(to)).otherwise(route)
        reply = F.when(n == tool, F.col(TOOL_ARGUMENT[tool])).otherwise(reply)
    bad = known & ~F.col("args_ok")
    return parsed.select(
        "*", F.when(bad, F.lit("error")).otherwise(route).alias("route"),
        F.when(bad, F.concat(F.lit("Error: malformed arguments for "), n)).otherwise(reply).alias("reply"))


def conversation_history(conv: DataFrame, system_prompt: str | None = DEFAULT_SYSTEM_PROMPT,
                         key: str = "conv_id", order: str = "turn", role: str = "role",
                         text: str = "text", block_turns: int | None = 64) -> DataFrame:
    """Messages visible at each turn: the system prompt, then every turn up to
    and including this one, in order.  ``(conv_id, turn, n_messages,
    history)``.  Rows of one turn follow each other by role and text.

    With ``block_turns = None``: one window per conversation with a growing
    frame.  With ``block_turns = B``: turns are cut into blocks of ``B``; a turn's
    history is the messages of all earlier blocks followed by a running list
    inside its own ``(conversation, block)`` partition.  Each block lists the
    numbers of its earlier blocks, fetches their messages by (conversation,
    number) and gathers them by (conversation, block), so a conversation holding
    a large share of all turns is spread over many tasks.  One task sees a
    conversation whole only to number its blocks.  The output itself is
    quadratic in a conversation's length by definition.
    """
    msg = F.struct(F.col(role).alias("role"), F.col(text).alias("content"))
    if block_turns is None:
        w = Window.partitionBy(key).orderBy(order, msg).rowsBetween(Window.unboundedPreceding, 0)
        hist = F.collect_list(msg).over(w)
        base = conv.select(key, order, hist.alias("_h"))
    else:
        m = conv.select(key, order, msg.alias("_m"),
                        F.floor(F.col(order) / F.lit(block_turns)).alias("_blk"))
        w_in = Window.partitionBy(key, "_blk").orderBy(order, "_m").rowsBetween(Window.unboundedPreceding, 0)
        inner = m.select(key, order, "_blk", F.collect_list("_m").over(w_in).alias("_in"))
        blocks = m.groupBy(key, "_blk").agg(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_m").alias("m")))),
            lambda x: x["m"]).alias("_bm"))
        # only numbers go through the conversation's window; messages meet by
        # (conversation, block)
        ids = blocks.select(F.col(key).alias("_k"), F.col("_blk").alias("_b")).withColumn(
            "_no", F.row_number().over(Window.partitionBy("_k").orderBy("_b")))
        ids = ids.repartition("_k", "_no")
        held = blocks.join(ids, F.col(key).eqNullSafe(F.col("_k")) & F.col("_blk").eqNullSafe(F.col("_b"))).select(
            F.col("_k").alias("_hk"), F.col("_no").alias("_hno"), "_bm")
        pairs = ids.where("_no > 1").select("_k", "_b", F.explode(F.sequence(F.lit(1), F.col("_no") - 1)).alias("_e"))
        prefix = (pairs.join(held, F.col("_k").eqNullSafe(F.col("_hk")) & (F.col("_e") == F.col("_hno")))
                  .groupBy("_k", "_b").agg(F.flatten(F.transform(
                      F.array_sort(F.collect_list(F.struct("_e", "_bm"))), lambda x: x["_bm"])).alias("_pre")))
        base = inner.join(prefix, F.col(key).eqNullSafe(F.col("_k")) & F.col("_blk").eqNullSafe(F.col("_b")), "left").select(
            key, order, F.when(F.col("_pre").isNull(), F.col("_in"))
            .otherwise(F.concat(F.col("_pre"), F.col("_in"))).alias("_h"))
    hist = F.col("_h")
    if system_prompt is not None:
        sys_msg = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")))
        hist = F.concat(sys_msg, hist)
    return base.select(key, order, hist.alias("history")) \
        .select(key, order, F.size("history").alias("n_messages"), "history")


def append_reply(conv: DataFrame, routed: DataFrame, answers: DataFrame | None = None,
                 results: DataFrame | None = None, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Conversation rows plus what each routed call adds after its turn:
    ``(conv_id, turn, seq, role, call_id, content)``, ``seq`` from 1 in the
    order of the calls.

    A message or an error is an assistant's message; so is the SQL text of an
    ``sql`` route, followed by a ``tool`` message with the call's id and its
    result if ``results`` (``call_id, content``) has one.  A retrieval question
    is answered: ``answers`` (``call_id, answer``) holds what the documents say.
    No call is dropped.
    """
    none = F.lit(None).cast("string")
    base = conv.select(key, order, F.lit(0).alias("seq"), "role", none.alias("call_id"), F.col("text").alias("content"))
    calls = routed
    content = F.col("reply")
    if answers is not None:
        calls = calls.join(answers.select("call_id", "answer"), "call_id", "left")
        content = F.when(F.col("route") == "retrieval", F.coalesce("answer", F.lit(NO_ANSWER))).otherwise(content)
    no = F.col("call_no") if "call_no" in routed.columns else F.lit(0)
    said = calls.select(key, order, (2 * no + 1).alias("seq"), F.lit("assistant").alias("role"), "call_id",
                        content.alias("content"))
    out = base.unionByName(said)
    if results is not None:
        ran = routed.where(F.col("route") == "sql").join(results.select("call_id", F.col("content").alias("result")), "call_id")
        out = out.unionByName(ran.select(key, order, (2 * no + 2).alias("seq"), F.lit("tool").alias("role"), "call_id",
                                         F.col("result").alias("content")))
    return out


def instructions_table(spark: SparkSession, rows=DEFAULT_INSTRUCTIONS) -> DataFrame:
    return spark.createDataFrame(list(rows), "type string, instructions string")


def instructions_lookup(calls: DataFrame, instructions: DataFrame,
                        name_col: str = "name") -> DataFrame:
    """Left join of calls to the instruction for their tool type; Spark
    broadcasts the instructions if they are small."""
    return calls.join(instructions,
                      calls[name_col] == instructions["type"], "left").drop("type")


def sql_tool_answer(spark: SparkSession, routed: DataFrame, max_result_chars: int | None = None,
                    kept: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run the SQL of every ``sql`` route once per distinct statement, also over
    several calls that share the folder ``kept`` (see ``relational.sql_batch``).

    Returns ``(answers, rows)``: per call ``(conv_id, turn, call_id, ok,
    n_rows, content)``, where content is the tool message, and the whole result
    rows ``(sql, row_no, row_json)``.  The message holds all rows in order as one
    JSON array; a failure reads ``query failed with error: ...``.  A caller whose
    model takes no longer messages may set ``max_result_chars``: the message of a
    larger result says how many rows there are, and they stay in ``rows``.
    """
    calls = routed.where(F.col("route") == "sql").select("conv_id", "turn", "call_id", F.col("reply").alias("sql"))
    res = relational.sql_batch(spark, calls, sql_col="sql", results=kept)
    # sizes first: only results that fit a message are gathered into one
    per = res.groupBy("sql").agg(
        F.bool_and("ok").alias("ok"), F.count("row_json").alias("n_rows"), F.max("error").alias("error"),
        F.coalesce(F.sum(F.char_length("row_json") + 2), F.lit(0)).alias("chars"))
    large = F.lit(False) if max_result_chars is None else F.col("chars") > max_result_chars
    fits = per.where(F.col("ok") & ~large).select(F.col("sql").alias("of"))
    texts = (res.join(fits, res["sql"] == fits["of"], "left_semi").where(F.col("row_json").isNotNull()).groupBy("sql")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row_json"))),
                                           lambda x: x["row_json"]), ", ").alias("rows_text")))
    per = per.join(texts, "sql", "left")
    content = (F.when(~F.col("ok"), F.concat(F.lit("query failed with error: "), F.col("error")))
               .when(large, F.concat(F.lit("query returned "), F.col("n_rows").cast("string"), F.lit(" rows")))
               .otherwise(F.concat(F.lit("["), F.coalesce("rows_text", F.lit("")), F.lit("]"))))
    answers = calls.join(per, "sql").select("conv_id", "turn", "call_id", "ok", "n_rows", content.alias("content"))
    rows = res.where(F.col("ok") & F.col("row_json").isNotNull()).select("sql", "row_no", "row_json")
    return answers, rows


def tool_message(call_id: Column, name: Column, content: Column, role: str = "tool") -> Column:
    """A message of role ``tool`` with the call that it answers."""
    return F.struct(F.lit(role).alias("role"), content.alias("content"), call_id.alias("tool_call_id"),
                    name.alias("name"))


def second_request(history: DataFrame, routed: DataFrame, answers: DataFrame, model: str,
                   temperature: float = 0.0, tool_choice: str = "auto") -> DataFrame:
    """What is asked next once a SQL call has its result: ``(conv_id, turn,
    call_id, request)``.

    The messages are the history up to the call's turn, the assistant's SQL,
    and the tool message with the call's id, name and result; the model may
    call a tool again or answer (``tool_choice``).
    """
    none = F.lit(None).cast("string")
    calls = routed.where(F.col("route") == "sql").select("conv_id", "turn", "call_id", "name", "reply")
    calls = calls.join(answers.select("call_id", "content"), "call_id").join(history, ["conv_id", "turn"])
    past = F.transform("history", lambda m: F.struct(
        m["role"].alias("role"), m["content"].alias("content"), none.alias("tool_call_id"), none.alias("name")))
    asked = tool_message(none, none, F.col("reply"), role="assistant")
    messages = F.concat(past, F.array(asked, tool_message(F.col("call_id"), F.col("name"), F.col("content"))))
    request = F.to_json(F.struct(F.lit(model).alias("model"), messages.alias("messages"),
                                 F.lit(temperature).cast("double").alias("temperature"),
                                 F.lit(tool_choice).alias("tool_choice")))
    return calls.select("conv_id", "turn", "call_id", request.alias("request"))
