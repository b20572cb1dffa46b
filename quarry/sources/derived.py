"""Inputs of the application derived from the given tables by fixed rules.

Each rule is a plain column expression over a given table, so the derived
input grows with the table and the DuckDB oracle can state the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Tool names and their argument keys.
TOOL_NAMES = ["get_information", "ask_database", "Answer_generic_questions"]
TOOL_ARGUMENT = {"get_information": "information", "ask_database": "query",
                 "Answer_generic_questions": "message"}
UNKNOWN_TOOL = "lookup_weather"

# The statements the SQL tool is asked to run (one per
# ``conv_id % len``).
TOOL_SQL = [
    "SELECT model_name, COUNT(alert_id) AS alert_count FROM alerts_table "
    "GROUP BY model_name ORDER BY alert_count DESC, model_name LIMIT 1",
    "SELECT model_name, COUNT(DISTINCT trader_id) AS traders FROM alerts_table "
    "GROUP BY model_name ORDER BY model_name",
    "SELECT a.model_name, COUNT(d.deal_number) AS deals FROM alerts_table a "
    "JOIN deals_table d ON a.alert_id = d.alert_id GROUP BY a.model_name ORDER BY a.model_name",
    "SELECT nope FROM alerts_table",
    "-- both tables\nSELECT a.alert_id, d.alert_id, NULL AS nothing, d.price FROM alerts_table a JOIN deals_table d "
    "ON a.alert_id = d.alert_id WHERE a.alert_id = '7' ORDER BY d.price, d.volume",
    "WITH z AS (SELECT 1 AS k) INSERT INTO alerts_table SELECT * FROM z",
]
# Of these, statements that fail or are refused.
FAILING_SQL = [3, 5]


def _num(x) -> F.Column:
    """Deterministic non-negative integer from a string (first 8 hex of md5)."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def wiki_docs(docs: DataFrame) -> DataFrame:
    """``(doc_id, title, markup)``: documents rebuilt as wiki markup.

    Before paragraph ``p`` a heading is inserted: ``== References ==`` when
    ``p % 16 = 9``, ``== S{p} ==`` when ``p % 8 = 1``, ``=== S{p} ===`` when
    ``p % 8 = 5``.  Paragraphs with ``p % 3 = 2`` get an inline
    ``<ref>p</ref>``.  Paragraph 0 is the summary.
    """
    lines = F.split(F.col("text"), "\n")

    def one(line, p):
        body = F.when(p % 3 == 2, F.concat(line, F.lit("<ref>"), p.cast("string"), F.lit("</ref>"))) \
            .otherwise(line)
        return (F.when(p % 16 == 9, F.array(F.lit("== References =="), body))
                .when(p % 8 == 1, F.array(F.concat(F.lit("== S"), p.cast("string"), F.lit(" ==")), body))
                .when(p % 8 == 5, F.array(F.concat(F.lit("=== S"), p.cast("string"), F.lit(" ===")), body))
                .otherwise(F.array(body)))

    markup = F.array_join(F.flatten(F.transform(lines, one)), "\n")
    return docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.col("doc_id").cast("string").alias("title"), markup.alias("markup"))


def category_edges(docs: DataFrame) -> DataFrame:
    """``(parent, child, kind)``: ``root`` -> ``g0..g3`` -> ``src{N}`` -> pages.

    ``src{N}`` hangs under ``g{N % 4}``; each document is a page of its
    source.  A few fixed edges add pages directly under ``root`` and ``g0``,
    a cycle ``src0 -> root`` and a page listed under two categories.
    """
    spark = docs.sparkSession
    n = F.regexp_extract(F.col("source"), r"(\d+)$", 1)
    srcs = docs.select(n.alias("n")).where(F.col("n") != "").distinct()
    top = spark.createDataFrame(
        [("root", f"g{i}", "category") for i in range(4)]
        + [("root", "root_page", "page"), ("g0", "g0_page", "page"),
           ("src0", "root", "category"), ("g1", "g0_page", "page")],
        "parent string, child string, kind string")
    mid = srcs.select(F.concat(F.lit("g"), (F.col("n").cast("int") % 4).cast("string")).alias("parent"),
                      F.concat(F.lit("src"), F.col("n")).alias("child"),
                      F.lit("category").alias("kind"))
    leaf = docs.where(n != "").select(F.concat(F.lit("src"), n).alias("parent"),
                                      F.col("doc_id").cast("string").alias("child"),
                                      F.lit("page").alias("kind"))
    return top.unionByName(mid).unionByName(leaf)


def mail(conversations: DataFrame) -> DataFrame:
    """``(mailbox, msg_no, sender, subject, body, unread)`` from conversations.

    Body: the turn text, ``Microsoft Teams`` added when ``turn % 5 = 4``, then
    a link.  A user message is unread when no assistant turn follows it.
    """
    c = conversations
    body = F.concat(F.col("text"),
                    F.when(F.col("turn") % 5 == 4, F.lit(" Microsoft Teams")).otherwise(F.lit("")),
                    F.lit(" http://x.example/"), F.col("turn").cast("string"))
    last_reply = (c.where(F.col("role") == "assistant").groupBy("conv_id")
                  .agg(F.max("turn").alias("_last")))
    return (c.join(last_reply, "conv_id", "left")
            .select(F.col("conv_id").alias("mailbox"), F.col("turn").alias("msg_no"),
                    F.col("role").alias("sender"),
                    F.regexp_extract(F.col("text"), r"^[^\n]*", 0).alias("subject"),
                    body.alias("body"),
                    ((F.col("role") == "user")
                     & (F.col("_last").isNull() | (F.col("_last") < F.col("turn")))).alias("unread")))


# Arguments that are no proper call, in turn.
BAD_ARGUMENTS = ["{bad", "{}", "[1]", '{"query": null, "information": 3}', '{"wrong": "key"}',
                 '{"query": "SELECT 1", "information": "x", "message": "y"} junk']


def tool_messages(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, tool_calls)`` for every user turn: an array of one or
    two ``struct<id, name, arguments>``.

    The tool is chosen by ``(conv_id + turn) % 4`` (three tools and one
    unknown); arguments are JSON made with ``to_json``: the turn text for
    ``information``/``message``, a statement of ``TOOL_SQL`` (by
    ``conv_id % len``) for ``query``.  When ``(conv_id + turn) % 13 = 0`` the
    arguments are one of ``BAD_ARGUMENTS``, by ``conv_id``.  When
    ``(conv_id + turn) % 5 = 0`` a second call asks the database.
    """
    c = conversations.where(F.col("role") == "user")
    at = F.col("conv_id") + F.col("turn")
    sel = (at % 4).cast("int")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), k.cast("int") + 1)
    name = pick(TOOL_NAMES + [UNKNOWN_TOOL], sel)
    sql = F.to_json(F.struct(pick(TOOL_SQL, F.col("conv_id") % len(TOOL_SQL)).alias("query")))
    args = (F.when(name == "get_information", F.to_json(F.struct(F.col("text").alias("information"))))
            .when(name == "ask_database", sql)
            .otherwise(F.to_json(F.struct(F.col("text").alias("message")))))
    args = F.when(at % 13 == 0, pick(BAD_ARGUMENTS, F.col("conv_id") % len(BAD_ARGUMENTS))).otherwise(args)
    call_id = F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    call = lambda i, n, a: F.struct(i.alias("id"), n.alias("name"), a.alias("arguments"))
    first = call(call_id, name, args)
    second = call(F.concat(call_id, F.lit("_1")), F.lit("ask_database"), sql)
    return c.select("conv_id", "turn", F.when(at % 5 == 0, F.array(first, second)).otherwise(F.array(first)).alias("tool_calls"))


def tool_calls(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, call_no, call_id, name, arguments)``, one row per call."""
    from ..operators.toolcalls import explode_tool_calls

    return explode_tool_calls(tool_messages(conversations))


def synth_rows(orders: DataFrame) -> DataFrame:
    """An alert and its deal side by side, one row per order key, with values
    drawn from md5 of the key (repeatable, unlike ``uuid()``/``rand``)."""
    k = F.col("o_orderkey").cast("string")
    h = F.md5(k)
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))
    return orders.select(
        uuid.alias("alert_id"),
        F.date_add(F.lit("2023-01-01").cast("date"),
                   (_num(F.concat(F.lit("d"), k)) % 362).cast("int")).alias("alert_date"),
        F.concat(F.lit("trader_"), (_num(F.concat(F.lit("t"), k)) % 50).cast("string")).alias("trader_id"),
        F.concat(F.lit("deal_"), k).alias("deal_number"),
        F.concat(F.lit("model_"), (_num(F.concat(F.lit("m"), k)) % 5 + 1).cast("string")).alias("model_name"),
        (F.lit(100) + _num(F.concat(F.lit("p"), k)) % 901).cast("int").alias("price"),
        (F.lit(1) + _num(F.concat(F.lit("v"), k)) % 99).cast("int").alias("volume"))


def synth_alerts_deals(orders: DataFrame):
    """Alerts and deals sharing ``alert_id``: ``(alerts, deals)`` with the column
    types of the original tables."""
    base = synth_rows(orders)
    alerts = base.select("alert_id", "alert_date", "trader_id", "deal_number", "model_name")
    deals = base.select("alert_id", F.col("alert_date").alias("deal_date"), "deal_number",
                        "price", "volume")
    return alerts, deals
