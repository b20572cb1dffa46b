"""Context packing: rank, keep the best articles under a token budget, build
the prompt, and turn it into a chat request row.

Token counts are additive over joins at white space (see
``functions.text.num_tokens``), so each candidate is counted once and a
running sum per question replaces a re-count of the whole message for
every candidate (linear instead of quadratic).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored
from . import embed, knn

# Prompt formats (every join falls on white space).
ARTICLE_PREFIX = '\n\nWikipedia article section:\n"""\n'
ARTICLE_SUFFIX = '\n"""'
QUESTION_PREFIX = "\n\nQuestion: "
TOP_N = 100
TOKEN_BUDGET = 4096 - 500
# Parameters with defaults of our own.
DEFAULT_INTRO = "Use the articles below to answer the question."
DEFAULT_SYSTEM = "You answer questions using the supplied articles."
DEFAULT_MODEL = "chat-model"


def prompt_article(text) -> Column:
    return F.concat(F.lit(ARTICLE_PREFIX), T._c(text), F.lit(ARTICLE_SUFFIX))


def question_text(q) -> Column:
    return F.concat(F.lit(QUESTION_PREFIX), T._c(q))


def budget_prefix(ranked: DataFrame, questions: DataFrame, budget: int = TOKEN_BUDGET,
                  intro: str = DEFAULT_INTRO, qid: str = "qid", rank: str = "rank",
                  text: str = "text", question: str = "question") -> DataFrame:
    """Keep ranked articles while ``tokens(intro + articles so far + question)
    <= budget``; stop at the first that does not fit.

    Counts are >= 0, so the running sum never falls and the filter is the
    prefix.  Window per question over at most ``top_n`` rows.
    """
    q = questions.select(F.col(qid), T.num_tokens(question_text(F.col(question))).alias("_qt"))
    intro_tokens = F.lit(0) if not intro else T.num_tokens(F.lit(intro))
    w = Window.partitionBy(qid).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    art = ranked.select(qid, rank, prompt_article(F.col(text)).alias("article"))
    art = art.withColumn("article_tokens", T.num_tokens(F.col("article")))
    art = art.withColumn("cum_tokens", F.sum("article_tokens").over(w))
    return (art.join(q, qid)
            .where(intro_tokens + F.col("cum_tokens") + F.col("_qt") <= budget)
            .drop("_qt"))


def build_prompt(kept: DataFrame, questions: DataFrame, intro: str = DEFAULT_INTRO,
                 qid: str = "qid", rank: str = "rank", question: str = "question") -> DataFrame:
    """``(qid, n_articles, prompt)``: introduction + articles in rank order +
    question; a question with no article that fits keeps intro + question."""
    per = kept.groupBy(qid).agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, "article"))),
                                 lambda x: x["article"]), "").alias("_arts"))
    return (questions.select(qid, question).join(per, qid, "left")
            .select(qid, F.coalesce("n_articles", F.lit(0)).alias("n_articles"),
                    F.concat(F.lit(intro or ""), F.coalesce("_arts", F.lit("")),
                             question_text(F.col(question))).alias("prompt")))


def chat_request(prompts: DataFrame, prompt_col: str = "prompt", system: str = DEFAULT_SYSTEM,
                 model: str = DEFAULT_MODEL, temperature: float = 0.0,
                 tools: Column | None = None, tool_choice: str | None = None) -> Column:
    """Request JSON: model, ``[system, user]`` messages, temperature, and
    optionally tools and ``tool_choice`` (``required``/``auto``)."""
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col(prompt_col).alias("content")))
    fields = [F.lit(model).alias("model"), msgs.alias("messages"),
              F.lit(temperature).cast("double").alias("temperature")]
    if tools is not None:
        fields.append(tools.alias("tools"))
    if tool_choice is not None:
        fields.append(F.lit(tool_choice).alias("tool_choice"))
    return F.to_json(F.struct(*fields))


def tool_definitions(schema_text: str) -> list[dict]:
    """The three tool definitions; the SQL tool carries the schema text."""
    def fn(name, desc, arg, arg_desc):
        return {"type": "function", "function": {
            "name": name, "description": desc,
            "parameters": {"type": "object",
                           "properties": {arg: {"type": "string", "description": arg_desc}},
                           "required": [arg]}}}
    return [
        fn("Answer_generic_questions", "Reply to the user directly from the conversation.",
           "message", "Text of the message to send to the user."),
        fn("get_information", "Search the document collection for the answer.",
           "information", "The user's question about the documents."),
        fn("ask_database", "Answer questions about alerts and deals with one SQL query.",
           "query", "SQL query written against this schema:\n" + schema_text),
    ]


TOOLS_SCHEMA = ("array<struct<type:string,function:struct<name:string,description:string,"
                "parameters:struct<type:string,properties:map<string,struct<type:string,"
                "description:string>>,required:array<string>>>>>")


def tools_column(schema_text: str) -> Column:
    """The tool list as one literal column (no join needed to attach it)."""
    return F.from_json(F.lit(json.dumps(tool_definitions(schema_text))), TOOLS_SCHEMA)


def first_lines(questions: DataFrame, corpus: DataFrame, qid: str = "qid", question: str = "question",
                cid: str = "id", text: str = "text", budget: int = TOKEN_BUDGET, intro: str = DEFAULT_INTRO,
                dim: int = embed.DEFAULT_DIM, corpus_vectors: DataFrame | None = None) -> DataFrame:
    """An extractive answer per question: the first line of the nearest article,
    if this article fits the prompt.  ``(qid, answer)``, no row otherwise.  It
    takes a model's place where none is at hand."""
    q = questions.select(F.col(qid).alias("qid"), F.col(question).alias("question"))
    c = corpus.select(F.col(cid).alias("id"), F.col(text).alias("text"))
    ce = corpus_vectors if corpus_vectors is not None else embed.hashed_embedding(c, "id", "text", dim)
    # the search reads its queries several times
    qe = stored(embed.hashed_embedding(q, "qid", "question", dim), "question-vectors")
    top = knn.nearest(qe, ce, 1, "cosine", qid="qid", qvec="embedding", cid="id", cvec="embedding")
    ranked = top.join(c, "id").select("qid", "rank", "text")
    kept = budget_prefix(ranked, q, budget, intro)
    body = F.substring(F.col("article"), F.lit(len(ARTICLE_PREFIX) + 1),
                       F.char_length("article") - len(ARTICLE_PREFIX) - len(ARTICLE_SUFFIX))
    return kept.select("qid", F.substring_index(body, "\n", 1).alias("answer"))


def answer_questions(questions: DataFrame, corpus: DataFrame, qid: str = "qid",
                     question: str = "question", cid: str = "id", text: str = "text",
                     top_n: int = TOP_N, budget: int = TOKEN_BUDGET,
                     intro: str = DEFAULT_INTRO, dim: int = embed.DEFAULT_DIM,
                     system: str = DEFAULT_SYSTEM, model: str = DEFAULT_MODEL,
                     corpus_vectors: DataFrame | None = None) -> DataFrame:
    """A table of questions to a table of chat requests:
    embed -> exact cosine top-n -> text lookup -> budget prefix -> prompt ->
    request.  ``(qid, n_articles, prompt, request)``.

    ``corpus_vectors`` (``id, embedding``, e.g. a stored vector index) skips
    embedding the corpus again; it must come from the same provider."""
    q = questions.select(F.col(qid).alias("qid"), F.col(question).alias("question"))
    c = corpus.select(F.col(cid).alias("id"), F.col(text).alias("text"))
    qe = embed.hashed_embedding(q, "qid", "question", dim)
    ce = (corpus_vectors.select("id", "embedding") if corpus_vectors is not None
          else embed.hashed_embedding(c, "id", "text", dim))
    top = knn.nearest(qe, ce, top_n, "cosine", qid="qid", qvec="embedding",
                      cid="id", cvec="embedding")
    ranked = top.join(c, "id").select("qid", "rank", "text")
    kept = budget_prefix(ranked, q, budget, intro)
    prompts = build_prompt(kept, q, intro)
    return prompts.select("qid", "n_articles", "prompt",
                          chat_request(prompts, system=system, model=model).alias("request"))
