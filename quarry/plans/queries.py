"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
Spark derives from them) in whole; computed columns carry the same names as
the matching oracle SQL in :mod:`quarry.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions import vectors as V
from ..operators import context, corpus, embed, knn, manhattan, profile, pruned, relational, toolcalls
from ..session import scratch_path, spread
from ..sources import derived, files, keyed, tables
from ..streaming import answers, conversations as streams

# Workload constants.
K_NN = 5
TOP_N = context.TOP_N
CHUNK_TOKENS = 1600
CATEGORY_ROOT = "root"
CATEGORY_DEPTH = 2
FILTER_DEAL = "deal_7"
QUERY_FAILED = "query failed with error: "
HISTORY_BLOCK = 4  # turns per history block (small here so the tables exercise several)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ inputs

# Text tables feed regex-heavy per-row work: give each core a task even when
# the table arrives as one file split (a no-op on a large table).
_SPREAD = {"documents", "pages"}


def _t(spark, sf, name):
    df = tables.load(spark, sf, name)
    return spread(df) if name in _SPREAD else df


def _alerts(spark, sf):
    return tables.alerts(spark, sf)


def _deals(spark, sf):
    return tables.deals(spark, sf)


def _doc_emb(spark, sf):
    return embed.hashed_embedding(_t(spark, sf, "documents"), "doc_id", "text")


def _bench_emb(spark, sf):
    return embed.hashed_embedding(_t(spark, sf, "benchmark"), "item_id", "text")


def _vec_corpus(spark, sf):
    """All stored vectors: ``(id, vec)``."""
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _vec_texts(spark, sf):
    """Stored vectors with the text of their document, null without one."""
    d = _t(spark, sf, "documents").select("doc_id", "text")
    c = _vec_corpus(spark, sf)
    return c.join(d, c["id"] == d["doc_id"], "left").select("id", "vec", "text")


def _vec_queries(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"),
                                              F.col("embedding").alias("qvec"))


def _topn(spark, sf, n=TOP_N):
    return knn.nearest(_bench_emb(spark, sf), _doc_emb(spark, sf), n, "cosine",
                       qid="item_id", qvec="embedding", cid="doc_id", cvec="embedding")


def _questions(spark, sf):
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("qid"),
                                             F.col("text").alias("question"))


def _ranked_articles(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return _topn(spark, sf).join(docs, "id").select("qid", "rank", "text")


def _kept(spark, sf):
    return context.budget_prefix(_ranked_articles(spark, sf), _questions(spark, sf))


def _prompts(spark, sf):
    return context.build_prompt(_kept(spark, sf), _questions(spark, sf))


def _wiki(spark, sf):
    return derived.wiki_docs(_t(spark, sf, "documents"))


def _tree(spark, sf):
    return corpus.section_tree(_wiki(spark, sf))


def _prepared_sections(spark, sf):
    """Section tree -> ignored subtrees dropped -> cleaned -> kept."""
    return corpus.clean_and_keep(corpus.ignore_sections(_tree(spark, sf)))


def _edges(spark, sf):
    return derived.category_edges(_t(spark, sf, "documents"))


def _mail(spark, sf):
    return derived.mail(_t(spark, sf, "conversations"))


def _calls(spark, sf):
    return derived.tool_calls(_t(spark, sf, "conversations"))


def _routed(spark, sf):
    return toolcalls.route_tool_call(toolcalls.parse_tool_call(_calls(spark, sf)))


def _explode_vec(df, id_col, vec_col):
    return df.select(id_col, F.posexplode(vec_col).alias("dim", "_v")) \
        .select(id_col, "dim", F.round(F.col("_v").cast("double"), 6).alias("value"))


def _path(titles):
    return F.array_join(titles, " > ")


# ------------------------------------------------------------------ A. sources, sinks

DEALS_SCHEMA = T.StructType([
    T.StructField("alert_id", T.StringType()), T.StructField("deal_date", T.DateType()),
    T.StructField("deal_number", T.StringType()), T.StructField("price", T.DoubleType()),
    T.StructField("volume", T.DoubleType())])
ALERTS_SCHEMA = T.StructType([
    T.StructField("alert_id", T.StringType()), T.StructField("alert_date", T.DateType()),
    T.StructField("trader_id", T.StringType()), T.StructField("deal_number", T.StringType()),
    T.StructField("model_name", T.StringType())])


@query("scan_csv")
def q_scan_csv(spark, sf):
    path = files.sink_csv(_deals(spark, sf), scratch_path(spark, "deals-csv"))
    return files.scan_csv(spark, path, DEALS_SCHEMA)


@query("drop_index_col")
def q_drop_index_col(spark, sf):
    a = _alerts(spark, sf)
    path = files.sink_csv(a, scratch_path(spark, "alerts-csv"), index_col="alert_id")
    schema = T.StructType([T.StructField("_c0", T.StringType())] + ALERTS_SCHEMA.fields)
    return files.drop_index_col(files.scan_csv(spark, path, schema))


@query("parse_vector_literal")
def q_parse_vector_literal(spark, sf):
    e = _t(spark, sf, "embeddings")
    lit = F.to_json("embedding")
    text = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("["), lit, F.lit("]"))).otherwise(lit)
    parsed = e.select("vec_id", files.parse_vector_literal(text).cast("array<float>").alias("v"))
    return _explode_vec(parsed, "vec_id", "v")


@query("sink_csv")
def q_sink_csv(spark, sf):
    e = _t(spark, sf, "embeddings")
    path = files.sink_csv(e, scratch_path(spark, "emb-csv"))
    back = files.scan_csv(spark, path, "vec_id bigint, embedding string, label int")
    v = files.parse_vector_literal("embedding").cast("array<float>")
    return back.select("vec_id", "label", F.size(v).alias("width"),
                       F.round(v[0].cast("double"), 6).alias("first"),
                       F.round(F.element_at(v, -1).cast("double"), 6).alias("last"))


@query("scan_table")
def q_scan_table(spark, sf):
    tables.register_alert_views(spark, sf)
    return spark.table("deals_table")


def _new_table(spark, name, schema):
    tname = f"{name}_{scratch_path(spark, 't').rsplit('-', 1)[-1]}"
    files.create_table(spark, tname, schema, scratch_path(spark, name))
    return tname


@query("create_table")
def q_create_table(spark, sf):
    t = _new_table(spark, "alerts", ALERTS_SCHEMA)
    files.bulk_insert(_alerts(spark, sf), t)
    out = spark.table(t)
    if files.key_violations(out, "alert_id").limit(1).count():
        raise ValueError("primary key alert_id is not unique")
    return out


@query("bulk_insert")
def q_bulk_insert(spark, sf):
    t = _new_table(spark, "deals", DEALS_SCHEMA)
    files.bulk_insert(_deals(spark, sf), t)
    files.bulk_insert(_deals(spark, sf), t)
    return spark.table(t)


@query("block_scan")
def q_block_scan(spark, sf):
    return corpus.block_scan(_t(spark, sf, "pages"))


@query("heading_sink")
def q_heading_sink(spark, sf):
    heads = corpus.block_scan(_t(spark, sf, "pages")).where(corpus.is_heading_tag("tag"))
    path = files.sink_text(heads, "text", scratch_path(spark, "headings"))
    return files.scan_text(spark, path)


@query("category_pages")
def q_category_pages(spark, sf):
    return corpus.category_pages(_edges(spark, sf), CATEGORY_ROOT, CATEGORY_DEPTH)


@query("page_text_scan")
def q_page_text_scan(spark, sf):
    titles = corpus.category_pages(_edges(spark, sf), CATEGORY_ROOT, CATEGORY_DEPTH)
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("title"), "text")
    return titles.join(docs, "title")


def _index(spark, sf):
    c = _vec_texts(spark, sf)
    return files.vector_index_build(c, "id", "text", "vec", id_col="ix").withColumnRenamed("id", "vec_id")


@query("vector_index_build")
def q_vector_index_build(spark, sf):
    return _index(spark, sf).select("ix", "vec_id", "text", F.size("vector").alias("width"))


def _saved_index(spark, sf):
    return files.vector_index_save(_index(spark, sf), scratch_path(spark, "vindex"))


@query("vector_index_save")
def q_vector_index_save(spark, sf):
    back = files.vector_index_load(spark, _saved_index(spark, sf))
    return back.select("ix", "vec_id", F.size("vector").alias("width"),
                       F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query("vector_index_load")
def q_vector_index_load(spark, sf):
    idx = files.vector_index_load(spark, _saved_index(spark, sf))
    res = knn.nearest(idx.select(F.col("vec_id").alias("qid"), F.col("vector").alias("qvec")),
                      idx, K_NN, "l2", cid="ix", cvec="vector")
    return res.select(F.col("qid"), F.col("id").alias("ix"), "score", "rank")


def _synth(spark, sf):
    return derived.synth_rows(_t(spark, sf, "orders"))


@query("synth_alerts_deals")
def q_synth(spark, sf):
    return _synth(spark, sf)


# ------------------------------------------------------------------ B. projections, filters

@query("filter_eq")
def q_filter_eq(spark, sf):
    li = _t(spark, sf, "lineitem").where(tables.deal_number_filter(FILTER_DEAL))
    return tables.deals_from(li)


@query("project_named")
def q_project_named(spark, sf):
    d = _deals(spark, sf).select("deal_number", "deal_date", "price", "volume")
    return d.toDF("deal", "date", "price", "volume")


@query("rename_cols")
def q_rename_cols(spark, sf):
    docs = _t(spark, sf, "documents")
    e = _doc_emb(spark, sf).join(docs.select("doc_id", "text"), "doc_id")
    positional = e.select(F.col("text").alias("0"), F.col("embedding").alias("1"))
    named = positional.withColumnsRenamed({"0": "text", "1": "embedding"})
    return named.select("text", F.size("embedding").alias("width"),
                        F.round(F.col("embedding")[0], 6).alias("e0"))


@query("keep_section")
def q_keep_section(spark, sf):
    s = corpus.section_summary(_wiki(spark, sf))
    return corpus.clean_and_keep(s).select("doc_id", "text")


@query("is_heading")
def q_is_heading(spark, sf):
    b = corpus.block_scan(_t(spark, sf, "pages"))
    return b.select("page_id", "block_no", corpus.is_heading_tag("tag").alias("is_heading"))


@query("dedup_by_text")
def q_dedup_by_text(spark, sf):
    d = embed.hashed_embedding(_t(spark, sf, "documents"), "doc_id", "text", out_col="vec", carry=("text", "source"))
    out = corpus.dedup_by_text(d, "doc_id", value_cols=("source", "vec"))
    return out.select("text", "pos", "last_pos", "n_copies", "source",
                      F.to_json(F.transform("vec", lambda x: F.round(x * 1_000_000).cast("long"))).alias("vec"))


@query("distinct_titles")
def q_distinct_titles(spark, sf):
    return _edges(spark, sf).where(F.col("kind") == "page").select(
        F.col("child").alias("title")).distinct()


@query("member_kind")
def q_member_kind(spark, sf):
    return _edges(spark, sf).groupBy("parent").agg(
        F.count_if(F.col("kind") == "page").alias("n_pages"),
        F.count_if(F.col("kind") == "category").alias("n_categories"))


@query("ignore_sections")
def q_ignore_sections(spark, sf):
    s = corpus.ignore_sections(_tree(spark, sf))
    return s.select("doc_id", "sec_no", _path(F.col("titles")).alias("path"))


@query("mail_filter")
def q_mail_filter(spark, sf):
    return relational.mail_filter(_mail(spark, sf)).select("mailbox", "msg_no")


@query("preview")
def q_preview(spark, sf):
    d = _t(spark, sf, "documents").orderBy("doc_id").limit(5)
    return d.select("doc_id", TX.preview(F.col("text")).alias("preview"))


# ------------------------------------------------------------------ C. joins

@query("join_alert_deal")
def q_join_alert_deal(spark, sf):
    return relational.join_alert_deal(_alerts(spark, sf), _deals(spark, sf))


@query("lookup_text")
def q_lookup_text(spark, sf):
    res = knn.nearest(_vec_queries(spark, sf), _vec_corpus(spark, sf), K_NN, "l2")
    texts = _t(spark, sf, "documents").select("doc_id", "text")
    return res.join(texts, res["id"] == texts["doc_id"], "left").select("qid", "rank", "id", "text")


@query("query_x_corpus")
def q_query_x_corpus(spark, sf):
    return knn.score_stats(_vec_queries(spark, sf), _vec_corpus(spark, sf), "cosine")


@query("category_children")
def q_category_children(spark, sf):
    return corpus.category_children(_edges(spark, sf))


@query("instructions_lookup")
def q_instructions_lookup(spark, sf):
    calls = _calls(spark, sf)
    return toolcalls.instructions_lookup(calls, toolcalls.instructions_table(spark)) \
        .select("call_id", "name", "instructions")


# ------------------------------------------------------------------ D. aggregations

@query("alerts_per_model")
def q_alerts_per_model(spark, sf):
    return relational.count_per(_alerts(spark, sf), "model_name", "alert_id", "alert_count")


@query("chunk_fixed")
def q_chunk_fixed(spark, sf):
    return corpus.chunk_fixed(_t(spark, sf, "documents"))


@query("pipeline_counts")
def q_pipeline_counts(spark, sf):
    titles = corpus.category_pages(_edges(spark, sf), CATEGORY_ROOT, CATEGORY_DEPTH)
    n_titles = titles.agg(F.count(F.lit(1)).alias("n_titles"))
    # sections found, kept and chunked: one pass over the section tree
    counts = corpus.section_counts(_tree(spark, sf), CHUNK_TOKENS)
    stacked = counts.select(F.expr("stack(3, 'n_sections', n_sections, 'n_kept', n_kept, "
                                   "'n_strings', n_strings) AS (metric, value)"))
    return n_titles.select(F.lit("n_titles").alias("metric"), F.col("n_titles").alias("value")) \
        .unionByName(stacked)


@query("result_text")
def q_result_text(spark, sf):
    per = relational.count_per(_alerts(spark, sf), "model_name", "alert_id", "alert_count")
    return relational.result_text(per, ["model_name"])


@query("unread_count")
def q_unread_count(spark, sf):
    return relational.unread_count(_mail(spark, sf))


# ------------------------------------------------------------------ E. windows

@query("rank_per_query")
def q_rank_per_query(spark, sf):
    return knn.nearest(_vec_queries(spark, sf), _vec_corpus(spark, sf), K_NN, "cosine")


@query("budget_prefix")
def q_budget_prefix(spark, sf):
    return _kept(spark, sf).select("qid", "rank", "article_tokens", "cum_tokens")


@query("conversation_history")
def q_conversation_history(spark, sf):
    h = toolcalls.conversation_history(_t(spark, sf, "conversations"), block_turns=HISTORY_BLOCK)
    return h.select("conv_id", "turn", "n_messages", F.to_json("history").alias("history"))


@query("order_check")
def q_order_check(spark, sf):
    """Every input row has one output vector, and it is that row's vector: the
    buckets of the row's own tokens travel beside the vector and must be the
    places where it is not zero."""
    d = _t(spark, sf, "documents")
    want = F.array_sort(F.array_distinct(F.transform(
        F.coalesce(TX.tokens(F.lower("text")), F.array().cast("array<string>")), lambda t: embed.token_bucket(t))))
    out = embed.hashed_embedding(d.select("doc_id", "text", want.alias("want")), "doc_id", "text", carry=("want",))
    found = F.filter(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.get("embedding", i) != 0)
    good = (F.size("embedding") == embed.DEFAULT_DIM) & (found == F.col("want"))
    rows = d.select("doc_id", F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("bad")) \
        .unionByName(out.select("doc_id", F.lit(0).alias("i"), F.lit(1).alias("o"),
                                F.when(good, 0).otherwise(1).alias("bad")))
    per = rows.groupBy("doc_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum("bad").alias("bad"))
    c = per.agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"),
                F.sum(F.greatest(F.col("i") - F.col("o"), F.lit(0))).alias("n_missing"),
                F.sum(F.greatest(F.col("o") - F.col("i"), F.lit(0))).alias("n_extra"),
                F.count_if(F.col("i") > 1).alias("n_repeated_ids"), F.sum("bad").alias("n_wrong"))
    names = ("n_in", "n_out", "n_missing", "n_extra", "n_repeated_ids", "n_wrong")
    return c.select(F.expr(f"stack({len(names)}, {', '.join(f"'{n}', {n}" for n in names)}) AS (metric, value)"))


# ------------------------------------------------------------------ F. sort / top-k / sets

@query("sort_relatedness")
def q_sort_relatedness(spark, sf):
    """The whole corpus in order for each query; to keep the first rows only is the work of F2 and E1."""
    return knn.ranking(_vec_queries(spark, sf), _vec_corpus(spark, sf), "cosine")


@query("topn_cosine")
def q_topn_cosine(spark, sf):
    return _topn(spark, sf)


@query("knn_l2")
def q_knn_l2(spark, sf):
    return knn.nearest(_vec_queries(spark, sf), _vec_corpus(spark, sf), K_NN, "l2")


@query("knn_pruned")
def q_knn_pruned(spark, sf):
    path = pruned.build(_vec_corpus(spark, sf), scratch_path(spark, "pivots-l2"), "l2")
    return pruned.search(_vec_queries(spark, sf), path, K_NN, "l2")[0]


@query("topn_pruned")
def q_topn_pruned(spark, sf):
    path = pruned.build(_doc_emb(spark, sf), scratch_path(spark, "pivots-cosine"), "cosine", cid="doc_id", cvec="embedding")
    return pruned.search(_bench_emb(spark, sf), path, TOP_N, "cosine", qid="item_id", qvec="embedding")[0]


@query("top_model")
def q_top_model(spark, sf):
    per = relational.count_per(_alerts(spark, sf), "model_name", "alert_id", "alert_count")
    return relational.top_by(per, "alert_count", "model_name")


@query("top_event_type")
def q_top_event_type(spark, sf):
    per = relational.count_per(_t(spark, sf, "events"), "event_type", "event_id", "n_events")
    return relational.top_by(per, "n_events", "event_type")


@query("union_titles")
def q_union_titles(spark, sf):
    e = _edges(spark, sf)
    a = corpus.category_pages(e, "g0", 1)
    b = corpus.category_pages(e, "g1", 1)
    return a.union(b).distinct()


@query("concat_sections")
def q_concat_sections(spark, sf):
    w = _wiki(spark, sf)
    summ = corpus.section_summary(w).select(F.lit(0).alias("part"), "doc_id",
                                            F.lit(0).alias("sec_no"), "text")
    tree = corpus.section_tree(w).select(F.lit(1).alias("part"), "doc_id", "sec_no", "text")
    return summ.unionByName(tree)


# ------------------------------------------------------------------ G. scalar / text / vector / prompt

def _pairs(spark, sf):
    e = _t(spark, sf, "embeddings")
    n = e.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("b"))
    return e.join(n, n["next_id"] == e["vec_id"] + 1).select("vec_id", "next_id",
                                                              F.col("embedding").alias("a"), "b")


@query("cosine")
def q_cosine(spark, sf):
    p = _pairs(spark, sf)
    return p.select("vec_id", "next_id", F.round(V.cosine("a", "b"), 6).alias("rel"))


@query("l2_squared")
def q_l2_squared(spark, sf):
    p = _pairs(spark, sf)
    return p.select("vec_id", "next_id", F.round(V.l2_squared("a", "b"), 6).alias("dist"))


@query("cast_float32")
def q_cast_float32(spark, sf):
    e = _doc_emb(spark, sf).select("doc_id", V.cast_float32("embedding").alias("v"))
    return _explode_vec(e, "doc_id", "v")


@query("num_tokens")
def q_num_tokens(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", TX.num_tokens("text").alias("n_tokens"))


@query("clean_refs")
def q_clean_refs(spark, sf):
    return _wiki(spark, sf).select("doc_id", TX.clean_refs("markup").alias("text"))


@query("strip_heading")
def q_strip_heading(spark, sf):
    lines = _wiki(spark, sf).select("doc_id", F.posexplode(F.split("markup", "\n")).alias("pos", "line"))
    return lines.where(corpus.heading_level("line") > 0).select(
        "doc_id", "pos", TX.strip_heading("line").alias("title"))


@query("remove_urls")
def q_remove_urls(spark, sf):
    return _mail(spark, sf).select("mailbox", "msg_no", TX.remove_urls("body").alias("body"))


@query("rstrip_question")
def q_rstrip_question(spark, sf):
    c = _t(spark, sf, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", TX.rstrip_ws(F.concat("text", F.lit(" \n"))).alias("question"))


@query("sql_batch")
def q_sql_batch(spark, sf):
    tables.register_alert_views(spark, sf)
    stmts = _routed(spark, sf).where(F.col("route") == "sql").select(F.col("reply").alias("sql"))
    res = relational.sql_batch(spark, stmts)
    ordered = F.col("sql").contains("ORDER BY")  # elsewhere the place of a row is Spark's choice
    return res.select("sql", "ok", F.when(ordered, F.col("row_no")).alias("row_no"), "row_json")


ALERT_VIEWS = ["alerts_table", "deals_table"]


@query("catalog_tables")
def q_catalog_tables(spark, sf):
    tables.register_alert_views(spark, sf)
    return relational.catalog_tables(spark, ALERT_VIEWS)


@query("catalog_columns")
def q_catalog_columns(spark, sf):
    tables.register_alert_views(spark, sf)
    return relational.catalog_columns(spark, ALERT_VIEWS, exact=True)


@query("catalog_profile")
def q_catalog_profile(spark, sf):
    """The alerts land in two parts; each update reads the files that are new."""
    where, kept = scratch_path(spark, "alerts"), scratch_path(spark, "profile")
    alerts = tables.alerts(spark, sf)
    for k in range(2):
        alerts.where(F.pmod(F.hash("alert_id"), F.lit(2)) == k).write.mode("append").parquet(where)
        files = list(spark.read.parquet(where).inputFiles())
        profile.update_profile(spark, kept, files, lambda some: spark.read.parquet(*some))
    sketched = profile.merged_profile(spark, kept, "alerts_table", files)
    tables.register_alert_views(spark, sf)
    exact = relational.catalog_columns(spark, ["alerts_table"], exact=True).select("ordinal", F.col("n_distinct").alias("exact"))
    off = F.abs(F.col("n_distinct") - F.col("exact"))
    return sketched.join(exact, "ordinal").select("table_name", "ordinal", "column_name", "data_type", "non_null",
                                                  (off <= 4 * profile.relative_error() * F.col("exact")).alias("within"))


@query("catalog_info")
def q_catalog_info(spark, sf):
    tables.register_alert_views(spark, sf)
    info = relational.catalog_info(spark, profile=relational.catalog_columns(spark, ALERT_VIEWS))
    return info.select("table_name", F.to_json("column_names").alias("column_names"),
                       F.to_json("without_values").alias("without_values"))


def _schema_text(spark, sf) -> str:
    tables.register_alert_views(spark, sf)
    return relational.schema_text(relational.catalog_info(spark, ALERT_VIEWS)).first()[0]


@query("schema_text")
def q_schema_text(spark, sf):
    tables.register_alert_views(spark, sf)
    return relational.schema_text(relational.catalog_info(spark, profile=relational.catalog_columns(spark, ALERT_VIEWS)))


@query("section_summary")
def q_section_summary(spark, sf):
    s = corpus.section_summary(_wiki(spark, sf))
    return s.select("doc_id", _path(F.col("titles")).alias("path"), "text")


@query("section_tree")
def q_section_tree(spark, sf):
    s = _tree(spark, sf)
    return s.select("doc_id", "sec_no", "level", _path(F.col("titles")).alias("path"), "text")


@query("section_string")
def q_section_string(spark, sf):
    s = _prepared_sections(spark, sf)
    return s.select("doc_id", "sec_no", corpus.section_string("titles", "text").alias("string"))


@query("halve")
def q_halve(spark, sf):
    left, right = TX.halve(F.col("text"), "\n")
    return _t(spark, sf, "documents").select("doc_id", left.alias("left"), right.alias("right"))


@query("truncate_tokens")
def q_truncate_tokens(spark, sf):
    t = TX.truncate_tokens("text", CHUNK_TOKENS)
    return _t(spark, sf, "documents").select("doc_id", t.alias("text"))


@query("chunk_recursive")
def q_chunk_recursive(spark, sf):
    return corpus.chunk_recursive(_prepared_sections(spark, sf), CHUNK_TOKENS)


@query("prompt_article")
def q_prompt_article(spark, sf):
    r = _ranked_articles(spark, sf)
    return r.select("qid", "rank", context.prompt_article("text").alias("article"))


@query("build_prompt")
def q_build_prompt(spark, sf):
    return _prompts(spark, sf)


@query("chat_request")
def q_chat_request(spark, sf):
    p = _prompts(spark, sf)
    return p.select("qid", context.chat_request(p).alias("request"))


@query("attach_tools")
def q_attach_tools(spark, sf):
    tools = context.tools_column(_schema_text(spark, sf))
    conv = _t(spark, sf, "conversations")
    h = toolcalls.conversation_history(conv, block_turns=HISTORY_BLOCK)
    asked = conv.where(F.col("role") == "user").select("conv_id", "turn")  # a request per user turn
    h = h.join(asked, ["conv_id", "turn"], "left_semi")
    req = F.to_json(F.struct(F.lit(context.DEFAULT_MODEL).alias("model"),
                             F.col("history").alias("messages"),
                             F.lit(0.0).alias("temperature"), tools.alias("tools"),
                             F.lit("required").alias("tool_choice")))
    return h.select("conv_id", "turn", req.alias("request"))


@query("parse_tool_call")
def q_parse_tool_call(spark, sf):
    p = toolcalls.parse_tool_call(_calls(spark, sf))
    return p.select("call_id", "call_no", "name", "args_ok", "information", "query", "message")


@query("route_tool_call")
def q_route_tool_call(spark, sf):
    return _routed(spark, sf).select("call_id", "route", "reply")


def _masked(replies):
    failed = (F.col("role") == "tool") & F.col("content").startswith(F.lit(QUERY_FAILED))  # the engine's own words follow
    return replies.withColumn("content", F.when(failed, F.lit(QUERY_FAILED)).otherwise(F.col("content")))


@query("append_reply")
def q_append_reply(spark, sf):
    # retrieval questions are answered from the documents, SQL is run, and both
    # come back as messages
    tables.register_alert_views(spark, sf)
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return _masked(answers.replies(_t(spark, sf, "conversations"), docs))


@query("sql_tool_answer")
def q_sql_tool_answer(spark, sf):
    tables.register_alert_views(spark, sf)
    said, _rows = toolcalls.sql_tool_answer(spark, _routed(spark, sf))
    return said.select("call_id", "ok", "n_rows",
                          F.when(F.col("ok"), F.col("content")).alias("content"))


@query("second_request")
def q_second_request(spark, sf):
    tables.register_alert_views(spark, sf)
    routed = _routed(spark, sf)
    results, _rows = toolcalls.sql_tool_answer(spark, routed)
    said = F.when(F.col("ok"), F.col("content")).otherwise(F.lit(QUERY_FAILED))  # without the engine's own words
    history = toolcalls.conversation_history(_t(spark, sf, "conversations"), block_turns=HISTORY_BLOCK)
    return toolcalls.second_request(history, routed, results.withColumn("content", said), context.DEFAULT_MODEL)


@query("score_text")
def q_score_text(spark, sf):
    return _topn(spark, sf).select("qid", "rank", TX.score_text("score").alias("score_text"))


@query("date_text")
def q_date_text(spark, sf):
    s = _synth(spark, sf)
    return s.select("alert_id", F.date_format("alert_date", "yyyy-MM-dd").alias("date_text"))


@query("label_text")
def q_label_text(spark, sf):
    return _synth(spark, sf).select("alert_id", "trader_id", "deal_number", "model_name")


# ------------------------------------------------------------------ H. embedding, answers

@query("embed_texts")
def q_embed_texts(spark, sf):
    return _explode_vec(_doc_emb(spark, sf), "doc_id", "embedding")


@query("embed_query")
def q_embed_query(spark, sf):
    return _explode_vec(_bench_emb(spark, sf), "item_id", "embedding")


def _chunk_index(spark, sf):
    """Paragraph chunks of all pages, one row per distinct text, with their
    vectors, written once: ``(id, text, embedding)``."""
    chunks = corpus.page_chunks(_t(spark, sf, "pages"))
    pos = F.col("page_id") * 1_000_000 + F.col("chunk_no")
    once = corpus.dedup_by_text(chunks.withColumn("at", pos), "at").select(F.col("pos").alias("id"), "text")
    index = embed.hashed_embedding(once, "id", "text", carry=("text",))
    return files.vector_index_load(spark, files.vector_index_save(index, scratch_path(spark, "chunk-index")))


@query("answer_questions")
def q_answer_questions(spark, sf):
    """Questions against paragraph chunks: the corpus is embedded once, stored,
    and both the search and the text lookup read the stored table."""
    index = _chunk_index(spark, sf)
    res = context.answer_questions(_questions(spark, sf), index.select("id", "text"),
                                   corpus_vectors=index.select("id", "embedding"))
    return res.select("qid", "n_articles", "request")


@query("pluggable_similarity")
def q_pluggable_similarity(spark, sf):
    """A relatedness function of the caller's: the negative Manhattan distance."""
    return knn.nearest(_vec_queries(spark, sf), _vec_corpus(spark, sf), K_NN, manhattan.similarity)


# ------------------------------------------------------------------ I. streaming

@query("stream_route")
def q_stream_route(spark, sf):
    return streams.stream_route(spark, streams.landed_in_files(spark, sf)).select("call_id", "route", "reply")


@query("stream_history")
def q_stream_history(spark, sf):
    landed = streams.landed_in_files(spark, sf)
    return streams.stream_history(spark, landed, max_files_per_trigger=streams.files_per_class(spark))


@query("insert_keyed")
def q_insert_keyed(spark, sf):
    """Alerts in two batches that overlap; the second one is sent again."""
    alerts = tables.alerts(spark, sf)
    table = keyed.KeyedTable(spark, scratch_path(spark, "keyed"), alerts.schema, "alert_id")
    table.insert(alerts.where(F.col("alert_id").cast("long") % 2 == 0), "even")
    for _ in range(2):
        table.insert(alerts, "all")
    return (table.rows().select("alert_id", "deal_number", F.lit(None).cast("string").alias("reason"))
            .unionByName(table.rejects().select("alert_id", "deal_number", "reason")))


@query("stream_answers")
def q_stream_answers(spark, sf):
    """The tool loop inside the stream, in four micro-batches."""
    tables.register_alert_views(spark, sf)
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    landed = streams.landed_in_files(spark, sf)
    return _masked(answers.stream_answers(spark, landed, docs, max_files_per_trigger=streams.files_per_class(spark)))
