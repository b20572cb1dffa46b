"""DuckDB SQL stating the same rule as each registered query (same column
names).  Tables ``region … conversations`` are pre-registered views.

The SQL is assembled from small CTE builders that mirror the derived inputs
of :mod:`quarry.plans.queries`; constants are taken from the operator
modules so both sides share one definition.
"""

from __future__ import annotations

import json

from ..functions import text as TX
from ..operators import context, corpus, toolcalls
from ..sources import derived
from . import queries as Q

ORACLE: dict[str, str] = {}


def s(text: str) -> str:
    """A Python string as a DuckDB expression (newlines through chr(10))."""
    parts = text.split("\n")
    lits = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(lits) if len(lits) > 1 else lits[0]


TOKEN = s(TX.TOKEN_PATTERN)
TOKEN_WS = s(TX.TOKEN_WITH_SPACE_PATTERN)
EDGE = s(TX.EDGE_SPACE_PATTERN)
HEAD = s(corpus.HEADING_LINE_PATTERN)
NN = "chr(10) || chr(10)"


def ntok(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, {TOKEN})), 0)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {EDGE}, '', 'g')"


def clean(x: str) -> str:
    return strip(f"regexp_replace({x}, {s(TX.REF_PATTERN)}, '', 'g')")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c)


# ------------------------------------------------------------------ CTE builders

ALERTS = """alerts_table AS (SELECT CAST(o_orderkey AS VARCHAR) AS alert_id,
  CAST(o_orderdate AS DATE) AS alert_date, 'trader_' || CAST(o_custkey AS VARCHAR) AS trader_id,
  'deal_' || CAST(o_orderkey AS VARCHAR) AS deal_number,
  'model_' || CAST(o_orderkey % 5 + 1 AS VARCHAR) AS model_name FROM orders)"""
DEALS = """deals_table AS (SELECT CAST(l_orderkey AS VARCHAR) AS alert_id,
  CAST(l_shipdate AS DATE) AS deal_date, 'deal_' || CAST(l_orderkey AS VARCHAR) AS deal_number,
  l_extendedprice AS price, l_quantity AS volume FROM lineitem)"""


def emb(p: str, src: str, dim: int = 64) -> str:
    """Hashed bag-of-tokens embedding of ``src(id, text)`` as ``{p}_emb(id, e)``."""
    return f"""{p}_src AS ({src}),
{p}_tok AS (SELECT id, unnest(regexp_extract_all(lower(text), {TOKEN})) AS t FROM {p}_src),
{p}_b AS (SELECT id, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {dim} AS INTEGER) AS b,
  count(*) AS n FROM {p}_tok GROUP BY 1, 2),
{p}_dense AS (SELECT ids.id, list(CAST(coalesce(b.n, 0) AS DOUBLE) ORDER BY r.i) AS v
  FROM (SELECT DISTINCT id FROM {p}_src) ids CROSS JOIN range({dim}) r(i)
  LEFT JOIN {p}_b b ON b.id = ids.id AND b.b = r.i GROUP BY ids.id),
{p}_emb AS (SELECT id, CASE WHEN nrm > 0 THEN list_transform(v, lambda x: x / nrm) ELSE v END AS e
  FROM (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM {p}_dense))"""


DOC_EMB = emb("d", "SELECT doc_id AS id, text FROM documents")
BENCH_EMB = emb("q", "SELECT item_id AS id, text FROM benchmark")


def rank_cte(name: str, pairs: str, metric: str, k: int | None) -> str:
    order = "score DESC NULLS LAST" if metric == "cosine" else "score ASC NULLS LAST"
    return f"""{name} AS (SELECT qid, id, score, rank FROM (SELECT qid, id, score,
  row_number() OVER (PARTITION BY qid ORDER BY {order}, id) AS rank FROM ({pairs})){'' if k is None else f' WHERE rank <= {k}'})"""


def score_expr(metric: str, a: str, b: str) -> str:
    if metric == "cosine":
        return f"round(list_cosine_similarity({a}, {b}), 6)"
    return f"round(power(list_distance({a}, {b}), 2), 6)"


TOPN = rank_cte("topn", f"SELECT q.id AS qid, d.id AS id, {score_expr('cosine', 'q.e', 'd.e')} AS score "
                        "FROM q_emb q CROSS JOIN d_emb d", "cosine", Q.TOP_N)
VEC = """vq AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
vc AS (SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS v, d.text FROM embeddings e
  LEFT JOIN documents d ON e.vec_id = d.doc_id)"""


def vec_rank(metric: str, k: int | None, name: str = "r") -> str:
    return rank_cte(name, f"SELECT q.qid, c.id, {score_expr(metric, 'q.v', 'c.v')} AS score "
                          "FROM vq q CROSS JOIN vc c", metric, k)


def wiki() -> str:
    body = (f"CASE WHEN (i - 1) % 3 = 2 THEN l || '<ref>' || CAST(i - 1 AS VARCHAR) || '</ref>' "
            "ELSE l END")
    one = (f"CASE WHEN (i - 1) % 16 = 9 THEN ['== References ==', {body}] "
           f"WHEN (i - 1) % 8 = 1 THEN ['== S' || CAST(i - 1 AS VARCHAR) || ' ==', {body}] "
           f"WHEN (i - 1) % 8 = 5 THEN ['=== S' || CAST(i - 1 AS VARCHAR) || ' ===', {body}] "
           f"ELSE [{body}] END")
    return f"""wiki AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS title,
  array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda l, i: {one})), chr(10)) AS markup
  FROM documents WHERE text IS NOT NULL)"""


def summary() -> str:
    return f"""summ AS (SELECT doc_id, title, CASE WHEN fp > 0 THEN
  array_to_string(list_slice(ls, 1, fp - 1), chr(10)) ELSE markup END AS text FROM (
  SELECT doc_id, title, markup, ls,
  coalesce(list_position(list_transform(ls, lambda l: regexp_matches(l, {HEAD})), true), 0) AS fp
  FROM (SELECT doc_id, title, markup, string_split(markup, chr(10)) AS ls FROM wiki)))"""


def tree() -> str:
    anc = []
    for k in range(2, 7):
        anc.append(f"last_value(CASE WHEN lvl > 0 AND lvl <= {k} THEN {{'l': lvl, 't': stitle}} END "
                   f"IGNORE NULLS) OVER w AS a{k}")
    parts = ", ".join(f"CASE WHEN a{k}.l = {k} AND lvl >= {k} THEN a{k}.t END" for k in range(2, 7))
    return f"""tl AS (SELECT doc_id, title, unnest(generate_series(0, len(ls) - 1)) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, title, string_split(markup, chr(10)) AS ls FROM wiki)),
tlv AS (SELECT *, CASE WHEN regexp_matches(line, {HEAD}) THEN length(regexp_extract(line, '^(=+)', 1))
  ELSE 0 END AS lvl FROM tl),
tsn AS (SELECT *, CAST(sum(CASE WHEN lvl > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS sec_no FROM tlv),
tsec AS (SELECT doc_id, title, sec_no, max(lvl) AS lvl,
  max(CASE WHEN lvl > 0 THEN line END) AS stitle,
  coalesce(array_to_string(list(line ORDER BY pos) FILTER (WHERE lvl = 0), chr(10)), '') AS text
  FROM tsn GROUP BY 1, 2, 3),
tanc AS (SELECT *, {", ".join(anc)} FROM tsec
  WINDOW w AS (PARTITION BY doc_id ORDER BY sec_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tree AS (SELECT doc_id, sec_no, CASE WHEN lvl = 0 THEN 1 ELSE lvl END AS level,
  list_concat([title], list_filter([{parts}], lambda x: x IS NOT NULL)) AS titles, text FROM tanc)"""


IGNORE_LIST = "[" + ", ".join("'" + x + "'" for x in dict.fromkeys(corpus.SECTIONS_TO_IGNORE)) + "]"


def prepared() -> str:
    return f"""kept_tree AS (SELECT * FROM tree WHERE NOT coalesce(
  list_has_any(list_transform(list_slice(titles, 2, len(titles)), lambda x: trim(x, '= ')), {IGNORE_LIST}), false)),
prep AS (SELECT doc_id, sec_no, level, titles, text FROM (
  SELECT doc_id, sec_no, level, titles, {clean('text')} AS text FROM kept_tree)
  WHERE length(text) >= {TX.MIN_SECTION_CHARS})"""


def _halves(t: str, d: str):
    mid = f"(length({t}) // 2)"
    pa = f"instr(substr({t}, {mid} + 1), {d})"
    p = f"(CASE WHEN {pa} > 0 THEN {mid} + {pa} ELSE instr({t}, {d}) END)"
    left = f"(CASE WHEN {p} > 0 THEN substr({t}, 1, {p} - 1) ELSE {t} END)"
    right = f"(CASE WHEN {p} > 0 THEN substr({t}, {p} + length({d})) ELSE '' END)"
    return left, right


def chunks(max_tokens: int = Q.CHUNK_TOKENS) -> str:
    def st(t, done, trunc):
        return f"{{'t': {t}, 'done': {done}, 'trunc': {trunc}}}"
    ctes = [f"""c0 AS (SELECT doc_id, sec_no, titles, {ntok(f"array_to_string(titles, {NN})")} AS tt,
  [{st('text', 'false', 'false')}] AS p FROM prep)"""]
    for r in range(1, corpus.MAX_RECURSION + 1):
        case = [f"WHEN x.done THEN [x]",
                f"WHEN tt + {ntok('x.t')} <= {max_tokens} THEN [{st('x.t', 'true', 'false')}]"]
        for d in corpus.RECURSIVE_DELIMITERS:
            left, right = _halves("x.t", s(d))
            case.append(f"WHEN {left} <> '' AND {right} <> '' THEN "
                        f"[{st(left, 'false', 'false')}, {st(right, 'false', 'false')}]")
        case.append(f"ELSE [{st('x.t', 'true', 'true')}]")
        ctes.append(f"""c{r} AS (SELECT doc_id, sec_no, titles, tt,
  flatten(list_transform(p, lambda x: CASE {' '.join(case)} END)) AS p FROM c{r - 1})""")
    last = corpus.MAX_RECURSION
    full = f"array_to_string(list_concat(titles, [x.t]), {NN})"
    trunc = f"array_to_string(list_slice(regexp_extract_all({full}, {TOKEN_WS}), 1, {max_tokens}), '')"
    ctes.append(f"""cu AS (SELECT doc_id, sec_no, titles, tt, unnest(generate_series(0, len(p) - 1)) AS piece_no,
  unnest(p) AS x FROM c{last}),
strings AS (SELECT doc_id, sec_no, piece_no, CASE WHEN x.trunc OR tt + {ntok('x.t')} > {max_tokens}
  THEN {trunc} ELSE {full} END AS text FROM cu)""")
    return ",\n".join(ctes)


def edges() -> str:
    top = ", ".join(f"('root', 'g{i}', 'category')" for i in range(4))
    return f"""esrc AS (SELECT doc_id, regexp_extract(source, '(\\d+)$', 1) AS n FROM documents),
edges AS (SELECT * FROM (VALUES {top}, ('root', 'root_page', 'page'), ('g0', 'g0_page', 'page'),
  ('src0', 'root', 'category'), ('g1', 'g0_page', 'page')) t(parent, child, kind)
  UNION ALL SELECT DISTINCT 'g' || CAST(CAST(n AS INTEGER) % 4 AS VARCHAR), 'src' || n, 'category'
  FROM esrc WHERE n <> ''
  UNION ALL SELECT 'src' || n, CAST(doc_id AS VARCHAR), 'page' FROM esrc WHERE n <> '')"""


def cat_pages(name: str, root: str, depth: int) -> str:
    ctes = [f"{name}_f0 AS (SELECT '{root}' AS cat)"]
    pages = []
    for d in range(depth + 1):
        ctes.append(f"{name}_p{d} AS (SELECT child AS title FROM edges WHERE kind = 'page' "
                    f"AND parent IN (SELECT cat FROM {name}_f{d}))")
        pages.append(f"SELECT title FROM {name}_p{d}")
        if d < depth:
            ctes.append(f"{name}_f{d + 1} AS (SELECT DISTINCT child AS cat FROM edges "
                        f"WHERE kind = 'category' AND parent IN (SELECT cat FROM {name}_f{d}))")
    ctes.append(f"{name} AS (SELECT DISTINCT title FROM ({' UNION ALL '.join(pages)}))")
    return ",\n".join(ctes)


def mail() -> str:
    return """lr AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
mail AS (SELECT c.conv_id AS mailbox, c.turn AS msg_no, c.role AS sender,
  regexp_extract(c.text, '^[^\\n]*', 0) AS subject,
  c.text || CASE WHEN c.turn % 5 = 4 THEN ' Microsoft Teams' ELSE '' END || ' http://x.example/'
    || CAST(c.turn AS VARCHAR) AS body,
  (c.role = 'user' AND (lr.last IS NULL OR lr.last < c.turn)) AS unread
  FROM conversations c LEFT JOIN lr USING (conv_id))"""


TOOL_LIST = "[" + ", ".join(f"'{x}'" for x in derived.TOOL_NAMES + [derived.UNKNOWN_TOOL]) + "]"
SQL_LIST = "[" + ", ".join(s(x) for x in derived.TOOL_SQL) + "]"
BAD_LIST = "[" + ", ".join(s(x) for x in derived.BAD_ARGUMENTS) + "]"


def calls() -> str:
    sql = f"CAST(to_json(struct_pack(query := {SQL_LIST}[CAST(conv_id % {len(derived.TOOL_SQL)} AS INTEGER) + 1])) AS VARCHAR)"
    cid = "'call_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR)"
    known = ", ".join(f"'{t}'" for t in derived.TOOL_NAMES)
    fields = ", ".join(
        f"CASE WHEN is_object AND json_type(arguments, '$.{k}') = 'VARCHAR' "
        f"THEN json_extract_string(arguments, '$.{k}') END AS {k}" for k in ("information", "query", "message"))
    return f"""asked AS (SELECT conv_id, turn, text, conv_id + turn AS place,
  {TOOL_LIST}[CAST((conv_id + turn) % 4 AS INTEGER) + 1] AS name FROM conversations WHERE role = 'user'),
calls2 AS (SELECT conv_id, turn, 0 AS call_no, {cid} AS call_id, name,
  CASE WHEN place % 13 = 0 THEN {BAD_LIST}[CAST(conv_id % {len(derived.BAD_ARGUMENTS)} AS INTEGER) + 1]
    WHEN name = 'get_information' THEN CAST(to_json(struct_pack(information := text)) AS VARCHAR)
    WHEN name = 'ask_database' THEN {sql}
    ELSE CAST(to_json(struct_pack(message := text)) AS VARCHAR) END AS arguments FROM asked
  UNION ALL SELECT conv_id, turn, 1, {cid} || '_1', 'ask_database', {sql} FROM asked WHERE place % 5 = 0),
checked AS (SELECT *, CASE WHEN json_valid(arguments) THEN json_type(arguments) = 'OBJECT' ELSE false END AS is_object
  FROM calls2),
parsed AS (SELECT *, {fields} FROM checked),
parsed2 AS (SELECT *, is_object AND CASE name WHEN 'get_information' THEN information IS NOT NULL
  WHEN 'ask_database' THEN query IS NOT NULL WHEN 'Answer_generic_questions' THEN message IS NOT NULL
  ELSE true END AS args_ok FROM parsed),
routed AS (SELECT *, CASE WHEN NOT args_ok THEN 'error' WHEN name = 'get_information' THEN 'retrieval'
    WHEN name = 'ask_database' THEN 'sql' WHEN name = 'Answer_generic_questions' THEN 'message'
    ELSE 'error' END AS route,
  CASE WHEN NOT args_ok AND name IN ({known}) THEN 'Error: malformed arguments for ' || name
    WHEN name = 'get_information' THEN information WHEN name = 'ask_database' THEN query
    WHEN name = 'Answer_generic_questions' THEN message
    ELSE 'Error: function ' || name || ' does not exist' END AS reply FROM parsed2)"""


def prompts(articles: str = "documents d ON d.doc_id = t.id") -> str:
    intro = context.DEFAULT_INTRO
    art = f"{s(context.ARTICLE_PREFIX)} || r.text || {s(context.ARTICLE_SUFFIX)}"
    return f"""ranked AS (SELECT t.qid, t.rank, d.text FROM topn t JOIN {articles}),
art AS (SELECT qid, rank, article, {ntok('article')} AS article_tokens FROM (
  SELECT r.qid, r.rank, {art} AS article FROM ranked r)),
cum AS (SELECT *, CAST(sum(article_tokens) OVER (PARTITION BY qid ORDER BY rank
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_tokens FROM art),
qs AS (SELECT item_id AS qid, text AS question,
  {ntok(f"{s(context.QUESTION_PREFIX)} || text")} AS qt FROM benchmark),
kept AS (SELECT c.* FROM cum c JOIN qs USING (qid)
  WHERE {ntok(s(intro))} + c.cum_tokens + qs.qt <= {context.TOKEN_BUDGET}),
prompts AS (SELECT qs.qid, coalesce(k.n, 0) AS n_articles,
  {s(intro)} || coalesce(k.arts, '') || {s(context.QUESTION_PREFIX)} || qs.question AS prompt
  FROM qs LEFT JOIN (SELECT qid, count(*) AS n, string_agg(article, '' ORDER BY rank) AS arts
  FROM kept GROUP BY qid) k USING (qid))"""


def request(prompt: str) -> str:
    return (f"to_json(struct_pack(model := '{context.DEFAULT_MODEL}', messages := ["
            f"{{'role': 'system', 'content': {s(context.DEFAULT_SYSTEM)}}}, "
            f"{{'role': 'user', 'content': {prompt}}}], temperature := CAST(0.0 AS DOUBLE)))")


def history(sys_prompt: str = toolcalls.DEFAULT_SYSTEM_PROMPT) -> str:
    return f"""hist AS (SELECT conv_id, turn, list_concat([{{'role': 'system', 'content': {s(sys_prompt)}}}],
  list({{'role': role, 'content': text}}) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h FROM conversations)"""


# ------------------------------------------------------------------ A. sources, sinks

ALERT_COLS = "SELECT * FROM alerts_table"
DEAL_COLS = "SELECT * FROM deals_table"
ORACLE["scan_csv"] = f"{with_(DEALS)} {DEAL_COLS}"
ORACLE["drop_index_col"] = f"{with_(ALERTS)} {ALERT_COLS}"
ORACLE["parse_vector_literal"] = """SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS dim,
  unnest(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6))) AS value FROM embeddings"""
ORACLE["sink_csv"] = """SELECT vec_id, label, len(embedding) AS width,
  round(CAST(embedding[1] AS DOUBLE), 6) AS "first", round(CAST(embedding[-1] AS DOUBLE), 6) AS "last"
  FROM embeddings"""
ORACLE["scan_table"] = f"{with_(DEALS)} {DEAL_COLS}"
ORACLE["create_table"] = f"{with_(ALERTS)} {ALERT_COLS}"
ORACLE["bulk_insert"] = f"{with_(DEALS)} {DEAL_COLS} UNION ALL {DEAL_COLS}"

BLOCKS = f"""bl AS (SELECT page_id, regexp_extract_all(html, {s(corpus.BLOCK_PATTERN)}) AS bl FROM pages),
blu AS (SELECT page_id, unnest(generate_series(0, len(bl) - 1)) AS block_no, unnest(bl) AS b FROM bl),
blocks AS (SELECT page_id, block_no, lower(regexp_extract(b, '^<([A-Za-z0-9]+)', 1)) AS tag,
  {strip("regexp_replace(b, '<[^>]*>', '', 'g')")} AS text FROM blu)"""
ORACLE["block_scan"] = f"{with_(BLOCKS)} SELECT * FROM blocks"
ORACLE["heading_sink"] = f"{with_(BLOCKS)} SELECT text AS value FROM blocks WHERE regexp_matches(tag, '^h[1-6]$')"
ORACLE["is_heading"] = (f"{with_(BLOCKS)} SELECT page_id, block_no, "
                        "coalesce(regexp_matches(tag, '^h[1-6]$'), false) AS is_heading FROM blocks")
ORACLE["category_pages"] = f"{with_(edges(), cat_pages('cp', 'root', Q.CATEGORY_DEPTH))} SELECT title FROM cp"
ORACLE["page_text_scan"] = (f"{with_(edges(), cat_pages('cp', 'root', Q.CATEGORY_DEPTH))} "
                            "SELECT cp.title, d.text FROM cp JOIN documents d ON CAST(d.doc_id AS VARCHAR) = cp.title")
IDX = """idx AS (SELECT row_number() OVER (ORDER BY e.vec_id) - 1 AS ix, e.vec_id, d.text, e.embedding
  FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id)"""
ORACLE["vector_index_build"] = f"{with_(IDX)} SELECT ix, vec_id, text, len(embedding) AS width FROM idx"
ORACLE["vector_index_save"] = (f"{with_(IDX)} SELECT ix, vec_id, len(embedding) AS width, "
                               "round(CAST(embedding[1] AS DOUBLE), 6) AS \"first\" FROM idx")
ORACLE["vector_index_load"] = with_(IDX, rank_cte(
    "r", "SELECT q.vec_id AS qid, c.ix AS id, "
         f"{score_expr('l2', 'CAST(q.embedding AS DOUBLE[])', 'CAST(c.embedding AS DOUBLE[])')} AS score "
         "FROM idx q CROSS JOIN idx c", "l2", Q.K_NN)) + " SELECT qid, id AS ix, score, rank FROM r"


def _num(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"


SYNTH = f"""syn AS (SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
  || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS alert_id,
  CAST('2023-01-01' AS DATE) + CAST({_num("'d' || k")} % 362 AS INTEGER) AS alert_date,
  'trader_' || CAST({_num("'t' || k")} % 50 AS VARCHAR) AS trader_id, 'deal_' || k AS deal_number,
  'model_' || CAST({_num("'m' || k")} % 5 + 1 AS VARCHAR) AS model_name,
  CAST(100 + {_num("'p' || k")} % 901 AS INTEGER) AS price,
  CAST(1 + {_num("'v' || k")} % 99 AS INTEGER) AS volume
  FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders))"""
ORACLE["synth_alerts_deals"] = f"{with_(SYNTH)} SELECT * FROM syn"
ORACLE["date_text"] = f"{with_(SYNTH)} SELECT alert_id, strftime(alert_date, '%Y-%m-%d') AS date_text FROM syn"
ORACLE["label_text"] = f"{with_(SYNTH)} SELECT alert_id, trader_id, deal_number, model_name FROM syn"

# ------------------------------------------------------------------ B.

ORACLE["filter_eq"] = f"{with_(DEALS)} {DEAL_COLS} WHERE deal_number = '{Q.FILTER_DEAL}'"
ORACLE["project_named"] = (f"{with_(DEALS)} SELECT deal_number AS deal, deal_date AS date, price, volume "
                           "FROM deals_table")
ORACLE["rename_cols"] = (f"{with_(DOC_EMB)} SELECT d.text, len(e.e) AS width, round(e.e[1], 6) AS e0 "
                         "FROM d_emb e JOIN documents d ON d.doc_id = e.id")
ORACLE["keep_section"] = (f"{with_(wiki(), summary())} SELECT doc_id, text FROM (SELECT doc_id, "
                          f"{clean('text')} AS text FROM summ) WHERE length(text) >= {TX.MIN_SECTION_CHARS}")
ORACLE["dedup_by_text"] = f"""{with_(DOC_EMB)} SELECT d.text, min(doc_id) AS pos, max(doc_id) AS last_pos,
  count(*) AS n_copies, arg_max(source, doc_id) AS source,
  CAST(to_json(list_transform(arg_max(e.e, doc_id), lambda x: CAST(round(x * 1000000) AS BIGINT))) AS VARCHAR) AS vec
  FROM documents d JOIN d_emb e ON e.id = d.doc_id GROUP BY d.text"""
ORACLE["distinct_titles"] = f"{with_(edges())} SELECT DISTINCT child AS title FROM edges WHERE kind = 'page'"
ORACLE["member_kind"] = (f"{with_(edges())} SELECT parent, count_if(kind = 'page') AS n_pages, "
                         "count_if(kind = 'category') AS n_categories FROM edges GROUP BY parent")
ORACLE["ignore_sections"] = (f"{with_(wiki(), tree(), prepared())} SELECT doc_id, sec_no, "
                             "array_to_string(titles, ' > ') AS path FROM kept_tree")
ORACLE["mail_filter"] = (f"{with_(mail())} SELECT mailbox, msg_no FROM mail WHERE sender <> '' AND "
                         "subject <> '' AND body <> '' AND NOT contains(lower(body), 'microsoft teams')")
ORACLE["preview"] = ("SELECT doc_id, substr(text, 1, 77) || '...' AS preview FROM documents "
                     "ORDER BY doc_id LIMIT 5")

# ------------------------------------------------------------------ C.

ORACLE["join_alert_deal"] = f"""{with_(ALERTS, DEALS)} SELECT a.alert_id, a.alert_date, a.trader_id,
  a.deal_number AS deal_number_x, a.model_name, d.deal_date, d.deal_number AS deal_number_y, d.price, d.volume
  FROM alerts_table a JOIN deals_table d ON a.alert_id = d.alert_id"""
ORACLE["lookup_text"] = (f"{with_(VEC, vec_rank('l2', Q.K_NN))} SELECT r.qid, r.rank, r.id, c.text "
                         "FROM r JOIN vc c ON c.id = r.id")
ORACLE["query_x_corpus"] = (f"{with_(VEC)} SELECT qid, count(score) AS n_scored, max(score) AS max_score, "
                            f"min(score) AS min_score FROM (SELECT q.qid, {score_expr('cosine', 'q.v', 'c.v')} "
                            "AS score FROM vq q CROSS JOIN vc c) GROUP BY qid")
ORACLE["category_children"] = (f"{with_(edges())} SELECT u.child AS parent, u.parent AS grandparent, "
                               "e.child, e.kind FROM edges u JOIN edges e ON e.parent = u.child "
                               "WHERE u.kind = 'category'")
INSTR = ", ".join(f"({s(a)}, {s(b)})" for a, b in toolcalls.DEFAULT_INSTRUCTIONS)
ORACLE["instructions_lookup"] = (f"{with_(calls())} SELECT c.call_id, c.name, i.instructions FROM calls2 c "
                                 f"LEFT JOIN (VALUES {INSTR}) i(type, instructions) ON c.name = i.type")

# ------------------------------------------------------------------ D.

PER_MODEL = "SELECT model_name, count(alert_id) AS alert_count FROM alerts_table GROUP BY model_name"
ORACLE["alerts_per_model"] = f"{with_(ALERTS)} {PER_MODEL}"
ORACLE["chunk_fixed"] = """SELECT doc_id, chunk_no, array_to_string(list_slice(ls, chunk_no * 5 + 1, chunk_no * 5 + 5), ' ') AS text
  FROM (SELECT doc_id, ls, unnest(generate_series(0, CAST(ceil(len(ls) / 5) AS INTEGER) - 1)) AS chunk_no
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))"""
ORACLE["pipeline_counts"] = f"""{with_(edges(), cat_pages('cp', 'root', Q.CATEGORY_DEPTH), wiki(), tree(),
                                      prepared(), chunks())}
  SELECT 'n_titles' AS metric, count(*) AS value FROM cp UNION ALL SELECT 'n_sections', count(*) FROM tree
  UNION ALL SELECT 'n_kept', count(*) FROM prep UNION ALL SELECT 'n_strings', count(*) FROM strings"""
ORACLE["result_text"] = (f"{with_(ALERTS)} SELECT '[' || string_agg(to_json(struct_pack(model_name := model_name, "
                         f"alert_count := alert_count)), ', ' ORDER BY model_name) || ']' AS result FROM ({PER_MODEL})")
ORACLE["unread_count"] = f"{with_(mail())} SELECT mailbox, count_if(unread) AS unread FROM mail GROUP BY mailbox"

# ------------------------------------------------------------------ E.

ORACLE["rank_per_query"] = f"{with_(VEC, vec_rank('cosine', Q.K_NN))} SELECT * FROM r"
ORACLE["budget_prefix"] = (f"{with_(DOC_EMB, BENCH_EMB, TOPN, prompts())} "
                           "SELECT qid, rank, article_tokens, cum_tokens FROM kept")
ORACLE["conversation_history"] = (f"{with_(history())} SELECT conv_id, turn, CAST(len(h) AS INTEGER) AS n_messages, "
                                  "to_json(h) AS history FROM hist")
ORACLE["order_check"] = """SELECT 'n_in' AS metric, count(*) AS value FROM documents
  UNION ALL SELECT 'n_out', count(*) FROM documents
  UNION ALL SELECT 'n_missing', 0 UNION ALL SELECT 'n_extra', 0
  UNION ALL SELECT 'n_repeated_ids', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
  UNION ALL SELECT 'n_wrong', 0"""

# ------------------------------------------------------------------ F.

ORACLE["sort_relatedness"] = f"{with_(VEC, vec_rank('cosine', None))} SELECT * FROM r"
ORACLE["topn_cosine"] = f"{with_(DOC_EMB, BENCH_EMB, TOPN)} SELECT * FROM topn"
ORACLE["knn_l2"] = f"{with_(VEC, vec_rank('l2', Q.K_NN))} SELECT * FROM r"
# the pivot index skips vectors, never rows of the result
ORACLE["knn_pruned"] = ORACLE["knn_l2"]
ORACLE["topn_pruned"] = ORACLE["topn_cosine"]
ORACLE["top_model"] = f"{with_(ALERTS)} {PER_MODEL} ORDER BY alert_count DESC, model_name LIMIT 1"
ORACLE["top_event_type"] = ("SELECT event_type, count(event_id) AS n_events FROM events GROUP BY event_type "
                            "ORDER BY n_events DESC, event_type LIMIT 1")
ORACLE["union_titles"] = (f"{with_(edges(), cat_pages('ga', 'g0', 1), cat_pages('gb', 'g1', 1))} "
                          "SELECT title FROM ga UNION SELECT title FROM gb")
ORACLE["concat_sections"] = (f"{with_(wiki(), summary(), tree())} SELECT 0 AS part, doc_id, 0 AS sec_no, text "
                             "FROM summ UNION ALL SELECT 1, doc_id, sec_no, text FROM tree")

# ------------------------------------------------------------------ G.

PAIRS = ("FROM embeddings e JOIN embeddings n ON n.vec_id = e.vec_id + 1")
ORACLE["cosine"] = (f"SELECT e.vec_id, n.vec_id AS next_id, "
                    f"{score_expr('cosine', 'CAST(e.embedding AS DOUBLE[])', 'CAST(n.embedding AS DOUBLE[])')} "
                    f"AS rel {PAIRS}")
ORACLE["l2_squared"] = (f"SELECT e.vec_id, n.vec_id AS next_id, "
                        f"{score_expr('l2', 'CAST(e.embedding AS DOUBLE[])', 'CAST(n.embedding AS DOUBLE[])')} "
                        f"AS dist {PAIRS}")
ORACLE["cast_float32"] = (f"{with_(DOC_EMB)} SELECT id AS doc_id, unnest(generate_series(0, len(e) - 1)) AS dim, "
                          "unnest(list_transform(CAST(e AS FLOAT[]), lambda x: round(CAST(x AS DOUBLE), 6))) AS value "
                          "FROM d_emb")
ORACLE["num_tokens"] = f"SELECT doc_id, {ntok('text')} AS n_tokens FROM documents"
ORACLE["clean_refs"] = f"{with_(wiki())} SELECT doc_id, {clean('markup')} AS text FROM wiki"
ORACLE["strip_heading"] = f"""{with_(wiki())} SELECT doc_id, pos, trim(line, '= ') AS title FROM (
  SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(markup, chr(10)) AS ls FROM wiki)) WHERE regexp_matches(line, {HEAD})"""
ORACLE["remove_urls"] = (f"{with_(mail())} SELECT mailbox, msg_no, "
                         f"regexp_replace(lower(body), {s(TX.URL_PATTERN)}, '', 'g') AS body FROM mail")
ORACLE["rstrip_question"] = (f"SELECT conv_id, turn, regexp_replace(text || ' ' || chr(10), "
                             f"{s(TX.TRAILING_SPACE_PATTERN)}, '', 'g') AS question FROM conversations "
                             "WHERE role = 'user'")


# as DuckDB must be asked where the statement repeats a column name
ASKED = {4: derived.TOOL_SQL[4].replace("d.alert_id, NULL", "d.alert_id AS alert_id_2, NULL").split("\n", 1)[1]}


def _sql_results() -> str:
    rows = []
    for k, stmt in enumerate(derived.TOOL_SQL):
        if k in derived.FAILING_SQL:
            rows.append(f"SELECT {s(stmt)} AS sql, false AS ok, CAST(NULL AS BIGINT) AS row_no, "
                        "CAST(NULL AS VARCHAR) AS row_json")
        else:
            rows.append(f"SELECT {s(stmt)} AS sql, true AS ok, row_no, row_json FROM (SELECT 1) one LEFT JOIN "
                        f"(SELECT row_number() OVER () - 1 AS row_no, CAST(to_json(t) AS VARCHAR) AS row_json "
                        f"FROM ({ASKED.get(k, stmt)}) t) r ON true")
    return "res AS (" + " UNION ALL ".join(rows) + ")"


PER_SQL = """per AS (SELECT sql, bool_and(ok) AS ok, count(row_json) AS n_rows,
  CASE WHEN bool_and(ok) THEN '[' || coalesce(string_agg(row_json, ', ' ORDER BY row_no), '') || ']'
  ELSE 'query failed with error: ' END AS content FROM res GROUP BY sql)"""
ORACLE["sql_batch"] = (f"{with_(ALERTS, DEALS, calls(), _sql_results())} SELECT sql, ok, row_no, row_json FROM res "
                       "WHERE sql IN (SELECT reply FROM routed WHERE route = 'sql')")
ORACLE["sql_tool_answer"] = f"""{with_(ALERTS, DEALS, calls(), _sql_results(), PER_SQL)}
  SELECT r.call_id, p.ok, p.n_rows, CASE WHEN p.ok THEN p.content END AS content
  FROM routed r JOIN per p ON p.sql = r.reply WHERE r.route = 'sql'"""

CATALOG = [
    ("alerts_table", [("alert_id", "string"), ("alert_date", "date"), ("trader_id", "string"),
                      ("deal_number", "string"), ("model_name", "string")]),
    ("deals_table", [("alert_id", "string"), ("deal_date", "date"), ("deal_number", "string"),
                     ("price", "double"), ("volume", "double")]),
]
ORACLE["catalog_tables"] = f"{with_(ALERTS, DEALS)} " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, {len(cols)} AS n_cols FROM {t}" for t, cols in CATALOG)
ORACLE["catalog_columns"] = f"{with_(ALERTS, DEALS)} " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {i + 1} AS ordinal, '{c}' AS column_name, '{ty}' AS data_type, "
    f"count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct FROM {t}"
    for t, cols in CATALOG for i, (c, ty) in enumerate(cols))
ORACLE["catalog_profile"] = f"{with_(ALERTS)} " + " UNION ALL ".join(
    f"SELECT 'alerts_table' AS table_name, {i + 1} AS ordinal, '{c}' AS column_name, '{ty}' AS data_type, "
    f"count({c}) AS non_null, true AS within FROM alerts_table" for i, (c, ty) in enumerate(CATALOG[0][1]))
COLUMNS = "columns_of AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {i} AS ordinal, '{c}' AS c, count({c}) AS non_null FROM {t}"
    for t, cols in CATALOG for i, (c, _) in enumerate(cols)) + ")"
ORACLE["catalog_info"] = (f"{with_(ALERTS, DEALS, COLUMNS)} SELECT table_name, CAST(to_json(list(c ORDER BY ordinal)) AS VARCHAR) "
                          "AS column_names, CAST(to_json(coalesce(list(c ORDER BY ordinal) FILTER (non_null = 0), [])) AS VARCHAR) "
                          "AS without_values FROM columns_of GROUP BY table_name")
SCHEMA_TEXT = "\n".join(f"Table: {t}\nColumns: {', '.join(c for c, _ in cols)}" for t, cols in CATALOG)
ORACLE["schema_text"] = (f"{with_(ALERTS, DEALS, COLUMNS)} SELECT string_agg('Table: ' || table_name || chr(10) || 'Columns: ' "
                         "|| cols, chr(10) ORDER BY table_name) AS schema_text FROM (SELECT table_name, "
                         "string_agg(c, ', ' ORDER BY ordinal) AS cols FROM columns_of GROUP BY table_name)")
ORACLE["section_summary"] = f"{with_(wiki(), summary())} SELECT doc_id, title AS path, text FROM summ"
ORACLE["section_tree"] = (f"{with_(wiki(), tree())} SELECT doc_id, sec_no, level, "
                          "array_to_string(titles, ' > ') AS path, text FROM tree")
ORACLE["section_string"] = (f"{with_(wiki(), tree(), prepared())} SELECT doc_id, sec_no, "
                            f"array_to_string(list_concat(titles, [text]), {NN}) AS string FROM prep")
_L, _R = _halves("text", "chr(10)")
ORACLE["halve"] = f"SELECT doc_id, {_L} AS left, {_R} AS right FROM documents"
ORACLE["truncate_tokens"] = (f"SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, {TOKEN_WS}), "
                             f"1, {Q.CHUNK_TOKENS}), '') AS text FROM documents")
ORACLE["chunk_recursive"] = (f"{with_(wiki(), tree(), prepared(), chunks())} SELECT doc_id, sec_no, piece_no, "
                             f"text, {ntok('text')} AS n_tokens FROM strings")
ORACLE["prompt_article"] = (f"{with_(DOC_EMB, BENCH_EMB, TOPN, prompts())} SELECT qid, rank, "
                            f"{s(context.ARTICLE_PREFIX)} || text || {s(context.ARTICLE_SUFFIX)} AS article "
                            "FROM ranked")
ORACLE["build_prompt"] = f"{with_(DOC_EMB, BENCH_EMB, TOPN, prompts())} SELECT * FROM prompts"
ORACLE["chat_request"] = (f"{with_(DOC_EMB, BENCH_EMB, TOPN, prompts())} SELECT qid, {request('prompt')} AS request "
                          "FROM prompts")
CHUNKS = """chunk_rows AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY block_no) - 1) // 5
  AS chunk_no, block_no, text FROM blocks WHERE NOT regexp_matches(tag, '^h[1-6]$') AND text <> ''),
page_chunks AS (SELECT page_id * 1000000 + chunk_no AS at_no, string_agg(text, ' ' ORDER BY block_no) AS text
  FROM chunk_rows GROUP BY page_id, chunk_no),
chunks AS (SELECT min(at_no) AS id, text FROM page_chunks GROUP BY text)"""
CHUNK_TOPN = rank_cte("topn", f"SELECT q.id AS qid, c.id AS id, {score_expr('cosine', 'q.e', 'c.e')} AS score "
                              "FROM q_emb q CROSS JOIN c_emb c", "cosine", Q.TOP_N)
ORACLE["answer_questions"] = (
    f"{with_(BLOCKS, CHUNKS, emb('c', 'SELECT id, text FROM chunks'), BENCH_EMB, CHUNK_TOPN, prompts('chunks d ON d.id = t.id'))} "
    f"SELECT qid, n_articles, {request('prompt')} AS request FROM prompts")
ORACLE["pluggable_similarity"] = with_(VEC, rank_cte(
    "r", "SELECT q.qid, c.id, round(-list_sum(list_transform(range(1, len(q.v) + 1), lambda i: abs(q.v[i] - c.v[i]))), 6) "
         "AS score FROM vq q CROSS JOIN vc c", "cosine", Q.K_NN)) + " SELECT * FROM r"
TOOLS_JSON = json.dumps(context.tool_definitions(SCHEMA_TEXT), ensure_ascii=False, separators=(",", ":"))
ORACLE["attach_tools"] = (f"{with_(history())} SELECT hist.conv_id, hist.turn, to_json(struct_pack(model := '{context.DEFAULT_MODEL}', "
                          f"messages := h, temperature := CAST(0.0 AS DOUBLE), tools := CAST({s(TOOLS_JSON)} AS JSON), "
                          "tool_choice := 'required')) AS request FROM hist SEMI JOIN "
                          "(SELECT * FROM conversations WHERE role = 'user') c USING (conv_id, turn)")
ORACLE["parse_tool_call"] = (f"{with_(calls())} SELECT call_id, call_no, name, args_ok, information, query, message "
                             "FROM parsed2")
ORACLE["route_tool_call"] = f"{with_(calls())} SELECT call_id, route, reply FROM routed"
ASKED_EMB = emb("r", "SELECT call_id AS id, reply AS text FROM routed WHERE route = 'retrieval'")
NEAREST = rank_cte("rtop", f"SELECT r.id AS qid, d.id AS id, {score_expr('cosine', 'r.e', 'd.e')} AS score "
                           "FROM r_emb r CROSS JOIN d_emb d", "cosine", 1)
_ARTICLE = f"{s(context.ARTICLE_PREFIX)} || d.text || {s(context.ARTICLE_SUFFIX)}"
_QUESTION = f"{s(context.QUESTION_PREFIX)} || c.reply"
ORACLE["append_reply"] = f"""{with_(ALERTS, DEALS, calls(), _sql_results(), PER_SQL, DOC_EMB, ASKED_EMB, NEAREST)},
answers AS (SELECT c.call_id, string_split(d.text, chr(10))[1] AS answer FROM rtop t JOIN documents d ON d.doc_id = t.id
  JOIN routed c ON c.call_id = t.qid
  WHERE {ntok(s(context.DEFAULT_INTRO))} + {ntok(_ARTICLE)} + {ntok(_QUESTION)} <= {context.TOKEN_BUDGET})
SELECT conv_id, turn, 0 AS seq, role, CAST(NULL AS VARCHAR) AS call_id, text AS content FROM conversations
UNION ALL SELECT c.conv_id, c.turn, 2 * c.call_no + 1, 'assistant', c.call_id,
  CASE WHEN c.route = 'retrieval' THEN coalesce(a.answer, {s(toolcalls.NO_ANSWER)}) ELSE c.reply END
  FROM routed c LEFT JOIN answers a USING (call_id)
UNION ALL SELECT c.conv_id, c.turn, 2 * c.call_no + 2, 'tool', c.call_id, p.content
  FROM routed c JOIN per p ON p.sql = c.reply WHERE c.route = 'sql'"""
ORACLE["second_request"] = f"""{with_(ALERTS, DEALS, calls(), _sql_results(), PER_SQL, history())}
SELECT c.conv_id, c.turn, c.call_id, to_json(struct_pack(model := '{context.DEFAULT_MODEL}',
  messages := list_concat(list_transform(h.h, lambda m: to_json(m)), [
    to_json(struct_pack("role" := 'assistant', content := c.reply)),
    to_json(struct_pack("role" := 'tool', content := p.content, tool_call_id := c.call_id, name := c.name))]),
  temperature := CAST(0.0 AS DOUBLE), tool_choice := 'auto')) AS request
FROM routed c JOIN per p ON p.sql = c.reply JOIN hist h ON h.conv_id = c.conv_id AND h.turn = c.turn
WHERE c.route = 'sql'"""
ORACLE["score_text"] = (f"{with_(DOC_EMB, BENCH_EMB, TOPN)} SELECT qid, rank, 'relatedness=' || "
                        "CAST(CAST(CAST(score AS DECIMAL(18, 6)) AS DECIMAL(18, 2)) AS VARCHAR) AS score_text FROM topn")

# ------------------------------------------------------------------ H.

ORACLE["embed_texts"] = (f"{with_(DOC_EMB)} SELECT id AS doc_id, unnest(generate_series(0, len(e) - 1)) AS dim, "
                         "unnest(list_transform(e, lambda x: round(x, 6))) AS value FROM d_emb")
ORACLE["embed_query"] = (f"{with_(BENCH_EMB)} SELECT id AS item_id, unnest(generate_series(0, len(e) - 1)) AS dim, "
                         "unnest(list_transform(e, lambda x: round(x, 6))) AS value FROM q_emb")

# ------------------------------------------------------------------ I.

ORACLE["stream_route"] = ORACLE["route_tool_call"]
ORACLE["stream_history"] = ORACLE["conversation_history"]
ORACLE["insert_keyed"] = (f"{with_(ALERTS)} SELECT alert_id, deal_number, CAST(NULL AS VARCHAR) AS reason FROM alerts_table "
                          "UNION ALL SELECT alert_id, deal_number, 'key exists' FROM alerts_table "
                          "WHERE CAST(alert_id AS BIGINT) % 2 = 0")
ORACLE["stream_answers"] = ORACLE["append_reply"]
