"""Corpus preparation: blocks, headings, sections, cleaning, chunking, and
category descent.

Per-document work (splitting, sections, chunking) is done inside the row with
array expressions, so it needs no shuffle.  Category descent joins each level's
new categories to the category edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage

# Fixed values (markup rules of the corpus).
BLOCK_PATTERN = r"(?is)<(?:h1|p|li)\b[^>]*>.*?</(?:h1|p|li)>"
TAG_PATTERN = r"<[^>]*>"
HEADING_LINE_PATTERN = r"^={2,6}[^=].*={2,6}\s*$"
FIXED_CHUNK_PARAGRAPHS = 5
# Section titles whose section (and its whole subtree) is dropped; listed as
# in the original pipeline, "Footnotes" appears twice.
SECTIONS_TO_IGNORE = [
    "See also",
    "References",
    "External links",
    "Further reading",
    "Footnotes",
    "Bibliography",
    "Sources",
    "Citations",
    "Literature",
    "Footnotes",
    "Notes and references",
    "Photo gallery",
    "Works cited",
    "Photos",
    "Gallery",
    "Notes",
    "References and sources",
    "References and notes",
]
SECTION_JOIN = "\n\n"
RECURSIVE_DELIMITERS = ("\n\n", "\n", ". ")
MAX_RECURSION = 5


# --------------------------------------------------------------------------
# Blocks of landed markup (pages)

def block_scan(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, block_no, tag, text)``: heading, paragraph and list blocks
    in document order; tags are removed from the text."""
    blocks = F.regexp_extract_all(F.col(html_col), F.lit(BLOCK_PATTERN), 0)
    return (pages.select(id_col, F.posexplode(blocks).alias("block_no", "_b"))
            .select(id_col, "block_no",
                    F.lower(F.regexp_extract("_b", r"^<([A-Za-z0-9]+)", 1)).alias("tag"),
                    T.strip_ws(F.regexp_replace("_b", TAG_PATTERN, "")).alias("text")))


def page_chunks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                size: int = FIXED_CHUNK_PARAGRAPHS) -> DataFrame:
    """``(page_id, chunk_no, text)``: every ``size`` consecutive paragraph and
    list blocks of a page, headings left out, joined with one space.  Blocks
    without text are passed over.  Done inside each row: no shuffle."""
    blocks = F.regexp_extract_all(F.col(html_col), F.lit(BLOCK_PATTERN), 0)
    body = F.filter(blocks, lambda b: ~F.lower(F.regexp_extract(b, r"^<([A-Za-z0-9]+)", 1)).rlike("^h[1-6]$"))
    texts = F.filter(F.transform(body, lambda b: T.strip_ws(F.regexp_replace(b, TAG_PATTERN, ""))), lambda t: t != "")
    rows = pages.select(id_col, texts.alias("_ps")).where(F.size("_ps") > 0)
    starts = F.sequence(F.lit(1), F.size("_ps"), F.lit(size))
    return (rows.select(id_col, "_ps", F.posexplode(starts).alias("chunk_no", "_at"))
            .select(id_col, "chunk_no", F.array_join(F.slice("_ps", F.col("_at"), F.lit(size)), " ").alias("text")))


def is_heading_tag(tag) -> Column:
    return F.coalesce(T._c(tag).rlike("^h[1-6]$"), F.lit(False))


# --------------------------------------------------------------------------
# Paragraphs and fixed-size chunks

def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, pos, text)``, one row per line; empty lines are kept."""
    return (docs.where(F.col(text_col).isNotNull())
            .select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "text")))


def chunk_fixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                size: int = FIXED_CHUNK_PARAGRAPHS) -> DataFrame:
    """Every ``size`` consecutive paragraphs of a document joined with one
    space; the last chunk may be short.  Done inside each row: no shuffle."""
    # the lines are a column of their own: split once, not once per chunk
    lines = docs.where(F.col(text_col).isNotNull()).select(id_col, F.split(F.col(text_col), "\n").alias("_ls"))
    starts = F.sequence(F.lit(1), F.size("_ls"), F.lit(size))
    return (lines.select(id_col, "_ls", F.posexplode(starts).alias("chunk_no", "_at"))
            .select(id_col, "chunk_no", F.array_join(F.slice("_ls", F.col("_at"), F.lit(size)), " ").alias("text")))


def dedup_by_text(df: DataFrame, pos_col: str, text_col: str = "text",
                  value_col: str | None = None, value_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per distinct text: first position kept, the last row's values
    (a vector, say) win.

    A plain aggregate: partial aggregation before the shuffle collapses a hot
    text to one row per task.
    """
    aggs = [F.min(pos_col).alias("pos"), F.max(pos_col).alias("last_pos"),
            F.count(F.lit(1)).alias("n_copies")]
    aggs += [F.max_by(c, pos_col).alias(c) for c in (*value_cols, *([value_col] if value_col else []))]
    return df.groupBy(text_col).agg(*aggs)


# --------------------------------------------------------------------------
# Wiki-style markup and sections

def heading_level(line) -> Column:
    l = T._c(line)
    return F.when(l.rlike(HEADING_LINE_PATTERN),
                  F.length(F.regexp_extract(l, r"^(=+)", 1))).otherwise(F.lit(0))


def section_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "markup",
                    title_col: str = "title") -> DataFrame:
    """Text before the first heading (whole text without headings); titles
    are ``[page title]``.  ``(doc_id, titles, text)``."""
    lines = F.split(F.col(text_col), "\n")
    first = F.array_position(F.transform(lines, lambda l: l.rlike(HEADING_LINE_PATTERN)), True)
    summary = F.when(first > 0, F.array_join(F.slice(lines, F.lit(1), first - 1), "\n")) \
        .otherwise(F.col(text_col))
    return docs.select(id_col, F.array(F.col(title_col)).alias("titles"), summary.alias("text"))


def _raw_sql(x: str) -> str:
    """A raw Spark SQL string literal (backslashes kept as they are)."""
    if "'" in x:
        raise ValueError("pattern must not hold a single quote")
    return "r'" + x + "'"


def section_tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "markup",
                 title_col: str = "title", max_level: int = 6) -> DataFrame:
    """Flatten nested sections to ``(doc_id, sec_no, level, titles, text)``.

    Section 0 is the summary (level 1, titles ``[page title]``), present when
    text precedes the first heading.  A heading's own text runs to the next
    heading of any level.  Its title path holds the heading lines as they
    stand: for each level ``k`` up to its own, the last heading at level
    ``<= k`` when that heading is at level exactly ``k``; a skipped level
    therefore keeps the section under its nearest shallower heading.

    Every document is one row, so all of it is computed inside the row with
    array functions: no shuffle of the text, no window.  The last heading up to
    each level is a running maximum over the headings, found by doubling
    distances, so the work is n log n in the number of headings.
    """
    head = _raw_sql(HEADING_LINE_PATTERN)
    levels = list(range(2, max_level + 1))
    base = docs.select(F.col(id_col), F.col(title_col), F.split(F.col(text_col), "\n", -1).alias("_ls"))
    # line number and level of each heading
    base = base.withColumn("_hs", F.expr(
        f"""filter(transform(_ls, (l, i) -> named_struct('i', i, 'v',
            CASE WHEN l RLIKE {head} THEN length(regexp_extract(l, '^(=+)', 1)) ELSE 0 END)), x -> x.v > 0)"""))
    # _up[j][k]: the last heading m <= k with level <= j, or -1
    ups = ", ".join(
        f"""aggregate(sequence(0, CAST(ceil(log2(size(_hs) + 1)) AS INT)),
            transform(_hs, (x, k) -> CASE WHEN x.v <= {j} THEN k ELSE -1 END),
            (r, t) -> transform(r, (x, k) -> CASE WHEN k >= shiftleft(1, t)
                THEN greatest(x, r[k - shiftleft(1, t)]) ELSE x END))""" for j in levels)
    base = base.withColumn("_up", F.expr(f"array({ups})"))
    path = ", ".join(f"CASE WHEN x.v >= {j} AND _up[{n}][k] >= 0 AND _hs[greatest(_up[{n}][k], 0)].v = {j} "
                     f"THEN _ls[_hs[greatest(_up[{n}][k], 0)].i] END" for n, j in enumerate(levels))
    heads = f"""transform(_hs, (x, k) -> named_struct(
        'sec_no', k + 1, 'lvl', x.v,
        'text', array_join(slice(_ls, x.i + 2,
                 (CASE WHEN k + 1 < size(_hs) THEN _hs[k + 1].i ELSE size(_ls) END) - x.i - 1), chr(10)),
        'path', filter(array({path}), y -> y IS NOT NULL)))"""
    summary = """CASE WHEN size(_hs) = 0 OR _hs[0].i > 0 THEN array(named_struct(
        'sec_no', 0, 'lvl', 1,
        'text', array_join(slice(_ls, 1, CASE WHEN size(_hs) = 0 THEN size(_ls) ELSE _hs[0].i END), chr(10)),
        'path', CAST(array() AS array<string>))) ELSE array() END"""
    # exploded where they are built: only finished sections leave, and no projection
    # on top can be merged with the ones below, which would repeat their work
    secs = base.select(id_col, title_col, F.explode(F.expr(f"concat({summary}, {heads})")).alias("s"))
    return secs.select(id_col, F.col("s.sec_no").cast("long").alias("sec_no"), F.col("s.lvl").alias("level"),
                       F.concat(F.array(F.col(title_col)), F.col("s.path")).alias("titles"),
                       F.col("s.text").alias("text"))


def ignore_sections(sections: DataFrame, ignore=SECTIONS_TO_IGNORE,
                    titles_col: str = "titles") -> DataFrame:
    """Drop a section whose title, or any ancestor title, is in ``ignore`` once
    its ``=`` signs and spaces are stripped.  The page title (first element) is
    not checked."""
    return sections.where(~_ignored(titles_col, ignore))


def _ignored(titles_col: str, ignore) -> Column:
    lst = F.array(*[F.lit(x) for x in dict.fromkeys(ignore)])
    hit = F.exists(F.slice(F.col(titles_col), 2, 1 << 20), lambda t: F.array_contains(lst, T.strip_heading(t)))
    return F.coalesce(hit, F.lit(False))


def clean_and_keep(sections: DataFrame, text_col: str = "text",
                   min_chars: int = T.MIN_SECTION_CHARS) -> DataFrame:
    """Remove reference markup, strip, keep texts of at least ``min_chars``."""
    return (sections.withColumn(text_col, T.clean_refs(F.col(text_col)))
            .where(T.keep_section(F.col(text_col), min_chars)))


def section_counts(tree: DataFrame, max_tokens: int = 1600, ignore=SECTIONS_TO_IGNORE,
                   min_chars: int = T.MIN_SECTION_CHARS) -> DataFrame:
    """One pass over a section tree: ``(n_sections, n_kept, n_strings)`` -
    sections found, sections left after the ignore list, cleaning and the
    length filter, and the strings recursive chunking makes of them."""
    ignored = _ignored("titles", ignore)
    flagged = tree.select("doc_id", "sec_no", "titles", T.clean_refs(F.col("text")).alias("text"),
                          ignored.alias("_ign"))
    flagged = flagged.withColumn("_kept", ~F.col("_ign") & T.keep_section(F.col("text"), min_chars))
    # chunk only kept sections; others carry an empty text and are not counted
    parts = chunk_parts(flagged.withColumn("text", F.when(F.col("_kept"), F.col("text")).otherwise(F.lit(""))),
                        max_tokens, keep=("_kept",))
    return parts.agg(F.count(F.lit(1)).alias("n_sections"),
                     F.count_if(F.col("_kept")).alias("n_kept"),
                     F.sum(F.when(F.col("_kept"), F.size("_p")).otherwise(0)).cast("long").alias("n_strings"))


def section_string(titles, text) -> Column:
    return F.array_join(F.concat(T._c(titles), F.array(T._c(text))), SECTION_JOIN)


def _sql_count(x: str) -> str:
    return f"coalesce(regexp_count({x}, r'{T.TOKEN_PATTERN}'), 0)"


def _sql_split_at(t: str, delim: str) -> str:
    """SQL text: where ``functions.text.halve`` cuts ``t``, or 0 if a half is empty."""
    d = " || ".join(f"char({ord(ch)})" for ch in delim)
    d = f"({d})" if len(delim) > 1 else d
    mid = f"CAST(floor(char_length({t}) / 2) AS INT)"
    at = f"transform(array(locate({d}, {t}, {mid} + 1)), x -> CASE WHEN x > 0 THEN x ELSE locate({d}, {t}, 1) END)"
    return (f"element_at(transform({at}, x -> CASE WHEN x > 1 AND x + {len(delim)} <= char_length({t}) "
            f"THEN x ELSE 0 END), 1)")


def _sql_part(t: str, n: str, done: bool, trunc: bool) -> str:
    return (f"named_struct('t', {t}, 'n', {n}, 'done', {str(done).lower()}, "
            f"'trunc', {str(trunc).lower()})")


def _split_round_sql(parts: str, title_tokens: str, max_tokens: int) -> str:
    """One halving round as a SQL lambda (built once, parsed by Spark).  A
    delimiter's split position is looked for once, and only if the ones before
    it cannot be used; the text is cut once and each half counted once.  Each
    piece carries its token count ``n``; counts add up at white-space joins."""
    tail = f"array({_sql_part('p.t', 'p.n', True, True)})"
    for d in reversed(RECURSIVE_DELIMITERS):
        halves = f"array(substr(p.t, 1, x - 1), substr(p.t, x + {len(d)}))"
        cut = f"transform({halves}, h -> {_sql_part('h', _sql_count('h'), False, False)})"
        tail = (f"element_at(transform(array({_sql_split_at('p.t', d)}), "
                f"x -> CASE WHEN x > 0 THEN {cut} ELSE {tail} END), 1)")
    case = [f"WHEN p.done THEN array(p)",
            f"WHEN {title_tokens} + p.n <= {int(max_tokens)} THEN array({_sql_part('p.t', 'p.n', True, False)})",
            f"ELSE {tail}"]
    return f"flatten(transform({parts}, p -> CASE {' '.join(case)} END))"


def chunk_recursive(sections: DataFrame, max_tokens: int = 1600,
                    max_recursion: int = MAX_RECURSION, titles_col: str = "titles",
                    text_col: str = "text", keys=("doc_id", "sec_no")) -> DataFrame:
    """Split each section until its string (titles included) fits
    ``max_tokens``: at most ``max_recursion`` halvings per branch, trying the
    delimiters ``\\n\\n``, ``\\n``, ``". "`` in turn; a piece without a usable
    delimiter, or still too long after the last halving, is truncated.  Every
    piece repeats the titles.  ``(keys..., piece_no, text, n_tokens)``.

    All rounds run inside the row (no shuffle).  The text is counted once;
    a split counts only its two halves, and the output count follows from
    the carried counts (a truncated piece has exactly ``max_tokens``).
    """
    df = chunk_parts(sections, max_tokens, max_recursion, titles_col, text_col, keys)
    out = df.select(*keys, titles_col, "_tt", F.posexplode("_p").alias("piece_no", "_x"))
    full = section_string(F.col(titles_col), F.col("_x.t"))
    total = F.col("_tt") + F.col("_x.n")
    cut = F.col("_x.trunc") | (total > max_tokens)
    return out.select(*keys, "piece_no",
                      F.when(cut, T.truncate_tokens(full, max_tokens)).otherwise(full).alias("text"),
                      F.when(cut, F.least(total, F.lit(max_tokens))).otherwise(total)
                      .cast("int").alias("n_tokens"))


def chunk_parts(sections: DataFrame, max_tokens: int = 1600, max_recursion: int = MAX_RECURSION,
                titles_col: str = "titles", text_col: str = "text",
                keys=("doc_id", "sec_no"), keep=()) -> DataFrame:
    """The halving rounds of :func:`chunk_recursive` without the explode:
    ``(keys..., titles, _tt, _p)`` where ``_p`` is the ordered array of
    pieces ``struct<t, n, done, trunc>`` (``size(_p)`` pieces per section)."""
    titles_str = F.array_join(F.col(titles_col), SECTION_JOIN)
    df = sections.select(*keys, *keep, titles_col, T.num_tokens(titles_str).alias("_tt"),
                         T.num_tokens(F.col(text_col)).alias("_n0"), F.col(text_col).alias("_t0"))
    df = df.select(*keys, *keep, titles_col, "_tt",
                   F.expr(f"array({_sql_part('_t0', '_n0', False, False)})").alias("_p"))
    one_round = F.expr(_split_round_sql("_p", "_tt", max_tokens))
    for _ in range(max_recursion):
        df = df.withColumn("_p", one_round)
    return df


# --------------------------------------------------------------------------
# Category tree

def category_pages(edges: DataFrame, root: str, max_depth: int,
                   broadcast_categories: int = 100_000) -> DataFrame:
    """Distinct page titles under ``root``: pages directly under a category
    are taken, subcategories are descended while depth remains.  The depth
    bound also ends cycles.  ``(title)``.

    The descent runs on the category edges alone, stored once; each level is
    one join of its new categories with them, written to the shared folder, so
    no plan grows with the depth.  Page edges are read once, in the end, against
    all categories found: broadcast if there are at most
    ``broadcast_categories`` of them (counted), else by a plain join, which
    adaptive execution splits where one category holds many pages.
    """
    spark = edges.sparkSession
    e = edges.select("parent", "child", "kind")
    down = cut_lineage(e.where(F.col("kind") == "category").select("parent", F.col("child").alias("cat")).distinct())
    level = spark.createDataFrame([(root,)], "cat string")
    seen = level
    for _ in range(max_depth):
        level = (down.join(level.select(F.col("cat").alias("parent")), "parent", "left_semi")
                 .select("cat").distinct().join(seen, "cat", "left_anti"))
        level = cut_lineage(level)
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    cats = cut_lineage(seen.select(F.col("cat").alias("parent")))
    if cats.count() <= broadcast_categories:
        cats = F.broadcast(cats)
    pages = e.where(F.col("kind") == "page").join(cats, "parent", "left_semi")
    return pages.select(F.col("child").alias("title")).distinct()


def category_children(edges: DataFrame) -> DataFrame:
    """Two-level membership: ``(grandparent, parent, child, kind)`` by the
    self-join ``child = parent``."""
    up = edges.where(F.col("kind") == "category").select(
        F.col("parent").alias("grandparent"), F.col("child").alias("parent"))
    return up.join(edges.select("parent", "child", "kind"), "parent")
