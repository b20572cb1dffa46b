from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import corpus


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, markup string")


def test_chunk_fixed_five_and_six_paragraphs(spark):
    d = spark.createDataFrame([(1, "\n".join("abcde")), (2, "\n".join("abcdef"))], "doc_id long, text string")
    rows = corpus.chunk_fixed(d).orderBy("doc_id", "chunk_no").collect()
    assert [(r.doc_id, r.text) for r in rows] == [(1, "a b c d e"), (2, "a b c d e"), (2, "f")]


def test_section_tree_paths_and_skipped_level(spark):
    text = "\n".join(["intro", "== A ==", "a", "=== B ===", "b", "==== C ====", "c",
                      "== D ==", "d", "==== E ====", "e"])
    rows = corpus.section_tree(docs(spark, [(1, "P", text)])).orderBy("sec_no").collect()
    got = [(r.sec_no, r.level, r.titles, r.text) for r in rows]
    assert got == [(0, 1, ["P"], "intro"), (1, 2, ["P", "== A =="], "a"), (2, 3, ["P", "== A ==", "=== B ==="], "b"),
                   (3, 4, ["P", "== A ==", "=== B ===", "==== C ===="], "c"), (4, 2, ["P", "== D =="], "d"),
                   (5, 4, ["P", "== D ==", "==== E ===="], "e")]


def test_ignored_section_drops_its_subtree(spark):
    text = "\n".join(["intro", "== See also ==", "x", "=== Child ===", "y", "== Keep ==", "z"])
    tree = corpus.section_tree(docs(spark, [(1, "P", text)]))
    kept = corpus.ignore_sections(tree).orderBy("sec_no").collect()
    assert [r.titles for r in kept] == [["P"], ["P", "== Keep =="]]


def test_summary_without_and_with_heading(spark):
    d = docs(spark, [(1, "P", "only text\nmore"), (2, "Q", "lead\n== H ==\nbody"), (3, "R", "== H ==\nx")])
    rows = {r.doc_id: r.text for r in corpus.section_summary(d).collect()}
    assert rows == {1: "only text\nmore", 2: "lead", 3: ""}


def test_recursive_chunk_without_delimiter_is_truncated(spark):
    s = spark.createDataFrame([(1, 0, ["T"], " ".join(["w"] * 50))],
                              "doc_id long, sec_no long, titles array<string>, text string")
    rows = corpus.chunk_recursive(s, max_tokens=10).collect()
    assert len(rows) == 1 and rows[0].n_tokens == 10
    assert ("T\n\n" + " ".join(["w"] * 50)).startswith(rows[0].text)


def test_recursive_chunks_fit_and_rebuild_text(spark):
    paras = [" ".join(f"w{i}_{j}" for j in range(7)) for i in range(12)]
    text = "\n\n".join(paras)
    s = spark.createDataFrame([(1, 0, ["Title"], text)],
                              "doc_id long, sec_no long, titles array<string>, text string")
    rows = corpus.chunk_recursive(s, max_tokens=20).orderBy("piece_no").collect()
    assert len(rows) > 1 and all(r.n_tokens <= 20 for r in rows)
    bodies = [r.text[len("Title\n\n"):] for r in rows]
    assert all(r.text.startswith("Title\n\n") for r in rows)
    assert "".join(bodies).replace("\n", "") == text.replace("\n", "")


def test_dedup_first_position_last_value(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "pos long, text string, v double")
    rows = {r.text: (r.pos, r.v) for r in corpus.dedup_by_text(df, "pos", value_col="v").collect()}
    assert rows == {"a": (0, 3.0), "b": (1, 2.0)}


def test_category_descent_depth_and_cycle(spark):
    edges = spark.createDataFrame(
        [("root", "c1", "category"), ("c1", "c2", "category"), ("c2", "root", "category"),
         ("root", "p0", "page"), ("c1", "p1", "page"), ("c2", "p2", "page"), ("c1", "p0", "page")],
        "parent string, child string, kind string")
    got = lambda d: sorted(r.title for r in corpus.category_pages(edges, "root", d).collect())
    assert got(0) == ["p0"]
    assert got(1) == ["p0", "p1"]
    assert got(5) == ["p0", "p1", "p2"]


def test_category_descent_with_frontier_checkpoints(spark):
    edges = spark.createDataFrame(
        [(f"c{i}", f"c{i + 1}", "category") for i in range(6)] + [(f"c{i}", f"p{i}", "page") for i in range(7)],
        "parent string, child string, kind string")
    got = sorted(r.title for r in corpus.category_pages(edges, "c0", 6, broadcast_categories=0).collect())
    assert got == [f"p{i}" for i in range(7)]
