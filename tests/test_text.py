from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import corpus


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_num_tokens_counts_words_and_marks(spark):
    assert one(spark, T.num_tokens("x"), "Hello, wörld_1 !") == 4
    assert one(spark, T.num_tokens("x"), "") == 0
    assert one(spark, T.num_tokens("x"), None) == 0


def test_token_counts_add_up_at_white_space(spark):
    a, b = "one two, three", "\n\nfour five."
    assert one(spark, T.num_tokens("x"), a + b) == one(spark, T.num_tokens("x"), a) + one(
        spark, T.num_tokens("x"), b)


def test_truncate_is_exact_prefix(spark):
    s = "  alpha beta, gamma\n delta"
    out = one(spark, T.truncate_tokens("x", 3), s)
    assert s.startswith(out) and out == "  alpha beta,"
    assert one(spark, T.truncate_tokens("x", 100), s) == s.rstrip()


def test_clean_refs_cases(spark):
    assert one(spark, T.clean_refs("x"), "a<ref>1</ref>b<ref>2</ref>c") == "abc"
    assert one(spark, T.clean_refs("x"), "a<ref>1\n2</ref>b") == "a<ref>1\n2</ref>b"
    assert one(spark, T.clean_refs("x"), "\n  text \n") == "text"


def test_strip_heading_and_rstrip(spark):
    assert one(spark, T.strip_heading("x"), "== See also ==") == "See also"
    assert one(spark, T.rstrip_ws("x"), "why? \n\t") == "why?"


def test_keep_section_bounds(spark):
    assert not one(spark, T.keep_section("x"), "a" * 15)
    assert one(spark, T.keep_section("x"), "a" * 16)


def test_preview_adds_dots_even_to_short_text(spark):
    assert one(spark, T.preview("x"), "short") == "short..."
    assert one(spark, T.preview("x"), "y" * 100) == "y" * 77 + "..."


def test_remove_urls(spark):
    assert one(spark, T.remove_urls("x"), "See HTTPS://a.b/c now") == "see  now"


def test_score_text_rounds_half_up(spark):
    assert one(spark, T.score_text("x"), 0.125, "x double") == "relatedness=0.13"
    assert one(spark, T.score_text("x"), 0.874999, "x double") == "relatedness=0.87"


def test_halve_rule(spark):
    df = spark.createDataFrame([("aa\nbb\ncc\ndd",), ("no delimiter",), ("\nlead",)], "x string")
    left, right = T.halve(F.col("x"), "\n")
    rows = df.select(left.alias("l"), right.alias("r")).collect()
    assert (rows[0]["l"], rows[0]["r"]) == ("aa\nbb", "cc\ndd")
    assert (rows[1]["l"], rows[1]["r"]) == ("no delimiter", "")
    assert rows[2]["l"] == ""  # empty half: "no split here"


def test_block_scan_tags(spark):
    pages = spark.createDataFrame(
        [(1, "<h1>Title</h1><p class='x'>One <b>two</b></p><ul><li>item</li></ul>")],
        "page_id long, html string")
    rows = corpus.block_scan(pages).orderBy("block_no").collect()
    assert [(r.tag, r.text) for r in rows] == [("h1", "Title"), ("p", "One two"), ("li", "item")]
