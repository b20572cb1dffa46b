"""Text column expressions.

All patterns are Java regular expressions that also mean the same in RE2, so
the DuckDB oracle can state the same rule.  ``\\p{L}`` is used instead of
``\\w`` (ASCII only in Java), ``[^\\n]`` instead of ``.``, and no counted
repetition of groups is applied to long text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (patterns and formats).
# A token is a run of letters, digits and underscores, or one other
# non-space character.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# The same token with the white space before it, so matches tile a prefix.
TOKEN_WITH_SPACE_PATTERN = r"\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
# Inline reference markup, shortest match, never across a newline.
REF_PATTERN = r"<ref[^\n]*?</ref>"
URL_PATTERN = r"https?://\S+"
EDGE_SPACE_PATTERN = r"^\s+|\s+$"
TRAILING_SPACE_PATTERN = r"\s+$"
PREVIEW_CHARS = 77
MIN_SECTION_CHARS = 16


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), 0)


def num_tokens(text) -> Column:
    """Token count; whitespace never forms a token, so counts add up when
    two texts are joined at white space."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(TOKEN_PATTERN)), F.lit(0))


def truncate_tokens(text, max_tokens) -> Column:
    """Exact prefix of ``text`` holding its first ``max_tokens`` tokens."""
    n = max_tokens if isinstance(max_tokens, Column) else F.lit(int(max_tokens))
    parts = F.regexp_extract_all(_c(text), F.lit(TOKEN_WITH_SPACE_PATTERN), 0)
    return F.array_join(F.slice(parts, F.lit(1), n), "")


def strip_ws(text) -> Column:
    """Strip white space (including newlines) from both ends; ``trim`` in
    Spark only removes spaces."""
    return F.regexp_replace(_c(text), EDGE_SPACE_PATTERN, "")


def rstrip_ws(text) -> Column:
    return F.regexp_replace(_c(text), TRAILING_SPACE_PATTERN, "")


def clean_refs(text) -> Column:
    return strip_ws(F.regexp_replace(_c(text), REF_PATTERN, ""))


def strip_heading(title) -> Column:
    """Remove ``=`` and spaces from both ends of a wiki heading."""
    return F.trim(_c(title), F.lit("= "))


def remove_urls(text) -> Column:
    return F.regexp_replace(F.lower(_c(text)), URL_PATTERN, "")


def preview(text, n: int = PREVIEW_CHARS) -> Column:
    """First ``n`` characters plus ``...`` (added even to short text)."""
    return F.concat(F.substring(_c(text), 1, n), F.lit("..."))


def keep_section(text, min_chars: int = MIN_SECTION_CHARS) -> Column:
    return F.length(_c(text)) >= min_chars


def score_text(rel) -> Column:
    """``relatedness=0.87``; decimal rounding, half up, from the 6-digit score."""
    d = _c(rel).cast("decimal(18,6)").cast("decimal(18,2)").cast("string")
    return F.concat(F.lit("relatedness="), d)


def halve(text, delimiter: str):
    """Split at a delimiter; returns ``(left, right)`` columns.

    Rule: the first delimiter that starts at or after the character midpoint,
    else the first one anywhere; the delimiter itself is dropped.  Without a
    delimiter the right half is empty, which means "no split here".
    """
    t = _c(text)
    d = F.lit(delimiter)
    mid = F.floor(F.length(t) / 2).cast("int")
    p_after = F.call_function("locate", d, t, mid + 1)
    p_first = F.call_function("locate", d, t, F.lit(1))
    p = F.when(p_after > 0, p_after).otherwise(p_first)
    left = F.when(p > 0, F.substr(t, F.lit(1), p - 1)).otherwise(t)
    right = F.when(p > 0, F.substr(t, p + len(delimiter))).otherwise(F.lit(""))
    return left, right
