"""Column functions on text. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}_]{2,}"
CITATION = r"\[(\d+)\]"

#: The default stop words of keyword ranking.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def words(text: Column | str) -> Column:
    """Lower-case words of two characters or more; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def content_words(text: Column | str, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """``words`` without stop words, duplicates kept."""
    return F.filter(words(text), lambda w: ~w.isin(*stop)) if stop else words(text)


def tokens(text: Column | str) -> Column:
    """Lower-case runs of non-blank characters; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0)), F.array().cast("array<string>"))


def title_key(title: Column | str, n: int = 50) -> Column:
    """What titles are compared by: lower case, no outer blanks, the first ``n`` characters."""
    return F.substring(F.regexp_replace(F.lower(title), r"(?U)^\s+|\s+$", ""), 1, n)


def is_blank(text: Column | str) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)\s", "")) == 0, F.lit(True))


def full_text(title: Column | str, abstract: Column | str) -> Column:
    """``title: abstract`` with nulls as empty."""
    return F.concat(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")), F.lit(": "), F.coalesce(F.col(abstract) if isinstance(abstract, str) else abstract, F.lit("")))


def first_tokens(text: Column | str, n: int = 512) -> Column:
    """The text if it has at most ``n`` blank-separated tokens, else the first ``n`` joined by single spaces."""
    parts = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    whole = F.col(text) if isinstance(text, str) else text
    return F.when(F.size(parts) > n, F.array_join(F.slice(parts, 1, n), " ")).otherwise(whole)


def snippet(text: Column | str, n: int = 200) -> Column:
    """The first ``n`` characters, with three dots if anything is cut off."""
    whole = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(whole) > n, F.concat(F.substring(whole, 1, n), F.lit("..."))).otherwise(whole)


def first_filled(*columns: Column | str) -> Column:
    """The first argument that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns))


def clean_citations(text: Column | str) -> Column:
    """Wide brackets become plain ones, and what follows a dagger inside them goes."""
    return F.regexp_replace(F.translate(text, "【】", "[]"), "†[^\\]]*", "")


def citations(text: Column | str) -> Column:
    """Sorted distinct numbers of the citations ``[n]``."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda x: x.try_cast("decimal(38,0)"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull())))


def json_block(text: Column | str) -> Column:
    """From the first ``{`` to the last ``}``; empty if there is none."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def strip_fences(text: Column | str) -> Column:
    """The text without an enclosing code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?", ""), r"```$", ""))


def html_text(html: Column | str) -> Column:
    """Visible text of a page: no scripts, styles, comments, head or tags; blocks on lines of their own."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head|nav)\b.*?</\1\s*>", " ")
    lines = F.regexp_replace(bare, r"(?i)</?(p|div|br|h[1-6]|li|ul|ol|tr|table|article|section)\b[^>]*>", "\n")
    plain = F.regexp_replace(lines, r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")
