"""Wikitext helpers by regular expression: redirects, plain text, counts and sort keys.

What nests (links, transclusions, headings between protected parts) is in ``markup``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.markup import external_urls, transclusions, wikilinks  # noqa: F401

_REDIRECT = r"(?i)^\s*#redirect\s*:?\s*\[\[([^\[\]{}]+)\]\]"


def is_redirect(text: Column, whole: bool = False) -> Column:
    pattern = _REDIRECT + (r"\s*$" if whole else "")
    return text.rlike(pattern)


def redirect_target(text: Column) -> Column:
    """Link target of a redirect page, NULL for other pages."""
    link = F.regexp_extract(text, _REDIRECT, 1)
    return F.when(is_redirect(text), F.substring_index(link, "|", 1))


def plain_text(text: Column) -> Column:
    """Approximate text without markup: comments, tags, templates, links, quotes, headings."""
    out = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"\{\{[^{}]*\}\}", "")
    out = F.regexp_replace(out, r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\[(?:https?|ftp)://\S+ ([^\[\]]*)\]", "$1")
    out = F.regexp_replace(out, r"</?[A-Za-z][^<>]*>", "")
    out = F.regexp_replace(out, r"'{2,}", "")
    return F.regexp_replace(out, r"(?m)^=+[ \t]*(.*?)[ \t]*=+[ \t]*$", "$1")


def count_capitalized(text: Column) -> Column:
    """Number of words that start with an upper-case letter."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda word: word.rlike(r"^\p{Lu}")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda word: word != ""))


def is_struck_through(title: Column) -> Column:
    """``<s>...</s>`` around a section title marks a closed discussion."""
    low = F.lower(F.trim(title))
    return F.startswith(low, F.lit("<s>")) & F.endswith(low, F.lit("</s>"))


def phrase_count(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a literal phrase, ignoring case."""
    low = F.lower(text)
    needle = phrase.lower()
    gone = F.length(low) - F.length(F.replace(low, F.lit(needle), F.lit("")))
    return (gone / len(needle)).cast("int")


def category_sort_key(title: Column, prefix: Column) -> Column:
    """Upper-case title, behind the upper-case prefix and a line break if there is one."""
    return F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(F.upper(prefix), F.lit("\n"), F.upper(title))).otherwise(
        F.upper(title)
    )


def category_member_type(ns_id: Column) -> Column:
    return F.when(ns_id == 6, F.lit("file")).when(ns_id == 14, F.lit("subcat")).otherwise(F.lit("page"))
