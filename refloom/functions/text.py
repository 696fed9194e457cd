"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def squeeze(c: Column) -> Column:
    """Collapse whitespace and strip it at both ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_title(c: Column) -> Column:
    """Lower case, anything but letters, digits and underscores to spaces, squeezed; null gives ''."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "))


def norm_title_ascii(c: Column) -> Column:
    """The gold side's title form: only a-z and 0-9 count."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))


def strip_chars(c: Column, chars: str) -> Column:
    """Without any of chars at both ends."""
    return F.btrim(c, F.lit(chars))


def clean_title_variant(c: Column) -> Column:
    """Drop a trailing ' -- site.tld' and the dots and spaces at the ends."""
    plain = strip_chars(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), " .")
    return strip_chars(F.regexp_replace(plain, r"(?i)\s+-{2,}\s*[\w.-]+\.[a-z]{2,}\s*$", ""), " .")


def folded(text: str | None) -> str:
    """Lower case without diacritics, compatibility characters by their plain form; None gives ''."""
    return "".join(x for x in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(x)).lower()


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """folded() of a column."""
    return texts.map(folded)


def short(c: Column, n: int = 60) -> Column:
    """Stripped, and at most n characters, the last an ellipsis if something was cut."""
    plain = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(plain) > n, F.concat(F.substring(plain, 1, n - 1), F.lit("…"))).otherwise(plain)


def gold_markup(c: Column, n: int = 600) -> Column:
    """The gold side's clean markup: cut at n characters, without an ellipsis."""
    return F.substring(squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")), 1, n)


def clip(c: Column, n: int, mark: str = "…") -> Column:
    """At most n characters, and a mark if something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def clean_markup(c: Column, n: int = 600) -> Column:
    """Tags to spaces, squeezed, clipped."""
    return clip(squeeze(F.regexp_replace(c, r"<[^>]+>", " ")), n)


def html_flat(c: Column) -> Column:
    """Text of a page without structure: scripts and styles out, tags to spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>", " "))


#: Character entities that pages use most.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_structured(c: Column) -> Column:
    """Text of a page with its structure: a line for each block element, no more than one blank line."""
    c = F.regexp_replace(c, r'(?is)<math[^>]*alttext="([^"]*)"[^>]*>.*?</math>', " $1 ")
    c = F.regexp_replace(c, r"(?is)<(script|style|math|svg)[^>]*>.*?</(script|style|math|svg)>", " ")
    c = F.regexp_replace(c, r"(?i)</?(h[1-6]|p|div|li|tr|br|section|article|ul|ol|table)[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for entity, character in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(character))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def normalize_url(c: Column) -> Column:
    """Repair a torn scheme at the start, drop ',2020a' wherever it stands, all whitespace and closing punctuation."""
    c = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^\s*(https?)\s*:\s*/\s*/\s*", "$1://")
    c = F.regexp_replace(F.regexp_replace(c, r",\s*(?:19|20)[0-9]{2}[a-z]?\b", ""), r"\s+", "")
    return F.regexp_replace(c, r"[\s,;.)\]}>]+$", "")


def despace_url(c: Column) -> Column:
    return F.regexp_replace(c, r"([./-])\s+([a-z0-9])", "$1$2")


def norm_doi(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"^(https?://(dx\.)?doi\.org/|doi:)", "")


def cell_escape(c: Column) -> Column:
    """A value as a cell of a Markdown table."""
    return F.trim(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def cache_key(*parts: Column) -> Column:
    """A cache key of normalised parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[squeeze(F.lower(p)) for p in parts]), 256), 1, 32)


def despace_line(c: Column) -> Column:
    """Join a line whose letters were set apart: six tokens or more, of which five and 40 % are single characters."""
    tokens = F.split(F.trim(c), " +")
    single = F.size(F.filter(tokens, lambda t: F.length(t) == 1))
    return F.when((F.size(tokens) >= 6) & (single >= 5) & (single >= 0.4 * F.size(tokens)), F.array_join(tokens, "")).otherwise(c)


def strip_comments(c: Column) -> Column:
    """TeX without its line comments."""
    return F.regexp_replace(c, r"(?<!\\)%[^\n]*", "")


def slice_intro(c: Column, n: int = 2500) -> Column:
    """The text after 'introduction', up to related work, background or section 2."""
    after = F.regexp_extract(c, r"(?is)\bintroduction\b(.*)$", 1)
    return clip(squeeze(F.regexp_extract(after, r"(?is)^(.*?)(\brelated work\b|\bbackground\b|\b2\s+[A-Z]|$)", 1)), n)
