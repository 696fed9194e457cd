"""Identifiers, years and citation markers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: a DOI ends at a word boundary; a preprint number follows the word arxiv, of the new scheme or the old
#: (archive, perhaps with a subject class), with its version if there is one.
DOI = r"\b(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)\b"
ARXIV = r"(?i)arxiv[:\s]*([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7}(?:v[0-9]+)?)"


def doi(c: Column) -> Column:
    """The first DOI in lower case without trailing dots, or null."""
    return F.nullif(F.lower(F.rtrim(F.regexp_extract(c, DOI, 1), F.lit("."))), F.lit(""))


def arxiv_id(c: Column) -> Column:
    """The first arXiv id that follows the word arxiv, with its version, in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(c, ARXIV, 1)), F.lit(""))


def arxiv_stem(c: Column) -> Column:
    """An id without its version."""
    return F.regexp_replace(c, r"v[0-9]+$", "")


def cite_keys(cell: Column) -> Column:
    """All keys of the citation commands in a piece of TeX, in order."""
    groups = F.regexp_extract_all(cell, F.lit(CITE), F.lit(1))
    return F.filter(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda x: F.trim(x)), lambda k: k != "")


#: The citation commands of natbib, biblatex and apacite; two optional arguments may stand before the keys.
CITE_COMMANDS = (
    "cite", "citep", "citet", "citealp", "citealt", "citeauthor", "citeyear", "citeyearpar", "Citep", "Citet", "parencite", "Parencite", "autocite", "Autocite",
    "textcite", "Textcite", "footcite", "smartcite", "shortcite", "shortcites", "citeA", "citeNP", "fullcite",
)
CITE = r"\\(?:" + "|".join(CITE_COMMANDS) + r")\*?\s*(?:\[[^\]]*\]\s*){0,2}\{([^}]*)\}"


def valid_marker(key: Column, refs: Column) -> Column:
    """Whether a numeric marker's key is a reference: ref-0 never is; without any reference all others are."""
    return (key != "ref-0") & ((F.size(refs) <= 0) | F.array_contains(refs, key))


def numbered_style(markers: Column, refs: Column) -> Column:
    """Whether a text cites by numbers: three markers or more, of which 60 % resolve in full. markers: an array of the keys of each."""
    counted = F.filter(F.transform(markers, lambda keys: F.filter(keys, lambda k: k != "ref-0")), lambda keys: F.size(keys) > 0)
    hits = F.size(F.filter(counted, lambda keys: F.forall(keys, lambda k: F.array_contains(refs, k))))
    return (F.size(refs) > 0) & (F.size(counted) >= 3) & (hits >= 0.6 * F.size(counted))


def dense_numbering(numbers: Column) -> Column:
    """Whether line numbers are those of a list: three or more, and 60 % of the range between the least and the largest."""
    return (F.size(numbers) >= 3) & (F.size(numbers) >= 0.6 * (F.array_max(numbers) - F.array_min(numbers) + 1))


def resolved_id(doi_: Column, arxiv: Column, title: Column, cite_key: Column) -> Column:
    """Identity of a work: its DOI, its preprint, its title, or its key; null if it has none of these."""

    def tagged(tag: str, value: Column, plain: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(tag), plain))

    flat = F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))
    return F.coalesce(tagged("doi:", doi_, F.lower(F.trim(doi_))), tagged("arxiv_id:", arxiv, F.lower(F.trim(arxiv))), tagged("title:", title, flat), tagged("cite:", cite_key, cite_key))


def _years(c: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))


def year_max(c: Column) -> Column:
    """The resolver's year: the largest of 1800 to 2099."""
    return F.array_max(_years(c, r"\b(1[89][0-9]{2}|20[0-9]{2})\b"))


def year_last(c: Column) -> Column:
    """The gold side's year: the last of 1900 to 2099, wherever the digits stand."""
    return F.try_element_at(_years(c, r"((?:19|20)[0-9]{2})"), F.lit(-1))


def year_first(c: Column) -> Column:
    """The TeX parser's year: the first of 1900 to 2099."""
    return F.try_element_at(_years(c, r"((?:19|20)[0-9]{2})"), F.lit(1))


def year_prefix(c: Column) -> Column:
    """The API's year: the first four characters as a number, or null."""
    return F.substring(c.cast("string"), 1, 4).try_cast("int")


def expand_marker(c: Column, most: int = 50) -> Column:
    """'3, 5-7' as ref-3, ref-5, ref-6, ref-7; a range of ``most`` or more, and junk, give nothing."""

    def part(x: Column) -> Column:
        ends = F.transform(F.split(x, "[-–]"), lambda y: F.trim(y).try_cast("int"))
        a, b = F.get(ends, F.lit(0)), F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0)))
        return F.when(a.isNotNull() & (b >= a) & (b - a < most), F.transform(F.sequence(a, F.greatest(a, F.least(b, a + most))), lambda n: F.concat(F.lit("ref-"), n.cast("string")))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.split(c, ","), part))


def http_class(status: Column) -> Column:
    """live, blocked, dead or error."""
    return F.when(status.isNull(), "error").when((status >= 200) & (status < 400), "live").when(status.isin(401, 403, 429), "blocked").otherwise("dead")


def github_api(url: Column) -> Column:
    repo = F.regexp_extract(url, r"github\.com/([^/\s]+/[^/\s?#]+)", 1)
    return F.when(repo != "", F.concat(F.lit("https://api.github.com/repos/"), F.regexp_replace(repo, r"\.git$", "")))


def safe_id(stem: Column, path: Column) -> Column:
    return F.when(stem.rlike(r"^[A-Za-z0-9._-]+$"), stem).otherwise(F.concat(F.lit("pdf-"), F.substring(F.sha1(path.cast("binary")), 1, 12)))


def url_dead(status: Column) -> Column:
    """Only 404 and 410 say that a link is dead; no answer and all other answers don't."""
    return F.coalesce(status.isin(404, 410), F.lit(False))


def source_kind(c: Column) -> Column:
    """Where an input string leads: a local pdf, an archive, an arXiv id, a URL, or nowhere."""
    low = F.lower(F.trim(c))
    return (
        F.when(low.rlike(r"^https?://(www\.)?arxiv\.org/") | low.rlike(r"^[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$"), "arxiv")
        .when(low.rlike(r"^https?://"), "url")
        .when(low.endswith(".pdf"), "pdf")
        .when(low.rlike(r"\.(zip|tar|tgz|tar\.gz)$"), "archive")
        .otherwise("unknown")
    )


def source_link(url: Column, doi_: Column, arxiv: Column) -> Column:
    """The best link of a resolved work."""
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit("https://doi.org/"), F.nullif(doi_, F.lit(""))), F.concat(F.lit("https://arxiv.org/abs/"), F.nullif(arxiv, F.lit(""))))


def append_link(note: Column, link: Column) -> Column:
    """Add ' · source: link' unless the note has the link already."""
    return F.when(link.isNull() | F.contains(note, link), note).otherwise(F.concat(note, F.lit(" · source: "), link))
