"""Titles in reference strings, and where a reference is to be looked up, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.idents import arxiv_id, year_max
from refloom.functions.similarity import title_contradiction, title_tokens
from refloom.functions.text import clean_title_variant, norm_title, strip_chars

#: Fixed patterns: a quoted title has eight characters; a Vancouver name is a surname, perhaps of several words, and one to four initials;
#: what begins like a venue is none.
QUOTED_DOUBLE, QUOTED_SINGLE = '["“]([^"“”]{8,})["”]', "‘([^‘’]{8,})’"
VANCOUVER_NAME = r"^[A-Z][A-Za-z'’.\-]+(?:\s+[A-Z][A-Za-z'’.\-]+){0,2}\s+[A-Z](?:[-.]?[A-Z]){0,3}\.?$"
VENUE = r"(?i)^(?:in:?\s+|proceedings\s+of(?:\s+the)?\s+|proc\.?\s+|journal\s+of\s+|advances\s+in\s+neural\s+information\s+processing\s+systems\b)"
IDENTIFIER = r"(?i)\b(?:arxiv|doi|https?://)"
#: Words that send a reference to the preprint server and to the computing bibliography, and venues spelled out.
ARXIV_HINTS = (
    "arxiv", "preprint", "icml", "iclr", "neurips", "nips", "aistats", "uai", "colt", "tmlr", "jmlr", "cvpr", "iccv", "eccv", "wacv", "bmvc", "siggraph",
    "acl", "emnlp", "naacl", "eacl", "coling", "conll", "tacl", "aaai", "ijcai", "kdd", "sigir", "www", "wsdm", "recsys", "icra", "iros", "rss", "corl",
    "usenix", "ndss", "ccs", "oakland", "asplos", "osdi", "sosp", "nsdi", "sigcomm",
    "attention", "bert", "chatgpt", "diffusion", "embedding", "gpt", "language", "llm", "model", "models", "neural", "transformer",
)
DBLP_HINTS = (
    "aaai", "acl", "acm", "algorithm", "artificial", "chatbot", "comput", "computer", "conference", "cvf", "cvpr", "emnlp", "ieee", "ijcai", "intelligence",
    "language", "neurips", "nlp", "proceedings", "sigir", "transformer",
)
SPELLED_OUT = (
    r"(?i)\b(?:conference|symposium|workshop|proceedings|transactions|journal)\b[^.]{0,80}?\b(?:machine\s+learning|computer\s+vision|pattern\s+recognition|"
    r"artificial\s+intelligence|computational\s+linguistics|natural\s+language|neural\s+information|learning\s+representations|robotics|automation|"
    r"knowledge\s+discovery|data\s+mining|information\s+retrieval|robot\s+learning|empirical\s+methods)\b"
)
#: Fixed value: before this year nothing is on the preprint server.
FIRST_YEAR = 2007


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def is_author_clause(c: Column) -> Column:
    """Whether a clause is a list of names: two commas; three single capitals in a short clause; names with initials; capitalised names joined by 'and'."""
    clause = F.trim(c)
    capitals = F.regexp_count(clause, F.lit(r"\b[A-Z]\b"))
    segments, names = _parts(clause, ","), _parts(clause, r"\s*(?:,|\band\b|&)\s*")
    with_initials = (F.size(segments) >= 2) & F.forall(segments, lambda s: (F.size(_words(s)) <= 4) & s.rlike(VANCOUVER_NAME))
    capitalised = lambda g: F.forall(_words(g), lambda w: ~w.rlike(r"^\p{L}") | w.rlike(r"^\p{Lu}"))
    full_names = F.size(names).between(2, 6) & F.forall(names, lambda g: F.size(_words(g)).between(2, 4) & capitalised(g))
    return (clause != "") & ((F.regexp_count(clause, F.lit(",")) >= 2) | ((capitals >= 3) & (F.size(_words(clause)) <= 14)) | with_initials | full_names)


def is_venue_clause(c: Column) -> Column:
    return strip_chars(c, " .,").rlike(VENUE)


def likely_title(reference: Column) -> Column:
    """The title in a reference: what is quoted, else the first clause before any identifier that is long enough and has no year, names or venue; '' if none."""
    ref = F.trim(F.coalesce(reference, F.lit("")))
    head = F.get(F.split(ref, IDENTIFIER, 2), F.lit(0))
    clauses = F.transform(F.split(head, r"\.\s+"), lambda x: strip_chars(x, " .,"))
    titles = F.filter(clauses, lambda x: (F.length(x) >= 12) & ~x.rlike(r"\b(19|20)[0-9]{2}\b") & ~is_author_clause(x) & ~is_venue_clause(x))
    at_double, at_single = F.regexp_instr(ref, F.lit(QUOTED_DOUBLE)), F.regexp_instr(ref, F.lit(QUOTED_SINGLE))
    double, single = F.trim(F.regexp_extract(ref, QUOTED_DOUBLE, 1)), F.trim(F.regexp_extract(ref, QUOTED_SINGLE, 1))
    first_double = (at_double > 0) & ((at_single == 0) | (at_double <= at_single))
    return F.when(first_double, double).when(at_single > 0, single).otherwise(F.coalesce(F.get(titles, F.lit(0)), F.lit("")))


def title_variants(reference: Column) -> Column:
    """Titles to ask for: as it stands and cleaned, of six characters at least, different ones by their normal form."""
    title = likely_title(reference)
    clean = clean_title_variant(title)
    return F.filter(F.array(title, F.when(norm_title(clean) != norm_title(title), clean)), lambda t: t.isNotNull() & (F.length(t) >= 6) & (norm_title(t) != ""))


def reference_contradicts(reference: Column, title: Column) -> Column:
    """Whether a candidate's title speaks of another work than the one that a reference names; false without a title in either."""
    wanted = F.get(title_variants(reference), F.lit(0))
    return F.coalesce(title_contradiction(title_tokens(wanted), title_tokens(title)), F.lit(False))


def subtitle_reference(reference: Column) -> Column:
    """The reference with its title cut down to what follows the first colon; '' without a colon or with fewer than three words after it."""
    title = likely_title(reference)
    colon = F.instr(title, ":")
    subtitle = F.trim(F.substring(title, colon + 1, F.length(title)))
    at = F.instr(reference, title)
    cut = F.concat(F.substring(reference, F.lit(1), at - 1), subtitle, F.substring(reference, at + F.length(title), F.length(reference)))
    return F.when((title != "") & (colon > 0) & (F.size(_words(subtitle)) >= 3), cut).otherwise("")


def _has_any(reference: Column, hints: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(norm_title(reference), " "), F.array(*map(F.lit, hints)))


def on_arxiv(reference: Column) -> Column:
    """Whether the preprint server is asked: an id or the word, else not before 2007, else a hint or a venue spelled out."""
    norm = norm_title(reference)
    named = arxiv_id(F.coalesce(reference, F.lit(""))).isNotNull() | F.contains(norm, F.lit("arxiv")) | F.contains(norm, F.lit("preprint"))
    early = F.coalesce(year_max(reference) < FIRST_YEAR, F.lit(False))
    return named | (~early & (_has_any(reference, ARXIV_HINTS) | F.coalesce(reference, F.lit("")).rlike(SPELLED_OUT)))


def on_dblp(reference: Column) -> Column:
    """Whether the computing bibliography is asked."""
    return _has_any(reference, DBLP_HINTS)


def sources(reference: Column) -> Column:
    """The services that a reference is sent to, in their order."""
    return F.array_compact(F.array(F.lit("crossref"), F.when(on_arxiv(reference), "arxiv"), F.when(on_dblp(reference), "dblp"), F.lit("s2"), F.lit("openalex")))


def reference_string(title: Column, authors: Column, year: Column, venue: Column, raw: Column, arxiv: Column, doi: Column) -> Column:
    """The text to look a reference up by: 'authors "title" venue year', or the raw text without a title, with identifiers that it lacks."""
    text = lambda c: F.coalesce(c, F.lit(""))
    people = F.array_join(F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: a != ""), ", ")
    when = F.when(F.coalesce(year, F.lit(0)) != 0, year.cast("string"))

    def spaced(*parts: Column) -> Column:
        return F.trim(F.array_join(F.filter(F.array(*parts), lambda p: F.length(p) > 0), " "))

    plain = F.trim(text(raw))
    base = F.when(F.length(title) > 0, spaced(people, F.concat(F.lit('"'), title, F.lit('"')), text(venue), when)).otherwise(F.when(plain != "", plain).otherwise(spaced(people, when, text(venue))))
    low = F.lower(base)
    more_arxiv = F.when((F.length(arxiv) > 0) & ~F.contains(low, F.lit("arxiv")), F.concat(F.lit("arXiv:"), arxiv))
    more_doi = F.when((F.length(doi) > 0) & ~F.contains(low, F.lower(doi)), F.concat(F.lit("doi:"), doi))
    return spaced(base, more_arxiv, more_doi)
