"""Does the cited work exist as cited: the decision over a reference and its matched record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.names import author_issue, same_author
from refloom.functions.similarity import content_tokens, poorly_covered, strings_match, titles_diverge
from refloom.functions.text import norm_title, short

#: Month names, which alone make no title, and the services' names in notes.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SOURCE_NAMES = {"crossref": "Crossref", "arxiv": "arXiv", "dblp": "DBLP", "s2": "Semantic Scholar", "openalex": "OpenAlex"}
#: Fixed texts of the decision.
NO_REFERENCE = "no reference string available to resolve"
UNMATCHED = "could not retrieve a confident match"
REJECTED = "abstained from a weak fuzzy-title match — "
VETOES = {
    "nontitle": "closest candidate is not a real title ('",
    "no authors": "closest candidate has no authors to corroborate ('",
    "url": "different author + the citation is a URL/release, not this paper ('",
    "short": "different author on a short cited title (coincidental match) ('",
    "contradict": "closest candidate's author and title/year contradict ('",
    "other": "closest candidate is a different work — cited ",
}


def non_title(title: Column) -> Column:
    """No token, or nothing but months and numbers of up to six digits that begin like a year or up to four that don't."""
    toks = F.filter(F.split(norm_title(title), " "), lambda t: t != "")
    return F.forall(toks, lambda t: t.isin(*MONTHS) | t.rlike("^(?:19|20)?[0-9]{1,4}$"))


def _known(year: Column) -> Column:
    return F.nullif(year, F.lit(0))


def fuzzy_veto(cited_title: Column, title: Column, cited_authors: Column, authors: Column, cited_year: Column, year: Column, cited_url: Column) -> Column:
    """Why a fuzzy match is rejected, or null: the first reason that holds."""
    a, b = content_tokens(cited_title), content_tokens(title)
    gap = F.coalesce(F.abs(_known(cited_year) - _known(year)), F.lit(0))
    has = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    strangers = has(cited_authors) & has(authors) & ~same_author(F.get(cited_authors, F.lit(0)), F.get(authors, F.lit(0)))
    named = F.concat(short(title), F.lit("')"))
    say = lambda which: F.concat(F.lit(VETOES[which]), named)
    return (
        F.when(non_title(title), say("nontitle"))
        .when(~has(authors), say("no authors"))
        .when(strangers & (F.trim(F.coalesce(cited_url, F.lit(""))) != ""), say("url"))
        .when(strangers & (F.size(a) <= 2), say("short"))
        .when(strangers & ((gap > 1) | F.coalesce(poorly_covered(a, b), F.lit(False)) | F.coalesce(titles_diverge(a, b), F.lit(False))), say("contradict"))
        .when((gap > 2) & F.coalesce(titles_diverge(a, b), F.lit(False)), F.concat(F.lit(VETOES["other"]), cited_year, F.lit(" vs "), year, F.lit(", titles diverge ('"), named))
    )


def metadata_issues(cited_title: Column, title: Column, cited_authors: Column, authors: Column, cited_year: Column, year: Column, cited_venue: Column, venue: Column, url_valid: Column, url: Column) -> Column:
    """Ordered list of what differs: title, year (by more than one), venue, authors, a URL that did not validate. What either lacks is not compared."""

    def differ(what: str, x: Column, y: Column) -> Column:
        both = (F.length(x) > 0) & (F.length(y) > 0)
        return F.when(both & ~strings_match(x, y), F.concat(F.lit(f"{what} mismatch: cited '"), short(x), F.lit("' vs '"), short(y), F.lit("'")))

    return F.array_compact(
        F.array(
            differ("title", cited_title, title),
            F.when(F.abs(_known(cited_year) - _known(year)) > 1, F.concat(F.lit("year mismatch: cited "), cited_year, F.lit(" vs "), year)),
            differ("venue", cited_venue, venue),
            author_issue(cited_authors, authors),
            F.when(~url_valid, F.concat(F.lit("cited/resolved URL did not validate: "), F.coalesce(url, F.lit("None")))),
        )
    )


def unresolved_note(sources: Column) -> Column:
    """Which services were searched without a match."""
    names = F.create_map(*[F.lit(x) for pair in SOURCE_NAMES.items() for x in pair])
    where = F.array_join(F.transform(sources, lambda s: F.coalesce(F.try_element_at(names, s), s)), ", ")
    return F.when(where != "", F.concat(F.lit(UNMATCHED + " — searched "), where)).otherwise(UNMATCHED + " in structured sources")


def metadata_evidence(title: Column, authors: Column, year: Column, doi: Column, arxiv: Column, url: Column, source: Column) -> Column:
    """The matched record as evidence: kind, source, quote, url."""
    people = F.array_join(F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: a != ""), ", ")
    quote = F.substring(F.array_join(F.filter(F.array(title, people, _known(year).cast("string")), lambda x: F.length(x) > 0), " — "), 1, 600)
    some = lambda c: F.nullif(c, F.lit(""))
    return F.struct(F.lit("metadata").alias("kind"), F.coalesce(some(doi), some(arxiv), some(url), some(source), F.lit("structured")).alias("source"), quote.alias("quote"), url.alias("url"))


def distinct_evidence(items: Column) -> Column:
    """The first of items (kind, source, quote, url) with the same kind, source and quote."""
    same = lambda x, y: (x["kind"] == y["kind"]) & (x["source"] == y["source"]) & (x["quote"] == y["quote"])
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, F.lit(1), i), lambda y: same(x, y)))


def merge_issues(ours: Column, theirs: Column) -> Column:
    """Both lists, the first of equal ones."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(ours, none), F.coalesce(theirs, none)))


def fill_correctness(records: DataFrame) -> DataFrame:
    """Adds exists, match_method and issues.

    records: title, authors, year, venue, url (as cited), reference (the text that was looked up), sources (searched), method (null: unresolved),
    r_title, r_authors, r_year, r_venue, r_url, r_url_valid (as matched), url_status (live, blocked, dead, error or null), url_http, checked_url. A fuzzy match
    that is vetoed, and no match, fall back to the URL itself: a live one exists as such, a blocked one is unresolved and says so.
    """
    c = F.col
    veto = F.when(c("method") == "fuzzy_title", fuzzy_veto(c("title"), c("r_title"), c("authors"), c("r_authors"), c("year"), c("r_year"), c("url")))
    out = records.withColumn("veto", veto)
    empty = F.trim(F.coalesce("reference", F.lit(""))) == ""
    resolved = ~empty & c("method").isNotNull() & c("veto").isNull()
    cites = ~empty & (F.trim(F.coalesce("url", F.lit(""))) != "")
    live, blocked = cites & F.coalesce(c("url_status") == "live", F.lit(False)), cites & F.coalesce(c("url_status") == "blocked", F.lit(False))
    issues = metadata_issues(c("title"), c("r_title"), c("authors"), c("r_authors"), c("year"), c("r_year"), c("venue"), c("r_venue"), c("r_url_valid"), c("r_url"))
    gated = F.concat(
        F.lit("url access blocked: HTTP "), c("url_http"), F.lit(" from direct fetch ("), c("checked_url"),
        F.lit("); no configured API/search fallback validated — set GITHUB_TOKEN / S2_API_KEY or a search key and re-run"),
    )
    otherwise = F.when(empty, F.lit(NO_REFERENCE)).when(blocked, gated).when(c("veto").isNotNull(), F.concat(F.lit(REJECTED), c("veto"))).otherwise(unresolved_note(c("sources")))
    return out.withColumns(
        {
            "exists": F.when(resolved | live, "yes").otherwise("unresolved"),
            "match_method": F.when(resolved, c("method")).when(live, "direct_url"),
            "issues": F.when(resolved, issues).when(live, F.array().cast("array<string>")).otherwise(F.array(otherwise)),
        }
    )
