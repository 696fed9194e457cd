"""Gold records: an independent match, its metadata issues, labels and planted fabrications."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from refloom.functions.similarity import token_sort_ratio
from refloom.functions.text import norm_title_ascii
from refloom.operators.evidence import priority
from refloom.operators.severity import derive_severity

#: Least title scores of a match and of an agreeing title, the cues of an obligatory citation, two provenances.
LEAST_TITLE, SAME_TITLE = 0.82, 0.6
CUES = (
    "we use", "we adopt", "we extend", "based on", "following", "baseline", "outperform", "compared to", "compared with",
    "dataset", "showed that", "proposed by", "introduced by", "achieves", "state-of-the-art",
)
FABRICATED = "gold: gptzero-natural-hallucination (fabricated)"
UNMATCHED = "gold: offline/no-match (needs resolution)"


@F.pandas_udf(DoubleType())
def _sorted_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([token_sort_ratio(a, b) / 100.0 for a, b in zip(left, right, strict=True)], dtype="float64")


def title_similarity(a: Column, b: Column) -> Column:
    """Token sort ratio of two titles from 0 to 1; 0 if either is empty or null."""
    empty = (F.length(F.coalesce(a, F.lit(""))) == 0) | (F.length(F.coalesce(b, F.lit(""))) == 0)
    return F.when(empty, 0.0).otherwise(_sorted_ratio(norm_title_ascii(F.coalesce(a, F.lit(""))), norm_title_ascii(F.coalesce(b, F.lit("")))))


def doi(c: Column) -> Column:
    """The first DOI, without word boundaries, or null."""
    return F.nullif(F.rtrim(F.regexp_extract(c, r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+", 0), F.lit(".")), F.lit(""))


def arxiv_id(c: Column) -> Column:
    """The first preprint number, without its version, or null; it needs no word before it."""
    return F.nullif(F.regexp_extract(c, r"([0-9]{4}\.[0-9]{4,5})(v[0-9]+)?", 1), F.lit(""))


def match(refs: DataFrame, answers: DataFrame, least: float = LEAST_TITLE) -> DataFrame:
    """The answer that stands for each reference: that of the first source with a match.

    refs: ref_id, reference, doi, arxiv, year; answers: ref_id, source_ord, ord, title, year, doi, arxiv, what
    each source found for each reference. In a source an equal DOI comes first, then an identifier that
    contains the preprint number, then the most similar title, whose year must not differ by more
    than one. Returns ref_id, source_ord, ord, method, score. Minima are combined before the shuffle.
    """
    asked = refs.select("ref_id", "reference", F.lower("doi").alias("r_doi"), F.col("arxiv").alias("r_arxiv"), F.col("year").alias("r_year"))
    both = answers.join(asked, "ref_id").withColumn("sim", title_similarity(F.col("reference"), F.col("title")))
    near = F.coalesce(F.abs(F.nullif("year", F.lit(0)) - F.nullif("r_year", F.lit(0))) <= 1, F.lit(True))
    tier = F.when((F.col("r_doi") != "") & (F.lower("doi") == F.col("r_doi")), 0).when((F.col("r_arxiv") != "") & F.contains("arxiv", "r_arxiv"), 1).when(near & (F.col("sim") >= least), 2)
    found = both.withColumn("tier", tier).filter("tier IS NOT NULL").withColumn("away", F.when(F.col("tier") == 2, -F.col("sim")).otherwise(-1.0))
    best = found.groupBy("ref_id").agg(F.min(F.struct("source_ord", "tier", "away", "ord")).alias("b"))
    method = F.element_at(F.array(F.lit("doi"), F.lit("arxiv"), F.lit("fuzzy_title")), F.col("b.tier") + 1)
    return best.select("ref_id", "b.source_ord", "b.ord", method.alias("method"), F.round(-F.col("b.away"), 3).alias("score"))


def _last_words(authors: Column) -> Column:
    return F.filter(F.transform(authors, lambda a: F.lower(F.regexp_extract(a, r"(\S+)\s*$", 1))), lambda w: w != "")


def metadata_issues(cited_title: Column, title: Column, cited_authors: Column, authors: Column, cited_year: Column, year: Column) -> Column:
    """What a cited entry has otherwise than its canonical record; fields that either lacks are not compared."""
    mine, theirs = _last_words(cited_authors), _last_words(authors)
    return F.array_compact(
        F.array(
            F.when((cited_year != 0) & (year != 0) & (cited_year != year), F.concat(F.lit("year: claimed "), cited_year.cast("string"), F.lit(", found "), year.cast("string"))),
            F.when((F.length(cited_title) > 0) & (F.length(title) > 0) & (title_similarity(cited_title, title) < SAME_TITLE), F.lit("title: claimed title does not match canonical record")),
            F.when((F.size(mine) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(mine, theirs), F.lit("authors: no overlap with canonical first authors")),
        )
    )


def label(parsed: DataFrame) -> DataFrame:
    """Gold labels: parsed has claim_text, hint, hint_supports, source, method (both null without a match) and issues."""
    made_up, resolved = F.coalesce(F.col("hint") == "fabricated_reference", F.lit(False)), F.col("source").isNotNull()
    exists = F.when(made_up, "no").when(resolved, "yes").otherwise("unresolved")
    provenance = F.when(made_up, FABRICATED).when(resolved, F.concat(F.lit("gold: "), "source", F.lit("-resolver ("), "method", F.lit(")"))).otherwise(UNMATCHED)
    out = parsed.withColumns({"exists": exists, "supports": F.coalesce(F.nullif("hint_supports", F.lit("")), F.lit("inconclusive")), "priority": priority(F.coalesce("claim_text", F.lit("")), CUES), "provenance": provenance})
    return out.withColumns({"severity": derive_severity(F.col("exists"), F.col("supports"), F.col("priority")), "is_hallucinated": made_up | (F.size(F.coalesce("issues", F.array().cast("array<string>"))) > 0)})


def fabricate(records: DataFrame) -> DataFrame:
    """Records of the published type as planted fabrications: nothing resolves, severity follows."""
    supports, must = F.coalesce("labels.supports_claim", F.lit("inconclusive")), F.coalesce("labels.priority", "priority")
    severity = derive_severity(F.lit("no"), supports, must)
    had = F.when(F.col("labels").isNull(), F.from_json(F.lit("{}"), records.schema["labels"].dataType.simpleString())).otherwise(F.col("labels"))
    labels = had.withField("exists", F.lit("no")).withField("is_hallucinated", F.lit(True)).withField("severity", severity).withField("provenance", F.lit("synthetic:fabrication"))
    return records.withColumns({
        "exists": F.lit("no"), "resolved": F.lit(None).cast(records.schema["resolved"].dataType), "metadata_issues": F.array().cast("array<string>"),
        "notes": F.lit("synthetic fabrication (was a real citation)"), "labels": labels, "severity": severity,
    })


#: Fixed texts of planted metadata errors.
WRONG_AUTHOR, WRONG_VENUE, NEW_EDITION, PLANTED = "Q. Fabricated", "Journal of Imaginary Results", " (revised edition)", " (synthetic perturbation)"


def perturb(cited: DataFrame) -> DataFrame:
    """cited (authors, year, venue, title as cited, field: author, authors, year, venue or title, shift: years to add) with that field corrupted, and issue.

    Without authors one is made up, a missing year (null or 0) counts as 2020, a missing title is called Untitled.
    """
    field, none = F.col("field"), F.array().cast("array<string>")
    who, when = field.isin("author", "authors"), field == "year"
    year = F.coalesce(F.nullif("year", F.lit(0)), F.lit(2020)) + F.col("shift")
    issue = (
        F.when(who, "authors: first author replaced").when(when, F.concat(F.lit("year: shifted to "), year.cast("string"))).when(field == "venue", "venue: replaced with a wrong venue").when(field == "title", "title: altered from canonical")
    )
    rest = F.slice(F.coalesce("authors", none), 2, F.greatest(F.size(F.coalesce("authors", none)) - 1, F.lit(0)))
    title = F.concat(F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")), F.lit(NEW_EDITION))
    return cited.withColumns({
        "authors": F.when(who, F.concat(F.array(F.lit(WRONG_AUTHOR)), rest)).otherwise(F.col("authors")), "year": F.when(when, year).otherwise(F.col("year")),
        "venue": F.when(field == "venue", WRONG_VENUE).otherwise(F.col("venue")), "title": F.when(field == "title", title).otherwise(F.col("title")), "issue": F.concat(issue, F.lit(PLANTED)),
    })
