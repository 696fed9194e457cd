"""Candidates of a reference: where they come from, which are one, which wins, and what completes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.names import candidate_first_surname, first_token_surname
from refloom.functions.text import norm_title
from refloom.functions.titles import sources


def _text(c: str) -> Column:
    return F.coalesce(c, F.lit(""))


def routed(refs: DataFrame, reference: str = "reference") -> DataFrame:
    """A row for each reference and each service that it is sent to (source, source_ord)."""
    return refs.select("*", F.posexplode(sources(F.col(reference))).alias("source_ord", "source"))


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """The first of candidates (ref_id, ord, source, title, doi, arxiv, url...) of a reference that are one record of a service."""
    key = F.struct("source", norm_title(F.col("title")), F.lower(_text("doi")), F.get(F.split(F.lower(_text("arxiv")), "v"), F.lit(0)), _text("url"))
    rest = [c for c in candidates.columns if c != "ref_id"]
    first = candidates.groupBy("ref_id", F.xxhash64(key).alias("h"), key.alias("key")).agg(F.min_by(F.struct(*rest), "ord").alias("c"))
    return first.select("ref_id", *[f"c.{c}" for c in rest])


def choose(candidates: DataFrame) -> DataFrame:
    """The candidate that stands for each reference. candidates: ref_id, reference, step, ord and the fields of accepted matches.

    A match by identifier (step 'id') wins; of those by title the first one whose first author's surname leads the reference, else the first; then
    those of a broad search, then those of the subtitle. Minima are combined before the shuffle.
    """
    leads = (first_token_surname(F.col("reference")) != "") & (first_token_surname(F.col("reference")) == candidate_first_surname(F.col("authors")))
    tier = F.when(F.col("step") == "id", 0).when(F.col("step") == "title", F.when(leads, 1).otherwise(2)).when(F.col("step") == "broad", 3).otherwise(4)
    rest = [c for c in candidates.columns if c != "ref_id"]
    best = candidates.groupBy("ref_id").agg(F.min_by(F.struct(*rest), F.struct(tier, "ord")).alias("c"))
    return best.select("ref_id", *[f"c.{c}" for c in rest])


def sibling_arxiv(winners: DataFrame, candidates: DataFrame) -> DataFrame:
    """winners (ref_id, title, arxiv) with arxiv filled from the first other candidate of the same normal title that has one."""
    same = candidates.filter(F.length("arxiv") > 0).groupBy("ref_id", norm_title(F.col("title")).alias("nt")).agg(F.min_by("arxiv", "ord").alias("sibling"))
    keyed = winners.withColumn("nt", F.nullif(norm_title(F.col("title")), F.lit("")))
    filled = F.coalesce(F.nullif("arxiv", F.lit("")), "sibling", "arxiv")
    return keyed.join(same, ["ref_id", "nt"], "left").withColumn("arxiv", filled).drop("nt", "sibling")


def top_up_abstracts(winners: DataFrame, by_arxiv: DataFrame, by_doi: DataFrame) -> DataFrame:
    """winners (abstract, arxiv, doi, tldr) with a missing abstract filled: by the same preprint, by the same DOI in any case, by the summary.

    by_arxiv: arxiv, a_abstract; by_doi: doi, d_abstract; a row of each identifier.
    """
    a = by_arxiv.select(F.col("arxiv").alias("__a"), "a_abstract")
    d = by_doi.select(F.lower("doi").alias("__d"), "d_abstract")
    joined = winners.join(a, F.nullif("arxiv", F.lit("")) == F.col("__a"), "left").join(d, F.nullif(F.lower("doi"), F.lit("")) == F.col("__d"), "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return joined.withColumn("abstract", F.coalesce(some("abstract"), some("a_abstract"), some("d_abstract"), some("tldr"))).drop("__a", "a_abstract", "__d", "d_abstract")


def to_resolved(winners: DataFrame) -> DataFrame:
    """winners (source, method, score, title, authors, year, venue, doi, arxiv, url, oa_pdf, abstract) as resolved works: empty fields are null, an open PDF goes before the record's page."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    plain = [some(c).alias(c) for c in ("title", "venue", "doi", "arxiv", "abstract")]
    return winners.select("ref_id", "source", "method", "score", "authors", "year", *plain, F.coalesce(some("oa_pdf"), some("url")).alias("url"))
