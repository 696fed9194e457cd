"""Seeds of a benchmark: fetched listings as rows, and flagged references as parsed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed formats: a note of the review platform, and the texts of a seed.
NOTE = "id STRING, content STRUCT<title: STRING, pdf: STRING>"
SEED = "seed_kind string, source string, venue string, paper_title string, paper_url string, arxiv_id string, pdf_url string, hint map<string,string>, provenance string"


def _value(c):
    """A field that is a plain value, or an object with it as value."""
    return F.when(c.startswith("{"), F.get_json_object(c, "$.value")).otherwise(c)


def review_notes(notes: DataFrame, column: str = "json") -> DataFrame:
    """Seeds of the notes of a venue (venue, one JSON text of a listing per row); a text that is none gives none."""
    listed = notes.select("venue", F.explode(F.from_json(F.get_json_object(column, "$.notes"), f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in NOTE.split(', ', 1))}>>")).alias("x"))
    pdf = _value(F.col("x.content.pdf"))
    return listed.select(
        F.lit("openreview_paper").alias("seed_kind"), F.lit("openreview").alias("source"), "venue", _value(F.col("x.content.title")).alias("paper_title"),
        F.concat(F.lit("https://openreview.net/forum?id="), F.coalesce("x.id", F.lit(""))).alias("paper_url"), F.lit(None).cast("string").alias("arxiv_id"),
        F.when(F.length(pdf) > 0, F.concat(F.lit("https://openreview.net"), pdf)).alias("pdf_url"), F.create_map(F.lit("label"), F.lit("collected"), F.lit("openreview_id"), F.col("x.id")).alias("hint"),
        F.concat(F.lit("openreview:"), "venue").alias("provenance"),
    )


def listed_preprints(pages: DataFrame) -> DataFrame:
    """Seeds of the preprints that pages (source, venue, html) link to, each once per page."""
    ids = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})"), F.lit(1)))
    found = pages.select("source", "venue", F.explode(ids).alias("arxiv_id"))
    return found.select(
        F.lit("gptzero_hallucination").alias("seed_kind"), "source", "venue", F.lit(None).cast("string").alias("paper_title"), F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id").alias("paper_url"), "arxiv_id",
        F.concat(F.lit("https://arxiv.org/pdf/"), "arxiv_id").alias("pdf_url"), F.create_map(F.lit("label"), F.lit("flagged_in_gptzero_list"), F.lit("parser"), F.lit("coarse_html")).alias("hint"),
        F.concat("source", F.lit("_list (coarse_html scan)")).alias("provenance"),
    )


def parsed_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds (with ord) that flag a reference, as parsed rows: paper_id, claim_id, cite_key, raw, seed_hint. Others have nothing to label."""
    key, paper = F.concat(F.lit("flagged"), F.col("ord")), F.coalesce("arxiv_id", F.concat(F.coalesce("source", F.lit("seed")), F.lit("-"), "ord"))
    flagged = F.try_element_at("hint", F.lit("flagged_reference"))
    rows = seeds.filter(F.length(flagged) > 0).select(paper.alias("paper_id"), key.alias("cite_key"), flagged.alias("raw"), F.col("hint").alias("seed_hint"))
    return rows.select("paper_id", F.concat("paper_id", F.lit(":"), "cite_key", F.lit("#1")).alias("claim_id"), "cite_key", "raw", "seed_hint")


def combined(parsed: DataFrame, seeds: DataFrame) -> DataFrame:
    """Parsed rows, and those seeds' rows whose paper was not parsed."""
    return parsed.unionByName(seeds.join(parsed.select("paper_id").distinct(), "paper_id", "left_anti"), allowMissingColumns=True)
