"""Staged answers of bibliographic services as candidate tables: one JSON or XML text per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.text import clean_markup
from refloom.sources.records import openalex_abstract

#: Fixed formats: the fields that are read of each service's item.
SEMANTIC_SCHOLAR = "title STRING, authors ARRAY<STRUCT<name: STRING>>, year STRING, venue STRING, externalIds STRUCT<DOI: STRING, ArXiv: STRING>, url STRING, abstract STRING, tldr STRING, openAccessPdf STRING"
OPENALEX = (
    "display_name STRING, authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, publication_year STRING, type STRING, doi STRING, ids MAP<STRING, STRING>, "
    "primary_location STRUCT<source: STRUCT<display_name: STRING>, landing_page_url: STRING>, abstract_inverted_index MAP<STRING, ARRAY<INT>>"
)
ARXIV = "id STRING, title STRING, author ARRAY<STRUCT<name: STRING>>, published STRING, summary STRING, `arxiv:journal_ref` STRING, `arxiv:doi` STRING"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _year(c: Column) -> Column:
    return F.substring(c, 1, 4).try_cast("int")


def _one_or_inner(c: Column, field: str) -> Column:
    """A field that is a plain string, or an object of which one field is meant."""
    return F.when(c.startswith("{"), F.get_json_object(c, f"$.{field}")).otherwise(c)


def semantic_scholar(items: DataFrame, column: str = "json", carry: tuple[str, ...] = ()) -> DataFrame:
    """Candidates with tldr and oa_pdf; a text that is no item gives empty fields."""
    x = items.select(*carry, F.from_json(column, SEMANTIC_SCHOLAR).alias("x"))
    return x.select(
        *carry, F.lit("semantic_scholar").alias("source"), clean_markup(_text(F.col("x.title")), 400).alias("title"),
        F.coalesce(F.transform("x.authors", lambda a: _text(a["name"])), F.array().cast("array<string>")).alias("authors"),
        _year(F.col("x.year")).alias("year"), _text(F.col("x.venue")).alias("venue"), F.lower(_text(F.col("x.externalIds.DOI"))).alias("doi"), _text(F.col("x.externalIds.ArXiv")).alias("arxiv_id"),
        _text(F.col("x.url")).alias("url"), clean_markup(_text(F.col("x.abstract"))).alias("abstract"),
        clean_markup(_text(_one_or_inner(F.col("x.tldr"), "text"))).alias("tldr"), F.trim(_text(_one_or_inner(F.col("x.openAccessPdf"), "url"))).alias("oa_pdf"),
    )


def openalex(items: DataFrame, column: str = "json", carry: tuple[str, ...] = ()) -> DataFrame:
    """Candidates; the preprint number is the last part of the first identifier that names arXiv, the abstract that of the inverted index."""
    x = items.select(*carry, F.from_json(column, OPENALEX).alias("x"))
    preprint = F.get(F.filter(F.map_values("x.ids"), lambda v: F.contains(F.lower(v), F.lit("arxiv"))), F.lit(0))
    place = F.col("x.primary_location")
    return x.select(
        *carry, F.lit("openalex").alias("source"), clean_markup(_text(F.col("x.display_name")), 400).alias("title"),
        F.coalesce(F.transform("x.authorships", lambda a: _text(a["author"]["display_name"])), F.array().cast("array<string>")).alias("authors"),
        _year(F.col("x.publication_year")).alias("year"), _text(place["source"]["display_name"]).alias("venue"),
        F.lower(F.replace(_text(F.col("x.doi")), F.lit("https://doi.org/"), F.lit(""))).alias("doi"), F.regexp_extract(_text(preprint), "([^/]*)/*$", 1).alias("arxiv_id"),
        F.coalesce(F.nullif("x.doi", F.lit("")), place["landing_page_url"], F.lit("")).alias("url"), clean_markup(_text(openalex_abstract(F.col("x.abstract_inverted_index")))).alias("abstract"),
    )


def arxiv(entries: DataFrame, column: str = "xml", carry: tuple[str, ...] = ()) -> DataFrame:
    """Candidates from Atom entries (one element per row)."""
    x = entries.select(*carry, F.from_xml(F.col(column), ARXIV).alias("x"))
    url = F.trim(_text(F.col("x.id")))
    return x.select(
        *carry, F.lit("arxiv").alias("source"), clean_markup(_text(F.col("x.title")), 400).alias("title"),
        F.coalesce(F.transform("x.author", lambda a: F.trim(_text(a["name"]))), F.array().cast("array<string>")).alias("authors"),
        _year(F.trim("x.published")).alias("year"), F.coalesce(F.nullif(F.trim(F.col("x")["arxiv:journal_ref"]), F.lit("")), F.lit("arXiv (preprint)")).alias("venue"),
        F.lower(F.trim(_text(F.col("x")["arxiv:doi"]))).alias("doi"), F.substring_index(url, "/", -1).alias("arxiv_id"), url.alias("url"), clean_markup(_text(F.col("x.summary"))).alias("abstract"),
    )
