"""What bibliographic services are asked, and their answers as candidates; answers come staged, one JSON text per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.idents import arxiv_id, doi, year_prefix
from refloom.functions.names import search_surname
from refloom.functions.text import clean_markup
from refloom.functions.titles import on_arxiv, title_variants
from refloom.sources.records import dblp_authors

#: Fixed formats: the fields that are read of a work.
CROSSREF = "title ARRAY<STRING>, author ARRAY<STRUCT<given: STRING, family: STRING>>, issued STRUCT<`date-parts`: ARRAY<ARRAY<STRING>>>, `container-title` ARRAY<STRING>, type STRING, DOI STRING, URL STRING, abstract STRING"
DBLP = "title STRING, authors STRUCT<author: STRING>, year STRING, venue STRING, type STRING, doi STRING, ee STRING, url STRING"


def _text(c) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def crossref(items: DataFrame, column: str = "json", carry: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of Crossref works: markup out of titles and abstracts, DOIs in lower case; a text that is none gives empty fields."""
    x = items.select(*carry, F.from_json(column, CROSSREF).alias("x"))
    names = F.transform("x.author", lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit(""))))
    issued = F.get(F.get(F.col("x.issued")["date-parts"], F.lit(0)), F.lit(0))
    return x.select(
        *carry, F.lit("crossref").alias("source"), clean_markup(_text(F.get("x.title", F.lit(0))), 400).alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"), year_prefix(issued).alias("year"),
        _text(F.get(F.col("x")["container-title"], F.lit(0))).alias("venue"), _text("x.type").alias("type"), F.lower(_text("x.DOI")).alias("doi"), F.lit("").alias("arxiv"), _text("x.URL").alias("url"), clean_markup(_text("x.abstract")).alias("abstract"),
    )


def dblp(items: DataFrame, column: str = "json", carry: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of DBLP's hits (the info object of each): one or several authors, without the numbers of namesakes."""
    x = items.select(*carry, F.from_json(column, DBLP).alias("x"))
    return x.select(
        *carry, F.lit("dblp").alias("source"), clean_markup(_text("x.title"), 400).alias("title"), F.coalesce(dblp_authors(F.col("x.authors.author")), F.array().cast("array<string>")).alias("authors"), year_prefix(F.col("x.year")).alias("year"),
        _text("x.venue").alias("venue"), _text("x.type").alias("type"), F.lower(_text("x.doi")).alias("doi"), F.lit("").alias("arxiv"), F.coalesce(F.nullif("x.ee", F.lit("")), "x.url", F.lit("")).alias("url"), F.lit("").alias("abstract"),
    )


def _step(service: str, form: str, *args: Column) -> Column:
    given = [F.coalesce(a.cast("string"), F.lit("")) for a in args]
    return F.struct(F.lit(service).alias("service"), F.lit(form).alias("form"), F.array(*given).alias("args"))


def id_steps(reference: Column) -> Column:
    """Lookups by identifier in order, those that carry abstracts first."""
    ref = F.coalesce(reference, F.lit(""))
    a, d = arxiv_id(ref), doi(ref)
    steps = [F.when(a.isNotNull(), _step("s2", "arxiv", a)), F.when(a.isNotNull(), _step("arxiv", "id", a)), F.when(d.isNotNull(), _step("s2", "doi", d)), F.when(d.isNotNull(), _step("crossref", "doi", d))]
    return F.array_compact(F.array(*steps))


def title_steps(reference: Column) -> Column:
    """Lookups by title in order, of each form of the title: with the first author, then without; each once."""
    author, preprints = F.nullif(search_surname(reference), F.lit("")), on_arxiv(reference)
    none = F.lit(None).cast("string")

    def of(t: Column) -> Column:
        plain = author.isNotNull()
        return F.array_compact(
            F.array(
                _step("s2", "match", t), _step("crossref", "fields", t, author), F.when(preprints, _step("arxiv", "title", t, author)), F.when(plain, _step("crossref", "fields", t, none)), F.when(plain & preprints, _step("arxiv", "title", t, none)),
            )
        )

    return F.array_distinct(F.flatten(F.transform(title_variants(reference), of)))


def lookup_response(query: Column, candidates: Column) -> Column:
    """What a lookup tells: the query, whether anything was found, the candidates, and a note."""
    found = F.size(F.coalesce(candidates, F.array())) > 0
    return F.struct(query.alias("query"), found.alias("found"), candidates.alias("candidates"))


def cached(asked: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(answers that a cache (key, value) has, what is left to ask). A damaged or empty value is a miss."""
    good = cache.filter(F.length("value") > 0).groupBy(key).agg(F.max("value").alias("value"))
    return asked.join(good, key), asked.join(good, key, "left_anti")


def new_entries(answers: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Answers (key, value) to write: those that succeeded and are not there yet, one of each key."""
    good = cache.filter(F.length("value") > 0).select(key).distinct()
    return answers.filter(F.length("value") > 0).groupBy(key).agg(F.min("value").alias("value")).join(good, key, "left_anti")


def gloss_key(header: Column, caption: Column, siblings: Column, legend: Column, quotes: Column) -> Column:
    """A cache key of a column's definition: header, caption, the other headers in any order, legend and passages."""
    return F.sha2(F.to_json(F.struct(header.alias("header"), caption.alias("caption"), F.array_sort(siblings).alias("siblings"), legend.alias("legend"), quotes.alias("quotes"))), 256)
