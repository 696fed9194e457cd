from pyspark.sql import functions as F

from refloom.operators import gold
from refloom.sources import candidates, records

REFS = "ref_id int, reference string, doi string, arxiv string, year int"
ANSWERS = "ref_id int, source_ord int, ord int, title string, year int, doi string, arxiv string"


def test_first_source_with_a_match_wins(spark):
    refs = [(1, "Graph nets for molecules", "10.1/A", None, 2019), (2, "Graph nets for molecules", None, None, 2019), (3, "Graph nets for molecules", None, "1706.03762", None), (4, None, None, None, None), (5, "Soups", None, None, 2000)]
    answers = [
        (1, 1, 1, "Other", 1990, "10.1/a", None), (1, 1, 0, "Graph nets for molecules", 2019, None, None),
        (2, 1, 0, "Graph nets for molecules", 2017, None, None), (2, 2, 1, "Molecules for graph nets", 2020, None, None), (2, 2, 2, "Graph nets for molecules", None, None, None), (2, 3, 0, "Graph nets for molecules", 2019, None, None),
        (3, 1, 0, "Other", None, "", "1706.03762v3"), (4, 1, 0, None, None, None, None), (5, 1, 0, "Bread", 2000, None, None),
    ]
    got = gold.match(spark.createDataFrame(refs, REFS), spark.createDataFrame(answers, ANSWERS))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, "doi", 1.0), (2, 2, 1, "fuzzy_title", 1.0), (3, 1, 0, "arxiv", 1.0)]
    assert gold.match(spark.createDataFrame([], REFS), spark.createDataFrame(answers, ANSWERS)).count() == 0


def test_fabrications_do_not_resolve(spark):
    rows = [('{"paper_id": "p", "resolved": {"title": "x"}, "priority": "helpful", "metadata_issues": ["y"]}',), ('{"labels": {"priority": "obligatory", "exists": "yes"}}',)]
    read = spark.createDataFrame(rows, "v string").select(F.from_json("v", records.RECORD).alias("r")).select("r.*")
    for r in gold.fabricate(read).collect():
        assert (r["exists"], r.resolved, r.metadata_issues, r.severity) == ("no", None, [], "high")
        assert (r.labels["exists"], r.labels.is_hallucinated, r.labels.provenance) == ("no", True, "synthetic:fabrication")
    assert gold.fabricate(read).schema.simpleString() == read.schema.simpleString()


def test_texts_that_are_no_item_give_empty_fields(spark):
    bad = spark.createDataFrame([("x",), ("{}",), (None,)], "json string")
    assert [(r.title, r.authors, r.year) for f in (candidates.semantic_scholar, candidates.openalex) for r in f(bad).collect()] == [("", [], None)] * 6
    item = '{"title": "A <i>b</i>", "authors": [{"name": "X Y"}, {}], "year": 2020, "tldr": "plain", "openAccessPdf": {"url": " u "}}'
    r = candidates.semantic_scholar(spark.createDataFrame([(item,)], "json string")).first()
    assert (r.title, r.authors, r.year, r.tldr, r.oa_pdf) == ("A b", ["X Y", ""], 2020, "plain", "u")


def test_identifiers_without_boundaries():
    from pyspark.sql import SparkSession

    x = SparkSession.getActiveSession().createDataFrame([("xdoi10.1234/AbC. see 1706.03762v2",), ("none",)], "s string")
    assert [tuple(r) for r in x.select(gold.doi(F.col("s")), gold.arxiv_id(F.col("s"))).collect()] == [("10.1234/AbC", "1706.03762"), (None, None)]
