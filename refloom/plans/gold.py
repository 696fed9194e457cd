"""Gold records and the staged answers of services."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.operators import gold
from refloom.plans.evaluation import SEVERITY
from refloom.plans.registry import query, table
from refloom.sources import candidates

_ISSUES = """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'year: claimed ' || p_size || ', found ' || (p_size + 1) || '|' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN 'title: claimed title does not match canonical record|' ELSE '' END
  || CASE WHEN p_partkey % 5 = 0 THEN 'authors: no overlap with canonical first authors|' ELSE '' END AS issues FROM part"""


@query(_ISSUES)
def gold_metadata_issues(spark, sf_dir):
    """Parts with planted differences of year, title and author."""
    n = F.col("p_partkey")
    authors = F.array(F.concat(F.lit("A. "), "p_brand"), F.lit(" "))
    other = F.when(n % 5 == 0, F.array(F.lit("B Nobody"))).otherwise(F.array(F.upper(F.concat(F.lit("Q "), "p_brand"))))
    found = gold.metadata_issues(F.col("p_name"), F.when(n % 3 == 0, "0123 qqq xyxyxyxyxyxy").otherwise(F.upper("p_name")), authors, other, F.col("p_size"), F.when(n % 2 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("", F.transform(found, lambda x: F.concat(x, F.lit("|")))).alias("issues"))


_CUES = ", ".join(f"'{c}'" for c in gold.CUES)


@query(f"""WITH g AS (
  SELECT l.doc_id, CASE WHEN l.toxic = 1 THEN 'no' WHEN l.doc_id % 3 > 0 THEN 'yes' ELSE 'unresolved' END AS exists_, CASE WHEN l.doc_id % 4 = 0 THEN 'partial' ELSE 'inconclusive' END AS supports,
    CASE WHEN len(list_filter([{_CUES}], lambda c: contains(lower(coalesce(d.text, '')), c))) > 0 THEN 'obligatory' ELSE 'helpful' END AS priority,
    CASE WHEN l.toxic = 1 THEN '{gold.FABRICATED}' WHEN l.doc_id % 3 > 0 THEN 'gold: crossref-resolver (doi)' ELSE '{gold.UNMATCHED}' END AS provenance, l.toxic = 1 OR l.quality = 0 AS is_hallucinated
  FROM labels l JOIN documents d USING (doc_id))
  SELECT doc_id, exists_ AS "exists", supports, priority, {SEVERITY.format(e='exists_', s='supports', p='priority')} AS severity, is_hallucinated, provenance FROM g""")
def gold_labels(spark, sf_dir):
    n = F.col("doc_id")
    parsed = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("claim_text")), "doc_id").select(
        n, "claim_text", F.when(F.col("toxic") == 1, "fabricated_reference").alias("hint"), F.when(n % 4 == 0, "partial").otherwise("").alias("hint_supports"),
        F.when(n % 3 > 0, "crossref").alias("source"), F.when(n % 3 > 0, "doi").alias("method"), F.when(F.col("quality") == 0, F.array(F.lit("x"))).alias("issues"),
    )
    return gold.label(parsed).select("doc_id", "exists", "supports", "priority", "severity", "is_hallucinated", "provenance")


@query("""SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 4 = 0 THEN 'doi' WHEN p_partkey % 4 = 1 THEN 'arxiv' ELSE 'fuzzy_title' END AS method, CASE WHEN p_partkey % 4 = 3 THEN 2 ELSE 1 END AS source_ord, CAST(1 AS DOUBLE) AS score FROM part WHERE p_size % 3 <> 2 OR p_partkey % 4 < 2""")
def gold_match(spark, sf_dir):
    """Parts as references; two sources answer, the first without a year that fits every fourth one."""
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    number = F.concat(F.lpad((n % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad(F.col("p_size").cast("string"), 5, "0"))
    refs = p.select(n.alias("ref_id"), F.col("p_name").alias("reference"), F.when(n % 4 == 0, F.concat(F.lit("10.1234/A"), n)).alias("doi"), F.when(n % 4 == 1, number).alias("arxiv"), F.lit(2000).alias("year"))
    away = F.when(F.col("p_size") % 3 == 2, 5).otherwise(F.col("p_size") % 3)
    answers = [
        p.select(n.alias("ref_id"), F.lit(s).alias("source_ord"), n.alias("ord"), F.initcap("p_name").alias("title"), (F.lit(2000) + F.when((n % 4 == 3) & F.lit(s == 1), 9).otherwise(away)).cast("int").alias("year"), F.concat(F.lit("10.1234/a"), n).alias("doi"), F.concat(number, F.lit("v2")).alias("arxiv"))
        for s in (1, 2)
    ]
    return gold.match(refs, answers[0].unionByName(answers[1])).select("ref_id", "method", "source_ord", "score")


@query("""SELECT doc_id, CASE WHEN length(t) > 400 THEN t[:400] || '…' ELSE t END AS title, '10.1/x' || doc_id AS doi, 1990 + doc_id % 30 AS year, '' AS arxiv_id, 'u' || doc_id AS oa_pdf FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS t FROM documents)""")
def semantic_scholar_items(spark, sf_dir):
    """Documents as titles of items, parsed back."""
    n = F.col("doc_id").cast("string")
    item = F.struct(F.col("text").alias("title"), (F.lit(1990) + F.col("doc_id") % 30).alias("year"), F.struct(F.concat(F.lit("10.1/X"), n).alias("DOI")).alias("externalIds"), F.struct(F.concat(F.lit(" u"), n).alias("url")).alias("openAccessPdf"))
    return candidates.semantic_scholar(table(spark, sf_dir, "documents").select("doc_id", F.to_json(item).alias("json")), carry=("doc_id",)).select("doc_id", "title", "doi", F.col("year").cast("bigint").alias("year"), "arxiv_id", "oa_pdf")


@query("SELECT page_id, '10.1/p' || page_id AS doi, CAST(page_id AS VARCHAR) AS arxiv_id, 'https://doi.org/10.1/P' || page_id AS url, 'b a b' AS abstract FROM pages")
def openalex_items(spark, sf_dir):
    n = F.col("page_id").cast("string")
    link = F.concat(F.lit("https://doi.org/10.1/P"), n)
    item = F.struct(link.alias("doi"), F.create_map(F.lit("openalex"), F.lit("W1"), F.lit("arxiv"), F.concat(F.lit("https://arXiv.org/abs/"), n)).alias("ids"), F.create_map(F.lit("a"), F.array(F.lit(1)), F.lit("b"), F.array(F.lit(0), F.lit(2))).alias("abstract_inverted_index"))
    return candidates.openalex(table(spark, sf_dir, "pages").select("page_id", F.to_json(item).alias("json")), carry=("page_id",)).select("page_id", "doi", "arxiv_id", "url", "abstract")


@query("SELECT p_partkey, p_name || ' t' AS title, '[' || p_brand || ', N S]' AS authors, 2000 + p_size AS year, 'arXiv (preprint)' AS venue, '1706.' || p_partkey || 'v1' AS arxiv_id FROM part")
def arxiv_entries(spark, sf_dir):
    n = F.col("p_partkey").cast("string")
    xml = F.concat(F.lit("<entry><id>http://arxiv.org/abs/1706."), n, F.lit("v1</id><title>"), F.col("p_name"), F.lit("\n  t</title><published>"), F.lit(2000) + F.col("p_size"), F.lit("-06-12T00:00:00Z</published><author><name>"), F.col("p_brand"), F.lit("</name></author><author><name> N S </name></author></entry>"))
    got = candidates.arxiv(table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")), carry=("p_partkey",))
    return got.select("p_partkey", "title", F.concat(F.lit("["), F.array_join("authors", ", "), F.lit("]")).alias("authors"), "year", "venue", "arxiv_id")
