"""Normalisation, identifiers and token measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions import idents, similarity, text
from refloom.operators import evidence
from refloom.plans.registry import query, table

NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
STOP = "['" + "', '".join(similarity.TITLE_STOP) + "']"


CONTENT = "['" + "', '".join(similarity.CONTENT_STOP) + "']"


def _tokens(x: str, longer: int = 1, stop: str = "") -> str:
    cond = f"length(t) > {longer}" + (f" AND NOT list_contains({stop}, t)" if stop else "")
    return f"list_distinct(list_filter(string_split({NORM.format(x=x)}, ' '), lambda t: {cond}))"


@query(f"SELECT doc_id, {NORM.format(x='text')} AS norm, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS norm_ascii FROM documents")
def norm_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_title(F.col("text")).alias("norm"), text.norm_title_ascii(F.col("text")).alias("norm_ascii"))


_SQUEEZE = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_TAGS = _SQUEEZE.format(x="regexp_replace(html, '<[^>]+>', ' ', 'g')")


@query(f"SELECT page_id, CASE WHEN length({_TAGS}) > 600 THEN substr({_TAGS}, 1, 600) || '…' ELSE {_TAGS} END AS cleaned FROM pages")
def clean_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_markup(F.col("html")).alias("cleaned"))


_SCRIPTS = r"regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"


@query(f"SELECT page_id, {_SQUEEZE.format(x=f'''regexp_replace({_SCRIPTS}, '<[^>]+>', ' ', 'g')''')} AS flat FROM pages")
def html_flat(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_flat(F.col("html")).alias("flat"))


_S = r"""regexp_replace(html, '(?is)<math[^>]*alttext="([^"]*)"[^>]*>.*?</math>', ' \1 ', 'g')"""
_S = rf"regexp_replace({_S}, '(?is)<(script|style|math|svg)[^>]*>.*?</(script|style|math|svg)>', ' ', 'g')"
_S = rf"regexp_replace({_S}, '(?i)</?(h[1-6]|p|div|li|tr|br|section|article|ul|ol|table)[^>]*>', chr(10), 'g')"
_S = rf"regexp_replace({_S}, '<[^>]+>', '', 'g')"
for _e, _c in text.ENTITIES:
    _S = f"replace({_S}, '{_e}', " + ("chr(39)" if _c == "'" else f"'{_c}'") + ")"
_S = rf"regexp_replace(regexp_replace({_S}, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g')"
_S = rf"regexp_replace(regexp_replace({_S}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, {_S} AS body FROM pages")
def html_structured(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_structured(F.col("html")).alias("body"))


_U = r"replace(url, '://', ': // ') || ', ' || CAST(1990 + page_id % 60 AS VARCHAR) || 'a.' || CASE WHEN page_id % 3 = 0 THEN '}>' WHEN page_id % 3 = 1 THEN ' ]);' ELSE '' END"


@query(rf"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_U}, '(?i)^\s*(https?)\s*:\s*/\s*/\s*', '\1://'), ',\s*(?:19|20)[0-9]{{2}}[a-z]?\b', '', 'g'), '\s+', '', 'g'), '[\s,;.)\]}}>]+$', '') AS url FROM pages""")
def url_normalise(spark, sf_dir):
    n = F.col("page_id")
    noisy = F.concat(F.replace("url", F.lit("://"), F.lit(": // ")), F.lit(", "), (F.lit(1990) + n % 60).cast("string"), F.lit("a."), F.when(n % 3 == 0, "}>").when(n % 3 == 1, " ]);").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_url(noisy).alias("url"))


@query("SELECT status_class, count(*) AS n FROM (SELECT CASE WHEN s IS NULL THEN 'error' WHEN s >= 200 AND s < 400 THEN 'live' WHEN s IN (401, 403, 429) THEN 'blocked' ELSE 'dead' END AS status_class FROM (SELECT CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_id % 600 END AS s FROM pages)) GROUP BY 1")
def url_status_class(spark, sf_dir):
    status = F.when(F.col("page_id") % 7 != 0, F.col("page_id") % 600)
    return table(spark, sf_dir, "pages").groupBy(idents.http_class(status).alias("status_class")).agg(F.count("*").alias("n"))


_CITE = r"""concat(coalesce(text, ''), CASE doc_id % 5 WHEN 0 THEN concat(' doi:10.', CAST(1000 + doc_id % 9000 AS VARCHAR), '/ABC.', CAST(doc_id AS VARCHAR), '. 1') WHEN 1 THEN concat(' arXiv: ', CAST(1000 + doc_id % 9000 AS VARCHAR), '.', CAST(10000 + doc_id % 80000 AS VARCHAR), 'v2')
  WHEN 2 THEN concat(' (', CAST(1850 + doc_id % 200 AS VARCHAR), ') 19', CAST(10 + doc_id % 80 AS VARCHAR), '.') WHEN 3 THEN concat(' (10.1000/xyz', CAST(doc_id AS VARCHAR), ') arXiv:math.GT/0309', CAST(100 + doc_id % 900 AS VARCHAR)) ELSE '' END)"""


def _cites(spark, sf_dir):
    """Whole texts, each with an identifier or year at its end."""
    n = F.col("doc_id")
    tail = (
        F.when(n % 5 == 0, F.concat(F.lit(" doi:10."), (1000 + n % 9000).cast("string"), F.lit("/ABC."), n.cast("string"), F.lit(". 1")))
        .when(n % 5 == 1, F.concat(F.lit(" arXiv: "), (1000 + n % 9000).cast("string"), F.lit("."), (10000 + n % 80000).cast("string"), F.lit("v2")))
        .when(n % 5 == 2, F.concat(F.lit(" ("), (1850 + n % 200).cast("string"), F.lit(") 19"), (10 + n % 80).cast("string"), F.lit(".")))
        .when(n % 5 == 3, F.concat(F.lit(" (10.1000/xyz"), n.cast("string"), F.lit(") arXiv:math.GT/0309"), (100 + n % 900).cast("string")))
        .otherwise("")
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("cite"))


@query(rf"""SELECT doc_id, nullif(lower(rtrim(regexp_extract(c, '\b(10\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+)\b', 1), '.')), '') AS doi,
  nullif(lower(regexp_extract(c, '(?i)arxiv[:\s]*([0-9]{{4}}\.[0-9]{{4,5}}(?:v[0-9]+)?|[a-z-]+(?:\.[A-Z]{{2}})?/[0-9]{{7}}(?:v[0-9]+)?)', 1)), '') AS arxiv_id FROM (SELECT doc_id, {_CITE} AS c FROM documents)""")
def doi_arxiv_extract(spark, sf_dir):
    c = F.col("cite")
    return _cites(spark, sf_dir).select("doc_id", idents.doi(c).alias("doi"), idents.arxiv_id(c).alias("arxiv_id"))


@query(rf"""SELECT doc_id, list_max(list_transform(regexp_extract_all(c, '\b(1[89][0-9]{{2}}|20[0-9]{{2}})\b', 1), lambda x: CAST(x AS INT))) AS y_max, CAST(list_extract(regexp_extract_all(c, '((?:19|20)[0-9]{{2}})', 1), -1) AS INT) AS y_last, CAST(list_extract(regexp_extract_all(c, '((?:19|20)[0-9]{{2}})', 1), 1) AS INT) AS y_first FROM (SELECT doc_id, {_CITE} AS c FROM documents)""")
def year_rules(spark, sf_dir):
    c = F.col("cite")
    return _cites(spark, sf_dir).select("doc_id", idents.year_max(c).alias("y_max"), idents.year_last(c).alias("y_last"), idents.year_first(c).alias("y_first"))


@query("SELECT p_partkey, list_aggregate(list_concat([concat('ref-', CAST(p_size AS VARCHAR))], list_transform(range(p_size + 1, p_size + 4), lambda x: concat('ref-', CAST(x AS VARCHAR)))), 'string_agg', ' ') AS keys FROM part")
def marker_expand(spark, sf_dir):
    n = F.col("p_size")
    marker = F.concat(n.cast("string"), F.lit(", "), (n + 1).cast("string"), F.lit("-"), (n + 3).cast("string"), F.lit(", 1-99, x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(idents.expand_marker(marker), " ").alias("keys"))


_OTHER = "concat(split_part(p_name, ' ', 1), CASE WHEN p_partkey % 3 = 0 THEN ' x9 ' ELSE ' ' END, split_part(p_name, ' ', 2), CASE WHEN p_partkey % 4 = 0 THEN ' with colour' ELSE '' END)"
_A, _B, _A4, _B4 = _tokens("p_name", 1, STOP), _tokens(_OTHER, 1, STOP), _tokens("p_name", 3, CONTENT), _tokens(_OTHER, 3, CONTENT)


def _titles(spark, sf_dir):
    n = F.col("p_partkey")
    other = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.when(n % 3 == 0, " x9 ").otherwise(" "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.when(n % 4 == 0, " with colour").otherwise(""))
    each = {"a": similarity.title_tokens(F.col("p_name")), "b": similarity.title_tokens(other), "a4": similarity.content_tokens(F.col("p_name")), "b4": similarity.content_tokens(other)}
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(k) for k, c in each.items()])


@query(f"""WITH t AS (SELECT p_partkey, {_A} AS a, {_B} AS b, {_A4} AS a4, {_B4} AS b4 FROM part), u AS (SELECT p_partkey, len(b) AS n, len(list_intersect(b, a)) AS shared, len(a) AS m, list_filter(b, lambda x: regexp_matches(x, '[0-9]')) AS d, a,
    len(a4) AS m4, len(b4) AS n4, len(list_intersect(b4, a4)) AS shared4 FROM t)
  SELECT p_partkey, CASE WHEN n = 0 OR m = 0 THEN false WHEN len(d) > 0 AND len(list_intersect(d, a)) = 0 THEN true WHEN n <= 2 THEN shared / n < 1 WHEN n <= 4 THEN shared / n < 2.0 / 3 ELSE shared / n < 0.6 END AS contradicts,
    n4 >= 2 AND m4 >= 2 AND coalesce(greatest(shared4 / n4, shared4 / m4) < 0.85, false) AS diverge, n4 >= 3 AND m4 > 0 AND coalesce(shared4 / n4 < 0.6, false) AS poor FROM u""")
def title_contradiction(spark, sf_dir):
    a, b, a4, b4 = (F.col(c) for c in ("a", "b", "a4", "b4"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return _titles(spark, sf_dir).select("p_partkey", similarity.title_contradiction(b, a).alias("contradicts"), no(similarity.titles_diverge(b4, a4)).alias("diverge"), no(similarity.poorly_covered(b4, a4)).alias("poor"))


@query(f"""WITH t AS (SELECT p_partkey, {_A} AS a, {_B} AS b FROM part) SELECT p_partkey, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS jaccard FROM t""")
def jaccard_similarity(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", similarity.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


_T = "replace(p_name, ' ', '')"


@query(f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 100.0 WHEN 1 THEN 100.0 * 2 * (length({_T}) + 1) / (2 * length({_T}) + 4) WHEN 2 THEN 100.0 ELSE 0.0 END AS score FROM part""")
def indel_similarity(spark, sf_dir):
    """How alike titles are: words swapped, one letter of one word changed, words added, nothing there."""
    n, one = F.col("p_partkey") % 4, F.replace("p_name", F.lit(" "), F.lit(""))
    swapped = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1)))
    a = F.when(n == 1, F.concat(F.lit("!"), F.lit("zx"), one)).otherwise(F.col("p_name"))
    b = F.when(n == 0, swapped).when(n == 1, F.concat(F.lit("zy"), one)).when(n == 2, F.concat("p_name", F.lit(": a study of more"))).otherwise(" ?")
    return table(spark, sf_dir, "part").select("p_partkey", similarity.fuzzy_title_score(text.norm_title(a), text.norm_title(b)).alias("score"))


@query(rf"SELECT page_id, substr(sha256(lower({_SQUEEZE.format(x='url')}) || chr(31) || CAST(page_id AS VARCHAR)), 1, 32) AS cache_key FROM pages")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.cache_key(F.col("url"), F.col("page_id").cast("string")).alias("cache_key"))


@query("""SELECT s_suppkey, CASE WHEN link IS NULL OR contains(note, link) THEN note ELSE note || ' · source: ' || link END AS note FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'https://doi.org/10.1/' || s_suppkey ELSE s_name END AS note,
  CASE WHEN s_suppkey % 3 = 0 THEN 'http://x.org/' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'https://doi.org/10.1/' || s_suppkey WHEN s_suppkey % 2 = 0 THEN 'https://arxiv.org/abs/' || s_suppkey END AS link FROM supplier)""")
def source_links(spark, sf_dir):
    n = F.col("s_suppkey")
    link = idents.source_link(F.when(n % 3 == 0, F.concat(F.lit("http://x.org/"), n)).otherwise(""), F.when(n % 3 == 1, F.concat(F.lit("10.1/"), n)), F.when(n % 2 == 0, n.cast("string")))
    note = F.when(n % 4 == 0, F.concat(F.lit("https://doi.org/10.1/"), n)).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", idents.append_link(note, link).alias("note"))


_EVIDENCE_STOP = "['" + "', '".join(evidence.STOP) + "']"
_W = "list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) > 2 AND NOT list_contains(" + _EVIDENCE_STOP + ", t)))"


@query(f"""WITH n AS (SELECT least((SELECT count(DISTINCT item_id) FROM benchmark), (SELECT count(DISTINCT doc_id) FROM documents)) AS n), c AS (SELECT item_id, item_id % n AS paper, {_W.format(x='text')} AS claim FROM benchmark, n),
  p AS (SELECT doc_id, doc_id % n AS paper, chunk_no, {_W.format(x='chunk')} AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk, generate_subscripts(string_split(text, chr(10)), 1) AS chunk_no FROM documents WHERE text IS NOT NULL), n),
  s AS (SELECT item_id, doc_id, chunk_no, CASE WHEN len(claim) = 0 THEN 0.0 ELSE len(list_intersect(claim, words)) / len(claim) END AS overlap FROM c JOIN p ON c.paper = p.paper)
  SELECT item_id, doc_id, CAST(chunk_no AS INT) AS chunk_no, overlap, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id, chunk_no) AS place FROM s) WHERE place <= 3""")
def token_overlap_topk(spark, sf_dir):
    """The three lines of the documents of its paper that cover most of a claim's words."""
    items, documents = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    papers = F.lit(max(1, min(items.select("item_id").distinct().count(), documents.select("doc_id").distinct().count())))
    claims = items.select(F.col("item_id").alias("claim_id"), F.pmod("item_id", papers).alias("paper"), evidence.words(F.col("text")).alias("cw"))
    lines = documents.select(F.pmod("doc_id", papers).alias("paper"), F.col("doc_id").alias("section_no"), F.posexplode(F.split("text", "\n")).alias("at", "chunk"))
    found = evidence.best_chunks(claims, lines.select("paper", "section_no", (F.col("at") + 1).alias("chunk_no"), evidence.words(F.col("chunk")).alias("pw")))
    return found.select(F.col("claim_id").alias("item_id"), F.col("section_no").alias("doc_id"), "chunk_no", "overlap", F.col("place").cast("long").alias("place"))
