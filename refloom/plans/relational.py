"""Order, windows, dedup, sets and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from refloom.functions import idents, names
from refloom.operators import candidates, correctness, order, report
from refloom.plans.registry import query, table
from refloom.sources import claims


@query("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS ord FROM conversations), f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, role) AS first_turn FROM t)
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, role, turn) AS place FROM f""")
def first_seen_order(spark, sf_dir):
    first = F.min("turn").over(Window.partitionBy("conv_id", "role"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", first.alias("first_turn"))
    return rows.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("first_turn", "role", "turn")).cast("long").alias("place"))


@query("SELECT event_id, concat('p', CAST(user_id AS VARCHAR), ':', event_type, '#', CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS VARCHAR)) AS claim_id FROM events")
def occurrence_ids(spark, sf_dir):
    name = order.occurrence_id(F.concat(F.lit("p"), F.col("user_id")), F.col("event_type"), ["user_id", "event_type"], ["ts", "event_id"])
    return table(spark, sf_dir, "events").select("event_id", name.alias("claim_id"))


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id, length(text) // 100) > 1 AS shared FROM conversations")
def shared_span_marker(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("conv_id").alias("paper_id"), F.floor(F.length("text") / 100).alias("span"))
    return report.shared_span(turns).select("conv_id", "turn", "shared")


_NORM = r"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_CANDIDATES = r"""cand AS (SELECT p_partkey % 500 AS ref_id, p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN 's2' ELSE 'crossref' END AS source, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) || '.' ELSE p_name END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN '10.1/AB' WHEN p_partkey % 4 = 1 THEN '10.1/ab' ELSE '' END AS doi, CASE WHEN p_partkey % 6 = 0 THEN '2101.00001v2' WHEN p_partkey % 6 = 1 THEN '2101.00001' END AS arxiv, CASE WHEN p_partkey % 7 = 0 THEN 'http://x' ELSE '' END AS url FROM part)"""


def _candidates(spark, sf_dir):
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (n % 500).alias("ref_id"), n.alias("ord"), F.when(n % 3 == 0, "s2").otherwise("crossref").alias("source"), F.when(n % 2 == 0, F.concat(F.upper("p_name"), F.lit("."))).otherwise(F.col("p_name")).alias("title"),
        F.when(n % 4 == 0, "10.1/AB").when(n % 4 == 1, "10.1/ab").otherwise("").alias("doi"), F.when(n % 6 == 0, "2101.00001v2").when(n % 6 == 1, "2101.00001").alias("arxiv"), F.when(n % 7 == 0, "http://x").otherwise("").alias("url"),
    )


@query(rf"""WITH {_CANDIDATES} SELECT ref_id, ord, source FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, source, {_NORM.format(x="title")}, lower(doi), split_part(coalesce(arxiv, ''), 'v', 1), url ORDER BY ord) AS k FROM cand) WHERE k = 1""")
def candidate_dedup(spark, sf_dir):
    """The first of candidates that are one record of a service."""
    return candidates.distinct_candidates(_candidates(spark, sf_dir)).select("ref_id", "ord", "source")


@query(rf"""WITH {_CANDIDATES}, w AS (SELECT *, {_NORM.format(x="title")} AS nt FROM cand WHERE ord % 5 = 0), s AS (SELECT ref_id, {_NORM.format(x="title")} AS nt, arg_min(arxiv, ord) AS sibling FROM cand WHERE length(arxiv) > 0 GROUP BY 1, 2)
  SELECT w.ord, coalesce(nullif(w.arxiv, ''), s.sibling) AS arxiv FROM w LEFT JOIN s ON w.ref_id = s.ref_id AND w.nt = s.nt""")
def sibling_backfill(spark, sf_dir):
    """A preprint's number from another candidate of the same title."""
    every = _candidates(spark, sf_dir)
    return candidates.sibling_arxiv(every.filter("ord % 5 = 0"), every).select("ord", "arxiv")


@query("""WITH w AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 5 = 0 THEN 'own' ELSE '' END AS abstract, CASE WHEN p_partkey % 3 = 0 THEN 'a' || (p_partkey % 20) ELSE '' END AS arxiv, CASE WHEN p_partkey % 2 = 0 THEN 'D/' || (p_partkey % 15) END AS doi, CASE WHEN p_partkey % 7 = 0 THEN 'tldr' END AS tldr FROM part)
  SELECT n AS p_partkey, CASE WHEN abstract <> '' THEN abstract WHEN arxiv <> '' AND n % 20 < 10 THEN 'arxiv ' || (n % 20) WHEN doi IS NOT NULL AND n % 15 < 9 THEN 'doi ' || (n % 15) ELSE tldr END AS abstract FROM w""")
def abstract_topup(spark, sf_dir):
    """Missing abstracts by the same preprint, by the same DOI, by the summary."""
    n = F.col("p_partkey")
    winners = table(spark, sf_dir, "part").select(n, F.when(n % 5 == 0, "own").otherwise("").alias("abstract"), F.when(n % 3 == 0, F.concat(F.lit("a"), n % 20)).otherwise("").alias("arxiv"), F.when(n % 2 == 0, F.concat(F.lit("D/"), n % 15)).alias("doi"), F.when(n % 7 == 0, "tldr").alias("tldr"))
    a = spark.range(10).select(F.concat(F.lit("a"), F.col("id")).alias("arxiv"), F.concat(F.lit("arxiv "), F.col("id")).alias("a_abstract"))
    d = spark.range(9).select(F.concat(F.lit("d/"), F.col("id")).alias("doi"), F.concat(F.lit("doi "), F.col("id")).alias("d_abstract"))
    return candidates.top_up_abstracts(winners, a, d).select("p_partkey", "abstract")


@query("""WITH c AS (SELECT p_partkey % 300 AS ref_id, p_partkey AS ord, (['title', 'id', 'broad', 'title', 'subtitle', 'title'])[p_partkey % 6 + 1] AS step, p_partkey % 4 = 0 AS leads FROM part WHERE p_partkey % 300 % 3 <> p_partkey % 2),
  t AS (SELECT *, CASE step WHEN 'id' THEN 0 WHEN 'title' THEN CASE WHEN leads THEN 1 ELSE 2 END WHEN 'broad' THEN 3 ELSE 4 END AS tier FROM c)
  SELECT ref_id, ord, step FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY tier, ord) AS k FROM t) WHERE k = 1""")
def resolve_cascade(spark, sf_dir):
    """Which accepted match stands for a reference: identifier, title (of the leading author first), broad search, subtitle."""
    n = F.col("p_partkey")
    step = F.get(F.array(*map(F.lit, ("title", "id", "broad", "title", "subtitle", "title"))), (n % 6).cast("int"))
    authors = F.when(n % 4 == 0, F.array(F.lit("Premkumar T. Hindle"))).when(n % 4 == 1, F.array(F.lit("Hindle Other"))).otherwise(F.array().cast("array<string>"))
    accepted = table(spark, sf_dir, "part").filter("p_partkey % 300 % 3 <> p_partkey % 2").select((n % 300).alias("ref_id"), n.alias("ord"), step.alias("step"), F.lit("Hindle, A., and others").alias("reference"), authors.alias("authors"))
    return candidates.choose(accepted).select("ref_id", "ord", "step")


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'title mismatch: cited ''' || p_name || ' thing'' vs ''other work''' END, CASE WHEN p_partkey % 4 > 1 THEN 'year mismatch: cited 2000 vs ' || (2000 + p_partkey % 4) END,
    CASE WHEN p_partkey % 3 = 1 THEN 'venue mismatch: cited ''' || p_type || ''' vs ''elsewhere''' END, CASE WHEN p_partkey % 7 = 0 THEN 'first-author mismatch: cited ''Firat M'' vs ''Jon Snow''' WHEN p_partkey % 7 = 1 THEN 'author list differs substantially from the canonical record' END,
    CASE WHEN p_partkey % 6 = 0 THEN 'cited/resolved URL did not validate: u' END], lambda x: x IS NOT NULL), '; ') AS issues FROM part""")
def metadata_diff(spark, sf_dir):
    """What a citation has otherwise than its record, in order."""
    n = F.col("p_partkey")
    title = F.concat("p_name", F.lit(" thing"))
    cited = F.when(n % 7 == 1, F.array(F.lit("Firat M"), F.lit("A B"), F.lit("C D"))).otherwise(F.array(F.lit("Firat M")))
    found = F.when(n % 7 == 0, F.array(F.lit("Jon Snow"))).when(n % 7 == 2, F.array(F.lit("Google Research"))).when(n % 7 == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("Mehmet Fırat"), F.lit("Mehmet Firat")))
    found = F.when(n % 7 > 3, F.array(F.lit("Mehmet Firat"))).when(n % 7 == 1, F.array(F.lit("Mehmet Firat"), F.lit("E F"))).otherwise(found)
    other = F.when(n % 5 == 0, "other work").when(n % 5 == 1, F.replace(F.upper(title), F.lit(" "), F.lit("-"))).when(n % 5 == 2, "").otherwise(title)
    venue = F.when(n % 3 == 1, "elsewhere").when(n % 3 == 2, F.concat(F.lit("Proc. of "), F.col("p_type")))
    issues = correctness.metadata_issues(title, other, cited, found, F.lit(2000), F.lit(2000) + (n % 4).cast("int"), F.col("p_type"), venue, F.when(n % 6 == 0, False), F.lit("u"))
    return table(spark, sf_dir, "part").select(n, F.array_join(issues, "; ").alias("issues"))


_LAST = "lower(CASE WHEN contains(trim({x}), ',') THEN trim(regexp_extract(trim({x}), '^([^,]*)', 1)) ELSE regexp_extract(trim({x}), '([^ ]+)$', 1) END)"


@query(f"""WITH t AS (SELECT p_partkey, p_name AS a, concat(split_part(p_name, ' ', 2), ', ', split_part(p_name, ' ', 1)) AS b FROM part) SELECT p_partkey, {_LAST.format(x='a')} AS last_a, {_LAST.format(x='b')} AS last_b,
  CAST(len(list_intersect([{_LAST.format(x='a')}], [{_LAST.format(x='b')}])) AS DOUBLE) AS overlap FROM t""")
def author_overlap(spark, sf_dir):
    b = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(", "), F.split_part("p_name", F.lit(" "), F.lit(1)))
    x, y = names.last_name(F.col("p_name")), names.last_name(b)
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("last_a"), y.alias("last_b"), names.author_overlap(F.array(x), F.array(y)).alias("overlap"))


@query("""WITH r AS (SELECT p_partkey AS id, p_partkey % 6 AS k, 1990 + p_size AS y FROM part), f AS (SELECT *, k = 0 OR k = 1 OR (y >= 2007 AND k IN (2, 3)) AS arxiv, k IN (2, 4) AS dblp FROM r)
  SELECT id, source FROM (SELECT id, 'crossref' AS source FROM f UNION ALL SELECT id, 'arxiv' FROM f WHERE arxiv UNION ALL SELECT id, 'dblp' FROM f WHERE dblp UNION ALL SELECT id, 's2' FROM f UNION ALL SELECT id, 'openalex' FROM f)""")
def source_routing(spark, sf_dir):
    """The services that each reference is sent to."""
    n = F.col("p_partkey")
    tails = F.array(*map(F.lit, ("arXiv:2101.00001", "A preprint", "ICML neurips", "Journal of Robotics and Automation", "ACM Comput surveys", "Nature")))
    year = (F.lit(1990) + F.col("p_size")).cast("string")
    refs = table(spark, sf_dir, "part").select(n.alias("id"), F.concat(F.lit("Doe J. Zq. "), F.get(tails, (n % 6).cast("int")), F.lit(". "), year).alias("reference"))
    return candidates.routed(refs).select("id", "source")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events""")
def section_asof(spark, sf_dir):
    """As-of join: the last heading at or before each position."""
    heading = order.last_before(F.when(F.col("event_type") == "error", F.col("event_id")), ["user_id"], ["ts", "event_id"])
    return table(spark, sf_dir, "events").select("event_id", heading.alias("heading"))


@query("""WITH s AS (SELECT user_id, event_id % 50 AS slot, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type = 'view' GROUP BY 1, 2)
  SELECT e.event_id FROM events e WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND s.lo <= e.ts AND e.ts < s.hi AND s.slot IN (2, 7, 9))""")
def point_in_span(spark, sf_dir):
    """Range semi-join: positions inside some span of the same paper."""
    e = table(spark, sf_dir, "events")
    spans = e.filter("event_type = 'view'").groupBy("user_id", (F.col("event_id") % 50).alias("slot")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).filter("slot IN (2, 7, 9)")
    return order.inside_spans(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), spans, "user_id", "ts").select("event_id")


@query("""WITH g AS (SELECT user_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) > 5 THEN 1 ELSE 0 END AS brk, event_id FROM events),
  i AS (SELECT user_id, value, sum(brk) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM g)
  SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, avg(value) AS centre FROM i GROUP BY 1, 2""")
def gap_islands(spark, sf_dir):
    """1-D clustering: a new cluster where the gap to the value before is wide."""
    return order.clusters(table(spark, sf_dir, "events"), ["user_id"], "value", 5.0, "event_id")


@query("SELECT user_id, median(gap) AS gap FROM (SELECT user_id, lead(value) OVER (PARTITION BY user_id ORDER BY value) - value AS gap FROM events) GROUP BY 1")
def median_gap(spark, sf_dir):
    return order.median_gap(table(spark, sf_dir, "events"), ["user_id"], "value")


@query("SELECT conv_id, turn, CAST(coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), turn + 1) - turn AS BIGINT) AS span FROM conversations")
def entry_segmentation(spark, sf_dir):
    """An entry ends where the next one begins."""
    end = order.segment_end("turn", F.col("turn") + 1, ["conv_id"])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (end - F.col("turn")).cast("long").alias("span"))


@query("""SELECT p_partkey, CAST(no AS INT) AS no, heading, body FROM (SELECT p_partkey, 0 AS no, '' AS heading, 'Before.' AS body FROM part UNION ALL SELECT p_partkey, 1, CASE WHEN p_partkey % 2 = 0 THEN 'Intro Part' ELSE 'Introduction' END, 'About ' || p_name || '. And so.' FROM part
  UNION ALL SELECT p_partkey, 2, 'Method', 'We do it.' FROM part)""")
def section_split(spark, sf_dir):
    """Sections of TeX and of plain text."""
    n, name = F.col("p_partkey"), F.col("p_name")
    tex = F.concat(F.lit("Before. \\section{Intro Part} About "), name, F.lit(". And so. \\subsection*{Gone} \\subsubsection{Method} We do it."))
    plain = F.concat(F.lit("Before.\n1 Introduction\nAbout "), name, F.lit(". And so.\n2.1. Method\nWe do it."))
    texts = table(spark, sf_dir, "part").select(n.alias("paper_id"), F.when(n % 2 == 0, tex).otherwise(plain).alias("text"))
    return claims.section_table(texts).select(F.col("paper_id").alias("p_partkey"), F.col("section_no").alias("no"), "heading", F.col("text").alias("body"))


@query("""WITH r AS (SELECT coalesce(source, 'none') || '/' || (doc_id // 40) AS paper, doc_id, sum(n_chars + 1) OVER w AS used, row_number() OVER w AS k FROM documents WINDOW w AS (PARTITION BY coalesce(source, 'none') || '/' || (doc_id // 40) ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
  SELECT paper, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT *, max(CAST(used > 6000 AND k > 1 AS INT)) OVER (PARTITION BY paper ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS over FROM r) WHERE over = 0""")
def budget_prefix(spark, sf_dir):
    """Excerpts while they fit the budget, at least one; the first that doesn't fit ends the list."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(F.col("doc_id") / 40)).alias("paper"), "doc_id", "n_chars")
    return order.within_budget(rows, ["paper"], ["doc_id"], F.col("n_chars") + 1, 6000).select("paper", "doc_id", "used")


@query("""WITH r AS (SELECT coalesce(source, 'none') || '/' || (doc_id // 40) AS paper, coalesce(lang, 'x') AS lang, doc_id, n_chars FROM documents)
  SELECT paper, doc_id, row_number() OVER (PARTITION BY paper ORDER BY rank, lang) AS place FROM (SELECT *, row_number() OVER (PARTITION BY paper, lang ORDER BY n_chars DESC, doc_id) AS rank FROM r)""")
def interleave_rank(spark, sf_dir):
    """Round robin over columns: by rank, then column."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(F.col("doc_id") / 40)).alias("paper"), F.coalesce("lang", F.lit("x")).alias("lang"), "doc_id", "n_chars")
    return order.interleaved(rows, ["paper"], "lang", [F.desc("n_chars"), F.col("doc_id")]).select("paper", "doc_id", "place")


@query("""SELECT o_orderkey, 'seed' AS origin FROM orders WHERE o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) UNION ALL SELECT o_orderkey, 'parsed' FROM orders WHERE o_orderkey % 3 = 1""")
def anti_unparsed(spark, sf_dir):
    o, heavy = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    seeds = o.filter("o_orderkey % 3 = 0").join(heavy, o["o_orderkey"] == heavy["l_orderkey"], "left_anti").select("o_orderkey", F.lit("seed").alias("origin"))
    return seeds.unionByName(o.filter("o_orderkey % 3 = 1").select("o_orderkey", F.lit("parsed").alias("origin")))


@query("""SELECT p_partkey, list_filter([CASE WHEN p_partkey % 4 = 0 OR p_size <= 20 THEN 'ref-' || p_size END, CASE WHEN p_partkey % 4 = 0 OR p_size + 3 <= 20 THEN 'ref-' || (p_size + 3) END], lambda x: x IS NOT NULL) AS keys,
  p_partkey % 4 <> 0 AND (p_partkey % 4 = 1 OR CAST(p_size <= 20 AS INT) + 2 >= 0.6 * 3) AS numbered FROM part""")
def marker_validity(spark, sf_dir):
    """Numeric markers that are references, and whether a text cites by numbers."""
    n, size = F.col("p_partkey"), F.col("p_size")
    ref = lambda c: F.concat(F.lit("ref-"), c)
    refs = F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.lit(20)), ref))
    keys = F.filter(F.array(F.lit("ref-0"), ref(size), ref(size + 3)), lambda k: idents.valid_marker(k, refs))
    third = F.when(n % 4 == 1, F.lit("ref-1")).otherwise(ref(size))
    markers = F.array(F.array(F.lit("ref-1"), F.lit("ref-2")), F.array(F.lit("ref-0")), F.array(F.lit("ref-0"), F.lit("ref-3")), F.array(third))
    return table(spark, sf_dir, "part").select(n, keys.alias("keys"), idents.numbered_style(markers, refs).alias("numbered"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, CAST((s_suppkey * 3 + 1) % 97 AS BIGINT) AS b FROM supplier WHERE s_suppkey % 4 <> 3 UNION SELECT 1000 + i, 1001 + i FROM (SELECT unnest(range(60)) AS i)), r AS (SELECT a AS root, a AS node FROM e UNION SELECT r.root, e.b FROM r JOIN e ON r.node = e.a)
  SELECT root, count(*) AS reached FROM r GROUP BY root""")
def reachability(spark, sf_dir):
    """Closure of included files at any depth, with cycles and a chain of sixty."""
    n = F.col("s_suppkey")
    edges = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 3").select(n.cast("long").alias("a"), ((n * 3 + 1) % 97).cast("long").alias("b"))
    chain = spark.range(60).select((F.col("id") + 1000).alias("a"), (F.col("id") + 1001).alias("b"))
    return order.closure(edges.unionByName(chain)).groupBy("root").agg(F.count("*").alias("reached"))


@query("SELECT item_id, array_to_string(string_split_regex(trim(text), '\\s+'), ' ') AS abstract FROM benchmark")
def inverted_abstract(spark, sf_dir):
    """An inverted index {word: [positions]} and back to text in order."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "word"))
    index = words.groupBy("item_id", "word").agg(F.collect_list("pos").alias("positions"))
    return index.select("item_id", "word", F.explode("positions").alias("pos")).groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("abstract"))
