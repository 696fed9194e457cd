"""Inputs, services, full texts and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.operators import usage
from refloom.plans.registry import query, table
from refloom.sources import ingest, services


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'archive' WHEN 2 THEN 'arxiv' WHEN 3 THEN 'arxiv' ELSE 'url' END AS kind,
  CASE page_id % 6 WHEN 0 THEN 'paper-' || page_id WHEN 1 THEN 'pdf-' || substr(sha1('/data/a b ' || page_id || '.tar.gz'), 1, 12) WHEN 2 THEN '2101.0' || (1000 + page_id % 9000) || 'v2' WHEN 3 THEN '2101.0' || (1000 + page_id % 9000) ELSE 'url-' || substr(sha1(CASE page_id % 6 WHEN 4 THEN url ELSE 'HTTP://x.org/2101.01234.pdf' END), 1, 12) END AS paper_id FROM pages""")
def ingest_route(spark, sf_dir):
    """Where inputs lead: local files, preprints, links."""
    n = F.col("page_id")
    number = F.concat(F.lit("2101.0"), 1000 + n % 9000)
    source = (
        F.when(n % 6 == 0, F.concat(F.lit(" /data/paper-"), n, F.lit(".PDF "))).when(n % 6 == 1, F.concat(F.lit("/data/a b "), n, F.lit(".tar.gz"))).when(n % 6 == 2, F.concat(number, F.lit("v2")))
        .when(n % 6 == 3, F.concat(F.lit("https://arxiv.org/abs/"), number)).when(n % 6 == 4, F.col("url")).otherwise("HTTP://x.org/2101.01234.pdf")
    )
    return table(spark, sf_dir, "pages").select(n, ingest.route(source, n % 6 < 2).alias("r")).select("page_id", "r.kind", "r.paper_id")


@query("""SELECT p_partkey // 50 AS paper_id, 'k' || (p_partkey % 50) AS cite_key, CASE WHEN p_partkey % 3 = 0 THEN 'bib' WHEN p_partkey % 2 = 0 THEN 'bbl' ELSE 'inline' END AS title, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS venue FROM part""")
def layered_references(spark, sf_dir):
    """References in the text, in a list's file and in BibTeX, the richest of each key."""
    n = F.col("p_partkey")
    base = table(spark, sf_dir, "part").select(n, F.floor(n / 50).alias("paper_id"), F.concat(F.lit("k"), n % 50).alias("cite_key"), F.lit(0).alias("ord"), "p_type")
    of = lambda title: F.lit(title).alias("title")
    old = base.select("paper_id", "cite_key", F.lit(-1).alias("ord"), of("older"))
    inline = base.select("paper_id", "cite_key", "ord", of("inline")).unionByName(old)
    bbl = base.filter("p_partkey % 2 = 0").select("paper_id", "cite_key", "ord", of("bbl"))
    bib = base.filter("p_partkey % 3 = 0").select("paper_id", "cite_key", "ord", of("bib"), F.col("p_type").alias("venue"))
    return ingest.layered(inline, bbl, bib).select("paper_id", "cite_key", "title", "venue")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'tex' WHEN 2 THEN 'pdf' WHEN 3 THEN 'tex' ELSE '' END AS head, CASE p_partkey % 5 WHEN 0 THEN 'arxiv_html' WHEN 1 THEN 'arxiv_eprint' WHEN 2 THEN 'arxiv_pdf' WHEN 3 THEN 'arxiv_eprint' END AS channel, CASE p_partkey % 5 WHEN 0 THEN 200000 WHEN 1 THEN 800 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 0 END AS n FROM part""")
def fulltext_cascade(spark, sf_dir):
    """Full texts by channel: HTML, long TeX, PDF, any TeX."""
    n = F.col("p_partkey") % 5
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ref_id"), F.when(n == 0, F.concat(F.lit("html"), F.repeat(F.lit("x"), 250_000))).otherwise("").alias("html"),
        F.when(n == 1, F.concat(F.lit("tex"), F.repeat(F.lit("y"), 797))).when(n.isin(2, 3), "tex").alias("tex"), F.when(n.isin(1, 2), "pdf").alias("pdf"),
    )
    got = ingest.full_text(rows)
    return got.select(F.col("ref_id").alias("p_partkey"), F.regexp_extract("text", "^(html|tex|pdf)", 1).alias("head"), "channel", F.length("text").alias("n"))


@query("""WITH f AS (SELECT p_partkey % 200 AS ref_id, p_partkey AS ord, (['meta_pdf', 'openalex_oa', 'unpaywall'])[p_partkey % 3 + 1] AS channel, p_partkey % 3 AS c, 'u' || (p_partkey % 7) AS url FROM part WHERE p_partkey % 11 <> 0),
  d AS (SELECT *, CASE c WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS rank FROM f), e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, url ORDER BY rank, ord) AS k FROM d) WHERE k = 1), p AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY rank, ord) AS place FROM e)
  SELECT ref_id, url, channel, CAST(place AS INT) AS place, url = (SELECT arg_min(q.url, q.place) FROM p q WHERE q.ref_id = p.ref_id AND q.url <> 'u0') AS read FROM p""")
def open_pdfs(spark, sf_dir):
    """Links to open PDFs, each once, and the first that gives a text."""
    n = F.col("p_partkey")
    channel = F.get(F.array(*map(F.lit, ("meta_pdf", "openalex_oa", "unpaywall"))), (n % 3).cast("int"))
    found = table(spark, sf_dir, "part").select((n % 200).alias("ref_id"), n.alias("ord"), channel.alias("channel"), F.when(n % 11 != 0, F.concat(F.lit("u"), n % 7)).otherwise("").alias("url"))
    links = ingest.open_pdfs(found)
    read = ingest.first_text(links.withColumn("text", F.when(F.col("url") != "u0", "some text"))).select("ref_id", F.col("url").alias("best"))
    return links.join(read, "ref_id", "left").select("ref_id", "url", "channel", "place", (F.col("url") == F.col("best")).alias("read"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'https://a.org/x?y=1&z|https://b.org' WHEN 1 THEN 'https://c.org/p q|http://d.org' ELSE '' END AS links FROM supplier""")
def search_links(spark, sf_dir):
    """Links of a result page, unwrapped and each once."""
    n = F.col("s_suppkey")
    html = (
        F.when(n % 3 == 0, '<a rel="n" class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.org%2Fx%3Fy%3D1%26z&rut=1">A</a><a class="result__a" href="https://b.org">B</a><a class="result__a" href="https://duckduckgo.com/y">C</a><a class="result__a" href="https://b.org">B</a>')
        .when(n % 3 == 1, "<a href='/l/?uddg=https%3A%2F%2Fc.org%2Fp%20q'>x</a> uddg=http%3A%2F%2Fd.org&z uddg=ftp%3A%2F%2Fe")
    )
    return table(spark, sf_dir, "supplier").select(n, F.array_join(ingest.search_links(html, 5), "|").alias("links"))


@query("""SELECT p_partkey, 'A ' || p_name AS title, 'Ann Lee|Bo' AS authors, CASE WHEN p_partkey % 2 = 0 THEN 1990 + p_size END AS year, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS venue, '10.1/x' || p_partkey AS doi, CASE WHEN p_partkey % 2 = 0 THEN substr(repeat('z', 700), 1, 600) || '…' ELSE '' END AS abstract FROM part""")
def crossref_items(spark, sf_dir):
    """Candidates of Crossref works."""
    n = F.col("p_partkey")
    people = F.array(F.struct(F.lit("Ann").alias("given"), F.lit("Lee").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("Bo").alias("family")))
    issued = F.struct(F.array(F.array(F.when(n % 2 == 0, F.lit(1990) + F.col("p_size")))).alias("date-parts"))
    work = F.struct(
        F.array(F.concat(F.lit("<i>A</i>  "), "p_name")).alias("title"), people.alias("author"), issued.alias("issued"), F.when(n % 3 != 0, F.array("p_type")).alias("container-title"), F.concat(F.lit("10.1/X"), n).alias("DOI"),
        F.when(n % 2 == 0, F.concat(F.lit("<jats:p>"), F.repeat(F.lit("z"), 700), F.lit("</jats:p>"))).alias("abstract"),
    )
    got = services.crossref(table(spark, sf_dir, "part").select(n, F.to_json(work).alias("json")), carry=("p_partkey",))
    return got.select("p_partkey", "title", F.array_join("authors", "|").alias("authors"), "year", "venue", "doi", "abstract")


@query("""SELECT p_partkey, p_name AS title, CASE p_partkey % 3 WHEN 0 THEN 'Ann Lee|Bo Ho' WHEN 1 THEN 'Ann Lee' ELSE 'Solo' END AS authors, 1990 + p_size AS year, CASE WHEN p_partkey % 2 = 0 THEN 'ee' ELSE 'u' END AS url FROM part""")
def dblp_items(spark, sf_dir):
    """Candidates of DBLP hits: authors as objects, one object, or a name."""
    n = F.col("p_partkey")
    author = F.when(n % 3 == 0, '[{"@pid":"1","text":"Ann Lee 0001"},{"text":"Bo Ho"}]').when(n % 3 == 1, '{"text":"Ann Lee 0002"}').otherwise('"Solo"')
    json = F.concat(F.lit('{"title":"'), "p_name", F.lit('","authors":{"author":'), author, F.lit('},"year":"'), F.lit(1990) + F.col("p_size"), F.when(n % 2 == 0, '","ee":"ee","url":"u"}').otherwise('","url":"u"}'))
    return services.dblp(table(spark, sf_dir, "part").select(n, json.alias("json")), carry=("p_partkey",)).select("p_partkey", "title", F.array_join("authors", "|").alias("authors"), "year", "url")


@query("""WITH s AS (SELECT p_partkey AS n, 'Studies of ' || p_name || ' systems' AS t FROM part) SELECT n AS p_partkey, CASE WHEN n % 2 = 0 THEN 's2:arxiv:2101.00001v2 arxiv:id:2101.00001v2' ELSE '' END || CASE WHEN n % 3 = 0 THEN CASE WHEN n % 2 = 0 THEN ' ' ELSE '' END || 's2:doi:10.1000/abc crossref:doi:10.1000/abc' ELSE '' END AS ids,
  's2:match:' || t || ';crossref:fields:' || t || ',Ermon' || CASE WHEN n % 2 = 0 THEN ';arxiv:title:' || t || ',Ermon' ELSE '' END || ';crossref:fields:' || t || ',' || CASE WHEN n % 2 = 0 THEN ';arxiv:title:' || t || ',' ELSE '' END AS titles FROM s""")
def lookup_steps(spark, sf_dir):
    """What services are asked for a reference, in order."""
    n = F.col("p_partkey")
    ref = F.concat(F.lit('Ermon S, Xu Q. "Studies of '), "p_name", F.lit(' systems". Zq'), F.when(n % 2 == 0, " arXiv:2101.00001v2").otherwise(""), F.when(n % 3 == 0, " doi 10.1000/ABC").otherwise(""))
    told = lambda steps, sep: F.array_join(F.transform(steps, lambda s: F.concat_ws(":", s["service"], s["form"], F.array_join(s["args"], ","))), sep)
    return table(spark, sf_dir, "part").select(n, told(services.id_steps(ref), " ").alias("ids"), told(services.title_steps(ref), ";").alias("titles"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'kept' WHEN c_custkey % 3 = 1 AND c_custkey % 5 <> 0 THEN 'written' ELSE 'asked' END AS state FROM customer""")
def cached_lookups(spark, sf_dir):
    """Answers that a cache has, those to ask, and those to write."""
    n = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(n.alias("key"))
    cache = asked.filter("key % 3 <> 1").withColumn("value", F.when(F.col("key") % 3 == 0, "v").otherwise(""))
    hits, misses = services.cached(asked, cache)
    new = services.new_entries(misses.filter("key % 3 = 1").withColumn("value", F.when(F.col("key") % 5 != 0, "w").otherwise("")), cache).select("key", F.lit(True).alias("new"))
    rest = misses.join(new, "key", "left").select("key", F.when(F.col("new"), "written").otherwise("asked").alias("state"))
    return hits.select("key", F.lit("kept").alias("state")).unionByName(rest).withColumnRenamed("key", "c_custkey")


@query("""WITH s AS (SELECT event_type AS tier, user_id AS run, CAST(floor(value) AS BIGINT) AS a, event_id % 50 AS b, event_id % 7 AS c, event_id % 5 AS d FROM events),
  x AS (SELECT *, CASE WHEN b % 2 = 0 THEN 0.5 ELSE round(((a + c + d) * 3.0 + b * 15.0) / 1000000, 6) END AS usd FROM s)
  SELECT run, tier, CAST(sum(a) AS BIGINT) AS input_tokens, CAST(sum(b) AS BIGINT) AS output_tokens, CAST(sum(c) AS BIGINT) AS cache_read_tokens, CAST(sum(d) AS BIGINT) AS cache_creation_tokens, count(*) AS num_turns, CAST(0 AS BIGINT) AS tool_calls, round(sum(usd), 6) AS cost_usd FROM x GROUP BY 1, 2""")
def usage_totals(spark, sf_dir):
    """Usage of runs by tier: all counters, and what was reported or computed as cost."""
    n = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("tier"), F.floor("value").cast("long").alias("input_tokens"), (n % 50).alias("output_tokens"), (n % 7).alias("cache_read_tokens"), (n % 5).alias("cache_creation_tokens"),
        F.lit(1).cast("long").alias("num_turns"), F.lit(None).cast("long").alias("tool_calls"), F.lit(0.5).alias("wall_seconds"), F.when(n % 50 % 2 == 0, 0.5).alias("reported_usd"),
    )
    return usage.totals(e.withColumn("cost_usd", usage.full_cost(F.lit(3.0), F.lit(15.0))), ["run", "tier"]).drop("wall_seconds")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2101.0000' || (page_id % 9) WHEN 1 THEN 'h' || substr(sha1(url), 1, 12) WHEN 2 THEN 'h' || substr(sha1('t' || page_id), 1, 12) ELSE 'h' || substr(sha1('seed' || page_id), 1, 12) END AS paper_id FROM pages""")
def harvest_ids(spark, sf_dir):
    n = F.col("page_id")
    paper = ingest.harvest_id(F.when(n % 4 == 0, F.concat(F.lit("2101.0000"), n % 9)).otherwise(""), F.when(n % 4 == 1, F.col("url")), F.when(n % 4 == 2, F.concat(F.lit("t"), n)), F.concat(F.lit("seed"), n))
    return table(spark, sf_dir, "pages").select(n, paper.alias("paper_id"))


@query("""SELECT paper_id, ord FROM (SELECT o_custkey AS paper_id, min(o_orderkey) AS ord FROM orders GROUP BY 1) WHERE paper_id % 4 <> 0""")
def harvest_pending(spark, sf_dir):
    """Papers still to fetch, one seed of each."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("ord"))
    return ingest.pending(o, o.filter("paper_id % 4 = 0")).select("paper_id", "ord")
