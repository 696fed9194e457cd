"""Loose answers, evidence rows, records that no judge answered for, usage of messages, and columns below group headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions.names import who_year
from refloom.operators import answers, dimensions, evidence, layout, relevance, report, usage, verify
from refloom.operators.severity import derive_severity
from refloom.plans.evaluation import BASE, SEVERITY, pred
from refloom.plans.registry import query, table
from refloom.sources import pagetables
from refloom.sources.textables import page_caption

#: (JSON value as answered, its text, its issues joined by '|', its evidence as kind/source/quote/url joined by '|').
_LOOSE = (
    ('["a b", " ", 3, {"text": "t"}]', '["a b"," ",3,{"text":"t"}]', 'a b|3|{"text":"t"}', "snippet/model/a b/-|snippet/model/t/-"),
    ('" one "', " one ", "one", "snippet/model/one/-"),
    ('{"quote": "q", "kind": "abstract", "source": "10.1/x", "url": "https://a.org"}', "", "", "abstract/10.1/x/q/https://a.org"),
    ('{"raw": "r", "claim": "c", "url": 3}', "r", "", "snippet/model//-"),
    ("null", "", "", ""),
    ("7", "7", "", ""),
    ("not json", "", "", ""),
    ('[{"text": "shown", "url": 5}, ["x"]]', '[{"text":"shown","url":5},["x"]]', '{"text":"shown","url":5}|["x"]', "snippet/model/shown/-"),
)
_LOOSE_SQL = "(VALUES " + ", ".join("(" + str(i) + ", " + ", ".join("'" + x + "'" for x in row[1:]) + ")" for i, row in enumerate(_LOOSE)) + ") x(i, said, issues, quoted)"


@query(f"SELECT p_partkey, said, issues, CASE WHEN p_partkey % 3 = 0 THEN quoted ELSE 'bib/' || p_name || '/x/-' || CASE WHEN quoted = '' THEN '' ELSE '|' || quoted END END AS quoted FROM part JOIN {_LOOSE_SQL} ON p_partkey % {len(_LOOSE)} = i")
def loose_answers(spark, sf_dir):
    """Lists, strings, objects and junk where a record wants text, issues and evidence."""
    n = F.col("p_partkey")
    raw = F.get(F.array(*[F.lit(x[0]) for x in _LOOSE]), (n % len(_LOOSE)).cast("int"))
    own = F.array(F.struct(F.lit("bib").alias("kind"), F.col("p_name").alias("source"), F.lit("x").alias("quote"), F.lit(None).cast("string").alias("url")))
    rows = table(spark, sf_dir, "part").select(n, raw.alias("raw"), F.when(n % 3 != 0, own).alias("own"))
    line = lambda e: F.concat_ws("/", e["kind"], e["source"], e["quote"], F.coalesce(e["url"], F.lit("-")))
    shown = F.array_join(F.transform(answers.with_model_evidence(F.col("own"), F.col("raw")), line), "|")
    return rows.select(n, answers.text_of(F.col("raw")).alias("said"), F.array_join(answers.issue_list(F.col("raw")), "|").alias("issues"), shown.alias("quoted"))


@query("""WITH d AS (SELECT doc_id, coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS t, coalesce(text, '') AS raw, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || doc_id END AS doi, CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id END AS url FROM documents)
  SELECT doc_id, coalesce(doi, url, 'dblp') AS origin, CASE WHEN length(t) > 600 THEN substr(t, 1, 600) || '…' ELSE t END AS quote, CAST(t <> '' AS INT) + CAST(doc_id % 5 <> 0 AS INT) AS n_rows,
  CASE WHEN doc_id % 4 = 0 THEN 'unpaywall' ELSE coalesce(url, 'arxiv') END || ' §' || CASE WHEN doc_id % 7 = 0 THEN 'full text' ELSE 'Method' END AS full_source, CASE WHEN doc_id % 4 = 1 THEN 'L1' ELSE 'L0' END AS level,
  length(trim(raw)) + CASE WHEN doc_id % 4 = 1 THEN CASE WHEN trim(raw) = '' THEN 15 + 5 ELSE 17 + 5 END ELSE 0 END AS n_chars FROM d""")
def evidence_rows(spark, sf_dir):
    """What verdicts rest on: abstract rows, never twice, full-text rows, and the text a judge reads."""
    n, text = F.col("doc_id"), F.col("text")
    work = F.struct(F.when(n % 3 == 0, F.concat(F.lit("10.1/"), n)).alias("doi"), F.lit("").alias("arxiv_id"), F.when(n % 2 == 0, F.concat(F.lit("u"), n)).alias("url"), F.lit("dblp").alias("source"))
    chunks = F.array(F.struct(F.when(n % 7 != 0, "Method").otherwise("").alias("heading"), F.coalesce(text, F.lit("")).alias("text")), F.struct(F.lit("b").alias("heading"), F.lit("more").alias("text")))
    rows = table(spark, sf_dir, "documents").select(n, text, work.alias("work"), chunks.alias("chunks"))
    first = answers.with_abstract(F.lit(None).cast(answers.EVIDENCE), F.col("work"), text)
    again = F.when(n % 5 == 0, answers.with_abstract(first, F.col("work"), text)).otherwise(F.concat(first, F.array(answers.abstract_row(F.col("work"), F.lit("other")))))
    full = answers.full_text_row(F.col("work"), F.col("chunks"), F.when(n % 4 == 0, "unpaywall"), F.lit(""))
    read = answers.assembled(text, F.when(n % 4 == 1, "Intro"))
    row = answers.abstract_row(F.col("work"), text)
    return rows.select(n, row["source"].alias("origin"), row["quote"].alias("quote"), F.size(again).alias("n_rows"), full["source"].alias("full_source"), read["level"].alias("level"), F.length(read["text"]).alias("n_chars"))


@query(f"""{BASE}, d AS (SELECT claim_id, cite_key, exists_, supports, priority, ord, ord % 3 = 0 AS lost, ord % 2 = 0 AS retrieved FROM pred),
  r AS (SELECT *, CASE WHEN lost OR (supports = 'supports' AND NOT retrieved) THEN 'inconclusive' ELSE supports END AS s2 FROM d)
  SELECT claim_id, cite_key, ord, CASE WHEN ord % 4 = 0 THEN 'run' ELSE 'own' END AS paper_id, s2 AS supports, CASE WHEN lost THEN CASE WHEN ord % 5 = 0 THEN 'timeout; no answer' ELSE 'no answer' END ELSE CASE WHEN ord % 5 = 0 THEN 'timeout' END END AS error,
  CASE WHEN NOT lost AND supports = 'supports' AND NOT retrieved THEN 'abstained: no abstract/introduction was retrieved to ground support' END AS notes, {SEVERITY.format(e='exists_', s='s2', p='priority')} AS severity FROM r""")
def unanswered(spark, sf_dir):
    """Support without retrieved text, and records that no judge answered for."""
    rows = pred(spark, sf_dir).select("claim_id", "cite_key", "ord", F.when(F.col("ord") % 4 != 0, "own").alias("paper_id"), "exists", "supports", "priority", F.when(F.col("ord") % 5 == 0, "timeout").alias("error"), F.lit(None).cast("string").alias("notes"))
    lost = answers.degraded(rows.filter("ord % 3 = 0"), F.lit("run"), F.lit("no answer"))
    judged = answers.grounded(rows.filter("ord % 3 <> 0"), F.col("ord") % 2 == 0)
    judged = judged.withColumns({"paper_id": answers.stamped(F.col("paper_id"), F.lit("run")), "severity": derive_severity(F.col("exists"), F.col("supports"), F.col("priority"))})
    return judged.unionByName(lost.drop("model_tier")).select("claim_id", "cite_key", "ord", "paper_id", "supports", "error", "notes", "severity")


@query("""SELECT p_partkey, trim(CASE WHEN p_partkey % 3 = 0 THEN p_name || ' DOI 10.1/A' ELSE 'Ann Lee, Bo Wu ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' 2020' ELSE '' END END || CASE WHEN p_partkey % 5 = 0 THEN ' arXiv:2001.00001' ELSE '' END || CASE WHEN p_partkey % 3 <> 0 THEN ' doi:10.1/a' ELSE '' END) AS asked,
  CASE p_partkey % 4 WHEN 0 THEN 'does_not' WHEN 1 THEN 'inconclusive' WHEN 2 THEN 'partial' ELSE 'skipped' END AS verdict FROM part""")
def asked_references(spark, sf_dir):
    """References as a model is told of them, and loosely spelled verdicts."""
    n = F.col("p_partkey")
    cited = F.struct(
        F.when(n % 3 == 0, F.concat("p_name", F.lit(" DOI 10.1/A"))).alias("raw"), F.array(F.lit("Ann Lee"), F.lit(""), F.lit("Bo Wu")).alias("authors"), F.col("p_name").alias("title"), F.when(n % 2 == 0, 2020).alias("year"), F.lit("").alias("venue"),
        F.when(n % 5 == 0, "2001.00001").alias("arxiv_id"), F.lit("10.1/a").alias("doi"),
    )
    said = F.when(n % 4 == 0, " Does-Not ").when(n % 4 == 1, "N/A").when(n % 4 == 2, "PARTIAL").otherwise("nonsense")
    rows = table(spark, sf_dir, "part").select(n, cited.alias("cited"))
    return rows.select(n, answers.asked_reference(F.col("cited")).alias("asked"), relevance.token(said, relevance.SUPPORTS, "skipped").alias("verdict"))


@query("""SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'judge-model' ELSE 'bulk-model' END AS model, CAST(sum(CASE WHEN turn % 5 = 4 THEN 0 ELSE turn * 10 END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN turn % 5 = 4 THEN 0 ELSE conv_id % 100 END) AS BIGINT) AS output_tokens,
  CAST(sum(CASE WHEN turn % 5 = 4 THEN 0 ELSE 3 END) AS BIGINT) AS cache_read_tokens, CAST(sum(CASE WHEN turn % 5 = 4 THEN 0 ELSE turn END) AS BIGINT) AS num_turns, CAST(sum(CASE WHEN turn % 5 = 4 THEN 0 ELSE 0.5 END) AS DOUBLE) AS wall_seconds,
  CAST(round(sum(CASE WHEN turn % 5 = 4 OR turn % 3 = 0 THEN 0.01 ELSE 0.25 END), 6) AS DOUBLE) AS cost_usd, count(*) AS one_turn_each FROM conversations GROUP BY 1, 2""")
def message_usage(spark, sf_dir):
    """Usage as messages report it, by model: reported costs first, junk and missing fields as nothing."""
    n = F.col("turn")
    counts = F.struct((n * 10).alias("input_tokens"), (F.col("conv_id") % 100).alias("output_tokens"), F.lit(3).alias("cache_read_input_tokens"))
    said = F.to_json(F.struct(counts.alias("usage"), n.alias("num_turns"), F.lit(500).alias("duration_ms"), F.when(n % 3 != 0, 0.25).alias("total_cost_usd")))
    tier = F.when(n % 2 == 0, "judge").otherwise("bulk")
    rows = table(spark, sf_dir, "conversations").select("conv_id", usage.model_of(tier, "bulk-model", "judge-model").alias("model"), F.when(n % 5 == 4, "{broken").otherwise(said).alias("message"))
    sums = usage.totals(usage.reported(rows, "message").withColumn("cost_usd", F.lit(0.01)), ["conv_id", "model"])
    single = usage.totals(usage.reported(rows, "message", single_calls=True).withColumn("cost_usd", F.lit(0.0)), ["conv_id", "model"]).select("conv_id", "model", F.col("num_turns").alias("one_turn_each"))
    return sums.join(single, ["conv_id", "model"]).select("conv_id", "model", "input_tokens", "output_tokens", "cache_read_tokens", "num_turns", "wall_seconds", "cost_usd", "one_turn_each")


@query("""WITH b AS (SELECT p_partkey, p_size, p_name, p_partkey % 3 AS k FROM part),
  s AS (SELECT p_partkey, k, v.* FROM b, (VALUES (1, 'body', 'resource constraints bind the program'), (2, 'caption', 'retargetable code meets re-targeting limits'), (3, 'self-context', 'we use it')) v(ord, source, quote) WHERE NOT (k = 1 AND ord = 2))
  SELECT p_partkey, ord, CASE WHEN k = 1 AND source <> 'self-context' THEN 'mention' ELSE source END AS source, quote FROM s WHERE k <> 0 OR ord <> 1""")
def group_headers(spark, sf_dir):
    """Passages of columns below a group header: kept where they mention it, demoted where none does, untouched without a group."""
    n = F.col("p_partkey")
    quotes = ((1, "body", "resource constraints bind the program"), (2, "caption", "retargetable code meets re-targeting limits"), (3, "self-context", "we use it"))
    items = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("source"), F.lit(q).alias("quote")) for i, s, q in quotes])
    rows = table(spark, sf_dir, "part").select(n, F.when(n % 3 == 2, F.lit(None)).otherwise("Limits").alias("parent"), F.inline(items)).filter("NOT (p_partkey % 3 = 1 AND ord = 2)")
    return dimensions.qualified(rows, ["p_partkey"]).select("p_partkey", "ord", "source", "quote")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '. It is new.' WHEN 2 THEN '. It is new.' END AS asked, p_partkey % 5 IN (0, 3) AS is_method,
  CASE p_partkey % 3 WHEN 0 THEN 'Table ' || p_size || ': ' || p_name || '.' WHEN 1 THEN 'TABLE IV. ' || p_name ELSE '' END AS caption FROM part""")
def table_words(spark, sf_dir):
    """Searches by columns, row labels that name methods, captions in a page's text."""
    n, name = F.col("p_partkey"), F.col("p_name")
    header, gloss = F.when(n % 4 < 2, F.concat(name, F.lit(" "))), F.when((n % 4 == 1) | (n % 4 == 2), " It is new.")
    label = F.when(n % 5 == 0, "Skeleton of Merger [29]").when(n % 5 == 1, "adaptability and the deeper understanding").when(n % 5 == 2, F.repeat(F.lit("x"), F.lit(61))).when(n % 5 == 3, "OurNet")
    page = F.when(n % 3 == 0, F.concat(F.lit("Some text\nTable "), "p_size", F.lit(":\n "), name, F.lit("."))).when(n % 3 == 1, F.concat(F.lit("TABLE  IV. "), name)).otherwise(F.concat(F.lit("As Table 3 shows, "), name))
    return table(spark, sf_dir, "part").select(n, dimensions.column_query(header, gloss).alias("asked"), verify.method_name(label).alias("is_method"), page_caption(page).alias("caption"))


#: Words of a page (text or null for a supplier's name, x0, x1, y0), 8 points high: caption, headers, three rows beside prose.
_PAGE = (
    ("Table", 150, 170, 62), ("1:", 172, 180, 62), ("Marks", 250, 270, 62), ("Low", 190, 210, 84), ("cost", 212, 228, 84), ("Fast", 250, 270, 84), ("Open", 310, 330, 84),
    ("prose", 20, 50, 100), (None, 100, 140, 100), ("[3]", 145, 160, 100), ("✓", 196, 204, 100), ("✗", 256, 264, 100), ("\x13", 316, 324, 100),
    ("Ours", 120, 150, 112), ("✗", 196, 204, 112), ("✓", 256, 264, 112), ("Bo", 100, 115, 124), ("et", 117, 125, 124), ("al.,", 127, 140, 124), ("2020", 142, 160, 124), ("✓", 196, 204, 124), ("✓", 256, 264, 124), ("✗", 316, 324, 124),
)
_OTHER = [["Method", "A", "B"], ["Net", "yes", "N/A"], ["Old [1, 2]", "no", None], []]


@query("""WITH s AS (SELECT s_suppkey, s_name, s_suppkey % 2 = 1 AS whole, s_suppkey % 4 = 0 AS seen FROM supplier),
  g AS (SELECT s_suppkey, 'pdf' AS source, CASE WHEN whole THEN '' ELSE '1/3 row(s) have a partial mark count' END AS warnings, r, CASE r WHEN 0 THEN s_name || ' [3]' ELSE label END AS row_label, keys, r = 1 AS is_self, c, header, CASE WHEN r = 1 AND c = 3 AND whole THEN 'ILP' ELSE raw END AS raw
    FROM s, (VALUES (0, '', '3', 1, 'Low cost', '✓'), (0, '', '3', 2, 'Fast', '✗'), (0, '', '3', 3, 'Open', '✓'), (1, 'Ours', '', 1, 'Low cost', '✗'), (1, 'Ours', '', 2, 'Fast', '✓'), (1, 'Ours', '', 3, 'Open', ''),
      (2, 'Bo et al., 2020', 'Bo 2020', 1, 'Low cost', '✓'), (2, 'Bo et al., 2020', 'Bo 2020', 2, 'Fast', '✓'), (2, 'Bo et al., 2020', 'Bo 2020', 3, 'Open', '✗')) v(r, label, keys, c, header, raw) WHERE NOT seen
    UNION ALL SELECT s_suppkey, 'pdf+ocr', '', r, label, keys, false, c, header, raw FROM s, (VALUES (0, 'Net', '', 1, 'A', 'yes'), (0, 'Net', '', 2, 'B', 'N/A'), (1, 'Old [1, 2]', '1;2', 1, 'A', 'no'), (1, 'Old [1, 2]', '1;2', 2, 'B', '.')) v(r, label, keys, c, header, raw) WHERE seen)
  SELECT s_suppkey AS doc_id, source, warnings, r AS row_index, row_label, keys, is_self, c AS col_index, header, raw, CASE WHEN raw IN ('✓', 'yes') THEN 'yes' WHEN raw IN ('✗', 'no') THEN 'no' WHEN raw IN ('', 'N/A') THEN 'empty' ELSE 'value' END AS mark FROM g""")
def page_tables(spark, sf_dir):
    """Comparison tables from words with places: marks without a character map, prose beside labels, captions above headers, damaged grids and another reader's rows."""
    n = F.col("s_suppkey")
    at = F.array(*[F.struct((F.col("s_name") if t is None else F.lit(t)).alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(z)).alias("x1"), F.lit(float(y)).alias("y0")) for t, x, z, y in _PAGE])
    value = F.array(F.struct(F.lit("ILP").alias("text"), F.lit(312.0).alias("x0"), F.lit(328.0).alias("x1"), F.lit(112.0).alias("y0")))
    prose = F.transform(F.slice(at, 1, 7), lambda w: w)
    pages = F.array(F.struct(F.lit(0).alias("page"), F.when(n % 2 == 1, F.concat(at, value)).otherwise(at).alias("w")), F.struct(F.lit(1).alias("page"), prose.alias("w")), F.struct(F.lit(12).alias("page"), at.alias("w")))
    seen = F.array(*[F.array(*[F.lit("." if c is None else c) for c in row]).cast("array<string>") for row in _OTHER])
    rows = table(spark, sf_dir, "supplier").select(n.alias("doc_id"), "s_name", F.when(n % 4 == 0, seen).alias("other"), F.inline(pages))
    words = rows.select("doc_id", "page", F.lit(612.0).alias("width"), "other", F.inline("w")).withColumn("y1", F.col("y0") + 8)
    return pagetables.page_tables(words).select("doc_id", "source", F.array_join("warnings", ";").alias("warnings"), "row_index", "row_label", F.array_join("cite_keys", ";").alias("keys"), "is_self", "col_index", "header", "raw", "mark")


_SEVERITY = SEVERITY.format(e="exists_", s="supports", p="priority")


@query(f"""{BASE}, q AS (SELECT paper_id, exists_, supports, {_SEVERITY} AS sev, CASE WHEN doc_id % 40 = 0 THEN 'Backend X unavailable' WHEN doc_id % 40 = 1 THEN 'limited to first 3 of 9 citation pairs' END AS e FROM pred),
  a AS (SELECT paper_id, count(*) AS n, bool_or(e IS NOT NULL AND e LIKE '%unavail%') AS outage, max(CASE WHEN e LIKE 'limited%' THEN 9 END) AS total, count(*) FILTER (exists_ = 'no') AS f, count(*) FILTER (exists_ = 'unresolved') AS u, count(*) FILTER (supports = 'does_not') AS d, count(*) FILTER (sev = 'high') AS h FROM q GROUP BY 1),
  x AS (SELECT * FROM a UNION ALL SELECT 'none', 0, false, NULL, 0, 0, 0, 0 UNION ALL SELECT 'good', 1, false, NULL, 0, 0, 0, 0 UNION ALL SELECT 'loud', 1, false, NULL, 0, 0, 0, 1 UNION ALL SELECT 'weak', 2, false, NULL, 0, 1, 1, 0), s AS (SELECT unnest([true, false]) AS sample)
  SELECT paper_id, sample, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, CASE WHEN outage THEN '⚠️ Couldn''t verify — the pipeline degraded (extraction/backend unavailable). Nothing was checked; please try again later.'
    WHEN n = 0 THEN '📭 No citations were extracted from `' || paper_id || '` — the paper may have no reference list, or extraction found none.'
    WHEN f > 0 THEN '🚨 ' || f || CASE WHEN sample THEN ' of ' || n || ' sampled citation(s) fabricated / not found' ELSE ' fabricated / not-found citation(s)' END
    WHEN h > 0 THEN '⚠️ ' || h || CASE WHEN sample THEN ' of ' || n || ' sampled with high-severity issues' ELSE ' high-severity issue(s)' END
    WHEN d + u > 0 THEN '🔍 ' || CASE WHEN d > 0 THEN d || ' not supporting their claim' ELSE '' END || CASE WHEN d > 0 AND u > 0 THEN ', ' ELSE '' END || CASE WHEN u > 0 THEN u || ' unverifiable' ELSE '' END
    WHEN sample THEN '✅ No hallucinations in this sample' ELSE '✅ No citation hallucinations detected' END AS headline,
  CASE WHEN outage THEN 'red' WHEN sample THEN 'amber' WHEN n > 0 AND f + h > 0 THEN 'red' WHEN n = 0 OR d + u > 0 THEN 'amber' ELSE 'green' END AS colour FROM x, s""")
def run_headlines(spark, sf_dir):
    """What is said of each run first, for samples and whole papers."""
    n = F.col("doc_id") % 40
    errors = F.when(n == 0, F.array(F.lit("Backend X unavailable"))).when(n == 1, F.array(F.lit("limited to first 3 of 9 citation pairs")))
    judged = pred(spark, sf_dir).withColumn("severity", derive_severity(F.col("exists"), F.col("supports"), F.col("priority"))).select("paper_id", "claim_id", "cite_key", "exists", "supports", "severity", errors.alias("errors"))
    few = [("good", "1", "a", "yes", "supports", "ok", None), ("loud", "1", "a", "yes", "partial", "high", None), ("weak", "1", "a", "unresolved", "inconclusive", "low", None), ("weak", "2", "b", "yes", "does_not", "low", None)]
    rows = judged.unionByName(spark.createDataFrame(few, "paper_id string, claim_id string, cite_key string, exists string, supports string, severity string, errors array<string>"))
    papers = rows.select("paper_id").unionByName(spark.createDataFrame([("none",)], "paper_id string"))
    sample, whole = (report.run_headlines(rows, papers, s).withColumn("sample", F.lit(s)) for s in (True, False))
    return sample.unionByName(whole)


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Ann Lee et al.' WHEN 1 THEN 'Ann Lee, Bo Wu' WHEN 2 THEN p_name ELSE 'key' END || CASE WHEN p_partkey % 3 = 0 THEN ' (2020)' ELSE '' END AS who,
  CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE false END AS same FROM part""")
def work_labels(spark, sf_dir):
    """Short labels of cited works, and whether a fetched text is the work it was looked up for."""
    n, name = F.col("p_partkey"), F.col("p_name")
    people = F.when(n % 4 == 0, F.array(F.lit("Ann Lee"), F.lit("Bo Wu"), F.lit("Cy Ng"))).when(n % 4 == 1, F.array(F.lit("Ann Lee"), F.lit("Bo Wu")))
    who = who_year(people, F.when(n % 4 == 2, name), F.when(n % 3 == 0, 2020), F.lit(""), F.lit("key"))
    long = "Language Models Learn Unsupervised Multitask Skills From Webpages"
    title = F.when(n % 5 == 1, "Unsupervised Multitask Learners").when(n % 5 == 2, long).when(n % 5 == 3, long).when(n % 5 == 4, "").otherwise("Deep Nets")
    text = F.when(n % 5 == 1, "Supervised multitask learners").when(n % 5 == 2, "language models learn multitask skills from webpages").when(n % 5 == 3, "language models learn skills from webpages").otherwise(F.concat(F.lit("On DEEP-nets: "), name))
    return table(spark, sf_dir, "part").select(n, who.alias("who"), evidence.names_work(text, title).alias("same"))


@query("""WITH v AS (SELECT * FROM (VALUES (1, 'title', 20, 590, 10, 30), (2, 'a1', 40, 280, 100, 200), (3, 'b1', 320, 590, 90, 180), (4, 'a2', 40, 290, 210, 700), (5, 'b2', 320, 580, 200, 700), (6, 'wide', 20, 600, 400, 500)) t(i, w, x0, x1, y0, y1)),
  o AS (SELECT * FROM (VALUES ('title', 1), ('a1', 2), ('a2', 3), ('b1', 4), ('b2', 5), ('wide', 6)) t(w, place))
  SELECT s_suppkey AS doc_id, s_name || w AS text, place, CASE w WHEN 'a1' THEN 'top' WHEN 'a2' THEN 'top' WHEN 'b2' THEN 'side' WHEN 'wide' THEN 'side' END AS above FROM supplier, v JOIN o USING (w)""")
def page_reading(spark, sf_dir):
    """Blocks of two columns below a title in reading order, and group headers over the cells that they span."""
    at = (("title", 20, 590, 10, 30, 1, "x"), ("a1", 40, 280, 100, 200, 2, "top"), ("a2", 40, 290, 210, 700, 0, ""), ("b1", 320, 590, 90, 180, 1, "alone"), ("b2", 320, 580, 200, 700, 2, "side"), ("wide", 20, 600, 400, 500, 0, ""))
    items = F.array(*[F.struct(F.concat("s_name", F.lit(w)).alias("text"), *[F.lit(float(v)).alias(k) for k, v in zip(("x0", "x1", "y0", "y1"), box, strict=True)], F.lit(span).alias("span"), F.lit(name).alias("name")) for w, *box, span, name in at])
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(612.0).alias("width"), "s_name", F.inline(items))
    placed = layout.reading_order(rows)
    return layout.carried_headers(placed, ["doc_id"], "place", "name", "span").select("doc_id", "text", "place", F.col("group").alias("above"))


@query("""WITH s AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN 9 ELSE 3 END AS s2 FROM part), v AS (SELECT p_partkey, x.* FROM s, LATERAL (SELECT * FROM (VALUES
    ('body', p_name || ' is defined here', 8, 0), ('mention', 'Second of ' || p_name, s2, 0), ('body', 'third', 2, 0), ('mention', 'fourth one', 1, 0), ('mention', 'fifth', 1, 0), ('self-context', 'we use it', 0, 1), ('self-context', 'ours is new', 0, 2)) t(source, quote, s, b)) x)
  SELECT p_partkey, CASE WHEN b > 0 THEN 4 + b ELSE row_number() OVER (PARTITION BY p_partkey, b > 0 ORDER BY s DESC, length(quote) DESC) END AS place, source, quote, s FROM v WHERE quote <> 'fifth'""")
def passages_of_columns(spark, sf_dir):
    """The four best passages of a column, repeated ones once, and two on the paper's own work."""
    n, name = F.col("p_partkey"), F.col("p_name")
    second = F.when(n % 2 == 0, 9).otherwise(3)
    every = (
        (1, "body", F.concat(name, F.lit("  is defined\nhere")), F.lit(8)), (2, "mention", F.concat(F.lit("Second of "), name), second), (3, "mention", F.concat(F.lit("SECOND -- of "), name, F.lit("!")), second - 1), (4, "body", F.lit("third"), F.lit(2)),
        (5, "mention", F.lit("fourth one"), F.lit(1)), (6, "mention", F.lit("fifth"), F.lit(1)), (7, "self-context", F.lit("we use it"), F.lit(0)), (8, "self-context", F.lit("ours is new"), F.lit(0)), (9, "self-context", F.lit("and more"), F.lit(0)),
    )
    items = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(src).alias("source"), q.alias("quote"), s.alias("s")) for i, src, q, s in every])
    rows = table(spark, sf_dir, "part").select(n, name, F.inline(items))
    return dimensions.top_passages(rows, ["p_partkey"])
