"""Queries of the verification path: correctness, evidence, escalation, reports, parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.operators import correctness, evidence, layout, report
from refloom.operators.severity import derive_severity
from refloom.plans.evaluation import BASE, SEVERITY, pred
from refloom.plans.registry import query, table
from refloom.sources import records, tex


def _works(spark, sf_dir):
    """References of every kind: parts as cited, and what was found for them."""
    n = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    title = F.concat(F.lit("The "), "p_name", F.lit(" of common things"))
    return p.select(
        n, title.alias("title"), F.array(F.lit("Yang Z"), F.lit("Müller, Hans")).alias("authors"), (F.lit(1990) + F.col("p_size")).cast("int").alias("year"), F.col("p_type").alias("venue"), F.when(n % 6 == 0, "http://x.org").otherwise("").alias("url"),
        F.when(n % 31 == 0, " ").otherwise(title).alias("reference"), F.array(F.lit("crossref"), F.lit("s2")).alias("sources"), F.when(n % 5 == 4, None).when(n % 2 == 0, "doi").otherwise("fuzzy_title").alias("method"),
        F.when(n % 7 == 0, "May 2020").when(n % 7 == 1, F.concat(F.upper(title), F.lit(": a study"))).otherwise(title).alias("r_title"),
        F.when(n % 11 == 0, F.array().cast("array<string>")).when(n % 13 == 0, F.array(F.lit("Ann Other"))).when(n % 17 == 0, F.array(F.lit("OpenAI"))).otherwise(F.array(F.lit("Zhengyuan Yang"), F.lit("Hans Muller"))).alias("r_authors"),
        (F.lit(1990) + F.col("p_size") + n % 4).cast("int").alias("r_year"), F.when(n % 4 == 1, "elsewhere").when(n % 4 == 2, None).otherwise(F.col("p_type")).alias("r_venue"),
        F.when(n % 9 == 5, False).when(n % 9 == 6, True).alias("r_url_valid"), F.lit("http://y.org").alias("r_url"),
        F.when(n % 9 == 0, "live").when(n % 9 == 1, "dead").when(n % 9 == 3, "blocked").alias("url_status"), F.lit(403).alias("url_http"), F.lit("http://x.org").alias("checked_url"),
    )


_SHORT = "CASE WHEN length({x}) > 60 THEN substr({x}, 1, 59) || '…' ELSE {x} END"
_FOUND = f" (''' || {_SHORT.format(x='r_title')} || ''')'"


@query(f"""WITH w AS (SELECT *, p_partkey AS n, 'The ' || p_name || ' of common things' AS title, CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 2 = 0 THEN 'doi' ELSE 'fuzzy_title' END AS method, p_partkey % 31 = 0 AS void, p_partkey % 6 = 0 AS cites FROM part),
  t AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'May 2020' WHEN n % 7 = 1 THEN upper(title) || ': a study' ELSE title END AS r_title, n % 11 <> 0 AND n % 13 = 0 AS stranger, n % 11 <> 0 AND (n % 13 = 0 OR n % 17 = 0) AS differs,
    len(list_filter(string_split(p_name, ' '), lambda x: length(x) > 3)) + 2 AS n_content FROM w),
  v AS (SELECT *, CASE WHEN method IS DISTINCT FROM 'fuzzy_title' THEN NULL WHEN n % 7 = 0 THEN 'closest candidate is not a real title{_FOUND} WHEN n % 11 = 0 THEN 'closest candidate has no authors to corroborate{_FOUND}
    WHEN differs AND cites THEN 'different author + the citation is a URL/release, not this paper{_FOUND} WHEN differs AND n_content <= 2 THEN 'different author on a short cited title (coincidental match){_FOUND}
    WHEN differs AND n % 4 > 1 THEN 'closest candidate''s author and title/year contradict{_FOUND} END AS veto FROM t),
  r AS (SELECT *, NOT void AND method IS NOT NULL AND veto IS NULL AS resolved, NOT void AND cites AND n % 9 = 0 AS live FROM v)
  SELECT p_partkey, CASE WHEN resolved OR live THEN 'yes' ELSE 'unresolved' END AS "exists", CASE WHEN resolved THEN method WHEN live THEN 'direct_url' END AS match_method,
    CASE WHEN resolved THEN array_to_string(list_filter([CASE WHEN n % 7 = 0 THEN 'title mismatch: cited ''' || {_SHORT.format(x='title')} || ''' vs ''May 2020''' END, CASE WHEN n % 4 > 1 THEN 'year mismatch: cited ' || (1990 + p_size) || ' vs ' || (1990 + p_size + n % 4) END,
        CASE WHEN n % 4 = 1 THEN 'venue mismatch: cited ''' || {_SHORT.format(x='p_type')} || ''' vs ''elsewhere''' END, CASE WHEN stranger THEN 'first-author mismatch: cited ''Yang Z'' vs ''Ann Other''' END,
        CASE WHEN n % 9 = 5 THEN 'cited/resolved URL did not validate: http://y.org' END], lambda x: x IS NOT NULL), '; ')
      WHEN live THEN '' WHEN void THEN 'no reference string available to resolve'
      WHEN cites AND n % 9 = 3 THEN 'url access blocked: HTTP 403 from direct fetch (http://x.org); no configured API/search fallback validated — set GITHUB_TOKEN / S2_API_KEY or a search key and re-run'
      WHEN veto IS NOT NULL THEN 'abstained from a weak fuzzy-title match — ' || veto ELSE 'could not retrieve a confident match — searched Crossref, Semantic Scholar' END AS issues FROM r""")
def correctness_decision(spark, sf_dir):
    return correctness.fill_correctness(_works(spark, sf_dir)).select("p_partkey", "exists", "match_method", F.array_join("issues", "; ").alias("issues"))


@query("""SELECT p_partkey, 'The ' || p_name || ' — A, B — ' || (1990 + p_size) AS quote, CASE WHEN p_partkey % 3 = 0 THEN '10.1/x' WHEN p_partkey % 3 = 1 THEN '2101.1' ELSE 'structured' END AS source,
  CASE WHEN p_partkey % 2 = 0 THEN 'year;venue;title' ELSE 'year;url;venue;title' END AS issues, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END AS n_evidence FROM part""")
def resolved_evidence(spark, sf_dir):
    """The matched record as evidence, once each, and two lists of issues as one."""
    n, none = F.col("p_partkey"), F.lit(None).cast("string")
    seen = correctness.metadata_evidence(F.concat(F.lit("The "), "p_name"), F.array(F.lit("A"), F.lit(""), F.lit("B")), (F.lit(1990) + F.col("p_size")).cast("int"), F.when(n % 3 == 0, "10.1/x").otherwise(""), F.when(n % 3 == 1, "2101.1"), none, none)
    other = seen.withField("quote", F.when(n % 4 == 0, seen["quote"]).otherwise("else")).withField("url", F.lit("http://z"))
    ours = F.array(F.lit("year"), F.when(n % 2 == 0, "venue").otherwise("url"))
    merged = correctness.merge_issues(ours, F.array(F.lit("venue"), F.lit("year"), F.lit("title")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", seen["quote"].alias("quote"), seen["source"].alias("source"), F.array_join(merged, ";").alias("issues"), F.size(correctness.distinct_evidence(F.array(seen, other, seen))).alias("n_evidence")
    )


@query(f"""{BASE} SELECT claim_id, ord, supports IN ('inconclusive', 'does_not') OR (supports = 'partial' AND doc_id % 2 = 0) AS escalates FROM pred""")
def stage_escalation(spark, sf_dir):
    claim = F.when(F.col("doc_id") % 2 == 0, "it outperforms others").otherwise("it is related")
    return pred(spark, sf_dir).select("claim_id", "ord", evidence.escalates(F.col("supports"), evidence.experimental(evidence.words(claim))).alias("escalates"))


_CUE = " OR ".join(f"contains(low, '{c}')" for c in evidence.OBLIGATORY_CUES)
_TEXT_CUE = "lower(coalesce(text, '')) || CASE doc_id % 4 WHEN 0 THEN ' as shown in it' WHEN 1 THEN ' for example a survey' WHEN 2 THEN ' for a survey of a dataset' ELSE '' END"


@query(f"""SELECT doc_id, CASE WHEN {_CUE} THEN 'obligatory' ELSE 'helpful' END AS priority FROM (SELECT doc_id, {_TEXT_CUE} AS low FROM documents)""")
def priority_cues(spark, sf_dir):
    n = F.col("doc_id") % 4
    cued = F.concat(F.coalesce("text", F.lit("")), F.when(n == 0, " As Shown In it").when(n == 1, " for example a survey").when(n == 2, " for a survey of a DATASET").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", evidence.priority(cued).alias("priority"))


_RECORDS = rf"""{BASE}, rec AS (SELECT *, {SEVERITY.format(e="exists_", s="supports", p="priority")} AS severity, ([[], ['A. Bee'], ['A. Bee', 'C|D'], ['E', 'F', 'G']])[doc_id % 4 + 1] AS authors,
    CASE WHEN doc_id % 10 <> 0 THEN 'Title ' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2000 + doc_id % 20 END AS year, CASE WHEN doc_id % 7 = 0 THEN 'raw | text' END AS raw, CASE WHEN doc_id % 3 = 1 THEN 'Intro' WHEN doc_id % 3 = 2 THEN '' END AS section,
    CASE WHEN doc_id % 5 <> 0 THEN doc_id // 2 END AS span, CASE WHEN doc_id % 2 = 0 THEN 'ref-' || (doc_id % 9) ELSE cite_key END AS key, CASE WHEN doc_id % 6 = 0 THEN 'seen in full text' WHEN doc_id % 6 = 1 THEN '' END AS notes, CASE WHEN doc_id % 8 = 1 THEN 'failed' END AS err FROM pred),
  cel AS (SELECT *, coalesce(nullif(replace(array_to_string(list_filter([CASE WHEN len(authors) > 2 THEN authors[1] || ' et al.' ELSE array_to_string(authors, ', ') END, title, CASE WHEN year <> 0 THEN CAST(year AS VARCHAR) END], lambda x: length(x) > 0), ', '), '|', '\|'), ''),
      replace(replace(raw, '|', '\|'), '|', '\|'), key) AS citation, CASE WHEN section = 'Intro' THEN '[Intro] ' || claim_id ELSE claim_id END AS claim, CASE WHEN n_issues > 0 THEN 'year differs' ELSE '' END AS issue,
      coalesce(nullif(notes, ''), err, '') AS expl, '[' || regexp_replace(key, '^ref-([0-9]+)$', '\1') || ']' AS mark,
      CASE supports WHEN 'supports' THEN 'Relevant' WHEN 'partial' THEN 'Partly Relevant' WHEN 'does_not' THEN 'Irrelevant' WHEN 'inconclusive' THEN 'Inconclusive' END AS label FROM rec)"""


def records_of(spark, sf_dir):
    """Records of every shape, for reports."""
    n, none = F.col("doc_id"), F.lit(None).cast("string")
    rows = pred(spark, sf_dir)
    authors = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(F.lit("A. Bee"))).when(n % 4 == 2, F.array(F.lit("A. Bee"), F.lit("C|D"))).otherwise(F.array(F.lit("E"), F.lit("F"), F.lit("G")))
    return rows.withColumn("severity", derive_severity(F.col("exists"), F.col("supports"), F.col("priority"))).withColumns({
        "authors": authors, "title": F.when(n % 10 != 0, F.concat(F.lit("Title "), n)), "year": F.when(n % 3 == 0, 0).otherwise((2000 + n % 20).cast("int")), "raw": F.when(n % 7 == 0, "raw | text"),
        "section": F.when(n % 3 == 1, "Intro").when(n % 3 == 2, ""), "span": F.when(n % 5 != 0, F.floor(n / 2)), "cite_key": F.when(n % 2 == 0, F.concat(F.lit("ref-"), n % 9)).otherwise(F.col("cite_key")),
        "notes": F.when(n % 6 == 0, "seen in full text").when(n % 6 == 1, ""), "error": F.when(n % 8 == 1, "failed").otherwise(none), "claim": F.col("claim_id"),
    })


_NL = "chr(10)"
_MAIN = f"""num AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY f, ord) AS no FROM (SELECT *, min(ord) OVER (PARTITION BY paper_id, key) AS f, span IS NOT NULL AND count(*) OVER (PARTITION BY paper_id, span) > 1 AS shared FROM cel WHERE supports <> 'skipped')),
  main AS (SELECT paper_id, '**Scope:** ' || count(*) || ' (claim, citation) ' || CASE WHEN count(*) = 1 THEN 'pair' ELSE 'pairs' END || ' for `' || paper_id || '`.' || {_NL} || {_NL} || '| {" | ".join(report.HEADER)} |' || {_NL} || '|{" --- |" * 7}' || {_NL}
    || string_agg('| ' || no || ' | ' || citation || ' | ' || CASE WHEN shared THEN mark || ' ' ELSE '' END || claim || ' | ' || exists_ || ' | ' || issue || ' | ' || label || ' | ' || expl || ' |', {_NL} ORDER BY no) AS "table" FROM num GROUP BY paper_id)"""
_SKIPPED = f"""num2 AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY f, ord) AS no FROM (SELECT *, min(ord) OVER (PARTITION BY paper_id, key) AS f FROM cel WHERE supports = 'skipped')),
  skip AS (SELECT paper_id, '## Skipped — table/figure citation sites' || {_NL} || {_NL} || 'These **' || count(*) || '**{report.SKIPPED_NOTE[1]}' || {_NL} || {_NL} || '| {" | ".join(report.SKIPPED_HEADER)} |' || {_NL} || '|{"---|" * 5}' || {_NL}
    || string_agg('| ' || no || ' | ' || citation || ' | ' || claim || ' | ' || exists_ || ' | ' || issue || ' |', {_NL} ORDER BY no) AS skipped FROM num2 GROUP BY paper_id)"""


def _sum_row(label: str, count: str, token: str) -> str:
    return f"'| {label} | ' || {count} || ' |  | {report.SUPPORTS[token]} | ' || s_{token} || ' |' || {_NL}"


_REASON = "CASE WHEN supports = 'inconclusive' THEN CASE WHEN exists_ <> 'yes' THEN 'unresolved' WHEN contains(notes, 'full text') THEN 'fulltext' ELSE 'abstract' END END"
_WHY = {k: v.replace("'", "''") for k, v in report.REASONS.items()}
_SUMMARY = f"""wrk AS (SELECT paper_id, key, arg_min(exists_, ord) AS e, bool_or(n_issues > 0) AS m FROM cel GROUP BY 1, 2),
  bw AS (SELECT paper_id, count(*) AS refs, count_if(m) AS meta, {", ".join(f"count_if(e = '{x}') AS e_{x}" for x in report.EXISTS)} FROM wrk GROUP BY 1),
  br AS (SELECT paper_id, count(*) AS n, count_if(severity = 'high') AS high, {", ".join(f"count_if(supports = '{x}') AS s_{x}" for x in report.SUPPORTS)}, {", ".join(f"count_if(reason = '{x}') AS r_{x}" for x in report.REASONS)},
    string_agg('- `' || key || '` — ' || citation || ': high' || CASE WHEN expl <> '' THEN ' — ' || expl ELSE '' END, {_NL} ORDER BY ord) FILTER (WHERE severity = 'high') AS fixes FROM (SELECT *, {_REASON} AS reason FROM cel) GROUP BY 1),
  summ AS (SELECT bw.paper_id, '## Summary' || {_NL} || {_NL} || '**' || n || '** (claim, citation) pairs over **' || refs || '** unique references · **' || meta || '** with metadata issues · **' || high || '** high-severity.' || {_NL} || {_NL}
    || '| References — Exists? | n |  | Claims — Relevance | n |' || {_NL} || '|:---|---:|:-:|:---|---:|' || {_NL} || {_sum_row("yes", "e_yes", "supports")} || {_sum_row("unresolved", "e_unresolved", "partial")} || {_sum_row("no (fabricated)", "e_no", "does_not")}
    || '| **total refs** | **' || refs || '** |  | Inconclusive | ' || s_inconclusive || ' |' || CASE WHEN s_inconclusive > 0 THEN {_NL} || {_NL} || '{report.ABSTAINED}' ELSE '' END
    || {" || ".join(f"CASE WHEN r_{k} > 0 THEN {_NL} || '- {v}: **' || r_{k} || '**' ELSE '' END" for k, v in _WHY.items())}
    || CASE WHEN s_skipped > 0 THEN {_NL} || {_NL} || '*Plus **' || s_skipped || '**{report.SKIPPED_NOTE[0]}' ELSE '' END || CASE WHEN high > 0 THEN {_NL} || {_NL} || '### Fix before submission' || {_NL} || fixes ELSE '' END AS summary FROM bw JOIN br ON bw.paper_id = br.paper_id)"""


@query(f"""{_RECORDS}, {_MAIN} SELECT paper_id, "table" FROM main""")
def markdown_table(spark, sf_dir):
    """The main table of each paper's report."""
    return report.table(records_of(spark, sf_dir))


@query(f"{_RECORDS}, {_SKIPPED} SELECT paper_id, skipped FROM skip")
def skipped_appendix(spark, sf_dir):
    return report.skipped(records_of(spark, sf_dir))


@query(f"{_RECORDS}, {_SUMMARY} SELECT paper_id, summary FROM summ")
def markdown_summary(spark, sf_dir):
    return report.summary(records_of(spark, sf_dir))


_FOOTER = rf"""foot AS (SELECT paper_id, '## Run' || {_NL} || {_NL} || '- Backend: `b`' || CASE WHEN count(*) % 2 = 0 THEN ' · model `m`' ELSE '' END || {_NL} || '- Tokens: in ' || format('{{:,}}', sum(doc_id)::BIGINT) || ' / out ' || format('{{:,}}', count(*) * 1000) || ' (total ' || format('{{:,}}', (sum(doc_id) + count(*) * 1000)::BIGINT) || ')' || {_NL}
    || '- Cost: $' || format('{{:.4f}}', count(*) / 8.0) || ' · turns ' || count(*) || ' · tool calls ' || count(DISTINCT key) || CASE WHEN count(*) % 3 <> 0 THEN {_NL} || '- Wall time: ' || format('{{:.1f}}', CAST(count(*) % 3 AS DOUBLE)) || 's' ELSE '' END
    || CASE WHEN count(*) % 2 = 1 THEN {_NL} || {_NL} || '### Degraded pairs' || {_NL} || '- a \| b' ELSE '' END AS footer FROM cel GROUP BY 1)"""


def _usage_of(records):
    n = F.col("turns")
    sums = records.groupBy("paper_id").agg(F.count("*").alias("turns"), F.sum("doc_id").alias("n_in"), F.count_distinct("cite_key").alias("tool_calls"))
    return sums.withColumns({
        "backend": F.lit("b"), "model": F.when(n % 2 == 0, "m").otherwise(""), "n_out": n * 1000, "cost": n / 8, "seconds": (n % 3).cast("double"), "errors": F.when(n % 2 == 1, F.array(F.lit("a | b"))).otherwise(F.array().cast("array<string>")),
    })


@query(f"{_RECORDS}, {_FOOTER} SELECT paper_id, footer FROM foot")
def usage_footer(spark, sf_dir):
    return report.usage_footer(_usage_of(records_of(spark, sf_dir)))


@query(f"""{_RECORDS}, {_MAIN}, {_SKIPPED}, {_SUMMARY}, {_FOOTER} SELECT summ.paper_id, '# Citation verification — `' || summ.paper_id || '`' || {_NL} || {_NL}
    || coalesce("table", '**Scope:** 0 (claim, citation) pairs.' || {_NL} || {_NL} || '| {" | ".join(report.HEADER)} |' || {_NL} || '|{" --- |" * 7}') || {_NL} || {_NL} || summary || coalesce({_NL} || {_NL} || skipped, '') || {_NL} || {_NL} || footer AS report
  FROM summ LEFT JOIN main ON summ.paper_id = main.paper_id LEFT JOIN skip ON summ.paper_id = skip.paper_id JOIN foot ON summ.paper_id = foot.paper_id""")
def markdown_report(spark, sf_dir):
    """Whole reports: heading, table, summary, appendix, run."""
    rows = records_of(spark, sf_dir)
    return report.markdown(rows, _usage_of(rows))


@query(f"""{_RECORDS}, k AS (SELECT paper_id, key, arg_min(exists_, ord) AS e, count(*) AS pairs, count_if(severity = 'high') AS high FROM cel GROUP BY 1, 2)
  SELECT paper_id, CAST(count(*) AS BIGINT) AS refs, CAST(sum(pairs) AS BIGINT) AS pairs, CAST(sum(high) AS BIGINT) AS high, count_if(e = 'yes') AS yes, (SELECT count(*) FROM cel WHERE cel.paper_id = k.paper_id AND supports = 'partial') AS partial FROM k GROUP BY 1""")
def web_summary(spark, sf_dir):
    got = report.web_summary(records_of(spark, sf_dir))
    return got.select("paper_id", "refs", "pairs", "high", F.coalesce(F.try_element_at("exists", F.lit("yes")), F.lit(0)).alias("yes"), F.coalesce(F.try_element_at("supports", F.lit("partial")), F.lit(0)).alias("partial"))


@query()
def evidence_chunks(spark, sf_dir):
    """Rows only: benchmark texts as claims against documents of the same number.

    Both are numbered by their ids modulo one count, of items or of documents if these are fewer, so that no claim is
    without documents.
    """
    items, documents = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    papers = F.lit(max(1, min(items.select("item_id").distinct().count(), documents.select("doc_id").distinct().count())))
    claims = items.select(F.col("item_id").alias("claim_id"), F.pmod("item_id", papers).cast("int").alias("paper"), F.col("text").alias("claim"))
    passages = documents.select(F.pmod("doc_id", papers).cast("int").alias("paper"), F.col("doc_id").alias("section_no"), F.lit("").alias("heading"), "text")
    return evidence.top_chunks(claims, passages)


@query()
def latex_sites(spark, sf_dir):
    """Rows only: TeX made of whole documents, their percent signs escaped, parsed into citation sites."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    body = F.concat(F.lit("\\section{Intro} "), F.replace("text", F.lit("%"), F.lit("\\%")), F.lit(" \\citep[see][]{a"), (F.col("doc_id") % 7).cast("string"), F.lit(", b}. % \\cite{gone}\n\\begin{table} x \\cite{t} \\end{table}"))
    return tex.site_table(d.select(F.col("doc_id").alias("file"), body.alias("text")))


_WORDS = f"list_distinct(list_filter(string_split(regexp_replace(lower({{x}}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) > 2 AND NOT list_contains({list(evidence.STOP)}, t)))"


@query(f"""WITH p AS (SELECT p_partkey AS n, p_partkey // 20 AS paper, p_name, p_type FROM part), c AS (SELECT n AS claim_id, paper, n % 2 = 0 AS exp, {_WORDS.format(x="CASE WHEN n % 2 = 0 THEN 'accuracy of ' || p_name || ' and big things' ELSE 'it sees ' || p_name END")} AS cw FROM p),
  k AS (SELECT paper, n AS section_no, CASE n % 3 WHEN 0 THEN 'Results' WHEN 1 THEN 'Introduction' ELSE '' END AS heading, unnest([0, 1]) AS chunk_no, unnest(['The ' || p_name || ' is good.', 'It has ' || p_type || ' accuracy.']) AS chunk FROM p),
  s AS (SELECT claim_id, c.paper, heading, chunk, section_no, chunk_no, len(list_intersect(cw, {_WORDS.format(x='chunk')})) / len(cw) AS overlap FROM c JOIN k ON c.paper = k.paper WHERE heading <> 'Results' OR exp)
  SELECT claim_id, paper, CAST(place AS INT) AS place, heading, chunk, overlap FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, paper ORDER BY overlap DESC, section_no, chunk_no) AS place FROM s) WHERE place <= 3""")
def evidence_topk(spark, sf_dir):
    """The passages of its paper that cover most of a claim's words: sections in scope, chunks, no headings."""
    n, name = F.col("p_partkey"), F.col("p_name")
    p = table(spark, sf_dir, "part").withColumn("paper", F.floor(n / 20))
    claims = p.select(n.alias("claim_id"), "paper", F.when(n % 2 == 0, F.concat(F.lit("Accuracy of "), name, F.lit(" and big things"))).otherwise(F.concat(F.lit("it sees "), name)).alias("claim"))
    heading = F.when(n % 3 == 0, "Results").when(n % 3 == 1, "Introduction").otherwise("")
    passages = p.select("paper", n.alias("section_no"), heading.alias("heading"), F.concat(F.lit("The  "), name, F.lit(" is\ngood.\n\nIt has "), "p_type", F.lit(" accuracy.\n \nE.2 Big Things of Accuracy")).alias("text"))
    return evidence.top_chunks(claims, passages)


@query("""SELECT p_partkey AS file, 'p' || p_partkey AS key, 'article' AS type, p_name AS title, 'A and B' AS author, CAST(1990 + p_size AS VARCHAR) AS year FROM part""")
def bib_parse(spark, sf_dir):
    """BibTeX files as entries."""
    p = table(spark, sf_dir, "part")
    entry = F.concat(F.lit("@comment{x}\n@Article{p"), F.col("p_partkey"), F.lit(",\n title = {{"), "p_name", F.lit("}},\n author = \"A and\n B\", year = "), (F.lit(1990) + F.col("p_size")).cast("string"), F.lit("\n}\n"))
    got = tex.bib_table(p.select(F.col("p_partkey").alias("file"), entry.alias("text")))
    return got.select("file", "key", "type", *[F.col("fields")[c].alias(c) for c in ("title", "author", "year")])


@query("""SELECT p_partkey AS file, CAST(r AS INT) AS r, CAST(c AS INT) AS c, replace(raw, 'BRAND', p_brand) AS raw, CAST(span AS INT) AS span FROM part, (VALUES (0, 0, 'Method', 1), (0, 1, 'Marks', 2), (1, 0, 'BRAND', 1), (1, 1, '\\cmark', 1), (1, 2, '{a & b}', 1), (2, 0, 'ours', 1), (2, 1, '5\\%', 1), (2, 2, 'x', 1)) v(r, c, raw, span)""")
def tabular_cells(spark, sf_dir):
    """LaTeX tables as cells."""
    p = table(spark, sf_dir, "part")
    body = F.concat(F.lit("\\toprule Method & \\multicolumn{2}{c}{Marks} \\\\ \\midrule "), "p_brand", F.lit(" & \\cmark & {a & b} \\\\[2pt] ours & 5\\% & x \\\\"))
    return tex.cell_table(p.select(F.col("p_partkey").alias("file"), body.alias("text")))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS doc_id, CAST(page AS INT) AS page, y0, x0, x1, replace(text, 'NAME', s_name) AS text FROM supplier, (SELECT unnest([0, 1]) AS page), (VALUES (100.0, 10.0, 60.0, '[1] Ann NAME'), (100.0, 200.0, 220.0, 'far'), (112.0, 16.0, 30.0, 'wrapped'), (124.0, 10.0, 40.0, '[2] Bo')) v(y0, x0, x1, text)""")
def word_grid(spark, sf_dir):
    """Words with positions into lines: a word joins the first line that begins within reach of it, and lines part at wide gaps."""
    at = (("[2]", 10.0, 124.0, 20.0), ("Bo", 25.0, 125.0, 40.0), ("far", 200.0, 101.4, 220.0), ("wrapped", 16.0, 112.0, 30.0), ("Ann", 22.0, 101.5, 40.0), ("[1]", 10.0, 100.0, 20.0))
    words = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(z).alias("x1")) for t, x, y, z in at], F.struct(F.col("s_name").alias("text"), F.lit(45.0).alias("x0"), F.lit(100.9).alias("y0"), F.lit(60.0).alias("x1")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("page"), words.alias("w")).select("doc_id", "page", F.inline("w"))
    return layout.baselines(rows)


@query("""SELECT CAST(s_suppkey AS BIGINT) AS doc_id, CAST(e AS BIGINT) AS entry, replace(text, 'NAME', s_name) AS text FROM supplier, (VALUES (1, 'Ann NAME. One thing here. https://a.org/xgoes'), (2, 'Bo. Two things of the wordnet'), (3, 'Cy. Three.')) v(e, text)""")
def hanging_entries(spark, sf_dir):
    """Lines of reference lists in columns, cut at the left edges."""
    at = ((0, 0, 10.0, 50.0, None), (0, 0, 20.0, 60.0, "One thing here. https://a.org/"), (0, 0, 30.0, 60.0, "x"), (0, 0, 35.0, 61.0, "goes"), (0, 0, 40.0, 52.0, "Bo. Two"), (0, 1, 5.0, 312.0, "things of the word-"), (0, 1, 10.0, 312.0, "net"), (0, 1, 20.0, 300.0, "Cy. Three."))
    line = lambda t: F.concat(F.lit("Ann "), F.col("s_name"), F.lit(".")) if t is None else F.lit(t)
    lines = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(c).alias("col"), F.lit(y).alias("y0"), F.lit(x).alias("x0"), line(t).alias("text")) for p, c, y, x, t in at])
    return layout.hanging_entries(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("doc_id"), F.inline(lines)))


@query("""WITH w AS (SELECT row_number() OVER () AS word_id, l_partkey, l_suppkey AS page, CAST(l_partkey % 500 AS DOUBLE) AS x FROM lineitem), a AS (SELECT s_suppkey AS page, k AS col, (s_suppkey * 7 + k * 61) % 500 AS ax FROM supplier, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k))
  SELECT page, col, count(*) AS n FROM (SELECT w.word_id, w.page, w.x, w.l_partkey, arg_min(col, abs(x - ax) * 1000 + col) AS col FROM w JOIN a ON w.page = a.page WHERE abs(x - ax) <= 25 GROUP BY ALL) GROUP BY 1, 2""")
def nearest_anchor(spark, sf_dir):
    """Words by the nearest column of their page."""
    n = F.col("s_suppkey")
    anchors = table(spark, sf_dir, "supplier").select(n.alias("page"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("col")).select("page", "col", ((F.col("page") * 7 + F.col("col") * 61) % 500).cast("double").alias("ax"))
    words = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("word_id"), F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 500).cast("double").alias("x"))
    return layout.nearest_anchor(words, anchors, 25.0).groupBy("page", "col").agg(F.count("*").alias("n"))


@query("""SELECT item_id, list_aggregate(list_transform(range(len(w)), lambda i: w[i + 1]), 'string_agg', ' ') AS abstract FROM (SELECT item_id, string_split_regex(trim(text), '\\s+') AS w FROM benchmark)""")
def openalex_abstract(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("p", "w"))
    index = words.groupBy("item_id", "w").agg(F.collect_list("p").alias("at")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))
    return index.select("item_id", records.openalex_abstract(F.col("index")).alias("abstract"))
