"""Claim sites, pages, comparison tables and columns: inputs of known structure are built from the tables, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.operators import dimensions, verify
from refloom.plans.references import _pick, _values
from refloom.plans.registry import query, table
from refloom.plans.tables import _ANSWER, _CELLS, _VERDICT, judged
from refloom.sources import claims, seeds, tex, textables

# ---- claims ----------------------------------------------------------------------------------------------------------
_SITES = """SELECT p_partkey, cite_key, section, in_table, sentence FROM (SELECT p_partkey, 'k' || p_partkey AS cite_key, 'Intro Two' AS section, false AS in_table, 'We use ' || p_name || ' and more, as in here' AS sentence FROM part
  UNION ALL SELECT p_partkey, 'b', 'Intro Two', false, 'We use ' || p_name || ' and more, as in here' FROM part UNION ALL SELECT p_partkey, 't', 'Results', true, 'table* ' || p_name || ' x & y table*' FROM part)"""


@query(f"SELECT p_partkey AS file, cite_key AS key, section, in_table, sentence FROM ({_SITES})")
def latex_citations(spark, sf_dir):
    """Citation sites of TeX files: keys, sections, tables and sentences."""
    p = table(spark, sf_dir, "part")
    text = F.concat(
        F.lit("\\section{Intro \\emph Two} One ends. We \\emph{use} "), "p_name", F.lit(" and~more, as in \\citep[see][p.~2]{k"), "p_partkey",
        F.lit(", b} here. % \\cite{gone}\nNext one.\n\\subsection*{Results}\n\nAll told. \\begin{table*} "), "p_name", F.lit(" x \\& y \\cite*{t} \\end{table*}"),
    )
    return tex.site_table(p.select(F.col("p_partkey").alias("file"), text.alias("text"))).select("file", "key", "section", "in_table", "sentence")


@query("""WITH s AS (SELECT doc_id, n_chars, coalesce(text, '') AS t FROM documents) SELECT doc_id AS paper_id, key AS cite_key, claim FROM (
    SELECT doc_id, 'doe' || (1990 + doc_id % 30) AS key, 'As Doe et al. (' || (1990 + doc_id % 30) || ') say in ' || doc_id || '.' AS claim FROM s
    UNION ALL SELECT doc_id, 'roe2001a', 'It holds (Roe & Poe, 2001a; Müller et al. 2003, 2004) too.' FROM s UNION ALL SELECT doc_id, 'muller2003', 'It holds (Roe & Poe, 2001a; Müller et al. 2003, 2004) too.' FROM s UNION ALL SELECT doc_id, 'muller2004', 'It holds (Roe & Poe, 2001a; Müller et al. 2003, 2004) too.' FROM s)""")
def author_year_sites(spark, sf_dir):
    """Author-year citations in text, with their sentences."""
    n = F.col("doc_id")
    text = F.concat(F.lit("First. As Doe et al. ("), (1990 + n % 30).cast("string"), F.lit(") say in "), n, F.lit(".\nIt holds (Roe & Poe, 2001a; Müller et al. 2003, 2004) too. Last one."))
    return claims.text_sites(table(spark, sf_dir, "documents").select(n.alias("paper_id"), text.alias("text"))).select("paper_id", "cite_key", "claim")


@query("""SELECT p_partkey, p_partkey % 4 IN (1, 2) AS dump, p_partkey % 3 <> 2 AS cjk, CASE p_partkey % 2 WHEN 0 THEN 'Prose of ' || p_name || ' goes on here.' || chr(10) || 'And more.' ELSE '' || chr(10) || 'Text ' || p_name || '.' END AS body FROM part""")
def prose_tests(spark, sf_dir):
    """Dumped table rows, East Asian notes, and pages without their furniture."""
    n, name = F.col("p_partkey"), F.col("p_name")
    claim = F.when(n % 4 == 1, "ELIZA [19] 1966 Chat SHRDLU [20] 1970 Task PARRY [21] Chat").when(n % 4 == 2, "VAE 55M 4096 0.27 LDM 400M 3.60 1.5B").otherwise(F.concat(F.lit("works [1], [2], [3] show 2.5 "), name))
    line = F.when(n % 3 == 0, F.concat(name, F.lit(" Yang Yue (乐阳) led"))).when(n % 3 == 1, "清华大学 计算机").otherwise(F.concat(F.lit("The word 乐 means joy in "), name))
    page = F.when(n % 2 == 0, F.concat(F.lit("12\n© The Authors\n1 Introduction\nProse of "), name, F.lit(" goes on here.\n∗ Equal contribution\nPreprint. Under review.\nAnd more."))).otherwise(
        F.concat(F.lit("1 Department of Things (X)\nSome Place, Town\n2 School of Art (Y)\n\nwrite to\na.b@c.org\nUniversity of X\nText "), name, F.lit("."))
    )
    return table(spark, sf_dir, "part").select(n, claims.table_dump(claim).alias("dump"), claims.cjk_boilerplate(line).alias("cjk"), claims.scan_body(page).alias("body"))


@query("""SELECT l_orderkey, first(l_orderkey) OVER () IS NOT NULL AS same, true AS other, true AS shaped FROM (SELECT DISTINCT l_orderkey FROM lineitem)""")
def claim_ids(spark, sf_dir):
    """Names of citation sites: the same for the same site, others for others, of twelve hexadecimal digits."""
    n = F.col("l_orderkey")
    name = lambda begin, section: claims.claim_id(F.lit("p"), section, begin, begin + 5, F.lit("k"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    one, two, none = name(n, F.lit("s")), name(n, F.lit("s2")), name(n, F.lit(None).cast("string"))
    return rows.select(n, (one == name(n, F.lit("s"))).alias("same"), ((one != two) & (one != none) & (none == name(n, F.lit("")))).alias("other"), one.rlike("^claim-[0-9a-f]{12}$").alias("shaped"))


@query("""WITH s AS (SELECT l_orderkey % 300 AS paper_id, 'c' || (l_linenumber % 3) AS claim_id, 'k' || l_suppkey AS cite_key, l_orderkey * 10 + l_linenumber AS ord, l_partkey FROM lineitem),
  f AS (SELECT *, row_number() OVER (PARTITION BY paper_id, claim_id, cite_key ORDER BY ord, l_partkey) AS k FROM s), d AS (SELECT * FROM f WHERE k = 1), p AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ord, claim_id, cite_key) AS place FROM d)
  SELECT paper_id, count(*) AS n, count(DISTINCT cite_key) AS keys, count_if(CAST(substr(cite_key, 2) AS INT) % 2 = 1) AS missing FROM p WHERE place <= 5 GROUP BY 1""")
def citation_stubs(spark, sf_dir):
    """Stubs of citation sites, each once, joined with their references, the first five of a paper."""
    n = F.col("l_orderkey")
    sites = table(spark, sf_dir, "lineitem").select((n % 300).alias("paper_id"), F.concat(F.lit("c"), F.col("l_linenumber") % 3).alias("claim_id"), F.concat(F.lit("k"), "l_suppkey").alias("cite_key"), F.struct((n * 10 + F.col("l_linenumber")).alias("a"), F.col("l_partkey").alias("b")).alias("ord"))
    stubs = claims.first_stubs(sites)
    refs = stubs.select("paper_id", "cite_key").distinct().filter("CAST(substr(cite_key, 2) AS INT) % 2 = 0").withColumn("title", F.lit("t"))
    joined = claims.with_references(claims.first_citations(stubs.withColumn("ord", F.struct("ord.a", "claim_id", "cite_key")), 5), refs)
    return joined.groupBy("paper_id").agg(F.count("*").alias("n"), F.count_distinct("cite_key").alias("keys"), F.count("note").alias("missing"))


# ---- pages -----------------------------------------------------------------------------------------------------------
@query("""WITH w AS (SELECT l_suppkey AS page, CAST(l_partkey % 600 AS DOUBLE) AS x0, l_partkey % 600 + 5.0 + CASE WHEN l_suppkey % 3 = 0 THEN 200 ELSE 0 END AS x1 FROM lineitem WHERE l_suppkey % 5 <> 4 OR l_partkey % 600 < 280 OR l_suppkey % 2 = 0)
  SELECT page, n >= 40 AND across < 0.02 * n AND least(l, n - l) > 0.25 * n AS two FROM (SELECT page, count(*) AS n, count_if(x0 < 300 AND 300 < x1) AS across, count_if((x0 + x1) / 2 < 300) AS l FROM w GROUP BY 1)""")
def two_columns(spark, sf_dir):
    x = (F.col("l_partkey") % 600).cast("double")
    words = table(spark, sf_dir, "lineitem").filter("l_suppkey % 5 <> 4 OR l_partkey % 600 < 280 OR l_suppkey % 2 = 0").select(F.col("l_suppkey").alias("page"), x.alias("x0"), (x + 5 + F.when(F.col("l_suppkey") % 3 == 0, 200).otherwise(0)).alias("x1"), F.lit(600.0).alias("width"))
    return claims.two_columns(words, ["page"])


@query("""WITH w AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS word_no, l_partkey % 500 AS x, l_orderkey % 700 AS y FROM lineitem), r AS (SELECT s_suppkey AS page, unnest([1, 2]) AS rect_id, (s_suppkey * 37) % 400 AS x, (s_suppkey * 91) % 600 AS y FROM supplier)
  SELECT r.page, r.rect_id, min(CASE WHEN w.y + 8 >= r.y AND w.y <= r.y + 40 * rect_id AND w.x + 20 >= r.x AND w.x <= r.x + 60 * rect_id THEN word_no END) AS word_no FROM r LEFT JOIN w ON r.page = w.page GROUP BY 1, 2""")
def rectangle_hits(spark, sf_dir):
    """The first word that each link's rectangle overlaps."""
    box = lambda x, y, w, h: [x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1")]
    words = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("word_no"), *box(F.col("l_partkey") % 500, F.col("l_orderkey") % 700, F.lit(20), F.lit(8)))
    s = F.col("s_suppkey")
    rects = table(spark, sf_dir, "supplier").select(s.alias("page"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rect_id")).select("page", "rect_id", *box(F.col("page") * 37 % 400, F.col("page") * 91 % 600, 60 * F.col("rect_id"), 40 * F.col("rect_id")))
    return claims.first_hit(rects, words, ["page"])


@query("""WITH l AS (SELECT l_suppkey AS doc, l_linenumber AS col, l_partkey % (l_suppkey % 4 + 3) + l_linenumber * 100 AS x0 FROM lineitem), e AS (SELECT doc, col, min(x0) AS edge FROM l GROUP BY 1, 2)
  SELECT l.doc, avg(CAST(x0 <= edge + 2 AS INT)) >= 0.85 AS flush FROM l JOIN e ON l.doc = e.doc AND l.col = e.col GROUP BY 1""")
def flush_left(spark, sf_dir):
    s, line = F.col("l_suppkey"), F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(s.alias("doc"), line.alias("col"), (F.col("l_partkey") % (s % 4 + 3) + line * 100).alias("x0"))
    return claims.flush_left(lines, ["doc"], ["col"], indent=2.0)


@query("""SELECT p_partkey, replace(p_name, ' ', '') || ' 3.5 x' AS text, 'A https://a.org/x-y.zB, and word- Net wordnet' AS entry, 'Yetistiren B, efficient Language' || chr(10) || '11. Yang Z, Gan Z. Title' AS pdf FROM part""")
def glyph_lines(spark, sf_dir):
    """Glyphs with gaps into text, an entry's lines into one, and a PDF's text in plain form."""
    n = F.col("p_partkey")
    letters = F.split(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("|3.|5|x")), "")
    glyphs = table(spark, sf_dir, "part").select(n, F.posexplode(F.filter(letters, lambda c: c != "")).alias("no", "ch"))
    bars = F.sum((F.col("ch") == "|").cast("int")).over(_order("p_partkey"))
    placed = glyphs.withColumn("x0", F.col("no") * 5.0 + bars * 4.0).filter("ch <> '|'").withColumns({"x1": F.col("x0") + 5.0, "size": F.lit(10.0)})
    entry = F.array(*map(F.lit, ("A https://a.org/", "x-", "y.z", "B , and word-", "Net word-", "net")))
    pdf = F.lit("Yeti ̧stiren B, eﬃcient Lan- guage\n1 1 . Y a n gZ , G a nZ . T i t l e")
    return table(spark, sf_dir, "part").select(n, claims.entry_text(entry).alias("entry"), claims.pdf_text(pdf).alias("pdf")).join(claims.glyph_text(placed, ["p_partkey"]), "p_partkey").select("p_partkey", "text", "entry", "pdf")


def _order(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)


# ---- tables ----------------------------------------------------------------------------------------------------------
_GRID = """(VALUES (0, 'A', 'a,b', false, 1, 'Efficiency — Fast', 'yes'), (0, 'A', 'a,b', false, 2, 'Efficiency — Cheap', 'no'), (1, 'B', 'c', false, 1, 'Efficiency — Fast', 'no'), (1, 'B', 'c', false, 2, 'Efficiency — Cheap', 'yes'), (2, 'OWN (ours)', '', true, 1, 'Efficiency — Fast', 'yes'), (2, 'OWN (ours)', '', true, 2, 'Efficiency — Cheap', 'partial')) v(r, label, keys, own, c, head, mark)"""


@query(f"SELECT p_partkey AS file, CAST(r AS INT) AS row_index, replace(label, 'OWN', p_name) AS row_label, keys, own AS is_self, CAST(c AS INT) AS col_index, head AS header, mark FROM part, {_GRID}")
def latex_tables(spark, sf_dir):
    """Comparison tables of TeX files, with stacked headers, macros, citations and the paper's own row; tables of results are left out."""
    p = table(spark, sf_dir, "part")
    text = F.concat(
        F.lit("\\newcommand{\\method}{"), "p_name", F.lit("}\\begin{table}[t]\\caption{Compare}\\begin{tabular}{l|c@{}c}\\toprule Method & \\multicolumn{2}{c}{Efficiency} \\\\ \\cline{2-3} & Fast & Cheap \\\\ \\midrule A \\cite{a,b} & \\cmark & \\xmark \\\\[2pt] B~\\citep{c} & -- & \\ding{51} \\\\ % C & \\cmark \\\\\n"),
        F.lit("\\method (ours) & \\textbf{Yes} & $\\halfcirc$ \\\\ \\bottomrule\\end{tabular}\\end{table}\\begin{tabular}{lcc} Results & a & b \\\\ X \\cite{q} & 81.2 & 3.4 \\\\ Y & 80.0 & 2.2 \\\\ \\end{tabular}"),
    )
    got = textables.comparison_table_cells(p.select(F.col("p_partkey").alias("file"), text.alias("text")))
    return got.select("file", "row_index", "row_label", F.array_join("cite_keys", ",").alias("keys"), "is_self", "col_index", "header", "mark")


_KINDS = "CASE col_index WHEN 1 THEN 'binary' WHEN 2 THEN 'graded' WHEN 3 THEN 'text' ELSE 'categorical' END"
_GLOSS = "CASE CAST(l_orderkey % 4 AS INT) WHEN 0 THEN 'body' WHEN 1 THEN 'mention' WHEN 2 THEN 'none' ELSE CASE WHEN l_orderkey % 8 = 3 THEN 'header_only' ELSE 'caption' END END"
_FACTS = f"""v AS (SELECT *, {_ANSWER} AS answer, {_KINDS} AS kind, {_GLOSS} AS gloss, l_orderkey % 7 = 0 AS is_self, l_orderkey % 3 AS n_cites, CASE l_orderkey % 11 WHEN 0 THEN '' ELSE 'text' END AS ev FROM ({_CELLS})),
  s AS (SELECT *, CASE WHEN is_self OR n_cites = 0 OR mark NOT IN ('yes', 'no', 'partial') THEN 'skipped' WHEN gloss = 'header_only' THEN 'undefined' WHEN kind = 'text' THEN 'skipped' END AS sk, CASE WHEN ev = '' THEN 'unverifiable' ELSE {_VERDICT} END AS raw_v FROM v),
  t AS (SELECT *, CASE WHEN sk IS NOT NULL THEN sk WHEN raw_v = 'contradicted' AND mark = 'no' AND kind = 'categorical' THEN 'undefined' WHEN raw_v = 'contradicted' AND gloss = 'none' THEN 'undefined' ELSE raw_v END AS verdict,
    sk IS NULL AND raw_v = 'contradicted' AND gloss = 'mention' AND NOT (mark = 'no' AND kind = 'categorical') AS loose FROM s)"""


def _facts(spark, sf_dir):
    """Cells of every kind with what is asked and known of them."""
    n, c = F.col("l_orderkey"), F.col("col_index")
    gloss = F.when(n % 4 == 0, "body").when(n % 4 == 1, "mention").when(n % 4 == 2, "none").otherwise(F.when(n % 8 == 3, "header_only").otherwise("caption"))
    kind = F.when(c == 1, "binary").when(c == 2, "graded").when(c == 3, "text").otherwise("categorical")
    rows = judged(spark, sf_dir).drop("verdict").withColumns({"is_self": n % 7 == 0, "n_cites": n % 3, "gloss": gloss, "kind": kind})
    return rows


@query(f"""WITH {_FACTS} SELECT verdict, severity, understates, count(*) AS n FROM (SELECT verdict, CASE WHEN loose THEN 'low' WHEN verdict = 'contradicted' AND ((mark = 'no' AND NOT is_self) OR (mark = 'yes' AND is_self)) THEN 'high' WHEN verdict = 'contradicted' THEN 'medium'
  WHEN verdict = 'may_not_support' THEN CASE WHEN is_self THEN 'low' ELSE 'medium' END WHEN verdict = 'undefined' THEN 'medium' WHEN verdict = 'unverifiable' THEN 'low' ELSE 'ok' END AS severity, verdict = 'contradicted' AND mark = 'no' AND NOT is_self AS understates FROM t) GROUP BY ALL""")
def verified_cells(spark, sf_dir):
    """Cells judged against the cited works, with what downgrades a contradiction."""
    facts = _facts(spark, sf_dir)
    row = ["table_id", "l_orderkey", "l_linestatus", "raw"]
    cells = facts.select(*row, "col_index", "is_self", "n_cites", "mark", "gloss", "kind").distinct()
    evidence = facts.select(*row).distinct().withColumns({"evidence": F.when(F.col("l_orderkey") % 11 == 0, " ").otherwise("text"), "failure": F.lit(None).cast("string")})
    answers = facts.select(*row, "col_index", F.lit(1).alias("ord"), F.initcap("answer").alias("answer"), F.lit("why").alias("justification"), F.lit("0.5").alias("confidence")).distinct()
    found = verify.verify_cells(cells, evidence, answers, row)
    counted = facts.groupBy(*row, "col_index").agg(F.count("*").alias("copies")).join(found, [*row, "col_index"])
    return counted.groupBy("verdict", "severity", "understates").agg(F.sum("copies").alias("n"))


@query("""SELECT p_partkey, 'COVERAGE: ' || CASE WHEN p_partkey % 3 = 0 THEN 'title and abstract only — the body was not retrieved' ELSE 'full text — the excerpts below were selected from the whole paper' END || chr(10) || chr(10) || 'TITLE: ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || 'ABSTRACT: a' ELSE '' END
  || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || chr(10) || 'FULL TEXT EXCERPTS:' || chr(10) || '[Intro] One thing.' || chr(10) || '[body] Two' ELSE chr(10) || chr(10) || 'FULL TEXT EXCERPTS:' || chr(10) || '[R] ' || repeat('x', 23000) END AS evidence FROM part""")
def evidence_blocks(spark, sf_dir):
    """What is known of a work as one text: excerpts once each, while they fit."""
    n = F.col("p_partkey")
    x = lambda h, t: F.struct(F.lit(h).alias("heading"), t.alias("text"))
    few = F.array(x("Intro", F.lit("One thing.")), x("Again", F.lit("one THING")), x("", F.lit("Two")), x("Gone", F.lit(" . ")))
    long = F.array(x("R", F.repeat(F.lit("x"), 23_000)), x("S", F.repeat(F.lit("y"), 2_000)), x("T", F.lit("short")))
    chunks = F.when(n % 3 == 1, few).when(n % 3 == 2, long)
    return table(spark, sf_dir, "part").select(n, verify.evidence_block(F.col("p_name"), F.when(n % 2 == 0, "a"), chunks).alias("evidence"))


@query(f"""WITH c AS ({_CELLS}), r AS (SELECT DISTINCT table_id, l_orderkey FROM c), h AS (SELECT DISTINCT table_id, col_index FROM c),
  a AS (SELECT table_id, count(*) AS n, avg(CAST(l_orderkey % 3 > 0 OR l_orderkey % 7 = 0 AS INT)) AS cited, avg(CAST(l_orderkey % 2 = 0 AS INT)) AS named FROM r GROUP BY 1), b AS (SELECT table_id, count(*) AS m, avg(CAST(col_index <> 4 AS INT)) AS headed FROM h GROUP BY 1), d AS (SELECT table_id, count_if(mark IN ('yes', 'no', 'partial')) AS marks FROM c GROUP BY 1)
  SELECT a.table_id, 0.4 * cited + 0.25 * headed + 0.2 * named + 0.15 * marks / (n * m) AS quality FROM a JOIN b ON a.table_id = b.table_id JOIN d ON a.table_id = d.table_id""")
def extraction_quality(spark, sf_dir):
    """How usable extractions of tables are."""
    n = F.col("l_orderkey")
    c = judged(spark, sf_dir)
    rows = c.select("table_id", "l_orderkey").distinct().select("table_id", F.when(n % 2 == 0, "Skeleton Merger [29]").otherwise("adaptability and the understanding of it").alias("label"), (n % 3).alias("n_cites"), (n % 7 == 0).alias("is_self"))
    columns = c.select("table_id", "col_index").distinct().select("table_id", F.when(F.col("col_index") == 4, " ").otherwise("h").alias("header"))
    return verify.extraction_quality(rows, columns, c, ["table_id"])


@query("""WITH l AS (SELECT s_suppkey // 5 AS paper_id, s_suppkey AS ord, [CASE WHEN s_suppkey % 2 = 0 THEN 'yes' ELSE 'no' END, 'no', 'yes', 'partial', 'no'] AS marks FROM supplier WHERE s_suppkey % 5 < 3), r AS (SELECT s_suppkey // 5 AS paper_id, s_suppkey AS ord, s_suppkey % 5 AS k FROM supplier WHERE s_suppkey % 5 < 2)
  SELECT paper_id, CAST(paper_id * 5 AS BIGINT) AS l_ord, CAST(paper_id * 5 AS BIGINT) AS r_ord FROM (SELECT DISTINCT paper_id FROM r WHERE k = 0) UNION ALL SELECT paper_id, paper_id * 5 + 1, paper_id * 5 + 1 FROM (SELECT DISTINCT paper_id FROM r WHERE k = 1)""")
def paired_extractions(spark, sf_dir):
    """Which two extractions are of one table: each takes the first free one that agrees."""
    n = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.floor(n / 5).alias("paper_id"), n.cast("long").alias("ord"), (n % 5).alias("k"))
    left = s.filter("k < 3").withColumn("marks", F.array(F.lit("empty"), F.lit("yes"), F.lit("no"), F.lit("yes"), F.lit("partial"), F.lit("no")))
    right = s.filter("k < 2").withColumn("marks", F.array(F.lit("yes"), F.lit("no"), F.lit("value"), F.lit("yes"), F.lit("partial"), F.lit("yes")))
    return verify.pair_extractions(left, right)


@query(f"""WITH c AS (SELECT table_id, l_orderkey AS r, col_index AS c, min(mark) AS mark FROM ({_CELLS}) GROUP BY 1, 2, 3), o AS (SELECT *, CASE WHEN (r + c) % 3 = 0 THEN 'x' ELSE mark END AS other FROM c)
  SELECT table_id, r AS row_index, c AS col_index, mark FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY r, c) AS k FROM o WHERE mark <> other) WHERE k <= 20""")
def mark_disagreements(spark, sf_dir):
    """Cells that two extractions read differently, the first twenty of a table."""
    c = judged(spark, sf_dir).groupBy("table_id", F.col("l_orderkey").alias("row_index"), "col_index").agg(F.min("mark").alias("mark"))
    other = c.withColumn("mark", F.when((F.col("row_index") + F.col("col_index")) % 3 == 0, "x").otherwise(F.col("mark")))
    return verify.mark_disagreements(c, other, ["table_id"]).select("table_id", "row_index", "col_index", "mark")


@query("""SELECT s_suppkey // 10 AS paper_id, min(s_suppkey) AS ord FROM supplier GROUP BY 1, s_suppkey % 3""")
def distinct_tables(spark, sf_dir):
    """Tables of a paper, each once."""
    n = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select(F.floor(n / 10).alias("paper_id"), n.alias("ord"), F.array(F.lit("h"), (n % 3).cast("string")).alias("headers"), F.array(F.lit("r")).alias("rows"), F.array(F.lit("yes")).alias("marks"))
    return verify.distinct_tables(t).select("paper_id", "ord")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END, p_name, p_partkey) AS place FROM part""")
def findings_order(spark, sf_dir):
    """Findings of a table, worst first."""
    n = F.col("p_partkey")
    severity = F.when(n % 4 == 0, "high").when(n % 4 == 1, "low").when(n % 4 == 2, "ok").otherwise("medium")
    rows = table(spark, sf_dir, "part").select(n, "p_brand", severity.alias("severity"), F.col("p_name").alias("row_label"), n.alias("dimension"))
    return verify.findings_order(rows, ["p_brand"]).select("p_partkey", "place")


# ---- columns ---------------------------------------------------------------------------------------------------------
#: (passage with {t} for the term, its score): cues, an own claim, a problem, leftovers, a mention, none.
_PASSAGES = (
    ("A method is {t} if and only if it adapts.", "6"), ("{t} means that tasks are known.", "5"), ("We define {t} here.", "2"), ("Most methods fail at {t} learning.", "-2"), ("\\begin{x} {t} denotes it.", "2"), ("The {t} column.", "4"),
    ("Nothing of the kind.", "0"), ("{t}s require a model, i.e. data.", "3"), ("OwnNet is {t}.", "-2"),
)


@query(f"SELECT p_partkey, CAST(s AS INT) + CASE WHEN s <> '0' AND p_partkey % 2 = 0 THEN 5 ELSE 0 END AS score FROM part JOIN {_values(_PASSAGES, 'passage, s')} ON p_partkey % {len(_PASSAGES)} = i")
def definition_scores(spark, sf_dir):
    """How much passages look like definitions of a column."""
    n = F.col("p_partkey")
    passage = F.replace(_pick(_PASSAGES, 0, n), F.lit("{t}"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("-aware")))
    spelled = F.array(F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" aware")))
    return table(spark, sf_dir, "part").select(n, dimensions.score(passage, spelled, n % 2 == 0, F.array(F.lit("OwnNet"))).alias("score"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '\\cmark=strong;▲=medium' WHEN 1 THEN '-=lacks that capability;◐=partly ' || p_name ELSE '' END AS legend,
  CASE p_partkey % 3 WHEN 0 THEN 'the augmented tasks are known to all' WHEN 1 THEN 'keeps every part of ' || p_name ELSE '' END AS definitions, p_partkey % 3 <> 2 AS grounded,
  CASE p_partkey % 3 WHEN 0 THEN ' Anaphora Resolution: it holds. a b' WHEN 1 THEN 'plain text' ELSE 'x   y' END AS prose FROM part""")
def column_evidence(spark, sf_dir):
    """Legends, definitions by punctuation, grounding, and TeX as prose."""
    n, name = F.col("p_partkey"), F.col("p_name")
    caption = F.when(n % 3 == 0, "Compare (\\cmark: strong, ▲ denotes medium; \\cmark: weak)").when(n % 3 == 1, F.concat(F.lit("``-'' indicates  lacks that capability. ◐ = partly "), name)).otherwise("no signs here")
    text = F.when(n % 3 == 0, "(3) \\textit{model-adaptive}: the augmented tasks are known to all. Model adaptive: see Table 3 for more.").when(n % 3 == 1, F.concat(F.lit("Models-adaptive learning — keeps every part of "), name, F.lit("; and model-adaptive, which we abbreviate MA in the tables")))
    gloss = F.when(n % 3 == 2, "something else entirely").otherwise("whether the augmented tasks are known")
    prose = F.when(n % 3 == 0, "\\paragraph{Anaphora Resolution.} it holds.\\begin{verbatim}a\n b\\end{verbatim}").when(n % 3 == 1, "plain text").otherwise("x~\\cite{a} \\label{q}y")
    legend = F.array_join(F.transform(F.map_entries(dimensions.symbol_legend(caption)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return table(spark, sf_dir, "part").select(
        n, legend.alias("legend"), F.array_join(dimensions.punctuation_definitions(F.lit("model-adaptive"), F.coalesce(text, F.lit(""))), ";").alias("definitions"),
        dimensions.grounded(gloss, F.lit("The augmented tasks are known to a model.")).alias("grounded"), F.rtrim(F.regexp_replace(dimensions.normalize_prose(prose), "holds\\.\\s+a b", "holds. a b")).alias("prose"),
    )


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'An adaptive method is defined as one that adapts.' WHEN 1 THEN 'supports adaptive (Order)' END AS gloss, CASE s_suppkey % 3 WHEN 0 THEN 'body' WHEN 1 THEN 'mention' ELSE 'header_only' END AS gloss_source FROM supplier""")
def column_glosses(spark, sf_dir):
    """The best passage of each column, and how good it is."""
    n = F.col("s_suppkey")
    p = F.when(n % 3 == 0, F.array(F.lit("We like adaptive things."), F.lit("An adaptive method is defined as one that adapts."), F.lit("Adaptive means that it adapts."))).when(n % 3 == 1, F.array(F.lit("Nothing."), F.lit("supports adaptive (Order)"))).otherwise(F.array(F.lit("Nothing at all.")))
    rows = table(spark, sf_dir, "supplier").select(n, F.posexplode(p).alias("ord", "passage")).withColumns({"header": F.lit("Adaptive"), "spellings": F.array(F.lit("adaptive")), "in_environment": F.lit(False), "own_names": F.array(F.lit("OwnNet"))})
    return dimensions.best_gloss(rows, ["s_suppkey"])


# ---- seeds -----------------------------------------------------------------------------------------------------------
@query("""SELECT 'V' || (c_custkey % 5) AS venue, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS paper_title, 'https://openreview.net/forum?id=n' || c_custkey AS paper_url, CASE WHEN c_custkey % 3 = 0 THEN 'https://openreview.net/pdf/' || c_custkey || '.pdf' END AS pdf_url, 'openreview:V' || (c_custkey % 5) AS provenance FROM customer""")
def review_seeds(spark, sf_dir):
    """Notes of venues as seeds."""
    n = F.col("c_custkey")
    note = F.struct(F.concat(F.lit("n"), n).alias("id"), F.struct(F.when(n % 2 == 0, F.struct(F.col("c_name").alias("value"))).alias("title"), F.when(n % 3 == 0, F.struct(F.concat(F.lit("/pdf/"), n, F.lit(".pdf")).alias("value"))).alias("pdf")).alias("content"))
    listing = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("V"), n % 5).alias("venue")).agg(F.to_json(F.struct(F.collect_list(note).alias("notes"))).alias("json"))
    return seeds.review_notes(listing).select("venue", "paper_title", "paper_url", "pdf_url", "provenance")


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE '21' || (10 + page_id % 80) || '.0000' || (page_id % 10) END AS a FROM pages), s AS (SELECT a AS arxiv_id, page_id FROM p WHERE a IS NOT NULL)
  SELECT coalesce(CASE WHEN page_id % 3 = 0 THEN NULL ELSE arxiv_id END, 'list-' || page_id) AS paper_id, 'flagged' || page_id AS cite_key, 'Ref ' || page_id AS raw FROM s WHERE page_id % 2 = 1 AND NOT (page_id % 3 <> 0 AND arxiv_id LIKE '%1')
  UNION ALL SELECT arxiv_id, 'k', NULL FROM (SELECT DISTINCT arxiv_id FROM s WHERE arxiv_id LIKE '%1')""")
def seed_rows(spark, sf_dir):
    """Preprints that pages link to as seeds, those that flag a reference as rows, and the papers already parsed."""
    n = F.col("page_id")
    link = F.concat(F.lit("21"), 10 + n % 80, F.lit(".0000"), n % 10)
    html = F.when(n % 4 != 0, F.concat(F.lit("<a href='https://arxiv.org/abs/"), link, F.lit("v2'>x</a> https://arxiv.org/pdf/"), link))
    found = seeds.listed_preprints(table(spark, sf_dir, "pages").select(F.lit("list").alias("source"), n.cast("string").alias("venue"), html.alias("html")))
    ord_ = F.col("venue").cast("long")
    flagged = found.withColumns({"ord": ord_, "arxiv_id": F.when(ord_ % 3 != 0, F.col("arxiv_id")), "hint": F.when(ord_ % 2 == 1, F.create_map(F.lit("flagged_reference"), F.concat(F.lit("Ref "), ord_))).otherwise(F.col("hint"))})
    parsed = found.filter(F.col("arxiv_id").endswith("1")).select(F.col("arxiv_id").alias("paper_id"), F.lit("k").alias("cite_key")).distinct()
    return seeds.combined(parsed, seeds.parsed_seeds(flagged)).select("paper_id", "cite_key", "raw")
