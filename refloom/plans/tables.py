"""Comparison tables, usage, JSON and linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions.names import surnames
from refloom.functions.tex import strip_cell
from refloom.operators import gold, grid, linkage, usage
from refloom.plans.registry import query, table

#: (raw cell, its mark, its text): signs and macros of both kinds, words, dashes, abstentions, numbers.
_SAMPLES = (
    ("✗", "no", "✗"), (r"\xmark", "no", ""), (r"\ding{55}", "no", "55"), ("No", "no", "no"), ("—", "no", "—"), (r"$\times$", "no", ""),
    ("✓", "yes", "✓"), (r"\cmark~\cite{a}", "yes", ""), (r"$\checkmark$", "yes", ""), (r"\ding{51}", "yes", "51"), (r"\textbf{Yes}", "yes", "yes"), ("Supported", "yes", "supported"),
    ("Partial", "partial", "partial"), ("▲", "partial", "▲"), (r"\halfcirc", "partial", ""), ("limited % not really", "partial", "limited"),
    ("n/a", "empty", "n/a"), ("", "empty", ""), ("?", "empty", "?"), ("n.a.", "empty", "n.a"), ("% gone", "empty", ""),
    (r"84.21\%", "value", "84.21%"), ("3.2M", "value", "3.2m"), (r"\emph{No-Reference}", "value", "no-reference"), ("limited-memory BFGS", "value", "limited-memory bfgs"), ("a rather long remark on the method", "value", "a rather long remark on the method"),
)
_SAMPLE_SQL = "(VALUES " + ", ".join(f"({i}, '{r}', '{m}', '{t}')" for i, (r, m, t) in enumerate(_SAMPLES)) + ") x(i, raw, mark, txt)"
#: Which sample a cell shows: each column of a table draws from its own kind of samples.
_PICK = f"CASE l_linenumber WHEN 1 THEN CAST(l_orderkey % 12 AS INT) WHEN 2 THEN CAST(6 + l_orderkey % 10 AS INT) WHEN 3 THEN CAST(16 + l_orderkey % 5 AS INT) WHEN 4 THEN CAST(21 + l_orderkey % 2 AS INT) WHEN 5 THEN CAST(20 + l_orderkey % 6 AS INT) ELSE CAST(l_orderkey % {len(_SAMPLES)} AS INT) END"
_CELLS = f"SELECT l_suppkey AS table_id, l_linenumber AS col_index, l_orderkey, l_linestatus, raw, mark, txt FROM (SELECT *, {_PICK} AS pick FROM lineitem) JOIN {_SAMPLE_SQL} ON pick = i"


def cells(spark, sf_dir):
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    pick = F.when(n == 1, k % 12).when(n == 2, 6 + k % 10).when(n == 3, 16 + k % 5).when(n == 4, 21 + k % 2).when(n == 5, 20 + k % 6).otherwise(k % len(_SAMPLES))
    raw = F.get(F.array(*[F.lit(r) for r, _, _ in _SAMPLES]), pick.cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("table_id"), n.alias("col_index"), "l_orderkey", "l_linestatus", raw.alias("raw"))
    return rows.withColumn("mark", grid.normalize_mark(F.col("raw")))


@query(f"SELECT raw, mark, count(*) AS n FROM ({_CELLS}) GROUP BY 1, 2")
def mark_classifier(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("raw", "mark").agg(F.count("*").alias("n"))


@query(f"SELECT raw, txt AS text, count(*) AS n FROM ({_CELLS}) GROUP BY 1, 2")
def cell_text(spark, sf_dir):
    """Text of TeX cells, in lower case."""
    return cells(spark, sf_dir).groupBy("raw", F.lower(strip_cell(F.col("raw"))).alias("text")).agg(F.count("*").alias("n"))


_PDF_SAMPLES = (("\x13", "yes"), ("\x17 x", "no"), ("✔", "yes"), ("√", "yes"), ("×", "no"), ("◑", "partial"), ("High", "value"), ("some", "value"), ("FALSE", "no"), ("--", "no"), ("n.a", "empty"), ("", "empty"), ("Full", "yes"))
_PDF_SQL = "(VALUES " + ", ".join(f"({i}, '{m}')" for i, (_, m) in enumerate(_PDF_SAMPLES)) + ") x(i, mark)"


@query(f"SELECT p_partkey, mark FROM part JOIN {_PDF_SQL} ON p_partkey % {len(_PDF_SAMPLES)} = i")
def pdf_mark_classifier(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(r) for r, _ in _PDF_SAMPLES]), (F.col("p_partkey") % len(_PDF_SAMPLES)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", grid.normalize_pdf_mark(raw).alias("mark"))


#: (cell, legend, mark): a paper's own legend goes before all else, unless its wording abstains.
_LEGENDS = (
    ("▲", {"▲": "strong support"}, "yes"), (r"\tmark", {r"\tmark": "medium"}, "partial"), (r"\tmarker", {r"\tmark": "weak"}, "empty"), ("-", {"-": "not applicable"}, "no"), ("H", {"H": "has it", "L": "lacks it"}, "yes"),
    ("L", {"H": "has it", "L": "lacks it"}, "no"), ("✓", {"✗": "no"}, "yes"), ("x", {}, "value"),
)


@query(f"SELECT p_partkey, mark FROM part JOIN (VALUES {', '.join(f'({i}, {chr(39)}{m}{chr(39)})' for i, (_, _, m) in enumerate(_LEGENDS))}) x(i, mark) ON p_partkey % {len(_LEGENDS)} = i")
def legend_marks(spark, sf_dir):
    """Marks by the paper's own legend."""
    pick = (F.col("p_partkey") % len(_LEGENDS)).cast("int")
    raw = F.get(F.array(*[F.lit(r) for r, _, _ in _LEGENDS]), pick)
    legend = F.get(F.array(*[F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>") for _, d, _ in _LEGENDS]), pick)
    return table(spark, sf_dir, "part").select("p_partkey", grid.normalize_mark(raw, legend).alias("mark"))


_KINDS = f"""k AS (SELECT table_id, col_index, count_if(mark <> 'empty') AS n, count_if(mark IN ('yes', 'no', 'partial')) AS marks, count_if(txt <> '') AS texts, count_if(txt IN ('84.21%', '3.2m', '51', '55')) AS numbers,
  count_if(txt <> '' AND length(txt) <= 25) AS shorts, count(DISTINCT CASE WHEN txt <> '' AND length(txt) <= 25 THEN txt END) AS different FROM ({_CELLS}) GROUP BY 1, 2),
kinds AS (SELECT *, CASE WHEN n < 2 THEN 'empty' WHEN marks >= 0.6 * n THEN 'mark' WHEN texts > 0 AND numbers >= 0.6 * texts THEN 'numeric' WHEN shorts > 0 AND different <= greatest(2, floor(0.6 * n)) AND marks + shorts >= 0.6 * n THEN 'categorical' ELSE 'text' END AS kind FROM k)"""


@query(f"WITH {_KINDS} SELECT table_id, col_index, kind FROM kinds")
def column_kind(spark, sf_dir):
    return grid.column_kinds(cells(spark, sf_dir), ["table_id", "col_index"]).select("table_id", "col_index", "kind")


@query(f"""WITH {_KINDS}, t AS (SELECT table_id, count_if(kind = 'mark') AS m, count_if(kind = 'categorical') AS c, count_if(kind = 'numeric') AS u, sum(marks) AS filled, count(*) AS width FROM kinds GROUP BY 1), b AS (SELECT l_suppkey AS table_id, count(DISTINCT l_orderkey) AS body FROM lineitem GROUP BY 1)
  SELECT t.table_id, ((m >= 2 AND filled >= 0.35 * body * width) OR (c >= 2 AND u <= 1)) AND body >= 2 AS comparison FROM t JOIN b ON t.table_id = b.table_id""")
def comparison_table(spark, sf_dir):
    return grid.comparison_tables(cells(spark, sf_dir), ["table_id"], "l_orderkey", "col_index").select("table_id", "comparison")


@query(f"""SELECT table_id, col_index, CASE WHEN count_if(mark = 'value') > 0 THEN CASE WHEN count_if(txt IN ('84.21%', '3.2m', '51', '55')) >= 2 THEN 'numeric' ELSE 'categorical' END WHEN count_if(mark = 'partial') > 0 THEN 'graded' ELSE 'binary' END AS kind FROM ({_CELLS}) GROUP BY 1, 2""")
def dimension_kind(spark, sf_dir):
    return grid.dimension_kinds(cells(spark, sf_dir), ["table_id", "col_index"])


_ANSWER = "CASE CAST(l_orderkey % 5 AS INT) WHEN 0 THEN 'has' WHEN 1 THEN 'lacks' WHEN 2 THEN 'absent' WHEN 3 THEN 'unclear' ELSE 'wrong_paper' END"
_VERDICT = """CASE WHEN mark IN ('yes', 'partial') AND answer = 'has' THEN 'supported' WHEN mark IN ('yes', 'partial') AND answer = 'lacks' THEN 'contradicted' WHEN mark IN ('yes', 'partial') AND answer = 'absent' THEN 'may_not_support'
  WHEN mark = 'no' AND answer = 'has' THEN 'contradicted' WHEN mark = 'no' AND answer IN ('lacks', 'absent') THEN 'supported' ELSE 'unverifiable' END"""


def judged(spark, sf_dir):
    n = F.col("l_orderkey") % 5
    answer = F.when(n == 0, "has").when(n == 1, "lacks").when(n == 2, "absent").when(n == 3, "unclear").otherwise("wrong_paper")
    return cells(spark, sf_dir).withColumn("answer", answer).withColumn("verdict", grid.decide(F.col("mark"), F.col("answer")))


@query(f"SELECT mark, answer, {_VERDICT} AS verdict, count(*) AS n FROM (SELECT *, {_ANSWER} AS answer FROM ({_CELLS})) GROUP BY ALL")
def verdict_decision(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("mark", "answer", "verdict").agg(F.count("*").alias("n"))


_SKIP = "CASE WHEN l_linestatus = 'O' AND l_orderkey % 7 = 0 THEN 'self row' WHEN l_orderkey % 3 = 0 THEN 'no citation' WHEN mark NOT IN ('yes', 'no', 'partial') THEN 'not a mark' WHEN col_index = 1 THEN 'undefined' WHEN col_index = 2 THEN 'descriptive' ELSE 'judged' END"


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_SKIP} AS reason FROM ({_CELLS})) GROUP BY 1")
def skip_ladder(spark, sf_dir):
    c = F.col("col_index")
    reason = grid.skip_reason((F.col("l_linestatus") == "O") & (F.col("l_orderkey") % 7 == 0), F.col("l_orderkey") % 3, F.col("mark"), F.when(c == 1, "header_only").otherwise("body"), F.when(c == 2, "text").otherwise("binary"))
    return cells(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("judged")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH f AS (SELECT *, CAST(col_index AS VARCHAR) AS header, l_orderkey % 7 = 0 AS is_self, CASE WHEN v = 'contradicted' AND col_index = 1 THEN 'undefined' ELSE v END AS verdict FROM (SELECT *, {_VERDICT} AS v FROM (SELECT *, {_ANSWER} AS answer FROM ({_CELLS}))))
  SELECT table_id, coalesce(bool_and(mark = 'yes') FILTER (WHERE is_self), false) AS self_all_yes, CAST(count_if(NOT is_self AND verdict = 'contradicted') AS BIGINT) AS contradicted, CAST(count_if(NOT is_self AND verdict = 'may_not_support') AS BIGINT) AS unbacked,
    CAST(count_if(NOT is_self AND verdict = 'contradicted' AND mark = 'no') AS BIGINT) AS understated, coalesce(string_agg(DISTINCT header, ',' ORDER BY header) FILTER (WHERE verdict = 'undefined'), '') AS undefined_headers FROM f GROUP BY 1""")
def asymmetry(spark, sf_dir):
    gloss = F.when(F.col("col_index") == 1, "header_only").otherwise("body")
    findings = judged(spark, sf_dir).withColumns({"is_self": F.col("l_orderkey") % 7 == 0, "header": F.col("col_index").cast("string"), "verdict": grid.downgrade(F.col("verdict"), F.col("mark"), F.lit("binary"), gloss)})
    return grid.asymmetry(findings)


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def grid_pivot(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return wide.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("""SELECT conv_id, CAST(sum(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, CAST(round_even(length(text) / 4.0, 0) AS INT)) END) AS BIGINT) AS tokens FROM conversations GROUP BY 1""")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(usage.estimate_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))


#: Prices per million tokens of invented model families; the longest key that a name contains counts.
PRICES = (("view", 1.0, 5.0), ("vi", 9.0, 9.0), ("click", 3.0, 15.0), ("error", 0.25, 1.25))
_VALUES = ", ".join(f"('{k}', {a}, {b})" for k, a, b in PRICES)


def _ledger(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.concat(F.lit("M-"), F.upper("event_type")).alias("model"), (F.floor("value") * 100).cast("long").alias("n_in"), (F.col("event_id") % 500).alias("n_out"))
    rows = usage.priced(e, spark.createDataFrame(list(PRICES), "key string, p_in double, p_out double"))
    return rows.withColumn("cost", usage.cost(F.col("n_in"), F.col("n_out"), F.col("p_in"), F.col("p_out")))


_LEDGER = f"""e AS (SELECT event_id, user_id, ts, 'M-' || upper(event_type) AS model, CAST(floor(value) AS BIGINT) * 100 AS n_in, event_id % 500 AS n_out FROM events),
  p AS (SELECT * FROM (VALUES {_VALUES}) v(key, p_in, p_out)), b AS (SELECT model, arg_max(CAST(p_in AS DOUBLE), length(key)) AS p_in, arg_max(CAST(p_out AS DOUBLE), length(key)) AS p_out FROM (SELECT DISTINCT model FROM e) JOIN p ON contains(lower(model), key) GROUP BY 1),
  g AS (SELECT e.*, coalesce(p_in, 3.0) AS p_in, coalesce(p_out, 15.0) AS p_out FROM e LEFT JOIN b ON e.model = b.model), l AS (SELECT *, round((n_in * p_in + n_out * p_out) / 1e6, 6) AS cost FROM g)"""


@query(f"WITH {_LEDGER} SELECT model, count(*) AS n, CAST(sum(n_in) AS BIGINT) AS n_in, CAST(sum(n_out) AS BIGINT) AS n_out, round(sum(cost), 4) AS cost FROM l GROUP BY 1")
def usage_by_model(spark, sf_dir):
    return _ledger(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"), F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.round(F.sum("cost"), 4).alias("cost"))


@query(f"WITH {_LEDGER} SELECT event_id FROM (SELECT event_id, sum(n_in) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM l) WHERE spent <= 50000")
def cost_ceiling(spark, sf_dir):
    return usage.under_ceiling(_ledger(spark, sf_dir), ["user_id"], ["ts", "event_id"], "n_in", 50000).select("event_id")


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def event_props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 8 = 0 THEN 'Q. Fabricated' ELSE 'Q. Fabricated,B' END ELSE CASE WHEN p_partkey % 8 = 0 THEN '' ELSE p_brand || ',B' END END AS authors,
  CASE WHEN p_partkey % 4 = 1 THEN (CASE WHEN p_size = 1 THEN 2020 ELSE p_size END) + ([-3, -2, 2, 3])[p_size % 4 + 1] ELSE CASE WHEN p_size = 1 THEN 0 ELSE p_size END END AS year, CASE WHEN p_partkey % 4 = 2 THEN 'Journal of Imaginary Results' ELSE p_type END AS venue,
  CASE WHEN p_partkey % 4 = 3 THEN p_name || ' (revised edition)' ELSE p_name END AS title, (['author', 'year', 'venue', 'title'])[p_partkey % 4 + 1] AS field,
  CASE p_partkey % 4 WHEN 0 THEN 'authors: first author replaced (synthetic perturbation)' WHEN 1 THEN 'year: shifted to ' || ((CASE WHEN p_size = 1 THEN 2020 ELSE p_size END) + ([-3, -2, 2, 3])[p_size % 4 + 1]) || ' (synthetic perturbation)'
    WHEN 2 THEN 'venue: replaced with a wrong venue (synthetic perturbation)' ELSE 'title: altered from canonical (synthetic perturbation)' END AS issue FROM part""")
def inject_perturb(spark, sf_dir):
    """One planted error per record: author, year, venue or title by turns."""
    n = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        n, F.when(n % 8 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", F.lit("B"))).alias("authors"), F.when(F.col("p_size") == 1, 0).otherwise(F.col("p_size")).cast("int").alias("year"), F.col("p_type").alias("venue"), F.col("p_name").alias("title"),
        F.get(F.array(*map(F.lit, ("author", "year", "venue", "title"))), (n % 4).cast("int")).alias("field"), F.get(F.array(*map(F.lit, (-3, -2, 2, 3))), (F.col("p_size") % 4).cast("int")).alias("shift"),
    )
    return gold.perturb(p).select("p_partkey", F.array_join("authors", ",").alias("authors"), "year", "venue", "title", "field", "issue")


@query("""SELECT p_partkey AS ref_id, p_partkey AS cand_id, CASE WHEN p_partkey % 5 = 0 THEN 'doi' ELSE 'fuzzy_title' END AS method, CAST(1.0 AS DOUBLE) AS score FROM part""")
def match_cascade(spark, sf_dir):
    """Part names as references, edited part names as candidates: by DOI, else by title, each to its own."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    people = F.array(F.col("p_brand"))
    refs = p.select(n.alias("ref_id"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" "), n.cast("string")).alias("title"), surnames(people).alias("surnames"), F.col("p_size").alias("year"), F.when(n % 5 == 0, F.concat(F.lit("10.1/"), n)).otherwise("").alias("doi"), F.lit("").alias("arxiv"))
    cands = p.select(
        n.alias("cand_id"), F.when(n % 3 == 0, F.upper(F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" "), n.cast("string")))).otherwise(F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" "), n.cast("string"), F.lit("."))).alias("title"),
        surnames(people).alias("surnames"), (F.col("p_size") + n % 4).cast("int").alias("year"), F.when(n % 5 == 0, F.concat(F.lit("10.1/"), n)).otherwise("").alias("doi"), F.lit("").alias("arxiv"),
    )
    return linkage.match(refs, cands)
