"""Evaluation queries over gold and pred views derived from documents and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refloom.operators import evaluate as ev
from refloom.operators import order, report
from refloom.operators.severity import derive_cell_severity, derive_severity, eligible, finalize_severity, hallucination_pred, inconclusive_reason
from refloom.plans.registry import query, table

_PAPER = "concat(coalesce({t}source, 'none'), '/', CAST({t}doc_id // 40 AS VARCHAR))"
_RID = """CASE WHEN {t}doc_id % 5 = 0 THEN concat('doi:10.1/ab', CAST({t}doc_id % 20 AS VARCHAR)) WHEN {t}doc_id % 5 = 1 THEN concat('arxiv_id:2101.0000', CAST({t}doc_id % 15 AS VARCHAR))
    WHEN {t}doc_id % 5 = 2 THEN concat('title:a great title ', CAST({t}doc_id % 12 AS VARCHAR)) ELSE concat('cite:', coalesce({t}lang, 'x'), '-', CAST({t}doc_id % 7 AS VARCHAR)) END"""
#: Gold rows: labels first, then own fields; what has no flag is a hallucination if it does not exist or has issues.
GOLD = f"""gold0 AS (
  SELECT d.doc_id, {_PAPER.format(t="d.")} AS paper_id, CAST(d.doc_id AS VARCHAR) AS claim_id, concat(coalesce(d.lang, 'x'), '-', CAST(d.doc_id % 7 AS VARCHAR)) AS cite_key, {_RID.format(t="d.")} AS rid, l.quality,
    coalesce(CASE d.doc_id % 4 WHEN 0 THEN 'supports' WHEN 1 THEN 'partial' WHEN 2 THEN 'does_not' ELSE CASE WHEN d.doc_id % 3 = 0 THEN 'skipped' END END, 'inconclusive') AS supports_gold,
    coalesce(CASE WHEN d.doc_id % 11 = 0 THEN 'unresolved' WHEN l.quality = 0 AND d.doc_id % 3 = 0 THEN 'no' WHEN d.doc_id % 17 <> 0 THEN 'yes' END, 'yes') AS exists_gold,
    coalesce(CASE WHEN d.doc_id % 6 <> 0 THEN CASE WHEN l.toxic = 1 THEN 'obligatory' ELSE 'helpful' END END, CASE WHEN d.doc_id % 9 = 0 THEN 'obligatory' END, 'helpful') AS priority_gold
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
gold AS (SELECT *, coalesce(CASE WHEN doc_id % 4 <> 3 THEN quality = 0 END, exists_gold = 'no' OR doc_id % 8 = 3) AS is_hallucinated FROM gold0)"""
PRED = f"""raw_pred AS (
  SELECT doc_id, n_chars, source, lang, text, doc_id AS ord FROM documents WHERE doc_id % 13 <> 5
  UNION ALL SELECT doc_id, n_chars + 1, source, lang, text, doc_id + 1000000000 FROM documents WHERE doc_id % 10 = 3 AND doc_id % 13 <> 5),
pred AS (
  SELECT {_PAPER.format(t="")} AS paper_id, CAST(doc_id AS VARCHAR) AS claim_id, concat(coalesce(lang, 'x'), '-', CAST(doc_id % 7 AS VARCHAR)) AS cite_key, doc_id, ord,
    CASE WHEN n_chars % 9 = 0 THEN 'unresolved' WHEN n_chars % 17 = 0 THEN 'no' ELSE 'yes' END AS exists_,
    CAST(n_chars % 5 = 0 AS INT) AS n_issues,
    CASE n_chars % 6 WHEN 2 THEN 'partial' WHEN 3 THEN 'does_not' WHEN 4 THEN 'inconclusive' WHEN 5 THEN 'skipped' ELSE 'supports' END AS supports,
    CASE WHEN contains(lower(coalesce(text, '')), 'based on') OR contains(lower(coalesce(text, '')), 'of the') THEN 'obligatory' ELSE 'helpful' END AS priority,
    CASE WHEN n_chars % 10 = 0 THEN NULL ELSE (n_chars % 100) / 100.0 END AS confidence
  FROM raw_pred),
last_pred AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, claim_id, cite_key ORDER BY ord DESC) AS k FROM pred) WHERE k = 1),
joined AS (
  SELECT g.*, p.ord IS NOT NULL AS matched, p.exists_, p.n_issues, p.supports, p.priority, CAST(p.confidence AS DOUBLE) AS confidence
  FROM gold g LEFT JOIN last_pred p ON g.paper_id = p.paper_id AND g.claim_id = p.claim_id AND g.cite_key = p.cite_key)"""
BASE = f"WITH {GOLD}, {PRED}"
PRF = """n, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1"""


def _paper() -> Column:
    return F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(F.col("doc_id") / 40).cast("string"))


def _identity() -> dict[str, Column]:
    """DOIs, preprints and titles, spelt in several ways, of some documents."""
    n = F.col("doc_id")
    return {
        "r_doi": F.when(n % 5 == 0, F.concat(F.when(n % 2 == 0, " 10.1/AB").otherwise("10.1/ab"), (n % 20).cast("string"))),
        "r_arxiv": F.when(n % 5 == 1, F.concat(F.lit("2101.0000"), (n % 15).cast("string"))).when(n % 5 == 2, ""),
        "r_title": F.when(n % 5 == 2, F.concat(F.when(n % 2 == 0, "A  Great Title ").otherwise("a great\ttitle "), (n % 12).cast("string"))),
    }


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels")
    n, none = F.col("doc_id"), F.array().cast("array<string>")
    supports = F.when(n % 4 == 0, "supports").when(n % 4 == 1, "partial").when(n % 4 == 2, "does_not").when(n % 3 == 0, "skipped")
    exists = F.when(n % 11 == 0, "unresolved").when((F.col("quality") == 0) & (n % 3 == 0), "no").when(n % 17 != 0, "yes")
    priority = F.when(n % 6 != 0, F.when(F.col("toxic") == 1, "obligatory").otherwise("helpful"))
    truth = F.struct(exists.alias("exists"), supports.alias("supports_claim"), priority.alias("priority"), F.when(n % 4 != 3, F.col("quality") == 0).alias("is_hallucinated"))
    rows = d.join(labels, "doc_id").select(
        _paper().alias("paper_id"), n.cast("string").alias("claim_id"), F.concat(F.coalesce("lang", F.lit("x")), F.lit("-"), (n % 7).cast("string")).alias("cite_key"), *[c.alias(k) for k, c in _identity().items()],
        truth.alias("labels"), F.lit("yes").alias("exists"), F.lit(None).cast("string").alias("supports"), F.when(n % 9 == 0, "obligatory").alias("priority"), F.when(n % 8 == 3, F.array(F.lit("year"))).otherwise(none).alias("issues"),
    )
    return ev.gold_axes(rows)


CUES = ("based on", "of the")


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("doc_id % 13 <> 5").withColumn("ord", F.col("doc_id"))
    d = d.unionByName(d.filter("doc_id % 10 = 3").withColumns({"n_chars": F.col("n_chars") + 1, "ord": F.col("ord") + 1000000000}))
    n, low = F.col("n_chars"), F.lower(F.coalesce("text", F.lit("")))
    cue = F.contains(low, F.lit(CUES[0])) | F.contains(low, F.lit(CUES[1]))
    return d.select(
        _paper().alias("paper_id"), F.col("doc_id").cast("string").alias("claim_id"), F.concat(F.coalesce("lang", F.lit("x")), F.lit("-"), (F.col("doc_id") % 7).cast("string")).alias("cite_key"), "doc_id", "ord", *[c.alias(k) for k, c in _identity().items()],
        F.when(n % 9 == 0, "unresolved").when(n % 17 == 0, "no").otherwise("yes").alias("exists"),
        F.when(n % 5 == 0, F.array(F.lit("year differs"))).otherwise(F.array().cast("array<string>")).alias("issues"),
        F.when(n % 6 == 2, "partial").when(n % 6 == 3, "does_not").when(n % 6 == 4, "inconclusive").when(n % 6 == 5, "skipped").otherwise("supports").alias("supports"),
        F.when(cue, "obligatory").otherwise("helpful").alias("priority"), F.when(n % 10 != 0, (n % 100) / 100.0).alias("confidence"),
    )


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.join_gold(gold(spark, sf_dir), pred(spark, sf_dir).drop("doc_id"))


SEVERITY = """CASE WHEN {e} = 'no' THEN 'high' WHEN {p} = 'obligatory' AND {s} = 'does_not' THEN 'high' WHEN {p} = 'obligatory' AND {s} = 'partial' THEN 'medium'
  WHEN {s} = 'does_not' THEN 'low' WHEN {e} = 'unresolved' OR {s} = 'inconclusive' THEN 'low' WHEN {s} = 'partial' THEN 'low' ELSE 'ok' END"""
_AXES = """SELECT CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE 'unresolved' END AS e,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'supports' WHEN 1 THEN 'partial' WHEN 2 THEN 'does_not' WHEN 3 THEN 'inconclusive' ELSE 'skipped' END AS s,
  CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'obligatory' ELSE 'helpful' END AS p FROM orders"""


@query(f"SELECT severity, count(*) AS n FROM (SELECT {SEVERITY.format(e='e', s='s', p='p')} AS severity FROM ({_AXES})) GROUP BY severity")
def severity_distribution(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    axes = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").otherwise("unresolved").alias("e"),
        F.when(k == 0, "supports").when(k == 1, "partial").when(k == 2, "does_not").when(k == 3, "inconclusive").otherwise("skipped").alias("s"),
        F.when(F.col("o_orderpriority").rlike("^[12]"), "obligatory").otherwise("helpful").alias("p"),
    )
    return axes.groupBy(derive_severity(F.col("e"), F.col("s"), F.col("p")).alias("severity")).agg(F.count("*").alias("n"))


CELL = """SELECT CASE l_returnflag WHEN 'R' THEN 'no' WHEN 'A' THEN 'yes' ELSE 'partial' END AS mark,
  CASE CAST(l_orderkey % 6 AS INT) WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'may_not_support' WHEN 3 THEN 'undefined' WHEN 4 THEN 'unverifiable' ELSE 'skipped' END AS verdict,
  l_linestatus = 'O' AS is_self FROM lineitem"""


@query(f"""SELECT severity, count(*) AS n FROM (SELECT CASE WHEN verdict = 'contradicted' AND ((mark = 'no' AND NOT is_self) OR (mark = 'yes' AND is_self)) THEN 'high' WHEN verdict = 'contradicted' THEN 'medium'
  WHEN verdict = 'may_not_support' THEN CASE WHEN is_self THEN 'low' ELSE 'medium' END WHEN verdict = 'undefined' THEN 'medium' WHEN verdict = 'unverifiable' THEN 'low' ELSE 'ok' END AS severity FROM ({CELL})) GROUP BY severity""")
def cell_severity(spark, sf_dir):
    k = F.col("l_orderkey") % 6
    cells = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "no").when(F.col("l_returnflag") == "A", "yes").otherwise("partial").alias("mark"),
        F.when(k == 0, "supported").when(k == 1, "contradicted").when(k == 2, "may_not_support").when(k == 3, "undefined").when(k == 4, "unverifiable").otherwise("skipped").alias("verdict"),
        (F.col("l_linestatus") == "O").alias("is_self"),
    )
    return cells.groupBy(derive_cell_severity(F.col("mark"), F.col("verdict"), F.col("is_self")).alias("severity")).agg(F.count("*").alias("n"))


@query(f"""{BASE}, f AS (SELECT claim_id, ord, doc_id % 5 = 0 AS in_table, CASE WHEN doc_id % 8 = 0 THEN 'medium' ELSE 'ok' END AS s0, CASE WHEN doc_id % 2 = 0 THEN 'judge' ELSE 'bulk' END AS tier, exists_, supports, priority FROM pred),
  g AS (SELECT *, CASE WHEN in_table THEN 'skipped' ELSE supports END AS s FROM f)
  SELECT claim_id, ord, s AS supports, CASE WHEN s0 <> 'ok' AND tier = 'judge' THEN s0 ELSE {SEVERITY.format(e='exists_', s='s', p='priority')} END AS severity FROM g""")
def finalized_severity(spark, sf_dir):
    n = F.col("doc_id")
    supports, severity = finalize_severity(F.col("exists"), F.col("supports"), F.col("priority"), F.when(n % 8 == 0, "medium").otherwise("ok"), F.when(n % 2 == 0, "judge").otherwise("bulk"), n % 5 == 0)
    return pred(spark, sf_dir).select("claim_id", "ord", supports.alias("supports"), severity.alias("severity"))


@query(f"{BASE} SELECT paper_id, claim_id, cite_key, matched, exists_ AS exists, supports, priority, confidence FROM joined")
def pred_gold_join(spark, sf_dir):
    return joined(spark, sf_dir).select("paper_id", "claim_id", "cite_key", "matched", "exists", "supports", "priority", "confidence")


@query(f"""{BASE}, w AS (SELECT bool_or(is_hallucinated) AS g, bool_or(coalesce(exists_ = 'no' OR n_issues > 0, false)) AS p FROM joined GROUP BY paper_id, rid),
  c AS (SELECT count_if(g AND p) AS tp, count_if(NOT g AND p) AS fp, count_if(g AND NOT p) AS fn, count(*) AS n FROM w) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {PRF} FROM c""")
def correctness_prf(spark, sf_dir):
    return ev.correctness(joined(spark, sf_dir))


MACRO = """m AS (SELECT avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END) AS macro_f1 FROM (
  SELECT label, count_if(supports_gold = label AND coalesce(supports, 'inconclusive') = label) AS tp, count_if(supports_gold <> label AND coalesce(supports, 'inconclusive') = label) AS fp,
    count_if(supports_gold = label AND coalesce(supports, 'inconclusive') <> label) AS fn
  FROM (VALUES ('supports'), ('partial'), ('does_not'), ('inconclusive')) v(label) LEFT JOIN joined ON supports_gold <> 'skipped' GROUP BY label))"""


@query(f"{BASE}, {MACRO} SELECT macro_f1 FROM m")
def supports_macro_f1(spark, sf_dir):
    return ev.support_macro_f1(joined(spark, sf_dir))


@query(f"{BASE} SELECT avg(CAST(coalesce(supports, 'inconclusive') = supports_gold AS DOUBLE)) AS accuracy, count(*) AS n FROM joined")
def relevance_accuracy(spark, sf_dir):
    return ev.relevance_accuracy(joined(spark, sf_dir))


_PRIORITY = "SELECT count_if(g AND p) AS tp, count_if(NOT g AND p) AS fp, count_if(g AND NOT p) AS fn, count(*) AS n, avg(CAST(g = p AS DOUBLE)) AS accuracy FROM (SELECT priority_gold = 'obligatory' AS g, coalesce(priority, 'helpful') = 'obligatory' AS p FROM joined)"


@query(f"{BASE}, c AS ({_PRIORITY}) SELECT accuracy, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {PRF} FROM c")
def priority_metrics(spark, sf_dir):
    return ev.priority_metrics(joined(spark, sf_dir))


_ABSTAIN = """a AS (SELECT *, coalesce(NOT matched OR exists_ = 'unresolved' OR supports = 'inconclusive', false) AS p, exists_gold = 'unresolved' OR supports_gold = 'inconclusive' AS g,
  CAST(exists_ = exists_gold AND supports = supports_gold AS DOUBLE) AS good FROM joined),
c AS (SELECT count_if(g AND p) AS tp, count_if(NOT g AND p) AS fp, count_if(g AND NOT p) AS fn, count(*) AS n, avg(CAST(p AS DOUBLE)) AS rate,
  avg(confidence) FILTER (WHERE NOT p AND confidence IS NOT NULL) AS mean_confidence, avg(good) FILTER (WHERE NOT p AND confidence IS NOT NULL) AS committed_accuracy FROM a)"""


@query(f"{BASE}, {_ABSTAIN} SELECT rate, mean_confidence, committed_accuracy, mean_confidence - committed_accuracy AS calibration_gap, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {PRF} FROM c")
def abstention_calibration(spark, sf_dir):
    return ev.abstention(joined(spark, sf_dir))


@query(f"""{BASE}, w AS (SELECT bool_or(is_hallucinated) AS g, bool_or(coalesce(exists_ = 'no' OR n_issues > 0, false)) AS p FROM joined GROUP BY paper_id, rid),
  {MACRO}, h AS (SELECT 2 * count_if(g AND p) / (2 * count_if(g AND p) + count_if(g <> p)) AS headline_f1, count(*) AS n_works FROM w),
  q AS ({_PRIORITY})
  SELECT headline_f1, n_works, macro_f1, (SELECT avg(CAST(coalesce(supports, 'inconclusive') = supports_gold AS DOUBLE)) FROM joined) AS relevance_accuracy,
    (SELECT CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END FROM q) AS priority_f1,
    (SELECT avg(CAST(coalesce(NOT matched OR exists_ = 'unresolved' OR supports = 'inconclusive', false) AS DOUBLE)) FROM joined) AS abstention_rate,
    (SELECT count(*) FROM joined WHERE matched) AS n_matched, (SELECT count(*) FROM joined WHERE NOT matched) AS n_unmatched FROM h, m""")
def eval_headline(spark, sf_dir):
    return ev.headline(joined(spark, sf_dir))


@query(f"""{BASE}, w AS (SELECT paper_id, cite_key, arg_min(exists_, ord) AS e, bool_or(n_issues > 0) AS m FROM pred GROUP BY 1, 2),
  a AS (SELECT paper_id, count(*) AS n_refs, count_if(e = 'yes') AS exists_yes, count_if(e = 'no') AS exists_no, count_if(e = 'unresolved') AS exists_unresolved, count_if(m) AS with_issues FROM w GROUP BY 1),
  b AS (SELECT paper_id, count(*) AS n_pairs, count_if(supports = 'supports') AS n_supports, count_if(supports = 'partial') AS n_partial, count_if(supports = 'does_not') AS n_does_not, count_if(supports = 'inconclusive') AS n_inconclusive, count_if(supports = 'skipped') AS n_skipped FROM pred GROUP BY 1)
  SELECT a.paper_id, n_refs, CAST(exists_yes AS BIGINT) AS exists_yes, CAST(exists_no AS BIGINT) AS exists_no, CAST(exists_unresolved AS BIGINT) AS exists_unresolved, CAST(with_issues AS BIGINT) AS with_issues, n_pairs, CAST(n_supports AS BIGINT) AS n_supports,
    CAST(n_partial AS BIGINT) AS n_partial, CAST(n_does_not AS BIGINT) AS n_does_not, CAST(n_inconclusive AS BIGINT) AS n_inconclusive, CAST(n_skipped AS BIGINT) AS n_skipped FROM a JOIN b ON a.paper_id = b.paper_id""")
def report_summary(spark, sf_dir):
    return ev.report_summary(pred(spark, sf_dir))


@query(f"{BASE} SELECT paper_id, supports, count(*) AS n FROM pred GROUP BY ROLLUP (paper_id, supports)")
def report_rollup(spark, sf_dir):
    return pred(spark, sf_dir).rollup("paper_id", "supports").agg(F.count("*").alias("n"))


@query(f"""{BASE} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN exists_ <> 'yes' THEN 'unresolved' WHEN doc_id % 3 = 0 THEN 'fulltext' ELSE 'abstract' END AS reason FROM pred WHERE supports = 'inconclusive') GROUP BY reason""")
def inconclusive_reasons(spark, sf_dir):
    notes = F.when(F.col("doc_id") % 3 == 0, "(based on full text) not there").when(F.col("doc_id") % 3 == 1, "judged on Full Text").otherwise(F.lit(None))
    return pred(spark, sf_dir).filter("supports = 'inconclusive'").groupBy(inconclusive_reason(F.col("exists"), notes).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""{BASE} SELECT paper_id, count(*) AS n FROM pred WHERE exists_ = 'yes' AND doc_id % 5 <> 0 GROUP BY 1""")
def eligible_citations(spark, sf_dir):
    """Citations that go to the judge, per paper."""
    rows = pred(spark, sf_dir).filter(eligible(F.col("exists"), F.when(F.col("doc_id") % 5 == 0, True).when(F.col("doc_id") % 5 == 1, False)))
    return rows.groupBy("paper_id").agg(F.count("*").alias("n"))


@query(f"""{BASE} SELECT claim_id, exists_gold, supports_gold, priority_gold, is_hallucinated, rid FROM gold""")
def gold_truth(spark, sf_dir):
    """Gold axes, flags and identities of works, labels first."""
    return gold(spark, sf_dir).select("claim_id", "exists_gold", "supports_gold", "priority_gold", "is_hallucinated", ev.unit("", "").alias("rid"))


@query(f"""{BASE} SELECT claim_id, ord, positive FROM (SELECT claim_id, ord, exists_ = 'no' OR n_issues > 0 AS positive FROM pred) ORDER BY positive DESC, ord LIMIT 18""")
def smoke_split(spark, sf_dir):
    rows = pred(spark, sf_dir).select("claim_id", "ord", ((F.col("exists") == "no") | (F.size("issues") > 0)).alias("positive"))
    return order.smoke(rows, F.col("positive"), [F.col("ord")])


_FLAG = f"CASE WHEN exists_ = 'no' THEN 0 WHEN {SEVERITY.format(e='exists_', s='supports', p='priority')} = 'high' THEN 1 WHEN supports = 'does_not' THEN 2 WHEN exists_ = 'unresolved' THEN 3 ELSE 99 END"
_FLAGGED = f"""b AS (SELECT paper_id, claim_id, cite_key, ord, {_FLAG} AS bucket FROM pred),
  f AS (SELECT paper_id, claim_id, cite_key, bucket, ord FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, claim_id, cite_key ORDER BY bucket, ord) AS k FROM b WHERE bucket < 99) WHERE k = 1),
  p AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY bucket, ord) AS place, count(*) OVER (PARTITION BY paper_id) AS total FROM f)"""


def _judged(spark, sf_dir) -> DataFrame:
    return pred(spark, sf_dir).withColumn("severity", derive_severity(F.col("exists"), F.col("supports"), F.col("priority")))


@query(f"{BASE}, {_FLAGGED} SELECT paper_id, claim_id, cite_key, bucket, ord, place FROM p")
def flagged_records(spark, sf_dir):
    return report.flagged(_judged(spark, sf_dir))


@query(f"{BASE}, {_FLAGGED} SELECT paper_id, claim_id, place, greatest(total - 6, 0) AS more FROM p WHERE place <= 6")
def flagged_display(spark, sf_dir):
    """The six worst records of each paper, and how many more there are."""
    return report.display_cap(report.flagged(_judged(spark, sf_dir)), ["paper_id"]).select("paper_id", "claim_id", "place", "more")


@query(f"""{BASE}, q AS (SELECT paper_id, CASE WHEN doc_id % 40 = 0 THEN ['Backend X unavailable'] WHEN doc_id % 40 = 1 THEN ['limited to first 3 of 9 citation pairs'] END AS e FROM pred)
  SELECT paper_id, bool_or(e IS NOT NULL AND contains(lower(e[1]), 'unavailable')) AS outage FROM q GROUP BY 1 UNION ALL SELECT 'down', true UNION ALL SELECT 'tiny', false""")
def outage_runs(spark, sf_dir):
    """Which runs degraded as a whole: by their only record, or by what their errors say."""
    n = F.col("doc_id") % 40
    errors = F.when(n == 0, F.array(F.lit("Backend X unavailable"))).when(n == 1, F.array(F.lit("limited to first 3 of 9 citation pairs")))
    rows = pred(spark, sf_dir).select("paper_id", "claim_id", "cite_key", "exists", errors.alias("errors"))
    more = spark.createDataFrame([("down", "run", "run", "unresolved", None), ("tiny", "1", "run", "unresolved", None)], "paper_id string, claim_id string, cite_key string, exists string, errors array<string>")
    return report.outages(rows.unionByName(more))


@query(f"""{BASE}, v AS (SELECT 'no fabricated reference' AS rule, count_if(exists_ = 'no') < 3 AS broken FROM pred UNION ALL SELECT 'no wrong metadata', count_if(n_issues > 0) < 3 FROM pred
  UNION ALL SELECT 'confidence outside [0, 1]', count_if(confidence < 0 OR confidence > 1) > 0 FROM pred UNION ALL SELECT 'duplicate key', count(*) > 0 FROM (SELECT 1 FROM pred GROUP BY paper_id, claim_id, cite_key HAVING count(*) > 1))
  SELECT rule FROM v WHERE broken""")
def dataset_violations(spark, sf_dir):
    p = pred(spark, sf_dir)

    def rule(name, rows, broken):
        return rows.agg(broken.alias("broken")).filter("broken").select(F.lit(name).alias("rule"))

    out = rule("no fabricated reference", p, F.count_if(F.col("exists") == "no") < 3)
    out = out.unionByName(rule("no wrong metadata", p, F.count_if(F.size("issues") > 0) < 3))
    out = out.unionByName(rule("confidence outside [0, 1]", p, F.count_if(~F.col("confidence").between(0, 1)) > 0))
    return out.unionByName(rule("duplicate key", p.groupBy(*ev.KEY).count().filter("count > 1"), F.count("*") > 0))
