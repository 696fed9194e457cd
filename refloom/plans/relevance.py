"""The relevance stage: requests, answers, escalation and settled records."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.operators import evidence, relevance
from refloom.plans.evaluation import BASE, pred
from refloom.plans.registry import query, table

#: (verdict as answered, justification, what it counts as).
_SAID = (
    ("Does Not", "", "does_not"), ("supports", "", "supports"), ("SUPPORTS", "the text contradicts it", "does_not"), ("partial", "Inconsistent with it", "does_not"), ("n/a", "", "inconclusive"), ("maybe", "", "inconclusive"),
    ("inconclusive", "refuted", "inconclusive"), ("does-not", "fine", "does_not"), ("unverified", "", "inconclusive"), ("Partial", " does not mention it ", "partial"),
)
_SAID_SQL = "(VALUES " + ", ".join(f"({i}, '{w.strip()}', '{v}')" for i, (_, w, v) in enumerate(_SAID)) + ") x(i, why, verdict)"


def _answers(spark, sf_dir):
    n = F.col("turn") + F.col("conv_id")
    pick = lambda k: F.get(F.array(*[F.lit(x[k]) for x in _SAID]), F.pmod(n, F.lit(len(_SAID))).cast("int"))
    confidence = F.when(F.col("turn") % 3 == 0, F.col("turn") / 8)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pick(0).alias("supports_claim"), pick(1).alias("justification"), confidence.alias("confidence"), F.when(F.col("turn") % 2 == 0, "Obligatory").otherwise("none").alias("priority"))


_WANT = f"""SELECT conv_id, turn, verdict AS supports, CASE WHEN turn % 2 = 0 THEN 'obligatory' END AS priority, CASE WHEN turn % 3 = 0 THEN turn / 8 END AS confidence, why AS justification FROM conversations JOIN {_SAID_SQL} ON (turn + conv_id) % {len(_SAID)} = i"""


@query(f"SELECT conv_id, turn AS i, supports, priority, CAST(confidence AS DOUBLE) AS confidence, justification FROM ({_WANT})")
def verdict_json_parse(spark, sf_dir):
    """A judge's answer: prose around a JSON array of verdicts, the last of each number, with aliases and contradictions."""
    item = F.struct(F.col("turn").alias("i"), "supports_claim", "priority", "confidence", "justification")
    stale = F.struct(F.col("turn").alias("i"), F.lit("supports").alias("supports_claim"), F.lit(None).cast("string").alias("priority"), F.lit(None).cast("double").alias("confidence"), F.lit("old").alias("justification"))
    both = F.concat(F.lit("[ignored] Here you are:\n```json\n"), F.to_json(F.concat(F.collect_list(stale), F.collect_list(item))), F.lit("\n``` done ]"))
    answers = _answers(spark, sf_dir).groupBy("conv_id").agg(both.alias("answer"))
    return relevance.parse_batch(answers, ("conv_id",)).select("conv_id", "i", "v.*")


@query(f"""SELECT conv_id, 'k' || (turn % 2) AS cite_key, 'c' || turn AS claim_id, supports FROM ({_WANT})""")
def verdict_groups(spark, sf_dir):
    """A judge's answer by work and claim."""
    claim = F.struct(F.concat(F.lit("c"), "turn").alias("claim_id"), "supports_claim", "justification")
    works = _answers(spark, sf_dir).groupBy("conv_id", F.concat(F.lit("k"), F.col("turn") % 2).alias("cite_key")).agg(F.collect_list(claim).alias("claims"))
    answers = works.groupBy("conv_id").agg(F.concat(F.lit("Sure: "), F.to_json(F.collect_list(F.struct("cite_key", "claims"))), F.lit(" ok")).alias("answer"))
    return relevance.parse_groups(answers, ("conv_id",)).select("conv_id", "cite_key", "claim_id", "v.supports")


@query(f"""SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN 'inconclusive' ELSE supports END AS supports FROM ({_WANT})""")
def verdict_single(spark, sf_dir):
    """Answers of one object, some garbled."""
    body = F.to_json(F.struct("supports_claim", "justification"))
    answer = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("x "), body)).when(F.col("turn") % 4 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(F.col("turn") % 4 == 2, body).otherwise("{ not json }")
    return relevance.parse_single(_answers(spark, sf_dir).withColumn("answer", answer), ("conv_id", "turn")).select("conv_id", "turn", "v.supports")


@query(f"""{BASE}, i AS (SELECT paper_id, cite_key, claim_id, ord, row_number() OVER (PARTITION BY paper_id, cite_key ORDER BY ord) AS k FROM pred),
  w AS (SELECT paper_id, cite_key, min(ord) AS ord, count(*) AS n, string_agg(claim_id, ',' ORDER BY ord) AS claims, max(CASE WHEN k = 1 THEN 'abstract of ' || claim_id END) AS abstract FROM i GROUP BY 1, 2)
  SELECT paper_id, cite_key, claims, abstract, CAST((row_number() OVER (PARTITION BY paper_id ORDER BY ord) - 1) // 3 AS INT) AS request FROM w""")
def judge_requests(spark, sf_dir):
    """Works with their claims and evidence, in requests of three."""
    items = pred(spark, sf_dir).select("paper_id", "cite_key", "claim_id", "ord", F.col("claim_id").alias("claim"), F.concat(F.lit("abstract of "), "claim_id").alias("abstract"))
    got = relevance.requests(items, 3)
    return got.select("paper_id", "cite_key", F.array_join(F.transform("claims", lambda c: c["claim_id"]), ",").alias("claims"), "abstract", "request")


@query(f"""{BASE}, w AS (SELECT paper_id, cite_key, count(*) AS n, min(ord) AS ord FROM pred WHERE supports IN ('partial', 'inconclusive') AND doc_id % 2 = 0 AND doc_id % 3 <> 0 GROUP BY 1, 2)
  SELECT paper_id, cite_key, n, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, ord) AS place FROM w) WHERE place <= 8""")
def escalated_works(spark, sf_dir):
    """Works that the judge reads in full: open claims on details that their abstract is on topic for."""
    n = F.col("doc_id")
    claim = F.when(n % 2 == 0, "the benchmark accuracy of networks").otherwise("networks are related")
    abstract = F.when(n % 3 == 0, "cooking rice and beans").when(n % 3 == 1, "").otherwise("networks reach accuracy")
    pending = pred(spark, sf_dir).filter(evidence.judge_escalates(F.col("supports"), claim, abstract))
    return evidence.escalated_works(pending.select("paper_id", "cite_key", "ord"))


@query(f"""{BASE}, f AS (SELECT claim_id, ord, doc_id, doc_id % 5 = 0 AS in_table, CASE WHEN doc_id % 4 <> 3 THEN CASE WHEN doc_id % 8 = 0 THEN 'partial' ELSE 'supports' END END AS first, CASE WHEN doc_id % 8 = 0 THEN 'does_not' END AS second FROM pred)
  SELECT claim_id, ord, CASE WHEN in_table THEN 'skipped' WHEN first IS NULL THEN 'inconclusive' ELSE coalesce(second, first) END AS supports, CASE WHEN NOT in_table AND first IS NOT NULL AND doc_id % 3 = 0 THEN 'helpful' WHEN doc_id % 2 = 0 THEN 'obligatory' ELSE 'helpful' END AS priority,
    CASE WHEN in_table OR first IS NULL THEN 'n' WHEN second IS NOT NULL THEN 'n' || chr(10) || '(based on full text' || CASE WHEN doc_id % 16 = 0 THEN ' §Results' ELSE '' END || ') again' ELSE 'n' || chr(10) || '(based on abstract only) why' END AS notes FROM f""")
def relevance_fill(spark, sf_dir):
    """Records settled by two stages of a judge."""
    n = F.col("doc_id")
    rows = pred(spark, sf_dir).select("claim_id", "ord", n, F.when(n % 2 == 0, "we use it").otherwise("it is there").alias("claim"), (n % 5 == 0).alias("in_table"), F.lit("n").alias("notes"))
    said = lambda v, why: relevance.verdict(F.struct(v.alias("supports_claim"), F.when(n % 3 == 0, "helpful").alias("priority"), F.lit(0.5).alias("confidence"), F.lit(why).alias("justification")))
    first = rows.filter("doc_id % 4 <> 3").select("claim_id", "ord", said(F.when(n % 8 == 0, "partial").otherwise("supports"), "why").alias("v"))
    second = rows.filter("doc_id % 8 = 0").select("claim_id", "ord", said(F.lit("does_not"), "again").alias("v"), F.when(n % 16 == 0, "Results").alias("heading"))
    key = ["claim_id", "ord"]
    return relevance.fill(rows, relevance.restage(first, second, key), key).select("claim_id", "ord", "supports", "priority", "notes")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '[Intro]' || chr(10) || p_name || chr(10) || chr(10) || 'plain' ELSE '[Intro]' || chr(10) || p_name || chr(10) || chr(10) || '[Two]' || chr(10) || 'other' END AS evidence, least(8192, greatest(512, 96 * p_size)) AS cap FROM part""")
def chunk_format(spark, sf_dir):
    """Chosen chunks as one text, equal ones once, and the cap of an answer."""
    n = F.col("p_partkey")
    x = lambda h, c: F.struct(h.alias("heading"), c.alias("chunk"))
    chosen = F.array(x(F.lit(" Intro "), F.col("p_name")), x(F.lit("Again"), F.concat(F.lit(" "), "p_name")), x(F.lit("Empty"), F.lit(" ")), x(F.when(n % 2 == 0, "").otherwise("Two"), F.when(n % 2 == 0, "plain").otherwise("other")))
    return table(spark, sf_dir, "part").select(n, evidence.format_chunks(chosen).alias("evidence"), evidence.output_cap(F.col("p_size")).alias("cap"))
