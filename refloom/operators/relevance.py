"""The relevance stage: what a judge is asked, how its answers are read, and how they settle records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.operators.evidence import priority

#: The closed sets, other spellings of a verdict, and words that say that the evidence opposes the claim.
SUPPORTS = ("supports", "partial", "does_not", "inconclusive", "skipped")
PRIORITIES = ("obligatory", "helpful")
ALIASES = {"does not": "does_not", "doesnt": "does_not", "n/a": "inconclusive", "na": "inconclusive", "unknown": "inconclusive", "unverified": "inconclusive"}
CONTRADICTION = r"(?i)\bcontradict|\bdoes not support\b|\bdo not support\b|\binconsistent with\b|\brefut|\bchronolog|\bthe opposite\b"
VERDICT = "supports_claim STRING, priority STRING, confidence DOUBLE, justification STRING"
_FIELDS = ", ".join(x.replace(" ", ": ", 1) for x in VERDICT.split(", "))
#: Works in one request to the judge.
WORKS_PER_REQUEST = 40


def first_json(text: Column, opener: str, closer: str) -> Column:
    """The outermost span between two brackets, in a fenced block if there is one; null without any."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.+?)\s*```", 1)
    where = F.when(inner != "", inner).otherwise(text)
    begin = F.instr(where, opener)
    end = F.length(where) - F.instr(F.reverse(where), closer) + 1
    return F.when((begin > 0) & F.contains(where, F.lit(closer)) & (end > begin), F.substring(where, begin, end - begin + 1))


def _whole(span: Column, schema: str) -> Column:
    """A span as one value of the type schema; null if it is no JSON or holds more. In brackets, as from_json() would forgive what follows a first value."""
    values = F.from_json(F.concat(F.lit("["), span, F.lit("]")), f"array<{schema}>")
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def token(value: Column, allowed: tuple[str, ...], default: str | None) -> Column:
    """A loosely spelled value of a closed set; default for any other."""
    raw = F.lower(F.trim(value))
    out = F.regexp_replace(raw, "[ -]", "_")
    for alias, meant in ALIASES.items():
        out = F.when(raw == alias, meant).otherwise(out)
    return F.when(out.isin(*allowed), out).otherwise(F.lit(default))


def verdict(row: Column) -> Column:
    """supports, priority, confidence, justification of one answer (VERDICT). What is no verdict is inconclusive; what its own words contradict is does_not."""
    said = F.trim(F.coalesce(row["justification"], F.lit("")))
    found = token(row["supports_claim"], SUPPORTS, "inconclusive")
    found = F.when(found.isin("supports", "partial") & said.rlike(CONTRADICTION), "does_not").otherwise(found)
    return F.struct(found.alias("supports"), token(row["priority"], PRIORITIES, None).alias("priority"), row["confidence"].alias("confidence"), said.alias("justification"))


def parse_single(answers: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """carry, v of answers (answer: text with one JSON object); anything else abstains."""
    rows = answers.select(*carry, F.coalesce(_whole(first_json(F.col("answer"), "{", "}"), f"struct<{_FIELDS}>"), F.from_json(F.lit("{}"), VERDICT)).alias("x"))
    return rows.select(*carry, verdict(F.col("x")).alias("v"))


def parse_batch(answers: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """carry, i, v of each verdict in answers (answer: text with a JSON array), the last of each i; garbled answers give none."""
    items = _whole(first_json(F.col("answer"), "[", "]"), f"array<struct<i: BIGINT, {_FIELDS}>>")
    rows = answers.select(*carry, F.posexplode(items).alias("at", "x")).filter("x.i IS NOT NULL")
    return rows.groupBy(*carry, F.col("x.i").alias("i")).agg(F.max_by("x", "at").alias("x")).select(*carry, "i", verdict(F.col("x")).alias("v"))


def parse_groups(answers: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """carry, cite_key, claim_id, v of each verdict in answers (answer: text with a JSON array of works, each with its claims).

    A work that comes twice counts as its last answer says, as does a claim within it; works and claims without an id are left out.
    """
    items = _whole(first_json(F.col("answer"), "[", "]"), f"array<struct<cite_key: STRING, claims: array<struct<claim_id: STRING, {_FIELDS}>>>>")
    works = answers.select(*carry, F.posexplode(items).alias("at", "w")).filter("w.cite_key IS NOT NULL").groupBy(*carry, F.col("w.cite_key").alias("cite_key")).agg(F.max_by("w.claims", "at").alias("claims"))
    rows = works.select(*carry, "cite_key", F.posexplode("claims").alias("at", "x")).filter("x.claim_id IS NOT NULL")
    return rows.groupBy(*carry, "cite_key", F.col("x.claim_id").alias("claim_id")).agg(F.max_by("x", "at").alias("x")).select(*carry, "cite_key", "claim_id", verdict(F.col("x")).alias("v"))


def requests(items: DataFrame, size: int = WORKS_PER_REQUEST) -> DataFrame:
    """One row per work of a paper: its claims in order, its evidence once, and the number of the request that it goes into.

    items: paper_id, cite_key, claim_id, ord, claim, abstract. Works go by first appearance, ``size`` to a request.
    """
    claims = F.transform(F.array_sort(F.collect_list(F.struct("ord", "claim_id", "claim"))), lambda x: F.struct(x["claim_id"].alias("claim_id"), x["claim"].alias("claim")))
    works = items.groupBy("paper_id", "cite_key").agg(F.min("ord").alias("ord"), claims.alias("claims"), F.min_by("abstract", "ord").alias("abstract"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("ord"))
    return works.withColumn("request", F.floor((place - 1) / size).cast("int")).drop("ord")


def fill(records: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """records (key, claim, in_table, notes) with supports, priority, confidence and notes after the judge.

    verdicts: key, v as of verdict(), basis (what was read: 'abstract only', 'full text §Results'). Citations in tables are skipped;
    a record without a verdict is inconclusive; the judge's priority goes before the cues of the claim.
    """
    joined = records.join(verdicts.select(*key, "v", "basis"), key, "left")
    table_row = F.coalesce("in_table", F.lit(False))
    judged = ~table_row & F.col("v").isNotNull()
    said = F.concat(F.lit("(based on "), F.coalesce("basis", F.lit("abstract only")), F.lit(") "), F.col("v.justification"))
    notes = F.when(judged & (F.col("v.justification") != ""), F.concat_ws("\n", F.nullif("notes", F.lit("")), said)).otherwise(F.col("notes"))
    return joined.withColumns(
        {
            "supports": F.when(table_row, "skipped").when(judged, F.col("v.supports")).otherwise("inconclusive"),
            "priority": F.coalesce(F.when(judged, F.col("v.priority")), priority(F.col("claim"))),
            "confidence": F.when(judged, F.col("v.confidence")),
            "notes": notes,
        }
    ).drop("v", "basis")


def full_text_basis(heading: Column) -> Column:
    return F.when(F.length(heading) > 0, F.concat(F.lit("full text §"), heading)).otherwise("full text")


def restage(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Verdicts of the first stage (key, v), replaced by those of the second where there is one; key, v, basis. second: key, v, heading."""
    again = second.select(*key, F.col("v").alias("v2"), full_text_basis(F.col("heading")).alias("b2"))
    return first.join(again, key, "left").select(*key, F.coalesce("v2", "v").alias("v"), F.when(F.col("v2").isNotNull(), F.col("b2")).otherwise("abstract only").alias("basis"))
