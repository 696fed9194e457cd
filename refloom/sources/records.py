"""Readers and sinks of citation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.operators.order import smoke

#: Fixed format: the record type, field by field in its published order.
RECORD = """
schema_version STRING, paper_id STRING, claim_id STRING, cite_key STRING,
paper STRUCT<paper_id: STRING, title: STRING, arxiv_id: STRING, doi: STRING, source_kind: STRING, tex_available: BOOLEAN>,
claim STRUCT<claim_id: STRING, text: STRING, section: STRING, char_span: ARRAY<INT>>,
cited_as STRUCT<raw: STRING, authors: ARRAY<STRING>, title: STRING, year: INT, venue: STRING, doi: STRING, arxiv_id: STRING, url: STRING>,
in_table BOOLEAN, `exists` STRING,
resolved STRUCT<source: STRING, match_method: STRING, match_score: DOUBLE, title: STRING, authors: ARRAY<STRING>, year: INT, venue: STRING, doi: STRING, arxiv_id: STRING, url: STRING, url_valid: BOOLEAN, abstract: STRING>,
metadata_issues ARRAY<STRING>, supports_claim STRING, priority STRING, severity STRING, compared_against BOOLEAN,
evidence ARRAY<STRUCT<kind: STRING, source: STRING, quote: STRING, url: STRING>>, confidence DOUBLE, model_tier STRING, notes STRING, error STRING,
labels STRUCT<`exists`: STRING, supports_claim: STRING, priority: STRING, severity: STRING, is_hallucinated: BOOLEAN, provenance: STRING>
"""
REQUIRED = ("paper_id", "claim_id", "cite_key", "claim", "cited_as")
DOMAINS = {
    "exists": ("yes", "no", "unresolved"), "supports_claim": ("supports", "partial", "does_not", "inconclusive", "skipped"), "priority": ("obligatory", "helpful"),
    "severity": ("high", "medium", "low", "ok"), "model_tier": ("none", "bulk", "judge"),
}
DEFAULTS = {"schema_version": "0.1", "exists": "unresolved", "supports_claim": "inconclusive", "priority": "helpful", "severity": "ok", "model_tier": "none"}


def with_defaults(records: DataFrame) -> DataFrame:
    out = records.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()})
    return out.withColumn("metadata_issues", F.coalesce("metadata_issues", F.array().cast("array<string>")))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One record per line; a line that is no record fails the read."""
    return with_defaults(spark.read.schema(RECORD).option("mode", "FAILFAST").json(path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents: an array of records, or an object with a list 'records'."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.get_json_object("v", "$.records"))
    rows = whole.select(F.explode(F.from_json(listed, f"ARRAY<STRUCT<{_nested(RECORD)}>>", {"mode": "FAILFAST"})).alias("r"))
    return with_defaults(rows.select("r.*"))


def _nested(ddl: str) -> str:
    from pyspark.sql.types import StructType

    inner = StructType.fromDDL(ddl).simpleString()
    return inner.removeprefix("struct<").removesuffix(">")


def read_directory(spark: SparkSession, folder: str, gold: str | None = None) -> DataFrame:
    """All *.jsonl of a folder but the gold file."""
    rows = spark.read.schema(RECORD).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(folder).select("*", F.col("_metadata.file_path").alias("file"))
    return with_defaults(rows if gold is None else rows.filter(~F.col("file").endswith(gold))).drop("file")


def violations(records: DataFrame) -> DataFrame:
    """Every broken rule of every record: paper_id, claim_id, cite_key, rule. It never raises."""
    rules = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in REQUIRED]
    rules += [F.when(~F.col(c).isin(*v), F.concat(F.lit(f"{c} has no value "), F.col(c))) for c, v in DOMAINS.items()]
    rules += [F.when(~F.col("confidence").between(0, 1), F.lit("confidence outside [0, 1]")), F.when(~F.col("resolved.match_score").between(0, 1), F.lit("match_score outside [0, 1]"))]
    rules += [F.when((F.size("claim.char_span") > 0) & (F.size("claim.char_span") != 2), F.lit("char_span is no pair"))]
    return records.select("paper_id", "claim_id", "cite_key", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def unlabelled(gold: DataFrame) -> DataFrame:
    return gold.filter(F.col("labels.exists").isNull()).select("paper_id", "claim_id", "cite_key")


def write_jsonl(records: DataFrame, path: str) -> None:
    records.write.option("ignoreNullFields", "false").json(path)


def write_splits(records: DataFrame, positive: Column, order: list[Column], path: str, n: int = 18) -> dict[str, str]:
    """All records and the first n, positive ones first, as JSON lines in folders of path; where they are."""
    where = {"smoke": f"{path}/smoke", "full": f"{path}/full"}
    write_jsonl(smoke(records, positive, order, n).coalesce(1), where["smoke"])
    write_jsonl(records, where["full"])
    return where


def openalex_abstract(index):
    """{word: [positions]} as text in order."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " ")


def dblp_authors(column):
    """DBLP's author field: one or many objects or strings; numbers that tell namesakes apart go."""
    many = F.from_json(column, "array<string>")
    text = F.when(column.startswith("["), many).when(column.startswith("{"), F.array(column)).otherwise(F.array(F.regexp_replace(column, '^"|"$', "")))
    return F.transform(text, lambda a: F.regexp_replace(F.coalesce(F.when(a.startswith("{"), F.get_json_object(a, "$.text")), a), r" [0-9]{4}$", ""))


def write_report(reports: DataFrame, path: str, name: str = "report", extension: str = "md") -> None:
    """A text file of each paper (paper_id, report) in a folder of its own below path: written side by side, partitioned by paper."""
    reports.select("paper_id", reports[name].alias("value")).write.partitionBy("paper_id").option("lineSep", "\n").text(f"{path}/{extension}")


def write_runs(runs: DataFrame, path: str) -> None:
    """A JSON object of each run's figures, partitioned by paper."""
    runs.write.partitionBy("paper_id").json(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Runs as they were written; what is damaged gives nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def json_schema() -> str:
    """The record type as a JSON text."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(RECORD).json()
