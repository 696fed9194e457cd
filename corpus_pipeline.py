"""Corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet into the shared folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refloom.llm.bag_minhash import drop_near_duplicates
from refloom.llm.common import DOC_COLUMNS, doc_columns, read, stage
from refloom.llm.mixing import mix
from refloom.llm.repetition import repetition_rules
from refloom.llm.secret_scan import redact
from refloom.llm.tiling import drop_contaminated


# Of every stage: a null text counts as empty and has no word; texts go through whole; rows equal in all columns are
# judged alike; an empty table gives an empty one; columns beside those of documents are not read, whatever their names.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep, all their columns. Null, empty and short texts (under 50 words) go."""
    return repetition_rules(doc_columns(docs), DOC_COLUMNS).filter("kept").select(*DOC_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest doc_id (null last).

    Documents are told apart by doc_id and text: of rows equal in both, one stays, whatever their other columns hold.
    """
    return drop_near_duplicates(doc_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text. A null or empty text, on either side, matches nothing and stays."""
    return drop_contaminated(doc_columns(docs), read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars brought up to date; a null text stays null."""
    return redact(doc_columns(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as they came (doc_id, text, lang, source, n_chars), and how many words of each it takes.

    Rows come by virtual finish time. Documents of which nothing is taken go: those without words, and those that
    the total budget does not reach. A null source is a source.
    """
    mixed = mix(doc_columns(docs), carry=("text", "lang", "n_chars")).filter("taken > 0")
    return mixed.select(*DOC_COLUMNS, "size", "source_size", "target", "taken", "finish_time")


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("secret scan", secrets), ("mixing", mixture)]

#: Suffix arrays and tilings have no SQL form; tests/llm/test_pipeline_brute.py compares each stage and run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
