"""Comparison tables against the cited works: which cells are judged, and what answers make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.operators.grid import MARKS, checkable, decide
from refloom.operators.severity import derive_cell_severity

#: What a judge may answer, and columns without a definition or with a loose one.
ANSWERS, NO_GLOSS, LOOSE_GLOSS = ("has", "lacks", "absent", "unclear", "wrong_paper"), ("header_only", "none"), ("mention", "recovered")
#: Fixed texts: why a cell is not judged, and what is told of a verdict.
SKIPPED = {"self": "authors' own method — no external source", "uncited": "row carries no citation to verify against", "undefined": "column never defined in the paper"}
NO_EVIDENCE = "no evidence could be retrieved for the cited work"
WRONG_PAPER = "[retrieval failure: the retrieved text is about a different work, so this cell was never checked against the cited paper] "
NO_TECHNIQUE = "[in this column a ✗ means the citing paper reports no technique for that phase, not that the cited work cannot do it] "
NO_CRITERION = "[the citing paper never states what earns a mark in this column, so the cell asserts nothing checkable] "
WEAK = "[weakly grounded: the paper discusses this column but never defines it crisply, so treat this as a lead rather than a finding] "


def skip(is_self: Column, n_cites: Column, mark: Column, gloss: Column, kind: Column, verify_self: bool = False) -> Column:
    """struct(verdict, note) of a cell that is not judged, the first reason counts; null if it is."""
    said = lambda verdict, note: F.struct(F.lit(verdict).alias("verdict"), note.alias("note"))
    return (
        F.when(is_self & ~F.lit(verify_self), said("skipped", F.lit(SKIPPED["self"])))
        .when(n_cites == 0, said("skipped", F.lit(SKIPPED["uncited"])))
        .when(~mark.isin(*MARKS), said("skipped", F.concat(F.lit("cell is "), mark, F.lit(", not a ✓/✗ claim"))))
        .when(gloss == "header_only", said("undefined", F.lit(SKIPPED["undefined"])))
        .when(~checkable(gloss, kind), said("skipped", F.concat(F.lit("column kind "), kind, F.lit(" is descriptive"))))
    )


def confidence(c: Column) -> Column:
    """A loose number as a share; null if it is none."""
    number = c.cast("string").try_cast("double")
    return F.when(number.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


def verify_cells(cells: DataFrame, evidence: DataFrame, answers: DataFrame, row: list[str], col: str = "col_index") -> DataFrame:
    """A finding for each cell: verdict, severity, note, confidence and understates.

    cells: row keys, col, is_self, n_cites, mark, gloss, kind; evidence: row keys, evidence, failure (of the judge, or null);
    answers: row keys, col, ord, answer, justification, confidence, of which the last for a cell counts. What the judge is not asked in so many words is unclear.
    """
    given = answers.groupBy(*row, col).agg(F.max_by(F.struct("answer", "justification", "confidence"), "ord").alias("a"))
    joined = cells.join(evidence.select(*row, "evidence", "failure"), row, "left").join(given, [*row, col], "left")
    skipped = skip(F.col("is_self"), F.col("n_cites"), F.col("mark"), F.col("gloss"), F.col("kind"))
    answer = F.lower(F.trim(F.coalesce("a.answer", F.lit("unclear"))))
    answer = F.when(answer.isin(*ANSWERS), answer).otherwise("unclear")
    silent = F.trim(F.coalesce("evidence", F.lit(""))) == ""
    first = F.when(silent, "unverifiable").otherwise(decide(F.col("mark"), answer))
    said = F.when(silent, F.lit(NO_EVIDENCE)).otherwise(F.substring(F.coalesce("a.justification", F.lit("")), 1, 500))
    failed = F.concat(F.lit("[pipeline failure: "), "failure", F.lit(", so this cell was never judged]"))
    said = F.when((said == "") & F.col("failure").isNotNull(), failed).otherwise(said)
    said = F.when(answer == "wrong_paper", F.concat(F.lit(WRONG_PAPER), said)).otherwise(said)
    crossed = (first == "contradicted") & (F.col("mark") == "no") & (F.col("kind") == "categorical")
    bare = (first == "contradicted") & ~crossed & F.col("gloss").isin(*NO_GLOSS)
    loose = (first == "contradicted") & ~crossed & F.col("gloss").isin(*LOOSE_GLOSS)
    verdict = F.when(crossed | bare, "undefined").otherwise(first)
    said = F.when(crossed, F.concat(F.lit(NO_TECHNIQUE), said)).when(bare, F.concat(F.lit(NO_CRITERION), said)).when(loose, F.concat(F.lit(WEAK), said)).otherwise(said)
    out = joined.withColumn("s", skipped).withColumns({"verdict": F.coalesce("s.verdict", verdict), "note": F.coalesce("s.note", said), "loose": F.col("s").isNull() & loose})
    severity = F.when(F.col("loose"), "low").otherwise(derive_cell_severity(F.col("mark"), F.col("verdict"), F.col("is_self")))
    understates = (F.col("verdict") == "contradicted") & (F.col("mark") == "no") & ~F.col("is_self")
    judged = F.when(F.col("s").isNull() & ~silent, confidence(F.col("a.confidence")))
    return out.withColumns({"severity": severity, "understates": understates, "confidence": judged}).drop("a", "s", "loose", "evidence", "failure")


def row_payloads(cells: DataFrame, row: list[str], col: str = "col_index") -> DataFrame:
    """What the judge is asked of each row: the properties of its judged cells in order, never the marks. cells as above, with header and definition."""
    asked = cells.filter(skip(F.col("is_self"), F.col("n_cites"), F.col("mark"), F.col("gloss"), F.col("kind")).isNull())
    prop = F.struct(F.col(col).alias("col_index"), F.col("header").alias("property"), F.col("definition").alias("definition"))
    return asked.groupBy(*row).agg(F.array_sort(F.collect_list(prop)).alias("properties"))


#: Fixed texts of an evidence block, and the characters that it may have.
FULL, SHORT = "COVERAGE: full text — the excerpts below were selected from the whole paper", "COVERAGE: title and abstract only — the body was not retrieved"
EXCERPTS, EVIDENCE_CHARS = "FULL TEXT EXCERPTS:\n", 24_000


def evidence_block(title: Column, abstract: Column, chunks: Column, most: int = EVIDENCE_CHARS) -> Column:
    """What is known of a work as one text: coverage, title, abstract, and excerpts (heading, text) while they fit, at least one, each once by its first 120 word characters."""
    key = lambda x: F.substring(F.regexp_replace(F.lower(F.coalesce(x["text"], F.lit(""))), r"[^\p{L}\p{N}_]+", ""), 1, 120)
    some = F.coalesce(chunks, F.array().cast("array<struct<heading:string,text:string>>"))
    first = F.filter(some, lambda x, i: (key(x) != "") & ~F.exists(F.slice(some, F.lit(1), i), lambda y: key(y) == key(x)))
    lines = F.transform(first, lambda x: F.concat(F.lit("["), F.coalesce(F.nullif(x["heading"], F.lit("")), F.lit("body")), F.lit("] "), x["text"]))
    coverage = F.when(F.size(some) > 0, FULL).otherwise(SHORT)
    head = F.concat_ws("\n\n", coverage, F.rtrim(F.concat(F.lit("TITLE: "), F.coalesce(title, F.lit("")))), F.when(F.length(abstract) > 0, F.concat(F.lit("ABSTRACT: "), abstract)))
    budget = F.greatest(F.lit(0), F.lit(most) - F.length(head) - F.lit(len("\n\n" + EXCERPTS)))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        full = acc["full"] | (acc["used"] + F.length(x) + 1 > budget)
        return F.struct(F.when(full, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"), F.when(full, acc["used"]).otherwise(acc["used"] + F.length(x) + 1).alias("used"), full.alias("full"))

    kept = F.aggregate(lines, start, step, lambda acc: F.when(F.size(acc["kept"]) > 0, acc["kept"]).otherwise(F.slice(lines, 1, 1)))
    return F.substring(F.when(F.size(lines) > 0, F.concat(head, F.lit("\n\n" + EXCERPTS), F.array_join(kept, "\n"))).otherwise(head), 1, most)


_PROSE = r"(?i)\b(?:the|and|of|for|with|that|this|which|while|from|are|is|was|were|has|have)\b"


def method_name(label: Column) -> Column:
    """Whether a row's label names a method: up to 60 characters and one function word."""
    text = F.trim(F.coalesce(label, F.lit("")))
    return (text != "") & (F.length(text) <= 60) & (F.regexp_count(text, F.lit(_PROSE)) <= 1)


def extraction_quality(rows: DataFrame, columns: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, quality: 0.40 rows with a citation or one's own, 0.25 named columns, 0.20 rows that name a method, 0.15 marks of all cells; 0 without rows or columns.

    rows: keys, label, n_cites, is_self; columns: keys, header; cells: keys, mark.
    """
    share = lambda c: F.avg(c.cast("double"))
    r = rows.groupBy(*keys).agg(F.count("*").alias("n"), share((F.col("n_cites") > 0) | F.col("is_self")).alias("cited"), share(method_name(F.col("label"))).alias("named"))
    c = columns.groupBy(*keys).agg(F.count("*").alias("m"), share(F.trim(F.coalesce("header", F.lit(""))) != "").alias("headed"))
    marks = cells.groupBy(*keys).agg(F.count_if(F.col("mark").isin(*MARKS)).alias("marks"))
    joined = r.join(c, keys, "full").join(marks, keys, "left")
    quality = 0.40 * F.col("cited") + 0.25 * F.col("headed") + 0.20 * F.col("named") + 0.15 * F.coalesce("marks", F.lit(0)) / (F.col("n") * F.col("m"))
    return joined.select(*keys, F.coalesce(quality, F.lit(0.0)).alias("quality"))


def mark_agreement(a: Column, b: Column) -> Column:
    """Share of the longer of two sequences of marks that agrees place by place; null unless both have four."""
    x, y = (F.filter(c, lambda m: m.isin(*MARKS)) for c in (a, b))
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), lambda t: t))
    return F.when((F.size(x) >= 4) & (F.size(y) >= 4), same / F.greatest(F.size(x), F.size(y)))


def pair_extractions(left: DataFrame, right: DataFrame, least: float = 0.7) -> DataFrame:
    """paper_id, l_ord, r_ord: which two extractions are of one table, each used once. left and right: paper_id, ord, marks (in order).

    A table of the left takes the first free one of the right that agrees in 70 %; that depends on those before it, so it is a fold over a paper's tables.
    """
    both = left.select("paper_id", F.col("ord").alias("l_ord"), F.col("marks").alias("lm")).join(right.select("paper_id", F.col("ord").alias("r_ord"), F.col("marks").alias("rm")), "paper_id")
    good = both.filter(mark_agreement(F.col("lm"), F.col("rm")) >= least).select("paper_id", "l_ord", "r_ord")
    edges = good.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("l_ord", "r_ord"))).alias("e"))
    used = lambda acc, x: F.exists(acc, lambda y: (y["l_ord"] == x["l_ord"]) | (y["r_ord"] == x["r_ord"]))
    kind = f"array<{dict(edges.select(F.col('e').alias('e')).dtypes)['e'].removeprefix('array<').removesuffix('>')}>"
    chosen = F.aggregate("e", F.array().cast(kind), lambda acc, x: F.when(used(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return edges.select("paper_id", F.inline(chosen))


def mark_disagreements(win: DataFrame, lose: DataFrame, keys: list[str], cap: int = 20) -> DataFrame:
    """Cells (keys, row_index, col_index, mark) of two extractions of a table that differ, the first 20 in order."""
    other = lose.select(*keys, "row_index", "col_index", F.col("mark").alias("other"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("row_index", "col_index"))
    return win.join(other, [*keys, "row_index", "col_index"]).filter("mark <> other").withColumn("place", place).filter(F.col("place") <= cap).drop("place")


def distinct_tables(tables: DataFrame) -> DataFrame:
    """The first of a paper's tables (paper_id, ord, headers, rows, marks) with the same headers, labelled and cited rows, and marks."""
    rest = [c for c in tables.columns if c != "paper_id"]
    first = tables.groupBy("paper_id", F.sha2(F.to_json(F.struct("headers", "rows", "marks")), 256).alias("signature")).agg(F.min_by(F.struct(*rest), "ord").alias("t"))
    return first.select("paper_id", *[f"t.{c}" for c in rest])


def findings_order(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with their place in a table's report: worst severity first, then by row and dimension."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
    return findings.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "row_label", "dimension")).cast("long"))
