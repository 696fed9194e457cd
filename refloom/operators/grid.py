"""Comparison tables: marks, columns, verdicts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.tex import strip_cell
from refloom.functions.text import squeeze, strip_chars, strip_comments

#: Whole-cell words of each mark, in TeX and in a PDF's text.
PARTIAL_WORDS = ("partial", "partially", "limited", "partly", "some", "medium", "mid")
YES_WORDS = ("yes", "y", "true", "full", "high", "supported")
NO_WORDS = ("no", "n", "false", "low", "none", "unsupported")
EMPTY_WORDS = ("n/a", "na", "n.a.", "n.a", "?", "unknown", "unk", "tbd")
DASHES = ("-", "–", "—", "--", "---")
PDF_YES_WORDS, PDF_NO_WORDS, PDF_PARTIAL_WORDS = ("yes", "y", "true", "full"), ("no", "n", "false", "none"), ("partial", "partially", "limited", "partly", "medium")
#: Fixed patterns: signs and macros of each mark. Dingbats 51 and 52 are check marks, 53 to 56 are crosses.
YES_SIGN = r"(?i)\\ding\s*\{\s*5[12]\s*\}|\\(?:checkmark|cmark|greencheck|CheckmarkBold|Checkmark)\b|\\usym\s*\{\s*2713\s*\}|[✓✔🗸]"
NO_SIGN = r"(?i)\\ding\s*\{\s*5[3-6]\s*\}|\\(?:xmark|redcross|XSolidBrush|ding55)\b|\\usym\s*\{\s*271[78]\s*\}|\$?\\times\$?|[✗✘×✕✖]"
PARTIAL_SIGN = r"(?i)\\(?:halfcirc|LEFTcircle|RIGHTcircle|halfstar|Circle|tmark|mmark|pmark|midmark|hmark|partialmark|yellowcheck)\b|[▲◐◑⯨◒◓]"
PDF_YES, PDF_NO, PDF_PARTIAL = "\uf0fc\uf052\uf051✓✔√", "\uf0fb\uf056\uf055✗✘✕×", "▲◐◑半"
#: Fixed patterns: what a legend's wording stands for, tested in this order.
ABSTAINS = r"(?i)\b(?:not\s+applicable|n/?\.?a\.?|not\s+(?:reported|measured|evaluated|available|studied|tested)|unknown|unclear|undetermined|to\s+be\s+determined)\b"
MIDDLING = r"(?i)\b(medium|partial(ly)?|moderate|limited|some|weakly|mid)\b"
WEAK = r"(?i)\b(weak|no|not|none|lacks?|without|absent|unsupported|does not)\b"
STRONG = r"(?i)\b(strong|full|fully|yes|support(s|ed)?|satisf(y|ies|ied)|has|available)\b"
NUMERIC = r"^[~$\\simO()0-9.,\s]*[0-9][0-9.,KMBG%~\s]*$"
MARKS = ("yes", "no", "partial")


def grade_from_meaning(meaning: Column) -> Column:
    """The mark that a legend's wording stands for; null if it abstains or says nothing of the kind."""
    return F.when(meaning.rlike(ABSTAINS), F.lit(None).cast("string")).when(meaning.rlike(MIDDLING), "partial").when(meaning.rlike(WEAK), "no").when(meaning.rlike(STRONG), "yes")


def _words(low: Column, partial: tuple, yes: tuple, no: tuple) -> Column:
    """The mark of a cell's whole text by one lookup; null if it is no word of any."""
    marks: dict[str, str] = {}
    for mark, some in (("no", DASHES), ("empty", EMPTY_WORDS), ("partial", partial), ("yes", yes), ("no", no), ("empty", ("",))):
        for word in some:
            marks.setdefault(word, mark)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in marks.items() for x in pair]), low)


def normalize_mark(raw: Column, legend: Column | None = None) -> Column:
    """yes, no, partial, empty or value of a TeX cell; the paper's own legend (a map of sign to meaning) goes first."""
    cell = F.trim(strip_comments(F.coalesce(raw, F.lit(""))))
    yes, no, low = cell.rlike(YES_SIGN), cell.rlike(NO_SIGN), F.lower(strip_cell(cell))
    out = (
        F.when(cell.rlike(PARTIAL_SIGN), "partial")
        .when(yes & ~no, "yes")
        .when(no & ~yes, "no")
        .otherwise(F.coalesce(_words(low, PARTIAL_WORDS, YES_WORDS, NO_WORDS), F.lit("value")))
    )
    if legend is not None:

        def hit(sign: Column) -> Column:
            macro = F.rlike(cell, F.concat(F.lit("\\Q"), sign, F.lit("\\E(?![A-Za-z])")))
            return F.when(sign.startswith("\\"), macro).otherwise((sign != "") & F.contains(cell, sign))

        graded = F.transform(F.map_entries(legend), lambda e: F.when(hit(F.trim(e["key"])), grade_from_meaning(e["value"])))
        out = F.coalesce(F.get(F.filter(graded, lambda g: g.isNotNull()), F.lit(0)), out)
    return F.when(cell == "", "empty").otherwise(out)


def repair_dingbats(c: Column) -> Column:
    """Control characters that are the low byte of a mark, as a PDF without a character map has them, as that mark."""
    marks = [m for m in PDF_YES + PDF_NO + PDF_PARTIAL if 0 <= ord(m) - 0x2700 < 0x20]
    return F.translate(c, "".join(chr(ord(m) - 0x2700) for m in marks), "".join(marks))


def normalize_pdf_mark(raw: Column) -> Column:
    """yes, no, partial, empty or value of a cell of a PDF's text."""
    cell = F.trim(repair_dingbats(F.coalesce(raw, F.lit(""))))
    low = F.lower(squeeze(cell))
    sign = lambda chars: cell.rlike(f"[{chars}]")
    out = F.when(sign(PDF_YES), "yes").when(sign(PDF_NO), "no").when(sign(PDF_PARTIAL), "partial")
    return F.when(cell == "", "empty").otherwise(F.coalesce(out, _words(low, PDF_PARTIAL_WORDS, PDF_YES_WORDS, PDF_NO_WORDS), F.lit("value")))


def column_kinds(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Kind of each column (keys) of long cells (raw, mark): empty, mark, numeric, categorical or text.

    Cells whose mark is empty don't count. Shares of marks are taken over the others, shares of numbers over those with text;
    marks and short values (25 characters) together make a column categorical if its short values are few different ones.
    """
    text = strip_cell(F.col("raw"))
    some, short = F.col("mark") != "empty", (F.col("text") != "") & (F.length("text") <= 25)
    c = cells.withColumn("text", text).groupBy(*keys).agg(
        F.count_if(some).alias("n"), F.count_if(F.col("mark").isin(*MARKS)).alias("marks"), F.count_if(F.col("text") != "").alias("texts"), F.count_if((F.col("text") != "") & F.col("text").rlike(NUMERIC)).alias("numbers"),
        F.count_if(short).alias("shorts"), F.count_distinct(F.when(short, F.lower("text"))).alias("different"),
    )
    kind = (
        F.when(F.col("n") < 2, "empty")
        .when(F.col("marks") >= 0.6 * F.col("n"), "mark")
        .when((F.col("texts") > 0) & (F.col("numbers") >= 0.6 * F.col("texts")), "numeric")
        .when((F.col("shorts") > 0) & (F.col("different") <= F.greatest(F.lit(2), F.floor(0.6 * F.col("n")))) & (F.col("marks") + F.col("shorts") >= 0.6 * F.col("n")), "categorical")
        .otherwise("text")
    )
    return c.withColumn("kind", kind)


def comparison_tables(cells: DataFrame, keys: list[str], row: str, col: str) -> DataFrame:
    """Tables (keys) that compare, of long cells (raw, mark, row, col): two body rows, and two mark columns with marks in 35 % of the whole
    body, or two categorical columns and at most one numeric one. Columns of labels must not be among the cells."""
    kinds = column_kinds(cells, [*keys, col])
    of = {k: F.count_if(F.col("kind") == k).alias(k) for k in ("mark", "categorical", "numeric")}
    columns = kinds.groupBy(*keys).agg(*of.values(), F.sum("marks").alias("filled"), F.count("*").alias("width"))
    rows = cells.select(*keys, row).distinct().groupBy(*keys).agg(F.count("*").alias("body"))
    good = ((F.col("mark") >= 2) & (F.col("filled") >= 0.35 * F.col("body") * F.col("width"))) | ((F.col("categorical") >= 2) & (F.col("numeric") <= 1))
    return columns.join(rows, keys).withColumn("comparison", good & (F.col("body") >= 2))


def dimension_kinds(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Value space of each column (keys) of long cells (raw, mark): binary, graded, numeric or categorical, by the marks in it."""
    number = F.count_if(strip_cell(F.col("raw")).rlike(r"^[0-9.,]+\s*[KMBG%]?$"))
    c = cells.groupBy(*keys).agg(F.count_if(F.col("mark") == "value").alias("values"), F.count_if(F.col("mark") == "partial").alias("partials"), number.alias("numbers"))
    kind = F.when(F.col("values") > 0, F.when(F.col("numbers") >= 2, "numeric").otherwise("categorical")).when(F.col("partials") > 0, "graded").otherwise("binary")
    return c.select(*keys, kind.alias("kind"))


def checkable(gloss: Column, kind: Column) -> Column:
    """Whether a column can be judged: the paper defines it and its cells are marks or few values."""
    return (gloss != "header_only") & kind.isin("binary", "graded", "categorical")


def verdict_tally(findings: DataFrame, keys: list[str]) -> DataFrame:
    """How many cells of each table (keys) have each verdict."""
    return findings.groupBy(*keys, "verdict").agg(F.count("*").alias("n"))


def clean_property(c: Column) -> Column:
    """A column's definition without references to figures, tables and sections, and without the preposition that introduced one at the end."""
    floats = r"(?:Figure|Fig\.|Table|Tab\.|Section|Sec\.|Eq\.|Equation|Appendix)"
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^()]{0,90}" + floats + r"[^()]{0,90}\)|\\(?:ref|cref|Cref|autoref|eqref|label|cite\w*)\s*\{[^}]*\}|\b(?:Figure|Fig\.|Table|Tab\.|Section|Sec\.|Appendix)~?\s*\\?\w*\{?[\w:.-]*\}?", " ")
    c = strip_chars(F.regexp_replace(F.regexp_replace(c, r"\s*\(\s*\)", ""), r"\s+", " "), " .,;:")
    tail = r"(?i)[,;]?\s*(?:as\s+)?(?:reported|shown|listed|described|summari[sz]ed|illustrated|given)?\s*(?:in|on|by|from|of|see)\s*$"
    return strip_chars(F.regexp_replace(c, tail, ""), " .,;:")


def drop_rationale(gloss: Column) -> Column:
    """A definition without sentences in which the authors say what they chose, unless under 20 characters would be left."""
    chose = r"(?i)^\s*(?:thus|hence|therefore|so|accordingly|as\s+such|for\s+this\s+reason)?[,\s]*(?:we|our\s+\w+)\s+(?:prefer|choose|opt\s+for|adopt|use|favou?r|rely\s+on)\b"
    kept = F.filter(F.split(F.coalesce(gloss, F.lit("")), r"(?<=[.!?])\s+(?=[A-Z\\(])"), lambda s: ~F.trim(s).rlike(chose))
    out = strip_chars(squeeze(F.array_join(kept, " ")), " ,;")
    return F.when(F.length(out) >= 20, out).otherwise(F.coalesce(gloss, F.lit("")))


def header_variants(header: Column) -> Column:
    """Spellings of a column header to look for, in lower case, the longest first: hyphens as spaces or left out, spaces as hyphens,
    as written, 'aware' with 'awareness', '-ive' with '-ion'."""
    raw = F.lower(squeeze(F.coalesce(header, F.lit(""))))
    base = squeeze(F.regexp_replace(raw, r"[^\p{L}\p{N}_\s-]", " "))
    sub = lambda old, new: F.replace(base, F.lit(old), F.lit(new))
    forms = F.array_compact(F.array(base, sub("-", " "), sub("-", ""), sub(" ", "-"), F.when(raw != "", raw)))
    more = F.flatten(F.transform(forms, lambda f: F.array_compact(F.array(F.when(f.endswith("aware"), F.concat(f, F.lit("ness"))), F.when(f.endswith("ive"), F.concat(F.substring(f, F.lit(1), F.length(f) - 3), F.lit("ion")))))))
    kept = F.filter(F.array_distinct(F.concat(forms, more)), lambda f: F.length(f) >= 2)
    ordered = F.array_sort(F.transform(kept, lambda f: F.struct((-F.length(f)).alias("n"), f.alias("f"))))
    return F.when(base == "", F.array().cast("array<string>")).otherwise(F.transform(ordered, lambda x: x["f"]))


def decide(mark: Column, answer: Column) -> Column:
    """The verdict on a cell from its mark and the judge's answer."""
    claims = mark.isin("yes", "partial")
    return (
        F.when(claims & (answer == "has"), "supported")
        .when(claims & (answer == "lacks"), "contradicted")
        .when(claims & (answer == "absent"), "may_not_support")
        .when((mark == "no") & (answer == "has"), "contradicted")
        .when((mark == "no") & answer.isin("lacks", "absent"), "supported")
        .otherwise("unverifiable")
    )


def skip_reason(is_self: Column, n_cites: Column, mark: Column, gloss: Column, kind: Column) -> Column:
    """Why a cell is not judged, first reason first; null if it is."""
    return (
        F.when(is_self, "self row")
        .when(n_cites == 0, "no citation")
        .when(~mark.isin("yes", "no", "partial"), "not a mark")
        .when(gloss == "header_only", "undefined")
        .when(~kind.isin("binary", "graded", "categorical"), "descriptive")
    )


def downgrade(verdict: Column, mark: Column, kind: Column, gloss: Column) -> Column:
    """A contradiction of a column that the paper never defined is undefined."""
    wrong = verdict == "contradicted"
    return F.when(wrong & (mark == "no") & (kind == "categorical"), "undefined").when(wrong & gloss.isin("header_only", "none"), "undefined").otherwise(verdict)


def asymmetry(findings: DataFrame) -> DataFrame:
    """Per table: whether the own row is all yes, and how the others fared."""
    others = ~F.col("is_self")
    return findings.groupBy("table_id").agg(
        F.coalesce(F.bool_and(F.when(F.col("is_self"), F.col("mark") == "yes")), F.lit(False)).alias("self_all_yes"),
        F.count_if(others & (F.col("verdict") == "contradicted")).alias("contradicted"), F.count_if(others & (F.col("verdict") == "may_not_support")).alias("unbacked"),
        F.count_if(others & (F.col("verdict") == "contradicted") & (F.col("mark") == "no")).alias("understated"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("verdict") == "undefined", F.col("header")))), ",").alias("undefined_headers"),
    )
