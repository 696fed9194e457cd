"""Reports: Markdown texts of the records of each paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.names import citation_cell
from refloom.functions.text import cell_escape
from refloom.operators.severity import inconclusive_reason

#: Fixed format: the columns of the main table and of the appendix, labels, and the texts of a report.
HEADER = ("#", "Citation (authors, title, year)", "Cited where (the claim)", "Exists?", "Match notes", "Supports claim?", "Explanation")
SKIPPED_HEADER = ("#", "Citation (authors, title, year)", "Cited where", "Exists?", "Match notes")
SUPPORTS = {"supports": "Relevant", "partial": "Partly Relevant", "does_not": "Irrelevant", "inconclusive": "Inconclusive", "skipped": "Skipped"}
EXISTS = ("yes", "no", "unresolved")
REASONS = {
    "unresolved": "reference unresolved — no verified paper to judge against",
    "fulltext": "full text checked — the specific claim still wasn't confirmed",
    "abstract": "abstract is on-topic, but the specific claim isn't stated in it",
}
ABSTAINED = '*"Inconclusive" = relevance could not be determined (an abstention, not a refutation) — by cause:*'
SKIPPED_NOTE = (
    " table/figure citation site(s): skipped (not a prose claim, no relevance verdict) — excluded from the distribution above; see the appendix.*",
    " citations sit in a results table or figure, not a prose claim, so relevance is not judged (existence/metadata still checked). Not counted in the Relevant / Partly Relevant / Irrelevant / Inconclusive distribution.",
)


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))


def _table(header: tuple[str, ...], rule: str = " --- ") -> list[Column]:
    return [F.lit("| " + " | ".join(header) + " |"), F.lit("|" + f"{rule}|" * len(header))]


def cite_marker(cite_key: Column) -> Column:
    """'[6]' for ref-6, else the key in brackets."""
    return F.concat(F.lit("["), F.regexp_replace(cite_key, r"^ref-([0-9]+)$", "$1"), F.lit("]"))


def claim_cell(section: Column, text: Column, marker: Column | None = None) -> Column:
    """'[6] [Section] text': a marker where one is given, the section where there is one."""
    body = F.when(F.length(section) > 0, F.trim(F.concat(F.lit("["), section, F.lit("] "), _some(text)))).otherwise(_some(text))
    return body if marker is None else F.when(marker.isNotNull(), F.trim(F.concat(marker, F.lit(" "), body))).otherwise(body)


def exists_label(exists: Column) -> Column:
    return F.when(exists.isin(*EXISTS), exists).otherwise("unresolved")


def supports_label(supports: Column) -> Column:
    out = F.lit(SUPPORTS["inconclusive"])
    for token, label in SUPPORTS.items():
        out = F.when(supports == token, label).otherwise(out)
    return out


def numbered(records: DataFrame) -> DataFrame:
    """Rows by first appearance of their key in the paper, then in order, numbered per paper as no."""
    first = F.min("ord").over(Window.partitionBy("paper_id", "cite_key"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("first", "ord"))
    return records.withColumn("first", first).withColumn("no", place.cast("long")).drop("first")


def shared_span(records: DataFrame) -> DataFrame:
    """Adds shared: whether another row of the paper has the same span."""
    return records.withColumn("shared", F.col("span").isNotNull() & (F.count("*").over(Window.partitionBy("paper_id", "span")) > 1))


def _lines(rows: DataFrame, line: Column) -> DataFrame:
    """The lines of each paper in order, as one text. A report is one text per paper, so its lines meet."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("paper_id").agg(F.array_join(ordered, "\n").alias("lines"), F.count("*").alias("n"))


def _cells() -> dict[str, Column]:
    return {
        "no": F.col("no").cast("string"), "citation": cell_escape(citation_cell(F.col("authors"), F.col("title"), F.col("year"), F.col("raw"), F.col("cite_key"))),
        "exists": exists_label(F.col("exists")), "issues": cell_escape(F.array_join("issues", "; ")),
        "explanation": cell_escape(F.coalesce(F.nullif("notes", F.lit("")), "error", F.lit(""))),
    }


def scope_line(n: Column, paper_id: Column) -> Column:
    where = F.when(F.length(paper_id) > 0, F.concat(F.lit(" for `"), paper_id, F.lit("`"))).otherwise("")
    return F.concat(F.lit("**Scope:** "), n.cast("string"), F.lit(" (claim, citation) "), F.when(n == 1, "pair").otherwise("pairs"), where, F.lit("."))


def table(records: DataFrame) -> DataFrame:
    """paper_id, table: the scope line and the main table, without skipped rows; papers with none have none.

    records: paper_id, cite_key, ord, claim, section, span, authors, title, year, raw, exists, issues, supports, notes, error.
    """
    rows = numbered(shared_span(records.filter("supports <> 'skipped'")))
    c, marker = _cells(), F.when(F.col("shared"), cite_marker(F.col("cite_key")))
    line = _row([c["no"], c["citation"], cell_escape(claim_cell(F.col("section"), F.col("claim"), marker)), c["exists"], c["issues"], supports_label(F.col("supports")), c["explanation"]])
    return _lines(rows, line).select("paper_id", F.concat_ws("\n", scope_line(F.col("n"), F.col("paper_id")), F.lit(""), *_table(HEADER), "lines").alias("table"))


def skipped(records: DataFrame) -> DataFrame:
    """paper_id, skipped: the appendix of skipped rows, of papers that have some."""
    c = _cells()
    line = _row([c["no"], c["citation"], cell_escape(claim_cell(F.col("section"), F.col("claim"))), c["exists"], c["issues"]])
    told = F.concat(F.lit("These **"), F.col("n").cast("string"), F.lit("**" + SKIPPED_NOTE[1]))
    lines = _lines(numbered(records.filter("supports = 'skipped'")), line)
    return lines.select("paper_id", F.concat_ws("\n", F.lit("## Skipped — table/figure citation sites"), F.lit(""), told, F.lit(""), *_table(SKIPPED_HEADER, "---"), "lines").alias("skipped"))


def summary(records: DataFrame) -> DataFrame:
    """paper_id, summary: counts by reference and by pair, why verdicts are open, and what to fix. records as for table(), with severity."""
    works = records.groupBy("paper_id", "cite_key").agg(F.min_by("exists", "ord").alias("e"), F.bool_or(F.size("issues") > 0).alias("m"))
    by_work = works.groupBy("paper_id").agg(F.count("*").alias("refs"), F.count_if("m").alias("meta"), *[F.count_if(F.col("e") == x).alias(f"e_{x}") for x in EXISTS])
    reason = F.when(F.col("supports") == "inconclusive", inconclusive_reason(F.col("exists"), F.col("notes")))
    flat = cell_escape(F.coalesce(F.nullif("notes", F.lit("")), "error", F.lit("")))
    fix = F.concat(F.lit("- `"), "cite_key", F.lit("` — "), _cells_citation(), F.lit(": high"), F.when(flat != "", F.concat(F.lit(" — "), flat)).otherwise(""))
    by_row = records.groupBy("paper_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "high").alias("high"), *[F.count_if(F.col("supports") == x).alias(f"s_{x}") for x in SUPPORTS], *[F.count_if(reason == x).alias(f"r_{x}") for x in REASONS],
        F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == "high", F.struct("ord", fix.alias("fix"))))), lambda x: x["fix"]).alias("fixes"),
    )
    t = lambda x: F.col(x).cast("string")

    def pair(label: str, count: Column, token: str) -> Column:
        return F.concat(F.lit(f"| {label} | "), count, F.lit(f" |  | {SUPPORTS[token]} | "), t(f"s_{token}"), F.lit(" |"))

    lines = [
        F.lit("## Summary"), F.lit(""),
        F.concat(F.lit("**"), t("n"), F.lit("** (claim, citation) pairs over **"), t("refs"), F.lit("** unique references · **"), t("meta"), F.lit("** with metadata issues · **"), t("high"), F.lit("** high-severity.")), F.lit(""),
        F.lit("| References — Exists? | n |  | Claims — Relevance | n |"), F.lit("|:---|---:|:-:|:---|---:|"),
        pair("yes", t("e_yes"), "supports"), pair("unresolved", t("e_unresolved"), "partial"), pair("no (fabricated)", t("e_no"), "does_not"),
        F.concat(F.lit("| **total refs** | **"), t("refs"), F.lit("** |  | "), F.lit(SUPPORTS["inconclusive"]), F.lit(" | "), t("s_inconclusive"), F.lit(" |")),
        F.when(F.col("s_inconclusive") > 0, F.lit("\n" + ABSTAINED)), *[F.when(F.col(f"r_{k}") > 0, F.concat(F.lit(f"- {v}: **"), t(f"r_{k}"), F.lit("**"))) for k, v in REASONS.items()],
        F.when(F.col("s_skipped") > 0, F.concat(F.lit("\n*Plus **"), t("s_skipped"), F.lit("**" + SKIPPED_NOTE[0]))),
        F.when(F.col("high") > 0, F.concat_ws("\n", F.lit("\n### Fix before submission"), "fixes")),
    ]
    return by_work.join(by_row, "paper_id").select("paper_id", F.concat_ws("\n", *lines).alias("summary"))


def _cells_citation() -> Column:
    return cell_escape(citation_cell(F.col("authors"), F.col("title"), F.col("year"), F.col("raw"), F.col("cite_key")))


def usage_footer(usage: DataFrame) -> DataFrame:
    """paper_id, footer: tokens, cost and time of a run. usage: paper_id, backend, model, n_in, n_out, cost, turns, tool_calls, seconds, errors."""
    told = lambda c, n=0: F.format_number(c, n)
    plain = lambda c, n: F.replace(F.format_number(c, n), F.lit(","), F.lit(""))
    model = F.when(F.length("model") > 0, F.concat(F.lit(" · model `"), "model", F.lit("`"))).otherwise("")
    degraded = F.transform("errors", lambda e: F.concat(F.lit("- "), cell_escape(e)))
    lines = [
        F.lit("## Run"), F.lit(""), F.concat(F.lit("- Backend: `"), "backend", F.lit("`"), model),
        F.concat(F.lit("- Tokens: in "), told(F.col("n_in")), F.lit(" / out "), told(F.col("n_out")), F.lit(" (total "), told(F.col("n_in") + F.col("n_out")), F.lit(")")),
        F.concat(F.lit("- Cost: $"), plain(F.col("cost"), 4), F.lit(" · turns "), F.col("turns").cast("string"), F.lit(" · tool calls "), F.col("tool_calls").cast("string")),
        F.when(F.col("seconds") != 0, F.concat(F.lit("- Wall time: "), plain(F.col("seconds"), 1), F.lit("s"))),
        F.when(F.size("errors") > 0, F.concat_ws("\n", F.lit("\n### Degraded pairs"), degraded)),
    ]
    return usage.select("paper_id", F.concat_ws("\n", *lines).alias("footer"))


def markdown(records: DataFrame, usage: DataFrame) -> DataFrame:
    """paper_id, report: heading, main table, summary, appendix of skipped rows if there are any, and the run's figures."""
    empty = F.concat_ws("\n", scope_line(F.lit(0), F.lit("")), F.lit(""), *_table(HEADER))
    parts = summary(records).join(table(records), "paper_id", "left").join(skipped(records), "paper_id", "left").join(usage_footer(usage), "paper_id")
    heading = F.concat(F.lit("# Citation verification — `"), "paper_id", F.lit("`"))
    return parts.select("paper_id", F.concat_ws("\n\n", heading, F.coalesce("table", empty), "summary", "skipped", "footer").alias("report"))


def web_summary(records: DataFrame) -> DataFrame:
    """Per paper: refs, pairs, high, and counts by exists (a reference once, its first row) and by support as maps."""
    works = records.groupBy("paper_id", "cite_key").agg(F.min_by("exists", "ord").alias("e"), F.count("*").alias("pairs"), F.count_if(F.col("severity") == "high").alias("high"))
    by_exists = works.groupBy("paper_id", "e").agg(F.count("*").alias("c"), F.sum("pairs").alias("pairs"), F.sum("high").alias("high"))
    left = by_exists.groupBy("paper_id").agg(F.sum("c").alias("refs"), F.sum("pairs").alias("pairs"), F.sum("high").alias("high"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("e", "c")))).alias("exists"))
    by_support = records.groupBy("paper_id", "supports").agg(F.count("*").alias("c"))
    right = by_support.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("supports", "c")))).alias("supports"))
    return left.join(right, "paper_id")


def flag_bucket(exists: Column, severity: Column, supports: Column) -> Column:
    """0 fabricated, 1 high severity, 2 irrelevant, 3 unresolved; 99 is not flagged."""
    return F.when(exists == "no", 0).when(severity == "high", 1).when(supports == "does_not", 2).when(exists == "unresolved", 3).otherwise(99)


def flagged(records: DataFrame) -> DataFrame:
    """Records worth showing, worst first in each paper (place), the first of equal claim and key. records: paper_id, claim_id, cite_key, ord, exists, severity, supports."""
    marked = records.withColumn("bucket", flag_bucket(F.col("exists"), F.col("severity"), F.col("supports"))).filter("bucket < 99")
    first = marked.groupBy("paper_id", "claim_id", "cite_key").agg(F.min(F.struct("bucket", "ord")).alias("f")).select("paper_id", "claim_id", "cite_key", "f.bucket", "f.ord")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy("bucket", "ord")).cast("long"))


def display_cap(listed: DataFrame, keys: list[str], place: str = "place", cap: int = 6) -> DataFrame:
    """The first rows of each list, and how many more it has."""
    more = F.greatest(F.count("*").over(Window.partitionBy(*keys)) - F.lit(cap), F.lit(0))
    return listed.withColumn("more", more).filter(F.col(place) <= cap)


def _degraded() -> Column:
    low = F.transform(F.coalesce("errors", F.array().cast("array<string>")), F.lower)
    has = lambda e, *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(e, w))
    said = F.exists(low, lambda e: has(e, "extract layer unavailable", "extraction failed") | (F.contains(e, F.lit("backend")) & has(e, "unavailable", "failed")))
    stub = (F.col("exists") == "unresolved") & (F.col("cite_key") == "run") & (F.col("claim_id") == "run")
    return ((F.count("*") == 1) & F.bool_and(stub)) | F.bool_or(said)


def outages(records: DataFrame) -> DataFrame:
    """paper_id, outage: whether a whole run degraded. A run that did has one record, with 'run' as its key and claim; or an error that says so.

    records: paper_id, claim_id, cite_key, exists, errors (of the run).
    """
    return records.groupBy("paper_id").agg(_degraded().alias("outage"))


#: The headline of a run in chat, by what was found, and its colours.
HEADLINES = {
    "outage": "⚠️ Couldn't verify — the pipeline degraded (extraction/backend unavailable). Nothing was checked; please try again later.",
    "empty": "📭 No citations were extracted from `{paper}` — the paper may have no reference list, or extraction found none.",
    "fabricated": ("🚨 {k} of {n} sampled citation(s) fabricated / not found", "🚨 {k} fabricated / not-found citation(s)"),
    "high": ("⚠️ {k} of {n} sampled with high-severity issues", "⚠️ {k} high-severity issue(s)"),
    "clean": ("✅ No hallucinations in this sample", "✅ No citation hallucinations detected"),
}


def _filled(template: str, **columns: Column) -> Column:
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), c.cast("string"))
    return out


def run_headlines(records: DataFrame, papers: DataFrame, sample: bool) -> DataFrame:
    """paper_id, n, total (of the run's note of its limit), headline and colour of each paper (paper_id), those without records included. A sample is never green, an outage always red.

    records: paper_id, claim_id, cite_key, exists, supports, severity, errors (of the run).
    """
    note = F.get(F.filter(F.coalesce("errors", F.array().cast("array<string>")), lambda e: e.startswith("limited to first")), F.lit(0))
    counts = records.groupBy("paper_id").agg(
        F.count("*").alias("n"), _degraded().alias("outage"), F.max(F.nullif(F.regexp_extract(note, r"of (\d+) citation pairs", 1), F.lit("")).cast("long")).alias("total"),
        F.count_if(F.col("exists") == "no").alias("fabricated"), F.count_if(F.col("exists") == "unresolved").alias("unresolved"), F.count_if(F.col("supports") == "does_not").alias("unsupported"), F.count_if(F.col("severity") == "high").alias("high"),
    )
    x = papers.select("paper_id").distinct().join(counts, "paper_id", "left").fillna(0, ["n", "fabricated", "unresolved", "unsupported", "high"]).fillna(False, ["outage"])
    pick = lambda k: HEADLINES[k][0 if sample else 1]
    bits = F.concat_ws(", ", F.when(F.col("unsupported") > 0, F.concat("unsupported", F.lit(" not supporting their claim"))), F.when(F.col("unresolved") > 0, F.concat("unresolved", F.lit(" unverifiable"))))
    headline = (
        F.when(F.col("outage"), HEADLINES["outage"])
        .when(F.col("n") == 0, _filled(HEADLINES["empty"], paper=F.col("paper_id")))
        .when(F.col("fabricated") > 0, _filled(pick("fabricated"), k=F.col("fabricated"), n=F.col("n")))
        .when(F.col("high") > 0, _filled(pick("high"), k=F.col("high"), n=F.col("n")))
        .when(bits != "", F.concat(F.lit("🔍 "), bits))
        .otherwise(pick("clean"))
    )
    found = F.when((F.col("n") > 0) & (F.col("fabricated") + F.col("high") > 0), "red").when((F.col("n") == 0) | (bits != ""), "amber").otherwise("green")
    return x.select("paper_id", "n", "total", headline.alias("headline"), F.when(F.col("outage"), "red").when(F.lit(sample), "amber").otherwise(found).alias("colour"))
