"""Loose answers of a verifying model as values of a record, the evidence of a verdict, and rows that could not be judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.text import clip, squeeze
from refloom.operators.severity import derive_severity

#: How much of a passage is quoted, and what is noted when support rests on nothing.
QUOTED = 600
UNGROUNDED = "abstained: no abstract/introduction was retrieved to ground support"
EVIDENCE = "array<struct<kind: string, source: string, quote: string, url: string>>"


def _typed(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _items(value: Column) -> Column:
    """The items of a JSON list, or the value itself as the only one."""
    listed = F.try_variant_get(value, "$", "array<variant>")
    return F.when(_typed(value, "ARRAY"), listed).otherwise(F.array(value))


def _said(value: Column, path: str = "$") -> Column:
    return F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))


def _first(*texts: Column) -> Column:
    """The first text that isn't empty, or an empty one."""
    out = F.lit("")
    for t in reversed(texts):
        out = F.when(t != "", t).otherwise(out)
    return out


def text_of(raw: Column) -> Column:
    """The text of a JSON value: a string, an object's text, raw or claim, or the value as written; null and no JSON give an empty one."""
    v = F.try_parse_json(raw)
    named = _first(_said(v, "$.text"), _said(v, "$.raw"), _said(v, "$.claim"))
    return F.when(_typed(v, "OBJECT"), named).otherwise(_said(v))


def issue_list(raw: Column) -> Column:
    """The stripped non-empty texts of a JSON list or string; nothing of other values."""
    v = F.try_parse_json(raw)
    texts = F.filter(F.transform(_items(v), lambda x: F.trim(_said(x))), lambda t: t != "")
    return F.when(_typed(v, "ARRAY") | _typed(v, "STRING"), texts).otherwise(F.array().cast("array<string>"))


def evidence_list(raw: Column) -> Column:
    """EVIDENCE of a JSON list or single value: objects by field, strings as the model's own snippets; other items are left out."""
    v = F.try_parse_json(raw)

    def row(x: Column) -> Column:
        quote = F.substring(_first(_said(x, "$.quote"), _said(x, "$.text")), 1, QUOTED)
        url = F.when(_typed(F.try_variant_get(x, "$.url", "variant"), "STRING"), F.try_variant_get(x, "$.url", "string"))
        known = F.struct(_first(_said(x, "$.kind"), F.lit("snippet")).alias("kind"), _first(_said(x, "$.source"), F.lit("model")).alias("source"), quote.alias("quote"), url.alias("url"))
        plain = F.struct(F.lit("snippet").alias("kind"), F.lit("model").alias("source"), F.substring(F.trim(_said(x)), 1, QUOTED).alias("quote"), F.lit(None).cast("string").alias("url"))
        return F.when(_typed(x, "OBJECT"), known).otherwise(plain)

    wanted = F.filter(_items(v), lambda x: _typed(x, "OBJECT") | (_typed(x, "STRING") & (F.trim(_said(x)) != "")))
    return F.coalesce(F.transform(wanted, row), F.array()).cast(EVIDENCE)


def assembled(abstract: Column, introduction: Column) -> Column:
    """text and level of what a judge reads: the abstract (L0), with the introduction if there is one (L1)."""
    plain, intro = F.trim(F.coalesce(abstract, F.lit(""))), F.coalesce(introduction, F.lit(""))
    both = F.ltrim(F.concat(plain, F.lit("\n\n[Introduction]\n"), intro), F.lit(" \n"))
    return F.when(intro != "", F.struct(both.alias("text"), F.lit("L1").alias("level"))).otherwise(F.struct(plain.alias("text"), F.lit("L0").alias("level")))


def origin(work: Column) -> Column:
    """Where a work (doi, arxiv_id, url, source) was found, best first."""
    parts = [F.coalesce(work[c], F.lit("")) for c in ("doi", "arxiv_id", "url", "source")]
    return _first(*parts, F.lit("structured"))


def _evidence(kind: str, source: Column, quote: Column, url: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), source.alias("source"), quote.alias("quote"), url.alias("url"))


def with_abstract(items: Column, work: Column, text: Column) -> Column:
    """items with the text a verdict was judged by, unless it is empty or there already."""
    quote = F.substring(squeeze(F.coalesce(text, F.lit(""))), 1, QUOTED)
    added = F.array(_evidence("abstract", origin(work), quote, work["url"])).cast(EVIDENCE)
    have = F.coalesce(items, F.array().cast(EVIDENCE))
    known = F.exists(have, lambda e: (e["kind"] == "abstract") & (e["source"] == origin(work)) & (e["quote"] == quote))
    return F.when((quote == "") | known, have).otherwise(F.concat(have, added))


def abstract_row(work: Column, abstract: Column) -> Column:
    """The evidence of a verdict by the abstract."""
    return _evidence("abstract", origin(work), clip(squeeze(F.coalesce(abstract, F.lit(""))), QUOTED), work["url"])


def full_text_row(work: Column, chunks: Column, channel: Column, url: Column) -> Column:
    """The evidence of a verdict by chunks (heading, text), best first, of a full text from channel."""
    heading = _first(F.coalesce(F.get(chunks, F.lit(0))["heading"], F.lit("")), F.lit("full text"))
    by = _first(F.coalesce(channel, F.lit("")), F.coalesce(work["arxiv_id"], F.lit("")), F.coalesce(work["url"], F.lit("")), F.lit("arxiv"))
    quote = clip(squeeze(F.array_join(F.transform(chunks, lambda c: c["text"]), "  ")), QUOTED)
    return _evidence("full_text", F.concat(by, F.lit(" §"), heading), quote, F.coalesce(F.when(url != "", url), work["url"]))


def asked_reference(cited: Column) -> Column:
    """What a model is told of a reference (raw, authors, title, year, venue, arxiv_id, doi): its raw text or else its fields, and ids that the text doesn't name."""
    text = lambda c: F.coalesce(cited[c].cast("string"), F.lit(""))
    raw = F.trim(text("raw"))
    people = F.array_join(F.filter(F.coalesce(cited["authors"], F.array().cast("array<string>")), lambda a: a != ""), ", ")
    fields = F.when(raw != "", F.array(raw)).otherwise(F.array(people, text("title"), text("year"), text("venue")))
    arxiv = F.when((text("arxiv_id") != "") & ~F.contains(F.lower(raw), F.lit("arxiv")), F.concat(F.lit("arXiv:"), text("arxiv_id"))).otherwise("")
    doi = F.when((text("doi") != "") & ~F.contains(F.lower(raw), F.lower(text("doi"))), F.concat(F.lit("doi:"), text("doi"))).otherwise("")
    return F.trim(F.array_join(F.filter(F.concat(fields, F.array(arxiv, doi)), lambda p: p != ""), " "))


def grounded(records: DataFrame, retrieved: Column) -> DataFrame:
    """records (supports, notes) where support without retrieved text becomes an abstention that says so."""
    unfounded = (F.col("supports") == "supports") & ~retrieved
    noted = F.when(F.coalesce("notes", F.lit("")) != "", F.concat("notes", F.lit("\n"), F.lit(UNGROUNDED))).otherwise(UNGROUNDED)
    return records.withColumns({"supports": F.when(unfounded, "inconclusive").otherwise(F.col("supports")), "notes": F.when(unfounded, noted).otherwise(F.col("notes"))})


def degraded(records: DataFrame, paper_id: Column, reason: Column) -> DataFrame:
    """records (paper_id, exists, priority, error) that no judge answered for: inconclusive, with the reason added to their errors."""
    before = F.coalesce("error", F.lit(""))
    return records.withColumns(
        {
            "paper_id": stamped(F.col("paper_id"), paper_id),
            "supports": F.lit("inconclusive"),
            "model_tier": F.lit("judge"),
            "error": F.when(before != "", F.concat(before, F.lit("; "), reason)).otherwise(reason),
            "severity": derive_severity(F.col("exists"), F.lit("inconclusive"), F.col("priority")),
        }
    )


def stamped(own: Column, run: Column) -> Column:
    """A record's paper, or its run's where it names none."""
    return F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(run)


def with_model_evidence(items: Column, raw: Column) -> Column:
    """items, then what a model quoted."""
    return F.concat(F.coalesce(items, F.array().cast(EVIDENCE)), evidence_list(raw))
