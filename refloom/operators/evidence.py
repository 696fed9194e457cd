"""Evidence: sections in scope, chunks, the best chunks of a claim, escalation of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.text import squeeze

#: Headings that are always read, headings read for experimental claims, words that make a claim one, and words that say nothing.
DEFAULT_SECTIONS = ("abstract", "introduction", "conclusion", "discussion", "summary")
EXPERIMENTAL_SECTIONS = ("method", "approach", "model", "architecture", "experiment", "evaluation", "result", "dataset", "data", "setup", "implementation", "analysis", "ablation")
EXPERIMENTAL_HINTS = (
    "dataset", "datasets", "benchmark", "accuracy", "f1", "score", "metric", "metrics", "outperform", "outperforms", "sota", "state-of-the-art", "experiment", "experiments",
    "ablation", "trained", "training", "fine-tuned", "parameters", "method", "approach", "result", "results", "baseline", "baselines", "evaluation", "evaluated", "precision",
    "recall", "epochs", "hyperparameter", "architecture",
)
STOP = (
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "by", "as", "is", "are", "was", "were", "be", "been", "being", "that", "this", "these", "those",
    "it", "its", "from", "at", "into", "using", "use", "used", "can", "could", "may", "we", "our", "their", "they", "which", "such", "than", "then", "also", "but",
)
#: Cues of an obligatory citation. Cues of a helpful one change nothing: without an obligatory cue a citation is helpful.
OBLIGATORY_CUES = (
    "we use", "we adopt", "we extend", "we build on", "based on", "baseline", "compared to", "compared with", "outperform", "state-of-the-art", "we follow", "dataset", "benchmark",
    "showed that", "demonstrated that", "proved", "as shown in", "introduced by", "proposed by",
)
#: Least overlap of a claim with an abstract that is on its topic, characters of a chunk, chunks of a claim, works that the judge reads in full.
OFF_TOPIC, CHUNK_CHARS, TOP_CHUNKS, ESCALATED_WORKS = 0.12, 600, 3, 8


def words(c: Column) -> Column:
    """Different words of three characters and more, in lower case, without those that say nothing."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda t: (F.length(t) > 2) & ~t.isin(*STOP)))


def names_work(text: Column, title: Column, head: int = 6000) -> Column:
    """Whether a fetched text is the work of a title: its head has the title's words of four letters on (all words where there are none), but for one of seven and more."""
    every = words(title)
    long = F.filter(every, lambda t: F.length(t) > 3)
    wanted = F.when(F.size(long) > 0, long).otherwise(every)
    missing = F.size(F.array_except(wanted, words(F.substring(text, 1, head))))
    return (F.size(wanted) > 0) & (missing <= F.when(F.size(wanted) >= 7, 1).otherwise(0))


def experimental(claim_words: Column) -> Column:
    """Whether a claim is about methods, data or results."""
    return F.arrays_overlap(claim_words, F.array(*map(F.lit, EXPERIMENTAL_HINTS)))


def in_scope(heading: Column, claim_is_experimental: Column) -> Column:
    key = F.regexp_replace(F.lower(F.coalesce(heading, F.lit(""))), "[^a-z]+", " ")
    has = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(key, n))
    return F.when(F.trim(key) == "", True).when(has(DEFAULT_SECTIONS), True).when(has(EXPERIMENTAL_SECTIONS), claim_is_experimental).otherwise(True)


def chunks(text: Column, most: int = CHUNK_CHARS) -> Column:
    """Paragraphs, inner whitespace collapsed; a longer one is cut at sentence ends so that pieces have at most ``most`` characters."""

    def cut(p: Column) -> Column:
        sentences = F.split(p, r"(?<=[.!?])\s+")
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def step(acc: Column, s: Column) -> Column:
            full = (F.length(acc["open"]) > 0) & (F.length(acc["open"]) + F.length(s) + 1 > most)
            return F.struct(F.when(full, F.concat(acc["done"], F.array(F.trim(acc["open"])))).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(F.trim(F.concat(acc["open"], F.lit(" "), s))).alias("open"))

        return F.aggregate(sentences, start, step, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(F.trim(acc["open"])))).otherwise(acc["done"]))

    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), squeeze), lambda p: p != "")
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(cut(p))))


def heading_like(chunk: Column) -> Column:
    """Whether a chunk names a topic and says nothing: up to 12 words, no sentence end, and a number, a closing colon or title case."""
    text = F.trim(F.coalesce(chunk, F.lit("")))
    long = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z][\w'-]*"), F.lit(0)), lambda w: F.length(w) > 3)
    titled = (F.size(long) >= 2) & (F.size(F.filter(long, lambda w: w.rlike("^[A-Z]"))) >= 0.6 * F.size(long))
    said = (F.size(F.split(text, r"\s+")) > 12) | text.rlike(r"[.!?][\"'\u201d\u2019)\]]*(?:\s|$)")
    return (text == "") | (~said & (text.rlike(r"^\(?(?:[A-Z]|[0-9]+)(?:\.[0-9]+)*\)?[.\s]") | text.endswith(":") | titled))


def overlap(claim_words: Column, other_words: Column) -> Column:
    """Share of a claim's words that the other text has; 0 if either has none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(claim_words, other_words)), F.size(claim_words)), F.lit(0.0))


def top_chunks(claims: DataFrame, passages: DataFrame, k: int = TOP_CHUNKS, most: int = CHUNK_CHARS) -> DataFrame:
    """The k chunks of the cited paper that cover most of a claim's words, ties and chunks without any in document order.

    claims: claim_id, paper, claim; passages: paper, section_no, heading, text. The join is on the paper; of a (claim, paper) pair
    only the best k leave the map side of the aggregation, so a paper with many claims or chunks is not held anywhere.
    """
    c = claims.select("claim_id", "paper", words(F.col("claim")).alias("cw")).withColumn("exp", F.coalesce(experimental(F.col("cw")), F.lit(False)))
    p = passages.select("paper", "section_no", "heading", F.posexplode(chunks(F.col("text"), most)).alias("chunk_no", "chunk")).filter(~heading_like(F.col("chunk")))
    scoped = c.join(p.withColumn("pw", words(F.col("chunk"))), "paper").filter(in_scope(F.col("heading"), F.col("exp")))
    return _ranked(scoped, k).select("claim_id", "paper", "place", "heading", "chunk", "overlap")


def best_chunks(claims: DataFrame, lines: DataFrame, k: int = TOP_CHUNKS) -> DataFrame:
    """The same ranking over ready words: claims: claim_id, paper, cw; lines: paper, section_no, chunk_no, pw and any more columns."""
    return _ranked(claims.join(lines, "paper"), k).drop("cw", "pw")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The best k of each claim and paper; Spark keeps no more of them on the map side of the window already."""
    scored = pairs.withColumn("overlap", overlap(F.col("cw"), F.col("pw")))
    place = F.row_number().over(Window.partitionBy("claim_id", "paper").orderBy(F.desc("overlap"), "section_no", "chunk_no"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def format_chunks(chosen: Column) -> Column:
    """Chunks (heading, chunk) as one text: '[heading]' above each that has one, equal chunks once, a blank line between."""
    plain = F.filter(F.transform(chosen, lambda x: F.struct(F.trim(F.coalesce(x["heading"], F.lit(""))).alias("heading"), F.trim(F.coalesce(x["chunk"], F.lit(""))).alias("chunk"))), lambda x: x["chunk"] != "")
    first = F.filter(plain, lambda x, i: ~F.exists(F.slice(plain, F.lit(1), i), lambda y: y["chunk"] == x["chunk"]))
    return F.array_join(F.transform(first, lambda x: F.when(x["heading"] != "", F.concat(F.lit("["), x["heading"], F.lit("]\n"), x["chunk"])).otherwise(x["chunk"])), "\n\n")


def output_cap(items: Column) -> Column:
    """Tokens that an answer on so many items may have."""
    return F.least(F.lit(8192), F.greatest(F.lit(512), 96 * items))


def escalates(verdict: Column, claim_is_experimental: Column) -> Column:
    """Second stage: a verdict from the abstract that full text may change."""
    return verdict.isin("inconclusive", "does_not") | ((verdict == "partial") & claim_is_experimental)


def off_topic(claim_words: Column, abstract: Column) -> Column:
    """Whether an abstract shares almost nothing with a claim; never without an abstract or words in the claim."""
    return (F.trim(F.coalesce(abstract, F.lit(""))) != "") & (F.size(claim_words) > 0) & (overlap(claim_words, words(abstract)) < OFF_TOPIC)


def judge_escalates(verdict: Column, claim: Column, abstract: Column) -> Column:
    """Inside the judge: unsettled claims on details whose abstract is not off topic."""
    w = words(claim)
    return verdict.isin("partial", "inconclusive") & F.coalesce(experimental(w), F.lit(False)) & ~off_topic(w, abstract)


def escalated_works(pending: DataFrame, cap: int = ESCALATED_WORKS) -> DataFrame:
    """The works of each paper (paper_id, cite_key, ord: a row per pending claim) with the most pending claims, the first of equals."""
    counted = pending.groupBy("paper_id", "cite_key").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("n"), "ord"))
    return counted.withColumn("place", place).filter(F.col("place") <= cap).select("paper_id", "cite_key", "n", "place")


def priority(text: Column, cues: tuple[str, ...] = OBLIGATORY_CUES) -> Column:
    """obligatory if a cue stands in the text, in any case, else helpful."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = F.lit(False)
    for cue in cues:
        held = held | F.contains(low, F.lit(cue))
    return F.when(held, "obligatory").otherwise("helpful")


def fan_out(stubs: DataFrame, resolved: DataFrame) -> DataFrame:
    """One resolution per distinct reference, copied to all its sites: resolved has dedup_key."""
    key = F.coalesce(F.nullif("cite_key", F.lit("")), F.nullif(F.lower("raw"), F.lit("")), F.col("claim_id"))
    return stubs.withColumn("dedup_key", key).join(resolved, "dedup_key", "left")


def overlay(records: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Judge verdicts over records: a support without evidence is inconclusive; confidence is clamped to [0, 1]."""
    v = verdicts.select(*key, F.col("supports").alias("v_supports"), F.col("confidence").alias("v_confidence"), F.size(F.coalesce("evidence", F.array().cast("array<string>"))).alias("n_evidence"))
    joined = records.join(v, key, "left")
    supports = F.when((F.col("v_supports") == "supports") & (F.col("n_evidence") == 0), "inconclusive").otherwise(F.coalesce("v_supports", "supports"))
    return joined.withColumns({"supports": supports, "confidence": F.coalesce(F.when(F.col("v_confidence").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v_confidence")))), F.col("confidence"))}).drop("v_supports", "v_confidence", "n_evidence")
