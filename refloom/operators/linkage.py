"""Linking references to canonical records: identifiers first, gated fuzzy titles second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.idents import arxiv_stem
from refloom.functions.names import surname_matches
from refloom.functions.similarity import fuzzy_title_score, title_contradiction, title_tokens
from refloom.functions.text import norm_title

#: Least scores with and without an agreeing author or year, and the year window.
GATED, UNGATED, YEARS = 78.0, 95.0, 2
#: Titles looked up singly up to this many hits, and pairs of tokens made of titles of up to this many tokens.
CHEAP, LONG = 1_000, 40


def gate(surnames: Column, ref_tokens: Column, ref_year: Column, year: Column) -> Column:
    """True if authors or year agree; never false, only unknown."""
    present = F.size(F.filter(surnames, lambda s: F.exists(ref_tokens, lambda t: surname_matches(s, t))))
    first = F.exists(ref_tokens, lambda t: surname_matches(F.get(surnames, F.lit(0)), t))
    agrees = (present >= 2) | first | ((present > 0) & (present >= 0.5 * F.size(surnames))) | (F.abs(ref_year - year) <= YEARS)
    return F.when(F.coalesce(agrees, F.lit(False)), F.lit(True))


def _shared_least(n: Column) -> Column:
    """How many of a cited title's n tokens a title must have to escape the veto."""
    return F.when(n <= 2, n).when(n <= 4, F.floor((2 * n + 2) / 3)).otherwise(F.floor((3 * n + 4) / 5)).cast("int")


def _token_pairs(c: Column) -> Column:
    return F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda y: F.struct(F.least(x, y).alias("t"), F.greatest(x, y).alias("u")))))


def title_pairs(r: DataFrame, c: DataFrame, cheap: int = CHEAP, long: int = LONG) -> DataFrame:
    """(rk, ck) of all titles that the veto on title tokens may let pass, with few others.

    r: rk, r_tokens; c: ck, tokens. Of a cited title's n tokens a candidate must have m, so it has one of
    any n - m + 1 and two of any n - m + 2; it must also have one of the numbered tokens, if there are any.
    The rarest tokens, or the numbered ones, are looked up singly if they occur in no more than ``cheap``
    titles, else in pairs. Titles of over ``long`` tokens, which would give too many pairs, are only looked
    up singly. Every way is complete. Titles without tokens are left out.
    """
    posted = c.select("ck", F.size("tokens").alias("m"), F.explode("tokens").alias("t"))
    frequency = posted.groupBy("t").agg(F.count("*").alias("df"))
    known = r.select("rk", F.explode("r_tokens").alias("t")).join(frequency, "t", "left").groupBy("rk").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("all"))
    least = _shared_least(F.size("all"))
    cost = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s + x["df"])
    chosen = known.withColumns({"least": least, "rarest": F.slice("all", 1, F.size("all") - least + 1), "numbered": F.filter("all", lambda x: x["t"].rlike("[0-9]"))})
    by_number = (F.size("numbered") > 0) & (cost(F.col("numbered")) < cost(F.col("rarest")))
    chosen = chosen.withColumn("single", F.when(by_number, F.col("numbered")).otherwise(F.col("rarest")))
    chosen = chosen.withColumn("paired", (cost(F.col("single")) > cheap) & (F.col("least") > 1) & (F.size("all") <= long))
    singly = chosen.select("rk", F.explode("single.t").alias("t"), F.when(F.col("paired"), "+").otherwise("").alias("u"))
    twos = chosen.filter("paired").select("rk", F.slice("all", 1, F.size("all") - F.col("least") + 2)["t"].alias("two"))
    doubly = twos.select("rk", F.inline(_token_pairs(F.col("two"))))
    common = twos.select(F.explode("two").alias("t")).distinct()
    several = posted.filter(F.col("m") <= long).join(common, "t", "left_semi").groupBy("ck").agg(F.collect_list("t").alias("two"))
    keys = posted.select("ck", "t", F.lit("").alias("u")).unionByName(posted.filter(F.col("m") > long).select("ck", "t", F.lit("+").alias("u"))).unionByName(several.select("ck", F.inline(_token_pairs(F.col("two")))))
    return singly.unionByName(doubly).join(keys, ["t", "u"]).select("rk", "ck")


def match(refs: DataFrame, candidates: DataFrame, cheap: int = CHEAP, long: int = LONG) -> DataFrame:
    """The best candidate of each reference.

    refs: ref_id, title, surnames, year, doi, arxiv; candidates: cand_id, and the same columns.
    Rows equal in all but their id are compared once. Pairs come from equal identifiers (in either case,
    without the version of a preprint) and from title_pairs(), never from a cross join; only these are scored.
    Returns ref_id, cand_id, method, score; references without a match are absent, as are those without title
    tokens and identifiers.
    """
    fields = ("title", "surnames", "year", "doi", "arxiv")

    def plain(df: DataFrame) -> DataFrame:
        return df.withColumns({"doi": F.lower("doi"), "arxiv": arxiv_stem(F.lower("arxiv"))})

    asked = plain(refs).select("ref_id", F.md5(F.to_json(F.struct(*fields))).alias("rk"), *[F.col(c).alias(f"r_{c}") for c in fields])
    r = asked.drop("ref_id").distinct().withColumn("r_tokens", title_tokens(F.col("r_title")))
    c = plain(candidates).groupBy(*fields).agg(F.min("cand_id").alias("cand_id")).withColumns({"ck": F.md5(F.to_json(F.struct(*fields))), "tokens": title_tokens(F.col("title"))})
    pairs = title_pairs(r, c, cheap, long)
    for key in ("doi", "arxiv"):
        pairs = pairs.unionByName(r.filter(F.col(f"r_{key}") != "").join(c.filter(F.col(key) != ""), F.col(f"r_{key}") == F.col(key)).select("rk", "ck"))
    both = pairs.distinct().join(r, "rk").join(c, "ck").filter(~title_contradiction(F.col("r_tokens"), F.col("tokens")))
    score = fuzzy_title_score(norm_title(F.col("r_title")), norm_title(F.col("title")))
    ref_words = F.split(norm_title(F.concat_ws(" ", F.array_join("r_surnames", " "), F.col("r_title"))), " ")
    scored = both.withColumn("score", score).withColumn("gated", gate(F.col("surnames"), ref_words, F.col("r_year"), F.col("year")))
    tier = F.when((F.col("r_doi") != "") & (F.col("r_doi") == F.col("doi")), 0).when((F.col("r_arxiv") != "") & (F.col("r_arxiv") == F.col("arxiv")), 1).when(F.col("score") >= F.when(F.col("gated"), GATED).otherwise(UNGATED), 2)
    first = F.coalesce(F.get("r_surnames", F.lit(0)) == F.get("surnames", F.lit(0)), F.lit(False))
    best = Window.partitionBy("rk").orderBy("tier", F.desc("rank_score"), F.desc("first"), "cand_id")
    ranked = scored.withColumns({"tier": tier, "first": first}).filter("tier IS NOT NULL").withColumn("rank_score", F.when(F.col("tier") == 2, F.col("score")).otherwise(0.0))
    chosen = ranked.withColumn("k", F.row_number().over(best)).filter("k = 1")
    method = F.element_at(F.array(F.lit("doi"), F.lit("arxiv"), F.lit("fuzzy_title")), F.col("tier") + 1)
    answers = chosen.select("rk", "cand_id", method.alias("method"), F.when(F.col("tier") < 2, 1.0).otherwise(F.bround(F.col("score") / 100, 3)).alias("score"))
    return asked.select("ref_id", "rk").join(answers, "rk").drop("rk")
