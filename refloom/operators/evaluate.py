"""Scoring of predictions against gold: a keyed left join and one conditional aggregate per axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.idents import resolved_id
from refloom.operators.severity import hallucination_pred

KEY = ["paper_id", "claim_id", "cite_key"]
#: The closed label set of the support axis.
SUPPORT_LABELS = ("supports", "partial", "does_not", "inconclusive")


def ratio(n: Column, d: Column) -> Column:
    """n / d in double, 0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d)


IDENTITY = ("r_doi", "r_arxiv", "r_title")


def last_prediction(pred: DataFrame) -> DataFrame:
    """One prediction for each key: the last by ord."""
    rest = [c for c in pred.columns if c not in KEY]
    return pred.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "ord").alias("p")).select(*KEY, "p.*")


def join_gold(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """gold (with the columns of gold_axes()) with its prediction; matched tells whether there is one. Predictions without gold go.

    Both have the key and IDENTITY; of gold only these and its axes are kept, the prediction's identity is called p_r_doi and so on.
    """
    truth = gold.select(*KEY, *IDENTITY, "exists_gold", "supports_gold", "priority_gold", "is_hallucinated")
    guess = last_prediction(pred).withColumnsRenamed({c: f"p_{c}" for c in IDENTITY}).withColumn("matched", F.lit(True))
    return truth.join(guess, KEY, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def prf(joined: DataFrame, truth: Column, guess: Column) -> DataFrame:
    counted = joined.agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count("*").alias("n"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def gold_axes(gold: DataFrame) -> DataFrame:
    """Adds exists_gold, supports_gold, priority_gold and is_hallucinated.

    The labels come first, then the record's own fields (exists, supports, priority), then the defaults. What is no flagged
    hallucination is one if it does not exist or has issues.
    """
    axis = lambda field, own, default: F.coalesce(F.col(f"labels.{field}"), F.col(own), F.lit(default))
    out = gold.withColumns({"exists_gold": axis("exists", "exists", "unresolved"), "supports_gold": axis("supports_claim", "supports", "inconclusive"), "priority_gold": axis("priority", "priority", "helpful")})
    return out.withColumn("is_hallucinated", F.coalesce("labels.is_hallucinated", hallucination_pred(F.col("exists_gold"), F.col("issues"))))


def unit(gold: str = "", pred: str = "p_") -> Column:
    """Identity of the work that a row counts for: gold's resolved identity, which is its key at least, else the prediction's, else ''."""
    of = lambda prefix: resolved_id(*[F.col(f"{prefix}{c}") for c in ("r_doi", "r_arxiv", "r_title")], F.col("cite_key"))
    return F.coalesce(of(gold), of(pred), F.lit(""))


def works(joined: DataFrame, *more: Column) -> DataFrame:
    """Works of a paper: g and p tell whether any of their rows is a hallucination in gold and by the prediction."""
    guess = hallucination_pred(F.col("exists"), F.col("issues"))
    return joined.groupBy("paper_id", unit().alias("rid")).agg(F.bool_or("is_hallucinated").alias("g"), F.bool_or(guess).alias("p"), *more)


def correctness(joined: DataFrame) -> DataFrame:
    """Hallucination P/R/F1 over works: a paper's rows of one work count once, true if any is."""
    return prf(works(joined), F.col("g"), F.col("p"))


def _counts() -> dict[str, Column]:
    """Sums over joined rows that all row-wise figures are made of."""
    support, p = F.coalesce("supports", F.lit("inconclusive")), F.coalesce("priority", F.lit("helpful"))
    abstains = F.coalesce(~F.col("matched") | (F.col("exists") == "unresolved") | (F.col("supports") == "inconclusive"), F.lit(False))
    should = (F.col("exists_gold") == "unresolved") | (F.col("supports_gold") == "inconclusive")
    committed = ~abstains & F.col("confidence").isNotNull()
    must, guess = F.col("priority_gold") == "obligatory", p == "obligatory"
    out = {"n": F.lit(True), "matched": F.col("matched"), "relevant": support == F.col("supports_gold"), "priority": p == F.col("priority_gold"), "abstains": abstains, "committed": committed}
    out["right"] = committed & (F.col("exists") == F.col("exists_gold")) & (F.col("supports") == F.col("supports_gold"))
    for name, truth, found in (("p", must, guess), ("a", should, abstains)):
        out |= {f"{name}_tp": truth & found, f"{name}_fp": ~truth & found, f"{name}_fn": truth & ~found}
    known = F.col("supports_gold").isin(*SUPPORT_LABELS)
    for label in SUPPORT_LABELS:
        g, s = F.col("supports_gold") == label, support == label
        out |= {f"{label}_tp": g & s, f"{label}_fp": known & ~g & s, f"{label}_fn": g & ~s}
    sums = {k: F.count_if(v).alias(f"c_{k}") for k, v in out.items()}
    return sums | {"confidence": F.sum(F.when(committed, F.col("confidence"))).alias("c_confidence")}


def _f1(name: str) -> Column:
    tp, fp, fn = (F.col(f"c_{name}_{x}") for x in ("tp", "fp", "fn"))
    return ratio(2 * tp, 2 * tp + fp + fn)


def _prf_of(counted: DataFrame, name: str) -> list[Column]:
    tp, fp, fn = (F.col(f"c_{name}_{x}") for x in ("tp", "fp", "fn"))
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.col("c_n").alias("n"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), _f1(name).alias("f1")]


def _share(name: str, of: str = "n") -> Column:
    return F.col(f"c_{name}").cast("double") / F.nullif(F.col(f"c_{of}"), F.lit(0))


def _macro() -> Column:
    return sum((_f1(x) for x in SUPPORT_LABELS[1:]), _f1(SUPPORT_LABELS[0])) / len(SUPPORT_LABELS)


def support_macro_f1(joined: DataFrame) -> DataFrame:
    """Mean F1 over the closed label set, labels without support included; gold outside the set is left out."""
    return joined.agg(*_counts().values()).select(_macro().alias("macro_f1"))


def relevance_accuracy(joined: DataFrame) -> DataFrame:
    return joined.agg(*_counts().values()).select(_share("relevant").alias("accuracy"), F.col("c_n").alias("n"))


def priority_metrics(joined: DataFrame) -> DataFrame:
    counted = joined.agg(*_counts().values())
    return counted.select(*_prf_of(counted, "p"), _share("priority").alias("accuracy"))


def abstention(joined: DataFrame) -> DataFrame:
    """Abstention rate and P/R/F1, and how confident the committed rows were against how right."""
    counted = joined.agg(*_counts().values())
    confident, right = F.col("c_confidence") / F.nullif("c_committed", F.lit(0)), _share("right", "committed")
    return counted.select(*_prf_of(counted, "a"), _share("abstains").alias("rate"), confident.alias("mean_confidence"), right.alias("committed_accuracy"), (confident - right).alias("calibration_gap"))


def headline(joined: DataFrame) -> DataFrame:
    """All axes in one row, by one pass: sums per work, then over all works."""
    counts = _counts()
    per_work = works(joined, *counts.values())
    tp, fp, fn = (F.count_if(x) for x in (F.col("g") & F.col("p"), ~F.col("g") & F.col("p"), F.col("g") & ~F.col("p")))
    total = per_work.agg(tp.alias("c_w_tp"), fp.alias("c_w_fp"), fn.alias("c_w_fn"), F.count("*").alias("n_works"), *[F.coalesce(F.sum(f"c_{k}"), F.lit(0)).alias(f"c_{k}") for k in counts])
    return total.select(
        _f1("w").alias("headline_f1"), "n_works", _macro().alias("macro_f1"), _share("relevant").alias("relevance_accuracy"), _f1("p").alias("priority_f1"), _share("abstains").alias("abstention_rate"),
        F.col("c_matched").alias("n_matched"), (F.col("c_n") - F.col("c_matched")).alias("n_unmatched"),
    )


def report_summary(pred: DataFrame) -> DataFrame:
    """exists once per cite_key (its first row), issues once per cite_key (any row), support per row."""
    works = pred.groupBy("paper_id", "cite_key").agg(F.min_by("exists", "ord").alias("e"), F.bool_or(F.size("issues") > 0).alias("m"))
    by_work = works.groupBy("paper_id").agg(
        F.count("*").alias("n_refs"), *[F.count_if(F.col("e") == x).alias(f"exists_{x}") for x in ("yes", "no", "unresolved")], F.count_if("m").alias("with_issues")
    )
    by_row = pred.groupBy("paper_id").agg(F.count("*").alias("n_pairs"), *[F.count_if(F.col("supports") == x).alias(f"n_{x}") for x in (*SUPPORT_LABELS, "skipped")])
    return by_work.join(by_row, "paper_id")
