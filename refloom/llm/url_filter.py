"""URL filtering: host rules first, gradient-boosted trees on lexical features for the rest.

Everything that touches all rows is a DataFrame expression: the rules, the features
the trees, which are compiled to nested conditions, and the suffix statistics, which
are those of all labelled URLs (those that a rule decides). The trees are fitted on
the driver on a bounded sample of the distinct ones, each with its number of rows; what a
URL of the sample is told of its suffix comes from other folds of the URLs, so its label can't leak into
its features. evaluate() holds out a fifth of the distinct URLs and gives the log-loss there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import stage

#: (verdict, rule): a rule is a host, with all its subdomains, and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Bound of the training sample, and the size of the ensemble.
TRAIN_ROWS, TREES, DEPTH, BINS, RATE, L2 = 20_000, 20, 3, 16, 0.3, 1.0
#: Distinct labelled URLs fall into folds by a hash; what a URL is told of its suffix comes from the other folds.
FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./:-_?=&%#+~"
FEATURES = ("length", "host_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "fragment", "hyphens", "suffix_rate", "suffix_count")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first '://' and '/', '?', '#' or the end, A-Z in lower case; path up to '?', '#' or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    stem = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^?#]*", 0)
    host = F.regexp_extract(stem, r"^[^/]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.substring(stem, F.length(host) + 1, F.length(stem))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; both null if none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        rule_host, _, tail = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + tail)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(s: Column, chars: str) -> Column:
    return F.length(s) - F.length(F.translate(s, chars, ""))


def _entropy(s: Column) -> Column:
    """Bits per character over _ALPHABET; all other characters count as one symbol."""
    n = F.greatest(F.length(s), F.lit(1)).cast("double")

    def part(c: Column) -> Column:
        p = c / n
        return F.when(c > 0, -p * F.log2(p)).otherwise(F.lit(0.0))

    out = part(F.length(F.translate(s, _ALPHABET, "")))
    for ch in _ALPHABET:
        out = out + part(_count(s, ch))
    return out


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features as columns f_<name>, and suffix, to columns url, host and path."""
    url = F.translate(F.coalesce("url", F.lit("")), _UPPER, _LOWER)
    digits = _count(url, "0123456789")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.size(F.split("host", r"\."))
    columns = {
        "length": F.length(url), "host_length": F.length("host"), "labels": labels, "depth": _count(F.col("path"), "/"), "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(url), "parameters": F.when(query == "", 0).otherwise(1 + _count(query, "&")), "fragment": F.contains(url, F.lit("#")).cast("int"), "hyphens": _count(F.col("host"), "-"),
    }
    suffix = F.regexp_extract("host", r"([^.]*\.[^.]*|[^.]*)$", 1)
    return urls.withColumns({f"f_{k}": v.cast("double") for k, v in columns.items()} | {"suffix": suffix})


@dataclass
class Trees:
    """An ensemble: each tree is nested tuples (feature, threshold, left, right) or a leaf's value."""

    base: float
    trees: list
    prior: float  # the share of blocked among all labelled rows, for suffixes without a label
    labelled: int  # how many labelled rows there are

    def score(self) -> Column:
        def column(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, left, right = node
            return F.when(F.col(f"f_{FEATURES[feature]}") <= float(threshold), column(left)).otherwise(column(right))

        out = F.lit(self.base)
        for t in self.trees:
            out = out + column(t)
        return out


def margins(base: float, trees: list, x: np.ndarray) -> Iterator[np.ndarray]:
    """The margin of each row of x with no tree, with one, with two..."""
    out = np.full(len(x), base)
    yield out.copy()

    def add(node, rows: np.ndarray) -> None:
        if isinstance(node, tuple):
            left = x[rows, node[0]] <= node[1]
            add(node[2], rows[left])
            add(node[3], rows[~left])
        else:
            out[rows] += node

    for tree in trees:
        add(tree, np.arange(len(x)))
        yield out.copy()


def useful_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, **kw) -> int:
    """How many trees have the least log-loss on rows held out, over all folds."""
    if len(y) < 2 * FOLDS:
        return kw.get("trees", TREES)
    loss = 0.0
    for k in range(FOLDS):
        out = fold == k
        steps = margins(*boost(x[~out], y[~out], weight=weight[~out], **kw), x[out])
        each = np.array([(weight[out] * np.logaddexp(0, np.where(y[out] > 0, -m, m))).sum() for m in steps])
        loss = loss + np.pad(each, (0, kw.get("trees", TREES) + 1 - len(each)), "edge")
    return int(np.argmin(loss))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, weight: np.ndarray | None = None) -> tuple[float, list]:
    """Gradient-boosted trees for the logistic loss, with histograms of gradients per bin; a row counts weight times."""
    if not len(y):
        return 0.0, []
    w = np.ones(len(y)) if weight is None else weight
    share = ((w * y).sum() + 1.0) / (w.sum() + 2.0)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    margin, out = np.full(len(y), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if level < depth:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                gain = left_g**2 / (left_h + L2) + (total_g - left_g) ** 2 / (total_h - left_h + L2) - total_g**2 / (total_h + L2)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        if best[1] is None:
            value = -rate * total_g / (total_h + L2)
            margin[rows] += value
            return value
        _, j, k = best
        left = binned[rows, j] <= k
        return j, cuts[j][k], grow(rows[left], g, h, level + 1), grow(rows[~left], g, h, level + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out.append(grow(np.arange(len(y)), w * (p - y), w * p * (1 - p), 0))
    return base, out


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Trees, DataFrame]:
    """(trees, statistics by suffix) from labelled URLs (columns of lexical() and label 0/1).

    The statistics are of all labelled rows. The trees are fitted on at most ``rows`` distinct URLs, the first
    by a hash of the URL, with the number of their rows as weights; there are as many trees as lower the log-loss on held-out folds.
    """
    total, blocked, urls = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), F.approx_count_distinct("url")).first()
    prior = (blocked + 1) / (total + 2)
    fold = F.pmod(F.xxhash64(F.concat(F.lit("fold"), "url")), F.lit(FOLDS)).cast("int")
    by_fold = stage(labelled.groupBy("suffix", fold.alias("in_fold")).agg(F.sum("label").alias("fb"), F.count("*").alias("fn")), "url-folds")
    by_suffix = stage(by_fold.groupBy("suffix").agg(F.sum("fb").alias("b"), F.sum("fn").alias("n")), "url-suffixes")

    def described(b, n) -> tuple:
        return ((b + 5 * prior) / (n + 5)).alias("f_suffix_rate"), F.log1p(n).alias("f_suffix_count")

    # few more hashes than needed pass, so that the limit below has little to sort
    bound = 1 << 40
    h = F.pmod(F.xxhash64("url"), F.lit(bound))
    features = [f"f_{n}" for n in FEATURES[:-2]]
    chosen = labelled.filter(h < min(bound, bound * (2 * rows + 64) // max(1, urls))).groupBy("url", "suffix", "label", *features).agg(F.count("*").alias("weight"))
    chosen = chosen.withColumn("h", h).orderBy("h", "url").limit(rows)
    others = described(F.col("b") - F.coalesce("fb", F.lit(0)), F.col("n") - F.coalesce("fn", F.lit(0)))
    known = chosen.withColumn("fold", fold).join(by_suffix.withColumnRenamed("suffix", "s"), F.col("suffix") == F.col("s"))
    wide = known.join(by_fold.withColumnRenamed("suffix", "fs"), (F.col("suffix") == F.col("fs")) & (F.col("fold") == F.col("in_fold")), "left").select("url", "label", "weight", "fold", *features, *others)
    sample = sorted((tuple(r) for r in wide.toLocalIterator()), key=lambda r: r[0] or "")
    x = np.array([r[4:] for r in sample], np.float64).reshape(len(sample), len(FEATURES))
    y, weight, folds = (np.array([r[i] for r in sample], np.float64) for i in (1, 2, 3))
    base, trees = boost(x, y, trees=useful_trees(x, y, weight, folds), weight=weight)
    return Trees(base, trees, float(prior), total), by_suffix.select(F.col("suffix").alias("s"), *described(F.col("b"), F.col("n")))


def scored(urls: DataFrame, model: Trees, stats: DataFrame) -> DataFrame:
    """Adds score, the trees' probability of a block, to columns of lexical()."""
    known = urls.join(stats, F.col("suffix") == F.col("s"), "left").fillna({"f_suffix_rate": model.prior, "f_suffix_count": 0.0})
    return known.withColumn("score", 1 / (1 + F.exp(-model.score())) if model.labelled else F.lit(0.0))


def evaluate(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Held-out figures of the trees: n, accuracy, log_loss, and prior_log_loss (that of the labels' share alone).

    A fifth of the labelled distinct URLs, by a hash, is judged by trees and statistics from the other four.
    """
    labelled = _labelled(lexical(_judged(pages, rules)))
    held = F.pmod(F.xxhash64(F.concat(F.lit("held"), "url")), F.lit(5)) == 0
    model, stats = train(labelled.filter(~held), train_rows)
    p = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = lambda q: -F.avg(F.col("label") * F.log(q) + (1 - F.col("label")) * F.log(1 - q))
    return scored(labelled.filter(held), model, stats).agg(F.count("*").alias("n"), F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")).alias("accuracy"), loss(p).alias("log_loss"), loss(F.lit(model.prior)).alias("prior_log_loss"))


def _judged(pages: DataFrame, rules) -> DataFrame:
    host, path = split_url(F.col("url"))
    return pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))


def _labelled(wide: DataFrame) -> DataFrame:
    return wide.filter("r.verdict is not null").select("*", (F.col("r.verdict") == "block").cast("int").alias("label"))


def filter_urls(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Judge each URL: page_id, host, path, rule, verdict, score.

    pages needs page_id and url; other columns, whatever their names, are not read. verdict is that of the
    longest rule that fits host and path; where none fits, 'block' if the
    trees give a score of at least 0.5, else 'allow'. Labelled URLs, from
    which the trees learn, are those that a rule decides. A URL that is null or without '://' has an empty host
    and path, fits no rule and is left to the trees; without a labelled URL they
    allow all (a score of 0.5 or more needs evidence). Repeated rows get equal
    results; an empty table gives none.
    """
    wide = lexical(_judged(pages, rules))
    model, stats = train(_labelled(wide), train_rows)
    verdict = F.coalesce("r.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored(wide, model, stats).select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    from refloom.llm.common import read

    return filter_urls(read(spark, sf_dir, "pages"))
