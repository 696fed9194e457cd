"""Token sets, match gates and string similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from refloom.functions.text import clean_title_variant, norm_title

#: Function words that generic titles share.
CONTENT_STOP = ("the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "by", "as")
#: Fixed value: least token sort ratio of two strings that say the same.
SAME = 88.0
#: Words that say nothing about a title.
TITLE_STOP = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "toward", "towards", "via", "with", "without")


def tokens(c: Column, longer_than: int = 1, stop: tuple[str, ...] = ()) -> Column:
    """Different tokens of a normalised title that are longer than longer_than and not stop words."""
    parts = F.filter(F.split(norm_title(c), " "), lambda t: F.length(t) > longer_than)
    return F.array_distinct(F.filter(parts, lambda t: ~t.isin(*stop)) if stop else parts)


def title_tokens(c: Column) -> Column:
    """Tokens of a title without a trailing site that are longer than one character and not stop words."""
    return tokens(clean_title_variant(c), 1, TITLE_STOP)


def content_tokens(c: Column) -> Column:
    """Distinctive tokens of a title: longer than three characters, without the words that generic titles share."""
    return tokens(c, 3, CONTENT_STOP)


def containment(a: Column, b: Column) -> Column:
    """Share of a's tokens that b has; null for an empty a."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(a))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def title_contradiction(cited: Column, found: Column) -> Column:
    """Whether two titles speak of different works; takes the token arrays of both."""
    digits = F.filter(cited, lambda t: t.rlike("[0-9]"))
    share, n = containment(cited, found), F.size(cited)
    return (
        F.when((n == 0) | (F.size(found) == 0), F.lit(False))
        .when((F.size(digits) > 0) & ~F.arrays_overlap(digits, found), F.lit(True))
        .when(n <= 2, share < 1.0)
        .when(n <= 4, share < 2.0 / 3)
        .otherwise(share < 0.60)
    )


def titles_diverge(a: Column, b: Column) -> Column:
    """Neither title's content tokens cover 85 % of the other's; takes the token arrays, both need two tokens."""
    return (F.size(a) >= 2) & (F.size(b) >= 2) & (F.greatest(containment(a, b), containment(b, a)) < 0.85)


def poorly_covered(cited: Column, found: Column) -> Column:
    """Under 60 % of three or more cited content tokens are in the other title, which has some."""
    return (F.size(cited) >= 3) & (F.size(found) > 0) & (containment(cited, found) < 0.6)


def off_topic(claim: Column, abstract: Column) -> Column:
    return (F.size(abstract) > 0) & (F.size(claim) > 0) & (containment(claim, abstract) < 0.12)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows as bits of one integer."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for ch in b:
        u = rows & masks.get(ch, 0)
        rows = ((rows + u) | (rows - u)) & full
    return len(a) - rows.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 LCS / (|a| + |b|); two empty strings are alike."""
    return 100.0 * 2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(indel_ratio(one, two), indel_ratio(both, one) if both else 0.0, indel_ratio(both, two) if both else 0.0)


@F.pandas_udf(DoubleType())
def sorted_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Token sort ratio (0 to 100) of two normalised strings; null for a null."""
    for left, right in pairs:
        yield pd.Series([None if a is None or b is None else token_sort_ratio(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def strings_match(a: Column, b: Column) -> Column:
    """Whether two titles or venues say the same: one holds the other, with spaces or without, or their sorted tokens are alike.

    An empty one contradicts nothing. Only pairs that no containment settles are handed to the ratio.
    """
    x, y = norm_title(a), norm_title(b)
    u, v = F.replace(x, F.lit(" "), F.lit("")), F.replace(y, F.lit(" "), F.lit(""))
    held = (x == "") | (y == "") | F.contains(x, y) | F.contains(y, x) | F.contains(u, v) | F.contains(v, u)
    return held | F.coalesce(sorted_ratio(F.when(~held, x), F.when(~held, y)) >= SAME, F.lit(False))


@F.pandas_udf(DoubleType())
def fuzzy_title_score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """max(token sort ratio, token set ratio) of two normalised titles; 0 if either is empty."""
    for left, right in pairs:
        yield pd.Series([max(token_sort_ratio(a, b), token_set_ratio(a, b)) if a and b else 0.0 for a, b in zip(left, right, strict=True)], dtype="float64")
