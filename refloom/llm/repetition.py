"""Quality rules on repetition, by suffix arrays over the words of each document.

A batch of texts is one string of words in which no suffix reaches past its text.
Only suffixes whose first three words occur again in the same text can take part in
a repeat, so the suffix array holds those. It is built by prefix doubling (ranks of
3, 6, 12... words from pairs of ranks). The ranks of all rounds give the longest common
prefix of neighbours; an LCP interval that can't be extended to the left is a maximal
repeated substring. The union of their spans is the covered part of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import small_batches

_SYMBOLS = b"#*$%&|<>"
_IS_CONTINUATION = np.zeros(256, bool)
_IS_CONTINUATION[0x80:0xC0] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(_SYMBOLS)] = True

#: A repeat counts from this many words; a text may be covered by repeats to this share,
#: and its longest repeat may have this many words or this share of the text, whichever is more.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST, MAX_LONGEST_SHARE = 10, 0.4, 200, 0.2


def suffix_repeats(words: np.ndarray, doc: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words: ids; doc: number of the text of each. Returns flags of words in repeated windows of three,
    flags of words in maximal repeats of at least min_repeat words, and at each word the length of
    the maximal repeat that starts there (0: none)."""
    n = len(words)
    in_three, covered, longest = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
    if n < 3:
        return in_three, covered, longest
    # the next words, 0 past the end of the text
    next1, next2 = (np.append(np.where(doc[i:] == doc[:-i], words[i:] + 1, 0), np.zeros(i, np.int64)) for i in (1, 2))
    if words.max() < 2**21 - 2:
        order = np.lexsort((((words + 1) << 42) | (next1 << 21) | next2, doc))
    else:
        order = np.lexsort((next2, next1, words, doc))
    w0, w1, w2, d = words[order], next1[order], next2[order], doc[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (w0[1:] != w0[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
    sa = order[~(new & np.append(new[1:], True))]
    if not len(sa):
        return in_three, covered, longest
    for i in range(3):
        in_three[sa + i] = True
    # the rank of a suffix: the place of the first suffix that has the same first k words
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, k, todo = [(3, rank)], 3, sa
    while len(todo):
        ahead = todo + k
        safe = np.minimum(ahead, n - 1)
        inside = (ahead < n) & (doc[safe] == doc[todo])
        second = np.where(inside, rank[safe], -1)
        order = np.lexsort((second, rank[todo]))
        todo = todo[order]
        first_rank, second = rank[todo], second[order]
        same = (first_rank[1:] == first_rank[:-1]) & (second[1:] == second[:-1])
        new = np.concatenate(([True], ~same))
        heads = np.flatnonzero(new)
        nxt = rank.copy()
        group_start = np.concatenate(([True], first_rank[1:] != first_rank[:-1]))
        base = np.flatnonzero(group_start)[np.cumsum(group_start) - 1]
        place = heads[np.cumsum(new) - 1] - base
        nxt[todo] = first_rank + place
        rank, k = nxt, 2 * k
        lone = new & np.append(new[1:], True)
        todo = todo[~lone]
        if len(todo):
            levels.append((k, rank))
    sa = sa[np.lexsort((rank[sa], doc[sa]))]
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    for size, ranks in reversed(levels):
        ok = (a < n) & (b < n)
        ok[ok] = (ranks[a[ok]] == ranks[b[ok]]) & (doc[a[ok]] == doc[b[ok]])
        lcp[ok] += size
        a[ok] += size
        b[ok] += size
    for _ in range(2):
        ok = (a < n) & (b < n)
        ok[ok] = (words[a[ok]] == words[b[ok]]) & (doc[a[ok]] == doc[b[ok]])
        open_ = ok & (doc[np.minimum(a, n - 1)] == doc[sa[:-1]]) & (doc[np.minimum(b, n - 1)] == doc[sa[1:]])
        lcp[open_] += 1
        a[open_] += 1
        b[open_] += 1
        a[~open_] = b[~open_] = n
    best = np.zeros(n, np.int64)
    best[sa] = np.maximum(np.append(lcp, 0), np.concatenate(([0], lcp)))
    # an interval that extends to the left lies inside the repeat that starts one word earlier
    left = np.concatenate(([0], best[:-1]))
    left[1:][doc[1:] != doc[:-1]] = 0
    start = np.flatnonzero((best >= min_repeat) & (left != best + 1))
    longest[start] = best[start]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + best[start], -1)
    covered = np.cumsum(edges[:-1]) > 0
    return in_three, covered, longest


class WordIds(dict):
    BOUND = 1_000_000

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def judge(texts: list[bytes], ids: WordIds, min_repeat: int, max_covered: float, max_longest: int, max_share: float) -> dict[str, np.ndarray]:
    """The figures of one batch of texts."""
    if len(ids) > ids.BOUND:
        ids.clear()
    split = [x.split() for x in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    doc = np.repeat(np.arange(len(split)), n_words)
    words = np.fromiter((ids[w] for x in split for w in x), np.int64, int(n_words.sum()))
    in_three, covered, longest = suffix_repeats(words, doc, min_repeat)
    n = len(split)
    chars, symbols, lines = [], [], []
    for text, found in zip(texts, split, strict=True):
        data = np.frombuffer(text, np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        chars.append(len(data) - int(_IS_CONTINUATION[data].sum()) - int(space.sum()))
        symbols.append(int(_IS_SYMBOL[data].sum()))
        rows = [x for x in text.split(b"\n") if x and not x.isspace()] if found else []
        lines.append(len(rows) - len(set(rows)))
    repeat = np.bincount(doc, in_three, n).astype(np.int64)
    cover = np.bincount(doc, covered, n).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc, longest)
    failed = (n_words < 50) | (100 * repeat > 50 * n_words)
    good = ~failed & (cover <= max_covered * n_words) & (top <= np.maximum(max_longest, max_share * n_words))
    return {
        "n_words": n_words, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": repeat,
        "base_failed": failed, "kept": good, "covered_words": cover, "longest_repeat": top,
    }


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def repetition_rules(
    docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, max_share: float = MAX_LONGEST_SHARE, batch_bytes: int = 4 << 20
) -> DataFrame:
    """Judge each whole text; returns the columns ``carry`` and the figures of FIGURES.

    docs needs text and the columns of carry (which may hold text); columns beside these
    are not read, and a name in carry that is a figure's is an error, as is a min_repeat under 3. A null or empty text has
    no word and fails the base rules; rows are judged one by one, so repeated rows get
    equal figures; an empty table gives none. Texts go through in batches of about
    batch_bytes, a longer text alone.
    """
    clash = {x.split()[0] for x in FIGURES.split(", ")} & set(carry)
    if clash:
        raise ValueError(f"carry names figures of the result: {', '.join(sorted(clash))}")
    if min_repeat < 3:
        raise ValueError("min_repeat must be at least 3")
    small_batches(docs.sparkSession)
    chosen = docs.select(*carry, F.col("text").alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for batch in batches:
            texts = [x.encode("utf-8", "surrogatepass") if x else b"" for x in batch["__text"]]
            at = 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= batch_bytes:
                    size += len(texts[end])
                    end += 1
                figures = judge(texts[at:end], ids, min_repeat, max_covered, max_longest, max_share)
                yield pd.concat([batch.iloc[at:end][list(carry)].reset_index(drop=True), pd.DataFrame(figures)], axis=1)
                at = end

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInPandas(run, f"{schema}, {FIGURES}")


def query(spark, sf_dir: str) -> DataFrame:
    from refloom.llm.common import read

    return repetition_rules(read(spark, sf_dir, "documents"))


#: DuckDB: a word is covered if a window of MIN_REPEAT words around it occurs twice in its text; the longest repeat is the longest
#: stretch of places whose windows are equal to those a fixed distance further on.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
w AS (SELECT row, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
u AS (SELECT row, len(w) AS n, i, w[i] AS a, w[i:i+2] AS three, CASE WHEN i + {MIN_REPEAT - 1} <= len(w) THEN md5_number(array_to_string(w[i:i+{MIN_REPEAT - 1}], ' ')) END AS ten FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
c AS (SELECT *, i + 2 <= n AND count(*) OVER (PARTITION BY row, three) > 1 AS again3, ten IS NOT NULL AND count(*) OVER (PARTITION BY row, ten) > 1 AS again10 FROM u),
v AS (SELECT row, a, bool_or(again3) OVER (PARTITION BY row ORDER BY i ROWS 2 PRECEDING) AS in3, bool_or(again10) OVER (PARTITION BY row ORDER BY i ROWS {MIN_REPEAT - 1} PRECEDING) AS in10 FROM c),
f AS (SELECT row, count(*) AS n_words, sum(length(a)) AS word_chars, count_if(in3) AS n_repeat_words, count_if(in10) AS covered_words FROM v GROUP BY row),
p AS (SELECT x.row, x.i, y.i - x.i AS gap FROM c x JOIN c y ON x.row = y.row AND x.ten = y.ten AND x.i < y.i WHERE x.again10 AND y.again10),
r AS (SELECT row, max(k) + {MIN_REPEAT - 1} AS longest FROM (SELECT row, count(*) AS k FROM (SELECT row, gap, i - row_number() OVER (PARTITION BY row, gap ORDER BY i) AS island FROM p) GROUP BY row, gap, island) GROUP BY row),
l AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
g AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(covered_words, 0) AS BIGINT) AS covered_words, CAST(coalesce(longest, 0) AS BIGINT) AS longest_repeat
  FROM d LEFT JOIN f ON d.row = f.row LEFT JOIN r ON d.row = r.row LEFT JOIN l ON d.row = l.row),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM g)
SELECT *, NOT base_failed AND covered_words <= CAST({MAX_COVERED} AS DOUBLE) * n_words AND longest_repeat <= greatest({MAX_LONGEST}, CAST({MAX_LONGEST_SHARE} AS DOUBLE) * n_words) AS kept FROM b
"""
