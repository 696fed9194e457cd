"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

Texts are cut into tokens, and each run of five tokens is a seed (all tokens of a
shorter benchmark text). Seeds of both sides are joined on a 128-bit hash. Documents are scanned
once; which of their seeds go to the join is decided by a bitmap of the benchmark's seed hashes,
whose size is bounded whatever the benchmark's (a fuller one only lets more seeds through to the join).
Equal texts, on either side, are one.

A pair of texts needs enough shared seeds for the threshold. So of each benchmark text the
seeds that most documents have are left out of the search for pairs, as many as can't reach
the threshold by themselves; phrases that everybody uses make no pairs. For the pairs
found all shared seeds are looked up, and the tokens under them are tiled: the longest
match of unmarked tokens on both sides is marked again and again, down to five tokens. It
counts how many of the benchmark's tokens are tiled, in whatever order, so that reordered
passages are caught too.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.common import discard, small_batches, stage, text_key

MIN_MATCH, COVERAGE = 5, 0.5
_TOKEN = re.compile(r"[^\W_]+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def tokens(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _TOKEN.findall(text.lower()) if text else []


def _windows(line: list[int], free: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """(position, Karp-Rabin hash) of each window of unmarked tokens."""
    top, h, run = pow(_BASE, size, _MOD), 0, 0
    for i, x in enumerate(line):
        if not free[i]:
            h = run = 0
            continue
        h = (h * _BASE + x + 1) % _MOD
        run += 1
        if run > size:
            h = (h - (line[i - size] + 1) * top) % _MOD
        if run >= size:
            yield i - size + 1, h


def tile(pattern: list[int], text: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: tiles (pattern position, text position, length), longest first.

    A negative token in text matches nothing. Of equally long matches the first in
    pattern, then in text, is marked.
    """
    free_p, free_t = bytearray(b"\1") * len(pattern), bytearray(int(x >= 0) for x in text)
    tiles: list[tuple[int, int, int]] = []
    size = max(min_match, min(len(pattern), len(text)))
    while size >= min_match:
        at = defaultdict(list)
        for i, h in _windows(text, free_t, size):
            at[h].append(i)
        matches: list[tuple[int, int, int]] = []
        for i, h in _windows(pattern, free_p, size):
            for j in at.get(h, ()):
                n = 0
                while i + n < len(pattern) and j + n < len(text) and free_p[i + n] and free_t[j + n] and pattern[i + n] == text[j + n]:
                    n += 1
                if n >= size:
                    matches.append((-n, i, j))
        longest = -min(matches)[0] if matches else 0
        if longest > 2 * size:
            size = longest
            continue
        heapify(matches)
        while matches:
            n, i, j = heappop(matches)
            n = -n
            if all(free_p[i : i + n]) and all(free_t[j : j + n]):
                free_p[i : i + n] = free_t[j : j + n] = bytes(n)
                tiles.append((i, j, n))
                continue
            run = 0  # what an earlier tile has left of it waits for its turn among shorter matches
            for k in range(n + 1):
                if k < n and free_p[i + k] and free_t[j + k]:
                    run += 1
                else:
                    if run >= size:
                        heappush(matches, (-run, i + k - run, j + k - run))
                    run = 0
        size = min_match if min_match < size <= 2 * min_match else size // 2 if size > min_match else 0
    return tiles


_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LEAST_BITS, _MOST_BITS = 16, 27
#: The places of a seed in the bitmap, from its two hashes.
PROBES = (lambda h, g: h, lambda h, g: g, lambda h, g: h >> np.uint64(32))
CHUNK_CHARS = 1 << 20


class TokenHashes(dict):
    """token -> 64-bit hash, remembered up to a bound."""

    BOUND = 250_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        self[token] = value = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


def _seeds(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of size tokens."""
    n = max(0, len(ids) - size + 1)
    out = []
    for factor in (_P, _Q):
        h = np.full(n, size, np.uint64)
        for i in range(size):
            h = h * factor + (ids[i : i + n] ^ (ids[i : i + n] >> np.uint64(29))) * factor
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(h ^ (h >> np.uint64(29)))
    return out[0], out[1]


def _grouped(owner: np.ndarray, h: np.ndarray, g: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(owner, h, g, sorted places) of each different seed of each owner."""
    order = np.lexsort((at, g, h, owner))
    owner, h, g, at = owner[order], h[order], g[order], at[order]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])))) if len(at) else []
    for i, places in zip(new, np.split(at, new[1:]), strict=True) if len(at) else ():
        yield int(owner[i]), int(h[i].view(np.int64)), int(g[i].view(np.int64)), places


def _item_seeds(min_match: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = TokenHashes()
        for batch in batches:
            for key, text in zip(batch["k"], batch["text"], strict=True):
                ids = np.fromiter(map(hashes.__getitem__, tokens(text)), np.uint64)
                if len(ids):
                    size = min(min_match, len(ids))
                    h, g = _seeds(ids, size)
                    rows = [(key, len(ids), size, a, b, x.tolist()) for _, a, b, x in _grouped(np.zeros(len(h), np.int64), h, g, np.arange(len(h)))]
                    yield pd.DataFrame(rows, columns=["ik", "n", "size", "h", "g", "places"])

    return run


def _item_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = TokenHashes()
    for batch in batches:
        yield pd.DataFrame({"ik": batch["k"], "ids": [np.fromiter(map(hashes.__getitem__, tokens(t)), np.uint64).view(np.int64).tolist() for t in batch["text"]]})


def _scan(shared, sizes: tuple[int, ...]):
    """The seeds of documents that the bitmap lets through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, bitmap = TokenHashes(), np.frombuffer(shared.value, np.uint8)
        mask = np.uint64(len(bitmap) * 8 - 1)
        for batch in batches:
            keys, texts, at = batch["k"].tolist(), batch["text"].tolist(), 0
            while at < len(texts):
                end, chars = at + 1, len(texts[at] or "")
                while end < len(texts) and chars + len(texts[end] or "") <= CHUNK_CHARS:
                    chars += len(texts[end] or "")
                    end += 1
                lines = [tokens(t) for t in texts[at:end]]
                ends = np.cumsum([len(x) for x in lines])
                begins = np.concatenate(([0], ends[:-1]))
                ids = np.fromiter(map(hashes.__getitem__, chain.from_iterable(lines)), np.uint64, int(ends[-1]))
                rows = []
                for size in sizes:
                    h, g = _seeds(ids, size)
                    found = np.arange(len(h))
                    for probe in PROBES:  # each sees only what the ones before let through
                        bit = probe(h[found], g[found]) & mask
                        found = found[((bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
                    doc = np.searchsorted(ends, found, "right")
                    inside = found + size <= ends[doc] if len(found) else np.zeros(0, bool)
                    found, doc = found[inside], doc[inside]
                    rows += [(keys[at + d], a, b, x.tolist()) for d, a, b, x in _grouped(doc, h[found], g[found], found - begins[doc])]
                if rows:
                    yield pd.DataFrame(rows, columns=["k", "h", "g", "ps"])
                at = end

    return run


def _tile_pairs(coverage: float):
    """(item's tokens, shared seeds with their places on both sides) -> how much of the item is tiled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, ik, size, ids, seeds in zip(batch["k"], batch["ik"], batch["size"].tolist(), batch["ids"], batch["seeds"], strict=True):
                number: dict[int, int] = {}
                pattern = [number.setdefault(x, len(number)) for x in ids.tolist()]
                reach = np.zeros(len(pattern), bool)
                places, items = [], []
                for x in seeds:
                    for p in x["places"]:
                        reach[p : p + size] = True
                    first = x["places"][0]
                    ps = np.asarray(x["ps"], np.int64)
                    places.append((ps[:, None] + np.arange(size)).ravel())
                    items.append(np.tile(pattern[first : first + size], len(ps)))
                if reach.sum() < coverage * len(pattern):
                    continue
                at, which = np.unique(np.concatenate(places), return_index=True)
                line = np.insert(np.concatenate(items)[which], np.flatnonzero(np.diff(at) > 1) + 1, -1).tolist()
                tiles = tile(pattern, line, size)
                covered = sum(n for *_, n in tiles)
                if covered >= coverage * len(pattern):
                    rows.append((k, ik, len(pattern), covered, len(tiles), max(n for *_, n in tiles)))
            yield pd.DataFrame(rows, columns=["k", "ik", "item_tokens", "covered_tokens", "n_tiles", "longest_tile"])

    return run


FOUND = "k binary, ik binary, item_tokens long, covered_tokens long, n_tiles long, longest_tile long"


def _bitmap(seeds: DataFrame) -> bytes:
    """Three places for each seed (PROBES) among 64 bits a seed or more, within fixed bounds, built by groups of 32,768 bits."""
    bits = min(_MOST_BITS, max(_LEAST_BITS, (64 * seeds.count()).bit_length()))
    at = F.col("at")
    places = F.array(F.col("h"), F.col("g"), F.shiftrightunsigned("h", 32))
    placed = seeds.select(F.explode(places).alias("p")).select(F.col("p").bitwiseAND((1 << bits) - 1).alias("at"))
    parts = placed.groupBy(F.shiftright(at, 15).alias("b")).agg(F.bitmap_construct_agg((at % 32768)).alias("m"))
    out = bytearray(1 << (bits - 3))
    for row in parts.toLocalIterator():  # 4 KiB a row, 16 MiB at most
        out[row["b"] * 4096 : (row["b"] + 1) * 4096] = row["m"]
    return bytes(out)


def find_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """Pairs of different texts: FOUND, with the content keys (common.text_key) of the document's and of the benchmark's text."""
    spark = docs.sparkSession
    small_batches(spark)
    wanted = benchmark.filter("text is not null").select(text_key(F.col("text")).alias("k"), "text").dropDuplicates(["k"])
    items = stage(wanted, "tiling-items")
    seeds = stage(items.mapInPandas(_item_seeds(min_match), "ik binary, n int, size int, h long, g long, places array<int>"), "tiling-seeds")
    ids = stage(items.mapInPandas(_item_tokens, "ik binary, ids array<long>"), "tiling-ids")
    sizes = tuple(sorted(r["size"] for r in seeds.select("size").distinct().collect()))  # min_match values at most
    shared = spark.sparkContext.broadcast(_bitmap(seeds))
    scanned = stage(docs.select(text_key(F.col("text")).alias("k"), "text").mapInPandas(_scan(shared, sizes), "k binary, h long, g long, ps array<int>"), "tiling-scan")
    shared.destroy()
    hits = stage(scanned.groupBy("k", "h", "g").agg(F.first("ps").alias("ps")), "tiling-hits")  # copies have equal seeds
    frequency = hits.groupBy("h", "g").agg(F.count("*").alias("c"))
    counted = stage(seeds.join(frequency, ["h", "g"], "left").withColumn("c", F.coalesce("c", F.lit(0))), "tiling-counted")
    # of an item the most frequent seeds that together lie over too few of its tokens need not be looked up
    common = Window.partitionBy("ik").orderBy(F.desc("c"), "h", "g").rowsBetween(Window.unboundedPreceding, 0)
    over = F.sum(F.col("size") * F.size("places")).over(common)
    rare = stage(counted.withColumn("over", over).filter((F.col("over") >= F.ceil(F.lit(coverage) * F.col("n"))) & (F.col("c") > 0)).select("ik", "h", "g"), "tiling-rare")
    pairs = stage(hits.join(rare, ["h", "g"]).select("k", "ik").distinct(), "tiling-pairs")
    looked = pairs.join(counted.filter("c > 0").select("ik", "size", "h", "g", "places"), "ik")
    both = stage(looked, "tiling-looked").join(hits, ["k", "h", "g"])
    shared_seeds = both.groupBy("k", "ik", "size").agg(F.collect_list(F.struct("places", "ps")).alias("seeds"))
    found = stage(shared_seeds.join(ids, "ik").select("k", "ik", "size", "ids", "seeds").mapInPandas(_tile_pairs(coverage), FOUND), "tiling-found")
    discard(items, seeds, ids, scanned, hits, counted, rare, pairs)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """Pairs of a document and a benchmark text of which at least ``coverage`` is tiled by the document.

    docs needs text and the columns of carry, benchmark needs item_id and text; other
    columns, whatever their names, are not read. Returns the columns of carry and
    item_id, item_tokens, covered_tokens, n_tiles, longest_tile, which carry must not name. Null or empty texts,
    on either side, match nothing; a benchmark text of fewer than min_match tokens must
    occur as a whole; repeated documents and repeated benchmark texts each give their own
    pairs; an empty table on either side gives none. Whole texts are compared, however long.
    """
    result = ["item_id", "item_tokens", "covered_tokens", "n_tiles", "longest_tile"]
    if set(result) & set(carry):
        raise ValueError(f"{', '.join(result)} are columns of the result")
    found = find_pairs(docs, benchmark, coverage, min_match)
    named = benchmark.filter("text is not null").select(F.col("item_id").cast("long"), text_key(F.col("text")).alias("ik")).join(found, "ik")
    mine = docs.filter("text is not null").select(*[F.col(c).alias(f"__{c}") for c in carry], text_key(F.col("text")).alias("k"))
    return mine.join(stage(named, "tiling-named"), "k").select(*[F.col(f"__{c}").alias(c) for c in carry], *result)


def query(spark, sf_dir: str) -> DataFrame:
    from refloom.llm.common import read

    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("coverage", F.col("covered_tokens") / F.col("item_tokens"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """docs without those that hold a benchmark text; all columns and all other rows stay.

    docs needs text; its other columns may have any names. A null or empty text stays, as it holds nothing; of repeated rows all
    stay or all go; an empty table on either side changes nothing.
    """
    leaks = stage(find_pairs(docs, benchmark, coverage, min_match).select(F.col("k").alias("__leak")).distinct(), "tiling-leaks")
    marked = docs.withColumn("__key", text_key(F.col("text")))
    return marked.join(leaks, F.col("__key") == F.col("__leak"), "left_anti").select(*docs.columns)
