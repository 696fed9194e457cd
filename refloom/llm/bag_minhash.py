"""Near-duplicate classes by BagMinHash over multisets of word shingles.

A document is a multiset of shingles (five words). The weight of a shingle is its
count, discretised at the integers. The weight axis is cut into [0,1), [1,2), [2,4), [4,8)...,
and each of these intervals is the root of a hierarchy of Poisson processes per shingle, seeded by shingle and
interval, with the interval's width as its rate. A process gives its earliest point: a time, one of ``m``
components, and a position in the interval; the point counts if the position lies under the weight. From that
time on the process is split into those of the interval's two halves, which go on by themselves (at unit width:
into its own continuation). A half is only followed if it begins under the weight, and no process is followed
past the latest time of a component, so points that can't matter are never drawn. All documents see the
same hierarchy of a shingle, so the signature, the earliest time in each component, agrees
between two documents in a component with the probability of their
weighted Jaccard similarity. Most shingles stop after a point or two.

Signatures are cut into bands. In a band's bucket all members are first compared with
one leader, not with each other: the text that meets most others in all buckets, such as
the original of edited copies. In the buckets that still hold several classes, members of different
classes are then compared by their whole signatures, in blocks of bounded size; only
pairs whose signatures agree nearly enough are verified, in the same task, so that no pairs of a group are
written anywhere. Candidates are verified by the overlap of the shingle multisets, and classes are the connected components of verified
links. Equal texts are one node throughout. A link of exactly the least similarity
shares no bucket with a chance of 3e-6, and its signatures agree too little with one of 2e-4, should
no other path connect the two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import WordHashes, discard, one_of_each, small_batches, stage, text_key, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
_P = np.uint64(0x9E3779B97F4A7C15)
_ALL = 2**64 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``size`` words; of a shorter text, one of all its words."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * _P + words[i : i + n]
    return _mix(h + np.uint64(size))


def weighted(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The multiset of a whole text: different shingles, sorted, and their counts."""
    words = words_of(text)
    h = np.sort(shingle_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), size))
    if not len(h):
        return h, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[at], np.diff(np.append(at, len(h)))


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 0 if both are empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    common = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    total = int(a[1].sum() + b[1].sum()) - common
    return common / total if total else 0.0


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int, reach: float = 1.0) -> np.ndarray:
    """BagMinHash signatures (rows: documents), by rounds over all processes still of use.

    Processes are followed up to a time by which a document's components are likely to be filled, ``reach`` times the usual one; documents
    where some are not are signed again with twice the reach. So the points that are drawn depend on m, not on the weights.
    """
    sizes = np.fromiter((len(h) for h, _ in sets), np.int64, len(sets))
    doc = np.repeat(np.arange(len(sets)), sizes)
    h = np.concatenate([x for x, _ in sets]) if len(sets) else np.zeros(0, np.uint64)
    w = np.concatenate([x for _, x in sets]) if len(sets) else np.zeros(0, np.int64)
    reg = np.full((len(sets), m), np.inf)
    if not len(h):
        return reg
    flat, latest = reg.reshape(-1), reach * m * (np.log(m) + 4) / np.maximum(np.bincount(doc, w, len(sets)), 1)
    parts, level, low, width = [], 0, 0, 1
    while True:
        on = np.flatnonzero(w > low)
        if not len(on):
            break
        seed = _mix(h[on] ^ _mix(np.full(1, level + 1, np.uint64) * _P))
        parts.append((doc[on], seed, np.full(len(on), width), w[on] - low))
        level, low, width = level + 1, low + width, max(1, low + width)
    # room: how much of a process's interval lies under the weight
    doc, seed, width, room = (np.concatenate(x) for x in zip(*parts, strict=True))
    t, filled = np.zeros(len(doc)), np.zeros(len(sets), bool)
    while len(doc):
        u = _mix(seed + _P)
        t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / width
        useful = t < latest[doc]
        doc, seed, width, room, t = doc[useful], seed[useful], width[useful], room[useful], t[useful]
        v = _mix(seed ^ np.uint64(0xD6E8FEB86659FD93))
        component = ((v & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
        inside = (width <= room) | ((v >> np.uint64(32)).astype(np.float64) / 2.0**32 * width < room)
        np.minimum.at(flat, doc[inside] * m + component[inside].astype(np.int64), t[inside])
        touched = np.flatnonzero(np.bincount(doc, minlength=len(sets)))
        top = reg[touched].max(axis=1)
        latest[touched], filled[touched] = np.minimum(latest[touched], top), np.isfinite(top)
        seed = _mix(seed + np.uint64(2 * int(_P) & _ALL))  # the lower half, or the continuation
        wide = np.flatnonzero(width > 1)
        if len(wide):
            half = np.maximum(width // 2, 1)
            upper = wide[room[wide] > half[wide]]
            doc, t = np.concatenate((doc, doc[upper])), np.concatenate((t, t[upper]))
            room, seed = np.concatenate((room, room[upper] - half[upper])), np.concatenate((seed, _mix(seed[upper] ^ np.uint64(0xA0761D6478BD642F))))
            width = np.concatenate((half, half[upper]))
    again = np.flatnonzero(~filled & (sizes > 0))
    if len(again):
        reg[again] = signatures([sets[i] for i in again], m, 2 * reach)
    return reg


def band_hashes(reg: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(reg[:, : bands * rows]).view(np.uint64).reshape(len(reg), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(reg), bands)) * np.uint64(0x9FB21C651E98DF25)
    for i in range(rows):
        h = _mix(h * _P + bits[:, :, i])
    return h.view(np.int64)


def _portions(some: list[int], sets: list, most: int = 1 << 17) -> Iterator[list[int]]:
    """some in portions of about ``most`` different shingles, a longer text alone."""
    part, n = [], 0
    for i in some:
        if part and n + len(sets[i][0]) > most:
            yield part
            part, n = [], 0
        part.append(i)
        n += len(sets[i][0])
    yield part


def _sign(bands: int, rows: int):
    """Band hashes of each text, and its signature as 16 bits of each component. A task signs the copies that it meets once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, met = WordHashes(), set()
        for batch in batches:
            if len(met) > 50_000:
                met.clear()
            new = [k not in met and not met.add(k) for k in batch["k"]]
            batch = batch[new]
            sets = [weighted(x, hashes) for x in batch["text"]]
            some = [i for i, x in enumerate(sets) if len(x[0])]
            if some:
                reg = np.concatenate([signatures([sets[i] for i in part], bands * rows) for part in _portions(some, sets)])
                short = _mix(reg.view(np.uint64)).astype(np.uint16)
                yield pd.DataFrame({"k": batch["k"].iloc[some].to_numpy(), "sig": [x.tobytes() for x in short], "bands": list(band_hashes(reg, bands, rows))})

    return run


def _compare(bands: int, rows: int, least: float, similarity: float):
    """Links in a bucket between its classes so far. Rows come sorted by bucket and pair of blocks.

    Members of different classes are compared by signature; those that agree in a share of at least ``least``
    of their components are verified, each pair in the first of its common buckets.
    """

    def group(parts: list[pd.DataFrame], hashes: WordHashes, out: list[tuple]) -> None:
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        n, first, second = (int(pdf[c].iloc[0]) for c in ("n", "i", "j"))
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), bands * rows)
        root = pd.factorize(pdf["root"])[0]
        block, key, text = pdf["block"].to_numpy(), pdf["k"].tolist(), pdf["text"].tolist()
        right, bags = np.flatnonzero(block == second), {}

        def of(i: int) -> tuple:
            if i not in bags:
                bags[i] = weighted(text[i], hashes)
            return bags[i]

        for x in np.flatnonzero(block == first).tolist():
            near = right[right > x] if first == second else right
            near = near[root[near] != root[x]]
            if len(near):
                equal = sig[near] == sig[x]
                good = equal.mean(axis=1) >= least
                near, equal = near[good], equal[good]
                good = equal.reshape(len(near), bands, rows).all(axis=2).argmax(axis=1) == n
                out += [(key[x], key[y]) for y in near[good].tolist() if jaccard(of(x), of(y)) >= similarity]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, parts, now = WordHashes(), [], None
        for batch in batches:
            out: list[tuple] = []
            keys = batch[["band", "i", "j"]].to_numpy(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if a == b:
                    continue
                if parts and tuple(keys[a]) != now:
                    group(parts, hashes, out)
                    parts = []
                parts.append(batch.iloc[a:b])
                now = tuple(keys[a])
            yield pd.DataFrame(out, columns=["a", "b"])
        out = []
        if parts:
            group(parts, hashes, out)
        yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _verify(similarity: float):
    """Multisets of the last texts seen are kept, as one text is in many pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen = WordHashes(), {}

        def of(key: bytes, text: str) -> tuple:
            if key not in seen:
                if len(seen) >= 500:
                    seen.clear()
                seen[key] = weighted(text, hashes)
            return seen[key]

        for batch in batches:
            good = [jaccard(of(a, ta), of(b, tb)) >= similarity for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True)]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "ok": good})

    return run


BLOCK = 500


def links(keyed: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) that connect each class of texts; keyed has doc_id, k (content key) and text."""
    signed = stage(keyed.select("k", "text").mapInPandas(_sign(bands, rows), "k binary, sig binary, bands array<long>"), "minhash-signed")
    members = signed.select(F.col("k").alias("a"), F.posexplode("bands").alias("n", "band"))
    short = F.xxhash64("a")
    several = stage(members.groupBy("band").agg(F.min(short).alias("x"), F.max(short).alias("y")).filter("x != y").select("band"), "minhash-several")
    live = stage(members.join(several.hint("merge"), "band").distinct(), "minhash-live")
    # a text that meets many others leads its buckets: the original of a group of edited copies is like each of them
    counts = stage(live.groupBy("band").agg(F.count("*").alias("c")), "minhash-counts")
    live, first = stage(live.join(counts, "band"), "minhash-counted"), live
    discard(first, counts)
    degree = stage(live.groupBy("a").agg(F.sum("c").alias("d")), "minhash-degree")
    order = F.struct("d", F.xxhash64("a").alias("r"), F.col("a").alias("b"))
    leader = stage(live.join(degree, "a").groupBy("band").agg(F.max(order).alias("m")).select("band", "m.b"), "minhash-leaders")
    pairs = stage(live.join(leader, "band").filter("a != b").select("a", "b").distinct(), "minhash-pairs")
    needed = live.select(F.col("a").alias("k")).distinct()
    texts = stage(one_of_each(keyed, needed).dropDuplicates(["k"]), "minhash-texts")
    ta, tb = texts.select(F.col("k").alias("a"), F.col("text").alias("ta")), texts.select(F.col("k").alias("b"), F.col("text").alias("tb"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
        return stage(both.mapInPandas(_verify(similarity), "a binary, b binary, ok boolean").filter("ok").select("a", "b"), "minhash-links")

    found = verified(pairs)
    # what a leader did not connect: pairs of different classes in one bucket, by whole signatures, in blocks
    roots = components(found)
    placed = live.join(roots.withColumnRenamed("k", "a"), "a", "left").select("band", "n", "a", "c", F.coalesce("root", "a").alias("root"))
    open_ = stage(placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("band"), "minhash-open")
    blocks = F.ceil(F.col("c") / block).cast("int")
    rest = stage(placed.join(open_, "band").withColumn("block", F.pmod(F.xxhash64("a"), blocks).cast("int")), "minhash-rest")
    keys = stage(rest.select(F.col("a").alias("k")).distinct(), "minhash-keys")
    sigs = signed.groupBy("k").agg(F.first("sig").alias("sig")).join(keys, "k")  # copies are combined before the shuffle
    wide = stage(sigs.join(texts, "k"), "minhash-wide")
    dealt = rest.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("band", "n", F.col("a").alias("k"), "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    least = similarity - 3.5 * (similarity * (1 - similarity) / (bands * rows)) ** 0.5
    parts = max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = dealt.join(wide, "k").repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    more = stage(ordered.mapInPandas(_compare(bands, rows, least, similarity), "a binary, b binary"), "minhash-more")
    discard(signed, several, live, degree, leader, pairs, texts, open_, rest, keys, wide)
    return found.unionByName(more)


def components(edges: DataFrame) -> DataFrame:
    """(k, root) of each node of an undirected graph, by alternating large-star and small-star steps.

    Each step only takes minima per node, which are combined before the shuffle,
    and the joins back are plain equi-joins, whose hot nodes AQE splits.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now = stage(edges.select(hi, lo).filter("hi != lo").distinct(), "components")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        near = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        last, now = now, stage(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "components")
        discard(last)
    return now.select(F.col("hi").alias("k"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("k"), F.col("lo").alias("root")).distinct())


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Near-duplicate classes of documents: weighted Jaccard over five-word shingles of at least ``similarity``.

    docs needs doc_id and text; other columns, whatever their names, are not read.
    Returns one row per input row: doc_id, class_id (the smallest doc_id of the
    class), class_size, keep (true for one row of each class). Equal texts are one class, null counting as empty; a text
    without words is like no other but its equals; a text of under five words has
    one shingle. A class whose doc_ids are all null has a null class_id. Of rows
    equal in doc_id and text, which one is kept can't be told apart. An empty table
    gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("k"))
    edges = links(keyed, similarity, bands, rows)
    roots = components(edges)
    nodes = stage(
        keyed.groupBy("k").agg(F.min("doc_id").alias("id"), F.count("*").alias("c")).join(roots, "k", "left").select("k", "id", "c", F.coalesce("root", "k").alias("root")),
        "minhash-nodes",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "k"))
    classes = nodes.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("c").alias("class_size"), first.alias("f"))
    classes = stage(classes, "minhash-classes")
    members = stage(nodes.join(classes, "root").select("k", "class_id", "class_size", (F.col("f.k") == F.col("k")).alias("first")), "minhash-members")
    out = keyed.select("doc_id", "k", F.monotonically_increasing_id().alias("row"))
    ids = stage(out, "minhash-rows")
    # min(row) per doc_id and text is combined before the shuffle; the last join has staged tables on both sides
    each = ids.groupBy("k", "doc_id").agg(F.min("row").alias("row"))
    first_rows = members.filter("first").select(F.col("k").alias("fk"), F.col("class_id").alias("c"))
    kept = each.join(first_rows, (F.col("k") == F.col("fk")) & F.col("doc_id").eqNullSafe(F.col("c"))).groupBy("k").agg(F.min("row").alias("kept_row"))
    final = stage(members.join(kept, "k", "left").select("k", "class_id", "class_size", "kept_row"), "minhash-final")
    discard(nodes, classes, members)
    return ids.join(final.hint("merge"), "k").select("doc_id", "class_id", "class_size", F.coalesce(F.col("row") == F.col("kept_row"), F.lit(False)).alias("keep"), "k")


def query(spark, sf_dir: str) -> DataFrame:
    from refloom.llm.common import read

    return near_duplicates(read(spark, sf_dir, "documents")).drop("k")


#: DuckDB: all pairs of different texts that share a shingle, their exact similarity, and the components of those alike enough.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
t AS (SELECT t, row_number() OVER (ORDER BY min(doc_id)) AS k FROM d GROUP BY t),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
s AS (SELECT k, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS g FROM (SELECT k, w, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1)) AS i FROM w WHERE len(w) > 0)),
b AS (SELECT k, g, count(*) AS c FROM s GROUP BY k, g), n AS (SELECT k, sum(c) AS n FROM b GROUP BY k),
p AS (SELECT x.k AS a, y.k AS b, sum(least(x.c, y.c)) AS c FROM b x JOIN b y ON x.g = y.g AND x.k < y.k GROUP BY x.k, y.k),
e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.k JOIN n y ON p.b = y.k WHERE CAST(p.c AS DOUBLE) / (x.n + y.n - p.c) >= CAST({SIMILARITY} AS DOUBLE)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(k, r) AS (SELECT k, k FROM t UNION SELECT reach.k, l.b FROM reach JOIN l ON reach.r = l.a),
o AS (SELECT k, min(r) AS root FROM reach GROUP BY k), m AS (SELECT d.doc_id, o.root FROM d JOIN t ON d.t = t.t JOIN o ON t.k = o.k),
c AS (SELECT root, min(doc_id) AS class_id, count(*) AS class_size FROM m GROUP BY root)
SELECT m.doc_id, c.class_id, c.class_size, m.doc_id = c.class_id AS keep FROM m JOIN c ON m.root = c.root
"""


def drop_near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """docs with one document of each near-duplicate class, that of the smallest doc_id (null last); all columns stay.

    docs needs doc_id and text; its other columns may have any names but __key, __id and __k. Rows are told apart by doc_id and text;
    of rows equal in both, one stays, whatever their other columns hold. Null texts count as empty, and all texts that are
    empty are one class; texts are compared whole; an empty table gives none.
    """
    judged = near_duplicates(docs.select("doc_id", "text"), **kw)
    keep = judged.filter("keep").select(F.col("doc_id").alias("__id"), F.col("k").alias("__k"))
    marked = docs.withColumn("__key", text_key(F.col("text")))
    joined = marked.join(keep, F.col("__key").eqNullSafe(F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return joined.dropDuplicates(["__key", "doc_id"]).select(*docs.columns)
