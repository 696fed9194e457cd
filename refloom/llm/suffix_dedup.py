"""Exact substring dedup by external induced suffix sorting.

Which 200-byte strings occur twice is decided without looking at all suffixes of
the corpus at once:

1. *Samples.* Every window of ``length`` bytes contains a content-defined anchor,
   the position with the smallest k-gram hash. Equal windows have equal anchors at
   equal offsets, so windows can only match within the shard of their anchor's hash.
   Consecutive windows with one anchor form a run.
2. *Shards.* Runs whose anchor hash occurs once are unique and need no sorting.
   The other runs are pre-aggregated by content: a run that occurs twice is
   repeated as a whole, and one copy of each different run goes to its shard, so
   that thousands of copies weigh as one.
3. *Induced sorting.* In a shard the suffixes at anchors arrive sorted by Spark's
   external sorter, and their common-prefix values are read off neighbours. The
   suffixes 1, 2, 3... bytes further left are then induced: each pass takes the
   tuples (preceding byte, run, common prefix) in suffix order and puts them into
   a disk-backed monotone priority queue keyed by the byte; the next pass takes
   them out in order. The common prefix of two neighbours in a bucket is one more
   than the minimum over the tuples between them. A window is repeated where the
   common prefix with a neighbour reaches ``length``.

Queues, runs and what is known of them are held up to ``queue_bytes`` each; what exceeds it goes to the
executor's local disk, where it is read in blocks or mapped, so one shard may be far larger than memory.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import one_of_each, small_batches, stage, text_key

GRAM = 32
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MULTIPLIER = 0x9E3779B97F4A7C15


def _gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of each gram-byte string (gram: a power of two), by doubling."""
    h, n = _BYTES[data], 1
    while n < gram:
        h = h[:-n] * np.uint64(pow(_MULTIPLIER, n, 2**64)) + h[n:]
        n *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n, m = 1, values
    while n * 2 <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[: len(m) - (width - n)], m[width - n :]) if width > n else m


_POSITION_BITS = 20
_SEGMENT = 1 << 19


def window_runs(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (anchor hash, first window, windows, offset of the anchor in the last window).

    The low bits of a hash make room for the position, so that the minimum also
    says where it is, the first of equals. Positions are relative to a segment;
    a run ends at a segment's end, which splits it but changes no anchor.
    """
    grams = _gram_hashes(np.frombuffer(data, np.uint8))
    width, mask = length - GRAM + 1, np.uint64((1 << _POSITION_BITS) - 1)
    parts = []
    for at in range(0, len(grams) - width + 1, _SEGMENT):
        part = grams[at : at + _SEGMENT + width - 1]
        low = _sliding_min((part & ~mask) | np.arange(len(part), dtype=np.uint64), width)
        starts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        ends = np.append(starts[1:], len(low))
        anchor = (low[starts] & mask).astype(np.int64)
        parts.append((part[anchor], starts + at, ends - starts, anchor - (ends - 1)))  # the whole hash, so that few anchors meet by chance
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class SpillQueue:
    """Monotone priority queue of numpy records: 256 FIFO buckets, spilled to disk beyond a bound.

    Induction inserts into each bucket in final order, so a bucket is a queue and
    the buckets in turn give the order. Blocks beyond ``bound`` bytes go to one
    temporary file, which is deleted with the queue.
    """

    def __init__(self, bound: int):
        self.bound, self.held, self.file = bound, 0, None
        self.buckets: list[list] = [[] for _ in range(256)]

    def put(self, symbol: int, block: np.ndarray) -> None:
        if self.held + block.nbytes > self.bound:
            if self.file is None:
                self.file = tempfile.TemporaryFile(prefix="refloom-queue-")
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(block.tobytes())
            self.buckets[symbol].append((at, block.nbytes, block.dtype))
        else:
            self.held += block.nbytes
            self.buckets[symbol].append(block)

    def drain(self, block_rows: int) -> Iterator[np.ndarray]:
        """All records in order, in blocks of about block_rows."""
        pending, n = [], 0
        for bucket in self.buckets:
            for item in bucket:
                if isinstance(item, tuple):
                    self.file.seek(item[0])
                    item = np.frombuffer(self.file.read(item[1]), item[2])
                pending.append(item)
                n += len(item)
                if n >= block_rows:
                    yield np.concatenate(pending)
                    pending, n = [], 0
            bucket.clear()
        if pending:
            yield np.concatenate(pending)
        if self.file is not None:
            self.file.close()
            self.file = None
        self.held = 0


_FAR = 2**31 - 1
TUPLE = np.dtype([("run", np.int64), ("lcp", np.int32)])


class _Induction:
    """One pass: blocks of tuples in suffix order in, the order one byte further left out."""

    def __init__(self, queue: SpillQueue):
        self.queue = queue
        #: per symbol the minimum common prefix since its last tuple; 0 before the first
        self.since = np.zeros(256, np.int64)

    def add(self, runs: np.ndarray, lcp: np.ndarray, symbols: np.ndarray) -> None:
        n = len(runs)
        order = np.argsort(symbols, kind="stable")
        sym = symbols[order]
        first = np.concatenate(([True], sym[1:] != sym[:-1]))
        heads = np.flatnonzero(first)
        present = sym[heads]
        new = np.empty(n, np.int64)
        inner = np.flatnonzero(~first)
        if len(inner):
            ranges = np.empty(2 * len(inner), np.int64)
            ranges[0::2] = order[inner - 1] + 1
            ranges[1::2] = order[inner] + 1
            padded = np.append(lcp, np.int32(0))
            new[inner] = np.minimum.reduceat(padded, ranges)[0::2]
        running = np.minimum.accumulate(lcp)
        new[heads] = np.minimum(self.since[present], running[order[heads]])
        tails = order[np.append(heads[1:], n) - 1]
        self.since = np.minimum(self.since, running[-1])
        backward = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.int32(_FAR))
        self.since[present] = backward[tails + 1]
        out = np.empty(n, TUPLE)
        out["run"] = runs[order]
        out["lcp"] = new + 1
        for symbol, a, b in zip(present.tolist(), heads.tolist(), np.append(heads[1:], n).tolist(), strict=True):
            self.queue.put(symbol, out[a:b])


def _base_lcp(right: list[bytes], length: int) -> np.ndarray:
    """Common prefix of each sorted suffix with the one before; of the first, 0."""
    sizes = np.fromiter(map(len, right), np.int64, len(right))
    flat = np.frombuffer(b"".join(x.ljust(length, b"\0") for x in right), np.uint8).reshape(len(right), length)
    differ = flat[1:] != flat[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return np.concatenate(([0], np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1])))).astype(np.int32)


RUN = np.dtype([("h", np.int64), ("s", np.int64), ("at", np.int64), ("lcp", np.int32), ("low", np.int32), ("depth", np.int32)])


class Column:
    """Rows of a numpy type that are appended: in memory up to ``bound`` bytes, then in a temporary file that is mapped."""

    def __init__(self, dtype: np.dtype, bound: int):
        self.dtype, self.bound = np.dtype(dtype), bound
        self.rows, self.parts, self.file = 0, [], None

    def add(self, rows: np.ndarray) -> None:
        self.rows += len(rows)
        if self.file is None and self.rows * self.dtype.itemsize > self.bound:
            self.file = tempfile.TemporaryFile(prefix="refloom-shard-")
            for x in self.parts:
                self.file.write(x.tobytes())
            self.parts = []
        if self.file is None:
            self.parts.append(rows)
        else:
            self.file.write(rows.tobytes())

    def all(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        self.file.flush()
        return np.memmap(self.file, self.dtype, "r+", shape=self.rows)

    def close(self) -> None:
        self.parts = []
        if self.file is not None:
            self.file.close()


def _filled(n: int, value: int, dtype, bound: int, block_rows: int) -> Column:
    out = Column(dtype, bound)
    for at in range(0, n, block_rows):
        out.add(np.full(min(block_rows, n - at), value, dtype))
    return out


class Shards:
    """A chunk of whole shards for induced sorting, fed in suffix order.

    What it holds of runs, and the bytes left of their anchors, go to temporary files beyond ``bound`` bytes.
    """

    def __init__(self, length: int, bound: int):
        self.length, self.bound = length, bound
        self.rows, self.bytes = 0, 0
        self.runs, self.left = Column(RUN, bound), Column(np.uint8, bound)
        self.last: tuple[int, bytes] | None = None

    def add(self, h: np.ndarray, s: np.ndarray, right: list[bytes], left: list[bytes], low: np.ndarray) -> None:
        if not len(h):
            return
        h0, right0 = self.last or (int(h[0]), b"")
        lcp = _base_lcp([right0, *right], self.length)[1:]
        lcp[np.concatenate(([h0], h[:-1])) != h] = 0
        self.last = (int(h[-1]), right[-1])
        runs = np.empty(len(h), RUN)
        runs["h"], runs["s"], runs["lcp"], runs["low"] = h, s, lcp, low
        runs["depth"] = np.fromiter(map(len, left), np.int32, len(left))
        runs["at"] = self.bytes + np.cumsum(runs["depth"], dtype=np.int64) - runs["depth"]
        joined = np.frombuffer(b"".join(left), np.uint8)
        self.runs.add(runs)
        self.left.add(joined)
        self.rows += len(h)
        self.bytes += len(joined)

    def repeated(self, block_rows: int = 1_000_000) -> Iterator[tuple[np.ndarray, ...]]:
        """(h, s, first offset, last offset) of stretches of repeated windows, as they end."""
        runs = self.runs.all()
        for row, a, b in _induce(runs, self.left.all(), self.length, self.bound, block_rows):
            yield runs["h"][row], runs["s"][row], a, b
        self.runs.close()
        self.left.close()


def _ended(open_: np.ndarray, flagged: np.ndarray | None, offset: int, block_rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first offset, last offset) of open stretches that are not flagged any more, which are closed. Flags are taken back."""
    for at in range(0, len(open_), block_rows):
        part = open_[at : at + block_rows]
        gone = part >= 0 if flagged is None else (part >= 0) & ~flagged[at : at + block_rows].view(bool)
        end = np.flatnonzero(gone)
        if len(end):
            yield end + at, part[end].copy(), np.full(len(end), offset)
            part[end] = -1
        if flagged is not None:
            flagged[at : at + block_rows] = 0


def _induce(runs: np.ndarray, left_bytes: np.ndarray, length: int, queue_bytes: int, block_rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The passes: a row of RUN has its common prefix with the row before at the anchor, the smallest and the largest offset of its
    anchor in its windows, and where the bytes before its anchor are in left_bytes."""
    n = len(runs)
    marks, opened = _filled(n, 0, np.uint8, queue_bytes, block_rows), _filled(n, -1, np.int32, queue_bytes, block_rows)
    flagged, open_ = marks.all(), opened.all()  # whether a run's window at this offset is repeated; the offset at which its present stretch began

    def base() -> Iterator[np.ndarray]:
        for at in range(0, n, block_rows):
            part = runs[at : at + block_rows]
            block = np.empty(len(part), TUPLE)
            block["run"], block["lcp"] = np.arange(at, at + len(part)), part["lcp"]
            yield block

    blocks: Iterator[np.ndarray] = base()
    deepest = max((int(runs["depth"][at : at + block_rows].max()) for at in range(0, n, block_rows)), default=0)
    offset = 0
    for offset in range(deepest + 1):
        queue = SpillQueue(queue_bytes)
        nxt = _Induction(queue)
        last, carry, alive = -1, _FAR, 0
        for block in blocks:
            run, common = np.ascontiguousarray(block["run"]), np.ascontiguousarray(block["lcp"])
            same = np.flatnonzero(common >= length)
            if len(same):
                both = np.concatenate((run[same], run[same[same > 0] - 1], [last] if same[0] == 0 and last >= 0 else []))
                both = both.astype(np.int64)
                flagged[both[(runs["low"][both] <= offset) & (runs["depth"][both] >= offset)]] = 1
            last = int(run[-1])
            depth = runs["depth"][run]
            keep = np.flatnonzero(depth > offset)
            if not len(keep):
                carry = min(carry, int(common.min()))
                continue
            kept_lcp = np.minimum.reduceat(common, np.concatenate(([0], keep[:-1] + 1)))
            if keep[-1] + 1 < len(common):  # the last range went on to the block's end
                kept_lcp[-1] = common[(keep[-2] + 1 if len(keep) > 1 else 0) : keep[-1] + 1].min()
            kept_lcp[0] = min(int(kept_lcp[0]), carry)
            carry = int(common[keep[-1] + 1 :].min(initial=_FAR))
            kept = run[keep]
            nxt.add(kept, kept_lcp, np.asarray(left_bytes[runs["at"][kept] + depth[keep] - 1 - offset]))
            alive += len(kept)
        for at in range(0, n, block_rows):
            part = open_[at : at + block_rows]
            part[flagged[at : at + block_rows].view(bool) & (part < 0)] = offset
        yield from _ended(open_, flagged, offset - 1, block_rows)
        if not alive:
            break
        blocks = queue.drain(block_rows)
    yield from _ended(open_, None, offset, block_rows)
    marks.close()
    opened.close()


RUNS = "h long, s long, k binary, p int, n int, o int"


def _find_runs(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns: list[tuple] = []
            contents: list[int] = []
            keys: list[bytes] = []
            for key, text in zip(batch["k"], batch["text"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                h, p, n, o = window_runs(data, length)
                columns.append((h, p, n, o))
                ends = (p + n - 1 + length).tolist()
                contents += [int.from_bytes(hashlib.blake2b(data[a:b], digest_size=8).digest(), "little", signed=True) for a, b in zip(p.tolist(), ends, strict=True)]
                keys += [key] * len(h)
            if columns:
                h, p, n, o = (np.concatenate(x) for x in zip(*columns, strict=True))
                yield pd.DataFrame({"h": h.astype(np.int64), "s": contents, "k": keys, "p": p.astype(np.int32), "n": n.astype(np.int32), "o": o.astype(np.int32)})

    return run


def _cut(length: int):
    """(text, runs of it) -> the bytes right and left of each run's anchor.

    A row that is there twice would add equal runs, which are repeats indeed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch["text"], batch["runs"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in runs:
                    end = x["p"] + x["n"] - 1
                    anchor = end + x["o"]
                    rows.append((x["h"], x["s"], data[anchor : end + length], data[x["p"] : anchor], x["o"]))
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=["h", "s", "r", "l", "o"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["h", "s", "r", "l", "o"])

    return run


def _sort_shards(length: int, queue_bytes: int, chunk_rows: int):
    """Rows come sorted by (h, r); chunks of whole shards, a huge shard alone."""

    def frames(shards: Shards) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for part in shards.repeated():
            held.append(part)
            rows += len(part[0])
            if rows >= 100_000:
                yield frame(held)
                held, rows = [], 0
        if held:
            yield frame(held)

    def frame(parts: list[tuple]) -> pd.DataFrame:
        h, s, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({"h": h, "s": s, "a": a.astype(np.int32), "b": b.astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards = Shards(length, queue_bytes)
        for batch in batches:
            h, s, o = (batch[c].to_numpy(np.int64) for c in ("h", "s", "o"))
            right, left = batch["r"].tolist(), batch["l"].tolist()
            cut = 0
            if shards.rows >= chunk_rows:
                other = np.flatnonzero(h != shards.last[0])
                cut = int(other[0]) if len(other) else len(h)
                shards.add(h[:cut], s[:cut], right[:cut], left[:cut], o[:cut])
                if cut < len(h):
                    yield from frames(shards)
                    shards = Shards(length, queue_bytes)
            shards.add(h[cut:], s[cut:], right[cut:], left[cut:], o[cut:])
        if shards.rows:
            yield from frames(shards)

    return run


def _remove(texts: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in spans) if spans is not None else ():
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                rows.append((doc_id, len(data), len(data) - len(left), len(merged), hashlib.sha256(left).hexdigest(), merged, *([left.decode("utf-8", "replace")] if texts else [])))
            columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept_text"] if texts else [])]
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    return run


def suffix_dedup(docs: DataFrame, length: int = 200, queue_bytes: int = 64 << 20, chunk_rows: int = 100_000, texts: bool = True) -> DataFrame:
    """Remove every byte that a ``length``-byte string covers which starts elsewhere too.

    docs needs doc_id and text; other columns, whatever their names, are not read.
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (maximal removed
    byte ranges, end exclusive) and, if texts, kept_text (remaining bytes; a character cut
    in two shows as U+FFFD, the digest is of the bytes). One row per input row:
    null text is empty; texts shorter than ``length`` are kept whole; repeated rows
    are copies of each other, so all their bytes go; null or repeated doc_ids do
    no harm since rows are matched by content; an empty table gives none.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    spark = docs.sparkSession
    small_batches(spark)
    whole_texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("k"))
    runs = stage(whole_texts.select("k", "text").mapInPandas(_find_runs(length), RUNS), "suffix-runs")
    # staged sides make the joins plain exchanges, so that AQE can split a hot key
    shared = stage(runs.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "suffix-shared")
    runs = stage(runs.join(shared, "h"), "suffix-candidates")
    groups = runs.groupBy("h", "s").agg(F.count("*").alias("c"), F.min(F.struct("k", "p", "n", "o")).alias("x"))
    whole = groups.filter("c > 1").select("h", "s", F.col("x.o").alias("a"), (F.col("x.o") + F.col("x.n") - 1).alias("b"))
    several = groups.groupBy("h").agg(F.count("*").alias("d")).filter("d > 1").select("h")
    one = (
        groups.join(several, "h", "left_semi")
        .groupBy(F.col("x.k").alias("k"))
        .agg(F.collect_list(F.struct("h", "s", F.col("x.p").alias("p"), F.col("x.n").alias("n"), F.col("x.o").alias("o"))).alias("runs"))
    )
    cut = one_of_each(whole_texts, one).mapInPandas(_cut(length), "h long, s long, r binary, l binary, o int")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = cut.repartition(parts, "h").sortWithinPartitions("h", "r").mapInPandas(_sort_shards(length, queue_bytes, chunk_rows), "h long, s long, a int, b int")
    hits = stage(found.unionByName(whole), "suffix-hits")
    last = F.col("p") + F.col("n") - 1 + F.col("o")  # position of the anchor
    spans = (
        runs.join(hits, ["h", "s"])
        .select("k", (last - F.col("b")).alias("a"), (last - F.col("a") + length).alias("b"))
        .groupBy("k")
        .agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>" + (", kept_text string" if texts else "")
    return whole_texts.join(stage(spans, "suffix-spans"), "k", "left").select("doc_id", "text", "spans").mapInPandas(_remove(texts), schema)


def query(spark, sf_dir: str) -> DataFrame:
    from refloom.llm.common import read

    return suffix_dedup(read(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: DuckDB: every 200-byte string of every text by its start, counted over all; texts are spelt in hex, two characters a byte.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER () AS row FROM documents),
w AS (SELECT row, i, md5_number(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT row, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
a AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY s) AS c FROM w) WHERE c > 1),
g AS (SELECT row, i, sum(CAST(i > coalesce(p + 200, -1) AS INT)) OVER (PARTITION BY row ORDER BY i) AS k FROM (SELECT row, i, lag(i) OVER (PARTITION BY row ORDER BY i) AS p FROM a)),
r AS (SELECT row, k, min(i) AS b, max(i) + 200 AS e FROM g GROUP BY row, k),
q AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY row ORDER BY k) AS p FROM r),
x AS (SELECT d.row, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * p + 1, 2 * (b - p)), '' ORDER BY k) AS kept FROM q JOIN d ON q.row = d.row GROUP BY d.row)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN x ON d.row = x.row
"""
