import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from refloom.llm.suffix_dedup import Shards, suffix_dedup, window_runs


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                flags[i : i + length] = True
        out.append(flags)
    return out


def local(texts, length, bound, block):
    rows = []
    for d, t in enumerate(texts):
        if len(t) < length:
            continue
        for h, p, n, o in zip(*(x.tolist() for x in window_runs(t, length)), strict=True):
            end = p + n - 1
            rows.append((h, t[end + o : end + length], t[p : end + o], o, d, end + o))
    rows.sort(key=lambda r: r[:2])
    shards = Shards(length, bound)
    for i in range(0, len(rows), 7):
        part = rows[i : i + 7]
        shards.add(np.array([r[0] for r in part]), np.arange(i, i + len(part)), [r[1] for r in part], [r[2] for r in part], np.array([r[3] for r in part]))
    out = [np.zeros(len(t), bool) for t in texts]
    if rows:
        for part in shards.repeated(block):
            for s, a, b in zip(*(x.tolist() for x in part[1:]), strict=True):
                _, _, _, _, d, anchor = rows[s]
                out[d][anchor - b : anchor - a + length] = True
    return out


@pytest.mark.parametrize("bound, block", [(1 << 30, 1_000_000), (50, 5)])
@pytest.mark.parametrize("seed", range(12))
def test_induced_sorting_finds_what_counting_finds(seed, bound, block):
    r = random.Random(seed)
    letters = [b"ab", b"abcdefgh \x00", bytes(range(256))][seed % 3]
    make = lambda n: bytes(r.choice(letters) for _ in range(n))
    length, source, texts = r.choice([64, 70, 100]), make(400), []
    for _ in range(r.randint(1, 14)):
        t = make(r.randint(0, 150))
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, 300)
            t += source[i : i + r.randint(1, 200)] + make(r.randint(0, 30))
        texts.append(t)
    if seed % 4 == 0:
        texts += [b"a" * 500, b"\0" * 130]
    for x, y in zip(brute(texts, length), local(texts, length, bound, block), strict=True):
        assert (x == y).all()


def expected(texts, length):
    out = []
    for t, flags in zip(texts, brute(texts, length), strict=True):
        left = bytes(b for b, f in zip(t, flags, strict=True) if not f)
        spans = int((np.diff(np.concatenate(([0], flags.astype(int)))) == 1).sum())
        out.append((len(t), int(flags.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def test_whole_operator_against_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéß ") for _ in range(r.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", "x" * 199, "y" * 400, passage, passage]
    for i in range(12):
        t = " ".join(word() for _ in range(40))
        texts.append(t + passage[i * 3 : 260 + i] + word() if i % 2 else t)
    rows = [(i if i != 3 else None, t, 1, "clash") for i, t in enumerate(texts)] + [(4, passage, 1, "clash")]
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, k int, spans string"), queue_bytes=4096, chunk_rows=8).collect()
    want = expected([(t or "").encode() for _, t, *_ in rows], 200)
    assert sorted((g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == sorted(want)
    by_id = {g.doc_id: g for g in got if g.doc_id not in (None, 4)}
    assert all((g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == want[i] for i, g in by_id.items())


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_memory_does_not_grow_with_the_shard():
    """A shard of over 20 times the bound, in parts, against the memory that a small one takes."""
    r = np.random.default_rng(3)
    peaks, bound, length = [], 1 << 20, 64
    for n in (20_000, 200_000):
        shards, expected = Shards(length, bound), 0
        tracemalloc.start()
        for at in range(0, n, 5_000):
            # pairs of equal runs: the first bytes number them, so they come in order
            numbers = np.arange(at, at + 5_000) // 2
            right = [b"%08d" % x + b"-" * 56 for x in numbers.tolist()]
            left = [bytes(r.integers(0, 256, 100, dtype=np.uint8)) for _ in range(5_000)]
            shards.add(np.full(5_000, 7), np.arange(at, at + 5_000), right, left, np.zeros(5_000, np.int64))
        assert shards.bytes + shards.rows * 40 > 2 * bound
        found = 0
        for part in shards.repeated(10_000):
            found += len(part[0])
            expected = max(expected, int(part[3].max()))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found == n  # each run has an equal one at its anchor
    assert n * 140 > 20 * bound and peaks[1] < 1.5 * peaks[0] + 4 * bound, peaks


def test_long_texts_without_texts_in_the_result(spark):
    r = random.Random(9)
    base = "".join(r.choice("abcdefgh ") for _ in range(300_000))
    docs = spark.createDataFrame([(1, base), (2, "x" + base[100_000:150_000]), (3, "unlike " * 3)], "doc_id long, text string")
    got = {x.doc_id: x for x in suffix_dedup(docs, texts=False).collect()}
    assert "kept_text" not in got[1] and (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (50_000, 50_000, 0)
