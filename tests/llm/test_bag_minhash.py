import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from refloom.llm.bag_minhash import components, drop_near_duplicates, jaccard, links, near_duplicates, signatures, weighted
from refloom.llm.common import WordHashes, text_key


def bag(text):
    w = text.encode().split()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def exact(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 0.0


def test_signature_estimates_weighted_jaccard_without_bias():
    r, errors = random.Random(1), []
    for i in range(40):
        words = [r.choice("abc" if i % 2 else "abcdefghijklmnop") for _ in range(r.randint(30, 400))]
        other = words[:]
        for _ in range(r.randint(0, 20)):
            other[r.randrange(len(other))] = "z"
        a, b = (weighted(" ".join(x), WordHashes()) for x in (words, other))
        want = exact(bag(" ".join(words)), bag(" ".join(other)))
        assert abs(jaccard(a, b) - want) < 1e-12
        s = signatures([a, b], 1024)
        errors.append((s[0] == s[1]).mean() - want)
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.08


def brute_classes(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [bag(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or exact(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 6)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(1, 150))]
        for _ in range(r.randint(1, 6)):
            copy = base[:]
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


def test_classes_match_all_pairs(spark):
    texts = corpus()
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, k string")).collect()}
    want = brute_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(got[i].keep == (want[i] == i) and got[i].class_size == want.count(want[i]) for i in range(len(texts)))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "a b"), (None, "a b"), (5, "a b"), (None, "q"), (9, "w " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars", "7 root")
    got = near_duplicates(docs).collect()
    assert len(got) == 9 and sum(x.keep for x in got) == 5
    assert sorted(str(x.class_id) for x in got) == ["1", "1", "3", "4", "4", "4", "4", "9", "None"]
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(x.doc_id) for x in left.collect()) == ["1", "3", "4", "9", "None"]
    assert near_duplicates(docs.limit(0)).collect() == []


def near_threshold(seed):
    """Chains of edited copies whose similarities lie on both sides of 0.8."""
    r = random.Random(seed)
    texts = []
    for _ in range(120):
        base = [f"w{r.randrange(20_000)}" for _ in range(r.randint(60, 200))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = base[:]
            for _ in range(round(len(base) * r.uniform(0.005, 0.045))):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts


def test_recall_on_many_pairs_near_the_threshold(spark):
    texts = near_threshold(5)
    bags = [bag(t) for t in texts]
    close = [(i, j, exact(bags[i], bags[j])) for i in range(len(texts)) for j in range(i) if i // 5 == j // 5]
    linked = [(i, j) for i, j, s in close if s >= 0.8]
    assert len(linked) > 150 and sum(0.8 <= s < 0.85 for *_, s in close) > 25
    rows = list(enumerate(texts))
    got = {x.doc_id: x.class_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(texts)
    kept = sum(got[i] == got[j] for i, j in linked) / len(linked)
    assert kept >= 0.99  # recall of links
    assert all(want[i] == want[j] for i in range(len(texts)) for j in range(i) if got[i] == got[j])  # and no link too many


def test_buckets_of_many_blocks_lose_no_link(spark):
    # all texts share most bands with a common core but are only like their own twin
    r = random.Random(9)
    core = [f"c{i}" for i in range(60)]
    texts = []
    for i in range(40):
        own = [f"o{i}x{r.randrange(1000)}" for _ in range(20)]
        texts += [" ".join(core + own), " ".join(core + own[:-1] + ["end"])]
    keyed = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text", text_key(F.col("text")).alias("k"))
    got = components(links(keyed, block=3)).distinct().collect()
    root = {bytes(x.k): bytes(x.root) for x in got}
    keys = {x.doc_id: bytes(x.k) for x in keyed.collect()}
    want = brute_classes(texts)
    for i in range(len(texts)):
        for j in range(i):
            assert (root.get(keys[i], keys[i]) == root.get(keys[j], keys[j])) == (want[i] == want[j])


def test_copies_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, text) for i in range(300)] + [(7, text)] * 50 + [(None, text)] * 20 + [(1000, text + " more")]
    got = near_duplicates(spark.createDataFrame(spark.sparkContext.parallelize(rows, 13), "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {x.class_id for x in got} == {0} and {x.class_size for x in got} == {len(rows)}
    assert [x.doc_id for x in got if x.keep] == [0]
