import hashlib
import math
import re
from collections import Counter

from refloom.llm.mixing import mix


def fill_targets(sizes, weights, budget, cap):
    """Share the budget by weight; what exceeds cap times a source's size is shared among the others again."""
    targets, open_, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0], float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in over]
    return targets


def brute(rows, budget=None, epochs=3, packets=1000):
    """rows (doc_id, text, source) -> ({source: target}, [(doc_id, size, source, taken)]): packets by finish time up to the budget."""
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    queues = {s: [] for s in names}
    for n, (doc, text, s) in enumerate(rows):
        key = hashlib.md5(f"mix:{'null' if doc is None else doc}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        queues[s].append((key, n, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    sizes = [sum(x[2] for x in queues[s]) for s in names]
    budget = sum(sizes) if budget is None else budget
    targets = dict(zip(names, fill_targets(sizes, [i % 3 + 1 for i in range(len(names))], budget, epochs), strict=True))
    order = []
    for rank, s in enumerate(names):
        part, done = max(1, math.ceil(targets[s] / packets)), 0
        for e in range(epochs if targets[s] else 0):
            for key, n, size in sorted(queues[s]):
                for at in range(0, size, part):
                    words = min(part, size - at)
                    done += words
                    order.append((done / targets[s], rank, key, n, e, at, words))
    taken, left = Counter(), budget
    for _, _, _, n, _, _, words in sorted(order):
        taken[n] += min(words, left)
        left -= min(words, left)
    return targets, [(doc, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s, taken[n]) for n, (doc, t, s) in enumerate(rows)]


def check(spark, rows, partitions=4, **kw):
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, partitions), "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as row", "'x' as target")
    got = mix(docs, **kw).collect()
    targets, want = brute(rows, kw.get("budget"), kw.get("max_epochs", 3), kw.get("packets", 1000))
    assert sorted(map(str, ((x.doc_id, x.size, x.source, x.taken) for x in got))) == sorted(map(str, want))
    assert all(abs(x.target - targets[x.source]) < 1e-9 * max(1, x.target) for x in got)
    times = [x.finish_time for x in got if x.finish_time is not None]
    assert times == sorted(times)
    return got, targets


def test_targets_are_capped_and_reshared(spark):
    texts = {"a": 100, "b": 1, "c": 50, "d": 0}
    got, targets = check(spark, [(i, "w " * n, s) for i, (s, n) in enumerate(texts.items())])
    assert targets["b"] == 3 and targets["d"] == 0 and abs(sum(targets.values()) - 151) < 1e-9
    assert sum(x.taken for x in got) == 151


def test_mix_against_brute_force(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), ["a", "b", None, "", "é", "hot", "z\U0001f600"][i % 7 if i % 3 else 5]) for i in range(300)]
    rows += [(None, None, "a"), (5, "x y", "a"), (5, "x y", "a"), (400, "", "void"), (401, "w " * 60_000, "long"), (402, "one", "long")]
    for kw in ({}, {"packets": 7}, {"budget": 500}, {"budget": 10**7}, {"max_epochs": 1}):
        got, targets = check(spark, rows, **kw)
        for s, target in targets.items():
            mine = [x for x in got if x.source == s]
            assert all(0 <= x.taken <= kw.get("max_epochs", 3) * x.size for x in mine)
            assert abs(sum(x.taken for x in mine) - target) <= max(1, math.ceil(target / kw.get("packets", 1000)))
    again = [check(spark, rows[::-1], n)[0] for n in (1, 9)]
    assert sorted(map(str, again[0])) == sorted(map(str, again[1]))


def test_many_sources_need_no_table_on_the_driver(spark):
    rows = [(i, "w " * (i % 5 + 1), f"s{i % 700}") for i in range(2000)]
    check(spark, rows)


def test_carried_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5)], "doc_id long, text string, source string, n_chars long")
    assert mix(docs, carry=("n_chars", "text")).select("n_chars", "text", "taken").collect() == [(5, "a b", 2)]


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
