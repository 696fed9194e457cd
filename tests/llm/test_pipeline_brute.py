"""The pipeline's chain of stages against a brute-force version in plain Python."""

import random
import re
from collections import Counter

import test_bag_minhash
import test_mixing
import test_repetition
import test_secret_scan
import test_tiling

import corpus_pipeline as cp


def documents(items):
    r = random.Random(11)
    noise = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    texts = [None, "", "too short"]
    for i in range(12):
        base = noise(r.randint(60, 90))
        near = base[:]
        near[30] = "changed"
        texts += [" ".join(base), " ".join(near)] + [" ".join(base)] * (i % 2)
    texts += [" ".join(noise(40) + items[i].upper().split() + noise(20)) for i in (0, 2)]
    texts += [" ".join(noise(60) + ["password=abcdef12345", "x", "token=ghijkl67890"]), "a b c " * 40, " ".join((b := noise(60)) + b)]
    r.shuffle(texts)
    return [(i, t, ["en", "de"][i % 2], ["a", "b", None, "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]


def redacted(text):
    spans = []
    for a, _, b in test_secret_scan.brute(text):
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    for a, b in reversed(spans):
        text = text[:a] + "[SECRET]" + text[b:]
    return text, bool(spans)


def mixed(rows):
    """The rows of the mix: packets by virtual finish time up to the budget."""
    targets, taken = test_mixing.brute([(doc, text, source) for doc, text, _, source, _ in rows])
    sizes = Counter()
    for _, size, source, _ in taken:
        sizes[source] += size
    pairs = zip(rows, taken, strict=True)
    return {(doc, text, lang, s, n, size, sizes[s], words, round(targets[s], 6)) for (doc, text, lang, s, n), (_, size, _, words) in pairs if words}


def test_chain_equals_brute_force(spark, tmp_path):
    r = random.Random(12)
    items = [" ".join(f"item{i}x{r.randrange(900)}" for _ in range(14)) for i in range(3)]
    docs = documents(items)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = [d for d in docs if test_repetition.brute(d[1], 10)[6]]
    classes = test_bag_minhash.brute_classes([d[1] for d in good])
    single = [d for i, d in enumerate(good) if classes[i] == i]
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    leaks = lambda t: any(2 * sum(n for *_, n in test_tiling.brute_tiles(tokens(x), tokens(t), 5)) >= len(tokens(x)) for x in items)
    clean = [d for d in single if not leaks(d[1])]
    safe = [(d[0], new, d[2], d[3], len(new) if hit else d[4]) for d in clean for new, hit in [redacted(d[1])]]
    assert len(docs) > len(good) > len(single) > len(clean) and safe != clean
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, step), want in zip(cp.STAGES, (good, single, clean, safe), strict=False):
        now = step(spark, now, str(tmp_path)).cache()
        assert sorted(map(tuple, now.collect())) == sorted(want), name
    got = [(x.doc_id, x.text, x.lang, x.source, x.n_chars, x.size, x.source_size, x.taken, round(x.target, 6)) for x in cp.run(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == mixed(safe)
