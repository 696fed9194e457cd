import random

import pytest

from refloom.llm.tiling import contaminated, drop_contaminated, tile, tokens


def brute_tiles(pattern, text, least):
    """The longest match of unmarked tokens, first in pattern, then in text, again and again."""
    p, t, out = list(pattern), list(text), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] is not None and p[i + n] == t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        out.append((i, j, n))
        p[i : i + n], t[j : j + n] = [None] * n, ["taken"] * n


def test_tiling_covers_what_greedy_search_covers():
    r = random.Random(6)
    for _ in range(300):
        k = r.choice([3, 10, 40])
        pattern = [r.randrange(k) for _ in range(r.randint(0, 40))]
        text = [r.randrange(k) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, len(pattern))
            text += pattern[i : i + r.randint(1, 30)]
        got, want = tile(pattern, text, 3), brute_tiles(pattern, text, 3)
        assert all(pattern[i : i + n] == text[j : j + n] for i, j, n in got)
        assert len({i + d for i, _, n in got for d in range(n)}) == sum(n for *_, n in got)
        assert [(i, j, n) for i, j, n in got] == want


def test_pairs(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    items = [" ".join(word() for _ in range(30)) for _ in range(6)]
    bench = [(i, t) for i, t in enumerate(items)] + [(6, "zz yy"), (7, None), (8, ""), (None, items[0])]
    noise = lambda n: " ".join(word() for _ in range(n))
    w = items[1].split()
    rows = [
        (0, noise(50)), (1, noise(20) + " " + items[0].upper().replace(" ", ", ") + " " + noise(9)), (2, " ".join(w[15:] + ["--"] + w[:15])), (3, " ".join(w[:12])), (4, None), (5, ""), (6, "a ZZ, yy!"),
        (None, items[2]), (8, noise(5000) + " " + items[3] + " " + noise(5000)), (8, items[4]), (8, items[4]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 as item_id", "'en' as lang")
    benchmark = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = sorted((str(x.doc_id), str(x.item_id)) for x in contaminated(docs, benchmark).collect())
    assert got == sorted([("1", "0"), ("1", "None"), ("2", "1"), ("6", "6"), ("None", "2"), ("8", "3"), ("8", "4"), ("8", "4")])
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [0, 3, 4, 5]
    assert contaminated(docs.limit(0), benchmark).collect() == [] == contaminated(docs, benchmark.limit(0)).collect()
    assert tokens("Éa_b-C9") == ["éa", "b", "c9"]


def test_pairs_against_brute_force_over_alphabets(spark):
    for k in (2, 4, 12, 60):
        r = random.Random(k)
        word = lambda: f"w{r.randrange(k)}"
        items = [" ".join(word() for _ in range(r.randint(1, 40))) for _ in range(25)]
        texts = []
        for _ in range(40):
            words = [word() for _ in range(r.randint(0, 60))]
            for _ in range(r.randint(0, 2)):
                piece = r.choice(items).split()
                i = r.randint(0, len(piece) - 1)
                words += piece[i : i + r.randint(1, 40)] + piece[:i]
            texts.append(" ".join(words))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {(x.doc_id, x.item_id): x.covered_tokens for x in contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
        for d, t in enumerate(texts):
            for i, x in enumerate(items):
                pattern = tokens(x)
                # the tokens that tile() covers on the whole text, not only under shared seeds
                number = {w: n for n, w in enumerate(dict.fromkeys(pattern))}
                tiles = tile([number[w] for w in pattern], [number.get(w, -1) for w in tokens(t)], min(5, len(pattern)))
                covered = sum(n for *_, n in tiles)
                assert got.get((d, i)) == (covered if 2 * covered >= len(pattern) else None), (k, d, i)


def test_frequent_seeds_lose_no_pair(spark):
    phrase = "for more information please visit our website today"
    items = [f"{phrase} item{i} a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}" for i in range(40)] + [phrase]
    docs = [(i, f"x{i} y{i} {phrase} z{i}") for i in range(200)] + [(1000 + i, f"q {items[i]} r") for i in range(40)]
    got = {(x.doc_id, x.item_id) for x in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == {(i, 40) for i, _ in docs} | {(1000 + i, i) for i in range(40)}


def test_carried_names_must_not_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    with pytest.raises(ValueError, match="item_id"):
        contaminated(docs, docs, carry=("item_id",))
