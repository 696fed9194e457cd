import random
import re
from collections import Counter

import pytest

from refloom.llm.repetition import MAX_COVERED, MAX_LONGEST, MAX_LONGEST_SHARE, repetition_rules


def brute(text, min_repeat):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {j for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    covered, longest = set(), 0
    for i in range(len(words)):
        for j in range(len(words)):
            if i != j:
                n = 0
                while max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                    n += 1
                if n >= min_repeat:
                    covered.update(range(i, i + n))
                    longest = max(longest, n)
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    good = not failed and len(covered) <= MAX_COVERED * len(words) and longest <= max(MAX_LONGEST, MAX_LONGEST_SHARE * len(words))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), failed, good, len(covered), longest


def test_figures_match_brute_force(spark):
    r = random.Random(2)
    texts = [None, "", " \n\n", "a", "a b", "a a a a a a a", "é b c\nx\n x\nx\n", "a b c " * 60, "#*$ <p> 100%\n"]
    for i in range(40):
        words = [r.choice(["a", "b", "cc", "d\n", "#é", "f"] if i % 3 == 0 else [f"w{j}" for j in range(200)]) for _ in range(r.randint(1, 120))]
        if i % 4 == 0:
            words += words[5:60] + ["x"] + words[:30]
        texts.append(" ".join(words))
    rows = [(i, t, "c") for i, t in enumerate(texts)]
    for batch in (1, 1 << 22):
        got = {x.doc_id: x for x in repetition_rules(spark.createDataFrame(rows, "doc_id long, text string, doc string"), min_repeat=5, batch_bytes=batch).collect()}
        for i, t in enumerate(texts):
            assert tuple(got[i])[1:] == brute(t, 5), (i, t)


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert repetition_rules(spark.createDataFrame([], schema)).collect() == []
    assert len(repetition_rules(spark.createDataFrame([(None, "a"), (None, "a")], schema)).collect()) == 2


def test_names_that_clash_and_short_repeats_are_errors(spark):
    docs = spark.createDataFrame([(1, "a", True)], "doc_id long, text string, kept boolean")
    with pytest.raises(ValueError, match="kept"):
        repetition_rules(docs, carry=("doc_id", "kept"))
    with pytest.raises(ValueError, match="min_repeat"):
        repetition_rules(docs, min_repeat=2)
    assert repetition_rules(docs, carry=("doc_id", "text")).first().text == "a"


def test_very_long_text(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(10**9)}" for _ in range(200_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + words[:50_000]))], "doc_id long, text string")
    got = {x.doc_id: x for x in repetition_rules(docs).collect()}
    assert (got[1].n_words, got[1].longest_repeat, got[1].kept) == (200_000, 0, True)
    assert (got[2].n_words, got[2].longest_repeat, got[2].covered_words) == (250_000, 50_000, 100_000)
