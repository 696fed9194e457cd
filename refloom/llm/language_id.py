"""Language identification by a blended-spectrum string kernel.

Two texts are compared by the n-grams (n = 1, 2, 3 characters) that occur in both:
k(x, y) = |A(x) & A(y)| / sqrt(|A(x)| |A(y)|) with A the set of n-grams present in the
whole text in lower case. Every letter of every script is a character of its own; all
that is no letter is one gap. An n-gram is a 63-bit number, three code points of 21 bits, so
none are folded together and none are left out. Nystroem: m landmark texts span the feature space,
phi(x) = K_mm^(-1/2) k_m(x). One-versus-rest kernel ridge regression on phi gives one
weight vector per language. Batches of texts are scored by products of their sparse
presence matrix; as k_m is linear in the presence vector up to its norm, the landmark
matrix and the weights are multiplied once, after fitting.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import small_batches

#: Bounds of the sample that the classifier is fitted on, and of the landmarks in it.
TRAIN_ROWS, TRAIN_CHARS, LANDMARKS, LANDMARK_CHARS, RIDGE = 1600, 8_000_000, 192, 2_000_000, 1e-3
_GAP, _BITS = 1, 21
#: Characters that are scored at a time, a longer text alone.
BATCH_CHARS = 1 << 20
_LETTER = np.frombuffer(bytes(chr(code).isalpha() for code in range(0x110000)), bool)


def _sorted_set(values: np.ndarray) -> np.ndarray:
    """The different ones of sorted values."""
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def grams(text: str) -> np.ndarray:
    """The n-grams present in a whole text, sorted: characters between gaps at both ends, shorter ones with zeros in front."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.full(len(codes) + 2, _GAP, np.int64)
    c[1:-1] = np.where(_LETTER[codes], codes, _GAP)
    two = (c[:-1] << _BITS) | c[1:]
    three = _sorted_set(np.sort((two[:-1] << _BITS) | c[2:]))
    pairs = _sorted_set(np.sort(np.append(_sorted_set(three >> _BITS), two[-1])))
    return np.concatenate((_sorted_set(np.sort(np.append(_sorted_set(pairs >> _BITS), c[-1]))), pairs, three))


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # the landmarks' n-grams, sorted
    weights: np.ndarray  # n-grams x languages

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row per text: the presence matrix times the weights, over the texts' norms."""
        found = [grams(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        out = np.zeros((len(texts), len(self.languages)))
        if not len(self.vocabulary):
            return out
        every = np.concatenate(found) if found else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, every), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == every
        row = np.repeat(np.arange(len(found)), sizes)[known]
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(row, self.weights[at[known], k], len(found))
        return out / np.sqrt(sizes)[:, None]


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE, landmark_chars: int = LANDMARK_CHARS) -> Model:
    """rows: (text, language). Rows are taken in the given order, so equal rows give equal models.

    Landmarks are taken from the languages in turn, up to ``landmarks`` texts of together ``landmark_chars`` characters
    (each language's first one in any case).
    """
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    by_language = {lang: [i for i, x in enumerate(rows) if x[1] == lang] for lang in languages}
    chosen, chars = [], 0
    for depth in range(max(map(len, by_language.values()))):  # round robin over languages
        for lang in languages:
            if depth < len(by_language[lang]):
                i = by_language[lang][depth]
                if depth and (len(chosen) >= landmarks or chars + len(rows[i][0]) > landmark_chars):
                    continue
                chosen.append(i)
                chars += len(rows[i][0])
    sets = [grams(rows[i][0]) for i in chosen]
    vocabulary = _sorted_set(np.sort(np.concatenate(sets)))
    # postings: the landmarks that have each n-gram
    where = np.concatenate([np.searchsorted(vocabulary, s) for s in sets])
    mark = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(where, kind="stable")
    mark = mark[order]
    begin = np.searchsorted(where[order], np.arange(len(vocabulary) + 1))
    norms = np.sqrt([len(s) for s in sets])

    def kernel(present: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(vocabulary, present), len(vocabulary) - 1)
        at = at[vocabulary[at] == present]
        n = begin[at + 1] - begin[at]
        flat = np.repeat(begin[at + 1] - np.cumsum(n), n) + np.arange(n.sum())
        return np.bincount(mark[flat], minlength=len(sets)) / (norms * np.sqrt(len(present)))

    values, vectors = np.linalg.eigh(np.stack([kernel(s) for s in sets]))
    good = values > 1e-6 * values.max()
    root = (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T  # K_mm^(-1/2)
    phi = np.stack([kernel(grams(t)) for t, _ in rows]) @ root
    wanted = np.array([[1.0 if lang == x[1] else -1.0 for lang in languages] for x in rows])
    # balance: each language weighs the same
    weight = np.array([1.0 / len(by_language[x[1]]) for x in rows])
    beta = np.linalg.solve(phi.T @ (phi * weight[:, None]) + ridge * np.eye(phi.shape[1]), phi.T @ (wanted * weight[:, None]))
    of_mark = (root @ beta) / norms[:, None]
    weights = np.stack([np.bincount(where, np.repeat(of_mark[:, k], [len(s) for s in sets]), len(vocabulary)) for k in range(len(languages))], axis=1)
    return Model(languages, vocabulary, weights.astype(np.float32))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Fit on a bounded sample of labelled (text, lang): at most ``rows`` different texts, an equal share for each
    language, and of these no more than ``chars`` characters. Which texts depends on a hash of their content; copies count once.
    Of more than ``rows`` languages, those with the most texts are learned."""
    useful = labelled.filter("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("o"))
    counted = useful.groupBy("lang").agg(F.approx_count_distinct("o", 0.02).alias("n"))
    n = {r["lang"]: r["n"] for r in counted.orderBy(F.desc("n"), "lang").limit(rows).collect()}
    share = max(1, rows // max(1, len(n)))
    # a hash threshold leaves about twice the share of each language's different texts; of these the first are taken
    limit = F.lit(None)
    for lang, count in n.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(1.0, (2.0 * share + 20) / max(1, count)))).otherwise(limit)
    kept = useful.filter(F.pmod("o", F.lit(1_000_000)) < limit * 1_000_000).dropDuplicates(["o", "lang"]) if n else None
    taken: Counter = Counter()
    sample, total = [], 0
    for r in kept.orderBy("o", "text").toLocalIterator() if n else ():
        if taken[r["lang"]] < share and total + len(r["text"]) <= chars:
            taken[r["lang"]] += 1
            total += len(r["text"])
            sample.append((r["text"], r["lang"]))
    return fit(sample)


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The language of each whole text: columns of carry, lang_pred, score.

    docs needs text and the columns of carry (lang_pred and score can't be carried); others are not read. lang_pred is a
    language of the model, or 'und' with score 0 if the text is null or has no
    letter, or if the model was fitted on nothing. score is the share of the best
    language in the softmax of the regression scores. Of tied languages the first
    in code point order is taken. Long texts are scored whole, alone. Repeated rows get equal results; an empty table
    gives none.
    """
    if {"lang_pred", "score"} & set(carry):
        raise ValueError("lang_pred and score are columns of the result")
    small_batches(docs.sparkSession)
    chosen = docs.select(*carry, F.col("text").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", lang_pred string, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            texts = batch["__text"].tolist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            ready = [i for i, x in enumerate(texts) if x and model.languages and any(map(str.isalpha, x))]
            at = 0
            while at < len(ready):
                end, size = at + 1, len(texts[ready[at]])
                while end < len(ready) and size + len(texts[ready[end]]) <= BATCH_CHARS:
                    size += len(texts[ready[end]])
                    end += 1
                part, at = ready[at:end], end
                s = model.scores([texts[i] for i in part])
                share = np.exp(3 * (s - s.max(axis=1, keepdims=True)))
                best = s.argmax(axis=1)
                top = 1.0 / share.sum(axis=1)
                for i, b, p in zip(part, best.tolist(), top.tolist(), strict=True):
                    lang[i], score[i] = model.languages[b], p
            yield batch[list(carry)].assign(lang_pred=lang, score=score)

    return chosen.mapInPandas(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from refloom.llm.common import read

    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = train(docs.filter(~held_out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
