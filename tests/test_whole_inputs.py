"""Queries without SQL against brute force, on inputs that a cut would shorten."""

import re

from refloom.operators.evidence import STOP
from refloom.plans import QUERIES


def save(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def words(text):
    return list(dict.fromkeys(t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) > 2 and t not in STOP))


def best_chunks(items, docs):
    """One-line documents are chunks; the three that cover most of a claim's words."""
    n, want = min(len(items), len(docs)), set()
    for item, claim in items:
        cw = words(claim)
        scored = sorted((-len(set(cw) & set(words(text))) / len(cw), doc, text) for doc, text in docs if doc % n == item % n)
        want |= {(item, item % n, place, text) for place, (score, _, text) in enumerate((x for x in scored if x[0] < 0), 1) if place <= 3}
    return want


def test_every_claim_meets_its_documents(spark, tmp_path):
    for k, (n_items, n_docs) in enumerate([(90, 400), (90, 50)]):
        items = [(i, f"claim about topic{i % 7} and thing{i % 11} common") for i in range(n_items)]
        docs = [(i, f"this common text names topic{i % 5} with thing{i % 13} number{i}.") for i in range(n_docs)]
        sf = save(spark, tmp_path / str(k), benchmark=(items, "item_id long, text string"), documents=(docs, "doc_id long, text string"))
        got = [(x.claim_id, x.paper, x.place, x.chunk) for x in QUERIES["evidence_chunks"](spark, sf).collect()]
        assert sorted(got) == sorted(best_chunks(items, docs))
        assert {x[0] for x in got} == set(range(n_items))


def test_sites_lie_behind_whole_texts(spark, tmp_path):
    texts = ["word " * 400 + "End. Last sentence", "short", "a" * 81, "Half of it. 90% of\nthe rest, 5%", "x. " * 300, "", None]
    sf = save(spark, tmp_path / "tex", documents=(list(enumerate(texts)), "doc_id long, text string"))
    rows = QUERIES["latex_sites"](spark, sf).collect()
    got = {(x.file, x.key): x for x in rows}
    assert len(rows) == len(got) == 3 * sum(t is not None for t in texts)
    for doc, text in enumerate(texts):
        if text is None:
            continue
        tex = "\\section{Intro} " + text.replace("%", "\\%") + " "
        cite = "\\citep[see][]{a%d, b}" % (doc % 7)
        assert all((got[doc, k].start, got[doc, k].end, got[doc, k].section, got[doc, k].in_table) == (len(tex), len(tex + cite), "Intro", False) for k in (f"a{doc % 7}", "b"))
        assert got[doc, "t"].in_table
    assert got[0, "b"].sentence == "Last sentence"  # plain prose, the citation left out
