import json
import random

import pytest
from pyspark.sql import functions as F

from refloom.functions.similarity import title_contradiction, title_tokens
from refloom.operators import correctness, evidence, layout, linkage, report, usage
from refloom.sources import records, services, tex
from refloom.streaming import event_log


def test_records_round_trip(spark, tmp_path):
    row = {"paper_id": "p", "claim_id": "c1", "cite_key": "k", "claim": {"claim_id": "c1", "text": "t", "char_span": [1, 5]}, "cited_as": {"raw": "r", "authors": ["A"]}, "confidence": 0.5}
    (tmp_path / "a.jsonl").write_text(json.dumps(row) + "\n")
    (tmp_path / "gold.jsonl").write_text(json.dumps(row | {"paper_id": "g"}) + "\n")
    (tmp_path / "doc.json").write_text(json.dumps({"records": [row, row | {"claim_id": "c2", "exists": "maybe", "confidence": 2.0}]}))
    got = records.read_directory(spark, str(tmp_path), "gold.jsonl").collect()
    assert [(r.paper_id, r["exists"], r.supports_claim, r.schema_version, r.claim.char_span) for r in got] == [("p", "unresolved", "inconclusive", "0.1", [1, 5])]
    whole = records.read_json(spark, str(tmp_path / "doc.json"))
    assert whole.count() == 2
    assert {(r.claim_id, r.rule) for r in records.violations(whole).collect()} == {("c2", "exists has no value maybe"), ("c2", "confidence outside [0, 1]")}
    assert records.unlabelled(whole).count() == 2
    records.write_jsonl(whole, str(tmp_path / "out"))
    assert sorted(map(str, records.read_jsonl(spark, str(tmp_path / "out")).collect())) == sorted(map(str, whole.collect()))


def test_broken_line_fails_the_read(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        records.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()


def test_payload_parsers(spark):
    item = {"title": ["T"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "issued": {"date-parts": [[2020, 1]]}, "container-title": ["V"], "DOI": "10.1/X"}
    got = services.crossref(spark.createDataFrame([(json.dumps(item),)], "json string")).first()
    assert (got.title, got.authors, got.year, got.venue, got.doi) == ("T", ["A B", "C"], 2020, "V", "10.1/x")
    rows = [('["Ann Lee 0001", "Bo"]',), ('{"text": "Cy 0002"}',), ('[{"text": "Di 0003"}, {"text": "Ed"}]',), ("Flo",)]
    got = spark.createDataFrame(rows, "a string").select(records.dblp_authors(F.col("a")).alias("x")).collect()
    assert [r.x for r in got] == [["Ann Lee", "Bo"], ["Cy"], ["Di", "Ed"], ["Flo"]]


def test_tex_parsers():
    bib = '@Article{k1, title = {A {B} c}, author="X and\n Y", year = 2020}\n@comment{x}\n@misc{k2,note={open {brace}}, eprint = {2101.00001}}'
    assert tex.bib_entries(bib) == [("k1", "article", {"title": "A B c", "author": "X and Y", "year": "2020"}), ("k2", "misc", {"note": "open brace", "eprint": "2101.00001"})]
    assert tex.bibitems("\\bibitem[L]{a} One\n two \\bibitem{b} Three \\end{thebibliography} rest") == [("a", "One two"), ("b", "Three")]
    sites = tex.cite_sites("\\section{In} First. We use \\citep[e.g.][p. 2]{a, b} here. % \\cite{no}\n\\begin{table}\\cite{t}\\end{table}")
    assert [(s[0], s[3], s[4]) for s in sites] == [("a", "In", False), ("b", "In", False), ("t", "In", True)]
    assert sites[0][5] == "We use \\citep[e.g.][p. 2]{a, b} here."
    assert tex.tabular_cells("a & {b & c} \\\\[2pt] \\hline \\multicolumn{2}{c}{x} & 5\\% \\\\") == [(0, 0, "a", 1), (0, 1, "{b & c}", 1), (1, 0, "x", 2), (1, 2, "5\\%", 1)]


def test_matching_cascade(spark):
    refs = [(1, "Deep learning for protein folding", ["smith"], 2020, "10.1/a", ""), (2, "Attention is all you need", ["vaswani"], 2017, "", "1706.03762"), (3, "Graph networks for molecules and materials", ["lee"], 2019, "", ""), (4, "An unrelated cookbook of soups", ["xu"], 2001, "", "")]
    cands = [(10, "Deep learning for protein folding", ["smith"], 2020, "10.1/a", ""), (11, "Attention is all you need.", ["vaswani"], 2017, "", "1706.03762"), (12, "Graph Networks for Molecules, and Materials", ["lee"], 2020, "", ""), (13, "Graph networks for traffic", ["ho"], 2019, "", ""), (14, "Entirely different soups", ["xu"], 2001, "10.1/a", "")]
    schema = "title string, surnames array<string>, year int, doi string, arxiv string"
    got = linkage.match(spark.createDataFrame(refs, f"ref_id int, {schema}"), spark.createDataFrame(cands, f"cand_id int, {schema}")).collect()
    assert {(r.ref_id, r.cand_id, r.method) for r in got} == {(1, 10, "doi"), (2, 11, "arxiv"), (3, 12, "fuzzy_title")}
    assert all(r.score == 1.0 for r in got)


@pytest.mark.parametrize(("cheap", "long"), [(1000, 40), (0, 40), (0, 4), (5, 6)])
def test_title_pairs_lose_none_that_the_veto_passes(spark, cheap, long):
    rng = random.Random(7)
    words = [f"w{chr(97 + i)}x" for i in range(12)] + ["v2", "v3", "2020"]
    titles = [" ".join(rng.sample(words, rng.randint(0, 9))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(titles)), "i int, title string").withColumn("tokens", title_tokens(F.col("title"))).cache()
    r, c = df.select(F.col("i").alias("rk"), F.col("tokens").alias("r_tokens")), df.select(F.col("i").alias("ck"), "tokens")
    passed = r.crossJoin(c).filter((F.size("tokens") > 0) & (F.size("r_tokens") > 0) & ~title_contradiction(F.col("r_tokens"), F.col("tokens")))
    got = {tuple(x) for x in linkage.title_pairs(r, c, cheap, long).collect()}
    want = {(x.rk, x.ck) for x in passed.collect()}
    assert len(want) > 80 and want <= got and len(got) < 80 * 80


def test_matching_of_repeated_rows(spark):
    schema = "title string, surnames array<string>, year int, doi string, arxiv string"
    ref = ("Graph networks for molecules and materials", ["lee"], 2019, None, "1706.03762v2")
    refs = spark.createDataFrame([(i, *ref) for i in (1, 1, 2)] + [(3, None, None, None, None, None), (4, "", [], None, "10.1/B", "")], f"ref_id int, {schema}")
    cands = spark.createDataFrame([(i, "Graph networks for molecules, and materials", ["lee"], 2019, "", "1706.03762V1") for i in (9, 8, 8)] + [(8, "Other", None, None, "10.1/b", None)], f"cand_id int, {schema}")
    got = sorted((x.ref_id, x.cand_id, x.method) for x in linkage.match(refs, cands).collect())
    assert got == [(1, 8, "arxiv"), (1, 8, "arxiv"), (2, 8, "arxiv"), (4, 8, "doi")]
    assert linkage.match(refs, cands.limit(0)).count() == linkage.match(refs.limit(0), cands).count() == 0


def test_veto_and_issues(spark):
    schema = (
        "title string, authors array<string>, year int, venue string, url string, reference string, sources array<string>, method string, r_title string, r_authors array<string>, r_year int, r_venue string, r_url_valid boolean, r_url string, "
        "url_status string, url_http int, checked_url string"
    )
    graph, lee = "Graph nets for molecules", ["Ann Lee"]
    rows = [
        (graph, lee, 2019, "ICML", "", "r", [], "fuzzy_title", graph, ["Lee A"], 2019, "Proc. ICML", None, None, None, None, None),
        (graph, lee, 2019, "ICML", "http://x", "r", [], "fuzzy_title", graph, ["Bo Ho"], 2019, "ICML", None, None, "live", 200, "http://x"),
        (graph, lee, 2019, "ICML", "", "r", [], "fuzzy_title", "May 2019", ["Lee A"], 2019, "ICML", None, None, None, None, None),
        (graph, lee, 2015, "ICML", "", "r", [], "doi", graph, ["Bo Ho"], 2019, "NeurIPS", False, "u", "dead", 404, None),
        ("Graph nets", lee, 2015, "", "http://x", "r", ["arxiv"], None, None, None, None, None, None, None, "blocked", 403, "http://x"),
        ("OpenAI o3-mini", ["OpenAI"], 2025, "", "", "r", [], "fuzzy_title", "A case of pneumonia with o3-mini", ["Bo Ho"], 2025, "", None, None, None, None, None),
        (None, None, None, None, None, "", ["arxiv"], None, None, None, None, None, None, None, None, None, None),
        (None, None, None, None, None, "r", ["arxiv", "dblp"], None, None, None, None, None, None, None, "error", None, None),
    ]
    got = correctness.fill_correctness(spark.createDataFrame(rows, schema)).collect()
    assert [(r["exists"], r.match_method) for r in got] == [("yes", "fuzzy_title"), ("yes", "direct_url"), ("unresolved", None), ("yes", "doi"), *[("unresolved", None)] * 4]
    assert got[0].issues == got[1].issues == [] and got[2].issues == ["abstained from a weak fuzzy-title match — closest candidate is not a real title ('May 2019')"] and got[4].issues[0].startswith("url access blocked: HTTP 403")
    assert got[3].issues == ["year mismatch: cited 2015 vs 2019", "venue mismatch: cited 'ICML' vs 'NeurIPS'", "first-author mismatch: cited 'Ann Lee' vs 'Bo Ho'", "cited/resolved URL did not validate: u"]
    assert "short cited title" in got[5].issues[0] and got[6].issues == ["no reference string available to resolve"] and got[7].issues == ["could not retrieve a confident match — searched arXiv, DBLP"]


def test_evidence(spark):
    long = "One sentence here. " * 60
    got = spark.createDataFrame([("a b\n\nc d\n \n" + long,)], "t string").select(evidence.chunks(F.col("t"), 200).alias("c")).first().c
    assert got[:2] == ["a b", "c d"] and all(len(x) <= 200 for x in got) and " ".join(got[2:]) == long.strip()
    scope = spark.createDataFrame([("", False), ("4 Experiments", False), ("4 Experiments", True), ("1 Introduction", False), ("Weather", False)], "h string, e boolean").select(evidence.in_scope(F.col("h"), F.col("e")).alias("s")).collect()
    assert [r.s for r in scope] == [True, False, True, True, True]
    claims = spark.createDataFrame([(1, 7, "Cats outperform dogs in accuracy")], "claim_id int, paper int, claim string")
    passages = spark.createDataFrame([(7, 0, "Introduction", "Cats are nice animals.\n\nDogs and cats differ in accuracy."), (7, 1, "Results", "We find cats outperform dogs in accuracy."), (8, 0, "", "cats outperform dogs in accuracy.")], "paper int, section_no int, heading string, text string")
    top = evidence.top_chunks(claims, passages, 2).orderBy("place").collect()
    assert [(r.heading, r.overlap) for r in top] == [("Results", 1.0), ("Introduction", 0.75)]
    # without any shared word the leading chunks are taken, headings are not, and inner whitespace is one space
    other = spark.createDataFrame([(2, 7, "zebra stripes"), (3, 9, None)], "claim_id int, paper int, claim string")
    more = passages.unionByName(spark.createDataFrame([(7, 2, "", "E.2 High-order Features\n\na  b\n c is said.")], passages.schema))
    assert [r.chunk for r in evidence.top_chunks(other, more, 9).orderBy("place").collect()] == ["Cats are nice animals.", "Dogs and cats differ in accuracy.", "a b c is said."]  # Results is not in the scope of this claim


def test_layout(spark):
    words = [(1, 0, 10.0, 100.0, 20.0, "[1]"), (1, 0, 25.0, 101.0, 40.0, "Ann"), (1, 0, 15.9, 112.0, 30.0, "wrapped"), (1, 0, 10.0, 124.0, 20.0, "[2]"), (1, 0, 100.0, 124.0, 120.0, "far")]
    lines = layout.baselines(spark.createDataFrame(words, "doc_id long, page int, x0 double, y0 double, x1 double, text string"))
    assert sorted(r.text for r in lines.collect()) == ["[1] Ann", "[2]", "far", "wrapped"]
    flush = lines.withColumn("x0", F.when(F.col("text") == "wrapped", 30.0).otherwise(F.col("x0"))).filter("text <> 'far'")
    assert sorted(r.text for r in layout.hanging_entries(flush.withColumn("col", F.lit(0))).collect()) == ["[1] Ann wrapped", "[2]"]
    spans = spark.createDataFrame([("a", 0, 5), ("a", 0, 9), ("a", 4, 12), ("a", 9, 10), ("b", 1, 2)], "k string, start int, end int")
    assert sorted(map(tuple, layout.keep_non_overlapping(spans, ["k"]).collect())) == [("a", 0, 9), ("a", 9, 10), ("b", 1, 2)]


def test_report_and_usage(spark):
    schema = "paper_id string, cite_key string, ord int, claim string, section string, span int, authors array<string>, title string, year int, raw string, exists string, issues array<string>, supports string, severity string, notes string, error string"
    rows = [
        ("p", "ref-6", 0, "a|b", "Intro", 5, ["A", "B", "C"], "T", 2020, None, "yes", [], "supports", "ok", None, None), ("p", "k2", 1, "c", None, 5, [], None, None, "raw\ntext", "no", ["x", "y"], "partial", "high", "n", None),
        ("p", "ref-6", 2, "d", "", None, ["A"], "T", 0, None, "yes", [], "does_not", "ok", "", "boom"), ("p", "k3", 3, "e", None, None, None, None, None, "", "odd", [], "skipped", "ok", None, None),
    ]
    records = spark.createDataFrame(rows, schema)
    assert report.table(records).first().table.split("\n") == [
        "**Scope:** 3 (claim, citation) pairs for `p`.", "", "| # | Citation (authors, title, year) | Cited where (the claim) | Exists? | Match notes | Supports claim? | Explanation |", "| --- | --- | --- | --- | --- | --- | --- |",
        "| 1 | A et al., T, 2020 | [6] [Intro] a\\|b | yes |  | Relevant |  |", "| 2 | A, T | d | yes |  | Irrelevant | boom |", "| 3 | raw text | [k2] c | no | x; y | Partly Relevant | n |",
    ]
    assert report.skipped(records).first().skipped.endswith("| 1 | k3 | e | unresolved |  |")
    summary = report.summary(records).first().summary
    assert summary.endswith("### Fix before submission\n- `k2` — raw text: high — n") and "**4** (claim, citation) pairs over **3** unique references · **1** with metadata issues · **1** high-severity." in summary
    assert report.web_summary(records).first().asDict() == {"paper_id": "p", "refs": 3, "pairs": 4, "high": 1, "exists": {"yes": 1, "no": 1, "odd": 1}, "supports": {"supports": 1, "partial": 1, "does_not": 1, "skipped": 1}}
    prices = spark.createDataFrame([("son", 1.0, 2.0), ("sonnet", 3.0, 4.0)], "key string, p_in double, p_out double")
    got = usage.priced(spark.createDataFrame([("X-Sonnet-9",), ("other",)], "model string"), prices).collect()
    assert {(r.model, r.p_in, r.p_out) for r in got} == {("X-Sonnet-9", 3.0, 4.0), ("other", 3.0, 15.0)}


def test_event_stream(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.limit(500).write.parquet(str(tmp_path / "log"))
    stream = event_log.activity(event_log.read_log(spark, str(tmp_path / "log"), batch.schema))
    event_log.drain(stream, "activity", str(tmp_path / "state"))
    want = spark.read.parquet(str(tmp_path / "log")).groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("activity").select("start", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))


def test_splits_are_written(spark, tmp_path):
    from refloom.sources.records import write_splits

    rows = spark.createDataFrame([(i, i % 10 == 7) for i in range(100)], "ord int, bad boolean")
    where = write_splits(rows, F.col("bad"), [F.col("ord")], str(tmp_path), 12)
    assert sorted(r["ord"] for r in spark.read.json(where["smoke"]).collect()) == sorted([*range(7, 100, 10), 0, 1])
    assert spark.read.json(where["full"]).count() == 100
