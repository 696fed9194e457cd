import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from refloom import extension
from refloom.operators import dimensions, order, relevance, verify
from refloom.sources import claims, ingest, records, tex, textables


def packed(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, text in files:
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text))
    return out.getvalue()


def test_archives_are_read_and_guarded(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/b.tex", "zip")
        f.writestr("../evil.tex", "out")
        f.writestr("/abs.tex", "out")
    rows = [("t", packed([("b.tex", b"second"), ("main.tex", b"\\documentclass{x} first"), ("../x.tex", b"out"), ("fig.png", b"\x00")])), ("z", z.getvalue()), ("g", gzip.compress(b"alone")), ("bad", b"nothing"), ("none", None)]
    got = ingest.archive_texts(spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary"))
    assert sorted((r.path, r.member) for r in got.collect()) == [("g", "main.tex"), ("t", "b.tex"), ("t", "fig.png"), ("t", "main.tex"), ("z", "a/b.tex")]
    assert {r.path: r.text for r in ingest.eprint_text(got).collect()} == {"t": "\\documentclass{x} first\n\nsecond", "z": "zip", "g": "alone"}


def test_unknown_inputs_are_errors(spark):
    df = spark.createDataFrame([("no such thing", False)], "s string, f boolean")
    with pytest.raises(Exception, match="Unrecognized input"):
        df.select(ingest.route(F.col("s"), F.col("f"))["kind"]).collect()


def test_tex_sites_and_environments():
    text = r"\section{Intro}A b. We use \citep[see][]{a, b} here. Next \begin{table}\begin{tabular}{c} x \cite{t} \end{tabular}\end{table} % \cite{gone}" + "\n\\begin{table*} open \\cite{u}"
    got = tex.cite_sites(text)
    assert [(k, s, t) for k, _, _, s, t, *_ in got] == [("a", "Intro", False), ("b", "Intro", False), ("t", "Intro", True), ("u", "Intro", False)]
    assert tex.cite_sites("") == [] and tex.environments(r"\end{table}", tex.TABLES) == []


def test_sentences_are_cut_at_spaces():
    text = "First one. " + "word " * 200 + "here we cite it and go on " + "more " * 200 + "end. Last."
    claim, begin, end = claims.claim_around(text, text.index("cite"))
    assert "cite it" in claim and len(claim) <= 360 and text[begin - 1] == " " and text[end] == " "
    assert claims.sentence("A b. C d? E f", 6, 500) == (5, 9)
    assert claims.claim_key("p", None, None, None, "k") == claims.claim_key("p", "", None, None, "k") != claims.claim_key("p", "", 0, 5, "k")


def test_prose_without_furniture():
    page = "1 Department of Things (X)\nSomewhere, Land\n\n2.1 Method\nWe do a thing (张三) in words.\nReal prose goes on.\nWrite to\nx@y.org\nafter mail\n‡ note\nProceedings of it\nAn institute of the University of X was short"
    assert claims.prose_lines(page) == "\nReal prose goes on.\nafter mail"
    assert claims.plain_text(None) == "" and claims.joined_letters("a normal line") == "a normal line"
    assert claims.joined_lines(["see https://a.org/", "xy (2001)", "", "word-", "end . Then"]) == "see https://a.org/xy (2001) wordend. Then"
    assert claims.joined_lines(["doi:10.1/acl-long.", "427 next"]) == "doi:10.1/acl-long.427 next"


def test_definitions():
    d = dimensions
    assert "criterion" in d.spellings("criteria") and "matrices" in d.spellings("matrix")
    assert d.term("seq len").search("the Seq. Len of it") and d.term("weight").search("Weights") and not d.term("SP").search("SPRIN")
    assert d.term("ellipses").search("Ellipsis resolution") and d.legend("(\\cmark: strong; ▲ = so so)") == {"\\cmark": "strong", "▲": "so so"}
    assert d.definition_score("Nothing here", ["adaptive"]) == 0 and d.definition_score("A model is adaptive if for any task it adapts", ["adaptive"], True) == 11
    assert d.punctuated("TDA Free", "\\item \\textbf{TDA Free}: no augmentation of the data is made. TDA free, which we abbreviate T here") == ["no augmentation of the data is made"]
    assert d.states_criterion("Order: by length", "order") and not d.states_criterion("example order (Arrangement)", "Arrangement") and not d.states_criterion("", "x")
    assert d.enumerator_name("(ii)", r"\item (i) We propose x \item (ii) \textit{Anti-occlusion.} The detector must hold. \item (iii)") == ("Anti-occlusion", "Anti-occlusion: The detector must hold")
    assert d.enumerator_name("(i)", r"(i) We propose a thing") == d.enumerator_name("1", "1 Name") == d.enumerator_name(None, None) == ("", "")
    assert d.before_contrast("Others do one thing. In contrast, OwnNet does all", ["OwnNet"]) == "Others do one thing" and d.before_contrast("We do x. However y", ["OwnNet"]) == ""
    assert d.recites_table("Method TDA Free CT Free SP", [["tda free"], ["ct free"], ["x"]]) and not d.recites_table("TDA free means", [["tda free"], ["ct free"]])
    assert d.tex_prose("plain \\ text") == "plain \\ text" and d.tex_prose(None) is None


def test_latex_tables():
    head = r"\begin{table}\caption{C}\begin{tabular}{l c c} Method & A & B \\ "
    rows = r"X~\cite{x} & \cmark & \xmark \\ \multirow{2}{*}{Fam} Y & no & yes \\ Ours & \cmark & \cmark \\"
    got = textables.comparison_cells(head + rows + r"\end{tabular}\end{table}")
    assert [(r[3], r[5]) for r in got[::2]] == [("X", False), ("Fam Y", True), ("Ours", True)] and {r[7] for r in got} == {"A", "B"}
    assert textables.comparison_cells("") == [] and textables.comparison_cells(r"\begin{tabular}{c} a \\ \end{tabular}") == []
    assert textables.own_row("Wanda + x", ["k"], ["wanda"]) and not textables.own_row("Wander", ["k"], ["wanda"]) and not textables.own_row("Y", [], [], strict=True)
    assert textables.expanded(r"\sys and \sysname", {"sys": "S"}) == r"S and \sysname"


def test_marks_in_text_and_in_columns_agree(spark):
    from refloom.operators import grid
    from refloom.plans.tables import _SAMPLES

    raws = [r for r, *_ in _SAMPLES] + [r"\textit{No}", "✓✗", r"\usym{2713}", "%", "~", "N/A."]
    got = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", grid.normalize_mark(F.col("raw")).alias("m"), grid.strip_cell(F.col("raw")).alias("t")).collect()
    assert [(textables.cell_mark(r.raw), textables.cell_text(r.raw)) for r in got] == [(r.m, r.t) for r in got]


def test_extension_points(spark):
    df = spark.createDataFrame([("p", "c", "k")], "paper_id string, claim_id string, cite_key string")

    @extension.register("echo")
    class Echo:
        def verify(self, stubs):
            return extension.chain(stubs, lambda r: r.withColumn("x", F.lit(1)))

    assert isinstance(extension.backend("echo"), extension.Backend) and extension.backend("echo").verify(df).first().x == 1
    with pytest.raises(ValueError, match="echo"):
        extension.register("echo")(Echo)
    with pytest.raises(ValueError, match="no backend"):
        extension.backend("none")
    with pytest.raises(ValueError, match="cite_key"):
        extension.chain(df, lambda r: r.drop("cite_key"))
    seen = []
    with extension.progress(seen.append, "judge", n=3):
        pass
    assert [x["state"] for x in seen] == ["begun", "ended"]
    with extension.progress(lambda _: 1 / 0, "judge"):
        pass
    assert extension.env_settings("# c\nexport A='b c'\nB=\"d\"\nC = e=f\n=g\nno\n") == {"A": "b c", "B": "d", "C": "e=f"}
    assert extension.optional(" ") is None and extension.truthy("On", False) and extension.truthy(None, True) and extension.number("x", 1.5) == 1.5


def test_sinks(spark, tmp_path):
    records.write_report(spark.createDataFrame([("p", "# a\nb"), ("q", "c")], "paper_id string, report string"), str(tmp_path))
    assert (next((tmp_path / "md" / "paper_id=p").glob("*.txt"))).read_text() == "# a\nb\n"
    records.write_runs(spark.createDataFrame([("p", 3)], "paper_id string, n_in long"), str(tmp_path / "runs"))
    assert records.read_runs(spark, str(tmp_path / "runs"), "n_in long").first().n_in == 3
    assert '"cite_key"' in records.json_schema()


def test_answers_of_every_kind(spark):
    rows = [('x ```json\n[{"i": 1, "supports_claim": "Partial", "justification": "refuted"}]\n```',), ("[broken",), (None,), ('[{"i": "1"}, {"supports_claim": "supports"}]',), ("[]",)]
    got = relevance.parse_batch(spark.createDataFrame(rows, "answer string")).collect()
    assert [(r.i, r.v.supports) for r in got] == [(1, "does_not")]
    single = relevance.parse_single(spark.createDataFrame([('{"supports_claim": "supports", "confidence": 0.7} tail }',), ("",), (None,)], "answer string")).collect()
    assert [r.v.supports for r in single] == ["inconclusive"] * 3  # the outermost braces take in the tail


def test_closure_and_spans_on_odd_inputs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (3, 3)], "a long, b long")
    assert sorted(map(tuple, order.closure(edges).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]
    assert order.closure(edges.limit(0)).count() == 0
    points = spark.createDataFrame([("a", 0), ("a", 5), ("a", 9), ("a", 12), ("b", 5), ("a", None)], "k string, at int")
    spans = spark.createDataFrame([("a", 0, 5), ("a", 3, 10), ("a", 4, 4), ("c", 0, 99)], "k string, lo int, hi int")
    assert sorted(map(tuple, order.inside_spans(points, spans, "k", "at").collect())) == [("a", 0), ("a", 5), ("a", 9)]


def test_verified_cells_on_odd_rows(spark):
    cells = spark.createDataFrame([(1, 1, 0, False, 1, "yes", "body", "binary"), (1, 1, 1, False, 1, "no", "mention", "binary"), (1, 2, 0, False, 1, "yes", "body", "binary"), (1, 3, 0, False, 1, "yes", "body", "binary")], "t int, r int, col_index int, is_self boolean, n_cites int, mark string, gloss string, kind string")
    evidence = spark.createDataFrame([(1, 1, "text", None), (1, 3, "text", "the judge call for this row failed (X)")], "t int, r int, evidence string, failure string")
    answers = spark.createDataFrame([(1, 1, 0, 1, "has", "old", "2"), (1, 1, 0, 2, "nonsense", "why", "x"), (1, 1, 1, 1, " HAS ", "q", "0.25")], "t int, r int, col_index int, ord int, answer string, justification string, confidence string")
    got = {(x.r, x.col_index): x for x in verify.verify_cells(cells, evidence, answers, ["t", "r"]).collect()}
    assert (got[1, 0].verdict, got[1, 0].note, got[1, 0].confidence) == ("unverifiable", "why", None)
    assert (got[1, 1].verdict, got[1, 1].severity, got[1, 1].understates, got[1, 1].confidence) == ("contradicted", "low", True, 0.25) and got[1, 1].note.startswith("[weakly grounded")
    assert got[2, 0].note == verify.NO_EVIDENCE and "pipeline failure" in got[3, 0].note


def test_sections_of_tex_and_of_plain_text():
    assert claims.sections("pre \\section{One} a \\subsubsection*{Two x} b \\section{Empty} ") == [("", "pre"), ("One", "a"), ("Two x", "b")]
    assert claims.sections("Before.\n1 Introduction\nBody one goes.\n2.1. Method Used Here\nBody two. More.\n") == [("", "Before."), ("Introduction", "Body one goes."), ("Method Used Here", "Body two. More.")]
    assert claims.sections("no structure at all, just this.") == [("", "no structure at all, just this.")] and claims.sections(" ") == claims.sections(None) == []


def test_nearest_anchors_against_all_pairs(spark):
    import random

    from refloom.operators import layout

    r = random.Random(2)
    words = [(i, r.randint(0, 3), float(r.randint(0, 40))) for i in range(200)]
    anchors = [(r.randint(0, 2), c, float(r.randint(0, 40))) for c in range(20)]
    got = layout.nearest_anchor(spark.createDataFrame(words, "word_id int, page int, x double"), spark.createDataFrame(anchors, "page int, col int, ax double"), 3.0).collect()
    want = {(w, p, min((abs(x - ax), c) for q, c, ax in anchors if q == p and abs(x - ax) <= 3)[1]) for w, p, x in words if any(q == p and abs(x - ax) <= 3 for q, _, ax in anchors)}
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 30
