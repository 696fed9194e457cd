import pandas as pd
import pytest
from pyspark.sql import functions as F

from refloom.operators.grid import normalize_pdf_mark
from refloom.sources.pagetables import cell_mark, cited, issues, one_table, page_grid, page_tables, rectangular


def words(*rows):
    return pd.DataFrame([(x - 4.0, y - 4.0, x + 4.0, y + 4.0, t) for x, y, t in rows], columns=["x0", "y0", "x1", "y1", "text"])


def test_marks_of_cells_are_those_of_columns(spark):
    raw = ["", "  ", "\x13", "\x17", "", "", "✓ (some)", "×", "▲", "-", "--", "N/A", "unk", "Yes", "FULL", "none", "Partly", "medium", "ILP", "3.5", "n", "?", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", normalize_pdf_mark(F.col("r")).alias("m")).orderBy("i").collect()
    assert [r["m"] for r in got] == [cell_mark(r) for r in raw]
    assert [cell_mark(x) for x in ("\x13", "\x17", "", "", "-", "?", "ILP")] == ["yes", "no", "yes", "no", "no", "empty", "value"]


@pytest.mark.parametrize(("label", "keys"), [("Net [3, 5–7]", ["3", "5", "7"]), ("Aug (Rao et al., 2020)", ["Rao 2020"]), ("Lee and Wu 2019b", ["Lee and Wu 2019b"]), ("Ours", []), ("", [])])
def test_citations_of_labels(label, keys):
    assert cited(label) == keys


def test_tables_part_at_the_gutter():
    left = [(x, y, "✓") for x in (100, 130, 160) for y in (100, 112)]
    right = [(x, y, "✗") for x in (400, 430) for y in (100, 112)]
    marks = words(*left, *right).assign(x=lambda m: (m.x0 + m.x1) / 2, y=lambda m: (m.y0 + m.y1) / 2)
    assert set(one_table(marks, 612.0)["text"]) == {"✓"}
    wide = words(*[(x, y, "✓") for x in (100, 250, 400, 550) for y in (100, 112)]).assign(x=lambda m: (m.x0 + m.x1) / 2, y=lambda m: (m.y0 + m.y1) / 2)
    assert len(one_table(wide, 612.0)) == 8
    tall = words(*left, *[(x, 300, "✗") for x in (100, 130, 160)]).assign(x=lambda m: (m.x0 + m.x1) / 2, y=lambda m: (m.y0 + m.y1) / 2)
    assert set(one_table(tall, 612.0)["text"]) == {"✓"}


def test_grids_need_two_rows_of_two_marks():
    assert page_grid(words((100, 100, "✓"), (130, 100, "✗"), (160, 100, "✓"), (190, 100, "✓")), 612.0) is None
    assert page_grid(words((100, 100, "✓"), (130, 112, "✗"), (100, 124, "✓"), (130, 136, "✓")), 612.0) is None
    grid = page_grid(words((100, 100, "✓"), (130, 100, "✗"), (100, 112, "✓"), (130, 112, "✓"), (170, 112, "Right"), (170, 100, "Side")), 612.0)
    assert grid == [["Method", "", ""], ["Side", "✓", "✗"], ["Right", "✓", "✓"]]
    assert issues(grid) == ["2/2 column header(s) came out empty"]


def test_doubts_and_ragged_grids():
    assert issues(None) == issues([["Method", "A"]]) == ["no rows parsed"]
    assert issues([["M", "A", "B"], ["", "✓", ""], ["Net (a) Aug (b)", "✓", "✗"]]) == ["1/2 row label(s) came out empty", "1 row label(s) look like several merged rows", "1/2 row(s) have a partial mark count"]
    assert rectangular([["M", "A", "B"], [None, ""], "junk", ["Net", 1]]) == [["M", "A", "B"], ["Net", "1", ""]]
    assert rectangular([["M"]]) is None and rectangular(None) is None and rectangular("x") is None


def test_pages_without_words_give_nothing(spark):
    schema = "doc_id long, page int, width double, x0 double, y0 double, x1 double, y1 double, text string, other array<array<string>>"
    assert page_tables(spark.createDataFrame([], schema)).count() == 0
    assert page_tables(spark.createDataFrame([(1, 0, 612.0, 1.0, 1.0, 2.0, 2.0, None, None)], schema)).count() == 0
