"""Comparison tables from the words of a page.

The marks of a capability matrix are its skeleton: their places give the columns and rows, and every other word goes to the nearest
one in reach. A page is the unit, as positions mean nothing beyond it, so pages are grouped and read one by one in Arrow groups.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from refloom.operators.grid import DASHES, EMPTY_WORDS, PDF_NO, PDF_NO_WORDS, PDF_PARTIAL, PDF_PARTIAL_WORDS, PDF_YES, PDF_YES_WORDS
from refloom.sources.textables import compares, own_row

#: Fixed values, in points: how far a mark may lie from its column and its row, a gap between tables, a gap between labels and prose,
#: how far above the marks headers begin, how far beside them they lie, and how many lines they take.
COLUMN, ROW, TABLE_GAP, PROSE_GAP, HEAD_ABOVE, HEAD_BESIDE, HEAD_LINES = 12.0, 6.0, 60.0, 40.0, 70.0, 90.0, 3
#: Fixed patterns: a caption's beginning, and citations in a row's label by number and by author and year.
CAPTION_LINE = re.compile(r"\s*(?:Table|TABLE|Tab\.)\s*[IVXLC0-9]+\s*[.:]", re.IGNORECASE)
BY_NUMBER = re.compile(r"\[(\d+(?:\s*[,–-]\s*\d+)*)\]")
BY_AUTHOR = re.compile(r"\(?\b([A-Z][A-Za-z'’-]+(?:\s+(?:et\s+al\.?|and|&)\s+[A-Z][A-Za-z'’-]+)?),?\s*(?:et\s+al\.?,?\s*)?\(?((?:19|20)\d{2}[a-z]?)\)?")
MARKS = PDF_YES + PDF_NO + PDF_PARTIAL
_LOST = {ord(m) - 0x2700: m for m in MARKS if 0 <= ord(m) - 0x2700 < 0x20}


def cell_mark(raw: str | None) -> str:
    """The mark of a cell, as operators.grid.normalize_pdf_mark() has it."""
    cell = (raw or "").translate(_LOST).strip()
    if not cell:
        return "empty"
    for mark, signs in (("yes", PDF_YES), ("no", PDF_NO), ("partial", PDF_PARTIAL)):
        if set(cell) & set(signs):
            return mark
    low = " ".join(cell.split()).lower()
    words = {"no": (*DASHES, *PDF_NO_WORDS), "empty": EMPTY_WORDS, "yes": PDF_YES_WORDS, "partial": PDF_PARTIAL_WORDS}
    return next((mark for mark, some in words.items() if low in some), "value")


def cited(label: str) -> list[str]:
    """The citations of a row's label: numbers in brackets, or else 'Author Year'."""
    numbers = [n for m in BY_NUMBER.finditer(label) for n in re.findall(r"\d+", m[1])]
    return numbers or [f"{m[1]} {m[2]}" for m in BY_AUTHOR.finditer(label)]


def centres(places: np.ndarray, gap: float) -> np.ndarray:
    """The means of runs of places whose neighbours lie within gap."""
    places = np.sort(places)
    return np.array([run.mean() for run in np.split(places, np.flatnonzero(np.diff(places) > gap) + 1)])


def one_table(marks: pd.DataFrame, width: float) -> pd.DataFrame:
    """The marks of the page's largest table: tables part at tall gaps, and at the gutter where the gap there is far wider than the table's own pitch. All marks if none has four."""
    best = marks.iloc[:0]
    by_y = marks.sort_values("y", kind="stable")
    for _, band in by_y.groupby((by_y["y"].diff() > TABLE_GAP).cumsum()):
        band = band.sort_values("x", kind="stable")
        gaps = band["x"].diff()
        steps = np.sort(gaps[gaps > 1])
        least = max(0.18 * width, 2.5 * steps[len(steps) // 2] if len(steps) else 0.0)
        gutter = np.flatnonzero((gaps > least) & (band["x"] > width / 2) & (band["x"].shift() < width / 2))
        parts = np.split(np.arange(len(band)), gutter[:1])
        best = max([best, *(band.iloc[p] for p in parts)], key=len)
    return best if len(best) >= 4 else marks


def _joined(words: pd.DataFrame) -> str:
    return " ".join(words.sort_values("x0", kind="stable")["text"]).strip()


def _labels(words: pd.DataFrame, rows: np.ndarray, reach: float, left: bool) -> list[str]:
    """For each row, its words on one side of the marks that run on without a wide gap."""
    near = words[words["off_row"] <= reach]
    out = []
    for r in range(len(rows)):
        line = near[near["row"] == r].sort_values("x0", kind="stable")
        breaks = np.flatnonzero(line["x0"].to_numpy()[1:] - line["x1"].to_numpy()[:-1] > PROSE_GAP) + 1
        runs = np.split(np.arange(len(line)), breaks)
        out.append(_joined(line.iloc[runs[-1 if left else 0]]))
    return out


def page_grid(words: pd.DataFrame, width: float) -> list[list[str]] | None:
    """The capability matrix of a page from words (x0, y0, x1, y1, text), headers first; None without two columns and two rows of two marks."""
    if len(words) < 4:
        return None
    w = words.assign(text=[t.translate(_LOST) for t in words["text"]], x=(words["x0"] + words["x1"]) / 2, y=(words["y0"] + words["y1"]) / 2)
    is_mark = w["text"].str.strip().str.fullmatch(f"[{MARKS}]+").astype(bool)
    marks, rest = w[is_mark], w[~is_mark]
    if len(marks) < 4:
        return None
    marks = one_table(marks, width)
    cols, rows = centres(marks["x"].to_numpy(), COLUMN), centres(marks["y"].to_numpy(), ROW)
    in_row = np.abs(marks["y"].to_numpy()[:, None] - rows) <= ROW
    if len(cols) < 2 or len(rows) < 2 or (in_row.sum(axis=0) >= 2).sum() < 2:
        return None
    left, right, top = marks["x0"].min(), marks["x1"].max(), marks["y0"].min()
    dx, dy = np.abs(rest["x"].to_numpy()[:, None] - cols), np.abs(rest["y"].to_numpy()[:, None] - rows)
    rest = rest.assign(col=dx.argmin(axis=1), off_col=dx.min(axis=1), row=dy.argmin(axis=1), off_row=dy.min(axis=1))
    spacing = float(np.median(np.diff(cols)))

    reach = max(2.0, min(ROW, np.diff(rows).min() / 2))
    sides = [_labels(rest[rest["x1"] < left - 3], rows, reach, True), _labels(rest[rest["x0"] > right + 3], rows, reach, False)]
    labels = max(sides, key=lambda side: sum(bool(re.search("[A-Za-z]", s)) for s in side))

    above = rest[(rest["y0"] < top - 2) & (top - rest["y0"] <= HEAD_ABOVE)]
    above = above.assign(line=(above["y0"] / 3).round())
    head, taken = [], 0
    for _, line in sorted(above.groupby("line"), key=lambda kv: -kv[0])[:HEAD_LINES]:
        if CAPTION_LINE.search(_joined(line)):
            continue
        beside = line[line["x"].between(left - HEAD_BESIDE, right + HEAD_BESIDE)]
        head.append(beside)
        taken += len(beside)
        if taken >= len(cols):
            break
    named = pd.concat(head) if head else above.iloc[:0]
    named = named[named["off_col"] <= max(3.5 * COLUMN, spacing / 2)]
    named = named.assign(line=named["y0"].round()).sort_values(["line", "x0"], kind="stable")
    headers = [" ".join(named.loc[named["col"] == c, "text"]).strip() for c in range(len(cols))]

    inside = rest[rest["x"].between(left - 3, right + 3) & (rest["off_col"] <= max(COLUMN, spacing / 2 - 2))]
    grid = [["Method", *headers]]
    for r, label in enumerate(labels):
        signs, here = marks[in_row[:, r]], inside[np.abs(inside["y"] - rows[r]) <= ROW]
        line = [label]
        for c, place in enumerate(cols):
            hit = signs[np.abs(signs["x"] - place) <= COLUMN]
            line.append(hit["text"].iloc[0] if len(hit) else _joined(here[here["col"] == c]))
        if any(x.strip() for x in line):
            grid.append(line)
    return grid if len(grid) > 1 else None


def issues(grid: list[list[str]] | None) -> list[str]:
    """What makes a grid doubtful: missing headers and labels, labels of several rows, rows with some cells only."""
    if not grid or len(grid) < 2:
        return ["no rows parsed"]
    width, body = len(grid[0]) - 1, grid[1:]
    blank = sum(not h.strip() for h in grid[0][1:])
    nameless = sum(not r[0].strip() for r in body)
    crowded = sum(len(re.findall(r"[A-Za-z]{3,}\s*\(", r[0])) >= 2 for r in body)
    ragged = sum(sum(bool(c.strip()) for c in r[1:]) not in (0, width) for r in body)
    found = (
        (blank, f"{blank}/{width} column header(s) came out empty"),
        (nameless, f"{nameless}/{len(body)} row label(s) came out empty"),
        (crowded, f"{crowded} row label(s) look like several merged rows"),
        (ragged, f"{ragged}/{len(body)} row(s) have a partial mark count"),
    )
    return [text for n, text in found if n]


def rectangular(grid: object) -> list[list[str]] | None:
    """What another reader made of a page as rows of equally many texts; None under two rows."""
    given = [r for r in grid if isinstance(r, (list, tuple, np.ndarray))] if isinstance(grid, (list, np.ndarray)) else []
    rows = [["" if c is None else str(c).strip() for c in r] for r in given]
    rows = [r for r in rows if any(r)]
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows] if len(rows) >= 2 else None


CELLS = "source string, warnings array<string>, row_index int, row_label string, cite_keys array<string>, is_self boolean, col_index int, header string, raw string, mark string"


def grid_cells(grid: list[list[str]], names: list[str], source: str = "pdf") -> list[tuple]:
    """Rows of CELLS of a grid; rows without a label are left out. A row that cites nothing is the paper's own only where it says so."""
    out, doubts = [], issues(grid)
    for r, row in enumerate(grid[1:]):
        label = row[0].strip()
        if label:
            keys = cited(label)
            own = own_row(label, keys, names, strict=True)
            out += [(source, doubts, r, label, keys, own, c, grid[0][c].strip(), row[c], cell_mark(row[c])) for c in range(1, len(grid[0]))]
    return out


def page_tables(words: DataFrame, names: list[str] = (), pages: int = 12) -> DataFrame:
    """doc_id, page and CELLS of the comparison tables on the first pages of documents.

    words: doc_id, page (from 0), width, x0, y0, x1, y1, text (null ones count nothing), other (null, or rows that another reader, such as one of images, made of the page; they count where they have fewer issues and the grid has some).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        grid, source = page_grid(pdf[pdf["text"].notna()].sort_values(["y0", "x0", "text"], kind="stable"), first["width"]), "pdf"
        rows = []
        if grid and compares(grid, cell_mark):
            other = rectangular(first["other"]) if issues(grid) else None
            if other and len(issues(other)) < len(issues(grid)):
                grid, source = other, "pdf+ocr"
            rows = grid_cells(grid, list(names), source)
        return pd.DataFrame([(first["doc_id"], first["page"], *x) for x in rows], columns=["doc_id", "page", *[c.strip().split(" ")[0] for c in CELLS.split(", ")]])

    types = dict(words.dtypes)
    return words.filter(words["page"] < pages).groupBy("doc_id", "page").applyInPandas(run, f"doc_id {types['doc_id']}, page {types['page']}, {CELLS}")
