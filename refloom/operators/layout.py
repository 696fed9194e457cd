"""Geometry of pages: words to lines, greedy scans in Arrow groups where order decides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.sources.claims import entry_text

#: Fixed pattern: a line that goes on with a link rather than begin an entry.
LINK_GOES_ON = r"^(?:https?://|www\.|doi:|10\.[0-9]{4,}/)"


def baselines(words: DataFrame, tolerance: float = 1.5, gap: float = 24.0) -> DataFrame:
    """Lines of text from words (doc_id, page, x0, y0, x1, text): a word joins the first line whose first word is
    within tolerance in y; a line splits where the gap is wide. First fit depends on order, so it runs per page."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads: list[float] = []
        lines: list[list[tuple]] = []
        for w in pdf.sort_values(["y0", "x0", "text"]).itertuples(index=False):
            k = next((i for i, y in enumerate(heads) if abs(w.y0 - y) <= tolerance), None)
            if k is None:
                heads.append(w.y0)
                lines.append([])
                k = len(lines) - 1
            lines[k].append((w.x0, w.x1, w.text))
        rows = []
        for y, line in zip(heads, lines, strict=True):
            part: list[tuple] = []
            for w in sorted(line):
                if part and w[0] - part[-1][1] > gap:
                    rows.append((y, part[0][0], part[-1][1], " ".join(x[2] for x in part)))
                    part = []
                part.append(w)
            rows.append((y, part[0][0], part[-1][1], " ".join(x[2] for x in part)))
        out = pd.DataFrame(rows, columns=["y0", "x0", "x1", "text"])
        out.insert(0, "page", pdf["page"].iloc[0])
        out.insert(0, "doc_id", pdf["doc_id"].iloc[0])
        return out

    return words.groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, y0 double, x0 double, x1 double, text string")


def hanging_entries(lines: DataFrame, indent: float = 6.0) -> DataFrame:
    """Reference entries from lines (doc_id, page, col, y0, x0, text): a line at the left edge of its page's column begins one, unless
    it is under three characters long or goes on with a link. Entries run on over columns and pages; doc_id, entry, text."""
    edges = lines.groupBy("doc_id", "page", "col").agg(F.min("x0").alias("edge"))
    begins = (F.col("x0") <= F.col("edge") + indent) & (F.length("text") >= 3) & ~F.col("text").rlike(LINK_GOES_ON)
    marked = lines.join(edges, ["doc_id", "page", "col"]).withColumn("begins", begins.cast("int"))
    entry = F.sum("begins").over(Window.partitionBy("doc_id").orderBy("page", "col", "y0", "x0").rowsBetween(Window.unboundedPreceding, 0))
    ordered = F.array_sort(F.collect_list(F.struct("page", "col", "y0", "x0", "text")))
    return marked.withColumn("entry", entry).groupBy("doc_id", "entry").agg(entry_text(F.transform(ordered, lambda x: x["text"])).alias("text"))


def keep_non_overlapping(spans: DataFrame, key: list[str]) -> DataFrame:
    """Of spans (start, end) per key keep the earliest, of these the longest, that overlap none kept before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.assign(_n=pdf["start"] - pdf["end"]).sort_values(["start", "_n"], kind="stable").drop(columns="_n")
        kept, last = [], None
        for i, (a, b) in enumerate(zip(ordered["start"], ordered["end"], strict=True)):
            if last is None or a >= last:
                kept.append(i)
                last = b
        return ordered.iloc[kept]

    return spans.groupBy(*key).applyInPandas(run, spans.schema)


def nearest_anchor(words: DataFrame, anchors: DataFrame, reach: float) -> DataFrame:
    """Each word (word_id, page, x) with the nearest anchor (page, col, ax) of its page within reach, the one of the least col of equally near ones.

    Words and anchors are sorted together, and each word looks at the anchor before and the one after it: no pairs are formed.
    """
    places = anchors.groupBy("page", F.col("ax").alias("x")).agg(F.min("col").alias("col"))
    both = words.select("page", "x", "word_id", F.lit(None).cast(dict(anchors.dtypes)["col"]).alias("col")).unionByName(places, allowMissingColumns=True)
    w = Window.partitionBy("page").orderBy("x", F.col("word_id").isNotNull())
    spot = F.when(F.col("word_id").isNull(), F.struct("x", "col"))
    seen = both.withColumns({"before": F.last(spot, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first(spot, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}).filter("word_id IS NOT NULL")
    away = lambda a: F.when(a.isNotNull(), F.struct(F.abs(F.col("x") - a["x"]).alias("dx"), a["col"].alias("col")))
    best = F.array_min(F.array_compact(F.array(away(F.col("before")), away(F.col("after")))))
    return seen.withColumn("best", best).filter(F.col("best.dx") <= reach).select("word_id", "page", "best.col")


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page, width, x0, y0, x1, y1, text) with their place on the page: wide blocks of the top fifth, the left column, the right one, other wide blocks."""
    page = Window.partitionBy("doc_id", "page")
    wide, middle = F.col("x1") - F.col("x0") >= 0.72 * F.col("width"), (F.col("x0") + F.col("x1")) / 2
    part = F.when(wide, F.when(F.col("y1") < 0.22 * F.max("y1").over(page), 0).otherwise(3)).when(middle < F.col("width") / 2, 1).otherwise(2)
    order = page.orderBy("part", F.bround("y0"), "x0", "text")
    return blocks.withColumn("part", part).withColumn("place", F.row_number().over(order)).drop("part")


def carried_headers(cells: DataFrame, keys: list[str], order: str, name: str, span: str) -> DataFrame:
    """cells with the group above each column of a table (keys): the name of the last cell that spans several columns and goes on over those of span 0; none below cells of one column."""
    before = Window.partitionBy(*keys).orderBy(order)
    own = F.when(F.col(span) != 0, F.struct(F.when(F.col(span) > 1, F.col(name)).alias("g")))
    return cells.withColumn("group", F.last(own, ignorenulls=True).over(before)["g"])
