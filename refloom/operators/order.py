"""Order, spans and groups: occurrence numbers, segments, clusters, budgets, intervals and closures."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence_id(paper: Column, key: Column, over: list[str], order: list[str]) -> Column:
    """'<paper>:<key>#<n>' for the n-th occurrence of a key in a paper."""
    n = F.row_number().over(Window.partitionBy(*over).orderBy(*order))
    return F.concat(paper, F.lit(":"), key, F.lit("#"), n)


def segment_end(begin: str, end: Column, over: list[str]) -> Column:
    """Where the segment that begins at a position ends: at the next begin, the last one at end."""
    return F.coalesce(F.lead(begin).over(Window.partitionBy(*over).orderBy(begin)), end)


def clusters(rows: DataFrame, keys: list[str], value: str, tolerance: float, tie: str) -> DataFrame:
    """One-dimensional clusters of values per keys: a new one where the gap to the value before exceeds tolerance; keys, cluster, n, centre (the mean)."""
    w = Window.partitionBy(*keys).orderBy(value, tie)
    marked = rows.select(*keys, value, tie, F.when(F.col(value) - F.lag(value).over(w) > tolerance, 1).otherwise(0).alias("brk"))
    placed = marked.withColumn("cluster", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.avg(value).alias("centre"))


def median_gap(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The median difference of neighbouring values per keys; null for a single value."""
    gap = F.lead(value).over(Window.partitionBy(*keys).orderBy(value)) - F.col(value)
    return rows.select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.median("gap").alias("gap"))


def within_budget(rows: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """The first rows per keys up to the one that would exceed the budget; the first in any case. A later row that would fit again is not kept. Adds used."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({"used": F.sum(size).over(upto), "k": F.row_number().over(w)})
    over = F.max(((F.col("used") > budget) & (F.col("k") > 1)).cast("int")).over(upto)
    return summed.withColumn("over", over).filter("over = 0").drop("over", "k")


def interleaved(rows: DataFrame, keys: list[str], column: str, order: list[Column]) -> DataFrame:
    """Rows of several columns per keys in turn: all first ones by column, then all second ones; adds rank in the column and place."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, column).orderBy(*order)))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", column)).cast("long"))


def last_before(heading: Column, over: list[str], order: list[str]) -> Column:
    """As-of lookup: the last heading (null elsewhere) at or before each position."""
    return F.last(heading, ignorenulls=True).over(Window.partitionBy(*over).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def inside_spans(points: DataFrame, spans: DataFrame, key: str, at: str) -> DataFrame:
    """Points (key, at) that lie in some span (key, lo, hi) of the same key: lo <= at < hi.

    Spans of a key are merged first, so that each point meets one span by an as-of lookup over points and spans together: no pairs are formed.
    """
    w = Window.partitionBy(key).orderBy("lo", "hi")
    marked = spans.select(key, "lo", "hi").withColumn("until", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    islands = marked.withColumn("island", F.sum((F.col("until").isNull() | (F.col("lo") > F.col("until"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(key, "island").agg(F.min("lo").alias("at"), F.max("hi").alias("hi"))
    both = points.select(key, F.col(at).alias("at"), F.struct(*points.columns).alias("p"), F.lit(None).cast(dict(spans.dtypes)["hi"]).alias("hi")).unionByName(merged.select(key, "at", "hi"), allowMissingColumns=True)
    # a span that begins at a point holds it, so spans come first
    hi = F.last("hi", ignorenulls=True).over(Window.partitionBy(key).orderBy("at", F.col("p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("until", hi).filter(F.col("p").isNotNull() & (F.col("at") < F.col("until"))).select("p.*")


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that the cluster names; a session in one process makes its own."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="refloom-checkpoint-"))
    return df.checkpoint()


def closure(edges: DataFrame) -> DataFrame:
    """(root, node) for each node that can be reached from root along edges (a, b), root included, at any depth.

    Paths are doubled until none is new, so the rounds are the logarithm of the longest path; a node reached twice is one row.
    """
    now = _cut(edges.select(F.col("a").alias("root"), F.col("b").alias("node")).distinct())
    size = now.count()
    while size:
        onward = now.select(F.col("root").alias("via"), F.col("node").alias("next"))
        longer = _cut(now.unionByName(now.join(onward, F.col("node") == F.col("via")).select("root", F.col("next").alias("node"))).distinct())
        now, last, size = longer, size, longer.count()
        if size == last:
            break
    return now.unionByName(edges.select(F.col("a").alias("root"), F.col("a").alias("node"))).distinct()


def smoke(rows: DataFrame, positive: Column, order: list[Column], n: int = 18) -> DataFrame:
    """The first n rows, positive ones before the others."""
    return rows.orderBy(F.desc(positive), *order).limit(n)
