"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, served up to ``max_epochs``
times over. What is served at a time is a packet: a document, or, where a document has
more than a thousandth of its source's target, a part of it. A packet's virtual finish
time is the number of its source's words up to and with it, divided by the source's
target. All packets are sorted by finish time, by ranges over the whole cluster; a
running sum of their words cuts the order at the total budget, and the packet over which
the budget runs out is taken in part. Sources progress in proportion to their targets,
so each is served its target to within a packet.

The budget is shared out as targets first: by weight, up to max_epochs times a source's
size, what exceeds that going to the others. Sources with the least size per weight reach
their cap first, so one running sum over the sources in this order tells which do.

All running sums are distributed (common.running): no source, and no table of sources, is
in one task or on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import WORD, discard, running, stage, text_key

MAX_EPOCHS = 3
#: A packet has at most this share of its source's target, and at least a word.
PACKETS = 1000


def cyclic_weight(rank: Column) -> Column:
    """1, 2, 3, repeating, by the rank (from 0) of a source by code point, null last."""
    return (rank % 3 + 1).cast("double")


def source_targets(sources: DataFrame, weight: Callable[[Column], Column], budget: int | None, cap: int) -> DataFrame:
    """sources (source, source_size) with target and source_start, the words of all sources before this one by code point, null last."""
    ordered = [F.col("source").isNull(), F.col("source")]
    ranked = running(sources.withColumn("one", F.lit(1)), ordered, ("one", "source_size"), "mix-sources")
    weighed = stage(ranked.withColumn("weight", weight(F.col("one_before"))).select("source", "source_size", F.col("source_size_before").alias("source_start"), "weight"), "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    budget = float(total if budget is None else budget)
    queued = weighed.filter("source_size > 0 AND weight > 0").withColumn("cap", F.col("source_size") * F.lit(cap))
    filled = stage(running(queued, [F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source")], ("cap", "weight"), "mix-filling"), "mix-filled")
    weights = float(filled.agg(F.sum("weight")).first()[0] or 0.0)
    share = (F.lit(budget) - F.col("cap_before")) * F.col("weight") / (F.lit(weights) - F.col("weight_before"))
    caps, open_ = filled.agg(F.sum(F.when(share > F.col("cap"), F.col("cap"))), F.sum(F.when(~(share > F.col("cap")), F.col("weight")))).first()
    rest = F.lit(budget - float(caps or 0)) * F.col("weight") / F.lit(float(open_ or 1.0))
    targets = filled.select(F.col("source").alias("__s"), F.when(share > F.col("cap"), F.col("cap").cast("double")).otherwise(rest).alias("target"))
    out = weighed.join(targets, F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "source_size", "source_start", F.coalesce("target", F.lit(0.0)).alias("target"))
    return stage(out, "mix-targets")


def mix(
    docs: DataFrame, weight: Callable[[Column], Column] = cyclic_weight, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: str = "mix", packets: int = PACKETS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """How many words of each document the mix takes.

    docs needs doc_id, text and source (and the columns of carry); others are not read.
    Returns doc_id, size, source, source_size, target (of its source), taken,
    start_time and finish_time (virtual, of its first serving; null in a source without
    target) and carry. Rows come globally sorted by finish time. A null text has size 0 and nothing is taken
    of it; the null source is a source; documents are shuffled by a hash of doc_id and
    text, and equal rows may swap places, which changes no result. A long text is queued in several
    packets. Packets of one finish time go by source, null last. budget defaults to all sizes; all of it is taken,
    unless max_epochs servings of all documents have less. An empty table gives none. carry may name any
    columns of docs, those of the result included: they come back last under the name given.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lower(F.hex(text_key(F.col("text"))))).cast("binary"))
    # staged, so that a row keeps its mark
    sized = stage(docs.select("doc_id", "source", size.alias("size"), order.alias("o"), F.monotonically_increasing_id().alias("row"), *(F.col(c).alias(f"__{c}") for c in carry)), "mix-sized")
    narrow = sized.select("source", "size", "o", "row")
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weight, budget, max_epochs)
    queued = running(narrow, [F.col("source").isNull(), F.col("source"), F.col("o"), F.col("row")], ("size",), "mix-queues")
    # the table of sources has a row for each source; AQE splits a hot one, both sides being staged
    both = stage(queued, "mix-queued").join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    queue = stage(both.withColumn("first", F.col("size_before") - F.col("source_start")), "mix-served")  # the source's words before the document
    # no packet that begins after this time is reached: by then each source has been served its target in whole packets
    part = F.greatest(F.lit(1.0), F.ceil(F.col("target") / packets))
    horizon = 1.0 + float(targets.filter("target > 0").agg(F.max(part / F.col("target"))).first()[0] or 0.0) + 1e-9
    epochs = queue.filter("size > 0 AND target > 0").withColumns({"part": part.cast("long"), "e": F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))}).withColumn("begin", F.col("first") + F.col("e") * F.col("source_size"))
    epochs = epochs.filter(F.col("begin") <= F.col("target") * horizon)
    pieces = epochs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("part"))))).withColumn("n", F.least("part", F.col("size") - F.col("i") * F.col("part")))
    timed = pieces.select("source", "o", "row", "e", "i", "n", ((F.col("begin") + F.col("i") * F.col("part") + F.col("n")) / F.col("target")).alias("time"))
    served = running(timed, [F.col("time"), F.col("source").isNull(), F.col("source"), F.col("o"), F.col("row"), F.col("e"), F.col("i")], ("n",), "mix-packets")
    words = int(targets.agg(F.sum("source_size")).first()[0] or 0) if budget is None else budget
    taken = served.withColumn("t", F.least(F.lit(words) - F.col("n_before"), F.col("n"))).filter("t > 0").groupBy(F.col("row").alias("__row")).agg(F.sum("t").alias("taken"))
    placed = stage(queue.join(taken, F.col("row") == F.col("__row"), "left").select(F.col("row").alias("__row"), "source_size", "target", "first", F.coalesce("taken", F.lit(0)).alias("taken")), "mix-taken")
    out = sized.join(placed, F.col("row") == F.col("__row")).select(
        "doc_id", "size", "source", "source_size", "target", "taken",
        F.try_divide("first", "target").alias("start_time"), F.try_divide(F.col("first") + F.col("size"), F.col("target")).alias("finish_time"), *(F.col(f"__{c}").alias(c) for c in carry),
    )
    discard(queue)
    return out.orderBy("finish_time", "source", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    from refloom.llm.common import read

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB: the same mix. Targets are filled in closed form: sources by size / weight; a source is at its cap
#: if the budget left by the smaller ratios, shared by weight over the rest, exceeds it. Packets are sorted by finish time and cut at the budget.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS o, row_number() OVER () AS row
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (SELECT *, CAST((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s
), r AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source) AS k FROM w WHERE source_size > 0
), p AS (SELECT *, CAST((SELECT sum(source_size) FROM w) AS DOUBLE) AS total,
              sum(3 * source_size) OVER (ORDER BY k) - 3 * source_size AS caps, sum(weight) OVER () - (sum(weight) OVER (ORDER BY k) - weight) AS from_here FROM r
), q AS (SELECT *, (total - caps) * weight / from_here > 3 * source_size AS capped FROM p
), t AS (SELECT w.source, w.source_size, CASE WHEN q.source_size IS NULL THEN 0.0 WHEN q.capped THEN 3.0 * q.source_size
              ELSE (q.total - (SELECT coalesce(sum(3 * source_size), 0) FROM q WHERE capped)) * q.weight / (SELECT sum(weight) FROM q WHERE NOT capped) END AS target
         FROM w LEFT JOIN q ON w.source IS NOT DISTINCT FROM q.source
), c AS (SELECT d.*, t.source_size, t.target, CAST(greatest(1, ceil(t.target / 1000)) AS BIGINT) AS part,
                CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, row ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS first
         FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, first + e * source_size AS begin FROM c, (VALUES (0), (1), (2)) v(e) WHERE size > 0 AND target > 0
), i AS (SELECT *, least(part, size - i * part) AS n, (begin + i * part + least(part, size - i * part)) / target AS time FROM (SELECT *, unnest(range((size - 1) // part + 1)) AS i FROM e)
), u AS (SELECT row, n, sum(n) OVER (ORDER BY time, source COLLATE "C" NULLS LAST, o, row, e, i ROWS UNBOUNDED PRECEDING) - n AS before FROM i
), x AS (SELECT row, CAST(sum(greatest(0, least(n, (SELECT sum(source_size) FROM w) - before))) AS BIGINT) AS taken FROM u GROUP BY row)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, coalesce(taken, 0) AS taken FROM c LEFT JOIN x ON c.row = x.row
"""
