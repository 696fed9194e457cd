"""Usage ledgers: prices, costs and ceilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def estimate_tokens(c: Column) -> Column:
    """A quarter of the length by banker's rounding, at least one; none for an empty text."""
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(F.length(c) / 4.0).cast("int")))


def priced(usage: DataFrame, prices: DataFrame, default: tuple[float, float] = (3.0, 15.0)) -> DataFrame:
    """usage (model) with p_in and p_out of the longest price key that its model name contains."""
    models = usage.select("model").distinct()
    found = models.join(F.broadcast(prices), F.contains(F.lower("model"), F.col("key"))).groupBy("model").agg(F.max_by(F.struct("p_in", "p_out"), F.struct(F.length("key"), "key")).alias("p"))
    return usage.join(found, "model", "left").withColumns({"p_in": F.coalesce("p.p_in", F.lit(default[0])), "p_out": F.coalesce("p.p_out", F.lit(default[1]))}).drop("p")


def cost(tokens_in: Column, tokens_out: Column, p_in: Column, p_out: Column) -> Column:
    return F.round((tokens_in * p_in + tokens_out * p_out) / 1e6, 6)


def under_ceiling(ledger: DataFrame, by: list[str], order: list[str], amount: str, ceiling: float) -> DataFrame:
    """Rows up to which the running amount stays within the ceiling."""
    spent = F.sum(amount).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ledger.withColumn("spent", spent).filter(F.col("spent") <= ceiling)


COUNTERS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "num_turns", "tool_calls", "wall_seconds")


def full_cost(p_in: Column, p_out: Column) -> Column:
    """Cost of a row of COUNTERS at prices per million tokens: cached tokens cost what others do."""
    billed = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    return cost(billed, F.col("output_tokens"), p_in, p_out)


def totals(slices: DataFrame, by: list[str]) -> DataFrame:
    """Sums of COUNTERS and cost_usd of slices of usage, missing ones as none; a reported cost goes before a computed one. slices: by, COUNTERS, reported_usd, cost_usd."""
    paid = F.coalesce("reported_usd", "cost_usd", F.lit(0.0))
    return slices.groupBy(*by).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTERS], F.round(F.sum(paid), 6).alias("cost_usd"))


_TOKENS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def reported(messages: DataFrame, message: str, single_calls: bool = False) -> DataFrame:
    """messages with COUNTERS and reported_usd by the JSON text in a column: usage, num_turns, duration_ms, total_cost_usd. What is missing or no number counts nothing; single calls are one turn each and report no time or cost."""
    v = F.try_parse_json(message)
    number = lambda path: F.coalesce(F.try_variant_get(v, path, "double"), F.lit(0.0))
    tokens = {c: number(f"$.usage.{t}").cast("long") for c, t in zip(COUNTERS[:4], _TOKENS, strict=True)}
    if single_calls:
        run = {"num_turns": F.lit(1).cast("long"), "wall_seconds": F.lit(0.0), "reported_usd": F.lit(None).cast("double")}
    else:
        run = {"num_turns": number("$.num_turns").cast("long"), "wall_seconds": number("$.duration_ms") / 1000, "reported_usd": F.try_variant_get(v, "$.total_cost_usd", "double")}
    return messages.withColumns({**tokens, **run, "tool_calls": F.lit(0).cast("long")})


def model_of(tier: Column, bulk: str, judge: str) -> Column:
    """The model of a tier; that of the bulk for all but judges."""
    return F.when(tier == "judge", judge).otherwise(bulk)
