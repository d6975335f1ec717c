"""Model calls as a log: totals, running cost, milestones, switches.  Prices are a table the caller brings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.ordered import previous, running_total


def call_cost(usage: DataFrame, prices: DataFrame, default: tuple[float, float] = (0.0, 0.0), free_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """``usage`` (model, prompt_tokens, completion_tokens) with cost from prices for a million tokens.

    ``prices``: model, input_price, output_price.  Models without a price cost the default, or nothing if their name
    begins with a free prefix.  The price table is joined by whatever strategy its size allows.
    """
    free = F.lit(False)
    for p in free_prefixes:
        free = free | F.lower("model").startswith(p)
    j = usage.join(prices.dropDuplicates(["model"]), "model", "left")
    a = F.coalesce("input_price", F.when(free, 0.0).otherwise(default[0]))
    b = F.coalesce("output_price", F.when(free, 0.0).otherwise(default[1]))
    return j.withColumn("cost", F.col("prompt_tokens") / 1e6 * a + F.col("completion_tokens") / 1e6 * b).drop("input_price", "output_price")


def by_model(usage: DataFrame, model: str, cost: str) -> DataFrame:
    """(model, calls, cost); a null cost counts as 0."""
    return usage.groupBy(model).agg(F.count("*").alias("calls"), F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 6).alias("cost"))


def model_choice(usage: DataFrame, order_by: list[str], cost: str, switch_at: float, cap: float, first: str = "primary", second: str = "fallback") -> DataFrame:
    """``usage`` with cost_before, and choice: first, second from ``switch_at`` on, stopped from ``cap`` on (cap 0: never)."""
    out = running_total(usage, order_by, {"total": F.col(cost)})
    before = F.round(F.col("total") - F.coalesce(cost, F.lit(0.0)), 6)
    choice = F.when((F.lit(cap) > 0) & (F.col("cost_before") >= cap), "stopped").when(F.col("cost_before") >= switch_at, second).otherwise(first)
    return out.withColumn("cost_before", before).withColumn("choice", choice).drop("total")


def milestones(usage: DataFrame, order_by: list[str], cost: str, cap: float, shares: tuple[float, ...] = (0.5, 0.8, 1.0)) -> DataFrame:
    """(share, reached_at): the first row, by its last order key, at which the running cost reaches a share of the cap."""
    out = running_total(usage, order_by, {"total": F.col(cost)})
    cols = [F.min(F.when(F.round("total", 9) >= round(cap * s, 9), F.struct(*order_by)))[order_by[-1]].alias(str(k)) for k, s in enumerate(shares)]
    one = out.agg(*cols)
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(str(k)).alias("reached_at")) for k, s in enumerate(shares)])).alias("x")).select("x.*")


def transitions(usage: DataFrame, group: list[str], order: list[str], model: str) -> DataFrame:
    """(group, order, from_model, to_model): places where the model of a group changes; the order is total in a group."""
    out = previous(usage.select(*group, *order, model), group, order, model, "from_model")
    return out.where(F.col("from_model").isNotNull() & (F.col("from_model") != F.col(model))).select(*group, *order, "from_model", F.col(model).alias("to_model"))


def completeness(results: DataFrame, success: Column) -> DataFrame:
    """One row: attempted, failed, complete."""
    ok = F.coalesce(success, F.lit(False))
    return results.agg(F.count("*").alias("attempted"), F.count_if(~ok).alias("failed"), (F.count_if(~ok) == 0).alias("complete"))


def model_report(chunks: DataFrame, usage: DataFrame, model: str = "model") -> DataFrame:
    """(model, chunks, tokens, cost): how many chunks each model analyzed beside what it cost; models of either side."""
    zero = F.lit(0).cast("long")
    done = chunks.select(model, F.lit(1).cast("long").alias("chunks"), zero.alias("tokens"), F.lit(0.0).alias("cost"))
    tokens = (F.coalesce("prompt_tokens", zero) + F.coalesce("completion_tokens", zero)).cast("long")
    spent = usage.select(model, zero.alias("chunks"), tokens.alias("tokens"), F.coalesce("cost", F.lit(0.0)).alias("cost"))
    return done.unionByName(spent).groupBy(model).agg(F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))


def soft_cap(usage: DataFrame, order_by: list[str], cost: str, switch_at: float, share: float = 0.8) -> DataFrame:
    """At most one row, (order, cost_before, remaining, percent): the first row that starts with ``share`` of the switching cost spent, but not all of it."""
    out = running_total(usage, order_by, {"total": F.col(cost)})
    before = F.round(F.col("total") - F.coalesce(cost, F.lit(0.0)), 6)
    warned = out.withColumn("cost_before", before).where((F.col("cost_before") >= share * switch_at) & (F.col("cost_before") < switch_at))
    first = warned.agg(F.min(F.struct(*order_by, "cost_before")).alias("x")).where("x IS NOT NULL").select("x.*")
    return first.withColumns({"remaining": F.round(F.lit(float(switch_at)) - F.col("cost_before"), 6), "percent": F.round(F.col("cost_before") / switch_at * 100, 6)})


def progress(done: DataFrame, order_by: list[str], at: str, every: int = 10, seconds: float = 30) -> DataFrame:
    """Rows at which progress is reported: each ``every``-th, and the first after ``seconds`` without a step of that clock."""
    out = running_total(done.withColumn("__one", F.lit(1)), order_by, {"done": F.col("__one")}).drop("__one")
    tick = F.floor(F.col(at).cast("timestamp").cast("double") / seconds).cast("long")
    firsts = out.groupBy(tick.alias("tick")).agg(F.min("done").alias("first"))
    return out.withColumn("tick", tick).join(firsts, "tick").where((F.pmod(F.col("done").cast("long"), F.lit(every)) == 0) | (F.col("done") == F.col("first"))).select(*order_by, F.col("done").cast("long").alias("done"))
