"""Per-channel moments as mergeable partials, and comparisons of the states made from them.

A state is long: (label, ch, mean, var), or with ``layer`` beside ``ch``.  Variances are population variances.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def partials(long: DataFrame, *keys: str) -> DataFrame:
    """keys, n, s1, s2 of x: sums that add up over any split of the rows."""
    return long.groupBy(*keys).agg(F.count("x").alias("n"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"))


def merge(parts: DataFrame, *keys: str) -> DataFrame:
    """Partials of coarser keys."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))


def finish(parts: DataFrame) -> DataFrame:
    """Partials to n, mean, var (never under 0)."""
    mean = F.col("s1") / F.col("n")
    out = parts.where("n > 0").withColumn("mean", mean)
    return out.withColumn("var", F.greatest(F.col("s2") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0))).drop("s1", "s2")


def channel_moments(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """keys, ch, n, mean, var of the vector's channels."""
    long = rows.select(*keys, F.posexplode(vector).alias("ch", "x")).withColumn("x", F.col("x").cast("double"))
    return finish(partials(long, *keys, "ch"))


def federated_moments(states: DataFrame, weight: str = "n") -> DataFrame:
    """ch, mean, var over clients: weighted means, and the spread of the means added to the variances."""
    w = F.col(weight)
    out = states.groupBy("ch").agg(
        F.sum(w).alias("w"), F.sum(w * F.col("mean")).alias("m"), F.sum(w * (F.col("var") + F.col("mean") * F.col("mean"))).alias("q")
    ).where("w > 0")
    mean = F.col("m") / F.col("w")
    return out.select("ch", mean.alias("mean"), F.greatest(F.col("q") / F.col("w") - mean * mean, F.lit(0.0)).alias("var"))


def self_check(rows: DataFrame, vector: str, batch: str, tolerance: float = 1e-6) -> DataFrame:
    """ch, agree: moments merged from batches against moments at once."""
    long = rows.select(batch, F.posexplode(vector).alias("ch", "x")).withColumn("x", F.col("x").cast("double"))
    steps = finish(merge(partials(long, batch, "ch"), "ch")).select("ch", F.col("mean").alias("m1"), F.col("var").alias("v1"))
    once = long.groupBy("ch").agg(F.avg("x").alias("m2"), F.var_pop("x").alias("v2"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance * (1 + F.abs(F.col(b)))
    return steps.join(once, "ch").select("ch", (near("m1", "m2") & near("v1", "v2")).alias("agree"))


def scale(bank: DataFrame, floor: float = 1e-8) -> DataFrame:
    """ch, mean_scale, var_scale: population spread over the bank's entries, floored."""
    return bank.groupBy("ch").agg(
        F.greatest(F.stddev_pop("mean"), F.lit(floor)).alias("mean_scale"), F.greatest(F.stddev_pop("var"), F.lit(floor)).alias("var_scale")
    )


def _matched(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Both states side by side; a key that only one has is an error, raised where it is found."""
    a = one.select(*keys, F.col("mean").alias("m1"), F.col("var").alias("v1"))
    b = two.select(*keys, F.col("mean").alias("m2"), F.col("var").alias("v2"))
    both = a.join(b, keys, "full_outer")
    lone = F.col("m1").isNull() | F.col("m2").isNull()
    return both.withColumn("m1", F.when(lone, F.raise_error(F.lit("the states differ in their channels")).cast("double")).otherwise(F.col("m1")))


def residual(one: DataFrame, two: DataFrame, layer: str = "layer", ch: str = "ch", floor: float = 1e-8) -> DataFrame:
    """One row: worst mean shift in standard deviations and worst variance ratio minus 1, each with its layer."""
    both = _matched(one, two, [layer, ch])
    sd = F.sqrt(F.greatest(F.col("v2"), F.lit(floor)))
    low, high = F.greatest(F.least("v1", "v2"), F.lit(floor)), F.greatest("v1", "v2", F.lit(floor))
    both = both.withColumn("shift", F.abs(F.col("m1") - F.col("m2")) / sd).withColumn("ratio", high / low - 1)
    return both.agg(
        F.max("shift").alias("mean_shift"), F.max_by(layer, F.struct(F.col("shift"), -F.col(ch))).alias("mean_layer"),
        F.max("ratio").alias("var_ratio"), F.max_by(layer, F.struct(F.col("ratio"), -F.col(ch))).alias("var_layer"),
    )


def blend(chosen: DataFrame, source: DataFrame, alpha: float, keys: list[str]) -> DataFrame:
    """keys, mean, var: alpha of the chosen state, the rest of the source."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    mix = lambda a, b: alpha * F.col(a) + (1 - alpha) * F.col(b)
    return _matched(chosen, source, keys).select(*keys, mix("m1", "m2").alias("mean"), mix("v1", "v2").alias("var"))


def restrict(state: DataFrame, layers: list[str]) -> DataFrame:
    """The named layers of a state; a missing one is an error."""
    have = {r[0] for r in state.where(F.col("layer").isin(layers)).select("layer").distinct().collect()}
    if missing := set(layers) - have:
        raise ValueError(f"layers not in the state: {sorted(missing)}")
    return state.where(F.col("layer").isin(layers))


def descriptor(state: DataFrame, order: list[str]) -> DataFrame:
    """ch, mean, var: layers strung together in the order given; ch runs on from layer to layer."""
    places = state.sparkSession.createDataFrame(list(enumerate(order)), "ord int, layer string")
    sizes = state.groupBy("layer").agg((F.max("ch") + 1).alias("size")).join(F.broadcast(places), "layer")
    start = F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return state.join(F.broadcast(sizes.select("layer", start.alias("start"))), "layer").select((F.col("start") + F.col("ch")).alias("ch"), "mean", "var")


def order_conflicts(adapted: DataFrame, used: DataFrame) -> DataFrame:
    """Pairs (adapted layer, descriptor layer) where the adapted one comes first: must be empty for independence."""
    a = adapted.select(F.col("layer").alias("adapted"), F.col("ord").alias("a"))
    d = used.select(F.col("layer").alias("used"), F.col("ord").alias("d"))
    return a.join(F.broadcast(d), F.col("a") < F.col("d")).select("adapted", "used")


#: How a state may be measured.
METHODS = ("as-is", "batch-stats", "sequential")


def collect_states(
    rows: DataFrame, layers: list[str], method: str = "as-is", vector: str = "x", stored: DataFrame | None = None, batch: str = "batch",
    only: list[str] | None = None, max_batches: int | None = None, eps: float = 1e-5, progress: Callable[[int, int, str], None] | None = None,
) -> DataFrame:
    """layer, ch, mean, var: what each layer's input looks like.

    The model is a chain of element-wise layers: layer k sees its input standardised and put through tanh.  By ``as-is`` the layers
    before it normalise with their ``stored`` state (layer, ch, mean, var); by ``batch-stats`` with each batch's own moments; by
    ``sequential`` with the state just measured, which is the one fixed point.  One aggregate per layer, in order; layers
    after the last of ``only`` are never reached.  ``max_batches``: batches numbered below it, the same ones for every layer.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if unknown := set(only or ()) - set(layers):
        raise ValueError(f"not layers of this model: {sorted(unknown)}")
    if method == "as-is" and stored is None:
        raise ValueError("as-is needs the states that the layers carry")
    wanted = only or layers
    if max_batches is not None:
        rows = rows.where(F.col(batch) < max_batches)
    keys = [batch] if method == "batch-stats" else []
    out, data = None, rows.select(*keys, F.posexplode(vector).alias("ch", "x")).withColumn("x", F.col("x").cast("double"))
    for k, name in enumerate(layers[: max(map(layers.index, wanted)) + 1]):
        state = finish(partials(data, "ch")).select(F.lit(name).alias("layer"), "ch", "mean", "var")
        if name in wanted:
            out = state if out is None else out.unionByName(state)
        if progress:
            progress(k + 1, len(layers), name)
        if method == "as-is":
            by = stored.where(F.col("layer") == name).select("ch", "mean", "var")
        else:
            by = finish(partials(data, *keys, "ch")).select(*keys, "ch", "mean", "var")
        by = by if keys else F.broadcast(by)  # one row a channel
        data = data.join(by, [*keys, "ch"]).select(*keys, "ch", F.tanh((F.col("x") - F.col("mean")) / F.sqrt(F.col("var") + eps)).alias("x"))
    return out


def sequential_states(rows: DataFrame, layers: list[str], vector: str = "x", eps: float = 1e-5) -> DataFrame:
    """layer, ch, mean, var: each layer's moments once all layers before it normalise by theirs."""
    return collect_states(rows, layers, "sequential", vector, eps=eps)


def load_state(current: DataFrame, new: DataFrame) -> DataFrame:
    """The states that layers carry (layer, ch, mean, var) with those of ``new`` in their place; a layer or channel that the model lacks is an error."""
    both = current.select("layer", "ch", F.col("mean").alias("m1"), F.col("var").alias("v1"), F.lit(True).alias("has"))
    both = both.join(new.select("layer", "ch", F.col("mean").alias("m2"), F.col("var").alias("v2")), ["layer", "ch"], "full_outer")
    mean = F.when(F.col("has").isNull(), F.raise_error(F.lit("the model has no such layer or channel")).cast("double")).otherwise(F.coalesce("m2", "m1"))
    return both.select("layer", "ch", mean.alias("mean"), F.coalesce("v2", "v1").alias("var"))


def normalise(rows: DataFrame, state: DataFrame, vector: str = "x", eps: float = 1e-5, *keys: str) -> DataFrame:
    """keys, ch, x standardised by a stored state, or by the batch's own moments if that is what ``state`` holds."""
    long = rows.select(*keys, F.posexplode(vector).alias("ch", "x")).withColumn("x", F.col("x").cast("double"))
    on = [c for c in (*keys, "ch") if c in state.columns]
    return long.join(state, on).select(*keys, "ch", ((F.col("x") - F.col("mean")) / F.sqrt(F.col("var") + eps)).alias("x"))
