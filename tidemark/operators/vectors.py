"""Weighted aggregation of parameter vectors.

Vectors rest as arrays and are summed in long form (key, pos, x): the sum over clients is an ordinary aggregate with
map-side partials, keyed by position, so its shuffle is one partial row per task and position however many
clients there are.  Everything accumulates in double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """keys, pos, x."""
    return rows.select(*keys, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def weighted_sum(rows: DataFrame, vector: str, weight: Column, *keys: str) -> DataFrame:
    """keys, pos, x: sum over rows of weight * vector. Positions stay apart from keys, so a hot key is many groups."""
    long = rows.select(*keys, weight.cast("double").alias("_w"), F.posexplode(vector).alias("pos", "x"))
    return long.groupBy(*keys, "pos").agg(F.sum(F.col("_w") * F.col("x").cast("double")).alias("x"))


def average(rows: DataFrame, vector: str, weight: Column, *keys: str) -> DataFrame:
    """Size-weighted mean: keys, pos, x; no row where the weights add up to 0."""
    long = rows.select(*keys, weight.cast("double").alias("_w"), F.posexplode(vector).alias("pos", "x"))
    out = long.groupBy(*keys, "pos").agg(F.sum(F.col("_w") * F.col("x").cast("double")).alias("s"), F.sum("_w").alias("w"))
    return out.where("w > 0").select(*keys, "pos", (F.col("s") / F.col("w")).alias("x"))


def pack(long: DataFrame, *keys: str) -> DataFrame:
    """keys, vector: long form back to arrays in order of position."""
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))


def aggregate_with(updates: DataFrame, weights: DataFrame, vector: str) -> DataFrame:
    """pos, x: sum of weight * vector over the clients of ``weights`` (client, weight), which is the small side."""
    return weighted_sum(updates.join(weights.select("client", "weight"), "client"), vector, F.col("weight"))


def with_skew(updates: DataFrame, skew: DataFrame) -> DataFrame:
    """Updates with their client's d_k; a client without statistics counts as unskewed."""
    return updates.join(skew.select("client", "d_k"), "client", "left").withColumn("d_k", F.coalesce("d_k", F.lit(0.0)))


def delta(local: DataFrame, reference: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, x: local minus reference, by position."""
    ref = reference.select("pos", F.col("x").alias("_r"))
    return local.join(ref, "pos").select(*keys, "pos", (F.col("x") - F.col("_r")).alias("x"))


def proximal_term(local: DataFrame, reference: DataFrame, mu: float, *keys: str) -> DataFrame:
    """keys, penalty: mu / 2 times the sum over layers of the plain (not squared) norm of the difference.

    Both sides are (layer, pos, x); the missing square is how the rule is defined here.
    """
    both = local.join(reference.select("layer", "pos", F.col("x").alias("_r")), ["layer", "pos"])
    per = both.groupBy(*keys, "layer").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("_r"), F.lit(2.0)))).alias("norm"))
    return per.groupBy(*keys).agg((F.sum("norm") * F.lit(mu / 2)).alias("penalty"))


def flatten_layers(layers: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, x from (layer, size, pos, x): positions run on from layer to layer."""
    sizes = layers.select("layer", "size").distinct()
    start = F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("layer", start.alias("start"))
    return layers.join(offsets, "layer").select(*keys, (F.col("start") + F.col("pos")).alias("pos"), "x")


def unflatten(flat: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """keys, layer, pos, x from a flat vector and (layer, size): the inverse of :func:`flatten_layers`."""
    end = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("layer").rowsBetween(Window.unboundedPreceding, 0))
    spans = sizes.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    at = F.sequence(F.col("start"), F.col("end") - 1)
    places = spans.where("size > 0").select("layer", "start", F.explode(at).alias("flat"))
    both = flat.withColumnRenamed("pos", "flat").join(places, "flat", "full_outer")
    lone = F.col("layer").isNull() | F.col("x").isNull()
    x = F.when(lone, F.raise_error(F.lit("the vector does not fill the layers")).cast("double")).otherwise(F.col("x"))
    return both.select(*keys, "layer", (F.col("flat") - F.col("start")).alias("pos"), x.alias("x"))


def parameter_counts(params: DataFrame, trainable: str | None = None) -> DataFrame:
    """One row: layers, parameters, from (layer, values); with a boolean column ``trainable`` those that training moves as well."""
    n = F.size("values")
    moved = [F.sum(F.when(F.col(trainable), n).otherwise(0)).cast("long").alias("trainable")] if trainable else []
    return params.agg(F.count("*").alias("layers"), F.sum(n).cast("long").alias("parameters"), *moved)
