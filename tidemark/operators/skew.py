"""Label skew of clients and the aggregation weights that follow from it.

Input throughout: long counts (client, class, n).  Only counts shuffle: rows are summed per client and class on the map side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import WEIGHT_SCALE


def class_counts(rows: DataFrame, client: str, label: str) -> DataFrame:
    """client, class, n of the pairs that occur."""
    return rows.where(F.col(client).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(client).alias("client"), F.col(label).alias("class")).agg(F.count("*").alias("n"))


def dense_counts(counts: DataFrame) -> DataFrame:
    """Every client with every class, zeros included; the class list (never more rows than classes) is crossed in."""
    cells = counts.select("client").distinct().crossJoin(counts.select("class").distinct())
    return cells.join(counts, ["client", "class"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def client_skew(counts: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """client, n, d_k: distance of the client's class shares from uniform over the declared ``classes`` (class), or all that occur anywhere.

    Classes the client lacks add (1/C)^2 each, so no dense table is needed: sum over its own classes, plus the rest at once.
    """
    total = (counts if classes is None else classes).agg(F.countDistinct("class").alias("c"))
    own = counts.withColumn("all", F.sum("n").over(Window.partitionBy("client")))
    shares = own.crossJoin(F.broadcast(total)).groupBy("client", "c").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("all") > 0, F.pow(F.col("n") / F.col("all") - 1.0 / F.col("c"), F.lit(2.0))).otherwise(0.0)).alias("s"),
        F.count("*").alias("k"),
    )
    rest = (F.col("c") - F.col("k")) / (F.col("c") * F.col("c")).cast("double")
    return shares.select("client", "n", F.when(F.col("n") > 0, F.sqrt(F.col("s") + rest)).otherwise(0.0).alias("d_k"))


def feddisco_weights(skew: DataFrame, a: float = 0.5, b: float = 0.1) -> DataFrame:
    """Add ``size_share``, ``score`` and ``weight``: relu(share - a * d_k + b), normalised.

    No positive score: size shares.  No samples at all: uniform.
    """
    everything = Window.partitionBy(F.lit(0))
    total, clients = F.sum("n").over(everything), F.count("*").over(everything)
    out = skew.withColumn("size_share", F.when(total > 0, F.col("n") / total).otherwise(F.lit(1.0) / clients))
    out = out.withColumn("score", F.greatest(F.col("size_share") - F.lit(float(a)) * F.col("d_k") + F.lit(float(b)), F.lit(0.0)))
    scores = F.sum("score").over(everything)
    return out.withColumn("weight", F.when((scores > 0) & (total > 0), F.col("score") / scores).otherwise(F.col("size_share")))


def integer_weights(weights: DataFrame, scale: int = WEIGHT_SCALE) -> DataFrame:
    """Add ``int_weight``: half-even rounding on the scale, what is left over on the first largest weight."""
    rounded = weights.withColumn("raw", F.rint(F.col("weight") * float(scale)).cast("long"))
    everything = Window.partitionBy(F.lit(0))
    first = F.row_number().over(everything.orderBy(F.col("weight").desc(), F.col("client")))
    rounded = rounded.withColumn("left", F.lit(scale) - F.sum("raw").over(everything)).withColumn("rank", first)
    return rounded.withColumn("int_weight", F.col("raw") + F.when(F.col("rank") == 1, F.col("left")).otherwise(0)).drop("raw", "left", "rank")


def weight_diagnostics(weights: DataFrame) -> DataFrame:
    """One row: clients, the largest shift against size shares, and clients whose final weight is 0."""
    return weights.agg(
        F.count("*").alias("clients"),
        F.max(F.abs(F.col("weight") - F.col("size_share"))).alias("max_shift"),
        F.count_if(F.col("weight") == 0).alias("dropped"),
    )


def partition_report(rows: DataFrame, client: str, unit: str, label: str, classes: list) -> DataFrame:
    """client, n_units, n_images, n_classes_present, d_k (4 decimals), class_<c> counts."""
    base = rows.groupBy(F.col(client).alias("client")).agg(F.countDistinct(unit).alias("n_units"), F.count("*").alias("n_images"))
    wide = rows.groupBy(F.col(client).alias("client")).pivot(label, classes).count().na.fill(0)
    wide = wide.select("client", *[F.col(f"`{c}`").cast("long").alias(f"class_{c}") for c in classes])
    counts = class_counts(rows, client, label)
    skew = client_skew(counts).select("client", F.round("d_k", 4).alias("d_k"))
    present = counts.groupBy("client").agg(F.count_if(F.col("n") > 0).alias("n_classes_present"))
    return base.join(present, "client").join(skew, "client").join(wide, "client")


def calibration(counts: DataFrame) -> DataFrame:
    """class, total, tau: total over clients to the power -1/4, zero totals taken as 1."""
    per = counts.groupBy("class").agg(F.sum("n").alias("total"))
    return per.withColumn("tau", F.pow(F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("total").cast("double")), F.lit(-0.25)))
