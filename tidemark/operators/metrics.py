"""Classification metrics, intervals, latency, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import accuracy_interval, corruption_of, effective_sample_size, family_of, severity_of


def confusion(predictions: DataFrame, *keys: str) -> DataFrame:
    """keys, y_true, y_pred, n: the one pass over the rows; everything below reads this table."""
    return predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))


def per_class(cells: DataFrame, *keys: str) -> DataFrame:
    """keys, label, tp, support, predicted, precision, recall, f1 over the labels that occur as truth or prediction."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    truth = cells.select(*keys, F.col("y_true").alias("label"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted"))
    guess = cells.select(*keys, F.col("y_pred").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted"))
    out = truth.unionByName(guess).groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    return out.withColumns({"precision": share(tp, p), "recall": share(tp, s), "f1": share(2 * tp, s + p)})


def classification(predictions: DataFrame, *keys: str) -> DataFrame:
    """keys, n_images, correct, accuracy, macro_f1, weighted f1, precision and recall."""
    rows = per_class(confusion(predictions, *keys), *keys)
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return rows.groupBy(*keys).agg(
        F.sum("support").alias("n_images"), F.sum("tp").alias("correct"), (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"), weighted("f1").alias("weighted_f1"), weighted("precision").alias("weighted_precision"), weighted("recall").alias("weighted_recall"),
    )


def validation(predictions: DataFrame, splits: DataFrame) -> DataFrame:
    """client, test_size, mean loss and weighted metrics of predictions (client, y_true, y_pred, loss); zeros for a client of ``splits`` without any."""
    names = {"n_images": "test_size", "weighted_f1": "test_f1", "weighted_precision": "test_prec", "weighted_recall": "test_recall", "accuracy": "test_acc"}
    scores = classification(predictions, "client").select("client", *[F.col(a).alias(b) for a, b in names.items()])
    both = scores.join(predictions.groupBy("client").agg(F.avg("loss").alias("test_loss")), "client")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return splits.select("client").distinct().join(both, "client", "left").select("client", *[zero(c) for c in both.columns if c != "client"])


def latency(batches: DataFrame, *keys: str) -> DataFrame:
    """keys, num_batches, total_seconds, mean / median / p95 / first batch in ms, ms_per_image."""
    ms = lambda c: c * 1000.0
    return batches.groupBy(*keys).agg(
        F.count("*").alias("num_batches"), F.sum("seconds").alias("total_seconds"), ms(F.avg("seconds")).alias("mean_ms_per_batch"),
        ms(F.percentile("seconds", F.lit(0.5))).alias("median_ms_per_batch"), ms(F.percentile("seconds", F.lit(0.95))).alias("p95_ms_per_batch"),
        ms(F.min_by("seconds", "seq")).alias("first_batch_ms"), ms(F.sum("seconds") / F.sum("n_images")).alias("ms_per_image"),
    )


def family_summary(rows: DataFrame) -> DataFrame:
    """arm, family, num_conditions, n_images, correct, accuracy, macro_f1 weighted by images."""
    return rows.groupBy("arm", "family").agg(
        F.count("*").alias("num_conditions"), F.sum("n_images").alias("n_images"), F.sum("correct").alias("correct"),
        (F.sum("correct") / F.sum("n_images")).alias("accuracy"), (F.sum(F.col("macro_f1") * F.col("n_images")) / F.sum("n_images")).alias("macro_f1"),
    )


def arm_accuracy(rows: DataFrame) -> DataFrame:
    return rows.groupBy("arm").agg(F.sum("n_images").alias("n_images"), (F.sum("correct") / F.sum("n_images")).alias("accuracy"))


def arm_difference(rows: DataFrame, one: str, two: str, z: float = 1.959963984540054) -> DataFrame:
    """condition, difference, half_width, significant of two arms, on the track-corrected sample sizes."""
    a = rows.where(F.col("arm") == one).select("condition", F.col("accuracy").alias("p1"), F.col("n_images").alias("i1"))
    b = rows.where(F.col("arm") == two).select("condition", F.col("accuracy").alias("p2"), F.col("n_images").alias("i2"))
    n1, n2 = effective_sample_size(F.col("i1")), effective_sample_size(F.col("i2"))
    half = z * F.sqrt(F.col("p1") * (1 - F.col("p1")) / n1 + F.col("p2") * (1 - F.col("p2")) / n2)
    out = a.join(b, "condition").select("condition", (F.col("p1") - F.col("p2")).alias("difference"), half.alias("half_width"))
    return out.withColumn("significant", F.abs("difference") > F.col("half_width"))


def with_retention(rows: DataFrame, clean: str = "clean") -> DataFrame:
    """Add ``retention``: accuracy over the same arm's clean accuracy; null where the arm has none or it is 0."""
    base = rows.where(F.col("condition") == clean).select("arm", F.col("accuracy").alias("_clean"))
    return rows.join(F.broadcast(base), "arm", "left").withColumn("retention", F.when(F.col("_clean") > 0, F.col("accuracy") / F.col("_clean"))).drop("_clean")


def condition_table(predictions: DataFrame, batches: DataFrame, routing: DataFrame, bank_labels: list[str]) -> DataFrame:
    """arm x condition fact rows: metrics, interval, family, seen, retention, routing rates, latency."""
    rows = classification(predictions, "arm", "condition").drop("weighted_precision", "weighted_recall")
    low, high = accuracy_interval(F.col("accuracy"), F.col("n_images"))
    rows = rows.withColumns({"accuracy_low": low, "accuracy_high": high, "effective_n": effective_sample_size(F.col("n_images"))})
    name = corruption_of(F.col("condition"))
    rows = rows.withColumns({"corruption": name, "severity": severity_of(F.col("condition")), "family": family_of(name), "seen": name.isin(*bank_labels)})
    speed = latency(batches, "arm", "condition").select("arm", "condition", "ms_per_image", "num_batches")
    rates = routing.select("arm", "condition", "fallback_rate", "hit_rate")
    return with_retention(rows).join(speed, ["arm", "condition"], "left").join(rates, ["arm", "condition"], "left")
