"""Round bookkeeping: rollups, best round, early stop, payload scale, late and repeated messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import client_denominator, effective_algorithm

METRICS = ("test_loss", "test_f1", "test_acc", "test_prec", "test_recall")


def train_loss(updates: DataFrame) -> DataFrame:
    """round, train_loss (size-weighted), train_loss_mean; rounds without samples give no row."""
    out = updates.groupBy("round").agg(F.sum(F.col("train_loss") * F.col("train_size")).alias("s"), F.sum("train_size").alias("n"), F.avg("train_loss").alias("train_loss_mean"))
    return out.where("n > 0").select("round", (F.col("s") / F.col("n")).alias("train_loss"), "train_loss_mean")


def eval_rollup(evals: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """round, test_size and each metric weighted by test_size."""
    sums = [F.sum(F.col(m) * F.col("test_size")).alias(m) for m in metrics]
    out = evals.groupBy("round").agg(F.sum("test_size").alias("test_size"), *sums)
    return out.select("round", "test_size", *[F.when(F.col("test_size") > 0, F.col(m) / F.col("test_size")).alias(m) for m in metrics])


def best_round(history: DataFrame, metric: str = "test_f1") -> DataFrame:
    """The row of the earliest greatest metric; none if it never rises over 0. One aggregate, no sort."""
    names = history.columns
    best = history.where(F.col(metric) > 0).agg(F.max_by(F.struct(*names), F.struct(F.col(metric), -F.col("round"))).alias("b"))
    return best.where("b is not null").select("b.*")


def running_best(history: DataFrame, metric: str = "test_f1") -> DataFrame:
    """Add ``best_so_far``. One row a round: the ordered window runs over rounds, not over data."""
    w = Window.partitionBy(F.lit(0)).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best_so_far", F.max(metric).over(w))


def early_stop(history: DataFrame, loss: str, patience: int) -> DataFrame:
    """Add ``worse`` (rounds in a row, this one included, whose loss rose) and ``stop`` (the first to reach the patience)."""
    order = Window.partitionBy(F.lit(0)).orderBy("round")
    rose = history.withColumn("_rose", F.coalesce(F.col(loss) > F.lag(loss).over(order), F.lit(False)))
    runs = rose.withColumn("_run", F.sum(F.when(F.col("_rose"), 0).otherwise(1)).over(order))
    counted = runs.withColumn("worse", F.sum(F.when(F.col("_rose"), 1).otherwise(0)).over(Window.partitionBy("_run").orderBy("round")).cast("long"))
    hit = F.sum(F.when(F.col("worse") >= patience, 1).otherwise(0)).over(order)
    return counted.withColumn("stop", (F.col("worse") >= patience) & (hit == 1)).drop("_rose", "_run")


def open_rounds(rounds: DataFrame, warmup: int, encrypted: bool) -> DataFrame:
    """Add the rule of each round and the denominator that undoes the *previous* round's payload (round 0: 0, pass through).

    ``rounds``: round, algorithm, total.  ``snapshot``: the rule needs the model as it was before the round.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("round")
    rule = effective_algorithm(F.col("algorithm"), F.col("round"), F.lit(warmup))
    out = rounds.withColumn("rule", rule)
    before = client_denominator(F.lag("rule").over(order), F.lag("total").over(order), F.lit(encrypted))
    out = out.withColumn("denominator", F.when(F.lag("rule").over(order).isNull(), F.lit(0.0)).otherwise(before))
    return out.withColumn("snapshot", (F.col("rule") == "FIPA") & F.lit(not encrypted))


def drop_late(updates: DataFrame, current: str = "current_round") -> DataFrame:
    """Updates for the round that is open; all others are late and dropped."""
    return updates.where(F.col("round") == F.col(current))


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key (upsert): an aggregate over structs with map-side partials, no window, no sort."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    last = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("s"))
    return last.select(key, *[F.col(f"s.{c}").alias(c) for c in [*order, *rest]])


def joined_history(train: DataFrame, evals: DataFrame) -> DataFrame:
    """Both halves of a round; a round with one half only keeps nulls for the other."""
    return train.join(evals, "round", "full_outer")
