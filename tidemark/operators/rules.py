"""Aggregation rules by name, and the round loop that joins local steps, aggregation, evaluation and early stop.

A model is a softmax regression of ``classes`` x width parameters.  It is sent to the tasks whole, as a round's model is to its
clients, so its size is bounded (``MOST_PARAMETERS``); gradients are summed map-side per batch and client and never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import ALGORITHMS

from . import fipa, skew, vectors

#: The most parameters of a model that is sent to the tasks.
MOST_PARAMETERS = 10_000_000


def _by_size(updates: DataFrame, context: dict) -> DataFrame:
    return vectors.average(updates, "vector", F.col("n"))


def _by_skew(updates: DataFrame, context: dict) -> DataFrame:
    d = vectors.with_skew(updates.select("client", "n"), skew.client_skew(context["counts"]))
    weights = skew.feddisco_weights(d, context.get("feddisco_a", 0.5), context.get("feddisco_b", 0.1))
    return vectors.aggregate_with(updates, weights, "vector")


def _by_curvature(updates: DataFrame, context: dict) -> DataFrame:
    """Updates hold what a client moved by, and its factors come from the gradients of its batches."""
    factors = fipa.top_factors(context["gradients"], context.get("fipa_rank", 5))
    moved = updates.select("client", F.col("n").cast("double").alias("n"), F.zip_with("vector", context["sent"], lambda a, b: a - b).alias("delta"))
    return fipa.server_round(context["model"], moved.join(factors, "client"), context.get("fipa_pinv_rtol", 1e-8))


#: Rule -> (updates (client, n, vector), context) -> model (pos, x). Add one here to make it known by name.
RULES: dict[str, Callable[[DataFrame, dict], DataFrame]] = {"FedAvg": _by_size, "FedProx": _by_size, "FedLC": _by_size, "FedDisco": _by_skew, "FIPA": _by_curvature}
assert tuple(RULES) == ALGORITHMS


def aggregate(rule: str, updates: DataFrame, context: dict | None = None) -> DataFrame:
    """pos, x: the next model under the named rule; an unknown name is an error, never plain averaging."""
    if rule not in RULES:
        raise ValueError(f"unknown aggregation rule {rule!r}")
    return RULES[rule](updates, context or {})


def effective_rule(rule: str, number: int, warmup: int) -> str:
    """Preconditioned rounds run as plain averaging until their warm-up is over."""
    if warmup < 0:
        raise ValueError("negative warm-up")
    if rule not in RULES:
        raise ValueError(f"unknown aggregation rule {rule!r}")
    return "FedAvg" if rule == "FIPA" and number < warmup else rule


def initial_weights(spark, classes: int, width: int, scale: float = 0.0) -> DataFrame:
    """pos, x of the model before any round: zeros, or a fixed pattern of numbers within ``scale``."""
    return spark.range(classes * width).select(F.col("id").cast("int").alias("pos"), (((F.col("id") * 7919) % 2001 - 1000) / 1000.0 * scale).alias("x"))


def _softmax(x: np.ndarray, theta: np.ndarray, shift: np.ndarray) -> np.ndarray:
    z = x @ theta.T + shift
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def local_gradients(rows: DataFrame, theta: np.ndarray, shift: DataFrame | np.ndarray | None = None, batch: str | None = None) -> DataFrame:
    """client (, batch), n, loss, g: sums over rows (client, label, vector) of the loss and its gradient at ``theta`` (classes x width).

    ``shift``: what a rule adds to each class's logit.
    """
    sent = rows.sparkSession.sparkContext.broadcast(theta)
    shift = np.zeros(len(theta)) if shift is None else shift
    keys = ["client", *([batch] if batch else [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        theta = sent.value
        for f in frames:
            out = []
            for key, part in f.groupby(keys, sort=True):
                x = np.vstack(part["vector"].to_numpy()).astype(float)
                y = part["label"].to_numpy().astype(int)
                p = _softmax(x, theta, shift)
                loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
                p[np.arange(len(y)), y] -= 1
                out.append((*key, len(y), loss, (p.T @ x).ravel().tolist()))
            yield pd.DataFrame(out, columns=[*keys, "n", "loss", "g"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "label", "vector").mapInPandas(run, f"{kinds}, n long, loss double, g array<double>")


def local_updates(rows: DataFrame, theta: np.ndarray, rate: float, shift: np.ndarray | None = None) -> DataFrame:
    """client, n, train_loss, vector: each client's model after one gradient step from ``theta``."""
    parts = local_gradients(rows, theta, shift)
    facts = parts.groupBy("client").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    g = vectors.pack(vectors.weighted_sum(parts, "g", F.lit(1), "client"), "client").withColumnRenamed("vector", "g")
    flat = F.array(*map(F.lit, theta.ravel().tolist())) if theta.size <= 4096 else None
    joined = facts.join(g, "client")
    if flat is None:
        flat = F.col("theta")
        one = rows.sparkSession.createDataFrame([(theta.ravel().tolist(),)], "theta array<double>")
        joined = joined.crossJoin(F.broadcast(one))
    vector = F.zip_with(flat, "g", lambda a, b: a - F.lit(rate) * b / F.col("n"))
    return joined.select("client", "n", (F.col("loss") / F.col("n")).alias("train_loss"), vector.alias("vector"))


def evaluated(rows: DataFrame, theta: np.ndarray) -> DataFrame:
    """y_true, y_pred of rows (label, vector) under the model; equal logits go to the first class."""
    sent = rows.sparkSession.sparkContext.broadcast(theta)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.vstack(f["vector"].to_numpy()).astype(float) if len(f) else np.empty((0, sent.value.shape[1]))
            yield pd.DataFrame({"y_true": f["label"].astype("int32"), "y_pred": (x @ sent.value.T).argmax(1).astype("int32")})

    return rows.select("label", "vector").mapInPandas(run, "y_true int, y_pred int")


@dataclass
class Training:
    """What a run leaves: one dict a round, the best model by macro F1, and the round that stopped it early, if any."""

    history: list[dict] = field(default_factory=list)
    best: np.ndarray | None = None
    best_round: int | None = None
    stopped: int | None = None

    def table(self, spark) -> DataFrame:
        names = ("round", "rule", "train_loss", "test_acc", "test_f1")
        return spark.createDataFrame([tuple(h[n] for n in names) for h in self.history], "round long, rule string, train_loss double, test_acc double, test_f1 double")


def run_rounds(rows: DataFrame, test: DataFrame, classes: int, config: dict, progress: Callable[[dict], None] | None = None) -> Training:
    """Train on rows (client, label, vector) by the configuration's rule: each round every client steps, the rule aggregates, ``test`` is scored.

    Stops after ``rounds``, or once the training loss has risen ``patience`` rounds in a row.
    """
    from .metrics import classification

    spark, rule = rows.sparkSession, config.get("aggregation_algorithm", "FedAvg")
    effective_rule(rule, 0, int(config.get("fipa_warmup_rounds", 0)))
    width = rows.select(F.max(F.size("vector"))).first()[0]
    if not width:
        raise ValueError("there is nothing to train on")
    if classes * width > MOST_PARAMETERS:
        raise ValueError(f"a model of over {MOST_PARAMETERS} parameters is not sent to tasks")
    counts = skew.class_counts(rows, "client", "label")
    theta = np.zeros((classes, width))
    for r in initial_weights(spark, classes, width, float(config.get("initial_scale", 0.0))).collect():
        theta[r["pos"] // width, r["pos"] % width] = r["x"]
    shift = None
    if rule == "FedLC":
        shift = np.zeros(classes)
        for r in skew.calibration(counts).collect():  # one row a class
            shift[int(r["class"])] = -r["tau"]
    out, best, worse, before = Training(), 0.0, 0, math.inf
    for number in range(int(config.get("rounds", 1))):
        now = effective_rule(rule, number, int(config.get("fipa_warmup_rounds", 0)))
        updates = local_updates(rows, theta, float(config.get("learning_rate", 0.1)), shift).persist()
        context = {k: v for k, v in config.items() if k.startswith(("feddisco_", "fipa_"))} | {"counts": counts}
        if now == "FIPA":
            model = spark.createDataFrame([(i, float(x)) for i, x in enumerate(theta.ravel())], "pos int, x double")
            per_batch = local_gradients(rows.withColumn("row", F.pmod(F.xxhash64("vector"), F.lit(int(config.get("fipa_grad_batches", 8))))), theta, shift, "row")
            sums = vectors.pack(vectors.average(per_batch.withColumn("g", F.transform("g", lambda x: x / F.col("n"))), "g", F.col("n"), "client", "row"), "client", "row")
            context |= {"model": model, "sent": F.array(*map(F.lit, theta.ravel().tolist())), "gradients": sums.withColumnRenamed("vector", "g")}
        total = updates.agg((F.sum(F.col("train_loss") * F.col("n")) / F.sum("n")).alias("l")).first()["l"]
        for r in aggregate(now, updates, context).collect():  # the model: MOST_PARAMETERS at most
            theta[r["pos"] // width, r["pos"] % width] = r["x"]
        updates.unpersist()
        scores = classification(evaluated(test, theta)).first()
        entry = {"round": number, "rule": now, "train_loss": total, "test_acc": scores["accuracy"], "test_f1": scores["macro_f1"]}
        out.history.append(entry)
        if progress:
            progress(entry)
        if entry["test_f1"] > best:
            best, out.best, out.best_round = entry["test_f1"], theta.copy(), number
        worse, before = (worse + 1 if total > before else 0), total
        if worse >= int(config.get("patience", 1 << 30)):
            out.stopped = number
            break
    return out
