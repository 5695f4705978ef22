"""Streaming forms of the batch operators: the same column expressions over unbounded input.

Every query reads a folder as it fills (``availableNow`` drains what is there).  Event time is UTC; ``ts`` columns without a
zone are cast before watermarking.  Results and state go to the shared folder, never through the driver.  What a stateful
operator holds at once is one key's rows of one trigger, so ``files`` (read per trigger) bounds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.rounds import latest_per_key
from tidemark.sources.shared import scratch

#: The most rows of a static side that is broadcast to a stream.
BROADCAST_ROWS = 100_000


class Progress(StreamingQueryListener):
    """Calls ``report(name, batch, rows)`` after every micro-batch; add it to ``spark.streams``."""

    def __init__(self, report: Callable[[str, int, int], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.report(p.name, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def source(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(path)


def drain(stream: DataFrame, name: str, keys: list[str] | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what there is and return its result as a table in the shared folder.

    Without ``keys`` rows are appended.  With them a row replaces the one of its keys that an earlier batch gave (update
    mode): batches are stored beside each other, so that a repeated batch overwrites itself, and the last row of each key is read.
    """
    spark = stream.sparkSession
    path = scratch(spark, name)
    w = stream.writeStream.queryName(name).trigger(availableNow=True).option("checkpointLocation", checkpoint or scratch(spark, f"{name}-state"))
    if keys is None:
        w = w.outputMode("append").format("parquet").option("path", path)
    else:
        w = w.outputMode("update").foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/_batch={batch}"))
    conf, key = spark.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")  # a query with timers would otherwise run batches without data for ever
    try:
        w.start().awaitTermination()
    finally:
        conf.set(key, before)
    if keys is None:
        return spark.read.schema(stream.schema).parquet(path)
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", LongType())])).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    packed = out.select(F.struct(*keys).alias("k"), "_batch", F.struct(*rest).alias("v"))
    return latest_per_key(packed, "k", ["_batch"]).select("k.*", "v.*")


def tumbling_moments(events: DataFrame, ts: str, value: str, window: str, late: str, *keys: str) -> DataFrame:
    """keys, window, n, mean, var of each tumbling window; rows later than ``late`` are dropped."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    x = F.col(value)
    out = e.groupBy(F.window(ts, window), *keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(0.0)).alias("var"))
    return out.select(*keys, F.col("window.start").alias("start"), "n", "mean", "var")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n of runs without a silence of ``gap``: the watchdog's notion of a live client."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = e.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def nearest_state(batches: DataFrame, bank: DataFrame) -> DataFrame:
    """Stream rows (key, seq, values) joined with a static bank (label, mean, var): scalar symmetric divergence to each entry."""
    from tidemark.functions.scalar import symmetric_kl_term

    if bank.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"a bank of over {BROADCAST_ROWS} rows is not for a stream's broadcast")
    d = symmetric_kl_term(F.col("mean"), F.col("var"), F.col("bank_mean"), F.col("bank_var"))
    return batches.crossJoin(F.broadcast(bank)).withColumn("distance", d)


def lagged_router(batches: DataFrame, bank: list[tuple[str, list[float], list[float]]], threshold: float, digits: int | None = None) -> DataFrame:
    """arm, seq, chosen, distance, fallback, state_loaded: each batch is routed by the descriptor of the one before it.

    ``digits``: distances are rounded before they are compared, as those that the threshold was taken from; ties go to the first entry.
    State per arm: the previous descriptor and what is loaded.  A batch is (arm, seq, mean array, var array); within a trigger
    rows are put in order of seq.  Null chosen and no fallback: the arm's first batch.
    """
    labels = [b[0] for b in bank]
    means, variances = np.array([b[1] for b in bank]), np.maximum(np.array([b[2] for b in bank]), 1e-8)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, var, loaded = state.get if state.exists else (None, None, None)
        rows = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            chosen, distance, fallback, load = None, None, False, False
            if mean is not None:
                m, v = np.array(mean), np.maximum(np.array(var), 1e-8)
                d = ((v + (m - means) ** 2) / (2 * variances) + (variances + (m - means) ** 2) / (2 * v) - 1).sum(1)
                d = d if digits is None else np.round(d, digits)
                k = int(np.argmin(d))
                distance, fallback = float(d[k]), bool(d[k] > threshold)
                chosen = None if fallback else labels[k]
            if chosen is not None and chosen != loaded:
                load, loaded = True, chosen
            elif fallback:
                loaded = None
            mean, var = list(map(float, r.mean)), list(map(float, r.var))
            rows.append((key[0], int(r.seq), chosen, distance, fallback, load))
        state.update((mean, var, loaded))
        yield pd.DataFrame(rows, columns=["arm", "seq", "chosen", "distance", "fallback", "state_loaded"])

    return batches.groupBy("arm").applyInPandasWithState(
        run, "arm string, seq long, chosen string, distance double, fallback boolean, state_loaded boolean",
        "mean array<double>, var array<double>, loaded string", "append", GroupStateTimeout.NoTimeout,
    )


def round_barrier(updates: DataFrame, need: int) -> DataFrame:
    """round, n, train_size, train_loss: one row once ``need`` different clients have reported for a round.

    State per round: each client's last report before the round closed; a repeated report replaces its own, a late one is dropped.
    Serves training rounds and evaluation alike (evaluations are keyed by their round too).
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clients, sizes, losses, closed = state.get if state.exists else ([], [], [], False)
        seen = {c: (s, x) for c, s, x in zip(clients, sizes, losses, strict=True)}
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "client"], kind="stable").itertuples(index=False):
            if closed:
                continue
            seen[r.client] = (int(r.train_size), float(r.train_loss))
            if len(seen) >= need:
                n = sum(s for s, _ in seen.values())
                out.append((int(key[0]), len(seen), n, sum(s * x for s, x in seen.values()) / n if n else None))
                closed = True
        state.update((list(seen), [s for s, _ in seen.values()], [x for _, x in seen.values()], closed))
        yield pd.DataFrame(out, columns=["round", "n", "train_size", "train_loss"])

    return updates.groupBy("round").applyInPandasWithState(
        run, "round long, n long, train_size long, train_loss double", "clients array<string>, sizes array<long>, losses array<double>, closed boolean",
        "append", GroupStateTimeout.NoTimeout,
    )


def watchdog(events: DataFrame, key: str, timeout_ms: int) -> DataFrame:
    """key, seen, silent: a key's count when it has been silent for the timeout (processing time), or still alive."""
    kind = events.schema[key].dataType.simpleString()

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "seen": [n], "silent": [True]})
            return
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({key: [k[0]], "seen": [n], "silent": [False]})

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, seen long, silent boolean", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout)
