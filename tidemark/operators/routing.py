"""Nearest-state routing with refusal, and its scorecards.

The bank (a few dozen states) is the broadcast side: batches stream past it, each batch x state distance is one grouped sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import symmetric_kl_term

from . import moments

#: The most rows (entries times channels) of a bank that is broadcast; a larger one is joined by shuffle on ``ch``.
BROADCAST_ROWS = 2_000_000


def _sum_kl(floor: float) -> Column:
    return F.sum(symmetric_kl_term(F.col("m"), F.col("v"), F.col("bm"), F.col("bv"), floor))


def _l2(floor: float) -> Column:
    m, v = (F.col("m") - F.col("bm")), (F.col("v") - F.col("bv"))
    sm, sv = F.greatest(F.coalesce("mean_scale", F.lit(1.0)), F.lit(floor)), F.greatest(F.coalesce("var_scale", F.lit(1.0)), F.lit(floor))
    return F.sqrt(F.sum((m / sm) * (m / sm) + (v / sv) * (v / sv)))


DISTANCES: dict[str, Callable[[float], Column]] = {"symmetric_kl": _sum_kl, "l2": _l2}


def distances(batches: DataFrame, bank: DataFrame, kind: str = "symmetric_kl", scales: DataFrame | None = None, floor: float = 1e-8, *keys: str) -> DataFrame:
    """keys, idx, label, distance of each batch descriptor (keys, ch, mean, var) to each entry (idx, label, ch, mean, var)."""
    if kind not in DISTANCES:
        raise ValueError(f"unknown distance {kind}")
    b = bank.select("idx", "label", "ch", F.col("mean").alias("bm"), F.col("var").alias("bv"))
    if scales is not None:
        b = b.join(scales, "ch")
    else:
        b = b.withColumn("mean_scale", F.lit(None).cast("double")).withColumn("var_scale", F.lit(None).cast("double"))
    b = F.broadcast(b) if bank.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else b
    q = batches.select(*keys, "ch", F.col("mean").alias("m"), F.col("var").alias("v"))
    return q.join(b, "ch").groupBy(*keys, "idx", "label").agg(DISTANCES[kind](floor).alias("distance"))


def channel_mismatch(batches: DataFrame, bank: DataFrame) -> DataFrame:
    """label, channels of entries whose channel count differs from the batches': must be empty."""
    n = batches.agg(F.countDistinct("ch").alias("want"))
    return bank.groupBy("label").agg(F.count("*").alias("channels")).crossJoin(n).where("channels <> want").select("label", "channels")


def route(dist: DataFrame, threshold: float | None = None, *keys: str) -> DataFrame:
    """keys, idx, label, distance, margin, fallback: the nearest entry, the first index on ties.

    ``margin`` is the runner-up's distance minus the best's, null in a bank of one.  Beyond the threshold (strictly)
    the batch is refused and label and index are null.  Best and runner-up come from one aggregate, not a sort.
    """
    pair = F.struct("distance", "idx", "label")
    top = dist.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(pair)), 1, 2).alias("t"))
    best, second = F.col("t")[0], F.get("t", F.lit(1))
    refused = (best["distance"] > F.lit(threshold)) if threshold is not None else F.lit(False)
    return top.select(
        *keys, F.when(~refused, best["idx"]).alias("idx"), F.when(~refused, best["label"]).alias("label"), best["distance"].alias("distance"),
        (second["distance"] - best["distance"]).alias("margin"), refused.alias("fallback"),
    )


def threshold_of(intra: DataFrame, percentile: float = 95.0) -> DataFrame:
    """One row: the linearly interpolated percentile of distances within a condition."""
    return intra.agg(F.percentile("distance", F.lit(percentile / 100)).alias("threshold"))


def build_bank(rows: DataFrame, vector: str = "x", calibration: int = 8) -> tuple[DataFrame, DataFrame]:
    """Entries (idx, label, ch, mean, var) of rows (condition, batch, vector), and the distances (label, batch, distance) of each
    condition's first ``calibration`` batches to its own entry.  There must be a ``clean`` condition: without it undegraded batches
    would be routed to the nearest corruption.
    """
    labels = sorted(r[0] for r in rows.select("condition").distinct().collect())  # a few dozen
    if "clean" not in labels:
        raise ValueError("the bank has no clean entry")
    names = rows.sparkSession.createDataFrame(list(enumerate(["clean", *[x for x in labels if x != "clean"]])), "idx int, label string")
    entries = moments.channel_moments(rows, vector, "condition").withColumnRenamed("condition", "label")
    entries = entries.join(F.broadcast(names), "label").select("idx", "label", "ch", "mean", "var")
    first = moments.channel_moments(rows.where(F.col("batch") < calibration), vector, "condition", "batch").withColumnRenamed("condition", "of")
    own = distances(first, entries, "symmetric_kl", None, 1e-8, "of", "batch").where("of = label")
    return entries, own.select("label", "batch", "distance")


def stream_order(conditions: list[str], severities: list[int], revisit: bool = True) -> list[str]:
    """Clean first, then the other conditions by name if their severity is wanted, then clean again."""
    found = {}
    for c in conditions:
        name, _, tail = c.rpartition("_s")
        found[c] = int(tail) if name and tail.isdigit() else None
    rest = [c for c in sorted(found) if c != "clean" and found[c] in severities]
    return ["clean", *rest, *(["clean_again"] if revisit else [])]


def visit_order(batches: DataFrame) -> DataFrame:
    """visit, condition: conditions (a few dozen) in the order in which the stream first shows them, a second visit to clean apart."""
    first = batches.groupBy("condition").agg(F.min("seq").alias("seq"))
    return first.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("seq")) - 1).alias("visit"), "condition")


def lagged(batches: DataFrame, arm: str = "arm", seq: str = "seq", *columns: str) -> DataFrame:
    """Add ``prev_<column>``: what the batch before showed, across conditions; the first batch of an arm has null."""
    w = Window.partitionBy(arm).orderBy(seq)
    return batches.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def arms(decided: DataFrame, bank_labels: list[str]) -> DataFrame:
    """Four arms over routed decisions of the previous batch.

    Input: seq, condition, corruption, prev_label, prev_fallback, prev_distance, prev_margin (nulls for the first batch).
    source never adapts; blind adapts on the batch; routed loads what the previous batch chose, blind if refused;
    oracle loads the true state, blind where the bank has none.
    """
    rows = decided.withColumn("arm", F.explode(F.array(*map(F.lit, ("source", "blind", "routed", "oracle")))))
    first = F.col("prev_distance").isNull()
    routed, oracle = F.col("arm") == "routed", F.col("arm") == "oracle"
    known = F.col("corruption").isin(*bank_labels)
    chosen = F.when(routed & ~first, F.col("prev_label")).when(oracle & known, F.col("corruption"))
    fallback = F.when(routed & ~first, F.coalesce("prev_fallback", F.lit(False))).when(oracle, ~known).otherwise(F.lit(False))
    out = rows.withColumn("chosen", chosen).withColumn("fallback", fallback)
    out = out.withColumn("blind", (F.col("arm") == "blind") | F.col("fallback"))
    out = out.withColumn("decided", (routed & ~first) | oracle)
    out = out.withColumn("distance", F.when(routed, F.col("prev_distance"))).withColumn("margin", F.when(routed, F.col("prev_margin")))
    return state_loads(out)


def state_loads(rows: DataFrame, chosen: str = "chosen") -> DataFrame:
    """Add ``state_loaded``: a state is wanted and is not the one the batch before left loaded (a blind batch leaves none)."""
    w = Window.partitionBy("arm").orderBy("seq")
    return rows.withColumn("state_loaded", F.col(chosen).isNotNull() & ~F.col(chosen).eqNullSafe(F.lag(chosen).over(w)))


def report(decisions: DataFrame, *keys: str) -> DataFrame:
    """Rates over decisions (chosen, truth, distance, margin); null where there is nothing to rate."""
    routable, refused = F.col("truth").isNotNull(), F.col("chosen").isNull()
    rate = lambda hit, over: F.avg(F.when(over, hit.cast("double")))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return decisions.groupBy(*keys).agg(
        F.avg(refused.cast("double")).alias("fallback_rate"),
        rate(F.coalesce(F.col("chosen") == F.col("truth"), F.lit(False)), routable).alias("hit_rate"),
        rate(refused, routable).alias("fallback_when_routable"),
        rate(refused, ~routable).alias("refusal_rate"),
        F.avg(finite("distance")).alias("mean_distance"),
        F.avg(finite("margin")).alias("mean_margin"),
    )


def footprint(bank: DataFrame, bytes_per_value: int = 4) -> DataFrame:
    """One row: states, channels, bytes_per_state, bytes; states of different channel counts are an error."""
    per = bank.groupBy("label").agg(F.count("*").alias("c"))
    out = per.agg(F.count("*").alias("states"), F.max("c").alias("channels"), F.min("c").alias("lo"))
    ok = F.when(F.col("lo") == F.col("channels"), F.col("channels")).otherwise(F.raise_error(F.lit("states differ in channels")).cast("long"))
    return out.select("states", ok.alias("channels"), (F.col("channels") * 2 * bytes_per_value).alias("bytes_per_state"), (F.col("states") * F.col("channels") * 2 * bytes_per_value).alias("bytes"))
