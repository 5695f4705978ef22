"""Deterministic partitioning, splitting and sampling.

Order comes from a hash of key and seed (never ``rand``), so results do not depend on partitions.  Ranks are taken in two
levels (:func:`numbered`): the leading order column cuts each class into slots, rows are numbered within a slot, and the
counts of the slots before are added, so a class that holds most rows is many tasks.  ``order`` may be replaced
to fix one that another engine can repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The range of a 64-bit hash, and the slots that it is cut into.
HASHED = (-(2.0**63), 2.0**63)
SLOTS = 1024


def seeded(key: str, seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def numbered(rows: DataFrame, name: str, order: list[Column], *keys: str, span: tuple[float, float] = HASHED, slots: int = SLOTS) -> DataFrame:
    """Add ``name``: 1, 2, ... within keys in the order given.

    ``order[0]`` is a number spread over ``span`` (a hash): slots of it are ranked apart.  The window that adds up the
    slots' counts runs over keys x slots rows, never over data.
    """
    lo, hi = span
    slot = F.least(F.greatest(F.floor((order[0].cast("double") - lo) / (hi - lo) * slots), F.lit(0)), F.lit(slots - 1)).cast("int")
    dealt = rows.withColumn("_cell", F.struct(slot.alias("slot"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    counts = dealt.groupBy("_cell").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*[F.col(f"_cell.k{i}") for i in range(len(keys))] or [F.lit(0)])
    before = F.coalesce(F.sum("_n").over(group.orderBy("_cell.slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_cell").orderBy(*order)))
    out = ranked.join(counts.select("_cell", before.alias("_before")), "_cell")
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_cell", "_before")


def batches(rows: DataFrame, order: list[Column], size: int, *keys: str, span: tuple[float, float] = HASHED) -> DataFrame:
    """Add ``batch``: rows numbered within keys and cut into runs of ``size``."""
    return numbered(rows, "batch", order, *keys, span=span).withColumn("batch", F.floor((F.col("batch") - 1) / size))


def stratified_kfold(rows: DataFrame, label: str, k: int, order: list[Column], span: tuple[float, float] = HASHED) -> DataFrame:
    """Add ``client``: members of each class dealt round robin; no more clients than the rarest class has members."""
    rarest = rows.groupBy(label).count().agg(F.min("count")).first()[0] or 1
    folds = max(1, min(k, rarest))
    return numbered(rows, "client", order, label, span=span).withColumn("client", ((F.col("client") - 1) % folds).cast("int"))


def leading(column: str, kind: str) -> Column:
    """A number in the order of the column: itself, or a text's first six bytes."""
    if kind != "string":
        return F.col(column).cast("double")
    return F.coalesce(F.conv(F.rpad(F.substring(F.hex(F.col(column).cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double"), F.lit(0.0))


def units(rows: DataFrame, label: str, track: str) -> DataFrame:
    """unit, label, track, n: one row for each class and track, numbered in sorted order."""
    per = rows.groupBy(F.col(label).alias("label"), F.col(track).alias("track")).agg(F.count("*").alias("n"))
    lead = leading("track", per.schema["track"].dataType.simpleString())
    lo, hi = per.agg(F.min(lead), F.max(lead)).first()
    out = numbered(per, "unit", [lead, F.col("track")], "label", span=(lo or 0.0, (hi or 0.0) + 1.0))
    sizes = per.groupBy("label").agg(F.count("*").alias("_n"))
    # one row a class
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("label").alias("_label"), before.alias("_before"))
    out = out.join(F.broadcast(starts), F.col("label").eqNullSafe(F.col("_label")))
    return out.select("label", "track", "n", (F.col("unit") - 1 + F.col("_before")).cast("long").alias("unit"))


def positions_of(assigned: DataFrame, members: DataFrame) -> DataFrame:
    """client, position: the rows that each client's units (client, unit) hold, from (unit, positions array)."""
    return assigned.join(members, "unit").select("client", F.explode("positions").alias("position"))


def cap_units(rows: DataFrame, label: str, most: int, order: list[Column], span: tuple[float, float] = HASHED) -> DataFrame:
    """At most ``most`` units of each class, without replacement."""
    return numbered(rows, "_r", order, label, span=span).where(F.col("_r") <= most).drop("_r")


def draw_proportions(classes: list, clients: int, alpha: float, seed: int) -> list[tuple]:
    """(class, client, p): one symmetric Dirichlet draw for each class."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    draws = np.random.default_rng(seed).dirichlet([alpha] * clients, len(classes))
    return [(c, k, float(p)) for c, row in zip(classes, draws, strict=True) for k, p in enumerate(row)]


def dirichlet_assign(rows: DataFrame, label: str, proportions: DataFrame, order: list[Column], span: tuple[float, float] = HASHED) -> DataFrame:
    """Add ``client``: each class in hashed order, cut at floor(cumulative share * size); the last client takes the rest.

    ``proportions``: (label, client, p).  The cuts (classes x clients) are the broadcast side of a range join.
    """
    ranked = numbered(rows, "_r", order, label, span=span).withColumn("_r", F.col("_r") - 1)
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label).orderBy("client")
    share = F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))
    cuts = proportions.join(sizes, label).withColumn("_to", F.floor(share * F.col("_n"))).withColumn("_last", F.lead("client").over(w).isNull())
    cuts = cuts.withColumn("_to", F.when(F.col("_last"), F.col("_n")).otherwise(F.col("_to")))
    cuts = cuts.withColumn("_from", F.coalesce(F.lag("_to").over(w), F.lit(0))).select(F.col(label).alias("_c"), "client", "_from", "_to")
    hit = (F.col(label) == F.col("_c")) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to"))
    return ranked.join(F.broadcast(cuts), hit).drop("_r", "_c", "_from", "_to")


def units_of_clients(sizes: dict, shares: list[tuple], clients: int) -> list[int]:
    """How many units each client would get: what a draw does, from the classes' sizes alone."""
    out = [0] * clients
    for c, n in sizes.items():
        mine = [p for label, _, p in shares if label == c]
        cuts = [0, *(int(np.floor(x * n)) for x in np.cumsum(mine)[:-1]), n]
        for k in range(clients):
            out[k] += cuts[k + 1] - cuts[k]
    return out


def dirichlet_partition(rows: DataFrame, label: str, unit: str, clients: int, alpha: float, min_images: int = 10, weight: str | None = None, attempts: int = 50, seed: int = 42) -> DataFrame:
    """:func:`dirichlet_assign` with drawn shares, drawn again until every client has two units and ``min_images``; else an error.

    A draw is judged by the classes' sizes first; only if units hold several images (``weight``) must one that passes be counted over the rows.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(label).collect()}
    schema = f"`{label}` {rows.schema[label].dataType.simpleString()}, client int, p double"
    spark = rows.sparkSession
    for k in range(attempts):
        shares = draw_proportions(list(sizes), clients, alpha, seed + k)
        if min(units_of_clients(sizes, shares, clients)) < (2 if weight else max(2, min_images)):
            continue
        out = dirichlet_assign(rows, label, spark.createDataFrame(shares, schema), [seeded(unit, seed + k), F.col(unit)])
        if weight:
            worst = out.groupBy("client").agg(F.sum(weight).alias("i")).agg(F.min("i")).first()[0]
            if worst < min_images:
                continue
        return out
    raise ValueError(f"no partition gave every client 2 units and {min_images} images in {attempts} attempts")


#: Strategies and units of a split, and what a configuration leaves out.
STRATEGIES, UNITS = ("stratified", "dirichlet"), ("track", "image")
DEFAULTS = {"partition_strategy": "stratified", "dirichlet_alpha": 0.5, "partition_unit": "track", "min_samples_per_client": 10, "max_resample_attempts": 50, "max_units_per_class": None, "seed": 42}


def split_settings(config: dict) -> dict:
    """The settings of a split with defaults filled in; what cannot be meant is an error."""
    s = {k: config.get(k, v) for k, v in DEFAULTS.items()} | {"num_clients": config["num_clients"]}
    if s["partition_strategy"] not in STRATEGIES:
        raise ValueError(f"unknown partition strategy {s['partition_strategy']!r}")
    if s["partition_unit"] not in UNITS:
        raise ValueError(f"unknown partition unit {s['partition_unit']!r}")
    if float(s["dirichlet_alpha"]) <= 0:
        raise ValueError("dirichlet_alpha must be over 0")
    return s


def split_by(config: dict, rows: DataFrame, label: str, track: str, row_id: str) -> DataFrame:
    """Rows with ``client``, by the strategy that the configuration names; tracks stay whole where the unit is the track."""
    s = split_settings(config)
    if rows.isEmpty():
        raise ValueError("there is nothing to split")
    if s["partition_strategy"] == "stratified":
        return stratified_kfold(rows, label, s["num_clients"], [seeded(row_id, s["seed"]), F.col(row_id)])
    unit = track if s["partition_unit"] == "track" else row_id
    per = rows.groupBy(F.col(label).alias("_label"), F.col(unit).alias("_unit")).agg(F.count("*").alias("_n"))
    if s["max_units_per_class"]:
        per = cap_units(per, "_label", s["max_units_per_class"], [seeded("_unit", s["seed"]), F.col("_unit")])
    out = dirichlet_partition(per, "_label", "_unit", s["num_clients"], float(s["dirichlet_alpha"]), s["min_samples_per_client"], "_n", s["max_resample_attempts"], s["seed"])
    on = F.col(label).eqNullSafe(F.col("_label")) & F.col(unit).eqNullSafe(F.col("_unit"))
    return rows.join(out.select("_label", "_unit", "client"), on).drop("_label", "_unit")


def conservation(assigned: DataFrame, unit: str) -> DataFrame:
    """One row: rows, distinct units, units with more than one client (must be 0)."""
    per = assigned.groupBy(unit).agg(F.count("*").alias("n"), F.countDistinct("client").alias("c"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("units"), F.count_if(F.col("c") > 1).alias("split_units"))


def train_valid(rows: DataFrame, client: str, label: str, unit: str, share: float, order: list[Column], span: tuple[float, float] = HASHED) -> DataFrame:
    """Add ``split``: ceil(share * units) of each client are for validation.

    Stratified by class if the client has 10 units, two of each class and as many validation units as classes: every class then
    gives its largest-remainder part of the quota, at least one.  Otherwise the first units in order are taken.
    """
    per_class = rows.groupBy(client, label).agg(F.count("*").alias("_m"))
    facts = per_class.groupBy(client).agg(F.sum("_m").alias("_n"), F.min("_m").alias("_least"), F.count("*").alias("_k"))
    facts = facts.withColumn("_quota", F.ceil(F.col("_n") * F.lit(share)))
    facts = facts.withColumn("_strat", (F.col("_n") >= 10) & (F.col("_least") >= 2) & (F.col("_quota") >= F.col("_k")))
    quota = allocate(per_class.join(facts, client).select(F.col(client).alias("key"), F.col(label).alias("class"), F.col("_m").alias("n"), F.col("_quota").alias("size")))
    quota = quota.select(F.col("key").alias(client), F.col("class").alias(label), F.col("alloc").alias("_take"))
    ranked = numbered(numbered(rows, "_rc", order, client, label, span=span), "_ra", order, client, span=span)
    out = ranked.join(facts.select(client, "_quota", "_strat"), client).join(quota, [client, label])
    valid = F.when(F.col("_strat"), F.col("_rc") <= F.col("_take")).otherwise(F.col("_ra") <= F.col("_quota"))
    return out.withColumn("split", F.when(valid, F.lit("valid")).otherwise(F.lit("train"))).drop("_rc", "_ra", "_quota", "_strat", "_take")


def allocate(counts: DataFrame) -> DataFrame:
    """Add ``alloc`` to (key, class, n, size): the key's size split over its classes by largest remainder.

    Every class gets one at least and its own size at most.  Too few handed out: one more to each class that has room, in order of
    the fractional part; too many: one less of each class over 1, largest first.  Ties go by class name.
    """
    w = Window.partitionBy("key")
    total = F.sum("n").over(w)
    out = counts.withColumn("_t", total).withColumn("_x", F.col("size") * F.col("n") / F.col("_t"))
    out = out.withColumn("_a", F.least(F.col("n"), F.greatest(F.lit(1), F.floor("_x")))).withColumn("_rest", F.col("size") - F.sum("_a").over(w))
    room, over = F.col("_a") < F.col("n"), F.col("_a") > 1
    up = F.row_number().over(w.orderBy(room.desc(), (F.col("_x") - F.floor("_x")).desc(), "class"))
    down = F.row_number().over(w.orderBy(over.desc(), F.col("_a").desc(), "class"))
    out = out.withColumn("_up", up).withColumn("_down", down)
    step = F.when((F.col("_rest") > 0) & room & (F.col("_up") <= F.col("_rest")), 1).when((F.col("_rest") < 0) & over & (F.col("_down") <= -F.col("_rest")), -1).otherwise(0)
    alloc = F.when(F.col("size") >= F.col("_t"), F.col("n")).otherwise(F.col("_a") + step)
    return out.withColumn("alloc", alloc.cast("long")).drop("_t", "_x", "_a", "_rest", "_up", "_down")


def stratified_subsample(rows: DataFrame, label: str, size: int, order: list[Column], span: tuple[float, float] = HASHED) -> DataFrame:
    """``size`` rows that keep each class's share; the same rows whatever else is asked of the table."""
    counts = rows.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n")).select(F.lit(0).alias("key"), "class", "n", F.lit(size).alias("size"))
    quota = F.broadcast(allocate(counts).select(F.col("class").alias(label), F.col("alloc").alias("_k")))
    ranked = numbered(rows, "_r", order, label, span=span)
    return ranked.join(quota, label).where(F.col("_r") <= F.col("_k")).drop("_r", "_k")


def sample_clients(clients: DataFrame, share: float, order: list[Column], needed: int = 1) -> DataFrame:
    """int(share * clients) clients in hashed order; none if fewer than ``needed`` are there: no round then."""
    n = clients.count()
    return clients.orderBy(*order).limit(int(share * n) if n >= needed else 0)


def conditions(spark, corruptions: list[str], severities: list[int]) -> DataFrame:
    """corruption, severity, condition: the plan of a corrupted set."""
    from tidemark.functions.scalar import condition_name

    rows = spark.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, corruptions))).alias("corruption"))
    rows = rows.withColumn("severity", F.explode(F.array(*map(F.lit, severities))))
    return rows.withColumn("condition", condition_name(F.col("corruption"), F.col("severity")))
