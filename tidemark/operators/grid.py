"""Experiment grids: expansion, normalisation, fingerprints, what is new.

A configuration is a row (ord, params map<string,string>): values are texts, as they are in a results CSV.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What keys read as while they mean nothing, and their defaults while they do.
PARTITION_INACTIVE = {"dirichlet_alpha": "-1.0", "partition_unit": "n/a"}
PARTITION_DEFAULTS = {"partition_unit": "track", "dirichlet_alpha": "0.5"}
FIPA_INACTIVE = {"fipa_warmup_rounds": "0", "fipa_rank": "-1", "fipa_grad_batches": "-1", "fipa_pinv_rtol": "-1.0"}
FIPA_DEFAULTS = {"fipa_warmup_rounds": "0", "fipa_rank": "5", "fipa_pinv_rtol": "1e-08"}
FEDDISCO_INACTIVE = {"feddisco_a": "-1.0", "feddisco_b": "-1.0"}
FEDDISCO_DEFAULTS = {"feddisco_a": "0.5", "feddisco_b": "0.1"}
AUGMENTATION_INACTIVE = {"augmentation_rotation_degrees": "-1.0", "augmentation_translate": "-1.0", "augmentation_scale": "-1.0"}
AUGMENTATION_DEFAULTS = {"augmentation_rotation_degrees": "10.0", "augmentation_translate": "0.1", "augmentation_scale": "(0.9, 1.1)"}
PROX_INACTIVE = {"fedprox_mu": "0.0"}
#: Keys that identify a run even where they are not axes.
EXTRA_KEYS = (
    "dataset_name", "train_augmentation", "model_name", "partition_strategy", "dirichlet_alpha", "partition_unit", "max_units_per_class",
    "fipa_warmup_rounds", "fipa_rank", "fipa_grad_batches", "fipa_pinv_rtol", "feddisco_a", "feddisco_b",
)


def expand(spark: SparkSession, common: dict[str, list], specific: dict[str, dict[str, list]]) -> DataFrame:
    """ord, params: every choice of the axes for every model; a model's own axis replaces the common one of the same name."""
    parts = []
    for model in sorted(specific):
        axes = {"model_name": [model]} | common | specific[model]
        row = spark.range(0, 1, 1, 1)
        for k in sorted(axes):  # one task multiplies the choices out: a cross join would multiply partitions too
            row = row.withColumn(k, F.explode(F.array(*[F.lit(str(v)) for v in axes[k]])))
        parts.append(row.select(F.create_map(*[x for k in sorted(axes) for x in (F.lit(k), F.col(f"`{k}`"))]).alias("params")))
    out = reduce(DataFrame.union, parts)
    return out.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(fingerprint_text(F.col("params"), None))) - 1).cast("long").alias("ord"), "params")


def normalise(configs: DataFrame) -> DataFrame:
    """Keys that mean nothing under a configuration's other keys get one fixed value; keys that do get their defaults.

    Every controlled key is one expression over the original map, so the plan grows with the keys, not with their nesting.
    """
    value = lambda k: F.nullif(F.try_element_at("params", F.lit(k)), F.lit(""))
    rule, strategy = value("aggregation_algorithm"), F.coalesce(value("partition_strategy"), F.lit("stratified"))
    augmented = F.coalesce(value("train_augmentation"), F.lit("False"))
    settled = {"partition_strategy": strategy, "train_augmentation": augmented}
    groups = (
        (strategy == "dirichlet", PARTITION_INACTIVE, PARTITION_DEFAULTS),
        (rule == "FIPA", FIPA_INACTIVE, FIPA_DEFAULTS),
        (rule == "FedDisco", FEDDISCO_INACTIVE, FEDDISCO_DEFAULTS),
        (rule == "FedProx", PROX_INACTIVE, {}),
        (F.lower(F.trim(augmented)).isin("true", "1", "yes"), AUGMENTATION_INACTIVE, AUGMENTATION_DEFAULTS),
    )
    for active, inactive, defaults in groups:
        for k in inactive:
            settled[k] = F.when(active, F.coalesce(value(k), F.lit(defaults.get(k)).cast("string"))).otherwise(F.lit(inactive[k]))
    made = F.create_map(*[x for k, v in settled.items() for x in (F.lit(k), v)])
    rest = F.map_filter("params", lambda k, v: ~k.isin(*settled) & v.isNotNull() & (v != ""))
    return configs.withColumn("params", F.map_concat(rest, F.map_filter(made, lambda k, v: v.isNotNull())))


def fingerprint_text(params: Column, keys: tuple[str, ...] | None) -> Column:
    """``key=value`` pairs of the keys (all if None), sorted; absent and empty ones add nothing."""
    pairs = F.filter(F.map_entries(params), lambda e: e["value"].isNotNull() & (e["value"] != "") & (e["key"].isin(*keys) if keys is not None else F.lit(True)))
    return F.array_join(F.array_sort(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n")


def fingerprint(configs: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``fingerprint``; the seed never counts."""
    use = F.map_filter("params", lambda k, v: k != "seed")
    return configs.withColumn("fingerprint", F.sha2(fingerprint_text(use, keys), 256))


def new_configs(generated: DataFrame, executed: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Generated configurations that were never run, once each: the first by ``ord`` of equal ones."""
    left, right = fingerprint(normalise(generated), keys), fingerprint(normalise(executed), keys)
    first = left.groupBy("fingerprint").agg(F.min_by("params", "ord").alias("params"), F.min("ord").alias("ord"))
    return first.join(right.select("fingerprint"), "fingerprint", "left_anti")


def grid_counts(generated: DataFrame, executed: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """One row: generated, new, skipped."""
    n = generated.agg(F.count("*").alias("generated"))
    return n.crossJoin(new_configs(generated, executed, keys).agg(F.count("*").alias("new"))).withColumn("skipped", F.col("generated") - F.col("new"))


def merge_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables under the union of their columns, in sorted order; what a row lacks is null."""
    out = old.unionByName(new, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def symmetric_difference(one: DataFrame, two: DataFrame, column: str) -> DataFrame:
    """Values that only one side has."""
    a, b = one.select(column), two.select(column)
    return a.exceptAll(b).union(b.exceptAll(a)).distinct()


#: Augmentations that are refused, and classes that mirror each other.
REFUSED_KEYS = ("augmentation_horizontal_flip", "augmentation_vertical_flip", "augmentation_brightness", "augmentation_contrast", "augmentation_blur", "augmentation_noise")
MIRROR_CLASS_PAIRS = ((19, 20), (33, 34), (36, 37), (38, 39))


def augmentation(config: dict) -> dict | None:
    """degrees, translate and scale of a run's augmentation, or None if it is off.

    Refused keys are an error even then: flips change the class of mirrored signs, and the others would train on what is measured.
    """
    if bad := [k for k in REFUSED_KEYS if k in config]:
        raise ValueError(f"{bad[0]} is not available")
    if not config.get("train_augmentation"):
        return None
    degrees, translate = (float(config.get(f"augmentation_{k}", v)) for k, v in (("rotation_degrees", 10.0), ("translate", 0.1)))
    scale = tuple(map(float, config.get("augmentation_scale", (0.9, 1.1))))
    if not (0 <= degrees < 180 and 0 <= translate < 1 and len(scale) == 2 and 0 < scale[0] <= scale[1]):
        raise ValueError(f"augmentation out of range: {degrees} degrees, {translate}, {scale}")
    return {"degrees": degrees, "translate": translate, "scale": scale}
