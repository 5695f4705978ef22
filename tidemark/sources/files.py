"""Sources and sinks: labelled directory trees, configurations, results, checkpoints, manifests."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File endings of a catalogue.
SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".gif")
INDEX_SUFFIXES = (".png", ".ppm", ".jpg", ".jpeg")


def scan_classes(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, dir, filename of every image below a class directory; contents are never read (only ``path`` is projected)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    out = files.select("path", F.element_at(parts, -2).alias("dir"), F.element_at(parts, -1).alias("filename"))
    return out.where(F.lower("filename").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))


def class_directories(spark: SparkSession, root: str) -> list[str]:
    """Names of the class directories below ``root``, sorted; a root that is not there, or without any, is an error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    if not names:
        raise ValueError(f"no class directories below {root}")
    return names


def class_map(dirs: DataFrame) -> DataFrame:
    """dir, class_id: the first run of digits if every name has one and no two agree, else the alphabetical rank.

    One row for each class; an empty list is an error.
    """
    names = dirs.select("dir").distinct()
    digits = F.nullif(F.regexp_extract("dir", r"(\d+)", 1), F.lit("")).cast("long")
    n = names.withColumn("d", digits)
    facts = n.agg(F.count("*").alias("all"), F.count("d").alias("have"), F.countDistinct("d").alias("kinds"))
    ok = (F.col("all") == F.col("have")) & (F.col("have") == F.col("kinds"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("dir")) - 1
    empty = F.when(F.col("all") == 0, F.raise_error(F.lit("no class directories")).cast("long"))
    return n.crossJoin(F.broadcast(facts)).select("dir", empty.when(ok, F.col("d")).otherwise(rank.cast("long")).alias("class_id"))


def missing_classes(have: DataFrame, canonical: DataFrame, column: str = "dir") -> DataFrame:
    """Canonical classes that are not there."""
    return canonical.select(column).distinct().join(have.select(column).distinct(), column, "left_anti")


def require_complete(have: DataFrame, canonical: DataFrame, column: str = "dir") -> DataFrame:
    """``have``, or an error that names a missing class."""
    lost = [r[0] for r in missing_classes(have, canonical, column).limit(5).collect()]
    if lost:
        raise ValueError(f"classes missing from the tree: {sorted(lost)}")
    return have


#: The most classes of a map that is broadcast.
MOST_CLASSES = 1_000_000


def relabel(rows: DataFrame, canonical: DataFrame, column: str = "dir") -> DataFrame:
    """Rows with their canonical ``class_id``; a class that the map lacks is an error where it is met. Doing it twice changes nothing."""
    known = canonical.select(column, "class_id")
    known = F.broadcast(known) if known.limit(MOST_CLASSES + 1).count() <= MOST_CLASSES else known
    out = rows.drop("class_id").join(known, column, "left")
    return out.withColumn("class_id", F.when(F.col("class_id").isNull(), F.raise_error(F.concat(F.lit("unknown class "), column)).cast("long")).otherwise(F.col("class_id")))


def class_index(rows: DataFrame) -> DataFrame:
    """dir, files sorted by name."""
    return rows.groupBy("dir").agg(F.sort_array(F.collect_list("filename")).alias("files"))


def verify_split(counts: DataFrame, expected: int) -> DataFrame:
    """One row: classes, images, empty classes, and whether the total is the expected one and no class is empty."""
    out = counts.agg(F.count("*").alias("classes"), F.sum("n").alias("images"), F.count_if(F.col("n") == 0).alias("empty"))
    return out.withColumn("complete", (F.col("images") == expected) & (F.col("empty") == 0))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """A semicolon CSV with header, every value a text."""
    return spark.read.csv(path, sep=";", header=True, inferSchema=False)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def config_rows(results: DataFrame) -> DataFrame:
    """ord, params of a results table: empty cells are absent."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in results.columns])
    kept = F.filter(pairs, lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return results.select(F.monotonically_increasing_id().alias("ord"), F.map_from_entries(kept).alias("params"))


def write_partitions(assigned: DataFrame, path: str) -> None:
    """Assignments under client=/split=/class=, replacing what was there."""
    assigned.write.mode("overwrite").partitionBy("client", "split", "class").parquet(path)


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def flatten_extra(rows: DataFrame, extra: str = "extra") -> DataFrame:
    """A map column as sorted columns of its own; no rows are an error. The key list is the only thing brought back."""
    keys = sorted(r[0] for r in rows.select(F.explode(F.map_keys(extra))).distinct().collect())
    if rows.isEmpty():
        raise ValueError("no rows to write")
    return rows.select(*[c for c in rows.columns if c != extra], *[F.try_element_at(extra, F.lit(k)).alias(k) for k in keys])


def append_results(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Append to a shared results table; new keys become new columns when it is read."""
    rows.write.mode("append").parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def results_tail(rows: DataFrame, order: str, n: int = 5) -> DataFrame:
    return rows.orderBy(F.col(order).desc()).limit(n)


def write_checkpoint(params: DataFrame, path: str, metadata: dict, denominator: float = 1.0) -> None:
    """Parameters (layer, shape, values) descaled as Parquet, and their metadata as one JSON row beside them."""
    scaled = params.withColumn("values", F.transform("values", lambda x: (x / denominator).cast("float")) if denominator > 0 else F.col("values"))
    scaled.write.mode("overwrite").parquet(f"{path}/params")
    params.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def read_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Parameters and metadata; missing columns are an error."""
    params = spark.read.parquet(f"{path}/params")
    if lost := {"layer", "shape", "values"} - set(params.columns):
        raise ValueError(f"not a checkpoint, it lacks {sorted(lost)}")
    return params, json.loads(spark.read.text(f"{path}/metadata").first()[0])


def write_manifest(spark: SparkSession, facts: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def checkpoint_stem(config: dict, stamp: str) -> str:
    """A name that says what the model is; characters that files should not have become dashes."""
    split = f"a{config.get('dirichlet_alpha')}" if config.get("partition_strategy") == "dirichlet" else "iid"
    parts = [config.get("dataset_name", "dataset"), config.get("model_name", "model"), config.get("aggregation_algorithm", "FedAvg"), split]
    parts += [f"c{config.get('num_clients')}", f"le{config.get('local_epoch')}", f"seed{config.get('seed')}", stamp]
    return "".join(c if c.isalnum() or c in "._-" else "-" for c in "_".join(map(str, parts)))


def save_best(params: DataFrame | None, path: str, metadata: dict, denominator: float = 1.0, encrypted: bool = False, log: Callable[[str], None] = print) -> str | None:
    """Write the best model if there is one that can be read; else say why not and return None. A failure to write is told, not raised."""
    if params is None:
        log("no checkpoint: no round improved on the first score")
        return None
    if encrypted:
        log("no checkpoint: the parameters are ciphertexts, and the server has no key")
        return None
    try:
        write_checkpoint(params, path, metadata, denominator)
    except Exception as e:  # the run's results stand without it
        log(f"the checkpoint could not be written: {e}")
        return None
    return path


def save_recalibrated(spark: SparkSession, path: str, state: DataFrame, target: str, source: str, on: str | None = None, images: int | None = None) -> dict:
    """A second checkpoint beside the first: its parameters, and the states (layer, ch, mean, var) measured since; returns its metadata."""
    params, metadata = read_checkpoint(spark, path)
    facts = state.agg(F.countDistinct("layer"), F.count("*")).first()
    metadata |= {"bn_stats_source": source, "bn_stats_recalibrated_on": on, "bn_stats_num_images": images, "bn_stats_num_layers": facts[0], "bn_stats_num_channels": facts[1]}
    write_checkpoint(params, target, metadata)
    state.select("layer", "ch", "mean", "var").write.mode("overwrite").parquet(f"{target}/bn_stats")
    return metadata


def checkpoint_states(spark: SparkSession, path: str) -> DataFrame | None:
    """The recalibrated states that a checkpoint carries; None: it still has those that it was trained from."""
    _, metadata = read_checkpoint(spark, path)
    return spark.read.parquet(f"{path}/bn_stats") if metadata.get("bn_stats_source") else None


def write_records(batches: DataFrame, conditions: DataFrame, summary: dict, path: str) -> None:
    """Batch records and condition rows as CSV, and the summary as JSON, under one folder; no batch is an error."""
    if batches.isEmpty():
        raise ValueError("no batch records to write")
    write_csv(batches, f"{path}/batches")
    write_csv(conditions, f"{path}/conditions")
    write_manifest(batches.sparkSession, summary | {"files": {k: f"{path}/{k}" for k in ("batches", "conditions")}}, f"{path}/summary")
