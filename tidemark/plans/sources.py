"""Queries that write through a sink into the shared folder and read back through the source beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import rules, vectors
from tidemark.sources import files
from tidemark.sources.shared import scratch

from .common import rounded, table


def class_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation below its region's directory, scanned, numbered and relabelled; other endings are no images."""
    n = table(spark, sf_dir, "nation").select(F.format_string("%05d", "n_regionkey").alias("dir"), F.regexp_replace("n_name", "[^A-Za-z0-9]", "").alias("name"))
    path = scratch(spark, "tree")
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    for r in n.collect():  # 25 rows: a tree is written file by file
        for ending in (".png", ".txt"):
            out = fs.create(hadoop.Path(f"{path}/{r['dir']}/{r['name']}{ending}"))
            out.write(1)
            out.close()
    found = files.scan_classes(spark, path)
    have = spark.createDataFrame([(d,) for d in files.class_directories(spark, path)], "dir string")
    out = files.relabel(found, files.class_map(files.require_complete(have, found)))
    return out.groupBy("dir", "class_id").agg(F.count("*").alias("n"), F.min("filename").alias("first"))


CLASS_TREE_SQL = """select printf('%05d', n_regionkey) as dir, n_regionkey::bigint as class_id, count(*)::bigint as n, min(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g') || '.png') as first from nation group by n_regionkey"""


def partitioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under client / split / class folders, written twice: the second run replaces the first."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 4).cast("int").alias("client"), F.when(F.col("o_orderkey") % 10 == 0, "valid").otherwise("train").alias("split"), F.col("o_orderstatus").alias("class")
    )
    path = scratch(spark, "split")
    files.write_partitions(o.union(o), path)
    files.write_partitions(o, path)
    back = spark.read.schema("o_orderkey long, client int, split string, class string").parquet(path)
    return back.groupBy("client", "split", "class").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


PARTITIONED_SQL = """select (o_custkey % 4)::int as client, case when o_orderkey % 10 = 0 then 'valid' else 'train' end as split, o_orderstatus as class, count(*)::bigint as n, sum(o_orderkey)::bigint as keys
from orders group by 1, 2, 3"""


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a semicolon list of files and classes, every value a text."""
    path = scratch(spark, "truth")
    table(spark, sf_dir, "part").select(F.format_string("%05d.ppm", "p_partkey").alias("Filename"), F.col("p_size").alias("ClassId")).write.csv(path, sep=";", header=True)
    return files.read_ground_truth(spark, path).groupBy("ClassId").agg(F.count("*").alias("n"), F.min("Filename").alias("first"))


TRUTH_SQL = "select p_size::varchar as ClassId, count(*)::bigint as n, min(printf('%05d.ppm', p_partkey)) as first from part group by 1"


def results_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results appended twice under different columns, read under their union, and their rows as configurations."""
    path = scratch(spark, "results")
    c = table(spark, sf_dir, "customer")
    files.append_results(spark, c.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), path)
    files.append_results(spark, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), path)
    params = files.config_rows(files.read_appended(spark, path)).select("params")
    return params.select(F.array_join(F.array_sort(F.map_keys("params")), ",").alias("keys")).groupBy("keys").agg(F.count("*").alias("n"))


APPEND_SQL = "select 'name,segment' as keys, count(*)::bigint as n from customer union all select 'name,nation', count(*)::bigint from supplier"


def extra_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map column as columns of its own, through CSV and back."""
    e = table(spark, sf_dir, "events").select("event_id", F.create_map(F.col("event_type"), F.col("value")).alias("extra"))
    path = scratch(spark, "extra")
    files.write_csv(files.flatten_extra(e), path)
    back = files.read_results(spark, path)
    return back.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in back.columns if c != "event_id"])).alias("x")).select("x.*").groupBy("kind").agg(
        F.count("value").alias("n"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total")
    )


EXTRA_SQL = "select event_type as kind, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1"


def checkpoint_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters scaled by 4 on the way in; the recalibrated checkpoint carries the same ones, and the states beside them."""
    e = table(spark, sf_dir, "embeddings")
    params = e.groupBy(F.col("label").cast("string").alias("layer")).agg(F.array(F.count("*").cast("int")).alias("shape"), F.array_sort(F.collect_list(F.col("embedding")[0].cast("double") * 4)).alias("values"))
    one, two = scratch(spark, "checkpoint"), scratch(spark, "recalibrated")
    files.save_best(params, one, {"round": 3}, 4.0)
    state = vectors.average(e, "embedding", F.lit(1), "label").select(F.col("label").cast("string").alias("layer"), F.col("pos").alias("ch"), F.col("x").alias("mean"), F.lit(1.0).alias("var"))
    files.save_recalibrated(spark, one, state, two, "pooled")
    back, facts = files.read_checkpoint(spark, two)
    states = files.checkpoint_states(spark, two).groupBy("layer").agg(F.sum("mean").alias("states"))
    out = back.select("layer", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"), F.lit(facts["bn_stats_num_channels"]).cast("long").alias("channels")).join(states, "layer")
    return rounded(out, "total", "states", digits=4)


CHECKPOINT_SQL = """with l as (select label, unnest(embedding)::double as x, unnest(range(0, 64)) as pos from embeddings), m as (select label, pos, avg(x) as m from l group by 1, 2)
select label::varchar as layer, round((select sum(x) from l where pos = 0 and l.label = m.label), 4) as total, (select count(*) from m)::bigint as channels, round(sum(m), 4) as states from m group by label"""


def initial_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's parameters before any round, as many as classes times width."""
    facts = table(spark, sf_dir, "embeddings").agg(F.countDistinct("label").alias("k"), F.max(F.size("embedding")).alias("w")).first()
    return rounded(rules.initial_weights(spark, facts["k"], facts["w"], 0.1), "x")


WEIGHTS_SQL = """with f as (select count(distinct label) as k, max(len(embedding)) as w from embeddings)
select i::int as pos, round(((i * 7919) % 2001 - 1000) / 1000e0 * 0.1e0, 6) as x from f, unnest(range(0, k * w)) t(i)"""

PAIRS = {
    "class_tree": (class_tree, CLASS_TREE_SQL),
    "partitioned_sink": (partitioned_sink, PARTITIONED_SQL),
    "ground_truth": (ground_truth, TRUTH_SQL),
    "results_append": (results_append, APPEND_SQL),
    "extra_columns": (extra_columns, EXTRA_SQL),
    "checkpoint_round_trip": (checkpoint_round_trip, CHECKPOINT_SQL),
    "initial_weights": (initial_weights, WEIGHTS_SQL),
}
