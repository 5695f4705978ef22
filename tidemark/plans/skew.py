"""Queries on label skew, aggregation weights and vector aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import fixedpoint, skew, vectors

from .common import rounded, table

VIEWS = {
    "lineitem": ("l_suppkey", "l_returnflag || l_linestatus"),
    "events": ("user_id", "event_type"),
    "documents": ("source", "lang"),
    "embeddings": ("vec_id % 8", "label"),
}


def counts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    client, label = VIEWS[name]
    rows = table(spark, sf_dir, name).select(F.expr(client).cast("string").alias("client"), F.expr(label).cast("string").alias("class"))
    return skew.class_counts(rows, "client", "class")


def _counts_sql(name: str) -> str:
    client, label = VIEWS[name]
    return f"select cast({client} as varchar) as client, cast({label} as varchar) as class, count(*) as n from {name} where ({client}) is not null and ({label}) is not null group by 1, 2"


def _weights_sql(name: str, a: float, b: float) -> str:
    return f"""
with counts as ({_counts_sql(name)}),
cells as (select c.client, k.class, coalesce(n, 0) as n from (select distinct client from counts) c cross join (select distinct class from counts) k
  left join counts using (client, class)),
totals as (select client, sum(n) as n from counts group by 1),
sk as (select client, t.n, sqrt(sum(pow(c.n::double / t.n - 1.0e0 / (select count(distinct class) from counts), 2))) as d_k
  from cells c join totals t using (client) group by 1, 2),
sc as (select *, n::double / sum(n) over () as size_share, greatest(n::double / sum(n) over () - {a}e0 * d_k + {b}e0, 0) as score from sk),
wt as (select *, case when sum(score) over () > 0 then score / sum(score) over () else size_share end as weight from sc)"""


def _feddisco(name: str, a: float = 0.5, b: float = 0.1):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = skew.feddisco_weights(skew.client_skew(counts(spark, sf_dir, name)), a, b)
        return rounded(w.select("client", "n", "d_k", "size_share", "weight"), "d_k", "size_share", "weight")

    sql = _weights_sql(name, a, b) + "\nselect client, n::bigint as n, round(d_k, 6) as d_k, round(size_share, 6) as size_share, round(weight, 6) as weight from wt"
    return query, sql


def dense_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.dense_counts(counts(spark, sf_dir, "documents"))


DENSE_SQL = f"""with counts as ({_counts_sql("documents")})
select c.client, k.class, coalesce(n, 0)::bigint as n from (select distinct client from counts) c cross join (select distinct class from counts) k left join counts using (client, class)"""


def feddisco_integer_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = skew.feddisco_weights(skew.client_skew(counts(spark, sf_dir, "lineitem")))
    return skew.integer_weights(w.withColumn("weight", F.round("weight", 12))).select("client", "int_weight")


INTEGER_SQL = (
    _weights_sql("lineitem", 0.5, 0.1)
    + """,
r as (select client, round(weight, 12) as weight, round_even(round(weight, 12) * 16777216, 0)::bigint as raw from wt)
select client, (raw + case when row_number() over (order by weight desc, client) = 1 then 16777216 - sum(raw) over () else 0 end)::bigint as int_weight from r"""
)


def feddisco_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = skew.feddisco_weights(skew.client_skew(counts(spark, sf_dir, "documents")), 0.5, 0.2)
    return rounded(skew.weight_diagnostics(w), "max_shift")


DIAGNOSTICS_SQL = _weights_sql("documents", 0.5, 0.2) + "\nselect count(*)::bigint as clients, round(max(abs(weight - size_share)), 6) as max_shift, count(*) filter (weight = 0)::bigint as dropped from wt"

LANGS = ["de", "en", "es", "fr"]


def partition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.partition_report(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), "source", "doc_id", "lang", LANGS)


REPORT_SQL = f"""with counts as ({_counts_sql("documents")}),
cells as (select c.client, k.class, coalesce(n, 0) as n from (select distinct client from counts) c cross join (select distinct class from counts) k left join counts using (client, class)),
d as (select client, sqrt(sum(pow(n::double / t - 1.0e0 / k, 2))) as d_k, count(*) filter (n > 0) as present from
  (select *, sum(n) over (partition by client) as t, (select count(distinct class) from counts) as k from cells) group by client)
select client, count(distinct doc_id)::bigint as n_units, count(*)::bigint as n_images, any_value(present)::bigint as n_classes_present, round(any_value(d_k), 4) as d_k,
  {", ".join(f"count(*) filter (lang = '{x}')::bigint as class_{x}" for x in LANGS)}
from documents join d on source = client group by client"""


def fedlc_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(skew.calibration(counts(spark, sf_dir, "events")), "tau")


CALIBRATION_SQL = f"with counts as ({_counts_sql('events')}) select class, sum(n)::bigint as total, round(pow(case when sum(n) = 0 then 1.0e0 else sum(n)::double end, -0.25e0), 6) as tau from counts group by 1"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client, n, vector: a client's model is the mean of its embeddings."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 8).cast("string").alias("client"), "embedding")
    sizes = e.groupBy("client").agg(F.count("*").alias("n"))
    return vectors.pack(vectors.average(e, "embedding", F.lit(1), "client"), "client").join(sizes, "client")


_MODELS_SQL = """m as (select cast(vec_id % 8 as varchar) as client, pos, avg(x::double) as x, count(*) as n from
  (select vec_id, unnest(embedding) as x, unnest(range(0, len(embedding))) as pos from embeddings) group by 1, 2)"""


def fedavg_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.average(_vectors(spark, sf_dir), "vector", F.col("n")), "x")


FEDAVG_SQL = f"with {_MODELS_SQL} select pos::int as pos, round(sum(n * x) / sum(n), 6) as x from m group by 1"


def fedavg_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.weighted_sum(_vectors(spark, sf_dir), "vector", F.col("n")), "x")


SUM_SQL = f"with {_MODELS_SQL} select pos::int as pos, round(sum(n * x), 6) as x from m group by 1"


def feddisco_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discounted sum; client 7 has no statistics and counts as unskewed."""
    c = counts(spark, sf_dir, "embeddings")
    known = skew.client_skew(c).where("client <> '7'")
    updates = vectors.with_skew(_vectors(spark, sf_dir), known)
    w = skew.feddisco_weights(updates.select("client", "n", "d_k"))
    return rounded(vectors.aggregate_with(updates, w, "vector"), "x")


FEDDISCO_SQL = f"""with {_MODELS_SQL}, counts as ({_counts_sql("embeddings")}),
cells as (select c.client, k.class, coalesce(n, 0) as n from (select distinct client from counts) c cross join (select distinct class from counts) k left join counts using (client, class)),
d as (select client, case when client = '7' then 0 else sqrt(sum(pow(n::double / t - 1.0e0 / k, 2))) end as d_k, any_value(t) as n from
  (select *, sum(n) over (partition by client) as t, (select count(distinct class) from counts) as k from cells) group by client),
s as (select client, n::double / sum(n) over () as p, greatest(n::double / sum(n) over () - 0.5e0 * d_k + 0.1e0, 0) as a from d),
w as (select client, case when sum(a) over () > 0 then a / sum(a) over () else p end as w from s)
select pos::int as pos, round(sum(w * x), 6) as x from m join w using (client) group by 1"""


def prox_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers are runs of 16 positions; the reference point is the average model."""
    v = _vectors(spark, sf_dir)
    cut = lambda d: d.withColumn("layer", F.floor(F.col("pos") / 16))
    local = cut(vectors.long_form(v, "vector", "client"))
    return rounded(vectors.proximal_term(local, cut(vectors.average(v, "vector", F.col("n"))), 0.1, "client"), "penalty")


PROX_SQL = f"""with {_MODELS_SQL}, g as (select pos, sum(n * x) / sum(n) as r from m group by 1),
l as (select client, pos // 16 as layer, sqrt(sum(pow(x - r, 2))) as norm from m join g using (pos) group by 1, 2)
select client, round(sum(norm) * 0.05e0, 6) as penalty from l group by 1"""


def delta_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return rounded(vectors.delta(vectors.long_form(v, "vector", "client"), vectors.average(v, "vector", F.col("n")), "client"), "x")


DELTA_SQL = f"with {_MODELS_SQL}, g as (select pos, sum(n * x) / sum(n) as r from m group by 1) select client, pos::int as pos, round(x - r, 6) as x from m join g using (pos)"


def flatten_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut into layers of 40 and 24, strung together and cut again."""
    v = vectors.long_form(_vectors(spark, sf_dir), "vector", "client")
    layers = v.withColumn("layer", (F.col("pos") >= 40).cast("int")).withColumn("size", F.when(F.col("layer") == 0, 40).otherwise(24)).withColumn("pos", F.when(F.col("layer") == 1, F.col("pos") - 40).otherwise(F.col("pos")))
    back = vectors.unflatten(vectors.flatten_layers(layers, "client"), layers.select("layer", "size").distinct(), "client")
    return rounded(back.select("client", "layer", F.col("pos").cast("long").alias("pos"), "x"), "x")


FLATTEN_SQL = f"with {_MODELS_SQL} select client, (pos >= 40)::int as layer, (case when pos >= 40 then pos - 40 else pos end)::bigint as pos, round(x, 6) as x from m"


def fixed_point_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return e.select("vec_id", "pos", fixedpoint.encode(F.col("x").cast("double")).cast("long").alias("k"))


FIXED_SQL = "select vec_id, pos::int as pos, round_even(x::double * 4503599627370496, 0)::bigint as k from (select vec_id, unnest(embedding) as x, unnest(range(0, len(embedding))) as pos from embeddings)"


def fixed_point_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact integer-weighted sum, read back as double."""
    v = vectors.long_form(_vectors(spark, sf_dir), "vector", "client").withColumn("x", F.round("x", 9))
    w = skew.integer_weights(skew.feddisco_weights(skew.client_skew(counts(spark, sf_dir, "embeddings"))))
    out = fixedpoint.integer_sum(fixedpoint.encode_vectors(v, "client"), w)
    return out.select("pos", F.round(fixedpoint.decode(F.col("total")) / float(1 << 24), 6).alias("x"))


FIXED_SUM_SQL = _weights_sql("embeddings", 0.5, 0.1) + f", {_MODELS_SQL} select pos::int as pos, round(sum(weight * x), 6) as x from m join wt using (client) group by 1"


def paillier_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sum under encryption, decrypted at the end."""
    keys = fixedpoint.Keys.make(256, seed=5)
    v = vectors.long_form(_vectors(spark, sf_dir), "vector", "client").withColumn("x", F.round("x", 9))
    w = skew.integer_weights(skew.feddisco_weights(skew.client_skew(counts(spark, sf_dir, "embeddings"))))
    cipher = fixedpoint.encrypted(fixedpoint.encode_vectors(v, "client"), keys.public)
    total = fixedpoint.decrypted(fixedpoint.encrypted_sum(cipher, w, keys.n), keys)
    return total.select("pos", F.round(fixedpoint.decode(F.col("total")) / float(1 << 24), 6).alias("x"))


PAILLIER_SQL = _weights_sql("embeddings", 0.5, 0.1) + f", {_MODELS_SQL} select pos::int as pos, round(sum(weight * x), 6) as x from m join wt using (client) group by 1"


def parameter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("layer"), F.col("embedding").alias("values"), (F.col("label") < 5).alias("moved"))
    return vectors.parameter_counts(e, "moved")


PARAMETERS_SQL = "select count(*)::bigint as layers, sum(len(embedding))::bigint as parameters, sum(case when label < 5 then len(embedding) else 0 end)::bigint as trainable from embeddings"

def client_skew_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve classes are declared, two of which nobody holds."""
    return rounded(skew.client_skew(counts(spark, sf_dir, "embeddings"), spark.range(12).toDF("class")), "d_k")


DECLARED_SQL = """with c as (select (vec_id % 8)::varchar as client, label, count(*) as n from embeddings group by 1, 2), s as (select client, sum(n) as n from c group by 1)
select s.client, s.n::bigint as n, round(sqrt(sum(pow(coalesce(c.n, 0) / s.n - 1e0 / 12, 2))), 6) as d_k from s cross join range(12) t(k) left join c on c.client = s.client and c.label = k group by 1, 2"""

_W = {
    "client_skew_feddisco": _feddisco("lineitem"),
    "client_skew_feddisco_fallback": _feddisco("documents"),
    "client_skew_events": _feddisco("events"),
    "client_skew_vectors": _feddisco("embeddings"),
    "feddisco_partial_drop": _feddisco("documents", 0.5, 0.2),
}
PAIRS = _W | {
    "dense_class_counts": (dense_class_counts, DENSE_SQL),
    "feddisco_integer_weights": (feddisco_integer_weights, INTEGER_SQL),
    "feddisco_diagnostics": (feddisco_diagnostics, DIAGNOSTICS_SQL),
    "partition_report": (partition_report, REPORT_SQL),
    "fedlc_calibration": (fedlc_calibration, CALIBRATION_SQL),
    "fedavg_vector": (fedavg_vector, FEDAVG_SQL),
    "fedavg_sum": (fedavg_sum, SUM_SQL),
    "feddisco_vector": (feddisco_vector, FEDDISCO_SQL),
    "prox_norm": (prox_norm, PROX_SQL),
    "delta_payload": (delta_payload, DELTA_SQL),
    "flatten_round_trip": (flatten_round_trip, FLATTEN_SQL),
    "fixed_point_encode": (fixed_point_encode, FIXED_SQL),
    "fixed_point_sum": (fixed_point_sum, FIXED_SUM_SQL),
    "paillier_sum": (paillier_sum, PAILLIER_SQL),
    "parameter_counts": (parameter_counts, PARAMETERS_SQL),
    "client_skew_declared": (client_skew_declared, DECLARED_SQL),
}
