"""Queries on moments, states, routing and metrics.

``embeddings`` under four affine conditions stand for corrupted batches: clean, contrast_s3 (halved), brightness_s1 (plus 0.1)
and gaussian_noise_s5 (alternating 0.3); a batch is 50 vectors in order of id.  Labels of nearest class centroids stand for predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import metrics, moments, routing

from .common import rounded, table

SIZE = 50
CONDITIONS = ["clean", "contrast_s3", "brightness_s1", "gaussian_noise_s5", "clean_again"]
BANK = ["clean", "contrast_s3", "gaussian_noise_s5"]


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, condition, vec_id, label, x: the stream in order, conditions one after the other, clean visited twice."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    plan = spark.createDataFrame(list(enumerate(CONDITIONS)), "visit int, condition string")
    v = F.col("v")
    x = (
        F.when(F.col("condition") == "contrast_s3", F.transform(v, lambda x: x * 0.5))
        .when(F.col("condition") == "brightness_s1", F.transform(v, lambda x: x + 0.1))
        .when(F.col("condition") == "gaussian_noise_s5", F.transform(v, lambda x, i: x + F.when(i % 2 == 0, 0.3).otherwise(-0.3)))
        .otherwise(v)
    )
    rows = e.crossJoin(F.broadcast(plan)).withColumn("x", x)
    return rows.select((F.col("visit") * 100_000 + F.floor(F.col("vec_id") / SIZE)).alias("seq"), "condition", "vec_id", "label", "x")


_CONDITIONS_SQL = ", ".join(f"({k}, '{c}')" for k, c in enumerate(CONDITIONS))
_STREAM = f"""pl(visit, condition) as (values {_CONDITIONS_SQL}),
el as (select vec_id, label, unnest(embedding)::double as v, unnest(range(0, len(embedding))) as ch from embeddings),
st as (select visit * 100000 + vec_id // {SIZE} as seq, condition, vec_id, label, ch, case condition when 'contrast_s3' then v * 0.5e0 when 'brightness_s1' then v + 0.1e0
  when 'gaussian_noise_s5' then v + case when ch % 2 = 0 then 0.3e0 else -0.3e0 end else v end as x from el cross join pl)"""
_DESC = "ds as (select seq, condition, ch, avg(x) as mean, greatest(avg(x * x) - avg(x) * avg(x), 0) as var from st group by 1, 2, 3)"
_BANK_SQL = ", ".join(f"({k}, '{c}')" for k, c in enumerate(BANK))
_BANK = f"bi(idx, label) as (values {_BANK_SQL}), bk as (select idx, bi.label, ch, avg(x) as mean, greatest(avg(x * x) - avg(x) * avg(x), 0) as var from st join bi on condition = bi.label group by 1, 2, 3)"
_KL = "sum((greatest(d.var, 1e-8) + pow(d.mean - b.mean, 2)) / (2 * greatest(b.var, 1e-8)) + (greatest(b.var, 1e-8) + pow(d.mean - b.mean, 2)) / (2 * greatest(d.var, 1e-8)) - 1)"
_DIST = f"di as (select seq, condition, idx, b.label, round({_KL}, 6) as distance from ds d join bk b using (ch) group by 1, 2, 3, 4)"
_ROUTE = """rt as (select seq, condition, min_by(idx, (distance, idx)) as idx, min_by(label, (distance, idx)) as label, min(distance) as distance,
  list_sort(list(distance))[2] - min(distance) as margin from di group by 1, 2)"""
_ALL = f"{_STREAM}, {_DESC}, {_BANK}, {_DIST}, {_ROUTE}"


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.channel_moments(stream(spark, sf_dir), "x", "seq", "condition")


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(list(enumerate(BANK)), "idx int, label string")
    per = moments.channel_moments(stream(spark, sf_dir), "x", "condition").withColumnRenamed("condition", "label")
    return per.join(F.broadcast(names), "label").select("idx", "label", "ch", "mean", "var")


def channel_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.channel_moments(table(spark, sf_dir, "embeddings"), "embedding", "label"), "mean", "var")


CHANNEL_SQL = """select label, ch::int as ch, count(*)::bigint as n, round(avg(x), 6) as mean, round(greatest(avg(x * x) - avg(x) * avg(x), 0), 6) as var from
  (select label, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as ch from embeddings) group by 1, 2"""


def federated_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("client", F.col("vec_id") % 8)
    return rounded(moments.federated_moments(moments.channel_moments(e, "embedding", "client")), "mean", "var")


FEDERATED_SQL = """select ch::int as ch, round(avg(x), 6) as mean, round(var_pop(x), 6) as var from
  (select unnest(embedding)::double as x, unnest(range(0, len(embedding))) as ch from embeddings) group by 1"""


def moment_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("batch", F.floor(F.col("vec_id") / SIZE))
    return moments.self_check(e, "embedding", "batch").groupBy("agree").count().withColumnRenamed("count", "channels")


def standardisation_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.scale(bank(spark, sf_dir)), "mean_scale", "var_scale")


SCALE_SQL = f"with {_STREAM}, {_BANK} select ch::int as ch, round(greatest(stddev_pop(mean), 1e-8), 6) as mean_scale, round(greatest(stddev_pop(var), 1e-8), 6) as var_scale from bk group by 1"


def _layers(state: DataFrame) -> DataFrame:
    return state.withColumn("layer", F.concat(F.lit("bn"), F.floor(F.col("ch") / 16)))


def state_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _layers(bank(spark, sf_dir))
    return rounded(moments.residual(b.where("label = 'gaussian_noise_s5'"), b.where("label = 'clean'")), "mean_shift", "var_ratio")


RESIDUAL_SQL = f"""with {_STREAM}, {_BANK}, j as (select a.ch, 'bn' || (a.ch // 16) as layer, abs(a.mean - c.mean) / sqrt(greatest(c.var, 1e-8)) as s,
  greatest(a.var, c.var, 1e-8) / greatest(least(a.var, c.var), 1e-8) - 1 as r from bk a join bk c on a.ch = c.ch and a.label = 'gaussian_noise_s5' and c.label = 'clean')
select round(max(s), 6) as mean_shift, max_by(layer, (s, -ch)) as mean_layer, round(max(r), 6) as var_ratio, max_by(layer, (r, -ch)) as var_layer from j"""


def blend_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bank(spark, sf_dir)
    return rounded(moments.blend(b.where("label = 'contrast_s3'"), b.where("label = 'clean'"), 0.25, ["ch"]), "mean", "var")


BLEND_SQL = f"""with {_STREAM}, {_BANK} select a.ch::int as ch, round(0.25e0 * a.mean + 0.75e0 * c.mean, 6) as mean, round(0.25e0 * a.var + 0.75e0 * c.var, 6) as var
from bk a join bk c on a.ch = c.ch and a.label = 'contrast_s3' and c.label = 'clean'"""


def descriptor_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers bn3 and bn1 of the clean state, in that order."""
    s = _layers(bank(spark, sf_dir).where("label = 'clean'")).withColumn("ch", (F.col("ch") % 16).cast("int"))
    s = moments.restrict(s.where(scalar.layer_matches(F.col("layer"), "bn1", "bn2", "bn3")), ["bn1", "bn3"])
    return rounded(moments.descriptor(s, ["bn3", "bn1"]).withColumn("ch", F.col("ch").cast("int")), "mean", "var")


LAYERS_SQL = f"""with {_STREAM}, {_BANK} select (case when ch >= 48 then ch - 48 else ch end)::int as ch, round(mean, 6) as mean, round(var, 6) as var from bk
where label = 'clean' and (ch // 16) in (1, 3)"""


def layer_order_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "nation").select(F.col("n_name").alias("layer"), F.col("n_nationkey").alias("ord"), "n_regionkey")
    return moments.order_conflicts(p.where("n_regionkey = 1"), p.where("n_regionkey = 2"))


CONFLICT_SQL = "select a.n_name as adapted, d.n_name as used from nation a join nation d on a.n_nationkey < d.n_nationkey and a.n_regionkey = 1 and d.n_regionkey = 2"


def sequential_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = moments.sequential_states(table(spark, sf_dir, "embeddings"), ["l0", "l1"], "embedding")
    return rounded(out.select("layer", "ch", "mean", "var"), "mean", "var")


SEQUENTIAL_SQL = """with el as (select vec_id, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as ch from embeddings),
m as (select ch, avg(x) as mean, greatest(avg(x * x) - avg(x) * avg(x), 0) as var from el group by 1),
n as (select ch, tanh((x - mean) / sqrt(var + 1e-5)) as x from el join m using (ch))
select 'l0' as layer, ch::int as ch, round(mean, 6) as mean, round(var, 6) as var from m union all
select 'l1', ch::int, round(avg(x), 6), round(greatest(avg(x * x) - avg(x) * avg(x), 0), 6) from n group by ch"""


def batch_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors standardised by their batch's own moments; returned as sums of squares by batch."""
    s = stream(spark, sf_dir)
    state = moments.channel_moments(s, "x", "seq").select("seq", "ch", "mean", "var")
    out = moments.normalise(s, state, "x", 1e-5, "seq").groupBy("seq").agg(F.sum(F.col("x") * F.col("x")).alias("energy"))
    return rounded(out, "energy", digits=4)


NORMALISE_SQL = f"""with {_STREAM}, {_DESC} select st.seq, round(sum(pow((x - mean) / sqrt(var + 1e-5), 2)), 4) as energy from st join ds using (seq, ch) group by 1"""


def _dist(spark: SparkSession, sf_dir: str, kind: str = "symmetric_kl", scales: bool = False) -> DataFrame:
    b = bank(spark, sf_dir)
    return rounded(routing.distances(descriptors(spark, sf_dir), b, kind, moments.scale(b) if scales else None, 1e-8, "seq", "condition"), "distance")


def kl_bank_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dist(spark, sf_dir)


def l2_bank_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dist(spark, sf_dir, "l2", True)


L2_SQL = f"""with {_STREAM}, {_DESC}, {_BANK}, sc as (select ch, greatest(stddev_pop(mean), 1e-8) as ms, greatest(stddev_pop(var), 1e-8) as vs from bk group by 1)
select seq, condition, idx, b.label, round(sqrt(sum(pow((d.mean - b.mean) / ms, 2) + pow((d.var - b.var) / vs, 2))), 6) as distance from ds d join bk b using (ch) join sc using (ch) group by 1, 2, 3, 4"""


def _routed(spark: SparkSession, sf_dir: str, threshold: float | None = None) -> DataFrame:
    return routing.route(_dist(spark, sf_dir), threshold, "seq", "condition")


def route_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_routed(spark, sf_dir), "margin").drop("fallback")


def _threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60th percentile of the distances of a bank condition's batches to its own entry."""
    return routing.threshold_of(_dist(spark, sf_dir).where("condition = label"), 60.0)


def intra_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_threshold(spark, sf_dir), "threshold")


_TH = "th as (select quantile_cont(distance, 0.6) as t from di where condition = label)"


def route_with_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_routed(spark, sf_dir, _threshold(spark, sf_dir).first()[0]), "margin")


REFUSAL_SQL = f"with {_ALL}, {_TH} select seq, condition, case when distance <= t then idx end as idx, case when distance <= t then label end as label, distance, round(margin, 6) as margin, distance > t as fallback from rt cross join th"


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _routed(spark, sf_dir, _threshold(spark, sf_dir).first()[0]).withColumn("one", F.lit(1))
    before = routing.lagged(routed, "one", "seq", "label", "fallback", "distance", "margin")
    name = F.regexp_replace("condition", "_again$", "")
    return routing.arms(before.select("seq", "condition", name.alias("corruption"), "prev_label", "prev_fallback", "prev_distance", "prev_margin"), BANK)


def four_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arms(spark, sf_dir).select("arm", "seq", "condition", "chosen", "fallback", "blind", "decided", "state_loaded")


_BANKED = ", ".join(f"'{b}'" for b in BANK)
_ARMS = f"""pv as (select seq, condition, regexp_replace(condition, '_again$', '') as corruption, lag(case when distance <= t then label end) over (order by seq) as pl,
  lag(distance > t) over (order by seq) as pf, lag(distance) over (order by seq) as pd, lag(margin) over (order by seq) as pm from rt cross join th),
ar as (select arm, seq, condition, corruption, pd, pm, case when arm = 'routed' and pd is not null then pl when arm = 'oracle' and corruption in ({_BANKED}) then corruption end as chosen,
  case when arm = 'routed' and pd is not null then pf when arm = 'oracle' then corruption not in ({_BANKED}) else false end as fallback,
  (arm = 'routed' and pd is not null) or arm = 'oracle' as decided from pv cross join (select unnest(['source', 'blind', 'routed', 'oracle']) as arm)),
a as (select *, arm = 'blind' or fallback as blind, chosen is not null and chosen is distinct from lag(chosen) over (partition by arm order by seq) as state_loaded from ar)"""
ARMS_SQL = f"with {_ALL}, {_TH}, {_ARMS} select arm, seq, condition, chosen, fallback, blind, decided, state_loaded from a"


def _report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _arms(spark, sf_dir).where("decided")
    return routing.report(a.withColumn("truth", F.when(F.col("corruption").isin(*BANK), F.col("corruption"))), "arm", "condition")


def routing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("fallback_rate", "hit_rate", "fallback_when_routable", "refusal_rate", "mean_distance", "mean_margin")
    return rounded(_report_rows(spark, sf_dir), *cols)


_REPORT = f"""rp as (select arm, condition, avg((chosen is null)::int) as fallback_rate, avg(coalesce(chosen = corruption, false)::int) filter (corruption in ({_BANKED})) as hit_rate,
  avg((chosen is null)::int) filter (corruption in ({_BANKED})) as fallback_when_routable, avg((chosen is null)::int) filter (corruption not in ({_BANKED})) as refusal_rate,
  avg(case when arm = 'routed' then pd end) as mean_distance, avg(case when arm = 'routed' then pm end) as mean_margin from a where decided group by 1, 2)"""
REPORT_SQL = f"""with {_ALL}, {_TH}, {_ARMS}, {_REPORT} select arm, condition, round(fallback_rate, 6) as fallback_rate, round(hit_rate, 6) as hit_rate, round(fallback_when_routable, 6) as fallback_when_routable,
  round(refusal_rate, 6) as refusal_rate, round(mean_distance, 6) as mean_distance, round(mean_margin, 6) as mean_margin from rp"""


def state_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arms(spark, sf_dir).groupBy("arm").agg(F.count_if("state_loaded").alias("loads"))


def bank_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.footprint(bank(spark, sf_dir))


def channel_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank with one entry cut short against whole batches."""
    b = bank(spark, sf_dir).where("label <> 'contrast_s3' or ch < 60")
    return routing.channel_mismatch(descriptors(spark, sf_dir), b)


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.channel_moments(table(spark, sf_dir, "embeddings"), "embedding", "label").select(F.col("label").alias("y_pred"), "ch", F.col("mean").alias("c"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """condition, vec_id, y_true, y_pred: the nearest class centroid (10 rows of 64, broadcast) under each condition."""
    long = stream(spark, sf_dir).select("seq", "condition", "vec_id", F.col("label").alias("y_true"), F.posexplode("x").alias("ch", "x"))
    return _nearest(long, _centroids(spark, sf_dir))


_PRED = f"""ce as (select label as y_pred, ch, avg(v) as c from el group by 1, 2),
pp as (select seq, condition, vec_id, label as y_true, y_pred, round(sum(pow(x - c, 2)), 9) as d from st join ce using (ch) group by 1, 2, 3, 4, 5),
pr as (select seq, condition, vec_id, y_true, min_by(y_pred, (d, y_pred)) as y_pred from pp group by 1, 2, 3, 4)"""


def _class_sql(source: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""pc as (select {k}label, sum(tp) as tp, sum(s) as s, sum(p) as p from (select {k}y_true as label, (y_true = y_pred)::int as tp, 1 as s, 0 as p from {source}
  union all select {k}y_pred, 0, 0, 1 from {source}) group by {k}label),
cm as (select {k}sum(s)::bigint as n_images, sum(tp)::bigint as correct, sum(tp) / sum(s) as accuracy, avg(2 * tp / (s + p)) as macro_f1, sum(2 * tp / (s + p) * s) / sum(s) as weighted_f1,
  sum(case when p > 0 then tp / p else 0 end * s) / sum(s) as weighted_precision, sum(case when s > 0 then tp / s else 0 end * s) / sum(s) as weighted_recall from pc {"group by " + keys if keys else ""})"""


_CM = ("accuracy", "macro_f1", "weighted_f1", "weighted_precision", "weighted_recall")


def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.classification(predictions(spark, sf_dir), "condition"), *_CM)


CLASS_SQL = f"with {_STREAM}, {_PRED}, {_class_sql('pr', 'condition')} select condition, n_images, correct, {', '.join(f'round({c}, 6) as {c}' for c in _CM)} from cm"


def quality_rule_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A length rule (texts of 500 characters or more) against the quality labels that there are."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") >= 500).cast("int").alias("y_pred"))
    rows = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y_true")), "doc_id")
    return rounded(metrics.classification(rows), *_CM)


QUALITY_SQL = f"with q as (select quality as y_true, (length(text) >= 500)::int as y_pred from documents join labels using (doc_id)), {_class_sql('q', '')} select n_images, correct, {', '.join(f'round({c}, 6) as {c}' for c in _CM)} from cm"


def _nearest(long: DataFrame, centroids: DataFrame) -> DataFrame:
    d = long.join(F.broadcast(centroids), "ch").groupBy("seq", "condition", "vec_id", "y_true", "y_pred").agg(F.round(F.sum(F.pow(F.col("x") - F.col("c"), F.lit(2.0))), 9).alias("d"))
    return d.groupBy("seq", "condition", "vec_id", "y_true").agg(F.min(F.struct("d", "y_pred")).alias("m")).select("seq", "condition", "vec_id", "y_true", F.col("m.y_pred").alias("y_pred"))


def blind_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model says of batches standardised by their own moments and put on the clean state's."""
    s = stream(spark, sf_dir)
    own = moments.channel_moments(s, "x", "seq").select("seq", "ch", "mean", "var")
    clean = bank(spark, sf_dir).where("label = 'clean'").select("ch", F.col("mean").alias("cm"), F.col("var").alias("cv"))
    unit = moments.normalise(s, own, "x", 1e-5, "seq", "condition", "vec_id", "label").join(F.broadcast(clean), "ch")
    long = unit.select("seq", "condition", "vec_id", F.col("label").alias("y_true"), "ch", (F.col("x") * F.sqrt(F.col("cv") + 1e-5) + F.col("cm")).alias("x"))
    return _nearest(long, _centroids(spark, sf_dir))


def _fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, condition rows: arm ``source`` as predicted, arm ``blind`` after adapting to the batch."""
    source = predictions(spark, sf_dir).withColumn("arm", F.lit("source"))
    return source.unionByName(blind_predictions(spark, sf_dir).withColumn("arm", F.lit("blind")))


_FACTS = """bx as (select st.seq, st.condition, st.vec_id, st.label as y_true, st.ch, (x - ds.mean) / sqrt(ds.var + 1e-5) * sqrt(k.var + 1e-5) + k.mean as x from st join ds on st.seq = ds.seq and st.ch = ds.ch
  join (select ch, mean, var from bk where label = 'clean') k on k.ch = st.ch),
bp as (select seq, condition, vec_id, y_true, y_pred, round(sum(pow(x - c, 2)), 9) as d from bx join ce using (ch) group by 1, 2, 3, 4, 5),
fr as (select 'source' as arm, * from pr union all select 'blind', seq, condition, vec_id, y_true, min_by(y_pred, (d, y_pred)) as y_pred from bp group by 1, 2, 3, 4, 5)"""


def _timed(rows: DataFrame) -> DataFrame:
    """Batch records: a deterministic number stands for the seconds that a batch took."""
    return rows.groupBy("arm", "condition", "seq").agg(F.count("*").alias("n_images"), ((F.col("seq") * 37) % 101 / 1000.0 + 0.01).alias("seconds"))


_TIMED = "tb as (select arm, condition, seq, count(*) as n_images, (seq * 37) % 101 / 1000.0e0 + 0.01e0 as seconds from fr group by 1, 2, 3)"


def condition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fact_rows(spark, sf_dir)
    rates = _report_rows(spark, sf_dir)
    out = metrics.condition_table(rows, _timed(rows), rates.withColumn("arm", F.when(F.col("arm") == "routed", "blind").otherwise(F.col("arm"))), ["contrast", "gaussian_noise", "clean"])
    cols = ("accuracy", "macro_f1", "weighted_f1", "accuracy_low", "accuracy_high", "effective_n", "retention", "ms_per_image", "fallback_rate", "hit_rate")
    return rounded(out, *cols)


_WILSON = """w as (select *, case when n_images >= 12630 then 421e0 else 421e0 * (1 - pow(1 - n_images / 12630e0, 30)) end as touched from cm),
w2 as (select *, greatest(1, n_images / (1 + (n_images / touched - 1))) as en from w),
w3 as (select *, 1.959963984540054e0 as z from w2),
wi as (select *, greatest(0, ((accuracy + z * z / (2 * en)) - z * sqrt(accuracy * (1 - accuracy) / en + z * z / (4 * en * en))) / (1 + z * z / en)) as lo,
  least(1, ((accuracy + z * z / (2 * en)) + z * sqrt(accuracy * (1 - accuracy) / en + z * z / (4 * en * en))) / (1 + z * z / en)) as hi from w3)"""
_NAMED = """nm as (select *, case when regexp_matches(b, '^(.+)_s([0-9]+)$') then regexp_extract(b, '^(.+)_s([0-9]+)$', 1) else b end as corruption,
  case when regexp_matches(b, '^(.+)_s([0-9]+)$') then regexp_extract(b, '^(.+)_s([0-9]+)$', 2)::int end as severity from (select *, regexp_replace(condition, '_again$', '') as b from wi)),
nf as (select *, case corruption when 'clean' then 'clean' when 'contrast' then 'digital' when 'brightness' then 'digital' when 'gaussian_noise' then 'noise' else 'other' end as family,
  corruption in ('contrast', 'gaussian_noise', 'clean') as seen from nm),
cl as (select arm, accuracy as clean from nf where condition = 'clean')"""
_LAT = "la as (select arm, condition, sum(seconds) / sum(n_images) * 1000 as ms_per_image, count(*)::bigint as num_batches from tb group by 1, 2)"
_TABLE = f"{_ALL}, {_TH}, {_ARMS}, {_REPORT}, {_PRED}, {_FACTS}, {_TIMED}, {_class_sql('fr', 'arm, condition')}, {_WILSON}, {_NAMED}, {_LAT}"
TABLE_SQL = f"""with {_TABLE} select nf.arm, nf.condition, n_images, correct, round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1, round(weighted_f1, 6) as weighted_f1, round(lo, 6) as accuracy_low,
  round(hi, 6) as accuracy_high, round(en, 6) as effective_n, corruption, severity, family, seen, round(accuracy / clean, 6) as retention, round(ms_per_image, 6) as ms_per_image, num_batches,
  round(fallback_rate, 6) as fallback_rate, round(hit_rate, 6) as hit_rate
from nf left join cl using (arm) left join la on la.arm = nf.arm and la.condition = nf.condition left join rp on (case when rp.arm = 'routed' then 'blind' else rp.arm end) = nf.arm and rp.condition = nf.condition"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.classification(_fact_rows(spark, sf_dir), "arm", "condition")
    return rows.withColumn("family", scalar.family_of(scalar.corruption_of(F.col("condition"))))


def family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.family_summary(_scored(spark, sf_dir)), "accuracy", "macro_f1")


_SCORED = f"{_STREAM}, {_DESC}, {_BANK}, {_PRED}, {_FACTS}, {_class_sql('fr', 'arm, condition')}, {_WILSON}, {_NAMED}"
FAMILY_SQL = f"""with {_SCORED} select arm, family, count(*)::bigint as num_conditions, sum(n_images)::bigint as n_images, sum(correct)::bigint as correct,
  round(sum(correct) / sum(n_images), 6) as accuracy, round(sum(macro_f1 * n_images) / sum(n_images), 6) as macro_f1 from nf group by 1, 2"""


def accuracy_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.arm_accuracy(_scored(spark, sf_dir)), "accuracy")


def arm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.arm_difference(_scored(spark, sf_dir), "blind", "source"), "difference", "half_width")


DIFFERENCE_SQL = f"""with {_SCORED} select a.condition, round(a.accuracy - b.accuracy, 6) as difference, round(a.z * sqrt(a.accuracy * (1 - a.accuracy) / a.en + b.accuracy * (1 - b.accuracy) / b.en), 6) as half_width,
  abs(a.accuracy - b.accuracy) > a.z * sqrt(a.accuracy * (1 - a.accuracy) / a.en + b.accuracy * (1 - b.accuracy) / b.en) as significant from nf a join nf b on a.condition = b.condition and a.arm = 'blind' and b.arm = 'source'"""


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("seq"), (F.col("value") / 1000).alias("seconds"), F.lit(128).alias("n_images"))
    cols = ("total_seconds", "mean_ms_per_batch", "median_ms_per_batch", "p95_ms_per_batch", "first_batch_ms", "ms_per_image")
    return rounded(metrics.latency(e, "event_type"), *cols)


LATENCY_SQL = """select event_type, count(*)::bigint as num_batches, round(sum(value / 1000), 6) as total_seconds, round(avg(value), 6) as mean_ms_per_batch, round(quantile_cont(value, 0.5), 6) as median_ms_per_batch,
  round(quantile_cont(value, 0.95), 6) as p95_ms_per_batch, round(min_by(value, event_id), 6) as first_batch_ms, round(sum(value) / (128 * count(*)), 6) as ms_per_image from events group by 1"""

def state_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers' states by each method of measuring; the layers carry the standard state (mean 0, variance 1)."""
    e = table(spark, sf_dir, "embeddings").withColumn("batch", F.floor(F.col("vec_id") / SIZE))
    stored = spark.range(64).select(F.explode(F.array(F.lit("l0"), F.lit("l1"))).alias("layer"), F.col("id").cast("int").alias("ch"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("var"))
    out = None
    for method in moments.METHODS:
        one = moments.collect_states(e, ["l0", "l1"], method, "embedding", stored).withColumn("method", F.lit(method))
        out = one if out is None else out.union(one)
    return rounded(out, "mean", "var")


METHODS_SQL = f"""with el as (select vec_id // {SIZE} as batch, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as ch from embeddings),
m as (select ch, avg(x) as mean, greatest(avg(x * x) - avg(x) * avg(x), 0) as var from el group by 1),
mb as (select batch, ch, avg(x) as mean, greatest(avg(x * x) - avg(x) * avg(x), 0) as var from el group by 1, 2),
n as (select 'as-is' as method, ch, tanh(x / sqrt(1 + 1e-5)) as x from el union all select 'batch-stats', el.ch, tanh((x - mean) / sqrt(var + 1e-5)) from el join mb on el.ch = mb.ch and el.batch = mb.batch
  union all select 'sequential', ch, tanh((x - mean) / sqrt(var + 1e-5)) from el join m using (ch))
select method, 'l0' as layer, ch::int as ch, round(mean, 6) as mean, round(var, 6) as var from m cross join (select unnest(['as-is', 'batch-stats', 'sequential']) as method) union all
select method, 'l1', ch::int, round(avg(x), 6), round(greatest(avg(x * x) - avg(x) * avg(x), 0), 6) from n group by method, ch"""


def bank_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each condition's first eight batches to its own entry, and the 95th percentile over them all."""
    s = stream(spark, sf_dir).where(F.col("condition").isin(*BANK)).withColumn("batch", F.col("seq") % 100_000)
    _, own = routing.build_bank(s, "x", 8)
    t = routing.threshold_of(own)
    return rounded(own.crossJoin(F.broadcast(t)), "distance", "threshold")


CALIBRATION_SQL = f"""with {_STREAM}, {_DESC}, {_BANK}, o as (select b.label, seq % 100000 as batch, {_KL} as distance from ds d join bk b on d.ch = b.ch and d.condition = b.label where seq % 100000 < 8 group by 1, 2)
select label, batch, round(distance, 6) as distance, round((select quantile_cont(distance, 0.95) from o), 6) as threshold from o"""


def stream_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over all planned conditions of severities 3 and 5."""
    names = [f"{c}_s{s}" for c in scalar.SEEN + scalar.UNSEEN for s in scalar.SEVERITIES] + ["clean"]
    return spark.createDataFrame(list(enumerate(routing.stream_order(names, [3, 5]))), "visit int, condition string")


ORDER_SQL = f"""with c as (select c || '_s' || s as condition from (select unnest([{", ".join(repr(c) for c in scalar.SEEN + scalar.UNSEEN)}]) as c) cross join (select unnest([3, 5]) as s)),
o as (select 0 as part, 'clean' as condition union all select 1, condition from c union all select 2, 'clean_again')
select (row_number() over (order by part, condition) - 1)::int as visit, condition from o"""


def visit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.visit_order(stream(spark, sf_dir))


def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients by vec_id mod 8, of which 7 holds no validation rows; the squared distance stands for the loss."""
    long = stream(spark, sf_dir).where("condition = 'clean'").select("seq", "condition", "vec_id", F.col("label").alias("y_true"), F.posexplode("x").alias("ch", "x"))
    near = _nearest(long, _centroids(spark, sf_dir)).withColumn("client", F.col("vec_id") % 8).where("client < 7").withColumn("loss", F.col("vec_id") / 100.0)
    out = metrics.validation(near, spark.range(8).toDF("client"))
    return rounded(out, "test_loss", "test_f1", "test_prec", "test_recall", "test_acc")


VALIDATION_SQL = f"""with {_STREAM}, {_PRED}, v as (select vec_id % 8 as client, y_true, y_pred, vec_id / 100e0 as loss from pr where condition = 'clean' and vec_id % 8 < 7), {_class_sql('v', 'client')},
ls as (select client, avg(loss) as l from v group by 1)
select k as client, coalesce(n_images, 0)::bigint as test_size, round(coalesce(l, 0), 6) as test_loss, round(coalesce(weighted_f1, 0), 6) as test_f1, round(coalesce(weighted_precision, 0), 6) as test_prec,
  round(coalesce(weighted_recall, 0), 6) as test_recall, round(coalesce(accuracy, 0), 6) as test_acc from range(8) t(k) left join cm on cm.client = k left join ls on ls.client = k"""

PAIRS = {
    "channel_moments": (channel_moments, CHANNEL_SQL),
    "federated_moments": (federated_moments, FEDERATED_SQL),
    "moment_self_check": (moment_self_check, "select true as agree, max(len(embedding))::bigint as channels from embeddings"),
    "standardisation_scale": (standardisation_scale, SCALE_SQL),
    "state_residual": (state_residual, RESIDUAL_SQL),
    "blend_states": (blend_states, BLEND_SQL),
    "descriptor_layers": (descriptor_layers, LAYERS_SQL),
    "layer_order_conflicts": (layer_order_conflicts, CONFLICT_SQL),
    "sequential_states": (sequential_states, SEQUENTIAL_SQL),
    "batch_normalise": (batch_normalise, NORMALISE_SQL),
    "kl_bank_distance": (kl_bank_distance, f"with {_STREAM}, {_DESC}, {_BANK}, {_DIST} select * from di"),
    "l2_bank_distance": (l2_bank_distance, L2_SQL),
    "route_batches": (route_batches, f"with {_ALL} select seq, condition, idx, label, distance, round(margin, 6) as margin from rt"),
    "intra_threshold": (intra_threshold, f"with {_ALL}, {_TH} select round(t, 6) as threshold from th"),
    "route_with_refusal": (route_with_refusal, REFUSAL_SQL),
    "four_arms": (four_arms, ARMS_SQL),
    "routing_report": (routing_report, REPORT_SQL),
    "state_loads": (state_loads, f"with {_ALL}, {_TH}, {_ARMS} select arm, count(*) filter (state_loaded)::bigint as loads from a group by 1"),
    "bank_footprint": (bank_footprint, f"select {len(BANK)}::bigint as states, max(len(embedding))::bigint as channels, max(len(embedding))::bigint * 8 as bytes_per_state, max(len(embedding))::bigint * {8 * len(BANK)} as bytes from embeddings"),
    "channel_mismatch": (channel_mismatch, "select 'contrast_s3' as label, 60::bigint as channels"),
    "classification_metrics": (classification_metrics, CLASS_SQL),
    "quality_rule_metrics": (quality_rule_metrics, QUALITY_SQL),
    "condition_table": (condition_table, TABLE_SQL),
    "family_summary": (family_summary, FAMILY_SQL),
    "accuracy_by_arm": (accuracy_by_arm, f"with {_SCORED} select arm, sum(n_images)::bigint as n_images, round(sum(correct) / sum(n_images), 6) as accuracy from nf group by 1"),
    "arm_difference": (arm_difference, DIFFERENCE_SQL),
    "latency_summary": (latency_summary, LATENCY_SQL),
    "state_methods": (state_methods, METHODS_SQL),
    "bank_calibration": (bank_calibration, CALIBRATION_SQL),
    "stream_order": (stream_order, ORDER_SQL),
    "visit_order": (visit_order, f"select visit, condition from (values {_CONDITIONS_SQL}) t(visit, condition)"),
    "validation_metrics": (validation_metrics, VALIDATION_SQL),
}
