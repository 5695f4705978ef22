"""Queries on rounds: days of ``events`` stand for rounds, users for clients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import rounds, rules, skew

from .common import rounded, table


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round, client, train_size, train_loss, ts: one row for each event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.dayofmonth("ts").alias("round"), F.col("user_id").alias("client"), (F.col("event_id") % 50 + 1).alias("train_size"), F.col("value").alias("train_loss"), "ts", "event_id")


_U = "u as (select extract(day from ts)::int as round, user_id as client, event_id % 50 + 1 as train_size, value as train_loss, ts, event_id from events)"


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round, test_size and metrics: order lines rolled up by month stand for evaluations."""
    o = table(spark, sf_dir, "orders")
    m = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    share = F.pmod(F.col("o_custkey"), F.lit(100)) / 100.0
    return o.select(
        m.alias("round"), (F.col("o_orderkey") % 20 + 1).alias("test_size"), (F.col("o_totalprice") / 1e5).alias("test_loss"), share.alias("test_f1"),
        (share * 0.9).alias("test_acc"), (share * 0.8).alias("test_prec"), (share * 0.7).alias("test_recall"),
    )


_E = """e as (select extract(year from o_orderdate)::int * 12 + extract(month from o_orderdate)::int as round, o_orderkey % 20 + 1 as test_size, o_totalprice / 1e5 as test_loss,
  (o_custkey % 100) / 100.0e0 as test_f1, (o_custkey % 100) / 100.0e0 * 0.9e0 as test_acc, (o_custkey % 100) / 100.0e0 * 0.8e0 as test_prec, (o_custkey % 100) / 100.0e0 * 0.7e0 as test_recall from orders)"""
_H = f"{_E}, h as (select round, sum(test_size)::bigint as test_size, {', '.join(f'round(sum({m} * test_size) / sum(test_size), 6) as {m}' for m in rounds.METRICS)} from e group by 1)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounds.eval_rollup(evals(spark, sf_dir)), *rounds.METRICS)


def best_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.best_round(history(spark, sf_dir))


def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.running_best(history(spark, sf_dir)).select("round", "test_f1", "best_so_far")


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = rounded(rounds.train_loss(updates(spark, sf_dir)), "train_loss", "train_loss_mean")
    return rounds.early_stop(h, "train_loss", 2).select("round", "train_loss", "worse", "stop")


_L = f"{_U}, l as (select round, round(sum(train_loss * train_size) / sum(train_size), 6) as train_loss, round(avg(train_loss), 6) as train_loss_mean from u group by 1)"
EARLY_SQL = f"""with {_L}, r as (select *, coalesce(train_loss > lag(train_loss) over (order by round), false) as rose from l),
g as (select *, sum(case when rose then 0 else 1 end) over (order by round) as run from r),
c as (select *, sum(case when rose then 1 else 0 end) over (partition by run order by round) as worse from g)
select round, train_loss, worse::bigint as worse, worse >= 2 and sum(case when worse >= 2 then 1 else 0 end) over (order by round) = 1 as stop from c"""


def train_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounds.train_loss(updates(spark, sf_dir)), "train_loss", "train_loss_mean")


def round_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days alternate between rules; FIPA warms up for 8 rounds."""
    r = updates(spark, sf_dir).groupBy("round").agg(F.sum("train_size").alias("total"))
    names = F.array(*map(F.lit, scalar.ALGORITHMS))
    r = r.withColumn("algorithm", F.element_at(names, (F.col("round") % 5 + 1).cast("int")))
    return rounds.open_rounds(r, 8, True).select("round", "algorithm", "rule", "total", "denominator", "snapshot")


ALGORITHM_SQL = f"""with {_U}, r as (select round, sum(train_size)::bigint as total from u group by 1),
a as (select *, (['FedAvg', 'FedProx', 'FedLC', 'FedDisco', 'FIPA'])[round % 5 + 1] as algorithm from r),
b as (select *, case when algorithm = 'FIPA' and round < 8 then 'FedAvg' else algorithm end as rule from a),
c as (select *, lag(rule) over (order by round) as pr, lag(total) over (order by round) as pt from b)
select round, algorithm, rule, total, case when pr is null then 0e0 when pr in ('FedAvg', 'FedProx', 'FedLC') then pt::double when pr = 'FedDisco' then 16777216e0 else 1e0 end as denominator, false as snapshot from c"""


def round_algorithm_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rounds in the clear: preconditioned ones need a snapshot, discounted ones no scale."""
    r = updates(spark, sf_dir).groupBy("round").agg(F.sum("train_size").alias("total"))
    names = F.array(*map(F.lit, scalar.ALGORITHMS))
    r = r.withColumn("algorithm", F.element_at(names, (F.col("round") % 5 + 1).cast("int")))
    return rounds.open_rounds(r, 8, False).select("round", "rule", "denominator", "snapshot")


PLAIN_SQL = f"""with {_U}, r as (select round, sum(train_size)::bigint as total from u group by 1),
a as (select *, (['FedAvg', 'FedProx', 'FedLC', 'FedDisco', 'FIPA'])[round % 5 + 1] as algorithm from r),
b as (select *, case when algorithm = 'FIPA' and round < 8 then 'FedAvg' else algorithm end as rule from a),
c as (select *, lag(rule) over (order by round) as pr, lag(total) over (order by round) as pt from b)
select round, rule, case when pr is null then 0e0 when pr in ('FedAvg', 'FedProx', 'FedLC') then pt::double else 1e0 end as denominator, rule = 'FIPA' as snapshot from c"""


def _training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).cast("int").alias("client"), "label", F.col("embedding").alias("vector"))
    return e, e.select("label", "vector")


def training_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of plain averaging from zero weights: four clients step, the rule aggregates, all vectors are scored."""
    rows, test = _training(spark, sf_dir)
    out = rules.run_rounds(rows, test, 10, {"aggregation_algorithm": "FedAvg", "rounds": 2, "learning_rate": 0.5}).table(spark)
    return rounded(out.select("round", "rule", "train_loss", "test_acc"), "train_loss", "test_acc")


TRAINING_SQL = """with el as (select vec_id, label, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as pos from embeddings), n as (select count(*) as n from embeddings),
t1 as (select k, pos, -0.5e0 * sum(x * (0.1e0 - (label = k)::int)) / any_value(n) as w from el cross join range(10) t(k) cross join n group by 1, 2),
z1 as (select vec_id, label, k, sum(w * x) as z from el join t1 using (pos) group by 1, 2, 3), p1 as (select *, exp(z) / sum(exp(z)) over (partition by vec_id) as p from z1),
g2 as (select k, pos, sum(x * (p - (el.label = k)::int)) / any_value(n) as g from el join p1 using (vec_id) cross join n group by 1, 2),
t2 as (select k, pos, w - 0.5e0 * g as w from t1 join g2 using (k, pos)), z2 as (select vec_id, label, k, sum(w * x) as z from el join t2 using (pos) group by 1, 2, 3)
select 0::bigint as round, 'FedAvg' as rule, round(ln(10e0), 6) as train_loss, round((select avg((best = label)::int) from (select label, max_by(k, z) as best from z1 group by vec_id, label)), 6) as test_acc
union all select 1, 'FedAvg', round((select avg(-ln(p)) from p1 where k = label), 6), round((select avg((best = label)::int) from (select label, max_by(k, z) as best from z2 group by vec_id, label)), 6)"""


def aggregation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round under every rule that works on sizes or skew, by name: the norm of the model that comes out."""
    rows, _ = _training(spark, sf_dir)
    updates_ = rules.local_updates(rows, np.zeros((10, 64)), 1.0)
    context = {"counts": skew.class_counts(rows, "client", "label")}
    out = None
    for name in ("FedAvg", "FedProx", "FedLC", "FedDisco"):
        one = rules.aggregate(name, updates_, context).agg(F.lit(name).alias("rule"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        out = one if out is None else out.union(one)
    return rounded(out, "norm")


RULES_SQL = """with el as (select vec_id % 4 as client, label, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as pos from embeddings),
c as (select vec_id % 4 as client, label, count(*) as n from embeddings group by 1, 2), s as (select client, sum(n) as n from c group by 1),
k as (select count(distinct label) as k from embeddings),
d as (select s.client, s.n, sqrt(sum(pow(coalesce(c.n, 0) / s.n - 1e0 / k, 2))) as d from s cross join (select distinct label from c) l cross join k left join c on c.client = s.client and c.label = l.label group by 1, 2),
w as (select client, n / sum(n) over () as a, greatest(n / sum(n) over () - 0.5e0 * d + 0.1e0, 0) as sc from d), ww as (select client, a, case when sum(sc) over () > 0 then sc / sum(sc) over () else a end as b from w),
u as (select client, k, pos, -sum(x * (0.1e0 - (label = k)::int)) / any_value(s.n) as v from el join s using (client) cross join range(10) t(k) group by 1, 2, 3),
m as (select k, pos, sum(a * v) as x, sum(b * v) as y from u join ww using (client) group by 1, 2)
select unnest(['FedAvg', 'FedProx', 'FedLC', 'FedDisco']) as rule, round(unnest([sqrt(sum(x * x)), sqrt(sum(x * x)), sqrt(sum(x * x)), sqrt(sum(y * y))]), 6) as norm from m"""


def payload_descale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(scalar.descale(F.transform("embedding", lambda x: x.cast("double")), (F.col("vec_id") % 3).cast("double"))).alias("x"), scalar.payload_guard(F.lit(None).cast("string"), "weights").alias("kind"))
    return rounded(e.groupBy("vec_id", "kind").agg(F.sum("x").alias("x")), "x")


DESCALE_SQL = "select vec_id, 'weights' as kind, round(sum(case when vec_id % 3 > 0 then x::double / (vec_id % 3) else x::double end), 6) as x from (select vec_id, unnest(embedding) as x from embeddings) group by 1"


def late_updates_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as rounds; a report takes 0, 6, 12, 18 or 24 hours to arrive, and one that arrives on another day finds its round closed."""
    arrival = F.col("ts") + F.expr("make_dt_interval(0, cast(event_id % 5 * 6 as int))")
    u = updates(spark, sf_dir).withColumn("current_round", F.dayofmonth(arrival))
    return rounds.drop_late(u).groupBy("round").agg(F.count("*").alias("kept"), F.sum("train_size").alias("train_size"))


LATE_SQL = f"with {_U} select round, count(*)::bigint as kept, sum(train_size)::bigint as train_size from u where extract(day from ts + to_hours(event_id % 5 * 6)) = round group by 1"


def latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    return rounds.latest_per_key(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


SESSION_SQL = "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"


def round_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training halves (days) joined with evaluation halves (customers mod 40) of a round, either possibly missing."""
    ev = evals(spark, sf_dir).withColumn("round", (F.col("test_size") * 2).cast("int"))
    both = rounds.joined_history(rounds.train_loss(updates(spark, sf_dir)), rounds.eval_rollup(ev))
    return rounded(both.select("round", "train_loss", "test_f1", "test_size"), "train_loss", "test_f1")


HISTORY_SQL = f"""with {_U}, {_E}, l as (select round, sum(train_loss * train_size) / sum(train_size) as train_loss from u group by 1),
h as (select (test_size * 2)::int as round, sum(test_size)::bigint as test_size, sum(test_f1 * test_size) / sum(test_size) as test_f1 from e group by 1)
select round, round(train_loss, 6) as train_loss, round(test_f1, 6) as test_f1, test_size from l full join h using (round)"""


def client_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.partition import sample_clients

    from .common import mixed

    return sample_clients(table(spark, sf_dir, "events").select("user_id").distinct(), 0.3, mixed("user_id"), 2)


SAMPLE_SQL = "select user_id from (select user_id, row_number() over (order by (user_id * 7919) % 10007, user_id) as r, count(*) over () as n from (select distinct user_id from events)) where r <= floor(0.3e0 * n)"

PAIRS = {
    "train_loss": (train_loss, f"with {_L} select round, train_loss, train_loss_mean from l"),
    "eval_rollup": (history, f"with {_H} select * from h"),
    "best_round": (best_round, f"with {_H} select * from h where test_f1 > 0 order by test_f1 desc, round limit 1"),
    "running_best": (running_best, f"with {_H} select round, test_f1, max(test_f1) over (order by round) as best_so_far from h"),
    "early_stop": (early_stop, EARLY_SQL),
    "round_algorithm": (round_algorithm, ALGORITHM_SQL),
    "round_algorithm_plain": (round_algorithm_plain, PLAIN_SQL),
    "training_rounds": (training_rounds, TRAINING_SQL),
    "aggregation_rules": (aggregation_rules, RULES_SQL),
    "payload_descale": (payload_descale, DESCALE_SQL),
    "late_updates_dropped": (late_updates_dropped, LATE_SQL),
    "latest_session": (latest_session, SESSION_SQL),
    "round_history": (round_history, HISTORY_SQL),
    "client_sample": (client_sample, SAMPLE_SQL),
}
