"""Queries on class maps, partitions, samples, names and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import corruptions, grid, partition
from tidemark.sources import files

from .common import MIXED, SPAN, mixed, rounded, table


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("dir"), "p_partkey", "p_name")


_MAP = """b as (select distinct p_brand as dir from part), n as (select dir, try_cast(nullif(regexp_extract(dir, '([0-9]+)', 1), '') as bigint) as d from b),
cm as (select dir, case when (select count(*) = count(d) and count(d) = count(distinct d) from n) then d else row_number() over (order by dir) - 1 end::bigint as class_id from n)"""


def canonical_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.class_map(_brands(spark, sf_dir))


def canonical_classes_alphabetical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without digits: ranks."""
    return files.class_map(table(spark, sf_dir, "nation").select(F.col("n_name").alias("dir")).select(F.regexp_replace("dir", "[0-9]", "").alias("dir")))


ALPHA_SQL = """with b as (select distinct regexp_replace(n_name, '[0-9]', '', 'g') as dir from nation) select dir, (row_number() over (order by dir) - 1)::bigint as class_id from b"""


def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _brands(spark, sf_dir)
    once = files.relabel(b, files.class_map(b))
    return files.relabel(once, files.class_map(b)).groupBy("class_id").agg(F.count("*").alias("n"))


def missing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _brands(spark, sf_dir)
    return files.missing_classes(b.where("dir <> 'Brand#11'"), b)


def class_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by flag: complete against the line table's own flags; then the split's totals."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dir"))
    counts = files.require_complete(li, li.distinct()).groupBy("dir").agg(F.count("*").alias("n"))
    return files.verify_split(counts, 60000)


GUARD_SQL = "with c as (select l_returnflag, count(*) as n from lineitem group by 1) select count(*)::bigint as classes, sum(n)::bigint as images, count(*) filter (n = 0)::bigint as empty, sum(n) = 60000 and count(*) filter (n = 0) = 0 as complete from c"


def class_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("dir"), F.col("n_name").alias("filename"))
    return files.class_index(rows).select("dir", F.array_join("files", ",").alias("files"))


def loader_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return partition.batches(o, mixed("o_orderkey"), 32, "o_orderstatus", span=SPAN).groupBy("o_orderstatus", "batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


LOADER_SQL = f"""with r as (select o_orderstatus, o_orderkey, (row_number() over (partition by o_orderstatus order by {MIXED.format("o_orderkey")}) - 1) // 32 as batch from orders)
select o_orderstatus, batch::bigint as batch, count(*)::bigint as n, min(o_orderkey) as first from r group by 1, 2"""


def stratified_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return partition.stratified_kfold(o, "o_orderpriority", 7, mixed("o_orderkey"), SPAN)


KFOLD_SQL = f"select o_orderkey, o_orderpriority, ((row_number() over (partition by o_orderpriority order by {MIXED.format('o_orderkey')}) - 1) % 7)::int as client from orders"


def partition_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.units(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey"), "l_returnflag", "l_orderkey")


UNITS_SQL = "select l_returnflag as label, l_orderkey as track, count(*)::bigint as n, (dense_rank() over (order by l_returnflag, l_orderkey) - 1)::bigint as unit from lineitem group by 1, 2"


def cap_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.cap_units(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", 100, mixed("o_orderkey"), SPAN)


CAP_SQL = f"select o_orderkey, o_orderpriority from orders qualify row_number() over (partition by o_orderpriority order by {MIXED.format('o_orderkey')}) <= 100"

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_DRAW = [(c, k, round(p, 9)) for c, k, p in partition.draw_proportions(_PRIORITIES, 4, 0.5, 42)]


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return partition.dirichlet_assign(o, "o_orderpriority", spark.createDataFrame(_DRAW, "o_orderpriority string, client int, p double"), mixed("o_orderkey"), SPAN)


_ASSIGN = f"""dr(pri, client, p) as (values {", ".join(f"('{c}', {k}, {p!r}::double)" for c, k, p in _DRAW)}),
cu as (select pri, client, case when client = 3 then n else floor(sum(p) over (partition by pri order by client) * n) end as hi from dr join (select o_orderpriority as pri, count(*) as n from orders group by 1) using (pri)),
cv as (select *, coalesce(lag(hi) over (partition by pri order by client), 0) as lo from cu),
rk as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by {MIXED.format("o_orderkey")}) - 1 as r from orders),
asg as (select o_orderkey, o_orderpriority, client::int as client from rk join cv on o_orderpriority = pri and r >= lo and r < hi)"""


def dirichlet_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.conservation(_assigned(spark, sf_dir), "o_orderkey")


def dirichlet_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn shares, not injected: rows and split units are what any draw must give."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return partition.conservation(partition.dirichlet_partition(o, "o_orderpriority", "o_orderkey", 4, 0.5), "o_orderkey")


def train_valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return partition.train_valid(d, "source", "lang", "doc_id", 0.1, mixed("doc_id"), SPAN)


def _alloc_sql(counts: str) -> str:
    """``counts`` names a relation (key, class, n, size)."""
    return f"""al as (select *, sum(n) over (partition by key) as t from {counts}), ax as (select *, size::double * n / t as x from al),
ab as (select *, least(n, greatest(1, floor(x)::bigint)) as a from ax), ac as (select *, size - sum(a) over (partition by key) as rest from ab),
ad as (select *, row_number() over (partition by key order by (a < n) desc, x - floor(x) desc, class) as up, row_number() over (partition by key order by (a > 1) desc, a desc, class) as down from ac),
alloc as (select key, class, n, size, case when size >= t then n else a + case when rest > 0 and a < n and up <= rest then 1 when rest < 0 and a > 1 and down <= -rest then -1 else 0 end end::bigint as alloc from ad)"""


SPLIT_SQL = f"""with pc as (select source, lang, count(*) as m from documents group by 1, 2), fc as (select source, sum(m) as n, min(m) as least, count(*) as k, ceil(sum(m) * 0.1e0)::bigint as quota from pc group by 1),
ct as (select pc.source as key, lang as class, m as n, quota as size from pc join fc using (source)), {_alloc_sql("ct")},
rk as (select doc_id, source, lang, row_number() over (partition by source, lang order by {MIXED.format("doc_id")}) as rc, row_number() over (partition by source order by {MIXED.format("doc_id")}) as ra from documents)
select doc_id, rk.source, lang, case when (case when fc.n >= 10 and least >= 2 and quota >= k then rc <= alloc else ra <= quota end) then 'valid' else 'train' end as split
from rk join fc on rk.source = fc.source join alloc on key = rk.source and class = lang"""


def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's share of its nations' customers: sizes of 5, 50 and 500, a small one forcing the claw-back."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    sizes = spark.createDataFrame([(5,), (30,), (50,), (500,), (5000,)], "key int")
    return partition.allocate(c.crossJoin(sizes).select("key", F.col("c_nationkey").alias("class"), "n", F.col("key").alias("size")))


REMAINDER_SQL = f"""with c as (select c_nationkey as class, count(*) as n from customer group by 1), k as (select key::int as key, class, n, key::int as size from c cross join (select unnest([5, 30, 50, 500, 5000]) as key)),
{_alloc_sql("k")} select key, class, n::bigint as n, size, alloc from alloc"""


def stratified_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.stratified_subsample(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", 200, mixed("p_partkey"), SPAN)


SUBSAMPLE_SQL = f"""with c as (select 0 as key, p_brand as class, count(*) as n, 200 as size from part group by 2), {_alloc_sql("c")}
select p_partkey, p_brand from part join alloc on class = p_brand qualify row_number() over (partition by p_brand order by {MIXED.format("p_partkey")}) <= any_value(alloc) over (partition by p_brand)"""


def condition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.conditions(spark, list(scalar.SEEN + scalar.UNSEEN), list(scalar.SEVERITIES))


PLAN_SQL = f"select c as corruption, s::int as severity, c || '_s' || s as condition from (select unnest([{', '.join(repr(c) for c in scalar.SEEN + scalar.UNSEEN)}]) as c) cross join (select unnest([1, 3, 5]) as s)"


def corrupted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, sums of squares and sums weighted by position of every vector under each corruption at each severity."""
    plan = partition.conditions(spark, sorted(set(scalar.FAMILIES) - {"clean"}), [1, 3, 5])
    rows = corruptions.corrupt(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", plan, "vec_id")
    long = rows.select("vec_id", "condition", F.posexplode("x").alias("i", "x"))
    # a little more, as sums of values on a grid may fall on a rounding edge
    sums = [(F.sum(c) + 1e-7).alias(n) for n, c in (("s1", F.col("x")), ("s2", F.col("x") * F.col("x")), ("s3", F.col("x") * F.col("i")))]
    return rounded(long.groupBy("vec_id", "condition").agg(*sums), "s1", "s2", "s3", digits=5)


_AT = "list_extract(e, (greatest(0, least(63, {0})) + 1)::int)"
_KERNELS = {
    "gaussian_noise": "x + u * s * 0.05e0", "shot_noise": "x + u * sqrt(abs(x)) * s * 0.06e0", "impulse_noise": "case when q < s then case when u < 0 then -1e0 else 1e0 end else x end",
    "speckle_noise": "x + x * u * s * 0.1e0", "defocus_blur": f"list_sum(list_transform(range(-s, s + 1), lambda k: {_AT.format('i + k')})) / (2 * s + 1)",
    "gaussian_blur": f"x + (s / 5e0) * (({_AT.format('i - 1')} + 2 * x + {_AT.format('i + 1')}) / 4 - x)", "glass_blur": _AT.format("i + m % (2 * s + 1) - s"),
    "motion_blur": f"list_sum(list_transform(range(0, s + 1), lambda k: {_AT.format('i + k')})) / (s + 1)", "zoom_blur": f"(x + {_AT.format('floor(i / (1 + s * 0.1e0))')} + {_AT.format('floor(i / (1 + s * 0.2e0))')}) / 3",
    "snow": "case when q < 2 * s then x + 0.5e0 else x end", "frost": "x * (1 - s * 0.1e0) + case when i % 5 = 0 then s * 0.1e0 else 0 end", "fog": "x * (1 - s * 0.1e0) + s * 0.1e0",
    "spatter": "case when q < s then 0e0 else x end", "brightness": "x + s * 0.1e0", "contrast": "mean + (x - mean) / (1 + s * 0.5e0)",
    "elastic_transform": _AT.format("i + case when (i // 8) % 2 = 0 then s else -s end"), "pixelate": "round_even(x * (10e0 / s), 0) / (10e0 / s)",
    "jpeg_compression": "round_even(x * (40e0 / s), 0) / (40e0 / s) + case when i % 8 = 0 then s * 0.01e0 else 0 end", "saturate": "greatest(-1e0, least(1e0, x * (1 + s * 0.2e0)))",
}
CORRUPT_SQL = f"""with w as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
l as (select vec_id, e, list_avg(e) as mean, unnest(e) as x, unnest(range(0, 64)) as i from w),
p as (select c, s::int as s from (select unnest([{", ".join(repr(k) for k in _KERNELS)}]) as c) cross join (select unnest([1, 3, 5]) as s)),
m as (select *, (vec_id * 7919 + i * 10459 + s * 1013) % 2001 as m from l cross join p), q as (select *, m % 20 as q, (m - 1000) / 1000e0 as u from m),
y as (select vec_id, i, c || '_s' || s as condition, case c {" ".join(f"when '{k}' then {v}" for k, v in _KERNELS.items())} end as y from q)
select vec_id, condition, round(sum(y) + 1e-7, 5) as s1, round(sum(y * y) + 1e-7, 5) as s2, round(sum(y * i) + 1e-7, 5) as s3 from y group by 1, 2"""


def unit_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines that each client holds when whole orders are dealt to four clients."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    members = li.groupBy(F.col("l_orderkey").alias("unit")).agg(F.collect_list(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("positions"))
    assigned = li.select(F.col("l_orderkey").alias("unit"), (F.col("l_orderkey") % 4).cast("int").alias("client")).distinct()
    return partition.positions_of(assigned, members)


def split_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both strategies by configuration: rows dealt, tracks on more than one client, clients with rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    out = None
    for strategy, split_ok in (("stratified", False), ("dirichlet", True)):
        config = {"num_clients": 3, "partition_strategy": strategy, "dirichlet_alpha": 5.0}
        one = partition.split_by(config, rows, "l_returnflag", "l_orderkey", "line")
        per = one.groupBy("l_returnflag", "l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("client").alias("c"), F.max("client").alias("m"))
        one = per.agg(F.lit(strategy).alias("strategy"), F.sum("n").alias("rows"), F.max(F.when(F.lit(split_ok), F.col("c"))).alias("clients_a_track"), (F.max("m") + 1).alias("clients"))
        out = one if out is None else out.union(one)
    return out


STRATEGY_SQL = """select s as strategy, count(*)::bigint as rows, case s when 'dirichlet' then 1::bigint end as clients_a_track, 3 as clients
from lineitem cross join (select unnest(['stratified', 'dirichlet']) as s) group by 1"""


def track_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines named like frames of a track, plus names without a tail."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lpad(F.col("l_orderkey").cast("string"), 5, "0"), F.lit("_"), F.lpad(F.col("l_linenumber").cast("string"), 5, "0"), F.lit(".png")).alias("name"))
    names = li.union(table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(".jpg"))))
    return names.groupBy(scalar.track_of(F.col("name")).alias("track")).agg(F.count("*").alias("frames"))


TRACK_SQL = """with n as (select lpad(l_orderkey::varchar, greatest(5, 5), '0') || '_' || lpad(l_linenumber::varchar, 5, '0') || '.png' as name from lineitem union all select p_brand || '.jpg' from part),
s as (select regexp_replace(name, '\\.[^./]*$', '') as stem from n)
select case when regexp_matches(stem, '^(.+)_[0-9]+$') then regexp_extract(stem, '^(.+)_[0-9]+$', 1) else stem end as track, count(*)::bigint as frames from s group by 1"""


def condition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of the plan, its second visit, and names without severity."""
    names = condition_plan(spark, sf_dir).select("condition")
    both = names.union(names.select(F.concat("condition", F.lit("_again")))).union(spark.createDataFrame([("clean",), ("clean_again",), ("odd_sx",)], "condition string"))
    c = F.col("condition")
    name = scalar.corruption_of(c)
    return both.select(c, name.alias("corruption"), scalar.severity_of(c).alias("severity"), scalar.family_of(name).alias("family"), name.isin(*scalar.SEEN).alias("seen"))


_FAMILY = " ".join(f"when '{c}' then '{f}'" for c, f in scalar.FAMILIES.items())
PARSE_SQL = f"""with p as ({PLAN_SQL}), a as (select condition from p union all select condition || '_again' from p union all select unnest(['clean', 'clean_again', 'odd_sx'])),
b as (select condition, regexp_replace(condition, '_again$', '') as b from a),
c as (select condition, case when regexp_matches(b, '^(.+)_s([0-9]+)$') then regexp_extract(b, '^(.+)_s([0-9]+)$', 1) else b end as corruption,
  case when regexp_matches(b, '^(.+)_s([0-9]+)$') then regexp_extract(b, '^(.+)_s([0-9]+)$', 2)::int end as severity from b)
select condition, corruption, severity, case corruption {_FAMILY} else 'other' end as family, corruption in ({", ".join(repr(c) for c in scalar.SEEN)}) as seen from c"""


def effective_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per nation as image counts, and the share with a positive balance as accuracy."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.avg((F.col("c_acctbal") > 0).cast("double")).alias("accuracy"))
    low, high = scalar.accuracy_interval(F.col("accuracy"), F.col("n"))
    out = c.select("c_nationkey", "n", "accuracy", scalar.effective_sample_size(F.col("n")).alias("effective_n"), low.alias("low"), high.alias("high"), scalar.retention(F.col("accuracy"), F.lit(0.9)).alias("retention"), scalar.estimated_bytes(F.col("n"), F.lit(64)).alias("bytes"))
    return rounded(out, "accuracy", "effective_n", "low", "high", "retention", "bytes")


EFFECTIVE_SQL = """with c as (select c_nationkey, count(*) as n, avg((c_acctbal > 0)::int) as p from customer group by 1), e as (select *, greatest(1, n / (1 + (n / (421e0 * (1 - pow(1 - n / 12630e0, 30))) - 1))) as en, 1.959963984540054e0 as z from c)
select c_nationkey, n::bigint as n, round(p, 6) as accuracy, round(en, 6) as effective_n, round(greatest(0, ((p + z * z / (2 * en)) - z * sqrt(p * (1 - p) / en + z * z / (4 * en * en))) / (1 + z * z / en)), 6) as low,
  round(least(1, ((p + z * z / (2 * en)) + z * sqrt(p * (1 - p) / en + z * z / (4 * en * en))) / (1 + z * z / en)), 6) as high, round(p / 0.9e0, 6) as retention, round(n * 17300e0 * 0.25e0, 6) as bytes from e"""


def name_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a trailing number: base plus number; checkpoint-safe stems beside them."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("client "), F.col("p_partkey")).alias("name"))
    return p.select("p_partkey", scalar.shuffle_seed(F.col("name"), 42).alias("seed"), scalar.file_stem(F.col("name")).alias("stem"))


SEED_SQL = "select p_partkey, (42 + p_partkey) % 2147483648 as seed, regexp_replace('client ' || p_partkey, '[^A-Za-z0-9._-]', '-', 'g') as stem from part"

_COMMON = {"aggregation_algorithm": ["FedAvg", "FedDisco", "FIPA"], "partition_strategy": ["stratified", "dirichlet"], "dirichlet_alpha": [0.1, 0.5], "fipa_rank": [5, 20], "feddisco_a": [0.5]}
_SPECIFIC = {"resnet18": {"fipa_rank": [5]}, "convnet": {}}
_EXECUTED = [{"model_name": "resnet18", "aggregation_algorithm": "FedAvg", "partition_strategy": "stratified"}, {"model_name": "convnet", "aggregation_algorithm": "FIPA", "partition_strategy": "dirichlet", "dirichlet_alpha": "0.5", "fipa_rank": "20"}]
_KEYS = ("aggregation_algorithm", "dirichlet_alpha", "feddisco_a", "fipa_rank", "model_name", "partition_strategy")


def _grid(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    done = spark.createDataFrame([(k, c) for k, c in enumerate(_EXECUTED)], "ord long, params map<string,string>")
    return grid.expand(spark, _COMMON, _SPECIFIC), done


_PAIRS = lambda p: [F.try_element_at(p, F.lit(k)).alias(k) for k in _KEYS]


def grid_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark)[0].select(*_PAIRS("params"))


def _list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_EXPAND = f"""ex as (select m as model_name, a as aggregation_algorithm, s as partition_strategy, d as dirichlet_alpha, r as fipa_rank, '0.5' as feddisco_a
from (select unnest({_list(_COMMON["aggregation_algorithm"])}) as a) cross join (select unnest({_list(_COMMON["partition_strategy"])}) as s) cross join (select unnest({_list(_COMMON["dirichlet_alpha"])}) as d)
cross join (select 'resnet18' as m, '5' as r union all select 'convnet', '5' union all select 'convnet', '20'))"""
_NORMAL = """select model_name, aggregation_algorithm, partition_strategy, case when partition_strategy = 'dirichlet' then coalesce(dirichlet_alpha, '0.5') else '-1.0' end as dirichlet_alpha,
case when aggregation_algorithm = 'FIPA' then coalesce(fipa_rank, '5') else '-1' end as fipa_rank, case when aggregation_algorithm = 'FedDisco' then coalesce(feddisco_a, '0.5') else '-1.0' end as feddisco_a"""
_DONE = """do_(model_name, aggregation_algorithm, partition_strategy, dirichlet_alpha, fipa_rank, feddisco_a) as (values ('resnet18', 'FedAvg', 'stratified', null, null, null), ('convnet', 'FIPA', 'dirichlet', '0.5', '20', null))"""


def config_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.normalise(_grid(spark)[0]).select(*_PAIRS("params"))


def grid_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.new_configs(*_grid(spark)).select(*_PAIRS("params"))


def grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_counts(*_grid(spark))


def results_schema_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as old rows, suppliers as new rows with other columns."""
    old = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return grid.merge_results(old, new)


MERGE_SQL = "select c_name as name, c_acctbal as balance, c_mktsegment as segment, null::int as nation from customer union all select s_name, s_acctbal, null, s_nationkey from supplier"


def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who ordered in the last year but not in the year before, or the other way round."""
    o = table(spark, sf_dir, "orders")
    last = o.agg(F.max(F.year("o_orderdate")).alias("y")).first()["y"]
    year = lambda y: o.where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("customer")).distinct()
    return grid.symmetric_difference(year(last), year(last - 1), "customer")


DIFF_SQL = """with y as (select max(extract(year from o_orderdate)) as y from orders), a as (select distinct o_custkey as customer from orders, y where extract(year from o_orderdate) = y),
b as (select distinct o_custkey as customer from orders, y where extract(year from o_orderdate) = y - 1) (select * from a except select * from b) union (select * from b except select * from a)"""


def grid_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs the extra keys tell apart: sizes of the groups of equal fingerprints."""
    return grid.fingerprint(grid.normalise(_grid(spark)[0]), grid.EXTRA_KEYS).groupBy("fingerprint").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))


def results_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.results_tail(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5)


PAIRS = {
    "canonical_classes": (canonical_classes, f"with {_MAP} select dir, class_id from cm"),
    "canonical_classes_alphabetical": (canonical_classes_alphabetical, ALPHA_SQL),
    "relabelled": (relabelled, f"with {_MAP} select class_id, count(*)::bigint as n from part join cm on dir = p_brand group by 1"),
    "missing_classes": (missing_classes, "select distinct p_brand as dir from part where p_brand = 'Brand#11'"),
    "class_guard": (class_guard, GUARD_SQL),
    "class_index": (class_index, "select n_regionkey as dir, string_agg(n_name, ',' order by n_name) as files from nation group by 1"),
    "loader_batches": (loader_batches, LOADER_SQL),
    "stratified_kfold": (stratified_kfold, KFOLD_SQL),
    "partition_units": (partition_units, UNITS_SQL),
    "cap_units": (cap_units, CAP_SQL),
    "dirichlet_assign": (_assigned, f"with {_ASSIGN} select * from asg"),
    "dirichlet_conservation": (dirichlet_conservation, "select count(*)::bigint as rows, count(distinct o_orderkey)::bigint as units, 0::bigint as split_units from orders"),
    "dirichlet_partition": (dirichlet_partition, "select count(*)::bigint as rows, count(distinct o_orderkey)::bigint as units, 0::bigint as split_units from orders"),
    "train_valid_split": (train_valid_split, SPLIT_SQL),
    "largest_remainder": (largest_remainder, REMAINDER_SQL),
    "stratified_subsample": (stratified_subsample, SUBSAMPLE_SQL),
    "condition_plan": (condition_plan, PLAN_SQL),
    "corrupted_vectors": (corrupted_vectors, CORRUPT_SQL),
    "unit_positions": (unit_positions, "select (l_orderkey % 4)::int as client, l_orderkey * 10 + l_linenumber as position from lineitem"),
    "split_strategies": (split_strategies, STRATEGY_SQL),
    "track_names": (track_names, TRACK_SQL),
    "condition_parse": (condition_parse, PARSE_SQL),
    "effective_n": (effective_n, EFFECTIVE_SQL),
    "name_seeds": (name_seeds, SEED_SQL),
    "grid_expand": (grid_expand, f"with {_EXPAND} select * from ex"),
    "config_normalise": (config_normalise, f"with {_EXPAND} {_NORMAL} from ex"),
    "grid_dedup": (grid_dedup, f"with {_EXPAND}, {_DONE} {_NORMAL} from ex except {_NORMAL} from do_"),
    "grid_counts": (grid_counts, f"with {_EXPAND}, {_DONE}, nw as ({_NORMAL} from ex except {_NORMAL} from do_) select (select count(*) from ex)::bigint as generated, (select count(*) from nw)::bigint as new, ((select count(*) from ex) - (select count(*) from nw))::bigint as skipped"),
    "results_schema_merge": (results_schema_merge, MERGE_SQL),
    "key_difference": (key_difference, DIFF_SQL),
    "grid_fingerprints": (grid_fingerprints, f"with {_EXPAND}, nx as ({_NORMAL} from ex), g as (select count(*) as n from nx group by model_name, partition_strategy, dirichlet_alpha, fipa_rank, feddisco_a) select n::bigint as n, count(*)::bigint as groups from g group by 1"),
    "results_tail": (results_tail, "select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 5"),
}
