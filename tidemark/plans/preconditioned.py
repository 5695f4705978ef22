"""Queries on low-rank preconditioned aggregation: four clients with 64-wide models made from ``embeddings``.

A client's gradients are its first rows' vectors; its directions and curvatures come from them.  Where SQL has to repeat the
query, directions are unit vectors read off the data, so no decomposition is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import fipa, fixedpoint, moments, vectors

from .common import rounded, table

CLIENTS = 4
#: Rows of ``embeddings`` (by id) that are gradients of a client.
ROWS = 8


def gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client, row, g: means of the vectors by client and ``vec_id // 4 % 8``: every vector counts."""
    e = table(spark, sf_dir, "embeddings")
    e = e.select((F.col("vec_id") % CLIENTS).cast("int").alias("client"), (F.floor(F.col("vec_id") / CLIENTS) % ROWS).alias("row"), "embedding")
    return vectors.pack(vectors.average(e, "embedding", F.lit(1), "client", "row"), "client", "row").withColumnRenamed("vector", "g")


_G = f"""g as (select cast(vec_id % {CLIENTS} as int) as client, vec_id // {CLIENTS} % {ROWS} as row, pos, avg(x::double) as x from
  (select vec_id, unnest(embedding) as x, unnest(range(0, len(embedding))) as pos from embeddings) group by 1, 2, 3)"""


def sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client, n, delta, directions, curvature: directions are the normalised means of the even and of the odd gradient rows."""
    g = gradients(spark, sf_dir)
    halves = vectors.pack(vectors.average(g.withColumn("j", (F.col("row") % 2).cast("int")), "g", F.lit(1), "client", "j"), "client", "j")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    unit = halves.select("client", "j", F.transform("vector", lambda x: x / norm).alias("u"), (norm * norm).alias("l"))
    side = unit.groupBy("client").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "u", "l"))), lambda s: F.struct(s["u"], s["l"])).alias("s"))
    delta = vectors.pack(vectors.average(g, "g", F.lit(1), "client"), "client").withColumnRenamed("vector", "delta")
    sizes = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % CLIENTS).cast("int").alias("client")).agg(F.count("*").cast("double").alias("n"))
    return delta.join(side, "client").join(sizes, "client").select("client", "n", "delta", F.transform("s", lambda x: x["u"]).alias("directions"), F.transform("s", lambda x: x["l"]).alias("curvature"))


_SK = f"""{_G}, hv as (select client, (row % 2)::int as j, pos, avg(x) as x from g group by 1, 2, 3), nr as (select client, j, sqrt(sum(x * x)) as norm from hv group by 1, 2),
u as (select client, j, pos, x / norm as u, norm * norm as l from hv join nr using (client, j)),
de as (select client, pos, avg(x) as d from g group by 1, 2), sz as (select cast(vec_id % {CLIENTS} as int) as client, count(*)::double as n from embeddings group by 1),
sh as (select client, n / sum(n) over () as share from sz)"""


def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gradients(spark, sf_dir)
    lam = sketched(spark, sf_dir).select("client", F.explode("curvature").alias("lambda"))
    return rounded(fipa.explained_variance(vectors.long_form(g, "g", "client", "row"), lam), "explained")


EXPLAINED_SQL = f"with {_SK} select client, round((select sum(l) from (select distinct client as c, j, l from u) where c = g.client) / (sum(x * x) / count(distinct row)), 6) as explained from g group by client"


def project_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fipa.project_deltas(sketched(spark, sf_dir)), "z")


def sample_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fipa.shares(sketched(spark, sf_dir)), "share")


def consensus_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fipa.gram(sketched(spark, sf_dir)), "k")


GRAM_SQL = f"""with {_SK}, c as (select client, j, pos, sqrt(share * l) * u as c from u join sh using (client))
select a.client as c1, a.j as j1, b.client as c2, b.j as j2, round(sum(a.c * b.c), 6) as k from c a join c b using (pos) where a.client < b.client or (a.client = b.client and a.j <= b.j) group by 1, 2, 3, 4"""


def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients of unequal width: the last one's delta is cut short by one."""
    s = sketched(spark, sf_dir)
    return fipa.size_mismatch(s.withColumn("delta", F.when(F.col("client") == CLIENTS - 1, F.slice("delta", 1, 63)).otherwise(F.col("delta"))))


def top_r_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of each client's full set of factors: curvatures add up to the gradients' mean square, their squares to the
    squared Gram cells of the gradients, and all of the variance is explained."""
    f = fipa.top_factors(gradients(spark, sf_dir), ROWS)
    sums = lambda e: F.aggregate("curvature", F.lit(0.0), lambda a, x: a + e(x))
    out = f.select("client", F.size("curvature").cast("long").alias("rank"), sums(lambda x: x).alias("total"), sums(lambda x: x * x).alias("squares"), "explained")
    return rounded(out, "total", "squares", "explained")


FACTORS_SQL = f"""with {_G}, n as (select client, count(distinct row) as n from g group by 1),
d as (select a.client, a.row as i, b.row as j, sum(a.x * b.x) as d from g a join g b using (client, pos) group by 1, 2, 3)
select client, n::bigint as rank, round(sum(d) filter (i = j) / n, 6) as total, round(sum(d * d) / (n * n), 6) as squares, 1.0e0 as explained from d join n using (client) group by client, n"""


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clients with one direction each, the case whose 2 x 2 Gram matrix SQL can invert by hand: the direction is the mean
    of a client's vectors, its movement their mean weighted by ``vec_id // 2 % 3``.
    """
    e = table(spark, sf_dir, "embeddings").withColumn("client", (F.col("vec_id") % 2).cast("int"))
    mean = vectors.pack(vectors.average(e, "embedding", F.lit(1), "client"), "client")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    side = mean.select("client", F.array(F.transform("vector", lambda x: x / norm)).alias("directions"), F.array(norm * norm).alias("curvature"))
    weight = F.floor(F.col("vec_id") / 2) % 3
    delta = vectors.pack(vectors.average(e, "embedding", weight, "client"), "client").withColumnRenamed("vector", "delta")
    sizes = e.groupBy("client").agg(F.count("*").cast("double").alias("n"))
    return delta.join(side, "client").join(sizes, "client").select("client", "n", "delta", "directions", "curvature")


def _theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.channel_moments(table(spark, sf_dir, "embeddings"), "embedding").select(F.col("ch").alias("pos"), F.col("mean").alias("x"))


_PAIR = """e2 as (select cast(vec_id % 2 as int) as client, vec_id // 2 % 3 as w, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as pos from embeddings),
de as (select client, pos, sum(w * x) / sum(w) as d from e2 group by 1, 2), me as (select client, pos, avg(x) as x from e2 group by 1, 2), nm as (select client, sqrt(sum(x * x)) as norm from me group by 1),
a2 as (select client, n / sum(n) over () as a from (select vec_id % 2 as client, count(*)::double as n from embeddings group by 1)),
c2 as (select client, pos, x / norm as u, norm * norm as l, a, sqrt(a) * x as c from me join nm using (client) join a2 using (client)),
z2 as (select client, any_value(a) as a, any_value(l) as l, sum(u * d) as z from c2 join de using (client, pos) group by 1),
wide as (select pos, max(c) filter (client = 0) as c0, max(c) filter (client = 1) as c1 from c2 group by 1),
k as (select sum(c0 * c0) as p, sum(c0 * c1) as q, sum(c1 * c1) as r from wide),
t as (select max(sqrt(a * l) * z) filter (client = 0) as t0, max(sqrt(a * l) * z) filter (client = 1) as t1 from z2),
co as (select (r * t0 - q * t1) / (p * r - q * q) as w0, (p * t1 - q * t0) / (p * r - q * q) as w1 from k, t),
st as (select pos, c0 * w0 + c1 * w1 as x from wide, co)"""


def preconditioned_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fipa.preconditioned_sum(pair(spark, sf_dir)), "x")


def fipa_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model (mean of all vectors) after one preconditioned step."""
    return fipa.server_round(_theta(spark, sf_dir), pair(spark, sf_dir)).select("pos", F.round(F.col("x").cast("double"), 5).alias("x"))


FIPA_SQL = f"""with {_PAIR}, th as (select pos, avg(x::double) as m from (select unnest(embedding) as x, unnest(range(0, len(embedding))) as pos from embeddings) group by 1)
select pos::int as pos, round((m + x)::float::double, 5) as x from th join st using (pos)"""


def projection_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fipa.diagnostics(pair(spark, sf_dir)), "delta_in_local", "delta_in_joint", "step_ratio")


DIAGNOSTICS_SQL = f"""with {_PAIR}, dn as (select client, sqrt(sum(d * d)) as norm from de group by 1),
v as (select client, sum(c0 * d) as v0, sum(c1 * d) as v1 from de join wide using (pos) group by 1),
jn as (select client, sqrt((r * v0 * v0 - 2 * q * v0 * v1 + p * v1 * v1) / (p * r - q * q)) as inside from v, k),
pl as (select sqrt(sum(s * s)) as plain from (select pos, sum(a * d) as s from de join a2 using (client) group by 1))
select round(sum(a * least(abs(z) / norm, 1)), 6) as delta_in_local, round(sum(a * least(inside / norm, 1)), 6) as delta_in_joint,
  round((select sqrt(sum(x * x)) from st) / any_value(plain), 6) as step_ratio from z2 join dn using (client) join jn using (client), pl"""


def preconditioners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fipa.preconditioners(pair(spark, sf_dir)), "x")


PRECONDITIONERS_SQL = f"""with {_PAIR}
select client, 0 as j, pos::int as pos, round(sqrt(a * l) * case client when 0 then (c0 * r - c1 * q) else (c1 * p - c0 * q) end / (p * r - q * q), 6) as x from z2, wide, k"""


def preconditioner_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step again, from what clients would send: sum of P_m z_m."""
    c = pair(spark, sf_dir)
    both = fipa.preconditioners(c).join(fipa.project_deltas(c), ["client", "j"])
    return rounded(both.groupBy("pos").agg(F.sum(F.col("x") * F.col("z")).alias("x")), "x")


def subspace_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of the weighted movement along the joint columns: C'v."""
    clients = pair(spark, sf_dir)
    c = fipa.consensus(clients)
    rows = [(*n, float(x)) for n, x in zip(c.names, fipa.project(clients, c), strict=True)]
    return rounded(spark.createDataFrame(rows, "client int, j int, x double"), "x")


def mean_explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the clients that report a number: client 3 reports none, client 2 NaN."""
    g = gradients(spark, sf_dir)
    e = fipa.explained_variance(vectors.long_form(g, "g", "client", "row"), sketched(spark, sf_dir).select("client", F.explode("curvature").alias("lambda")))
    told = F.when(F.col("client") == 2, F.lit(float("nan"))).when(F.col("client") < 2, F.col("explained"))
    return rounded(fipa.mean_explained(e.select("client", told.alias("explained"))), "mean_explained")


EXPLAINED_MEAN_SQL = f"""with {_SK}, e as (select client, (select sum(l) from (select distinct client as c, j, l from u) where c = g.client) / (sum(x * x) / count(distinct row)) as e from g group by client)
select round(avg(e), 6) as mean_explained from e where client < 2"""


def _lane(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Operators (client, j, pos, x) and projections (client, j, z) of four clients and two directions: sums over all vectors,
    which are exact (32-bit numbers added in 64 bits), scaled by a power of two.
    """
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % CLIENTS).cast("int").alias("client"), (F.floor(F.col("vec_id") / CLIENTS) % 2).cast("int").alias("j"), "embedding")
    long = e.select("client", "j", F.posexplode("embedding").alias("pos", "x"))
    operators = long.groupBy("client", "j", "pos").agg((F.sum(F.col("x").cast("double")) / 65536).alias("x"))
    return operators, e.groupBy("client", "j").agg((F.sum(F.col("embedding")[0].cast("double")) / 65536).alias("z"))


_LANE = f"""lv as (select (vec_id % {CLIENTS})::int as client, vec_id // {CLIENTS} % 2 as j, embedding from embeddings),
op as (select client, j, pos, sum(x) / 65536 as x from (select client, j, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as pos from lv) group by 1, 2, 3),
pz as (select client, j, sum(embedding[1]::double) / 65536 as z from lv group by 1, 2)"""
_INTEGER_SQL = f"""with {_LANE} select pos::int as pos, sum(round_even(x * pow(2e0, 52), 0)::hugeint * round_even(z * pow(2e0, 52), 0)::hugeint)::varchar as total from op join pz using (client, j) group by 1"""


def fipa_integer_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The increment in exact integers."""
    return fixedpoint.integer_increment(*_lane(spark, sf_dir)).select("pos", F.col("total").cast("string").alias("total"))


def fipa_encrypted_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same integers out of ciphertexts."""
    keys = fixedpoint.Keys.make(256, seed=5)
    operators, z = _lane(spark, sf_dir)
    cipher = fixedpoint.encrypted_increment(operators, fixedpoint.encrypt_projection(z, keys.public), keys.public)
    return fixedpoint.decrypted(cipher, keys).select("pos", F.col("total").cast("string").alias("total"))


def _means(spark: SparkSession, sf_dir: str, clients: int) -> tuple[DataFrame, DataFrame]:
    """Models (client, pos, x), the mean vectors of so many clients, and their sizes (client, n)."""
    e = table(spark, sf_dir, "embeddings").withColumn("client", (F.col("vec_id") % clients).cast("int"))
    return vectors.average(e, "embedding", F.lit(1), "client").withColumn("x", F.round("x", 9)), e.groupBy("client").agg(F.count("*").alias("n"))


def fipa_encrypted_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warm-up hands over: the encrypted sum of the clients' models, divided by all samples, plus the encrypted increment."""
    keys = fixedpoint.Keys.make(384, seed=5)
    operators, z = _lane(spark, sf_dir)
    models, sizes = _means(spark, sf_dir, CLIENTS)
    model = fixedpoint.encrypted_average(fixedpoint.encrypted(fixedpoint.encode_vectors(models, "client"), keys.public), sizes, keys.n)
    total = float(sizes.agg(F.sum("n")).first()[0])
    out = fixedpoint.preconditioned_round(model, total, operators, fixedpoint.encrypt_projection(z, keys.public), keys.public)
    return rounded(fixedpoint.decrypted_values(out, keys), "x")


def fipa_encrypted_first_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without warm-up the first round adds an encrypted increment to a model in the clear."""
    keys = fixedpoint.Keys.make(384, seed=5)
    operators, z = _lane(spark, sf_dir)
    out = fixedpoint.preconditioned_round(_theta(spark, sf_dir), 0, operators, fixedpoint.encrypt_projection(z, keys.public), keys.public)
    return rounded(fixedpoint.decrypted_values(out, keys), "x")


_ROUND_SQL = f"""with {_LANE}, inc as (select pos, sum(x * z) as i from op join pz using (client, j) group by 1),
mo as (select pos, avg(x) as m from (select unnest(embedding)::double as x, unnest(range(0, len(embedding))) as pos from embeddings) group by 1)
select pos::int as pos, round(m + i, 6) as x from inc join mo using (pos)"""


def paillier_fedavg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size-weighted mean of all clients' mean vectors, under encryption."""
    keys = fixedpoint.Keys.make(256, seed=5)
    means, sizes = _means(spark, sf_dir, CLIENTS)
    total = fixedpoint.decrypted(fixedpoint.encrypted_average(fixedpoint.encrypted(fixedpoint.encode_vectors(means, "client"), keys.public), sizes, keys.n), keys)
    n = sizes.agg(F.sum("n").alias("n"))
    return total.crossJoin(F.broadcast(n)).select("pos", F.round(fixedpoint.decode(F.col("total")) / F.col("n"), 6).alias("x"))


def batch_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms of the softmax gradients of each client's batches of 25 vectors."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % CLIENTS).alias("client"), F.floor(F.col("vec_id") / 100).alias("batch"), "embedding", "label")
    g = fipa.batch_gradients(e, "client", "batch", "embedding", "label", 10)
    return g.select("client", "row", F.round(F.sqrt(F.aggregate("g", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


BATCH_SQL = f"""with e as (select vec_id % {CLIENTS} as client, vec_id // 100 as row, vec_id, label, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as pos from embeddings),
n as (select client, row, count(distinct vec_id) as n from e group by 1, 2),
gr as (select client, row, pos, k, sum(x * (0.1e0 - (label = k)::int)) / any_value(n) as g from e join n using (client, row) cross join range(10) t(k) group by 1, 2, 3, 4)
select client, row, round(sqrt(sum(g * g)), 6) as norm from gr group by 1, 2"""

PAIRS = {
    "explained_variance": (explained_variance, EXPLAINED_SQL),
    "project_delta": (project_delta, f"with {_SK} select client, j, round(sum(u * d), 6) as z from u join de using (client, pos) group by 1, 2"),
    "sample_shares": (sample_shares, f"with {_SK} select client, round(share, 6) as share from sh"),
    "consensus_gram": (consensus_gram, GRAM_SQL),
    "size_guard": (size_guard, "select unnest([63, 64])::int as p"),
    "batch_gradients": (batch_gradients, BATCH_SQL),
    "top_r_factors": (top_r_factors, FACTORS_SQL),
    "preconditioned_sum": (preconditioned_sum, f"with {_PAIR} select pos::int as pos, round(x, 6) as x from st"),
    "fipa_round": (fipa_round, FIPA_SQL),
    "projection_diagnostics": (projection_diagnostics, DIAGNOSTICS_SQL),
    "preconditioners": (preconditioners, PRECONDITIONERS_SQL),
    "preconditioner_sum": (preconditioner_sum, f"with {_PAIR} select pos::int as pos, round(x, 6) as x from st"),
    "subspace_projection": (subspace_projection, f"with {_PAIR} select unnest([0, 1])::int as client, 0 as j, round(unnest([p * t0 + q * t1, q * t0 + r * t1]), 6) as x from k, t"),
    "mean_explained_variance": (mean_explained_variance, EXPLAINED_MEAN_SQL),
    "fipa_integer_increment": (fipa_integer_increment, _INTEGER_SQL),
    "fipa_encrypted_increment": (fipa_encrypted_increment, _INTEGER_SQL),
    "fipa_encrypted_round": (fipa_encrypted_round, _ROUND_SQL),
    "fipa_encrypted_first_round": (fipa_encrypted_first_round, _ROUND_SQL),
    "paillier_fedavg": (paillier_fedavg, "select pos::int as pos, round(avg(x::double), 6) as x from (select unnest(embedding) as x, unnest(range(0, len(embedding))) as pos from embeddings) group by 1"),
}
