"""Low-rank preconditioned aggregation.

Client m brings a change delta (p), directions U (p x r) and curvatures lambda (r); with shares a_m the sum is
H+ sum_m a_m U_m (lambda_m * U_m' delta_m), where H = C C' and C holds the columns sqrt(a_m lambda_mj) U_mj.  C is long
(pos, col, c) and never leaves the executors: only its Gram matrix K = C'C (s x s, s the number of columns) is brought to
the driver, and C C' and C'C share their non-zero spectrum.  With K = W diag(sigma) W', H+ v = C W diag(sigma+^2) W' C' v.
The Gram matrix has s^2 / 2 cells summed over positions; more than MOST_COLUMNS columns are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_factors(gradients: DataFrame, rank: int) -> DataFrame:
    """client, directions (r arrays of p), curvature (r), explained, from gradient rows (client, g array<double>).

    One client's gradients (a few dozen rows) are one group; r is at most the rows and columns there are.
    """

    def factor(key, pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.vstack(pdf.sort_values("row")["g"].to_numpy()).astype(float)
        _, s, vt = np.linalg.svd(g, full_matrices=False)
        r = min(rank, *g.shape)
        vt = vt[:r] * np.sign(vt[np.arange(r), np.abs(vt[:r]).argmax(1)])[:, None]
        lam = s[:r] ** 2 / len(g)
        total = (g**2).sum() / len(g)
        return pd.DataFrame([(key[0], vt.tolist(), lam.tolist(), float(lam.sum() / total) if total > 0 else 0.0)], columns=["client", "directions", "curvature", "explained"])

    schema = f"client {gradients.schema['client'].dataType.simpleString()}, directions array<array<double>>, curvature array<double>, explained double"
    return gradients.select("client", "row", "g").groupBy("client").applyInPandas(factor, schema)


def explained_variance(long: DataFrame, curvature: DataFrame) -> DataFrame:
    """client, explained: positive curvatures over the mean squared norm of the gradient rows (client, row, pos, x); 0 for zero gradients."""
    norm = long.groupBy("client").agg((F.sum(F.col("x") * F.col("x")) / F.countDistinct("row")).alias("total"))
    lam = curvature.groupBy("client").agg(F.sum(F.greatest("lambda", F.lit(0.0))).alias("sum"))
    return norm.join(lam, "client").select("client", F.when(F.col("total") > 0, F.col("sum") / F.col("total")).otherwise(0.0).alias("explained"))


def shares(clients: DataFrame) -> DataFrame:
    """client, share of all samples; 0 for all if there are none."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return clients.select("client", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)).alias("share"))


def size_mismatch(clients: DataFrame) -> DataFrame:
    """Parameter counts, if there is more than one: must be empty."""
    return clients.select(F.size("delta").alias("p")).distinct().withColumn("k", F.count("*").over(Window.partitionBy(F.lit(0)))).where("k > 1").select("p")


def columns(clients: DataFrame) -> DataFrame:
    """client, j, share, lambda, pos, u of client rows (client, n, directions, curvature)."""
    a = shares(clients)
    rows = clients.join(a, "client").select("client", "share", F.posexplode("directions").alias("j", "d"), "curvature")
    return rows.select("client", "share", "j", F.greatest(F.col("curvature")[F.col("j")], F.lit(0.0)).alias("lambda"), F.posexplode("d").alias("pos", "u"))


def project_deltas(clients: DataFrame) -> DataFrame:
    """client, j, z: each delta along its client's directions."""
    d = clients.select("client", F.posexplode("delta").alias("pos", "x"))
    u = clients.select("client", F.posexplode("directions").alias("j", "d")).select("client", "j", F.posexplode("d").alias("pos", "u"))
    return u.join(d, ["client", "pos"]).groupBy("client", "j").agg(F.sum(F.col("u") * F.col("x")).alias("z"))


def scaled_columns(clients: DataFrame) -> DataFrame:
    """client, j, pos, c: the columns of C."""
    return columns(clients).select("client", "j", "pos", (F.sqrt(F.col("share") * F.col("lambda")) * F.col("u")).alias("c"))


def gram(clients: DataFrame) -> DataFrame:
    """c1, j1, c2, j2, k: the upper half of C'C, positions multiplied where they meet and summed."""
    c = scaled_columns(clients)
    a = c.select(F.col("client").alias("c1"), F.col("j").alias("j1"), "pos", F.col("c").alias("x"))
    b = c.select(F.col("client").alias("c2"), F.col("j").alias("j2"), "pos", F.col("c").alias("y"))
    half = (F.col("c1") < F.col("c2")) | ((F.col("c1") == F.col("c2")) & (F.col("j1") <= F.col("j2")))
    return a.join(b, "pos").where(half).groupBy("c1", "j1", "c2", "j2").agg(F.sum(F.col("x") * F.col("y")).alias("k"))


#: The most columns (clients x rank) of C: its Gram matrix of their square is what the driver holds.
MOST_COLUMNS = 4096


@dataclass(frozen=True)
class Consensus:
    """The driver's view of C C': the columns' names, their Gram matrix, its eigenvectors and inverse non-zero spectrum."""

    names: list[tuple]
    k: np.ndarray
    vectors: np.ndarray
    inverse: np.ndarray

    def apply(self, v: np.ndarray, power: int) -> np.ndarray:
        """K to the power of minus ``power``, on its non-zero spectrum, times v."""
        inverse = self.inverse**power
        return self.vectors @ ((inverse[:, None] if v.ndim == 2 else inverse) * (self.vectors.T @ v))


def consensus(clients: DataFrame, rtol: float = 1e-8) -> Consensus:
    names = [tuple(r) for r in clients.select("client", F.posexplode("curvature").alias("j", "l")).select("client", "j").limit(MOST_COLUMNS + 1).collect()]
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"clients x rank is over {MOST_COLUMNS}")
    names.sort()
    place = {n: i for i, n in enumerate(names)}
    k = np.zeros((len(names), len(names)))
    for c1, j1, c2, j2, x in gram(clients).select("c1", "j1", "c2", "j2", "k").collect():  # MOST_COLUMNS squared at most
        k[place[c1, j1], place[c2, j2]] = k[place[c2, j2], place[c1, j1]] = x
    sigma, w = np.linalg.eigh(k)
    keep = sigma > rtol * max(sigma.max(initial=0.0), 0.0)
    return Consensus(names, k, w, np.where(keep, 1 / np.where(keep, sigma, 1), 0.0))


def project(clients: DataFrame, c: Consensus) -> np.ndarray:
    """C'v of v = sum_m a_m U_m (lambda_m z_m): v lies in C's span with coefficients sqrt(a lambda) z on column (m, j), so it is K t."""
    if "delta" not in clients.columns or clients.where("delta is null").limit(1).count():
        raise ValueError("there are no deltas to project")
    facts = columns(clients).select("client", "j", "share", "lambda").distinct()
    t = dict.fromkeys(c.names, 0.0)
    for client, j, z, share, lam in project_deltas(clients).join(facts, ["client", "j"]).select("client", "j", "z", "share", "lambda").collect():
        t[client, j] = float(np.sqrt(share * lam)) * z
    return c.k @ np.array([t[n] for n in c.names])


def expand(clients: DataFrame, c: Consensus, coordinates: np.ndarray) -> DataFrame:
    """pos, x: H+ of the vector with these coordinates C'v, back in all positions: C K^-2 C'v."""
    coefficient = c.apply(coordinates, 2) if c.names else coordinates
    kinds = f"client {clients.schema['client'].dataType.simpleString()}, j int, w double"
    w = clients.sparkSession.createDataFrame([(n[0], n[1], float(x)) for n, x in zip(c.names, coefficient, strict=True)], kinds)
    both = scaled_columns(clients).join(F.broadcast(w), ["client", "j"])
    return both.groupBy("pos").agg(F.sum(F.col("c") * F.col("w")).alias("x"))


def preconditioned_sum(clients: DataFrame, rtol: float = 1e-8) -> DataFrame:
    """pos, x: the preconditioned sum of client rows (client, n, delta, directions, curvature); zeros if no client has samples."""
    c = consensus(clients, rtol)
    return expand(clients, c, project(clients, c))


def aggregate(theta: DataFrame, clients: DataFrame, rtol: float = 1e-8) -> DataFrame:
    """pos, x: the model (pos, x) plus the preconditioned sum, as float."""
    step = preconditioned_sum(clients, rtol).withColumnRenamed("x", "_d")
    return theta.join(step, "pos", "left").select("pos", (F.col("x") + F.coalesce("_d", F.lit(0.0))).cast("float").alias("x"))


def server_round(snapshot: DataFrame | None, updates: DataFrame, rtol: float = 1e-8) -> DataFrame:
    """:func:`aggregate` behind the server's guards: the model as sent out must be there, and every update its factors."""
    if snapshot is None:
        raise ValueError("no snapshot of the model that was sent out: the deltas have nothing to be added to")
    factors = {"directions", "curvature"} - set(updates.columns)
    bare = updates.where("directions is null or curvature is null or size(directions) <> size(curvature)").select("client").limit(1).collect() if not factors else []
    if factors or bare:
        raise ValueError(f"client {bare[0][0] if bare else '?'} sent a delta without its curvature factors")
    return aggregate(snapshot, updates, rtol)


def mean_explained(updates: DataFrame) -> DataFrame:
    """One row: the mean of ``explained`` over the clients that report one (neither null nor NaN)."""
    return updates.agg(F.avg(F.when(~F.isnan("explained"), F.col("explained"))).alias("mean_explained"))


def preconditioners(clients: DataFrame, rtol: float = 1e-8) -> DataFrame:
    """client, j, pos, x: P_m with sum_m P_m z_m the preconditioned sum, so that a client sends r numbers instead of p."""
    c = consensus(clients, rtol)
    facts = {(r[0], r[1]): (r[2], r[3]) for r in columns(clients).select("client", "j", "share", "lambda").distinct().collect()}
    inner = c.apply(c.k, 2) * np.array([np.sqrt(facts[n][0] * facts[n][1]) for n in c.names])[None, :]
    kind = clients.schema["client"].dataType.simpleString()
    # one row a column of C with its coefficients for all operators: MOST_COLUMNS numbers
    m = clients.sparkSession.createDataFrame([(*n, row.tolist()) for n, row in zip(c.names, inner, strict=True)], f"client {kind}, j int, w array<double>")
    names = clients.sparkSession.createDataFrame([(i, *n) for i, n in enumerate(c.names)], f"at int, client {kind}, j int")
    both = scaled_columns(clients).join(F.broadcast(m), ["client", "j"]).select("pos", "c", F.posexplode("w").alias("at", "w"))
    return both.groupBy("at", "pos").agg(F.sum(F.col("c") * F.col("w")).alias("x")).join(F.broadcast(names), "at").select("client", "j", "pos", "x")


def diagnostics(clients: DataFrame, rtol: float = 1e-8) -> DataFrame:
    """One row: shares of the deltas' norms inside the clients' own and the joint span, and the step's size against plain averaging.

    A zero delta counts as 0; without samples all are null.
    """
    rows = clients.join(shares(clients), "client")
    d = rows.select("client", "share", F.posexplode("delta").alias("pos", "x"))
    norms = d.groupBy("client", "share").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    local = project_deltas(clients).groupBy("client").agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("inside"))
    c, columns_ = consensus(clients, rtol), scaled_columns(clients)
    # a client's delta against every column: clients x columns numbers
    against = columns_.withColumnRenamed("client", "of").join(d, "pos").groupBy("client", "of", "j").agg(F.sum(F.col("c") * F.col("x")).alias("t"))
    seen: dict = {}
    for r in against.collect():
        seen.setdefault(r["client"], {})[r["of"], r["j"]] = r["t"]
    joint = []
    for client in sorted(seen):
        v = np.array([seen[client].get(n, 0.0) for n in c.names])
        joint.append((client, float(np.sqrt(max(0.0, float(v @ c.apply(v, 1)))))))
    kind = clients.schema["client"].dataType.simpleString()
    joint_rows = clients.sparkSession.createDataFrame(joint, f"client {kind}, joint double")
    per = norms.join(local, "client").join(joint_rows, "client", "left")
    over = lambda x: F.when(F.col("norm") > 0, F.least(F.col(x) / F.col("norm"), F.lit(1.0))).otherwise(0.0)
    out = per.agg(
        (F.sum(F.col("share") * over("inside")) / F.nullif(F.sum("share"), F.lit(0.0))).alias("delta_in_local"),
        (F.sum(F.col("share") * over("joint")) / F.nullif(F.sum("share"), F.lit(0.0))).alias("delta_in_joint"),
    )
    plain = d.groupBy("pos").agg(F.sum(F.col("share") * F.col("x")).alias("x")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("plain"))
    step = preconditioned_sum(clients, rtol).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("step"))
    return out.crossJoin(plain).crossJoin(step).select("delta_in_local", "delta_in_joint", F.when(F.col("plain") > 0, F.col("step") / F.col("plain")).alias("step_ratio"))


def batch_gradients(rows: DataFrame, client: str, batch: str, vector: str, label: str, classes: int) -> DataFrame:
    """client, row, g: softmax-regression gradients at zero weights, one for each client and batch (a stand-in for a network's)."""
    kind = rows.schema[client].dataType.simpleString()

    def grad(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(pdf[vector].to_numpy()).astype(float)
        y = np.eye(classes)[pdf[label].to_numpy().astype(int)]
        g = x.T @ (np.full_like(y, 1 / classes) - y) / len(x)
        return pd.DataFrame({"client": [key[0]], "row": [int(key[1])], "g": [g.T.ravel().tolist()]})

    cols = rows.select(client, batch, vector, label)
    return cols.groupBy(client, batch).applyInPandas(grad, f"client {kind}, row long, g array<double>")
