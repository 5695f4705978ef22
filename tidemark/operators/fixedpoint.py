"""Fixed-point and encrypted lanes of aggregation.

The plaintext lane keeps integers on one grid (decimal(38,0), exact sums).  The encrypted lane is Paillier over Python
integers: ciphertexts rest as text, sums are modular products in a grouped Pandas aggregate.  Encrypting tasks get the
public key alone, and noise comes from the system's source of randomness; a seed is for tests.

A preconditioned round stays on two grids: projections and operators at 2 ** -52, the model and increments at their product,
2 ** -104, so nothing is ever realigned.
"""

from __future__ import annotations

import math
import random
import secrets
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grid is 16 ** -13, that is 2 ** -52.
GRID_BITS = 52
MODEL_BITS = 2 * GRID_BITS
#: The most (client, direction) rows that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def encode(x: Column, limit: float | None = None) -> Column:
    """x on the grid as decimal(38,0), rounded half to even; values beyond ``limit`` grid steps are an error."""
    scaled = F.rint(x * float(1 << GRID_BITS))
    ok = scaled if limit is None else F.when(F.abs(scaled) <= limit, scaled).otherwise(F.raise_error(F.lit("beyond the fixed-point ceiling")).cast("double"))
    return ok.cast("decimal(38,0)")


def decode(k: Column) -> Column:
    return k.cast("double") / float(1 << GRID_BITS)


def encode_vectors(long: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, k of (keys, pos, x); a client whose vector is 0 throughout is an error: nothing of it would survive."""
    size = long.groupBy(*keys).agg(F.max(F.abs("x")).alias("_top"))
    checked = long.join(size, list(keys))
    x = F.when(F.col("_top") > 0, F.col("x")).otherwise(F.raise_error(F.lit("an all-zero vector cannot be encoded")).cast("double"))
    return checked.select(*keys, "pos", encode(x).alias("k"))


def _with_weights(rows: DataFrame, weights: DataFrame) -> DataFrame:
    w = weights.select("client", "int_weight")
    return rows.join(F.broadcast(w) if w.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else w, "client")


def integer_sum(encoded: DataFrame, weights: DataFrame) -> DataFrame:
    """pos, total: sum of integer weight * k over clients, exact; divide by the weights' scale to read it."""
    both = _with_weights(encoded, weights)
    return both.groupBy("pos").agg(F.sum((F.col("k") * F.col("int_weight").cast("decimal(18,0)")).cast("decimal(38,0)")).alias("total"))


@dataclass(frozen=True)
class PublicKey:
    """What encrypting and adding needs."""

    n: int

    def ceiling(self, m: int) -> int:
        """m, if the key can hold it; past the ceiling a value would come back plausible and wrong."""
        if abs(m) > self.n // 3:
            raise ValueError("beyond the ceiling of the key")
        return m

    def encrypt(self, m: int, noise: random.Random | None = None) -> int:
        n2 = self.n * self.n
        r = noise.randrange(1, self.n) if noise else secrets.randbelow(self.n - 1) + 1
        return (1 + (self.ceiling(m) % self.n) * self.n) % n2 * pow(r, self.n, n2) % n2


@dataclass(frozen=True)
class Keys:
    """A Paillier key pair; ``secret`` is kept by whoever decrypts."""

    n: int
    secret: int

    @property
    def public(self) -> PublicKey:
        return PublicKey(self.n)

    @staticmethod
    def make(bits: int = 128, seed: int | None = None) -> Keys:
        """A pair of ``bits`` bits; without a seed (a test's) from the system's randomness."""
        draw = random.SystemRandom() if seed is None else random.Random(seed)

        def prime() -> int:
            while True:
                p = draw.getrandbits(bits // 2) | 1 | 1 << (bits // 2 - 1) | 1 << (bits // 2 - 2)
                if all(pow(a, p - 1, p) == 1 for a in (2, 3, 5, 7, 11, 13)):
                    return p

        while True:
            p, q = prime(), prime()
            if p != q and math.gcd(p * q, (p - 1) * (q - 1)) == 1:
                return Keys(p * q, math.lcm(p - 1, q - 1))

    def decrypt(self, c: int) -> int:
        n2 = self.n * self.n
        m = (pow(c, self.secret, n2) - 1) // self.n * pow(self.secret, -1, self.n) % self.n
        return m if m <= self.n // 2 else m - self.n


def on_grid(value: float, bits: int) -> int:
    """The value as a whole number of steps of 2 ** -bits, half to even; a value that falls through the grid is an error."""
    steps = round(Fraction(value) * (1 << bits))
    if not steps and value:
        raise ValueError(f"{value!r} rounds to zero on the grid 2 ** -{bits}")
    return steps


def encrypted(encoded: DataFrame, public: PublicKey, seed: int | None = None) -> DataFrame:
    """Rows with ``k`` replaced by ciphertext text ``c``."""

    @F.pandas_udf("string")
    def run(pos: pd.Series, k: pd.Series) -> pd.Series:
        noise = lambda p: None if seed is None else random.Random(f"{seed}:{p}")
        return pd.Series([str(public.encrypt(int(x), noise(p))) for p, x in zip(pos, k, strict=True)])

    return encoded.withColumn("c", run.asNondeterministic()("pos", F.col("k").cast("string"))).drop("k")


def encrypted_sum(cipher: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """pos, c: ciphertext of the weighted sum, by powers and products modulo n squared.

    Products are taken within a task first, then over tasks' results, so no task holds a position's whole group.
    """
    both = _with_weights(cipher, weights)

    @F.pandas_udf("string")
    def scaled(c: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([str(pow(int(x), int(y), n * n)) for x, y in zip(c, w, strict=True)])

    @F.pandas_udf("string")
    def product(c: pd.Series) -> str:
        out = 1
        for x in c:
            out = out * int(x) % (n * n)
        return str(out)

    rows = both.select("pos", F.pmod(F.xxhash64("client"), F.lit(64)).alias("slot"), scaled("c", "int_weight").alias("c"))
    return rows.groupBy("pos", "slot").agg(product("c").alias("c")).groupBy("pos").agg(product("c").alias("c"))


def encrypted_average(cipher: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """pos, c of the sum weighted by the clients' sizes (client, n); whoever decrypts divides by their total."""
    return encrypted_sum(cipher, sizes.select("client", F.col("n").cast("long").alias("int_weight")), n)


def encrypt_projection(z: DataFrame, public: PublicKey) -> DataFrame:
    """client, j, c of (client, j, z): all that a client sends of its delta."""

    @F.pandas_udf("string")
    def run(z: pd.Series) -> pd.Series:
        return pd.Series([str(public.encrypt(on_grid(float(x), GRID_BITS))) for x in z])

    return z.select("client", "j", run.asNondeterministic()("z").alias("c"))


def _paired(operators: DataFrame, projections: DataFrame) -> None:
    """Every client's projection must meet its own operator, direction by direction."""
    a = operators.select("client", "j").distinct().withColumn("a", F.lit(1))
    b = projections.groupBy("client", "j").agg(F.count("*").alias("b"))
    lone = a.join(b, ["client", "j"], "full_outer").where("a is null or b is null or b > 1").limit(1).collect()
    if lone:
        raise ValueError(f"client {lone[0]['client']}, direction {lone[0]['j']}: operators and projections do not pair up")
    if operators.isEmpty():
        raise ValueError("no clients to aggregate")


def _operator_steps(operators: DataFrame, public: PublicKey) -> DataFrame:
    """client, j, pos, k: operators on the grid; one that falls through it whole is an error."""
    top = operators.groupBy("client").agg(F.max(F.abs("x")).alias("top")).where((F.col("top") > 0) & (F.rint(F.col("top") * float(1 << GRID_BITS)) == 0)).limit(1).collect()
    if top:
        raise ValueError(f"client {top[0]['client']}: every entry of its operator rounds to zero on the grid")
    return operators.select("client", "j", "pos", encode(F.col("x"), public.n / 3 if public.n < 1 << 125 else None).alias("k"))


def _with_projections(operators: DataFrame, projections: DataFrame) -> DataFrame:
    small = projections.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return operators.join(F.broadcast(projections) if small else projections, ["client", "j"])


def encrypted_increment(operators: DataFrame, projections: DataFrame, public: PublicKey) -> DataFrame:
    """pos, c: the sum over clients and directions of P_m[pos, j] times the ciphertext of z_m[j], on the model's grid.

    Powers and products are taken within a task first, by position and a slot of the client, then over tasks' results.
    """
    _paired(operators, projections)
    n = public.n

    @F.pandas_udf("string")
    def scaled(c: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([str(pow(int(x), public.ceiling(int(y)) % n, n * n)) for x, y in zip(c, k, strict=True)])

    @F.pandas_udf("string")
    def product(c: pd.Series) -> str:
        out = 1
        for x in c:
            out = out * int(x) % (n * n)
        return str(out)

    rows = _with_projections(_operator_steps(operators, public), projections)
    rows = rows.select("pos", F.pmod(F.xxhash64("client"), F.lit(64)).alias("slot"), scaled("c", F.col("k").cast("string")).alias("c"))
    return rows.groupBy("pos", "slot").agg(product("c").alias("c")).groupBy("pos").agg(product("c").alias("c"))


def integer_increment(operators: DataFrame, z: DataFrame) -> DataFrame:
    """pos, total: the same sum over plain projections (client, j, z), in exact integers on the model's grid."""
    _paired(operators, z)
    steps = z.select("client", "j", encode(F.col("z")).cast("decimal(19,0)").alias("kz"))
    rows = _with_projections(operators.select("client", "j", "pos", encode(F.col("x")).cast("decimal(19,0)").alias("kp")), steps)
    return rows.groupBy("pos").agg(F.sum((F.col("kp") * F.col("kz")).cast("decimal(38,0)")).alias("total"))


def rescale_to_grid(cipher: DataFrame, total: float, public: PublicKey) -> DataFrame:
    """pos, c of a sum of ``total`` weights on the first grid, divided by the total and put on the model's grid: once, where warm-up ends."""
    factor, n2 = on_grid(1.0 / total, MODEL_BITS - GRID_BITS), public.n * public.n

    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([str(pow(int(x), factor, n2)) for x in c])

    return cipher.select("pos", run("c").alias("c"))


def add_increment(model: DataFrame, increment: DataFrame, public: PublicKey | None = None) -> DataFrame:
    """The model (pos, c or x) plus the increment (pos, c or x): encrypted if either is.  Positions must be the same."""
    secret = "c" in model.columns, "c" in increment.columns
    both = model.withColumnRenamed("c" if secret[0] else "x", "a").join(increment.withColumnRenamed("c" if secret[1] else "x", "b"), "pos", "full_outer")
    lone = F.col("a").isNull() | F.col("b").isNull()
    kind = "string" if secret[0] else "double"
    a = F.when(lone, F.raise_error(F.lit("the model and the increment differ in their positions")).cast(kind)).otherwise(F.col("a"))
    if secret == (False, False):
        return both.select("pos", (a + F.col("b")).alias("x"))
    if not secret[1]:
        raise ValueError("an increment in the clear is for a model in the clear")
    n, n2 = public.n, public.n * public.n

    @F.pandas_udf("string")
    def add(a: pd.Series, b: pd.Series) -> pd.Series:
        plain = lambda x: (1 + public.ceiling(on_grid(float(x), MODEL_BITS)) % n * n) % n2
        return pd.Series([str((int(x) if secret[0] else plain(x)) * int(y) % n2) for x, y in zip(a, b, strict=True)])

    return both.select("pos", add(a, "b").alias("c"))


def preconditioned_round(model: DataFrame, denominator: float, operators: DataFrame, projections: DataFrame, public: PublicKey) -> DataFrame:
    """pos, c: the encrypted model after one round.

    ``denominator``: what undoes the scale of the model that was sent out (1, or 0 before any round: nothing to undo).
    """
    if "c" in model.columns and denominator not in (0, 1):
        model = rescale_to_grid(model, denominator, public)
    return add_increment(model, encrypted_increment(operators, projections, public), public)


def decrypted_values(cipher: DataFrame, keys: Keys, bits: int = MODEL_BITS) -> DataFrame:
    """pos, x of ciphertexts on a grid."""

    @F.pandas_udf("double")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([float(Fraction(keys.decrypt(int(x)), 1 << bits)) for x in c])

    return cipher.select("pos", run("c").alias("x"))


def decrypted(cipher: DataFrame, keys: Keys) -> DataFrame:
    """pos, total of (pos, c)."""

    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([str(keys.decrypt(int(x))) for x in c])

    return cipher.select("pos", run("c").cast("decimal(38,0)").alias("total"))
