"""Nineteen corruptions as deterministic kernels on vectors: what an image kernel does to pixels, on channels in a row.

A kernel works on a whole block of vectors of one length, one row each: it reads the block ``x`` (doubles), the positions ``i``, the
severity ``s`` (1 to 5) and ``m``, a number in [0, 2000] mixed from the row's id, position and severity; nothing is drawn.
Nulls follow SQL: null wherever a null is read, but ``greatest`` and ``least`` pass over it and a condition on it does not hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: The most numbers in a block that is worked on at once (one vector at least).
BLOCK = 500_000


def _at(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The elements at positions ``k``, one row of positions for all rows or one each; the nearest element beyond the ends."""
    last = x.shape[1] - 1
    k = np.fmax(0, np.fmin(last, k)).astype(np.int64)
    return x[:, k] if k.ndim == 1 else np.take_along_axis(x, k, 1)


def _near(x: np.ndarray, i: np.ndarray, lo: int, hi: int) -> np.ndarray:
    total = np.zeros(x.shape)
    for k in range(lo, hi + 1):
        total += _at(x, i + k)
    return total / (hi - lo + 1)


def _mean(x: np.ndarray) -> np.ndarray:
    """Summed in order, as engines do."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k]
    return (total / max(1, x.shape[1]))[:, None]


def _u(m: np.ndarray) -> np.ndarray:
    """-1 to 1."""
    return (m - 1000) / 1000.0


#: corruption -> the block after it.
KERNELS: dict[str, Callable[[np.ndarray, np.ndarray, int, np.ndarray], np.ndarray]] = {
    "gaussian_noise": lambda x, i, s, m: x + _u(m) * s * 0.05,
    "shot_noise": lambda x, i, s, m: x + _u(m) * np.sqrt(np.abs(x)) * s * 0.06,
    "impulse_noise": lambda x, i, s, m: np.where(m % 20 < s, np.where(m < 1000, -1.0, 1.0), x),
    "speckle_noise": lambda x, i, s, m: x + x * _u(m) * s * 0.1,
    "defocus_blur": lambda x, i, s, m: _near(x, i, -s, s),
    "gaussian_blur": lambda x, i, s, m: x + (s / 5.0) * ((_at(x, i - 1) + 2 * x + _at(x, i + 1)) / 4 - x),
    "glass_blur": lambda x, i, s, m: _at(x, i + m % (2 * s + 1) - s),
    "motion_blur": lambda x, i, s, m: _near(x, i, 0, s),
    "zoom_blur": lambda x, i, s, m: (x + _at(x, np.floor(i / (1 + s * 0.1))) + _at(x, np.floor(i / (1 + s * 0.2)))) / 3,
    "snow": lambda x, i, s, m: np.where(m % 20 < 2 * s, x + 0.5, x),
    "frost": lambda x, i, s, m: x * (1 - s * 0.1) + np.where(i % 5 == 0, s * 0.1, 0.0),
    "fog": lambda x, i, s, m: x * (1 - s * 0.1) + s * 0.1,
    "spatter": lambda x, i, s, m: np.where(m % 20 < s, 0.0, x),
    "brightness": lambda x, i, s, m: x + s * 0.1,
    "contrast": lambda x, i, s, m: _mean(x) + (x - _mean(x)) / (1 + s * 0.5),
    "elastic_transform": lambda x, i, s, m: _at(x, i + np.where(i // 8 % 2 == 0, s, -s)),
    "pixelate": lambda x, i, s, m: np.rint(x * (10 / s)) / (10 / s),
    "jpeg_compression": lambda x, i, s, m: np.rint(x * (40 / s)) / (40 / s) + np.where(i % 8 == 0, s * 0.01, 0.0),
    "saturate": lambda x, i, s, m: np.fmax(-1.0, np.fmin(1.0, x * (1 + s * 0.2))),
}


def _mixed(ids: pa.Array, i: np.ndarray, s: int) -> np.ndarray:
    """0 to 2000, whatever the id's size; not a number for a null id."""
    row = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64) % 2001
    m = (row[:, None] * 7919 + i * 10459 + s * 1013) % 2001
    if not ids.null_count:
        return m
    return np.where(pc.is_null(ids).to_numpy(zero_copy_only=False)[:, None], np.nan, m)


def _block(x: np.ndarray, gone: np.ndarray | None, ids: pa.Array, name: str, s: int) -> pa.Array:
    """The block's elements after a corruption, row by row; ``gone``: where nulls were."""
    if name not in KERNELS:
        raise ValueError(f"unknown corruption {name}")
    kernel, i = KERNELS[name], np.arange(x.shape[1])
    m = _mixed(ids, i, s)
    with np.errstate(all="ignore"):
        y = kernel(x, i, s, m).ravel()
        if gone is None and not ids.null_count:
            return pa.array(y)
        # what is no number although every number was 0 has read a null
        return pa.array(y, mask=np.isnan(kernel(np.where(gone, np.nan, 0.0) if gone is not None else np.zeros(x.shape), i, s, m)).ravel())


def _lists(values: pa.Array, n: int, length: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * length, pa.int32()), values)


def corrupt(rows: DataFrame, vector: str, plan: DataFrame, id_col: str) -> DataFrame:
    """Every row under every condition (corruption, severity, condition) of the plan: ``x`` is the vector after it; an unknown name is an error.

    Rows times conditions is what is asked for; the plan has a few dozen rows and goes to the tasks.  A table of few files
    is dealt over all cores first, as each row is worked on many times.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    v = "_v"
    schema = StructType([*rows.schema.fields, *plan.schema.fields, StructField("x", ArrayType(DoubleType()))])
    names, wanted = schema.names, plan.toArrow()
    conditions = wanted.select(["corruption", "severity"]).to_pylist()

    def under_all(part: pa.RecordBatch, x: np.ndarray | None, gone: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        kept, n = part.columns[:-1], part.num_rows
        for k, c in enumerate(conditions):
            plan_columns = [pa.repeat(column[k], n) for column in wanted.columns]
            if x is None:
                out = pa.nulls(n, pa.list_(pa.float64()))
            else:
                out = _lists(_block(x, gone, part.column(id_col), c["corruption"], c["severity"]), n, x.shape[1])
            yield pa.RecordBatch.from_arrays([*kept, *plan_columns, out], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(v)), -1).to_numpy(zero_copy_only=False)
            for length in np.unique(sizes):
                same = b.filter(pa.array(sizes == length))
                step = max(1, BLOCK // max(1, length))
                for at in range(0, same.num_rows, step):
                    part = same.slice(at, step)
                    if length < 0:
                        yield from under_all(part, None, None)
                        continue
                    flat = part.column(v).flatten()
                    gone = pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(-1, length) if flat.null_count else None
                    x = flat.to_numpy(zero_copy_only=False).reshape(part.num_rows, length)
                    yield from under_all(part, x, gone)

    return rows.withColumn(v, F.col(vector).cast("array<double>")).mapInArrow(run, schema)
