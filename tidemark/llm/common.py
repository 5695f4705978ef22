"""Helpers that the corpus operators share: shared storage, sized broadcasts, words."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_dir

#: A word everywhere in this package: a run of anything but space, tab, LF, VT, FF and CR.
#: ``bytes.split()`` cuts at exactly these six bytes, which is what the Python kernels use.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold ``rows`` rows, unless the session has a setting of its own: texts are large, and ten thousand of them are
    tens of megabytes outside the heap in every task, several times over while a batch grows.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def brief_shuffles(spark: SparkSession) -> None:
    """Let a query's shuffle files go when it ends, unless the session has a setting of its own: a chain of cut tables never reads them
    again, and otherwise they stay on the executors' disks until the driver happens to collect garbage, three small files a map task.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if key not in spark.conf.getAll:
        spark.conf.set(key, "true")


def few_processes(spark: SparkSession) -> dict[str, str]:
    """Writer options for tables that only this query reads: on a mounted folder (``file:``) no checksum file beside each file, unless the
    session has a file system of its own. Without Hadoop's native library every file written there costs a ``chmod`` process, started from the
    executor's JVM, and its checksum file more of them. Other file systems ignore these options.
    """
    if spark.sparkContext._jsc.hadoopConfiguration().get("fs.file.impl"):
        return {}
    return {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def scratch(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call uses; deleted when the driver exits."""
    small_batches(spark)
    brief_shuffles(spark)
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}/{name}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    A lost executor then costs a reread of a file, never a recomputation, and each
    expensive Python pass runs once however often its result is used.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**few_processes(spark)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(since: int = 0, keep: str | None = None) -> None:
    """Delete what :func:`cut` wrote after the first ``since`` tables, but for those under ``keep``. Call it only once the results have been stored."""
    gone, _written[since:] = [w for w in _written[since:] if w[1] != keep], [w for w in _written[since:] if w[1] == keep]
    for spark, path in gone:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path).getParent()
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: its shared folder is then the cluster's to clean
            return


def stored(df: DataFrame, name: str, since: int) -> DataFrame:
    """:func:`cut`, and let go of all tables cut after the first ``since`` (:func:`written`), which only went into this one."""
    out = cut(df, name)
    release(since, _written[-1][1])
    return out


def written() -> int:
    """How many tables are kept now."""
    return len(_written)


atexit.register(release)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else ``df`` unhinted (a shuffled join).

    ``max_rows`` times the row width of the call bounds what is sent; the count reads a table that was cut.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


class HotKeys:
    """The keys that hold so many rows that one task should not get them all.

    A key is hot if it holds more than ``least`` rows and more than one in ``most`` of ``total``: there are fewer than
    ``most`` such keys whatever the data, so their list may be broadcast, and any other key is a small share of all.
    ``counts``: keys and ``n``, their rows.
    """

    def __init__(self, counts: DataFrame, keys: list[str], total: int, least: int = 1000, most: int = 100_000):
        self.keys, limit = keys, max(least, total // most)
        self.any = total > limit  # else no key can be hot
        if not self.any:
            return
        hot = counts.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_salts"))
        self.hot = cut(hot, "hot")
        self.any = not self.hot.isEmpty()

    def join(self, left: DataFrame, right: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
        """``left`` join ``right`` on the keys; a hot key's left rows are dealt over tasks by ``spread``, its right rows repeated to each.

        With ``how="left"`` rows with a null key, which meet nothing, are dealt out as well.
        """
        deal = F.xxhash64(*spread)
        salt = F.lit(0)
        if self.any:
            left = left.join(F.broadcast(self.hot), self.keys, "left")
            right = right.join(F.broadcast(self.hot), self.keys, "left")
            salt = F.coalesce(F.pmod(deal, F.col("_salts")).cast("int"), salt)
            right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_salts")
        else:
            right = right.withColumn("_salt", F.lit(0))
        if how == "left":
            for k in self.keys:
                salt = F.when(F.col(k).isNull(), F.pmod(deal, F.lit(1024)).cast("int")).otherwise(salt)
        left = left.withColumn("_salt", salt).drop("_salts")
        return left.join(right, [*self.keys, "_salt"], how).drop("_salt")


def hot_keys(left: DataFrame, keys: list[str], least: int = 1000, most: int = 100_000) -> HotKeys:
    """The hot keys of a table that was cut, counted."""
    return HotKeys(left.groupBy(*keys).agg(F.count("*").alias("n")), keys, left.count(), least, most)


def tidy() -> None:
    """Give a worker process's freed memory back to the system: it is reused by many tasks, beside others."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it keeps
        pass


def slices(batches: Iterator, column: int, most: int = 4_000_000) -> Iterator:
    """The batches' rows in slices of about ``most`` bytes of a text column (one row at least), so that what a kernel builds beside them is bounded."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield b.slice(at, end - at)
            at = end
    tidy()


def n_words(text):
    """Words in a text column; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(t, SPACE), lambda w: w != F.lit("")))
