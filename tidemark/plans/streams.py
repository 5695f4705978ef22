"""Streaming queries over ``events`` and ``embeddings``, drained to the end; most have the batch answer in SQL beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import scratch
from tidemark.streaming import streams

from .common import rounded, table
from .routing import _ALL, _ARMS, _TH, BANK, bank, descriptors


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return streams.source(spark, sf_dir, table(spark, sf_dir, name).schema, f"{name}.parquet")


def _drained(stream: DataFrame, *keys: str) -> DataFrame:
    return streams.drain(stream, f"q_{uuid.uuid4().hex}", list(keys) or None)


def _feed(spark: SparkSession, *parts: DataFrame) -> DataFrame:
    """A stream that reads the parts one after the other, a file each trigger."""
    path = scratch(spark, "feed")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return streams.source(spark, path, parts[0].schema)


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` up to the 15th and after it: two triggers in order of time."""
    e = table(spark, sf_dir, "events")
    return _feed(spark, e.where("dayofmonth(ts) <= 15"), e.where("dayofmonth(ts) > 15"))


def stream_tumbling_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drained(streams.tumbling_moments(_halves(spark, sf_dir), "ts", "value", "1 day", "10 minutes", "event_type"), "event_type", "start")
    nudged = lambda c: (F.col(c) + 1e-8).alias(c)  # noqa: E731  means of two-decimal values may fall on a rounding edge
    return rounded(out.select("event_type", F.dayofmonth("start").alias("day"), "n", nudged("mean"), nudged("var")), "mean", "var")


TUMBLE_SQL = "select event_type, extract(day from ts)::int as day, count(*)::bigint as n, round(avg(value) + 1e-8, 6) as mean, round(greatest(avg(value * value) - avg(value) * avg(value), 0) + 1e-8, 6) as var from events group by 1, 2"


def stream_late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth event comes after all others: the watermark drops those whose day is over, and closed days are final.

    The watermark stands two days behind the latest event, and a trigger judges late rows by the one before its predecessor
    ended, so a trigger of a few more events goes between.
    """
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 50
    second = e.where("dayofmonth(ts) > 15")
    feed = _feed(spark, e.where("dayofmonth(ts) <= 15").where(k != 0), second.where(k > 1), second.where(k == 1), e.where(k == 0))
    out = _drained(streams.tumbling_moments(feed, "ts", "value", "1 day", "2 days"), "start")
    return out.select(F.dayofmonth("start").alias("day"), "n")


LATE_SQL = """with m as (select max(ts) - interval 2 days as mark from events where event_id % 50 > 1)
select extract(day from ts)::int as day, count(*)::bigint as n from events, m where event_id % 50 <> 0 or date_trunc('day', ts) + interval 1 day > mark group by 1"""


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions open at the end of a trigger go on in the next; each is given out once, when the watermark has passed its end.

    Two marker rows of a later date follow: the first moves the watermark past all events, the second brings a trigger that sees it.
    """
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    marks = [spark.createDataFrame([(-1, day)], "user_id long, ts string").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts")) for day in ("2100-01-01", "2100-02-01")]
    feed = _feed(spark, e.where("dayofmonth(ts) <= 15"), e.where("dayofmonth(ts) > 15"), *marks)
    out = _drained(streams.sessions(feed, "ts", "user_id", "6 hours", "1 minute")).where("user_id >= 0")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


SESSIONS_SQL = """with g as (select user_id, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hours or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events)
select user_id, sum(new)::bigint as sessions, count(*)::bigint as events from g group by 1"""


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event is sent again in a later trigger, and once more in the same."""
    e = table(spark, sf_dir, "events")
    feed = _feed(spark, e.where("dayofmonth(ts) <= 15"), e.where("dayofmonth(ts) > 15 or event_id % 3 = 0").union(e.where("event_id % 3 = 0")))
    out = _drained(streams.deduplicated(feed, "ts", ["event_id"], "60 days"))
    return out.groupBy("event_type").agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("events"))


def stream_bank_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's value as a one-channel batch of unit variance against a bank of three levels; the nearest wins."""
    static = spark.createDataFrame([("low", 10.0, 25.0), ("mid", 50.0, 100.0), ("high", 120.0, 400.0)], "label string, bank_mean double, bank_var double")
    e = _stream(spark, sf_dir, "events").select("event_id", F.col("value").alias("mean"), F.lit(1.0).alias("var"))
    out = _drained(streams.nearest_state(e, static))
    best = out.groupBy("event_id").agg(F.min(F.struct("distance", "label")).alias("m"))
    return best.groupBy(F.col("m.label").alias("label")).agg(F.count("*").alias("n"))


BANK_SQL = """with b(label, bm, bv) as (values ('low', 10e0, 25e0), ('mid', 50e0, 100e0), ('high', 120e0, 400e0)),
d as (select event_id, label, (1 + pow(value - bm, 2)) / (2 * bv) + (bv + pow(value - bm, 2)) / 2 - 1 as d from events cross join b)
select label, count(*)::bigint as n from (select event_id, min_by(label, (d, label)) as label from d group by 1) group by 1"""


def stream_lag_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routed arm as a stateful stream over batch descriptors written in order."""
    from .routing import _threshold

    entries = {(r[0], r[1]): (r[2], r[3]) for r in bank(spark, sf_dir).select("label", "ch", "mean", "var").collect()}
    width = max(ch for _, ch in entries) + 1
    fixed = [(b, [entries[b, c][0] for c in range(width)], [entries[b, c][1] for c in range(width)]) for b in BANK]
    packed = descriptors(spark, sf_dir).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("ch", "mean", "var"))).alias("s"))
    packed = packed.select(F.lit("routed").alias("arm"), "seq", F.transform("s", lambda x: x["mean"]).alias("mean"), F.transform("s", lambda x: x["var"]).alias("var"))
    path = _folder(spark, packed)
    src = spark.readStream.schema(packed.schema).parquet(path)
    out = _drained(streams.lagged_router(src, fixed, float(_threshold(spark, sf_dir).first()[0]), digits=6))
    return out.select("seq", "chosen", "fallback", "state_loaded")


def _folder(spark: SparkSession, rows: DataFrame) -> str:
    """Rows written where driver and executors both see them, for a stream to read."""
    path = scratch(spark, "stream")
    rows.write.parquet(path)
    return path


def _reports(spark: SparkSession, sf_dir: str, client: str) -> DataFrame:
    size = (1 + F.col("event_id") % 7).cast("long").alias("train_size")
    return _stream(spark, sf_dir, "events").select(F.dayofmonth("ts").cast("long").alias("round"), F.col(client).alias("client"), size, F.col("value").alias("train_loss"), F.col("ts").cast("timestamp").alias("ts"))


def stream_round_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as rounds: a round closes with its tenth client; until then a client's later report replaces its own."""
    return rounded(_drained(streams.round_barrier(_reports(spark, sf_dir, "user_id"), 10)), "train_loss")


def stream_evaluation_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same barrier over evaluations of all five registered clients, keyed by their round."""
    out = rounded(_drained(streams.round_barrier(_reports(spark, sf_dir, "event_type"), 5)), "train_loss")
    return out.withColumnsRenamed({"train_size": "test_size", "train_loss": "test_loss"})


_BARRIER_SQL = """with e as (select extract(day from ts)::bigint as round, {client} as client, 1 + event_id % 7 as s, value as x, row_number() over (partition by extract(day from ts) order by ts, {client}) as rn from events),
f as (select round, client, min(rn) as first from e group by 1, 2),
c as (select round, first as until from (select round, first, row_number() over (partition by round order by first) as k from f) where k = {need}),
l as (select round, client, arg_max(s, rn) as s, arg_max(x, rn) as x from e join c using (round) where rn <= until group by 1, 2)
select round, count(*)::bigint as n, sum(s)::bigint as {part}_size, round(sum(s * x) / sum(s), 6) as {part}_loss from l group by 1"""


def stream_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of even id report in the first trigger, the others in the second, when the first ones' timers have run out."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return _drained(streams.watchdog(_feed(spark, e.where("user_id % 2 = 0"), e.where("user_id % 2 <> 0")), "user_id", 1), "user_id")


PAIRS = {
    "stream_tumbling_moments": (stream_tumbling_moments, TUMBLE_SQL),
    "stream_late_windows": (stream_late_windows, LATE_SQL),
    "stream_sessions": (stream_sessions, SESSIONS_SQL),
    "stream_dedup": (stream_dedup, "select event_type, count(*)::bigint as rows, count(distinct event_id)::bigint as events from events group by 1"),
    "stream_bank_join": (stream_bank_join, BANK_SQL),
    "stream_lag_router": (stream_lag_router, f"with {_ALL}, {_TH}, {_ARMS} select seq, chosen, fallback, state_loaded from a where arm = 'routed'"),
    "stream_round_barrier": (stream_round_barrier, _BARRIER_SQL.format(client="user_id", need=10, part="train")),
    "stream_evaluation_barrier": (stream_evaluation_barrier, _BARRIER_SQL.format(client="event_type", need=5, part="test")),
    "stream_watchdog": (stream_watchdog, "select user_id, count(*)::bigint as seen, user_id % 2 = 0 as silent from events group by 1"),
}
