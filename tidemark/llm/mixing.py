"""Mixing sources to target weights by the cube method.

Each source has a target in words; a document of the source is taken ``target / source size`` times on average (at most
``cap``).  The whole part of that is certain; the fraction is a probability, drawn by balanced sampling.  The flight
phase moves the probabilities of three documents at a time along the null space of their constraints (one row for the
documents taken, one for their words), up or down with the chances that keep every probability's mean, until one
of the three is 0 or 1.  So both totals stay exact while at most two documents of a block stay undecided.

Blocks are groups of about ``block_rows`` documents of one source, dealt by a hash of the row and of its number among the rows
equal to it (equal rows are counted map-side, not gathered), so a source with a third of all rows, or a row repeated a
million times, is as many blocks as it needs.  The undecided of all blocks are dealt into fewer blocks, again and again; the
last two of a source land where its words come nearest its target.  Draws come from a generator seeded by
source, block and level over sorted rows: reruns agree, whatever the partitions.

Null or empty texts have size 0 and are taken 0 times.  A null source is a source of its own, last in order.  Repeated rows
are documents of their own, one result row each.  Ties in size are moved in pairs.  Null ids stay null.  Very long texts are
counted by one regular expression, in time linear in their length.  Empty input: empty result.

Targets are worked out in one task over one row for each source, so sources may number in the millions, not more.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_keys, n_words

_TINY = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, rows, target: weights repeat over the sources by code point, null last.

    With sources in order of ``cap * size / weight``, the level that fills the rest if all before stop at their cap
    rises while sources do stop there and falls after: its maximum is the level, and a target is the lesser of
    cap and weight times level.  Windows run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.lit(cap) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / open_)
    target = F.least("most", F.col("weight") * F.max("level").over(everything))
    return per.select("source", "source_size", "rows", target.alias("target"))


def flight(prob: np.ndarray, size: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: all but two at most are 0 or 1; sum(prob) and sum(prob * size) are kept."""
    p, z = prob.tolist(), size.tolist()
    window: list[int] = []
    for nxt in range(len(p)):
        if not _TINY < p[nxt] < 1 - _TINY:
            p[nxt] = float(round(p[nxt]))
            continue
        window.append(nxt)
        while len(window) > 1:
            pair = next(((a, b) for i, a in enumerate(window) for b in window[i + 1 :] if z[a] == z[b]), None)
            if pair:
                move = [(pair[0], 1.0), (pair[1], -1.0)]
            elif len(window) == 3:
                a, b, c = window
                span = float(max(abs(z[c] - z[b]), abs(z[a] - z[c]), abs(z[b] - z[a])))
                move = [(a, (z[c] - z[b]) / span), (b, (z[a] - z[c]) / span), (c, (z[b] - z[a]) / span)]
            else:
                break
            up = min((1 - p[k]) / u if u > 0 else -p[k] / u for k, u in move if u)
            down = min(p[k] / u if u > 0 else (p[k] - 1) / u for k, u in move if u)
            step = up if draws.random() * (up + down) < down else -down
            for k, u in move:
                p[k] += step * u
                if not _TINY < p[k] < 1 - _TINY:
                    p[k] = float(round(p[k]))
            window = [k for k in window if 0 < p[k] < 1]
    return np.array(p)


def land(prob: np.ndarray, size: np.ndarray, before: np.ndarray, exchanges: int = 4) -> np.ndarray:
    """All 0 or 1: the last undecided (two at most) fall where the words come nearest what ``before`` expects.

    What words they then leave over or short are made good by a few exchanges at most: a document that was drawn
    for one that was not, of those that were open before the flight.
    """
    at = np.flatnonzero((prob > 0) & (prob < 1))
    picks = [np.array([bits >> k & 1 for k in range(len(at))], float) for bits in range(1 << len(at))]
    best = min(picks, key=lambda x: (abs(((x - prob[at]) * size[at]).sum()), abs((x - prob[at]).sum())))
    out = prob.copy()
    out[at] = best
    off = float(((best - prob[at]) * size[at]).sum())
    open_ = (before > _TINY) & (before < 1 - _TINY)
    for _ in range(exchanges):
        drawn, spare = np.flatnonzero(open_ & (out == 1)), np.flatnonzero(open_ & (out == 0))
        if not off or not len(drawn) or not len(spare):
            break
        spare = spare[np.argsort(size[spare], kind="stable")]
        wanted = size[drawn] - off  # the size that would settle the account in place of each drawn document
        right = np.searchsorted(size[spare], wanted).clip(0, len(spare) - 1)
        left = (right - 1).clip(0)
        near = np.where(abs(size[spare[left]] - wanted) <= abs(size[spare[right]] - wanted), left, right)
        gap = abs(size[spare[near]] - wanted)
        i = int(np.argmin(gap))
        if gap[i] >= abs(off):
            break
        off += float(size[spare[near[i]]] - size[drawn[i]])
        out[drawn[i]], out[spare[near[i]]] = 0.0, 1.0
    return out


def _of_source(rows: DataFrame, per: DataFrame, broadcast_sources: int) -> DataFrame:
    """``rows`` with what ``per`` (cut; one row a source) says of their source: broadcast if few, else a large source's rows are dealt over tasks."""
    key = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))).alias("_key")
    per = per.select(key, *[c for c in per.columns if c != "source"])
    rows = rows.select(key, *rows.columns)
    if per.limit(broadcast_sources + 1).count() <= broadcast_sources:
        return rows.join(F.broadcast(per), "_key").drop("_key")
    return hot_keys(rows, ["_key"]).join(rows, per, ["id", "size"]).drop("_key")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5, cap: float = 2.0, block_rows: int = 5000, broadcast_sources: int = 100_000,
) -> DataFrame:
    """id, source, size, source_size, target, copies, taken: one row for each row of ``docs``.

    ``share``: words of the mix over words of all sources; it must be at most ``cap``, the most times a document is taken.
    """
    if share > cap:
        raise ValueError("the mix cannot hold more words than cap times the sources")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).cast("long").alias("size"))
    sized = cut(sized, "sized")
    targets = cut(source_targets(sized, weights, share, cap), "targets")
    rows = _of_source(sized, targets, broadcast_sources)
    # equal rows get numbers 0, 1, ... by their count, a thousand to a row first, so that no task holds them all
    equal = [c for c in rows.columns]
    rows = rows.groupBy(*equal).agg(F.count("*").alias("_n"))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / 1000))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("_k") * 1000, F.least(F.col("_k") * 1000 + 999, F.col("_n") - 1)))).drop("_n", "_k")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + _TINY).cast("long")
    rows = rows.withColumn("sure", F.when(F.col("size") > 0, whole).otherwise(0)).withColumn("prob", F.when(F.col("size") > 0, F.greatest(rate - whole, F.lit(0.0))).otherwise(0.0))
    columns = "id {}, source string, size long, source_size long, rows long, target double, sure long, prob double, copy long".format(sized.schema["id"].dataType.simpleString())
    rows = rows.select("id", "source", "size", "source_size", "rows", "target", "sure", "prob", "copy")

    def flier(level: int):
        def fly(key, pdf):
            pdf = pdf.sort_values(["id", "size", "copy"], kind="stable", ignore_index=True, na_position="last")
            seed = zlib.crc32(repr((str(key[0]), int(key[1]), level)).encode())
            before, size = pdf["prob"].to_numpy(), pdf["size"].to_numpy()
            prob = flight(before, size, np.random.default_rng(seed))
            if int(pdf["blocks"].iloc[0]) == 1:
                prob = land(prob, size, before)
            return pdf.drop(columns=["block", "blocks"]).assign(prob=prob)

        return fly

    decided, level = None, 0
    blocks = F.greatest(F.ceil(F.col("rows") / block_rows), F.lit(1)).cast("long")
    while True:
        dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(level), "id", "size", "copy"), "blocks"))
        flown = dealt.groupBy("source", "block").applyInPandas(flier(level), columns)
        flown = cut(flown, f"flight{level}")
        done = flown.where("prob <= 0 or prob >= 1")
        decided = done if decided is None else decided.union(done)
        rest = flown.where("prob > 0 and prob < 1")
        if rest.isEmpty():
            break
        rows = _of_source(rest.drop("rows"), cut(rest.groupBy("source").agg(F.count("*").alias("rows")), "left"), broadcast_sources)
        rows = rows.select(*flown.columns)
        level += 1
    copies = F.col("sure") + F.col("prob").cast("long")
    out = decided.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return out
