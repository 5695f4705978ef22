"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance, over words.

A test item of n words may differ from a passage of a document by k = floor(rate * n) word edits (insertions,
deletions, substitutions).  Cut into k + 1 pieces, at least one piece stands in such a passage unchanged: the
pieces of all items form one Aho-Corasick automaton that every text is run through once.  Where a piece hits, the
window around it is verified with Myers' algorithm (one machine word of any length per item, one step per word).
The rate's edits are counted over the whole item, so the search is exact: it finds every passage within k edits.

Items come in blocks of ``block_chars``; each block is broadcast (a bounded size) and is one pass over the
documents; with several blocks each pass is stored and its broadcast let go before the next one.  A worker process builds a
block's automaton once and keeps it from task to task.  Words are runs of word characters, lower-cased, so case,
punctuation and spacing never count; in scripts written without spaces each character is a word.

Items of any length are searched: a short one has a budget of 0 and must stand in the text word for word.  Null items and
items without a word match nothing, as do null and empty documents; null ids stay null.  Items with the same text are reported
each; repeated rows are reported each; of several passages that hold an item the least distance counts.  Very long texts are
one run through the automaton, in time linear in their length and their hits.  Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small_batches

#: Thai to Myanmar, kana, Han: scripts without spaces between words.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_words = re.compile(rf"[^\W{_UNSPACED}]+|[{_UNSPACED}]").findall


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """Bounds of k + 1 runs of n words, as even as can be."""
    return [(n * i // (k + 1), n * (i + 1) // (k + 1)) for i in range(k + 1)]


def myers(masks: dict, n: int, window: list) -> int:
    """Least edit distance between the pattern (``masks``: symbol -> bits, n symbols) and any part of the window."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, n
    get = masks.get
    for symbol in window:
        eq = get(symbol, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus), plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # no carry into row 0: the match may start anywhere
        plus, minus = (mh | ~(xv | ph)) & full, ph & xv & full
        if score < best:
            best = score
    return best


class Matcher:
    """Items of one block, ready for many texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, places = [], {}
        for item_id, text in items:
            words = _words(text.lower())
            n = len(words)
            if not n:
                continue
            k, masks = int(rate * n), {}
            for i, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << i
            at = len(self.items)
            self.items.append((item_id, n, k, masks))
            for lo, hi in pieces(n, k):
                places.setdefault(" " + " ".join(words[lo:hi]) + " ", []).append((at, lo, hi - lo))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        if places:
            self.automaton.make_automaton()

    def match(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, distance) of each item that the text holds."""
        if not text or not self.items:
            return []
        words = _words(text.lower())
        line = " " + " ".join(words) + " "
        windows: dict[int, set[tuple[int, int]]] = {}
        last, before = 0, 0  # words before character ``last``
        for end, where in self.automaton.iter(line):
            before += line.count(" ", last, end)
            last = end
            for at, lo, length in where:
                _, n, k, _ = self.items[at]
                start = before - length - lo
                windows.setdefault(at, set()).add((max(0, start - k), min(len(words), start + n + k)))
        found = []
        for at, spans in windows.items():
            item_id, n, k, masks = self.items[at]
            best = n
            for lo, hi in sorted(spans):
                best = min(best, myers(masks, n, words[lo:hi]))
                if not best:
                    break
            if best <= k:
                found.append((item_id, best))
        return found


#: The matcher that a worker process holds: its block's name, and the matcher.
_held: tuple[str, Matcher] | None = None


def worker_matcher(name: str, items, rate: float) -> Matcher:
    """This process's matcher of the block, built by its first task and found again by the others."""
    global _held
    if _held is None or _held[0] != name:
        _held = None
        _held = (name, Matcher(items.value, rate))
    return _held[1]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Items a block at a time, and whether it is the last: the driver holds two blocks at most."""
    block, held, full = [], 0, None
    for r in benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        if full:
            yield full, False
            full = None
        block.append((r[0], r[1]))
        held += len(r[1])
        if held >= block_chars:
            full, block, held = block, [], 0
    if full or block:
        yield full or block, True


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    rate: float = 0.15, block_chars: int = 8_000_000,
) -> DataFrame:
    """id, item_id, distance (in words): one row for each document row and item that it holds."""
    spark, out = docs.sparkSession, None
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, item_id long, distance long"
    for block, last in _blocks(benchmark, item_col, item_text, block_chars):
        items, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], items=items, name=name) -> Iterator[pa.RecordBatch]:
            matcher = worker_matcher(name, items, rate)
            for b in slices(batches, 1):
                hits = [(i, *m) for i, t in enumerate(b.column(1)) for m in matcher.match(t.as_py())]
                rows, ids, distances = ([h[k] for h in hits] for k in range(3))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()), pa.array(distances, pa.int64())], names=["id", "item_id", "distance"]
                )

        found = docs.select(id_col, text_col).mapInArrow(run, schema)
        if not last:
            found = cut(found, "leaks")
            items.destroy()
        out = found if out is None else out.union(found)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("id", id_col)


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    rate: float = 0.15, block_chars: int = 8_000_000,
) -> DataFrame:
    """``docs`` without the rows that hold an item, by maps alone; columns as given."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text_col)
    for block, last in _blocks(benchmark, item_col, item_text, block_chars):
        items, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], items=items, name=name) -> Iterator[pa.RecordBatch]:
            matcher = worker_matcher(name, items, rate)
            for b in slices(batches, at):
                yield b.filter(pa.array([not matcher.match(t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = cut(docs, "clean")
            items.destroy()
    return docs
