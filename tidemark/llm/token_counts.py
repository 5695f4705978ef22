"""Token counts by a two-tier, map-side lookup.

Tier 1 is a hash table pre-token -> number of tokens, made on the driver from the most frequent
pre-tokens of a bounded sample and broadcast once (``max_entries`` pre-tokens of at most
``max_entry_chars`` characters: a proven bound).  Tier 2 is one cache for each Python worker process, kept from task to
task with the tokenizer: what tier 1 misses is encoded by the tokenizer itself and remembered, up to ``cache_bytes`` of
keys, values and their overhead.  Pre-tokens are never shuffled; the whole job is one map over the rows.

Counts are those of the library, bit for bit: byte-level BPE never merges across pre-tokens, so the
count of a text is the sum over its pre-tokens, and a text may be cut before any single space between two characters that
are no white space.  A run between two cuts that holds a code point outside the range in which our splitting pattern was
checked against the library's is encoded by the library whole; only texts with an added token's string go there as they are.

Null texts count as empty (0 bytes, 0 tokens); null ids stay null; repeated rows are counted each, so there is one result
row for each input row; other columns are ignored.  Very long texts are worked through in slices of about a million
characters, whatever their length; a run without a cut is encoded by the library in one piece and never cached.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: The byte-level BPE pre-tokenisation pattern (a fixed value of the tokenizer's file format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond these code points (Latin to Thai, general punctuation to CJK, Hangul) a run goes to the library whole;
#: within them tests/llm compares every code point's splitting with the library's.
UNCHECKED = r"[\x1c-\x1f\x85\u0558-\u058f\u0860-\u08ff\u0c00-\u0dff\u0e80-\u1fff\u2080-\u209f\u2e00-\u2fff\u3100-\u33ff\ua000-\uabff\ud7b0-\ufeff\U00010000-\U0010ffff]"
#: Where any text may be cut.
_cut = re.compile(r"(?<=\S)(?= \S)")
_odd = re.compile(r"  |\s \s| $").search
#: Keys of more characters are not cached; a cached key costs about this many bytes beside its own.
_LONGEST, _ENTRY = 48, 150


class _Cache:
    """String -> count in two generations of half the bytes each: what is asked for again moves to the young one, the old one goes."""

    def __init__(self, most: int):
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.held, self.most = 0, most // 2

    def find(self, keys: set[str]) -> dict[str, int]:
        young, old = self.young, self.old
        out = {k: young[k] for k in keys if k in young}
        again = {k: old[k] for k in keys if k in old and k not in out}
        self.add(again)
        out.update(again)
        return out

    def add(self, found: dict[str, int]) -> None:
        kept = [x for x in found.items() if len(x[0]) <= _LONGEST]
        for k in range(0, len(kept), 1000):
            part = dict(kept[k : k + 1000])
            size = sum(map(len, part)) + _ENTRY * len(part)
            if self.held + size > self.most:
                self.young, self.old, self.held = {}, self.young, 0
            self.young.update(part)
            self.held += size


class Lengths:
    """Tokens of whole texts, by tier 1, then the worker's caches, then the tokenizer.

    A text is first cut at its single spaces: a run with the space before it pre-tokenises on its own
    unless white space meets that space on both sides.  A known run costs one lookup; an unknown one is
    split into pre-tokens, and only pre-tokens that no tier knows are encoded, a batch at a time.
    """

    def __init__(self, head: dict[str, int], tokenizer, cache_bytes: int):
        self.head, self.tokenizer, self.cache_bytes = head, tokenizer, cache_bytes
        self.pieces, self.runs = _Cache(cache_bytes // 3), _Cache(2 * (cache_bytes // 3))
        added = _added(tokenizer)
        self.added = regex.compile(added).search if added else lambda t: None
        self.split, self.unchecked = regex.compile(PATTERN).findall, regex.compile(UNCHECKED).search

    def _encoded(self, strings: list[str]) -> Iterator[tuple[str, int]]:
        for k in range(0, len(strings), 1000):
            part = strings[k : k + 1000]
            yield from zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True)

    def _learn(self, runs: set[str]) -> dict[str, int]:
        """The count of every run."""
        out = self.runs.find(runs)
        split, unchecked, head = self.split, self.unchecked, self.head.get
        whole, parts, pieces = [], [], set()
        for r in runs:
            if r not in out:
                if unchecked(r):
                    whole.append(r)
                else:
                    parts.append((r, split(r)))
                    pieces.update(parts[-1][1])
        known = {p: n for p in pieces if (n := head(p))}
        known.update(self.pieces.find(pieces.difference(known)))
        fresh = dict(self._encoded(list(pieces.difference(known))))
        self.pieces.add(fresh)
        known.update(fresh)
        get = known.__getitem__
        counted = {r: sum(map(get, ps)) for r, ps in parts}
        counted.update(self._encoded(whole))
        self.runs.add(counted)
        out.update(counted)
        return out

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        for block in _blocks((i, s) for i, t in enumerate(texts) for s in ([t] if self.added(t) else _slices(t))):
            cut: list[tuple[int, list[str]]] = []
            for i, t in block:
                if self.added(t):
                    out[i] += len(self.tokenizer.encode(t, add_special_tokens=False))
                elif _odd(t):
                    cut.append((i, _cut.split(t)))
                else:
                    first, *rest = t.split(" ")
                    cut.append((i, [first, *(" " + r for r in rest)]))
            known = self._learn({r for _, rs in cut for r in rs}).__getitem__
            for i, rs in cut:
                out[i] += sum(map(known, rs))
        return out


def _slices(text: str, most: int = 1_000_000) -> Iterator[str]:
    """Parts of the text of about ``most`` characters, cut where any text may be."""
    at = 0
    while len(text) - at > most:
        found = _cut.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def _blocks(rows: Iterator[tuple[int, str]], most: int = 1_000_000) -> Iterator[list[tuple[int, str]]]:
    """Runs of rows of about ``most`` characters: what is worked on at once has a bound."""
    block, held = [], 0
    for row in rows:
        block.append(row)
        held += len(row[1])
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def _load(tokenizer_path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism; the library's threads keep memory of their own
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(tokenizer_path) if "/" not in tokenizer_path else tokenizer_path)


#: The one counter that a worker process holds: its call's name, and the counter.
_held: tuple[str, Lengths] | None = None


def worker_lengths(call: str, head, tokenizer: str, cache_bytes: int) -> Lengths:
    """This process's counter of the call, made by its first task and found again by the others; an older call's is let go."""
    global _held
    if _held is None or _held[0] != call:
        same = _held[1].tokenizer if _held and _held[0].split("|")[0] == call.split("|")[0] else None
        _held = None
        _held = (call, Lengths(head.value, same or _load(tokenizer), cache_bytes))
    return _held[1]


def _added(tokenizer) -> str | None:
    """A pattern for the strings of added tokens, which the library cuts out before pre-tokenising."""
    strings = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return "|".join(map(regex.escape, strings)) or None


def frequent_lengths(docs: DataFrame, text_col: str, tokenizer: str, sample_rows: int, max_entries: int, max_entry_chars: int) -> dict[str, int]:
    """The tier-1 table from about ``sample_rows`` rows. It only decides speed: a count never depends on it."""
    total = docs.count()
    if not total:
        return {}
    part = docs.select(text_col) if total <= sample_rows else docs.select(text_col).sample(fraction=sample_rows / total, seed=7)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = regex.compile(PATTERN).findall, Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(p for p in split(t) if len(p) <= max_entry_chars)
                if len(seen) > 8 * max_entries:
                    seen = Counter(dict(seen.most_common(2 * max_entries)))
        top = seen.most_common(2 * max_entries)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    # what the sample holds once is not frequent, and most of it is that
    counted = part.mapInArrow(pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1")
    rows = counted.orderBy(F.desc("n"), "piece").limit(max_entries).collect()
    encoder = _load(tokenizer)
    return {r[0]: len(encoder.encode(r[0], add_special_tokens=False).ids) for r in rows}


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", context: int = 1024,
    sample_rows: int = 2000, max_entries: int = 20_000, max_entry_chars: int = 32, cache_bytes: int = 128_000_000,
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row. ``tokenizer``: a file name in the tokenizer package, or a path."""
    spark = docs.sparkSession
    small_batches(spark)
    head = spark.sparkContext.broadcast(frequent_lengths(docs, text_col, tokenizer, sample_rows, max_entries, max_entry_chars))
    call = f"{tokenizer}|{uuid.uuid4().hex}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = worker_lengths(call, head, tokenizer, cache_bytes)
        for b in slices(batches, 1):
            texts = pc.fill_null(b.column(1), "")
            n = pa.array(lengths.count(texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.cast(pc.binary_length(texts), pa.int64()), n, pc.greater(n, context)], names=["id", "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
