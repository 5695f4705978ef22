"""Near-duplicate groups: one-permutation MinHash with optimal densification, bands, stars, exact confirmation.

1. Every text becomes its set of word shingles (64-bit hashes).  Texts with equal sets are one *class*, known by a
   128-bit digest of the set; buckets, sets and pairs are keyed by it, links and components by the class's least id.
2. A set gets one signature from one hash pass: the hash range is cut into ``bins``
   bins and each keeps its least hash; an empty bin takes the value of a full one picked by a 2-universal
   sequence of its own (optimal densification).  ``bands`` bands of ``bins / bands`` values give bucket keys.
3. Each bucket proposes a star: its members against one centre, the member with the most company over all
   its buckets.  Pairs therefore number at most one per bucket entry, whatever a bucket's size.
   Every proposed pair is confirmed on the full sets; linked pairs are joined into components.
4. A star can miss a link between two members that both differ from the centre.  Buckets whose members are
   not yet in one component are therefore gathered into clusters, and each cluster is compared exactly in
   blocks of bounded rows and hashes; a task returns spanning links only, never the pairs.
   So every two classes that share a bucket and pass the similarity are in one component.

With 32 bands of 6, a pair at similarity 0.85 shares no bucket with probability below 3e-7 if bands were independent;
bins that densification filled are not, so short texts lose a little more: README has the measured recall by length.

Hot buckets, centres and classes are dealt over tasks (``common.HotKeys``).  Nothing is collected to the driver but
counts, and links while they are few (``components``).  Null or empty texts have an empty set, are linked with nothing and stand alone.  Repeated rows are copies of
each other.  A null id gets its group's id but never names a group, and is kept by none.  The same id on different texts
is one document: it links the groups of all its texts.  Very long texts are one set of 8 bytes a shingle in one
task, never more.  Ties (equal sizes, equal company) are settled by the digest.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HotKeys, cut, hot_keys, slices, small, tidy

_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    """Word -> 64-bit hash, remembered up to a limit."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word windows of the text, A-Z lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.array([hashes[x] for x in words], np.uint64)
    with np.errstate(over="ignore"):
        if len(w) < width:  # the whole sequence; its length keeps it apart from full windows
            h = np.uint64(len(w))
            for x in w:
                h = h * _M + x
            return _mix(np.array([h ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))
        n = len(w) - width + 1
        h = w[:n].copy()
        for k in range(1, width):
            h = h * _M + w[k : k + n]
        return np.unique(_mix(h))


class Signer:
    """Signatures of ``bins`` values, and the keys of their bands."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.edges = np.array([((k << 64) + self.bins - 1) // self.bins for k in range(self.bins)], dtype=np.uint64)
        self.all = np.arange(self.bins, dtype=np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(hashes, self.edges)
        end = np.append(at[1:], len(hashes))
        full = at < end
        sig = hashes[np.minimum(at, len(hashes) - 1)]
        if full.all():
            return sig
        if len(hashes) == 1:
            return np.full(self.bins, hashes[0])
        open_ = np.flatnonzero(~full)
        attempt = 0
        while len(open_):
            attempt += 1
            with np.errstate(over="ignore"):
                pick = _mix(self.all[open_] * np.uint64(2654435761) + np.uint64(attempt) * _M) % np.uint64(self.bins)
            pick = pick.astype(np.int64)
            hit = full[pick]
            sig[open_[hit]] = sig[pick[hit]]
            open_ = open_[~hit]
        return sig

    def buckets(self, hashes: np.ndarray) -> np.ndarray:
        sig = self.signature(hashes).reshape(self.bands, self.rows)
        with np.errstate(over="ignore"):
            key = np.arange(self.bands, dtype=np.uint64)
            for k in range(self.rows):
                key = _mix(key * _M + sig[:, k])
        return key.view(np.int64)


def sign(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, key (of the whole set), buckets: one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        hashes, signer = _Hashes(), Signer(bands, rows)
        for b in slices(batches, 1):
            n, keys, buckets = [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), width, hashes)
                n.append(len(s))
                keys.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                buckets.append(signer.buckets(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "key", "buckets"],
            )

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n_shingles long, key binary, buckets array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """key, set (little-endian 64-bit hashes) of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        hashes = _Hashes()
        for b in slices(batches, 1):
            sets = [shingle_set(t.as_py(), width, hashes).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["key", "set"])

    return docs.mapInArrow(run, "key binary, set binary")


def _linked(common: np.ndarray, a, b, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b (least ids) of the pairs (key_a, key_b, a, b) whose full sets are similar enough.

    A pair brings one set to the other's task; a centre of very many pairs is dealt over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 3):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y)
                keep.append(bool(_linked(both - len(np.union1d(x, y)), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("key").alias("key_b"), F.col("set").alias("set_b")), "key_b")
    two = hot_keys(pairs, ["key_a"]).join(one, sets.select(F.col("key").alias("key_a"), F.col("set").alias("set_a")), ["key_b"])
    return two.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _joined(a: list[int], b: list[int]) -> dict[int, int]:
    """Each node of the links (a, b), and its smallest reachable node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a, b, strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in list(parent)}


def components(links: DataFrame, name: str = "components", few: int = 100_000) -> DataFrame:
    """node, component (its smallest reachable node) of every node of the links (a, b), a table that was cut.

    Up to ``few`` links (16 bytes each) are joined on the driver: rounds over so little are nothing but tasks.  More are
    joined by large-star and small-star rounds: each is two aggregations with map-side minima, and a node with very many
    neighbours is dealt over tasks where its minimum goes back to them; links that stay the same end the loop.
    """
    fact = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])
    links = links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    n = links.count()
    if n > few:
        links = cut(links.distinct(), name)
        n = links.count()
    if n <= few:
        held = links.toArrow()
        found = _joined(held["a"].to_pylist(), held["b"].to_pylist())
        made = pa.table({"node": pa.array(found.keys(), pa.int64()), "component": pa.array(found.values(), pa.int64())})
        return links.sparkSession.createDataFrame(made, "node long, component long")
    before = fact(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        hubs = HotKeys(least.select("a", "n"), ["a"], 2 * before[0])
        large = hubs.join(both.where("b > a"), least.select("a", F.least("a", "m").alias("m")), ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = HotKeys(low.select("a", "n"), ["a"], 2 * before[0]).join(large, low.select("a", "m"), ["b"])
        small_ = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        links = cut(small_, name)
        state = fact(links)
        if state == before:
            break
        before = state
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())


def _common(rows: np.ndarray, n: int, owner: np.ndarray, col: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Shared hashes of each of ``rows`` with each of the n sets of a block, as len(rows) x n counts.

    ``owner``/``col``: entries in order of their hash; ``begin``: where each hash's entries begin; ``starts``: each set's hashes
    (``starts[k]``).  Hashes that many sets hold go through products of 0/1 matrices, a slice of columns at a time; the
    others through their lists of owners, a bounded number of entries at a time.
    """
    df = np.diff(begin)
    out = np.zeros(len(rows) * n, np.int32)
    dense = np.flatnonzero(df > max(8, n // 16))
    place = np.full(len(df), -1)
    for k in range(0, len(dense), 2048):
        part = dense[k : k + 2048]
        place[part] = np.arange(len(part))
        at = np.concatenate([np.arange(begin[c], begin[c + 1]) for c in part])
        x = np.zeros((n, len(part)), np.float32)
        x[owner[at], place[col[at]]] = 1
        out += (x[rows] @ x.T).astype(np.int32).ravel()
    few = df <= max(8, n // 16)
    held, entry_row, entry_col = 0, [], []

    def flush() -> None:
        nonlocal held, entry_row, entry_col, out
        if held:
            r, c = np.concatenate(entry_row), np.concatenate(entry_col)
            reps = df[c]
            first = np.repeat(begin[c] - (np.cumsum(reps) - reps), reps)
            out += np.bincount(np.repeat(r, reps) * n + owner[first + np.arange(len(first))], minlength=len(out)).astype(np.int32)
        held, entry_row, entry_col = 0, [], []

    for k, i in enumerate(rows):
        c = starts[i]
        c = c[few[c]]
        entry_row.append(np.full(len(c), k))
        entry_col.append(c)
        held += int(df[c].sum())
        if held > 2_000_000:
            flush()
    flush()
    return out.reshape(len(rows), n)


def _spanning(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different components of one block, enough to span them.

    All but the largest component are compared with everything, a few rows at a time, by the hashes that at least two
    sets hold.
    """
    n = len(ids)
    names, inverse, sizes_ = np.unique(comps, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(inverse != np.argmax(sizes_))
    if len(names) < 2 or not len(rest):
        return []
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[col] > 1
    owner, col = owner[shared], col[shared]
    col = np.unique(col, return_inverse=True)[1]
    ends = np.cumsum(np.bincount(owner, minlength=n))
    starts = np.split(col, ends[:-1])
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    begin = np.searchsorted(col, np.arange(int(col[-1]) + 2 if len(col) else 1))
    found, parent = [], {c: c for c in names.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    for k in range(0, len(rest), 256):
        part = rest[k : k + 256]
        common = _common(part, n, owner, col, begin, starts).astype(np.int64)
        near = _linked(common, size[part][:, None], size[None, :], percent) & (comps[part][:, None] != comps[None, :])
        for i, j in zip(*np.nonzero(near), strict=True):
            p, q = root(int(comps[part[i]])), root(int(comps[j]))
            if p != q:
                parent[p] = q
                found.append((int(ids[part[i]]), int(ids[j])))
    return found


def _rest_of_clusters(members: DataFrame, hot: HotKeys, comps: DataFrame, sets: DataFrame, percent: int, block_hashes: int, block_rows: int) -> DataFrame | None:
    """Links that stars missed: members (bucket, key, rep, n, n_shingles) of buckets whose members fall into several components."""
    labelled = members.where("n > 2").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = cut(labelled.select("bucket", "key", "rep", "n_shingles", "component"), "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("first")).where("lo <> hi")
    edges = hot.join(labelled, mixed.select("bucket", "first"), ["key"])
    edges = cut(edges.select(F.col("rep").alias("a"), F.col("first").alias("b"), "key", "component", "n_shingles"), "mixed")
    if edges.isEmpty():
        return None
    clusters = components(edges.select("a", "b"), "clusters")
    nodes = edges.select(F.col("a").alias("node"), "key", F.col("component").alias("linked"), "n_shingles").distinct()
    nodes = cut(nodes.join(clusters, "node").select("node", "key", "linked", "n_shingles", F.col("component").alias("cluster")), "nodes")
    # an eighth of the cluster or block_rows, whichever is less, so that a cluster of some hundreds is several tasks too
    each = F.least(F.lit(float(block_rows)), F.greatest(F.lit(100.0), F.count("*") / 8))
    count = F.greatest(F.ceil(F.sum("n_shingles") / F.lit(block_hashes)), F.ceil(F.count("*") / each)).cast("int")
    blocks = nodes.groupBy("cluster").agg(count.alias("blocks"))
    placed = hot_keys(nodes, ["cluster"]).join(nodes, blocks, ["key"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # the cell (i, j) holds blocks i and j: every two members meet in one cell at least
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "linked", "key")
    cells = cells.join(sets, "key")

    def compare(pdf):
        import pandas as pd

        found = _spanning(pdf["node"].to_numpy(), pdf["linked"].to_numpy(), [np.frombuffer(s, np.uint64) for s in pdf["set"]], percent)
        tidy()
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return cells.select("cluster", "i", "j", "node", "linked", "set").groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")


def _several_texts(named: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) from an id on different texts to the least ids of their classes; None if no id is."""
    several = named.groupBy("doc_id").agg(F.min(F.xxhash64("key")).alias("lo"), F.max(F.xxhash64("key")).alias("hi")).where("lo <> hi").select("doc_id")
    several = cut(several, "several")
    if several.isEmpty():
        return None
    versions = named.select("doc_id", "key").join(small(several, 1_000_000), "doc_id", "left_semi").distinct()
    return versions.join(classes.select("key", "rep"), "key").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85,
    bands: int = 32, rows: int = 6, broadcast_ids: int = 1_000_000, block_hashes: int = 1_000_000, block_rows: int = 1000,
) -> DataFrame:
    """id, n_shingles, component_id, kept: one row per row of ``docs``.

    Linked are documents whose sets have ``100 * intersection >= percent * union``; ``component_id`` is the least
    id reachable.  ``broadcast_ids``: up to so many candidate ids (8 bytes each) are broadcast, more are joined by shuffle.
    ``block_hashes`` and ``block_rows`` bound half of what one task of the exact comparison holds.
    """
    signed = cut(sign(docs, id_col, text_col, width, bands, rows), "signed")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets have equal buckets, so any row's will do; exact copies meet map-side
    classes = named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("buckets").alias("buckets"))
    classes = cut(classes, "classes")
    # entries go by an 8-byte hash of the key: few stand in a bucket with others, and only those get their class back
    entries = classes.select(F.xxhash64("key").alias("h"), F.explode("buckets").alias("bucket"))
    full = cut(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "full")
    hot = HotKeys(full, ["bucket"], bands * classes.count())
    shared = hot.join(entries, full, ["h"])
    members = cut(shared.join(classes.select(F.xxhash64("key").alias("h"), "key", "rep", "n_shingles"), "h").drop("h"), "members")
    company = members.groupBy("key").agg(F.sum("n").alias("company"))
    ranked = members.select("bucket", "key", "rep", "n_shingles").join(company, "key")
    centre = ranked.groupBy("bucket").agg(F.max(F.struct("company", "key", "rep", "n_shingles")).alias("c"))
    centre = centre.select("bucket", F.col("c.key").alias("key_a"), F.col("c.rep").alias("a"), F.col("c.n_shingles").alias("size"))
    star = hot.join(members, centre, ["key"]).where("key <> key_a").where(
        F.lit(100) * F.least("n_shingles", "size") >= F.lit(percent) * F.greatest("n_shingles", "size")
    )
    pairs = cut(star.select("key_a", "a", F.col("key").alias("key_b"), F.col("rep").alias("b")).distinct(), "pairs")
    wanted = members.where("n > 2").select("rep").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = cut(wanted.select(F.col("rep").alias("doc_id")), "wanted")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chosen = source.join(small(wanted, broadcast_ids), "doc_id", "left_semi")
    sets = cut(_sets(chosen.select("doc_id", "text"), width).dropDuplicates(["key"]), "sets")
    links = confirm(pairs, sets, percent)
    versions = _several_texts(named, classes)
    links = cut(links if versions is None else links.union(versions), "links")
    comps = components(links)
    more = _rest_of_clusters(members, hot, comps, sets, percent, block_hashes, block_rows)
    if more is not None:
        more = cut(more, "more")
        if not more.isEmpty():
            comps = components(links.union(more))
    found = classes.select("key", "rep", "n").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.where("n > 1 or component is not null").select("key", F.coalesce("component", "rep").alias("found"))
    out = HotKeys(classes.select("key", "n"), ["key"], signed.count()).join(signed.select("doc_id", "n_shingles", "key"), found, ["doc_id"], "left")
    component = F.coalesce("found", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
    return out.withColumnRenamed("doc_id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group: of the document of least id, and of its repeated rows the one of least hash.

    Rows without an id are kept: no id tells them from another document's.
    """
    found = near_duplicates(docs, id_col, text_col, **options).where(F.col(id_col).isNotNull())
    found = cut(found.select(F.col(id_col).alias("_id"), "kept"), "found")
    gone = cut(found.where("not kept").select("_id").distinct(), "gone")
    own = docs[id_col].cast("long")
    kept = docs.join(small(gone, 1_000_000), own == gone["_id"], "left_anti")
    again = cut(found.where("kept").groupBy("_id").count().where("count > 1").select("_id"), "again")
    if again.isEmpty():
        return kept
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    ids = small(again, 1_000_000)
    copies = kept.join(ids, own == again["_id"], "left_semi").withColumn("_row", F.xxhash64(*hashed))
    least = cut(copies.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min("_row").alias("_least")), "least")
    one = copies.join(small(least, 1_000_000), (F.col(id_col).cast("long") == F.col("_id")) & (F.col("_row") == F.col("_least")), "left_semi")
    return kept.join(ids, own == again["_id"], "left_anti").union(one.drop("_row").dropDuplicates([id_col]))
