"""Removal of lines that many sites share.

A line (trimmed, not blank) is boilerplate if it stands on at least ``min_sites`` distinct sites.  Spread is
counted in two tiers: a HyperLogLog sketch of sites per line hash, merged by aggregation (map side first), and an
exact distinct count only for lines whose estimate is within ``band`` of the threshold.  No site list is ever
gathered, so a line on every site costs one sketch.

Boilerplate goes from every text, whatever its share of the text.  With ``spare_copies`` a text of more than ``max_share``
boilerplate words that is shown to be a copy (of the same text on another row, or of a near copy among such texts, by
``minhash.near_duplicates``) stays whole: its lines spread because the document does, and document-level
deduplication keeps one of its group.

Lines are cut in one map over the texts, which are never shuffled, while the boilerplate keys are few enough to be broadcast
(``broadcast_keys``, 16 bytes each).  Beyond that the lines' keys are joined by shuffle, a line of very many rows dealt over
tasks, and each text gets the list of its own.  Both ways give the same rows.

Null sites are no evidence of spread.  Null texts stay null and have no lines; blank lines are never removed, and an empty
text has none.  Very long texts are split once, in one task, in time linear in their length.  Repeated rows count as one
site and change alike, as removal depends on the text alone; a line at exactly ``min_sites`` sites goes.
Columns whose names start with ``_ld_`` are reserved; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HotKeys, cut, hot_keys, slices
from .minhash import near_duplicates

_TRIM = " \t\r\x0b\x0c"


def _hashes(col):
    """128 bits as two longs, of different seeds; :func:`line_keys` gives the same in Python."""
    return F.xxhash64(col).alias("h1"), F.xxhash64(F.lit("line"), col).alias("h2")


def line_keys(line: bytes) -> tuple[int, int]:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(line, 42), xxh64_intdigest(line, xxh64_intdigest(b"line", 42))


def lines_of(docs: DataFrame, text_col: str, *more) -> DataFrame:
    """h1, h2 (hashes of the trimmed line) and the columns ``more`` of every line that is not blank."""
    rows = docs.where(F.col(text_col).isNotNull()).select(*more, F.col(text_col).alias("_text"))
    kept = [c for c in rows.columns if c != "_text"]
    rows = rows.select(*kept, F.explode(F.split("_text", "\n")).alias("_raw"))
    rows = rows.select(*kept, F.btrim("_raw", F.lit(_TRIM)).alias("_line")).where("_line <> ''")
    return rows.select(*kept, *_hashes(F.col("_line")))


def shared_lines(lines: DataFrame, min_sites: int, band: float, lg_k: int, broadcast_keys: int) -> DataFrame:
    """h1, h2 of each line (rows: site, h1, h2) on at least ``min_sites`` sites."""
    sketched = lines.groupBy("h1", "h2").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sk"))
    # a line of one site is settled without reading its sketch
    wide = sketched.where("lo < hi" if min_sites > 1 else "lo is not null")
    wide = wide.select("h1", "h2", F.hll_sketch_estimate("sk").alias("sites")).where(F.col("sites") >= min_sites * (1 - band))
    wide = cut(wide, "wide")
    sure = wide.where(F.col("sites") > min_sites * (1 + band)).select("h1", "h2")
    near = wide.where(F.col("sites") <= min_sites * (1 + band)).select("h1", "h2")
    # a line counts once a site, whatever its rows: copies of one (line, site) meet map-side, before any join by shuffle
    exact = lines.where("site is not null").select("h1", "h2", "site")
    if near.limit(broadcast_keys + 1).count() <= broadcast_keys:
        exact = exact.join(F.broadcast(near), ["h1", "h2"], "left_semi").distinct()
    else:
        exact = exact.distinct().join(near, ["h1", "h2"], "left_semi")
    exact = exact.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h1", "h2")
    return cut(sure.union(exact), "shared")


class _Sorted:
    """Membership of many hashes at once in a sorted table of (h1, h2)."""

    def __init__(self, table: np.ndarray):
        self.table = table[np.lexsort((table[:, 1], table[:, 0]))] if len(table) else table.reshape(0, 2)

    def find(self, lines: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        first = np.fromiter((xxh64_intdigest(x, 42) for x in lines), np.uint64, len(lines))
        lo, hi = (np.searchsorted(self.table[:, 0], first, side) for side in ("left", "right"))
        hit = lo < hi
        for k in np.flatnonzero(hit):
            hit[k] = line_keys(lines[k])[1] in self.table[lo[k] : hi[k], 1]
        return hit


def _cleaned(text: bytes, found, max_share: float | None) -> tuple[bytes, int, int, bool]:
    """The text without its boilerplate, its lines, the lines cut, and whether they hold more than ``max_share`` of its words."""
    raw = text.split(b"\n")
    bare = [x.strip(_TRIM.encode()) for x in raw]
    at = [k for k, x in enumerate(bare) if x]
    bad = {at[k] for k in np.flatnonzero(found([bare[k] for k in at]))}
    if not bad:
        return text, len(at), 0, False
    over = max_share is not None and sum(len(raw[k].split()) for k in bad) > max_share * len(text.split())
    return b"\n".join(x for k, x in enumerate(raw) if k not in bad), len(at), len(bad), over


def _cut_lines(docs: DataFrame, text_col: str, max_share: float | None, table=None, keys_col: str | None = None) -> DataFrame:
    """``docs`` with texts cleaned by the broadcast table, or by each row's list of h1; ``_ld_whole``: the text before, if over the share."""
    given = [c for c in docs.columns if c != keys_col]
    at = docs.columns.index(text_col)
    schema = docs.select(given).schema.add("_ld_lines", "long").add("_ld_removed", "long").add("_ld_whole", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        everywhere = _Sorted(table.value).find if table is not None else None
        for b in slices(batches, at):
            texts, n_lines, n_cut, whole = [], [], [], []
            own = b.column(b.schema.get_field_index(keys_col)) if everywhere is None else None
            for i, t in enumerate(b.column(at)):
                text = t.as_py()
                if text is None:
                    clean, n, k, over = None, 0, 0, False
                elif everywhere is not None:
                    clean, n, k, over = _cleaned(text.encode(), everywhere, max_share)
                else:
                    mine = {x & (1 << 64) - 1 for x in own[i].as_py() or ()}
                    clean, n, k, over = _cleaned(text.encode(), lambda lines: np.array([xxh64_intdigest(x, 42) in mine for x in lines], bool), max_share)
                texts.append(clean)
                n_lines.append(n)
                n_cut.append(k)
                whole.append(text if over else None)
            made = {text_col: pa.array(texts, pa.binary()).cast(pa.string())}
            columns = [made.get(c, b.column(b.schema.get_field_index(c))) for c in given]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_cut, pa.int64()), pa.array(whole, pa.string())], names=[*given, "_ld_lines", "_ld_removed", "_ld_whole"]
            )

    return docs.mapInArrow(run, schema)


def spared_copies(out: DataFrame, text_col: str) -> DataFrame:
    """``out`` with the whole text back where it is a copy: on several rows, or near another of those over the share."""
    out = cut(out, "cleaned")
    over = cut(out.where("_ld_whole is not null").withColumn("_ld_doc", F.xxhash64("_ld_whole")), "over")
    if over.isEmpty():
        return out
    groups = cut(near_duplicates(over.select("_ld_doc", "_ld_whole"), "_ld_doc", "_ld_whole").select("_ld_doc", "component_id"), "groups")
    several = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    spared = hot_keys(groups, ["component_id"]).join(groups, several, ["_ld_doc"]).select("_ld_doc", F.lit(True).alias("_ld_spare")).distinct()
    over = hot_keys(over, ["_ld_doc"]).join(over, spared, ["_ld_doc", "_ld_lines"], "left")
    text = F.when(F.col("_ld_spare"), F.col("_ld_whole")).otherwise(F.col(text_col))
    removed = F.when(F.col("_ld_spare"), 0).otherwise(F.col("_ld_removed")).cast("long")
    over = over.withColumns({text_col: text, "_ld_removed": removed})
    return out.where("_ld_whole is null").unionByName(over.select(out.columns))


def line_dedup(
    docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = 6, band: float = 0.1, lg_k: int = 12,
    broadcast_keys: int = 500_000, spare_copies: bool = False, max_share: float = 0.5,
) -> DataFrame:
    """``docs`` with boilerplate lines cut out of the text, and ``_ld_lines`` (lines), ``_ld_removed`` (lines cut).

    ``band`` is over five standard errors of a sketch of 2**lg_k registers.  Up to ``broadcast_keys`` keys of shared
    lines (16 bytes each) are broadcast; more are joined by shuffle.
    """
    lines = lines_of(docs, text_col, F.col(site_col).cast("string").alias("site"))
    bad = shared_lines(lines, min_sites, band, lg_k, broadcast_keys)
    share = max_share if spare_copies else None
    if bad.limit(broadcast_keys + 1).count() <= broadcast_keys:
        rows = bad.toPandas().to_numpy(dtype=np.int64).view(np.uint64).reshape(-1, 2)
        out = _cut_lines(docs, text_col, share, table=docs.sparkSession.sparkContext.broadcast(rows))
    else:
        # keys are gathered by text, exact copies of a text once
        doc = F.struct(*_hashes(F.col(text_col)))
        pairs = cut(lines_of(docs, text_col, doc.alias("_ld_doc")).distinct(), "pairs")
        hits = hot_keys(pairs, ["h1", "h2"]).join(pairs, bad, ["_ld_doc"]).groupBy("_ld_doc").agg(F.collect_list("h1").alias("_ld_keys"))
        hits = cut(hits.select(F.col("_ld_doc.h1").alias("_ld_h1"), F.col("_ld_doc.h2").alias("_ld_h2"), "_ld_keys"), "hits")
        h1, h2 = _hashes(F.col(text_col))
        keyed = docs.withColumns({"_ld_h1": h1, "_ld_h2": h2, "_ld_row": F.monotonically_increasing_id()})
        counts = docs.select(h1.alias("_ld_h1"), h2.alias("_ld_h2")).groupBy("_ld_h1", "_ld_h2").agg(F.count("*").alias("n"))
        keyed = HotKeys(counts, ["_ld_h1", "_ld_h2"], docs.count()).join(keyed, hits, ["_ld_row"], "left")
        out = _cut_lines(keyed.select(*docs.columns, "_ld_keys"), text_col, share, keys_col="_ld_keys")
    if spare_copies:
        out = spared_copies(out, text_col)
    return out.drop("_ld_whole")


#: DuckDB: the same rows from table {docs} (doc_id, text, source and what else), by exact counts throughout.
LINE_DEDUP_SQL = r"""
with ld_rows as (select row_number() over () as ld_row, * from {docs}),
ld_lines as (
  select ld_row, source, i - 1 as pos, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as line, raw from (
    select ld_row, source, unnest(string_split(text, chr(10))) as raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i
    from ld_rows where text is not null)),
ld_bad as (select line from ld_lines where line <> '' group by line having count(distinct source) >= 6),
ld_marked as (select l.*, b.line is not null as bad from ld_lines l left join ld_bad b on l.line = b.line),
ld_new as (
  select ld_row, count(*) filter (line <> '') as n_lines, count(*) filter (bad) as n_bad,
    coalesce(string_agg(raw, chr(10) order by pos) filter (not bad), '') as clean
  from ld_marked group by ld_row)
"""
