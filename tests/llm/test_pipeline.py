"""The pipeline's stages on the smallest tables, and on odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from test_corpus import brute_components, distance

from tidemark.llm import common, decontaminate, minhash, quality_crf


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF).persist()
        if k < 4:
            assert after.columns == columns, name
        ids, old = ({r[0] for r in x.select("doc_id").collect()} for x in (after, before))
        assert ids <= old, name
        if name == "MinHash near-dedup":
            found = {r["doc_id"] for r in minhash.near_duplicates(before).where("kept").collect()}
            assert ids == found < old
        if name == "benchmark decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert old - ids == {r[0] for r in decontaminate.find_leaks(before, bench).select("doc_id").collect()}
        if name == "line dedup":
            assert ids == old
        before = after
    assert before.where("copies < 1 or taken <> copies * size").count() == 0


def test_run_equals_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "taken" in out.columns


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "some words " * 40, "en", None, 440), (3, "word " * 20_000, "en", "b", 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() >= 1


def brute_quality(rows, labels):
    """Whole documents in plain Python: the same model, every chain on its own."""
    told = {d: q for d, q in labels if q in (0, 1) and d is not None}
    learn = []
    for d, t, _ in rows:
        if d in told and zlib.crc32(str(d).encode()) % 5:
            lines = (t or "").encode().split(b"\n")
            x = quality_crf.line_features(lines).astype(np.float32).astype(float)
            learn.append((told[d], x, np.array([len(v) + 1 for v in lines], np.float32).astype(float)))
    learn.sort(key=lambda r: (r[0], r[1].astype(np.float32).tobytes(), r[2].astype(np.float32).tobytes()))
    model = quality_crf.fit(learn)
    return [r for r in rows if quality_crf.score_texts([r[1]], model)[0] >= 0.3]


def brute_lines(rows, min_sites=6):
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if bare(x) and s is not None:
                sites[bare(x)].add(s)
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    over = [(d, t) for d, t, _ in rows if t and 2 * sum(len(x.encode().split()) for x in t.split("\n") if bare(x) in bad) > len(t.encode().split())]
    groups = brute_components([(k, t) for k, (_, t) in enumerate(over)])
    size = Counter(c for _, c in groups.values())
    spared = {over[k][1] for k, (_, c) in groups.items() if size[c] > 1}
    return [(d, t if t is None or t in spared else "\n".join(x for x in t.split("\n") if bare(x) not in bad), s) for d, t, s in rows]


def brute_leaks(rows, items):
    split = lambda t: re.findall(r"\w+", t.lower())
    wanted = [split(t) for _, t in items if t]
    out = []
    for d, t, s in rows:
        words = split(t or "")
        have, leaks = set(words), False
        for p in wanted:
            k = int(0.15 * len(p))
            leaks = leaks or (sum(w not in have for w in p) <= k and distance(p, words) <= k)
        if not leaks:
            out.append((d, t, s))
    return out


def test_run_equals_brute_force(spark):
    """The first four stages text by text; the mix by its totals, as it is drawn."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = brute_lines(brute_quality(rows, labels))
    found = brute_components([(d, t) for d, t, _ in rows])
    rows = brute_leaks([r for r in rows if found[r[0]][1] == r[0]], items)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = common.cut(stage(spark, docs, SF), "stage")
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect()) == sorted(rows)
    out = corpus_pipeline.run(spark, SF).collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    assert {r["doc_id"] for r in out} <= set(size) and all(r["size"] == size[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] for r in out)
    taken, target, most = Counter(), {}, Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] for s in taken)


def test_a_stage_lets_go_of_its_scratch(spark):
    before = common.written()
    one = common.cut(spark.range(5), "x")
    two = common.stored(one.where("id > 1"), "y", before)
    assert common.written() == before + 1 and two.count() == 3


def test_cut_leaves_no_shuffle_files(spark):
    import time

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in found if "/shuffle_" in f}

    before = files()
    common.cut(spark.range(0, 10_000, 1, 4).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before


def test_cut_writes_no_checksum_files(spark):
    from pathlib import Path

    table = common.cut(spark.range(0, 1000, 1, 4), "plain")
    folder = Path(common._written[-1][1].removeprefix("file://"))
    assert table.count() == 1000 and len(list(folder.glob("part-*"))) == 4
    assert not list(folder.glob(".*.crc"))
