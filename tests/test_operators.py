"""Properties, golden values and guards of the operators."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import fipa, fixedpoint, grid, metrics, moments, partition, rounds, routing, rules, skew, vectors
from tidemark.sources import files


def one(df):
    return df.collect()[0]


def test_skew_golden(spark):
    def d(counts):
        rows = [("a", k, n) for k, n in enumerate(counts)] + [("z", k, 5) for k in range(len(counts))]
        return one(skew.client_skew(spark.createDataFrame(rows, "client string, class int, n long")).where("client = 'a'"))["d_k"]

    assert d([10, 10, 10, 10]) == pytest.approx(0)
    assert d([40, 30, 20, 10]) == pytest.approx(0.223607, abs=1e-6)
    assert d([97, 1, 1, 1]) == pytest.approx(0.831384, abs=1e-6)
    assert d([1, 3]) == pytest.approx(0.353553, abs=1e-6)


def test_weights_golden(spark):
    def weights(n, d, a, b):
        s = spark.createDataFrame([(str(k), x, y) for k, (x, y) in enumerate(zip(n, d, strict=True))], "client string, n long, d_k double")
        w = skew.feddisco_weights(s, a, b)
        return [r["weight"] for r in w.orderBy("client").collect()], [r["int_weight"] for r in skew.integer_weights(w).orderBy("client").collect()]

    w, i = weights([100, 200, 300], [0.0, 0.2, 0.4], 0.5, 0.1)
    assert w == pytest.approx([0.266667, 1 / 3, 0.4], abs=1e-6)
    assert i == [4473924, 5592405, 6710887]
    assert weights([100, 100], [0.8, 0.0], 0.5, 0.1)[0] == pytest.approx([0.25, 0.75])
    assert weights([100, 300], [0.9, 0.9], 2, 0)[0] == pytest.approx([0.25, 0.75])
    assert weights([0, 0], [0.0, 0.0], 0.5, 0.1)[0] == pytest.approx([0.5, 0.5])


def test_intervals_golden(spark):
    n = [r[0] for r in spark.createDataFrame([(2000,), (12630,), (100000,)], "n long").select(scalar.effective_sample_size(F.col("n"))).collect()]
    assert n == pytest.approx([418.611202, 421, 421], abs=1e-5)
    low, high = scalar.accuracy_interval(F.lit(0.5), F.lit(2000))
    assert tuple(one(spark.range(1).select(low, high))) == pytest.approx((0.452320, 0.547680), abs=1e-6)
    with pytest.raises(PySparkException):
        spark.range(1).select(scalar.retention(F.lit(0.3), F.lit(0.0))).collect()


def test_divergence_golden(spark):
    kl = lambda *x: one(spark.range(1).select(scalar.symmetric_kl_term(*map(F.lit, map(float, x)))))[0]
    assert kl(0, 1, 3, 1) == pytest.approx(9)
    assert kl(0, 1, 0, 6) == pytest.approx(2.083333, abs=1e-6)


def test_route_ties_margin_and_refusal(spark):
    d = spark.createDataFrame([(1, 0, "a", 2.0), (1, 1, "b", 2.0), (1, 2, "c", 3.0), (2, 0, "a", 9.0)], "q int, idx int, label string, distance double")
    rows = {r["q"]: r for r in routing.route(d, 5.0, "q").collect()}
    assert (rows[1]["label"], rows[1]["margin"], rows[1]["fallback"]) == ("a", 0.0, False)
    assert (rows[2]["label"], rows[2]["margin"], rows[2]["fallback"]) == (None, None, True)


def test_routing_report_golden(spark):
    chosen, truth = ["fog", "fog", "snow", None, None, "fog"], ["fog", "fog", "fog", "fog", None, None]
    rows = spark.createDataFrame([(c, t, float(k), float("inf")) for k, (c, t) in enumerate(zip(chosen, truth, strict=True))], "chosen string, truth string, distance double, margin double")
    r = one(routing.report(rows))
    assert (r["hit_rate"], r["fallback_when_routable"], r["refusal_rate"]) == (0.5, 0.25, 0.5)
    assert r["fallback_rate"] == pytest.approx(1 / 3) and r["mean_margin"] is None


def test_classification_golden(spark):
    rows = spark.createDataFrame([(0 if k < 90 else 1, 0) for k in range(100)], "y_true int, y_pred int")
    r = one(metrics.classification(rows))
    assert (r["macro_f1"], r["weighted_f1"], r["accuracy"]) == pytest.approx((0.473684, 0.852632, 0.9), abs=1e-6)


def test_allocation_golden(spark):
    sizes = [30, 12, 12, 6, 6, 3]
    rows = [(size, k, n, size) for size in (6, 20, 45) for k, n in enumerate(sizes)]
    got = partition.allocate(spark.createDataFrame(rows, "key int, class int, n long, size int"))
    by = {k: [r["alloc"] for r in got.where(F.col("key") == k).orderBy("class").collect()] for k in (6, 20, 45)}
    assert by == {6: [1] * 6, 20: [8, 3, 3, 2, 2, 2], 45: [19, 8, 8, 4, 4, 2]}


def test_early_stop_and_best(spark):
    h = spark.createDataFrame([(k, x, f) for k, (x, f) in enumerate(zip([3.0, 3.0, 4.0, 5.0, 4.0, 6.0], [0.0, 0.5, 0.5, 0.2, 0.1, 0.3], strict=True))], "round int, loss double, test_f1 double")
    got = rounds.early_stop(h, "loss", 2).orderBy("round").collect()
    assert [r["worse"] for r in got] == [0, 0, 1, 2, 0, 1] and [r["round"] for r in got if r["stop"]] == [3]
    assert one(rounds.best_round(h))["round"] == 1
    assert rounds.best_round(h.where("round = 0")).count() == 0


def test_warmup_and_unknown_rule(spark):
    f = lambda a, r: one(spark.range(1).select(scalar.effective_algorithm(F.lit(a), F.lit(r), F.lit(8))))[0]
    assert (f("FIPA", 7), f("FIPA", 8), f("FedLC", 0)) == ("FedAvg", "FIPA", "FedLC")
    with pytest.raises(PySparkException):
        f("Other", 0)


def naive(clients, rtol=1e-12):
    n = np.array([c["n"] for c in clients])
    p = len(clients[0]["delta"])
    if n.sum() <= 0:
        return np.zeros(p)
    h, v = np.zeros((p, p)), np.zeros(p)
    for a, c in zip(n / n.sum(), clients, strict=True):
        u, lam = np.array(c["directions"]).T, np.array(c["curvature"])
        h += a * u @ np.diag(lam) @ u.T
        v += a * u @ (lam * (u.T @ np.array(c["delta"])))
    return np.linalg.pinv(h, rcond=rtol, hermitian=True) @ v


def clients_of(rng, p=20, r=3, m=4):
    return [
        {"client": k, "n": float(rng.integers(1, 50)), "delta": rng.normal(size=p).tolist(), "directions": np.linalg.qr(rng.normal(size=(p, r)))[0].T.tolist(), "curvature": sorted(rng.uniform(0.1, 2, r).tolist(), reverse=True)}
        for k in range(m)
    ]


SCHEMA = "client int, n double, delta array<double>, directions array<array<double>>, curvature array<double>"


def test_preconditioned_sum_equals_naive(spark):
    c = clients_of(np.random.default_rng(1))
    df = spark.createDataFrame([tuple(x.values()) for x in c], SCHEMA)
    got = [r["x"] for r in fipa.preconditioned_sum(df).orderBy("pos").collect()]
    assert got == pytest.approx(naive(c).tolist(), rel=1e-6, abs=1e-9)
    both = fipa.preconditioners(df).join(fipa.project_deltas(df), ["client", "j"]).groupBy("pos").agg(F.sum(F.col("x") * F.col("z")).alias("x"))
    assert [r["x"] for r in both.orderBy("pos").collect()] == pytest.approx(got, rel=1e-6, abs=1e-9)


def test_preconditioned_without_samples_is_zero(spark):
    c = [x | {"n": 0.0} for x in clients_of(np.random.default_rng(2))]
    got = [r["x"] for r in fipa.preconditioned_sum(spark.createDataFrame([tuple(x.values()) for x in c], SCHEMA)).collect()]
    assert got == [0.0] * 20


def test_factors_and_diagnostics(spark):
    rng = np.random.default_rng(3)
    g = {k: rng.normal(size=(6, 12)) for k in range(3)}
    rows = [(k, i, row.tolist()) for k, m in g.items() for i, row in enumerate(m)]
    f = fipa.top_factors(spark.createDataFrame(rows, "client int, row int, g array<double>"), 4)
    for r in f.collect():
        s = np.linalg.svd(g[r["client"]], compute_uv=False)
        assert r["curvature"] == pytest.approx((s[:4] ** 2 / 6).tolist())
    data = f.withColumn("n", F.lit(2.0)).withColumn("delta", F.col("directions")[0])
    d = one(fipa.diagnostics(data.select("client", "n", "delta", "directions", "curvature")))
    assert d["delta_in_local"] == pytest.approx(1) and d["delta_in_joint"] == pytest.approx(1)


def test_paillier_round_trip():
    keys, noise = fixedpoint.Keys.make(128, seed=3), random.Random(1)
    public = keys.public
    for m in (0, 1, -1, 2**52, -(2**60)):
        assert keys.decrypt(public.encrypt(m, noise)) == m == keys.decrypt(public.encrypt(m))
    a, b = public.encrypt(41, noise), public.encrypt(-20, noise)
    assert keys.decrypt(a * pow(b, 2, keys.n**2) % keys.n**2) == 1
    assert public.encrypt(41) != public.encrypt(41) and not hasattr(public, "secret")
    assert fixedpoint.Keys.make(128) != fixedpoint.Keys.make(128)
    with pytest.raises(ValueError):
        public.encrypt(keys.n, noise)


def test_encrypted_round_equals_plain(spark):
    """Preconditioners and projections of real factors, at several scales of the movement."""
    keys, rng = fixedpoint.Keys.make(384, seed=3), np.random.default_rng(4)
    for scale in (1e-1, 1e-6):
        c = [x | {"delta": [v * scale for v in x["delta"]]} for x in clients_of(rng, p=8, r=2, m=3)]
        df = spark.createDataFrame([tuple(x.values()) for x in c], SCHEMA)
        operators, z = fipa.preconditioners(df), fipa.project_deltas(df)
        want = [r["x"] for r in fipa.preconditioned_sum(df).orderBy("pos").collect()]
        sent = fixedpoint.encrypt_projection(z, keys.public)
        got = fixedpoint.decrypted_values(fixedpoint.encrypted_increment(operators, sent, keys.public), keys)
        assert [r["x"] for r in got.orderBy("pos").collect()] == pytest.approx(want, rel=1e-6, abs=1e-13)
        model = spark.createDataFrame([(k, 0.5 * k) for k in range(8)], "pos int, x double")
        out = fixedpoint.decrypted_values(fixedpoint.preconditioned_round(model, 0, operators, sent, keys.public), keys)
        assert [r["x"] for r in out.orderBy("pos").collect()] == pytest.approx([0.5 * k + w for k, w in enumerate(want)], rel=1e-9, abs=1e-12)
        plain = fixedpoint.add_increment(model, fipa.preconditioned_sum(df))
        assert [r["x"] for r in plain.orderBy("pos").collect()] == pytest.approx([0.5 * k + w for k, w in enumerate(want)])


def test_encrypted_round_refuses(spark):
    keys = fixedpoint.Keys.make(128, seed=3)
    operators = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 1.0)], "client int, j int, pos int, x double")
    z = spark.createDataFrame([(0, 0, 1.0)], "client int, j int, z double")
    with pytest.raises(ValueError, match="pair up"):
        fixedpoint.integer_increment(operators, z)
    with pytest.raises(ValueError, match="no clients"):
        fixedpoint.integer_increment(operators.limit(0), z.limit(0))
    with pytest.raises(ValueError, match="rounds to zero"):
        fixedpoint.encrypted_increment(operators.where("client = 0").withColumn("x", F.lit(1e-30)), fixedpoint.encrypt_projection(z, keys.public), keys.public)
    with pytest.raises(ValueError):
        fixedpoint.on_grid(1e-30, 52)
    assert fixedpoint.on_grid(0.0, 52) == 0 and fixedpoint.on_grid(1.0, 52) == 2**52
    model = spark.createDataFrame([(0, 1.0), (1, 1.0)], "pos int, x double")
    with pytest.raises(PySparkException):
        fixedpoint.add_increment(model, spark.createDataFrame([(0, 1.0)], "pos int, x double")).collect()


def test_server_guards(spark):
    c = spark.createDataFrame([tuple(x.values()) for x in clients_of(np.random.default_rng(1))], SCHEMA)
    theta = spark.range(20).select(F.col("id").cast("int").alias("pos"), F.lit(1.0).alias("x"))
    with pytest.raises(ValueError, match="snapshot"):
        fipa.server_round(None, c)
    with pytest.raises(ValueError, match="factors"):
        fipa.server_round(theta, c.drop("curvature"))
    with pytest.raises(ValueError, match="factors"):
        fipa.server_round(theta, c.withColumn("curvature", F.when(F.col("client") > 0, F.col("curvature"))))
    assert fipa.server_round(theta, c).count() == 20
    told = spark.createDataFrame([(0.5,), (float("nan"),), (None,), (0.7,)], "explained double")
    assert one(fipa.mean_explained(told))[0] == pytest.approx(0.6)


def test_numbered_equals_one_window(spark):
    from pyspark.sql import Window

    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 < 5, "big").when(F.col("id") % 7 == 5, "small").alias("k"))
    order = [partition.seeded("id"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    want = {r["id"]: r["n"] for r in rows.withColumn("n", F.row_number().over(w)).collect()}
    got = partition.numbered(rows, "n", order, "k")
    assert {r["id"]: r["n"] for r in got.collect()} == want
    assert sorted(r["n"] for r in partition.numbered(rows, "n", order, slots=7).collect()) == list(range(1, 3001))


def test_units_of_text_tracks(spark):
    rows = spark.createDataFrame([(k % 3, f"{'ab'[k % 2]}é track {k % 11}") for k in range(200)], "label int, track string")
    got = [(r["label"], r["track"]) for r in partition.units(rows, "label", "track").orderBy("unit").collect()]
    assert got == sorted(set(got), key=lambda x: (x[0], x[1].encode()))


def test_split_settings(spark):
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("label"), F.floor(F.col("id") / 5).alias("track"))
    for bad in ({"partition_strategy": "other"}, {"partition_unit": "frame"}, {"dirichlet_alpha": 0}):
        with pytest.raises(ValueError):
            partition.split_settings({"num_clients": 2} | bad)
    with pytest.raises(ValueError):
        partition.split_by({"num_clients": 2}, rows.limit(0), "label", "track", "id")
    out = partition.split_by({"num_clients": 3, "partition_strategy": "dirichlet", "dirichlet_alpha": 10.0, "partition_unit": "image", "max_units_per_class": 40}, rows, "label", "track", "id")
    assert out.count() == 120 and out.groupBy("label").count().where("count <> 40").count() == 0


def test_rules_by_name(spark):
    updates = spark.createDataFrame([(0, 1, [1.0, 2.0]), (1, 3, [5.0, 2.0])], "client int, n long, vector array<double>")
    assert [r["x"] for r in rules.aggregate("FedAvg", updates).orderBy("pos").collect()] == [4.0, 2.0]
    with pytest.raises(ValueError):
        rules.aggregate("Other", updates)
    with pytest.raises(ValueError):
        rules.effective_rule("Other", 0, 0)
    assert (rules.effective_rule("FIPA", 1, 2), rules.effective_rule("FIPA", 2, 2)) == ("FedAvg", "FIPA")


@pytest.mark.parametrize("rule", ["FedAvg", "FedLC", "FedDisco", "FIPA"])
def test_training_learns_and_stops(spark, rule):
    rng = np.random.default_rng(5)
    centres = np.eye(3, 6) * 3
    rows = [(k % 3, k % 2 if k % 5 else 2, (centres[k % 3] + rng.normal(size=6) * 0.3).tolist()) for k in range(150)]
    frame = spark.createDataFrame([(c, y, v) for y, c, v in rows], "client int, label int, vector array<double>")
    seen = []
    config = {"aggregation_algorithm": rule, "rounds": 4, "learning_rate": 0.5, "fipa_warmup_rounds": 2, "fipa_rank": 2, "patience": 3}
    out = rules.run_rounds(frame, frame, 3, config, seen.append)
    assert out.history == seen and len(seen) == 4 and max(h["test_acc"] for h in seen) > 0.95 and out.best is not None
    assert [h["rule"] for h in seen][:2] == [rule if rule != "FIPA" else "FedAvg"] * 2 and seen[-1]["rule"] == rule
    assert out.table(spark).count() == 4
    wild = rules.run_rounds(frame.withColumn("label", F.pmod(F.xxhash64("vector"), F.lit(3)).cast("int")), frame, 3, {"rounds": 30, "learning_rate": 40.0, "patience": 1})
    assert wild.stopped is not None and len(wild.history) < 30
    with pytest.raises(ValueError):
        rules.run_rounds(frame.limit(0), frame, 3, {})


def test_corruptions(spark):
    from tidemark.operators import corruptions

    rows = spark.createDataFrame([(1, [0.1 * k for k in range(16)])], "id long, v array<double>")
    plan = partition.conditions(spark, sorted(set(scalar.FAMILIES) - {"clean"}), [1, 5])
    got = corruptions.corrupt(rows, "v", plan, "id").collect()
    assert len(got) == 38 and all(len(r["x"]) == 16 for r in got)
    moved = {(r["corruption"], r["severity"]): float(np.abs(np.array(r["x"]) - np.array(r["v"])).sum()) for r in got}
    assert sum(moved[c, 5] >= moved[c, 1] for c, _ in moved) >= 34 and all(moved[c, 5] > 0 for c, _ in moved)
    with pytest.raises(PySparkException):
        corruptions.corrupt(rows, "v", partition.conditions(spark, ["rain"], [1]), "id").collect()


def test_only_sequential_states_are_a_fixed_point(spark):
    rows = spark.createDataFrame([(k // 10, [float((k * 7) % 13), float(k % 5) * 3 - 4]) for k in range(60)], "batch int, x array<double>")
    layers, shift = ["a", "b", "c"], {}
    stored = spark.createDataFrame([(layer, c, 0.0, 1.0) for layer in layers for c in (0, 1)], "layer string, ch int, mean double, var double")
    for method in moments.METHODS:
        state = moments.collect_states(rows, layers, method, stored=stored)
        again = moments.collect_states(rows, layers, "as-is", stored=state)
        shift[method] = one(moments.residual(again, state))["mean_shift"]
    assert shift["sequential"] == pytest.approx(0, abs=1e-9) and shift["as-is"] > shift["batch-stats"] > 1e-6
    seen = []
    part = moments.collect_states(rows, layers, "sequential", only=["b"], max_batches=3, progress=lambda *a: seen.append(a))
    assert {r["layer"] for r in part.collect()} == {"b"} and seen == [(1, 3, "a"), (2, 3, "b")]
    loaded = moments.load_state(stored, part)
    assert loaded.count() == 6 and loaded.where("layer = 'a' and var = 1").count() == 2
    for bad in ({"method": "other"}, {"method": "as-is"}, {"method": "sequential", "only": ["z"]}):
        with pytest.raises(ValueError):
            moments.collect_states(rows, layers, **bad)
    with pytest.raises(PySparkException):
        moments.load_state(stored, part.withColumn("layer", F.lit("z"))).collect()


def test_bank_and_stream_order(spark):
    assert routing.stream_order(["fog_s3", "clean", "blur_s1", "blur_s3"], [3]) == ["clean", "blur_s3", "fog_s3", "clean_again"]
    rows = spark.createDataFrame([(c, b, [float(b + k), 1.0 * k]) for c in ("clean", "fog_s1") for b in range(10) for k in range(4)], "condition string, batch int, x array<double>")
    entries, own = routing.build_bank(rows, "x", 8)
    assert entries.where("idx = 0 and label = 'clean'").count() == 2 and own.groupBy("label").count().where("count <> 8").count() == 0
    with pytest.raises(ValueError):
        routing.build_bank(rows.where("condition <> 'clean'"))


def test_augmentation_settings():
    assert grid.augmentation({}) is None
    assert grid.augmentation({"train_augmentation": True}) == {"degrees": 10.0, "translate": 0.1, "scale": (0.9, 1.1)}
    for bad in ({k: False} for k in grid.REFUSED_KEYS):
        with pytest.raises(ValueError):
            grid.augmentation(bad)
    for k, v in (("rotation_degrees", 180), ("translate", 1.0), ("scale", (1.1, 0.9)), ("scale", (1.0,))):
        with pytest.raises(ValueError):
            grid.augmentation({"train_augmentation": True, f"augmentation_{k}": v})


def test_best_and_recalibrated_checkpoints(spark, tmp_path):
    params, told = spark.createDataFrame([("w", [2], [2.0, 4.0])], "layer string, shape array<int>, values array<double>"), []
    assert files.save_best(None, str(tmp_path / "a"), {}, log=told.append) is None
    assert files.save_best(params, str(tmp_path / "a"), {}, encrypted=True, log=told.append) is None
    assert files.save_best(params, "nowhere://x/y", {}, log=told.append) is None and len(told) == 3
    assert files.save_best(params, str(tmp_path / "a"), {"round": 1}, 2.0)
    assert files.checkpoint_states(spark, str(tmp_path / "a")) is None
    state = spark.createDataFrame([("bn1", 0, 0.5, 2.0), ("bn1", 1, 0.1, 1.0), ("bn2", 0, 0.0, 1.0)], "layer string, ch int, mean double, var double")
    facts = files.save_recalibrated(spark, str(tmp_path / "a"), state, str(tmp_path / "b"), "pooled", "clean", 100)
    assert (facts["bn_stats_num_layers"], facts["bn_stats_num_channels"], facts["round"]) == (2, 3, 1)
    assert sorted(map(tuple, files.checkpoint_states(spark, str(tmp_path / "b")).collect())) == sorted(map(tuple, state.collect()))
    assert files.checkpoint_stem({"partition_strategy": "dirichlet", "dirichlet_alpha": 0.5, "num_clients": 4, "local_epoch": 1, "seed": 7}, "now 1") == "dataset_model_FedAvg_a0.5_c4_le1_seed7_now-1"
    files.write_records(state, state, {"arms": ["source"]}, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r" / "batches"), header=True).count() == 3
    with pytest.raises(ValueError):
        files.write_records(state.limit(0), state, {}, str(tmp_path / "r"))
    (tmp_path / "tree" / "00002").mkdir(parents=True)
    assert files.class_directories(spark, str(tmp_path / "tree")) == ["00002"]
    with pytest.raises(FileNotFoundError):
        files.class_directories(spark, str(tmp_path / "gone"))
    with pytest.raises(ValueError):
        files.class_directories(spark, str(tmp_path / "tree" / "00002"))


def test_seeds_by_checksum(spark):
    import zlib

    assert one(spark.range(1).select(scalar.shuffle_seed(F.lit("clean"), 5)))[0] == (5 + zlib.crc32(b"clean")) % 2**31


def test_stream_progress(spark, tmp_path):
    from tidemark.streaming import streams

    spark.range(10).repartition(2).write.parquet(str(tmp_path / "in"))
    seen, listener = [], None
    listener = streams.Progress(lambda name, batch, rows: seen.append((name, rows)))
    spark.streams.addListener(listener)
    try:
        out = streams.drain(streams.source(spark, str(tmp_path / "in"), spark.range(1).schema), "told")
        assert out.count() == 10
        for _ in range(50):
            if sum(n for name, n in seen if name == "told") == 10:
                break
            import time

            time.sleep(0.1)
        assert sum(n for name, n in seen if name == "told") == 10
    finally:
        spark.streams.removeListener(listener)


def test_fixed_point_refuses(spark):
    long = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 0.0)], "client string, pos int, x double")
    with pytest.raises(PySparkException):
        fixedpoint.encode_vectors(long, "client").collect()


def test_states(spark):
    state = "layer string, ch int, mean double, var double"
    a = spark.createDataFrame([("l", 0, 1.0, 4.0)], state)
    b = spark.createDataFrame([("l", 0, 3.0, 2.0)], state)
    assert tuple(one(moments.blend(a, b, 0.25, ["layer", "ch"])))[2:] == (2.5, 2.5)
    with pytest.raises(PySparkException):
        moments.blend(a, b.withColumn("ch", F.lit(1)), 0.5, ["layer", "ch"]).collect()
    with pytest.raises(ValueError):
        moments.restrict(a, ["l", "gone"])
    with pytest.raises(ValueError):
        moments.blend(a, b, 1.5, ["ch"])


def test_partition_does_not_depend_on_partitions(spark):
    rows = spark.range(500).select(F.col("id").alias("unit"), (F.col("id") % 5).cast("int").alias("label"))
    for n in (1, 7):
        out = partition.dirichlet_partition(rows.repartition(n), "label", "unit", 4, 0.5, min_images=2)
        got = sorted(map(tuple, out.select("unit", "client").collect()))
        first = got if n == 1 else first
    assert got == first and len(got) == 500


def test_skew_falls_with_alpha(spark):
    def spread(alpha):
        draws = partition.draw_proportions(list(range(10)), 4, alpha, 1)
        return np.std([p for *_, p in draws])

    assert spread(0.1) > spread(1.0) > spread(100.0)


def test_normalised_configs_agree(spark):
    rows = [(0, {"aggregation_algorithm": "FedAvg", "fipa_rank": "5"}), (1, {"aggregation_algorithm": "FedAvg", "fipa_rank": "20", "seed": "7", "feddisco_a": ""})]
    rows.append((2, {"aggregation_algorithm": "FIPA", "fipa_rank": "20"}))
    got = grid.fingerprint(grid.normalise(spark.createDataFrame(rows, "ord long, params map<string,string>"))).orderBy("ord").collect()
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != got[2]["fingerprint"]


def test_class_tree(spark, tmp_path):
    for d, names in {"00001": ["a.PNG", "b.jpg", "c.txt"], "00003": ["d.gif"]}.items():
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_bytes(b"x")
    rows = files.scan_classes(spark, str(tmp_path))
    ids = files.class_map(rows)
    assert sorted(map(tuple, ids.collect())) == [("00001", 1), ("00003", 3)]
    assert files.relabel(rows, ids).count() == 3
    with pytest.raises(PySparkException):
        files.relabel(rows, ids.where("dir = '00001'")).collect()
    with pytest.raises(ValueError):
        files.require_complete(rows.where("dir = '00001'"), ids)
    collide = spark.createDataFrame([("a1",), ("b1",)], "dir string")
    assert sorted(map(tuple, files.class_map(collide).collect())) == [("a1", 0), ("b1", 1)]


def test_checkpoint_and_results(spark, tmp_path):
    params = spark.createDataFrame([("w", [2], [2.0, 4.0])], "layer string, shape array<int>, values array<double>")
    files.write_checkpoint(params, str(tmp_path / "c"), {"round": 3}, denominator=2.0)
    got, meta = files.read_checkpoint(spark, str(tmp_path / "c"))
    assert one(got)["values"] == [1.0, 2.0] and meta == {"round": 3}
    files.append_results(spark, spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "r"))
    files.append_results(spark, spark.createDataFrame([(2, 0.5)], "a int, z double"), str(tmp_path / "r"))
    assert sorted(files.read_appended(spark, str(tmp_path / "r")).columns) == ["a", "b", "z"]
    extra = spark.createDataFrame([(1, {"m": 1.0}), (2, {"k": 2.0})], "id int, extra map<string,double>")
    assert files.flatten_extra(extra).columns == ["id", "k", "m"]
    files.write_csv(files.flatten_extra(extra), str(tmp_path / "csv"))
    assert files.config_rows(files.read_results(spark, str(tmp_path / "csv"))).count() == 2
    (tmp_path / "gt.csv").write_text("Filename;ClassId\na.ppm;4\n")
    assert one(files.read_ground_truth(spark, str(tmp_path / "gt.csv")))["ClassId"] == "4"


def test_small_functions(spark):
    assert scalar.derive_seed(42, "subsample", "00001") == scalar.derive_seed(42, "subsample", "00001") < 2**32
    rows = spark.createDataFrame([(42, "subsample"), (7, "é"), (1, None)], "a long, b string")
    for r in rows.withColumn("s", scalar.derived_seed(F.col("a"), F.col("b"), F.lit("x"))).collect():
        assert r["s"] == scalar.derive_seed(r["a"], r["b"], "x")
    with pytest.raises(PySparkException):
        spark.range(1).select(scalar.payload_guard(F.lit("delta"), "weights")).collect()
    flat = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0])], "layer int, v array<double>")
    long = vectors.long_form(flat, "v", "layer").join(flat.select("layer", F.size("v").alias("size")), "layer")
    assert [r["x"] for r in vectors.flatten_layers(long).orderBy("pos").collect()] == [1.0, 2.0, 3.0]


def test_lagged_router_rounds_like_its_threshold(spark, tmp_path):
    from tidemark.streaming import streams

    rows = spark.createDataFrame([("x", k, [1 / 3], [1.0]) for k in range(2)], "arm string, seq long, mean array<double>, var array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    bank = [("a", [0.0], [1.0]), ("b", [1e-7], [1.0])]  # both at 0.111111, b nearer by less than the last digit
    got = streams.drain(streams.lagged_router(feed, bank, 0.111111, digits=6), "rounded").orderBy("seq").collect()
    assert [(r["chosen"], r["distance"], r["fallback"]) for r in got] == [(None, None, False), ("a", 0.111111, False)]


def test_corruptions_of_long_and_odd_vectors(spark):
    import time

    from tidemark.operators import corruptions

    n, schema = 20_000, "id long, v array<double>"
    v = [float(k % 97) for k in range(n)]
    began = time.time()  # work in proportion to the length, not to its square
    x = one(corruptions.corrupt(spark.createDataFrame([(10**17, v)], schema), "v", partition.conditions(spark, ["defocus_blur"], [5]), "id"))["x"]
    assert time.time() - began < 30
    assert x == pytest.approx([sum(v[max(0, min(n - 1, k + d))] for d in range(-5, 6)) / 11 for k in range(n)])
    odd = spark.createDataFrame([(1, [1.0, None, 3.0]), (None, [1.0, 2.0]), (3, []), (4, None)], schema)
    plan = partition.conditions(spark, ["brightness", "gaussian_noise", "saturate", "gaussian_blur"], [1])
    got = {(r["id"], r["corruption"]): r["x"] for r in corruptions.corrupt(odd, "v", plan, "id").collect()}
    assert len(got) == 16 and got[1, "brightness"] == [1.1, None, 3.1] and got[1, "saturate"] == [1.0, 1.0, 1.0] and got[1, "gaussian_blur"] == [None] * 3
    assert got[None, "gaussian_noise"] == [None, None] and got[None, "brightness"] == [1.1, 2.1] and got[3, "brightness"] == [] and got[4, "brightness"] is None
