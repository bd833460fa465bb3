"""Operators on small frames whose results are worked out by hand or by plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from winaudit.functions import clean, ordering, radix
from winaudit.functions.ranges import meeting_ranges
from winaudit.operators import calibrate, curves, drift, evaluate, features, leakage, scoring, segments, splits, summary, windows
from winaudit.sources import flow


def frame(spark, n, parts=3, **cols):
    df = spark.range(n, numPartitions=parts)
    return df.select(F.col("id").alias("pos"), *[F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("id") + 1).cast("int")).alias(k) for k, v in cols.items()])


def plain_windows(labels, w, stride):
    return [sum(labels[s : s + w]) for s in range(0, len(labels) - w + 1, stride)]


@pytest.mark.parametrize(("w", "stride"), [(4, 2), (6, 4), (5, 3), (3, 7), (8, 8)])
@pytest.mark.parametrize("parts", [1, 5])
def test_sliding_windows(spark, w, stride, parts):
    rng = random.Random(w * stride)
    labels = [rng.randrange(2) for _ in range(23)]
    df = frame(spark, 23, parts, label=labels).withColumns({"seg": F.lit("a"), "seg_rows": F.lit(23)})
    got = windows.sliding_windows(df, ["seg"], w, stride, {"n": F.col("label")}).orderBy("w").collect()
    assert [r.n for r in got] == plain_windows(labels, w, stride)
    assert all(r.end_pos - r.start_pos == w - 1 for r in got)


def test_short_segments_have_no_window(spark):
    df = frame(spark, 3, label=[1, 1, 1]).withColumns({"seg": F.lit("a"), "seg_rows": F.lit(3)})
    assert windows.sliding_windows(df, ["seg"], 4, 2, {"n": F.col("label")}).count() == 0
    assert windows.short_segment_drops(df, ["seg"], 4).first().asDict() == {"segments": 1, "rows": 3}


def test_window_counts_of_published_segments():
    assert sum((n - 128) // 16 + 1 for n in (190_911, 225_711, 286_096)) == 43_897


def test_ratio_at_threshold_and_family_tie(spark):
    df = frame(spark, 4, label=[1, 1, 0, 0], anomaly_type=["b", "a", "BENIGN", "BENIGN"]).withColumns({"seg": F.lit("s"), "seg_rows": F.lit(4)})
    win = windows.with_label(windows.sliding_windows(df, ["seg"], 4, 4, {"n_anomaly": F.col("label")}), 4, 0.5)
    assert win.first().label == 1
    assert windows.dominant_family(df, ["seg"], 4, 4).first().family == "a"


def test_entity_summary(spark):
    df = frame(spark, 6, ip=["x", "y", "y", "z", "w", "x"]).withColumns({"seg": F.lit("s"), "seg_rows": F.lit(6)})
    assert windows.entity_summary(df, ["seg"], 6, 6, "ip").first().summary == "x(2),y(2),w(1),+1more"


def test_positions_and_sums_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(50), rng.randrange(9)) for _ in range(80)]
    want = {}
    for g in "ab":
        total = 0
        for p, (k, v) in enumerate(sorted((k, v) for x, k, v in rows if x == g)):
            total += v
            want.setdefault(g, []).append((p, k, v, total))
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g string, k int, v int")
        out = ordering.with_position(df, ["g"], ["k", "v"], "p", count="n", partitions=parts)
        assert all(r.n == len(want[r.g]) for r in out.collect())
        odd = ordering.with_positions(df, ["g"], ["k", "v"], {"p": ordering.EVERY, "o": F.col("v") % 2 == 1}, {"o": "odd"}, partitions=parts).collect()
        before = {g: [sum(v % 2 for _, _, v, _ in xs[:i]) for i in range(len(xs) + 1)] for g, xs in want.items()}
        assert all((r.o, r.odd) == (before[r.g][r.p], before[r.g][-1]) for r in odd)
        sums = radix.swept(df.withColumn("at", F.col("k") * 100 + F.col("v")), ["g"], "at", {"t": F.col("v"), "n": F.lit(1)}).collect()
        assert all(r.t_upto == [t for _, k, v, t in want[r.g] if 100 * k + v == r.at][-1] for r in sums)
    assert ordering.with_position(df.where("false"), ["g"], ["k"]).count() == 0


def auc_ap(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
    ap, seen = 0.0, 0
    for t in sorted({s for s, _ in pairs}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        ap += (tp - seen) / max(len(pos), 1) * tp / (tp + fp)
        seen = tp
    return auc, ap


def test_curves_match_definitions(spark):
    rng = random.Random(5)
    data = {"r": [(rng.randrange(6) / 5, rng.randrange(2)) for _ in range(40)], "one": [(0.3, 0), (0.5, 0)], "flat": [(0.5, 1), (0.5, 0)]}
    df = spark.createDataFrame([(g, s, y) for g, xs in data.items() for s, y in xs], "g string, score double, label int")
    points = curves.curve_points(df, ["g"])
    auc = {r.g: r.auc for r in curves.roc_auc(points, ["g"]).collect()}
    ap = {r.g: r.ap for r in curves.average_precision(points, ["g"]).collect()}
    for g, xs in data.items():
        a, p = auc_ap(xs)
        assert auc[g] == (None if a is None else pytest.approx(a))
        assert ap[g] == pytest.approx(p)


def test_oracle_threshold_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 0), (0.6, 1)], "score double, label int")
    points = curves.curve_points(df)
    low, high = (curves.oracle_f1_threshold(points, tie=t).first() for t in ("lowest", "highest"))
    assert (low.oracle_threshold, high.oracle_threshold) == (0.6, 0.9)
    assert low.oracle_f1 == pytest.approx(2 / 3)


def test_threshold_quantile_and_alarm_at_it(spark):
    df = spark.createDataFrame([(float(x),) for x in range(5)], "score double")
    assert calibrate.threshold_of(df, 0.25) == 3.0
    assert calibrate.threshold_of(df, 0.3) == pytest.approx(2.8)
    assert (calibrate.threshold_of(df, 0.0), calibrate.threshold_of(df, 1.0)) == (4.0, 0.0)
    assert calibrate.threshold_of(df.limit(1), 0.25) == 0.0
    with pytest.raises(ValueError, match="no calibration"):
        calibrate.threshold_of(df.where("false"), 0.25)
    assert [r.prediction for r in calibrate.apply_threshold(df, threshold=F.lit(3.0)).orderBy("score").collect()] == [0, 0, 0, 1, 1]


def bits_of(x, kind):
    import numpy as np

    n = int(np.array([abs(x)], kind).view("i4" if kind == "f4" else "i8")[0])
    return -n if x < 0 else n


@pytest.mark.parametrize(("kind", "name"), [("f4", "float"), ("f8", "double")])
def test_keys_of_floats_are_their_bits(spark, kind, name):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.integers(-(1 << 62), 1 << 62, 4000).view("f4" if kind == "f4" else "f8")
    powers = (2.0 ** np.arange(-126, 127)).astype(kind)
    info = np.finfo(kind)
    x = np.concatenate([x[~np.isnan(x)], powers, -powers, np.nextafter(powers, powers.dtype.type(0)), np.array([0.0, -0.0, np.inf, -np.inf, info.tiny, info.smallest_subnormal, 3e-40, info.max, -info.max], kind)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double").select(F.col("v").cast(name).alias("v"))
    assert [r.k for r in radix.with_key(df, "v", "k").collect()] == [bits_of(v, kind) for v in x]
    above = spark.createDataFrame([(float("nan"),), (float("inf"),)], "v double").select(F.col("v").cast(name).alias("v"))
    nan, inf = (r.k for r in radix.with_key(above, "v", "k").collect())
    assert nan > inf


@pytest.mark.parametrize("kind", ["float", "double", "long", "int"])
def test_selection_and_sweep_against_numpy(spark, kind):
    """Groups (one of them null) of 1 to 400 values with ties, far apart and close together; null values."""
    import numpy as np

    rng = random.Random(kind)
    draw = {"float": lambda: float(np.float32(rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-30), 0.5, -0.0, 1e30]))), "double": lambda: rng.choice([rng.gauss(0, 1), 0.5 + rng.randrange(9) * 2.0**-50, 1e300, 5e-324]), "long": lambda: rng.choice([rng.randrange(-9, 9), rng.randrange(1 << 60), -(1 << 62)]), "int": lambda: rng.randrange(-5, 5)}[kind]
    data = {g: [draw() for _ in range(n)] for g, n in (("a", 400), ("b", 1), ("c", 2), (None, 55))}
    df = spark.createDataFrame([(g, v) for g, xs in data.items() for v in xs] + [("a", None), ("d", None)], f"g string, v {kind}").repartition(3)
    shares = {"low": 0.0, "some": 0.37, "mid": 0.5, "high": 0.95, "top": 1.0}
    got = {r.g: r for r in radix.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(data)
    for g, xs in data.items():
        assert [got[g][n] for n in shares] == pytest.approx([float(np.quantile(np.array(xs, float), q)) for q in shares.values()], rel=1e-12, abs=1e-300)
    with pytest.raises(Exception, match="nothing there"):
        radix.quantiles(df, ["g"], "v", shares, empty="nothing there").collect()
    whole = radix.quantiles(df, [], "v", {"m": 0.5}).collect()
    assert whole[0].m == pytest.approx(float(np.median([float(v) for xs in data.values() for v in xs])), rel=1e-12)
    assert radix.quantiles(df.where("false"), [], "v", {"m": 0.5}).count() == 0
    points = radix.swept(df, ["g"], "v", {"c": F.lit(1)})
    for g, xs in data.items():
        values = sorted(set(xs))
        rows = sorted(points.where(F.col("g").eqNullSafe(g)).collect(), key=lambda r: r.v)
        assert [(r.v, r.c, r.c_upto, r.c_all) for r in rows] == [(v, xs.count(v), sum(x <= v for x in xs), len(xs)) for v in values]
        assert [r.next_value for r in rows] == [*values[1:], None]


def test_ten_million_distinct_scores(spark):
    """2^23 neighbouring floats from 0.5 on, and a second group; more than a buffer of values would like to hold."""
    n = 1 << 23
    df = spark.range(n, numPartitions=8).select((F.col("id") % 2).alias("g"), (0.5 + F.col("id") * 2.0**-24).cast("float").alias("score"))
    grid = {(r.g, r.target_fpr): r.threshold for r in calibrate.target_fpr_grid(df, [0.25, 0.01, 0.25], ["g"]).collect()}
    want = lambda g, q: 0.5 + (2 * int(q * (n / 2 - 1)) + g) * 2.0**-24
    assert len(grid) == 4
    for (g, fpr), t in grid.items():
        assert t == pytest.approx(want(g, 1 - fpr), abs=2.0**-22)
    y = (F.col("g") == 1).cast("int")
    assert curves.roc_auc(curves.curve_points(df.withColumn("label", y))).first().auc == pytest.approx(0.5 + 1 / n, abs=1e-9)


def test_thresholds_are_32_bit(spark):
    """A score that is a threshold only after rounding to 32 bits alarms; groups without scores are an error."""
    scores = [0.1, 0.3257972747, 0.7]
    df = spark.createDataFrame([("r", s) for s in scores], "run string, score double")
    th = calibrate.threshold_from_benign_fpr(df, 0.5, ["run"])
    assert th.schema["threshold"].dataType.simpleString() == "float"
    alarms = calibrate.apply_threshold(df.withColumn("score", F.col("score").cast("float")).join(th, "run")).orderBy("score").collect()
    assert [r.prediction for r in alarms] == [0, 1, 1]
    for bad in (df.unionAll(spark.createDataFrame([("s", None)], df.schema)), df):
        with pytest.raises(Exception, match="no calibration scores"):
            calibrate.threshold_from_benign_fpr(bad, 0.5, ["run"], groups=spark.createDataFrame([("r",), ("s",)], "run string")).collect()
    only = spark.createDataFrame([("r", float("inf")), ("r", float("nan")), ("r", 2.0), ("r", None)], "run string, score double")
    assert calibrate.threshold_from_benign_fpr(only, 0.1, ["run"], finite_only=True).first().threshold == 2.0
    with pytest.raises(Exception, match="no calibration scores"):
        calibrate.threshold_from_benign_fpr(only.where("score is null"), 0.1, finite_only=True).collect()
    assert [(r.target_fpr, r.threshold) for r in calibrate.target_fpr_grid(df, [1.5, -1.0], ["run"]).collect()] == [(1.5, pytest.approx(0.1)), (-1.0, pytest.approx(0.7))]


def test_confusion_without_denominators(spark):
    df = spark.createDataFrame([(0, 0)], "label int, prediction int")
    r = evaluate.confusion_at_threshold(df).first()
    assert (r.tp, r.tn, r.precision, r.recall, r.f1, r.fpr) == (0, 1, 0, 0, 0, 0)


def test_anomaly_segments(spark):
    #            0  1  2  3  4  5  6
    labels = [1, 1, 0, 1, 0, 1, 1]
    alarms = [0, 1, 1, 0, 0, 0, 0]
    rows = [("f", i, y, a, f"w{i}", "x" if y else "BENIGN", 0.1 * i) for i, (y, a) in enumerate(zip(labels, alarms, strict=True))] + [("g", 0, 1, 1, "v0", "y", 0.5)]
    df = spark.createDataFrame(rows, "file string, w long, label int, prediction int, window_id string, family string, score double")
    want = [("f", 1, "w0", "w1", 2, 1, 1), ("f", 2, "w3", "w3", 1, 0, None), ("f", 3, "w5", "w6", 2, 0, None), ("g", 1, "v0", "v0", 1, 1, 0)]
    got = segments.anomaly_segments(df, ["file"], "w").orderBy("file", "segment").collect()
    assert [(r.file, r.segment, r.start_window_id, r.end_window_id, r.length, r.detected, r.delay) for r in got] == want


def test_distances(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1), (0.5, 0), (2.0, 0)], "score double, c int")
    r = drift.two_sample_distances(df, [], F.col("c") == 1, F.col("c") == 0).first()
    assert r.wasserstein == pytest.approx(0.75)
    assert r.ks == pytest.approx(0.5)


def test_splits(spark):
    df = spark.range(10).select(F.col("id"), F.lit(0).alias("label"))
    roles = [r.split_role for r in splits.split_benign_calibration(df, 0.01, ["id"]).orderBy("id").collect()]
    assert roles == [splits.TRAIN] * 9 + [splits.CALIBRATION]
    cut = splits.split_chrono(spark.range(12), 0.1, 0.1, 3, ["id"]).orderBy("id").collect()
    assert [r.split_role for r in cut] == [splits.TRAIN] * 3 + [splits.CALIBRATION] * 3 + [splits.TEST] * 6
    assert {r.split_role for r in splits.split_chrono(spark.range(5), 0.5, 0.2, 3, ["id"], strict=False).collect()} == {None}
    labelled = spark.range(10).select("id", (F.col("id") >= 7).cast("int").alias("label"))
    got = splits.subset_balanced(labelled, 8, ["id"]).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 5, 1: 3}


def test_fitted_transforms(spark):
    df = spark.createDataFrame([(1.0, 5.0, "A "), (3.0, 5.0, None)], "x double, flat double, c string")
    fit = features.fit_minmax(df, ["x", "flat"])
    assert [(r.x, r.flat) for r in features.apply_scaler(df, fit).collect()] == [(0.0, 0.0), (1.0, 0.0)]
    vocab = features.fit_vocab(df, ["c"])
    new = spark.createDataFrame([("a",), ("zzz",), ("-",)], "c string")
    got = features.one_hot(new, vocab).collect()
    assert [(r.c__a, r.c__MISSING, r.c__UNK) for r in got] == [(1, 0, 0), (0, 0, 1), (0, 1, 0)]
    clash = spark.createDataFrame([("c", "a-b"), ("c", "a_b")], "column string, token string")
    with pytest.raises(ValueError, match="two tokens"):
        features.one_hot(new, clash)


def test_cleaning(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("inf"), "y"), (float("nan"), "z"), (2.0, None)], "v double, t string")
    assert [r.v for r in clean.drop_nonfinite_rows(df).collect()] == [1.0]
    assert [r.v for r in clean.zero_fill_nonfinite(df).collect()] == [1.0, 0.0, 0.0, 2.0]
    assert clean.pick_label_col(["x", "LABEL"]) == "LABEL"
    with pytest.raises(ValueError, match="no label"):
        clean.pick_label_col(["x"])
    t = spark.createDataFrame([(" Normal ",), ("DDoS",), (None,)], "l string")
    assert [r[0] for r in t.select(clean.binary_label(F.col("l"), False)).collect()] == [0, 1, 1]
    assert [r[0] for r in spark.createDataFrame([("__a b__",), ("??",)], "s string").select(clean.sanitize_token(F.col("s"))).collect()] == ["a_b", "token"]


def test_csv_and_hashes(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    (data / "Monday.csv").write_text("﻿ Flow ID , Rate,Label\nf1, Infinity,BENIGN\nf2, 2.5,DDoS\n", encoding="utf-8")
    df = flow.with_provenance(spark.read.option("header", "true").csv(f"file://{data}"))
    assert sorted((r.source_file, r.row_index, r.line) for r in df.select("source_file", "row_index", "line").collect()) == [("Monday.csv", 0, 2), ("Monday.csv", 1, 3)]
    read = flow.read_flow_csv(spark, f"file://{data}")
    assert read.columns == ["Flow ID", "Rate", "Label"]
    assert clean.drop_nonfinite_rows(read).count() == 1
    assert [r.path for r in flow.list_dataset_files(spark, f"file://{data}").collect()] == ["Monday.csv"]
    found = flow.file_hashes(spark, f"file://{data}")
    right = found.first().sha256
    manifest = spark.createDataFrame([("Monday.csv", right), ("gone.csv", "0")], "path string, sha256 string")
    assert {r.path: r.status for r in flow.file_hash_check(found, manifest).collect()} == {"Monday.csv": "ok", "gone.csv": "missing"}
    flow.write_table(read.withColumn("split_role", F.lit("t")).drop("Flow ID"), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2


def test_scoring(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 1), (9.0, 0)], "s double, ref int")
    assert [r.n for r in scoring.minmax_norm(df, {"s": "n"}, F.col("ref") == 1).orderBy("s").collect()] == [0.0, 1.0, 1.0]
    assert [r.n for r in scoring.minmax_from_train(df, {"s": "n"}, F.col("s") == 1.0).collect()] == [0.0] * 3
    v = spark.createDataFrame([([0.0, 0.0], 1), ([2.0, 0.0], 1), ([0.0, 2.0], 1), ([1.0, 5.0], 0)], "v array<double>, ref int")
    l2 = scoring.feature_deviation_l2(v, "v", F.col("ref") == 1).where("ref = 0").first().sf_raw
    assert l2 == pytest.approx(math.hypot(1 - 2 / 3, 5 - 2 / 3))
    m = scoring.feature_deviation_mahal(v, "v", F.col("ref") == 1, 2).where("ref = 0").first().sf_mahal
    import numpy as np

    x = np.array([[0, 0], [2, 0], [0, 2.0]])
    d = np.array([1, 5.0]) - x.mean(0)
    assert m == pytest.approx(float(np.sqrt(d @ np.linalg.pinv(np.cov(x.T) + 1e-6 * np.eye(2)) @ d)))


def test_leakage_and_overlap(spark):
    df = spark.createDataFrame([("train", "a", "b"), ("test", "b", "c"), ("cal", "z", None)], "split_role string, src string, dst string")
    got = leakage.entity_overlap(df, ["src", "dst"]).collect()
    assert [(r.role_a, r.role_b, r.shared) for r in got] == [("test", "train", 1)]


def test_summaries(spark):
    runs = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.7), ("b", 0, 0.6), ("b", 1, 0.9)], "model string, seed int, f1 double")
    s = {r.model: r for r in summary.model_summary(runs, ["f1"]).collect()}
    assert s["a"].text == "0.6000±0.1414"
    assert s["a"].ci_high == pytest.approx(0.6 + 12.706204736432095 * math.sqrt(0.02) / math.sqrt(2))
    one = summary.paired_stats(summary.paired_differences(runs, ["f1"], "a", "b"), ["f1"]).first()
    assert (one.wins, round(one.mean, 6)) == (2, 0.15)
    old = spark.createDataFrame([("d", "m", 0.1, 1.0), ("d", "n", 0.1, 2.0)], "dataset string, method string, target_fpr double, f1 double")
    new = spark.createDataFrame([("d", "m", 0.1 + 1e-15, 9.0)], "dataset string, method string, target_fpr double, f1 double")
    assert sorted(r.f1 for r in summary.upsert_results(old, new).collect()) == [2.0, 9.0]


def test_iforest_ranks_outliers_first(spark):
    from winaudit.operators import detectors

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(300)] + [(1000, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    scored = detectors.iforest_score(df, "v", detectors.fit_iforest(df, "v", "id", trees=30))
    assert scored.orderBy(F.desc("score")).first().id == 1000


@pytest.mark.parametrize(("w", "stride", "rows"), [(4, 2, 1), (5, 3, 6), (3, 7, 10), (6, 6, 4096)])
def test_flattened_windows(spark, w, stride, rows):
    """Windows over the borders of pieces, of segments of several lengths, equal slices; a null feature is NaN; chosen windows only."""
    rng = random.Random(w)
    data = {g: [(rng.random(), rng.random() if i != 3 else None) for i in range(n)] for g, n in (("a", 61), ("b", w), ("c", w - 1), (None, 30))}
    df = spark.createDataFrame([(g, i, len(xs), *x) for g, xs in data.items() for i, x in enumerate(xs)], "seg string, pos long, seg_rows long, x double, y double").repartition(5)
    got = {(r.seg, r.w): r.features for r in windows.window_features(df, ["seg"], w, stride, ["x", "y"], rows=rows).collect()}
    want = {(g, k): [v for p in xs[k * stride : k * stride + w] for v in p] for g, xs in data.items() for k in range((len(xs) - w) // stride + 1 if len(xs) >= w else 0)}
    assert got.keys() == want.keys()
    for key, xs in want.items():
        assert [None if math.isnan(v) else v for v in got[key]] == [None if v is None else pytest.approx(v, rel=1e-6) for v in xs]
    assert {(r.seg, r.w) for r in windows.window_keys(df, ["seg"], w, stride).collect()} == want.keys()
    only = spark.createDataFrame([("a", 1), ("b", 0), ("zz", 4)], "seg string, w long")
    assert {(r.seg, r.w) for r in windows.window_features(df, ["seg"], w, stride, ["x", "y"], only=only, rows=rows).collect()} == {("a", 1), ("b", 0)}


def test_window_forest(spark):
    """Planted windows rank first; each tree has its rows; scoring in pieces equals scoring vectors; partitions don't matter."""
    from winaudit.operators import detectors

    rng = random.Random(7)
    rows = [("s", i, 400, 9.0 if 200 <= i < 208 else rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "seg string, pos long, seg_rows long, x double, y double")
    args = (["seg"], 8, 4, ["x", "y"])
    drawn = detectors.draw_for_trees(windows.window_keys(df, *args[:3]), ["seg", "w"], 20, rows=32)
    assert {r["count"] for r in drawn.groupBy("tree").count().collect()} == {32} and drawn.select("tree", "w").distinct().count() == 640
    forests = [detectors.fit_window_iforest(df.repartition(n), *args, trees=40, rows=32) for n in (1, 5)]
    assert all((a == b).all() for a, b in zip(forests[0][0], forests[1][0], strict=True)) and len(forests[0][0]) == 40
    scored = {r.w: r.score for r in detectors.iforest_window_score(df, *args, forests[0]).collect()}
    assert max(scored, key=scored.get) == 50
    vectors = windows.window_features(df, *args)
    assert {r.w: pytest.approx(r.score) for r in detectors.iforest_score(vectors, "features", forests[0]).collect()} == scored
    few = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, None)], "id long, v array<double>")
    assert [r.score is None for r in detectors.iforest_score(few, "v", detectors.fit_iforest(few, "v", "id", trees=3)).orderBy("id").collect()] == [False, False, True]


def test_principal_components(spark):
    import numpy as np

    from winaudit.operators.components import fit_pca, pca_reduce

    rng = np.random.default_rng(3)
    for d, k, n in ((5, 3, 200), (300, 4, 500)):
        base = rng.standard_normal((n, d)) * (0.5 ** np.minimum(np.arange(d), 30)) + rng.standard_normal(d)
        x = base @ np.linalg.qr(rng.standard_normal((d, d)))[0]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "id long, v array<double>").repartition(4)
        mean, axes, variances = fit_pca(df, "v", k)
        _, scale, right = np.linalg.svd(x - x.mean(0))
        assert np.allclose(mean, x.mean(0)) and np.allclose(variances, scale[:k] ** 2 / (n - 1), rtol=1e-6)
        assert np.abs(np.abs((axes * right[:k].T).sum(0)) - 1).max() < 1e-6
        got = {r.id: r.reduced for r in pca_reduce(df, "v", k).collect()}
        assert got.pop(-1) is None
        assert np.allclose([got[i] for i in range(n)], (x - x.mean(0)) @ axes)
    with pytest.raises(ValueError, match="no vectors"):
        fit_pca(df.where("false"), "v", 2)


def test_many_components_of_long_vectors(spark):
    """9,984 components: 128 rows of 78 features."""
    df = spark.range(300, numPartitions=3).select(F.transform(F.sequence(F.lit(0), F.lit(9983)), lambda i: F.sin(i * (F.col("id") % 7 + 1)).cast("float")).alias("v"))
    from winaudit.operators.components import fit_pca

    _, axes, variances = fit_pca(df, "v", 100, passes=1)
    assert axes.shape == (9984, 100) and (variances[:6] > 1).all() and variances[6:].max() < 1e-6


@pytest.mark.parametrize("most", [10_000, 100])
def test_many_ranges_lose_no_row(spark, most):
    ranges = spark.createDataFrame([(f"r{i}", 10 * i, 10 * i + (4 if i % 50 else 400)) for i in range(1500)] + [("none", 5, 4)], "split_role string, lo long, hi long")
    df = spark.createDataFrame([(i, i + 1) for i in range(-5, 15_600, 7)] + [(None, 3)], "ts_s long, until long")
    want = sum(10 * k <= t <= 10 * k + (4 if k % 50 else 400) for t in range(-5, 15_600, 7) for k in range(1500))
    assert meeting_ranges(df, ranges, "ts_s", "ts_s", most=most).count() == want
    assert splits.split_by_ts_ranges(df, ranges).count() == want
    met = sum(any(10 * k <= t + 1 and t <= 10 * k + (4 if k % 50 else 400) for k in range(1500)) for t in range(-5, 15_600, 7))
    assert meeting_ranges(df, ranges, "ts_s", "until", "left_semi", most=most).count() == met


@pytest.mark.parametrize("most", [1000, 0])
def test_ranges_of_any_length(spark, most):
    """Repeated rows and ranges, spans of 3e9, ends that touch, one point."""
    rng = random.Random(most)
    spans = [(-10, -10), (0, 0), (0, 5), (0, 5), (5, 5), (6, 3_000_000_000), (-3_000_000_000, 3_000_000_000), (9, 8)] + [tuple(sorted((rng.randrange(200), rng.randrange(200)))) for _ in range(60)]
    rows = [(0, 0, "x"), (0, 0, "x"), (5, 6, "x"), (0, 3_000_000_000, "x"), (0, 3_000_000_000, "x"), (None, 4, "x"), (7, None, "x"), (8, 3, "x"), (-9, -8, "x")] + [(*sorted((rng.randrange(-5, 210), rng.randrange(-5, 210))), "x") for _ in range(60)]
    ranges = spark.createDataFrame([(lo, hi, i) for i, (lo, hi) in enumerate(spans)], "lo long, hi long, n int")
    df = spark.createDataFrame(rows, "since long, until long, row string")
    meets = lambda a, b, lo, hi: None not in (a, b) and a <= b and lo <= hi and b >= lo and a <= hi
    got = meeting_ranges(df, ranges, "since", "until", most=most)
    assert got.columns == ["since", "until", "row", "lo", "hi", "n"]
    assert sorted(map(tuple, got.collect())) == sorted((a, b, x, lo, hi, i) for a, b, x in rows for i, (lo, hi) in enumerate(spans) if meets(a, b, lo, hi))
    some = sorted((a, b, x) for a, b, x in rows if any(meets(a, b, lo, hi) for lo, hi in spans))
    assert sorted(map(tuple, meeting_ranges(df, ranges, "since", "until", "left_semi", most=most).collect())) == some
    assert meeting_ranges(df.where("false"), ranges, "since", "until", most=most).count() == 0


def test_a_million_ranges(spark):
    ranges = spark.range(1_000_000).select((F.col("id") * 1000).alias("lo"), (F.col("id") * 1000 + 499).alias("hi"), "id")
    df = spark.range(2000).select((F.col("id") * 500_000 + 250).alias("t"), (F.col("id") * 500_000 + 250 + 10_000).alias("u"))
    assert meeting_ranges(df, ranges, "t", "t").agg(F.count("*"), F.sum(F.col("id") * 1000 - F.col("t"))).first()[:] == (2000, -250 * 2000)
    assert meeting_ranges(df, ranges, "t", "u").count() == 2000 * 11


def test_segments_too_short_to_cut(spark):
    df = spark.createDataFrame([("f", i) for i in range(40)], "source_file string, i long")
    counts = {r.split_role: r["count"] for r in splits.split_chrono(df, 0.5, 0.25, 16, ["i"]).groupBy("split_role").count().collect()}
    assert counts == {splits.TRAIN: 20, splits.CALIBRATION: 4, splits.TEST: 16}
    with pytest.raises(Exception, match="too few rows"):
        splits.split_chrono(df, 0.6, 0.2, 18, ["i"]).collect()
    with pytest.raises(Exception, match="too short"):
        splits.split_mixed(df, 0.5, 40, ["i"]).collect()
    assert splits.split_mixed(df, 0.5, 40, ["i"], strict=False).where("split_role is null").count() == 40


def test_recommendation(spark):
    def choice(f1, auc, families=(), failures=None):
        deltas = spark.createDataFrame(list(zip(f1, auc, strict=True)), "delta_f1 double, delta_auc double")
        fam = spark.createDataFrame([("a", f, 0.5, 0) for f, _ in families] + [("b", f, 0.5 + g, failures or 0) for f, g in families], "model string, family string, recall double, failed int")
        return summary.model_recommendation(deltas, fam, "a", "b", F.col("failed")).first().recommended

    up, down = [0.05, 0.04, -0.01, 0.03], [-0.05, -0.04, -0.03, 0.01]
    assert choice(up, up) == "A"
    assert choice([0.3, -0.1, -0.1, 0.3], up) == "A"  # too few wins, yet both gains are positive
    assert choice(up, up, [("x", 0.2), ("y", -0.2)], failures=1) == "C"
    assert choice([0.001] * 4, [-0.002] * 4, [("x", 0.2), ("y", -0.2)]) == "B"
    assert choice(down, down, [("x", 0.2), ("y", -0.2)]) == "C"
    assert choice(down, down, [("x", 0.2)]) == "B"


def test_hash_check_tells_paths_and_contents_apart(spark, tmp_path):
    import gzip
    import hashlib

    for name, data in (("a/x.csv", b"1"), ("b/x.csv", b"2"), ("a/y.csv.gz", gzip.compress(b"3"))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = flow.file_hashes(spark, str(tmp_path))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    packed = sha((tmp_path / "a/y.csv.gz").read_bytes())
    rows = [("a/x.csv", sha(b"1"), None), ("b/x.csv", sha(b"1"), None), ("a/y.csv.gz", packed, sha(b"4")), ("z", "0", None)]
    manifest = spark.createDataFrame(rows, "path string, sha256 string, uncompressed_sha256 string")
    got = {r.path: r.status for r in flow.file_hash_check(found, manifest).collect()}
    assert got == {"a/x.csv": "ok", "b/x.csv": "mismatch", "a/y.csv.gz": "uncompressed mismatch", "z": "missing"}
    assert [r.path for r in flow.list_dataset_files(spark, str(tmp_path)).collect()] == ["a/x.csv", "b/x.csv"]
    (tmp_path / "Training and Testing Sets/deep").mkdir(parents=True)
    for name in ("top.csv", "Training and Testing Sets/t.csv", "Training and Testing Sets/deep/no.csv"):
        (tmp_path / name).write_text("x")
    assert [r.path for r in flow.list_dataset_files(spark, str(tmp_path), "UNSW").collect()] == ["Training and Testing Sets/t.csv", "top.csv"]


def test_hashes_of_large_and_packed_files(spark, tmp_path, monkeypatch):
    """A file beyond Spark's binary reader; packed ones of several members, that unpack to much more, and that are cut; names with blanks."""
    import gzip
    import hashlib

    with open(tmp_path / "large file.bin", "wb") as f:
        f.truncate(2_200_000_000)
    blank = hashlib.sha256()
    for _ in range(2200):
        blank.update(bytes(1_000_000))
    packed = gzip.compress(bytes(300_000_000), 1)
    (tmp_path / "a.csv.gz").write_bytes(packed)
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"one") + gzip.compress(b"two"))
    (tmp_path / "c.csv.gz").write_bytes(b"not packed")
    got = {r.path: (r.sha256, r.uncompressed_sha256) for r in flow.file_hashes(spark, f"file://{tmp_path}").collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {
        "large file.bin": (blank.hexdigest(), None), "a.csv.gz": (sha(packed), sha(bytes(300_000_000))), "b.csv.gz": (sha((tmp_path / "b.csv.gz").read_bytes()), sha(b"onetwo")),
        "c.csv.gz": (sha(b"not packed"), None),
    }
    (tmp_path / "large file.bin").unlink()
    monkeypatch.setattr(flow.re, "match", lambda *_: None)  # as with a scheme that only Spark reads
    assert {r.path: (r.sha256, r.uncompressed_sha256) for r in flow.file_hashes(spark, f"file://{tmp_path}").collect()} == {k: v for k, v in got.items() if k != "large file.bin"}


def test_numeric_screen_takes_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 2.0), (1.0, float("nan"))], "a double, b double")
    assert {r.column: (r.keep, r.reason) for r in features.numeric_screen(df, ["a", "b"]).collect()} == {"a": (False, "constant_or_single_value"), "b": (True, "")}


def _noisy_rows(spark, n=3000):
    """(i, label, v): the label follows from two of six features for nine rows in ten; one vector in 50 is null, one value in 40 NaN or null."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(6)]
        y = int(x[0] + x[3] > 0) if rng.random() < 0.9 else rng.randrange(2)
        if i % 40 == 3:
            x[5] = None if i % 80 == 3 else float("nan")
        rows.append((i, y, None if i % 50 == 7 else x))
    return spark.createDataFrame(rows, "i int, label int, v array<float>")


def test_forest_does_not_depend_on_partitions(spark, monkeypatch):
    from winaudit.operators import detectors, forest

    df = _noisy_rows(spark)
    fit, rest = df.where("i % 2 = 0"), df.where("i % 2 = 1")

    def scores(parts):
        out = detectors.rf_window_score(rest.repartition(parts, "i"), fit.repartition(parts, F.hash("i")), "v", trees=20, depth=20)
        assert out.columns == ["i", "label", "v", "score"]
        return {r.i: (r.label, r.score) for r in out.collect()}

    one = scores(1)
    assert set(one) == set(range(1, 3000, 2)) and one == scores(5)
    assert {i for i, (_, s) in one.items() if s is None} == {i for i in one if i % 50 == 7}
    got = spark.createDataFrame([(y, s) for y, s in one.values() if s is not None], "label int, score double")
    assert curves.roc_auc(curves.curve_points(got)).first().auc > 0.9
    # With small nodes the upper levels are grown from counts, and with few rows a task nodes are grown in several.
    monkeypatch.setattr(forest, "NODE_ROWS", 100)
    few = scores(2)
    monkeypatch.setattr(forest, "JUDGED_ROWS", 50)
    assert few == scores(3)
    got = spark.createDataFrame([(y, s) for y, s in few.values() if s is not None], "label int, score double")
    assert curves.roc_auc(curves.curve_points(got)).first().auc > 0.9
    assert few.keys() == one.keys() and few != one


def test_forest_of_one_class_and_of_none(spark):
    from winaudit.operators import detectors

    df = _noisy_rows(spark, 60)
    assert {r.score for r in detectors.rf_window_score(df, df.where("label = 0"), "v", trees=3).where("v is not null").collect()} == {0.0}
    assert detectors.rf_window_score(df.where("false"), df, "v", trees=3).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        detectors.rf_window_score(df, df.where("v is null"), "v")


def test_trees_split_as_gini_says():
    """A tree on all features, against every split tried; rows that count twice."""
    import numpy as np

    from winaudit.operators import forest

    rng = np.random.default_rng(3)
    bins, y, w = rng.integers(0, 5, (60, 3)).astype(np.uint8), rng.integers(0, 2, 60), rng.integers(1, 4, 60)
    tree = forest.grow(bins, y, w, 20, 3, rng)

    def check(at, rows, depth):
        feature, cut, left, right, share = (c[at] for c in tree)
        tot, pos = w[rows].sum(), (w * y)[rows].sum()
        assert share == pytest.approx(pos / tot)
        purity = lambda m: ((w * y)[m].sum() ** 2 + (w * (1 - y))[m].sum() ** 2) / w[m].sum() if len(m) else 0
        gains = {(f, c): purity(rows[bins[rows, f] <= c]) + purity(rows[bins[rows, f] > c]) - purity(rows) for f in range(3) for c in range(5)}
        top = max(gains.values())
        if feature < 0:
            assert top <= 1e-6 or pos in (0, tot)
            return 1
        assert gains[feature, cut] == pytest.approx(top)
        low = bins[rows, feature] <= cut
        return 1 + check(left, rows[low], depth + 1) + check(right, rows[~low], depth + 1)

    assert check(0, np.arange(60), 0) == len(tree[0])


def _sweep_rows(spark):
    """Two runs of 300 rows with ties and a null score, a third without calibration rows."""
    rng = random.Random(11)
    score = lambda: rng.choice([rng.random(), 0.25, 0.5])
    rows = [(run, rng.choice(["cal", "test", "other"]), rng.randrange(2), score(), score()) for run in (1, 2) for _ in range(300)]
    rows += [(1, "test", 1, None, 0.5), (3, "test", 1, 0.5, 0.5)]
    return rows, spark.createDataFrame(rows, "run int, role string, label int, sd float, sf float").repartition(3)


def test_sweep_against_definitions(spark):
    import numpy as np

    rows, df = _sweep_rows(spark)
    role = F.col("role")
    sweep = lambda **more: {(r.run, r.alpha): r for r in evaluate.alpha_sweep(df, 0.2, ["run"], role == "cal", role == "test", [0.0, 0.3, 1.0], **more).collect()}
    full, plain = sweep(), sweep(curve=False)
    assert set(full) == set(plain) == {(r, a) for r in (1, 2) for a in (0.0, 0.3, 1.0)}
    for (run, a), got in full.items():
        fused = [(p, y, np.float32(round(a * float(np.float32(sd)) + (1 - a) * float(np.float32(sf)), 6))) for r, p, y, sd, sf in rows if r == run and sd is not None]
        t = np.float32(np.quantile(np.array([s for p, _, s in fused if p == "cal"], float), 0.8))
        pos, neg = ([s for p, y, s in fused if p == "test" and y == k] for k in (1, 0))
        assert got.threshold == t and (got.tp, got.fp, got.tn, got.fn) == (sum(s >= t for s in pos), sum(s >= t for s in neg), sum(s < t for s in neg), sum(s < t for s in pos))
        assert got.auc == pytest.approx(sum((x > z) + (x == z) / 2 for x in pos for z in neg) / len(pos) / len(neg))
        assert {c: v for c, v in got.asDict().items() if c not in ("auc", "ap")} == plain[run, a].asDict()


def test_best_alpha_sweeps_seeds_without_curves(spark, monkeypatch):
    """Models of a seed aren't swept one by one, and no distinct fused score is moved for metrics that need none."""
    from winaudit.plans import audit, views

    seen, sweep = [], evaluate.alpha_sweep
    monkeypatch.setattr(evaluate, "alpha_sweep", lambda df, *a, **k: (seen.append(df.groupBy("seed").count().count()), sweep(df, *a, **k))[1])
    monkeypatch.setattr(evaluate, "swept", lambda *a: pytest.fail("swept"))
    assert audit.best_alpha(spark, "/root/testdata/sf0.001").count() == 3
    assert audit.broad_peak(spark, "/root/testdata/sf0.001").count() == 1
    assert seen == [len(views.SEEDS)] * 2


def test_quantiles_of_counted_values(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 0), ("a", 4.0, 2), ("a", None, 5), ("b", 7.0, 1)], "g string, v double, n int")
    got = {r.g: (r.low, r.mid, r.high) for r in radix.quantiles(df, ["g"], "v", {"low": 0.0, "mid": 0.625, "high": 1.0}, count="n").collect()}
    assert got == {"a": (1.0, 2.5, 4.0), "b": (7.0, 7.0, 7.0)}
