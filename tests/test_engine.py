"""The operators on small hand-computed histories."""

import math
import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.functions.scalar import SplitMix64, fields, nearest, parse_u32, to_double, to_u32, z_score
from wearline.operators import baselines, eda, labels, recurrent, regime, scoring, tree, windows
from wearline.plans import workflows
from wearline.schema import FILES, NUM_FIELDS, SUBSETS, Layout, subset_code, subsets
from wearline.sources import sinks, text
from wearline.streaming.cycles import read_cycle_stream, store_cycles

ONE = Layout(run=("unit",), order=("cycle",), settings=("op_setting_1",), sensors=("sensor_1", "sensor_2"))


def history(spark, rows, layout=ONE):
    """rows of (unit, cycle, sensor_1) or (unit, cycle, setting, sensor_1); sensor_2 varies."""
    full = [(r[0], r[1], float(r[2]) if len(r) == 4 else 0.0, float(r[-1]), float(r[1] * 3 % 7)) for r in rows]
    return spark.createDataFrame(full, "unit long, cycle long, op_setting_1 double, sensor_1 double, sensor_2 double")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


# ---- parsing

GOOD = "1 1 -0.0007 -0.0004 100.0 518.67 641.82 1589.70 1400.60 14.62 21.61 554.36 2388.06 9046.19 1.30 47.47 521.66 2388.02 8138.62 8.4195 0.03 392 2388 100.00 39.06 23.4190  "


def lines(spark, *texts):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(texts, 1)], "path string, line_no long, line string")


def test_a_line_of_26_fields_parses(spark):
    r = text.parsed(lines(spark, GOOD)).first()
    assert r["reason"] is None
    assert (r["unit"], r["cycle"], r["op_setting_1"], r["sensor_1"], r["sensor_21"]) == (1, 1, -0.0007, 518.67, 23.4190)


def test_bad_lines_are_named(spark):
    bad = text.bad_rows(lines(spark, GOOD, "1 2 3", GOOD.rstrip().rsplit(" ", 1)[0] + " NOTANUMBER", GOOD.replace("518.67", "5d"))).orderBy("line_no").collect()
    assert [r["line_no"] for r in bad] == [2, 3, 4]
    assert bad[0]["reason"] == f"expected {NUM_FIELDS} fields, found 3"
    assert bad[1]["reason"] == "could not parse sensor (NOTANUMBER) as a number"
    with pytest.raises(text.ParseError, match="line 2"):
        text.raise_first(text.bad_rows(lines(spark, GOOD, "1 2 3")))


def test_scalars(spark):
    df = spark.createDataFrame([("1d",), ("1.5f",), ("1e3",), ("-.5",), ("inf",), ("nan",), ("x",), ("0x1p3",), ("5.",)], "s string")
    got = [r[0] for r in df.select(to_double(F.col("s"))).collect()]
    assert got[:2] == [None, None] and got[2:5] == [1000.0, -0.5, math.inf] and math.isnan(got[5]) and got[6:] == [None, None, 5.0]
    one = spark.createDataFrame([(1,)], "a int")
    r = one.select(
        to_u32(F.lit(-3.5)).alias("low"), to_u32(F.lit(7.9)).alias("cut"), to_u32(F.lit(1e20)).alias("high"), to_u32(F.lit(float("nan"))).alias("nan"),
        parse_u32(F.lit("42")).alias("n"), parse_u32(F.lit("4294967296")).alias("over"), parse_u32(F.lit("-1")).alias("neg"), parse_u32(F.lit("1.0")).alias("dot"),
        F.size(fields(F.lit(" a \t b  "))).alias("two"), F.size(fields(F.lit("  "))).alias("none"), z_score(F.lit(5.0), F.lit(1.0), F.lit(1e-10)).alias("flat"),
        nearest([F.lit(5.0)], [[4.0], [6.0]]).alias("tie"),
    ).first()
    assert (r["low"], r["cut"], r["high"], r["nan"]) == (0, 7, 4294967295, 0)
    assert (r["n"], r["over"], r["neg"], r["dot"], r["two"], r["none"], r["flat"], r["tie"]) == (42, None, None, None, 2, 0, 0.0, 0)


def test_splitmix_reference_values():
    rng = SplitMix64(0)
    assert [rng.bits() for _ in range(3)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]
    assert 0 <= rng.uniform() < 1


def test_subset_names_and_facts(spark):
    assert [subset_code(x) for x in ("fd001", "2", "FD004")] == ["FD001", "FD002", "FD004"]
    with pytest.raises(ValueError):
        subset_code("FD009")
    assert {r["subset"]: tuple(r)[1:] for r in subsets(spark).collect()} == SUBSETS


# ---- labels


def test_train_labels(spark):
    df = labels.label_train(history(spark, [(1, c, 0) for c in range(1, 6)]), ONE)
    assert column(df, "rul", "cycle") == [4, 3, 2, 1, 0]
    long = column(labels.label_train(history(spark, [(1, c, 0) for c in range(1, 201)]), ONE), "rul", "cycle")
    assert long[0] == 125 and long[-1] == 0 and long == sorted(long, reverse=True)
    assert labels.label_breaks(df, ONE).count() == 0


def test_test_labels_and_positional_truth(spark):
    df = history(spark, [(u, c, 0) for u in (9, 3) for c in (1, 2, 3)])
    truth = spark.createDataFrame([(1, 50), (2, 7), (3, 1)], "ord int, final_rul long")
    out = labels.label_test(labels.join_truth(df, truth, ONE), ONE)
    assert column(out, "rul", "unit", "cycle") == [52, 51, 50, 9, 8, 7]
    with pytest.raises(ValueError):
        labels.join_truth(df, truth, ONE, strict=True)
    capped = labels.label_test(history(spark, [(1, c, 0) for c in range(1, 201)]).withColumn("final_rul", F.lit(10)), ONE)
    assert column(capped, "rul", "cycle")[0] == 125 and column(capped, "rul", "cycle")[-1] == 10


# ---- windows


def test_rolling_features(spark):
    df = labels.label_train(history(spark, [(1, 1, 1), (1, 2, 2), (1, 3, 3)]), ONE)
    r = windows.windowed_features(df, 3, ONE).first()
    assert (r["sensor_1_raw"], r["sensor_1_mean"], r["sensor_1_std"], r["sensor_1_slope"], r["rul"]) == (3, 2, 1, 1, 0)
    assert windows.windowed_features(df, 4, ONE).count() == 0
    assert [r["unit"] for r in windows.short_runs(df, 4, ONE).collect()] == [1]
    with pytest.raises(ValueError):
        windows.windowed_features(df, 1, ONE)


def test_windows_go_by_rows_and_stay_within_a_run(spark):
    df = history(spark, [(1, 1, 10), (1, 2, 12), (1, 9, 14), (2, 1, 100), (2, 2, 100), (2, 3, 100)])
    out = windows.windowed_features(df, 3, ONE).orderBy("unit").collect()
    assert [(r["unit"], r["sensor_1_slope"]) for r in out] == [(1, 2.0), (2, 0.0)]
    assert tuple(windows.window_count(df, 3, ONE).first()) == (2, 6, 2)


def test_last_only_equals_the_last_of_all(spark):
    df = history(spark, [(u, c, (u * c * 7) % 11) for u in (1, 2, 3) for c in range(1, 9)])
    every = windows.last_rows(windows.windowed_features(df, 4, ONE), ONE).orderBy("unit").collect()
    assert windows.windowed_features(df, 4, ONE, last_only=True).orderBy("unit").collect() == every


def test_feature_names():
    names = windows.feature_names()
    assert len(names) == 84 and names[0] == "sensor_1_raw" and names[21] == "sensor_1_mean" and names[-1] == "sensor_21_slope"
    fewer = windows.feature_names(excluded=[1, 5, 21])
    assert len(fewer) == 72 and not any(n.startswith(("sensor_1_", "sensor_5_", "sensor_21_")) for n in fewer)


def test_sequences_are_time_major(spark):
    df = history(spark, [(1, 1, 10), (1, 2, 20), (1, 3, 30)])
    r = windows.sequences(df, 3, ONE).first()
    assert r["sequence"][0::2] == [10, 20, 30] and len(r["sequence"]) == 6
    assert windows.sequences(df, 1, ONE, ["sensor_1"]).count() == 3


# ---- summaries


def test_summaries(spark):
    df = history(spark, [(1, c, 5) for c in range(1, 5)])
    assert [r["sensor"] for r in eda.near_constant(eda.sensor_stats(df, ONE)).collect()] == [1]
    assert eda.excluded_sensors(df, ONE) == [1]
    runs = history(spark, [(u, c, 0) for u, n in ((1, 10), (2, 20), (3, 30)) for c in range(1, n + 1)])
    assert tuple(eda.run_lengths(runs, ONE).first()) == (10, 20.0, 30)
    ties = history(spark, [(u, c, 0) for u in (1, 2) for c in (1, 2)])
    assert eda.longest_run(ties, ONE).first()["unit"] == 2


def test_correlation(spark):
    up = labels.label_train(history(spark, [(1, c, c) for c in range(1, 42)]), ONE)
    down = labels.label_train(history(spark, [(1, c, -c) for c in range(1, 42)]), ONE)
    flat = labels.label_train(history(spark, [(1, c, 7) for c in range(1, 42)]), ONE)
    got = [eda.rul_correlation(x, ONE).where("sensor = 1").first()["corr"] for x in (up, down, flat)]
    assert got[0] == pytest.approx(-1) and got[1] == pytest.approx(1) and got[2] == 0.0
    assert eda.top_sensors(eda.rul_correlation(up, ONE), 1).first()["sensor"] == 1


# ---- scoring


def pairs(spark, *p):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "unit int, pred double, true_rul double")


def test_scores(spark):
    assert scoring.rmse(pairs(spark, (53, 50), (6, 10))) == pytest.approx(math.sqrt(12.5))
    assert scoring.score(pairs(spark, (60, 50))).first()["phm08"] == pytest.approx(math.e - 1)
    assert scoring.score(pairs(spark, (37, 50))).first()["phm08"] == pytest.approx(math.e - 1)
    late, early, both = (scoring.score(pairs(spark, *p)).first()["phm08"] for p in ([(60, 50)], [(40, 50)], [(60, 50), (40, 50)]))
    assert late > early and both == pytest.approx(late + early)
    assert tuple(scoring.score(pairs(spark, (5, 5), (4, 5))).select("late", "early").first()) == (1, 1)
    with pytest.raises(ValueError):
        scoring.rmse(pairs(spark).limit(0))
    assert scoring.score(pairs(spark, (1, 1)).limit(0)).first()["phm08"] == 0
    assert [r["unit"] for r in scoring.worst(pairs(spark, (1, 5), (9, 5), (5, 5), (5, 10)), 2).collect()] == [3, 0]


# ---- regimes


def test_kmeans_blobs_duplicates_and_one_cluster(spark):
    blobs = history(spark, [(1, c, (c % 3) * 100 + (c // 3) * 0.01, 0) for c in range(60)])
    first, again = (regime.fit_regimes(blobs, 3, ONE, 42) for _ in range(2))
    assert first == again
    assert sorted(r["n"] for r in regime.regime_sizes(regime.assign(blobs, first, ONE.settings), 3).collect()) == [20, 20, 20]
    same = history(spark, [(1, c, 4, 0) for c in range(10)])
    assert len(regime.fit_regimes(same, 2, ONE, 7)) == 2
    assert {r["regime"] for r in regime.assign(same, regime.fit_regimes(same, 1, ONE), ONE.settings).collect()} == {0}
    with pytest.raises(ValueError):
        regime.fit_regimes(same, 11, ONE)


def test_normalisation_uses_training_statistics(spark):
    train = history(spark, [(1, 1, 0, 50), (1, 2, 0, 52), (1, 3, 10, 150), (1, 4, 10, 148)])
    test = history(spark, [(1, 1, 0, 51), (1, 2, 10, 151)])
    centres = [(0.0,), (10.0,)]
    stats = regime.regime_stats(regime.assign(train, centres, ONE.settings), ONE)
    assert column(regime.normalize(test, centres, stats, ONE), "sensor_1", "cycle") == [0.0, 2.0]
    flat = history(spark, [(1, c, 0, 42) for c in range(4)])
    stats = regime.regime_stats(regime.assign(flat, [(0.0,)], ONE.settings), ONE)
    assert set(column(regime.normalize(flat, [(0.0,)], stats, ONE), "sensor_1", "cycle")) == {0.0}


# ---- trees


def table(spark, xs, ys):
    return spark.createDataFrame([(float(x), 3.0, float(y)) for x, y in zip(xs, ys)], "a double, b double, y double")


def test_trees(spark):
    assert tree.fit_tree(table(spark, [1, 2, 3], [10, 20, 30]), ["a"], "y", tree.TreeParams(0, 1)) == tree.Node(20.0)
    step = tree.fit_tree(table(spark, range(20), [0] * 10 + [100] * 10), ["b", "a"], "y", tree.TreeParams(3, 1))
    assert (step.feature, step.threshold, step.predict([3, 2]), step.predict([3, 15])) == (1, 9.5, 0, 100)
    deep = tree.fit_tree(table(spark, range(64), range(64)), ["a"], "y", tree.TreeParams(2, 1))
    assert deep.depth() == 2
    assert tree.fit_tree(table(spark, range(10), [5] * 10), ["a"], "y").depth() == 0
    assert tree.fit_tree(table(spark, [1] * 10, range(10)), ["a", "b"], "y", tree.TreeParams(3, 1)).depth() == 0
    rows = table(spark, range(10), [x * x for x in range(10)])
    leaf = tree.fit_tree(rows, ["a"], "y", tree.TreeParams(5, 4))
    sizes = [r["n"] for r in rows.groupBy(leaf.column(["a", "b"]).alias("p")).agg(F.count("*").alias("n")).collect()]
    assert min(sizes) >= 4


def test_best_split_equals_a_plain_search(spark):
    import random

    rng = random.Random(3)
    xs, ys = [rng.randrange(40) for _ in range(300)], [rng.random() for _ in range(300)]
    got = tree.best_splits(table(spark, xs, ys).withColumn("node", F.lit(1)), ["a"], "y", "node", 20).first()

    def sse(v):
        return sum((x - sum(v) / len(v)) ** 2 for x in v)

    best = max(((sse(ys) - sse(left) - sse(right), -t) for t in {(a + b) / 2 for a, b in zip(sorted(set(xs)), sorted(set(xs))[1:])} if len(left := [y for x, y in zip(xs, ys) if x <= t]) >= 20 and len(right := [y for x, y in zip(xs, ys) if x > t]) >= 20))
    assert got["gain"] == pytest.approx(best[0]) and got["threshold"] == -best[1]


def test_boosting(spark):
    flat = tree.fit_boosted(table(spark, [1, 2, 3], [10, 20, 30]), ["a"], "y", tree.BoostParams(0))
    assert flat.init == 20 and flat.curve == [] and set(column(flat.predict(table(spark, [1], [1])), "pred", "a")) == {20.0}
    rows = table(spark, range(50), [0] * 25 + [10] * 25)
    params = tree.BoostParams(6, 0.3, tree.TreeParams(2, 1))
    one, two = (tree.fit_boosted(rows, ["a"], "y", params) for _ in range(2))
    assert [t.table() for t in one.trees][0][0][2:4] == [t.table() for t in two.trees][0][0][2:4] == (0, 24.5)
    assert one.curve == pytest.approx(two.curve) and len(one.curve) == 6 and one.curve == sorted(one.curve, reverse=True) and one.curve[-1] < 1
    assert column(one.predict(rows, at_once=2), "pred", "a")[0] == pytest.approx(5 - 5 * (1 - 0.7**6))
    assert one.table(spark).count() >= 12 and one.curve_table(spark).count() == 6


def test_baselines_and_recurrent(spark):
    rows = table(spark, range(60), [2 * x + 1 for x in range(60)])
    out = baselines.linear_predict(rows, rows, ["a"], "y")
    assert column(out, "pred_linear", "a")[10] == pytest.approx(21)
    assert baselines.forest_predict(rows, rows, ["a"], "y", trees=3, depth=3).where("pred_rf is null").count() == 0
    runs = labels.label_train(history(spark, [(u, c, c) for u in (1, 2) for c in range(1, 30)]), ONE)
    seq = windows.sequences(runs, 3, ONE)
    model, losses = recurrent.fit_recurrent(seq, 3, recurrent.RecurrentParams(hidden=4, epochs=6, learning_rate=0.1))
    assert losses[-1] < losses[0]
    assert recurrent.predict_recurrent(model, seq, 3).where("pred_lstm is null").count() == 0


# ---- files, workflows and the stream


def write_subset(folder, units, lengths, cut):
    def rows(unit, n):
        return [" ".join([str(unit), str(c), "0.1", "0.2", "100.0", *(f"{(unit * 31 + c * (s + 1)) % 97 + s:.2f}" if s else "518.67" for s in range(21))]) + "  " for c in range(1, n + 1)]

    (folder / "train_FD001.txt").write_text("\n".join(r for u, n in zip(units, lengths) for r in rows(u, n)) + "\n\n")
    (folder / "test_FD001.txt").write_text("\n".join(r for u, n in zip(units, lengths) for r in rows(u, n - cut)) + "\n")
    (folder / "RUL_FD001.txt").write_text("".join(f"{cut} \n" for _ in units))


def test_files_to_predictions(spark, tmp_path):
    write_subset(tmp_path, [1, 2, 3], [30, 40, 35], 6)
    p = workflows.load(spark, str(tmp_path), "1")
    assert p.excluded == [1] and len(p.features()) == 80
    assert p.train.count() == 105 and labels.label_breaks(p.train).count() == 0
    last = windows.last_rows(p.test).select("rul").distinct().collect()
    assert [r["rul"] for r in last] == [6]
    metrics = {r["metric"]: r["value"] for r in workflows.process(spark, str(tmp_path), "FD001", str(tmp_path / "out")).collect()}
    assert metrics["train_units"] == "3" and metrics["train_windows"] == str(105 - 27) and metrics["near_constant_sensors"] == "1"
    back = spark.read.csv(str(tmp_path / "out/FD001_train_features.csv"), header=True)
    assert len(back.columns) == 90 and back.count() == 78
    assert len(spark.read.csv(str(tmp_path / "out/FD001_test_labeled.csv"), header=True).columns) == 27
    done, failed = workflows.process_all(spark, str(tmp_path), None)
    assert list(done) == ["FD001"] and sorted(failed) == ["FD002", "FD003", "FD004"]


def test_bad_files(spark, tmp_path):
    write_subset(tmp_path, [1], [30], 6)
    with open(tmp_path / "train_FD001.txt", "a") as f:
        f.write("1 2 3\n")
    with pytest.raises(text.ParseError) as e:
        text.read_cycles(spark, str(tmp_path), "FD001", "train")
    assert e.value.line_number == 32 and e.value.raw_line == "1 2 3"
    assert text.read_cycles(spark, str(tmp_path), "FD001", "train", strict=False).count() == 30
    (tmp_path / "RUL_FD001.txt").write_text("5\n\nx\n")
    with pytest.raises(text.ParseError, match="line 3"):
        text.read_truth(spark, str(tmp_path), "FD001")


def test_stream_parses_as_the_batch_does(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(GOOD + "\n\n1 2 3\n")
    store_cycles(read_cycle_stream(spark, str(tmp_path / "in")), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).first()["sensor_21"] == 23.4190
    assert spark.read.parquet(str(tmp_path / "bad")).first()["line"] == "1 2 3"


def test_normalised_prediction_names(spark):
    assert sinks.prediction_path("o/", "FD001", "flagship_predictions", True) == "o/FD001_flagship_predictions_normalized.csv"
    out = sinks.predictions(pairs(spark, (3, 5)), {"x": "pred"}).first()
    assert tuple(out) == (0, 5.0, 3.0, -2.0)
    assert replace(FILES).run == ("subset", "split", "unit")


# ---- packed trees and splits of files


def plain_tree(x, y, depth, least):
    """(value, feature, threshold, left, right) by trying every split."""
    n, best = len(y), None
    if depth and n >= 2 * least:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for a, b in zip(values, values[1:]):
                left = x[:, f] <= (a + b) / 2
                k = left.sum()
                if least <= k <= n - least:
                    gain = y[left].sum() ** 2 / k + y[~left].sum() ** 2 / (n - k) - y.sum() ** 2 / n
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, f, (a + b) / 2, left)
    if best is None or best[0] <= 1e-12:
        return (y.mean(), None, None, None, None)
    _, f, t, left = best
    return (y.mean(), f, t, plain_tree(x[left], y[left], depth - 1, least), plain_tree(x[~left], y[~left], depth - 1, least))


def as_plain(node):
    return (node.value, node.feature, node.threshold, *(None if c is None else as_plain(c) for c in (node.left, node.right)))


def alike(a, b):
    if a is None or b is None:
        return a is b
    return a[0] == pytest.approx(b[0]) and a[1] == b[1] and (a[2] == pytest.approx(b[2]) if a[2] is not None else b[2] is None) and alike(a[3], b[3]) and alike(a[4], b[4])


@pytest.mark.parametrize("range_rows", [4_000_000, 40])
def test_packed_trees_equal_plain_ones(spark, monkeypatch, range_rows):
    from wearline.operators import tree

    monkeypatch.setattr(tree, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(tree, "BLOCK_ROWS", 17)
    monkeypatch.setattr(tree, "TREES_AT_ONCE", 2)
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 9, 200), rng.normal(size=200).round(2), np.ones(200)])
    y = x[:, 0] * (x[:, 1] > 0) + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([x, y])], "a double, b double, c double, y double")
    assert alike(as_plain(tree.fit_tree(df, ["a", "b", "c"], "y", tree.TreeParams(3, 8))), plain_tree(x, y, 3, 8))
    model, rest = tree.fit_boosted(df, ["a", "b", "c"], "y", tree.BoostParams(5, 0.5, tree.TreeParams(2, 8))), y - y.mean()
    for fitted, error in zip(model.trees, model.curve, strict=True):
        want = plain_tree(x, rest, 2, 8)
        assert alike(as_plain(fitted), want)
        rest = rest - 0.5 * np.array([fitted.predict(row) for row in x])
        assert error == pytest.approx(np.sqrt(np.mean(rest**2)))


@pytest.mark.parametrize("kind", ["noise", "ties", "far", "tails"])
def test_packed_trees_with_few_cells_and_small_parts(spark, monkeypatch, kind):
    for name, value in {"LEVEL_CELLS": 24, "CELL_ROWS": 4, "RANGE_ROWS": 30, "BLOCK_ROWS": 17, "HELD": 16, "TASKS_AT_ONCE": 1, "TREES_AT_ONCE": 1, "STEPS": 2}.items():
        monkeypatch.setattr(tree, name, value)
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=240), rng.integers(0, 3, 240) if kind == "ties" else rng.random(240)])
    y = {"noise": rng.normal(size=240), "ties": rng.integers(0, 2, 240) * 1.0, "far": 1e6 + rng.normal(size=240), "tails": rng.standard_cauchy(240)}[kind]
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([x, y])], "a double, b double, y double")
    assert alike(as_plain(tree.fit_tree(df, ["a", "b"], "y", tree.TreeParams(3, 5))), plain_tree(x, y, 3, 5))
    if kind == "noise":
        model, rest = tree.fit_boosted(df, ["a", "b"], "y", tree.BoostParams(5, 0.5, tree.TreeParams(1, 5))), y - y.mean()
        for fitted, error in zip(model.trees, model.curve, strict=True):
            assert alike(as_plain(fitted), plain_tree(x, rest, 1, 5))
            rest = rest - 0.5 * np.array([fitted.predict(row) for row in x])
            assert error == pytest.approx(np.sqrt(np.mean(rest**2)))


def test_a_level_does_not_send_every_value(spark):
    """Sums by value of all rows made each level as large as the table."""
    rows = 60_000
    df = spark.range(0, rows, 1, 4).select(*(F.rand(i).alias(f"f{i}") for i in range(4))).withColumn("y", F.col("f1") + F.rand(9))

    def written():
        return sum(e.totalShuffleWrite() for e in (seq.apply(i) for seq in [spark.sparkContext._jsc.sc().statusStore().executorList(False)] for i in range(seq.size())))

    packed = tree._Packed(df, ["f0", "f1", "f2", "f3"], "y")
    before = written()
    nodes = packed.grown(tree.TreeParams(2, 20))
    assert nodes[1]["feature"] == 1 and abs(nodes[1]["threshold"] - 0.5) < 0.1
    assert written() - before < rows * 4 * 8 / 4  # of two levels; the values alone of one level have rows * 4 * 8 bytes


def test_packed_trees_refuse_what_has_no_order(spark):
    from wearline.operators import tree

    for rows in ([(1.0, None)], [(float("nan"), 1.0)]):
        with pytest.raises(Exception, match="null or nan"):
            tree.fit_tree(spark.createDataFrame(rows, "a double, y double"), ["a"], "y")
    with pytest.raises(ValueError, match="zero rows"):
        tree.fit_boosted(spark.createDataFrame([], "a double, y double"), ["a"], "y")


def test_long_whole_numbers_and_a_bad_end(spark):
    import time

    df = spark.createDataFrame([(f"p{k}", 1, " ".join(["1234567890"] * 25) + f" 12345{end}") for k, end in enumerate(["", "x", "..", "d"])] + [("p9", 1, None)], "path string, line_no long, line string")
    began = time.time()
    got = {r["path"]: r["reason"] for r in text.parsed(df).collect()}
    assert time.time() - began < 20 and got["p0"] is None and got["p1"] == "could not parse sensor (12345x) as a number"
    assert all(got[p] for p in ("p2", "p3")) and got["p9"] == "expected 26 fields, found 0"


def test_lines_keep_their_numbers_across_splits(spark, tmp_path):
    want = {}
    for name in ("a.txt", "b.txt"):
        lines = [f"{name} line {i} " + "x" * (i % 50) if i % 7 else "  " for i in range(1, 4000)]
        (tmp_path / name).write_bytes("\r\n".join(lines).encode() if name == "a.txt" else "\n".join(lines).encode() + b"\n\n")
        want |= {(name, i): line for i, line in enumerate(lines, 1) if line.strip()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = text.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(os.path.basename(r["path"]), r["line_no"]): r["line"] for r in got} == want and len(got) == len(want)
