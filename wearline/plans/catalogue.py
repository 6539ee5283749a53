"""Registered queries over the driver's tables, each with its oracle SQL where SQL can say it.

Floating results are rounded to six decimals on both sides, and 0.0 is added so
that a negative zero cannot differ from zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fields, to_double
from ..operators import baselines, eda, labels, recurrent, regime, scoring, tree, windows
from ..schema import Layout, subsets
from ..sources import sinks, text
from . import adapters, workflows

L, E = adapters.L_LAYOUT, adapters.E_LAYOUT
L_SQL, E_SQL = adapters.L_SQL, adapters.E_SQL
CAP, WINDOW = 125, 10
FLOAT = {"double", "float"}

QUERIES: dict = {}
ORACLES: dict = {}

#: Centres that the regime queries and their oracles share: discount, tax, quantity.
CENTRES = [(0.02, 0.01, 8.3), (0.05, 0.04, 25.1), (0.08, 0.06, 43.7)]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if kind in FLOAT else F.col(c) for c, kind in df.dtypes))


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def _l(spark, d):
    return adapters.line_items(spark, d)


def _e(spark, d):
    return adapters.user_events(spark, d)


_OVER = f"(PARTITION BY unit ORDER BY cycle ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)"

# ---- labels


@query(f"WITH {L_SQL}, {adapters.split_sql('l')} SELECT unit, cycle, least(max(cycle) OVER (PARTITION BY unit) - cycle, {CAP})::BIGINT AS rul FROM tr")
def rul_label_train(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_train(adapters.training(_l(spark, d)), L, CAP).select("unit", "cycle", "rul")


_TEST = f"""tl AS (
  SELECT te.*, t.final_rul, least(t.final_rul + max(te.cycle) OVER (PARTITION BY te.unit) - te.cycle, {CAP})::BIGINT AS rul
  FROM te JOIN (SELECT unit, row_number() OVER (ORDER BY unit) AS ord FROM (SELECT DISTINCT unit FROM te)) u ON te.unit = u.unit JOIN truth t ON t.ord = u.ord)"""


def _test_labelled(df: DataFrame, layout: Layout) -> DataFrame:
    return labels.label_test(labels.join_truth(adapters.test(df), adapters.truth(df), layout), layout, CAP)


@query(f"WITH {L_SQL}, {adapters.split_sql('l')}, {_TEST} SELECT unit, cycle, final_rul::BIGINT AS final_rul, rul FROM tl")
def rul_label_test_positional(spark: SparkSession, d: str) -> DataFrame:
    return _test_labelled(_l(spark, d), L).select("unit", "cycle", "final_rul", "rul")


@query(f"WITH {L_SQL}, {adapters.split_sql('l')}, x AS (SELECT unit, least(max(cycle) OVER (PARTITION BY unit) - cycle, {CAP}) AS rul, cycle FROM tr), y AS (SELECT *, lag(rul) OVER w AS b, lead(rul) OVER w AS a FROM x WINDOW w AS (PARTITION BY unit ORDER BY cycle)) SELECT count(*)::BIGINT AS breaks FROM y WHERE rul > b OR (a IS NULL AND rul <> 0)")
def label_monotonicity(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_breaks(labels.label_train(adapters.training(_l(spark, d)), L, CAP), L).agg(F.count("*").alias("breaks"))


@query(f"WITH {L_SQL} SELECT 'lineitem' AS subset, count(DISTINCT unit)::BIGINT AS units, 99::BIGINT AS expected FROM l HAVING count(DISTINCT unit) <> 99")
def unit_count_check(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.createDataFrame([("lineitem", 99)], "subset string, expected long")
    return labels.unit_count_check(_l(spark, d).withColumn("subset", F.lit("lineitem")), expected, Layout(run=("subset", "unit"))).select("subset", "units", "expected")


# ---- windows


def _rolling(spark, d, kinds):
    out = windows.windowed_features(_l(spark, d), WINDOW, L, kinds=kinds)
    return rounded(out.select("unit", "cycle", *(f"{s}_{k}" for s in L.sensors for k in kinds)))


def _kind_sql(s: str, k: str) -> str:
    return {"raw": r6(s, f"{s}_raw"), "mean": r6(f"avg({s}) OVER w", f"{s}_mean"), "std": r6(f"stddev_samp({s}) OVER w", f"{s}_std"), "slope": r6(f"regr_slope({s}, cycle) OVER w", f"{s}_slope")}[k]


def _rolling_sql(kinds, name="l", cte=L_SQL, layout=L, more=""):
    columns = ", ".join(_kind_sql(s, k) for s in layout.sensors for k in kinds)
    return f"WITH {cte} SELECT unit, cycle{more}, {columns} FROM {name} WINDOW w AS {_OVER} QUALIFY cycle >= {WINDOW}"


@query(_rolling_sql(["mean"]))
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rolling(spark, d, ["mean"])


@query(_rolling_sql(["std"]))
def rolling_std(spark: SparkSession, d: str) -> DataFrame:
    return _rolling(spark, d, ["std"])


@query(_rolling_sql(["slope"]))
def rolling_slope(spark: SparkSession, d: str) -> DataFrame:
    return _rolling(spark, d, ["slope"])


_TRAIN_LABELLED = f"{L_SQL}, {adapters.split_sql('l')}, x AS (SELECT *, least(max(cycle) OVER (PARTITION BY unit) - cycle, {CAP})::BIGINT AS rul FROM tr)"


@query(_rolling_sql(windows.KINDS, "x", _TRAIN_LABELLED, L, ", op_setting_1, op_setting_2, op_setting_3, rul"))
def windowed_features(spark: SparkSession, d: str) -> DataFrame:
    out = windows.windowed_features(labels.label_train(adapters.training(_l(spark, d)), L, CAP), WINDOW, L)
    return rounded(out.select("unit", "cycle", *L.settings, "rul", *(f"{s}_{k}" for s in L.sensors for k in windows.KINDS)))


@query(f"WITH {E_SQL}, f AS (SELECT unit, cycle, {', '.join(_kind_sql(s, k) for s in E.sensors for k in windows.KINDS)}, row_number() OVER (PARTITION BY unit ORDER BY cycle DESC) AS back FROM e WINDOW w AS {_OVER} QUALIFY cycle >= {WINDOW}) SELECT * EXCLUDE (back) FROM f WHERE back = 1")
def last_window_per_unit(spark: SparkSession, d: str) -> DataFrame:
    out = windows.windowed_features(_e(spark, d), WINDOW, E, last_only=True)
    return rounded(out.select("unit", "cycle", *(f"{s}_{k}" for s in E.sensors for k in windows.KINDS)))


@query(f"WITH {E_SQL} SELECT unit, count(*)::BIGINT AS rows FROM e GROUP BY unit HAVING count(*) < 60")
def empty_window_units(spark: SparkSession, d: str) -> DataFrame:
    return windows.short_runs(_e(spark, d), 60, E)


@query(f"WITH {E_SQL}, n AS (SELECT unit, count(*) AS n FROM e GROUP BY unit) SELECT count(*)::BIGINT AS units, sum(n)::BIGINT AS cycles, sum(greatest(n - {WINDOW} + 1, 0))::BIGINT AS windows FROM n")
def window_totals(spark: SparkSession, d: str) -> DataFrame:
    return windows.window_count(_e(spark, d), WINDOW, E)


@query(f"""WITH {E_SQL}, s AS (SELECT unit, cycle, list([sensor_1, sensor_2]) OVER (PARTITION BY unit ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS q FROM e QUALIFY cycle >= 5),
f AS (SELECT unit, cycle, flatten(q) AS q FROM s)
SELECT unit, cycle, k::INT AS place, {r6('q[k]', 'value')} FROM f, (SELECT unnest(range(1, 11)) AS k)""")
def sequence_windows(spark: SparkSession, d: str) -> DataFrame:
    out = windows.sequences(_e(spark, d), 5, E)
    return rounded(out.select("unit", "cycle", F.posexplode("sequence").alias("place", "value")).withColumn("place", F.col("place") + 1))


@query("SELECT name, place::INT AS place FROM (VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate(windows.feature_names(L, [5]), 1)) + ") v(name, place)")
def feature_names(spark: SparkSession, d: str) -> DataFrame:
    names = windows.feature_names(L, eda.excluded_sensors(_l(spark, d), L))
    return spark.createDataFrame(list(enumerate(names, 1)), "place int, name string")


# ---- summaries


@query(f"WITH {E_SQL}, n AS (SELECT max(cycle) AS n FROM e GROUP BY unit) SELECT min(n)::BIGINT AS min_cycles, {r6('avg(n)', 'mean_cycles')}, max(n)::BIGINT AS max_cycles FROM n")
def run_length_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eda.run_lengths(_e(spark, d), E))


_STATS = " UNION ALL ".join(f"SELECT {i}::INT AS sensor, avg({s}) AS mean, stddev_samp({s}) AS std_dev FROM l" for i, s in enumerate(L.sensors, 1))


# the sixth decimal of one mean is a rounding boundary, so these keep eight
@query(f"WITH {L_SQL}, s AS ({_STATS}) SELECT sensor, round(mean, 8) AS mean, round(std_dev, 8) AS std_dev FROM s")
def sensor_stats(spark: SparkSession, d: str) -> DataFrame:
    return eda.sensor_stats(_l(spark, d), L).select("sensor", F.round("mean", 8).alias("mean"), F.round("std_dev", 8).alias("std_dev"))


@query(f"WITH {L_SQL}, s AS ({_STATS}) SELECT sensor FROM s WHERE std_dev < 1e-6")
def near_constant_sensors(spark: SparkSession, d: str) -> DataFrame:
    return eda.near_constant(eda.sensor_stats(_l(spark, d), L))


_CORR = " UNION ALL ".join(f"SELECT {i}::INT AS sensor, CASE WHEN count(*) * sqrt(var_pop({s}) * var_pop(rul)) < 1e-9 THEN 0.0 ELSE covar_pop({s}, rul) / sqrt(var_pop({s}) * var_pop(rul)) END AS corr FROM x" for i, s in enumerate(L.sensors, 1))


def _train_labelled(spark, d):
    return labels.label_train(adapters.training(_l(spark, d)), L, CAP)


@query(f"WITH {_TRAIN_LABELLED}, c AS ({_CORR}) SELECT sensor, {r6('corr', 'corr')} FROM c")
def sensor_rul_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eda.rul_correlation(_train_labelled(spark, d), L))


@query(f"WITH {_TRAIN_LABELLED}, c AS ({_CORR}) SELECT sensor, {r6('corr', 'corr')}, row_number() OVER (ORDER BY abs(corr) DESC, sensor)::INT AS rank FROM c QUALIFY rank <= 3")
def top_sensors_by_corr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eda.top_sensors(eda.rul_correlation(_train_labelled(spark, d), L)))


_LONGEST = "g AS (SELECT unit, max(cycle) AS last_cycle FROM l GROUP BY unit ORDER BY last_cycle DESC, unit DESC LIMIT 1)"


@query(f"WITH {L_SQL}, {_LONGEST} SELECT unit, last_cycle FROM g")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return eda.longest_run(_l(spark, d), L)


@query(f"WITH {L_SQL}, {_LONGEST}, x AS (SELECT l.* FROM l JOIN g USING (unit)) SELECT unit, cycle, {', '.join(_kind_sql(s, k) for s in ('sensor_1', 'sensor_2') for k in ('raw', 'mean'))} FROM x WINDOW w AS {_OVER} QUALIFY cycle >= {WINDOW}")
def raw_vs_rolling(spark: SparkSession, d: str) -> DataFrame:
    df = _l(spark, d)
    one = df.join(F.broadcast(eda.longest_run(df, L).select("unit")), "unit")
    out = windows.windowed_features(one, WINDOW, L, ["sensor_1", "sensor_2"], ("raw", "mean"))
    return rounded(out.select("unit", "cycle", *(f"{s}_{k}" for s in ("sensor_1", "sensor_2") for k in ("raw", "mean"))))


@query(f"WITH {L_SQL}, {_LONGEST} SELECT unit, cycle, least(last_cycle - cycle, {CAP})::BIGINT AS rul FROM l JOIN g USING (unit)")
def rul_shape(spark: SparkSession, d: str) -> DataFrame:
    df = _l(spark, d)
    return labels.label_train(df.join(F.broadcast(eda.longest_run(df, L).select("unit")), "unit"), L, CAP).select("unit", "cycle", "rul")


# ---- regimes


def _distance_sql(c) -> str:
    return " + ".join(f"(op_setting_{i} - {float(x)!r}) * (op_setting_{i} - {float(x)!r})" for i, x in enumerate(c, 1))


_ASSIGN = f"a0 AS (SELECT *, {', '.join(f'{_distance_sql(c)} AS d{i}' for i, c in enumerate(CENTRES))} FROM l), a AS (SELECT * EXCLUDE (d0, d1, d2), CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END::INT AS regime FROM a0)"


@query(f"WITH {L_SQL}, {_ASSIGN} SELECT unit, cycle, regime FROM a")
def regime_assign(spark: SparkSession, d: str) -> DataFrame:
    return regime.assign(_l(spark, d), CENTRES, L.settings).select("unit", "cycle", "regime")


@query(f"WITH {L_SQL}, {_ASSIGN}, k AS (SELECT unnest(range(4))::INT AS regime) SELECT k.regime, count(a.unit)::BIGINT AS n FROM k LEFT JOIN a ON a.regime = k.regime GROUP BY 1")
def regime_sizes(spark: SparkSession, d: str) -> DataFrame:
    return regime.regime_sizes(regime.assign(_l(spark, d), CENTRES, L.settings), 4)


_REGIME_STATS = "rs AS (" + " UNION ALL ".join(f"SELECT regime, {i}::INT AS sensor, avg({s}) AS mean, stddev_pop({s}) AS std, count(*)::BIGINT AS n FROM a GROUP BY regime" for i, s in enumerate(L.sensors, 1)) + ")"


@query(f"WITH {L_SQL}, {_ASSIGN}, {_REGIME_STATS} SELECT regime, sensor, {r6('mean', 'mean')}, {r6('std', 'std')}, n FROM rs")
def regime_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regime.regime_stats(regime.assign(_l(spark, d), CENTRES, L.settings), L))


@query(f"WITH {L_SQL}, {_ASSIGN}, z AS (SELECT unit, cycle, op_setting_1, op_setting_2, op_setting_3, " + ", ".join(f"CASE WHEN stddev_pop({s}) OVER r < 1e-9 THEN 0.0 ELSE ({s} - avg({s}) OVER r) / stddev_pop({s}) OVER r END AS {s}" for s in L.sensors) + " FROM a WINDOW r AS (PARTITION BY regime)) SELECT unit, cycle, op_setting_1, op_setting_2, op_setting_3, " + ", ".join(r6(s, s) for s in L.sensors) + " FROM z")
def regime_normalize(spark: SparkSession, d: str) -> DataFrame:
    df = _l(spark, d)
    return rounded(regime.normalize(df, CENTRES, regime.regime_stats(regime.assign(df, CENTRES, L.settings), L), L))


def _lloyd_sql(rounds: int) -> str:
    parts = [L_SQL, "c0(i, x, y, z) AS (VALUES " + ", ".join(f"({i}, {c[0]!r}::DOUBLE, {c[1]!r}::DOUBLE, {c[2]!r}::DOUBLE)" for i, c in enumerate(CENTRES)) + ")"]
    for k in range(rounds):
        parts.append(f"n{k} AS (SELECT arg_min(c.i, struct_pack(d := (op_setting_1 - c.x) * (op_setting_1 - c.x) + (op_setting_2 - c.y) * (op_setting_2 - c.y) + (op_setting_3 - c.z) * (op_setting_3 - c.z), i := c.i)) AS i, any_value(p.op_setting_1) AS x, any_value(p.op_setting_2) AS y, any_value(p.op_setting_3) AS z, any_value(p.w) AS w FROM (SELECT op_setting_1, op_setting_2, op_setting_3, count(*) AS w, row_number() OVER () AS id FROM l GROUP BY 1, 2, 3) p, c{k} c GROUP BY p.id)")
        parts.append(f"c{k + 1}(i, x, y, z) AS (SELECT c.i, coalesce(sum(n.x * n.w) / sum(n.w), any_value(c.x)), coalesce(sum(n.y * n.w) / sum(n.w), any_value(c.y)), coalesce(sum(n.z * n.w) / sum(n.w), any_value(c.z)) FROM c{k} c LEFT JOIN n{k} n ON n.i = c.i GROUP BY c.i)")
    return f"WITH {', '.join(parts)} SELECT i::INT AS regime, {r6('x', 'c1')}, {r6('y', 'c2')}, {r6('z', 'c3')} FROM c{rounds}"


@query(_lloyd_sql(3))
def kmeans_lloyd(spark: SparkSession, d: str) -> DataFrame:
    points = _l(spark, d).groupBy(*L.settings).agg(F.count("*").alias("weight"))
    found = regime.lloyd(points, L.settings, CENTRES, 3)
    return rounded(spark.createDataFrame([(i, *c) for i, c in enumerate(found)], "regime int, c1 double, c2 double, c3 double"))


@query()
def kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    found = regime.fit_regimes(adapters.training(_l(spark, d)), 3, L)
    return spark.createDataFrame([(i, *c) for i, c in enumerate(found)], "regime int, c1 double, c2 double, c3 double")


# ---- scoring, against a prediction that both sides can state

_PRED = f"p AS (SELECT unit, rul::DOUBLE AS true_rul, (5 + unit % 30)::DOUBLE AS pred FROM tl QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cycle DESC) = 1)"
_SCORED = f"WITH {E_SQL}, {adapters.split_sql('e')}, {_TEST}, {_PRED}"


def _predictions(spark, d) -> DataFrame:
    last = windows.last_rows(_test_labelled(_e(spark, d), E), E)
    return last.select("unit", F.col("rul").cast("double").alias("true_rul"), (F.lit(5) + F.col("unit") % 30).cast("double").alias("pred"))


@query(f"{_SCORED} SELECT {r6('sqrt(avg((pred - true_rul) * (pred - true_rul)))', 'rmse')} FROM p")
def rmse(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.score(_predictions(spark, d)).select("rmse"))


@query(f"{_SCORED} SELECT {r6('coalesce(sum(CASE WHEN pred < true_rul THEN exp(-(pred - true_rul) / 13.0) - 1 ELSE exp((pred - true_rul) / 10.0) - 1 END), 0.0)', 'phm08')} FROM p")
def phm08_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.score(_predictions(spark, d)).select("phm08"))


@query(f"{_SCORED} SELECT count(*) FILTER (pred >= true_rul)::BIGINT AS late, count(*) FILTER (pred < true_rul)::BIGINT AS early FROM p")
def late_early(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(_predictions(spark, d)).select("late", "early")


@query(f"{_SCORED} SELECT unit, true_rul, pred, pred - true_rul AS error, CASE WHEN pred >= true_rul THEN 'late' ELSE 'early' END AS side FROM p ORDER BY abs(pred - true_rul) DESC, unit LIMIT 3")
def worst_k(spark: SparkSession, d: str) -> DataFrame:
    return scoring.worst(_predictions(spark, d))


@query(f"{_SCORED} SELECT unit, true_rul, pred, pred - true_rul AS error, CASE WHEN pred >= true_rul THEN 'late' ELSE 'early' END AS side FROM p")
def residuals(spark: SparkSession, d: str) -> DataFrame:
    return scoring.residuals(_predictions(spark, d))


@query(f"{_SCORED} SELECT 'true_rul' AS series, min(true_rul) AS low, max(true_rul) AS high, max(abs(true_rul)) AS abs_high FROM p UNION ALL SELECT 'pred', min(pred), max(pred), max(abs(pred)) FROM p UNION ALL SELECT 'error', min(pred - true_rul), max(pred - true_rul), max(abs(pred - true_rul)) FROM p")
def chart_bounds(spark: SparkSession, d: str) -> DataFrame:
    return eda.bounds(scoring.residuals(_predictions(spark, d)), ["true_rul", "pred", "error"])


# ---- trees and models

_SPLIT_ROWS = "x AS (SELECT sensor_1 AS f0, sensor_2 AS f1, sensor_1 + 2 * sensor_2 + unit % 7 AS y FROM e)"
_SPLIT = f"""{_SPLIT_ROWS}, v AS (SELECT 0 AS feature, f0 AS value, count(*) AS n, sum(y) AS s FROM x GROUP BY f0 UNION ALL SELECT 1, f1, count(*), sum(y) FROM x GROUP BY f1),
c AS (SELECT feature, value, lead(value) OVER w AS nxt, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER (PARTITION BY feature) AS n, sum(s) OVER (PARTITION BY feature) AS s FROM v WINDOW w AS (PARTITION BY feature ORDER BY value)),
g AS (SELECT feature, (value + nxt) / 2 AS threshold, ls * ls / ln + (s - ls) * (s - ls) / (n - ln) - s * s / n AS gain, ln, n FROM c WHERE nxt IS NOT NULL AND ln >= 20 AND n - ln >= 20),
b AS (SELECT * FROM g ORDER BY round(gain, 3) DESC, feature, threshold LIMIT 1)"""


def _split_rows(spark, d) -> DataFrame:
    return _e(spark, d).select("unit", "cycle", F.col("sensor_1").alias("f0"), F.col("sensor_2").alias("f1"), (F.col("sensor_1") + 2 * F.col("sensor_2") + F.col("unit") % 7).alias("y"))


@query(f"WITH {E_SQL}, {_SPLIT} SELECT feature::INT AS feature, {r6('threshold', 'threshold')}, round(gain, 3) + 0.0 AS gain, ln::BIGINT AS left_n, n::BIGINT AS n FROM b")
def best_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _split_rows(spark, d).withColumn("node", F.lit(1))
    out = tree.best_splits(rows, ["f0", "f1"], "y", "node", 20)
    return out.select("feature", (F.round("threshold", 6) + 0.0).alias("threshold"), (F.round("gain", 3) + 0.0).alias("gain"), "left_n", "n")


@query(f"WITH {E_SQL}, {_SPLIT}, r AS (SELECT e.unit, e.cycle, e.sensor_1 AS f0, e.sensor_2 AS f1, e.sensor_1 + 2 * e.sensor_2 + e.unit % 7 AS y FROM e), q AS (SELECT r.*, CASE WHEN CASE WHEN b.feature = 0 THEN f0 ELSE f1 END <= b.threshold THEN 0 ELSE 1 END AS side FROM r, b) SELECT unit, cycle, {r6('avg(y) OVER (PARTITION BY side)', 'pred')} FROM q")
def tree_depth1_predict(spark: SparkSession, d: str) -> DataFrame:
    rows = _split_rows(spark, d)
    node = tree.fit_tree(rows, ["f0", "f1"], "y", tree.TreeParams(1, 20))
    return rounded(rows.select("unit", "cycle", node.column(["f0", "f1"]).alias("pred")))


def _prepared(spark, d, regimes=None) -> workflows.Prepared:
    df = _e(spark, d) if not regimes else _l(spark, d)
    return workflows.prepare(adapters.training(df), adapters.test(df), adapters.truth(df), CAP, regimes, E if not regimes else L)


_SMALL = tree.BoostParams(3, 0.3, tree.TreeParams(2, 20))


def _boosted_sql(trees: int, depth: int, rate: float, least: int) -> str:
    """CTEs over the rows ``x`` (f0, f1, y): after tree t the rests are x{t}, its training error curve{t}."""
    parts = ["x0 AS (SELECT *, y - avg(y) OVER () AS rest FROM x)"]
    for t in range(trees):
        parts.append(f"s{t}_0 AS (SELECT *, 1 AS node FROM x{t})")
        for k in range(depth):
            s = f"s{t}_{k}"
            parts.append(f"""v{t}_{k} AS (SELECT node, 0 AS feature, f0 AS value, count(*) AS n, sum(rest) AS s FROM {s} WHERE node >= {2**k} GROUP BY ALL UNION ALL SELECT node, 1, f1, count(*), sum(rest) FROM {s} WHERE node >= {2**k} GROUP BY ALL),
c{t}_{k} AS (SELECT node, feature, value, lead(value) OVER w AS nxt, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER p AS n, sum(s) OVER p AS s FROM v{t}_{k} WINDOW w AS (PARTITION BY node, feature ORDER BY value), p AS (PARTITION BY node, feature)),
g{t}_{k} AS (SELECT node, feature, (value + nxt) / 2 AS threshold, ls * ls / ln + (s - ls) * (s - ls) / (n - ln) - s * s / n AS gain FROM c{t}_{k} WHERE nxt IS NOT NULL AND ln >= {least} AND n - ln >= {least}),
b{t}_{k} AS (SELECT * FROM g{t}_{k} WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 6) DESC, feature, threshold) = 1),
s{t}_{k + 1} AS (SELECT r.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN r.node WHEN CASE b.feature WHEN 0 THEN f0 ELSE f1 END <= b.threshold THEN 2 * r.node ELSE 2 * r.node + 1 END AS node FROM {s} r LEFT JOIN b{t}_{k} b ON b.node = r.node)""")
        parts.append(f"x{t + 1} AS (SELECT * EXCLUDE (rest, node), rest - {rate} * avg(rest) OVER (PARTITION BY node) AS rest FROM s{t}_{depth})")
    return ", ".join(parts)


_SMALL = tree.BoostParams(3, 0.3, tree.TreeParams(2, 20))
_BOOSTED = f"WITH {E_SQL}, x AS (SELECT unit, cycle, sensor_1 AS f0, sensor_2 AS f1, sensor_1 + 2 * sensor_2 + unit % 7 AS y FROM e), {_boosted_sql(3, 2, 0.3, 20)}"


@query(f"{_BOOSTED} SELECT unit, cycle, {r6('y - rest', 'pred')} FROM x3")
def boosted_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _split_rows(spark, d)
    return rounded(tree.fit_boosted(rows, ["f0", "f1"], "y", _SMALL).predict(rows).select("unit", "cycle", "pred"))


@query(_BOOSTED + " " + " UNION ALL ".join(f"SELECT {t}::INT AS tree_number, {r6('sqrt(avg(rest * rest))', 'training_rmse')} FROM x{t}" for t in (1, 2, 3)))
def boosted_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tree.fit_boosted(_split_rows(spark, d), ["f0", "f1"], "y", _SMALL).curve_table(spark))


@query()
def gbm_predict(spark: SparkSession, d: str) -> DataFrame:
    """With the defaults: 100 trees of depth 3 at rate 0.1."""
    return workflows.boosted_predictions(_prepared(spark, d), WINDOW)[0]


@query()
def training_curve(spark: SparkSession, d: str) -> DataFrame:
    train, _ = workflows.matrices(p := _prepared(spark, d), WINDOW)
    return tree.fit_boosted(train, p.features(), "rul", tree.BoostParams(10)).curve_table(spark)


@query()
def gbm_nodes(spark: SparkSession, d: str) -> DataFrame:
    return tree.fit_boosted(_split_rows(spark, d), ["f0", "f1"], "y", _SMALL).table(spark)


@query()
def linear_predict(spark: SparkSession, d: str) -> DataFrame:
    train, test = workflows.matrices(p := _prepared(spark, d), WINDOW)
    return baselines.linear_predict(train, test, p.features()).select("unit", "rul", "pred_linear")


@query(f"""WITH {E_SQL}, x AS (SELECT unit, cycle, sensor_1 AS f0, sensor_2 AS f1, sensor_1 + 2 * sensor_2 + unit % 7 AS y FROM e),
m AS (SELECT avg(f0) AS a, avg(f1) AS b, avg(y) AS c, var_pop(f0) AS s00, var_pop(f1) AS s11, covar_pop(f0, f1) AS s01, covar_pop(f0, y) AS t0, covar_pop(f1, y) AS t1 FROM x),
w AS (SELECT a, b, c, (t0 * s11 - t1 * s01) / (s00 * s11 - s01 * s01) AS w0, (t1 * s00 - t0 * s01) / (s00 * s11 - s01 * s01) AS w1 FROM m)
SELECT unit, cycle, {r6('c + w0 * (f0 - a) + w1 * (f1 - b)', 'pred_linear')} FROM x, w""")
def linear_two_features(spark: SparkSession, d: str) -> DataFrame:
    rows = _split_rows(spark, d)
    return rounded(baselines.linear_predict(rows, rows, ["f0", "f1"], "y").select("unit", "cycle", "pred_linear"))


@query()
def rf_predict(spark: SparkSession, d: str) -> DataFrame:
    train, test = workflows.matrices(p := _prepared(spark, d), WINDOW)
    return baselines.forest_predict(train, test, p.features(), trees=20, depth=5).select("unit", "rul", "pred_rf")


@query()
def lstm_predict(spark: SparkSession, d: str) -> DataFrame:
    return workflows.recurrent_predictions(_prepared(spark, d), 5, recurrent.RecurrentParams(hidden=8, epochs=1, batch=64))[0]


def _report_sql(name: str) -> str:
    lengths = f"(SELECT max(cycle) AS m, count(*) AS n FROM {'tr' if name == 'train' else 'te'} GROUP BY unit)"
    values = {"min_cycles": "min(m)", "max_cycles": "max(m)", "mean_cycles": "avg(m)", "units": "count(*)", "cycles": "sum(n)", "windows": f"sum(greatest(n - {WINDOW} + 1, 0))"}
    return " UNION ALL ".join(f"SELECT '{name}_{k}' AS metric, CAST({v} AS VARCHAR) AS value FROM {lengths}" for k, v in values.items())


@query(f"WITH {E_SQL}, {adapters.split_sql('e')} {_report_sql('train')} UNION ALL {_report_sql('test')} UNION ALL SELECT 'near_constant_sensors', CASE WHEN stddev_samp(sensor_1) < 1e-6 OR stddev_samp(sensor_2) < 1e-6 THEN 'some' ELSE 'none' END FROM tr UNION ALL SELECT 'test_units_without_window', CAST(count(*) AS VARCHAR) FROM (SELECT unit FROM te GROUP BY unit HAVING count(*) < {WINDOW})")
def report(spark: SparkSession, d: str) -> DataFrame:
    return workflows.report(_prepared(spark, d), window=WINDOW)


@query()
def normalized_features(spark: SparkSession, d: str) -> DataFrame:
    p = _prepared(spark, d, regimes=3)
    return windows.windowed_features(p.test, WINDOW, L, p.kept(), last_only=True).select("unit", "cycle", *p.features(), "rul")


# ---- text

_WORDS = r"regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')"


@query(f"SELECT doc_id, CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 0 ELSE len({_WORDS}) END::INT AS n_fields FROM documents")
def parse_whitespace(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.size(fields(F.coalesce("text", F.lit("")))).alias("n_fields"))


def _readings(spark, d) -> DataFrame:
    """Line items as lines of readings; one in seven has a word among them and one in eleven lacks a field."""
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    numbers = F.concat_ws("  ", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"), *([F.col("l_quantity").cast("string")] * 23))
    last = F.when(F.col("l_orderkey") % 7 == 0, "NOTANUMBER").when(F.col("l_orderkey") % 11 == 0, "").otherwise(F.col("l_tax").cast("string"))
    return items.select("l_orderkey", F.concat(numbers, F.lit("   "), last, F.lit("  ")).alias("line"))


@query("SELECT l_orderkey % 77 AS bucket, count(*)::BIGINT AS bad FROM lineitem WHERE l_orderkey % 7 = 0 OR l_orderkey % 11 = 0 GROUP BY 1")
def parse_bad_rows(spark: SparkSession, d: str) -> DataFrame:
    return text.parsed(_readings(spark, d)).where("reason is not null").groupBy((F.col("l_orderkey") % 77).alias("bucket")).agg(F.count("*").alias("bad"))


@query(f"SELECT l_suppkey AS unit, count(*)::BIGINT AS n, {r6('sum(l_quantity)', 'sensor_1')}, {r6('sum(l_tax)', 'sensor_21')} FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0 GROUP BY 1")
def parse_cycles(spark: SparkSession, d: str) -> DataFrame:
    good = text.parsed(_readings(spark, d)).where("reason is null")
    return rounded(good.groupBy("unit").agg(F.count("*").alias("n"), F.sum("sensor_1").alias("sensor_1"), F.sum("sensor_21").alias("sensor_21")))


def _text_file(spark, df: DataFrame, order: str, path: str) -> None:
    """Lines of one text file in the order of a column."""
    df.orderBy(order).select("line").coalesce(1).write.text(path)


@query(f"WITH {E_SQL} SELECT unit, cycle, (row_number() OVER (ORDER BY unit, cycle))::BIGINT AS line_no, {r6('sensor_1', 'sensor_1')}, {r6('sensor_2', 'sensor_21')} FROM e")
def text_file_cycles(spark: SparkSession, d: str) -> DataFrame:
    from ..scratch import scratch

    numbers = F.concat_ws(" ", F.col("unit").cast("string"), F.col("cycle").cast("string"), *([F.lit("0.5")] * 3), *([F.col("sensor_1").cast("string")] * 20), F.col("sensor_2").cast("string"))
    ordered = _e(spark, d).select(F.struct("unit", "cycle").alias("k"), F.concat(numbers, F.lit("  ")).alias("line"))
    _text_file(spark, ordered, "k", path := f"{scratch(spark, 'files')}/train_FD001.txt")
    return rounded(text.read_cycles(spark, path.rpartition("/")[0], "FD001", "train").select("unit", "cycle", "line_no", "sensor_1", "sensor_21"))


@query(f"WITH {E_SQL}, {adapters.split_sql('e')} SELECT 'FD002' AS subset, ord::INT AS ord, final_rul::BIGINT AS final_rul FROM truth")
def text_file_truth(spark: SparkSession, d: str) -> DataFrame:
    from ..scratch import scratch

    lines = adapters.truth(_e(spark, d)).select("ord", F.concat(F.when(F.col("ord") % 3 == 0, "\n").otherwise(""), F.col("final_rul").cast("string"), F.lit(" ")).alias("line"))
    _text_file(spark, lines, "ord", path := f"{scratch(spark, 'files')}/RUL_FD002.txt")
    return text.read_truth(spark, path.rpartition("/")[0], "2")


@query("SELECT l_orderkey AS key, CASE WHEN l_quantity::BIGINT % 2 = 0 THEN l_quantity END AS even FROM lineitem")
def strict_numbers(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long").cast("string")
    spelled = F.when(F.col("l_quantity").cast("long") % 2 == 0, q).otherwise(F.concat(q, F.lit("d")))
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("key"), to_double(spelled).alias("even"))


@query("SELECT * FROM (VALUES ('FD001', 1, 1, 100::BIGINT, 100::BIGINT), ('FD002', 6, 1, 260, 259), ('FD003', 1, 2, 100, 100), ('FD004', 6, 2, 249, 248)) v(subset, conditions, fault_modes, train_units, test_units)")
def subset_metadata(spark: SparkSession, d: str) -> DataFrame:
    return subsets(spark)


# ---- sinks: what a written file holds when it is read again


@query(f"WITH {_TRAIN_LABELLED} SELECT count(*)::BIGINT AS n, sum(rul)::BIGINT AS rul, {r6('sum(sensor_1)', 'sensor_1')} FROM x")
def labeled_csv(spark: SparkSession, d: str) -> DataFrame:
    from ..scratch import scratch

    sinks.write_csv(sinks.labelled(_train_labelled(spark, d), L), path := scratch(spark, "labeled.csv"))
    back = spark.read.csv(path, header=True, schema="unit long, cycle long, " + ", ".join(f"{c} double" for c in L.settings + L.sensors) + ", rul long")
    return rounded(back.agg(F.count("*").alias("n"), F.sum("rul").alias("rul"), F.sum("sensor_1").alias("sensor_1")))


@query(f"{_SCORED} SELECT unit, true_rul, pred AS pred_naive, pred - true_rul AS error_naive FROM p")
def prediction_csv(spark: SparkSession, d: str) -> DataFrame:
    from ..scratch import scratch

    sinks.write_csv(sinks.predictions(_predictions(spark, d), {"naive": "pred"}), path := scratch(spark, "predictions.csv"), ("unit",), one_file=True)
    return spark.read.csv(path, header=True, schema="unit long, true_rul double, pred_naive double, error_naive double")


@query("SELECT n_nationkey % 4 AS part, count(*)::BIGINT AS n FROM nation GROUP BY 1")
def subset_union(spark: SparkSession, d: str) -> DataFrame:
    nation = spark.read.parquet(f"{d}/nation.parquet")
    parts = [nation.where(F.col("n_nationkey") % 4 == k).withColumn("part", F.lit(k)) for k in range(4)]
    return reduce(DataFrame.unionByName, parts).groupBy("part").agg(F.count("*").alias("n"))
