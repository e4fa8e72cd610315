"""The distributed forest against trees grown row by row, whatever the size of a task."""

import dataclasses
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.operators import calendar as cal
from optionlake.operators import evaluate, features, forecast, forest, splits
from optionlake.sources.stages import StageTables
from tests.test_forecasting import GRID, history

SETTINGS = forest.ForestSettings(n_trees=5, max_depth=4, min_leaf=3, bins=8, feature_share=0.4,
                                 trees_in_task=2)


def slow_tree(bins, y, weights, use, split, tree, s):
    """Every candidate cut of every node by the definition of summed variance."""
    def spread(rows):
        w = weights[rows]
        return float((w[:, None] * (y[rows] - np.average(y[rows], axis=0, weights=w)) ** 2).sum())

    def below(node, rows, depth):
        best = None
        if depth < s.max_depth:
            for f in forest.candidates(split, tree, node, bins.shape[1], s):
                for cut in range(s.bins):
                    left, right = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                    if min(weights[left].sum(), weights[right].sum()) >= s.min_leaf:
                        drop = spread(rows) - spread(left) - spread(right)
                        if drop > 1e-9 and (best is None or drop > best[0] + 1e-9):
                            best = drop, f, cut, left, right
        if best is None:
            mean = np.average(y[rows], axis=0, weights=weights[rows])
            return lambda x: mean
        _, f, cut, left, right = best
        low, high = below(2 * node, left, depth + 1), below(2 * node + 1, right, depth + 1)
        return lambda x: low(x) if x[f] <= cut else high(x)

    predict = below(1, np.flatnonzero(weights > 0), 0)
    return np.array([predict(x) for x in use])


def test_grown_trees_equal_slow_trees():
    rng = np.random.default_rng(1)
    bins, y = rng.integers(0, 8, (70, 9)).astype(np.uint8), rng.normal(size=(70, 4))
    y[:, 0] += bins[:, 2]
    use = rng.integers(0, 8, (25, 9)).astype(np.uint8)
    for tree in range(4):
        weights = forest.draw_weights(np.arange(70), 2, tree, 7)
        got = forest.grow(bins, y, weights, use, 2, tree, 1, SETTINGS)
        np.testing.assert_allclose(got, slow_tree(bins, y, weights, use, 2, tree, SETTINGS), atol=1e-9)


def test_weights_are_poisson_and_independent_of_order():
    ids = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 200_000)
    drawn = forest.draw_weights(ids, 3, 1, 7)
    assert abs(drawn.mean() - 1.0) < 0.01 and abs(drawn.var() - 1.0) < 0.02
    assert (forest.draw_weights(ids[::-1].copy(), 3, 1, 7) == drawn[::-1]).all()
    assert abs(np.corrcoef(drawn, forest.draw_weights(ids, 3, 2, 7))[0, 1]) < 0.01


def test_histogram_sums_every_row():
    rng = np.random.default_rng(2)
    bins, values = rng.integers(0, 6, (5000, 3)), rng.integers(0, 9, (5000, 2)).astype(float)
    want = np.zeros((3, 6, 2))
    for row, value in zip(bins, values, strict=True):
        for f in range(3):
            want[f, row[f]] += value
    assert (forest.histogram(bins, values, 6) == want).all()


@pytest.fixture(scope="module")
def case(spark):
    a, b = dt.date(2019, 12, 1), dt.date(2023, 12, 31)
    lookup = cal.session_lookup(cal.session_table(cal.weekday_sessions(spark, a, b)), a, b)
    rng = np.random.default_rng(3)
    noise = rng.uniform(0.9, 1.1, size=(2, 90, 4))
    gold = history(spark, 90, ("A", "B"),
                   lambda s, t, c: 0.03 * (1 + c // 2) * noise["AB".index(s), t, c]).cache()
    feats = features.build_features(gold, GRID, lookup).cache()
    wf = splits.WalkforwardSettings(30, 10, 5, 5)
    return gold, feats, splits.clean_splits(splits.walkforward_splits(feats, wf), 2).cache()


def predicted(spark, case, **changes):
    _, feats, members = case
    made = forest.forest_forecasts(StageTables(spark), feats, members, "r",
                                   dataclasses.replace(SETTINGS, **changes))
    return made, {(r[N.SYMBOL], r[N.DATE], r.split_id): np.array(r.predictions) for r in made.collect()}


def test_large_and_small_tasks_give_the_same_forest(spark, case):
    """A task limit of 20 rows grows most levels by aggregation, one of 20,000 none."""
    made, whole = predicted(spark, case)
    _, feats, members = case
    tests = {(r[N.SYMBOL], r[N.DATE], r.split_id) for r in members.filter("role = 'test'").select(
        *N.DAY, "split_id").collect()}
    assert set(whole) == tests
    for rows, nodes in ((20, 64), (45, 3)):
        _, parts = predicted(spark, case, rows_in_task=rows, nodes_in_job=nodes)
        assert parts.keys() == whole.keys()
        for key in whole:
            np.testing.assert_allclose(parts[key], whole[key], rtol=1e-9)
    daily = evaluate.daily_loss(evaluate.realization_panel(made, case[0], GRID))
    assert daily.count() == len(tests)


def test_forest_equals_slow_trees_on_one_split(spark, case):
    _, feats, members = case
    split = members.agg(F.min("split_no")).first()[0]
    rows = forecast.training_rows(feats, features.FeatureSettings()).join(
        members.filter(F.col("split_no") == split), list(N.DAY)).withColumn(
            "id", F.xxhash64(*N.DAY)).orderBy("id").collect()
    fit, test = [r for r in rows if r.role != "test"], [r for r in rows if r.role == "test"]
    x = np.array([r.x for r in fit])
    share = [(k + 1) / SETTINGS.bins for k in range(SETTINGS.bins - 1)]
    # the smallest value that at least this share of the values does not exceed
    edges = np.sort(x, axis=0)[[int(np.ceil(p * len(x))) - 1 for p in share]]
    bins = (x[:, None, :] > edges).sum(axis=1).astype(np.uint8)
    use = (np.array([r.x for r in test])[:, None, :] > edges).sum(axis=1).astype(np.uint8)
    y, ids = np.array([r.log_y for r in fit]), np.array([r.id for r in fit])
    total = sum(slow_tree(bins, y, forest.draw_weights(ids, split, t, SETTINGS.seed), use, split, t, SETTINGS)
                for t in range(SETTINGS.n_trees))
    _, got = predicted(spark, case)
    for r, log_mean in zip(test, total / SETTINGS.n_trees, strict=True):
        np.testing.assert_allclose(got[r[N.SYMBOL], r[N.DATE], "split_%04d" % split], np.exp(log_mean), rtol=1e-8)


def test_constant_targets_and_no_splits(spark, case):
    _, feats, members = case
    flat = feats.withColumn("target_total_variance", F.transform("target_total_variance", lambda _: F.lit(0.04)))
    for rows in (10, 20_000):
        made = forest.forest_forecasts(StageTables(spark), flat, members, "r", dataclasses.replace(
            SETTINGS, rows_in_task=rows)).select(F.explode("predictions").alias("p"))
        low, high = made.agg(F.min("p"), F.max("p")).first()
        assert low == pytest.approx(0.04) and high == pytest.approx(0.04)
    assert forest.forest_forecasts(StageTables(spark), feats, members.limit(0), "r", SETTINGS).count() == 0
