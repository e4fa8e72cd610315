"""A multi-output random forest over all underlyings, grown for every split and tree at once.

Features are binned once, at quantiles of the first split's training sessions. A tree level is one
Spark aggregation: every partition sums the targets of its rows per (split, tree, node, feature,
bin) as vectors over all surface cells, the sums are added up by node, and the cut with the largest
drop of summed variance splits the node. Only nodes of more than ``rows_in_task`` rows grow that
way. As soon as a node is smaller, its rows are gathered in one task, which grows the rest of the
tree from the same sums; test rows travel with their node, so predictions come out where the leaf
is, and neither leaves nor subtrees leave the task. Small splits start there, some trees a task.

Bootstrap weights are Poisson(1), drawn from a hash of row, split and tree; the candidate features
of a node are drawn from its place. Neither depends on partitioning. The driver holds the cuts of
large nodes only, at most trees x rows / ``rows_in_task`` of each split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.sqlmath import exp_back
from optionlake.operators.features import FeatureSettings
from optionlake.operators.forecast import checked_predictions, config_hash, training_rows
from optionlake.operators.splits import split_id
from optionlake.sources.stages import StageTables


@dataclass(frozen=True)
class ForestSettings:
    n_trees: int = 30
    max_depth: int = 10
    min_leaf: int = 5
    bins: int = 32
    feature_share: float = 1.0 / 3.0
    seed: int = 7
    rows_in_task: int = 20_000
    trees_in_task: int = 8
    nodes_in_job: int = 64

    @property
    def params(self) -> dict:
        """What decides predictions."""
        return {"n_estimators": self.n_trees, "max_depth": self.max_depth, "bins": self.bins,
                "min_samples_leaf": self.min_leaf, "max_features": self.feature_share,
                "random_state": self.seed}


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])


def draw_weights(ids: np.ndarray, split: int, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample."""
    place = np.array([(seed << 42) ^ (split << 20) ^ (tree + 1)], np.uint64)
    drawn = _mixed(ids.view(np.uint64) ^ _mixed(place))
    return np.searchsorted(_POISSON, (drawn >> np.uint64(11)) / float(1 << 53), side="right").astype(float)


def candidates(split: int, tree: int, node: int, n_features: int, s: ForestSettings) -> np.ndarray:
    count = max(1, round(s.feature_share * n_features))
    return np.sort(np.random.default_rng([s.seed, split, tree, node]).choice(
        n_features, count, replace=False))


def histogram(bins: np.ndarray, values: np.ndarray, n_bins: int) -> np.ndarray:
    """(feature, bin, value) sums of the rows of ``values`` by each column of ``bins``."""
    n, width = bins.shape
    out = np.zeros((width * n_bins, values.shape[1]))
    for low in range(0, n, 2048):
        part = bins[low:low + 2048].astype(np.int64) + np.arange(width) * n_bins
        marks = np.zeros((len(part), width * n_bins))
        marks[np.arange(len(part))[:, None], part] = 1.0
        out += marks.T @ values[low:low + 2048]
    return out.reshape(width, n_bins, -1)


def best_cut(sums: np.ndarray, min_leaf: int) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """(candidate, bin, sums of the left, sums of the right) of the largest drop of summed variance.

    The last column of ``sums`` is the weight. Rows up to the bin go left. None without a cut.
    """
    left = np.cumsum(sums, axis=1)
    total = left[0, -1]
    right = total - left
    n_left, n_right = left[..., -1], right[..., -1]
    usable = (n_left >= min_leaf) & (n_right >= min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = ((left[..., :-1] ** 2).sum(axis=-1) / n_left
                 + (right[..., :-1] ** 2).sum(axis=-1) / n_right)
    score = np.where(usable, score, -np.inf)
    # cuts that part the rows alike differ by rounding only; the first of them counts
    best = score.max()
    at = int(np.argmax(score >= best - 1e-10 * abs(best)))
    base = float((total[:-1] ** 2).sum() / total[-1]) if total[-1] else 0.0
    feature, cut = divmod(at, score.shape[1])
    if not score.flat[at] > base + 1e-12 * abs(base):
        return None
    return feature, cut, left[feature, cut], right[feature, cut]


#: Cuts (feature, bin) and leaf means of the large nodes of a tree, by node; children of k: 2k, 2k + 1.
Tree = dict[int, "tuple[int, int] | np.ndarray"]


def descend(tree: Mapping[int, object], bins: np.ndarray) -> np.ndarray:
    """The node at which each row leaves the known part of a tree."""
    nodes = np.ones(len(bins), np.int64)
    for node in sorted(tree):
        if isinstance(tree[node], tuple):
            feature, cut = tree[node]
            here = np.flatnonzero(nodes == node)
            nodes[here] = 2 * node + (bins[here, feature] > cut)
    return nodes


ROW = "id long, fit_lo int, fit_hi int, test_lo int, test_hi int, bins binary, y binary"


class _Batch:
    def __init__(self, batch: pa.RecordBatch) -> None:
        self.ids = batch.column("id").to_numpy()
        self.fit, self.test = (
            [batch.column(f"{role}_{end}").fill_null(fill).to_numpy(zero_copy_only=False)
             for end, fill in (("lo", 1), ("hi", 0))] for role in ("fit", "test"))
        self.bins = np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column("bins")])
        self.y = np.stack([np.frombuffer(v.as_buffer()) for v in batch.column("y")])

    def rows(self, role: str, split: int) -> np.ndarray:
        low, high = getattr(self, role)
        return np.flatnonzero((low <= split) & (split <= high))


def _bin_rows(edges: np.ndarray):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist())
            bins = np.zeros(x.shape, np.uint8)
            for k in range(x.shape[1] if len(x) else 0):
                bins[:, k] = np.searchsorted(edges[k], x[:, k], side="left")
            y = np.array(batch.column("log_y").to_pylist())
            out = {c: batch.column(c) for c in batch.schema.names if c not in ("x", "log_y")}
            yield pa.record_batch(out | {"bins": pa.array([r.tobytes() for r in bins], pa.binary()),
                                         "y": pa.array([r.tobytes() for r in y], pa.binary())})
    return build


def _level_sums(wanted: list[tuple[int, int, int]], trees: dict, s: ForestSettings):
    """Sums of a partition for each wanted (split, tree, node)."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in map(_Batch, (b for b in batches if b.num_rows)):
            for split, tree in dict.fromkeys(w[:2] for w in wanted):
                rows = batch.rows("fit", split)
                weights = draw_weights(batch.ids[rows], split, tree, s.seed)
                rows, weights = rows[weights > 0], weights[weights > 0]
                nodes = descend(trees.get((split, tree), {}), batch.bins[rows])
                for node in (w[2] for w in wanted if w[:2] == (split, tree)):
                    here, w = rows[nodes == node], weights[nodes == node][:, None]
                    features = candidates(split, tree, node, batch.bins.shape[1], s)
                    made = histogram(batch.bins[here][:, features],
                                     np.hstack([batch.y[here] * w, w]), s.bins)
                    sums[split, tree, node] = sums.get((split, tree, node), 0.0) + made
        for (split, tree, node), made in sums.items():
            yield pa.record_batch({
                "split_no": pa.array([split], pa.int32()), "tree": pa.array([tree], pa.int32()),
                "node": pa.array([node], pa.int64()), "width": pa.array([made.shape[0]], pa.int32()),
                "sums": pa.array([made.tobytes()], pa.binary())})
    return build


def _choose(s: ForestSettings):
    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(pdf["width"].iloc[0])
        added = sum(np.frombuffer(v) for v in pdf["sums"]).reshape(width, s.bins, -1)
        cut = best_cut(added, s.min_leaf)
        total = added[0].sum(axis=0)
        feature, bin_, left, right = cut or (-1, -1, total, total)
        return pd.DataFrame({"split_no": [key[0]], "tree": key[1], "node": key[2], "candidate": feature,
                             "bin": bin_, "left": [left], "right": [right]})
    return choose


def large_nodes(rows: DataFrame, counts: Mapping[int, int], n_features: int,
                s: ForestSettings) -> dict[tuple[int, int], Tree]:
    """Cuts of every node above ``rows_in_task``, level by level, all splits and trees together."""
    trees: dict[tuple[int, int], Tree] = {}
    frontier = [(split, tree, 1) for split, n in sorted(counts.items()) if n > s.rows_in_task
                for tree in range(s.n_trees)]
    for depth in range(s.max_depth):
        following = []
        for low in range(0, len(frontier), s.nodes_in_job):
            wanted = frontier[low:low + s.nodes_in_job]
            found = rows.mapInArrow(
                _level_sums(wanted, {w[:2]: trees.get(w[:2], {}) for w in wanted}, s),
                "split_no int, tree int, node long, width int, sums binary",
            ).groupBy("split_no", "tree", "node").applyInPandas(
                _choose(s), "split_no int, tree int, node long, candidate int, bin int, "
                            "left array<double>, right array<double>").collect()
            for r in found:
                tree = trees.setdefault((r.split_no, r.tree), {})
                left, right = np.array(r.left), np.array(r.right)
                if r.candidate < 0:
                    tree[r.node] = left[:-1] / left[-1]
                    continue
                own = candidates(r.split_no, r.tree, r.node, n_features, s)
                tree[r.node] = int(own[r.candidate]), r.bin
                for child, sums in ((2 * r.node, left), (2 * r.node + 1, right)):
                    if depth + 1 == s.max_depth:
                        tree[child] = sums[:-1] / sums[-1]
                    elif sums[-1] > s.rows_in_task:
                        following.append((r.split_no, r.tree, child))
        frontier = sorted(following)
    return trees


GROUPED = "split_no int, chunk int, node long, id long, is_test boolean, fixed boolean, bins binary, y binary"


def _gathered(splits: list[int], trees: dict, s: ForestSettings):
    """Sends each row to the small nodes it belongs to; ``chunk`` is a tree, or -1 - (first tree)."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_Batch, (b for b in batches if b.num_rows)):
            for split in splits:
                large = [t for (own, t) in trees if own == split]
                places = [(t, trees[split, t]) for t in large] or [
                    (-1 - t, {}) for t in range(0, s.n_trees, s.trees_in_task)]
                for chunk, tree in places:
                    fit, test = batch.rows("fit", split), batch.rows("test", split)
                    if chunk >= 0:
                        fit = fit[draw_weights(batch.ids[fit], split, chunk, s.seed) > 0]
                    rows = np.concatenate([fit, test])
                    nodes = descend(tree, batch.bins[rows])
                    leaves = {k: v for k, v in tree.items() if not isinstance(v, tuple)}
                    is_test = np.arange(len(rows)) >= len(fit)
                    # a large leaf needs its mean only, which stands in for its rows
                    keep = is_test | ~np.isin(nodes, list(leaves))
                    rows, nodes, is_test = rows[keep], nodes[keep], is_test[keep]
                    means = [k for k in leaves if (nodes[is_test] == k).any()]
                    n = len(rows) + len(means)
                    width, cells = batch.bins.shape[1], batch.y.shape[1]
                    yield pa.record_batch({
                        "split_no": np.full(n, split, np.int32), "chunk": np.full(n, chunk, np.int32),
                        "node": np.concatenate([nodes, np.array(means, np.int64)]),
                        "id": np.concatenate([batch.ids[rows], np.zeros(len(means), np.int64)]),
                        "is_test": np.concatenate([is_test, np.zeros(len(means), bool)]),
                        "fixed": np.arange(n) >= len(rows),
                        "bins": pa.array([r.tobytes() for r in batch.bins[rows]]
                                         + [bytes(width)] * len(means), pa.binary()),
                        "y": pa.array([np.zeros(cells).tobytes() if t else r.tobytes()
                                       for r, t in zip(batch.y[rows], is_test, strict=True)]
                                      + [leaves[k].tobytes() for k in means], pa.binary())})
    return build


def grow(bins: np.ndarray, y: np.ndarray, weights: np.ndarray, use: np.ndarray, split: int, tree: int,
         root: int, s: ForestSettings) -> np.ndarray:
    """Leaf means of the rows ``use`` in the subtree below ``root`` of weighted rows."""
    out = np.zeros((len(use), y.shape[1]))
    values = np.hstack([y * weights[:, None], weights[:, None]])
    waiting = [(root, np.flatnonzero(weights > 0), np.arange(len(use)))]
    while waiting:
        node, rows, used = waiting.pop()
        if not len(used):
            continue
        total, cut = values[rows].sum(axis=0), None
        if node.bit_length() - 1 < s.max_depth and total[-1] >= 2 * s.min_leaf:
            features = candidates(split, tree, node, bins.shape[1], s)
            cut = best_cut(histogram(bins[rows][:, features], values[rows], s.bins), s.min_leaf)
        if cut is None:
            # an empty sample (all weights zero) predicts the plain mean
            out[used] = total[:-1] / total[-1] if total[-1] else y.mean(axis=0)
            continue
        feature, at = features[cut[0]], cut[1]
        goes, moves = bins[rows, feature] > at, use[used, feature] > at
        waiting += [(2 * node, rows[~goes], used[~moves]), (2 * node + 1, rows[goes], used[moves])]
    return out


def _finish(s: ForestSettings):
    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        split, chunk, node = (int(k) for k in key)
        pdf = pdf.sort_values(["is_test", "id"])
        test = pdf["is_test"].to_numpy(bool)
        if not test.any() or test.all():
            return pd.DataFrame(columns=["id", "split_no", "chunk", "total", "trees"], dtype=object)
        bins = np.stack([np.frombuffer(v, np.uint8) for v in pdf["bins"]])
        y = np.stack([np.frombuffer(v) for v in pdf["y"]])
        fit, ids = ~test, pdf["id"].to_numpy(np.int64)
        chosen = [chunk] if chunk >= 0 else range(-1 - chunk, min(-1 - chunk + s.trees_in_task, s.n_trees))
        total = np.zeros((int(test.sum()), y.shape[1]))
        for tree in chosen:
            weights = np.where(pdf["fixed"].to_numpy(bool)[fit], 1.0,
                               draw_weights(ids[fit], split, tree, s.seed))
            total += grow(bins[fit], y[fit], weights, bins[test], split, tree, node, s)
        return pd.DataFrame({"id": ids[test], "split_no": split, "chunk": chunk,
                             "total": list(total), "trees": len(chosen)})
    return finish


def forest_forecasts(stages: StageTables, features: DataFrame, members: DataFrame, run_id: str,
                     s: ForestSettings = ForestSettings(),
                     settings: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Forecast surfaces of all test sessions of the splits in ``members``.

    Fits read the training and validation sessions of every underlying. The binned sessions are a
    stage table, which all levels read.
    """
    rows = training_rows(features, settings)
    role = F.col("role") == "test"
    spans = members.groupBy(*N.DAY).agg(
        F.min(F.when(~role, F.col("split_no"))).alias("fit_lo"),
        F.max(F.when(~role, F.col("split_no"))).alias("fit_hi"),
        F.min(F.when(role, F.col("split_no"))).alias("test_lo"),
        F.max(F.when(role, F.col("split_no"))).alias("test_hi"))
    placed = rows.join(spans, list(N.DAY), "inner").withColumn("id", F.xxhash64(*N.DAY))
    counts = {r.split_no: r.n for r in members.filter(~role).groupBy("split_no").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    first = min(counts, default=0)
    share = F.array(*[F.lit((k + 1) / s.bins) for k in range(s.bins - 1)])
    quantiles = placed.filter(F.lit(first).between(F.col("fit_lo"), F.col("fit_hi"))).select(
        F.posexplode("x").alias("at", "value")).groupBy("at").agg(
            F.percentile_approx("value", share, F.lit(10_000)).alias("edges")).orderBy("at").collect()
    edges = np.array([r.edges for r in quantiles])
    keep = ("id", N.SYMBOL, N.DATE, "fit_lo", "fit_hi", "test_lo", "test_hi")
    binned = stages.get(f"forest_rows_{s.bins}_{first}", lambda: placed.select(*keep, "x", "log_y").mapInArrow(
        _bin_rows(edges), f"id long, {N.SYMBOL} string, {N.DATE} date, fit_lo int, fit_hi int, "
                          "test_lo int, test_hi int, bins binary, y binary"))
    data = binned.select(*[c.split()[0] for c in ROW.split(", ")])
    trees = large_nodes(data, counts, len(edges), s)
    partial = data.mapInArrow(_gathered(sorted(counts), trees, s), GROUPED).groupBy(
        "split_no", "chunk", "node").applyInPandas(
            _finish(s), "id long, split_no int, chunk int, total array<double>, trees int")
    summed = partial.groupBy("id", "split_no").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "total"))).alias("parts"), F.sum("trees").alias("trees"))
    mean = F.expr(f"transform(aggregate(slice(parts, 2, size(parts)), parts[0].total, (acc, p) -> "
                  f"zip_with(acc, p.total, (a, b) -> a + b)), v -> v / {s.n_trees})")
    whole = F.when(F.col("trees") == s.n_trees, mean).otherwise(
        F.raise_error("a forecast lacks trees").cast("array<double>"))
    made = summed.select("id", "split_no", whole.alias("log_prediction")).join(
        binned.select("id", *N.DAY), "id", "inner").join(
            rows.select(*N.DAY, N.TARGET_DATE, N.DECISION_TS, N.TARGET_TS, *N.SURFACE_IDS), list(N.DAY), "inner")
    return made.select(
        N.SYMBOL, F.lit("random_forest").alias("model_name"), N.DATE, N.TARGET_DATE,
        split_id(F.col("split_no")).alias("split_id"), N.DECISION_TS, N.TARGET_TS, *N.SURFACE_IDS,
        config_hash("random_forest", s.params).alias("model_config_hash"),
        F.lit(run_id).alias("training_run_id"),
        checked_predictions(exp_back(F.col("log_prediction"))).alias("predictions"))
