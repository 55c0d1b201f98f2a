"""Multi-class gradient boosting on 0/1 features: trees of all classes of a round grow together, level by level.

Rows are first reduced to distinct feature patterns with a count for each class; every statistic of a tree is a sum over
patterns, so nothing is lost. One level of all trees of a round needs one set of sums of weight, gradient and hessian by
(class, node, feature). A pattern table counted to be small is summed in memory; a larger one is summed by one Spark
aggregation a level, from which only the sums (classes x nodes x features) come to the driver. Jobs do not grow with the
number of classes.
"""
from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from evidloom import fixed_values as fv
from evidloom.functions.vectors import let
from evidloom.session import stored
from evidloom.shipping import ship_by_value

#: distinct patterns that are summed in memory; more are summed by Spark
MEMORY_PATTERNS = 50_000
#: rounds after which the Spark path writes the scores of all patterns, so that a task applies few trees
SCORE_ROUNDS = 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Boosting:
    """Sizes and penalties. ``newton`` splits by second-order gain G^2 / (H + l2), kept when it reaches ``min_gain`` and
    both sides have ``min_weight`` of hessian; its leaf is -G / (H + l2). Otherwise splits lower the squared error of the
    residuals, and the leaf is the multinomial step (K - 1) / K * sum(r) / sum(p (1 - p)), from log priors."""

    rounds: int = 150
    step: float = 0.05
    depth: int = 5
    newton: bool = True
    l2: float = 10.0
    min_gain: float = 2.0
    min_weight: float = 1.0
    min_leaf: int = 1
    subsample: float = 1.0
    features: str = "all"
    seed: int = fv.SPLIT_SEED


#: plain boosting (multinomial deviance) and regularised boosting (second order)
PLAIN = Boosting(rounds=200, depth=4, newton=False, l2=0.0, min_gain=0.0, min_weight=0.0, min_leaf=10, subsample=0.8, features="sqrt")
REGULARISED = Boosting()


def _uniform(*parts: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from a hash of integers."""
    x = np.uint64(0x243F6A8885A308D3)
    with np.errstate(over="ignore"):
        for p in parts:
            x = (x ^ np.asarray(p).astype(np.uint64)) * _MUL
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x = x ^ (x >> np.uint64(32))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def walk(x: np.ndarray, feature: np.ndarray, depth: int) -> np.ndarray:
    """Node of each row in each class's tree: 1 is the root, 2i the side without the feature, 2i + 1 the side with it."""
    n, classes = len(x), len(feature)
    node = np.ones((n, classes), np.int64)
    rows = np.arange(n)[:, None]
    for _ in range(depth):
        f = feature[np.arange(classes), node]
        node = np.where(f >= 0, 2 * node + x[rows, np.maximum(f, 0)], node)
    return node


class Patterns:
    """Patterns of one place (the driver, or a task): 0/1 rows, counts by class, scores, and the sums over them."""

    def __init__(self, x: np.ndarray, counts: np.ndarray, scores: np.ndarray, cfg: Boosting):
        self.x, self.counts, self.scores, self.cfg = x.astype(np.int64), counts.astype(np.float64), scores, cfg
        with np.errstate(over="ignore"):
            self.key = (self.x.astype(np.uint64) * (np.arange(1, x.shape[1] + 1, dtype=np.uint64) * _MUL | np.uint64(1))).sum(1, dtype=np.uint64)

    def apply(self, feature: np.ndarray, value: np.ndarray) -> None:
        """Add the leaf values of one round's trees."""
        node = walk(self.x, feature, self.cfg.depth)
        self.scores = self.scores + value[np.arange(value.shape[0]), node]

    def begin(self, number: int) -> None:
        """Weight, gradient and hessian of every pattern and class in round ``number``; a row sample keeps of every
        count its share, rounded up or down by a hash of pattern, class and round."""
        cfg, p = self.cfg, softmax(self.scores)
        counts = self.counts
        if cfg.subsample < 1:
            draw = _uniform(self.key[:, None], np.arange(counts.shape[1])[None, :], np.full((1, 1), number * 1000003 + cfg.seed))
            counts = np.floor(counts * cfg.subsample + draw)
        n = counts.sum(1, keepdims=True)
        h = p * (1 - p) * (2.0 if cfg.newton else 1.0)
        self.stats = np.stack([np.broadcast_to(n, p.shape), n * p - counts, n * h])

    def sums(self, feature: np.ndarray, level: int) -> np.ndarray:
        """(class, node of the level, 3, features + 1): sums over rows with each feature, and over all rows, last."""
        node = walk(self.x, feature, level) - (1 << level)
        classes, width = feature.shape[0], 1 << level
        out = np.zeros((classes, width, 3, self.x.shape[1] + 1))
        wide = np.column_stack([self.x, np.ones(len(self.x), np.int64)]).astype(np.float64)
        for k in range(classes):
            for m in np.unique(node[:, k]):
                if m >= 0:  # rows in a leaf above have smaller numbers
                    here = node[:, k] == m
                    out[k, m] = self.stats[:, here, k] @ wide[here]
        return out


class SparkPatterns:
    """The same sums over a pattern table of any size: one aggregation a level."""

    def __init__(self, table: DataFrame, start: np.ndarray, cfg: Boosting):
        self.cfg, self.trees, self.start = cfg, [], start
        self.table = stored(table.withColumn("scores", F.array(*[F.lit(float(v)) for v in start])), "patterns")

    def apply(self, feature: np.ndarray, value: np.ndarray) -> None:
        self.trees.append((feature, value))
        if len(self.trees) == SCORE_ROUNDS:
            cfg, trees = self.cfg, list(self.trees)

            def run(batches):
                for b in batches:
                    part = _part(b, cfg)
                    for t in trees:
                        part.apply(*t)
                    yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(part.scores.tolist(), b.schema.field(2).type)], ["x", "counts", "scores"])

            self.table = stored(self.table.mapInArrow(run, self.table.schema), "patterns")
            self.trees = []

    def begin(self, number: int) -> None:
        self.number = number

    def sums(self, feature: np.ndarray, level: int) -> np.ndarray:
        cfg, trees, number = self.cfg, list(self.trees), self.number

        def run(batches):
            total = None
            for b in batches:
                if not b.num_rows:
                    continue
                part = _part(b, cfg)
                for t in trees:
                    part.apply(*t)
                part.begin(number)
                found = part.sums(feature, level).ravel()
                total = found if total is None else total + found
            if total is not None:
                cell = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(total[cell])], ["cell", "v"])

        rows = self.table.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
        width = len(self.table.select("x").first()["x"]) + 1
        out = np.zeros((feature.shape[0], 1 << level, 3, width))
        out.ravel()[[r["cell"] for r in rows]] = [r["v"] for r in rows]
        return out


def _part(batch: pa.RecordBatch, cfg: Boosting) -> Patterns:
    x, counts, scores = (np.array(c.to_pylist()) for c in batch.columns)
    return Patterns(x, counts, scores, cfg)


def _grow(place, cfg: Boosting, number: int, classes: int, width: int) -> dict[str, np.ndarray]:
    """Trees of one round. Ties take the first feature; gains are compared at nine decimals."""
    size = 2 << cfg.depth
    feature = np.full((classes, size), -1, np.int64)
    gain, cover, value = np.zeros((classes, size)), np.zeros((classes, size)), np.zeros((classes, size))
    place.begin(number)
    open_nodes = np.zeros((classes, size), bool)
    open_nodes[:, 1] = True
    scale = 1.0 if cfg.newton else (classes - 1) / classes
    for level in range(cfg.depth + 1):
        low = 1 << level
        if not open_nodes[:, low:2 * low].any():
            break
        if level < cfg.depth:
            found = place.sums(feature, level)
        else:
            found = last  # sums of the sides of the splits above
        for k, m in zip(*np.nonzero(open_nodes[:, low:2 * low])):
            node = low + m
            n, g, h = found[k, m, :, -1]
            cover[k, node] = h
            denominator = h + cfg.l2
            value[k, node] = -scale * g / denominator * cfg.step if denominator > 1e-12 else 0.0
            if level == cfg.depth:
                continue
            one = found[k, m, :, :-1]
            zero = found[k, m, :, -1:] - one
            ok = (np.minimum(one[0], zero[0]) >= cfg.min_leaf) & (np.minimum(one[2], zero[2]) >= cfg.min_weight) & (np.minimum(one[0], zero[0]) > 0)
            if cfg.features == "sqrt":
                ok &= _chosen(cfg, number, k, node, np.minimum(one[0], zero[0]) > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                if cfg.newton:
                    better = one[1] ** 2 / (one[2] + cfg.l2) + zero[1] ** 2 / (zero[2] + cfg.l2) - g * g / (h + cfg.l2)
                else:
                    better = one[0] * zero[0] / n * (one[1] / one[0] - zero[1] / zero[0]) ** 2
            better = np.where(ok, np.round(better, 9), -1.0)
            best = int(better.argmax())
            if better[best] > max(cfg.min_gain, 1e-9) or (cfg.min_gain > 0 and better[best] == cfg.min_gain):
                feature[k, node], gain[k, node] = best, better[best]
                open_nodes[k, 2 * node:2 * node + 2] = True
        if level == cfg.depth - 1:
            last = np.zeros((classes, 2 * low, 3, width + 1))
            for k, m in zip(*np.nonzero(feature[:, low:2 * low] >= 0)):
                one = found[k, m, :, feature[k, low + m]]
                last[k, 2 * m + 1, :, -1], last[k, 2 * m, :, -1] = one, found[k, m, :, -1] - one
    value[feature >= 0] = 0.0
    return {"feature": feature, "value": value, "gain": gain, "cover": cover}


def _chosen(cfg: Boosting, number: int, k: int, node: int, useful: np.ndarray) -> np.ndarray:
    """A random set of sqrt(features) features that split the node."""
    draw = np.where(useful, _uniform(np.arange(len(useful)), np.full(len(useful), number * 4099 + k), np.full(len(useful), node * 31 + cfg.seed)), 2.0)
    return np.argsort(np.argsort(draw, kind="stable"), kind="stable") < max(1, int(len(useful) ** 0.5))


class BoostedTrees:
    """Fitted trees as arrays (round, class, node), and the starting scores of the classes."""

    def __init__(self, start: np.ndarray, trees: dict[str, np.ndarray], depth: int):
        self.start, self.trees, self.depth = start, trees, depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores before the softmax, for rows of 0/1 features; equal rows are scored once."""
        x = np.asarray(x, np.int64).reshape(-1, x.shape[1] if x.ndim == 2 else 0)
        some, back = np.unique(x, axis=0, return_inverse=True)
        total = np.tile(self.start, (len(some), 1))
        classes = np.arange(len(self.start))
        for feature, value in zip(self.trees["feature"], self.trees["value"]):
            total += value[classes, walk(some, feature, self.depth)]
        return total[back.ravel()]

    def probabilities(self, values: str | Column) -> Column:
        """Class probabilities of an array column of 0/1 features, in Arrow batches."""
        model = self

        @F.pandas_udf(ArrayType(DoubleType()))
        def score(column: pd.Series) -> pd.Series:
            if not len(column):
                return pd.Series([], dtype=object)
            return pd.Series(list(softmax(model.scores(np.stack(column.to_numpy()) > 0.5))))

        return score(values)

    def node_table(self, spark: SparkSession) -> DataFrame:
        """One row for each node: its feature (-1: leaf), value, gain and cover (sum of hessians)."""
        r, k, node = np.nonzero(self.trees["cover"] > 0)
        frame = pa.table({"round": pa.array(r, pa.int32()), "class": pa.array(k, pa.int32()), "node": pa.array(node, pa.int32()),
                          "feature": pa.array(self.trees["feature"][r, k, node], pa.int32()),
                          **{c: pa.array(self.trees[c][r, k, node]) for c in ("value", "gain", "cover")}})
        return spark.createDataFrame(frame)

    @staticmethod
    def from_nodes(rows: list, start: list[float], rounds: int, depth: int) -> BoostedTrees:
        shape = (rounds, len(start), 2 << depth)
        trees = {"feature": np.full(shape, -1, np.int64), **{c: np.zeros(shape) for c in ("value", "gain", "cover")}}
        for r in rows:
            for c in trees:
                trees[c][r["round"], r["class"], r["node"]] = r[c]
        return BoostedTrees(np.array(start), trees, depth)


def patterns(train: DataFrame, values: str, label: str, classes: int) -> DataFrame:
    """(x, counts): distinct 0/1 rows and how many rows of each class have them. Rows without values or label are left out."""
    x = F.transform(values, lambda v: (v > 0.5).cast("int"))
    known = train.where(F.col(values).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(x.alias("x")).agg(F.array(*[F.count(F.when(F.col(label) == k, 1)) for k in range(classes)]).alias("counts"))


def fit_boosting(train: DataFrame, values: str, label: str, classes: int, cfg: Boosting = REGULARISED,
                 memory_patterns: int = MEMORY_PATTERNS) -> BoostedTrees:
    """Boosted trees on an array column of 0/1 features and a label index below ``classes``.

    An empty table gives trees without splits and equal scores. Both ways of summing give the same trees.
    """
    table = stored(patterns(train, values, label, classes), "pattern-counts")
    few = table.limit(memory_patterns + 1).collect() if table.count() <= memory_patterns else None
    first = few[0] if few else table.first()
    width = len(first["x"]) if first else 0
    start = np.zeros(classes)
    if first and not cfg.newton:
        total = np.array(table.agg(*[F.sum(F.col("counts")[k]) for k in range(classes)]).first(), float)
        start = np.log(np.maximum(total, 1e-9) / total.sum())
    if few is None:
        place = SparkPatterns(table, start, cfg)
    else:
        x = np.array([r["x"] for r in few], np.int64).reshape(len(few), width)
        counts = np.array([r["counts"] for r in few], float).reshape(len(few), classes)
        order = np.lexsort(x.T[::-1]) if width else np.arange(len(x))
        place = Patterns(x[order], counts[order], np.tile(start, (len(few), 1)), cfg)
    grown = []
    for number in range(cfg.rounds if first else 0):
        trees = _grow(place, cfg, number, classes, width)
        place.apply(trees["feature"], trees["value"])
        grown.append(trees)
    shape = (0, classes, 2 << cfg.depth)
    names = ("feature", "value", "gain", "cover")
    return BoostedTrees(start, {c: np.stack([t[c] for t in grown]) if grown else np.zeros(shape, np.int64 if c == "feature" else float)
                                for c in names}, cfg.depth)


class Attribution:
    """Exact path-dependent Shapley values of trees for 0/1 rows.

    For each leaf, the features of its path have a weight z (the share of cover that goes the path's way where the feature
    is unknown) and o (1 where the row goes that way). The sums over all subsets are polynomials in the subset size:
    extended by one factor (z + o t) for each feature of the path, and unwound for the feature that is explained.
    """

    def __init__(self, model: BoostedTrees):
        self.leaves = []
        for k in range(len(model.start)):
            paths = []
            for feature, value, cover in zip(*(model.trees[c][:, k] for c in ("feature", "value", "cover"))):
                self._paths(feature, value, cover, 1, {}, paths)
            self.leaves.append(_packed(paths, model.depth))
        self.width = model.depth

    def _paths(self, feature, value, cover, node, path, out) -> None:
        """``path``: feature -> (share of cover, value that the row must have; 2 for one that no row has)."""
        if feature[node] < 0:
            out.append((value[node], path))
            return
        for side in (0, 1):
            child = 2 * node + side
            share = cover[child] / cover[node] if cover[node] > 0 else 0.0
            z, want = path.get(int(feature[node]), (1.0, side))
            self._paths(feature, value, cover, child, {**path, int(feature[node]): (z * share, want if want == side else 2)}, out)

    def expected(self, k: int) -> float:
        value, _, z, _, _ = self.leaves[k]
        return float((value * z.prod(1)).sum())

    def values(self, x: np.ndarray, k: int) -> np.ndarray:
        """Share of every feature in the score of class ``k``, for each row."""
        value, feature, z, want, size = self.leaves[k]
        depth, out = feature.shape[1], np.zeros(x.shape)
        if not len(value):
            return out
        from math import factorial
        weight = np.array([[factorial(s) * factorial(d - s - 1) / factorial(d) if s < d else 0.0 for s in range(depth)] for d in range(depth + 1)])
        for i, row in enumerate(np.asarray(x, np.int64)):
            there = np.arange(depth)[None, :] < size[:, None]
            o = np.where(there, row[np.maximum(feature, 0)] == want, False).astype(float)
            for j in range(depth):
                poly = np.zeros((len(value), depth + 1))
                poly[:, 0] = 1.0
                for q in range(depth):
                    if q != j:
                        step = poly * np.where(there[:, q], z[:, q], 1.0)[:, None]
                        step[:, 1:] += poly[:, :-1] * o[:, q:q + 1]
                        poly = step
                share = value * (o[:, j] - z[:, j]) * (poly[:, :depth] * weight[size]).sum(1)
                np.add.at(out[i], feature[there[:, j], j], share[there[:, j]])
        return out


def _packed(paths: list, depth: int) -> tuple:
    value = np.array([v for v, _ in paths])
    size = np.array([len(p) for _, p in paths], np.int64)
    feature, want = np.full((len(paths), depth), -1, np.int64), np.zeros((len(paths), depth), np.int64)
    z = np.ones((len(paths), depth))
    for i, (_, path) in enumerate(paths):
        for j, (f, (share, side)) in enumerate(path.items()):
            feature[i, j], z[i, j], want[i, j] = f, share, side
    return value, feature, z, want, size


def impacts(model: BoostedTrees, values: str | Column, target: str | Column, vocab: list[str]) -> Column:
    """Array of (feature, impact) of the active features of a row for its ``target`` class, largest impact first.

    ``impact`` is the exact Shapley value of the feature in the score before the softmax, at four decimals; ties go by
    name. Null without values or target. Equal patterns are explained once in a batch.
    """
    explain = Attribution(model)

    @F.pandas_udf("array<double>")
    def shares(x: pd.Series, k: pd.Series) -> pd.Series:
        known = {}
        out = []
        for row, t in zip(x, k):
            if row is None or t is None or t != t:
                out.append(None)
                continue
            key = (tuple(int(v > 0.5) for v in row), int(t))
            if key not in known:
                known[key] = explain.values(np.array([key[0]]), key[1])[0].tolist()
            out.append(known[key])
        return pd.Series(out, dtype=object)

    x, k = (F.col(c) if isinstance(c, str) else c for c in (values, target))
    named = F.array(*[F.lit(v) for v in vocab])
    places = F.filter(F.sequence(F.lit(0), F.lit(len(vocab) - 1)), lambda i: F.get(x, i) > 0.5)
    parts = let(shares(x, k), lambda s: F.when(s.isNotNull(), F.array_sort(F.transform(places, lambda i: F.struct(
        (-F.round(F.get(s, i), 4)).alias("down"), F.get(named, i).alias("feature"))))))
    return F.transform(parts, lambda p: F.struct(p["feature"].alias("feature"), (F.lit(0.0) - p["down"]).alias("impact")))


def tree_attribution(df: DataFrame, model: BoostedTrees, keys: list[str], values: str, target: str, vocab: list[str]) -> DataFrame:
    """(keys, feature, impact, rank): one row for each of the ``impacts`` of every row, rank 1 for the largest."""
    rows = df.select(*keys, F.posexplode(impacts(model, values, target, vocab)).alias("at", "p"))
    return rows.select(*keys, "p.feature", "p.impact", (F.col("at") + 1).alias("rank"))


def parameters(cfg: Boosting) -> dict:
    return asdict(cfg)


ship_by_value(__name__)
