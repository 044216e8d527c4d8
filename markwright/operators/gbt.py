"""A NaN-native gradient-boosted tree head, exact TreeSHAP, and the protocol grid that runs it.

Cells (dataset x split or fold x seed x variant) are small and independent, so the
grid is one ``applyInPandas`` task a cell; a cell's rows reach it through a join on
the fold predicate. Trees are histogram-based and grown best leaf first; a
missing value goes where the gain is larger.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import scratch
from . import parzen

#: Gradients are whole multiples of 1 / GRID, so that their sums are exact in any order.
GRID = 2.0**24
#: Partitions that cells and blocks are dealt to: so many that two rarely meet in one task. A given number isn't coalesced.
TASKS = 64


def whole(x: np.ndarray) -> np.ndarray:
    return np.rint(np.asarray(x, float) * GRID)


def gradients(raw: np.ndarray, target: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and output, in units of 1 / GRID: softmax against a class index, else half the squared error."""
    if not classes:
        return whole(raw - np.asarray(target, float)[:, None]), np.full(raw.shape, GRID)
    e = np.exp(raw - raw.max(1, keepdims=True))
    prob = e / e.sum(1, keepdims=True)
    return whole(prob - np.eye(classes)[np.asarray(target, int)]), whole(prob * (1 - prob))


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)  # -1: leaf
    threshold: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for name, v in (("feature", -1), ("threshold", 0.0), ("missing_left", True), ("left", -1), ("right", -1), ("value", value), ("cover", cover), ("gain", 0.0)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature[node]]
        return np.where(np.isnan(v), self.missing_left[node], v <= self.threshold[node])

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
            elif len(rows):
                left = self.goes_left(node, x[rows])
                stack += [(self.left[node], rows[left]), (self.right[node], rows[~left])]
        return out


def places(widths: list[int], width: int = 0) -> np.ndarray:
    """(column, missing values right, bin) places where a split may be: the last one parts values from missing ones, which then go right."""
    at = np.arange(max([*widths, width]) - 1)
    return np.array([[at < w - 2, at < w - 1] for w in widths])


class Booster:
    """Squared error, or softmax over classes (a tree a class and round)."""

    def __init__(self, n_estimators=100, learning_rate=0.05, num_leaves=31, min_child_samples=20, subsample=1.0, colsample=1.0, reg_alpha=0.0, reg_lambda=0.0, max_bin=63, seed=42, classes=0):
        self.p = dict(n=n_estimators, lr=learning_rate, leaves=num_leaves, least=min_child_samples, sub=subsample, col=colsample, l1=reg_alpha, l2=reg_lambda, bins=max_bin)
        self.seed, self.k, self.trees, self.base = seed, classes, [], None

    def _bin(self, x: np.ndarray, given: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        if given is not None:
            return np.stack([np.where(np.isnan(v), -1, np.searchsorted(cut, v, "left")) for v, cut in zip(x.T, given, strict=True)], 1).astype(np.int16), given
        codes, cuts = np.empty(x.shape, np.int16), []
        for j in range(x.shape[1]):
            v = x[:, j]
            seen = np.unique(v[~np.isnan(v)])
            if len(seen) > self.p["bins"]:
                seen = np.unique(np.quantile(v[~np.isnan(v)], np.linspace(0, 1, self.p["bins"] + 1)[1:-1]))
                cut = seen
            else:
                cut = (seen[1:] + seen[:-1]) / 2
            cuts.append(cut)
            codes[:, j] = np.where(np.isnan(v), -1, np.searchsorted(cut, v, "left"))
        return codes, cuts

    def _leaf(self, g: float, h: float) -> float:
        g = np.sign(g) * max(abs(g) - self.p["l1"], 0.0)
        return -g / (h + self.p["l2"] + 1e-12)

    def _score(self, g, h):
        if self.p["l1"]:
            g = np.sign(g) * np.maximum(np.abs(g) - self.p["l1"], 0.0)
        return g * g / (h + self.p["l2"] + 1e-12)

    def best(self, bins: dict[int, tuple], gs: float, hs: float, n: int) -> tuple:
        """The best split of a node by its columns' (gradient, hessian, count) sums of each bin, missing values first: gain and
        (column, bin, missing values go left, the left side's sums), or None for these."""
        columns, widths = list(bins), [len(v[2]) for v in bins.values()]
        sums = np.zeros((1, 3, len(columns), max(widths)))
        for i, v in enumerate(bins.values()):
            sums[0, :, i, : widths[i]] = v
        gain, split = self.best_of(sums, places(widths), [(gs, hs, n)])[0]
        return gain, split and (columns[split[0]], *split[1:])

    def best_of(self, sums: np.ndarray, allowed: np.ndarray, totals: list[tuple]) -> list[tuple]:
        """``best`` of several nodes at once, by their sums (node, 3, column, bin) and totals; of equal gains the first column's, missing left before right."""
        run = np.cumsum(sums[..., 1:], axis=3)
        both = np.stack([run + sums[..., :1], run], 3)  # missing values on the left, then on the right
        lg, lh, ln = both[:, 0], both[:, 1], both[:, 2]
        gs, hs, n = (np.array([t[i] for t in totals], float).reshape(-1, 1, 1, 1) for i in range(3))
        ok = allowed & (ln >= self.p["least"]) & (n - ln >= self.p["least"])
        ok[:, :, 1] &= sums[:, 2, :, :1] > 0
        gain = np.where(ok, self._score(lg, lh) + self._score(gs - lg, hs - lh) - self._score(gs, hs), -1.0).reshape(len(sums), -1)
        out = []
        for i, at in enumerate(gain.argmax(1)):
            if gain[i, at] > 1e-12:
                j, side, place = np.unravel_index(at, lg.shape[1:])
                out.append((float(gain[i, at]), (int(j), int(place), side == 0, float(lg[i, j, side, place]), float(lh[i, j, side, place]), int(ln[i, j, side, place]))))
            else:
                out.append((1e-12, None))
        return out

    def _sums(self, flat: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, shape: tuple) -> np.ndarray:
        """(3, column, bin) sums of gradients, hessians and rows, by blocks of rows."""
        m, width = shape
        out = np.zeros((3, m * width))
        for at in range(0, len(rows), 1 << 15):
            own = rows[at : at + (1 << 15)]
            into = flat[own].ravel()
            count = np.bincount(into, minlength=m * width)
            out[0] += np.bincount(into, np.repeat(g[own], m), m * width)
            out[1] += np.bincount(into, np.repeat(h[own], m), m * width) if self.k else count  # of squared error each hessian is 1
            out[2] += count
        return out.reshape(3, m, width)

    def _tree(self, flat, cuts, g, h, rows, columns) -> tuple[Tree, list[tuple[int, np.ndarray]]]:
        """A tree and the rows of each of its leaves. A split's smaller side is summed, the larger one is what is left (sums are exact)."""
        t, (m, width) = Tree(), (len(cuts), max(len(c) for c in cuts) + 2)
        allowed = places([len(c) + 2 for c in cuts], width)
        allowed[np.setdiff1d(np.arange(m), columns)] = False
        sums = self._sums(flat, g, h, rows, (m, width))
        total = (g[rows].sum(), h[rows].sum(), len(rows))
        root = t.add(self._leaf(*total[:2]), len(rows))
        first = self.best_of(sums[None], allowed, [total])[0]
        open_, gains = [(root, rows, sums, total, first[1])], [first[0]]
        while len(open_) < self.p["leaves"]:
            i = gains.index(max(gains))
            node, own, sums, total, split = open_[i]
            if split is None:
                break
            j, at, missing_left, *left_total = split
            t.feature[node], t.threshold[node], t.missing_left[node], t.gain[node] = j, float(cuts[j][at]) if at < len(cuts[j]) else np.inf, bool(missing_left), gains[i]
            code = flat[own, j] - j * width  # 0: missing
            left = (code <= at + 1) & (code > 0) | (code == 0) & missing_left
            parts = (own[left], own[~left])
            totals = [tuple(left_total), tuple(a - b for a, b in zip(total, left_total, strict=True))]
            small = int(len(parts[1]) < len(parts[0]))
            kid_sums = [None, None]
            kid_sums[small] = self._sums(flat, g, h, parts[small], (m, width))
            kid_sums[1 - small] = sums - kid_sums[small]
            kids = [t.add(self._leaf(*s[:2]), len(r)) for r, s in zip(parts, totals, strict=True)]
            t.left[node], t.right[node] = kids
            found = self.best_of(np.stack(kid_sums), allowed, totals)
            open_[i : i + 1] = [(k, r, s, n, f[1]) for k, r, s, n, f in zip(kids, parts, kid_sums, totals, found, strict=True)]
            gains[i : i + 1] = [f[0] for f in found]
        t.value = [v * self.p["lr"] for v in t.value]
        return t, [(node, own) for node, own, *_ in open_]

    def fit(self, x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray] | None = None) -> Booster:
        x = np.asarray(x, float)
        rng = np.random.default_rng(self.seed)
        codes, cuts = self._bin(x, cuts)
        flat = codes.astype(np.int64 if codes.shape[1] * (self.p["bins"] + 2) > 2**31 else np.int32)
        flat += (1 + np.arange(x.shape[1]) * (max(len(c) for c in cuts) + 2)).astype(flat.dtype)
        n, k = len(y), max(self.k, 1)
        if self.k:
            self.base = np.log(np.maximum(np.bincount(np.asarray(y, int), minlength=self.k) / n, 1e-9))
        else:
            self.base = np.array([np.rint(whole(y).sum() / n) / GRID])
        raw = np.tile(self.base, (n, 1))
        for _ in range(self.p["n"]):
            rows = np.sort(rng.choice(n, max(1, int(n * self.p["sub"])), replace=False)) if self.p["sub"] < 1 else np.arange(n)
            columns = np.sort(rng.choice(x.shape[1], max(1, int(x.shape[1] * self.p["col"])), replace=False)) if self.p["col"] < 1 else np.arange(x.shape[1])
            grad, hess = (v / GRID for v in gradients(raw, y, self.k))
            new = [self._tree(flat, cuts, grad[:, c], hess[:, c], rows, columns) for c in range(k)]
            rest = np.setdiff1d(np.arange(n), rows, assume_unique=True) if len(rows) < n else rows[:0]
            for c, (t, leaves) in enumerate(new):
                for node, own in leaves:
                    raw[own, c] += t.value[node]
                raw[rest, c] += t.predict(x[rest])
            self.trees.append([t for t, _ in new])
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        out = np.tile(self.base, (len(x), 1))
        for group in self.trees:
            for c, t in enumerate(group):
                out[:, c] += t.predict(x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        return r.argmax(1) if self.k else r[:, 0]

    def importance(self, n_features: int, kind: str = "split") -> np.ndarray:
        out = np.zeros(n_features)
        for group in self.trees:
            for t in group:
                for f, g in zip(t.feature, t.gain, strict=True):
                    if f >= 0:
                        out[f] += 1 if kind == "split" else g
        return out

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, outputs, features + 1): exact path-dependent Shapley values; the last column is the base, rows sum to ``raw``."""
        x = np.asarray(x, float)
        out = np.zeros((len(x), len(self.base), x.shape[1] + 1))
        out[:, :, -1] = self.base
        for group in self.trees:
            for c, t in enumerate(group):
                out[:, c] += tree_shaps(t, x)
        return out


def tree_shap(t: Tree, x: np.ndarray) -> np.ndarray:
    """Shapley values of one tree for one row, summed over leaves: for each leaf only the features on its path matter."""
    phi = np.zeros(len(x) + 1)

    def leaf(path: dict[int, tuple[float, float]], value: float) -> None:
        # path: feature -> (share of training rows that pass all its tests, 1 if x passes them else 0)
        names = list(path)
        zero, one = np.array([path[f][0] for f in names]), np.array([path[f][1] for f in names])
        m = len(names)
        phi[-1] += value * zero.prod()
        for i, f in enumerate(names):
            poly = np.ones(1)  # coefficient k: sum over subsets of size k of the others
            for j in range(m):
                if j != i:
                    poly = np.convolve(poly, [zero[j], one[j]])
            weight = np.array([1.0 / (m * _choose(m - 1, s)) for s in range(m)])
            phi[f] += value * (one[i] - zero[i]) * float((poly * weight).sum())

    def walk(node: int, path: dict[int, tuple[float, float]]) -> None:
        f = t.feature[node]
        if f < 0:
            leaf(path, t.value[node])
            return
        left = bool(t.missing_left[node] if np.isnan(x[f]) else x[f] <= t.threshold[node])
        for child, passes in ((t.left[node], left), (t.right[node], not left)):
            z, o = path.get(f, (1.0, 1.0))
            walk(child, path | {f: (z * t.cover[child] / t.cover[node], o * float(passes))})

    walk(0, {})
    return phi


def tree_shaps(t: Tree, x: np.ndarray) -> np.ndarray:
    """``tree_shap`` of every row; at each leaf rows that pass the same tests share one computation."""
    phi = np.zeros((len(x), x.shape[1] + 1))

    def leaf(path: dict[int, tuple[float, np.ndarray]], value: float) -> None:
        names, m = list(path), len(path)
        zero = np.array([path[f][0] for f in names])
        phi[:, -1] += value * zero.prod()
        if not m:
            return
        passed, of = np.unique(sum(path[f][1].astype(np.int64) << i for i, f in enumerate(names)), return_inverse=True)
        one = (passed[:, None] >> np.arange(m) & 1).astype(float)
        weight = np.array([1.0 / (m * _choose(m - 1, s)) for s in range(m)])
        for i, f in enumerate(names):
            poly = np.ones((len(passed), 1))
            for j in range(m):
                if j != i:
                    poly = np.pad(poly * zero[j], ((0, 0), (0, 1))) + np.pad(poly * one[:, j : j + 1], ((0, 0), (1, 0)))
            phi[:, f] += (value * (one[:, i] - zero[i]) * (poly @ weight))[of]

    def walk(node: int, path: dict[int, tuple[float, np.ndarray]]) -> None:
        f = t.feature[node]
        if f < 0:
            leaf(path, t.value[node])
            return
        left = t.goes_left(node, x).astype(bool)
        for child, passes in ((t.left[node], left), (t.right[node], ~left)):
            z, o = path.get(f, (1.0, True))
            walk(child, path | {f: (z * t.cover[child] / t.cover[node], passes & o)})

    walk(0, {})
    return phi


def _choose(n: int, k: int) -> float:
    out = 1.0
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out


class Head:
    """Fit and predict by task: classification, regression, or ordinal (regress, round half to even, clip to the training range)."""

    def __init__(self, kind: str, params: dict, seed: int):
        self.kind, self.params, self.seed = kind, params, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Head:
        y = np.asarray(y)
        self.lo, self.hi = y.min(), y.max()
        self.labels = np.unique(y)
        self.constant = len(self.labels) < 2
        if not self.constant:
            classes = len(self.labels) if self.kind == "classification" else 0
            target = np.searchsorted(self.labels, y) if classes else y
            self.model = Booster(**self.params, seed=self.seed, classes=classes).fit(x, target)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), self.labels[0])
        p = self.model.predict(x)
        if self.kind == "classification":
            return self.labels[p]
        return np.clip(np.rint(p), self.lo, self.hi) if self.kind == "ordinal" else p


def run_grid(cells: DataFrame, features: list[str], kind: str, params: dict) -> DataFrame:
    """Train and predict every cell of (cell, seed, role 'train'|'test', row_id, y, features): cell, seed, row_id, y_true, y_pred.

    Rows without a target don't train; a cell without training rows predicts nothing.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        train, test = pdf[(pdf.role == "train") & pdf.y.notna()], pdf[pdf.role == "test"].sort_values("row_id")
        train = train.sort_values("row_id")
        if train.empty or test.empty:
            return pd.DataFrame({"cell": [], "seed": [], "row_id": [], "y_true": [], "y_pred": []})
        head = Head(kind, params, int(pdf.seed.iloc[0])).fit(train[features].to_numpy(float), train.y.to_numpy(float))
        return pd.DataFrame({"cell": test.cell, "seed": test.seed, "row_id": test.row_id, "y_true": test.y, "y_pred": head.predict(test[features].to_numpy(float)).astype(float)})

    used = cells.where("role = 'test' or y is not null").select("cell", "seed", "role", "row_id", "y", *features)
    return used.repartition(TASKS, "cell", "seed").groupBy("cell", "seed").applyInPandas(one, "cell string, seed int, row_id long, y_true double, y_pred double")


def fold_cells(matrix: DataFrame, folds: DataFrame, seeds: tuple[int, ...], target: str = "score") -> DataFrame:
    """The cells of grouped cross-validation: each fold's rows are its test rows, all others train."""
    rows = matrix.join(folds.select("question_id", "fold"), "question_id").withColumn("y", F.col(target).cast("double"))
    grid = folds.select(F.col("fold").alias("cell_fold")).distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    both = rows.join(F.broadcast(grid))  # folds x seeds, a fixed handful
    return both.withColumn("role", F.when(F.col("fold") == F.col("cell_fold"), "test").otherwise("train")).withColumn("cell", F.concat(F.lit("fold-"), F.col("cell_fold")))


def split_cells(matrix: DataFrame, tests: tuple[str, ...], seeds: tuple[int, ...], target: str = "score") -> DataFrame:
    """The cells of the official protocol: train rows against each test split."""
    rows = matrix.withColumn("y", F.col(target).cast("double"))
    both = rows.select("*", F.explode(F.array(*[F.lit(t) for t in tests])).alias("cell"), F.array(*[F.lit(s) for s in seeds]).alias("__s")).select("*", F.explode("__s").alias("seed")).drop("__s")
    return both.withColumn("role", F.when(F.col("split") == "train", "train").when(F.col("split") == F.col("cell"), "test")).where("role is not null")


# The documented search space; (low, high) with a step or on a log scale.
SEARCH_SPACE = {
    "learning_rate": (5e-3, 0.3, "log"),
    "num_leaves": (15, 255, 1),
    "n_estimators": (100, 800, 50),
    "min_child_samples": (5, 80, 1),
    "subsample": (0.6, 1.0, "linear"),
    "colsample": (0.6, 1.0, "linear"),
    "reg_alpha": (1e-3, 10.0, "log"),
    "reg_lambda": (1e-3, 10.0, "log"),
}


def tried(cells: DataFrame, features: list[str], kind: str, options: list[dict]) -> DataFrame:
    """Held-out predictions of several settings, one task a (trial, cell, seed): trial, row_id, y_true, y_pred."""
    spark = cells.sparkSession
    grid = spark.createDataFrame([(i,) for i in range(len(options))], "trial int")
    used = cells.where("y is not null").select("cell", "seed", "role", "row_id", "y", *features)
    rows = used.join(F.broadcast(grid))  # a batch of trials

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        train, test = pdf[(pdf.role == "train") & pdf.y.notna()].sort_values("row_id"), pdf[(pdf.role == "test") & pdf.y.notna()].sort_values("row_id")
        if train.empty or test.empty:
            return pd.DataFrame({"trial": [], "row_id": [], "y_true": [], "y_pred": []})
        head = Head(kind, options[int(pdf.trial.iloc[0])], int(pdf.seed.iloc[0])).fit(train[features].to_numpy(float), train.y.to_numpy(float))
        return pd.DataFrame({"trial": test.trial, "row_id": test.row_id, "y_true": test.y, "y_pred": head.predict(test[features].to_numpy(float)).astype(float)})

    return rows.repartition(TASKS, "trial", "cell", "seed").groupBy("trial", "cell", "seed").applyInPandas(one, "trial int, row_id long, y_true double, y_pred double")


def search(cells: DataFrame, features: list[str], kind: str, metric: str, n: int, batch: int, seed: int) -> list[dict]:
    """Parzen search over ``SEARCH_SPACE`` for the best value of a registered metric on the cells' held-out rows; rows in the order tried.

    ``value`` is the metric, its sign turned for errors.
    """
    from ..functions import metrics
    from .protocol import LOWER_IS_BETTER

    sign = -1.0 if metric in LOWER_IS_BETTER else 1.0
    staged = cells.persist()  # every batch reads the cells

    def evaluate(options: list[dict]) -> list[float]:
        path = scratch(cells.sparkSession, "trials")  # a metric reads the predictions more than once: without this each read fits anew
        tried(staged, features, kind, options).write.option("compression", "zstd").parquet(path)
        values = {r.trial: r[metric] for r in metrics.compute(cells.sparkSession.read.parquet(path), ["trial"], [metric]).collect()}  # a row a trial
        return [float("nan") if values.get(i) is None else sign * values[i] for i in range(len(options))]

    found = parzen.search(evaluate, SEARCH_SPACE, n, batch, seed)
    staged.unpersist()
    return found


def explain(matrix: DataFrame, features: list[str], kind: str, params: dict, target: str = "score", seed: int = 42, block: int = 4096) -> DataFrame:
    """Contributions of a head fitted per dataset, for each of its scored rows: dataset, row_id, feature, value, shap, split_count.

    A fitted head goes to blocks of about ``block`` rows, which are explained in parallel. The rows are stored, as they are
    read three times.
    """
    path = scratch(matrix.sparkSession, "explained-rows")
    matrix.withColumn("y", F.col(target).cast("double")).where("y is not null").select("dataset", "row_id", *features, "y").write.option("compression", "zstd").parquet(path)
    rows = matrix.sparkSession.read.parquet(path)
    blocks = F.broadcast(rows.groupBy("dataset").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))  # one row a dataset

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        head = Head(kind, params, seed).fit(pdf[features].to_numpy(float), pdf.y.to_numpy(float))
        own = [] if head.constant else [(str(pdf.dataset.iloc[0]), pickle.dumps(head))]
        return pd.DataFrame({c: np.array([r[i] for r in own], object) for i, c in enumerate(("dataset", "head"))})

    def one(pdf: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or heads.empty:
            return pd.DataFrame({c: np.array([], object if c in ("dataset", "feature") else float) for c in ("dataset", "row_id", "feature", "value", "shap", "split_count")})
        head = pickle.loads(heads["head"].iloc[0])
        pdf = pdf.sort_values("row_id")
        x = pdf[features].to_numpy(float)
        c = head.model.contributions(x)
        shap = np.abs(c[:, :, :-1]).mean(1) if kind == "classification" else c[:, 0, :-1]
        count = head.model.importance(len(features))
        n, m = x.shape
        name = np.full(n * m, str(pdf.dataset.iloc[0]), object)
        return pd.DataFrame({"dataset": name, "row_id": np.repeat(pdf.row_id.to_numpy(), m), "feature": np.array(list(features) * n, object), "value": x.ravel(), "shap": shap.ravel(), "split_count": np.tile(count, n)})

    heads = rows.repartition(TASKS, "dataset").groupBy("dataset").applyInPandas(fitted, "dataset string, head binary").join(blocks, "dataset").select("dataset", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "head")
    dealt = rows.join(blocks, "dataset").withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int")).drop("blocks")
    both = dealt.repartition(TASKS, "dataset", "block").groupBy("dataset", "block").cogroup(heads.repartition(TASKS, "dataset", "block").groupBy("dataset", "block"))
    return both.applyInPandas(one, "dataset string, row_id long, feature string, value double, shap double, split_count double")
