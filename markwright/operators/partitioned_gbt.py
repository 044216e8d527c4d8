"""Boosted trees whose rows stay in their partitions, and nested folds as cells over one stored matrix.

The columns are binned once, by exact quantiles of all rows, and the bins are
stored with the rows. A cell is a set of slots (a slot is any small integer that
tells rows apart: a fold, a split and a fold), so cells that share rows copy none
of them: a task adds its rows to the histograms of each cell that trains on their
slot. A pass sums (cell, output, node, column, bin) in the tasks, then over
tasks; a node's best split is found beside its sums, and only that split comes to
the driver. Trees of all cells grow in the same passes, which look ahead: each
asks for the splits that the best leaf may need next, so a tree takes about as
many passes as it is deep, and is the one that ``gbt.Booster`` grows on the same
bins. Sums are of integers, so trees don't depend on how rows are partitioned.

What the driver and a task hold is bounded by the settings (cells x leaves x
columns x bins), not by rows.

Edge cases. Rows without a target, or with a null slot, train nothing; NaN counts
as missing. A cell without rows has no head and predicts nothing; one with a
single target value predicts it. With ``subsample`` under 1 a row takes part by a
hash of its id and the round, not by the local booster's draws. Bins are taken
from all rows' features, held-out ones included, but from no targets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import scratch
from . import ranks
from .gbt import GRID, Booster, Head, Tree, gradients

STAGE_EVERY = 10  # rounds between two stagings of the rows' scores
BINNED = "row_id long, slot int, y double, codes binary"
SUMS = "cell int, output int, node long, feature int, bin int, g long, h long, n long"
SPLIT = "cell int, output int, node long, gain double, feature int, at int, missing_left boolean, lg double, lh double, ln long, g double, h double, n long"


def cuts_of(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Each column's cuts between bins: half way between its values if these are few, else exact quantiles; no task sorts a column."""
    spark = rows.sparkSession
    values = rows.select(F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("feature", "value")).where("value is not null and not isnan(value)")
    path = scratch(spark, "feature-values")
    counted = values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks.running(counted, ["feature"], ["value"], {"less": "n"}).write.parquet(path)
    places = spark.read.schema("feature int, value double, n long, less long").parquet(path)
    sizes = {r.feature: (r.d, r.total) for r in places.groupBy("feature").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("total")).collect()}  # a row a column
    few = [f for f, (d, _) in sizes.items() if d <= bins]
    wanted = {f: (total - 1) * np.linspace(0, 1, bins + 1)[1:-1] for f, (d, total) in sizes.items() if d > bins}
    ends = [(f, int(p)) for f, v in wanted.items() for p in sorted({*np.floor(v), *np.minimum(np.floor(v) + 1, sizes[f][1] - 1)})]
    asked = F.broadcast(spark.createDataFrame(ends, "asked int, place long"))  # two places a cut
    at = places.join(asked, (F.col("feature") == F.col("asked")) & (F.col("less") <= F.col("place")) & (F.col("place") < F.col("less") + F.col("n")))
    found: dict[int, dict[int, float]] = {}
    for r in places.where(F.col("feature").isin(few)).select("feature", "less", "value").union(at.select("feature", "place", "value")).collect():  # at most 2 x bins a column
        found.setdefault(r[0], {})[r[1]] = r[2]
    out = []
    for f in range(len(features)):
        own = found.get(f, {})
        if f in wanted:
            low = np.floor(wanted[f]).astype(int)
            part = wanted[f] - low
            a, b = (np.array([own[p] for p in ps]) for ps in (low, np.minimum(low + 1, sizes[f][1] - 1)))
            out.append(np.unique(np.where(part >= 0.5, b - (b - a) * (1 - part), a + (b - a) * part)))
        else:
            seen = np.array([own[p] for p in sorted(own)])
            out.append((seen[1:] + seen[:-1]) / 2)
    return out


def matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features], 1).astype(float)


def packed(values: np.ndarray) -> pa.Array:
    """Rows of an array as a binary column."""
    data = np.ascontiguousarray(values)
    width = data.dtype.itemsize * data.shape[1]
    ends = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def unpacked(column: pa.Array, kind: type, columns: int) -> np.ndarray:
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    size = len(column) * columns
    return np.frombuffer(column.buffers()[2], np.uint8)[begin : begin + size * np.dtype(kind).itemsize].view(kind).reshape(len(column), columns)


def binned(rows: DataFrame, features: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """row_id, slot, y and the bins of ``features`` (-1: missing) of the rows that can train."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b, features)
            codes = np.empty(x.shape, np.int16)
            for j, cut in enumerate(cuts):
                codes[:, j] = np.where(np.isnan(x[:, j]), -1, np.searchsorted(cut, x[:, j], "left"))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("slot"), b.column("y"), packed(codes)], ["row_id", "slot", "y", "codes"])

    kept = rows.select(F.col("row_id").cast("long"), F.col("slot").cast("int"), F.col("y").cast("double"), *features).where("y is not null and not isnan(y) and slot is not null")
    return kept.mapInArrow(one, BINNED)


@dataclass
class Plan:
    """A cell: the slots it trains on, and what is known of its targets."""

    name: str
    slots: frozenset[int]
    labels: list[float] = field(default_factory=list)  # of a classification
    lo: float = 0.0
    hi: float = 0.0
    booster: Booster | None = None  # none: nothing to learn
    columns: list[int] = field(default_factory=list)  # of this round
    routes: list[list[tuple[dict, np.ndarray]]] = field(default_factory=list)  # of each round and output since the last staging

    @property
    def outputs(self) -> int:
        return max(self.booster.k, 1) if self.booster else 0


def descend(splits: dict[int, tuple], codes: np.ndarray) -> np.ndarray:
    """Where rows come to by the splits of nodes 1, 2 and 3 below it, and so on (node: column, bin, missing values go left)."""
    at = np.ones(len(codes), np.int64)
    for node in sorted(splits):
        j, cut, missing_left = splits[node]
        own = np.flatnonzero(at == node)
        c = codes[own, j]
        at[own] = 2 * node + np.where(c < 0, not missing_left, c > cut)
    return at


def scores(plan: Plan, codes: np.ndarray, staged: np.ndarray) -> np.ndarray:
    out = staged.copy()
    for outputs in plan.routes:
        for k, (splits, leaves) in enumerate(outputs):
            at = descend(splits, codes)
            for node, value in leaves.items():
                out[at == node, k] += value
    return out


def drawn(row_id: np.ndarray, round_: int, seed: int, share: float) -> np.ndarray:
    """Whether rows take part in a round, by a mixing hash of id, round and seed."""
    x = row_id.astype(np.uint64) + np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 + seed & 2**64 - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)) >> np.uint64(32) < np.uint64(int(share * 2**32))


class Growth:
    """One tree in the making: splits known so far, of it and of what it may grow into."""

    def __init__(self) -> None:
        self.known: dict[int, tuple] = {}  # node: gain, (column, bin, missing left) or None, its sums, its left side's sums
        self.done: tuple | None = None

    def wanted(self, leaves: int) -> list[int]:
        """The nodes whose split has to be known to go on; none when ``done`` has (splits, leaf sums in order of growth)."""
        if 1 not in self.known:
            return [1]
        open_, splits = [1], []
        while len(open_) < leaves:
            node = max(open_, key=lambda x: self.known[x][0])
            if self.known[node][1] is None:
                break
            kids = [2 * node, 2 * node + 1]
            if len(open_) + 1 < leaves and not all(k in self.known for k in kids):
                likely = sorted((x for x in open_ if self.known[x][1] is not None), key=lambda x: -self.known[x][0])[: leaves - len(open_)]
                return [k for x in likely for k in (2 * x, 2 * x + 1) if k not in self.known]
            splits.append(node)
            i = open_.index(node)
            open_[i : i + 1] = kids
        self.done = tuple(splits)
        return []

    def tree(self, booster: Booster, cuts: list[np.ndarray]) -> tuple[Tree, dict, dict]:
        """The tree, its splits by node, and the values of its leaves by node."""
        t, splits, leaves, lr = Tree(), {}, {}, booster.p["lr"]
        place = {1: t.add(booster._leaf(*self.known[1][2][:2]) * lr, self.known[1][2][2])}
        sums = {1: self.known[1][2]}
        for node in self.done:
            gain, (j, at, missing_left), own, left = self.known[node]
            splits[node] = (j, at, missing_left)
            i = place[node]
            t.feature[i], t.threshold[i], t.missing_left[i], t.gain[i] = j, float(cuts[j][at]) if at < len(cuts[j]) else np.inf, missing_left, gain
            for kid, s in ((2 * node, left), (2 * node + 1, tuple(a - b for a, b in zip(own, left, strict=True)))):
                sums[kid], place[kid] = s, t.add(booster._leaf(*s[:2]) * lr, s[2])
            t.left[i], t.right[i] = place[2 * node], place[2 * node + 1]
        for node, i in place.items():
            if t.feature[i] < 0:
                leaves[node] = t.value[i]
        return t, splits, leaves


def node_sums(rows: DataFrame, plans: list[Plan], growing: dict, widths: list[int], sub: tuple) -> DataFrame:
    """The pass: sums of gradients, hessians and rows for each bin of the asked nodes, added up in each task first."""
    starts, m, total = np.concatenate([[0], np.cumsum(widths)[:-1]]), len(widths), int(sum(widths))
    feature, bin_ = np.repeat(np.arange(m), widths), np.concatenate([np.arange(w) for w in widths])
    asked = {(c, k): ({n: g.known[n][1] for n in g.known if g.known[n][1]}, nodes) for (c, k), (g, nodes) in growing.items()}
    highest = max(max(p.slots, default=0) for p in plans) + 1
    trains = np.zeros((len(plans), highest + 1), bool)
    for c, p in enumerate(plans):
        trains[c, list(p.slots)] = True
    offsets = np.concatenate([[0], np.cumsum([p.outputs for p in plans])]).astype(int)
    round_, seed, share = sub

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            codes, y = unpacked(b.column("codes"), np.int16, m), b.column("y").to_numpy()
            slot = np.minimum(b.column("slot").to_numpy(), highest)
            staged = unpacked(b.column("raw"), np.float64, int(offsets[-1]))
            part = drawn(b.column("row_id").fill_null(0).to_numpy(), round_, seed, share) if share < 1 else np.ones(len(y), bool)
            for c, plan in enumerate(plans):
                mine = np.flatnonzero(trains[c][slot] & part & (slot >= 0))
                outputs = [k for k in range(plan.outputs) if (c, k) in asked]
                if not len(mine) or not outputs:
                    continue
                own = codes[mine]
                target = np.searchsorted(plan.labels, y[mine]) if plan.booster.k else y[mine]
                grad, hess = gradients(scores(plan, own, staged[mine, offsets[c] : offsets[c + 1]]), target, plan.booster.k)
                flat = own + (1 + starts)
                for k in outputs:
                    splits, nodes = asked[c, k]
                    at = descend(splits, own)
                    for node in nodes:
                        here = np.flatnonzero(at == node)
                        if len(here):
                            into = flat[here].ravel()
                            got = np.stack([np.bincount(into, w, total) for w in (np.repeat(grad[here, k], m), np.repeat(hess[here, k], m), None)]).astype(np.int64)
                            sums[c, k, node] = sums[c, k, node] + got if (c, k, node) in sums else got
        for (c, k, node), got in sums.items():
            there = np.flatnonzero(got[2])
            fixed = [np.full(len(there), v, t) for v, t in ((c, np.int32), (k, np.int32), (node, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*fixed, feature[there].astype(np.int32), bin_[there].astype(np.int32), *got[:, there])], [x.split()[0] for x in SUMS.split(", ")])

    each = rows.mapInArrow(one, SUMS)
    return each.repartition(F.col("cell"), F.col("output"), F.col("node")).groupBy("cell", "output", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])


def best_splits(sums: DataFrame, plans: list[Plan], widths: list[int]) -> DataFrame:
    """A row a node. ``sums`` has all sums of a node in one partition; a task holds its nodes' sums, at most columns x bins rows each."""
    columns, boosters, starts = [p.columns for p in plans], [p.booster for p in plans], np.concatenate([[0], np.cumsum(widths)]).astype(int)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple, np.ndarray] = {}
        for b in batches:
            c, k, node, j, bin_, *ghn = (x.to_numpy(zero_copy_only=False) for x in b.columns)
            keys, of = np.unique(np.stack([c.astype(np.int64), k.astype(np.int64), node]), axis=1, return_inverse=True)
            for i, key in enumerate(zip(*keys.tolist(), strict=True)):
                own = np.flatnonzero(of.ravel() == i)
                full = at.setdefault(key, np.zeros((3, starts[-1]), np.int64))
                full[:, starts[j[own]] + bin_[own]] += np.stack(ghn)[:, own]
        found = []
        for (c, k, node), full in at.items():
            g, h, n = full[0] / GRID, full[1] / GRID, full[2].astype(float)
            first = slice(0, starts[1])  # every row is in one bin of each column
            total = (g[first].sum(), h[first].sum(), int(n[first].sum()))
            gain, split = boosters[c].best({j: tuple(v[starts[j] : starts[j + 1]] for v in (g, h, n)) for j in columns[c]}, *total)
            found.append((c, k, node, gain, *(split or (-1, -1, True, 0.0, 0.0, 0)), *total))
        if found:
            schema = [(name, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[kind]) for name, kind in (x.split() for x in SPLIT.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*found, strict=True), schema, strict=True)], schema=pa.schema(schema))

    return sums.select("cell", "output", "node", "feature", "bin", "g", "h", "n").mapInArrow(one, SPLIT)


def staged(rows: DataFrame, plans: list[Plan], features: int) -> DataFrame:
    """``rows`` written anew with every cell's scores so far (``raw``), which cuts lineage; the first time these are the cells' bases."""
    spark, had = rows.sparkSession, "raw" in rows.columns
    offsets = np.concatenate([[0], np.cumsum([p.outputs for p in plans])]).astype(int)
    base = np.concatenate([p.booster.base for p in plans if p.booster] or [np.zeros(0)])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = unpacked(b.column("codes"), np.int16, features)
            raw = unpacked(b.column("raw"), np.float64, int(offsets[-1])).copy() if had else np.tile(base, (b.num_rows, 1))
            for c, p in enumerate(plans):
                if p.booster:
                    raw[:, offsets[c] : offsets[c + 1]] = scores(p, codes, raw[:, offsets[c] : offsets[c + 1]])
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in ("row_id", "slot", "y", "codes")], packed(raw)], ["row_id", "slot", "y", "codes", "raw"])

    path = scratch(spark, "boosting-rows")
    rows.mapInArrow(one, BINNED + ", raw binary").write.option("compression", "zstd").parquet(path)
    for p in plans:
        p.routes = []
    return spark.read.schema(BINNED + ", raw binary").parquet(path)


def targets(rows: DataFrame, cells: dict[str, set[int]], kind: str, params: dict, seed: int) -> list[Plan]:
    """The cells with the range, classes and base of their targets, from counts by slot."""
    by_slot = rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum(F.rint(F.col("y") * GRID).cast("long")).alias("total"), F.min("y").alias("lo"), F.max("y").alias("hi")).collect()  # a row a slot
    classes = rows.groupBy("slot", "y").agg(F.count(F.lit(1)).alias("n")).collect() if kind == "classification" else []  # a row a slot and class
    plans = []
    for name, slots in cells.items():
        p = Plan(name, frozenset(slots))
        own = [r for r in by_slot if r.slot in slots]
        plans.append(p)
        if not own:
            p.lo = float("nan")
            continue
        n, p.lo, p.hi = sum(r.n for r in own), min(r.lo for r in own), max(r.hi for r in own)
        p.labels = sorted({r.y for r in classes if r.slot in slots})
        if p.lo < p.hi:
            p.booster = Booster(**params, seed=seed, classes=len(p.labels))
            if p.labels:
                p.booster.base = np.log(np.maximum(np.array([sum(r.n for r in classes if r.slot in slots and r.y == v) for v in p.labels]) / n, 1e-9))
            else:
                p.booster.base = np.array([np.rint(sum(r.total for r in own) / n) / GRID])
    return plans


def fit(rows: DataFrame, features: list[str], cells: dict[str, set[int]], kind: str, params: dict, seed: int = 42, cuts: list[np.ndarray] | None = None) -> dict[str, Head]:
    """A head for each cell (name: the slots it trains on) of ``rows`` (row_id, slot, y, features), all grown in the same passes."""
    probe = Booster(**params, seed=seed)
    cuts = cuts_of(rows, features, probe.p["bins"]) if cuts is None else cuts
    widths = [len(c) + 2 for c in cuts]
    coded = binned(rows, features, cuts)
    path = scratch(rows.sparkSession, "binned")
    coded.write.option("compression", "zstd").parquet(path)
    coded = rows.sparkSession.read.schema(BINNED).parquet(path)
    plans = targets(coded, cells, kind, params, seed)
    learning = [p for p in plans if p.booster]
    now = staged(coded, learning, len(features)) if learning else coded
    trees: list[list[list[Tree]]] = [[] for _ in learning]  # apart from the boosters, which go to every task
    rng = np.random.default_rng(seed)
    for round_ in range(probe.p["n"] if learning else 0):
        if round_ and round_ % STAGE_EVERY == 0:
            now = staged(now, learning, len(features))
        col = probe.p["col"]
        columns = sorted(rng.choice(len(features), max(1, int(len(features) * col)), replace=False).tolist()) if col < 1 else list(range(len(features)))
        grown = {(c, k): Growth() for c, p in enumerate(learning) for k in range(p.outputs)}
        for p in learning:
            p.columns = columns
        while asked := {key: (g, nodes) for key, g in grown.items() if g.done is None and (nodes := g.wanted(probe.p["leaves"]))}:
            sums = node_sums(now, learning, asked, widths, (round_, seed, probe.p["sub"]))
            got = best_splits(sums, learning, widths).collect()  # a row a node
            if len({(r.cell, r.output, r.node) for r in got}) < len(got):
                raise RuntimeError("a node's sums came from two tasks")
            for r in got:
                split = None if r.feature < 0 else (r.feature, r.at, r.missing_left)
                grown[r.cell, r.output].known[r.node] = (r.gain, split, (r.g, r.h, r.n), (r.lg, r.lh, r.ln))
            for key, (g, nodes) in asked.items():
                for node in nodes:  # no row drawn there
                    g.known.setdefault(node, (1e-12, None, (0.0, 0.0, 0), (0.0, 0.0, 0)))
        for c, p in enumerate(learning):
            made = [grown[c, k].tree(p.booster, cuts) for k in range(p.outputs)]
            trees[c].append([t for t, _, _ in made])
            p.routes.append([(splits, leaves) for _, splits, leaves in made])
    for p, own in zip(learning, trees, strict=True):
        p.booster.trees = own
    return {p.name: head(p, kind, params, seed) for p in plans if p.lo == p.lo}


def head(p: Plan, kind: str, params: dict, seed: int) -> Head:
    h = Head(kind, params, seed)
    h.lo, h.hi, h.labels, h.constant = p.lo, p.hi, np.array(p.labels or [p.lo]), p.booster is None
    if p.booster:
        h.model = p.booster
    return h


def predicted(rows: DataFrame, features: list[str], heads: dict[str, Head], tests: dict[str, set[int]]) -> DataFrame:
    """Every row by each cell that tests its slot: cell, row_id, y_true, y_pred; a row may be scored by several cells, or by none."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, slot = matrix(b, features), b.column("slot").cast(pa.int64()).fill_null(-1).to_numpy()
            for cell, slots in tests.items():
                own = np.flatnonzero(np.isin(slot, list(slots)) & (slot >= 0))
                if len(own) and cell in heads:
                    y = np.asarray(heads[cell].predict(x[own]), float)
                    take = pa.array(own)
                    yield pa.RecordBatch.from_arrays([pa.array([cell] * len(own)), *[b.column(c).take(take) for c in ("row_id", "slot", "y")], pa.array(y)], ["cell", "row_id", "slot", "y_true", "y_pred"])

    kept = rows.select(F.col("row_id").cast("long"), F.col("slot").cast("int"), F.col("y").cast("double"), *features)
    return kept.mapInArrow(one, "cell string, row_id long, slot int, y_true double, y_pred double")


def nested(folds: list[int]) -> tuple[dict[str, set[int]], dict[str, set[int]]]:
    """Training and test slots of nested grouped folds over slots that are folds.

    ``outer-o`` trains on all folds but o and tests o. ``inner-i-o`` (i < o) trains on all but both: it tests fold i as an inner
    fold of outer fold o, and fold o as one of outer fold i, so one head serves both.
    """
    train = {f"outer-{o}": set(folds) - {o} for o in folds} | {f"inner-{i}-{o}": set(folds) - {i, o} for i in folds for o in folds if i < o}
    return train, {c: set(folds) - s for c, s in train.items()}


def by_outer(out: DataFrame) -> DataFrame:
    """Predictions of nested cells with ``outer``, the outer fold that they serve, and ``inner``, the inner fold tested (null: the outer one)."""
    i, o = (F.split_part("cell", F.lit("-"), F.lit(k)).try_cast("int") for k in (2, 3))
    inner = F.col("cell").startswith("inner")
    return out.withColumns({"outer": F.when(inner, F.when(F.col("slot") == i, o).otherwise(i)).otherwise(i), "inner": F.when(inner, F.col("slot"))})


def official(folds: list[int], others: dict[str, int]) -> tuple[dict[str, set[int]], dict[str, set[int]]]:
    """The official protocol with inner folds: slots ``folds`` are the train split's rows by grouped fold, ``others`` the other splits' slots.

    ``oof-f`` gives the train rows of fold f a prediction by the other folds, ``full`` gives all other splits one by the whole train split.
    """
    train = {f"oof-{f}": set(folds) - {f} for f in folds} | {"full": set(folds)}
    return train, {f"oof-{f}": {f} for f in folds} | {"full": set(others.values())}


def crossed(k: int) -> tuple[dict[str, set[int]], dict[str, set[int]]]:
    """Two cross-validations over the same rows, by slots grouped fold x k + stratified fold: cells ``grouped-f`` and ``stratified-f``."""
    slots = range(k * k)
    tests = {f"grouped-{f}": {s for s in slots if s // k == f} for f in range(k)} | {f"stratified-{f}": {s for s in slots if s % k == f} for f in range(k)}
    return {c: set(slots) - s for c, s in tests.items()}, tests
