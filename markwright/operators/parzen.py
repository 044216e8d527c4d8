"""Search over a head's settings in batches, by Parzen estimators of the good and the bad trials.

Each setting is placed on the unit interval (log scale where its bounds say so).
Trials so far are split by value into a good quarter and the rest; a mixture of
Gaussians around each side's settings, plus a flat part, is its density. Of the
candidates drawn from the good density, a batch takes those with the largest ratio
of good to bad; what the batch already holds counts as bad, so that it spreads. A
batch's trials are fitted in parallel Spark tasks; the driver sees a value a trial.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Space = dict[str, tuple]


def placed(options: dict, space: Space) -> np.ndarray:
    """Settings as a point of the unit cube."""
    out = []
    for name, (low, high, how) in space.items():
        ends = np.log([low, high, options[name]]) if how == "log" else np.array([low, high, options[name]], float)
        out.append((ends[2] - ends[0]) / (ends[1] - ends[0]))
    return np.array(out)


def read_off(point: np.ndarray, space: Space) -> dict:
    """The settings at a point; stepped ones go to the nearest step."""
    out = {}
    for x, (name, (low, high, how)) in zip(np.clip(point, 0, 1), space.items(), strict=True):
        if how == "log":
            out[name] = float(np.exp(np.log(low) + x * (np.log(high) - np.log(low))))
        elif how == "linear":
            out[name] = float(low + x * (high - low))
        else:
            out[name] = int(low + how * round(x * (high - low) / how))
    return out


def log_density(at: np.ndarray, points: np.ndarray, width: float) -> np.ndarray:
    """Log density at each row of ``at``, setting by setting: Gaussians around ``points`` and one flat part."""
    if not len(points):
        return np.zeros(len(at))
    near = np.exp(-0.5 * ((at[:, None, :] - points[None]) / width) ** 2) / (width * np.sqrt(2 * np.pi))
    return np.log((near.sum(1) + 1) / (len(points) + 1)).sum(1)


def propose(points: np.ndarray, values: np.ndarray, n: int, rng: np.random.Generator, candidates: int = 128, share: float = 0.25) -> np.ndarray:
    """n new points, given the points and values (larger is better, NaN worst) of finished trials."""
    d = points.shape[1]
    order = np.argsort(-np.nan_to_num(values, nan=-np.inf), kind="stable")
    good, bad = np.split(points[order], [max(1, int(np.ceil(share * len(points))))])
    width = float(np.clip(len(points) ** (-1 / (4 + d)) * 0.3, 0.05, 0.3))
    batch: list[np.ndarray] = []
    for _ in range(n):
        around = good[rng.integers(0, len(good), candidates)] + rng.normal(0, width, (candidates, d))
        drawn = np.where(rng.random((candidates, 1)) < 1 / (len(good) + 1), rng.random((candidates, d)), np.clip(around, 0, 1))
        against = np.vstack([bad, *batch]) if len(bad) or batch else bad  # pending trials count as bad ones
        batch.append(drawn[np.argmax(log_density(drawn, good, width) - log_density(drawn, against, width))])
    return np.array(batch)


def search(evaluate: Callable[[list[dict]], list[float]], space: Space, n: int, batch: int, seed: int, startup: int | None = None) -> list[dict]:
    """n trials in batches: trial, value and settings in the order tried. ``evaluate`` takes a batch's settings, larger values are better.

    The first ``startup`` trials (a batch, unless given) are drawn evenly. The same seed and values give the same trials.
    """
    rng = np.random.default_rng(seed)
    points, values, options = np.zeros((0, len(space))), np.zeros(0), []
    while len(options) < n:
        k = min(batch, n - len(options))
        new = rng.random((k, len(space))) if len(options) < (batch if startup is None else startup) else propose(points, values, k, rng)
        own = [read_off(p, space) for p in new]
        got = np.array(evaluate(own), float)
        points = np.vstack([points, [placed(o, space) for o in own]])
        values, options = np.concatenate([values, got]), options + own
    return [{"trial": i, "value": float(v), **o} for i, (v, o) in enumerate(zip(values, options, strict=True))]
