"""Quantile forecasts: gradient-boosted trees with pinball loss, in numpy, one series at a time.

Spark has no quantile boosting, so each series (or each fold of one) is a group of applyInPandas: groups are
small and independent, and their number is what scales.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gristmill.functions.timeseries import FIRST_T, HORIZON, MIN_TRAIN, SEASON, STEP, folds
from gristmill.session import ship

QUANTILES = (0.1, 0.5, 0.9)
ROUNDS, LEAVES, LEAF_ROWS, L2, SHRINK = 60, 7, 5, 1.0, 0.1
SPARSE, BAND_ROWS = 56, 14
NOTE = "Bands are conditional quantile estimates; check their empirical coverage."
SPARSE_NOTE = "Sparse history: fewer than 56 days, seasonal naive only."
BAND_NOTE = "Too few residuals for a band."
SPIKE_NOTE = "Recent demand spike: past patterns may understate demand."


def checked(history) -> np.ndarray:
    """A finite, non-negative, non-empty series, or ValueError."""
    y = np.asarray(history, dtype=float)
    if y.ndim != 1 or y.size == 0 or not np.all(np.isfinite(y)) or y.min() < 0:
        raise ValueError("a daily series must be non-empty, finite and non-negative")
    return y


def naive(history, horizon: int = HORIZON, season: int = SEASON) -> list[float]:
    y = checked(history)
    return np.resize(y[-min(len(y), season) :], horizon).tolist()


def lag_row(y: np.ndarray, t: int) -> list[float]:
    """Features of day t from the days before it."""
    return [y[t - 1], y[t - 7], y[t - 14], y[t - 7 : t].mean(), y[t - 14 : t].mean(), float(t % SEASON)]


@dataclass(eq=False)
class Leaf:
    rows: np.ndarray
    value: float = 0.0
    gain: float = 0.0
    split: tuple[int, float] | None = None
    kids: tuple[Leaf, Leaf] | None = None


class Boosted:
    """Pinball-loss boosting. Trees grow at the leaf of largest gain; a leaf's value is the quantile of its residuals."""

    def __init__(self, quantile: float):
        self.quantile = quantile
        self.trees: list[Leaf] = []

    def _best(self, x: np.ndarray, g: np.ndarray, leaf: Leaf) -> Leaf:
        """Fills in the split of largest gain under unit curvature."""
        n = len(leaf.rows)
        if n < 2 * LEAF_ROWS:
            return leaf
        total = g[leaf.rows].sum()
        for f in range(x.shape[1]):
            order = leaf.rows[np.argsort(x[leaf.rows, f], kind="stable")]
            v, left = x[order, f], np.cumsum(g[order])[:-1]
            k = np.arange(1, n)
            gain = left**2 / (k + L2) + (total - left) ** 2 / (n - k + L2) - total**2 / (n + L2)
            gain[(k < LEAF_ROWS) | (n - k < LEAF_ROWS) | (v[1:] == v[:-1])] = 0
            i = int(gain.argmax())
            if gain[i] > leaf.gain + 1e-12:
                leaf.gain, leaf.split = float(gain[i]), (f, (v[i] + v[i + 1]) / 2)
        return leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.start = float(np.quantile(y, self.quantile))
        now = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            g = np.where(y > now, -self.quantile, 1 - self.quantile)
            root = self._best(x, g, Leaf(np.arange(len(y))))
            leaves = [root]
            while len(leaves) < LEAVES:
                leaf = max(leaves, key=lambda n: n.gain)
                if leaf.split is None:
                    break
                f, at = leaf.split
                low = x[leaf.rows, f] <= at
                leaf.kids = tuple(self._best(x, g, Leaf(leaf.rows[m])) for m in (low, ~low))
                leaves.remove(leaf)
                leaves += leaf.kids
            for leaf in leaves:
                leaf.value = SHRINK * float(np.quantile(y[leaf.rows] - now[leaf.rows], self.quantile))
                now[leaf.rows] += leaf.value
            self.trees.append(root)
        return self

    def predict(self, row: list[float]) -> float:
        out = self.start
        for node in self.trees:
            while node.kids:
                f, at = node.split
                node = node.kids[int(row[f] > at)]
            out += node.value
        return out


def spiking(y: np.ndarray) -> bool:
    return y[-7:].mean() > 1.75 * max(y[-28:-7].mean(), 1) or y[-1] > 2 * max(y[-8:-1].mean(), 1)


def by_residuals(y: np.ndarray, horizon: int) -> np.ndarray:
    """Rows of lower, point and upper: the naive forecast, and around it the quantiles of its past errors; without enough of those, no band (nan)."""
    point = np.array(naive(y, horizon))
    errors = y[SEASON:] - y[:-SEASON]
    off = np.quantile(errors, [QUANTILES[0], QUANTILES[-1]]) if len(errors) >= BAND_ROWS else np.full(2, np.nan)
    return np.stack([np.maximum(0.0, point + np.minimum(0.0, off[0])), point, point + np.maximum(0.0, off[1])], axis=1)


def by_boosting(y: np.ndarray, horizon: int) -> np.ndarray:
    """The same from one boosted model a quantile, day by day: each median is history for the day after."""
    rows = np.array([lag_row(y, t) for t in range(FIRST_T, len(y))])
    models = [Boosted(q).fit(rows, y[FIRST_T:]) for q in QUANTILES]
    days = np.concatenate([y, np.zeros(horizon)])
    out = np.zeros((horizon, len(models)))
    for i in range(horizon):
        row = lag_row(days[: len(y) + i], len(y) + i)
        out[i] = np.sort(np.maximum(0.0, [m.predict(row) for m in models]))
        days[len(y) + i] = out[i, 1]
    return out


def forecast(history, horizon: int = HORIZON) -> dict:
    """method, point, lower, upper, baseline, warnings, quantiles, history_days."""
    y = checked(history)
    if not isinstance(horizon, int) or isinstance(horizon, bool) or not 1 <= horizon <= 90:
        raise ValueError("the horizon must be 1 to 90 days")
    sparse = len(y) < SPARSE
    method, bands = ("seasonal_naive", by_residuals(y, horizon)) if sparse else ("quantile_boosted_trees", by_boosting(y, horizon))
    unknown = bool(np.isnan(bands).any())
    held = {NOTE: True, SPARSE_NOTE: sparse, BAND_NOTE: unknown, SPIKE_NOTE: not sparse and spiking(y)}
    columns = {name: [None if np.isnan(v) else float(v) for v in column] for name, column in zip(("lower", "point", "upper"), bands.T, strict=True)}
    return {"method": method, **columns, "baseline": naive(y, horizon), "warnings": [note for note, holds in held.items() if holds], "quantiles": list(QUANTILES), "history_days": len(y)}


def fold(history, origin: int, horizon: int = HORIZON) -> dict:
    """Errors of the forecast from the days before origin; the field names are fixed values."""
    y = checked(history)
    days = slice(origin, origin + horizon)
    made = forecast(y[:origin], horizon)
    lower, upper, point, plain = (np.array(made[c], float) - y[days] for c in ("lower", "upper", "point", "baseline"))  # against the truth
    covered = None if np.isnan(lower).any() else float(np.mean((lower <= 0) & (upper >= 0)))
    return {
        "train_end_index": days.start - 1, "test_start_index": days.start, "test_end_index": days.stop - 1,
        "mae": float(np.abs(point).mean()), "baseline_mae": float(np.abs(plain).mean()), "interval_coverage": covered,
    }


def walk_forward(history, horizon: int = HORIZON, min_train: int = MIN_TRAIN, step: int = STEP) -> dict:
    """The folds of a history and their mean errors; the field names are fixed values."""
    origins = range(min_train, len(checked(history)) - horizon + 1, step)
    table = pd.DataFrame([fold(history, origin, horizon) for origin in origins])
    means = {f"mean_{c}": None if table.empty else float(table[c].mean()) for c in ("mae", "baseline_mae")}
    return {"folds": [fold_ | {"interval_coverage": None if pd.isna(fold_["interval_coverage"]) else fold_["interval_coverage"]} for fold_ in table.to_dict("records")], **means, "warning": None if len(origins) else "There is too little history to walk through."}


def forecast_series(df: DataFrame, key: str, horizon: int = HORIZON) -> DataFrame:
    """key, step, lower, point, upper, method for every series of df (key, t, y)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        made = forecast(pdf.sort_values("t")["y"].to_numpy(), horizon)
        return pd.DataFrame({key: pdf[key].iloc[0], "step": range(1, horizon + 1), **{c: pd.array(made[c], "Float64") for c in ("lower", "point", "upper")}, "method": made["method"]})

    ship(df.sparkSession)
    return df.select(key, "t", "y").groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, step int, lower double, point double, upper double, method string")


def walk_forward_series(df: DataFrame, key: str, horizon: int = HORIZON) -> DataFrame:
    """key, origin, mae, baseline_mae, interval_coverage: every fold of every series is a task's group of its own."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, o, *(fold(ys, int(o), horizon)[c] for c in ("mae", "baseline_mae", "interval_coverage"))) for k, o, ys in zip(pdf[key], pdf["origin"], pdf["ys"], strict=True)]
        return pd.DataFrame(rows, columns=[key, "origin", "mae", "baseline_mae", "interval_coverage"])

    ship(df.sparkSession)
    return folds(df, key, horizon).groupBy(key, "origin").applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, origin int, mae double, baseline_mae double, interval_coverage double")
