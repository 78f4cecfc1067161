"""Calibrated risk scores and review rules.

Two-feature logistic models are fitted on simulated rows on the driver, by Newton's method, and calibrated by
Platt's sigmoid. A fitted model is four numbers and a scale, so scoring is a Catalyst expression:
whole tables are assessed inside code generation, without Python on the executors.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.catalog import SEED

# Features, thresholds and rules of each kind.
FEATURES = {
    "stockout": ("days_of_cover", "inventory_age_days"),
    "late_delivery": ("distance_km", "traffic_index"),
    "supplier_reliability": ("late_delivery_rate", "evaluable_shipments"),
}
HIGH, MEDIUM = 0.65, 0.3
#: (field, comparison, bound, text): what keeps a row from being scored, absent fields counting as 0.
BLOCKERS = {
    "stockout": [("inventory_age_days", operator.gt, 3, "fresh inventory (at most 3 days old)")],
    "late_delivery": [],
    "supplier_reliability": [
        ("evaluable_shipments", operator.lt, 10, "at least 10 evaluable shipments"),
        ("missing_or_invalid_shipments", operator.gt, 0, "Resolve excluded shipment records before assessing supplier reliability."),
    ],
}
#: What makes a clean row high, whatever its score.
RULES = {
    "stockout": [("days_of_cover", operator.lt, 14, "Rule: fewer than 14 days of inventory coverage")],
    "late_delivery": [("traffic_index", operator.gt, 0.8, "Rule: traffic index above 0.8")],
    "supplier_reliability": [
        ("late_delivery_rate", operator.gt, 0.3, "Rule: observed late-delivery rate above 0.3 with at least 10 deliveries"),
        ("recent_delay_events", operator.ge, 3, "Rule: at least three supplier delay events in the past seven days"),
    ],
}
TRAIN, CALIBRATE, TEST = 720, 240, 240
SOURCE_RULE, SOURCE_MODEL = "data_quality_rule_v1", "simulated_logistic_sigmoid_v1 + review_rules_v1"
ASSUMPTION = "Simulated training data; not validated for real operations."


def simulated(kind: str, seed: int = SEED, size: int = TRAIN + CALIBRATE + TEST) -> tuple[np.ndarray, np.ndarray]:
    """Features and outcomes drawn from the kind's simulation."""
    rng = np.random.default_rng(seed)

    def stockout():
        cover, age = rng.uniform(0, 40, size), rng.integers(0, 15, size)
        return cover, age, cover < rng.normal(14, 4, size) + 0.3 * age

    def late_delivery():
        km, traffic = rng.uniform(50, 1000, size), rng.uniform(0, 1, size)
        return km, traffic, rng.binomial(1, 1 / (1 + np.exp(3 - km / 650 - 3 * traffic)))

    def supplier_reliability():
        rate, n = rng.uniform(0, 1, size), rng.integers(5, 200, size)
        return rate, n, rng.binomial(20, rate) > 6

    draws = {"stockout": stockout, "late_delivery": late_delivery, "supplier_reliability": supplier_reliability}
    if kind not in draws:
        raise ValueError(f"unknown risk kind: {kind}")
    a, b, y = draws[kind]()
    return np.column_stack([a, b]).astype(float), np.asarray(y).astype(float)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights, intercept last and not shrunk, of the minimum of the log loss plus ridge / 2 times their squares; y may be soft."""
    design = np.column_stack([x, np.ones(len(x))])
    shrink = np.diag([ridge] * x.shape[1] + [0.0])
    w = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + shrink + 1e-12 * np.eye(len(w)), design.T @ (p - y) + shrink @ w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


@dataclass(frozen=True)
class Model:
    kind: str
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    sigmoid: tuple[float, float]
    brier: float

    def probability(self, *features: float) -> float:
        margin = sum(w * (v - m) / s for w, v, m, s in zip(self.weights, features, self.mean, self.scale, strict=False)) + self.weights[-1]
        return 1 / (1 + math.exp(-(self.sigmoid[0] * margin + self.sigmoid[1])))

    def expression(self) -> Column:
        margin = F.lit(self.weights[-1])
        for name, w, m, s in zip(FEATURES[self.kind], self.weights, self.mean, self.scale, strict=False):
            margin = margin + F.lit(w / s) * (F.col(name).cast("double") - m)
        return 1 / (1 + F.exp(-(self.sigmoid[0] * margin + self.sigmoid[1])))


def fit(kind: str) -> Model:
    """Train on the first rows, calibrate on the next, score the rest."""
    x, y = simulated(kind)
    mean, scale = x[:TRAIN].mean(0), x[:TRAIN].std(0)
    z = (x - mean) / scale
    w = logistic(z[:TRAIN], y[:TRAIN], 1.0)
    margin = z @ w[:-1] + w[-1]
    held = slice(TRAIN, TRAIN + CALIBRATE)
    ones = y[held].sum()
    soft = np.where(y[held] == 1, (ones + 1) / (ones + 2), 1 / (CALIBRATE - ones + 2))
    a, b = logistic(margin[held, None], soft, 0.0)
    test = slice(TRAIN + CALIBRATE, None)
    brier = float(((1 / (1 + np.exp(-(a * margin[test] + b))) - y[test]) ** 2).mean())
    return Model(kind, tuple(mean), tuple(scale), tuple(w), (float(a), float(b)), brier)



def _or_zero(name: str, columns: list[str]) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) if name in columns else F.lit(0)


def missing_evidence(kind: str, columns: list[str]) -> Column:
    """Array of what stands in the way of a score, in order; empty if nothing does."""
    value = lambda c: F.col(c).cast("double")
    bad = lambda c: F.col(c).isNull() | F.isnan(value(c)) | (F.abs(value(c)) == float("inf"))
    reasons = [F.when(bad(c), c) for c in FEATURES[kind]]
    if "data_quality_flag" in columns:
        flag = F.coalesce("data_quality_flag", F.lit("ok"))
        reasons.append(F.when(flag != "ok", F.concat(F.lit("valid evidence: "), flag)))
    reasons += [F.when(holds(_or_zero(c, columns), bound), text) for c, holds, bound, text in BLOCKERS[kind]]
    return F.array_compact(F.array(*reasons))


def assess(df: DataFrame, model: Model) -> DataFrame:
    """df with risk_type, risk_level, drivers, missing_information, recommended_review, source, assumptions."""
    kind, columns = model.kind, df.columns
    lacking = F.size("missing_information") > 0
    rules = [(holds(_or_zero(c, columns), bound), text) for c, holds, bound, text in RULES[kind]]
    by_rule = F.lit(False)
    for hit, _ in rules:
        by_rule = by_rule | hit
    p = F.col("_p")
    level = F.when(lacking, "unknown").when(by_rule | (p >= HIGH), "high").when(p >= MEDIUM, "medium").otherwise("low")
    shown = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in FEATURES[kind]]
    drivers = F.when(lacking, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*shown, *(F.when(hit, text) for hit, text in rules))))
    judged = df.withColumn("missing_information", missing_evidence(kind, columns)).withColumn("_p", model.expression())
    done = judged.withColumns({"risk_type": F.lit(kind), "risk_level": level, "drivers": drivers, "source": F.when(lacking, SOURCE_RULE).otherwise(SOURCE_MODEL), "assumptions": F.array(F.lit(ASSUMPTION))})
    return done.withColumn("recommended_review", F.col("risk_level") != "low").drop("_p")


def assess_row(model: Model, row: dict) -> dict:
    """The record of one evidence row, for answers of a few hundred rows."""
    kind = model.kind
    features = [row.get(c) for c in FEATURES[kind]]
    missing = [c for c, v in zip(FEATURES[kind], features, strict=True) if v is None or not math.isfinite(v)]
    flag = row.get("data_quality_flag") or "ok"
    missing += [f"valid evidence: {flag}"] if flag != "ok" else []
    missing += [text for c, holds, bound, text in BLOCKERS[kind] if holds(row.get(c) or 0, bound)]
    level, drivers = "unknown", []
    if not missing:
        hits = [text for c, holds, bound, text in RULES[kind] if holds(row.get(c) or 0, bound)]
        p = model.probability(*features)
        level = "high" if hits or p >= HIGH else "medium" if p >= MEDIUM else "low"
        drivers = [f"{c}={v}" for c, v in zip(FEATURES[kind], features, strict=True)] + hits
    return {
        "risk_type": kind, "risk_level": level, "drivers": drivers, "evidence_rows": [dict(row)], "missing_information": missing,
        "recommended_review": level != "low", "source": SOURCE_RULE if missing else SOURCE_MODEL, "assumptions": [ASSUMPTION],
    }
