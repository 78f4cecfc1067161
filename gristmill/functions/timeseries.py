"""Daily series as DataFrame operators: spines, lags, naive forecasts, residual bands, spikes, folds.

A series is the rows of one key, with `t` its position from 0 and `y` its value. Windows partition by the
key, so a shuffle on it serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEASON, HORIZON, MIN_TRAIN, STEP = 7, 14, 84, 14
FIRST_T = 14


def spine(observed: DataFrame, key: str, day: str, units: str, first: str, last: str) -> DataFrame:
    """key, day, t, y on every day from first to last, 0 where nothing was observed."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")
    sums = observed.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy(key, F.col(day).alias("day")).agg(F.sum(units).alias("_u"))
    every = observed.select(key).distinct().select(key, days)
    return every.join(sums, [key, "day"], "left").select(key, "day", F.date_diff("day", F.lit(first).cast("date")).alias("t"), F.coalesce("_u", F.lit(0.0)).alias("y"))


def invalid_series(df: DataFrame, key: str, day: str = "day", y: str = "y", flag: str | None = None) -> DataFrame:
    """key and reason of the series that may not be forecast: gaps or repeats, negative or non-finite values, flags."""
    gap = F.date_diff(F.col(day), F.lag(day).over(Window.partitionBy(key).orderBy(day)))
    bad = F.col(y).isNull() | F.isnan(y) | (F.abs(y) == float("inf")) | (F.col(y) < 0)
    marks = df.select(key, (F.coalesce(gap, F.lit(1)) != 1).alias("gap"), bad.alias("bad"), ((F.col(flag) != "ok") if flag else F.lit(False)).alias("flagged"))
    sums = marks.groupBy(key).agg(*(F.max(c).alias(c) for c in ("gap", "bad", "flagged")))
    reason = F.when(F.col("bad"), "invalid value").when(F.col("gap"), "missing or duplicate day").when(F.col("flagged"), "flagged record")
    return sums.select(key, reason.alias("reason")).where("reason is not null")


def lag_features(df: DataFrame, key: str) -> DataFrame:
    """key, t, y, lag_1, lag_7, lag_14, mean_7, mean_14, phase for t from FIRST_T."""
    w = Window.partitionBy(key).orderBy("t")
    mean = lambda n: F.avg("y").over(w.rowsBetween(-n, -1))
    made = df.select(key, "t", "y", *(F.lag("y", n).over(w).alias(f"lag_{n}") for n in (1, 7, 14)), mean(7).alias("mean_7"), mean(14).alias("mean_14"), (F.col("t") % SEASON).alias("phase"))
    return made.where(F.col("t") >= FIRST_T)


def _arrays(df: DataFrame, key: str) -> DataFrame:
    """key and its values in order of t. A daily series is a few thousand values."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda s: s["y"]).alias("ys"))


def naive(ys: Column, horizon: int = HORIZON, season: int = SEASON) -> Column:
    """The last season repeated, as an array."""
    period = F.least(F.size(ys), F.lit(season))
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.element_at(ys, F.size(ys) - period + i % period + 1))


def seasonal_naive(df: DataFrame, key: str, horizon: int = HORIZON) -> DataFrame:
    """key, step (from 1), point."""
    points = _arrays(df, key).select(key, F.posexplode(naive(F.col("ys"), horizon)).alias("i", "point"))
    return points.select(key, (F.col("i") + 1).alias("step"), "point")


def residual_band(df: DataFrame, key: str, season: int = SEASON) -> DataFrame:
    """key, residuals, low and high: the 10 % and 90 % quantiles of y less y a season before, interpolated."""
    w = Window.partitionBy(key).orderBy("t")
    steps = df.select(key, (F.col("y") - F.lag("y", season).over(w)).alias("r")).where("r is not null")
    return steps.groupBy(key).agg(F.count("*").alias("residuals"), F.percentile("r", F.lit(0.1)).alias("low"), F.percentile("r", F.lit(0.9)).alias("high"))


def spikes(df: DataFrame, key: str) -> DataFrame:
    """key and whether its last days stand out against the weeks before."""
    mean = lambda a, from_end, to_end: F.aggregate(F.slice(a, F.size(a) - from_end + 1, from_end - to_end), F.lit(0.0), lambda s, x: s + x) / (from_end - to_end)
    one = F.lit(1.0)
    ys = F.col("ys")
    week = mean(ys, 7, 0) > 1.75 * F.greatest(mean(ys, 28, 7), one)
    day = F.element_at(ys, -1) > 2 * F.greatest(mean(ys, 8, 1), one)
    return _arrays(df, key).where(F.size("ys") >= 28).select(key, (week | day).alias("spike"))


def folds(df: DataFrame, key: str, horizon: int = HORIZON, min_train: int = MIN_TRAIN, step: int = STEP) -> DataFrame:
    """key, origin, ys: the training prefix's end for each walk-forward fold, with the whole series."""
    origins = F.when(F.size("ys") >= min_train + horizon, F.sequence(F.lit(min_train), F.size("ys") - horizon, F.lit(step)))
    return _arrays(df, key).select(key, "ys", F.explode(origins).alias("origin"))


def walk_forward_naive(df: DataFrame, key: str, horizon: int = HORIZON) -> DataFrame:
    """key, origin, baseline_mae of the naive forecast in each fold."""
    cut = folds(df, key, horizon).withColumn("points", naive(F.slice("ys", F.lit(1), F.col("origin")), horizon))
    errors = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.abs(F.element_at("ys", F.col("origin") + i) - F.element_at("points", i)))
    return cut.select(key, "origin", (F.aggregate(errors, F.lit(0.0), lambda s, x: s + x) / horizon).alias("baseline_mae"))
