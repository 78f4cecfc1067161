"""Manifests, reports, JSON lines and pinned files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST_FIELDS = (
    "dataset_id", "title", "owner", "url", "license", "role", "status", "downloaded_at", "version", "file_count", "row_count",
    "column_count", "missing_cells", "duplicate_rows", "date_range", "bytes", "notes",
)


def manifest(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """A dataset manifest, one row an entry, all fields as text. Unknown fields are refused."""
    strange = {k for e in entries for k in e} - set(MANIFEST_FIELDS)
    if strange:
        raise ValueError(f"unknown manifest fields: {sorted(strange)}")
    rows = [tuple(None if e.get(f) is None else str(e[f]) for f in MANIFEST_FIELDS) for e in entries]
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in MANIFEST_FIELDS))


def write_manifest(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(", ".join(f"{f} string" for f in MANIFEST_FIELDS)).csv(path)


def write_report(path: str, report: dict) -> None:
    """A JSON report on the driver; NaN is refused."""
    text = json.dumps(report, indent=2, allow_nan=False, default=str)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text + "\n")


def fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, bytes, sha256 of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def drifted(spark: SparkSession, pinned: DataFrame) -> DataFrame:
    """Rows of pinned (path, sha256) whose file now differs or is gone."""
    paths = [r.path for r in pinned.select("path").collect()]  # a pinned list is a handful of files
    now = fingerprints(spark, paths).select(F.col("path").alias("_p"), F.col("sha256").alias("_now"))
    return pinned.join(now, F.col("path") == F.col("_p"), "left").where(~F.col("sha256").eqNullSafe(F.col("_now"))).select("path", "sha256", F.col("_now").alias("now"))


def load_pinned(path: str, sha256: str) -> list[dict]:
    """Cases of a pinned JSON file with distinct ids and questions and canonical plans; ValueError otherwise."""
    from gristmill.plans.query_plan import validate

    with open(path, "rb") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError("the file is not the pinned one")
    cases = json.loads(data)
    for key in ("id", "question"):
        if len({c[key] for c in cases}) != len(cases):
            raise ValueError(f"{key} repeats")
    for case in cases:
        if validate(case["expected"]) != case["expected"]:
            raise ValueError(f"{case['id']}: the label is not canonical")
    return cases


def splits(df: DataFrame, key: str, shares: dict[str, float], seed: int = 4200) -> DataFrame:
    """df with a column split: rows ranked by a hash of seed and key, cut at the shares. The same rows always fall alike.

    The rank is by percent of the hash range, so no global sort is needed and the shares hold on average.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / float(1 << 52)
    out, upto, total = None, 0.0, sum(shares.values())
    for name, share in shares.items():
        upto += share / total
        out = F.when(place < upto, name) if out is None else out.when(place < upto, name)
    return df.withColumn("split", F.coalesce(out, F.lit(list(shares)[-1])))


def exact_splits(df: DataFrame, key: str, counts: dict[str, int], seed: int = 4200) -> DataFrame:
    """As splits, with exact counts, for small corpora: one ordered pass."""
    rank = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), key), key))
    out, upto = None, 0
    for name, n in counts.items():
        upto += n
        out = F.when(F.col("_rank") <= upto, name) if out is None else out.when(F.col("_rank") <= upto, name)
    return df.withColumn("_rank", rank).withColumn("split", out).where("split is not null").drop("_rank")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, one folder a split, nulls kept."""
    df.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", False).json(path)
