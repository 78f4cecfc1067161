"""Dataset profiles: rows, columns, missing cells, duplicate rows and date ranges of any readable file."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE_WORDS = ("date", "timestamp", "time_stamp")
#: Formats that a date column may mix, tried in order.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "dd-MM-yyyy")


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All cells as text; a byte-order mark is dropped, bad bytes are replaced, bad rows are kept.

    multiline: cells may hold line ends. Such a file is read by one task; without it, files are split.
    """
    return spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").option("encoding", "UTF-8").option("multiLine", multiline).option("escape", '"').csv(path)


def parsed_date(column: str) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.col(column).cast("string"), F.lit(f)) for f in DATE_FORMATS))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """duplicate_rows: k copies of a row count k - 1. Grouping treats nulls as equal, and as no literal.

    Rows are counted by a 128-bit digest that marks nulls, so wide rows do not travel, and equal rows combine before the shuffle.
    """
    cell = lambda c: F.coalesce(F.concat(F.lit("v"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("n"))
    key = F.md5(F.concat_ws(",", *(cell(f"`{c}`") for c in df.columns)).cast("binary"))
    return df.select(key.alias("k")).groupBy("k").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def date_columns(df: DataFrame) -> list[str]:
    """Columns that are named like dates."""
    return [c for c in df.columns if any(w in c.lower() for w in DATE_WORDS)]


def profile_frame(df: DataFrame, source: str) -> DataFrame:
    """One row: source, rows, columns, missing_cells, duplicate_rows, date_column, first_date, last_date, date_ranges.

    date_ranges holds (column, first, last) of every column named like a date with any value that parses; bounds are days, over
    all values that parse. date_column, first_date and last_date are the first such column's.
    """
    missing = F.lit(0).cast("long")
    for c in df.columns:
        missing = missing + F.col(f"`{c}`").isNull().cast("long")
    dated = date_columns(df)
    day = lambda f, c: f(parsed_date(f"`{c}`")).cast("date").cast("string")
    kind = "array<struct<column: string, first: string, last: string>>"
    ranges = F.array(*(F.struct(F.lit(c).alias("column"), day(F.min, c).alias("first"), day(F.max, c).alias("last")) for c in dated)).cast(kind)
    sums = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"), ranges.alias("_ranges"))
    joined = sums.crossJoin(F.broadcast(duplicate_rows(df)))  # one row on each side
    first = lambda part: F.try_element_at("_ranges", F.lit(1))[part]
    return joined.select(
        F.lit(source).alias("source"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "missing_cells", "duplicate_rows",
        first("column").alias("date_column"), first("first").alias("first_date"), first("last").alias("last_date"), F.filter("_ranges", lambda r: r["first"].isNotNull()).alias("date_ranges"),
    )


def profile_file(spark: SparkSession, path: str, multiline: bool = False) -> list[DataFrame]:
    """Profiles of a file by its suffix: CSV, Parquet, JSON lines, and each sheet of a workbook where pandas can open one; none otherwise."""
    name, suffix = PurePosixPath(path).name, PurePosixPath(path).suffix.lower()
    readers = {".csv": lambda: read_csv(spark, path, multiline), ".parquet": lambda: spark.read.parquet(path), ".json": lambda: spark.read.json(path), ".jsonl": lambda: spark.read.json(path)}
    if suffix in readers:
        return [profile_frame(readers[suffix](), name)]
    if suffix in (".xlsx", ".xls"):
        import pandas as pd

        try:
            sheets = pd.read_excel(path, sheet_name=None, dtype=str)
        except ImportError as e:
            raise RuntimeError("workbooks need an Excel reader for pandas") from e
        return [profile_frame(spark.createDataFrame(sheet.where(sheet.notna(), None).astype(object), ", ".join(f"`{c}` string" for c in sheet)), f"{name}:{title}") for title, sheet in sheets.items()]
    return []
