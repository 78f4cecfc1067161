"""The canonical store: one Parquet folder a table, published whole.

Tables are written into a staging folder beside the target and renamed over it, so readers see the old
store or the new one. Paths go through Hadoop's file system, so any store that Spark can write will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.catalog import AS_OF, PROVENANCE, TABLES, VIEWS, struct
from gristmill.operators.quality import flag_quality, with_provenance
from gristmill.operators.views import view_frames
from gristmill.sources.synthetic import synthetic_tables


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], replace: bool = False) -> str:
    """Write the tables under path, all or nothing. FileExistsError where path exists, unless replace."""
    fs, at = _files(spark, path)
    if fs.exists(at(path)) and not replace:
        raise FileExistsError(f"{path} exists; pass replace=True to rebuild it")
    staging = f"{path.rstrip('/')}._staging-{uuid.uuid4().hex}"
    old = f"{path.rstrip('/')}._old-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{staging}/{name}")
        if fs.exists(at(path)):
            fs.rename(at(path), at(old))
        if not fs.rename(at(staging), at(path)):
            raise OSError(f"could not publish {path}")
    finally:
        fs.delete(at(staging), True)
        if fs.exists(at(old)):
            if fs.exists(at(path)):
                fs.delete(at(old), True)
            else:
                fs.rename(at(old), at(path))
    return path


def canonical(tables: dict[str, DataFrame], as_of: str = AS_OF, dataset: str = "synthetic") -> dict[str, DataFrame]:
    """Raw canonical tables with provenance and quality flags, in canonical column order."""
    framed = flag_quality({name: with_provenance(df, name, as_of, dataset) for name, df in tables.items()}, as_of)
    return {name: df.select(*TABLES[name], *PROVENANCE) for name, df in framed.items()}


def build_store(spark: SparkSession, path: str, tables: dict[str, DataFrame] | None = None, as_of: str = AS_OF, replace: bool = False) -> str:
    """Provenance, flags and an atomic publish of the canonical tables."""
    return publish(spark, path, canonical(tables or synthetic_tables(spark, as_of=as_of), as_of), replace)


def open_store(spark: SparkSession, path: str, as_of: str = AS_OF) -> dict[str, DataFrame]:
    """Read-only scans of all tables under their fixed schemas; the views are registered for SQL."""
    tables = {name: spark.read.schema(struct(columns | PROVENANCE)).parquet(f"{path}/{name}") for name, columns in TABLES.items()}
    for name, view in view_frames(tables, as_of).items():
        assert view.columns == list(VIEWS[name]), name
        view.createOrReplaceTempView(name)
    return tables


def introspect(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, data_type, position of every column."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, k, i) for t, df in tables.items() for i, (c, k) in enumerate(df.dtypes, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int").orderBy("table_name", F.col("position"))
