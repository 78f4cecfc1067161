"""Shared helpers: durable intermediate tables, hot-key lookups, Arrow batches."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.session import shared_folder, ship

#: White space of the text contracts: space and U+0009 to U+000D.
SPACES = " \t\n\v\f\r"
#: Rows in one Arrow batch. Texts reach about 100 KB, so a batch stays in the tens of MB.
BATCH_ROWS = 256
#: A key is hot when it holds more than one part in HOT_PARTS of all rows; at most HOT_PARTS keys can be.
HOT_PARTS = 1000


def tune(spark: SparkSession) -> None:
    """Session settings that the Python stages rely on: small Arrow batches and an adaptive plan."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    ship(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Lineage ends there: a lost executor costs a re-read, not a recomputation, and non-deterministic
    columns keep the values they had when written. The table goes when it is discarded, and at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _located(spark, path)
    fs.deleteOnExit(at)
    _WRITTEN.append(path)
    if (owner := _OWNER.get()) is not None:
        owner.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []
_OWNER: ContextVar[list[str] | None] = ContextVar("owner", default=None)


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written() -> list[str]:
    """Paths of the tables that materialize() wrote in this process and discard() has not deleted."""
    return list(_WRITTEN)


@contextmanager
def owned() -> Iterator[list[str]]:
    """The paths that materialize() writes in this block, and in this thread. What is left of them then belongs to the block around."""
    around, paths = _OWNER.get(), []
    token = _OWNER.set(paths)
    try:
        yield paths
    finally:
        _OWNER.reset(token)
        if around is not None:
            around.extend(paths)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete materialized tables that no plan reads any more."""
    for path in paths:
        fs, at = _located(spark, path)
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)
        _WRITTEN.remove(path)


def tidied(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator, whose intermediate tables go as soon as it returns, but for those that its result reads."""

    @wraps(operator)
    def run(*args, **named) -> DataFrame:
        with owned() as paths:
            result = operator(*args, **named)
            files = result.inputFiles()
            unread = [path for path in paths if not any(path.rsplit("/", 1)[1] in f for f in files)]
            discard(result.sparkSession, unread)
            paths[:] = [path for path in paths if path not in unread]
        return result

    return run


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, total: int) -> DataFrame:
    """Inner join of left with right, one row of right for each key, safe against hot keys.

    weight: the column of right that counts left's rows of the key. Keys above total / HOT_PARTS, so
    HOT_PARTS of them at most, are broadcast and their rows never move; the others shuffle in parts
    no larger than that. The weight column is dropped.
    """
    hot = F.col(weight) * HOT_PARTS > total
    few = right.where(hot).drop(weight)
    return left.join(F.broadcast(few), key).unionByName(
        left.join(F.broadcast(few.select(key)), key, "left_anti").join(right.where(~hot).drop(weight), key)
    )


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sha256_hex(text: str) -> str:
    """Of UTF-8; lone surrogates cannot occur in Spark strings."""
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow where make() runs once per task and returns the function for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Ids that may be broadcast: 8 to 40 MB as a hash table. More of them shuffle.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in dropped.doc_id; rows without an id stay.

    The ids are counted first: up to BROADCAST_IDS go to every executor and texts do not move, more of
    them join by a shuffle.
    """
    ids = dropped.select("doc_id").where("doc_id is not null").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(docs.columns)
