"""Exact dedup by two-pass Bloom filtering (operator 3).

Pass one fills a Bloom filter whose slots saturate at "twice": a hash can be repeated only if all its
slots were hit twice or more. Pass two tests every row against it. Rows that fail the test are
certainly unique and go straight to the result; only the others, the repeats and a percent or so of
false alarms, shuffle, as thin rows of digest, length and id.

The filter has SLOTS_PER_ROW slots a row up to max_slots (2 ** 29: 64 MB as bits), which bounds what
the driver receives and broadcasts. A corpus beyond that keeps exact results: the filter just lets
more thin rows through to the shuffle.

Edge cases: a null text counts as empty, empty texts equal each other; ties in length go to the
smallest doc_id, null ids last; of rows alike in text and doc_id one stays; an empty table gives an
empty result; other columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import SPACES, lookup, materialize, tidied, tune

SLOTS_PER_ROW = 12
PROBES = 3
MAX_SLOTS = 2**29
SLICES = 32
_SPACE_BYTES = SPACES.encode()


def normal_digest(text: str | None) -> tuple[bytes, int]:
    """SHA-256 of the text without white space, and the code points of the text with it."""
    text = text or ""
    return hashlib.sha256(text.encode().translate(None, _SPACE_BYTES)).digest(), len(text)


def _digest(text: str) -> Column:
    @F.pandas_udf("sha string, n long")
    def digest(texts: pd.Series) -> pd.DataFrame:
        found = [normal_digest(x) for x in texts]
        return pd.DataFrame({"sha": [d.hex() for d, _ in found], "n": [n for _, n in found]}, columns=["sha", "n"])

    return digest(text)


def slots_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    """(PROBES, rows) slot numbers by double hashing of 64-bit hashes; slots is a power of two."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([((low + np.uint64(i) * high) & np.uint64(slots - 1)).astype(np.int64) for i in range(PROBES)])


def _hashes(digests) -> np.ndarray:
    """First 64 bits of hexadecimal digests; numbers are hashes already."""
    found = np.asarray(digests)
    return found.view(np.uint64) if found.dtype == np.int64 else np.array([int(x[:16], 16) for x in found], dtype=np.uint64)


def _partial(slots: int):
    """Batches of digests to (slice, slots hit once, slots hit more often), sparse, one set a task."""
    width = slots // SLICES

    def run(batches):
        gathered = []
        for batch in batches:
            gathered.append(slots_of(_hashes(batch.column(0).to_numpy(zero_copy_only=False)), slots).ravel())
            if sum(map(len, gathered)) >= 3_000_000:  # a bounded share of a long task
                yield from flush(gathered)
                gathered = []
        if gathered:
            yield from flush(gathered)

    def flush(gathered):
        found, counts = np.unique(np.concatenate(gathered), return_counts=True)
        edges = np.searchsorted(found, np.arange(SLICES + 1) * width)
        once, more = [], []
        for i in range(SLICES):
            part, many = found[edges[i] : edges[i + 1]] - i * width, counts[edges[i] : edges[i + 1]] > 1
            once.append(part[~many].astype(np.int32).tobytes())
            more.append(part[many].astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["slice", "once", "more"])

    return run


def _merged(slots: int):
    """Partial rows of whole slices to (slice, bits of the slots hit at least twice)."""
    width = slots // SLICES

    def run(batches):
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i, once, more in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if i not in seen:
                    seen[i] = np.zeros(width, bool), np.zeros(width, bool)
                hit, twice = seen[i]
                single = np.frombuffer(once, np.int32)
                twice[single[hit[single]]] = True
                hit[single] = True
                many = np.frombuffer(more, np.int32)
                twice[many] = hit[many] = True
        for i, (_, twice) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["slice", "bits"])

    return run


def repeat_filter(hashes: DataFrame, rows: int, max_slots: int = MAX_SLOTS) -> tuple[np.ndarray, int]:
    """Packed bits of the slots that the digests in hashes' only column hit at least twice, and the slot count."""
    slots = min(max_slots, 1 << max(10, int(np.ceil(np.log2(max(1, rows) * SLOTS_PER_ROW)))))
    parts = hashes.mapInArrow(_partial(slots), "slice int, once binary, more binary")
    bits = np.zeros(slots // 8, np.uint8)
    size = len(bits) // SLICES
    for row in parts.repartition(SLICES, "slice").mapInArrow(_merged(slots), "slice int, bits binary").toLocalIterator():
        bits[row.slice * size : (row.slice + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return bits, slots


class Tester:
    """Broadcast filter: which hexadecimal digests, or hashes as numbers, may be repeated?"""

    def __init__(self, spark, bits: np.ndarray, slots: int):
        self.shared, self.slots = spark.sparkContext.broadcast(bits), slots

    def __call__(self, digests) -> np.ndarray:
        at = slots_of(_hashes(digests), self.slots)
        return ((self.shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)

    def column(self, sha: str) -> Column:
        test = self

        @F.pandas_udf("boolean")
        def maybe_repeated(digests: pd.Series) -> pd.Series:
            return pd.Series(test(digests))

        return maybe_repeated(sha)

    def with_digest(self, text: str) -> Column:
        """sha, n and maybe of a text in one UDF, so that a task needs one Python worker."""
        test = self

        @F.pandas_udf("sha string, n long, maybe boolean")
        def digest(texts: pd.Series) -> pd.DataFrame:
            found = [normal_digest(x) for x in texts]
            sha = [d.hex() for d, _ in found]
            return pd.DataFrame({"sha": sha, "n": [n for _, n in found], "maybe": test(sha)}, columns=["sha", "n", "maybe"])

        return digest(text)


def _first(count: Column) -> list[Column]:
    """Aggregates of a group: the row that stays, by length then id, and the group's size."""
    best = F.min(F.struct((-F.col("n")).alias("shorter"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id")))
    return [best.alias("best"), count.alias("group_size")]


def _survey(thin: DataFrame, max_slots: int):
    """The tester, and the suspects' groups: sha, best, group_size."""
    rows = thin.count()
    bits, slots = repeat_filter(thin.select("sha"), rows, max_slots)
    maybe = Tester(thin.sparkSession, bits, slots)
    suspects = materialize(thin.where(maybe.column("sha")).groupBy("sha", "doc_id", "n").agg(F.count("*").alias("alike")), "exact-suspects")
    return rows, maybe, suspects, suspects.groupBy("sha").agg(*_first(F.sum("alike")))


@tidied
def exact_groups(docs: DataFrame, max_slots: int = MAX_SLOTS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    tune(docs.sparkSession)
    found = docs.select("doc_id", _digest("text").alias("_d"))
    thin = materialize(found.select("doc_id", "_d.sha", "_d.n"), "exact-thin")
    rows, maybe, suspects, groups = _survey(thin, max_slots)
    alone = thin.where(~maybe.column("sha")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    groups = materialize(groups.withColumn("weight", F.col("group_size")), "exact-groups")
    joined = lookup(suspects, groups, "sha", "weight", rows)
    stays = (F.col("best.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("best.shorter") == -F.col("n"))
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "alike")))
    return alone.unionByName(
        copies.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (stays & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
    )


@tidied
def drop_exact_copies(docs: DataFrame, max_slots: int = MAX_SLOTS) -> DataFrame:
    """docs' rows and columns, one row for each normalised text."""
    tune(docs.sparkSession)
    thin = materialize(docs.select("doc_id", _digest("text").alias("_d")).select("doc_id", "_d.sha", "_d.n"), "exact-thin")
    _, maybe, _, groups = _survey(thin, max_slots)
    flat = docs.select(F.struct("*").alias("_row"), maybe.with_digest("text").alias("_d")).select("_row", "_d.sha", "_d.n", F.col("_d.maybe").alias("_maybe"))
    best = groups.select("sha", (-F.col("best.shorter")).alias("n"), F.col("best.doc_id").alias("doc_id"))
    suspects = flat.where("_maybe").alias("a")
    stay = suspects.join(best.alias("b"), (F.col("a.sha") == F.col("b.sha")) & (F.col("a.n") == F.col("b.n")) & F.col("a._row.doc_id").eqNullSafe(F.col("b.doc_id")), "left_semi")
    return flat.where("not _maybe").select("_row.*").unionByName(stay.select("sha", "_row").dropDuplicates(["sha"]).select("_row.*"))
