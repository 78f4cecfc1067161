"""Substring dedup by sliding sentence spans (operator 9).

Texts are cut into sentences. From every sentence on, and up to every sentence, the shortest run of
consecutive sentences with at least RUN sentences and MIN_WORDS words is hashed to 128 bits; a sentence
of LONG words is a run by itself. Runs that occur before in their own text are repeats at once. The others are joined globally: a run's
first row is the one of the smallest doc_id that holds it, and in every other row the sentences it
covers are removed.

Runs are hashed once and written. Few repeat, so the Bloom filter of exact dedup first tells those that may; only they shuffle.
Counting the documents of a run is an aggregate of fixed-size numbers, combined before the shuffle, and runs held by
more than a thousandth of all are broadcast, so no common passage gathers in one task.

Edge cases: a null text stays null and an empty one empty, without sentences; null doc_ids come last.
Every row without an id is a document of its own, and so is every text under a shared doc_id: they are
ordered by a hash of the text, and a row is cut by its own ranges only. Rows of one doc_id and one text are
one document. Rows without an id are written to the shared folder once, with a number. Texts are read whole;
an empty table gives an empty result; dedup_sentences keeps other columns whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import lookup, map_batches, materialize, tidied, tune
from gristmill.llm.exact_dedup import MAX_SLOTS, Tester, repeat_filter

RUN = 2
MIN_WORDS = 16
LONG = 50
LAST_ID = 2**63 - 1
RUNS = "hi long, lo long, id long, sub long, first int, last int, again boolean"
#: A sentence ends after marks before white space, or at a line's end.
_SENTENCE = re.compile(r"[^\n]+?(?:[.!?]+(?=\s)|(?=\n)|$)\s*|\s+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans in code points that tile the text."""
    return [m.span() for m in _SENTENCE.finditer(text)] if text else []


def runs(text: str | None) -> list[tuple[bytes, int, int]]:
    """(hash, first sentence, sentence after the last) of each run of a text. White space is folded."""
    words = [text[a:b].split() for a, b in sentences(text)] if text else []
    real = [i for i, w in enumerate(words) if w]
    folded = [" ".join(words[i]) for i in real]
    sizes = [len(words[i]) for i in real]
    total = [0]
    for n in sizes:
        total.append(total[-1] + n)
    enough = lambda a, b: total[b] - total[a] >= LONG or (b - a >= RUN and total[b] - total[a] >= MIN_WORDS)
    spans, end, start = {}, 0, 0
    for k in range(len(real)):  # the shortest run from each sentence on, and the shortest up to each
        end = max(end, k)
        while end < len(real) and not enough(k, end):
            end += 1
        if enough(k, end):
            spans[k, end] = None
        while start < k and enough(start + 1, k + 1):
            start += 1
        if enough(start, k + 1):
            spans[start, k + 1] = None
    return [(xxhash.xxh3_128_digest("\n".join(folded[a:b]).encode()), real[a], real[b - 1] + 1) for a, b in spans]


def _run_rows():
    """Runs of a batch of (id, sub, text), their hashes as two numbers."""

    def work(batch: pa.RecordBatch):
        sha, ids, subs, first, last, again = [], [], [], [], [], []
        for doc_id, sub, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            seen = set()
            for h, a, b in runs(text):
                sha.append(h)
                again.append(h in seen)
                seen.add(h)
                ids.append(doc_id)
                subs.append(sub)
                first.append(a)
                last.append(b)
        both = np.frombuffer(b"".join(sha), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64()), pa.array(subs, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(again, pa.bool_())], names=["hi", "lo", "id", "sub", "first", "last", "again"])

    return work


def clean(text: str | None, ranges) -> tuple[str | None, int, int, str]:
    """The text without the sentences in ranges (first, after last), sentences before, removed, and removed spans."""
    spans = sentences(text)
    gone = set()
    for r in ranges if ranges is not None else ():
        gone.update(range(r["first"], r["last"]))
    out, removed = [], []
    for i, (a, b) in enumerate(spans):
        if i not in gone:
            out.append(text[a:b])
        elif removed and removed[-1][1] == a:
            removed[-1][1] = b
        else:
            removed.append([a, b])
    return (None if text is None else "".join(out)), len(spans), len(gone), ",".join(f"{a}:{b}" for a, b in removed)


#: Row keys order by id, then by nine digits of the text's hash and nine of the number of a row without an id.
DIGITS = 10**9


def _numbered(docs: DataFrame) -> DataFrame:
    """_row (all columns), id (doc_id, LAST_ID for null) and sub: equal only for rows of one doc_id and one text."""
    text = F.pmod(F.xxhash64("_row.text"), F.lit(DIGITS)) * DIGITS
    rows = lambda where: docs.where(where).select(F.struct("*").alias("_row"))
    known = rows("doc_id is not null").select("_row", F.col("_row.doc_id").cast("long").alias("id"), text.alias("sub"))
    # written, so that every later reading finds the same numbers
    unknown = materialize(rows("doc_id is null").select("_row", F.monotonically_increasing_id().alias("_number")), "rows-without-id")
    number = F.pmod(F.xxhash64("_number"), F.lit(DIGITS))
    return known.unionByName(unknown.select("_row", F.lit(LAST_ID).alias("id"), (text + number).alias("sub")))


def _row_key():
    """id and sub as one number in their order: a decimal is aggregated by hashing, a struct would be sorted."""
    return (F.col("id").cast("decimal(20,0)") * F.lit(DIGITS * DIGITS).cast("decimal(19,0)") + F.col("sub").cast("decimal(18,0)")).cast("decimal(38,0)")


def repeated_ranges(numbered: DataFrame, max_slots: int = MAX_SLOTS) -> DataFrame:
    """id, sub and ranges: sentence ranges of the row that repeat those of earlier rows."""
    every = materialize(map_batches(numbered.select("id", "sub", "_row.text"), _run_rows, RUNS), "runs")
    bits, slots = repeat_filter(every.where("not again").select("hi"), every.count(), max_slots)
    maybe = Tester(numbered.sparkSession, bits, slots)
    suspects = materialize(every.where(F.col("again") | maybe.column("hi")), "suspect-runs")
    held = suspects.select("hi", "lo", _row_key().alias("key")).groupBy("hi", "lo").agg(F.min("key").alias("owner"), F.max("key").alias("other"), F.count("*").alias("weight"))
    repeated = materialize(held.where("owner < other").drop("other"), "repeated-runs")
    rows = repeated.agg(F.sum("weight")).first()[0] or 0
    later = lookup(suspects.where("not again"), repeated, ["hi", "lo"], "weight", rows).where(_row_key() > F.col("owner"))
    gone = later.select("id", "sub", "first", "last").unionByName(suspects.where("again").select("id", "sub", "first", "last"))
    return gone.groupBy("id", "sub").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))


@tidied
def dedup_sentences(docs: DataFrame, max_slots: int = MAX_SLOTS) -> DataFrame:
    """docs with the cleaned text in place of text, and a struct column `repeats`: n_sentences, n_removed, removed."""
    tune(docs.sparkSession)

    @F.pandas_udf("text string, n_sentences int, n_removed int, removed string")
    def cleaned(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clean(t, r) for t, r in zip(texts, ranges, strict=True)], columns=["text", "n_sentences", "n_removed", "removed"])

    numbered = _numbered(docs)
    ranges = repeated_ranges(numbered, max_slots)
    joined = numbered.join(ranges, ["id", "sub"], "left").select("_row", cleaned("_row.text", "ranges").alias("_c"))
    return joined.select(*(F.col("_c.text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns), F.struct("_c.n_sentences", "_c.n_removed", "_c.removed").alias("repeats"))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text (cleaned), n_sentences, n_removed, removed (code point spans, comma-joined)."""
    return dedup_sentences(docs.select("doc_id", "text")).select("doc_id", "text", "repeats.*")
