"""Quality classifier on supervised subword embeddings (operator 2).

A document is the average of learned vectors of its words, word pairs and the character n-grams in words, all hashed
into BUCKETS rows; a softmax layer turns the average into class odds. Training is plain stochastic
gradient descent in numpy on the driver, over hashed count vectors of at most TRAIN_ROWS labelled
documents (a documented bound, TRAIN_ROWS * BUCKETS counts at the very most), taken in the order of a
hash of their ids, one row for each id (of the text with the smallest hash), so the sample is the same on every run. Averages and the output layer are both linear, so a trained
model folds into one number for each bucket: scoring broadcasts that table of BUCKETS floats, whatever
the corpus, and reads whole texts in windows cut at white space. A window starts again with the last word of the one
before, as context for their pair, so the cuts change nothing.

Edge cases: null and empty texts have no features and get the bias alone, a score like any other;
labels that are null are not learned from; without any label of one class the prior decides; repeated
rows score alike; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import ctypes
import gc
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import SPACES, tune

BUCKETS = 2**18
GRAMS = (3, 4)
DIM = 8
EPOCHS = 6
RATE = 2.0
#: Step of the vectors against that of the output layer. Averages over hundreds of features move little at 1.
GAIN = 20.0
TRAIN_ROWS = 3000
THRESHOLD = 0.3
WINDOW = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_STEPS = np.array([pow(0xD6E8FEB86659FD93, i, 1 << 64) for i in range(max(GRAMS))], np.uint64)
_CUT = re.compile(f"[{SPACES}]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and _BASE ** -i for i below n, modulo 2 ** 64."""
    one = np.ones(n, np.uint64)
    up, down = one * np.uint64(_BASE), one * np.uint64(pow(_BASE, -1, 1 << 64))
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def bucket_of(values: np.ndarray, kind: int) -> np.ndarray:
    """Bucket of hashed values; kind keeps words and n-grams of each length apart."""
    return (((values + np.uint64(kind)) * _MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def windows(text: str) -> list[tuple[str, int]]:
    """(part, context) of a text cut at white space into parts of about WINDOW characters; a longer word stays whole.

    The first `context` characters of a part are the last word of the part before.
    """
    out, lo, context = [], 0, 0
    while len(text) - lo > WINDOW + context:
        cut = _CUT.search(text, lo + context + WINDOW)
        if cut is None:
            break
        hi = cut.start()
        out.append((text[lo:hi], context))
        before = text[lo:hi].rstrip(SPACES)
        word = lo + max(before.rfind(c) for c in SPACES) + 1
        lo, context = (word, hi - word) if before else (hi, 0)
    return [*out, (text[lo:], context)]


def features(parts: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, word pairs and n-grams of the parts, and for each the part it is from. Of a part's context only the pair with what follows counts."""
    data = np.frombuffer((" " + "  ".join(p for p, _ in parts) + " ").encode("utf-32-le"), np.uint32).copy()
    space = _SPACE[np.minimum(data, 255)] & (data < 256)
    data[space] = 32
    sizes = np.array([len(p) + 2 for p, _ in parts])
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    fresh = np.ones(len(data), bool)
    for start, (_, context) in zip((np.cumsum(sizes) - sizes).tolist(), parts, strict=True):
        fresh[start : start + 1 + context] &= context == 0
    wide = data.astype(np.uint64)
    found, whose = [], []
    value = wide[:-1] + wide[1:] * _STEPS[1]
    inner = ~space[1:] & fresh[:-1]
    for n in range(3, max(GRAMS) + 1):
        value = value[: len(data) - n + 1] + wide[n - 1 :] * _STEPS[n - 1]
        ok = inner[: len(value)] if n == 3 else ok[: len(value)] & ~space[n - 2 : n - 2 + len(value)]
        if n in GRAMS:
            at = np.flatnonzero(ok)
            found.append(bucket_of(value[at], n))
            whose.append(owner[at])
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(data))
    total = np.append(np.uint64(0), np.cumsum(wide * up, dtype=np.uint64))
    word = (total[ends] - total[starts]) * down[starts]
    own = fresh[starts]
    found.append(bucket_of(word[own], 1))
    whose.append(owner[starts[own]])
    # word pairs hash by exclusive or: a word that follows itself is one feature, whichever word it is
    pair = owner[starts[1:]] == owner[starts[:-1]]
    found.append(bucket_of((word[1:] ^ word[:-1])[pair], 2))
    whose.append(owner[starts[1:]][pair])
    return np.concatenate(found), np.concatenate(whose)


def batches_of(texts, limit: int = WINDOW):
    """(parts, number of the text of each part) in groups of about `limit` characters."""
    parts, whose, size = [], [], 0
    for i, text in enumerate(texts):
        for part in windows(text or ""):
            parts.append(part)
            whose.append(i)
            size += len(part[0])
            if size >= limit:
                yield parts, np.array(whose)
                parts, whose, size = [], [], 0
    if parts:
        yield parts, np.array(whose)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for parts, _ in batches_of([text]):
        total += np.bincount(features(parts)[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, seed: int = 7) -> tuple[np.ndarray, float]:
    """Per-bucket log-odds of class 1 and the bias, from (buckets, counts, label) rows, by SGD."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, dim)) - 0.5) * 2 / dim).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps = max(1, epochs * len(rows))
    done = 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, n, y = rows[k]
            share = n / max(1.0, float(n.sum()))
            step = rate * (1 - done / steps)
            done += 1
            held = vectors[at]
            mean = share @ held
            odds = mean @ out + bias
            error = np.exp(odds - odds.max())
            error /= error.sum()
            error[y] -= 1
            error = error.astype(np.float32)
            # the gradient of the average is shared out by frequency; scaled back so that a vector moves as one of a short text would
            back = out @ error
            vectors[at] = held - (step * GAIN) * share[:, None] * back
            out -= step * np.outer(mean, error)
            bias -= 0.05 * step * error
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id: str = "doc_id"):
    """Is the row kept from training: crc32 of the id as text is divisible by 5. Null ids train nothing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Folded model of at most `rows` labelled documents that are not held out."""
    tune(docs.sparkSession)

    @F.pandas_udf("at binary, n binary")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        found = [counts(x) for x in texts]
        return pd.DataFrame({"at": [a.tobytes() for a, _ in found], "n": [n.tobytes() for _, n in found]}, columns=["at", "n"])

    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # a repeated id trains by one of its texts; the smallest is found before anything shuffles
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    found = one.select("doc_id", "y", hashed("t.text").alias("f")).select("doc_id", "y", "f.*")
    got = sorted(((r.doc_id, r.y, r.at, r.n) for r in found.toLocalIterator()), key=lambda r: r[0])
    model = fit([(np.frombuffer(a, np.int32), np.frombuffer(n, np.float32), y) for _, y, a, n in got])
    del got
    release_memory()
    return model


def release_memory() -> None:
    """Hand freed memory back to the system, where the C library can: the driver lives on long after training."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def score_texts(texts, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 of each whole text."""
    total, number = np.zeros(len(texts)), np.zeros(len(texts))
    for parts, whose in batches_of(texts):
        at, part = features(parts)
        total += np.bincount(whose, np.bincount(part, weights[at], minlength=len(parts)), minlength=len(texts))
        number += np.bincount(whose, np.bincount(part, minlength=len(parts)), minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(number, 1) + bias, -500, 500)))


def scorer(docs: DataFrame, model: tuple[np.ndarray, float]):
    """pandas UDF: score of a text under the model."""
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts, weights.value, bias))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    tune(docs.sparkSession)
    score = scorer(docs, train(docs, labels))
    scored = docs.select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows and columns that score at least the threshold."""
    tune(docs.sparkSession)
    score = scorer(docs, train(docs, labels))
    return docs.select(F.struct("*").alias("_row"), score("text").alias("_score")).where(F.col("_score") >= threshold).select("_row.*")
