"""Approximate nearest neighbours by cross-polytope hashing (operator 1).

A vector is turned by three rounds of random signs and Hadamard transforms and hashed to the nearest
signed axis; `functions` of such hashes make a bucket, and each table has its own rotations.
A query ranks the buckets of each table by how far its turned coordinates point there and probes the
best. Candidates are scored exactly, in double precision, on the original vectors.

Fitting: functions, tables and probes are chosen together. For each of LAYOUTS the smallest number of probes is taken
that finds GOAL of the true neighbours of FIT_QUERIES sampled queries (known by brute force over all vectors); of these
the cheapest stays, counting the candidates that the queries meet (from their share of FIT_VECTORS sampled vectors, at the
full number of vectors), the probes, and the copies of the index. More vectors so lead to more functions, smaller
buckets and a smaller share of candidates, not to a switch. Every vector is indexed. fitted() returns the measured recall and share.

Copies of a vector are searched once: a class of equal vectors keeps its k + 1 smallest ids, more of which no
answer can hold. Buckets that agree in all functions but the last form a group, and groups are dealt to reducers by
hash: a vector goes to a reducer once, with all its buckets there, and so does a query. A reducer holds its index rows, some
BLOCK_ROWS, and the queries stream past. Groups of more than that, known by counts taken before, are dealt to several
reducers by vector. Vectors of unequal norms get one more coordinate that evens them out, the usual
reduction of inner products to angles.

Edge cases: null, zero, non-finite vectors, ones with null components and rows without an id take
no part, nor do vectors whose length is not the most common one; ties go to the smaller vec_id, in whatever order
rows arrive; fewer than k candidates give what there is; an id that occurs twice with one vector counts once; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import lookup, map_batches, materialize, tidied, tune

#: (functions, tables) to choose from, and the most probes a table that are tried.
LAYOUTS = ((1, 8), (2, 8), (2, 16), (3, 24))
MOST_PROBES = 1024
BLOCK_ROWS = 65_536
FIT_QUERIES = 256
FIT_VECTORS = 4096
SHARE_QUERIES = 64
GOAL = 0.93
#: What a probe and a copy of an indexed vector cost, in candidates scored.
PROBE_COST, COPY_COST = 2.0, 2.0
#: Groups above one part in so many of all index rows are dealt out, so no more than this are.
HOT_GROUPS = 100_000
#: Pairs of query and candidate that a reducer scores at once.
PAIRS = 1 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


class Hasher:
    """Rotations of all tables, drawn from a seed. most: the largest norm, if norms are unequal."""

    def __init__(self, dim: int, functions: int, tables: int = 4, most: float | None = None, seed: int = 11):
        self.dim, self.functions, self.tables, self.most = dim, functions, tables, most
        self.wide = 1 << max(1, (dim + (most is not None) - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, functions, 3, self.wide))

    def lifted(self, v: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(v), self.wide))
        norms = np.linalg.norm(v, axis=1, keepdims=True)
        if self.most is None or query:
            out[:, : self.dim] = v / norms
        else:
            out[:, : self.dim] = v / self.most
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (norms[:, 0] / self.most) ** 2))
        return out

    def turned(self, x: np.ndarray, table: int, function: int) -> np.ndarray:
        """Rows by signed axes: the coordinate along each axis and against it, in turn."""
        for s in self.signs[table, function]:
            x = hadamard(x * s)
        return np.stack([x, -x], 2).reshape(len(x), -1)

    def codes(self, v: np.ndarray) -> np.ndarray:
        """(rows, tables) buckets of index vectors."""
        x, out = self.lifted(v, False), np.zeros((len(v), self.tables), np.int64)
        for t in range(self.tables):
            for f in range(self.functions):
                out[:, t] = out[:, t] * (2 * self.wide) + self.turned(x, t, f).argmax(1)
        return out

    def probes(self, v: np.ndarray, n: int) -> np.ndarray:
        """(rows, tables, up to n) buckets that a query looks at, best first."""
        n = min(n, (2 * self.wide) ** self.functions)
        rows = max(1, PAIRS // (min(n, 2 * self.wide) * 2 * self.wide))  # of which all sums are held at once
        if len(v) > rows:
            return np.concatenate([self.probes(v[lo : lo + rows], n) for lo in range(0, len(v), rows)])
        x, out = self.lifted(v, True), []
        for t in range(self.tables):
            best, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
            for f in range(self.functions):
                y = self.turned(x, t, f)
                total = (best[:, :, None] + y[:, None, :]).reshape(len(x), -1)
                kept = np.argpartition(-total, n - 1, axis=1)[:, :n] if total.shape[1] > n else np.broadcast_to(np.arange(total.shape[1]), total.shape)
                best = np.take_along_axis(total, kept, 1)
                code = np.take_along_axis(code, kept // y.shape[1], 1) * y.shape[1] + kept % y.shape[1]
                order = np.argsort(-best, axis=1, kind="stable")
                best, code = np.take_along_axis(best, order, 1), np.take_along_axis(code, order, 1)
            out.append(code)
        return np.stack(out, 1)


def unpacked(vectors: list[bytes], dim: int) -> np.ndarray:
    """Rows of doubles from packed vectors, which travel as floats where they were floats."""
    kind = np.float32 if vectors and len(vectors[0]) == 4 * dim else np.float64
    return np.frombuffer(b"".join(vectors), kind).reshape(-1, dim).astype(np.float64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return unpacked(column.to_pylist(), dim)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in one fixed order whatever the batch."""
    return np.multiply(a, b).sum(axis=1)


def _valid(batch: pa.RecordBatch):
    """The rows that take part, as bytes of floats or doubles, with norms and lengths; all tests run on the flattened batch."""
    kind = np.float32 if batch.column(1).type.value_type == pa.float32() else np.float64
    column, given = batch.column(1), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) + 0.0  # -0.0 and 0.0 are one value
    owner = np.repeat(np.arange(len(sizes)), sizes)
    finite = np.isfinite(flat)
    count = lambda weights: np.bincount(owner, weights, minlength=len(sizes))
    with np.errstate(over="ignore"):
        norms = np.sqrt(count(np.where(finite, flat, 0.0) ** 2))
    good = np.flatnonzero(given & (sizes > 0) & (count(~finite) == 0) & np.isfinite(norms) & (norms > 0))
    ends = np.cumsum(sizes)
    packed = flat.astype(kind)
    rows = [packed[ends[i] - sizes[i] : ends[i]].tobytes() for i in good]
    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(rows, pa.binary()), pa.array(norms[good]), pa.array(sizes[good].astype(np.int32))], names=["vec_id", "v", "norm", "dim"])


def top_pairs(who: np.ndarray, scores: np.ndarray, reps: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each number in `who`: largest score first, ties to the smaller rep, whatever their order."""
    order = np.lexsort((reps, -scores, who))
    first = np.flatnonzero(np.append(True, who[order][1:] != who[order][:-1])) if len(order) else order
    turn = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[turn < k]


def brute(rows: DataFrame, queries: list[tuple[int, bytes]], dim: int, k: int) -> DataFrame:
    """query, rep, v, score: the k best rows of a bounded set of broadcast queries, by blocks of all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((np.array([q for q, _ in queries]), unpacked([v for _, v in queries], dim)))

    def make():
        def work(batch: pa.RecordBatch):
            ids, q = shared.value
            if not batch.num_rows:
                return
            x, reps = _matrix(batch.column(1), dim), batch.column(0).to_numpy()
            scores = q @ x.T
            # whatever may be among the best: all down to the k-th product, less what products differ by when summed in another order
            least = np.partition(scores, -k, axis=1)[:, -k] if len(x) > k else np.full(len(q), -np.inf)
            who, at = np.nonzero(scores >= (least - 1e-9 * np.abs(least) - 1e-12)[:, None])
            sure = exact(q[who], x[at])
            keep = top_pairs(who, sure, reps[at], k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[who[keep]]), batch.column(0).take(pa.array(at[keep])), batch.column(1).take(pa.array(at[keep])), pa.array(sure[keep])], names=["query", "rep", "v", "score"])

        return work

    found = map_batches(rows.select("rep", "v"), make, "query long, rep long, v binary, score double")
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "rep")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


@dataclass(frozen=True)
class Fit:
    """A hasher, the probes a table, and what they give on the sampled queries: recall, and the share of all vectors met."""

    hasher: Hasher
    probes: int
    recall: float
    share: float


def needed_probes(hasher: Hasher, asked: np.ndarray, truth: np.ndarray, owner: np.ndarray, goal: float) -> tuple[int, float] | None:
    """Probes a table that find `goal` of the true neighbours (owner: the query of each, in order), and the recall; None if out of reach."""
    every = min(MOST_PROBES, (2 * hasher.wide) ** hasher.functions)
    codes, rank = hasher.codes(truth), np.full(len(truth), every)
    for lo in range(0, len(asked), 16):
        probes = hasher.probes(asked[lo : lo + 16], every)
        for i, own in enumerate(probes, lo):
            mine = slice(*np.searchsorted(owner, [i, i + 1]))
            hit = own[:, None, :] == codes[mine].T[:, :, None]
            rank[mine] = np.where(hit.any(2), hit.argmax(2), every).min(0, initial=every)
    need = int(np.sort(rank)[math.ceil(goal * len(rank)) - 1]) + 1
    return (need, float((rank < need).mean())) if need <= every else None


def share_met(hasher: Hasher, probes: int, asked: np.ndarray, sample: np.ndarray) -> float:
    """Share of the sampled vectors that a query meets in any table."""
    codes, met = hasher.codes(sample), 0
    for lo in range(0, len(asked), 16):
        for own in hasher.probes(asked[lo : lo + 16], probes):
            hit = np.zeros(len(sample), bool)
            for t in range(hasher.tables):
                hit |= np.isin(codes[:, t], own[t])
            met += int(hit.sum())
    return met / max(1, len(asked) * len(sample))


def fitted(classes: DataFrame, asked: DataFrame, rows: int, dim: int, most: float | None, k: int, every: int) -> Fit:
    """The cheapest layout and number of probes that reach GOAL on sampled queries; asked rows are one in `every`."""
    sample = [(r.rep, bytes(r.v)) for r in asked.orderBy(F.xxhash64("rep"), "rep").limit(FIT_QUERIES).select("rep", "v").collect()]
    found = brute(classes, sample, dim, k + 1).where("query <> rep").select("query", "v").collect() if sample else []
    place = {rep: i for i, (rep, _) in enumerate(sample)}
    truth = sorted(((place[r.query], bytes(r.v)) for r in found), key=lambda r: r[0])
    if not truth:
        return Fit(Hasher(dim, 1, 1, most), 1, 1.0, 1.0)
    others = classes.orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(FIT_VECTORS).select("v").collect()
    matrix = lambda found: unpacked([bytes(v) for v in found], dim)
    asks, true, some = matrix(v for _, v in sample), matrix(v for _, v in truth), matrix(r.v for r in others)
    owner = np.array([i for i, _ in truth])
    best: tuple[float, Fit] | None = None
    for functions, tables in LAYOUTS:
        hasher = Hasher(dim, functions, tables, most)
        if functions > 1 and (2 * hasher.wide) ** functions > 4 * rows:
            break  # more buckets than vectors
        if held := needed_probes(hasher, asks, true, owner, GOAL):
            need, recall = held
            share = share_met(hasher, need, asks[:SHARE_QUERIES], some)
            cost = share * rows + PROBE_COST * tables * need + COPY_COST * tables * every
            if best is None or cost < best[0]:
                best = cost, Fit(hasher, need, recall, share)
    if best is None:  # beyond MOST_PROBES in every layout: all buckets of one function
        hasher = Hasher(dim, 1, 1, most)
        return Fit(hasher, 2 * hasher.wide, 1.0, 1.0)
    return best[1]


def _coded(hasher: Hasher, dim: int, probes: int | None):
    """Rows (id, v) to the same with their (table, code) keys, numbered table by table, as bytes; probes: of a query."""
    size = (2 * hasher.wide) ** hasher.functions

    def make():
        def work(batch: pa.RecordBatch):
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                v = _matrix(part.column(1), dim)
                codes = hasher.probes(v, probes) if probes else hasher.codes(v)[:, :, None]
                keys = (codes + np.arange(hasher.tables)[None, :, None] * size).reshape(len(v), -1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([k.tobytes() for k in keys], pa.binary())], names=["id", "v", "keys"])

        return work

    return make


def group_of(keys: np.ndarray, hasher: Hasher) -> np.ndarray:
    """Number of the group of each bucket: all functions but the last; the bucket itself if there is one only."""
    return keys // (2 * hasher.wide) if hasher.functions > 1 else keys


def _mixed(x: np.ndarray, y) -> np.ndarray:
    """A hash of two numbers."""
    h = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.atleast_1d(np.asarray(y, np.int64)).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _dealt(hasher: Hasher, reducers: int, hot, index: bool):
    """Rows (id, v, keys) to (reducer, kind, id, v, keys): one row for each reducer that some of the keys go to.

    hot: broadcast (groups in order, parts of each). An indexed vector goes to one part of a group by its id, a query to all.
    """

    def make():
        def work(batch: pa.RecordBatch):
            names, parts = hot.value
            flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            row = np.repeat(np.arange(batch.num_rows), len(flat) // max(1, batch.num_rows))
            group = group_of(flat, hasher)
            if len(names):
                at = np.minimum(np.searchsorted(names, group), len(names) - 1)
                many = np.where(names[at] == group, parts[at], 1)
            else:
                many = np.ones(len(flat), np.int64)
            if index:
                part = (_mixed(batch.column(0).to_numpy(), 7)[row] % many.astype(np.uint64)).astype(np.int64)
            else:
                flat, row, group, part = np.repeat(flat, many), np.repeat(row, many), np.repeat(group, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            to = (_mixed(group, part) % np.uint64(reducers)).astype(np.int64)
            order = np.lexsort((to, row))
            flat, row, to = flat[order], row[order], to[order]
            cuts = np.flatnonzero((row[1:] != row[:-1]) | (to[1:] != to[:-1])) + 1
            first, packed = np.append(0, cuts)[: len(flat)], flat.tobytes()
            keys = [packed[8 * x : 8 * y] for x, y in zip(first.tolist(), [*cuts.tolist(), len(flat)])]
            taken = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([pa.array(to[first]), pa.array(np.full(len(first), 0 if index else 1, np.int32)), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(keys, pa.binary())], names=["reducer", "kind", "id", "v", "keys"])

        return work

    return make


class Bucketed:
    """The index rows of a reducer: vectors once, and their buckets in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keys: list[bytes]):
        self.ids, self.vectors = ids, vectors
        row = np.repeat(np.arange(len(ids)), [len(k) // 8 for k in keys])
        flat = np.frombuffer(b"".join(keys), np.int64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.rows = flat[order], row[order]

    def best(self, asked: np.ndarray, keys: list[bytes], k: int):
        """(query number, index row, score) of the k best candidates of each query, in parts of about PAIRS pairs."""
        flat = np.frombuffer(b"".join(keys), np.int64)
        ends = np.cumsum([len(x) // 8 for x in keys])
        lo, hi = np.searchsorted(self.keys, flat), np.searchsorted(self.keys, flat, "right")
        size = np.append(0, np.cumsum(hi - lo))
        first = 0
        while first < len(keys):
            begin = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size[ends], size[begin] + PAIRS, "right")))
            here = slice(begin, ends[last - 1])
            many = hi[here] - lo[here]
            total = int(many.sum())
            at = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[here], many)
            who = np.repeat(np.arange(first, last), np.diff(np.append(begin, ends[first:last])))
            pair = np.unique(np.repeat(who, many) * len(self.ids) + self.rows[at])  # tables may lead to one vector twice
            who, row = np.divmod(pair, max(1, len(self.ids)))
            score = np.concatenate([exact(asked[who[i : i + 65_536]], self.vectors[row[i : i + 65_536]]) for i in range(0, len(who), 65_536)] or [np.zeros(0)])
            keep = top_pairs(who, score, self.ids[row], k)
            yield who[keep], row[keep], score[keep]
            first = last


def _search(dim: int, k: int):
    """Rows sorted by reducer, index first, to the k best of each query there."""

    def run(batches):
        key, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            to, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((to[1:] != to[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)], strict=True):
                part = batch.slice(lo, hi - lo)
                ids, vectors, keys = part.column(2).to_numpy(), _matrix(part.column(3), dim), part.column(4).to_pylist()
                if to[lo] != key:
                    key, held, index = to[lo], [], None
                if kind[lo] == 0:
                    held.append((ids, vectors, keys))
                    continue
                if index is None and held:
                    index = Bucketed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), [y for x in held for y in x[2]])
                    held = []
                if index is not None:
                    for who, row, score in index.best(vectors, keys, k):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(index.ids[row]), pa.array(score)], names=["query", "rep", "score"])

    return run


def search(classes: DataFrame, asked: DataFrame, hasher: Hasher, probes: int, rows: int, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query, rep, score: the k best classes found for each asked class. Both tables: rep, v."""
    spark, dim = classes.sparkSession, hasher.dim
    kind = "id long, v binary, keys binary"
    index = materialize(map_batches(classes.select("rep", "v"), _coded(hasher, dim, None), kind), "ann-index")
    asks = map_batches(asked.select("rep", "v"), _coded(hasher, dim, probes), kind)
    least = max(block_rows, rows * hasher.tables // HOT_GROUPS)

    @F.pandas_udf("array<long>")
    def groups(keys: pd.Series) -> pd.Series:
        return pd.Series([group_of(np.frombuffer(x, np.int64), hasher) for x in keys])

    sizes = index.select(F.explode(groups("keys")).alias("g")).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > least)
    hot = sorted((r.g, -(-r.n // least)) for r in sizes.collect())  # HOT_GROUPS at most
    shared = spark.sparkContext.broadcast((np.array([g for g, _ in hot], np.int64), np.array([n for _, n in hot], np.int64)))
    reducers = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * hasher.tables // block_rows))
    dealt = "reducer long, kind int, id long, v binary, keys binary"
    every = map_batches(index, _dealt(hasher, reducers, shared, True), dealt).unionByName(map_batches(asks, _dealt(hasher, reducers, shared, False), dealt))
    found = every.repartition("reducer").sortWithinPartitions("reducer", "kind").mapInArrow(_search(dim, k), "query long, rep long, score double")
    return _best(found.groupBy("query", "rep").agg(F.max("score").alias("score")), k)


@tidied
def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`."""
    tune(vectors.sparkSession)
    valid = materialize(map_batches(vectors.select(F.col("vec_id").cast("long"), "embedding"), lambda: _valid, "vec_id long, v binary, norm double, dim int").distinct(), "vectors")
    sizes = valid.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("most"), F.min("norm").alias("least")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    dim, rows, most, least = sizes[0] if sizes else (1, 0, 1.0, 1.0)
    valid = valid.where(F.col("dim") == dim)
    turn = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = valid.select("vec_id", "v").withColumn("_r", turn).where(F.col("_r") <= k + 1)
    counts = valid.groupBy("v").agg(F.sum((F.col("vec_id") % every == 0).cast("long")).alias("weight"))
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).join(counts, "v").withColumn("rep", F.col("ids")[0])
    classes = materialize(classes, "vector-classes")
    asked = classes.where("weight > 0")
    fit = fitted(classes, asked, rows, dim, None if most <= least * 1.001 else most, k, every)
    found = search(classes, asked, fit.hasher, fit.probes, rows, k + 1, block_rows)
    ids = found.join(classes.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    by_id = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    best = ids.withColumn("_r", by_id).where(F.col("_r") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("found"))
    owners = lookup(valid.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v"), asked.select("v", F.col("rep").alias("query"), "weight"), "v", "weight", rows)
    weights = asked.select(F.col("rep").alias("query"), "weight")
    each = lookup(owners.select("query_id", "query"), best.join(weights, "query"), "query", "weight", rows)
    others = each.withColumn("found", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return others.select("query_id", F.posexplode("found").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
