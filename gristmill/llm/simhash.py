"""SimHash near-dedup with BK-trees (operator 7).

Fingerprints: 64 bits from XXH64 of word shingles; a bit is set if more than half of the shingles'
hashes set it. Two fingerprints link at `radius` or fewer differing bits, and linked documents form a
component named by its smallest doc_id.

Copies collapse first: only distinct fingerprints are searched. They are cut into radius + 1 blocks of
bits, of which a linked pair must share one, and each block value is a shard with a BK-tree of its own
(bktree.py). Every link comes from following the edges within the radius; no shard is compared whole. The trees
of the largest shards, TREE_NODES nodes in all as counted before, are broadcast: their queries are spread over all
tasks and never move. The other shards are smaller and gathered by a shuffle, their trees built and searched where they land.
Shards above SHARD_ROWS are first dealt out again by blocks of their remaining bits. A task yields a
spanning forest of what it found, not its pairs. Star contraction then joins the forests into components, with a written table each round.

Edge cases: a null or empty text, or one of white space, has fingerprint zero, linked like any other;
fewer words than a shingle hash whole; null doc_ids take part and never name a component unless all
are null; repeated rows fall into one component; an empty table gives an empty result; other columns
pass through near_dedup untouched.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.bktree import Forest, Groups
from gristmill.llm.common import BROADCAST_IDS, lookup, materialize, tidied, tune, without_ids

BITS = 64
SHARD_ROWS = 20_000
#: Nodes of all the trees that are broadcast, 24 bytes each.
TREE_NODES = 100_000
#: Fingerprints that a task gathers before it searches or builds trees; a shard is never parted.
GATHER = 65_536
#: Hot shards are at most this many, as none holds less than one part in so many of all keys.
HOT_SHARDS = 2000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: A to Z, and space, \t to \r only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) <= shingle:
        return int(xxhash.xxh64_intdigest(joined, seed))
    pairs = zip(starts[: 1 - shingle or None].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in pairs]), np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(hashes[i : i + 200], axis=1).sum(0, dtype=np.uint8).astype(np.int64) for i in range(0, len(hashes), 200))
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", fp("text").alias("fp"))


def _gathered(batches, whole: bool):
    """(shard, fingerprint) columns of many batches as arrays of about GATHER rows; whole: rows are sorted by shard, and none is parted."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if size >= GATHER:
            cut = int(np.argmax(shard != held[-1][0][-1])) if whole else 0
            if whole and shard[cut] == held[-1][0][-1]:
                cut = len(shard)  # the shard goes on
            if cut < len(shard):
                held.append((shard[:cut], fp[:cut]))
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size, shard, fp = [], 0, shard[cut:], fp[cut:]
        held.append((shard, fp))
        size += len(shard)
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def forest_links(forest: Forest, shard: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (fingerprint, smallest node of its group), as signed longs, of the forest's nodes that the queries join. Every query is a node of its shard's tree."""
    nodes = len(forest.points)
    groups = Groups(nodes + len(fp))
    for asked, node in forest.within(fp, forest.root_of(shard), radius):
        groups.join(asked + nodes, node)
    name = groups.names()[:nodes]
    moved = np.flatnonzero(name != np.arange(nodes))
    signed = forest.points.view(np.int64)
    return list(zip(signed[moved].tolist(), signed[name[moved]].tolist(), strict=True))


def bk_forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (larger, smallest of its group), as signed longs, of distinct 64-bit fingerprints within radius, by one tree."""
    points, one = points[np.argsort(points.view(np.int64))], np.zeros(len(points), np.int64)
    return forest_links(Forest(points, one), one, points, radius)


def _in_place(shared, radius: int):
    """Queries (shard, fp) to links found in the broadcast trees."""

    def run(batches):
        for shard, fp in _gathered(batches, False):
            yield _links(forest_links(shared.value, shard, fp, radius))

    return run


def _gathered_shards(radius: int):
    """Rows (shard, fp) sorted by shard to links, each shard through a tree of its own."""

    def run(batches):
        for shard, fp in _gathered(batches, True):
            edge = np.append(True, shard[1:] != shard[:-1])
            several = ~(edge & np.append(edge[1:], True))  # a fingerprint alone in its shard links to none
            shard, fp = shard[several], fp[several]
            yield _links(forest_links(Forest(fp, shard), shard, fp, radius))

    return run


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])


def blocks(parts: int, bits: list[int]) -> list[int]:
    """The bit positions in `bits`, dealt into `parts` masks of neighbours."""
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _masked(mask: int):
    signed = mask - (1 << 64) if mask >= 1 << 63 else mask
    return F.col("fp").bitwiseAND(F.lit(signed).cast("long"))


def shards(distinct: DataFrame, rows: int, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """shard (a hash of its block, value and, for what was dealt again, the same of the other bits) and fp: all shards that each fingerprint is in.

    Shards whose hashes agree are one, which only adds comparisons.
    """
    masks = blocks(radius + 1, list(range(BITS)))
    keyed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), _masked(m).alias("value")) for i, m in enumerate(masks)))).alias("k")).select("k.*", "fp")
    least = max(shard_rows, rows * len(masks) // HOT_SHARDS)
    hot = F.broadcast(keyed.groupBy("block", "value").count().where(F.col("count") > least).select("block", "value"))
    plain = keyed.join(hot, ["block", "value"], "left_anti").select(F.xxhash64("block", "value").alias("shard"), "fp")
    inner = [blocks(radius + 1, [b for b in range(BITS) if not m >> b & 1]) for m in masks]
    choice = F.array(*(F.array(*(F.xxhash64("block", "value", F.lit(j), _masked(x)) for j, x in enumerate(sub))) for sub in inner))
    return plain.unionByName(keyed.join(hot, ["block", "value"]).select(F.explode(choice[F.col("block")]).alias("shard"), "fp"))


def tree_links(keyed: DataFrame, radius: int, tree_nodes: int = TREE_NODES) -> DataFrame:
    """u, v joining the fingerprints of keyed (shard, fp) that are within radius in a shard."""
    sizes = materialize(keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"), "shard-sizes")
    left, least, some = tree_nodes, None, False
    for size in sizes.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.sum("n").alias("n")).orderBy(F.desc("power")).collect():  # 40 rows at most
        some = some or size.n > left
        if not some:
            left, least = left - size.n, 1 << size.power
    found = []
    if least:
        great = F.broadcast(sizes.where(F.col("n") >= least).select("shard"))
        here = keyed.join(great, "shard").select("shard", "fp")
        nodes = here.toArrow()  # tree_nodes rows at most, as counted
        forest = Forest(nodes.column("fp").to_numpy().view(np.uint64), nodes.column("shard").to_numpy())
        found.append(here.mapInArrow(_in_place(keyed.sparkSession.sparkContext.broadcast(forest), radius), "u long, v long"))
        keyed = keyed.join(great, "shard", "left_anti").select("shard", "fp")
    if some:
        found.append(keyed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_gathered_shards(radius), "u long, v long"))
    empty = keyed.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    return reduce(DataFrame.unionByName, found, empty)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest reachable) for each node of edges (u, v) except the roots, by alternating stars.

    Every round moves each node's larger neighbours to its smallest one, then its smaller ones, and
    writes the links; trees lose about half of their depth. It ends when every node hangs on a root.
    """
    ordered = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = materialize(edges.where("u <> v").select(*ordered("u", "v")).distinct(), "links")
    while True:
        ends = now.select("u", F.lit(1).alias("out"), F.lit(0).alias("held")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("held")))
        nodes = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("held").alias("held"))
        total, most, inner = nodes.agg(F.sum("out"), F.max("out"), F.max(F.col("out") * F.col("held"))).first()
        if not total or (most == 1 and inner == 0):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("weight"))
        large = lookup(both.where("v > u"), best, "u", "weight", 2 * total).select(*ordered("v", "m")).where("u <> v").distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight"))
        small = lookup(large, least, "u", "weight", total).select(F.explode(F.array(F.struct(*ordered("u", "m")), F.struct(*ordered("v", "m")))).alias("e")).select("e.*")
        now = materialize(small.where("u <> v").distinct(), "links")


@tidied
def linked(prints: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fp, component_id for a table of doc_id and fp."""
    tune(prints.sparkSession)
    thin = materialize(prints, "prints")
    distinct = materialize(thin.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("weight")), "distinct-prints")
    total, rows = (x or 0 for x in distinct.agg(F.sum("weight"), F.count("*")).first())
    trees = components(tree_links(shards(distinct, rows, radius, shard_rows), radius))
    member = trees.unionByName(trees.select(F.col("root").alias("node"), "root").distinct())
    owned = materialize(member.join(distinct, member.node == distinct.fp).select("fp", "root", "first", "weight"), "members")
    names = owned.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    named = lookup(owned, names, "root", "members", rows).select("fp", "component_id", "weight")
    others = distinct.join(owned.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"), "weight")
    return lookup(thin, materialize(named.unionByName(others), "named"), "fp", "weight", total).select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return linked(fingerprints(docs, shingle), radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity: longer fingerprints, found in several tables.
#
# At a Jaccard similarity of 0.8 two 64-bit fingerprints differ in some ten bits, more than any blocking
# by equal bits can bridge. WIDE fingerprints of 256 bits tell 0.8 from less, and tables of sampled bits
# find them: a pair that agrees in a bit with probability p meets in a table of b bits with probability
# p ** b. Enough tables are taken that such a pair meets at all with probability MEET.

WIDE = 4
OCCUPANCY = 64
#: At a radius of some 50 of 256 bits no edge of a small tree can be ruled out, so a bucket of OCCUPANCY is compared whole.
LEAF = 64
MEET = 0.99
#: Standard deviations of slack on the bits that a pair of the given similarity differs in.
SLACK = 2.0
_STEPS = np.array([[0x9E3779B97F4A7C15 * (i + 1) % (1 << 64) for i in range(WIDE)]], np.uint64)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted XXH64 of the distinct word shingles; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    starts = np.append(0, ends[:-1] + 1)[: max(1, len(words) - shingle + 1)]
    spans = zip(starts.tolist(), ends[min(shingle, len(words)) - 1 :].tolist() or [0], strict=False)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64))


def wide_bits(base: np.ndarray) -> bytes:
    """256 bits: the majority of the shingles' bits, each shingle's being four mixes of its XXH64."""
    ones = np.zeros(64 * WIDE, np.int64)
    for lo in range(0, len(base), 200):
        x = base[lo : lo + 200, None] + _STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(base)).tobytes()


def wide_fingerprint(text: str | None, shingle: int = 5) -> bytes:
    """256 bits of the set of a text's shingles, however often each occurs."""
    return wide_bits(shingle_set(text, shingle))


def set_id(base: np.ndarray) -> int:
    """Signed 64-bit name of a set of shingles."""
    return int(np.array([xxhash.xxh3_64_intdigest(base.tobytes())], np.uint64).view(np.int64)[0])


def differing(similarity: float) -> float:
    """Expected share of differing bits at a Jaccard similarity of sets of one size: the angle between them."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def tables_for(rows: int, similarity: float) -> tuple[int, int]:
    """(bits, tables) so that a table's bucket holds about OCCUPANCY of the rows and pairs meet with probability MEET."""
    bits = max(4, int(np.ceil(np.log2(max(2, rows) / OCCUPANCY))))
    return bits, int(np.ceil(np.log(1 - MEET) / np.log(1 - (1 - differing(similarity)) ** bits)))


def _sampled(seed: int, tables: int, bits: int, name: str):
    """Array of (table, key): hashes of the sampled bits of w0 to w3. Equal bits give equal keys."""
    rng = np.random.default_rng(seed)
    out = []
    for t in range(tables):
        masks = [0] * WIDE
        for b in rng.choice(64 * WIDE, bits, replace=False).tolist():
            masks[b // 64] |= 1 << (b % 64)
        signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        parts = [F.col(f"w{i}").bitwiseAND(F.lit(m).cast("long")) for i, m in enumerate(signed)]
        out.append(F.struct(F.lit(t).alias(name), F.xxhash64(F.lit(t), *parts).alias(f"{name}_key")))
    return F.explode(F.array(*out)).alias("k")


def distance(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints of one or more words: the last axis holds the words."""
    return np.bitwise_count(points ^ other).sum(-1, dtype=np.int16)


def joined_within(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(index, smallest index of its group) where they differ, for rows of words joined within radius, by one BK-tree.

    All points descend the tree together: at a node, the points whose distance to it differs from a
    child's edge by no more than the radius follow that edge. Subtrees of LEAF points are compared whole.
    """
    groups = Groups(len(points))
    todo = [(np.arange(len(points)), np.arange(len(points)))]
    while todo:
        tree, queries = todo.pop()
        if len(tree) <= LEAF:
            for lo in range(0, len(queries), 4096):
                part = queries[lo : lo + 4096]
                q, t = np.nonzero(distance(points[part][:, None], points[tree][None]) <= radius)
                groups.join(part[q], tree[t])
            continue
        root, rest = tree[0], tree[1:]
        apart = distance(points[queries], points[root])
        close = queries[(apart <= radius) & (queries != root)]
        groups.join(close, np.full(len(close), root))
        edges = distance(points[rest], points[root])
        for edge in np.unique(edges):
            follow = queries[np.abs(apart - edge) <= radius]
            if len(follow):
                todo.append((rest[edges == edge], follow))
    return [(i, r) for i, r in enumerate(groups.names().tolist()) if i != r]


def _close(limit: int):
    """Rows sorted by bucket to links of nodes at most `limit` bits apart, a forest for each bucket."""

    def run(batches):
        key, held = None, []

        def close():
            nodes, points = (np.concatenate(c) for c in zip(*held, strict=True)) if held else ((), ())
            if len(nodes) > 1:
                order = np.argsort(nodes)
                yield from ((int(nodes[order][i]), int(nodes[order][r])) for i, r in joined_within(points[order], limit))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            node = batch.column(4).to_numpy()
            points = np.stack([batch.column(5 + i).to_numpy() for i in range(WIDE)], 1).view(np.uint64)
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1
            links = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)], strict=True):
                now = tuple(int(c[lo]) for c in keys)
                if now != key:
                    links += close()
                    key, held = now, []
                held.append((node[lo:hi], points[lo:hi]))
            yield _links(links)
        yield _links(list(close()))

    return run


def wide_links(distinct: DataFrame, rows: int, similarity: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """u, v (u > v) joining the nodes of distinct (node, w0 to w3) that are similar enough."""
    share = differing(similarity)
    bits, tables = tables_for(rows, similarity)
    limit = int(64 * WIDE * share + SLACK * np.sqrt(64 * WIDE * share * (1 - share)))
    names = [f"w{i}" for i in range(WIDE)]
    keyed = distinct.select("node", *names, _sampled(17, tables, bits, "t")).select("k.*", "node", *names)
    least = max(shard_rows, rows * tables // HOT_SHARDS)
    hot = F.broadcast(keyed.groupBy("t", "t_key").count().where(F.col("count") > least).select("t", "t_key"))
    blank = [F.lit(-1).alias("s"), F.lit(0).cast("long").alias("s_key")]
    plain = keyed.join(hot, ["t", "t_key"], "left_anti").select("t", "t_key", *blank, "node", *names)
    # hot buckets are dealt out by eight more bits, in as many tables as pairs need to meet there
    more = tables_for(OCCUPANCY << 8, similarity)[1]
    dealt = keyed.join(hot, ["t", "t_key"]).select("t", "t_key", "node", *names, _sampled(19, more, 8, "s")).select("t", "t_key", "k.*", "node", *names)
    keys = ["t", "t_key", "s", "s_key"]
    buckets = plain.unionByName(dealt).repartition(*keys).sortWithinPartitions(*keys)
    return buckets.mapInArrow(_close(limit), "u long, v long")


#: Sets compared by one task come from two blocks of about this many shingles or sets.
BLOCK_SHINGLES = 1_000_000
BLOCK_SETS = 2_000


def joined_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(index, first index of its group) where they differ, for non-empty sets joined by pairs of Jaccard `similarity` or more.

    A set that is reached is compared with all that are not yet, so close groups cost one pass.
    """
    sizes = np.array([len(x) for x in sets])
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    marked, left, out = np.zeros(len(universe), bool), np.arange(len(sets)), []
    while len(left) > 1:
        first, left = int(left[0]), left[1:]
        flat = flat[len(own[first]) :]
        reached = [first]
        while reached and len(left):
            at = reached.pop()
            marked[own[at]] = True
            shared = np.add.reduceat(marked[flat], np.append(0, np.cumsum(sizes[left])[:-1]), dtype=np.int64)
            marked[own[at]] = False
            near = shared >= similarity * (sizes[left] + sizes[at] - shared) - 1e-9
            if near.any():
                reached += left[near].tolist()
                out += [(i, first) for i in left[near].tolist()]
                flat, left = flat[np.repeat(~near, sizes[left])], left[~near]
    return out


def _confirmed(similarity: float):
    """Rows (root, low, high, node, shingles) sorted by the first three to confirmed links of nodes."""

    def run(batches):
        key, held = None, {}

        def close():
            if len(held) > 1:
                nodes = list(held)
                yield from ((max(a, b), min(a, b)) for a, b in ((nodes[i], nodes[j]) for i, j in joined_sets(list(held.values()), similarity)))

        for batch in batches:
            links = []
            for *now, node, packed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now != key:
                    links += close()
                    key, held = now, {}
                held[node] = np.frombuffer(packed, np.uint64)
            yield _links(links)
        yield _links(list(close()))

    return run


#: Sets of a large group that all its others are compared with first, and the most shingles that each may have.
PIVOTS = 4
PIVOT_SHINGLES = 20_000


def _shared(packed: bytes, other: bytes) -> float:
    """Jaccard similarity of two packed sets."""
    x, y = np.frombuffer(packed, np.uint64), np.frombuffer(other, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _near_pivot(similarity: float):
    """UDF: numbers of the pivots that a set is near enough to."""

    @F.pandas_udf("array<int>")
    def near(shingles: pd.Series, pivots: pd.Series) -> pd.Series:
        return pd.Series([[i for i, p in enumerate(ps) if _shared(x, p["shingles"]) >= similarity - 1e-9] for x, ps in zip(shingles, pivots, strict=True)])

    return near


def confirmed_links(docs: DataFrame, suspects: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """u, v joining the sets that pairs of Jaccard `similarity` or more join within each root's suspects.

    suspects: node, first (a doc_id that holds the set), n (its shingles), root. Each set is read from its
    text again. Of a root with more than a block, all sets are compared with PIVOTS of them; those near the pivot that most are near to
    are joined by it and need no comparison among themselves. What is left, mostly little, is dealt into blocks that meet each
    other and all blocks of the joined ones, so that no pair of sets that are not joined yet is left out.
    """
    totals = suspects.groupBy("root").agg(F.count("*").alias("weight"), F.sum("n").alias("shingles"))
    totals = totals.where("weight > 1").withColumn("size", F.least(F.lit(BLOCK_SETS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_SHINGLES) * F.col("weight") / F.col("shingles")))).cast("long"))  # sets in a block
    totals = materialize(totals.drop("shingles"), "wide-roots")
    rows = totals.agg(F.sum("weight")).first()[0] or 0
    wanted = lookup(suspects, totals.withColumn("sets", F.col("weight")), "root", "weight", rows).select(F.col("first").alias("doc_id"), "node", "root", "sets", "size")

    @F.pandas_udf("node long, shingles binary")
    def sets_of(texts: pd.Series) -> pd.DataFrame:
        found = [shingle_set(x, shingle) for x in texts]
        return pd.DataFrame({"node": np.array([set_id(x) for x in found], np.int64), "shingles": [x.tobytes() for x in found]})

    wanted = F.broadcast(wanted) if rows <= BROADCAST_IDS else wanted
    read = docs.select("doc_id", "text").join(wanted, "doc_id").select("node", "root", "sets", "size", sets_of("text").alias("s"))
    read = materialize(read.where("s.node = node").select("node", "root", "sets", "size", "s.shingles"), "wide-shingles")  # a doc_id may stand for several texts
    large = read.where("sets > size")
    if not large.limit(1).count():
        return _meeting(read.select("root", "node", "shingles", F.lit(0).alias("low"), F.lit(0).alias("high")), similarity)
    order = F.struct(F.xxhash64("node").alias("h"), "node", "shingles")
    some = large.where(F.length("shingles") <= 8 * PIVOT_SHINGLES)
    # a sample in the order of a hash, kept small in every task before it is gathered
    dealt = some.withColumn("_deal", F.pmod(F.xxhash64("node"), F.lit(64))).groupBy("root", "_deal").agg(F.min(order).alias("p"))
    pivots = dealt.groupBy("root").agg(F.slice(F.array_sort(F.collect_list("p")), 1, PIVOTS).alias("pivots")).join(totals, "root").select("root", "pivots", "weight")
    near = materialize(lookup(large, materialize(pivots, "wide-pivots"), "root", "weight", rows).select("root", "node", F.explode(_near_pivot(similarity)("shingles", "pivots")).alias("i"), "pivots").select("root", "node", "i", F.col("pivots")[F.col("i")]["node"].alias("pivot")), "near-pivots")
    best = near.groupBy("root", "i").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("i", F.struct("n", -F.col("i"))).alias("i"), F.max("n").alias("weight"))
    held = materialize(lookup(near.select(F.struct("root", "i").alias("_at"), "root", "node", "pivot"), best.select(F.struct("root", "i").alias("_at"), "weight"), "_at", "weight", rows).select("root", "node", "pivot").distinct(), "held")
    joined = held.where("node <> pivot").select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v"))
    left = large.join(held.select("root", "node"), ["root", "node"], "left_anti")
    open_ = materialize(left.groupBy("root").agg(F.count("*").alias("open"), F.first("sets").alias("weight")), "open-roots")
    if not open_.limit(1).count():
        return _meeting(read.where("sets <= size").select("root", "node", "shingles", F.lit(0).alias("low"), F.lit(0).alias("high")), similarity).unionByName(joined)
    # blocks 0 to a - 1 hold what is left, a to a + b - 1 what is joined
    marked = large.join(held.select("root", "node", F.lit(True).alias("is_held")), ["root", "node"], "left")
    marked = lookup(marked, open_, "root", "weight", rows).withColumns({"is_held": F.coalesce("is_held", F.lit(False)), "a": F.ceil(F.col("open") / F.col("size")).cast("int"), "b": F.ceil((F.col("sets") - F.col("open")) / F.col("size")).cast("int")})
    own = F.when(F.col("is_held"), F.col("a") + F.pmod(F.xxhash64("node"), F.greatest("b", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), "a")).cast("int")
    every = marked.withColumn("own", own)
    alone = (F.col("a") == 1) & (F.col("b") == 0)
    meets = F.filter(F.sequence(F.lit(0), F.col("a") + F.col("b") - 1), lambda x: ((x != F.col("own")) & ((x < F.col("a")) | ~F.col("is_held"))) | alone)
    pairs = every.select("root", "node", "shingles", "own", F.explode(meets).alias("other")).select("root", "node", "shingles", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    small = read.where("sets <= size").select("root", "node", "shingles", F.lit(0).alias("low"), F.lit(0).alias("high"))
    return _meeting(small.unionByName(pairs), similarity).unionByName(joined)


def _meeting(dealt: DataFrame, similarity: float) -> DataFrame:
    """u, v of the sets that meet under one root, low and high and are joined by pairs of enough similarity."""
    keys = ["root", "low", "high"]
    rows = dealt.select(*keys, "node", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(_confirmed(similarity), "u long, v long")


@tidied
def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs' rows and columns, of each group of near copies only the rows of its smallest doc_id.

    Near copies have a Jaccard similarity of their sets of word shingles of `similarity` or more; groups are
    what such pairs connect. Fingerprints find the groups' suspects, their sets decide. Rows without an id stay.
    """
    tune(docs.sparkSession)

    @F.pandas_udf("node long, fp binary, n int")
    def print_of(texts: pd.Series) -> pd.DataFrame:
        found = [shingle_set(x, shingle) for x in texts]
        return pd.DataFrame({"node": np.array([set_id(x) for x in found], np.int64), "fp": [wide_bits(x) for x in found], "n": np.array([len(x) for x in found], np.int32)})

    known = docs.where("doc_id is not null")
    thin = materialize(known.select("doc_id", print_of("text").alias("p")).select("doc_id", "p.*"), "wide-prints")
    sets = materialize(thin.groupBy("node", "fp", "n").agg(F.min("doc_id").alias("first")), "wide-sets")
    word = lambda i: F.conv(F.hex(F.substring("fp", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"w{i}")
    prints = materialize(sets.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("alike")), "wide-distinct")
    distinct = prints.select("node", *map(word, range(WIDE)))
    tied = components(wide_links(distinct, prints.count(), similarity))
    hung = tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
    groups = prints.join(hung, "node", "left").where("root is not null or alike > 1").select("fp", F.coalesce("root", "node").alias("root"))
    suspects = materialize(sets.join(groups, "fp").select("node", "first", F.col("n").cast("long").alias("n"), "root"), "wide-suspects")
    sure = components(confirmed_links(known, suspects, shingle, similarity))
    member = sure.unionByName(sure.select(F.col("root").alias("node"), "root").distinct())
    named = sets.join(member, "node").groupBy("root").agg(F.min("first").alias("doc_id")).select("doc_id")
    kept = named.unionByName(sets.join(member, "node", "left_anti").select(F.col("first").alias("doc_id")))
    dropped = thin.select("doc_id").join(kept, "doc_id", "left_anti")
    return without_ids(docs, dropped)
