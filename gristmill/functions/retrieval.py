"""Schema retrieval: TF-IDF over words and word pairs, and dense vectors, both with top-k by total order."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.catalog import ALIASES, JOINS, METRICS, VIEWS

TOP = 3
WORD = re.compile(r"\b\w\w+\b")


def terms(text: str) -> Counter:
    """Words of two or more characters, lower-cased, and pairs of neighbours."""
    words = WORD.findall(text.lower())
    return Counter(words) + Counter(map(" ".join, zip(words, words[1:])))


def view_documents() -> dict[str, str]:
    return {v: " ".join([v, ALIASES[v], "columns", *VIEWS[v], *METRICS.values()]) for v in VIEWS}


class Retriever:
    """Ranks the views for a question. The four documents are weighed once on the driver."""

    backend = "lexical"

    def __init__(self, documents: dict[str, str] | None = None):
        counts = {k: terms(t) for k, t in (documents or view_documents()).items()}
        seen = Counter(t for c in counts.values() for t in c)
        self.idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in seen.items()}
        self.vectors = {k: self._unit(c) for k, c in counts.items()}

    def _unit(self, counts: Counter) -> dict[str, float]:
        weights = {t: n * self.idf[t] for t, n in counts.items() if t in self.idf}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        return {t: w / norm for t, w in weights.items()}

    def scores(self, question: str) -> dict[str, float]:
        q = self._unit(terms(question))
        return {k: sum(w * v.get(t, 0.0) for t, w in q.items()) for k, v in self.vectors.items()}

    def retrieve(self, question: str, top: int = TOP) -> dict:
        """Views, metrics, aliases and joins for the planner."""
        score = self.scores(question)
        best = sorted(score, key=lambda v: (-score[v], v))[:top]
        return {"backend": self.backend, "views": {v: VIEWS[v] for v in best}, "metrics": METRICS, "aliases": {v: ALIASES[v] for v in best}, "allowed_joins": JOINS}


class DenseRetriever(Retriever):
    """Ranks the views by cosine under a given encoder (a function from texts to vectors). The prefix goes before questions only."""

    backend = "dense"

    def __init__(self, encode, prefix: str = "", documents: dict[str, str] | None = None):
        self.encode, self.prefix = encode, prefix
        texts = documents or view_documents()
        self.rows = dict(zip(texts, map(self._normal, encode(list(texts.values()))), strict=True))

    @staticmethod
    def _normal(vector) -> list[float]:
        norm = math.sqrt(sum(x * x for x in vector)) or 1.0
        return [x / norm for x in vector]

    def scores(self, question: str) -> dict[str, float]:
        q = self._normal(self.encode([self.prefix + question])[0])
        return {k: sum(a * b for a, b in zip(q, v, strict=True)) for k, v in self.rows.items()}


def tokens(text: str) -> Column:
    """Array of words and word pairs of a text column."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, words[i + 1]))
    return F.concat(words, pairs)


def tfidf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, _term, _weight, _idf: L2-normalised, with smoothed inverse document frequency."""
    counts = docs.select(key, F.explode(tokens(text)).alias("_term")).groupBy(key, "_term").agg(F.count("*").alias("_n"))
    spread = counts.groupBy("_term").agg(F.count("*").alias("_df"))
    total = docs.agg(F.count("*").alias("_docs"))  # one row
    idf = spread.crossJoin(F.broadcast(total)).select("_term", (F.log((1.0 + F.col("_docs")) / (1.0 + F.col("_df"))) + 1.0).alias("_idf"))
    weighed = counts.join(idf, "_term").select(key, "_term", (F.col("_n") * F.col("_idf")).alias("_w"), "_idf")
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return weighed.join(norms, key).select(key, "_term", (F.col("_w") / F.col("_norm")).alias("_weight"), "_idf")


#: Documents of one term that meet its queries in one task.
TERM_ROWS = 50_000


def tfidf_search(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, top: int = TOP) -> DataFrame:
    """query_key, rank, key, score: the best documents of each query by TF-IDF cosine, ties by key."""
    weights = tfidf(docs, key, text)
    known = weights.select("_term", "_idf").distinct()
    asked = queries.select(query_key, F.explode(tokens(query_text)).alias("_term")).groupBy(query_key, "_term").agg(F.count("*").alias("_n")).join(known, "_term")
    asked = asked.select(query_key, "_term", (F.col("_n") * F.col("_idf")).alias("_q"))
    norms = asked.groupBy(query_key).agg(F.sqrt(F.sum(F.col("_q") * F.col("_q"))).alias("_qn"))
    # a common term meets all its documents in many tasks: both sides carry its part, the queries every part of it
    parts = weights.groupBy("_term").agg(F.ceil(F.count("*") / TERM_ROWS).cast("int").alias("_parts"))
    dealt = weights.select(key, "_term", "_weight").join(parts, "_term").withColumn("_part", F.pmod(F.xxhash64(key), "_parts").cast("int")).drop("_parts")
    every = asked.join(parts, "_term").select(query_key, "_term", "_q", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    hits = every.join(dealt, ["_term", "_part"]).groupBy(query_key, key).agg(F.sum(F.col("_q") * F.col("_weight")).alias("_dot")).join(norms, query_key)
    return top_k(hits.select(query_key, key, (F.col("_dot") / F.col("_qn")).alias("score")), query_key, key, top)


def top_k(scores: DataFrame, query_key: str, key: str, top: int) -> DataFrame:
    order = Window.partitionBy(query_key).orderBy(F.round("score", 9).desc(), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Queries that may be broadcast, some 10 MB at a thousand components.
BROADCAST_QUERIES = 1024


def vector_search(rows: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, top: int = TOP) -> DataFrame:
    """query_key, rank, key, score by inner product. Up to BROADCAST_QUERIES queries, as counted before, are broadcast and rows stream past once; more go by blocks."""
    asked = queries.select(F.col(query_key), F.col(query_vector).alias("_q"))
    if asked.limit(BROADCAST_QUERIES + 1).count() > BROADCAST_QUERIES:
        return block_search(rows, key, vector, queries, query_key, query_vector, top)
    scored = rows.select(F.col(key), F.col(vector).alias("_v")).crossJoin(F.broadcast(asked)).select(query_key, key, dot("_q", "_v").alias("score"))
    return top_k(scored, query_key, key, top)


#: Queries in a block, and rows in a block that a block of queries meets.
QUERY_BLOCK, ROW_BLOCK = 512, 4096


def block_search(rows: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, top: int = TOP) -> DataFrame:
    """As vector_search, for any number of queries: blocks of queries meet blocks of rows, and of each meeting the best rows go on."""

    def dealt(df: DataFrame, key: str, vector: str, size: int, names: tuple[str, str]) -> DataFrame:
        known = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        block = F.pmod(F.xxhash64(key), F.lit(max(1, math.ceil(known.count() / size))))
        return known.groupBy(block.alias("_b")).agg(F.collect_list(F.struct(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))).alias("_all")).select(F.col("_all.id").alias(names[0]), F.col("_all.v").alias(names[1]))

    def best(batches):
        for batch in batches:
            for asked, q, ids, v in zip(*(batch.column(i) for i in range(4)), strict=True):
                matrix = lambda x: x.values.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                names, queried = ids.values.to_numpy(zero_copy_only=False), asked.values.to_numpy(zero_copy_only=False)
                scores = matrix(q) @ matrix(v).T
                order = [np.lexsort((names, -np.round(line, 9)))[:top] for line in scores]
                at = np.concatenate(order)
                of = np.repeat(np.arange(len(queried)), [len(x) for x in order])
                yield pa.RecordBatch.from_arrays([pa.array(queried[of]), pa.array(names[at]), pa.array(scores[of, at])], names=[query_key, key, "score"])

    asked = dealt(queries, query_key, query_vector, QUERY_BLOCK, ("_q", "_qv"))
    met = asked.crossJoin(dealt(rows, key, vector, ROW_BLOCK, ("_i", "_v")))
    return top_k(met.mapInArrow(best, f"{query_key} long, {key} long, score double"), query_key, key, top)
