"""Secret scans by multipart credential linking (operator 5, DataFrame functions only).

Base spans, each kind leftmost and non-overlapping, failing matches dropped after matching:
assign (a secret-like name, a separator and a value of 12 or more characters), access (AKIA ids of 18
or more), hex (runs of 16 or more). Positions come from JVM expressions alone: a pattern's matches and
the gaps between them alternate, so running sums of their lengths are the spans, in code points.

Linking adds weak candidates that mean nothing alone: ident (an account or client name and value),
blob (40 characters of mixed base64) and endpoint (a URL). Within SCOPE code points of each other, an
ident counts if a secret (assign, hex or blob) is near, a blob if an identifier (access or ident) is
near, an endpoint if both are. That is an interval join on spans: both sides are dealt into buckets of
SCOPE code points of their document, a candidate looks at its own buckets and the two beside them, and
a semi join keeps it, so no pairs come out and a bucket holds what SCOPE code points can hold.

Edge cases: null and empty texts have no spans (the digest of the empty string, spans ''); rows alike
in doc_id and text give equal rows; null doc_ids are kept apart by their texts; texts are read whole;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import materialize, text_or_empty, tidied, tune

#: Kinds in the order of equal starts; the first three are base spans. Patterns are fixed values.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs are maximal, so shorter ones drop out either way
IDENT = r"""\b(?i:client_?id|access_?key_?id|account(?:_?id)?|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
BLOB = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\x20\x09-\x0D\"'<>]*"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "blob": BLOB, "endpoint": ENDPOINT}
BASE = ("assign", "access", "hex")
SECRET, IDENTIFIER = ("assign", "hex", "blob"), ("access", "ident")
SCOPE = 200
_NUMBER = {k: i for i, k in enumerate(KINDS)}
_SPAN = "array<struct<start: bigint, kind: int, end: bigint>>"
_BLOCK = 1000


def _kept(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN_VALUE, 1)) >= 12
    return F.length(match) >= {"access": 18}.get(kind, 1)


def spans_of(kind: str, text: Column) -> Column:
    """Spans of one kind in a text, as structs of start, kind and end.

    Matches are walked in blocks of _BLOCK, because an array grown by one element at a time costs
    its square.
    """
    pattern = KINDS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(matches, lambda m: F.struct(F.length(m).alias("n"), _kept(kind, m).alias("kept"))).alias("match"))
    # the last gap has no match
    steps = F.transform(F.filter(steps, lambda s: s["match"].isNotNull()), lambda s: F.struct(s["gap"].cast("long").alias("gap"), s["match"]["n"].cast("long").alias("n"), s["match"]["kept"].alias("kept")))
    empty = F.array().cast(_SPAN)

    def walk(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        span = F.struct(start.alias("start"), F.lit(_NUMBER[kind]).alias("kind"), (start + s["n"]).alias("end"))
        return F.struct((start + s["n"]).alias("at"), F.concat(acc["out"], F.when(s["kept"], F.array(span)).otherwise(empty)).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("out")), walk)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: F.slice(steps, b * _BLOCK + 1, _BLOCK))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.when(text.rlike(pattern), F.flatten(F.aggregate(blocks, start, block)["out"])).otherwise(empty)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _of(parts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return parts.where(F.col("kind").isin(*(_NUMBER[k] for k in kinds)))


def _buckets(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / SCOPE), F.floor(last / SCOPE)))


def near(candidates: DataFrame, others: DataFrame) -> DataFrame:
    """The candidates with a span of others within SCOPE code points: an interval semi join by buckets."""
    here = candidates.withColumn("bucket", _buckets(F.greatest(F.col("start") - SCOPE, F.lit(0)), F.col("end") + SCOPE)).alias("c")
    there = others.withColumn("bucket", _buckets(F.col("start"), F.col("end"))).alias("o")
    within = (F.col("c.key") == F.col("o.key")) & (F.col("c.bucket") == F.col("o.bucket")) & (F.col("o.start") <= F.col("c.end") + SCOPE) & (F.col("o.end") >= F.col("c.start") - SCOPE)
    return here.join(there, within, "left_semi").select("c.key", "c.start", "c.kind", "c.end").distinct()


@tidied
def linked_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans (arrays of start, kind and end, in order) for each row of docs."""
    tune(docs.sparkSession)
    text = F.col("_text")
    read = docs.select("doc_id", text_or_empty().alias("_text")).select(
        "doc_id",
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.hex(F.xxhash64(text)), F.lit(":"), F.length(text)).alias("key"),
        F.array_sort(F.concat(*(spans_of(k, text) for k in BASE))).alias("base"),
        F.array_sort(F.concat(*(spans_of(k, text) for k in KINDS if k not in BASE))).alias("weak"),
    )
    thin = materialize(read, "secret-spans")
    every = F.concat("base", "weak")
    linkable = (F.size("weak") > 0) & (F.size(every) > 1)
    parts = thin.where(linkable).groupBy("key").agg(F.first(every).alias("spans")).select("key", F.explode("spans").alias("s")).select("key", "s.*")
    secrets, names = _of(parts, SECRET), _of(parts, IDENTIFIER)
    ends = _of(parts, ("endpoint",))
    added = reduce(DataFrame.unionByName, [near(_of(parts, ("ident",)), secrets), near(_of(parts, ("blob",)), names), near(near(ends, secrets), names)])
    gathered = added.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    none = F.array().cast(_SPAN)
    alone = thin.where(~linkable).select("doc_id", "base", none.alias("added"))
    return alone.unionByName(thin.where(linkable).join(gathered, "key", "left").select("doc_id", "base", F.coalesce("added", none).alias("added")))


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == _NUMBER[k])).cast("long").alias(f"n_{k}")
    return linked_spans(docs).select("doc_id", *map(number, BASE), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "added"))).alias("spans"))
