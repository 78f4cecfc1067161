"""Mixing sources to target weights by entropy balancing (operator 10, DataFrame functions only).

Sizes are words. The mix shares `share` of all words among the sources by weight; a source's target
stops at MOST times its size and the excess is shared again (water filling, solved in closed form over
the sorted sources). Each document's rate r in 0..MOST then minimises the entropy to the even rate
under its source's token constraint sum(r * size) = target. The dual is convex with one multiplier a
source, and its solution tilts rates exponentially: r = MOST / (1 + exp(-lambda * size / mean size)).
Newton steps on the log-odds of the constraint solve all sources at once, over the table of
(source, size, documents): documents are counted before anything shuffles, and a round moves that
table only. Rates become copies from the largest size to the smallest, carrying the words left over, so a
source ends within about half its smallest document of its target. Which documents of one size and source get
the extra copy goes by the hash of doc_id and text: those up to a threshold. It is found by counting the group's rows in some
n / PART_ROWS equal ranges of hashes and ranking the rows of one range alone, so no group meets in one task, and the plan is
a table by (source, size) that documents look up where they lie.

Sources are numbered, and their caps summed up, by ranges: rows are sorted within ranges, and what lies before each
range comes from a table of one row a range.

Edge cases: null text: no words, taken 0; null sources are one source, last in order; an empty table
gives an empty result; rows alike in doc_id, source and text are interchangeable; a reserved column
name in docs is no clash, as rows travel as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import lookup, materialize, tidied, tune

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
ROUNDS = 60
EXACT = 1e-9
PART_ROWS = 1000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    """Number of words of a whole text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with each of `sums` summed over the rows before a row in the given order, which must tell all rows apart.

    Rows are dealt to ranges and written; a window then sees one range, and another one row for each range.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, order, strict=True)) | {f"_s_{c}": x for c, x in sums.items()})
    ranged = materialize(keyed.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = ranged.groupBy("_range").agg(*(F.sum(f"_s_{c}").alias(f"_t_{c}") for c in sums))
    starts = totals.select("_range", *(zero(F.sum(f"_t_{c}").over(before)).alias(f"_b_{c}") for c in sums))
    own = ranged.withColumns({f"_i_{c}": zero(F.sum(f"_s_{c}").over(inside)) for c in sums})
    return own.join(F.broadcast(starts), "_range").select(*df.columns, *((F.col(f"_b_{c}") + F.col(f"_i_{c}")).alias(c) for c in sums))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """source, source_size, documents, sid, target from source, source_size and documents."""
    named = running(sources, [F.col("source").isNull(), F.coalesce("source", F.lit(""))], {"sid": F.lit(1).cast("long")})
    weighed = named.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights)).cast("int") + 1).cast("double"), "cap": MOST * F.col("source_size").cast("double")})
    laid = materialize(running(weighed, [F.col("cap") / F.col("weight"), F.col("sid")], {"caps_before": F.col("cap"), "weight_before": F.col("weight")}), "caps")
    words_, weight = laid.agg(F.sum("source_size"), F.sum("weight")).first()
    all_words, weight = share * float(words_ or 0), weight or 0.0
    capped = (F.lit(all_words) - F.col("caps_before")) >= F.col("cap") / F.col("weight") * (F.lit(weight) - F.col("weight_before"))
    full, open_ = laid.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
    level = (all_words - (full or 0.0)) / open_ if open_ else 0.0
    return laid.select("source", "source_size", "documents", "sid", F.when(capped, F.col("cap")).otherwise(F.least(F.col("cap"), F.lit(level) * F.col("weight"))).alias("target"))


def rates(counts: DataFrame, goals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """sid, size, n, rate: the balanced rates. counts: sid, size, n; goals: sid, source_size, documents, target."""
    full = F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)
    none = F.col("target") <= 0
    base = goals.select("sid", "target", (MOST * F.col("source_size")).cast("double").alias("most"), (F.col("source_size") / F.col("documents")).alias("mean"), (full | none).alias("fixed"), F.when(full, F.lit(float(MOST))).otherwise(0.0).alias("fixed_rate"), F.lit(0.0).alias("lam"))
    now = materialize(base, "multipliers")
    tilt = lambda: F.col("lam") * F.col("size") / F.col("mean")
    odds = lambda part, whole: F.log(part / (whole - part))
    for _ in range(rounds):
        one = F.lit(1.0) / (1.0 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt()))))
        terms = counts.join(now.where("not fixed"), "sid").withColumn("p", one)
        sums = terms.groupBy("sid").agg(
            F.sum(F.col("n") * F.col("size") * MOST * F.col("p")).alias("f"),
            F.sum(F.col("n") * F.col("size") * MOST * F.col("p") * (1.0 - F.col("p")) * F.col("size") / F.col("mean")).alias("slope"),
        )
        step = (odds(F.col("target"), F.col("most")) - odds(F.col("f"), F.col("most"))) * F.col("f") * (F.col("most") - F.col("f")) / F.col("most") / F.col("slope")
        off = F.abs(F.col("f") - F.col("target")) / F.col("target")
        moving = (~F.col("fixed")) & (off > EXACT) & (F.col("slope") > 0) & (F.col("f") < F.col("most"))
        moved = now.join(sums, "sid", "left").select(*now.columns[:-1], F.when(moving, F.col("lam") + step).otherwise(F.col("lam")).alias("lam"), F.coalesce(moving, F.lit(False)).alias("moving"))
        after = materialize(moved, "multipliers")
        now = after.drop("moving")
        if not after.where("moving").limit(1).count():
            break
    else:
        raise ArithmeticError(f"the rates of some source did not settle in {rounds} rounds")
    one = F.lit(float(MOST)) / (1.0 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt()))))
    return counts.join(now, "sid").select("sid", "size", "n", F.when(F.col("fixed"), F.col("fixed_rate")).otherwise(F.round(one, 9)).alias("rate"))  # sums in another order change nothing


def copies(rated: DataFrame) -> DataFrame:
    """sid, size, n, total: copies in all of the n documents of a size, with the words left over carried on.

    One array a source holds its distinct sizes, whose number the longest text bounds, not the documents.
    """
    entry = F.struct((-F.col("size")).alias("minus"), "n", "rate")
    start = "cast(named_struct('err', 0D, 'done', array()) as struct<err: double, done: array<struct<size: bigint, n: bigint, total: bigint>>>)"
    total = "greatest(0L, least({most} * x.n, cast(round((x.n * x.rate * -x.minus + acc.err) / -x.minus) as bigint)))".format(most=MOST)
    step = f"""named_struct('err', acc.err + (x.n * x.rate - {total}) * -x.minus,
        'done', concat(acc.done, array(named_struct('size', -x.minus, 'n', x.n, 'total', {total}))))"""
    rounded = rated.where("size > 0").groupBy("sid").agg(F.array_sort(F.collect_list(entry)).alias("sizes"))
    return rounded.select("sid", F.explode(F.expr(f"aggregate(sizes, {start}, (acc, x) -> {step}).done")).alias("s")).select("sid", "s.*")


def _group() -> Column:
    """source and size as one key."""
    return F.concat(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), F.lit("\u0000"), F.col("size").cast("string"))


def plan(thin: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """How often to take the documents of each (source, size), from thin (source, size and a hash h).

    _group, n, source_size, target, each (copies of every document), and of the extra ones: limit, the hash at which they end (null: none
    is given), ties (rows with that hash) and given (how many of them still get one; those with smaller hashes all do).
    """
    hist = materialize(thin.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    goals = materialize(targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents")), weights, share), "targets")
    counts = hist.alias("h").join(goals.alias("g"), F.col("h.source").eqNullSafe(F.col("g.source"))).select("g.sid", "h.size", "h.n")
    done = copies(rates(counts, goals))
    named = counts.join(done.select("sid", "size", "total"), ["sid", "size"], "left").join(goals, "sid").withColumn("total", F.coalesce("total", F.lit(0)))
    table = materialize(named.select(_group().alias("_group"), "n", "source_size", "target", F.floor(F.col("total") / F.col("n")).alias("each"), (F.col("total") % F.col("n")).alias("more")), "copies")
    rows = hist.agg(F.sum("n")).first()[0] or 0
    # the extra copies: which range of hashes holds the last one, then which hash
    spread = (F.col("h") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("n") / PART_ROWS)
    uneven = lookup(thin.select(_group().alias("_group"), "h"), table.where("more > 0").select("_group", "n", "more", F.col("n").alias("weight")), "_group", "weight", rows).withColumn("part", F.floor(spread))
    upto = Window.partitionBy("_group").orderBy("part")
    parts = uneven.groupBy("_group", "part", "more").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(upto))
    here = materialize(parts.where((F.col("upto") >= F.col("more")) & (F.col("upto") - F.col("c") < F.col("more"))).select("_group", "part", (F.col("more") - F.col("upto") + F.col("c")).alias("left"), F.col("c").alias("weight")), "last-parts")
    ranked = lookup(uneven.select(F.struct("_group", "part").alias("_at"), "h"), here.select(F.struct("_group", "part").alias("_at"), "left", "weight"), "_at", "weight", rows)
    hashes = ranked.groupBy("_at", "left", "h").agg(F.count("*").alias("ties")).withColumn("upto", F.sum("ties").over(Window.partitionBy("_at").orderBy("h")))
    last = hashes.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("ties") < F.col("left")))
    last = last.select(F.col("_at._group").alias("_group"), F.col("h").alias("limit"), "ties", (F.col("left") - F.col("upto") + F.col("ties")).alias("given"))
    return materialize(table.drop("more").join(last, "_group", "left"), "mix-plan")


def _partly() -> Column:
    """Is the row one of those that tie at the limit, of which only some get the extra copy?"""
    return F.expr("coalesce(h = limit and given < ties, false)")


def _copies() -> Column:
    """Copies of any other row."""
    return F.expr("each + cast(coalesce(h < limit or (h = limit and given = ties), false) as int)")


@tidied
def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies for each row of docs."""
    tune(docs.sparkSession)
    thin = materialize(docs.select("doc_id", "source", words().alias("size"), F.xxhash64("doc_id", "text").alias("h")), "mix-thin")
    table = plan(thin, weights, share)
    rows = thin.count()
    found = lookup(thin.withColumn("_group", _group()), table.withColumn("weight", F.col("n")), "_group", "weight", rows)
    keep = ["doc_id", "size", "source_size", "target"]
    sure = found.where(~_partly()).select(*keep, _copies().alias("copies"))
    # rows alike in doc_id, source and text, of which some get the extra copy: dealt to parts, each with its share of them
    ties = materialize(found.where(_partly()).withColumn("_nr", F.monotonically_increasing_id()), "mix-ties").withColumn("_part", F.pmod(F.xxhash64("_nr"), F.ceil(F.col("ties") / PART_ROWS)))
    upto = Window.partitionBy("_group").orderBy("_part")
    dealt = ties.groupBy("_group", "_part", "given", "ties").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(upto))
    dealt = dealt.select("_group", "_part", (F.floor(F.col("given") * F.col("upto") / F.col("ties")) - F.floor(F.col("given") * (F.col("upto") - F.col("c")) / F.col("ties"))).alias("_extra"))
    turn = F.row_number().over(Window.partitionBy("_group", "_part").orderBy("_nr"))
    some = ties.join(dealt, ["_group", "_part"]).withColumn("_turn", turn).select(*keep, (F.col("each") + (F.col("_turn") <= F.col("_extra")).cast("int")).alias("copies"))
    return sure.unionByName(some).select(*keep, (F.col("copies") * F.col("size")).alias("taken"), "copies")


#: Groups of (source, size) whose plan may be broadcast, some 100 bytes each; for more of them texts are shuffled to their plan.
BROADCAST_GROUPS = 200_000


@tidied
def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """docs' rows, each as often as the mix takes it. Texts stay where they are, unless there are more than BROADCAST_GROUPS groups."""
    tune(docs.sparkSession)
    tagged = docs.select(F.struct("*").alias("_row"), "source", words().alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    thin = materialize(tagged.select("source", "size", "h"), "mix-thin")
    table = plan(thin, weights, share).where("each > 0 or limit is not null").select("_group", "n", "each", "limit", "ties", "given")
    few = table.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    keyed = tagged.select("_row", "h", _group().alias("_group"))
    found = keyed.join(F.broadcast(table.drop("n")), "_group") if few else lookup(keyed, table.withColumnRenamed("n", "weight"), "_group", "weight", thin.count())
    often = lambda df, n: df.where(n > 0).select(F.explode(F.array_repeat("_row", n.cast("int"))).alias("_row")).select("_row.*")
    every = often(found, F.when(_partly(), F.col("each")).otherwise(_copies()))
    if not table.where("given < ties").limit(1).count():
        return every
    # rows alike in doc_id, source and text, of which some get the extra copy: one of them stands for all, given times
    partly = found.where(_partly()).groupBy("_group", "h", "given").agg(F.first("_row").alias("_row"))
    chunks = partly.select("*", F.explode(F.expr(f"sequence(0L, (given - 1) div {PART_ROWS})")).alias("_chunk")).repartition("_group", "_chunk")
    return every.unionByName(often(chunks, F.least(F.lit(PART_ROWS), F.col("given") - F.col("_chunk") * PART_ROWS)))
