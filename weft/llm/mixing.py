"""Mixing sources to target weights by entropy balancing.

Targets come from weights by water-filling under the cap. The mix is the one nearest to one copy of each document, in
entropy over documents, that meets every source's token constraint with no rate above the cap: a document's rate is
min(cap, exp(lambda of its source * its size)). Newton iterations solve the convex dual; each one sums the tilted words
and their curvature over the cells (source and size) and moves one multiplier a source, inside a bracket that shrinks.

Rates become whole copies cell by cell, from the longest documents to the shortest, and what a cell's rounding misses in
words is carried to the next one, so that a source ends within about half of its shortest documents of its target.
Within a cell the copies are dealt evenly in order of the id's MD5 prefix and the id.

Sums are of whole numbers (rates in units of 1e-9), so equal input gives equal output whatever the partitions. A
source's cells are its distinct sizes, fewer than the root of twice its words; only they are gathered, never documents.

Defined cases: null text has size 0, and documents of size 0 have rate 1; the null source comes last and is a source of
its own; a source without words has target 0; an empty table gives an empty one; repeated rows are mixed one by one.
Other columns are carried along except those that an output replaces.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, without

WORDS = r"[^\x20\x09-\x0D]+"
#: Units of a rate; Newton stops when every source's words are this near their target, as a share.
UNITS, TOLERANCE = 10**9, 1e-9
#: Documents of one slice of a cell that a task ranks, about.
SLICE = 20_000


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(skey, words, target) from (skey, words), one row a source: weights repeat along the sources in order.

    min(cap * words, level * weight) sums to the total; sources fill up in order of cap * words / weight.
    """
    order = Window.orderBy("skey")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    most = F.col("words") * cap
    up = Window.orderBy(F.col("words") * cap / F.col("w"), "skey")
    every = Window.partitionBy()
    rest = F.lit(share) * F.sum("words").over(every) - F.coalesce(F.sum(most).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("w").over(every) - F.coalesce(F.sum("w").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    levelled = sizes.withColumn("w", w).withColumn("level", rest / open_)
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("level") * F.col("w") <= most, F.col("level")), ignorenulls=True).over(whole)
    return levelled.select("skey", "words", F.least(most, F.coalesce(level, F.lit(float("inf"))) * F.col("w")).alias("target"))


def balance(cells: DataFrame, wanted: DataFrame, cap: float, rounds: int = 100) -> DataFrame:
    """(skey, target, lam): distributed Newton on the dual of the token constraints, over cells(skey, size, docs).

    The gradient is the tilted words less the target, the curvature their derivative; a step is taken on the logarithm
    of the words, and halves the bracket instead where it would leave it.
    """
    far = F.log(F.lit(cap)) / F.min("size")  # there every document has rate cap
    least = cells.where("size > 0").groupBy("skey").agg(far.alias("high"))
    start = wanted.where("words > 0").join(least, "skey")
    full = F.col("target") >= F.col("words") * cap  # solved: every document at the cap
    state = materialize(start.select("skey", "target", F.when(full, F.col("high")).otherwise(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), "high"), "dual")
    rate = tilt(cap)
    whole = lambda c: F.sum(c.cast("decimal(38,0)")).cast("double")
    for _ in range(rounds):
        words = F.col("size") * F.col("docs")
        slope = F.when(rate < cap * UNITS, rate.cast("decimal(20,0)") * words * F.col("size")).otherwise(F.lit(0))
        summed = cells.where("size > 0").join(state, "skey").groupBy("skey", "target", "lam", "low", "high").agg(whole(rate.cast("decimal(20,0)") * words).alias("got"), whole(slope).alias("curve"))
        got, over = F.col("got") / UNITS, F.col("got") / UNITS > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") + F.log(F.col("target") / got) * F.col("got") / F.col("curve")
        inside = (F.col("got") > 0) & (F.col("curve") > 0) & (newton < high) & (low.isNull() | (newton > low))
        half = F.when(low.isNull(), F.least(high * 2, F.lit(-1e-6))).otherwise((low + high) / 2)
        off = F.abs(got - F.col("target")) / F.col("target")
        settled = (off <= TOLERANCE) | (low >= high)
        old, state = state, materialize(summed.select("skey", "target", F.when(settled, F.col("lam")).when(inside, newton).otherwise(half).alias("lam"), low.alias("low"), high.alias("high"), settled.alias("settled")), "dual")
        forget(old)
        if state.where("not settled").isEmpty():
            return state.select("skey", "target", "lam")
    raise RuntimeError(f"the dual did not settle in {rounds} Newton rounds")


def tilt(cap: float):
    """A document's rate in units."""
    most = F.log(F.lit(cap))
    return F.floor(F.exp(F.least(F.col("lam") * F.col("size"), most)) * UNITS + 0.5).cast("long")


def whole_copies(rates: DataFrame, cap: int) -> DataFrame:
    """(skey, size, copies): whole numbers for the cells of rates(skey, target, size, docs, rate), longest documents first.

    A cell takes what it asks for, rounded, as far as the shorter documents can make up for the rest.
    """

    def rows(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending")])
        size, docs, rate = (table[c].to_pylist() for c in ("size", "docs", "rate"))
        target = table["target"][0].as_py()
        rest, room = sum(s * d * r for s, d, r in zip(size, docs, rate, strict=True)), cap * UNITS * sum(s * d for s, d in zip(size, docs, strict=True))
        carry = round(target * UNITS) - rest
        copies = []
        for s, d, r in zip(size, docs, rate, strict=True):
            ask, unit = s * d * r + carry, s * UNITS
            rest, room = rest - s * d * r, room - cap * d * unit
            n = d
            if s:
                n = max((2 * ask + unit) // (2 * unit), -((room - rest - ask) // unit))
                n = min(max(min(n, (ask + rest) // unit), 0), cap * d)
            carry = ask - n * unit
            copies.append(n)
        return pa.table({"skey": table["skey"], "size": table["size"], "copies": pa.array(copies, pa.int64())})

    return rates.groupBy("skey").applyInArrow(rows, "skey string, size long, copies long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: int = 2) -> DataFrame:
    """docs with size, source_size, target, copies and taken (= copies * size)."""
    docs = without(docs, "size", "source_size", "target", "copies", "taken")
    names = docs.columns
    sized = docs.select(
        *[docs[c].alias(f"_c{i}") for i, c in enumerate(names)],
        docs[id_col].alias("_id"),
        F.when(docs[source_col].isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), docs[source_col].cast("string"))).alias("skey"),
        F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.md5(docs[id_col].cast("string")), F.lit("")).alias("mark"),
    )
    lengths = materialize(sized.groupBy("skey", "size").agg(F.count("*").alias("docs")), "lengths")
    wanted = materialize(targets(lengths.groupBy("skey").agg(F.sum(F.col("size") * F.col("docs")).alias("words")), weights, share, float(cap)), "targets")
    duals = balance(lengths, wanted, float(cap))
    rates = lengths.join(duals, "skey").withColumn("rate", tilt(float(cap)))
    dealt = lengths.join(whole_copies(rates, cap), ["skey", "size"], "left").join(wanted, "skey")
    plan = materialize(dealt.select("skey", "size", "docs", F.coalesce("copies", "docs").alias("copies"), "words", "target"), "copies")
    digits = len(f"{(plan.agg(F.max('docs')).first()[0] or 1) // SLICE:x}")  # of the mark, enough to slice the largest cell
    slice_ = F.substring("mark", 1, digits).alias("slice")
    before = Window.partitionBy("skey", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy("skey", "size", slice_).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = sized.withColumn("slice", slice_).withColumn("nth", F.row_number().over(Window.partitionBy("skey", "size", "slice").orderBy("mark", "_id")))
    ranked = ranked.join(starts, ["skey", "size", "slice"]).join(plan, ["skey", "size"])
    share_of = lambda n: F.expr(f"({n}) * copies div docs")
    copies = (share_of("start + nth") - share_of("start + nth - 1")).cast("long")
    return ranked.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], "size", F.col("words").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
