"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

A source's documents stand in a shuffled order (by a hash of id and text) and their words, one behind the other, are cut
into blocks of BLOCK words. Slot k of the schedule has the point frac((k + 1) / golden ratio); the source whose stretch of
the cumulative shares holds the point gets the slot, and the slot's rank within its source names its block; the
order goes around when a source is used up. So every stretch of the schedule has the sources in their shares. A source's
last block is cut at its target, and where the points leave it a block short, slots behind the others have it.

Places and ranks are sums over ranges, first of their totals and then within: no source, however large, is one task's.
Points are whole numbers modulo 2**52, exact for any slot.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

#: Words of a block.
BLOCK = 128
#: Bits of a point, and the golden ratio's inverse in them: the odd number next to it, with which all points come up.
POINT_BITS = 52
GOLDEN = 2783377641436329


def targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by code point, null last: shares by weight of budget times all sizes, none above most times its size.

    The excess of sources at their limit is shared out among the others, by weight, until none is above. One row for
    each source comes to the driver.
    """
    rows = sorted(((r["source"], int(r["size"] or 0)) for r in sizes.collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(rows)}
    limit = {s: most * n for s, n in rows}
    left, open_, target = budget * sum(n for _, n in rows), [s for s, _ in rows], {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > limit[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: limit[s] for s in full}
        left -= sum(limit[s] for s in full)
        open_ = [s for s in open_ if s not in target]
    return [(s, n, target[s]) for s, n in rows]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def ranges(n: int) -> int:
    """Into how many ranges n rows are dealt: about the root of their number, so both the ranges and what each holds stay small."""
    return 1 << max(4, (max(1, n).bit_length() + 1) // 2)


def point(k: Column) -> Column:
    """k * GOLDEN modulo 2**52, for k below 2**42: products of parts, none of which passes 2**63."""
    low, high = GOLDEN & ((1 << 26) - 1), GOLDEN >> 26
    k0, k1 = F.pmod(k, F.lit(1 << 21)), F.floor(k / (1 << 21))
    middle = F.pmod(k1 * low, F.lit(1 << 31)) * (1 << 21)
    upper = F.pmod(F.pmod(k, F.lit(1 << 26)) * high, F.lit(1 << 26)) * (1 << 26)
    return F.pmod(k0 * low + middle + upper, F.lit(1 << POINT_BITS))


def schedule(spark: SparkSession, targets_: list[int], block: int = BLOCK) -> DataFrame:
    """s, rank and slot: the slots of sources 0, 1, ... with these targets in words, and of each its rank within its source.

    A source has a slot for each of its blocks: those that the points give beyond them go, those that they lack stand behind.
    """
    total = sum(targets_)
    n = -(-total // block)
    needed = [-(-t // block) for t in targets_]
    ends, so_far = [], 0
    for t in targets_:
        so_far += t
        ends.append(round(Fraction(so_far, total) * (1 << POINT_BITS)))
    # the stretches are as many as sources: a sorted array of their ends, searched by counting
    number = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("point")))
    width = -(-n // ranges(n))
    slots = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id") + 1).alias("point")).select("slot", number.alias("s"), F.floor(F.col("slot") / width).alias("r"))
    totals = cut(slots.groupBy("s", "r").agg(F.count(F.lit(1)).alias("n")))
    before = totals.select("s", "r", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("r", "s").orderBy("slot")) - 1
    ranked = slots.withColumn("inside", inside).join(before, ["s", "r"]).select("s", (F.col("before") + F.col("inside")).alias("rank"), "slot")
    # one row for each source
    have = {r["s"]: r["n"] for r in totals.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    late = [(s, rank) for s, k in enumerate(needed) for rank in range(have.get(s, 0), k)]
    known = F.get(F.array(*map(F.lit, needed)), F.col("s"))
    return ranked.where(F.col("rank") < known).unionByName(spark.createDataFrame([(s, rank, n + k) for k, (s, rank) in enumerate(late)], "s int, rank long, slot long"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: its id, size, source_size, target, taken, source, place (its first word in the source's
    order) and row (a hash of id and text).

    taken counts the words that the scheduled blocks hold of it, repeats too; a source's order goes around at most `most`
    (a whole number of) times, so no document gives more than that times its size, and all of a source give its target,
    rounded. A null text has size 0; a null source is a source of its own, after all others. A document without words takes
    part with 0. Rows that are alike in id and text stand side by side in the order and are counted each. An empty table
    gives no rows; further columns are left out. Runs again agree: order and schedule hang on the rows alone.
    """
    spark = docs.sparkSession
    rows = cut(docs.select(F.col(id_col).alias("i"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _row(id_col, text_col).alias("row")))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, budget, most)
    names = f"source {docs.schema[source_col].dataType.simpleString()}, s int, source_size long, target double, words long"
    words = [min(round(t), int(most) * n) for _, n, t in plan]
    of_source = F.broadcast(spark.createDataFrame([(s, k, n, float(t), w) for k, ((s, n, t), w) in enumerate(zip(plan, words, strict=True))], names))
    known = rows.join(of_source, rows["source"].eqNullSafe(of_source["source"])).drop(of_source["source"])
    out = [F.col("i").alias(id_col), "size", "source_size", "target", "taken", F.col("source").alias(source_col), "place", "row"]
    none = known.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("place", F.lit(None).cast("long")).select(*out)
    if not sum(words):
        return known.withColumn("taken", F.lit(0).cast("long")).withColumn("place", F.lit(None).cast("long")).select(*out)

    # places: documents with words fall into ranges of the hash, whose totals come first
    n = ranges(rows.count())
    known = known.where("size > 0").withColumn("b", F.shiftrightunsigned("row", 64 - (n.bit_length() - 1)))
    totals = known.groupBy("s", "b").agg(F.sum("size").alias("n"))
    before = totals.select("s", "b", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("s", "b").orderBy("row", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = known.withColumn("inside", inside).join(before, ["s", "b"]).withColumn("place", F.col("before") + F.col("inside")).drop("b", "before", "inside")

    # rank r holds the words from r * BLOCK on of the source's order, gone around up to its target
    around = placed.select("s", "place", "size", "source_size", "words", F.explode(F.sequence(F.lit(0), F.lit(int(most) - 1))).alias("round"))
    begin = F.col("place") + F.col("round") * F.col("source_size")
    around = around.withColumn("begin", begin).withColumn("end", F.least(begin + F.col("size"), "words")).where("begin < end")
    parts = around.select("s", "place", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("rank"))
    held = F.least("end", (F.col("rank") + 1) * BLOCK) - F.greatest("begin", F.col("rank") * BLOCK)
    got = parts.join(schedule(spark, words), ["s", "rank"]).groupBy("s", "place").agg(F.sum(held).alias("got"))
    return placed.join(got, ["s", "place"], "left").withColumn("taken", F.coalesce("got", F.lit(0)).cast("long")).select(*out).unionByName(none)


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit("mix"), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def _word_range(text: Column, n: Column) -> Column:
    """The first n words of a text, white space between them as it stands."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), F.lit(1), n), " ")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of docs: a document stands once for each time that it is taken whole, and where
    blocks hold a part of it, that many of its words stand in a row of their own, joined by single spaces.

    n_chars, where docs has it, is that of the row's text. Rows that repeat an id are documents of their own; those that
    are alike in id, text and source share what the mix takes of them all evenly, the rest going to the first. Documents of
    which nothing is taken are left out, as are those without words.
    """
    mixed = mix_sources(docs, weights, budget, most, id_col, text_col, source_col)
    plan = mixed.where("taken > 0").groupBy(F.col("row").alias("__row"), F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col("size").alias("__size")).agg(F.sum("taken").alias("__sum"))
    given = docs.withColumn("__own", _row(id_col, text_col))
    joined = given.join(plan, (F.col("__own") == F.col("__row")) & F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")))
    # the join has brought equal hashes together, so alike rows are counted without another shuffle
    alike = Window.partitionBy("__own", id_col, source_col)
    joined = joined.withColumn("__n", F.count(F.lit(1)).over(alike)).withColumn("__k", F.row_number().over(alike.orderBy("__sum")))
    total, n = F.col("__sum"), F.col("__n")
    joined = joined.withColumn("__taken", F.floor(total / n) + F.when(F.col("__k") <= total % n, 1).otherwise(0)).where("__taken > 0")
    size, taken = F.col("__size"), F.col("__taken")
    whole, rest = F.floor(taken / size).cast("int"), (taken % size).cast("int")
    parts = F.concat(F.array_repeat(F.col(text_col), whole), F.when(rest > 0, F.array(_word_range(F.col(text_col), rest))).otherwise(F.array().cast("array<string>")))
    rows = joined.withColumn("__text", F.explode(parts))
    return rows.select(*[F.col("__text").alias(c) if c == text_col else F.length("__text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
