"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its weight's share of all words, stopped at a number of
times its own size, the excess reshared. Whole copies that a target surely needs
go to every document of the source. The rest of the target is drawn: a document's
odds of inclusion come from its size (a long one, whose chance would make the
words taken vary most, is the surer to be in), documents are ranked by their
random odds divided by their inclusion odds, and a fixed number of the least is
taken.

Numbers are fixed for each class of documents of nearly equal size of a source
(STEPS classes an octave), so that a fixed number of documents is a nearly fixed
number of words: classes of inclusion probability 1 are taken whole first, and
what rounding leaves over in a class goes to the next smaller one. Within a class
the last rank taken is found in bins of the ranking value, some BIN documents
each, so no task ranks a whole class.

Random numbers are hashes of id and text, so reruns agree.

Defined results: null text has size 0, and such documents get whole copies only;
null is a source of its own, sorted last; a source without words has target 0;
rows without an id, and repeated rows, draw by id and text, equal rows being told
apart by a number of their own, so that each counts; very long texts count whole;
extra columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, only, partitions, ship, written

WEIGHTS, MOST, SEED = (5.0, 2.0, 1.0), 3.0, 20_24
STEPS, BIN = 16, 256


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size) with each source's place by code point, null last, from 0.

    Sources are dealt out in ranges and numbered there; only the ranges' counts
    come to the driver, so their number has no limit.
    """
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sizes.repartitionByRange(partitions(sizes.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt)  # its ranges are sampled: read again, they would be others
    counts = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    before, sum_ = {}, 0
    for k in sorted(counts):
        before[k], sum_ = sum_, sum_ + counts[k]
    start = F.lit([before.get(k, 0) for k in range(max(counts, default=0) + 1)])
    own = Window.partitionBy("_range").orderBy(*order)
    return dealt.withColumn("place", F.row_number().over(own) - 1 + F.get(start, F.col("_range"))).drop("_range")


def with_targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds weight and target to sources(source, source_size, place): in proportion to weights, none above most times its size.

    Sources at their most leave the sharing, round by round; each round is one
    sum over the table, and only the level of a weight of 1 comes to the driver.
    """
    w = F.element_at(F.lit([float(x) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = written(sources.withColumn("weight", w))
    most_ = F.col("source_size") * float(most)
    level, all_ = 0.0, None
    while True:
        over = F.col("weight") * level > most_
        r = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, most_)).alias("at_most"), F.sum(F.when(~over, F.col("weight"))).alias("weights")).first()
        all_ = float(r["all"] or 0)
        new = max(0.0, all_ - (r["at_most"] or 0.0)) / r["weights"] if r["weights"] else level
        if new <= level:
            break
        level = new
    return s.withColumn("target", F.least(F.col("weight") * level, most_))


def size_class(size: Column) -> Column:
    """Number of the class of nearly equal sizes; -1 for no words."""
    return F.when(size > 0, F.floor(STEPS * F.log2(size.cast("double"))).cast("int")).otherwise(-1)


def class_numbers(classes: list[tuple[int, int, int]], rest: float) -> list[int]:
    """How many documents to draw of each (class, documents, words), so that the words come to rest.

    Inclusion probabilities are in proportion to a class's mean size, and at most
    1: the largest classes are taken whole while theirs would be above. The words
    that rounding to whole documents leaves over go to the next smaller class, and
    none goes beyond rest while smaller documents can fill up to it.
    """
    order = sorted((i for i, c in enumerate(classes) if c[2] > 0), key=lambda i: -classes[i][0])
    mean = {i: classes[i][2] / classes[i][1] for i in order}
    squares, left, numbers = sum(mean[i] * classes[i][2] for i in order), rest, [0] * len(classes)
    factor = None
    due, taken, smaller = 0.0, 0.0, sum(classes[i][2] for i in order)
    for i in order:
        _, n, words = classes[i]
        if factor is None and squares > 0 and left / squares * mean[i] < 1:
            factor = left / squares
        if factor is None:
            left, squares = left - words, squares - mean[i] * words
        due, smaller = due + words * (1.0 if factor is None else factor * mean[i]), smaller - words
        numbers[i] = max(0, min(n, math.floor((min(due, rest) - taken) / mean[i] + 0.5)))
        if numbers[i] and taken + numbers[i] * mean[i] > rest and taken + (numbers[i] - 1) * mean[i] + smaller >= rest:
            numbers[i] -= 1
        taken += numbers[i] * mean[i]
    return numbers


def _numbered(batches):
    """(source, class, draws) of every class of sources(source, rest, classes)."""
    for batch in batches:
        for source, rest, classes in zip(*(batch.column(c).to_pylist() for c in ("source", "rest", "classes")), strict=True):
            rows = [(c["class"], c["n"], c["words"]) for c in classes]
            k, n, words = zip(*rows, strict=True)
            draws = class_numbers(rows, rest)
            yield pa.RecordBatch.from_arrays(
                [pa.array([source] * len(rows), pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array(draws, pa.int64())],
                ["source", "class", "n", "words", "draws"],
            )


def ranking_value(u: Column, size: Column, n: Column, words: Column, draws: Column) -> Column:
    """Random odds divided by inclusion odds, the inclusion probability being in proportion to size within its class; null where nothing is drawn."""
    p = F.least(draws * size / words, F.lit(1 - 1e-9))
    return F.when((draws > 0) & (draws < n), (u / (1 - u)) / (p / (1 - p)))


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, carry: list[str] | None = None) -> DataFrame:
    """_id, source, size (words), class, the draw u in (0, 1), a tie-break and a number for every row, with columns to carry as carried_0, ..."""
    own = {f"carried_{i}": c for i, c in enumerate(carry or [])}
    d = only(df, doc_id=id_col, source=source_col, text=text_col, **own)
    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACE_CHARS))
    size = F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit("[\\x20\\x09-\\x0D]+")) + 1).cast("long")
    # a hash passes over nulls: flags keep (null, x) and (x, null) apart
    h = F.xxhash64(F.lit(SEED), F.isnull("doc_id"), "doc_id", F.isnull("text"), "text")
    u = (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(2**52)
    tie = F.xxhash64(*(x for c in own for x in (F.isnull(c), F.col(c)))) if own else F.lit(0).cast("long")
    d = d.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), u.alias("u"), tie.alias("tie"), *own)
    return d.withColumn("class", size_class(F.col("size"))).withColumn("number", F.monotonically_increasing_id())


def mix(table: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds source_size, target, copies and taken to sized() rows, which are read thrice: pass a written table."""
    narrow = table.select("doc_id", "source", "size", "class", "u", "tie", "number")
    classes = written(narrow.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = with_targets(ranked_sources(sizes), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int")
    sources = sources.withColumn("whole", F.least(whole, F.lit(int(most))))
    sources = sources.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    # a source has some STEPS classes for each doubling of its longest text, at any number of rows
    of_source = classes.groupBy("source").agg(F.collect_list(F.struct("class", "n", "words")).alias("classes"))
    same = of_source["source"].eqNullSafe(sources["source"])
    ship(table.sparkSession)
    drawn = of_source.join(sources.select("source", "rest"), same).select(of_source["source"], "rest", "classes").mapInArrow(_numbered, "source string, class int, n long, words long, draws long")
    own = sources.drop("place", "weight", "rest").withColumnRenamed("source", "_s")
    plan = written(drawn.join(own, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    # the last rank taken of each class that is drawn in part
    part = plan.where("draws > 0 AND draws < n").select("source", "class", "n", "words", "draws")
    value = ranking_value(F.col("u"), F.col("size"), F.col("n"), F.col("words"), F.col("draws"))
    # u again but for the odds within the class: bins of it hold nearly equal numbers
    p = F.col("draws") / F.col("n")
    even = F.col("q") * p / (1 - p)
    bin_ = F.floor(even / (1 + even) * F.ceil(F.col("n") / BIN)).cast("long")
    in_part = _joined(narrow, part).withColumn("q", value).withColumn("bin", bin_)
    bins = in_part.groupBy("source", "class", "bin", "draws").agg(F.count("*").alias("have"))
    before = Window.partitionBy("source", "class").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("have").over(before), F.lit(0)))
    edge = written(bins.where("before < draws AND before + have >= draws").select("source", "class", F.col("bin").alias("edge"), "before"))
    key = F.struct("q", "doc_id", "tie", "number")
    at_edge = _joined(in_part, edge).where("bin = edge").withColumn("key", key)
    rank = F.row_number().over(Window.partitionBy("source", "class").orderBy("key")) + F.col("before")
    last = at_edge.withColumn("rank", rank).where("rank = draws").select("source", "class", F.col("key").alias("last"))
    plan = written(plan.join(last.withColumnRenamed("source", "_s").withColumnRenamed("class", "_c"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c")), "left").drop("_s", "_c"))
    d = _joined(table, plan).withColumn("q", value)
    extra = (F.col("draws") >= F.col("n")) | ((F.col("draws") > 0) & (key <= F.col("last")))
    d = d.withColumn("copies", F.col("whole") + F.when(extra, 1).otherwise(0))
    return d.withColumn("taken", F.col("copies") * F.col("size")).drop("class", "n", "words", "draws", "whole", "last", "q", "u", "tie", "number")


def _joined(rows: DataFrame, by_class: DataFrame) -> DataFrame:
    """rows with what by_class(source, class, ...) has for theirs; Spark broadcasts it if it is small."""
    b = by_class.withColumnRenamed("source", "_s").withColumnRenamed("class", "_c")
    return rows.join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c"))).drop("_s", "_c")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    return mix(written(sized(df, id_col, text_col, source_col)), weights, most)


def mixed_rows(df: DataFrame, weights=WEIGHTS, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of df themselves, each as often as the mix takes it."""
    d = mix(written(sized(df, id_col, text_col, source_col, carry=df.columns)), weights, most)
    d = d.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return d.select(*(F.col(f"carried_{i}").alias(c) for i, c in enumerate(df.columns)))
