"""Document fingerprints: bottom-k sketches of shingle hashes, with built-in functions only.

A sketch is the sorted array of the k smallest distinct 48-bit hashes of the
shingles of five words; a text of one to four words is one shingle. Sketches
merge across parts, and estimate resemblance, containment and distinct shingles.

Defined results: null text is empty and has an empty sketch; two empty sketches
are alike (1.0), an empty and another are not (0.0); rows without an id (or with
one that is no integer) come last, in the order of a hash of their text, as do
rows of equal id among each other; repeated rows each give a row, and follow each
other; very long texts count whole; extra columns are left alone, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, partitions, words

K, SHINGLE, BITS, DIGITS = 64, 5, 48, 12


def shingle_hashes(word_array: Column, width: int = SHINGLE) -> Column:
    """48-bit hashes of all shingles. Reference the array by a column, not an expression."""
    n = F.size(word_array)
    cut = lambda h: F.shiftrightunsigned(h, 64 - BITS)
    rolled = F.transform(
        F.sequence(F.lit(0), n - width),
        lambda i: cut(F.xxhash64(*(F.get(word_array, i + j) for j in range(width)))),
    )
    few = F.array(cut(F.xxhash64(F.array_join(word_array, " "))))
    return F.when(n >= width, rolled).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both have."""
    both = merged(a, b, k)
    n = F.size(both)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(n == 0, F.lit(1.0)).otherwise(shared / n)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(
        (F.lit(k) - 1) / (F.element_at(a, -1) / F.lit(float(2**BITS)))
    )


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from the resemblance and both counts."""
    r, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(na == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((1 + r) * na)))


def as_text(a: Column) -> Column:
    """A sketch as fixed-width lower-case hexadecimal numbers, one after the other."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), "")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, text and sketch (array of longs) of every row."""
    d = only(df, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return _sketched(d, "text", "sketch", k)


def _sketched(d: DataFrame, text: str, to: str, k: int) -> DataFrame:
    return d.withColumn("_w", words(F.col(text))).withColumn(to, bottom(shingle_hashes(F.col("_w")), k)).drop("_w")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below key, by binary search within a literal array."""
    at = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    steps = max(1, len(bounds).bit_length())
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        open_ = a["lo"] < a["hi"]
        right = open_ & (F.get(at, mid) <= key)
        return F.struct(
            F.when(right, mid + 1).otherwise(a["lo"]).alias("lo"),
            F.when(open_ & ~right, mid).otherwise(a["hi"]).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda a: a["lo"])


def with_next(d: DataFrame, columns: list[str], sketch=lambda x: x) -> DataFrame:
    """Each row of d(doc_id, text, ...) with next_<column> of the row that follows by doc_id; the first follows the last.

    Rows go once through a shuffle into ranges of ids whose bounds come from
    mergeable quantiles (rows without an id into ranges of a hash of their text,
    behind all others); the first rows of each range are also sent to the range
    before, so the window never needs all rows in one place. sketch() adds
    columns after the shuffle.
    """
    n = 4 * partitions(d.sparkSession)
    id_ = F.expr("try_cast(doc_id AS bigint)")
    d = d.withColumn("_tie", F.xxhash64("text")).withColumn("_key", F.coalesce(id_, F.col("_tie")))
    cuts = d.agg(F.percentile_approx(id_, [i / n for i in range(1, n)], 10_000).alias("b")).first()["b"] if n > 1 else []
    bounds = sorted(set(cuts or []))
    last = F.floor((F.col("_tie") / float(2**64) + 0.5) * n).cast("int")  # n equal ranges of the hash
    d = d.withColumn("_bucket", F.when(id_.isNotNull(), _bucket(F.col("_key"), bounds)).otherwise(len(bounds) + 1 + F.least(last, F.lit(n - 1))))
    firsts = {r["_bucket"]: r["k"] for r in d.groupBy("_bucket").agg(F.min("_key").alias("k")).collect()}  # at most 2 n rows
    there = sorted(firsts)
    before = {b: there[i - 1] for i, b in enumerate(there)}
    buckets = range(len(bounds) + 1 + n)
    first_of = F.lit([firsts.get(b, 0) for b in buckets])
    before_of = F.lit([before.get(b, 0) for b in buckets])
    places = F.when(
        F.col("_key") == F.get(first_of, F.col("_bucket")),
        F.array(
            F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("copy")),
            F.struct(F.get(before_of, F.col("_bucket")).alias("b"), F.lit(True).alias("copy")),
        ),
    ).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("copy"))))
    placed = d.withColumn("_at", F.explode(places)).withColumn("_b", F.col("_at.b")).withColumn("_copy", F.col("_at.copy"))
    placed = placed.drop("_at", "_bucket").repartition("_b")
    w = Window.partitionBy("_b").orderBy("_copy", "_key", "_tie")
    follow = sketch(placed).select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return follow.where(~F.col("_copy")).drop("_b", "_copy", "_key", "_tie")


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Each text, the text that its second half's replacement by the next document's start gives, and both sketches."""
    d = only(df, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    d = with_next(d, ["text", "sketch"], lambda x: _sketched(x, "text", "sketch", k))
    d = d.withColumn("n_chars", F.length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("_half")).cast("int"))
    d = d.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), F.col("_half"))))
    return _sketched(d.drop("_half", "next_text"), "edited", "edited_sketch", k)
