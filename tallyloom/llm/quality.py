"""Quality rules: a threshold table compiled into one projection, with built-in functions only.

Stop words are those of four languages; long texts in others fail that rule.

Defined results: null text has no words and fails the base rule; an empty table
gives no rows; repeated rows are judged alike, each on its own, and there are no
ties to break: bounds are inclusive; very long texts are measured whole, their
repeated windows by 64-bit hashes; rows may lack an id; extra columns of the input
are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, words

# Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": "the of and to in is that it for was on as with be by at from this are or not an have which",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más",
}

#: (rule, lowest, highest) over the metrics of measure(); None: no bound.
THRESHOLDS = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 12.0),
    ("symbols_per_word", None, 0.2),
    ("stop_word_ratio", 0.03, None),
    ("dup_line_ratio", None, 0.5),
    ("ellipsis_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("upper_ratio", None, 0.5),
)


def repeated_window_words(word_hashes: Column, width: int = 3) -> Column:
    """Words in width-word windows that stand twice or more in an array of word hashes.

    Windows are sorted by their hash within the row; equal neighbours are repeats,
    and their start positions, sorted, give the union of covered words.
    """
    n = F.size(word_hashes)
    windows = F.when(
        n >= width,
        F.transform(
            F.sequence(F.lit(0), n - width),
            lambda i: F.struct(F.xxhash64(*(F.get(word_hashes, i + k) for k in range(width))).alias("g"), i.alias("p")),
        ),
    ).otherwise(F.array().cast("array<struct<g:bigint,p:int>>"))
    return windows


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """One row a document: its id, the carried value (as `carried`) and every metric of the rules."""
    d = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), (F.lit(None) if carry is None else carry).alias("carried"))
    d = d.withColumn("w", words(F.col("text"))).withColumn("lines", F.split("text", "\n", -1))
    bare = lambda x: F.btrim(x, F.lit(SPACE_CHARS))
    stop = sorted({x for v in STOP_WORDS.values() for x in v.split()})
    d = d.select(
        "doc_id",
        "carried",
        "text",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size(F.filter("w", lambda x: F.btrim(F.lower(x), F.lit(".,;:!?\"'()")).isin(stop))).alias("n_stop"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.filter("lines", lambda x: bare(x) != "").alias("lines"),
    )
    d = d.withColumn("s", F.sort_array(repeated_window_words(F.col("h"))))
    same = lambda x, i: F.coalesce(F.get(F.col("s"), i)["g"] == x["g"], F.lit(False))
    repeats = F.filter("s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    d = d.withColumn("p", F.sort_array(F.transform(repeats, lambda x: x["p"])))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    n_lines = F.size("lines")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    letters = F.length(F.regexp_replace("text", "[^\\p{L}]+", ""))
    return d.select(
        "doc_id",
        "carried",
        "n_words",
        "word_chars",
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        "n_stop",
        n_lines.alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_ellipsis"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).rlike("^[-*•]"))).alias("n_bullets"),
        letters.alias("n_letters"),
        F.length(F.regexp_replace("text", "[^\\p{Lu}]+", "")).alias("n_upper"),
    ).select(
        "*",
        ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        ratio(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        ratio(F.col("n_stop"), F.col("n_words")).alias("stop_word_ratio"),
        ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        ratio(F.col("n_ellipsis"), F.col("n_lines")).alias("ellipsis_line_ratio"),
        ratio(F.col("n_bullets"), F.col("n_lines")).alias("bullet_line_ratio"),
        ratio(F.col("n_upper"), F.col("n_letters")).alias("upper_ratio"),
    )


def verdicts(measured: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Adds base_failed, failed_rules (names) and kept; bounds are inclusive."""
    broken = []
    for name, low, high in thresholds:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(name) < low)
        if high is not None:
            bad = bad | (F.col(name) > high)
        broken.append(F.when(bad, F.lit(name)))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        measured.withColumn("base_failed", base)
        .withColumn("failed_rules", F.array_join(F.array(*broken), ","))
        .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
    )


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of df that the rules keep, with all their columns."""
    # the running id keeps the optimizer from pushing the filter, and a copy of every metric with it, below the metrics
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return verdicts(measure(df, id_col, text_col, row), thresholds).withColumn("once", F.monotonically_increasing_id()).where("kept AND once >= 0").select(*(F.col("carried")[c].alias(c) for c in df.columns))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    return verdicts(measure(df, id_col, text_col), thresholds).drop("carried")
