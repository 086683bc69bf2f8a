"""Language identification by rank-order profiles of letter n-grams.

A profile is the most frequent n-grams (one to three letters, words padded by one
blank) of a language's training texts; a document takes the language whose
profile its own most frequent n-grams are least out of place in.

Defined results: null text or a text without letters gives `und` and score 0, as
does a table without training rows; a language is learned only where it is not
null; ties go to the language that sorts first; an absent id counts as ''; repeated rows
are each named alike; very long texts count whole; extra columns are left alone,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only

TOP = 300
_LETTERS: list = []


def _letters() -> np.ndarray:
    """Code point to itself if it is a letter, else 1 (the blank)."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((i if chr(i).isalpha() else 1 for i in range(0x110000)), np.int64, 0x110000))
    return _LETTERS[0]


def _symbols(text: str) -> np.ndarray:
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _letters()[raw]
    return s[np.concatenate(([True], (s[1:] != 1) | (s[:-1] != 1)))]


def _ngrams(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, start positions) of the n-grams that have no blank inside; symbols take 21 bits each."""
    letter = s != 1
    one = np.flatnonzero(letter)
    two = np.flatnonzero(letter[:-1] | letter[1:])
    three = np.flatnonzero(letter[1:-1])
    codes = np.concatenate((s[one] << 42, (s[two] << 42) | (s[two + 1] << 21), (s[three] << 42) | (s[three + 1] << 21) | s[three + 2]))
    return codes, np.concatenate((one, two, three))


def _top(codes: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes, most frequent first, ties by code."""
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    n = np.diff(np.append(at, len(codes)))
    return codes[at][np.argsort(-n, kind="stable")[:k]]


def _count(batches):
    """Counts of n-grams by language, through counts of words."""
    by: dict[str, Counter] = {}
    size = 0

    def out():
        for lang, counts in by.items():
            seen = list(counts)
            s = np.concatenate([_letters()[np.frombuffer(f" {w}".encode("utf-32-le", "surrogatepass"), np.uint32)] for w in seen] + [np.array([1])])
            own = np.repeat(np.arange(len(seen)), [len(w) + 1 for w in seen])
            codes, start = _ngrams(s)
            weight = np.fromiter(counts.values(), np.int64, len(seen))
            # a bigram or trigram that starts at a blank belongs to the word behind it, as does one that ends at the next
            kinds, back = np.unique(codes, return_inverse=True)
            n = np.bincount(back, weights=weight[own[np.minimum(start, len(own) - 1)]], minlength=len(kinds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds)), pa.array(kinds), pa.array(n)], ["lang", "code", "n"])

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mapped = text.lower().translate(_Blanks)
            c = by.setdefault(lang, Counter())
            before = len(c)
            c.update(mapped.split())
            size += len(c) - before
            if size > 400_000:
                yield from out()
                by, size = {}, 0
    yield from out()


class _BlankTable(dict):
    """str.translate table: what isn't a letter becomes a blank."""

    def __missing__(self, cp):
        self[cp] = cp if chr(cp).isalpha() else " "
        return self[cp]


_Blanks = _BlankTable()


def train_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, rank, code): each language's most frequent n-grams over all given rows."""
    d = only(df, text=text_col, lang=lang_col).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = d.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "rank", "code")


def _guesser(langs: list[str], codes: np.ndarray, ranks: np.ndarray, top: int):
    def guess(text):
        if text is None or not langs:
            return "und", 0.0
        s = _symbols(text)
        if not (s != 1).any():
            return "und", 0.0
        own = _top(_ngrams(s)[0], top)
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        known = codes[at] == own
        place = np.arange(1, len(own) + 1)[known, None]
        gap = np.minimum(np.abs(ranks[at[known]] - place), top).sum(0) + top * (len(own) - known.sum())
        best = int(gap.argmin())
        return langs[best], float(1 - gap[best] / (top * len(own)))

    def run(batches):
        for batch in batches:
            got = [guess(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify(df: DataFrame, profiles: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "held_out"), top: int = TOP) -> DataFrame:
    """The kept columns with lang_pred and score. Profiles are at most `top` rows a language."""
    rows = profiles.collect()
    langs = sorted({r["lang"] for r in rows})
    codes = np.array(sorted({r["code"] for r in rows}), np.int64)
    ranks = np.full((len(codes), len(langs)), 2 * top, np.int64)
    for r in rows:
        ranks[np.searchsorted(codes, r["code"]), langs.index(r["lang"])] = r["rank"]
    kinds = dict(df.dtypes)
    d = df.select(*keep, F.col(f"`{text_col}`").alias("text"))
    return d.mapInArrow(_guesser(langs, codes, ranks, top), ", ".join(f"{c} {kinds[c]}" for c in keep) + ", lang_pred string, score double")


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """Learns from rows outside the held-out quarter, then names every row's language."""
    d = only(df, doc_id=id_col, text=text_col, lang=lang_col)
    d = d.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2)
    profiles = train_profiles(d.where(~F.col("held_out")), "text", "lang", top)
    return identify(d.select("doc_id", "held_out", "text"), profiles, "text", top=top)
