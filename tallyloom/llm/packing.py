"""Best-fit-decreasing packing of tokenized documents into sequences of a fixed capacity.

Lengths lie between 1 and the capacity, so a histogram of them, bounded by the
capacity at any size of input, is all that planning needs. The plan takes
lengths in decreasing order and puts documents into the tightest open bin, found
in a segment tree over remaining capacities; bins of equal remaining capacity
are interchangeable, so runs of equal documents go into runs of equal bins at
once. Every document then finds its bin by its rank among those of its length.
The outcome is that of best-fit decreasing over all documents, not of parts.

Defined results: null text is empty and becomes one piece with the end token
alone; repeated rows and rows without an id are packed each on their own; texts of
any length are tokenized whole and cut into pieces; pieces of equal length (ties)
take their places by id, piece and checksum; extra columns are left alone, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewise import slices
from .common import only, partitions, written

CAPACITY, END = 4096, 1
#: Distinct parts of texts whose ids a worker remembers, some 60 MB of them; beyond it the memory starts anew.
REMEMBERED = 200_000


# The settings of a tokenizer of lower-case words whose parts _Ids can cut by itself.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPLIT = {"type": "Split", "pattern": {"Regex": _CUT}, "behavior": "Removed", "invert": True}
#: Latin letters, digits and signs, which are in normal form C and none of which is a blank.
_LATIN = re.compile("[!-~\u00a1-\u024f]+")
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: What str.split takes for blanks and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """str.translate table from Latin-1 characters, one a byte, to a byte-level vocabulary's letters."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + hidden.index(b)) for b in hidden}


class _Ids(dict):
    """Ids of the parts of a text between blanks, which such a tokenizer never joins.

    The words of a Latin part are cut here and given to the vocabulary's model,
    once for each distinct word; other parts go through the whole tokenizer, and
    under any other settings whole texts do.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.table = self.tokenizer.model, _byte_letters()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = {k: v for k, v in (steps[0] if steps else {}).items() if k in _SPLIT}
        self.known = (told.get("normalizer") or {}).get("normalizers") == _NORMAL and split == _SPLIT and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        self.cut = regex.compile(_CUT)
        self.held = [t["content"] for t in told.get("added_tokens", [])]
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        ids = self.words[word] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        word, words = part.lower(), self.words
        if part.isascii():
            if word.isalpha():
                return words.get(word) or self._word(word)
            bare = word.rstrip(_SIGNS)
            if bare.isalpha():  # signs at the end are one word
                tail = word[len(bare) :]
                return (words.get(bare) or self._word(bare)) + (words.get(tail) or self._word(tail))
        elif part.isalpha() and max(part) < "\u0250" and word.isalpha():
            return words.get(word) or self._word(word)
        if _LATIN.fullmatch(part) and not any(h in part for h in self.held):
            return b"".join([words.get(w) or self._word(w) for w in self.cut.findall(word)])
        return self._whole(part)

    def __missing__(self, part: str) -> bytes:
        ids = self._part(part)
        if len(part) <= 64:
            self[part] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as unsigned 32-bit numbers."""
        if not self.known:
            return [self._whole(t) for t in texts]
        get, out = self.__getitem__, []
        for t in texts:
            parts = t.replace("\n", " ").replace("\t", " ").split(" ") if _ODD.search(t) else t.split()
            out.append(b"".join(map(get, filter(None, parts))))
        if len(self) > REMEMBERED:
            self.clear()
            self.words.clear()
        return out


_kept: dict[str, _Ids] = {}


def _memory(path: str) -> _Ids:
    """The worker's own tokenizer and remembered words, which its later tasks use, too."""
    if path not in _kept:
        _kept.clear()
        _kept[path] = _Ids(path)
    return _kept[path]


def piece_table(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenized pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32 (and ids)."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        memory, end = _memory(tokenizer_path), array("I", [END]).tobytes()
        for batch in batches:
            rows = []
            texts = batch.column("text")
            encoded = (x for s, e in slices(texts, 1 << 20) for x in memory.encode([t or "" for t in texts.slice(s, e - s).to_pylist()]))
            for k, ids in enumerate(encoded):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    cut = ids if len(ids) <= 4 * capacity else ids[4 * start : 4 * (start + capacity)]
                    rows.append((k, piece, start, len(cut) // 4, zlib.crc32(cut), array("I", cut).tolist() if with_ids else None))
            k, piece, start, length, crc, cuts = zip(*rows, strict=True) if rows else ((),) * 6
            columns = [batch.column("doc_id").take(pa.array(k, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(cuts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return only(df, doc_id=id_col, text=text_col).mapInArrow(run, schema)


class _Tree:
    """Segment tree over remaining capacities 0..capacity; a leaf holds runs of interchangeable open bins."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.open = bytearray(2 * self.size)
        self.runs: list[deque] = [deque() for _ in range(capacity + 1)]

    def add(self, room: int, first: int, count: int) -> None:
        self.runs[room].append((first, count))
        at = room + self.size
        while at and not self.open[at]:
            self.open[at] = 1
            at //= 2

    def shut(self, room: int) -> None:
        at = room + self.size
        self.open[at] = 0
        at //= 2
        while at:
            if self.open[2 * at] or self.open[2 * at + 1]:
                break
            self.open[at] = 0
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that is at least length."""
        at = length + self.size
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first bin, per_bin, offset) of every run of equal documents in equal bins.

    Rank r of a run goes to bin first_bin + (r - first) // per_bin at offset + length * ((r - first) % per_bin).
    """
    tree, out, bins = _Tree(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                # new bins, each filled with as many of this length as best fit would put there at once
                per = capacity // length
                full, rest = divmod(left, per)
                for count, each in ((full, per), (1 if rest else 0, rest)):
                    if count:
                        out.append((length, rank, rank + count * each - 1, bins, each, 0))
                        if capacity - length * each:
                            tree.add(capacity - length * each, bins, count)
                        rank, bins = rank + count * each, bins + count
                left = 0
                continue
            # the tightest bin stays the tightest until no more of this length fits
            first, count = tree.runs[room].popleft()
            per = room // length
            full = min(count, left // per)
            rest = left - full * per if full < count else 0  # below per, as left // per bins are full
            used = full + (1 if rest else 0)
            if used < count:
                tree.runs[room].appendleft((first + used, count - used))
            elif not tree.runs[room]:
                tree.shut(room)
            for at, bins_, each in ((first, full, per), (first + full, 1 if rest else 0, rest)):
                if bins_:
                    out.append((length, rank, rank + bins_ * each - 1, at, each, capacity - room))
                    if room > length * each:
                        tree.add(room - length * each, at, bins_)
                    rank, left = rank + bins_ * each, left - bins_ * each
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (which are read twice: pass a written table)."""
    spark = pieces.sparkSession
    n = 4 * partitions(spark)
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    dealt = pieces.withColumn("_deal", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    # rank within a length: the rank within its share of the deal, and how many the shares before have
    shares = dealt.groupBy("length", "_deal").count()
    before = Window.partitionBy("length").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    local = Window.partitionBy("length", "_deal").orderBy(*order)
    ranked = (
        dealt.withColumn("_local", F.row_number().over(local) - 1)
        .join(shares.select("length", "_deal", "_before"), ["length", "_deal"])
        .withColumn("_rank", F.col("_local") + F.col("_before"))
        .drop("_local", "_before", "_deal")
    )
    histogram = {r["length"]: r["count"] for r in shares.groupBy("length").agg(F.sum("count").alias("count")).collect()}  # at most `capacity` rows
    runs = plan(histogram, capacity)
    steps: dict[int, list] = {}
    for length, first, _, at, per, offset in runs:
        steps.setdefault(length, []).append((first, at, per, offset))
    # one row a length; its runs in order of rank, searched by rank
    table = spark.createDataFrame(
        [(length, sorted(s)) for length, s in steps.items()] or [(0, [(0, 0, 1, 0)])],
        "length long, runs array<struct<first:bigint,bin:bigint,per:bigint,offset:bigint>>",
    )
    search = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(1, max(map(len, steps.values()), default=1).bit_length()))),
        F.struct(F.lit(0).alias("lo"), F.size("runs").alias("hi")),
        _halve,
        lambda a: a["lo"] - 1,
    )
    k = F.col("_rank") - F.col("_run.first")
    return (
        ranked.join(F.broadcast(table), "length")  # bounded by the capacity, not by the input
        .withColumn("_run", F.get("runs", search))
        .withColumn("sequence_id", F.col("_run.bin") + F.floor(k / F.col("_run.per")).cast("long"))
        .withColumn("offset", F.col("_run.offset") + F.col("length") * (k % F.col("_run.per")))
        .drop("runs", "_run", "_rank")
    )


def _halve(a, _):
    mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    open_ = a["lo"] < a["hi"]
    right = open_ & (F.get(F.col("runs"), mid)["first"] <= F.col("_rank"))
    return F.struct(
        F.when(right, mid + 1).otherwise(a["lo"]).alias("lo"),
        F.when(open_ & ~right, mid).otherwise(a["hi"]).alias("hi"),
    )


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack every document."""
    pieces = written(piece_table(df, tokenizer_path, id_col, text_col, capacity, with_ids))
    return pack(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed token sequences, from pieces that carry their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
