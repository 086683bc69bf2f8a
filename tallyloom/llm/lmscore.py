"""Language-model scores of documents: a smoothed word unigram, and a subword lattice.

The lattice model takes an existing subword vocabulary. Its pieces start with
the vocabulary's own scores (ranks, as odds) and are then fitted: in each of
PASSES passes over all distinct training words, forward and backward recursion
give every piece's expected count over all segmentations, and the counts, added
up over the corpus, are the next scores. A word's probability is the sum over
all its segmentations into pieces (single bytes always being pieces), by forward
recursion in log space; a document's is the product over its words and one end.

Words cross the cluster as packed columns keyed by a range of word hashes (64
bits): each range holds its distinct words with their training counts, and
fits and scores each of them once. Words that make up HOT of all tokens (so at
most 1/HOT of them) are known to every task; entries of all others meet their
counts and scores by range, so no word gathers more than that share in one task.

Defined results: null text is empty, with the end as its only token; ids are
integers, and rows without one count as id ''; without training rows every count
is 0; repeated rows are scored each on their own; extra columns are left alone,
whatever their names; an empty table gives no rows. A text of any length is
scored whole, and so is a word: one longer than LONG bytes is scored by the same
recursion position by position, and fitted in stretches of LONG bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewise import U, by_bucket, packed, prefix_hash, slices, span_hash, texts_of, unpacked, words_of
from .common import consecutive, dropped, only, partitions, written

GROUP = 2 << 20
HOT = 1e-4
SMOOTH = 0.1
PASSES = 4
LONG = 64
#: Expected counts are added as whole multiples of this, so that their sum has no order.
GRAIN = 2.0**-20


def _hashes(a, start, end, block=1 << 20):
    """Hash of every word, by blocks of the bytes."""
    out, i = np.empty(len(start), U), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, "right")))
        at = start[i]
        out[i:j] = span_hash(prefix_hash(a[at : end[j - 1]]), start[i:j] - at, end[i:j] - at)
        i = j
    return out


def _groups(batches, columns):
    """(rows' columns, lower-case texts) of about GROUP bytes of text."""
    for batch in batches:
        texts, cols = batch.column("text"), [batch.column(c) for c in columns]
        for first, last in slices(texts, GROUP):
            own = texts_of(texts.slice(first, last - first))
            yield [c.slice(first, last - first) for c in cols], [t.lower() for t in own]  # of bytes: A-Z alone


def _bucket(h, n):
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


_KINDS = {"bucket": pa.int32(), "n": pa.int64(), "m": pa.int64(), "blob": pa.binary(), "kind": pa.int32(), "gid": pa.int64()}


def _batch(schema, rows):
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(cols, schema, strict=True)], schema)


_COUNTS, _ENTRIES = ["bucket", "n", "m", "blob"], ["kind", "bucket", "gid", "blob"]
_COUNTS_SQL, _ENTRIES_SQL = "bucket int, n long, m long, blob binary", "kind int, bucket int, gid long, blob binary"


def _gathered(raw, start, size):
    """The bytes of all ranges, one after the other."""
    skip = np.cumsum(size) - size
    return raw[np.arange(int(size.sum())) + np.repeat(start - skip, size)]


def _counter(n_buckets: int):
    """Distinct words of each group by bucket: hashes, training counts, sizes, bytes; and a row of bucket -1 with the training words (n) and documents (m)."""

    def run(batches):
        for (held,), texts in _groups(batches, ["held_out"]):
            a, start, end, doc = words_of(texts)
            train = ~np.array(held.to_pylist(), bool)
            u, first, back = np.unique(_hashes(a, start, end), return_index=True, return_inverse=True)
            n = np.bincount(back, train[doc], len(u)).astype("<i8")
            size = end[first] - start[first]
            rows = [(-1, int(train[doc].sum()), int(train.sum()), b"")]
            for b, (h, c, s, z) in by_bucket(_bucket(u, n_buckets), u, n, start[first], size):
                rows.append((b, 0, 0, packed(h, c, z.astype("<i4"), _gathered(a, s, z))))
            yield _batch(_COUNTS, rows)

    return run


def _merge_counts(batches):
    """Each bucket's distinct words; n: how many of them are in training texts, m: the largest count."""
    for bucket, rows in consecutive(batches, "bucket"):
        h, n, size, raw = (np.concatenate(c) for c in zip(*(unpacked(r[-1]) for r in rows), strict=True))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(back, n, len(u)).astype("<i8")
        size = size.astype(np.int64)
        start = np.cumsum(size) - size
        yield _batch(_COUNTS, [(bucket, int((n > 0).sum()), int(n.max(initial=0)), packed(u, n, size[first].astype("<i4"), _gathered(raw, start[first], size[first])))])


def _hot_words(least: float):
    def run(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                u, n, score = unpacked(blob)
                hot = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(u[hot].view(np.int64)), pa.array(n[hot].astype(np.int64)), pa.array(score[hot])], ["h", "c", "lp"])

    return run


class Lattice:
    """Recursions over all segmentations of words into pieces, vectorized over words of equal length."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        nodes = dict.fromkeys(pieces)
        self.n_pieces, self.longest = len(nodes), max(map(len, pieces))
        nodes.update(dict.fromkeys(p[:k] for p in pieces for k in range(1, len(p))))
        self.lp = np.full(len(nodes), -np.inf)  # a mere beginning of pieces has none
        place = {p: i for i, p in enumerate(nodes)}
        np.logaddexp.at(self.lp, [place[p] for p in pieces], logp)
        self.symbol = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
        self.keys = np.fromiter((self._hash(p) for p in nodes), U, len(nodes))
        self.table = np.full(1 << (16 * len(nodes)).bit_length(), -1, np.int32)
        left, step = np.arange(len(nodes), dtype=np.int32), 0
        while len(left):  # what finds its slot taken tries the next one
            at = self._slot(self.keys[left], step)
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            left, step = left[self.table[at] != left], step + 1

    def _hash(self, p: bytes) -> int:
        h = 0
        for b in p:
            h = (h * 0x9E3779B97F4A7C15 + int(self.symbol[b])) & (2**64 - 1)
        return h

    def _slot(self, h, step: int):
        m = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
        return ((m >> U(32)).astype(np.int64) + step) & (len(self.table) - 1)

    def _find(self, h):
        """Number of the node of each hash, or -1."""
        at = self.table[self._slot(h, 0)]
        wrong, step = np.flatnonzero((at >= 0) & (self.keys[at] != h)), 1
        while len(wrong):
            at[wrong] = self.table[self._slot(h[wrong], step)]
            wrong = wrong[(at[wrong] >= 0) & (self.keys[at[wrong]] != h[wrong])]
            step += 1
        return at

    def _matches(self, words: np.ndarray):
        """(first, last + 1, rows, nodes) of the pieces in rows of bytes, first to last position."""
        n, length = words.shape
        sym = self.symbol[words.T]
        every, zero = np.arange(n), np.zeros(n, U)
        for i in range(length):
            act, h = every, zero
            for j in range(i, min(length, i + self.longest)):
                h = h * U(0x9E3779B97F4A7C15) + sym[j, act]
                at = self._find(h)
                ok = at >= 0
                if not ok.all():
                    act, h, at = act[ok], h[ok], at[ok]
                    if not len(act):
                        break
                whole = at < self.n_pieces
                yield (i, j + 1, act, at) if whole.all() else (i, j + 1, act[whole], at[whole])

    def equal_length(self, words: np.ndarray) -> np.ndarray:
        """Natural-log probability of each row of bytes."""
        n, length = words.shape
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        for i, j, act, at in self._matches(words):
            alpha[j, act] = np.logaddexp(alpha[j, act], alpha[i, act] + self.lp[at])
        return alpha[length]

    def _counted(self, words: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        """Add to total the expected count of every piece over all segmentations of the rows."""
        n, length = words.shape
        alpha, beta = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
        alpha[0] = beta[length] = 0
        found = list(self._matches(words))
        for i, j, act, at in found:
            alpha[j, act] = np.logaddexp(alpha[j, act], alpha[i, act] + self.lp[at])
        for i, j, act, at in reversed(found):
            onward = self.lp[at] + beta[j, act]
            share = weight[act] * np.exp(alpha[i, act] + onward - alpha[length, act])
            total += np.bincount(at, share, len(total))[: len(total)]
            beta[i, act] = np.logaddexp(beta[i, act], onward)

    def one(self, word: bytes) -> float:
        """The same as equal_length for a single word, however long: its pieces are found for all places at once."""
        sym, n = self.symbol[np.frombuffer(word, np.uint8)], len(word)
        begin, h, ends, at_ = np.arange(n), np.zeros(n, U), [], []
        for k in range(self.longest):
            ok = begin + k < n
            begin, h = begin[ok], h[ok] * U(0x9E3779B97F4A7C15) + sym[begin[ok] + k]
            at = self._find(h)
            ok = at >= 0
            begin, h = begin[ok], h[ok]
            if not len(begin):
                break
            whole = at[ok] < self.n_pieces
            ends.append(np.stack((begin[whole] + k + 1, begin[whole])))
            at_.append(at[ok][whole])
        ends, lp = np.concatenate(ends, 1), self.lp[np.concatenate(at_)]
        order = np.argsort(ends[0], kind="stable")
        top = 1e200
        p, alpha, shift = np.exp(lp[order]).tolist(), [top] + [0.0] * n, -np.log(top)
        for x, (j, i) in enumerate(ends[:, order].T.tolist()):
            alpha[j] += alpha[i] * p[x]
            if j % 8 == 0 and alpha[j] < 1e100:
                window = range(max(0, j - self.longest), j + 1)
                most = max(alpha[y] for y in window)
                if most < 1e100:  # what is still needed moves up together, its logarithm kept apart
                    shift += np.log(most / top)
                    for y in window:
                        alpha[y] *= top / most
        return float(np.log(alpha[n]) + shift)

    def _by_length(self, raw, start, size):
        """(indices, rows of bytes behind a blank) of words of one length, some 200,000 places at a time."""
        order = np.argsort(size, kind="stable")
        edge = np.flatnonzero(np.diff(size[order], prepend=-1))
        for s, e in zip(edge, [*edge[1:], len(order)], strict=True):
            length = int(size[order[s]])
            step = max(1, 200_000 // (length + 1))
            for c in range(s, e, step):
                k = order[c : min(e, c + step)]
                yield k, raw[start[k][:, None] + np.arange(length)]

    def words(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log probability of each raw[start : start + size] behind one blank, the mark of a word's start."""
        out = np.empty(len(start))
        short = np.flatnonzero(size <= LONG)
        for k, rows in self._by_length(raw, start[short], size[short]):
            out[short[k]] = self.equal_length(np.pad(rows, ((0, 0), (1, 0)), constant_values=32))
        for i in np.flatnonzero(size > LONG):
            out[i] = self.one(b" " + raw[start[i] : start[i] + size[i]].tobytes())
        return out

    def expected(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected count of every piece in all words behind a blank; of long words, in their stretches."""
        total = np.zeros(self.n_pieces)
        short = np.flatnonzero(size <= LONG)
        for k, rows in self._by_length(raw, start[short], size[short]):
            self._counted(np.pad(rows, ((0, 0), (1, 0)), constant_values=32), count[short[k]].astype(float), total)
        for i in np.flatnonzero(size > LONG):
            cut = np.arange(start[i], start[i] + size[i], LONG)
            for k, rows in self._by_length(raw, cut, np.minimum(LONG, start[i] + size[i] - cut)):
                self._counted(rows, np.full(len(k), float(count[i])), total)
        return total


def vocabulary(model_path: str) -> tuple[list[bytes], np.ndarray]:
    """A sentencepiece model's pieces as bytes (the word mark is a blank, byte pieces are their byte) and their natural-log scores.

    A byte-pair model has ranks for scores; a piece's odds are one over its rank,
    a byte's those of the last rank. Equal pieces are one.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    odds: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            piece, own = bytes([int(model.id_to_piece(i)[3:5], 16)]), 1 / model.get_piece_size()
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        else:
            piece, own = model.id_to_piece(i).replace("▁", " ").encode(), 1 / (2 + abs(model.get_score(i)))
        odds[piece] = odds.get(piece, 0) + own
    for b in range(256):
        odds.setdefault(bytes([b]), 1 / model.get_piece_size())
    p = np.fromiter(odds.values(), np.float64, len(odds))
    return list(odds), np.log(p / p.sum())


def piece_scores(counts: np.ndarray, n_end: int) -> tuple[np.ndarray, float]:
    """Natural-log probabilities of the pieces and of the end, smoothed as the base is."""
    total = counts.sum() + n_end + SMOOTH * (len(counts) + 1)
    return np.log((counts + SMOOTH) / total), float(np.log((n_end + SMOOTH) / total))


_lattices: dict = {}


def _lattice(pieces: list[bytes], logp: np.ndarray) -> Lattice:
    """The worker's own lattice of these scores, which its later tasks use, too."""
    key = logp.tobytes()
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(pieces, logp)
    return _lattices[key]


def _fitter(pieces, logp):
    def run(batches):
        lattice, total = _lattice(pieces, logp), np.zeros(len(pieces), "<i8")
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                _, n, size, raw = unpacked(blob)
                size, seen = size.astype(np.int64), n > 0
                own = lattice.expected(raw, (np.cumsum(size) - size)[seen], size[seen], n[seen])
                total += np.rint(own / GRAIN).astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.array([packed(total)], pa.binary())], ["blob"])

    return run


def _added(size: int):
    def run(batches):
        total = np.zeros(size, "<i8")
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                total += unpacked(blob)[0]
        yield pa.RecordBatch.from_arrays([pa.array([packed(total)], pa.binary())], ["blob"])

    return run


def fitted(merged: DataFrame, pieces: list[bytes], logp: np.ndarray, n_end: int, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Scores of the pieces and of the end after `passes` passes of expected counts over merged words.

    What comes to the driver is one vector as long as the vocabulary from each of 16 tasks.
    """
    end = float(np.log(SMOOTH))
    for _ in range(max(1, passes)):
        got = merged.select("blob").mapInArrow(_fitter(pieces, logp), "blob binary")
        # dealt out again, so that a task has one Python worker, not two
        got = got.repartition(16).mapInArrow(_added(len(pieces)), "blob binary").collect()
        total = sum((unpacked(r["blob"])[0] for r in got), np.zeros(len(pieces), "<i8"))
        logp, end = piece_scores(total * GRAIN, n_end)
    return logp, end


def _word_scorer(pieces, logp):
    """Each bucket's words, with hashes, counts and log probabilities in place of their bytes."""

    def run(batches):
        lattice = _lattice(pieces, logp)
        for batch in batches:
            for bucket, n, m, blob in zip(*(batch.column(c).to_pylist() for c in _COUNTS), strict=True):
                u, c, size, raw = unpacked(blob)
                size = size.astype(np.int64)
                yield _batch(_COUNTS, [(bucket, n, m, packed(u, c, lattice.words(raw, np.cumsum(size) - size, size)))])

    return run


def _entries(hot_h: np.ndarray, hot_c: np.ndarray, hot_lp: np.ndarray, n_buckets: int):
    """Rows of kind 0 (a group's documents, with the sums over hot words) and kind 1 (a group's entries of one bucket)."""

    def run(batches):
        for (rid, ids, held), texts in _groups(batches, ["rid", "doc_id", "held_out"]):
            a, start, end, doc = words_of(texts)
            u, back = np.unique(_hashes(a, start, end), return_inverse=True)
            n = len(texts)
            at = np.minimum(np.searchsorted(hot_h, u), max(0, len(hot_h) - 1))
            hot = hot_h[at] == u if len(hot_h) else np.zeros(len(u), bool)
            here = hot[back]
            h_doc, h_at = doc[here], at[back[here]]
            known = np.bincount(h_doc, minlength=n)
            base = np.bincount(h_doc, np.log10(hot_c[h_at] + SMOOTH) if len(h_at) else None, n)
            score = np.bincount(h_doc, hot_lp[h_at] if len(h_at) else None, n)
            words = np.bincount(doc, minlength=n)
            pair, tf = np.unique(doc[~here] * len(u) + back[~here], return_counts=True)
            gid = int(rid[0].as_py())
            own = packed(
                np.array([0 if x is None else x for x in ids.to_pylist()], "<i8"),
                np.array(ids.is_null().to_pylist(), "<i1"),
                np.array(held.to_pylist(), "<i1"),
                words.astype("<i8"), known.astype("<i8"), base.astype("<f8"), score.astype("<f8"),
            )
            rows = [(0, -1, gid, own)]
            p_doc, p_word = np.divmod(pair, max(1, len(u)))
            for b, (d, w, t) in by_bucket(_bucket(u[p_word], n_buckets), p_doc, p_word, tf):
                few, local = np.unique(w, return_inverse=True)
                rows.append((1, b, gid, packed(u[few], local.astype("<i4"), d.astype("<i4"), t.astype("<i4"))))
            yield _batch(_ENTRIES, rows)

    return run


def _look_up(batches):
    """Entries meet the words of their bucket, which come first (kind 0): rows of kind 1 with a group's sums by document."""
    at = None
    h, c, lp = np.zeros(0, U), np.zeros(0), np.zeros(0)
    for batch in batches:
        out = []
        for kind, bucket, gid, blob in zip(*(batch.column(x).to_pylist() for x in _ENTRIES), strict=True):
            if kind == 0:
                at, (h, c, lp) = bucket, unpacked(blob)
                continue
            if bucket != at:
                raise ValueError("entries without the words of their bucket")
            u, local, doc, tf = unpacked(blob)
            k = np.searchsorted(h, u)
            d, back = np.unique(doc, return_inverse=True)
            base = np.bincount(back, tf * np.log10(c[k] + SMOOTH)[local], len(d))
            known = np.bincount(back, tf * (c[k] > 0)[local], len(d))
            score = np.bincount(back, tf * lp[k][local], len(d))
            out.append((1, bucket, gid, packed(d.astype("<i4"), known.astype("<i4"), base.astype("<f8"), score.astype("<f8"))))
        yield _batch(_ENTRIES, out)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"


def _join_sums(batches):
    """Partitions in order of group, kind and bucket: so the sums have one order, and reruns agree to the last bit."""
    for _, rows in consecutive(batches, "gid"):
        ids, null, held, words, known, base, score = unpacked(rows[0][3])
        known, base, score = known.copy(), base.copy(), score.copy()
        for r in rows[1:]:
            d, k, b, s = unpacked(r[3])
            known[d] += k
            base[d] += b
            score[d] += s
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(words + 1), pa.array(known), pa.array(base), pa.array(score)],
            ["doc_id", "held_out", "n_tokens", "n_known", "base_sum", "score"],
        )


def score_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", hot: float = HOT, passes: int = PASSES) -> DataFrame:
    """Learns from the documents outside the held-out tenth and scores all of them."""
    spark = df.sparkSession
    n = partitions(spark, df.select(f"`{text_col}`"), size=4 << 20)
    d = only(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    d = d.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0)
    d = d.withColumn("rid", F.monotonically_increasing_id())
    raw = written(d.select("held_out", "text").mapInArrow(_counter(n), _COUNTS_SQL))
    totals = raw.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    n_train, n_docs = totals["n"] + totals["m"], totals["m"]
    merged = written(raw.where("bucket >= 0").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge_counts, _COUNTS_SQL))
    dropped(raw)
    n_distinct = (merged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("v")).first()["v"]) + (1 if n_docs else 0)
    logp, log_end = fitted(merged, *(model := vocabulary(model_path)), n_docs, passes)
    words = written(merged.mapInArrow(_word_scorer(model[0], logp), _COUNTS_SQL))
    dropped(merged)
    least = max(2.0, hot * n_train)  # so that at most 1 / hot words are collected
    hot_rows = words.where(F.col("m") >= least).mapInArrow(_hot_words(least), "h long, c long, lp double").collect() if n_train >= 1 / hot else []
    hot_h = np.array([r["h"] for r in hot_rows], np.int64).view(U)
    order = np.argsort(hot_h)
    hot_c, hot_lp = (np.array([r[x] for r in hot_rows], np.float64)[order] for x in ("c", "lp"))
    entries = written(d.mapInArrow(_entries(hot_h[order], hot_c, hot_lp, n), _ENTRIES_SQL))
    counts = words.select(F.lit(0).alias("kind"), "bucket", F.lit(0).cast("long").alias("gid"), "blob")
    looked = entries.where("kind = 1").unionByName(counts).repartition(n, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_look_up, _ENTRIES_SQL)
    sums = entries.where("kind = 0").unionByName(looked).repartition(n, "gid").sortWithinPartitions("gid", "kind", "bucket").mapInArrow(_join_sums, _SCORES)
    log_all = float(np.log10(n_train + SMOOTH * (n_distinct + 1)))
    end = float(np.log10(n_docs + SMOOTH))
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + (1 if n_docs else 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_sum") + end - F.col("n_tokens") * log_all).alias("base_score"),
        ((F.col("score") + log_end) / float(np.log(10))).alias("score"),
    )
