"""Removal of passages that repeat across documents, by depth-limited radix sorting of suffixes.

A window is a string of DEPTH bytes inside one document. Every window has an
anchor: the least hash among its GRAM-byte substrings, so equal windows have
equal anchors at equal places, and only anchors cross the cluster at first
(about one for every twelve bytes):

1. Anchors found in one document alone are dropped: no window of theirs repeats.
2. For each other anchor, the windows it stands for form one run; distinct runs
   are sent once by each group of documents, as the anchor's 64-bit key and the
   bytes around it, to the anchor's bucket. There, equal runs share the smallest document; the runs of an anchor
   that differ are cut into windows (suffixes), ordered by most-significant-digit
   passes, the anchor's key and place first, then the bytes around it, eight at a
   time, through DEPTH bytes in all and no further, groups
   of one dropping out after each pass. Groups left are exactly the repeated
   windows.
3. Bytes covered by a window that a smaller document also has are removed.

A hot passage reaches a bucket once from each group, not once from each document;
of anchors that very many groups have, each window is sent by itself, to a bucket
that its first bytes choose, so the first digit's pass is done by the shuffle.

Ids are integers below 2**63 - 1. Defined results: null text is empty; rows without an id count as one document
that comes after all others, and rows of equal id as one document (windows they
share with each other stay); repeats within a document stay; texts below DEPTH
bytes stay whole; longer ones of any size are cut whole, each group of documents
in one task; ties, that is equal windows of many documents, go to the smallest id;
extra columns are left alone, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewise import U, by_bucket, mixed, packed, powers, prefix_hash, slices, span_hash, texts_of, unpacked
from .common import consecutive, partitions, ship, written

DEPTH, GRAM, GROUP = 50, 28, 4 << 20
#: An anchor that so many groups have sends single windows, spread by their first bytes, in place of runs.
HOT_GROUPS = 1000
_LAST = np.iinfo(np.int64).max
_LOW = U((1 << 40) - 1)


def _grouped(batches):
    """Groups of documents of about GROUP bytes, each one row (kind 0), and a row of carried columns (kind 5)."""
    for batch in batches:
        carried = batch.select([c for c in batch.schema.names if c.startswith("carried_")])
        ids = batch.column("doc_id")
        for s, e in slices(batch.column("text"), GROUP):
            texts, own = texts_of(batch.column("text").slice(s, e - s)), ids.slice(s, e - s)
            number = np.array([_LAST if x is None else x for x in own.to_pylist()], "<i8")
            raw = np.frombuffer(b"".join(texts), np.uint8)
            size = np.fromiter(map(len, texts), "<i8", e - s)
            gid = int(batch.column("rid")[s].as_py())
            yield _rows([(0, 0, gid, packed(number, size, raw, level=3))])
            if carried.num_columns:
                to = pa.BufferOutputStream()
                with pa.ipc.new_stream(to, carried.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(carried.slice(s, e - s))
                yield _rows([(5, 0, gid, to.getvalue().to_pybytes())])


_NAMES = ["kind", "bucket", "gid", "blob"]
_ROW = "kind int, bucket int, gid long, blob binary"


def _rows(rows):
    k, b, g, x = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(g, pa.int64()), pa.array(x, pa.binary())], _NAMES)


def anchors(raw: np.ndarray, size: np.ndarray, depth: int, gram: int):
    """(document, first window, number of windows, anchor's place, anchor's key) of every run."""
    first = np.concatenate(([0], np.cumsum(size)))
    out, i, width = [], 0, depth - gram + 1
    while i < len(size):
        j = i + 1
        while j < len(size) and first[j + 1] - first[i] <= 1 << 20:
            j += 1
        a = raw[first[i] : first[j]]
        if len(a) >= depth:
            p = prefix_hash(a)
            n = len(a) - gram + 1
            h = mixed((p[gram:] - p[:n]) * powers(_BACK, len(p))[:n])
            bits = max(21, int(n).bit_length())
            low = (h & ~U((1 << bits) - 1)) | np.arange(n, dtype=U)
            least, have = low, 1
            while have * 2 <= width:
                least = np.minimum(least[: len(least) - have], least[have:])
                have *= 2
            if have < width:
                least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
            at = (least & U((1 << bits) - 1)).astype(np.int64)
            # windows that end inside their document
            doc = np.repeat(np.arange(i, j), size[i:j])[: len(at)]
            inside = np.arange(len(at)) + depth <= (first[doc + 1] - first[i])
            s = np.flatnonzero(inside)
            if len(s):
                # a run ends where the anchor or the document changes
                new = np.concatenate(([True], (at[s[1:]] != at[s[:-1]]) | (s[1:] != s[:-1] + 1)))
                k = np.flatnonzero(new)
                n_windows = np.diff(np.append(k, len(s)))
                place = at[s[k]]
                out.append((doc[s[k]], s[k] + first[i], n_windows, place + first[i], mixed(h[place] + U(977))))
        i = j
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_BACK = pow(0x9E3779B97F4A7C15, -1, 2**64)


def _address(key, n):
    """Bucket and 40 more bits of a key, as one sortable number."""
    return (((key >> U(32)) * U(n) >> U(32)) << U(40)) | (key & _LOW)


def _five(x):
    return (x & U(0xFFFFFFFF)).astype("<u4"), ((x >> U(32)) & U(0xFF)).astype("<u1")


def _wide(low, high):
    return low.astype(U) | (high.astype(U) << U(32))


def _send_anchors(n, depth, gram):
    def run(batches):
        for batch in batches:
            for gid, blob in zip(batch.column("gid").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                _, size, raw = unpacked(blob)
                x = np.unique(_address(anchors(raw, size, depth, gram)[4], n))
                yield _rows([(1, b, gid, packed(*_five(c[0]))) for b, c in by_bucket((x >> U(40)).astype(np.int64), x)])

    return run


def _find_repeats(hot_groups):
    """Two bits for each anchor that a group has sent: do other groups have it, and do very many?"""

    def run(batches):
        for bucket, rows in consecutive(batches, "bucket"):
            parts = [_wide(*unpacked(r[3])) for r in rows]
            x, n = np.unique(np.concatenate(parts), return_counts=True)
            for r, own in zip(rows, parts, strict=True):
                have = n[np.searchsorted(x, own)]
                yield _rows([(1, bucket, r[2], packed(np.packbits(have > 1), np.packbits(have >= hot_groups)))])

    return run


def _ragged(start, size):
    """Indices of the elements of all ranges, one after the other."""
    skip = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(skip - start, size)


def _send_runs(n, depth, gram):
    """For each group: its runs (kind 3), and for each bucket its distinct repeated runs with their bytes (kind 2)."""

    def run(batches):
        for gid, rows in consecutive(batches, "gid"):
            ids, size, raw = unpacked(next(r[3] for r in rows if r[0] == 0))
            doc, start, many, place, key = anchors(raw, size, depth, gram)
            where = _address(key, n)
            x, back = np.unique(where, return_inverse=True)
            alive, hot = np.zeros(len(x), bool), np.zeros(len(x), bool)
            b = (x >> U(40)).astype(np.int64)
            for _, bucket, _, blob in (r for r in rows if r[0] == 1):
                s, e = np.searchsorted(b, [bucket, bucket + 1])
                alive[s:e], hot[s:e] = (np.unpackbits(bits)[: e - s].astype(bool) for bits in unpacked(blob))
            # what two documents of the group share repeats, too
            low, high = np.full(len(x), _LAST), np.full(len(x), np.iinfo(np.int64).min)
            np.minimum.at(low, back, ids[doc])
            np.maximum.at(high, back, ids[doc])
            keep, hot = (alive | (low < high))[back], hot[back]
            single = np.repeat(np.flatnonzero(keep & hot), many[keep & hot])
            step = _ragged(np.zeros(int((keep & hot).sum()), np.int64), many[keep & hot])
            at = np.concatenate((np.flatnonzero(keep & ~hot), single))
            first, n_windows = start[at], many[at].copy()
            first[len(at) - len(single) :] += step
            n_windows[len(at) - len(single) :] = 1
            doc, start, many, place, where, key = doc[at], first, n_windows, place[at], where[at], key[at]
            if len(single):  # their bucket follows from the key, its place, and the first eight bytes beside it
                k = np.arange(len(at) - len(single), len(at))
                off = place[k] - start[k]
                near = np.arange(8) + np.where(np.arange(8) < off[:, None], 0, gram)
                digit = raw[start[k][:, None] + near].view(U)[:, 0]
                where[k] = _address(mixed(key[k] ^ mixed(digit + off.astype(U))), n)
            h = _run_hash(raw, start, start + many + depth - 1) + (place - start).astype(U) * U(0xC2B2AE3D27D4EB4F)
            # one entry for each distinct run, by key and content, of its smallest document
            order = np.lexsort((ids[doc], h, key, where))
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1])
            entry = np.empty(len(order), np.int64)
            entry[order] = np.cumsum(new) - 1
            head = order[new]
            eb = (where[head] >> U(40)).astype(np.int64)
            out = []
            index = np.empty(len(head), np.int64)
            for bucket, (e,) in by_bucket(eb, np.arange(len(head))):
                index[e] = np.arange(len(e))
                k = head[e]
                # the bytes around the anchor, left then right; the anchor's own bytes are its key
                left, right = place[k] - start[k], start[k] + many[k] + depth - 1 - place[k] - gram
                text = raw[_ragged(np.stack((start[k], place[k] + gram), 1).ravel(), np.stack((left, right), 1).ravel())]
                out.append((2, bucket, gid, packed(key[k], left.astype("<u1"), many[k].astype("<u1"), ids[doc[k]], text)))
            local = ids[doc] > ids[doc[head]][entry] if len(head) else np.zeros(0, bool)
            o = np.argsort(start, kind="stable")
            out.append((3, -1, gid, packed(np.diff(start[o], prepend=0).astype("<i4"), many[o].astype("<u1"), eb[entry[o]].astype("<i4"), index[entry[o]].astype("<i4"), local[o].astype("<u1"))))
            yield _rows(out)

    return run


def _run_hash(raw, start, end, block=1 << 20):
    """Hash of raw[start:end] for ascending starts, by blocks."""
    out, i = np.empty(len(start), U), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + block)))
        at = start[i]
        out[i:j] = span_hash(prefix_hash(raw[at : end[i:j].max()]), start[i:j] - at, end[i:j] - at)
        i = j
    return out


def equal_windows(text: np.ndarray, start: np.ndarray, depth: int, group: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Group numbers of the windows text[start : start + depth] that are equal and of one group; -1 for those without an equal.

    Most-significant-digit passes: windows are ordered by eight bytes within the
    groups of the pass before; groups of one leave. Only one digit of those that
    are left is held at a time.
    """
    n = len(start)
    alive, name = np.arange(n), np.unique(group, return_inverse=True)[1].astype(np.int64)
    for k in range(-1, -(-depth // 8)):
        if k >= 0:
            d, width = np.zeros(len(alive), U), min(8, depth - 8 * k)
            for s in range(0, len(alive), block):
                for byte in range(width):
                    d[s : s + block] = (d[s : s + block] << U(8)) | text[start[alive[s : s + block]] + 8 * k + byte].astype(U)
            order = np.lexsort((d, name))
            alive, name, d = alive[order], name[order], d[order]
            step = np.ones(len(alive), bool)
            step[1:] = (name[1:] != name[:-1]) | (d[1:] != d[:-1])
            name = np.cumsum(step) - 1
        size = np.bincount(name, minlength=1)
        more = size[name] > 1
        alive, name = alive[more], name[more]
    out = np.full(n, -1, np.int64)
    out[alive] = name
    return out


def _resolve(around):
    """For each entry, the windows (as bits) that a smaller document has; rows of kind 3 pass.

    A window is its anchor's key and place, and the `around` bytes beside the anchor.
    """

    def run(batches):
        for bucket, rows in consecutive(batches, "bucket", alone=-1):
            if bucket < 0:
                yield _rows(rows)
                continue
            parts = [unpacked(r[3]) for r in rows]
            key, off, many, ids, text = (np.concatenate(c) for c in zip(*parts, strict=True))
            off, many = off.astype(np.int64), many.astype(np.int64)
            size = many + around - 1
            start = np.cumsum(size) - size
            mask = np.zeros(len(key), np.uint32)
            full = ((U(1) << many.astype(U)) - U(1)).astype(np.uint32)
            order = np.argsort(key, kind="stable")
            k = key[order]
            at = np.flatnonzero(np.diff(k, prepend=~k[:1]) != 0)
            count = np.diff(np.append(at, len(k)))
            order = order[np.repeat(count > 1, count)]  # keys that several groups, or several runs, have
            if len(order):
                h = _run_hash(text, start, start + size)
                order = order[np.lexsort((ids[order], h[order], many[order], off[order], key[order]))]
                new = np.ones(len(order), bool)
                a, b = order[1:], order[:-1]
                new[1:] = (key[a] != key[b]) | (off[a] != off[b]) | (many[a] != many[b]) | (h[a] != h[b])
                head = order[new]
                mine = head[np.cumsum(new) - 1]
                mask[order] = np.where(ids[order] > ids[mine], full[order], 0)
                # heads of keys with several distinct runs: cut into windows
                _, back, runs = np.unique(key[head], return_inverse=True, return_counts=True)
                cut = head[runs[back] > 1]
                for owner, step in _window_slices(cut, key[cut], off[cut], many[cut]):
                    group = mixed(key[owner] * U(64) + (off[owner] - step).astype(U))
                    same = equal_windows(text, start[owner] + step, around, group)
                    hit = np.flatnonzero(same >= 0)
                    if len(hit):
                        least = np.full(int(same.max()) + 1, _LAST)
                        np.minimum.at(least, same[hit], ids[owner[hit]])
                        hit = hit[ids[owner[hit]] > least[same[hit]]]
                        np.bitwise_or.at(mask, owner[hit], (U(1) << step[hit].astype(U)).astype(np.uint32))
                # entries of the head's document share the head's windows
                mask[order] |= np.where(ids[order] == ids[mine], mask[mine], 0)
            done = 0
            out = []
            for r, p in zip(rows, parts, strict=True):
                out.append((4, bucket, r[2], packed(mask[done : done + len(p[0])])))
                done += len(p[0])
            yield _rows(out)

    return run


def _window_slices(entry, key, off, many, most=400_000):
    """(entries, steps) of the windows of runs in order of key: whole keys with about `most` windows,
    and of a key with more, the windows of each place of the anchor."""
    edge = np.append(np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0), len(key))
    total = np.concatenate(([0], np.cumsum(many)))
    i = 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(total[edge], total[edge[i]] + most, "right")) - 1)
        s = slice(edge[i], edge[j])
        if j == i + 1 and total[edge[j]] - total[edge[i]] > most:
            for place in range(int((off[s] - many[s]).min()) + 1, int(off[s].max()) + 1):
                step = off[s] - place
                ok = (step >= 0) & (step < many[s])
                yield entry[s][ok], step[ok]
        else:
            yield np.repeat(entry[s], many[s]), _ragged(np.zeros(len(many[s]), np.int64), many[s])
        i = j


def _cut(depth):
    def run(batches):
        for _, rows in consecutive(batches, "gid"):
            ids, size, raw = unpacked(next(r[3] for r in rows if r[0] == 0))
            starts = np.zeros(len(raw) + 1, bool)
            for step, many, bucket, index, local in (unpacked(r[3]) for r in rows if r[0] == 3):
                start = np.cumsum(step.astype(np.int64))
                mask = np.where(local == 1, np.uint32(0xFFFFFFFF), np.uint32(0))
                order = np.argsort(bucket, kind="stable")
                ordered = bucket[order]
                for _, b, _, blob in (r for r in rows if r[0] == 4):
                    s, e = np.searchsorted(ordered, [b, b + 1])
                    k = order[s:e]
                    mask[k] |= unpacked(blob)[0][index[k]]
                for j in range(int(many.max(initial=0))):
                    starts[start[(many > j) & (mask >> np.uint32(j) & np.uint32(1) == 1)] + j] = True
            c = np.cumsum(starts)
            gone = c[: len(raw)].copy()
            gone[depth:] -= c[: max(0, len(raw) - depth)]
            gone = gone > 0
            first = np.cumsum(size) - size
            out = []
            carried = [pa.ipc.open_stream(r[3]).read_all().combine_chunks().to_batches()[0] for r in rows if r[0] == 5]
            for d, (s, n) in enumerate(zip(first, size, strict=True)):
                g = gone[s : s + n]
                edge = np.flatnonzero(np.diff(g, prepend=False, append=False))
                out.append((None if ids[d] == _LAST else int(ids[d]), int(n), [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)], raw[s : s + n][~g].tobytes()))
            for k in range(0, len(out), 1000):
                a, b, c_, d_ = zip(*out[k : k + 1000], strict=True)
                cols = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c_, _SPANS)]
                if carried:
                    own = carried[0].slice(k, 1000)
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([x.decode("utf-8", "ignore") for x in d_], pa.string()), *own.columns], ["doc_id", "n_bytes", "spans", "kept_text", *own.schema.names])
                else:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(d_, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def dedup_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM, carry: list[str] | None = None, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, maximal, in order) and kept (the remaining bytes) of every row.

    With columns to carry, these come as carried_0, carried_1, ... and the kept
    bytes as text (kept_text).
    """
    if not gram + 8 <= depth <= gram + 31:
        raise ValueError("a run's windows are kept as 32 bits, and eight bytes beside the anchor choose a bucket")
    spark = df.sparkSession
    ship(spark)
    own = [F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carry or [])]
    d = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("rid"), *own)
    written_groups = written(d.mapInArrow(_grouped, _ROW))
    n = partitions(spark, written_groups, size=16 << 20)
    groups = written_groups.where("kind = 0")
    sent = groups.mapInArrow(_send_anchors(n, depth, gram), _ROW).repartition(n, "bucket").sortWithinPartitions("bucket")
    known = sent.mapInArrow(_find_repeats(hot_groups), _ROW)  # no table: it is read once, and each file written has the JVM spawn processes
    runs = groups.unionByName(known).repartition(n, "gid").sortWithinPartitions("gid", "kind").mapInArrow(_send_runs(n, depth, gram), _ROW)
    place = F.when(F.col("kind") == 2, F.col("bucket").cast("long")).otherwise(F.col("gid"))
    solved = written(runs.repartition(n, place).sortWithinPartitions("bucket").mapInArrow(_resolve(depth - gram), _ROW))
    schema = "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, " + (
        "kept_text string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields if f.name.startswith("carried_")) if carry else "kept binary"
    )
    return written_groups.unionByName(solved).repartition(n, "gid").sortWithinPartitions("gid").mapInArrow(_cut(depth), schema)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """The rows of df with their kept text; bytes of characters that a cut has split are dropped."""
    others = [c for c in df.columns if c != text_col]
    cut = dedup_passages(df, id_col, text_col, depth, gram, carry=others)
    at = {c: f"carried_{i}" for i, c in enumerate(others)}
    return cut.select(*(F.col("kept_text" if c == text_col else at[c]).alias(c) for c in df.columns))
