"""WARC archives of pages, and an index of captures made by an external merge.

Writing: every page becomes a WARC/1.1 response record, or a revisit record if
an earlier page has the same payload of at least MIN_REVISIT bytes. Archives are
gzip members, one a record, laid end to end, and kept as rows (archive, part,
data) of a table, so that any storage that Spark writes can hold them.
Each archive begins with a warcinfo record. save_archives() and read_warc_files()
write and read the same as .warc.gz files.
Reading back gives each part's captures as a run sorted by URL key and
timestamp, which is written; runs are cut into blocks at common key bounds, and
within each range of keys a loser tree merges the blocks, each opened as the
merge reaches its first key, into globally ordered capture histories. So a task
holds the open blocks alone.

Ids are integers. Defined results: null html is an empty payload and null url an empty one;
records of fewer than MIN_REVISIT bytes are all responses; among equal payloads
the smallest page_id is the response, as are rows that repeat that id; an absent
page_id sorts last, and is a revisit if an equal payload has an id; captures of one key and time come in order of
page_id; payloads of any length are written and digested whole; extra columns are
left alone, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, partitions, ship, written

MIN_REVISIT = 100
PART_BYTES, CHUNK = 4 << 20, 1 << 14
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def url_key(url: str) -> str:
    """Sort-friendly key of a URL: reversed host, port, path and query, in lower case, without www. and fragment."""
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return url.lower()
    if host.startswith("www."):
        host = host[4:]
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else "")


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, bytes and refers_to (null: a response) of every page."""
    d = only(pages, page_id=id_col, url=url_col, html=text_col).withColumn("html", F.coalesce("html", F.lit("")))
    d = d.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    # small ones (all empty pages) need no partner
    small = d.where(F.col("bytes") < MIN_REVISIT).withColumn("refers_to", F.lit(None).cast("long"))
    large = d.where(F.col("bytes") >= MIN_REVISIT)
    # only digests that stand twice or more matter, and their first page
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    large = large.join(firsts, "digest", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return large.withColumn("refers_to", F.when(other, F.col("first"))).select(*small.columns).unionByName(small)


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    when = (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Date: {when}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    return _member(raw)


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _info(archive: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: tallyloom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{archive}>", f"WARC-Date: {EPOCH:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Filename: {archive}.warc.gz", "Content-Type: application/warc-fields"]
    return _member("\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n")


def _write(batches):
    task, data, archive, part = TaskContext.get().partitionId(), bytearray(), None, 0
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")]
        for page_id, url, html, digest, refers_to in zip(*cols, strict=True):
            rec = _record(page_id, url or "", html.encode("utf-8", "surrogatepass"), digest, refers_to)
            if archive is None:  # the task's number keeps apart archives of equal content
                archive = f"{task:06d}-{hashlib.sha256(rec).hexdigest()[:16]}"
                data += _info(archive)
            data += rec
            if len(data) >= PART_BYTES:
                yield _part(archive, part, data)
                data, part = bytearray(), part + 1
    if data:
        yield _part(archive, part, data)


def _part(archive, part, data):
    return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([part], pa.int32()), pa.array([bytes(data)], pa.binary())], ["archive", "part", "data"])


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives as a written table (archive, part, data); parts hold whole records.

    An archive is what one task writes; its name has the task's number and the digest of its first record.
    """
    return written(pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write, "archive string, part int, data binary"))


def records(data: bytes):
    """(offset, length, header fields, payload) of every record of a part."""
    at = 0
    while at < len(data):
        z, got, end = zlib.decompressobj(31), [], at
        while not z.eof and end < len(data):
            got.append(z.decompress(data[end : end + CHUNK]))
            end += min(CHUNK, len(data) - end)
        end -= len(z.unused_data)
        head, _, rest = b"".join(got).partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        block = rest[: int(fields["Content-Length"])]
        yield at, end - at, fields, block.partition(b"\r\n\r\n")[2]
        at = end


_RUN = "run string, urlkey string, ts string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, part int, offset long, length long"


def _read(batches):
    """Each part's captures, checked against their digests, sorted: a local run."""
    for batch in batches:
        for archive, part, data in zip(batch.column("archive").to_pylist(), batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
            rows = []
            for offset, length, h, payload in records(data):
                kind = h["WARC-Type"]
                if kind == "warcinfo":
                    continue
                digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response":
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest != h["WARC-Payload-Digest"].removeprefix("sha256:"):
                        raise ValueError(f"record at {offset} of {archive}: payload and digest differ")
                size = len(payload) if kind == "response" else int(h["X-Payload-Length"])
                number = lambda name: int(x) if (x := h.get(name, "")[10:-1]) else None
                rows.append((f"{archive}/{part}", url_key(h.get("WARC-Target-URI", "")), h["WARC-Date"], number("WARC-Record-ID"), kind, digest, size, number("WARC-Refers-To"), part, offset, length))
            rows.sort(key=_order)
            yield _batch(rows)


def _order(r):
    return r[1], r[2], r[3] is None, r[3] or 0, r[0], r[9]


def _batch(rows):
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _RUN.split(", ")])


class LoserTree:
    """Merge of sorted iterators: each inner node holds the loser of its match, so a step costs one path."""

    def __init__(self, key):
        self.key, self.its, self.heads, self.tree, self.win = key, [], [], [], 0

    def add(self, rows) -> None:
        """A further sorted iterator; those that have ended leave, and all matches are played anew."""
        own = [(h, it) for h, it in zip(self.heads, self.its, strict=True) if h is not None]
        for row in (it := iter(rows)):
            own.append(((self.key(row), len(own), row), it))
            break
        # the middle number keeps equal keys apart; it follows the order of adding
        self.heads = [(h[0], k, h[2]) for k, (h, _) in enumerate(own)]
        self.its = [it for _, it in own]
        self.tree = [0] * len(own)
        self.win = self._play(1) if len(own) > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _play(self, node: int) -> int:
        """Winner of the matches below."""
        if node >= len(self.its):
            return node - len(self.its)
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.tree[node] = lose
        return win

    def least(self):
        """Key of the next row, or None at the end."""
        return self.heads[self.win][0] if self.heads and self.heads[self.win] is not None else None

    def pop(self):
        row = self.heads[self.win][2]
        self.heads[self.win] = next(((self.key(x), self.win, x) for x in self.its[self.win]), None)
        node = (self.win + len(self.its)) // 2
        while node:
            if self._less(self.tree[node], self.win):
                self.tree[node], self.win = self.win, self.tree[node]
            node //= 2
        return row


def loser_tree_merge(runs, key):
    """All rows of sorted iterables in order."""
    tree = LoserTree(key)
    for run in runs:
        tree.add(run)
    while tree.least() is not None:
        yield tree.pop()


def merge_blocks(blocks, key):
    """All rows in order of blocks(first key, rows) that come in order of first key; a block is opened as the merge reaches it."""
    tree = LoserTree(key)
    for first, rows in blocks:
        while tree.least() is not None and tree.least() < first:
            yield tree.pop()
        tree.add(rows)
    while tree.least() is not None:
        yield tree.pop()


_BLOCK = "range int, urlkey string, ts string, no_id boolean, page_id long, run string, offset long, blob binary"


def _blocks(bounds: list[tuple[str, str]], most: int):
    """Runs cut at the bounds and every `most` rows: blocks that begin with the key of their first row."""

    def block(at, rows):
        to = pa.BufferOutputStream()
        batch = _batch(rows)
        with pa.ipc.new_stream(to, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(batch)
        o = _order(rows[0])
        cols = [[at], [o[0]], [o[1]], [o[2]], [o[3]], [o[4]], [o[5]], [to.getvalue().to_pybytes()]]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])

    def run(batches):
        own, at = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to = bisect.bisect_right(bounds, (row[1], row[2]))
                # a file that was split between tasks makes two runs of one
                if own and (to != at or len(own) >= most or row[0] != own[-1][0] or _order(row) < _order(own[-1])):
                    yield block(at, own)
                    own = []
                at = to
                own.append(row)
        if own:
            yield block(at, own)

    return run


def _merge(batches):
    def blocks():
        for batch in batches:
            *firsts, blobs = (c.to_pylist() for c in batch.columns)
            for *first, blob in zip(*firsts, blobs, strict=True):
                at = (first[0], tuple(first[1:]))
                with pa.ipc.open_stream(blob) as r:
                    rows = [row for b in r for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                # a partition may hold several ranges; they follow each other
                yield at, [(at[0], row) for row in rows]

    out = []
    for _, row in merge_blocks(blocks(), lambda x: (x[0], _order(x[1]))):
        out.append(row)
        if len(out) >= 10_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def capture_index(archives: DataFrame, block: int = 4096) -> DataFrame:
    """Captures of all archives; partitions are ranges of (urlkey, ts, page_id), each in order."""
    runs = written(archives.select("archive", "part", "data").mapInArrow(_read, _RUN))
    n = partitions(archives.sparkSession, archives)
    # bounds of n ranges of about equal size: the least keys of Spark's own range partitions
    keys = runs.select("urlkey", "ts").repartitionByRange(n, "urlkey", "ts").groupBy(F.spark_partition_id().alias("p"))
    least = keys.agg(F.min(F.struct("urlkey", "ts")).alias("k")).select("k.*").collect()  # n rows at most
    bounds = sorted((r["urlkey"], r["ts"]) for r in least)[1:]
    dealt = runs.mapInArrow(_blocks(bounds, block), _BLOCK).repartitionById(n, F.col("range"))
    order = ["range", "urlkey", "ts", "no_id", "page_id", "run", "offset"]
    return dealt.sortWithinPartitions(*order).mapInArrow(_merge, _RUN)


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write the archives as <folder>/<archive>.warc.gz, to a folder that pyarrow can reach from every executor; (archive, bytes) of each.

    A file is written under another name and then moved, so a task that runs twice does no harm.
    """

    def run(batches):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(at, recursive=True)
        task = TaskContext.get().taskAttemptId()
        name, f = None, None

        def closed():
            size = f.tell()
            f.close()
            store.move(f"{at}/.{name}.{task}", f"{at}/{name}.warc.gz")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["archive", "bytes"])

        for batch in batches:
            for archive, data in zip(batch.column("archive").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if archive != name:
                    if f is not None:
                        yield closed()
                    name, f = archive, store.open_output_stream(f"{at}/.{archive}.{task}", compression=None)
                f.write(data)
        if f is not None:
            yield closed()

    ship(archives.sparkSession)
    ordered = archives.select("archive", "part", "data").repartition("archive").sortWithinPartitions("archive", "part")
    return ordered.mapInArrow(run, "archive string, bytes long")


def read_warc_files(spark, path: str) -> DataFrame:
    """file, offset, length, type, uri, date, record_id, fields and payload of every record of .warc.gz files, of any writer."""

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for offset, length, h, payload in records(data):
                    cols = [[file], [offset], [length], [h.get("WARC-Type")], [h.get("WARC-Target-URI")], [h.get("WARC-Date")], [h.get("WARC-Record-ID")], [list(h.items())], [payload]]
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    schema = "file string, offset long, length long, type string, uri string, date string, record_id string, fields map<string,string>, payload binary"
    names = [x.split()[0] for x in schema.replace("map<string,string>", "map").split(", ")]
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Write, read back and index all pages."""
    return capture_index(write_archives(decided(pages, id_col, url_col, text_col)))
