"""Web archives: WARC records with revisits, and an external index merged from sorted capture runs.

Writing tasks put their records into an archive of their own and leave sorted runs of
index rows as files of small blocks, with a sparse index of the first and last key of each
block. The key range is cut at sampled keys; each range opens its slice of every run and
streams it through a loser tree, one block of each run in memory. So the index as a whole is in
order and the captures of one URL follow each other in time, even where they spread
over several ranges; each capture carries its number in that history.
"""

from __future__ import annotations

import base64
import bisect
import datetime as dt
import hashlib
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import map_arrow, materialise, open_store, shared_dir

#: Index rows; the first five columns are their order.
INDEX = "url_key string, ts string, page_id long, file string, offset long, url string, record_type string, digest string, length long"
KEYS = [c.split()[0] for c in INDEX.split(", ")][:5]
#: The sparse index of the runs: where a block is, and its first and last key.
BLOCKS = "run string, at long, size long, " + ", ".join(f"{end}_{c}" for end in ("first", "last") for c in INDEX.split(", ")[:5])
#: Rows of a block, and of a run: a task with more index rows leaves several runs.
BLOCK_ROWS, RUN_ROWS = 256, 200_000
#: Sampled keys for each cut of the key range.
_SAMPLED = 20
_HEAD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, so the next row costs one path of matches."""

    _END = object()

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, self._END) for r in self.runs]
        k = max(1, len(self.runs))
        self.losers = [-1] * k
        for i in range(len(self.runs)):
            self._play(i, building=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not self._END and (y is self._END or x < y or (x == y and a < b))

    def _play(self, i: int, building: bool = False) -> None:
        node, winner = (i + len(self.losers)) // 2, i
        while node > 0:
            other = self.losers[node]
            if other < 0:
                if building:
                    self.losers[node] = winner
                    return
            elif self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        if not self.runs:
            return
        while True:
            winner = self.losers[0]
            row = self.heads[winner]
            if row is self._END:
                return
            yield row
            self.heads[winner] = next(self.runs[winner], self._END)
            self._play(winner)


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query; scheme, ``www``, port and fragment left out."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:  # not a URL: kept as it is
        return url.strip().lower()
    query = f"?{'&'.join(sorted(parts.query.split('&')))}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path.rstrip('/').lower() or '/'}{query}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, sha1 and refers_to (null: response) of each page, without the pages' text.

    Both sides of the join are written tables, so a payload with very many copies is
    split among tasks.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    found = materialise(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("sha1"),
                                     F.octet_length(payload).cast("long").alias("size")), "warc-digests")
    first = materialise(found.groupBy("sha1", "size").agg(F.min("page_id").alias("first")), "warc-first")
    joined = found.join(first, ["sha1", "size"])
    later = (F.col("page_id") > F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull())
    return joined.select("page_id", "sha1", F.when(later & (F.col("size") >= least_bytes), F.col("first")).alias(
        "refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, captured: Column, least_bytes: int = 0) -> DataFrame:
    """Writes one archive per task below ``folder``, and its index runs; returns the sparse index of the runs.

    Every record is a gzip member of its own. A response holds the HTTP head and the
    payload; a revisit has the HTTP head with the payload's length, its digest, and the
    record it refers to. The names of files are new for every attempt of a task, and only
    the blocks of successful attempts count. Null html is an empty payload; a null time
    comes before all others, and so does a null page_id.
    """
    chosen = revisits(pages, least_bytes)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
                        F.unix_seconds(captured.cast("timestamp")).alias("seconds"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    same = rows["page_id"].eqNullSafe(chosen["page_id"]) & (rows["sha1"] == chosen["sha1"])
    rows = rows.join(chosen, same).select(rows["page_id"], "url", "payload", "seconds", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        name, offset, index = f"pages-{uuid.uuid4().hex}.warc.gz", 0, []
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                for page, url, payload, seconds, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    digest, ts = payload_digest(payload), _stamp(seconds)
                    kind = "response" if refers is None else "revisit"
                    deflate = zlib.compressobj(5, zlib.DEFLATED, 31)
                    data = deflate.compress(_record(page, url, payload, ts, refers, digest)) + deflate.flush()
                    out.write(data)
                    index.append((url_key(url), ts, -1 if page is None else page, name, offset, url or "", kind, digest, len(data)))
                    offset += len(data)
                    if len(index) == RUN_ROWS:
                        yield _batch(write_run(store, path, index), BLOCKS)
                        index = []
        if index:
            yield _batch(write_run(store, path, index), BLOCKS)
        if not offset:
            store.delete_file(f"{path}/{name}")

    return materialise(map_arrow(rows, run, BLOCKS), "warc-blocks")


def write_run(store, path: str, index: list[tuple]) -> list[tuple]:
    """Writes index rows, sorted, as one run of compressed blocks; returns the rows of its sparse index."""
    index.sort()
    name, at, blocks = f"run-{uuid.uuid4().hex}", 0, []
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        for rows in itertools.batched(index, BLOCK_ROWS):
            data = zlib.compress(json.dumps(rows).encode(), 1)
            out.write(data)
            blocks.append((name, at, len(data), *rows[0][:5], *rows[-1][:5]))
            at += len(data)
    return blocks


def read_run(store, path: str, name: str, blocks: list[tuple[int, int]]) -> Iterator[tuple]:
    """The rows of some blocks of a run, one block at a time."""
    for at, size in blocks:
        with store.open_input_file(f"{path}/{name}") as source:
            data = source.read_at(size, at)
        yield from map(tuple, json.loads(zlib.decompress(data)))


def _stamp(seconds: int | None) -> str:
    if seconds is None:
        return ""
    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)).strftime("%Y%m%d%H%M%S")


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    columns = [c.split() for c in ddl.split(", ")]
    kinds = [pa.int64() if t == "long" else pa.string() for _, t in columns]
    cols = list(zip(*rows, strict=True)) or [[]] * len(columns)
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [n for n, _ in columns])


def _record(page, url, payload: bytes, ts, refers, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers is None else b"")
    date = f"{ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:]}Z" if ts else "1970-01-01T00:00:00Z"
    uri = re.sub(r"\s", "", url or "")  # a header is one line
    head = [f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
            f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def key_cuts(blocks: DataFrame, ranges: int) -> list[tuple]:
    """At most ``ranges - 1`` keys that cut the key range evenly, from some 20 sampled block keys for each.

    Any cuts give the same merged index; they only share out the work.
    """
    n = max(1, blocks.count())
    part = F.pmod(F.xxhash64("run", "at"), F.lit(1 << 30)) * n < F.lit(_SAMPLED * ranges << 30).cast("double")
    keys = sorted(tuple(r) for r in blocks.where(part).select(*[f"first_{c}" for c in KEYS]).collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def merge_index(blocks: DataFrame, folder: str, ranges: int | None = None) -> DataFrame:
    """The global index with ``range``, ``place`` and ``capture``.

    Rows are ordered by URL key, timestamp, page and place in the archives: by ``range``, then by ``place``
    in it. ``capture`` numbers the captures of one URL key from 1, over all ranges. A range
    reads only the blocks that overlap it and holds one block of each run. No rows give no rows.
    """
    ranges = ranges or int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = key_cuts(blocks, ranges)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for run, at, size, *ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = (bisect.bisect_right(cuts, tuple(e)) for e in (ends[:5], ends[5:]))
                rows += [(r, run, at, size) for r in range(low, high + 1)]
            yield _batch(rows, "range long, run string, at long, size long")

    dealt = map_arrow(blocks, deal, "range long, run string, at long, size long")
    dealt = dealt.repartition(ranges, "range").sortWithinPartitions("range", "run", "at")
    ddl = f"range long, place long, nth long, {INDEX}, last long"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        listed = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for number, group in itertools.groupby(listed, lambda x: x[0]):
            runs = [read_run(store, path, run, [x[2:] for x in part]) for run, part in
                    [(run, list(part)) for run, part in itertools.groupby(group, lambda x: x[1])]]
            inside = (row for row in LoserTree(runs) if bisect.bisect_right(cuts, row[:5]) == number)
            place = itertools.count()
            numbered = ((number, next(place), nth, *row) for _, history in itertools.groupby(inside, lambda x: x[0])
                        for nth, row in enumerate(history, 1))
            for part in itertools.batched(_with_last(numbered), 10_000):
                yield _batch(part, ddl)

    index = materialise(map_arrow(dealt, merge, ddl), "warc-index")
    # The first and the last row of each range: two rows for each of the ranges, whose number is a setting.
    edges = index.where("place = 0 OR last = 1").select("range", "place", "url_key", "nth", "last").collect()
    carried = index.sparkSession.createDataFrame(carry(edges), "range long, url_key string, before long")
    return index.join(F.broadcast(carried), ["range", "url_key"], "left").select(
        "range", "place", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("capture"), *[c.split()[0] for c in INDEX.split(", ")])


def _with_last(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The rows with 1 at the last one and 0 at all others."""
    held = None
    for row in rows:
        if held:
            yield (*held, 0)
        held = row
    if held:
        yield (*held, 1)


def carry(edges: list) -> list[tuple]:
    """(range, url_key, captures in the ranges before) of histories that go on from the range before.

    ``edges`` are the first and the last row of each range that has rows; they may be one row.
    """
    out, key, total = [], None, 0
    for number, rows in itertools.groupby(sorted(edges, key=lambda x: (x.range, x.place)), lambda x: x.range):
        rows = list(rows)
        head, tail = rows[0], rows[-1]
        if head.url_key == key:
            out.append((number, key, total))
        total = tail.nth + (total if head.url_key == key == tail.url_key else 0)
        key = tail.url_key
    return out


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Each indexed record read at its place: page_id, type, payload length and digest, and the record referred to.

    URL key, timestamp and number of the capture are those of the index. The digest of a
    response is computed from the payload read; a revisit's is that of its head.
    """
    places = index.select("file", "offset", "length", "url_key", "ts", "capture").repartition(
        "file", F.floor(F.col("offset") / (16 << 20))).sortWithinPartitions("file", "offset")
    ddl = ("page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, "
           "url_key string, ts string, capture long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length, *capture in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    name, source = file, store.open_input_file(f"{path}/{file}")
                rows.append((*_read(source.read_at(length, offset)), *capture))
            yield _batch(rows, ddl)

    return map_arrow(places, run, ddl)


def _read(data: bytes) -> tuple:
    record = zlib.decompress(data, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in _HEAD.findall(head)}
    body = rest[:int(fields[b"content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    kind = fields[b"warc-type"].decode()
    number = lambda v: int(d) if (d := v.decode().removeprefix("<urn:page:").rstrip(">")) else None
    if kind == "response":
        return number(fields[b"warc-record-id"]), kind, len(payload), payload_digest(payload), None
    size = int({k.lower(): v for k, v in _HEAD.findall(http)}[b"content-length"])
    return (number(fields[b"warc-record-id"]), kind, size, fields[b"warc-payload-digest"].decode().removeprefix("sha1:"),
            number(fields[b"warc-refers-to"]))


def archive_round_trip(pages: DataFrame, captured: Column, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Writes archives and the merged index to the shared folder; returns the index and the records read back through it.

    One record for each row: repeated rows are captures of their own, all but the
    response revisits. A null page_id comes after all others as a payload's response and
    is read back as null; a null or broken URL is a key of its own; no pages give no records.
    Columns other than page_id, url and html are not read, whatever they are called.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    index = merge_index(write_archives(pages, folder, captured, least_bytes), folder)
    return index, read_archives(index, folder)
