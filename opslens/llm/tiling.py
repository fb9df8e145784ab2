"""Benchmark decontamination by greedy string tiling.

Runs of words that a document shares with a test item are its seeds. For each document
and item with a common seed, the longest match of unmarked words is marked, then the next
longest, until none of the least length is left; matches are found by running Karp-Rabin
hashes. The share of the item's words under tiles decides, so passages in another order
count as much as the whole.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import map_arrow, texts_of

#: ASCII characters other than letters and digits separate words.
_APART = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
MASK = (1 << 61) - 1


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_APART).split()


def tiles(a: list[int], b: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles (start in a, start in b, length), each of at least ``least`` words.

    Each round hashes all unmarked runs of the round's length in b and rolls over a. Matches
    are taken where they begin only, so a stretch of repeated words counts once for each
    diagonal. They are marked, longest first; what a mark leaves of a longer match
    goes back into the order with its new length. Then the length falls.
    """
    free_a, free_b, found = bytearray(b"\1" * len(a)), bytearray(b"\1" * len(b)), []
    length = max(least, min(len(a), len(b)))
    while length >= least:
        places = defaultdict(list)
        for h, j in _rolling(b, free_b, length):
            places[h].append(j)
        heap = []
        for h, i in _rolling(a, free_a, length) if places else ():
            for j in places.get(h, ()):
                if i and j and a[i - 1] == b[j - 1] and free_a[i - 1] and free_b[j - 1]:
                    continue  # inside a longer match
                n = _common(a, i, b, j, min(_stretch(free_a, i), _stretch(free_b, j)))
                if n >= length:
                    heap.append((-n, i, j))
        heapq.heapify(heap)
        matches = bool(heap)
        while heap:
            n, i, j = heapq.heappop(heap)
            for at, size in _open(free_a, i, free_b, j, -n):
                if size == -n:
                    free_a[i:i + size] = free_b[j:j + size] = bytes(size)
                    found.append((i, j, size))
                elif size >= length:
                    heapq.heappush(heap, (-size, i + at, j + at))
        if length == least and not matches:
            break  # else what a mark of this round has cut short is looked for again
        length = max(length // 2, least)
    return found


def _stretch(free: bytearray, at: int) -> int:
    """Unmarked places from here on."""
    end = free.find(0, at)
    return (len(free) if end < 0 else end) - at


def _common(a: list[int], i: int, b: list[int], j: int, most: int) -> int:
    """Length of the common run from i and j, at most ``most``: doubled while it holds, then halved."""
    n, step = 0, 1
    while step:
        size = min(step, most - n)
        if size and a[i + n:i + n + size] == b[j + n:j + n + size]:
            n, step = n + size, step * 2
        else:
            step = min(step, size) // 2
    return n


def _open(free_a: bytearray, i: int, free_b: bytearray, j: int, n: int) -> list[tuple[int, int]]:
    """Stretches (offset, length) of a match that no mark touches on either side."""
    out, at = [], 0
    while at < n:
        size = min(_stretch(free_a, i + at), _stretch(free_b, j + at), n - at)
        if size:
            out.append((at, size))
            at += size
        else:
            ends = [free.find(1, k + at, k + n) - k for free, k in ((free_a, i), (free_b, j)) if not free[k + at]]
            if min(ends) < 0:
                break
            at = max(ends)
    return out


def _rolling(x: list[int], free: bytearray, n: int) -> Iterator[tuple[int, int]]:
    """Karp-Rabin hash and start of every run of n unmarked words."""
    top, h, run = pow(1_000_003, n - 1, MASK), 0, 0
    for i, w in enumerate(x):
        if not free[i]:
            h = run = 0
            continue
        if run >= n:
            h = (h - x[i - n] * top) % MASK
        h = (h * 1_000_003 + w) % MASK
        run += 1
        if run >= n:
            yield h, i - n + 1


class Benchmark:
    """Test items as word ids, and their seeds: every run of ``least`` words with the items and places where it occurs."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[int, list[int]] = {}
        for item, text in items:
            ws = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ws:
                self.items[item] = ws
        self.least = least
        self.seeds: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        self.sizes = set()
        for item, ws in self.items.items():
            n = min(least, len(ws))  # an item of fewer words is a seed as a whole
            self.sizes.add(n)
            for i in range(len(ws) - n + 1):
                self.seeds[tuple(ws[i:i + n])].append((item, i))
        self.sizes = sorted(self.sizes)
        #: By length, a filter of the seeds' hashes; what passes is looked up exactly.
        self.filters = {}
        for n in self.sizes:
            self.filters[n] = np.zeros(1 << 22, bool)
            self.filters[n][_code(np.array([s for s in self.seeds if len(s) == n]))] = True

    def hits(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Start and length of every seed among word ids (0: a word no item has, or a border between documents)."""
        found = []
        for n in self.sizes:
            if len(ids) < n:
                continue
            runs = np.lib.stride_tricks.sliding_window_view(ids, n)
            known = np.flatnonzero(np.minimum.reduce([ids[k:len(ids) - n + 1 + k] for k in range(n)]) > 0)
            known = known[self.filters[n][_code(runs[known])]]
            found += [(at, n) for at, run in zip(known.tolist(), map(tuple, runs[known].tolist()), strict=True)
                      if run in self.seeds]
        return sorted(found)

    def candidates(self, ids: np.ndarray, hits: list[tuple[int, int]], coverage: float) -> dict[int, list[tuple[int, int]]]:
        """Items whose words under common seeds reach the coverage, with the runs of the document (start, end)
        that its seeds cover. Tiles are made of common seeds, so no other item can reach it."""
        places: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for at, n in hits:
            for item, place in self.seeds[tuple(ids[at:at + n].tolist())]:
                places[item].add((at, place))
        out = {}
        for item, pairs in places.items():
            size, n = len(self.items[item]), min(self.least, len(self.items[item]))
            if len({p for _, p in pairs}) * n >= coverage * size and len(
                    {p + k for _, p in pairs for k in range(n)}) >= coverage * size:
                out[item] = _runs(sorted({a + k for a, _ in pairs for k in range(n)}))
        return out


def _runs(places: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in places:
        out[-1:] = [(out[-1][0], p + 1)] if out and out[-1][1] == p else [*out[-1:], (p, p + 1)]
    return out


def _code(runs: np.ndarray) -> np.ndarray:
    h = np.zeros(len(runs), np.uint64)
    for k in range(runs.shape[1]):
        h = (h ^ runs[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h >> np.uint64(42)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 4, coverage: float = 0.6,
                 block_bytes: int = 32 << 20) -> DataFrame:
    """One row per document and test item whose tiles cover at least ``coverage`` of the item's words.

    Columns: doc_id, item_id, item_words, tiles, covered_words, coverage, longest_tile,
    spans (first word and number of words of each tile in the document). The benchmark is
    a query set against all documents: it goes to the tasks in blocks of at most
    ``block_bytes`` of text each, one pass over the documents per block. Items without
    words match nothing, null texts count as empty; repeated rows of documents count each,
    and of repeated item_ids one row with the smallest text.
    """
    items = benchmark.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1
    spark, out = docs.sparkSession, None
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else items
        rows = sorted((r.item_id, r.text) for r in part.collect())  # one block of bounded size
        found = _one_block(docs, spark.sparkContext.broadcast(rows), least, coverage)
        out = found if out is None else out.unionByName(found)
    return out


def _one_block(docs: DataFrame, items, least: int, coverage: float) -> DataFrame:
    names = ["doc_id", "item_id", "item_words", "tiles", "covered_words", "coverage", "longest_tile", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(items.value, least)
        get = bench.vocabulary.get
        for batch in batches:
            rows = []
            for doc, ids, hits in _documents(batch, bench, get):
                for item, runs in sorted(bench.candidates(ids, hits, coverage).items()):
                    b = bench.items[item]
                    # only these runs can match; a number below zero, found nowhere else, keeps them apart
                    a = [x for k, (i, j) in enumerate(runs) for x in (*ids[i:j].tolist(), -1 - k)]
                    home = [x for i, j in runs for x in (*range(i, j), -1)]
                    got = [(home[i], j, n) for i, j, n in tiles(a, b, min(least, len(b)))]
                    covered = sum(n for _, _, n in got)
                    if covered >= coverage * len(b):
                        rows.append((doc, item, len(b), len(got), covered, covered / len(b), max(n for _, _, n in got),
                                     [{"start": i, "words": n} for i, _, n in sorted(got)]))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(),
                     pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                     "doc_id long, item_id long, item_words long, tiles long, covered_words long, coverage double, "
                     "longest_tile long, spans array<struct<start:bigint,words:bigint>>")



def _documents(batch: pa.RecordBatch, bench: Benchmark, get) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int]]]]:
    """Documents with a seed: doc_id, word ids and hits. A thousand documents are searched at once, a border after each."""
    for k in range(0, batch.num_rows, 1000):
        part = batch.slice(k, 1000)
        words, ends = [], []
        for text in texts_of(part.column(1)):
            words += words_of(text)
            words.append(b" ")
            ends.append(len(words))
        ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        by_doc: dict[int, list[tuple[int, int]]] = defaultdict(list)
        hits = bench.hits(ids)
        owner = np.searchsorted(ends, [at for at, _ in hits], side="right")
        for d, hit in zip(owner.tolist(), hits, strict=True):
            by_doc[d].append(hit)
        docs = part.column(0).to_pylist()
        for d, found in by_doc.items():
            start = ends[d - 1] if d else 0
            yield docs[d], ids[start:ends[d] - 1], [(at - start, n) for at, n in found]
