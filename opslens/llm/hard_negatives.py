"""Hard negatives by exact inner product, with length buckets and coordinate pruning.

1. Rows fall into length classes, the longest first, and a class is dealt by hash into
   buckets of bounded size, stored one after the other in files. An anchor block is such a
   bucket of anchors.
2. A threshold is set for each anchor before any other row is read: the score of its last
   wanted neighbour among the anchors of its own block. Only buckets whose length allows
   the threshold meet the block; as classes fall in length, these are the first ones of a file.
3. A bucket keeps one sorted list of the normalised values of each coordinate. For an
   anchor's largest coordinates (its focus) the threshold leaves a range of values that a
   row may have; the rows inside all ranges are the candidates.
4. Candidates are verified by their exact integer score. A task streams a slice of the files
   past its blocks and keeps the best rows of each anchor; the thresholds rise with them. Only
   these rows are handed on, and the best of all slices are taken.

The search runs twice: for the positives of each anchor, then for the negatives of all its
positives at once, whose wanted scores are known from the first search. What a task holds is a
bucket, its blocks and their best rows, at any size of the table; blocks and buckets are not
shuffled to each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslens.llm.common import discard, map_arrow, materialise, open_store, remove, shared_dir

#: Components of all rows of a bucket, and of an anchor block; rows of either, however short.
BUCKET_CELLS, BLOCK_CELLS, MOST_ROWS = 1 << 16, 1 << 17, 1 << 11
#: Buckets of a slice at least, so that slices hand on few rows for those they read.
SLICE_BUCKETS = 32
#: Scores computed at once, and found rows that wait to be sorted in.
STRIP, WAITING = 1 << 18, 1 << 16
#: Candidates are verified one by one where a range leaves at most one row in so many, otherwise with all rows of the bucket.
FEW = 16
#: Largest coordinates of an anchor whose ranges are intersected.
FOCUS = 5
#: Length classes for each doubling of the length.
CLASSES = 8
#: What float64 and float32 hold exactly.
_EXACT, _EXACT32 = float(1 << 53), float(1 << 24)
_EPS = 1e-9
#: The ends of a long; the lower one as a threshold stands for none.
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Rules:
    """``positives`` of each anchor, ``negatives`` of each positive, scores from ``low`` to ``high`` percent of its score."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def usable_rows(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v, key) of the rows that take part: components times ``scale``, rounded down; repeated rows once."""
    size = F.lit(float(scale))
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * size) < float("inf")), F.lit(False)))
    used = rows.select("vec_id", "label", "embedding").where("vec_id is not null and label is not null and embedding is not null").where(fine)
    return used.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * size)).alias("v")).distinct().withColumn(
        "key", F.xxhash64("vec_id", "label", "v"))


def _with_class(rows: DataFrame) -> DataFrame:
    """Adds norm2 and the length class: at most some hundred classes, as components are longs."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.withColumn("norm2", norm2).withColumn("cls", F.when(F.col("norm2") > 0, F.floor(
        F.log2("norm2") * (CLASSES / 2)).cast("int")).otherwise(-1))


def _class_list(rows: DataFrame, cells: int) -> list[tuple[int, float, int, int]]:
    """(class, greatest length, first bucket, buckets), longest first: one entry for each length class, whatever the rows."""
    found = rows.groupBy("cls").agg(F.sqrt(F.max("norm2")).alias("top"), F.sum(F.size("v") + F.lit(1)).alias("cells"),
                                   F.count("*").alias("n")).collect()
    out, first = [], 0
    for r in sorted(found, key=lambda r: -r.cls):
        n = max(-(-r.cells // cells), -(-r["n"] // MOST_ROWS))
        out.append((r.cls, r.top * (1 + _EPS), first, n))
        first += n
    return out


def _number(classes: list[tuple[int, float, int, int]]) -> int:
    """Buckets of all classes."""
    return sum(c[3] for c in classes)


def _dealt(rows: DataFrame, classes: list, name: str) -> DataFrame:
    """The rows with the number of their bucket: within a class by hash, so that no label, id or vector gathers."""
    pairs = [F.lit(x) for c in classes for x in (c[0], F.struct(F.lit(c[2]).alias("first"), F.lit(c[3]).alias("n")))]
    if not pairs:
        return rows.withColumn(name, F.lit(0).cast("long"))
    at = F.create_map(*pairs)[F.col("cls")]
    return rows.withColumn(name, (at["first"] + F.pmod("key", at["n"].cast("long"))).cast("long"))


class Bucket:
    """Vectors of a bucket or block; the coordinate lists are built when they are asked for."""

    def __init__(self, items: pa.StructArray):
        self.id = items.field("vec_id").to_numpy(zero_copy_only=False)
        self.key = items.field("key").to_numpy(zero_copy_only=False)
        self.label = items.field("label").to_numpy(zero_copy_only=False)
        lists = items.field("v")
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        n, d = len(self.id), int(sizes.max(initial=0))
        if (sizes == d).all():
            self.whole = flat.reshape(n, d)
        else:  # shorter vectors end in zeros
            self.whole = np.zeros((n, d), np.int64)
            self.whole[np.arange(d)[None, :] < sizes[:, None]] = flat
        self.v = self.whole.astype(np.float64)
        self.length = np.sqrt((self.v ** 2).sum(axis=1))
        self.most = float(np.abs(self.v).max(initial=0))
        self.longest = float(self.length.max(initial=0))
        self._lists, self._focus, self._narrow = None, {}, None

    def width(self, d: int) -> np.ndarray:
        return self.v if self.v.shape[1] == d else np.pad(self.v, ((0, 0), (0, d - self.v.shape[1])))

    def narrow(self, d: int) -> np.ndarray:
        if self._narrow is None or self._narrow.shape[1] != d:
            self._narrow = self.width(d).astype(np.float32)
        return self._narrow

    def scores(self, other: Bucket, rows: np.ndarray) -> np.ndarray:
        """Exact scores of the given rows with all rows of the other: floats where they hold them, otherwise Python's integers.

        No part of a sum of products is greater than the product of the lengths.
        """
        d = max(self.v.shape[1], other.v.shape[1])
        if self.longest * other.longest * (1 + _EPS) < _EXACT32 and max(self.most, other.most) < _EXACT32:
            return self.narrow(d)[rows] @ other.narrow(d).T
        if self.most * other.most * max(d, 1) < _EXACT:
            return self.width(d)[rows] @ other.width(d).T
        pad = lambda x: np.pad(x, ((0, 0), (0, d - x.shape[1])))
        return pad(self.whole[rows]).astype(object) @ pad(other.whole).astype(object).T

    def pair_scores(self, other: Bucket, mine: np.ndarray, its: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of rows, the first of each from here."""
        d = min(self.v.shape[1], other.v.shape[1])
        exact = self.most * other.most * max(d, 1) < _EXACT
        x, y = (self.v, other.v) if exact else (self.whole.astype(object), other.whole.astype(object))
        return (x[mine, :d] * y[its, :d]).sum(axis=1)

    @property
    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised values, and by coordinate the sorted values and the rows they belong to."""
        if self._lists is None:
            unit = self.v / np.where(self.length > 0, self.length, 1)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            self._lists = unit, np.take_along_axis(unit, order, axis=0).T.copy(), order.T.copy()
        return self._lists

    @property
    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest normalised value of each coordinate."""
        unit = self.v / np.where(self.length > 0, self.length, 1)[:, None]
        return unit.min(axis=0), unit.max(axis=0)

    def focus(self, m: int, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the ``m`` coordinates of the greatest size (those from ``d`` on stand as the first), and its angles to them."""
        if (m, d) not in self._focus:
            q = self.v / np.where(self.length > 0, self.length, 1)[:, None]
            axes = np.argsort(-np.abs(q), axis=1, kind="stable")[:, :m]
            axes[axes >= d] = 0
            self._focus[m, d] = axes, np.arccos(np.clip(np.take_along_axis(q, axes, axis=1), -1, 1))
        return self._focus[m, d]


def candidate_pairs(block: Bucket, least: np.ndarray, bucket: Bucket, focus: int = FOCUS,
                    few: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the bucket that may score ``least`` or more: the anchors with all rows, and pairs (anchor, row) of the others.

    With a the angle between anchor and coordinate axis and b the greatest angle between
    anchor and row that the threshold allows, a row's angle to the axis lies within a - b
    and a + b, so its normalised value lies between the cosines of these. Ranges that leave
    more than one row in ``few`` are not looked into: their anchors have all rows.
    """
    n, d = bucket.v.shape
    low, high = bucket.length.min(initial=np.inf), bucket.longest
    nothing = np.zeros(0, np.int64)
    product = block.length * np.where(least > 0, high, low)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = least / product
    whole = ~((product == 0) & (least > 0)) & ~((product > 0) & (cosine > 1 + _EPS))  # others: all scores are 0 or too small
    ready = np.flatnonzero((product > 0) & (cosine > -1) & (cosine <= 1 + _EPS))
    m = min(focus, d, block.v.shape[1])
    if not n or not len(ready) or not m or low == 0:
        return np.flatnonzero(whole & (n > 0)), nothing, nothing
    axes, a = (x[ready] for x in block.focus(m, d))
    b = np.arccos(np.clip(cosine[ready], -1, 1))[:, None]
    lo, hi = np.cos(np.minimum(np.pi, a + b)) - _EPS, np.cos(np.maximum(0, a - b)) + _EPS
    first, last = bucket.ends
    cut = ((lo > first[axes]) | (hi < last[axes])).any(axis=1)
    if not cut.any():  # an anchor whose ranges hold every row has all as candidates
        return np.flatnonzero(whole), nothing, nothing
    ready, axes, lo, hi = ready[cut], axes[cut], lo[cut], hi[cut]
    unit, values, order = bucket.lists
    start, stop = np.zeros_like(axes), np.full_like(axes, n)
    for f in np.unique(axes):
        at = axes == f
        start[at] = np.searchsorted(values[f], lo[at], "left")
        stop[at] = np.searchsorted(values[f], hi[at], "right")
    size = np.maximum(stop - start, 0)
    by = size.argmin(axis=1)
    least_size = size[np.arange(len(size)), by]
    k = np.flatnonzero((least_size < n) & (least_size * few <= n))
    whole[ready[k]] = False
    by, count = by[k], least_size[k]
    of = np.repeat(np.arange(len(k)), count)
    at = start[k, by][of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    rows = order[axes[k, by][of], at]
    for j in range(m):
        x = unit[rows, axes[k[of], j]]
        inside = (x >= lo[k[of], j]) & (x <= hi[k[of], j])
        of, rows = of[inside], rows[inside]
    return np.flatnonzero(whole), ready[k[of]], rows


def candidates(block: Bucket, least: np.ndarray, bucket: Bucket, focus: int = FOCUS) -> list[np.ndarray | None]:
    """For each anchor the rows of the bucket that may score ``least`` or more; None stands for all of them."""
    whole, of, rows = candidate_pairs(block, least, bucket, focus)
    out: list[np.ndarray | None] = [rows[of == i] for i in range(len(least))]
    for i in whole:
        out[i] = None
    return out


def _long(x) -> int:
    return max(_LOWEST, min(_HIGHEST, int(x)))


def _longs(x: np.ndarray) -> np.ndarray:
    return np.array([_long(y) for y in x], np.int64) if x.dtype == object else x.astype(np.int64)


class Best:
    """The first ``k`` rows of each of many lists: higher scores first, ties by id and key. ``least`` of a list only rises."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.astype(np.int64), k
        self.last = np.full(len(least), _HIGHEST)  # the greatest id that a row of that score may have
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(4))
        self.waiting: list[tuple] = []
        self.n = 0

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        ok = (score > self.least[lists]) | ((score == self.least[lists]) & (ids <= self.last[lists]))
        if ok.any():
            self.waiting.append((lists[ok], score[ok], ids[ok], keys[ok]))
            self.n += len(self.waiting[-1][0])
            if self.n >= WAITING:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id, key) of the first rows of all lists, in order."""
        if self.waiting:
            lists, score, ids, keys = (np.concatenate(c) for c in zip(self.kept, *self.waiting, strict=True))
            by = np.lexsort((keys, ids, ~score, lists))  # ~ turns the order round and has no overflow
            lists = lists[by]
            place = np.arange(len(by)) - np.searchsorted(lists, lists, "left")
            by, lists, place = (x[place < self.k] for x in (by, lists, place))
            self.kept = lists, score[by], ids[by], keys[by]
            full = place == self.k - 1
            self.least[lists[full]], self.last[lists[full]] = self.kept[1][full], self.kept[2][full]
            self.waiting, self.n = [], 0
        return self.kept


def _bounds(score: int, rules: Rules) -> tuple[int, int]:
    """Least and greatest score of a negative of a positive with this score; the least is greater where there is none."""
    return -((-rules.low * score) // 100), rules.high * score // 100


class Positives:
    """The search of a block for rows of the same label: one list for each anchor."""

    def __init__(self, items: pa.StructArray, rules: Rules):
        self.block, self.k = Bucket(items), rules.positives
        self.begin(np.full(len(items), _LOWEST))

    def begin(self, least: np.ndarray) -> None:
        self.best = Best(least, self.k)

    def least(self) -> np.ndarray:
        """Of each anchor the least score that a row needs, as doubles; bounds near the ends of a double are no bounds."""
        return np.where(np.abs(self.best.least.astype(np.float64)) < _EXACT, self.best.least, -np.inf)

    def most(self) -> np.ndarray | None:
        return None

    def take(self, of: np.ndarray, rows: np.ndarray, scores: np.ndarray, bucket: Bucket) -> None:
        ok = (bucket.label[rows] == self.block.label[of]) & ~(
            (bucket.id[rows] == self.block.id[of]) & (bucket.key[rows] == self.block.key[of]))
        of, rows = of[ok], rows[ok]
        self.best.add(of, _longs(scores[ok]), bucket.id[rows], bucket.key[rows])

    def found(self) -> list[np.ndarray]:
        of, score, ids, keys = self.best.settle()
        return [self.block.id[of], self.block.key[of], ids, keys, score]


class Negatives(Positives):
    """The search of a block for rows of other labels: one list for each positive of an anchor, in its range of scores."""

    def __init__(self, items: pa.StructArray, rules: Rules):
        wanted = items.field("wanted").to_pylist()
        self.block, self.k, self.width = Bucket(items), rules.negatives, max(map(len, wanted), default=0)
        self.low, self.high = np.full((len(items), self.width), _HIGHEST), np.full((len(items), self.width), _LOWEST)
        self.other, self.score = (np.zeros((len(items), self.width), np.int64) for _ in range(2))
        for i, one in enumerate(wanted):
            for j, w in enumerate(one):
                lo, hi = _bounds(w["score"], rules)
                if lo <= hi:
                    self.low[i, j], self.high[i, j] = _long(lo), _long(hi)
                self.other[i, j], self.score[i, j] = w["other"], w["score"]
        self.asked = self.low <= self.high
        self.begin(self.low.ravel())

    def least(self) -> np.ndarray:
        now = self.best.least.reshape(self.low.shape).astype(np.float64)
        now = np.where(self.asked, np.where(np.abs(now) < _EXACT, now, np.where(now > 0, now * (1 - _EPS), -np.inf)), np.inf)
        return now.min(axis=1, initial=np.inf)

    def most(self) -> np.ndarray | None:
        high = np.where(self.asked, self.high.astype(np.float64), -np.inf).max(axis=1, initial=-np.inf)
        return np.where(np.abs(high) < _EXACT, high, np.inf)

    def take(self, of: np.ndarray, rows: np.ndarray, scores: np.ndarray, bucket: Bucket) -> None:
        ok = bucket.label[rows] != self.block.label[of]
        of, rows, score = of[ok], rows[ok], _longs(scores[ok])
        for j in range(self.width):
            at = np.flatnonzero(self.asked[of, j] & (score <= self.high[of, j]))
            self.best.add(of[at] * self.width + j, score[at], bucket.id[rows[at]], bucket.key[rows[at]])

    def found(self) -> list[np.ndarray]:
        at, score, ids, keys = self.best.settle()
        of, j = at // max(self.width, 1), at % max(self.width, 1)
        return [self.block.id[of], self.block.key[of], j, self.other[of, j], self.score[of, j], ids, keys, score]


def meet(search: Positives, bucket: Bucket) -> None:
    """All rows of the bucket that may belong to a list of the block's anchors are taken, each anchor and row once."""
    least, most = search.least(), search.most()
    whole, of, rows = candidate_pairs(search.block, least, bucket, few=FEW)
    step = max(1, STRIP // max(1, bucket.v.shape[1]))
    for i in range(0, len(of), step):
        a, r = of[i:i + step], rows[i:i + step]
        s = search.block.pair_scores(bucket, a, r)
        near = np.flatnonzero((s >= least[a]).astype(bool))
        search.take(a[near], r[near], s[near], bucket)
    step = max(1, STRIP // max(1, len(bucket.id)))
    for i in range(0, len(whole), step):
        used = whole[i:i + step]
        s = search.block.scores(bucket, used)
        bound = least[used][:, None]
        # Scores and bounds are integers where they are compared, and what float32 can't hold it has rounded beyond all scores.
        near = s >= (bound.astype(np.float32) if s.dtype == np.float32 else bound)
        if most is not None and np.count_nonzero(near) > near.size // 64:
            top = most[used][:, None]
            near &= s <= (top.astype(np.float32) if s.dtype == np.float32 else top)
        a, r = np.divmod(np.flatnonzero(near), near.shape[1])
        search.take(used[a], r, s[a, r], bucket)


def _store_rows(rows: DataFrame, classes: list) -> tuple[str, int]:
    """Folder and number of files with the rows of each bucket one after the other, the longest classes first."""
    files = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), _number(classes)))
    dealt = _dealt(rows, classes, "bucket").select("bucket", "vec_id", "key", "label", "v")
    return materialise(dealt.repartition(files, "bucket").sortWithinPartitions("bucket"), "negatives-buckets").stored_at, files


def _store_blocks(anchors: DataFrame, *more: str) -> str:
    """Folder with a folder for each block of anchors."""
    path = shared_dir(anchors.sparkSession, "negatives-blocks")
    anchors.select("block", "vec_id", "key", "label", "v", *more).repartition("block").write.partitionBy("block").parquet(path)
    return path


def _files(store: fs.FileSystem, path: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("part-"))


def _buckets_of(store: fs.FileSystem, path: str) -> Iterator[tuple[int, pa.StructArray]]:
    """(bucket, items) of a file, with a few buckets in memory."""
    rest = None
    with store.open_input_file(path) as f:
        stored = pq.ParquetFile(f)
        cells = sum(c.num_values for g in range(stored.num_row_groups) for c in [stored.metadata.row_group(g).column(4)])
        some = max(1, min(4096, STRIP * stored.metadata.num_rows // max(1, cells)))  # rows read at once
        for batch in stored.iter_batches(batch_size=some, use_threads=False):
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            whole = whole.combine_chunks()
            number = whole["bucket"].to_numpy()
            starts = np.flatnonzero(np.diff(number, prepend=number[0] - 1))
            for a, b in zip(starts, starts[1:], strict=False):
                yield int(number[a]), whole.slice(a, b - a).combine_chunks().to_batches()[0].to_struct_array()
            rest = whole.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield int(rest["bucket"][0].as_py()), rest.combine_chunks().to_batches()[0].to_struct_array()


def _need(search: Positives) -> float:
    """Least length of a row that reaches a threshold of the block; 0 where shorter ones score more, or any do."""
    least, length = search.least(), search.block.length
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(least > 0, np.where(length > 0, least / length * (1 - _EPS), np.inf), 0.0)
    return float(need.min(initial=np.inf))


def _search(spark: SparkSession, blocks: str, n_blocks: int, turns: int, rows: str, files: int, classes: list,
            kind: Callable[[pa.StructArray, Rules], Positives], rules: Rules, names: list[str], schema: str) -> DataFrame:
    """What ``kind`` finds for all blocks, some blocks and a slice of the files in each task."""
    per = max(1, n_blocks // turns)
    turns = -(-n_blocks // per)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, min(files, -(-most // max(1, turns)), -(-_number(classes) // SLICE_BUCKETS)))
    firsts, tops = np.array([c[2] for c in classes], np.int64), [c[1] for c in classes]
    kinds = [pa.int32() if n == "at" else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (x for batch in batches for x in batch.column(0).to_pylist()):
            turn, part = divmod(number, slices)
            store, at = open_store(blocks)
            searches = []
            for b in range(turn * per, min(n_blocks, turn * per + per)):
                for path in _files(store, f"{at}/block={b}"):
                    with store.open_input_file(path) as f:
                        items = pq.ParquetFile(f).read(use_threads=False).combine_chunks()
                    if items.num_rows:
                        searches.append(one := kind(items.to_batches()[0].to_struct_array(), rules))
                        meet(one, one.block)  # only for the thresholds: the block's own rows are read again
                        one.best.settle()
                        one.begin(one.best.least)
            store, at = open_store(rows)
            for path in _files(store, at)[part::slices] if searches else []:
                for bucket_number, items in _buckets_of(store, path):
                    top = tops[int(np.searchsorted(firsts, bucket_number, "right")) - 1]
                    needs = [_need(one) for one in searches]
                    if top < min(needs):
                        break
                    bucket = Bucket(items)
                    for one, need in zip(searches, needs, strict=True):
                        if top >= need:
                            meet(one, bucket)
            for one in searches:
                found = one.found()
                for i in range(0, len(found[0]), 10_000):
                    yield pa.record_batch([pa.array(c[i:i + 10_000]).cast(k) for c, k in zip(found, kinds, strict=True)], names)

    tasks = turns * slices
    return map_arrow(spark.range(0, tasks, 1, max(1, tasks)).select("id"), run, schema)


def mine_hard_negatives(rows: DataFrame, anchor: Column, relabel: Column | None = None, rules: Rules = Rules()) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, label and embedding; other columns are not read. ``anchor`` says
    which rows are anchors and ``relabel`` gives the label used, both as expressions over
    vec_id and label. Rows with a null id, label or vector, or with a component that is
    null or not finite (also after the scaling), take no part. A row listed several times counts
    once; rows of one id that differ count each, also as anchors. A shorter vector counts as if it
    ended in zeros. Components and scores beyond a long are held at its ends. Anchors
    without a positive, and positives without a negative, give no row; an empty table none.
    """
    used = usable_rows(rows)
    if relabel is not None:
        used = used.withColumn("label", relabel.cast("long")).where("label is not null")
    used = materialise(_with_class(used), "negatives-rows")
    spark, classes = used.sparkSession, _class_list(used, BUCKET_CELLS)
    kept = materialise(used.where(anchor), "negatives-anchors")
    anchor_classes = _class_list(kept, BLOCK_CELLS)
    anchors, n_blocks = _dealt(kept, anchor_classes, "block"), _number(anchor_classes)
    stored, files = _store_rows(used, classes)
    discard(used)
    # Blocks of classes with few anchors share a task.
    turns = max(1, n_blocks - len(anchor_classes) + 1)

    def searched(blocks: str, kind: type[Positives], names: list[str]) -> DataFrame:
        return _search(spark, blocks, n_blocks, turns, stored, files, classes, kind, rules, names, ", ".join(
            f"{n} {'int' if n == 'at' else 'long'}" for n in names))

    blocks = _store_blocks(anchors)
    found = searched(blocks, Positives, ["vec_id", "key", "other", "other_key", "score"])
    order = Window.partitionBy("vec_id", "key").orderBy(F.desc("score"), "other", "other_key")
    positives = materialise(found.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= rules.positives), "negatives-positives")
    wanted = positives.groupBy("vec_id", "key").agg(F.sort_array(F.collect_list(F.struct(
        "place", "other", "score"))).alias("wanted"))
    asking = _store_blocks(anchors.join(wanted, ["vec_id", "key"]), "wanted")
    discard(kept, positives)
    remove(spark, [blocks])
    names = ["anchor_id", "key", "at", "positive_id", "positive_score", "negative_id", "negative_key", "negative_score"]
    found = searched(asking, Negatives, names)
    order = Window.partitionBy("anchor_id", "key", "at").orderBy(F.desc("negative_score"), "negative_id", "negative_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rules.negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
