"""Jaccard self-join of documents on word n-grams, with adaptive multi-match prefixes.

1. Documents with the same set of n-grams form one class; only classes are joined.
2. N-grams are ordered by how often they occur, rare ones first. The l-prefix of a set of
   n n-grams is its first n - ceil(t n) + l; two sets of similarity t or more share at
   least l n-grams of their l-prefixes. Each class takes the l of least estimated cost:
   a longer prefix means more postings to read, but l common ones are then required.
3. Candidates come in two rounds. The first links every class to one hub per n-gram, the
   class with the largest share of common n-grams in its prefix, which joins large groups of near copies
   by as many pairs as they have members. The second pairs all classes of an n-gram that
   the first has not put into one component: members outside the n-gram's largest
   component against all. So no link between different components is lost; pairs
   inside a component cannot change it.
4. Candidates are verified on the whole sets.
5. Links are counted over all pairs of classes of a component whose sizes allow the
   similarity. A large component is dealt into blocks, and a row holds a block or a pair
   of blocks: rows grow with the pairs of blocks, the work with the pairs of classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import discard, map_arrow, materialise
from opslens.llm.components import connected_components

#: Lower case of A-Z, on UTF-8 bytes.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: An n-gram in at least this share of the documents of some chunk is counted as frequent.
FREQUENT_SHARE, CHUNK = 0.0005, 2_000_000
#: Frequent n-grams kept for the order, the most frequent; others count as rare. It changes the order, not the result.
MOST_FREQUENT = 500_000
MAX_LEVEL = 4
#: N-grams and classes in a block of a component, about, when links are counted.
BLOCK_NGRAMS, BLOCK_CLASSES = 1 << 19, 1024
#: Cost of reading a posting, and of verifying a candidate, for the choice of a prefix.
READ_COST, VERIFY_COST = 1.0, 30.0


class _Hashes(dict):
    """64-bit hash of each word, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


class Shingles:
    """Sets of hashed word n-grams; words' hashes are kept from text to text while there are few enough."""

    def __init__(self, size: int):
        self.size = size
        self.known = _Hashes()

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes: n-grams, or the whole sequence of a shorter text; empty without words."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > 500_000:
            self.known.clear()
        ids = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(words))
        h = np.full(len(ids) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ ids[k:len(ids) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h.sort()
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _per_text(docs: DataFrame, size: int, function, schema: str) -> DataFrame:
    """Rows of ``function(doc_id, set)`` for each document, and of ``function(None, None)`` at the end of a task."""
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    kinds = [arrow[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, call = Shingles(size), function()
        pack = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(
            list(zip(*rows, strict=True)) or [[]] * len(names), kinds, strict=True)], names)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pack([r for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                            for r in call(d, shingles.of(t))])
        yield pack(call(None, None))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, n, sig) of each document, and rows (token, n) of the n-grams frequent in a chunk of a task.

    Every n-gram that FREQUENT_SHARE of all documents have is frequent in some chunk.
    """

    def start():
        held, total, members, seen = [], 0, 0, set()

        def flush():
            nonlocal held, total, members
            rows = []
            if held:
                token, n = np.unique(np.concatenate(held), return_counts=True)
                often = n >= max(2, FREQUENT_SHARE * members)
                rows = [(None, int(c), None, t) for t, c in zip(token[often].astype(np.int64).tolist(), n[often], strict=True)]
            held, total, members = [], 0, 0
            seen.clear()
            return rows

        def call(doc, s):
            nonlocal total, members
            if s is None:
                return flush()
            sig = blake2b(s.tobytes(), digest_size=16).digest()
            rows = [(doc, len(s), sig, None)]
            if sig not in seen and len(s):  # a copy adds nothing to the order
                seen.add(sig)
                held.append(s)
                total, members = total + len(s), members + 1
            if total >= CHUNK:
                rows += flush()
            return rows

        return call

    return _per_text(docs, size, start, "doc_id long, n int, sig binary, token long")


def most_frequent(made: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and counts of the ``most`` most frequent n-grams, of equally frequent ones those with the smallest tokens.

    How many n-grams have each count, and how many of the count that only some are kept of have
    each leading 12 bits, tells which rows to fetch: nothing is sorted, and no more than wanted but
    for one such group reaches the driver, as columns.
    """
    counts = materialise(made.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")), "join-counts")
    keep, room = F.lit(True), most
    for n, rows in sorted(((r.n, r.rows) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True):
        if rows > room:
            lead, keep = F.shiftright("token", 52), F.col("n") > n
            for r in counts.where(F.col("n") == n).groupBy(lead.alias("lead")).agg(
                    F.count(F.lit(1)).alias("rows")).orderBy("lead").collect():
                if room <= 0:
                    break
                last, room = r.lead, room - r.rows
                keep = (F.col("n") > n) | ((F.col("n") == n) & (lead <= last))
            break
        room -= rows
    found = counts.where(keep).toArrow()
    discard(counts)
    tokens, n = (found.column(c).to_numpy() for c in ("token", "n"))
    order = np.lexsort((tokens, -n))[:most]
    return tokens[order].astype(np.uint64), n[order]


def prefixes(docs: DataFrame, size: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, n, tokens): the longest prefix of each non-empty set, in the order of the n-grams."""
    table = docs.sparkSession.sparkContext.broadcast(frequent)

    def start():
        tokens, counts = table.value
        order = np.argsort(tokens)
        tokens, counts = tokens[order], counts[order]

        def call(doc, s):
            if s is None or not len(s) or doc is None:
                return []
            n = len(s)
            count = np.zeros(n, np.int64)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                count = np.where(tokens[at] == s, counts[at], 0)
            need = -(-percent * n // 100)
            keep = n - need + min(MAX_LEVEL, need)
            # s is sorted, so a stable order by count breaks ties by n-gram
            return [(doc, n, s[np.argsort(count, kind="stable")[:keep]].astype(np.int64).tolist())]

        return call

    return _per_text(docs, size, start, "doc_id long, n int, tokens array<long>")


def _overlap(percent: int, n1: Column, n2: Column) -> Column:
    """Least number of common n-grams of two sets of the given sizes."""
    return F.ceil((n1 + n2) * F.lit(percent) / F.lit(100.0 + percent) - 1e-9)


def _may_link(percent: int) -> Column:
    """Whether two classes with an n-gram in common at these places can reach the similarity.

    Of the n-grams before it, those that no other prefix has are not common; of those after
    it, no more than the shorter rest.
    """
    common = 1 + F.least(F.col("pos") - F.col("alone"), F.col("pos2") - F.col("alone2")) + F.least(
        F.col("n") - F.col("pos") - 1, F.col("n2") - F.col("pos2") - 1)
    return (F.col("n") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n") * percent) & (
        common >= _overlap(percent, F.col("n"), F.col("n2")))


def postings(pre: DataFrame, percent: int) -> DataFrame:
    """(token, doc_id, n, pos, alone, level, lone) of n-grams that several classes have in their prefixes, cut to each class's level.

    alone is the number of earlier n-grams of the class that no other prefix has; lone is
    the share of such n-grams in its longest prefix. A class's n-grams meet in one row
    again, no larger than its text.

    The estimate of the candidates with l matches is the number of postings met over l.
    """
    need = F.ceil(F.col("n") * F.lit(percent) / 100.0 - 1e-9).cast("int")
    rows = pre.select("doc_id", "n", F.posexplode("tokens").alias("pos", "token"))
    shared = materialise(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "join-tokens")
    each = rows.join(shared, "token").groupBy("doc_id", "n").agg(
        F.sort_array(F.collect_list(F.struct("pos", "token", "df"))).alias("met"))

    def cost(level: int) -> Column:
        # postings met with prefix l: those of the first n - need + l places
        met = F.aggregate("met", F.lit(0).cast("long"), lambda s, x: s + F.when(x["pos"] < F.col("n") - need + level, x["df"] - 1).otherwise(0))
        return F.struct((met * (READ_COST + VERIFY_COST / level)).alias("cost"), F.lit(level).alias("level"))

    each = each.select(
        "doc_id", "n", "met", (1 - F.size("met") / (F.col("n") - need + F.least(need, F.lit(MAX_LEVEL)))).alias("lone"),
        F.least(F.array_min(F.array(*[cost(k) for k in range(1, MAX_LEVEL + 1)]))["level"], F.greatest(need, F.lit(1))).alias("level"))
    used = materialise(each.select("doc_id", "n", "level", "lone", F.posexplode("met").alias("rank", "x")).where(
        F.col("x.pos") < F.col("n") - need + F.col("level")).select(
        "x.token", "doc_id", "n", "x.pos", (F.col("x.pos") - F.col("rank")).alias("alone"), "level", "lone"), "join-used")
    discard(shared)
    return used


def _pair(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("doc_id", "doc2").alias("a"), F.greatest("doc_id", "doc2").alias("b"))


def hub_pairs(used: DataFrame, percent: int) -> DataFrame:
    """Each class with the hub of each of its n-grams, where sizes and places allow the similarity."""
    rank = F.struct("lone", "doc_id")
    hubs = materialise(used.groupBy("token").agg(F.min(F.struct(rank.alias("k"), "doc_id", "n", "pos", "alone")).alias("h")).select(
        "token", *[F.col(f"h.{c}").alias(f"{c.removesuffix('_id')}2") for c in ("doc_id", "n", "pos", "alone")]), "join-hubs")
    o = _overlap(percent, F.col("n"), F.col("n2"))
    rows = used.join(hubs, "token").where((F.col("doc_id") != F.col("doc2")) & _may_link(percent) & (
        F.col("pos") <= F.col("n") - o) & (F.col("pos2") <= F.col("n2") - o))
    return _pair(rows).distinct()


def remaining_pairs(used: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """All candidates whose classes lie in different components, with the required number of matches."""
    rows = used.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))
    rows = materialise(rows, "join-labelled")
    parts = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("members"))
    main = materialise(parts.groupBy("token").agg(F.max(F.struct("members", "component"))["component"].alias("main"),
                                                  F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts"), "join-main")
    mixed = materialise(rows.join(main, "token"), "join-mixed")
    discard(rows, main)
    other = mixed.select("token", *[F.col(c).alias(f"{c.removesuffix('_id')}2") for c in (
        "doc_id", "n", "pos", "alone", "level", "component")])
    few = mixed.where(F.col("component") != F.col("main"))
    o, least = _overlap(percent, F.col("n"), F.col("n2")), F.least("level", "level2")
    pairs = few.join(other, "token").where(
        (F.col("component") != F.col("component2")) & _may_link(percent)
        # two classes off the main component meet once
        & ((F.col("component2") == F.col("main")) | (F.col("doc_id") < F.col("doc2")))
        & (F.col("pos") <= F.col("n") - o + least - 1) & (F.col("pos2") <= F.col("n2") - o + least - 1))
    pairs = pairs.select(F.least("doc_id", "doc2").alias("a"), F.greatest("doc_id", "doc2").alias("b"), least.alias("least"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("matches"), F.max("least").alias("least")).where(
        "matches >= least").select("a", "b")


def verify(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity, written."""
    pairs = materialise(pairs, "join-pairs")
    if not pairs.limit(1).count():
        return pairs
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        wanted.hint("merge"), "doc_id", "left_semi")
    sets = materialise(_per_text(texts, size, lambda: lambda d, s: [] if s is None else [(d, s.tobytes())],
                                 "doc_id long, tokens binary"), "join-sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = materialise(map_arrow(both, run, "a long, b long").distinct(), "join-links")
    discard(pairs, sets)
    return found


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of x shares with each set of y."""
    out = np.zeros((len(x), len(y)), np.float32)
    flat_x, flat_y = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(flat_x, flat_y)
    if not len(shared):
        return out

    def places(sets, flat):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        hit = shared[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], row[hit][order]

    at_x, row_x = places(x, flat_x)
    at_y, row_y = places(y, flat_y)
    step = 4096
    for first in range(0, len(shared), step):
        width = min(step, len(shared) - first)
        dense = []
        for at, row, n in ((at_x, row_x, len(x)), (at_y, row_y, len(y))):
            lo, hi = np.searchsorted(at, [first, first + width])
            d = np.zeros((n, width), np.float32)
            d[row[lo:hi], at[lo:hi] - first] = 1
            dense.append(d)
        out += dense[0] @ dense[1].T  # whole numbers below 2^24: exact
    return out


def _linked(x: list[np.ndarray], y: list[np.ndarray], wx: np.ndarray, wy: np.ndarray, same: bool,
            percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set of x and of y, the documents of the sets on the other side that it links to."""
    nx, ny = (np.array([len(s) for s in sets], np.int64) for sets in (x, y))
    to_x, to_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    step = 256
    order_x, order_y = np.argsort(nx, kind="stable"), np.argsort(ny, kind="stable")
    for i in range(0, len(x), step):
        p = order_x[i:i + step]
        for j in range(0, len(y), step):
            q = order_y[j:j + step]
            if nx[p[0]] * percent > 100 * ny[q[-1]] or ny[q[0]] * percent > 100 * nx[p[-1]]:
                continue  # sorted by size: no pair here can reach the similarity
            common = _common([x[k] for k in p], [y[k] for k in q]).astype(np.int64)
            ok = 100 * common >= percent * (nx[p][:, None] + ny[q][None, :] - common)
            if same:
                ok &= p[:, None] != q[None, :]
            to_x[p] += ok @ wy[q]
            if not same:
                to_y[q] += wx[p] @ ok
    return to_x, to_y


def count_links(docs: DataFrame, classes: DataFrame, components: DataFrame, size: int, percent: int) -> DataFrame:
    """(sig, linked): documents of other classes that each class links to, over all pairs of each component.

    A component that fits one block is one. In a larger one sizes fall into bands, so that sets
    of similarity t lie in the same band or in neighbouring ones, and the classes of a band are
    dealt over blocks by their digest.
    """
    # a doc_id with several texts may be the head of several classes, which link without a pair of documents
    several = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select(
        F.col("rep").alias("node"), F.col("rep").alias("component"))
    nodes = components.unionByName(several.join(components, "node", "left_anti"))
    members = classes.join(nodes.withColumnRenamed("node", "rep"), "rep")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100.0 / percent)) * (1 + 1e-9) + 1e-9)).cast("int")
    members = materialise(members.select("sig", "rep", "documents", "component", "n", band.alias("band")), "join-members")
    large = members.groupBy("component").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("members")).where(
        (F.col("total") > BLOCK_NGRAMS) | (F.col("members") > BLOCK_CLASSES)).select("component")
    large = materialise(large, "join-large")
    bands = materialise(members.join(large, "component").groupBy("component", "band").agg(F.greatest(
        F.ceil(F.sum("n") / BLOCK_NGRAMS), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES)).cast("int").alias("blocks")), "join-bands")
    dealt = members.join(bands, ["component", "band"], "left").select(
        "sig", "rep", "documents", "component", F.when(F.col("blocks").isNotNull(), F.col("band")).otherwise(-1).alias("band"),
        F.pmod(F.xxhash64("sig"), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int").alias("block"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        members.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")

    def start():
        seen = set()

        def call(d, s):
            if s is None:
                return []
            sig = blake2b(s.tobytes(), digest_size=16).digest()
            if (d, sig) in seen:
                return []
            seen.add((d, sig))
            return [(d, sig, s.tobytes())]

        return call

    sets = _per_text(texts, size, start, "doc_id long, sig binary, tokens binary").withColumnRenamed("doc_id", "rep")
    blocks = materialise(dealt.join(sets, ["rep", "sig"]).groupBy("component", "band", "block").agg(F.collect_list(
        F.struct("sig", "documents", "tokens")).alias("sets")), "join-blocks")
    other = bands.select("component", F.col("band").alias("band2"), F.col("blocks").alias("blocks2"))
    pairs = bands.join(other, "component").where("band2 = band or band2 = band + 1").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "block2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1))).where("band2 > band or block2 > block")
    cut = blocks.where("band >= 0")
    cross = pairs.select("component", "band", "block", "band2", "block2").join(cut, ["component", "band", "block"]).join(
        cut.select("component", F.col("band").alias("band2"), F.col("block").alias("block2"), F.col("sets").alias("sets2")),
        ["component", "band2", "block2"]).select("sets", "sets2")

    def side(value):
        v = value.values
        found = {}  # a repeated document comes once from each task that read it
        for sig, w, t in zip(v.field("sig").to_pylist(), v.field("documents").to_pylist(), v.field("tokens"), strict=True):
            found[sig] = (w, np.frombuffer(t.as_buffer(), np.uint64))
        return list(found), np.array([w for w, _ in found.values()], np.int64), [t for _, t in found.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, linked = [], []
            for i in range(batch.num_rows):
                sig_x, w_x, x = side(batch.column(0)[i])
                if batch.num_columns == 1:
                    sig += sig_x
                    linked += _linked(x, x, w_x, w_x, True, percent)[0].tolist()
                else:
                    sig_y, w_y, y = side(batch.column(1)[i])
                    to_x, to_y = _linked(x, y, w_x, w_y, False, percent)
                    sig += sig_x + sig_y
                    linked += to_x.tolist() + to_y.tolist()
            yield pa.record_batch([pa.array(sig, pa.binary()), pa.array(linked, pa.int64())], ["sig", "linked"])

    found = map_arrow(blocks.select("sets"), run, "sig binary, linked long").unionByName(
        map_arrow(cross, run, "sig binary, linked long"))
    return found.groupBy("sig").agg(F.sum("linked").alias("linked"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, links: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), n_links and component_id.

    Without ``links`` the column n_links is left out and links are not counted.

    Documents link when 100 x intersection >= ``percent`` x union of their n-gram sets;
    component_id is the smallest doc_id reachable by links. n_links is the number of other
    documents that the text links to, exact copies among them. Null and empty texts have no
    n-gram and no link. Repeated rows share their component and count once as a link; where a doc_id
    repeats with another text, its rows count as one document in components, and as one
    for each of their sets in n_links. A null doc_id links with nothing. Empty tables give no row.
    """
    spark = docs.sparkSession
    made = materialise(document_sets(docs, size), "join-documents")
    rows = made.where("sig is not null").select("doc_id", "n", "sig")
    frequent = most_frequent(made, MOST_FREQUENT)
    classes = materialise(rows.where("n > 0 and doc_id is not null").groupBy("sig").agg(
        F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("documents"), F.any_value("n").alias("n")), "join-classes")
    heads = classes.select(F.col("rep").alias("doc_id")).distinct()
    pre = materialise(prefixes(docs, size, percent, frequent).join(heads, "doc_id", "left_semi"), "join-prefixes")
    used = postings(pre, percent)
    discard(pre)
    found = verify(docs, hub_pairs(used, percent), size, percent)
    components = connected_components(found)
    rest = verify(docs, remaining_pairs(used, components, percent), size, percent)
    discard(used)
    if rest.limit(1).count():
        components = connected_components(found.unionByName(rest))
    known = F.col("doc_id").isNotNull()
    component = F.when(known, F.coalesce("component", "doc_id")).alias("component_id")
    if not links:
        labels = classes.join(components.withColumnRenamed("node", "rep"), "rep", "left")
        labels = materialise(labels.select("sig", F.coalesce("component", "rep").alias("component")), "join-labels")
        return rows.join(labels, "sig", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component)
    linked = count_links(docs, classes, components, size, percent)
    labels = classes.join(components.withColumnRenamed("node", "rep"), "rep", "left").join(linked, "sig", "left")
    labels = materialise(labels.select("sig", F.coalesce("component", "rep").alias("component"), (F.coalesce(
        "linked", F.lit(0)) + F.col("documents") - 1).alias("n_links")), "join-labels")
    return rows.join(labels, "sig", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(
            F.lit(0)).alias("n_links"), component)
