"""Merkle manifest of a table: subtree per group, proofs for every row, by a butterfly exchange.

1. Each row is hashed to a leaf. Leaves are numbered within their group by a range sort and
   a prefix sum of the rows of each partition.
2. An aligned chunk of FANOUT ** LEVELS leaves builds its levels by itself.
3. Chunks then swap the roots they know, round by round. In round r those chunks form one
   swap group whose numbers differ only in their r-th digit (base FANOUT); each member gets
   the roots of all subtrees below their common ancestor and hashes that ancestor by
   itself. So every chunk holds the whole upper proof after the last round: nothing comes
   down from the root. Where the last subtree has fewer chunks than the others, its chunks
   serve several swap groups.
4. The subroots of the groups are numbered and form the upper tree in the same way.

Everything is DataFrame functions; a row of a chunk holds FANOUT ** LEVELS leaves at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import materialise

FANOUT, LEVELS = 8, 3
CHUNK = FANOUT ** LEVELS

#: One level of a proof: the place in its run, and all nodes of the run.
_PATH = "array<struct<at:int,run:array<string>>>"


def digest(parts: Column) -> Column:
    """Digest of the concatenated texts of an array."""
    return F.sha2(F.array_join(parts, ""), 256)


def encoded(*values: Column) -> Column:
    """Digest of values of any number: '-' for null, otherwise the bytes of its text, ':' and the text."""
    texts = [v.cast("string") for v in values]
    return digest(F.array(*[F.when(t.isNull(), "-").otherwise(F.concat(
        F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def _depth(n: Column) -> Column:
    """Rounds until n nodes are one."""
    at = F.lit(0)
    for k in range(1, 22):
        at = F.when(n > F.lit(FANOUT ** (k - 1)), F.lit(k)).otherwise(at)
    return at


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with ``rank`` (from 0, by ``order`` within the group) and ``n`` (rows of the group).

    Rows are range-sorted over the partitions and written with their place; equal rows are
    spread too. What is summed over has a row for each partition and group in it.
    """
    spread = F.xxhash64(F.monotonically_increasing_id())
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_spread").asc()]
    placed = rows.withColumn("_spread", spread).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "_at", F.monotonically_increasing_id()).drop("_spread")
    placed = materialise(placed, name).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.sum("_rows").over(whole).alias("n"), (
        F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(parts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).withColumn(
        "rank", F.col("_at") + F.col("_shift")).drop("_g", "_p", "_at", "_part", "_shift")


def _above(nodes: Column) -> Column:
    """The next level of a chunk: the digest of every run."""
    runs = F.greatest(F.ceil(F.size(nodes) / FANOUT).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), runs - 1), lambda i: digest(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT))))


def chunked(leaves: DataFrame, group: str, carry: list[str]) -> DataFrame:
    """(group, chunk, n, depth, items, level0.. , node): aligned chunks of numbered leaves with their own levels.

    ``items`` holds ``carry`` of each leaf in order. ``depth`` is how many of the levels the
    group needs, and ``node`` the chunk's root at that depth.
    """
    rows = leaves.groupBy(group, F.floor(F.col("rank") / CHUNK).alias("chunk")).agg(
        F.any_value("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "leaf", *carry))).alias("items"))
    rows = rows.withColumn("level0", F.col("items.leaf"))
    for k in range(1, LEVELS + 1):
        rows = rows.withColumn(f"level{k}", _above(F.col(f"level{k - 1}")))
    rows = rows.withColumn("depth", F.least(_depth(F.col("n")), F.lit(LEVELS)))
    node = F.array(*[F.col(f"level{k}")[0] for k in range(LEVELS + 1)])
    return rows.withColumn("node", F.get(node, F.col("depth")))


def butterfly(chunks: DataFrame, group: str, name: str) -> DataFrame:
    """(group, chunk, node, path): for each chunk the root of its group and the levels of the proof above the chunk.

    A round has a message for each chunk, and for the swap groups that the last subtree has
    no chunk for; a swap group has FANOUT messages at most.
    """
    state = materialise(chunks.select(group, "chunk", F.ceil(F.col("n") / CHUNK).cast("long").alias("chunks"), "node", F.array().cast(
        _PATH).alias("path")), f"{name}-chunks")
    most = state.agg(F.max("chunks")).first()[0] or 0
    width = 1
    while width < most:
        base = F.col("chunk") - F.col("chunk") % width
        own = F.least(F.lit(width), F.col("chunks") - base)  # chunks of this subtree
        high = F.floor(F.col("chunk") / (width * FANOUT)).cast("long")
        first = F.least(F.lit(width), F.col("chunks") - high * (width * FANOUT))  # of the first subtree here
        low = F.col("chunk") % width
        sent = state.select(
            group, high.alias("high"), (F.floor(F.col("chunk") / width) % FANOUT).cast("int").alias("digit"), "node", low.alias("low"),
            F.struct("chunk", "chunks", "path").alias("member"), F.explode(F.sequence(low, first - 1, own)).alias("to"))
        met = sent.groupBy(group, "high", "to").agg(
            F.sort_array(F.collect_list(F.struct("digit", "node"))).alias("runs"),
            F.collect_list(F.when(F.col("to") == F.col("low"), F.struct("digit", "member"))).alias("members"))
        met = met.select(group, F.col("runs.node").alias("run"), F.explode("members").alias("m"))
        active = F.col("m.member.chunks") > width
        state = met.select(
            group, F.col("m.member.chunk").alias("chunk"), F.col("m.member.chunks").alias("chunks"),
            F.when(active, digest(F.col("run"))).otherwise(F.col("run")[0]).alias("node"),
            F.when(active, F.concat("m.member.path", F.array(F.struct(F.col("m.digit").alias("at"), "run")).cast(_PATH))).otherwise(
                F.col("m.member.path")).alias("path"))
        width *= FANOUT
    return materialise(state.select(group, "chunk", "node", "path"), f"{name}-swapped")


def _own_path(place: Column) -> Column:
    """The levels of a leaf's proof inside its chunk, from the columns level0.. and depth."""
    parts = []
    for k in range(LEVELS):
        at = F.floor(place / FANOUT ** k).cast("int")
        parts.append(F.struct((at % FANOUT).alias("at"), F.slice(f"level{k}", at - at % FANOUT + 1, FANOUT).alias("run")))
    return F.slice(F.array(*parts).cast(_PATH), F.lit(1), F.col("depth"))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one text."""
    return F.array_join(F.flatten(F.transform(path, lambda p: F.filter(p["run"], lambda _, i: i != p["at"]))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings of its path."""
    return F.aggregate(path, leaf, lambda node, p: digest(F.transform(p["run"], lambda x, i: F.when(i == p["at"], node).otherwise(x))))


def manifest(rows: DataFrame, columns: list[str], key: str, group: str, changed: dict[str, Column] | None = None,
             tampered: Column | None = None) -> DataFrame:
    """One row per row of ``rows``: key, group, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes ``columns`` in order. Within a group (null is one) leaves ascend by the key,
    null first, and by their digest where keys repeat; groups ascend by their text's bytes,
    null first. ``changed`` replaces columns in the rows that ``tampered`` names, for
    folded_root only: it is what such a leaf, or the original one, leads to with the original siblings.
    Repeated rows are leaves of their own, side by side. Empty texts are texts; an empty table gives no row.
    """
    changed, tampered = changed or {}, F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaf = encoded(*[F.col(c) for c in columns])
    other = encoded(*[changed.get(c, F.col(c)) for c in columns])
    leaves = rows.select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), leaf.alias("leaf"),
                         F.when(tampered, other).alias("other"))
    leaves = numbered(materialise(leaves, "merkle-leaves"), "grp", ["key", "leaf"], "merkle-placed")
    chunks = materialise(chunked(leaves, "grp", ["key", "other"]), "merkle-chunks")
    upper = butterfly(chunks, "grp", "merkle")

    roots = upper.where("chunk = 0").select("grp", F.col("node").alias("leaf"), F.lit(0).alias("all"))
    tops = materialise(chunked(numbered(roots, "all", ["grp"], "merkle-roots"), "all", ["grp"]), "merkle-tops")
    above = butterfly(tops, "all", "merkle-top")
    tops = tops.join(above.select("chunk", F.col("node").alias("root"), F.col("path").alias("more")), "chunk")
    tops = tops.select("root", F.explode(F.transform("items", lambda x, i: F.struct(
        x["grp"].alias("g"), x["leaf"].alias("subroot"), F.concat(_own_path(i), F.col("more")).alias("last")))).alias("x"))
    lang = tops.select("x.*", "root")
    paths = upper.join(lang, F.col("grp").eqNullSafe(F.col("g"))).select(
        F.col("grp").alias("g"), F.col("chunk").alias("c"), "subroot", "root", F.concat("path", "last").alias("path"))
    met = chunks.join(paths, F.col("grp").eqNullSafe(F.col("g")) & (F.col("chunk") == F.col("c")))

    def item(x: Column, i: Column) -> Column:
        path = F.concat(_own_path(i), F.col("path"))
        return F.struct(x["key"].alias(key), x["leaf"].alias("leaf"), F.sha2(siblings(path), 256).alias("proof_sha256"), folded(
            F.coalesce(x["other"], x["leaf"]), path).alias("folded_root"))

    out = met.select(F.col("grp").alias(group), "subroot", "root", F.explode(F.transform("items", item)).alias("x"))
    return out.select(f"x.{key}", group, "x.leaf", "subroot", "root", "x.proof_sha256", "x.folded_root", (
        F.col("x.folded_root") == F.col("root")).alias("verified"))
