"""A Merkle manifest: a digest for each row, a tree of them for each source, one over all sources, and each row's way to the root.

Nodes are digests in hex, lower case; a node is the SHA-256 of the texts of its children, one after the other, up to three of them. Nodes of a
source are taken three by three in order, a rest too and even a single node, until one is left: its root. Roots of sources, in
order of the source (null first), are leaves of the last tree.

A source may be any share of the table. Its leaves are numbered across tasks and cut into aligned blocks of 3**7. One pass
gives each block's root by a treehash stack; these are the leaves of the next round, until each source has one node. On the way
down each block gets the path of its root, and a second pass goes through its leaves by the scheduling of Merkle's traversal: at each height
the siblings on the right of the next leaves are worked out ahead, a leaf at a time, while earlier ones are in use, so that beside the
block's leaves only a few nodes for each height are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ranked, ship, stored

ARITY = 3
#: The height of a block: 2187 leaves.
HEIGHT = 7

STEP = T.StructType([T.StructField("left", T.StringType(), False), T.StructField("right", T.StringType(), False)])
PATH = T.ArrayType(STEP, False)


def leaf(*fields: Column) -> Column:
    """The digest of a row: of each field `-` if it is null, else its UTF-8 bytes' number, a colon and the value; integers are decimal."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(own: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, own, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def height(n: int) -> int:
    """How often n nodes are taken three by three until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Treehash:
    """The node number `at` of a height over the leaves of a block, a leaf at a time: two nodes a height wait at most. Past the leaves there is no node: None."""

    def __init__(self, leaves: list[str], height: int, at: int):
        self.leaves, self.height, self.node = leaves, height, None
        self.next, self.end = at * ARITY**height, min((at + 1) * ARITY**height, len(leaves))
        self.waiting: list[list[str]] = [[] for _ in range(height)]
        self.open = self.next < self.end

    def update(self) -> None:
        """Take one more leaf in."""
        node, h = self.leaves[self.next], 0
        self.next += 1
        last = self.next == self.end
        while h < self.height:
            own = self.waiting[h]
            own.append(node)
            if len(own) < ARITY and not last:
                return
            node, h = digest(own), h + 1
            own.clear()
        self.node, self.open = node, False

    def finish(self) -> str | None:
        while self.open:
            self.update()
        return self.node


def traverse(leaves: list[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in order its siblings, height by height from the leaves: those on its left and those on its right, one after the other."""
    runs: list[list[str | None]] = [[None, *(Treehash(leaves, h, k).finish() for k in range(1, ARITY))] for h in range(height)]
    ahead = [[Treehash(leaves, h, ARITY + k) for k in range(1, ARITY)] for h in range(height)]
    path = [("", "".join(filter(None, r))) for r in runs]
    for t, node in enumerate(leaves):
        yield list(path)
        for h in range(height):  # the node on the way to leaf t is done at these heights
            at = t // ARITY**h
            runs[h][at % ARITY] = node
            if at % ARITY < ARITY - 1:
                changed = h
                break
            node = digest(runs[h])
            runs[h] = [None, *(x.finish() for x in ahead[h])]  # all done by now
            ahead[h] = [Treehash(leaves, h, at + 1 + ARITY + k) for k in range(1, ARITY)]
        else:
            changed = height - 1
        for h in range(changed + 1 if height else 0):
            at = (t + 1) // ARITY**h % ARITY
            path[h] = ("".join(x for x in runs[h][:at] if x), "".join(x for x in runs[h][at + 1 :] if x))
        for pair in ahead:  # two thirds of a leaf a step would do
            for hash_ in pair:
                if hash_.open:
                    hash_.update()
                    break


_NODE = "grp string, block long, size long, node string"


def _roots(nodes: DataFrame, tall: int) -> DataFrame:
    """grp, block, size (blocks of the group) and node, the root of each block of nodes (grp, rank, size, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaves, out = None, [], []

        def close() -> None:
            if key is not None:
                grp, block, size = key
                out.append((grp, block, -(-size // ARITY**tall), Treehash(leaves, min(tall, height(size)), 0).finish()))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    close()
                    key, leaves = row[:3], []
                leaves.append(row[3])
            yield _batch(out, _NODE)
            out = []
        close()
        yield _batch(out, _NODE)

    block = F.floor(F.col("rank") / ARITY**tall)
    dealt = nodes.select("grp", block.alias("block"), "size", "node", "rank").repartition("grp", "block").sortWithinPartitions("grp", "block", "rank")
    return dealt.select("grp", "block", "size", "node").mapInArrow(run, _NODE)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[f for f, _ in fields])


def _paths(nodes: DataFrame, above: DataFrame | None, keep: T.StructType, tall: int) -> DataFrame:
    """grp, rank, node, keep, subroot, path and root of nodes (grp, rank, size, node, keep): their path within their block, then their block's.

    above: grp, block, path, root and subroot of blocks; without it each group is one block, whose root is the root.
    """
    ship(nodes.sparkSession)
    none = F.lit(None)
    rows = nodes.select("grp", F.floor(F.col("rank") / ARITY**tall).alias("block"), F.col("rank"), "size", "node", "keep", none.cast("string").alias("root"), none.cast("string").alias("subroot"), none.cast(PATH).alias("path"))
    if above is not None:  # a block's own row comes before those of its nodes
        rows = above.select("grp", "block", F.lit(-1).cast("long").alias("rank"), none.cast("long").alias("size"), none.cast("string").alias("node"), none.cast(keep).alias("keep"), "root", "subroot", "path").unionByName(rows)
    schema = T.StructType([T.StructField("grp", T.StringType()), T.StructField("rank", T.LongType()), T.StructField("node", T.StringType()), T.StructField("keep", keep), T.StructField("subroot", T.StringType()), T.StructField("path", PATH), T.StructField("root", T.StringType())])
    step = pa.struct([pa.field("left", pa.string(), False), pa.field("right", pa.string(), False)])
    listed = pa.list_(pa.field("element", step, False))

    def block_of(parts: list[pa.RecordBatch], top: tuple) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        leaves, size = table["node"].to_pylist(), table["size"][0].as_py()
        above_, root, subroot = top
        for first in range(0, len(leaves), 512):
            if first == 0:
                walk = traverse(leaves, min(tall, height(size)))
            ways = [[*next(walk), *above_] for _ in range(min(512, len(leaves) - first))]
            if first == 0 and root is None:
                root = leaves[0]
                for left, right in ways[0]:
                    root = digest([left, root, right])
            offsets = [0]
            for w in ways:
                offsets.append(offsets[-1] + len(w))
            steps = pa.StructArray.from_arrays([pa.array([s[k] for w in ways for s in w], pa.string()) for k in (0, 1)], fields=list(step))
            own, n = table.slice(first, len(ways)), len(ways)
            columns = [own[c].combine_chunks() for c in ("grp", "rank", "node", "keep")]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([subroot] * n, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps, type=listed), pa.array([root] * n, pa.string())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, top = None, [], ((), None, None)
        for batch in batches:
            groups, blocks, ranks = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("grp", "block", "rank"))
            start = 0
            for i in range(len(ranks) + 1):
                end = i == len(ranks)
                if end or (groups[i], blocks[i]) != key or ranks[i] < 0:
                    if i > start:
                        parts.append(batch.slice(start, i - start))
                    start = i
                    if end:
                        break
                    if (groups[i], blocks[i]) != key:
                        if parts:
                            yield from block_of(parts, top)
                        key, parts, top = (groups[i], blocks[i]), [], ((), None, None)
                    if ranks[i] < 0:
                        row = batch.slice(i, 1).to_pylist()[0]
                        top, start = ([(s["left"], s["right"]) for s in row["path"]], row["root"], row["subroot"]), i + 1
        if parts:
            yield from block_of(parts, top)

    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "rank").mapInArrow(run, schema)


def _forest(nodes: DataFrame, tall: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of nodes (grp, rank, size, node, keep) round by round: the nodes of groups that are taken further, and the roots of all blocks."""
    rounds, roots = [nodes], []
    while True:
        roots.append(stored(_roots(rounds[-1], tall), "block-roots"))
        more = roots[-1].where("size > 1")
        if more.isEmpty():
            return rounds, roots
        rounds.append(more.select("grp", F.col("block").alias("rank"), "size", "node", F.struct(F.lit(0).alias("none")).alias("keep")))


def build(docs: DataFrame, leaf: Column, source: str = "source", doc_id: str = "doc_id", keep: tuple[str, ...] = (), tall: int = HEIGHT) -> DataFrame:
    """doc_id, source, the columns `keep`, leaf (as given), subroot (its source's), path (an array of left, right: what stands beside a row's node, at each
    height from the leaf to the root) and root (of all) for each row of docs.

    In a source leaves are in order of doc_id, rows of equal ids in order of their leaf, rows without one first; a null source is a source of
    its own. A lone row's leaf is its source's root, a lone source's root is the root. Repeated rows are leaves of their own. No rows give
    no rows. A source may hold any number of rows: no task has more than a block of them at once. ids may be of any type that can
    be ordered. Columns of docs that aren't named play no part. tall: the height of a block, of 3**tall nodes, which changes no result.
    """
    spark = docs.sparkSession
    ship(spark)
    named = F.struct(F.col(f"`{doc_id}`").alias("id"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    plain = stored(docs.select(F.col(f"`{source}`").cast("string").alias("grp"), leaf.alias("node"), named.alias("keep")), "leaves")
    leaves = stored(ranked(plain, "grp", [F.col("keep.id").asc_nulls_first(), F.col("node").asc()], "rank", "size", "leaves-by-source"), "ranked-leaves")
    rounds, roots = _forest(leaves, tall)
    subroots = roots[0].where("size = 1")
    for r in roots[1:]:
        subroots = subroots.unionByName(r.where("size = 1"))

    # the tree over all sources: one group, whose members are in order of the source
    members = subroots.select(F.lit("").alias("all"), F.col("node"), F.struct(F.col("grp").alias("source")).alias("keep"))
    top = ranked(members, "all", [F.col("keep.source").asc_nulls_first()], "rank", "size", "subroots").withColumnRenamed("all", "grp")
    top_rounds, top_roots = _forest(stored(top, "ranked-subroots"), tall)
    tops = _down(top_rounds, top_roots, tall).select(F.col("keep.source").alias("s"), F.col("node").alias("subroot"), F.col("path").alias("top"), F.col("root").alias("top_root"))

    way = _down(rounds, roots, tall, stored(tops, "sources"))
    columns = [F.col(f"keep.k{i}").alias(c) for i, c in enumerate(keep)]
    return way.select(F.col("keep.id").alias(doc_id), F.col("grp").cast(docs.schema[source].dataType).alias(source), *columns, F.col("node").alias("leaf"), "subroot", "path", "root")


def _down(rounds: list[DataFrame], roots: list[DataFrame], tall: int, tops: DataFrame | None = None) -> DataFrame:
    """The paths of the first round's nodes, from the last round's down. tops: the root, and the way to it, of each group as a whole (s, subroot, top, top_root)."""
    above = None
    for i in range(len(rounds) - 1, -1, -1):
        keep = rounds[i].schema["keep"].dataType
        blocks = None if above is None else above.select("grp", F.col("rank").alias("block"), "path", "root", "subroot")
        if i == 0 and tops is not None:  # every block gets its source's way
            own = roots[0].select("grp", "block").join(tops, F.col("grp").eqNullSafe(F.col("s")))
            if blocks is None:
                blocks = own.select("grp", "block", F.col("top").alias("path"), F.col("top_root").alias("root"), "subroot")
            else:
                up = blocks.select(F.col("grp").alias("g"), F.col("block").alias("b"), "path")
                met = own.join(up, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")), "left")
                blocks = met.select("grp", "block", F.concat(F.coalesce("path", F.array().cast(PATH)), F.col("top")).alias("path"), F.col("top_root").alias("root"), "subroot")
        above = _paths(rounds[i], blocks, keep, tall)
    return above
