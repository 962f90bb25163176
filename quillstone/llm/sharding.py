"""Shards of near equal bytes from groups that stay together, by Karmarkar and Karp's differencing.

Groups are summed up by Spark. Those with more than a 4096th of all bytes are items of their own, of which there can't be more
than 4096; all lighter groups are dealt by a hash to 4096 bundles, each an item. So the differencing, which can only be done
in one place, is over 8192 items at most, whatever the table's size, and a bundle is a small part of a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, ship, stored, without


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item.

    At first each item is a partial partition of its own, with one part of its size and empty ones. The two partial partitions with the largest
    spread (largest part less smallest) are combined, one's largest part with the other's smallest and so on, until one is left.
    Equal spreads go by age. Its parts, largest first, are the shards.
    """
    if not sizes:
        return []
    # (-spread, age, [(sum, tree), ...] by falling sum); a tree is an item, a pair of trees, or None
    heap = [(-n if shards > 1 else 0, k, [(n, k)] + [(0, None)] * (shards - 1)) for k, n in enumerate(sizes)]
    heapq.heapify(heap)
    age = len(sizes)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = [(a + b, x if y is None else y if x is None else (x, y)) for (a, x), (b, y) in zip(one, reversed(two), strict=True)]
        parts.sort(key=lambda part: -part[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], age, parts))
        age += 1
    out = [0] * len(sizes)
    for shard, (_, tree) in enumerate(heap[0][2]):
        open_ = [] if tree is None else [tree]
        while open_:
            node = open_.pop()
            if isinstance(node, tuple):
                open_ += node
            else:
                out[node] = shard
    return out


def assign(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", items: int = 4096) -> DataFrame:
    """docs without the text, with size (UTF-8 bytes of the text and 1), text_crc32, group (SHA-256 of the text), shard (from 0) and slot (from 0 without gaps in its shard, by id, then group).

    Equal texts are a group, which is never divided: one that is larger than a shard's share makes its shard as much larger. A null text has
    no bytes and is in one group with empty ones. Repeated rows are rows, each with its slot; rows without an id come first. Fewer
    groups than shards leave shards empty; no rows give no rows. Columns of docs with the results' names are replaced, all
    others stay. items: the bound on heavy groups and on bundles. The text is read once; ids may be of any type that can be ordered.
    """
    if shards < 1 or items < 1:
        raise ValueError("shards and items must be 1 at least")
    ship(docs.sparkSession)
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    names = ["size", "text_crc32", "group", "shard", "slot"]
    facts = {"size": F.octet_length(own).cast("long") + 1, "text_crc32": F.crc32(own), "group": F.unhex(F.sha2(own, 256))}
    kept = [c for c in without(docs, names).columns if c.lower() != text.lower()]
    rows = stored(docs.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(k) for k, c in facts.items()]), "sizes")

    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    bundle = F.pmod(F.xxhash64("group"), F.lit(items))
    heavy = F.col("bytes") * F.lit(items).cast("decimal(20,0)") > F.lit(total)
    item = groups.groupBy(F.when(heavy, F.col("group")).alias("heavy"), F.when(~heavy, bundle).alias("bundle")).agg(F.sum("bytes").alias("bytes"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (-r["bytes"], r["heavy"] or b"", r["bundle"] or 0))
        own = difference([r["bytes"] for r in all_], shards)
        yield pa.RecordBatch.from_pydict({"heavy": pa.array([r["heavy"] for r in all_], pa.binary()), "bundle": pa.array([r["bundle"] for r in all_], pa.int64()), "shard": pa.array(own, pa.int32())})

    # repartition(1): at most 2 * items rows
    found = stored(item.repartition(1).mapInArrow(placed, "heavy binary, bundle long, shard int"), "shards")
    of_heavy = found.where("heavy is not null").select(F.col("heavy").alias("__q_heavy"), F.col("shard").alias("__q_first"))
    of_bundle = found.where("bundle is not null").select(F.col("bundle").alias("__q_bundle"), F.col("shard").alias("__q_second"))
    met = rows.join(F.broadcast(of_heavy), F.col("group") == F.col("__q_heavy"), "left").join(F.broadcast(of_bundle), bundle == F.col("__q_bundle"), "left")  # `items` rows each at most
    out = met.select(*[F.col(f"`{c}`") for c in kept], *facts, F.coalesce("__q_first", "__q_second").alias("shard"))
    slots = ranked(out, "shard", [F.col(f"`{doc_id}`").asc_nulls_first(), F.col("group").asc()], "slot", "__q_rows", "slots")
    return slots.drop("__q_rows")
