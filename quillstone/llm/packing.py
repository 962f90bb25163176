"""Best-fit packing of token sequences by minimum bin slack.

Each document's ids and an end id are cut into pieces of at most `capacity` ids, the first the shorter one. Pieces
are alike but for their length, so that bins are planned on how many pieces each length has: capacity numbers at
most, whatever the corpus. A bin takes the longest length left, then the fullest feasible combination of the others,
found by subset sums over the available lengths with integers as bitsets; it is removed as often as the counts
allow. Every piece then gets its place by its rank among the pieces of its length. Ranks come from counts by task
and length, so that a length that a third of all pieces have isn't gathered anywhere.

Edge cases: a null text is an empty one; an empty text is one piece, the end id; repeated rows are packed as often
as they come; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, slices, stored, without
from .tokens import ids_of

PIECE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("piece", "start", "length")]
    + [T.StructField("ids", T.BinaryType()), T.StructField("task", T.LongType()), T.StructField("nth", T.LongType())]
)


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", end_id: int = 0, capacity: int = 2048, keep: int = 500_000) -> DataFrame:
    """A row for each piece: the document's columns but its text, piece, start, length, ids (little-endian unsigned
    32-bit integers), and the task and the number among its pieces of this length. It is stored, as task and nth
    are only right for one run. keep: words in a worker's cache of ids."""
    ship(docs.sparkSession)
    kept = without(docs, PIECE.names)
    at = [c.lower() for c in kept.columns].index(text.lower())
    rest = [i for i in range(len(kept.columns)) if i != at]
    fields = [kept.schema[i] for i in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, tokens, end = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), ids_of(tokenizer, keep), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            column = batch.column(at).cast(pa.string()).fill_null("")
            for part, texts in slices(batch, column, 2 << 20):
                row, piece, start, length, ids, nth = [], [], [], [], [], []
                for i, b in enumerate(tokens.encode_all(texts.to_pylist())):
                    b += end
                    n = len(b) // 4
                    cut = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
                        row.append(i)
                        piece.append(k)
                        start.append(x)
                        length.append(y - x)
                        ids.append(b[x * 4 : y * 4])
                        nth.append(seen[y - x])
                        seen[y - x] += 1
                own = part.take(pa.array(row, pa.int64()))
                made = [pa.array(x, pa.int64()) for x in (piece, start, length)] + [pa.array(ids, pa.binary()), pa.array([task] * len(row), pa.int64()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(own.column(j) for j in rest), *made], names=[*(f.name for f in fields), *PIECE.names])

    return stored(kept.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), *PIECE.fields])), "pieces")


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """Of lengths with how many are left, the combination that fills most of room: length to how many; longer ones first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in sorted((n for n, k in left.items() if k and n <= room), reverse=True):
        most, k = min(left[n], room // n), 1
        while most:
            k = min(k, most)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            most -= k
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + k
            at -= n * k
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """How often each combination of lengths is used; together they use up the counts."""
    left, out = {n: k for n, k in counts.items() if k}, []
    while left:
        top = max(left)
        rest = left | {top: left[top] - 1}
        bin_ = fullest(rest, capacity - top)
        bin_[top] = bin_.get(top, 0) + 1
        times = min(left[n] // k for n, k in bin_.items())
        out.append((times, bin_))
        for n, k in bin_.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


def place(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Rows of pieces (any columns, with length, task and nth) with sequence_id and offset.

    Only counts by length come to the driver, capacity of them at most; only the plan goes out, a bounded number of
    rows too, as a combination has about sqrt(2 * capacity) different lengths at most.
    """
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    ranks = before.select(F.col("length").alias("__q_length"), F.col("task").alias("__q_task"), F.coalesce("before", F.lit(0)).alias("__q_before"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for times, bin_ in plan(counts, capacity):
        at = 0
        for n in sorted(bin_, reverse=True):
            k, first = bin_[n], used.get(n, 0)
            slots.append((n, first, sequence, k, at))
            used[n] = first + k * times
            at += n * k
        sequence += times
    slots.sort()
    length, first, base, each, offset = (np.array(x, np.int64) for x in (zip(*slots, strict=True) if slots else [[]] * 5))
    shift = np.int64(1 << 48)
    keys = length * shift + first
    names = [c for c in without(cut, ["sequence_id", "offset"]).columns if c not in ("task", "nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("__q_rank").to_numpy()
            i = np.searchsorted(keys, n * shift + rank, "right") - 1
            rank = rank - first[i]
            made = [pa.array(base[i] + rank // each[i]), pa.array(offset[i] + rank % each[i] * n)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], names=[*names, "sequence_id", "offset"])

    joined = cut.join(ranks, (F.col("length") == F.col("__q_length")) & (F.col("task") == F.col("__q_task")))
    joined = joined.select(*[F.col(f"`{c}`") for c in names], (F.col("nth") + F.col("__q_before")).alias("__q_rank"))
    fields = [T.StructField(c, cut.schema[c].dataType) for c in names]
    return joined.mapInArrow(run, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
