"""Token ids in compressed blocks with a shared dictionary, an offset index and access to single documents.

The file format is a folder of two Parquet tables, so that any store that Spark reaches can hold it and its commits
make lost executors harmless:

dictionary  one row: dict_hash (SHA-256 in hex of the dictionary's bytes, empty without one), dict (a zstandard
            dictionary trained on id arrays so serialized), end_id, tokenizer (the vocabulary file's name)
blocks      shard, block: documents come in ascending order of id, shard by shard and block by block
            first_id, last_id, n_docs, n_tokens: what the block holds; start_in_shard: ids before it in its shard
            n_null: how many documents, the block's first ones, have no id (0 stands for it in doc_ids)
            dict_hash: the dictionary that its frames need
            doc_ids: signed 64-bit; lengths: unsigned 32-bit, ids of each document; offsets: unsigned 64-bit,
            n_docs + 1 places of frames in data; data: one zstandard frame for each document, of its ids as
            unsigned 32-bit integers. All integers are little-endian.

Edge cases: a null text is an empty one, and any text ends with the end id; rows of equal id lie in order of text,
rows without an id come first and their id is read back as null; ids must be whole numbers (TypeError else); an empty table gives no blocks.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_by_hash, ship, slices, whole_ids
from .tokens import Ids, ids_of

BLOCK = "shard long, block long, first_id long, last_id long, n_docs long, n_tokens long, n_null long, start_in_shard long, dict_hash string, doc_ids binary, lengths binary, offsets binary, data binary"


def train_dictionary(docs: DataFrame, tokenizer: str, text: str = "text", end_id: int = 2, sample: int = 512, longest: int = 16_384, size: int = 65_536) -> bytes:
    """A dictionary trained on `sample` different documents of at most `longest` characters, taken in order of a hash of the text; where they are too few, on
    the beginnings of longer ones too. Empty where there is too little to train on."""
    of = F.col(f"`{text}`")
    rows = first_by_hash(docs.where(F.length(of).between(1, longest)).select(of.alias("t")), F.col("t"), sample)
    if len(rows) < sample:
        rows += first_by_hash(docs.where(F.length(of) > longest).select(F.substring(of, 1, longest).alias("t")), F.col("t"), sample - len(rows))
    end = np.array([end_id], "<u4").tobytes()
    arrays = [b + end for b in Ids(tokenizer).encode_all([r.t for r in rows])]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, arrays)) // 8), arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 2, level: int = 3, block_docs: int = 1024, block_bytes: int = 4 << 20) -> None:
    """Encode every text and write the folder."""
    spark = docs.sparkSession
    ship(spark)
    whole_ids(docs, doc_id)
    raw = train_dictionary(docs, tokenizer, text, end_id)
    dict_hash = hashlib.sha256(raw).hexdigest() if raw else ""
    spark.createDataFrame([(dict_hash, bytearray(raw), end_id, os.path.basename(tokenizer))], "dict_hash string, dict binary, end_id long, tokenizer string").coalesce(1).write.parquet(f"{path}/dictionary")
    names = [f.split()[0] for f in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, shard, block = ids_of(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        before = 0
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        ids: list[int | None] = []
        lengths: list[int] = []
        frames: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, before
            offsets = np.cumsum([0, *map(len, frames)]).astype("<u8")
            known = [i for i in ids if i is not None]
            row = [shard, block, known[0] if known else None, known[-1] if known else None, len(ids), sum(lengths), len(ids) - len(known), before, dict_hash, np.array([0] * (len(ids) - len(known)) + known, "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), offsets.tobytes(), b"".join(frames)]
            kinds = [*[pa.int64()] * 8, pa.string(), *[pa.binary()] * 4]
            block += 1
            before += sum(lengths)
            for x in (ids, lengths, frames):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        held = 0
        for batch in batches:
            for part, texts in slices(batch, batch.column(1).cast(pa.string()).fill_null(""), 2 << 20):
                for d, b in zip(part.column(0).to_pylist(), tokens.encode_all(texts.to_pylist()), strict=True):
                    ids.append(d)
                    lengths.append(len(b) // 4 + 1)
                    frames.append(press.compress(b + end))
                    held += len(frames[-1])
                    if len(ids) >= block_docs or held >= block_bytes:
                        yield flush()
                        held = 0
        if ids:
            yield flush()

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t"))
    own.repartitionByRange(F.col("d").asc_nulls_first()).sortWithinPartitions(F.col("d").asc_nulls_first(), "t").mapInArrow(run, BLOCK).write.parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(row["dict"])
    if (hashlib.sha256(raw).hexdigest() if raw else "") != row["dict_hash"]:
        raise ValueError(f"{path}: the dictionary isn't the one that its hash names")
    return row["dict_hash"], raw


def _documents(blocks: DataFrame, of: tuple[str, bytes], before: dict[int, int], only: frozenset[int] | None = None) -> DataFrame:
    ship(blocks.sparkSession)
    dict_hash, raw = of
    fields = "doc_id long, start long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        for batch in batches:
            for b in batch.to_pylist():
                if b["dict_hash"] != dict_hash:
                    raise ValueError("a block needs another dictionary")
                ids, lengths = np.frombuffer(b["doc_ids"], "<i8"), np.frombuffer(b["lengths"], "<u4").astype(np.int64)
                offsets, data = np.frombuffer(b["offsets"], "<u8").astype(np.int64), memoryview(b["data"])
                starts = np.cumsum(lengths) - lengths + b["start_in_shard"] + before[b["shard"]]
                at = np.arange(len(ids)) if only is None else np.flatnonzero(np.isin(ids, list(only)) & (np.arange(len(ids)) >= b["n_null"]))
                for i in range(0, len(at), 256):
                    own = at[i : i + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[own], pa.int64(), mask=own < b["n_null"]),
                            pa.array(starts[own], pa.int64()),
                            pa.array(lengths[own], pa.int64()),
                            pa.array([open_.decompress(data[offsets[j] : offsets[j + 1]]) for j in own.tolist()], pa.binary()),
                        ],
                        names=[f.split()[0] for f in fields.split(", ")],
                    )

    return blocks.select("shard", "start_in_shard", "dict_hash", "n_null", "doc_ids", "lengths", "offsets", "data").mapInArrow(run, fields)


def _before(blocks: DataFrame) -> dict[int, int]:
    """How many ids come before each shard. There is a shard for each task that wrote, and no more numbers than that."""
    total, out = 0, {}
    for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        out[r.shard] = total
        total += r.n
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document: doc_id, start (ids of all documents before it), n_tokens, ids."""
    blocks = spark.read.parquet(f"{path}/blocks")
    return _documents(blocks, _dictionary(spark, path), _before(blocks))


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Only these documents: Parquet's statistics of first_id and last_id leave the blocks that may hold one, and only their frames are opened."""
    blocks, near = spark.read.parquet(f"{path}/blocks"), F.lit(False)
    for i in ids:
        near = near | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
    return _documents(blocks.where(near), _dictionary(spark, path), _before(blocks), frozenset(ids))
