"""What the operators of this subpackage share: scratch tables, shipping, and Arrow mapping over texts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parents[1]
_ARCHIVE = "quillstone-for-workers.zip"
_made: list[str] = []


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers, as an archive that Spark hands to every executor; once a session."""
    context = spark.sparkContext
    if any(f.endswith(_ARCHIVE) for f in context.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="quillstone-"), _ARCHIVE)
    with zipfile.ZipFile(path, "w") as archive:
        for f in sorted(ROOT.rglob("*.py")):
            archive.write(f, f.relative_to(ROOT.parent))
    context.addPyFile(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared checkpoint folder. Where none is set, a local master gets a temporary one; elsewhere that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Delete the tables that operators have stored so far. Results that weren't written yet read them: call it after that."""
    jvm = spark._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as a table in the shared folder, and read from there: a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_held: dict = {}


def held(key, make: Callable):
    """What make() gives, kept in this Python worker for its next tasks in place of what another key had: workers are used
    again by one operator after the other, and only one's large state is to stay."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Nothing is kept any longer."""
    _held.clear()


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without its columns of these names, in any case: a result column replaces an input column of its name."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def let(value: Column, then) -> Column:
    """then(value), with value worked out once however often then, or a lambda in it, uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def fold(column: str, n: int):
    """crc32 of the id as text, modulo n: the folds that the queries' contracts name. A null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0).cast("long"))


def hash_limit(n: int, of: int) -> int:
    """A 64-bit hash that is higher than those of the first n of about `of` rows by hash, unless hashes are very uneven."""
    return min(2**63 - 1, int(-(2**63) + min(1.0, (4 * n + 100) / max(of, 1)) * 2**64))


def first_by_hash(df: DataFrame, by: Column, n: int) -> list:
    """Up to n rows of df with different values of `by`, those of the smallest hashes, in their order; of rows that share a value the least.

    Rows whose hash is too high to be among them go before anything is sorted or sent, by an estimate of how many values there are; where
    too few are left, all rows are ranked. Copies are counted once, so that they can't fill the sample or empty it.
    """
    keyed = df.withColumn("__q_hash", F.xxhash64(by))
    limit = hash_limit(n, keyed.agg(F.approx_count_distinct("__q_hash").alias("n")).first()["n"])

    def first(rows: DataFrame) -> list:
        one = rows.groupBy("__q_hash").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
        return one.orderBy("__q_hash").limit(n).select("row.*").collect()

    rows = first(keyed.where(F.col("__q_hash") <= F.lit(limit)))
    return rows if len(rows) == n or limit == 2**63 - 1 else first(keyed)


def whole_ids(df: DataFrame, column: str) -> None:
    """Raises TypeError unless the column holds whole numbers of 64 bits at most."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        raise TypeError(f"{column}: ids must be whole numbers, not {kind.simpleString()}; number the rows first")


def slices(batch: pa.RecordBatch, column: pa.Array, max_bytes: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in pieces of about max_bytes of text, a row at least."""
    size, start, lengths = 0, 0, [0 if n is None else n for n in pa.compute.binary_length(column).to_pylist()]
    for i, n in enumerate(lengths):
        if i > start and size + n > max_bytes:
            yield batch.slice(start, i - start), column.slice(start, i - start)
            size, start = 0, i
        size += n
    if start < len(lengths):
        yield batch.slice(start), column.slice(start)


def map_texts(docs: DataFrame, text: str, fields: list[T.StructField], make: Callable, max_bytes: int = 2 << 20, keeps: bool = False) -> DataFrame:
    """docs with columns that a function of the texts makes. make() runs once a task and returns a function from an Arrow string array without nulls to Arrow arrays, one a field. keeps: make uses held()."""
    ship(docs.sparkSession)
    kept = without(docs, [f.name for f in fields])
    at = [c.lower() for c in kept.columns].index(text.lower())
    names = [*kept.columns, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        work = make()
        for batch in batches:
            column = batch.column(at).cast(pa.string()).fill_null("")
            for piece, texts in slices(batch, column, max_bytes):
                yield pa.RecordBatch.from_arrays([*piece.columns, *work(texts)], names=names)

    return kept.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in kept.schema), *fields]))


def ranked(df: DataFrame, group: str, order: list[Column], rank: str, size: str, name: str) -> DataFrame:
    """df, stored, with the place of each row in its group (from 0, nulls first, in the order given) and the group's number of rows.

    A group may be any share of df: rows are dealt out by ranges of (group, order), equal ones at random, and numbered where
    they lie; what each group has in the tasks before is a sum over a row for each task and group. The rank that a row gets is
    fixed once it's stored. df should be cheap to read: ranges are sampled first.
    """
    keys = [F.col(f"`{group}`").asc_nulls_first(), *order]
    dealt = df.repartitionByRange(*keys, F.rand(17)).sortWithinPartitions(*keys)
    put = stored(dealt.withColumn("__q_at", F.monotonically_increasing_id()), name)
    in_task = put.groupBy(F.col(f"`{group}`").alias("__q_g"), F.shiftright("__q_at", 33).alias("__q_t")).agg(F.min("__q_at").alias("__q_first"), F.count("*").alias("__q_n"))
    own = Window.partitionBy("__q_g")
    before = F.coalesce(F.sum("__q_n").over(own.orderBy("__q_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = in_task.select("__q_g", "__q_t", "__q_first", before.alias("__q_before"), F.sum("__q_n").over(own).alias("__q_size"))
    met = put.join(places, F.col(f"`{group}`").eqNullSafe(F.col("__q_g")) & (F.shiftright("__q_at", 33) == F.col("__q_t")))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__q_at") - F.col("__q_first") + F.col("__q_before")).alias(rank), F.col("__q_size").alias(size))
