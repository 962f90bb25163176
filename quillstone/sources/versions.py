"""Tables in versions: each write makes a new folder, and one atomic rename of a small file makes it current.

A table is a folder with the file _current, which names its key, how many buckets its keys fall into, its schema and a folder for each bucket that has rows. A
change writes only the buckets that it touches; the others' folders stay as they are. Readers that began with an older version keep its
folders until vacuum. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators import corpus


@dataclass(frozen=True)
class Version:
    """key: an SQL expression over a row; folders: by bucket."""

    number: int
    key: str
    buckets: int
    schema: dict
    folders: dict[str, str] = field(default_factory=dict)


def _context(spark: SparkSession, path: str):
    jvm = spark._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), spark._jsc.hadoopConfiguration()), own


def current(spark: SparkSession, path: str) -> Version | None:
    """None where there is no table."""
    jvm, context, own = _context(spark, f"{path}/_current")
    if not context.util().exists(own):
        return None
    stream = context.open(own)
    try:
        return Version(**json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    jvm, context, own = _context(spark, f"{path}/_current")
    _, _, new = _context(spark, f"{path}/_current.{uuid.uuid4().hex}")
    out = context.create(new, jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE), spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    out.write(json.dumps(asdict(version)).encode())
    out.close()
    overwrite = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, own, overwrite)


def _bucket(version: Version) -> Column:
    return F.pmod(F.xxhash64(F.expr(version.key).cast("string")), F.lit(version.buckets)).cast("int")


def _rows(spark: SparkSession, version: Version, buckets: set[str] | None = None) -> DataFrame:
    folders = [f for b, f in sorted(version.folders.items()) if buckets is None or b in buckets]
    schema = T.StructType.fromJson(version.schema)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The table as it is now; None where there is none. number: an error unless that is the version."""
    version = current(spark, path)
    if number is not None and (version is None or version.number != number):
        raise LookupError(f"{path}: version {number} isn't the current one")
    return None if version is None else _rows(spark, version)


def _write(spark: SparkSession, path: str, version: Version, rows: DataFrame, touched: set[str] | None) -> Version:
    """rows, which are all of the touched buckets, as the next version."""
    folder = f"{path}/v-{version.number + 1}-{uuid.uuid4().hex}"
    # rebalanced by bucket: few files a bucket, and a hot one is still split over tasks
    rows.withColumn("__bucket", _bucket(version)).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(folder)
    jvm, context, own = _context(spark, folder)
    made = {f.getPath().getName().split("=")[1] for f in context.util().listStatus(own) if f.isDirectory() and f.getPath().getName().startswith("__bucket=")}
    kept = {} if touched is None else {b: f for b, f in version.folders.items() if b not in touched}
    out = Version(version.number + 1, version.key, version.buckets, version.schema, kept | {b: f"{folder}/__bucket={b}" for b in made})
    _commit(spark, path, out)
    return out


def create(rows: DataFrame, path: str, key: str, buckets: int = 64) -> Version:
    """A table at path, in place of any that is there. key: a column or an SQL expression, by which rows are looked up and changed."""
    spark = rows.sparkSession
    old = current(spark, path)
    return _write(spark, path, Version(old.number if old else 0, key, buckets, rows.schema.jsonValue()), rows, None)


def _touched(version: Version, rows: DataFrame) -> set[str]:
    return {str(r.b) for r in rows.select(_bucket(version).alias("b")).distinct().collect()}  # as many as buckets at most


def upsert(path: str, new: DataFrame, order: str, key: str | None = None) -> Version:
    """The table at path with rows of new in place of those of their keys; of rows of new with one key the last by order stays. key: the column of the table's key, needed where there is no table yet."""
    spark = new.sparkSession
    version = current(spark, path)
    if version is None:
        if key is None:
            raise LookupError(f"{path}: no table, and no key for one")
        version = Version(0, key, 64, new.schema.jsonValue())
    new = new.select(*T.StructType.fromJson(version.schema).names)
    touched = _touched(version, new)
    return _write(spark, path, version, corpus.upsert(_rows(spark, version, touched), new, version.key, order), touched)


def delete(spark: SparkSession, path: str, keys: list[str], gone: Column) -> int:
    """How many rows were deleted: those of these keys for which gone holds. Counted as they are written; nothing is written where no key's bucket has rows."""
    version = current(spark, path)
    wanted = spark.createDataFrame([(k,) for k in keys], "k string").select(F.pmod(F.xxhash64("k"), F.lit(version.buckets)).cast("string").alias("b"))
    touched = {r.b for r in wanted.distinct().collect()} & set(version.folders)
    if not touched:
        return 0
    own, seen = F.expr(version.key).cast("string").isin(keys) & gone, Observation()
    rows = _rows(spark, version, touched).observe(seen, F.count_if(own).alias("n"))
    _write(spark, path, version, rows.where(~F.coalesce(own, F.lit(False))), touched)
    return seen.get["n"]


def vacuum(spark: SparkSession, path: str) -> int:
    """How many buckets' folders of older versions were removed. Readers of those must be done."""
    version = current(spark, path)
    jvm, context, own = _context(spark, path)
    named, n = {f.rpartition("/v-")[2] for f in version.folders.values()}, 0
    for made in context.util().listStatus(own):
        if made.isDirectory() and made.getPath().getName().startswith("v-"):
            for bucket in context.util().listStatus(made.getPath()):
                if bucket.isDirectory() and f"{made.getPath().getName()}/{bucket.getPath().getName()}".removeprefix("v-") not in named:
                    n += bool(context.delete(bucket.getPath(), True))
    return n


def write_scopes(rows: DataFrame, path: str, *scopes: str) -> None:
    """rows into the table at path, in folders by scope (a run, an arm): those of the scopes that rows has are replaced, no other is touched."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scopes).parquet(path)
