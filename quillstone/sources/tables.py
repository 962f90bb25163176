"""Tables as sinks: fresh folders, swaps, upserts and deletions in place, articles as JSON."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared checkpoint folder; a temporary one where none is set and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder, and read from there: what follows neither works it out again nor depends on an executor."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    fs, own = _files(spark, path)
    return fs.exists(own)


def swap(df: DataFrame, path: str) -> DataFrame:
    """df in place of the table at path, which df may read: written beside it by a committed job, then renamed. Between two renames a reader may find
    no table; sources.versions has tables whose readers always find one."""
    spark, tag = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}.new-{tag}")
    fs, own = _files(spark, path)
    _, new = _files(spark, f"{path}.new-{tag}")
    _, old = _files(spark, f"{path}.old-{tag}")
    had = fs.exists(own)
    if had and not fs.rename(own, old):
        raise OSError(f"{path}: can't be moved aside")
    if not fs.rename(new, own):
        if had:
            fs.rename(old, own)
        raise OSError(f"{path}: can't be put in place")
    if had:
        fs.delete(old, True)
    return spark.read.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, as a manifest; None where there is none."""
    return spark.read.parquet(path) if exists(spark, path) else None


def write_articles(articles: DataFrame, path: str) -> None:
    """Articles (articulo, title, text, paragraphs) as JSON lines, one folder a run of the job."""
    articles.select("articulo", "title", "text", "paragraphs").write.option("ignoreNullFields", "false").json(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("articulo string, title string, text string, paragraphs array<struct<apartado:string,text:string>>").json(path)


def checked(table: DataFrame, path: str, column: str, value) -> DataFrame:
    """table with another value in a column, written to path: its rows are counted as they are read and as they are written."""
    from pyspark.sql import Observation

    seen = Observation("rows")
    table.observe(seen, F.count(F.lit(1)).alias("n")).withColumn(column, value).write.parquet(path)
    out = table.sparkSession.read.parquet(path)
    if out.count() != seen.get["n"]:
        raise RuntimeError(f"{path}: rows were lost")
    return out
