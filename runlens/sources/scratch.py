"""Frames that are computed once: checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commitlog import Files


#: How frames are kept as Parquet: sorted texts by what differs, and hashes of which a file has tens of thousands in a dictionary.
COLUMNS = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.dictionary.page.size": "4194304"}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session gets a new one and a cluster's is refused."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(path or f"file://{tempfile.mkdtemp(prefix='runlens-')}")
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once, with its lineage cut."""
    folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, computed once, as compressed columns: wide frames take a fraction of a checkpoint's room, and readers open only the columns they name."""
    path = f"{folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.options(**COLUMNS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """The files of a written() frame, or of one of its slices, which is read no more."""
    files = Files(df.sparkSession)
    for path in df.inputFiles():
        files.remove(path)


def size(df: DataFrame) -> int:
    """Bytes of a written() frame's files, or of one of its slices."""
    files = Files(df.sparkSession)
    return sum(map(files.size, df.inputFiles()))


def ranged(df: DataFrame, column: str, n: int) -> DataFrame:
    """df in n ranges of a column of SHA-256 in hexadecimals, each in order. Such hashes are spread evenly, so that the ranges' bounds needn't be looked for in the rows."""
    n = max(1, n)
    at = (F.conv(F.substring(column, 1, 6), 16, 10).cast("long") * n / F.lit(1 << 24)).cast("int")
    return df.repartitionById(n, at).sortWithinPartitions(column)


def sliced(df: DataFrame, size: int, most: int = 16) -> list[DataFrame]:
    """A written() frame by groups of its files of about `size` bytes, `most` groups at most."""
    paths, files = sorted(df.inputFiles()), Files(df.sparkSession)
    n = min(len(paths), most, max(1, -(-sum(map(files.size, paths)) // size)))
    return [df.sparkSession.read.schema(df.schema).parquet(*paths[i::n]) for i in range(n)] if n > 1 else [df]


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the query that wrote them, rather than with the driver's next garbage collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores by its keys: a small file is one task, however much is then made of its rows."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keys)
