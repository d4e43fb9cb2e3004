"""Small helpers shared by the operators: table reading, scratch folders, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space and \t \n \v \f \r, which are also
#: the bytes that bytes.split() without an argument splits at.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is
    unset, a new local one is set for a local session; a cluster's is refused."""
    got = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not got and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    got = got or f"file://{tempfile.mkdtemp(prefix='runlens-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(got)
    return got


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: compressed,
    and split again at the reader's own size."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # small row groups: a writer holds one in memory
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_batch(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict | None], rows: int = 512) -> DataFrame:
    """mapInArrow with work() on slices of `rows` rows, so that a task holds
    few whole texts as Python objects at once."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if (out := work(batch.slice(at, rows))) is not None:
                    yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in ((out[f.name], f) for f in target)], schema=target)

    return df.mapInArrow(run, schema)


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string; needs no session, as in a task."""
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in ddl.split(","))])


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of rows with keyed, which has one row a key and in `count` how many rows
    the key has. Keys with over a thousandth of them, so a thousand at most, are broadcast; the
    others, none of which has more than that, meet in a shuffle. keyed is read several times."""
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > total // 1000
    some = F.broadcast(keyed.where(hot))
    rest = rows.join(some.select(*keys), keys, "left_anti")
    return rows.join(some, keys).unionByName(rest.join(keyed.where(~hot), keys))


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def file_bytes(path: str) -> bytes:
    """A tokenizer's file, read on the driver; executors get it in a broadcast
    and need no file of their own. Such files have a few MB."""
    if os.path.getsize(path) > 64 << 20:
        raise ValueError(f"{path}: a tokenizer file of over 64 MB isn't broadcast")
    with open(path, "rb") as f:
        return f.read()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null becomes the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's strings in UTF-8, as Arrow holds them; null becomes the empty text."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, as (new name = type or old name), so that extra
    columns of any name can't clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in cols.items()])
