"""A store of tables as Parquet files with a log of commits.

A commit's files are written first and become visible at once with its entry of the log (commitlog.py): a lost job leaves nothing to
see. Each file's entry has its rows and the least and greatest value of the table's first key, and keyed tables have an index beside
their files, a Bloom filter for each file, so that a batch reads only files that may hold one of its keys. Deleted rows are
hidden by lists of their places; compact() writes small files anew without them.
Files keep the format they were written in and are brought to the present one as they are read. Columns that follow from others
need not be stored: a file's entry says which they are and how they are made.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.identity import canonical_json
from .commitlog import Conflict, Files, Log, State
from .scratch import COLUMNS

VERSION = 3
RESIDUAL = "residual_set_id string, sample_id string, group_id string, origin_sample_id string, scope string, fold_id string, partition string, y_true double, y_pred double, y_proba array<double>, residual double, weight double"
#: Rows up to which a table's keys are read whole rather than by the index; rows of a file that compact() writes.
SMALL, FILE_ROWS = 100_000, 1_000_000
#: Tables of a commit that are written side by side.
WRITERS = 6
#: Rows from which a file gets a filter: a smaller one's keys are as soon read.
FILTERED = 10_000
#: Bits of a filter for each key, and how many of them a key sets: about one in 2,000 absent keys is taken for present.
BITS, HASHES = 16, 7

#: From a format to the next one: table -> (the DDL that files of that format have, what makes present rows of them).
Upgrades = dict[int, dict[str, tuple[str, Callable[[DataFrame], DataFrame]]]]


@dataclass
class Staged:
    """What is written and not yet seen: the tables, and what the log will say of their files."""

    tables: set[str] = field(default_factory=set)
    files: dict[str, dict] = field(default_factory=dict)

    def __or__(self, other: Staged) -> Staged:
        return Staged(self.tables | other.tables, self.files | other.files)


def _places(keys: list[str], slots: Column) -> Column:
    """The bits of a key in a filter of `slots` bits, a power of two."""
    return F.array(*[F.xxhash64(F.lit(i), *keys).bitwiseAND(slots - 1) for i in range(HASHES)])


def _seen(rows: Observation) -> int:
    """The number n of observed rows. Spark tells of none where the rows turned out to be none and their steps were left out: so no
    shuffle may stand between the observed rows and the write, as an empty one would take them along."""
    try:
        return rows.get["n"]
    except Py4JJavaError:
        return 0


class Store:
    """Tables under root; schemas: table -> DDL; keys: table -> the columns that name a row. A table without keys may have
    columns in clustered, by which its rows are laid out. derived: table -> columns that aren't stored, with the SQL that makes them of stored ones; in_order: table -> columns
    by which a file's rows are sorted, where they aren't the keys. An unknown or empty table reads as empty."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, list[str]] | None = None, clustered: dict[str, list[str]] | None = None, upgrades: Upgrades | None = None, derived: dict[str, dict[str, str]] | None = None, in_order: dict[str, list[str]] | None = None):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self.keys, self.clustered, self.upgrades, self.derived, self.in_order = keys or {}, clustered or {}, upgrades or {}, derived or {}, in_order or {}
        self.log, self._old = Log(spark, self.root), None
        if any(f["format"] > VERSION for f in self.state().files.values()):
            raise ValueError("the store is of a newer version")

    def state(self) -> State:
        """The live files; of a store of version 1, those of the batches that its markers name."""
        state = self.log.state()
        if state.version >= 0:
            return state
        if self._old is None:
            self._old = self._first_format()
        return State(-1, self._old)

    def _first_format(self) -> dict[str, dict]:
        if not self.log.files.names(f"{self.root}/_commits"):
            return {}
        markers = self.spark.read.schema("batch string, version int").parquet(f"{self.root}/_commits").collect()  # stores of this version are small
        out = {}
        for table in self.schemas:
            for m in markers:
                folder = f"{table}/batch={m.batch}"
                out |= {f"{folder}/{n}": {"table": table, "format": m.version, "rows": None} for n in self.log.files.names(f"{self.root}/{folder}") if n.endswith(".parquet")}
        return out

    # Reading

    def _schema(self, table: str) -> StructType:
        return StructType.fromDDL(self.schemas[table])

    def _stored(self, table: str, paths: list[str], derived: dict[str, str], *extra: Column) -> DataFrame:
        """Rows of files of the present format, with their derived columns."""
        schema = StructType([f for f in self._schema(table) if f.name not in derived])
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths]).select("*", *extra)
        return rows.withColumns({c: F.expr(e) for c, e in derived.items()}) if derived else rows

    def _present(self, table: str, paths: list[str], format_: int, derived: dict[str, str], extra: list[Column]) -> DataFrame:
        """Rows of files of one format, as they are now: columns that a format lacks are null."""
        steps = [(v, self.upgrades[v][table]) for v in range(format_, VERSION) if table in self.upgrades.get(v, {})]
        if steps:
            rows = self.spark.read.schema(StructType.fromDDL(steps[0][1][0])).parquet(*[f"{self.root}/{p}" for p in paths]).select("*", *extra)
        else:
            rows = self._stored(table, paths, derived, *extra)
        for _, (_, step) in steps:
            rows = step(rows)
        names = [f.name for f in self._schema(table)]
        cols = [(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self._schema(table)]
        return rows.select(*cols, *[c for c in rows.columns if c not in names and c.startswith("_")])

    def _rows(self, table: str, files: dict[str, dict], placed: bool = False) -> DataFrame:
        """The visible rows of some files; placed: with _file and _row, the file's name and the row's place."""
        place = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")]
        parts = []
        for format_, derived in sorted({(f["format"], tuple(f.get("derived", {}).items())) for f in files.values()}):
            for hidden in (False, True):
                paths = [p for p, f in files.items() if f["format"] == format_ and tuple(f.get("derived", {}).items()) == derived and bool(f.get("hidden")) == hidden]
                if not paths:
                    continue
                rows = self._present(table, paths, format_, dict(derived), place if hidden or placed else [])
                if hidden:
                    folders = sorted({h for p in paths for h in files[p]["hidden"]})
                    gone = self.spark.read.schema("_file string, _row bigint").parquet(*[f"{self.root}/{h}" for h in folders])
                    rows = rows.join(gone, ["_file", "_row"], "left_anti")
                parts.append(rows.select(*self._schema(table).names, *(["_file", "_row"] if placed else [])))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self._schema(table))

    def read(self, table: str, state: State | None = None) -> DataFrame:
        return self._rows(table, (state or self.state()).of(table))

    def rows(self, table: str, staged: Staged) -> DataFrame:
        """A table's rows of what was staged."""
        return self._rows(table, {p: f for p, f in staged.files.items() if f["table"] == table})

    def small(self, table: str, rows: DataFrame, state: State | None = None) -> DataFrame:
        """rows, one for each of the table at most, to be broadcast where the log says that they are few."""
        n = [f["rows"] for f in (state or self.state()).of(table).values()]
        return F.broadcast(rows) if None not in n and sum(n) <= SMALL else rows

    def lookup(self, table: str, value: str, state: State | None = None) -> DataFrame:
        """The rows whose first key, or first clustering column, has this value: only files whose range holds it are opened."""
        column = (self.keys.get(table) or self.clustered[table])[0]
        files = {p: f for p, f in (state or self.state()).of(table).items() if f.get("low") is None or f["low"] <= value <= f["high"]}
        return self._rows(table, files).where(F.col(column) == value)

    def candidates(self, table: str, keys: DataFrame, state: State | None = None) -> dict[str, dict]:
        """The live files that may hold one of the keys: files without a filter, and those whose filter has all bits of one."""
        files, names = (state or self.state()).of(table), self.keys[table]
        known = {p: f for p, f in files.items() if f.get("index")}
        if not known:
            return files
        sizes = F.array(*[F.lit(s).cast("long") for s in sorted({f["slots"] for f in known.values()})])  # powers of two: a few
        bits = keys.select(*names).distinct().withColumn("slots", F.explode(sizes)).select(F.xxhash64(*names).alias("k"), "slots", F.explode(_places(names, F.col("slots"))).alias("bit"))
        bits = bits.select("k", "slots", F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, CAST(bit & 63 AS INT))").alias("mask")).groupBy("k", "slots", "word").agg(F.bit_or("mask").alias("mask"))
        words = bits.groupBy("k", "slots").agg(F.count("*").alias("words"))
        index = self.spark.read.schema("table string, file string, slots long, word long, bits long").parquet(*[f"{self.root}/{i}" for i in sorted({f["index"] for f in known.values()})])
        hits = index.where(F.col("table") == table).join(bits, ["slots", "word"]).where(F.expr("bits & mask = mask")).groupBy("file", "k", "slots").agg(F.count("*").alias("words"))
        found = {r.file for r in hits.join(words, ["k", "slots", "words"]).select("file").distinct().collect()}  # at most the live files
        return {p: f for p, f in files.items() if p not in known or p.rsplit("/", 1)[-1] in found}

    def absent(self, table: str, rows: DataFrame, state: State | None = None) -> DataFrame:
        """rows whose key the table doesn't have. Of a large table only candidates' keys are read."""
        state, keys = state or self.state(), self.keys[table]
        files = state.of(table)
        if len(files) > 1 and sum(f["rows"] or SMALL for f in files.values()) > SMALL:
            files = self.candidates(table, rows, state)
        return rows.join(self._rows(table, files).select(*keys), keys, "left_anti") if files else rows

    # Writing

    def _order(self, table: str) -> list[str] | None:
        return self.in_order.get(table) or self.clustered.get(table) or self.keys.get(table)

    def _files(self, table: str, rows: DataFrame, in_place: bool = False) -> str:
        """The folder of laid out rows; in_place: they are in order too."""
        folder, order = f"{table}/{uuid.uuid4().hex}", None if in_place else self._order(table)
        rows = rows.sortWithinPartitions(*order) if order else rows
        rows.drop(*self.derived.get(table, ())).write.options(**COLUMNS).parquet(f"{self.root}/{folder}")
        return folder

    def _written(self, table: str, rows: DataFrame, in_place: bool = False) -> str:
        """The folder of rows, cast to the table's columns: missing ones are null, others go. in_place: each of their partitions is as a file has to be."""
        cols = [(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self._schema(table)]
        out = rows.select(*cols)
        if in_place:
            return self._files(table, out, True)
        if table in self.clustered:
            out = out.repartitionByRange(*self.clustered[table])
        elif not self._order(table):
            out = out.hint("rebalance")  # few files of a good size; keyed rows come from a shuffle of their own
        return self._files(table, out)

    def _described(self, folders: dict[str, str]) -> dict[str, dict]:
        """What the log says of the files of new folders, empty ones left out; keyed tables' files get filters."""
        first = lambda t: (self.keys.get(t) or self.clustered.get(t) or [None])[0]
        keyed = {t: f for t, f in folders.items() if t in self.keys}

        def names(t: str, *cols: Column) -> DataFrame:
            return self._stored(t, [folders[t]], self.derived.get(t, {}), F.col("_metadata.file_name").alias("_name")).select(F.lit(t).alias("table"), F.col("_name").alias("file"), *cols)

        # A key that is made of other columns lies in no order: a file with many has no range worth making them all for.
        made = lambda t: first(t) in self.derived.get(t, {})
        ranged = lambda t: F.col(first(t)).cast("string") if first(t) and not made(t) else F.lit(None).cast("string")
        ends = F.count("*").alias("rows"), F.min("k").alias("low"), F.max("k").alias("high")
        found = reduce(DataFrame.unionByName, [names(t, ranged(t).alias("k")) for t in folders]).groupBy("table", "file").agg(*ends).collect()  # a row a new file
        out = {f"{folders[r.table]}/{r.file}": {"table": r.table, "format": VERSION, "rows": r.rows, "low": r.low, "high": r.high} | ({"derived": self.derived[r.table]} if r.table in self.derived else {}) for r in found}
        few = {p: f for p, f in out.items() if made(f["table"]) and f["rows"] < FILTERED}
        if few:
            keys = [self._stored(t, of, self.derived[t], F.col("_metadata.file_name").alias("file")).select("file", F.col(first(t)).cast("string").alias("k")) for t in folders if (of := [p for p, f in few.items() if f["table"] == t])]
            least = {r.file: r for r in reduce(DataFrame.unionByName, keys).groupBy("file").agg(*ends).collect()}  # as few
            for p, f in few.items():
                f |= {"low": least[p.rsplit("/", 1)[-1]].low, "high": least[p.rsplit("/", 1)[-1]].high}
        if not keyed:
            return out
        slots = {r.file: max(64, 1 << math.ceil(math.log2(BITS * r.rows))) for r in found if r.table in keyed and r.rows >= FILTERED}
        keyed = {t: f for t, f in keyed.items() if any(r.table == t and r.file in slots for r in found)}
        if slots:
            index = f"_index/{uuid.uuid4().hex}"
            files = [(f, t, slots[f], i) for i, (f, t) in enumerate(sorted((r.file, r.table) for r in found if r.file in slots))]
            sizes = F.broadcast(self.spark.createDataFrame(files, "file string, table string, slots long, id int"))
            # Files go by numbers while bits are brought together.
            each = [names(t, *map(F.col, self.keys[t])).join(sizes.select("file", "slots", "id"), "file").select("id", F.explode(_places(self.keys[t], F.col("slots"))).alias("bit")) for t in keyed]
            words = reduce(DataFrame.unionByName, each).groupBy("id", F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits"))
            words = words.join(sizes, "id").select("table", "file", "slots", "word", "bits")
            words.repartition(max(1, sum(slots.values()) >> 26), "table", "file").sortWithinPartitions("table", "word").write.options(**COLUMNS).parquet(f"{self.root}/{index}")
            for p, f in out.items():
                if (name := p.rsplit("/", 1)[-1]) in slots:
                    f |= {"slots": slots[name], "index": index}
        return out

    def _append(self, entry: dict, read: State | None, writes: set[str]) -> int:
        """Gives the entry the next number. What came after read must not have touched keyed tables that this writes, nor
        files that it removes or hides."""
        while True:
            state = self.state()
            if state.version < 0:
                entry = entry | {"add": {p: f for p, f in state.files.items() if p not in entry.get("remove", ())} | entry.get("add", {})}
            if read is not None and state.version > read.version:
                for _, other in self.log.entries(read.version):
                    touched = {f["table"] for f in other.get("add", {}).values()}
                    if touched & writes & set(self.keys):
                        raise Conflict(f"other rows came into {sorted(touched & writes & set(self.keys))}")
            if not {*entry.get("remove", ()), *entry.get("hide", {})} <= set(state.files):
                raise Conflict("files that are to go are gone")
            if self.log.append(state.version + 1, entry):
                return state.version + 1

    def stage(self, in_place: set[str] = frozenset(), **tables: DataFrame) -> Staged:
        """Rows of tables, written and described and not yet seen: commit() shows them. in_place: tables whose rows are laid out already."""
        with ThreadPoolExecutor(WRITERS) as pool:  # small tables take longer to plan than to write
            folders = dict(zip(tables, pool.map(self._written, tables, tables.values(), [t in in_place for t in tables]), strict=True))
        return Staged(set(tables), self._described(folders) if folders else {})

    def commit(self, read: State | None = None, counters: dict[str, list[Observation]] | None = None, staged: Staged | None = None, **tables: DataFrame) -> int:
        """Appends to all the tables, and what is staged, or, if anything fails, to none; the version it has then. read: the state that
        rows were made from; if another commit has since added to a keyed table of these, Conflict is raised and nothing is seen. counters: observed
        numbers n of the rows that were offered to a table, of which the writing jobs tell."""
        staged = (staged or Staged()) | self.stage(**tables)
        entry = {"add": staged.files, "tables": sorted(staged.tables)}
        if counters:
            entry["counters"] = {name: sum(map(_seen, seen)) for name, seen in counters.items() if name in staged.tables}
        return self._append(entry, read, staged.tables)

    def delete(self, table: str, condition: Column, read: State | None = None) -> int:
        """Hides the rows of a table for which condition holds; their files stay as they are."""
        state = read or self.state()
        files, folder = state.of(table), f"_hidden/{uuid.uuid4().hex}"
        self._rows(table, files, placed=True).where(condition).select("_file", "_row").write.parquet(f"{self.root}/{folder}")
        hit = {r[0] for r in self.spark.read.schema("_file string, _row bigint").parquet(f"{self.root}/{folder}").select("_file").distinct().collect()}  # at most the live files
        return self._append({"hide": {p: folder for p in files if p.rsplit("/", 1)[-1] in hit}}, state, set())

    def compact(self, table: str, rows: int = FILE_ROWS) -> int:
        """Small files of a table, and those with hidden rows or of an older format, as files of about `rows` rows in the order of the keys."""
        state = self.state()
        small = {p: f for p, f in state.of(table).items() if f["rows"] is None or f["rows"] < rows // 2 or f.get("hidden") or f["format"] < VERSION}
        if len(small) < 2 and not any(f.get("hidden") or f["format"] < VERSION for f in small.values()):
            return state.version
        found = self._rows(table, small)
        n = max(1, math.ceil(sum(f["rows"] or rows for f in small.values()) / rows))
        order = self._order(table)
        folder = self._files(table, found.repartitionByRange(n, *order) if order else found.repartition(n))
        return self._append({"add": self._described({table: folder}), "remove": sorted(small)}, None, set())

    def history(self) -> DataFrame:
        """(version, table, new, deduplicated) of each commit that counted."""
        rows = []
        for v, e in self.log.entries(-1):
            for table, offered in e.get("counters", {}).items():
                new = sum(f["rows"] or 0 for f in e.get("add", {}).values() if f["table"] == table)
                rows.append((v, table, new, offered - new))
        return self.spark.createDataFrame(rows, "version long, table string, new long, deduplicated long")


def snapshot(path: str, per_run: tuple[str, ...] = (), **sections: DataFrame) -> None:
    """Each section as a folder of JSON lines; sections named in per_run have a folder for each execution_hash."""
    for name, df in sections.items():
        out = df.write.mode("overwrite")
        (out.partitionBy("execution_hash") if name in per_run else out).json(f"{path}/{name}")


class Snapshot:
    """A snapshot()'s folders as a store's tables: what reads a Store by read() reads it too."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas
        self._there = set(Files(spark).names(self.path))

    def read(self, table: str, state: State | None = None) -> DataFrame:
        """A table's rows; empty for a folder that isn't there. Columns that it lacks are null."""
        schema = StructType.fromDDL(self.schemas[table])
        if table not in self._there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/{table}").select(*schema.names)

    def run(self, table: str, execution_hash: str) -> DataFrame:
        """One run's rows of a section that has a folder for each run: only that folder is read."""
        return self.read(table).where(F.col("execution_hash") == execution_hash)


def write_residuals(rows: DataFrame, path: str) -> None:
    """Residual rows, a folder for each residual_set_id; sets that are there already are replaced, others stay. Missing columns
    are null, unknown ones go."""
    schema = StructType.fromDDL(RESIDUAL)
    cols = [(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    rows.select(*cols).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("residual_set_id").parquet(path)


def residual_set(spark: SparkSession, path: str, residual_set_id: str) -> DataFrame:
    """The rows of one set: only its folder is read."""
    return spark.read.schema(RESIDUAL).parquet(path).where(F.col("residual_set_id") == residual_set_id)


def audit_copy(manifests: DataFrame, path: str) -> None:
    """manifests(export_hash, text) as canonical JSON, one row for each export hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([canonical_json(json.loads(t)) for t in b.column(1).to_pylist()], pa.string())], names=["export_hash", "text"])

    once = manifests.where("export_hash IS NOT NULL AND text IS NOT NULL").groupBy("export_hash").agg(F.min("text").alias("text"))
    once.mapInArrow(run, "export_hash string, text string").write.mode("append").option("compression", "zstd").parquet(path)


def select(spark: SparkSession, text: str, views: dict[str, DataFrame], **values) -> DataFrame:
    """A SQL query with named parameters over views: values are bound, never put into the text."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=values)
