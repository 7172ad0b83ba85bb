"""Graph tables in SQLite files, in and out, as a Spark data source.

    read(spark, path, "nodes"), selected(spark, path, "nodes", "type_id = 'DOC' and not deprecated"), write(rows, folder, "nodes")

A path is one file or a folder of files (`*.db`). SQLite reads pages at random, so files must lie in a folder that all
machines mount; other stores are refused.

Reading: a table is cut into ranges of rowids. `selected` has filters on ids, types, numbers and deprecation pushed into each
range's SQL, where the indexes serve them; a file that can't hold a wanted type is never opened where the folder's manifest knows
its types, and otherwise asked for the rowids of its matching rows before any task starts.
Writing: each task makes a file of its own, with all tables and indexes, of which one holds its rows. Files get their
names when the job commits, together with the manifest; those of failed or repeated attempts are removed.

Cases: a table that a file lacks has no rows; null, malformed or empty JSON lists are empty lists; times with a zone
are UTC's, without one they are taken as they are, malformed ones are null; a null or empty embedding is null.
"""

from __future__ import annotations

import glob
import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .store import TABLES

FORMAT, MANIFEST, ROWS = "graph_sqlite", "_manifest.json", 100_000
#: Rows that a reader hands over at once.
LOT = 5_000

# The file's tables, as other programs expect them.
DDL = """
create table if not exists provenance (id text primary key, source_type text not null, source_uri text not null, extracted_by text not null, extracted_at text not null, raw_content_id text, pipeline_run_id text, trust_level text not null default 'unverified');
create table if not exists contents (id text primary key, format text not null, data blob not null, hash text not null, encoding text not null default 'utf-8', source_uri text, extracted_at text not null, chunks text not null default '[]');
create table if not exists nodes (id text primary key, type_id text not null, label text not null, embedding blob, properties text not null default '{}', content_ref text, confidence real not null default 0.9, version integer not null default 1, created_at text not null, updated_at text not null, valid_until text, deprecated integer not null default 0, provenance_id text not null references provenance(id));
create table if not exists edges (id text primary key, source text not null references nodes(id), target text not null references nodes(id), type_id text not null, weight real not null default 1.0, confidence real not null default 0.9, directional integer not null default 1, version integer not null default 1, valid_until text, deprecated integer not null default 0, provenance_id text not null references provenance(id), created_at text not null);
create table if not exists uncertainty (node_id text primary key references nodes(id), confidence real not null, coverage real not null, freshness_score real not null, contradiction_set text not null default '[]', last_verified text not null);
create table if not exists assertions (id text primary key, claim text not null, source_node_ids text not null, confidence real not null, created_at text not null, plan_step_id text);
create index if not exists idx_nodes_type on nodes(type_id);
create index if not exists idx_nodes_label on nodes(label);
create index if not exists idx_nodes_dep on nodes(deprecated);
create index if not exists idx_edges_src on edges(source, type_id, deprecated);
create index if not exists idx_edges_tgt on edges(target, type_id, deprecated);
"""

COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def kinds_of(table: str) -> dict[str, str]:
    """Column names and their Spark types."""
    return dict(c.split(None, 1) for c in TABLES[table][0].split(", "))


def local(path: str) -> str:
    """A path that SQLite can open."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" and rest:
        return "/" + rest.lstrip("/")
    if "://" in path:
        raise ValueError(f"SQLite files must lie in a mounted folder, not in {path}")
    return path


def files_of(path: str) -> list[str]:
    return sorted(glob.glob(f"{glob.escape(path)}/*.db")) if os.path.isdir(path) else [path]


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


# Values of either side.


def moment(value: str | None) -> datetime | None:
    try:
        at = datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return None
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def listed(value: str | None) -> list[str]:
    try:
        found = json.loads(value)
    except (TypeError, ValueError):
        return []
    return [x if isinstance(x, str) else json.dumps(x) for x in found] if isinstance(found, list) else []


def floats(value: bytes | None) -> list[float] | None:
    import numpy as np

    return np.frombuffer(value[: len(value) // 4 * 4], "<f4").tolist() or None if value else None


def octets(value) -> bytes | None:
    return value.encode() if isinstance(value, str) else value


FROM_FILE = {"timestamp_ntz": moment, "array<string>": listed, "array<float>": floats, "boolean": lambda v: None if v is None else bool(v), "binary": octets}


def to_file(kind: str, name: str, value):
    import numpy as np

    if kind == "array<float>":
        return np.asarray(value or [], "<f4").tobytes()
    if kind == "array<string>":
        return json.dumps(value or [])
    if kind == "timestamp_ntz":
        return value.replace(tzinfo=timezone.utc).isoformat() if value is not None else None
    return "{}" if name == "properties" and value is None else value


# Reading


@dataclass
class RowidRange(InputPartition):
    path: str
    low: int
    high: int

    def __post_init__(self):
        self.value = (self.path, self.low, self.high)


class Reader(DataSourceReader):
    def __init__(self, table: str, path: str, rows: int):
        self.table, self.path, self.rows = table, path, rows
        self.kinds = kinds_of(table)
        self.terms: list[str] = []
        self.values: list = []
        self.types: set[str] | None = None

    def term(self, f: Filter) -> tuple[str, list] | None:
        """A filter as a condition in SQL with its values, if SQLite means the same by it."""
        if isinstance(f, Not):
            inner = self.term(f.child)
            return inner and (f"not ({inner[0]})", inner[1])
        if not isinstance(f, (*COMPARED, In)) or len(f.attribute) != 1:
            return None
        kind, some = self.kinds.get(f.attribute[0]), list(f.value) if isinstance(f, In) else [f.value]
        sound = {"string": str, "boolean": bool, "int": int, "double": (int, float)}
        if kind not in sound or (isinstance(f, In) and len(some) > 500) or not all(isinstance(v, sound[kind]) and v == v for v in some):
            return None
        name = f.attribute[0]
        return (f"{name} in ({', '.join('?' * len(some))})" if isinstance(f, In) else f"{name} {COMPARED[type(f)]} ?", some)

    def where(self, *more: str) -> str:
        return " where " + " and ".join((*self.terms, *more, "true"))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        folder = self.path if os.path.isdir(self.path) else os.path.dirname(self.path)
        known = manifest(folder)["files"]
        for path in files_of(self.path):
            low, high = 1, None
            about = known.get(os.path.basename(path))
            if about:
                if about["table"] != self.table or (self.types is not None and about["types"] is not None and not self.types & set(about["types"])):
                    continue
                high = about["rows"]
            else:
                c = opened(path)
                if c.execute("select 1 from sqlite_master where type = 'table' and name = ?", (self.table,)).fetchone():
                    low, high = c.execute(f"select min(rowid), max(rowid) from {self.table}{self.where()}", self.values).fetchone()
                c.close()
            if high:
                out += [RowidRange(path, k, min(k + self.rows - 1, high)) for k in range(low, high + 1, self.rows)]
        return out or [RowidRange("", 1, 0)]

    def read(self, partition: RowidRange):
        import pyarrow as pa

        arrow = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "timestamp_ntz": pa.timestamp("us"), "array<float>": pa.list_(pa.float32()), "array<string>": pa.list_(pa.string())}
        if not partition.path:
            return
        c = opened(partition.path)
        found = c.execute(f"select {', '.join(self.kinds)} from {self.table}{self.where('rowid between ? and ?')}", [*self.values, partition.low, partition.high])
        while rows := found.fetchmany(LOT):
            columns = [[FROM_FILE[kind](v) for v in column] if kind in FROM_FILE else column for kind, column in zip(self.kinds.values(), zip(*rows))]
            yield pa.RecordBatch.from_arrays([pa.array(x, arrow[kind]) for x, kind in zip(columns, self.kinds.values())], names=list(self.kinds))
        c.close()


class FilteringReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            term = self.term(f)
            if term is None:
                yield f
                continue
            self.terms.append(term[0])
            self.values += term[1]
            if isinstance(f, (EqualTo, In)) and f.attribute == ("type_id",):
                self.types = set(term[1]) if self.types is None else self.types & set(term[1])


# Writing


def manifest(folder: str) -> dict:
    """files: a written file's name to its table, rows, and types (null where it has too many or none)."""
    try:
        with open(f"{folder}/{MANIFEST}", encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {"files": {}}


@dataclass
class Written(WriterCommitMessage):
    path: str
    table: str
    rows: int
    types: list[str] | None


class Writer(DataSourceArrowWriter):
    #: Most types that a file's entry in the manifest names.
    KINDS = 1000

    def __init__(self, table: str, folder: str, overwrite: bool):
        self.table, self.folder, self.overwrite = table, folder, overwrite
        self.kinds = kinds_of(table)
        self.job = uuid.uuid4().hex
        os.makedirs(f"{folder}/_{self.job}", exist_ok=True)

    def write(self, iterator) -> WriterCommitMessage:
        path, rows, types = f"{self.folder}/_{self.job}/{uuid.uuid4().hex}.db", 0, set()
        c = sqlite3.connect(path, isolation_level=None)
        c.executescript("pragma journal_mode = off; pragma synchronous = off;" + DDL + "begin;")
        names = list(self.kinds)
        insert = f"insert into {self.table} ({', '.join(names)}) values ({', '.join('?' * len(names))})"
        for b in iterator:
            columns = [[to_file(kind, n, v) for v in b.column(b.schema.get_field_index(n)).to_pylist()] for n, kind in self.kinds.items()]
            c.executemany(insert, zip(*columns))
            rows += b.num_rows
            if "type_id" in names and len(types) <= self.KINDS:
                types |= set(columns[names.index("type_id")])
        c.execute("commit")
        c.close()
        return Written(path, self.table, rows, sorted(types) if "type_id" in names and len(types) <= self.KINDS else None)

    def commit(self, messages) -> None:
        about = manifest(self.folder)
        old = [n for n, x in about["files"].items() if x["table"] == self.table] if self.overwrite else []
        for n in old:
            del about["files"][n]
        for k, m in enumerate(x for x in messages if x is not None and x.rows):
            name = f"{self.table}-{self.job}-{k:05}.db"
            os.replace(m.path, f"{self.folder}/{name}")
            about["files"][name] = {"table": m.table, "rows": m.rows, "types": m.types}
        with open(f"{self.folder}/_{self.job}/{MANIFEST}", "w", encoding="utf-8") as f:
            json.dump(about, f)
        os.replace(f"{self.folder}/_{self.job}/{MANIFEST}", f"{self.folder}/{MANIFEST}")
        for n in old:
            os.remove(f"{self.folder}/{n}")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        for left in os.listdir(f"{self.folder}/_{self.job}"):
            os.remove(f"{self.folder}/_{self.job}/{left}")
        os.rmdir(f"{self.folder}/_{self.job}")


class GraphSQLite(DataSource):
    """Options: path, table (nodes unless given), rowsPerPartition, filters (`pushed`: see selected)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    @property
    def table(self) -> str:
        table = self.options.get("table", "nodes")
        if table not in TABLES:
            raise ValueError(f"no table {table}; there are {', '.join(TABLES)}")
        return table

    def schema(self) -> str:
        return TABLES[self.table][0]

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = FilteringReader if self.options.get("filters") == "pushed" else Reader
        return kind(self.table, local(self.options["path"]), int(self.options.get("rowsPerPartition", ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.table, local(self.options["path"]), overwrite)


def read(spark: SparkSession, path: str, table: str = "nodes", rows: int = ROWS) -> DataFrame:
    """A table's rows. Filters are applied after reading."""
    spark.dataSource.register(GraphSQLite)
    return _reading(spark, table, rows).load(path)


def _reading(spark: SparkSession, table: str, rows: int) -> DataFrameReader:
    return spark.read.format(FORMAT).option("table", table).option("rowsPerPartition", rows)


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def selected(spark: SparkSession, path: str, table: str, condition: Column | str, rows: int = ROWS) -> DataFrame:
    """A table's rows that fulfil a condition, which is pushed into the source.

    A relation of a Python data source keeps the filters of the plan that pushed last, also for other plans over it
    (in Spark 4.1), so two filters on one would mix. Hence this relation is its own, is planned here once with
    pushdown on, and later without: what it keeps is the condition that its rows are filtered by anyway.
    """
    spark.dataSource.register(GraphSQLite)
    out = _reading(spark, table, rows).option("filters", "pushed").load(path).where(condition)
    before = spark.conf.get(PUSHDOWN, "false")
    spark.conf.set(PUSHDOWN, "true")
    try:
        out.inputFiles()  # has it planned
    finally:
        spark.conf.set(PUSHDOWN, before)
    return out


def write(rows: DataFrame, folder: str, table: str = "nodes", mode: str = "append") -> None:
    """rows of a graph's table as files of a folder; columns that they lack are null."""
    rows.sparkSession.dataSource.register(GraphSQLite)
    whole = rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in kinds_of(table).items()))
    whole.write.format(FORMAT).option("table", table).mode(mode).save(folder)


def one_file(folder: str, path: str) -> None:
    """All tables of a folder's files in one new file, copied by SQLite row by row: as big as one such file may be."""
    c = sqlite3.connect(path, isolation_level=None)
    c.executescript(DDL)
    for name in manifest(folder)["files"]:
        c.execute("attach ? as part", (f"{folder}/{name}",))
        for table in TABLES:
            c.execute(f"insert into main.{table} select * from part.{table}")
        c.execute("detach part")
    c.close()
