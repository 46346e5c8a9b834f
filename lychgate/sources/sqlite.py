"""SQLite tables as Spark data sources, read-only: rows by ranges of their ids, and ordered samples of columns.

`sqlite` reads named columns of a table as text, a range of row ids a task; what Spark filters by is asked of the database too.
`sqlite_sample` has the database itself order a column and end after the first values, a column a task.
"""

from __future__ import annotations

import hashlib
import json
import sqlite3
from collections.abc import Iterable, Iterator
from urllib.parse import quote

from pyspark.sql import datasource as api
from pyspark.sql.types import StringType, StructField, StructType

ROWS_PER_PART = 100_000
SAMPLE_SCHEMA = "column string, pos long, value string"


def as_text(v: object) -> str | None:
    return None if v is None else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


def connect(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    db.create_function("gate_text", 1, as_text, deterministic=True)
    db.create_function("gate_sha256", 1, lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest(), deterministic=True)
    return db


def identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite_tables(path: str) -> list[str]:
    """User tables by name."""
    with connect(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]


def sqlite_columns(path: str, table: str) -> list[str]:
    with connect(path) as db:
        return [r[1] for r in db.execute(f"PRAGMA table_info({identifier(table)})")]


class Rows(api.InputPartition):
    """Row ids from first to last; all rows, if there are none."""

    def __init__(self, first: int | None = None, last: int | None = None):
        self.first, self.last = first, last


COMPARED = {api.EqualTo: "=", api.GreaterThan: ">", api.GreaterThanOrEqual: ">=", api.LessThan: "<", api.LessThanOrEqual: "<="}


def condition(f: api.Filter) -> tuple[str, list] | None:
    """A test that holds wherever the filter does. Numbers with a fraction and blobs are written otherwise by SQLite than by Python, so
    those rows pass, and Spark tests all rows again."""
    if isinstance(f, api.Not):
        inner = f.child
        return (f"{identifier(inner.attribute[0])} IS NOT NULL", []) if isinstance(inner, api.IsNull) and len(inner.attribute) == 1 else None
    if len(f.attribute) != 1:
        return None
    name = identifier(f.attribute[0])
    if isinstance(f, api.IsNull | api.IsNotNull):
        return f"{name} IS {'NOT ' * isinstance(f, api.IsNotNull)}NULL", []
    text, loose = f"CAST({name} AS TEXT)", f"typeof({name}) IN ('real', 'blob')"
    if isinstance(f, api.In):
        values = list(f.value)
        return (f"({loose} OR {text} IN ({', '.join('?' * len(values))}))", values) if all(isinstance(v, str) for v in values) else None
    if isinstance(f, api.StringStartsWith):
        return f"({loose} OR substr({text}, 1, {len(f.value)}) = ?)", [f.value]
    if type(f) in COMPARED and isinstance(f.value, str):
        return f"({loose} OR {text} {COMPARED[type(f)]} ? COLLATE BINARY)", [f.value]
    return None


class SqliteReader(api.DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str]):
        self.path, self.table, self.columns = path, table, columns
        self.tests: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[api.Filter]) -> Iterable[api.Filter]:
        for f in filters:
            if test := condition(f):
                self.tests.append(test)
            yield f

    def partitions(self) -> list[Rows]:
        """Ranges of row ids of about ROWS_PER_PART rows each; a table without row ids is read by one task."""
        with connect(self.path) as db:
            try:
                n, low, high = db.execute(f"SELECT count(*), min(rowid), max(rowid) FROM {identifier(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [Rows()]
        if not n:
            return [Rows()]
        parts = -(-n // ROWS_PER_PART)
        cuts = [low + (high - low + 1) * k // parts for k in range(parts + 1)]
        return [Rows(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)]

    def query(self, part: Rows) -> tuple[str, list]:
        tests = [*self.tests, *([("rowid BETWEEN ? AND ?", [part.first, part.last])] if part.first is not None else [])]
        where = f" WHERE {' AND '.join(t for t, _ in tests)}" if tests else ""
        return f"SELECT {', '.join(map(identifier, self.columns))} FROM {identifier(self.table)}{where}", [v for _, values in tests for v in values]

    def read(self, partition: Rows) -> Iterator[tuple]:
        with connect(self.path) as db:
            for row in db.execute(*self.query(partition)):
                yield tuple(map(as_text, row))


class SqliteSource(api.DataSource):
    """spark.read.format("sqlite").options(path=..., table=..., columns='["a", "b"]'): the named columns (else all) as text."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        wanted = self.options.get("columns")
        return StructType([StructField(c, StringType()) for c in (json.loads(wanted) if wanted else sqlite_columns(self.options["path"], self.options["table"]))])

    def reader(self, schema: StructType) -> api.DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], schema.names)


class Column(api.InputPartition):
    def __init__(self, name: str):
        self.name = name


class SampleReader(api.DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], limit: int):
        self.path, self.table, self.columns, self.limit = path, table, columns, limit

    def partitions(self) -> list[Column]:
        return [Column(c) for c in self.columns]

    def read(self, partition: Column) -> Iterator[tuple]:
        text = f"gate_text({identifier(partition.name)})"
        query = f"SELECT v FROM (SELECT {text} AS v FROM {identifier(self.table)}) ORDER BY v IS NULL, gate_sha256(v), length(CAST(v AS BLOB)), hex(v) LIMIT ?"
        with connect(self.path) as db:
            for pos, (value,) in enumerate(db.execute(query, (self.limit,))):
                yield partition.name, pos, value


class SqliteSample(api.DataSource):
    """spark.read.format("sqlite_sample").options(path=..., table=..., limit=...): (column, pos, value), the first values of each column
    in the order of router.hash_order."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_sample"

    def schema(self) -> str:
        return SAMPLE_SCHEMA

    def reader(self, schema: StructType) -> api.DataSourceReader:
        path, table = self.options["path"], self.options["table"]
        return SampleReader(path, table, sqlite_columns(path, table), int(self.options["limit"]))
