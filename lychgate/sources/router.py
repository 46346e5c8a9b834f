"""Opening sources by their address, and deterministic samples of columns."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.profile import texts
from .sqlite import SqliteSample, SqliteSource, sqlite_tables

FILES = {".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}
# The shapes of identifiers in an analytics warehouse, and options of a MySQL address.
PROJECT = r"[a-z][a-z0-9-]{4,28}[a-z0-9]"
BIGQUERY = {"project": rf"(?:{PROJECT}|[a-z0-9][a-z0-9.-]*\.[a-z]{{2,}}:{PROJECT})", "dataset": r"[A-Za-z_][A-Za-z0-9_]*", "table": r"[A-Za-z0-9_]+", "column": r"[A-Za-z_][A-Za-z0-9_]*"}
_FLAG = ({"true": True, "false": False}.get, "true or false")
#: name: default, how a value is read (null if it is none), what it must be
MYSQL_OPTIONS = {
    "ssl_ca": (None, lambda v: v or None, "one path"),
    "ssl_verify_cert": (True, lambda v: _FLAG[0](v.lower()), _FLAG[1]),
    "ssl_verify_identity": (True, lambda v: _FLAG[0](v.lower()), _FLAG[1]),
}
MYSQL_PASSWORD = "LYCHGATE_MYSQL_PASSWORD"


@dataclass(frozen=True)
class Place:
    """What may be told of an address: its kind, where it leads and whether it had more that is kept back."""

    kind: str = ""
    host: str = ""
    path: str = ""
    hidden: bool = False

    @classmethod
    def of(cls, address: str) -> Place:
        try:
            parts = urlsplit(address)
            host = f"{parts.hostname or ''}{f':{parts.port}' if parts.port else ''}"
        except ValueError:
            return cls(hidden=True)
        hidden = bool(parts.username or parts.password or parts.query or parts.fragment)
        if parts.scheme and not parts.netloc or "@" in parts.path:
            return cls(parts.scheme, hidden=True)
        return cls(parts.scheme, host, parts.path, hidden)

    def __str__(self) -> str:
        told = f"{self.kind}://{self.host}{self.path}" if self.host else f"{self.kind}:" if self.kind else self.path
        return f"{told} (withheld)".strip() if self.hidden or not told else told


def safe_address(address: str) -> str:
    """An address for error texts, without what may be secret."""
    return str(Place.of(address))


def postgres_options(address: str) -> dict[str, str]:
    """Options of Spark's JDBC reader; the server's certificate must be verified against a named authority."""
    parts = urlsplit(address)
    query = parse_qs(parts.query, keep_blank_values=True)
    roots = query.get("sslrootcert", [])
    if query.get("sslmode") != ["verify-full"]:
        raise ValueError("a PostgreSQL address must say sslmode=verify-full")
    if len(roots) != 1 or not roots[0].strip():
        raise ValueError("a PostgreSQL address must name one sslrootcert")
    url = f"jdbc:postgresql://{parts.hostname}:{parts.port or 5432}{parts.path}?sslmode=verify-full&sslrootcert={roots[0]}&readOnly=true"
    return {"url": url, "user": unquote(parts.username or ""), "password": unquote(parts.password or ""), "driver": "org.postgresql.Driver", "sessionInitStatement": "SET default_transaction_read_only = on"}


def mysql_options(address: str, env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Options of Spark's JDBC reader. A password in the address wins, an empty one too; else the environment's, which may not be empty."""
    parts = urlsplit(address)
    database = unquote(parts.path.lstrip("/"))
    if parts.scheme.lower() != "mysql" or not parts.hostname or not database or "/" in database:
        raise ValueError("a MySQL address is mysql://host/database")
    given = parse_qs(parts.query, keep_blank_values=True, strict_parsing=bool(parts.query))
    if strange := sorted(given.keys() - MYSQL_OPTIONS.keys()):
        raise ValueError(f"unknown MySQL options: {', '.join(strange)}")
    options = {}
    for name, (default, read, rule) in MYSQL_OPTIONS.items():
        values = [read(v) for v in given.get(name, [])]
        if len(values) > 1 or None in values:
            raise ValueError(f"{name} must be {rule}, once")
        options[name] = values[0] if values else default
    if parts.password is not None:
        password = unquote(parts.password)
    elif MYSQL_PASSWORD in env and not env[MYSQL_PASSWORD].strip():
        raise ValueError(f"{MYSQL_PASSWORD} is set and empty; unset it to connect without a password")
    else:
        password = env.get(MYSQL_PASSWORD, "")
    mode = ("VERIFY_IDENTITY" if options["ssl_verify_identity"] else "VERIFY_CA") if options["ssl_verify_cert"] else "REQUIRED"
    root = f"&trustCertificateKeyStoreUrl=file:{options['ssl_ca']}&trustCertificateKeyStoreType=PEM" if options["ssl_ca"] else ""
    url = f"jdbc:mysql://{parts.hostname}:{parts.port or 3306}/{database}?sslMode={mode}{root}"
    return {"url": url, "user": unquote(parts.username or ""), "password": password, "driver": "com.mysql.cj.jdbc.Driver", "sessionInitStatement": "SET SESSION TRANSACTION READ ONLY"}


def bigquery_dataset(address: str) -> tuple[str, str]:
    """(project, dataset) of bigquery://project/dataset."""
    if any(c in address for c in "?#@"):
        raise ValueError("a BigQuery address has no user, port, query or fragment")
    found = re.fullmatch(r"(?i:bigquery)://([^/]+)/([^/]+)/?", address)
    if not found or re.search(r":\d+\Z", found[1]):
        raise ValueError("a BigQuery address is bigquery://project/dataset")
    for name, value in zip(("project", "dataset"), found.groups(), strict=True):
        if not re.fullmatch(BIGQUERY[name], value):
            raise ValueError(f"invalid BigQuery {name}")
    return found[1], found[2]


def csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV file with a header, all columns text; a byte order mark is dropped, short rows are filled with nulls. Fields may hold line
    breaks, for which a file is read by one task; without multi_line they may not, and a file is split."""
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', mode="PERMISSIVE", inferSchema=False)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


def inline(spark: SparkSession, columns: Mapping[str, list], table: str = "inline", sample: int | None = None) -> DataFrame:
    """The long form of columns in memory, which may differ in length."""
    rows = [(table, name, k, None if v is None else str(v)) for name, values in columns.items() for k, v in enumerate(values[:sample])]
    return spark.createDataFrame(rows, "table string, column string, pos long, value string")


def bigquery_listing(project: str, dataset: str) -> str:
    return f"SELECT table_name AS name FROM `{project}.{dataset}`.INFORMATION_SCHEMA.TABLES WHERE table_type = 'BASE TABLE'"


def register(spark: SparkSession) -> None:
    """Makes the formats sqlite and sqlite_sample known. Spark hands filters to Python sources only where this option says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(SqliteSample)


def open_source(spark: SparkSession, address: str, table: str | None = None) -> dict[str, DataFrame]:
    """Tables by name. Files of a kind that Spark reads are one table; databases list theirs unless one is named."""
    low = address.lower()
    stem = os.path.splitext(os.path.basename(address.rstrip("/")))[0]
    if low.startswith(("postgres://", "postgresql://", "mysql://")):
        postgres = low.startswith("postgres")
        options = postgres_options(address) if postgres else mysql_options(address)
        schema = "public" if postgres else unquote(urlsplit(address).path.lstrip("/"))
        jdbc = lambda **how: spark.read.format("jdbc").options(**options, **how).load()
        listing = f"SELECT table_name AS name FROM information_schema.tables WHERE table_schema = '{schema.replace(chr(39), chr(39) * 2)}' AND table_type = 'BASE TABLE'"
        names = [table] if table else sorted(r[0] for r in jdbc(query=listing).collect())
        quote = (lambda n: '"' + n.replace('"', '""') + '"') if postgres else (lambda n: "`" + n.replace("`", "``") + "`")
        return {n: jdbc(dbtable=(f"public.{quote(n)}" if postgres else quote(n))) for n in names}
    if low.startswith("bigquery://"):
        project, dataset = bigquery_dataset(address)
        if table and not re.fullmatch(BIGQUERY["table"], table):
            raise ValueError("invalid BigQuery table")
        read = lambda **how: spark.read.format("bigquery").options(**how).load()
        names = [table] if table else sorted(r[0] for r in read(query=bigquery_listing(project, dataset), materializationDataset=dataset, viewsEnabled="true").collect())
        return {n: read(table=f"{project}.{dataset}.{n}") for n in names}
    if low.endswith(".csv"):
        return {stem: csv(spark, address)}
    if low.endswith((".db", ".sqlite", ".sqlite3")):
        register(spark)
        return {n: spark.read.format("sqlite").options(path=address, table=n).load() for n in ([table] if table else sqlite_tables(address))}
    for end, kind in FILES.items():
        if low.rstrip("/").endswith(end):
            return {stem: spark.read.format(kind).load(address)}
    raise ValueError(f"no reader for {safe_address(address)}")


def hash_order(c: Column) -> list[Column]:
    """The order of a sample that is the same on every run: nulls last, then by SHA-256, length and bytes."""
    b = c.cast("string").cast("binary")
    return [c.isNull(), F.sha2(b, 256), F.octet_length(b), F.hex(b)]


def json_order(c: Column) -> list[Column]:
    """Order by JSON text, null as the word."""
    return [F.coalesce(F.to_json(F.struct(c.alias("v"))), F.lit("null")), F.coalesce(c.cast("string"), F.lit("null"))]


def sample(df: DataFrame, column: str, limit: int, order=hash_order) -> DataFrame:
    """(pos, value) of one column: the first `limit` values in the given order."""
    if limit < 0:
        raise ValueError("a sample can't be negative")
    if column not in df.columns:
        raise ValueError(f"unknown column {column}")
    c = F.col(column)
    return df.select(c).orderBy(*order(c)).limit(limit).select(F.monotonically_increasing_id().alias("pos"), c.cast("string").alias("value"))


#: Values of a column are dealt into so many parts, whose first values are found before those of the column.
PARTS = 64


def sampled(df: DataFrame, table: str, limit: int, order=hash_order, apart: bool = False) -> DataFrame:
    """(table, column, pos, value): the first `limit` values of every column of a table in the given order, whatever order the source has.

    One scan, whatever the number of columns: a column's first values are those of its parts, and a part's those of what each task has
    read of it (Spark cuts a task's rows to `limit` before the shuffle for limits of up to 1,000, its
    windowGroupLimitThreshold; larger samples give the same rows by a whole sort).

    apart: each column is read alone, for sources that store columns apart; a task then holds `limit` of a column's values and sorts no more.
    """
    if limit < 0:
        raise ValueError("a sample can't be negative")
    wide = df.select(*texts(df))
    if not wide.columns:
        raise ValueError(f"{table} has no columns")
    keys = F.struct(*[c.alias(f"k{k}") for k, c in enumerate(order(F.col("value")))])
    if apart:
        one = lambda c: wide.select(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")).select("column", "value", keys.alias("by")).orderBy("by").limit(limit)
        first = reduce(DataFrame.unionByName, map(one, wide.columns)).withColumn("n", F.row_number().over(Window.partitionBy("column").orderBy("by")))
        return first.select(F.lit(table).alias("table"), "column", (F.col("n") - 1).cast("long").alias("pos"), "value")
    long = wide.unpivot([], [F.col(f"`{c}`") for c in wide.columns], "column", "value")
    first = long.select("column", "value", F.pmod(F.xxhash64("value"), F.lit(PARTS)).alias("part"), keys.alias("by"))
    for of in (["column", "part"], ["column"]):
        first = first.withColumn("n", F.row_number().over(Window.partitionBy(*of).orderBy("by"))).where(F.col("n") <= limit)
    return first.select(F.lit(table).alias("table"), "column", (F.col("n") - 1).cast("long").alias("pos"), "value")


def sample_sql(kind: str, table: str, column: str, limit: int) -> str:
    """The same sample of one column as a query for a database server, which sends only its rows. kind: postgresql, mysql or bigquery;
    table: as that database quotes it."""
    ordered = {
        "postgresql": ('"', '"', "CAST({c} AS TEXT)", "v IS NULL, encode(sha256(convert_to(v, 'UTF8')), 'hex'), octet_length(v), encode(convert_to(v, 'UTF8'), 'hex')"),
        "mysql": ("`", "`", "CAST({c} AS CHAR CHARACTER SET utf8mb4)", "v IS NULL, SHA2(v, 256), OCTET_LENGTH(v), HEX(v)"),
        "bigquery": ("`", "`", "CAST({c} AS STRING)", "TO_JSON_STRING(STRUCT(v)), COALESCE(v, 'null')"),
    }
    left, right, text, order = ordered[kind]
    if limit < 0:
        raise ValueError("a sample can't be negative")
    if kind == "bigquery" and not re.fullmatch(BIGQUERY["column"], column):
        raise ValueError("invalid BigQuery column")
    name = f"{left}{column.replace(right, right * 2)}{right}"
    return f"SELECT v FROM (SELECT {text.format(c=name)} AS v FROM {table}) AS s ORDER BY {order} LIMIT {int(limit)}"


def sampled_source(spark: SparkSession, address: str, limit: int, table: str | None = None) -> DataFrame:
    """(table, column, pos, value) of all tables of a source, or of the one named. Databases order and cut their columns themselves; other
    sources are read once."""
    if limit < 0:
        raise ValueError("a sample can't be negative")
    low = address.lower()
    out = None
    if low.endswith((".db", ".sqlite", ".sqlite3")):
        register(spark)
        read = lambda n: spark.read.format("sqlite_sample").options(path=address, table=n, limit=limit).load()
        for name in [table] if table else sqlite_tables(address):
            one = read(name).select(F.lit(name).alias("table"), "column", "pos", "value")
            out = one if out is None else out.unionByName(one)
    elif low.startswith(("postgres://", "postgresql://", "mysql://")):
        kind = "mysql" if low.startswith("mysql") else "postgresql"
        options = mysql_options(address) if kind == "mysql" else postgres_options(address)
        for name, df in open_source(spark, address, table).items():
            quoted = f"`{name.replace('`', '``')}`" if kind == "mysql" else f'public."{name.replace(chr(34), chr(34) * 2)}"'
            for c in df.columns:
                rows = spark.read.format("jdbc").options(**options, query=sample_sql(kind, quoted, c, limit)).load()
                one = rows.select(F.lit(name).alias("table"), F.lit(c).alias("column"), F.monotonically_increasing_id().alias("pos"), F.col(rows.columns[0]).cast("string").alias("value"))
                out = one if out is None else out.unionByName(one)
    else:
        order = json_order if low.startswith("bigquery://") else hash_order
        for name, df in open_source(spark, address, table).items():
            one = sampled(df, name, limit, order, apart=low.rstrip("/").endswith((".parquet", ".orc")))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("the source has no tables")
    return out
