"""Databases read by ranges, filters and orders of their own; samples of all columns in one scan."""

from __future__ import annotations

import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from lychgate.sources import router, sqlite


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "x.sqlite")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE people (id INTEGER, "odd ""name" TEXT, x REAL, b BLOB)')
        db.executemany("INSERT INTO people VALUES (?, ?, ?, ?)", [(k, None if k % 7 == 0 else f"né{k % 50}", k * 1e19 if k % 2 else k / 4, bytes([k % 256])) for k in range(1000)])
        db.execute("DELETE FROM people WHERE rowid BETWEEN 200 AND 600")
        db.execute("CREATE TABLE keyed (a TEXT PRIMARY KEY, v TEXT) WITHOUT ROWID")
        db.executemany("INSERT INTO keyed VALUES (?, ?)", [(f"k{k}", str(k)) for k in range(30)])
        db.execute("CREATE TABLE bare (a TEXT)")
    return path


def plain(path: str, table: str) -> list[tuple]:
    with sqlite3.connect(path) as db:
        return sorted((tuple(map(sqlite.as_text, r)) for r in db.execute(f"SELECT * FROM {table}")), key=repr)


def test_tables_are_read_by_ranges_of_row_ids(spark, database, monkeypatch):
    tables = router.open_source(spark, database)
    assert sorted(tables) == ["bare", "keyed", "people"]
    for name, df in tables.items():
        assert sorted(map(tuple, df.collect()), key=repr) == plain(database, name)
    monkeypatch.setattr(sqlite, "ROWS_PER_PART", 100)
    reader = sqlite.SqliteReader(database, "people", ["id"])
    parts = reader.partitions()
    assert len(parts) == 6 and all(b.first == a.last + 1 for a, b in zip(parts, parts[1:], strict=False))
    assert sorted(v for p in parts for (v,) in reader.read(p)) == sorted(r[0] for r in plain(database, "people"))
    assert len(sqlite.SqliteReader(database, "keyed", ["a"]).partitions()) == 1


def test_columns_and_filters_go_to_the_database(spark, database):
    router.register(spark)
    df = spark.read.format("sqlite").options(path=database, table="people", columns='["id", "x", "b"]').load()
    assert df.columns == ["id", "x", "b"]
    whole = router.open_source(spark, database, "people")["people"]
    name = F.col('`odd "name`')
    rows = plain(database, "people")
    for test, want in [
        (name == "né3", lambda r: r[1] == "né3"),
        (name.isNull(), lambda r: r[1] is None),
        (name.isNotNull(), lambda r: r[1] is not None),
        (name.isin("né1", "né2"), lambda r: r[1] in ("né1", "né2")),
        (name.startswith("né4"), lambda r: r[1] is not None and r[1].startswith("né4")),
        ((F.col("id") > "5") & (F.col("id") <= "71"), lambda r: "5" < r[0] <= "71"),
        (F.col("x") == "1e+19", lambda r: r[2] == "1e+19"),
        (F.col("b") == "A", lambda r: r[3] == "A"),
        (name.contains("9"), lambda r: r[1] is not None and "9" in r[1]),
        (~(name == "né3"), lambda r: r[1] is not None and r[1] != "né3"),
    ]:
        assert sorted(map(tuple, whole.where(test).collect()), key=repr) == [r for r in rows if want(r)], test
    from pyspark.sql.datasource import EqualTo, IsNotNull, StringContains

    reader = sqlite.SqliteReader(database, "people", ["id"])
    asked = [EqualTo(('odd "name',), "né3"), IsNotNull(("id",)), StringContains(("id",), "1")]
    assert list(reader.pushFilters(asked)) == asked
    query, values = reader.query(sqlite.Rows(1, 50))
    assert query.count("?") == len(values) == 3 and '"odd ""name"' in query and "rowid BETWEEN" in query and "instr" not in query
    assert [v for (v,) in reader.read(sqlite.Rows(1, 100))] == ["3", "53"]


def test_samples_take_one_scan(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") % 700).alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), F.col("id") % 40)).alias("b"), (F.col("id") / 8).alias("c"), F.lit(None).cast("string").alias("d"))
    df.write.parquet(str(tmp_path / "t.parquet"))
    (_, df), = router.open_source(spark, str(tmp_path / "t.parquet")).items()
    for limit in (0, 7, 60):
        got = router.sampled(df, "t", limit)
        for order in (router.hash_order, router.json_order):
            rows = router.sampled(df, "t", limit, order).collect()
            for c in df.columns:
                text = df.select(F.col(c).cast("string").alias("v"))
                want = [(r.pos, r.value) for r in router.sample(text, "v", limit, order).collect()]
                assert sorted((r.pos, r.value) for r in rows if r.column == c) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 1 and re.search(r"WindowGroupLimit.*Partial", plan)


def test_the_database_orders_its_own_samples(spark, database):
    whole = router.open_source(spark, database)
    got = router.sampled_source(spark, database, 25)
    for name, df in whole.items():
        want = router.sampled(df, name, 25).collect()
        assert sorted(map(tuple, got.where(F.col("table") == name).collect()), key=repr) == sorted(map(tuple, want), key=repr)
    assert len(sqlite.SampleReader(database, "people", ["id", "x"], 5).partitions()) == 2
    with pytest.raises(ValueError):
        router.sampled_source(spark, database, -1).collect()


def test_queries_for_database_servers():
    q = router.sample_sql("postgresql", 'public."t"', 'a"b', 500)
    assert q == """SELECT v FROM (SELECT CAST("a""b" AS TEXT) AS v FROM public."t") AS s ORDER BY v IS NULL, encode(sha256(convert_to(v, 'UTF8')), 'hex'), octet_length(v), encode(convert_to(v, 'UTF8'), 'hex') LIMIT 500"""
    assert router.sample_sql("mysql", "`t`", "a`b", 3) == "SELECT v FROM (SELECT CAST(`a``b` AS CHAR CHARACTER SET utf8mb4) AS v FROM `t`) AS s ORDER BY v IS NULL, SHA2(v, 256), OCTET_LENGTH(v), HEX(v) LIMIT 3"
    assert router.sample_sql("bigquery", "`p.d.t`", "a", 3).endswith("ORDER BY TO_JSON_STRING(STRUCT(v)), COALESCE(v, 'null') LIMIT 3")
    for bad in (lambda: router.sample_sql("mysql", "t", "a", -1), lambda: router.sample_sql("bigquery", "t", "a`b", 1)):
        with pytest.raises(ValueError):
            bad()
    assert "INFORMATION_SCHEMA" in router.bigquery_listing("my-project", "d")
