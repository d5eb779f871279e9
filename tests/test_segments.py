"""Stored tables: folders that stay, changes that break off, merges, pages and look-ups by the manifest."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quillflow.operators import articles as A
from quillflow.sources.segments import SegmentedTable, cascade_delete

SCHEMA = "id string, source_name string, feed_source_id string, published_at timestamp, published_date date, run_id string"
DAYS = 100
FOLDERS = 99  # the undated rows would have filled two of the days


def rows(spark, n=2000, start=0):
    """Rows over `DAYS` days, every 50th undated."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("n") * 37, F.lit(DAYS)) * 86400 + F.col("n") % 86400)
    return spark.range(start, start + n, 1, 4).withColumnRenamed("id", "n").select(
        F.format_string("%06d", "n").alias("id"), F.when(F.col("n") % 7 == 0, "").otherwise("s").alias("source_name"),
        (F.col("n") % 10).cast("string").alias("feed_source_id"),
        F.when(F.col("n") % 50 != 0, at).alias("published_at")).withColumn("published_date", F.to_date("published_at"))


@pytest.fixture
def table(spark, tmp_path):
    made = SegmentedTable(spark, str(tmp_path / "t"), SCHEMA)
    made.write_run("r0", rows(spark))
    return made


def files(table):
    found = {}
    for folder, _, names in os.walk(f"{table.root}/data"):
        found.update({os.path.join(folder, n): os.path.getmtime(os.path.join(folder, n)) for n in names if n.endswith(".parquet")})
    return found


def test_an_empty_table(spark, tmp_path):
    made = SegmentedTable(spark, str(tmp_path / "t"), SCHEMA)
    assert made.read().count() == 0 and made.latest_page(5).count() == 0 and made.lookup("x").count() == 0
    assert made.update(F.lit(True), source_name=F.lit("x")) == made.delete(F.lit(True)) == made.merge() == made.vacuum() == 0
    made.write_run("r", rows(spark).limit(0))
    assert made.read().count() == 0 and made.version() == 1


def test_changes_leave_other_folders_alone(spark, table):
    before, version = files(table), table.version()
    day = F.col("published_date") == F.lit("2024-01-05").cast("date")
    assert table.update(day & (F.col("source_name") == "s"), source_name=F.lit("new")) == 1
    assert table.version() == version + 1
    assert files(table).items() >= before.items() and len(files(table)) > len(before)
    assert table.read().filter("source_name = 'new'").count() == table.read().filter(day & (F.col("source_name") != "")).count() > 0
    assert table.delete(F.col("id") == "000123") == 1 and table.read().count() == 1999
    kept = {s.path("published_date") for s in table.segments()}
    assert len(kept) == FOLDERS and sum(p.startswith(f"seg={table.segments()[0].name}") for p in kept) >= FOLDERS - 3
    assert table.update(F.lit(None).cast("boolean"), source_name=F.lit("never")) == 0


def test_upsert_touches_the_folders_of_known_keys(spark, table):
    incoming = rows(spark, 3, 1999).withColumns({"source_name": F.lit("up"), "run_id": F.lit("r5")})
    assert table.upsert(incoming, "id", ["source_name"]) == 1
    got = {r["id"]: (r["source_name"], r["run_id"]) for r in table.read().filter("id >= '001999'").collect()}
    assert got == {"001999": ("up", "r0"), "002000": ("up", "r5"), "002001": ("up", "r5")} and table.read().count() == 2002


def test_backfill_and_cascade(spark, table, tmp_path):
    children = SegmentedTable(
        spark, str(tmp_path / "c"), "article_id string, entity string, published_date date, run_id string", "article_id")
    children.write_run("r0", rows(spark).select(F.col("id").alias("article_id"), F.lit("e").alias("entity"), "published_date"))
    sources = spark.createDataFrame([(str(k), f"name {k}") for k in range(9)], "id string, name string")
    assert table.backfill(sources) > 0
    assert table.read().filter("source_name = ''").filter("feed_source_id <> '9'").count() == 0
    cascade_delete(table, [children], sources.filter("id in ('3', '4')"))
    assert table.read().count() == children.read().count() == 1600
    assert children.read().join(table.read(), F.col("article_id") == F.col("id"), "left_anti").count() == 0


def test_a_change_that_breaks_off_changes_nothing(spark, table, monkeypatch):
    want = sorted(map(tuple, table.read().collect()), key=str)

    def lost(self, segments, after):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(SegmentedTable, "_publish", lost)
        with pytest.raises(RuntimeError):
            table.update(F.col("id") < "000100", source_name=F.lit("x"))
    assert sorted(map(tuple, table.read().collect()), key=str) == want
    # A manifest that was cut off while it was written is passed over.
    with open(f"{table.root}/_manifest/{table.version() + 1:012d}.json", "w") as f:
        f.write('{"segments": [')
    assert sorted(map(tuple, table.read().collect()), key=str) == want
    table.update(F.col("id") < "000100", source_name=F.lit("x"))
    assert table.read().filter("source_name = 'x'").count() == 100 and table.read().count() == 2000
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish([], 1)


def test_a_rewrite_that_loses_rows_is_not_published(spark, table):
    with pytest.raises(RuntimeError, match="were due"):
        table._replace(table.segments(), table.read().limit(10), 2000)
    assert table.read().count() == 2000


def test_merges_keep_reads_and_runs(spark, table):
    for k in range(1, 5):
        table.write_run(f"r{k}", rows(spark, 500, 2000 + 500 * k))
    old = table.read()
    before = sorted(map(tuple, old.collect()), key=str)
    assert table.merge(date(2024, 2, 1), fan_in=3) > 0
    assert sorted(map(tuple, table.read().collect()), key=str) == before == sorted(map(tuple, old.collect()), key=str)
    per_date = {}
    for s in table.segments():
        per_date[s.part] = per_date.get(s.part, 0) + 1
    assert all(n == 1 for d, n in per_date.items() if d is None or d < "2024-02-01") and max(per_date.values()) > 1
    table.write_run("r2", rows(spark, 10, 3000))
    assert table.read_run("r2").count() == 10 and table.read().count() == 2000 + 3 * 500 + 10
    table.vacuum(1)
    assert table.read().count() == 2000 + 3 * 500 + 10
    live = {f"{table.root}/data/{s.path('published_date')}" for s in table.segments()}
    assert {os.path.dirname(f) for f in files(table)} == live
    assert table.merge(date(2024, 2, 1), fan_in=2, rows=10) == 0  # large folders are left alone


def test_pages_open_few_folders(spark, table):
    every = A.latest_page(table.read(), 3000).collect()
    opened = []
    first = table.latest_page(15, told=opened.append)
    assert [r["id"] for r in first.collect()] == [r["id"] for r in every[:16]]
    assert sum(map(len, opened)) <= 2 and len(table.segments()) == FOLDERS
    cursor, seen = None, []
    for _ in range(12):
        page = table.latest_page(199, cursor).collect()
        seen += [r["id"] for r in page[:199]]
        cursor = (page[min(198, len(page) - 1)]["published_at"], page[min(198, len(page) - 1)]["id"])
        if len(page) <= 199:
            break
    assert seen == [r["id"] for r in every]
    # A filter that few rows pass opens more, and only as many as it needs.
    some = table.latest_page(3, keep=lambda r: r.filter("feed_source_id = '3'")).collect()
    assert [r["id"] for r in some] == [r["id"] for r in every if r["feed_source_id"] == "3"][:4]
    undated = table.latest_page(5, (None, "000150")).collect()
    assert [r["id"] for r in undated] == ["000100", "000050", "000000"]
    at = datetime(2024, 1, 3)
    opened.clear()
    table.latest_page(5, (at, "x"), told=opened.append)
    assert all(s.first < 1704240000_000000 + 1 for wave in opened for s in wave if s.first is not None)


def test_lookups_open_folders_whose_range_holds_the_id(spark, tmp_path):
    made = SegmentedTable(spark, str(tmp_path / "t"), SCHEMA)
    for k in range(5):
        made.write_run(f"r{k}", rows(spark, 100, 100 * k).withColumn("published_date", F.lit("2024-01-01").cast("date")))
    found = made.lookup("000250")
    assert found.count() == 1 and len({f.split("/data/")[1].split("/")[0] for f in found.inputFiles()}) == 1
    assert made.lookup("999999").count() == 0
