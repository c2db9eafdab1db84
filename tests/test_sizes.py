"""What bounds a task's share of large tables: more rows make more tasks, not larger ones."""

import re

import pytest
from pyspark.sql import functions as F

from blockloom import queries
from blockloom.chain import BlockRange
from blockloom.engine import Engine
from blockloom.plans import planner
from blockloom.sources import store
from blockloom.sources.store import Table


def by_file(df):
    """Rows, least and greatest block of each file, in the order of blocks."""
    return sorted(tuple(r)[1:] for r in df.groupBy(F.input_file_name()).agg(F.count("*"), F.min("_block_num"), F.max("_block_num")).collect())


def test_compaction_sorts_bounded_shares(spark, tmp_path, monkeypatch):
    """A segment whose rows are large in memory goes to several files, however small these are when compressed."""
    monkeypatch.setattr(store, "SORT_BYTES", 16 * 1000, raising=False)  # rows of 16 bytes by their schema
    rows = spark.range(10_000).selectExpr("id AS _block_num", "0L AS v")
    table = Table(spark, str(tmp_path / "t"), rows.schema)
    for a in (0, 5000):
        table.append(rows.where(F.col("_block_num").between(a, a + 4999)), BlockRange(a, a + 4999, "main", str(a + 4999), str(a - 1)))
    assert table.compact() == 1 and len(table.segments()) == 1
    files = by_file(table.snapshot())
    assert len(files) == 10 and max(n for n, _, _ in files) < 2000
    spans = sorted((a, b) for _, a, b in files)
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert table.snapshot().agg(F.count("*"), F.sum("_block_num"), F.countDistinct("_block_num")).first() == (10_000, 49_995_000, 10_000)


def test_block_tables_are_dealt_by_size(spark, tmp_path, monkeypatch):
    """Tables are laid down in as many ranges of blocks as their files ask for, not in one for each core."""
    monkeypatch.setattr(queries, "TASK_BYTES", 4000, raising=False)
    spark.range(20_000).selectExpr("id AS event_id", "timestamp_seconds(id * 600) AS ts", "xxhash64(id) AS user_id").write.parquet(str(tmp_path / "events.parquet"))
    size = sum(f.stat().st_size for f in (tmp_path / "events.parquet").glob("*.parquet"))
    table = queries.block_table(spark, str(tmp_path), "events")
    files = by_file(table)
    assert len(files) > 0.8 * size / 4000 > 4 * spark.sparkContext.defaultParallelism
    spans = sorted((a, b) for _, a, b in files)
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert sorted(r.event_id for r in table.select("event_id").collect()) == list(range(20_000))


STATEMENTS = {
    "inner": ("SELECT a.k, w FROM a JOIN b ON a.k = b.j", "SELECT k, w FROM a JOIN b ON k = j"),
    "theta": ("SELECT a.k, w FROM a JOIN b ON a.k = b.j AND w > v", "SELECT k, w FROM a JOIN b ON k = j AND w > v"),
    "cte": ("WITH c AS (SELECT k AS id FROM a) SELECT c.id, b.w FROM c JOIN b ON c.id = b.j", "SELECT k AS id, w FROM a JOIN b ON k = j"),
    "semi": ("SELECT a.k FROM a LEFT SEMI JOIN b ON a.k = b.j", "SELECT k FROM a SEMI JOIN b ON k = j"),
}


@pytest.mark.parametrize("name", list(STATEMENTS))
def test_joins_of_large_sides_are_dealt(spark, tmp_path, monkeypatch, name):
    """Joins of two large tables are dealt into parts by the files' sizes, in no case broadcast on an estimate, and give what plain SQL gives."""
    monkeypatch.setattr(planner, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(planner, "BROADCAST_BYTES", 4)
    monkeypatch.setattr(planner, "PART_BYTES", 3000, raising=False)
    spark.range(3000).selectExpr("id * 7 % 12 AS _block_num", "CASE WHEN id % 50 > 0 THEN id END AS k", "id % 5 AS v").write.parquet(str(tmp_path / "a"))
    spark.range(9000).selectExpr("id * 5 % 12 AS _block_num", "CASE WHEN id % 40 > 0 THEN CAST(id % 2500 AS INT) END AS j", "id % 9 AS w").write.parquet(str(tmp_path / "b"))
    size = sum(f.stat().st_size for d in "ab" for f in (tmp_path / d).glob("*.parquet"))
    engine = Engine(spark)
    for table in "ab":
        read = spark.read.parquet(str(tmp_path / table))
        read.createOrReplaceTempView(table)
        engine.register(table, read)
    got = queries.microbatches(engine, STATEMENTS[name][0])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert {int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan)} == {-(-size // 3000)}
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 7
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(tuple(r) for r in spark.sql(STATEMENTS[name][1]).collect()) and len(rows) > 2000
