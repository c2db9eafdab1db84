"""Queries of the catalogue that go through stores, streams, datasets and providers, and the SQL that they are held against.

Each lays its rows down in a store of its own, in the shared folder, and reads
them back by the way that it is named for.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chain import BlockRange
from .datasets import Dataset, Registry, event_tables
from .engine import Engine
from .sources.provider import SCHEMAS, SyntheticChain, extract, fetch
from .sources.store import Table, scratch, static_csv
from .streaming.client import MemoryStore, TransactionalStream, changes
from .streaming.query import Blocks, Data, StreamingQuery

BLOCK = "_block_num"
#: Heights of the synthetic chains.
HEIGHT, LOGS = 40, 3


def _bounds(df: DataFrame) -> tuple[int, int]:
    return tuple(df.agg(F.min(BLOCK), F.max(BLOCK)).first())


def _segments(df: DataFrame, low: int, high: int, parts: int) -> list[tuple[DataFrame, BlockRange]]:
    """The rows of blocks low..high in so many ranges that follow each other; block numbers stand for hashes."""
    step = (high - low) // parts + 1
    ranges = [(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
    return [(df.where(F.col(BLOCK).between(a, b)), BlockRange(a, b, "main", str(b), str(a - 1))) for a, b in ranges]


def _store(spark: SparkSession, df: DataFrame, name: str, parts: int = 4, bounds: tuple[int, int] | None = None) -> Table:
    store = Table(spark, scratch(spark, name), df.schema)
    for rows, span in _segments(df, *(bounds or _bounds(df)), parts):
        store.append(rows, span)
    return store


def _together(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import block_table

    return block_table(spark, sf_dir, "orders")


def store_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, _orders(spark, sf_dir), "orders").snapshot().select("o_orderkey", "o_orderstatus")


def store_block_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files outside the range are not opened."""
    return _store(spark, _orders(spark, sf_dir), "orders", 8).snapshot(low=9000, high=9400).where(f"{BLOCK} BETWEEN 9000 AND 9400").select("o_orderkey", BLOCK).withColumnRenamed(BLOCK, "block")


def store_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, _orders(spark, sf_dir), "orders", 6)
    store.compact()
    store.collect_garbage(lock=0)
    return store.snapshot().select("o_orderkey", F.lit(len(store.segments())).cast("long").alias("segments"))


def store_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest anew from the files."""
    store = _store(spark, _orders(spark, sf_dir), "orders")
    store.restore()
    return store.snapshot(canonical_only=False).select("o_orderkey", "o_totalprice")


def store_fork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment of a chain that is not canonical is not in the snapshot."""
    df = _orders(spark, sf_dir)
    store = _store(spark, df, "orders")
    last = store.canonical()[-1].range
    store.append(df.where(F.col(BLOCK) >= last.start), BlockRange(last.start, last.end, "main", "fork", "nowhere"))
    return store.snapshot().select("o_orderkey")


def store_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new revision takes the table's place."""
    df = _orders(spark, sf_dir)
    store = _store(spark, df, "orders")
    store.truncate()
    low, _ = _bounds(df)
    for rows, span in _segments(df.where("o_orderstatus = 'F'"), low, _bounds(df)[1], 2):
        store.append(rows, span)
    return store.snapshot().select("o_orderkey")


def stream_microbatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    df = _orders(spark, sf_dir)
    engine.register("orders", df)
    low, high = _bounds(df)
    query = StreamingQuery(engine, "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 SETTINGS stream = true", max_interval=(high - low) // 3 + 1)
    return _together([m.rows for m in query.rounds() if isinstance(m, Data)])


def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second reader goes on from the first one's cursor."""
    from .streaming.query import MicrobatchEnd

    engine = Engine(spark)
    df = _orders(spark, sf_dir)
    engine.register("orders", df)
    low, high = _bounds(df)
    sql = "SELECT o_orderkey FROM orders SETTINGS stream = true"
    first = list(StreamingQuery(engine, sql, end_block=(low + high) // 2).rounds())
    cursor = next(m.cursor for m in reversed(first) if isinstance(m, MicrobatchEnd))
    second = StreamingQuery(engine, sql, cursor=cursor).rounds()
    return _together([m.rows for m in [*first, *second] if isinstance(m, Data)])


def stream_lagging_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that grow unevenly: lineitem has half its blocks in the first rounds, all in the next."""
    from .queries import block_table

    engine, orders, items = Engine(spark), _orders(spark, sf_dir), block_table(spark, sf_dir, "lineitem")
    spans = [_bounds(orders), _bounds(items)]
    bounds = min(a for a, _ in spans), max(b for _, b in spans)
    engine.register_store("orders", _store(spark, orders, "orders", 1, bounds))
    lagging, rest = Table(spark, scratch(spark, "lineitem"), items.schema), _segments(items, *bounds, 2)
    query = StreamingQuery(engine_with(engine, lagging, rest.pop(0)), "SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey SETTINGS stream = true", start_block=bounds[0], ordered=False)
    got = [m.rows for m in query.rounds() if isinstance(m, Data)]
    engine_with(engine, lagging, rest.pop(0))
    got += [m.rows for m in query.rounds() if isinstance(m, Data)]
    return _together(got)


def engine_with(engine: Engine, store: Table, segment: tuple[DataFrame, BlockRange]) -> Engine:
    store.append(*segment)
    engine.register_store("lineitem", store)
    return engine


def dataset_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two derived tables, one of the other, materialised by microbatches in their order."""
    df = _orders(spark, sf_dir)
    engine = Engine(spark)
    registry = Registry(engine)
    raw = Dataset("raw")
    registry.register(raw, "0.0.1")
    registry.publish(raw, {"orders": df})
    derived = Dataset("d", dependencies={"r": "_/raw@0.0.1"}, tables={"top": "SELECT o_orderkey, cents FROM self.open WHERE cents > 10000000", "open": "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM r.orders WHERE o_orderstatus = 'O'"})
    registry.register(derived, "1.0.0")
    schema = T._parse_datatype_string(f"{BLOCK} long, o_orderkey long, cents long")
    stores = {t: Table(spark, scratch(spark, t), schema) for t in derived.tables}
    low, high = _bounds(df)
    registry.run(derived, stores, max_interval=(high - low) // 2 + 1)
    return stores["top"].snapshot().select("o_orderkey", "cents")


def dataset_event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event of a contract, decoded from logs that were extracted into a store by eight tasks."""
    store = Table(spark, scratch(spark, "logs"), T._parse_datatype_string(SCHEMAS["logs"]))
    extract(spark, SyntheticChain(HEIGHT, LOGS), "logs", store, 0, parts=8)
    engine = Engine(spark)
    engine.register_store("logs", store)
    event = {"type": "event", "name": "Transfer", "inputs": [{"name": "from", "type": "address", "indexed": True}, {"name": "to", "type": "address", "indexed": True}, {"name": "value", "type": "uint256"}]}
    return engine.sql(event_tables([event])["transfer"]).selectExpr("block_num", "CAST(value AS BIGINT) AS value", "octet_length(`to`) AS width")


def provider_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch(spark, SyntheticChain(HEIGHT, LOGS), "logs", [(0, 9), (20, HEIGHT)], 4).groupBy("block_num").agg(F.count(F.lit(1)).alias("n"))


def stream_reorg_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change data over a reorganisation: what was undone is deleted; the rows that stay are those of the new chain."""
    engine, seen = Engine(spark), []

    def grow(chain: SyntheticChain) -> None:
        df = fetch(spark, chain, "blocks", [(0, chain.latest())], 2).selectExpr(BLOCK, "block_num", "hex(hash) AS hash", "hex(parent_hash) AS parent_hash")
        engine.register("blocks", df)
        seen.append(df.selectExpr("block_num AS number", "hash", "parent_hash"))

    grow(SyntheticChain(12))
    blocks = Blocks(lambda: seen[-1], lambda: _together(seen).distinct())
    query = StreamingQuery(engine, "SELECT block_num, hash FROM blocks SETTINGS stream = true", blocks=blocks, max_interval=4)
    stream, kept = TransactionalStream(MemoryStore()), []

    def drain() -> None:
        for kind, rows in changes(stream, query.rounds()):
            for r in rows:
                kept.append(r) if kind == "insert" else kept.remove(r)

    drain()
    grow(SyntheticChain(20, salt="fork", fork_at=8))
    drain()
    new = SyntheticChain(20, salt="fork", fork_at=8)
    return spark.createDataFrame([(r["block_num"], r["hash"] == new.hash(r["block_num"]).hex().upper()) for r in kept], "block_num long, canonical boolean")


def static_csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "nation")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.option("header", True).csv(path)
    engine = Engine(spark)
    engine.register("nation", static_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int"), network=None)
    return engine.sql("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey > 3")


def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"), "_/geo@1.0.0", network=None)
    engine.function("_/geo@1.0.0", "initial", lambda s: None if s is None else s[:1], "string")
    return engine.sql('SELECT n_nationkey, "_/geo@1.0.0".initial(n_name) AS i FROM "_/geo@1.0.0".nation')


def cross_dataset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"), "_/geo@1.0.0", network=None)
    engine.register("supplier", spark.read.parquet(f"{sf_dir}/supplier.parquet"), "_/trade@1.0.0", network=None)
    return engine.sql('SELECT s.s_suppkey, n.n_name FROM "_/trade@1.0.0".supplier s JOIN "_/geo@1.0.0".nation n ON s.s_nationkey = n.n_nationkey')


def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"), network=None)
    return engine.sql("DESCRIBE nation")


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)"

#: query -> SQL over the plain tables.
TABLE_QUERIES: dict[Callable[[SparkSession, str], DataFrame], str] = {
    store_snapshot: "SELECT o_orderkey, o_orderstatus FROM orders",
    store_block_range: f"SELECT o_orderkey, {_DAY} AS block FROM orders WHERE {_DAY} BETWEEN 9000 AND 9400",
    store_compaction: "SELECT o_orderkey, CAST(1 AS BIGINT) AS segments FROM orders",
    store_restore: "SELECT o_orderkey, o_totalprice FROM orders",
    store_fork: "SELECT o_orderkey FROM orders",
    store_truncate: "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    stream_microbatches: "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000",
    stream_resume: "SELECT o_orderkey FROM orders",
    stream_lagging_join: "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    stream_reorg_changes: "SELECT unnest(generate_series(0, 20)) AS block_num, true AS canonical",
    dataset_derived: f"SELECT o_orderkey, {_CENTS} AS cents FROM orders WHERE o_orderstatus = 'O' AND {_CENTS} > 10000000",
    dataset_event_table: f"SELECT n AS block_num, n * 1000 + i AS value, CAST(20 AS INTEGER) AS width FROM generate_series(0, {HEIGHT}) AS a(n), generate_series(0, {LOGS - 1}) AS b(i)",
    provider_fetch: f"SELECT n AS block_num, CAST({LOGS} AS BIGINT) AS n FROM generate_series(0, {HEIGHT}) AS a(n) WHERE n < 10 OR n >= 20",
    static_csv_table: "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey > 3",
    user_function: "SELECT n_nationkey, substr(n_name, 1, 1) AS i FROM nation",
    cross_dataset_join: "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    describe_table: "SELECT * FROM (VALUES ('n_nationkey', 'int', 'YES'), ('n_name', 'string', 'YES'), ('n_regionkey', 'int', 'YES')) AS t(column_name, data_type, is_nullable)",
}
