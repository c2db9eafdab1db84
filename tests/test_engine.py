"""Guards, golden values, chains, stores, streams with reorganisation, and consumers."""

import random

import pytest
from pyspark.sql import types as T

from blockloom.chain import BlockRange, Segment, canonical_chain, compaction_groups, fork, merge_ranges, missing_ranges, split_ranges
from blockloom.datasets import Dataset, Reference, Registry, event_tables, snake
from blockloom.engine import Engine
from blockloom.functions import abi, evm
from blockloom.plans.planner import NotIncremental
from blockloom.plans.sqlfront import SqlError
from blockloom.sources.provider import SCHEMAS, TRANSFER, SyntheticChain, extract, fetch
from blockloom.sources.store import Table, static_csv
from blockloom.streaming.client import KeyedSink, MemoryStore, ProtocolError, SqliteStore, TransactionalStream, changes, postgres_type, validate
from blockloom.streaming.query import Blocks, Data, MicrobatchEnd, MicrobatchStart, StreamingQuery, Watermark, split_at_blocks


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("blocks", spark.createDataFrame([(i, i * 10) for i in range(6)], "_block_num long, v long"), "_/x@0.0.0")
    e.register("logs", spark.createDataFrame([(i, i) for i in range(6)], "_block_num long, w long"))
    e.register("other", spark.createDataFrame([(1, 1)], "_block_num long, z long"), network="base")
    return e


def test_guards(engine):
    for sql, text in {
        "SELECT 0 AS _block_num": "column alias starting with '_'",
        "SELECT * FROM blocks, logs": "Duplicate field names detected",
        "SELECT block_num() FROM blocks": "only supported in streaming",
        "": "empty",
        "SELECT 1; SELECT 2": "one statement",
        "CREATE TABLE t (a int)": "read-only",
        "INSERT INTO blocks VALUES (1)": "read-only",
        "WITH a AS (SELECT v FROM blocks) INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT * FROM a": "read-only",
        "FROM blocks INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT v": "read-only",
        "SELECT java_method('java.lang.System', 'lineSeparator')": "read-only",
        "SELECT `reflect`('java.lang.System', 'lineSeparator')": "read-only",
        "SELECT identifier('reflect')('java.lang.System', 'lineSeparator')": "read-only",
        "SELECT v FROM blocks WHERE v IN (SELECT TRANSFORM(v) USING 'cat' AS (x) FROM logs)": "read-only",
        "EXPLAIN INSERT INTO blocks VALUES (1)": "read-only",
        "EXPLAIN ANALYZE CREATE TABLE t (a int)": "read-only",
        "SELECT * FROM a.b.c": "catalogs are not supported",
        "SELECT * FROM nowhere": "table not found",
        "SELECT v FROM blocks SETTINGS stream = true": "stream",
        "SELECT v FROM blocks SETTINGS foo = 1": "SETTINGS",
    }.items():
        with pytest.raises(SqlError, match=text.replace("(", "\\(")):
            engine.sql(sql)
    assert engine.sql('SELECT v FROM "_/x@0.0.0".blocks WHERE v > 20').count() == 3


@pytest.mark.parametrize(
    ("sql", "what"),
    {
        "SELECT count(*) AS n FROM blocks": "Aggregate",
        "SELECT DISTINCT v FROM blocks": "Distinct",
        "SELECT v FROM blocks ORDER BY v": "Sort",
        "SELECT v FROM blocks LIMIT 1": "Limit",
        "SELECT v, row_number() OVER (ORDER BY v) AS r FROM blocks": "Window",
        "SELECT v FROM blocks LEFT JOIN logs ON v = w": "Join\\(LeftOuter\\)",
        "SELECT v FROM blocks LEFT ANTI JOIN logs ON v = w": "Join\\(LeftAnti\\)",
        "SELECT a.v FROM blocks a JOIN blocks b ON a.v = b.v JOIN logs c ON b.v = c.w": "StackedJoins",
        "SELECT v FROM blocks WHERE v IN (SELECT w FROM logs)": "Subquery",
        "SELECT v FROM blocks EXCEPT SELECT w FROM logs": "Except",
        "SELECT DISTINCT ON (v) v FROM blocks ORDER BY v": "Distinct",
    }.items(),
)
def test_refused(engine, sql, what):
    with pytest.raises(NotIncremental, match=what):
        engine.incremental(sql)


def test_describe_and_explain(engine):
    assert [tuple(r) for r in engine.sql('DESCRIBE "_/x@0.0.0".blocks').collect()] == [("_block_num", "bigint", "YES"), ("v", "bigint", "YES")]
    assert [r.column_name for r in engine.sql("DESCRIBE SELECT v + 1 AS w FROM blocks").collect()] == ["w"]
    assert [r.plan_type for r in engine.sql("EXPLAIN SELECT v FROM blocks").collect()] == ["logical_plan", "physical_plan"]
    (row,) = engine.sql("EXPLAIN ANALYZE SELECT v FROM blocks WHERE v > 20").collect()
    assert row.plan_type == "Plan with Metrics" and "numOutputRows=3" in row.plan


def test_standard_calls_and_right_joins(engine):
    assert engine.sql("SELECT trim(BOTH 'a' FROM 'aba') AS t, extract(year FROM DATE'2020-05-01') AS y, substring('abcd' FROM 2 FOR 2) AS s, trim(LEADING FROM '  x') AS l FROM blocks LIMIT 1").first()[:] == ("b", 2020, "bc", "x")
    assert sorted(r.w for r in engine.sql("SELECT w FROM blocks RIGHT SEMI JOIN logs ON v = w * 10 AND v > 20").collect()) == [3, 4, 5]
    assert sorted(r.w for r in engine.sql("SELECT w FROM blocks b JOIN blocks c ON b.v = c.v AND c.v > 20 RIGHT ANTI JOIN logs l ON b.v = l.w * 10").collect()) == [0, 1, 2]
    engine.eth_call("_/x@0.0.0", lambda sender, to, data, block: (to + data, None))
    assert engine.sql("""SELECT "_/x@0.0.0".eth_call(X'00', X'01', X'02', 'latest') AS c FROM blocks LIMIT 1""").first().c.data == b"\1\2"
    with pytest.raises(Exception, match="300 is out of range of uint8"):
        engine.sql("SELECT evm_encode_params(v + 300, 'function f(uint8 k)') AS e FROM blocks WHERE v = 0").collect()


def test_contract_functions_agree(spark):
    """JVM expressions against the Arrow functions, over words of every shape."""
    r = random.Random(1)
    words = [None, b"", b"\1" * 31, b"\xff" * 32, bytes(32), b"\x80" + bytes(31), b"\x7f" + b"\xff" * 31, bytes(31) + b"\1", bytes(24) + b"\xff" * 8, b"\xff" * 24 + bytes(8), b"\xff" * 24 + b"\x80" + bytes(7), bytes(16) + b"\xff" * 16 + b"tail"]
    for _ in range(40):
        x = r.randbytes(r.choice([1, 2, 8, 9, 16, 20, 31, 32]))
        words += [x.rjust(32, r.choice([b"\0", b"\xff"])), x.ljust(32, b"\0")]
    e, slow = Engine(spark), Engine(spark)
    slow._in_jvm = lambda *a: None
    for x in (e, slow):
        x.register("t", spark.createDataFrame(list(enumerate(words)), "i int, d binary"), network=None)
    names = ["uint256", "int256", "uint8", "int24", "uint64", "int64", "int72", "uint120", "bool", "address", "bytes4"]
    sql = f"SELECT i, {', '.join(f'evm_decode_type(d, {n!r}) AS {n}' for n in names)} FROM t"
    assert sorted(map(str, e.sql(sql).collect())) == sorted(map(str, slow.sql(sql).collect())) and "Python" not in e.explain(sql)
    for v in ("1.5", "-0.00120", "000", "-0", "12", "1e5", "1.0E-7", "+3.", "123456789012345678901234567890123456789012.5"):
        for u in (0, -1, 18, -32):
            assert e.sql(f"SELECT shift_units('{v}', {u}) AS s").first().s == evm.shift(v, u)


def test_networks(engine):
    with pytest.raises(SqlError, match="several networks"):
        engine.incremental("SELECT v, z FROM blocks JOIN other ON v = z")
    assert engine.sql("SELECT v, z FROM blocks JOIN other ON v >= z").count() == 5


def test_user_function(engine):
    engine.function("_/x@0.0.0", "twice", lambda v: None if v is None else 2 * v, "bigint")
    assert sorted(r[0] for r in engine.sql('SELECT "_/x@0.0.0".twice(v) AS t FROM blocks').collect()) == [0, 20, 40, 60, 80, 100]


def test_abi_goldens():
    assert abi.parse_signature(TRANSFER).topic.hex() == "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert abi.encode(abi.parse_type("uint256"), 635).hex() == "0" * 61 + "27b"
    assert abi.encode(abi.parse_type("int256[]"), [1, 2, 3]).hex() == "".join(f"{n:064x}" for n in (32, 3, 1, 2, 3))
    assert abi.encode(abi.parse_type("string"), "hello world").hex() == f"{32:064x}{11:064x}" + b"hello world".hex().ljust(64, "0")
    t = abi.parse_type("(int256,int8,string[],(bool,bytes)[2],address,bytes4)")
    v = (5, -3, ["a", "bb" * 40], [(True, b"x"), (False, b"")], b"\x01" * 20, b"abcd")
    assert abi.decode(t, abi.encode(t, v)) == v
    kinds = {"uint8": T.ShortType(), "int24": T.IntegerType(), "uint64": T.DecimalType(20, 0), "uint120": T.DecimalType(38, 0), "uint128": T.StringType(), "uint256": T.StringType(), "bytes32": T.BinaryType()}
    for name, kind in kinds.items():
        assert abi.spark_type(abi.parse_type(name)) == kind
    for bad in ("uint7", "bytes33", "function", "int256]"):
        with pytest.raises(abi.AbiError):
            abi.parse_type(bad)
    for name, value in (("uint8", 256), ("int8", -129), ("uint8", -1), ("address", b"x")):
        with pytest.raises(abi.AbiError):
            abi.encode(abi.parse_type(name), value)
    assert evm.shift("1.376988483056381409", 18) == "1376988483056381409" and evm.shift("1.5", -18) == "0.0000000000000000015"
    assert evm.shift(None, 3) is None and evm.shift("2", None) == "20"
    with pytest.raises(ValueError, match="between -32 and 32"):
        evm.shift("1", 33)
    for text, message in (("0x123", "odd number"), ("", "got 0")):
        with pytest.raises(abi.AbiError, match=message):
            evm.evm_encode_hex(text)


def test_eth_call(spark):
    def client(sender, to, data, block):
        return (to + b"!", None) if to != b"bad" else (None, "reverted")

    df = spark.createDataFrame([(b"a", b"x"), (b"a", b"bad")], "s binary, t binary")
    rows = df.select(evm.eth_call(client, df.s, df.t, df.s, df.s.cast("string")).alias("c")).select("c.*").collect()
    assert [(None if r[0] is None else bytes(r[0]), r[1]) for r in rows] == [(b"x!", None), (None, "reverted")]


def segment(a, b, h, p, m=0.0):
    return Segment(f"{a}-{b}-{h}", BlockRange(a, b, "main", h, p), m)


def test_chains():
    good = [segment(0, 4, "a", "-"), segment(5, 9, "b", "a"), segment(12, 14, "c", "b")]
    rival = [segment(8, 12, "x", "y", 1), segment(13, 17, "z", "x", 1)]
    random.seed(3)
    for _ in range(50):
        mixed = random.sample(good + rival, 5)
        assert canonical_chain(mixed) == good
        assert fork(mixed, good) == rival
    assert canonical_chain(good, start_block=0) == good and canonical_chain(good[1:], start_block=0) == []
    assert merge_ranges([(5, 7), (0, 2), (3, 4), (9, 9)]) == [(0, 7), (9, 9)]
    old = [segment(3, 5, "a", "-"), segment(6, 11, "b", "a"), segment(12, 14, "c", "b")]
    assert missing_ranges([*old, segment(9, 17, "x", "y")], (0, 20)) == [(0, 2), (6, 8), (18, 20)]
    assert missing_ranges([segment(3, 5, "a", "-"), segment(6, 9, "b", "a")], (0, 12)) == [(0, 2), (10, 12)]
    assert [sum(b - a + 1 for a, b in s) for s in split_ranges([(0, 9), (20, 24)], 4)] == [4, 4, 4, 3]
    assert [len(g) for g in compaction_groups(good, 10**9)] == [2]


def test_store_and_extraction(spark, tmp_path):
    chain = SyntheticChain(20)
    table = Table(spark, str(tmp_path / "logs"), T._parse_datatype_string(SCHEMAS["logs"]))
    assert [(r.start, r.end) for r in extract(spark, chain, "logs", table, 0, 9)] == [(0, 9)]
    assert [(r.start, r.end) for r in extract(spark, chain, "logs", table, 0)] == [(10, 20)]
    assert extract(spark, chain, "logs", table, 0) == []
    assert table.synced() == (0, 20) and table.snapshot().count() == 63
    assert table.snapshot(low=10).inputFiles() != table.snapshot().inputFiles()
    held = table.snapshot()
    assert table.compact() == 1 and table.snapshot().count() == held.count() == 63
    assert table.check() == {"orphans": [], "missing": []}
    shown = Engine(spark)
    shown.register("logs", table.snapshot())
    assert str(tmp_path) not in shown.explain("SELECT block_num FROM logs")
    assert table.collect_garbage(lock=0) == 2 and table.check()["orphans"] == []
    e = Engine(spark)
    e.register("logs", table.snapshot())
    sql = event_tables([{"type": "event", "name": "Transfer", "inputs": [{"name": "from", "type": "address", "indexed": True}, {"name": "to", "type": "address", "indexed": True}, {"name": "amountOut", "type": "uint256"}]}])["transfer"]
    assert sorted(int(r.amount_out) for r in e.sql(sql).collect()) == [n * 1000 + i for n in range(21) for i in range(3)]
    table.restore()
    assert table.snapshot(canonical_only=False).count() == 63
    table.truncate()
    assert table.snapshot().count() == 0 and len(table.revisions()) == 1
    (tmp_path / "t.csv").write_text("k,v\n1,a\n2,\n")
    assert static_csv(spark, str(tmp_path / "t.csv"), "k long, v string").collect()[1] == (2, None)


def chain_stream(spark, e, state, **options):
    def refresh():
        c = state["chain"]
        df = fetch(spark, c, "blocks", [(0, c.latest())], 2).selectExpr("_block_num", "block_num", "hex(hash) AS hash", "hex(parent_hash) AS parent_hash").cache()
        state["df"] = df
        e.register("blocks", df)
        seen = df.selectExpr("block_num AS number", "hash", "parent_hash")
        state["seen"] = seen if "seen" not in state else state["seen"].unionByName(seen).distinct()

    refresh()
    blocks = Blocks(lambda: state["df"].selectExpr("block_num AS number", "hash", "parent_hash"), lambda: state["seen"])
    return StreamingQuery(e, "SELECT block_num, hash FROM blocks SETTINGS stream = true", blocks=blocks, refresh=refresh, **options)


def test_stream_with_reorg_and_consumers(spark, tmp_path):
    e, state = Engine(spark), {"chain": SyntheticChain(5)}
    query = chain_stream(spark, e, state, max_interval=2)
    store = SqliteStore(str(tmp_path / "state.db"))
    stream = TransactionalStream(store)
    kept: list = []

    def drain():
        for kind, rows in changes(stream, query.rounds()):
            for r in rows:
                kept.append(r) if kind == "insert" else kept.remove(r)

    drain()
    assert [r["block_num"] for r in kept] == list(range(6))
    state["chain"] = SyntheticChain(8, salt="fork", fork_at=4)
    drain()
    assert [r["block_num"] for r in kept] == list(range(9))
    assert [r["hash"] for r in kept] == [state["chain"].hash(n).hex().upper() for n in range(9)]
    again = SqliteStore(str(tmp_path / "state.db"))
    assert again.load() == store.load()


def test_stream_waits_for_a_lagging_table(spark, tmp_path):
    """A table behind the blocks table holds the end back; rows that come later are emitted, and empty blocks of its segments count."""
    chain = SyntheticChain(20)
    e, logs = Engine(spark), Table(spark, str(tmp_path / "logs"), T._parse_datatype_string(SCHEMAS["logs"]))
    blocks = Blocks(lambda: fetch(spark, chain, "blocks", [(0, 20)], 2).selectExpr("block_num AS number", "lower(hex(hash)) AS hash", "lower(hex(parent_hash)) AS parent_hash"))
    for stored in (False, True):
        refresh = lambda stored=stored: e.register_store("logs", logs) if stored else e.register("logs", logs.snapshot())
        logs.truncate()
        extract(spark, chain, "logs", logs, 0, 9)
        refresh()
        query = StreamingQuery(e, "SELECT block_num FROM logs SETTINGS stream = true", blocks=blocks, refresh=refresh)
        got = [m for m in query.rounds()]
        assert [m.range.end for m in got if isinstance(m, MicrobatchEnd)] == [9]
        seen = [r.block_num for m in got if isinstance(m, Data) for r in m.rows.collect()]
        extract(spark, chain, "logs", logs, 0)
        seen += [r.block_num for m in query.rounds() if isinstance(m, Data) for r in m.rows.collect()]
        assert sorted(seen) == sorted(r.block_num for r in logs.snapshot().collect())
    # Whole segments without rows, and one that the blocks table does not know.
    last = logs.canonical()[-1].range
    empty = Table(spark, str(tmp_path / "empty"), logs.schema)
    empty.append(spark.createDataFrame([], logs.schema), BlockRange(0, 20, "main", last.hash, ""))
    empty.append(spark.createDataFrame([], logs.schema), BlockRange(21, 25, "main", "unknown", last.hash))
    e.register_store("none", empty)
    query = StreamingQuery(e, "SELECT l.block_num FROM logs l JOIN none n ON l.tx_hash = n.tx_hash SETTINGS stream = true", blocks=blocks)
    assert query._bounds() == (0, 20)


def test_messages_and_protocol(spark):
    e, state = Engine(spark), {"chain": SyntheticChain(3)}
    got = list(chain_stream(spark, e, state, max_interval=3, end_block=3).messages())
    assert [type(m) for m in got] == [MicrobatchStart, Data, MicrobatchEnd, Watermark] * 2
    a, b = got[0].range, got[4].range
    assert b.follows(a) and not validate(a, b) and validate(b, a)
    with pytest.raises(ProtocolError, match="missing"):
        validate(a, BlockRange(9, 9, "main", "h", "p"))
    with pytest.raises(ProtocolError, match="does not follow"):
        validate(a, BlockRange(a.end + 1, a.end + 1, "main", "h", "p"))
    out = list(split_at_blocks(iter([[{"_block_num": 1}], [{"_block_num": 1}, {"_block_num": 2}], [{"_block_num": 3}]])))
    assert [len(o) if isinstance(o, list) else o.number for o in out] == [1, 1, 1, 1, 2, 1]


def test_sink_and_types(tmp_path):
    from blockloom.streaming.client import Event

    sink = KeyedSink(str(tmp_path / "s.db"), "t", ["k"])
    for _ in range(2):
        sink.apply(Event("data", 1, [{"k": 5}, {"k": 6}]))
    sink.apply(Event("data", 2, [{"k": 7}]))
    sink.apply(Event("undo", 3, undo=(2, 2)))
    assert sink.db.execute("SELECT k FROM t ORDER BY 1").fetchall() == [(5,), (6,)]
    assert [postgres_type(t) for t in ("decimal(20,0)", "array<bigint>", "struct<a:int>", "timestamp")] == ["numeric(20,0)", "int8[]", "jsonb", "timestamptz"]


def test_uncommitted_is_undone():
    store = MemoryStore()
    store.advance(3)
    store.commit({0: BlockRange(0, 1, "main", "a", "-")})
    event, _ = next(TransactionalStream(store).events(iter([])))
    assert event.kind == "undo" and event.undo == (1, 2)


def test_datasets(spark, engine, tmp_path):
    assert str(Reference.parse("eth_rpc")) == "_/eth_rpc@latest" and snake("amountOutUSD") == "amount_out_usd"
    registry = Registry(engine)
    raw = Dataset("raw")
    registry.register(raw, "0.0.1")
    registry.publish(raw, {"b": engine.tables[engine.default["blocks"]]})
    derived = Dataset("d", dependencies={"r": "_/raw@0.0.1"}, tables={"top": "SELECT v FROM self.mid WHERE v > 20", "mid": "SELECT v FROM r.b WHERE v > 0"})
    registry.register(derived, "1.0.0")
    assert derived.order() == ["mid", "top"] and registry.resolve("d")[0].revision == "1.0.0"
    with pytest.raises(SqlError, match="depend on each other"):
        Dataset("x", tables={"a": "SELECT 1 FROM self.b", "b": "SELECT 1 FROM self.a"}).order()
    schema = T._parse_datatype_string("_block_num long, v long")
    stores = {t: Table(spark, str(tmp_path / t), schema) for t in derived.tables}
    registry.run(derived, stores, max_interval=4)
    assert sorted(r.v for r in stores["top"].snapshot().collect()) == [30, 40, 50]
    assert registry.run(derived, stores)["mid"] == []
    assert registry.infer_schema(derived)["top"] == [("_block_num", "bigint"), ("v", "bigint")]
