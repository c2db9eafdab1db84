"""Named queries over the test tables, one or more for each operator, and the SQL that they are held against.

Most are statements of the engine's dialect (``BATCH``); the incremental ones run
a statement by microbatches of blocks and add up what these emit, so that plain
SQL over the whole tables is their oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .sources.store import TASK_BYTES, scratch
from .tablequeries import TABLE_QUERIES

STATIC = ("region", "nation", "customer", "supplier", "part", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Block numbers of the test tables: days of dates, hours of events.
BLOCKS = {
    "orders": "CAST(datediff(CAST(o_orderdate AS DATE), DATE'1970-01-01') AS BIGINT)",
    "lineitem": "CAST(datediff(CAST(l_shipdate AS DATE), DATE'1970-01-01') AS BIGINT)",
    "events": "CAST(datediff(CAST(ts AS DATE), DATE'1970-01-01') * 24 + hour(ts) AS BIGINT)",
}
DUCK_BLOCKS = {
    "orders": "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)",
    "lineitem": "CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT)",
    "events": "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS BIGINT)",
}


_STORED: dict[tuple[str, str, str], str] = {}


def block_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table with its block number as a stored column, in its order, as an extracted table has it: written once a session and input."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch(spark, name)
        read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        parts = -(-int(read._jdf.queryExecution().analyzed().stats().sizeInBytes()) // TASK_BYTES)  # the files' bytes
        rows = read.selectExpr(f"{BLOCKS[name]} AS _block_num", "*")
        dealt = rows.repartitionByRange(max(spark.sparkContext.defaultParallelism, parts), "_block_num").sortWithinPartitions("_block_num")
        dealt.write.option("compression", "zstd").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def engine_for(spark: SparkSession, sf_dir: str, sql: str | None = None) -> Engine:
    """An engine that knows the test tables, or only those that a statement names (opening a table reads its footer)."""
    engine = Engine(spark)
    named = set(re.findall(r"\w+", sql)) if sql is not None else {*STATIC, *BLOCKS}
    for name in [n for n in STATIC if n in named]:
        engine.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), network=None)
    for name in [n for n in BLOCKS if n in named]:
        engine.register(name, block_table(spark, sf_dir, name))
    return engine


def _money(x: str, name: str) -> str:
    """A sum of doubles that does not depend on their order."""
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE) AS {name}"


#: name -> statement, or (statement, SQL for the oracle where dialects differ).
BATCH: dict[str, str | tuple[str, str]] = {
    # Scans, projections, filters, expressions
    "scan_project_filter": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AND l_returnflag = 'R'",
    "values_rows": ("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)", "SELECT CAST(k AS INTEGER) AS k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)"),
    "empty_relation": "SELECT 1 AS one, 'x' AS x",
    "cast_arith_mod": "SELECT o_orderkey, CAST(o_orderkey % 7 AS INTEGER) AS m, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders WHERE o_orderkey % 2 = 0",
    "arrow_cast_types": ("SELECT o_orderkey, arrow_cast(o_custkey, 'Int32') AS c, arrow_cast(o_totalprice, 'Decimal128(18, 2)') AS p FROM orders", "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS c, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders"),
    "is_null_logic": "SELECT l.doc_id, l.toxic IS NULL AS no_toxic, l.quality = 1 AND l.toxic = 0 AS clean FROM labels l WHERE NOT (l.quality IS NULL)",
    "hex_literal_filter": ("SELECT o_orderkey FROM orders WHERE decode(lower(hex(CAST(o_orderstatus AS BINARY))), 'hex') = x'46'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "struct_field": ("SELECT o_orderkey, s.c0 AS k, s['c1'] AS status FROM (SELECT o_orderkey, struct(o_custkey, o_orderstatus) AS s FROM orders) AS q", "SELECT o_orderkey, o_custkey AS k, o_orderstatus AS status FROM orders"),
    "derived_table": "SELECT q.c, q.n FROM (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey) AS q WHERE q.n > 10",
    "cte": "WITH big AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 200000) SELECT b.o_orderkey, c.c_name FROM big b JOIN customer c ON b.o_custkey = c.c_custkey",
    "unnest_embedding": ("SELECT vec_id, explode(embedding) AS x FROM embeddings", "SELECT vec_id, unnest(embedding) AS x FROM embeddings"),
    "exists_subquery": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "not_exists_subquery": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "scalar_subquery": "SELECT c_custkey FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer)",
    "correlated_subquery": "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    # Joins
    "inner_equi": "SELECT o_orderkey, l_linenumber, o_custkey FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey",
    "inner_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "cross_small": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "comma_join": "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey",
    "self_join": "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey + 1 = b.o_orderkey",
    "left_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "left_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "right_semi": ("SELECT c_custkey FROM orders RIGHT SEMI JOIN customer ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "right_anti": ("SELECT c_custkey FROM orders RIGHT ANTI JOIN customer ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "left_outer": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "left_outer_is_null": "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL",
    "right_outer": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 300000",
    "full_outer": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey AND c.c_nationkey = s.s_nationkey",
    "multiway": "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "null_safe_join": ("SELECT a.doc_id AS a, b.doc_id AS b FROM labels a JOIN labels b ON a.toxic <=> b.toxic AND a.doc_id + 1 = b.doc_id", "SELECT a.doc_id AS a, b.doc_id AS b FROM labels a JOIN labels b ON a.toxic IS NOT DISTINCT FROM b.toxic AND a.doc_id + 1 = b.doc_id"),
    "using_join": "SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)",
    # Aggregation and distinct
    "group_agg": f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_money('l_quantity', 'qty')}, {_money('l_extendedprice', 'price')}, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "global_agg": f"SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, {_money('o_totalprice', 'total')} FROM orders",
    "average": "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM orders GROUP BY o_orderstatus",
    "count_distinct": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15",
    "distinct": "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderkey DESC",
    "group_by_expression": "SELECT o_orderkey % 10 AS bucket, count(*) AS n FROM orders GROUP BY o_orderkey % 10",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "statistics": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag",
    # Windows, sorts, limits, recursion
    "rownum_top": "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) AS q WHERE rn <= 3",
    "rolling_sum": "SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS s FROM orders",
    "lag_lead": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS next2 FROM events",
    "rank_ntile": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS q FROM part",
    "first_last_value": "SELECT event_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f, last_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events",
    "range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part",
    "order_by": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey",
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30",
    "recursive_cte": ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t"),
    # Set operations
    "union_all": "SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey AS k FROM customer",
    "union_distinct": "SELECT o_custkey AS k FROM orders UNION SELECT s_suppkey AS k FROM supplier",
    "intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey AS k FROM customer",
    "intersect_all": "SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT l_suppkey AS k FROM lineitem",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders",
    "except_all": "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey AS k FROM customer",
    # Inherited functions
    "lower_hex": ("SELECT n_nationkey, lower(encode(CAST(n_name AS BINARY), 'hex')) AS h FROM nation", "SELECT n_nationkey, lower(hex(n_name)) AS h FROM nation"),
    "decode_hex": ("SELECT n_nationkey, CAST(decode(encode(CAST(n_name AS BINARY), 'hex'), 'hex') AS STRING) AS n FROM nation", "SELECT n_nationkey, n_name AS n FROM nation"),
    "date_trunc_day": ("SELECT CAST(date_trunc('day', ts) AS DATE) AS d, count(*) AS n FROM events GROUP BY 1", "SELECT CAST(date_trunc('day', ts) AS DATE) AS d, count(*) AS n FROM events GROUP BY 1"),
    "date_bin_window": ("SELECT CAST(unix_seconds(date_bin(INTERVAL '15' MINUTE, CAST(ts AS TIMESTAMP))) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1", "SELECT CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1"),
    "array_literal": ("SELECT o_orderkey, [o_orderkey, o_custkey, 7][1] AS second, size([1, 2, 3]) AS n FROM orders", "SELECT o_orderkey, o_custkey AS second, CAST(3 AS INTEGER) AS n FROM orders"),
    "generate_series": ("SELECT unnest(generate_series(1, 20)) AS n", "SELECT CAST(unnest(generate_series(1, 20)) AS INTEGER) AS n"),
    "case_coalesce_nullif": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' ELSE 'fine' END AS k, coalesce(nullif(quality, 0), -1) AS q FROM labels",
    "string_functions": "SELECT p_partkey, upper(p_name) AS u, substr(p_name, 2, 3) AS s, length(p_name) AS n, concat(p_brand, '-', p_type) AS c, trim(p_brand) AS t, replace(p_type, 'A', 'x') AS r FROM part",
    "math_functions": "SELECT p_partkey, abs(p_size - 25) AS a, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(sqrt(p_size), 6) AS s, power(p_size, 2) AS p FROM part",
    "regex_functions": ("SELECT url, regexp_like(url, '^https') AS secure, regexp_replace(url, '[0-9]+', '#') AS shape FROM pages", "SELECT url, regexp_matches(url, '^https') AS secure, regexp_replace(url, '[0-9]+', '#', 'g') AS shape FROM pages"),
    "date_parts": ("SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h FROM events", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h FROM events"),
    "standard_calls": ("SELECT p_partkey, trim(BOTH 'B' FROM p_brand) AS t, substring(p_type FROM 2 FOR 3) AS s, position('a' IN p_name) AS p FROM part", "SELECT p_partkey, trim(p_brand, 'B') AS t, substring(p_type, 2, 3) AS s, CAST(position('a' IN p_name) AS INTEGER) AS p FROM part"),
    "extract_from": ("SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m FROM orders", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, CAST(extract(month FROM o_orderdate) AS INTEGER) AS m FROM orders"),
    "digest_functions": ("SELECT n_nationkey, md5(CAST(n_name AS BINARY)) AS m, sha2(CAST(n_name AS BINARY), 256) AS s FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s FROM nation"),
    "json_field": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "array_aggregate": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    # Contract functions
    "evm_topic_literal": ("SELECT n_nationkey, lower(hex(evm_topic('event Transfer(address indexed from, address indexed to, uint256 value)'))) AS t FROM nation", "SELECT n_nationkey, 'ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef' AS t FROM nation"),
    "evm_hex_round_trip": ("SELECT n_nationkey, evm_decode_hex(evm_encode_hex('0x00000000000000000000000000000000000000ff')) AS h FROM nation", "SELECT n_nationkey, '0x00000000000000000000000000000000000000ff' AS h FROM nation"),
    "evm_decode_hex_column": ("SELECT c_custkey, evm_decode_hex(CAST(c_name AS BINARY)) AS h FROM customer", "SELECT c_custkey, '0x' || lower(hex(c_name)) AS h FROM customer"),
    "evm_encode_uint256": ("SELECT o_orderkey, lower(hex(evm_encode_type(o_orderkey, 'uint256'))) AS w FROM orders", "SELECT o_orderkey, lpad(lower(hex(o_orderkey)), 64, '0') AS w FROM orders"),
    "evm_encode_int256_negative": ("SELECT o_orderkey, lower(hex(evm_encode_type(-o_orderkey - 1, 'int64'))) AS w FROM orders", "SELECT o_orderkey, repeat('f', 48) || lpad(lower(hex(-o_orderkey - 1)), 16, '0') AS w FROM orders"),
    "evm_uint256_round_trip": ("SELECT o_orderkey, evm_decode_type(evm_encode_type(o_orderkey, 'uint256'), 'uint256') AS v FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS v FROM orders"),
    "evm_tuple_round_trip": ("SELECT n_nationkey, t.c0 AS a, t.c1 AS b FROM (SELECT n_nationkey, evm_decode_type(evm_encode_type(struct(n_nationkey, n_name), '(int32,string)'), '(int32,string)') AS t FROM nation) AS q", "SELECT n_nationkey, n_nationkey AS a, n_name AS b FROM nation"),
    "evm_params_round_trip": (
        "SELECT o_orderkey, p.k AS k, p.s AS s FROM (SELECT o_orderkey, evm_decode_params(evm_encode_params(o_orderkey, o_orderstatus, 'function f(uint64 k, string s)'), 'function f(uint64 k, string s)') AS p FROM orders) AS q",
        "SELECT o_orderkey, CAST(o_orderkey AS DECIMAL(20,0)) AS k, o_orderstatus AS s FROM orders",
    ),
    "evm_params_mismatch": ("SELECT o_orderkey, evm_decode_params(CAST(o_orderstatus AS BINARY), 'function f(uint64 k)') IS NULL AS none FROM orders", "SELECT o_orderkey, true AS none FROM orders"),
    "evm_selector": ("SELECT n_nationkey, lower(hex(evm_encode_params('function f()'))) AS s FROM nation", "SELECT n_nationkey, '26121ff0' AS s FROM nation"),
    "evm_log_round_trip": (
        "SELECT o_orderkey, d.`value` AS v, lower(hex(d.`from`)) AS f FROM (SELECT o_orderkey, evm_decode_log(evm_encode_type(o_custkey, 'uint256'), NULL, NULL, evm_encode_type(o_orderkey, 'uint256'), 'event T(address indexed from, address indexed to, uint256 value)') AS d FROM orders) AS q",
        "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS v, lpad(lower(hex(o_custkey)), 40, '0') AS f FROM orders",
    ),
    "shift_units_up": ("SELECT o_orderkey, shift_units(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), 2) AS cents FROM orders", "SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR) AS cents FROM orders"),
    "shift_units_down": ("SELECT o_orderkey, shift_units(o_orderkey * 1000, -3) AS k FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders"),
}

_O, _L, _E = DUCK_BLOCKS["orders"], DUCK_BLOCKS["lineitem"], DUCK_BLOCKS["events"]

#: name -> (statement, SQL over the whole tables).
INCREMENTAL: dict[str, tuple[str, str]] = {
    "inc_filter": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"),
    "inc_union": ("SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey AS k FROM lineitem", "SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey AS k FROM lineitem"),
    "inc_join": ("SELECT o_orderkey, l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey", "SELECT o_orderkey, l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey"),
    "inc_theta_join": ("SELECT o_orderkey, l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate > o.o_orderdate", "SELECT o_orderkey, l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate > o.o_orderdate"),
    "inc_self_join": ("SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey"),
    "inc_static_join": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "inc_cte": ("WITH k AS (SELECT o_orderkey AS id, o_custkey FROM orders) SELECT k.id, l.l_linenumber FROM k JOIN lineitem l ON k.id = l.l_orderkey", "SELECT o_orderkey AS id, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "inc_semi": ("SELECT o.o_orderkey FROM orders o LEFT SEMI JOIN lineitem l ON o.o_orderkey = l.l_orderkey", "SELECT o_orderkey FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey"),
    "inc_unnest": ("SELECT event_id, explode(array(event_type, CAST(user_id AS STRING))) AS x FROM events", "SELECT event_id, unnest([event_type, CAST(user_id AS VARCHAR)]) AS x FROM events"),
    "inc_group_by_block": (f"SELECT block_num() AS block, count(*) AS n, {_money('o_totalprice', 'total')} FROM orders GROUP BY block_num()", f"SELECT {_O} AS block, count(*) AS n, {_money('o_totalprice', 'total')} FROM orders GROUP BY 1"),
    "inc_join_group_by_block": (
        f"SELECT block_num() AS block, count(*) AS n, {_money('l.l_extendedprice', 'revenue')} FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY block_num()",
        f"SELECT greatest({_O}, {_L}) AS block, count(*) AS n, {_money('l_extendedprice', 'revenue')} FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    ),
    "inc_distinct_on_block": ("SELECT DISTINCT ON (block_num(), user_id) user_id, event_id FROM events ORDER BY block_num(), user_id, event_id", f"SELECT DISTINCT ON ({_E}, user_id) user_id, event_id FROM events ORDER BY {_E}, user_id, event_id"),
    "inc_block_num_column": ("SELECT block_num() AS block, event_id FROM events", f"SELECT {_E} AS block, event_id FROM events"),
}


def _batch(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine_for(spark, sf_dir, sql).sql(sql)


def microbatches(engine: Engine, sql: str, batches: int = 4) -> DataFrame:
    """What a statement's microbatches emit, added up.  The bounds come from the tables' block numbers."""
    prepared = engine.incremental(sql)
    bounds = [engine.tables[t].agg(F.min("_block_num").alias("a"), F.max("_block_num").alias("b")).first() for t in dict.fromkeys(prepared.statement.tables) if engine.networks[t]]
    low, high = min(b["a"] for b in bounds), max(b["b"] for b in bounds)
    step = (high - low) // batches + 1
    parts = [prepared.delta(a, min(a + step - 1, high)).drop("blockloom_bn") for a in range(low, high + 1, step)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _incremental(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: microbatches(engine_for(spark, sf_dir, sql), sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by block over a join that is maintained by microbatches."""
    sql = INCREMENTAL["inc_join_group_by_block"][0]
    return microbatches(engine_for(spark, sf_dir, sql), sql)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{k: _batch(v if isinstance(v, str) else v[0]) for k, v in BATCH.items()},
    **{k: _incremental(v[0]) for k, v in INCREMENTAL.items()},
    **{f.__name__: f for f in TABLE_QUERIES},
}
ORACLE_SQL: dict[str, str] = {**{k: v if isinstance(v, str) else v[1] for k, v in BATCH.items()}, **{k: v[1] for k, v in INCREMENTAL.items()}, **{f.__name__: v for f, v in TABLE_QUERIES.items()}}
