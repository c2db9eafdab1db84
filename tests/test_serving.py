"""SQL over HTTP, and block providers as a data source."""

import gzip
import json
import threading
import urllib.error
import urllib.request

import pytest

from blockloom.engine import Engine
from blockloom.sources.http import server
from blockloom.sources.provider import SyntheticChain
from blockloom.sources.stream import block_source


@pytest.fixture(scope="module")
def address(spark):
    engine = Engine(spark)
    engine.register("t", spark.createDataFrame([(k, k, None if k == 2 else f"é{k}") for k in range(2500)], "_block_num long, k long, v string"))
    running = server(engine)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_address[1]}/"
    running.shutdown()


def post(address, sql, **headers):
    return urllib.request.urlopen(urllib.request.Request(address, sql.encode(), headers, method="POST"))


def test_rows_as_lines(address):
    with post(address, "SELECT k, v FROM t ORDER BY k") as r:
        lines = r.read().decode().splitlines()
        assert r.headers["Content-Type"] == "application/x-ndjson" and r.headers["Access-Control-Allow-Origin"] == "*"
    assert len(lines) == 2500 and json.loads(lines[2]) == {"k": 2, "v": None} and json.loads(lines[9]) == {"k": 9, "v": "é9"}
    with post(address, "SELECT k FROM t", **{"Accept-Encoding": "gzip"}) as r:
        assert r.headers["Content-Encoding"] == "gzip" and len(gzip.decompress(r.read()).splitlines()) == 2500
    with post(address, "SELECT k FROM t WHERE k < 0") as r:
        assert r.read() == b""


@pytest.mark.parametrize("sql", ["SELECT k FROM t SETTINGS stream = true", "SELECT nothing FROM t", "DROP TABLE t", "SELECT k FROM absent", ""])
def test_errors_are_400(address, sql):
    with pytest.raises(urllib.error.HTTPError) as e:
        post(address, sql)
    assert e.value.code == 400 and json.loads(e.value.read())["error_message"]


def test_provider_as_source(spark, tmp_path):
    spark.dataSource.register(block_source(SyntheticChain(25), "chain25"))
    df = spark.read.format("chain25").option("table", "logs").option("start", 5).option("end", -5).load()
    assert sorted(r.block_num for r in df.collect()) == sorted(list(range(5, 21)) * 3)
    assert spark.read.format("chain25").option("start", 30).load().count() == 0

    def run(parts):
        stream = spark.readStream.format("chain25").option("parts", parts).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        query.stop()
        return sorted(r.block_num for r in spark.read.parquet(str(tmp_path / "out")).select("block_num").collect())

    assert run(4) == list(range(26))
    spark.dataSource.register(block_source(SyntheticChain(40), "chain25"))
    assert run(3) == list(range(41))
