"""Raw datasets: rows of blocks from a provider, fetched by range on the executors.

A provider is any picklable object with ``blocks(start, end)``, which yields for each block, in
rising order, its rows by table, and ``latest()``.  ``SyntheticChain`` is one without
a network: a hash chain with token-transfer logs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..chain import BlockRange, end_block, split_ranges
from ..functions import abi

TRANSFER = "Transfer(address indexed from, address indexed to, uint256 value)"
SCHEMAS = {
    "blocks": "_block_num long, block_num long, timestamp timestamp, hash binary, parent_hash binary",
    "logs": "_block_num long, block_hash binary, block_num long, timestamp timestamp, tx_hash binary, tx_index long, log_index long, address binary, topic0 binary, topic1 binary, topic2 binary, topic3 binary, data binary",
}


class SyntheticChain:
    """Deterministic blocks; from block `fork_at` on they carry `salt`, as after a reorganisation."""

    def __init__(self, height: int, logs_per_block: int = 3, salt: str = "", fork_at: int = 0) -> None:
        self.height, self.logs_per_block, self.salt, self.fork_at = height, logs_per_block, salt, fork_at
        self.topic = abi.parse_signature(TRANSFER).topic

    def latest(self) -> int:
        return self.height

    def hash(self, number: int) -> bytes:
        return hashlib.sha256(f"{number}:{self.salt if number >= self.fork_at else ''}".encode()).digest()

    def blocks(self, start: int, end: int) -> Iterator[tuple[int, dict[str, list[dict]]]]:
        for n in range(start, min(end, self.height) + 1):
            time = pd.Timestamp(1_600_000_000 + 12 * n, unit="s")
            own = self.hash(n)
            logs = []
            for i in range(self.logs_per_block):
                a, b = (hashlib.sha256(f"{n}:{i}:{k}".encode()).digest()[:20] for k in "ab")
                logs.append({"_block_num": n, "block_hash": own, "block_num": n, "timestamp": time, "tx_hash": hashlib.sha256(own + bytes([i])).digest(), "tx_index": i, "log_index": i, "address": b"\x11" * 20, "topic0": self.topic, "topic1": bytes(12) + a, "topic2": bytes(12) + b, "topic3": None, "data": (n * 1000 + i).to_bytes(32, "big")})
            yield n, {"blocks": [{"_block_num": n, "block_num": n, "timestamp": time, "hash": own, "parent_hash": self.hash(n - 1)}], "logs": logs}


def fetch(spark: SparkSession, provider, table: str, ranges: list[tuple[int, int]], parts: int = 8, tries: int = 3) -> DataFrame:
    """A table's rows of the ranges, one Spark partition for each share of blocks; blocks must rise, and rows name their own block."""
    shares = split_ranges(ranges, parts)
    jobs = spark.createDataFrame([(k, a, b) for k, share in enumerate(shares) for a, b in share] or [(0, 1, 0)], "share int, a long, b long").repartition(max(len(shares), 1), "share")
    columns = [f.strip().split(" ")[0] for f in SCHEMAS[table].split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"], strict=True):
                at, left = int(a), tries
                while at <= b:
                    try:
                        for n, rows in provider.blocks(at, int(b)):
                            if n < at or any(r["_block_num"] != n for r in rows[table]):
                                raise ValueError(f"block {n} is out of order or mixed")
                            at = n + 1
                            if rows[table]:
                                yield pd.DataFrame(rows[table], columns=columns)
                        break
                    except ConnectionError:
                        left -= 1
                        if not left:
                            raise

    return jobs.mapInPandas(run, SCHEMAS[table])


def extract(spark: SparkSession, provider, table: str, store, start: int, end: str | int | None = "latest", parts: int = 8) -> list[BlockRange]:
    """Fetch what a store table lacks of start..end, and commit each missing range as a segment."""
    top = end_block(end, provider.latest())
    done = []
    for a, b in store.missing(start, top if top is not None else provider.latest()):
        span = BlockRange(a, b, "main", provider.hash(b).hex(), provider.hash(a - 1).hex())
        store.append(fetch(spark, provider, table, [(a, b)], parts), span)
        done.append(span)
    return done
