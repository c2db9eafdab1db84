"""Raw tables as a Spark data source: ``spark.read`` and ``spark.readStream`` over a block provider.

    spark.dataSource.register(block_source(provider))
    spark.readStream.format("blocks").option("table", "logs").option("start", 0).load()

Offsets are block numbers, so that a query's checkpoint names the next block to fetch.
The source follows the provider's chain as it is; reorganisations are the concern of
the engine's own continuous queries.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..chain import end_block, split_ranges
from .provider import SCHEMAS


class Share(InputPartition):
    """The blocks that one task fetches."""

    def __init__(self, ranges: list[tuple[int, int]]) -> None:
        self.ranges = ranges


def _plain(v):
    """A value as rows hold it; a time without a zone is one of UTC."""
    if isinstance(v, datetime.datetime) and v.tzinfo is None:
        v = v.replace(tzinfo=datetime.UTC)
    return v.to_pydatetime() if hasattr(v, "to_pydatetime") else v


class _Fetching:
    def __init__(self, provider, options: dict) -> None:
        self.provider = provider
        self.table = options.get("table", "blocks")
        self.start, self.parts = int(options.get("start", 0)), int(options.get("parts", 8))
        self.end = options.get("end")
        self.columns = [f.strip().split(" ")[0] for f in SCHEMAS[self.table].split(",")]

    def shares(self, start: int, end: int) -> list[Share]:
        return [Share(r) for r in split_ranges([(start, end)], self.parts)] if start <= end else [Share([])]

    def top(self) -> int:
        """The last block that may be read now: no later than a given end, whether a number or counted back from the latest."""
        latest = self.provider.latest()
        bound = end_block(self.end, latest)
        return latest if bound is None else min(bound, latest)

    def read(self, share: Share) -> Iterator[tuple]:
        for a, b in share.ranges:
            for _, rows in self.provider.blocks(a, b):
                yield from (tuple(_plain(r[c]) for c in self.columns) for r in rows[self.table])


class _Batch(_Fetching, DataSourceReader):
    def partitions(self) -> list[Share]:
        return self.shares(self.start, self.top())


class _Stream(_Fetching, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"next": self.start}

    def latestOffset(self) -> dict:
        return {"next": max(self.top() + 1, self.start)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.shares(start["next"], end["next"] - 1)

    def commit(self, end: dict) -> None:
        pass


def block_source(provider, name: str = "blocks") -> type[DataSource]:
    """A data source class over a picklable provider, for ``spark.dataSource.register``."""

    class Blocks(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMAS[self.options.get("table", "blocks")]

        def reader(self, schema) -> DataSourceReader:
            return _Batch(provider, self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(provider, self.options)

    return Blocks
