"""Continuous queries: a driver-side loop of microbatches over ranges of blocks.

Each round fixes the range -- from the cursor (or the block where a reorganised
chain and the cursor's chain part) up to the least block that all tables have
(of a table registered with its segments, the end of the newest that the blocks
table confirms, empty blocks included; of another, its last row's block),
bounded by the end block and the longest interval -- and runs the statement's
delta over it as an ordinary batch job.  Messages: start, data, end, and the
watermark of the blocks that are complete.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..chain import BlockRange

BLOCK = "_block_num"


@dataclass(frozen=True)
class Cursor:
    """Where a reader stands on each network: block number and hash."""

    at: dict[str, tuple[int, str]]

    def to_json(self) -> dict:
        return {n: {"number": b, "hash": h} for n, (b, h) in self.at.items()}

    @staticmethod
    def from_json(d: dict) -> Cursor:
        return Cursor({n: (v["number"], v["hash"]) for n, v in d.items()})


@dataclass(frozen=True)
class MicrobatchStart:
    range: BlockRange
    reorg: bool = False


@dataclass(frozen=True)
class Data:
    rows: DataFrame
    range: BlockRange


@dataclass(frozen=True)
class MicrobatchEnd:
    range: BlockRange

    @property
    def cursor(self) -> Cursor:
        return Cursor({self.range.network: (self.range.end, self.range.hash)})


@dataclass(frozen=True)
class Watermark:
    network: str
    number: int


class Blocks:
    """A network's blocks (number, hash, parent_hash): the canonical ones, and all that were ever seen.

    Without a table of blocks, numbers stand for hashes and no chain forks.
    Lookups are filtered reads of single rows.
    """

    def __init__(self, canonical: Callable[[], DataFrame] | None = None, seen: Callable[[], DataFrame] | None = None) -> None:
        self.canonical, self.seen = canonical, seen or canonical

    def latest(self) -> int | None:
        return self.canonical().agg(F.max("number")).first()[0] if self.canonical else None

    def hash(self, number: int) -> str | None:
        if not self.canonical:
            return str(number)
        row = self.canonical().filter(F.col("number") == number).select("hash").first()
        return row[0] if row else None

    def confirms(self, number: int, own_hash: str) -> bool:
        """Whether a segment's last block is on the chain."""
        if not self.canonical:
            return True
        found = self.hash(number)
        return found is not None and found.lower().removeprefix("0x") == own_hash.lower().removeprefix("0x")

    def parent(self, number: int, own_hash: str | None = None) -> str | None:
        if not self.canonical:
            return str(number - 1)
        rows = (self.seen if own_hash else self.canonical)().filter(F.col("number") == number)
        row = (rows.filter(F.col("hash") == own_hash) if own_hash else rows).select("parent_hash").first()
        return row[0] if row else None

    def base(self, number: int, own_hash: str) -> int:
        """The last block of a chain, walked back from one of its blocks, that is canonical."""
        while number >= 0 and self.hash(number) != own_hash:
            own_hash = self.parent(number, own_hash)
            number -= 1
            if own_hash is None:
                raise ValueError(f"block {number + 1} was never seen: cannot find where the chains part")
        return number


class StreamingQuery:
    """A statement run by microbatches.

    refresh is called before each round, to let tables grow; boundaries, for a
    query that materialises, are block numbers that a rewind must fall on.  Rows come
    in block order unless ordered is false.
    """

    def __init__(self, engine, sql: str, cursor: Cursor | None = None, blocks: Blocks | None = None, start_block: int | None = None, end_block: int | None = None, max_interval: int = 100_000, refresh: Callable | None = None, boundaries: list[int] | None = None, poll: float = 1.0, keep_block: bool = False, ordered: bool = True) -> None:
        self.engine, self.sql, self.blocks = engine, sql, blocks or Blocks()
        self.end_block, self.max_interval, self.refresh, self.boundaries, self.poll = end_block, max_interval, refresh, boundaries, poll
        self.keep_block, self.ordered = keep_block, ordered
        prepared = engine.incremental(sql)
        self.tables = [t for t in dict.fromkeys(prepared.statement.tables) if engine.networks[t]]
        self.network = next((engine.networks[t] for t in self.tables), "main")
        self.position = cursor.at.get(self.network) if cursor else None
        self.start_block = start_block

    def _synced(self, table: str) -> tuple[int, int] | None:
        """A table's earliest block, and the latest up to which it is whole and the chain confirms it."""
        chain = self.engine.chains[table]
        if chain is None:
            row = self.engine.tables[table].agg(F.min(BLOCK).alias("a"), F.max(BLOCK).alias("b")).first()
            return None if row["a"] is None else (row["a"], row["b"])
        for s in reversed(chain):
            if self.blocks.confirms(s.range.end, s.range.hash):
                return chain[0].range.start, s.range.end
        return None

    def _bounds(self) -> tuple[int, int] | None:
        """The earliest block of any table, and the latest that all have and the chain confirms; None if a table has none."""
        spans = [self._synced(t) for t in self.tables]
        if None in spans:
            return None
        highs = [high for _, high in spans]
        if self.blocks.canonical:
            top = self.blocks.latest()
            if top is None:
                return None
            highs.append(top)
        return min(low for low, _ in spans), min(highs)

    def next_range(self) -> tuple[BlockRange, bool] | None:
        bounds = self._bounds()
        if bounds is None:
            return None
        reorg = False
        if self.position is None:
            start = self.start_block if self.start_block is not None else bounds[0]
        else:
            number, own = self.position
            base = self.blocks.base(number, own)
            reorg = base < number
            if reorg and self.boundaries is not None:
                base = max((b for b in self.boundaries if b <= base), default=bounds[0] - 1)
            start = base + 1
        end = min(x for x in (bounds[1], self.end_block, start + self.max_interval - 1) if x is not None)
        if end < start:
            return None
        return BlockRange(start, end, self.network, self.blocks.hash(end) or "", self.blocks.parent(start)), reorg

    def rounds(self) -> Iterator:
        """Messages of all microbatches that can run now."""
        while True:
            if self.refresh:
                self.refresh()
            found = self.next_range()
            if found is None:
                return
            span, reorg = found
            yield MicrobatchStart(span, reorg)
            # Tables may have been registered anew since the last round.
            rows = self.engine.incremental(self.sql).delta(span.start, span.end)
            if self.ordered:
                rows = rows.orderBy(rows["blockloom_bn"].asc_nulls_last())
            yield Data(rows.withColumnRenamed("blockloom_bn", BLOCK) if self.keep_block else rows.drop("blockloom_bn"), span)
            yield MicrobatchEnd(span)
            yield Watermark(self.network, span.end)
            self.position = (span.end, span.hash)
            if self.end_block is not None and span.end >= self.end_block:
                return

    def messages(self, forever: bool = False) -> Iterator:
        while True:
            yield from self.rounds()
            done = self.end_block is not None and self.position is not None and self.position[0] >= self.end_block
            if done or not forever:
                return
            time.sleep(self.poll)


def split_at_blocks(batches: Iterator[list[dict]]) -> Iterator[list[dict] | Watermark]:
    """Batches of rows in block order, cut where the first new block begins; the block before is complete then.  The first batch is never cut."""
    last: int | None = None
    first = True
    for batch in batches:
        numbers = [r[BLOCK] for r in batch]
        if numbers != sorted(numbers) or numbers and last is not None and numbers[0] < last:
            raise ValueError("rows are not in block order")
        cut = next((i for i, n in enumerate(numbers) if last is not None and n > last), None)
        if first or cut is None:
            yield batch
        else:
            if cut:
                yield batch[:cut]
            yield Watermark("main", last)
            yield batch[cut:]
        first = False
        last = numbers[-1] if numbers else last


def wire(message, rows: list | None = None) -> dict:
    """A message as it goes over a wire: rows and the ranges they are of; the last one of a range is empty and says so."""
    complete = isinstance(message, MicrobatchEnd)
    return {"rows": rows or [], "metadata": {"ranges": [message.range.to_json()], "ranges_complete": complete}}


def materialise(engine, sql: str, table, **options) -> list[BlockRange]:
    """Run a statement into a store table: one file a microbatch, from where its chain ends, rewinding to a file's bound."""
    chain = table.canonical()
    cursor = Cursor({chain[-1].range.network: (chain[-1].range.end, chain[-1].range.hash)}) if chain else None
    query = StreamingQuery(engine, sql, cursor=cursor, boundaries=[s.range.end for s in chain], keep_block=True, ordered=False, **options)
    done = []
    for m in query.messages():
        if isinstance(m, Data):
            rows = m.rows.select(*dict.fromkeys([BLOCK, *m.rows.columns]))
            table.append(rows.select(table.schema.names), m.range)
            done.append(m.range)
    return done
