"""Datasets: versioned collections of tables (raw, derived by SQL, static) and functions.

References are ``name``, ``namespace/name`` or either with ``@revision``; a revision is
a version, a content hash, ``latest`` (the default: the highest version) or ``dev``.
Derived tables name each other by ``self.table`` and are run in dependency order.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from .functions import abi
from .plans.sqlfront import SqlError, tokenize
from .sources.store import Table

_REFERENCE = re.compile(r"(?:(?P<ns>[a-z0-9_]+)/)?(?P<name>[a-z0-9_]+)(?:@(?P<rev>[\w.+-]+))?")

#: Argument and result types that user functions may have.
INPUT_TYPES = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string", "binary", "date", "timestamp", "array", "struct", "map", "void"}
OUTPUT_TYPES = INPUT_TYPES - {"array", "binary", "map", "void"}


@dataclass(frozen=True)
class Reference:
    namespace: str
    name: str
    revision: str

    @staticmethod
    def parse(text: str) -> Reference:
        m = _REFERENCE.fullmatch(text)
        if not m:
            raise SqlError(f"no dataset reference: {text!r}")
        return Reference(m["ns"] or "_", m["name"], m["rev"] or "latest")

    def __str__(self) -> str:
        return f"{self.namespace}/{self.name}@{self.revision}"


@dataclass
class Dataset:
    name: str
    network: str | None = "main"
    namespace: str = "_"
    dependencies: dict[str, str] = field(default_factory=dict)
    tables: dict[str, str] = field(default_factory=dict)
    functions: dict[str, tuple] = field(default_factory=dict)

    @property
    def hash(self) -> str:
        body = {"network": self.network, "dependencies": self.dependencies, "tables": self.tables, "functions": sorted(self.functions)}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()

    def order(self) -> list[str]:
        """Tables in the order of their self-references; an error names a cycle."""
        graph = {}
        for table, sql in self.tables.items():
            tokens = tokenize(sql)
            graph[table] = {tokens[i + 2].text for i in range(len(tokens) - 2) if tokens[i].low == "self" and tokens[i + 1].text == "." and (i + 3 >= len(tokens) or tokens[i + 3].text != "(")}
            unknown = graph[table] - self.tables.keys()
            if unknown:
                raise SqlError(f"{table} refers to unknown tables: {', '.join(sorted(unknown))}")
        try:
            return list(TopologicalSorter(graph).static_order())
        except CycleError as e:
            raise SqlError(f"tables depend on each other: {' -> '.join(e.args[1])}") from e


def define_dataset(config: dict) -> Dataset:
    """A dataset from plain values; function types are checked."""
    made = Dataset(**config)
    for name, (_, result, *inputs) in made.functions.items():
        base = re.match(r"\w+", result)[0]
        if base == "decimal" and not result.endswith(",0)") or base not in OUTPUT_TYPES | {"decimal"}:
            raise SqlError(f"{name}: {result} cannot be a result type")
        for t in inputs:
            base = re.match(r"\w+", t)[0]
            if base == "decimal" and not t.endswith(",0)") or base not in INPUT_TYPES | {"decimal"}:
                raise SqlError(f"{name}: {t} cannot be an argument type")
    return made


class Registry:
    """Versions of datasets, and their tables in an engine."""

    def __init__(self, engine) -> None:
        self.engine = engine
        self.versions: dict[tuple[str, str], dict[str, Dataset]] = {}

    def register(self, dataset: Dataset, version: str = "dev") -> Reference:
        own = self.versions.setdefault((dataset.namespace, dataset.name), {})
        own[version] = own[dataset.hash] = dataset
        return Reference(dataset.namespace, dataset.name, version)

    def resolve(self, reference: str | Reference) -> tuple[Reference, Dataset]:
        ref = Reference.parse(reference) if isinstance(reference, str) else reference
        own = self.versions.get((ref.namespace, ref.name), {})
        revision = ref.revision
        if revision == "latest":
            numbered = [v for v in own if re.fullmatch(r"\d+\.\d+\.\d+", v)]
            revision = max(numbered, key=lambda v: tuple(map(int, v.split("."))), default="dev")
        if revision not in own:
            raise SqlError(f"no such dataset: {ref}")
        return Reference(ref.namespace, ref.name, revision), own[revision]

    def infer_schema(self, dataset: Dataset) -> dict[str, list[tuple[str, str]]]:
        """The tables' columns, by planning their SQL; the block number comes first."""
        out = {}
        for table in dataset.order():
            df = self._prepared(dataset, table).df
            out[table] = [("_block_num", "bigint"), *[(n, t) for n, t in df.dtypes if n != "_block_num"]]
            self._publish(dataset, table, df.selectExpr("CAST(0 AS BIGINT) AS _block_num", *[f"`{c}`" for c in df.columns if c != "_block_num"]))
        return out

    def _statement(self, dataset: Dataset, table: str) -> str:
        sql = dataset.tables[table]
        sql = re.sub(r"(?i)\bself\s*\.", f'"{dataset.namespace}/{dataset.name}@{dataset.hash}".', sql)
        for alias, ref in dataset.dependencies.items():
            ref, found = self.resolve(ref)
            sql = re.sub(rf"(?i)\b{re.escape(alias)}\s*\.(?=\s*\w)", f'"{ref.namespace}/{ref.name}@{found.hash}".', sql)
        return sql

    def _prepared(self, dataset: Dataset, table: str):
        for name, (call, result, *_) in dataset.functions.items():
            self.engine.function(f"{dataset.namespace}/{dataset.name}@{dataset.hash}", name, call, result)
        return self.engine.incremental(self._statement(dataset, table))

    def _publish(self, dataset: Dataset, table: str, df) -> None:
        self.engine.register(table, df, f"{dataset.namespace}/{dataset.name}@{dataset.hash}", dataset.network)

    def publish(self, dataset: Dataset, tables: dict) -> None:
        """Make a raw or static dataset's tables (DataFrames, or store tables) known under its content hash."""
        for name, df in tables.items():
            if isinstance(df, Table):
                self.engine.register_store(name, df, f"{dataset.namespace}/{dataset.name}@{dataset.hash}", dataset.network)
            else:
                self._publish(dataset, name, df)

    def run(self, dataset: Dataset, stores: dict, **options) -> dict:
        """Materialise a derived dataset's tables, in order, into store tables; what each has done."""
        from .streaming.query import materialise

        done = {}
        for table in dataset.order():
            self._prepared(dataset, table)
            done[table] = materialise(self.engine, self._statement(dataset, table), stores[table], **options)
            self.engine.register_store(table, stores[table], f"{dataset.namespace}/{dataset.name}@{dataset.hash}", dataset.network)
        return done


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def event_query(event: dict, source: str = "logs") -> str:
    """The statement that decodes an event of a contract's ABI from a table of logs."""
    params = ", ".join(f"{i['type']}{' indexed' if i.get('indexed') else ''} {i['name']}" for i in event["inputs"])
    signature = f"{event['name']}({params})"
    abi.parse_signature(signature)
    fields = ", ".join(f"event.`{i['name']}` AS `{snake(i['name'])}`" for i in event["inputs"])
    return (
        f"SELECT tx_hash, block_hash, address, block_num, timestamp{', ' if fields else ''}{fields} FROM (SELECT l.*, evm_decode_log(topic1, topic2, topic3, data, '{signature}') AS event"
        f" FROM {source} l WHERE topic0 = evm_topic('{signature}')) AS decoded"
    )


def event_tables(contract: list[dict], source: str = "logs") -> dict[str, str]:
    """One statement for each event of an ABI, by its name in snake case."""
    return {snake(e["name"]): event_query(e, source) for e in contract if e.get("type") == "event"}


