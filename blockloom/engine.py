"""The engine: datasets of block tables, batch SQL over them, and continuous queries.

``Engine.sql`` runs a statement once; ``Engine.stream`` runs it by microbatches of
blocks (see ``blockloom.streaming.query``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chain import Segment
from .functions import abisql, evm
from .plans import planner
from .plans.sqlfront import SqlError, Statement, Translator, join, one_statement, read_only, tokenize
from .sources.store import Table

BLOCK = "_block_num"


class Engine:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.networks: dict[str, str | None] = {}
        self.chains: dict[str, list[Segment] | None] = {}
        self.default: dict[str, str] = {}
        self.user: dict[tuple[str, str], str] = {}
        self.helped: set[str] = set()
        self.prefix = f"bl{id(self):x}"

    # Registration -----------------------------------------------------------

    def register(self, table: str, df: DataFrame, dataset: str | None = None, network: str | None = "main", chain: list[Segment] | None = None) -> str:
        """Make a table known by name, or by dataset and name; network None for tables without blocks.

        chain: the canonical segments that df has all rows of.  Without it a table counts as whole up to its last row only.
        """
        if network is not None and BLOCK not in df.columns:
            raise SqlError(f"{table} has no {BLOCK}")
        view = f"{self.prefix}_{dataset or ''}.{table}".replace("`", "")
        df.createOrReplaceTempView(f"`{view}`")
        self.tables[view], self.networks[view], self.chains[view] = df, network, chain
        self.default.setdefault(table.lower(), view)
        return view

    def register_store(self, table: str, store: Table, dataset: str | None = None, network: str | None = "main") -> str:
        """Make a store table known as it is now, with the blocks that it has done, empty ones too."""
        chain = store.canonical()  # before the rows, so that it claims none that they lack
        return self.register(table, store.snapshot(), dataset, network, chain)

    def function(self, dataset: str, name: str, call: Callable, result: str) -> None:
        """A user's scalar function, called as dataset.name(...); Arrow-batched, deterministic."""
        flat = f"{self.prefix}_{re.sub(r'\W', '_', dataset)}_{name}"
        if hasattr(call, "evalType"):
            self.spark.udf.register(flat, call)
        else:
            self.spark.udf.register(flat, F.udf(call, result, useArrow=True))
        self.user[dataset.lower(), name.lower()] = flat

    def eth_call(self, dataset: str, client: Callable, tries: int = 3) -> None:
        """Make dataset.eth_call(sender, target, data, block) known: a read-only call through the client, see evm.eth_call_udf."""
        self.function(dataset, "eth_call", evm.eth_call_udf(client, tries), "")

    def _view(self, dataset: str | None, table: str) -> str:
        if dataset is None:
            found = self.default.get(table.lower())
        else:
            found = next((v for v in self.tables if v.lower() == f"{self.prefix}_{dataset}.{table}".lower()), None)
        if found is None:
            raise SqlError(f"table not found: {dataset + '.' if dataset else ''}{table}")
        return found

    def _contract(self, name: str, args: list[str], signature: str | None) -> str:
        """Register a contract function for its signature and give the SQL of its call."""
        if name == "evm_topic":
            return f"X'{evm.abi.parse_signature(signature).topic.hex()}'"
        if name == "evm_encode_hex":
            evm.evm_encode_hex(signature)
            return f"X'{signature.removeprefix('0x')}'"
        if name == "evm_decode_hex":
            return f"concat('0x', lower(hex({args[0]})))"
        if name == "evm_encode_params" and not args:
            return f"X'{evm.abi.parse_signature(signature).selector.hex()}'"
        tag = hashlib.md5((signature or "").encode()).hexdigest()[:12]
        flat = f"{self.prefix}_{name}_{tag}"
        made = self._in_jvm(name, flat, args, signature)
        if made is not None and "{udf}" not in made:
            return made
        makers = {
            "evm_decode_log": lambda: evm.log_udf(signature),
            "evm_decode": lambda: evm.log_udf(signature),
            "evm_decode_params": lambda: evm.params_udf(signature),
            "evm_encode_params": lambda: evm.encode_params_udf(signature, len(args)),
            "evm_decode_type": lambda: evm.decode_type_udf(signature),
            "evm_encode_type": lambda: evm.encode_type_udf(signature),
        }
        if name not in makers:
            raise SqlError(f"no such function: {name}")
        self.spark.udf.register(flat, makers[name]())
        call = f"{flat}({', '.join(args)})"
        if made is not None:
            return made.replace("{udf}", call)
        return f"CASE WHEN {call}.ok THEN {call}.value END" if name == "evm_decode_params" else call

    def _in_jvm(self, name: str, flat: str, args: list[str], signature: str | None) -> str | None:
        """The call of a contract function as a temporary SQL function; None for types that have no expression.

        Where what is given decides, when the query is planned, {udf} stands for the Arrow function.
        """

        def function(params: list[str], result: str, body: str) -> str:
            declared = ", ".join(f"p{k} {t}" for k, t in enumerate(params))
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {flat}_sql({declared}) RETURNS {result} RETURN {body}")
            return f"{flat}_sql"

        for statement in abisql.helpers(name) if name not in self.helped else []:
            self.spark.sql(statement)
        self.helped.add(name)
        if name == "shift_units":
            return f"{abisql.SHIFT}(CAST({args[0]} AS STRING), CAST({args[1]} AS INT))"
        if name in ("evm_decode_type", "evm_encode_type"):
            t = evm.abi.parse_type(signature)
            if not abisql.plain([t]):
                return None
            if name == "evm_decode_type":
                return f"{function(['BINARY'], evm.abi.spark_type(t).simpleString(), abisql.decode_type(t, 'p0'))}({args[0]})"
            kind = abisql.parameter(t)
            call = function([kind], "BINARY", f"CASE WHEN p0 IS NOT NULL THEN {abisql.encode_sequence([t], ['p0'])} END")
            return f"CASE WHEN {abisql.fits(t, args[0])} THEN {call}(TRY_CAST({args[0]} AS {kind})) ELSE {{udf}} END"
        parsed = evm.abi.parse_signature(signature)
        types = [p.type for p in parsed.params]
        if not types or not abisql.plain(types):
            return None
        if name == "evm_decode_params":
            names = evm.param_names(parsed)
            result = ", ".join(f"`{n}`: {evm.abi.spark_type(t).simpleString()}" for n, t in zip(names, types, strict=True))
            return f"{function(['BINARY'], f'STRUCT<{result}>', abisql.decode_params(types, names, parsed.selector, 'p0'))}({args[0]})"
        if name in ("evm_decode_log", "evm_decode"):
            shown, body, names = evm.log_fields(parsed)
            result = ", ".join(f"`{n}`: {evm.abi.spark_type(t).simpleString()}" for n, t in zip(names, shown + body, strict=True))
            call = function(["BINARY"] * 4, f"STRUCT<{result}>", abisql.decode_log(shown, body, names, ["p0", "p1", "p2"], "p3"))
            return f"{call}({', '.join(args)})"
        if name == "evm_encode_params" and len(args) == len(types):
            kinds = [abisql.parameter(t) for t in types]
            own = [f"p{k}" for k in range(len(types))]
            null = " OR ".join(f"{p} IS NULL" for p in own)
            failed = f"CAST(raise_error('null for {parsed}') AS BINARY)"
            call = function(kinds, "BINARY", f"CASE WHEN {null} THEN {failed} ELSE concat(X'{parsed.selector.hex()}', {abisql.encode_sequence(types, own)}) END")
            given = ", ".join(f"TRY_CAST({a} AS {k})" for a, k in zip(args, kinds, strict=True))
            return f"CASE WHEN {' AND '.join(abisql.fits(t, a) for t, a in zip(types, args, strict=True))} THEN {call}({given}) ELSE {{udf}} END"
        return None

    def translate(self, sql: str, stream: bool | None = None) -> Statement:
        return Translator(self._view, self._contract, lambda d, n: self.user.get((d.lower(), n.lower()))).translate(sql, stream)

    # Running ------------------------------------------------------------------

    def _run(self, sql: str) -> DataFrame:
        """The DataFrame of translated SQL, which must be a query: commands would run at once."""
        read_only(self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))
        return self.spark.sql(sql)

    def sql(self, sql: str) -> DataFrame:
        """Run a statement once; also DESCRIBE of a table or query, and EXPLAIN [ANALYZE]."""
        tokens = one_statement(tokenize(sql))
        if tokens[0].low in ("describe", "desc"):
            return self._describe(tokens[1:])
        if tokens[0].low == "explain":
            analyze = len(tokens) > 1 and tokens[1].low == "analyze"
            return self._explained(join([t for t in tokens[2 if analyze else 1 :] if t.low != "verbose"]), analyze)
        statement = self.translate(sql)
        if statement.stream:
            raise SqlError("a streaming statement runs by stream()")
        if statement.uses_block_num:
            raise SqlError("block_num() is only supported in streaming queries")
        df = self._run(statement.sql)
        planner.check_output(df.columns)
        return df

    def _describe(self, tokens: list) -> DataFrame:
        if tokens and tokens[0].low == "table":
            tokens = tokens[1:]
        if not tokens:
            raise SqlError("DESCRIBE what?")
        query = tokens[0].low in ("select", "with", "values", "from", "(")
        schema = self.sql(join(tokens) if query else f"SELECT * FROM {join(tokens)}").schema
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO") for f in schema], "column_name string, data_type string, is_nullable string")

    def _explained(self, sql: str, analyze: bool) -> DataFrame:
        """Rows (plan_type, plan); ANALYZE runs the statement and gives what each operator put out."""
        if analyze:
            execution = self.sql(sql)._jdf.queryExecution()
            execution.toRdd().count()
            rows = [("Plan with Metrics", "\n".join(_with_metrics(execution.executedPlan())))]
        else:
            logical, _, physical = self.explain(sql).partition("== Physical Plan ==")
            rows = [("logical_plan", logical.strip()), ("physical_plan", physical.strip())]
        return self.spark.createDataFrame([(k, _without_paths(p)) for k, p in rows], "plan_type string, plan string")

    def explain(self, sql: str) -> str:
        """The plan of a statement, with paths of data files cut to their names."""
        return _without_paths(self.sql(sql)._jdf.queryExecution().toString())

    def incremental(self, sql: str) -> planner.Incremental:
        """A statement prepared for running by block ranges; an error if it cannot be."""
        statement = self.translate(sql, True)
        networks = {self.networks[t] for t in statement.tables} - {None}
        if len(networks) > 1:
            raise SqlError(f"streaming over several networks: {', '.join(sorted(networks))}")
        df = self._run(statement.sql)
        planner.check_output([c for c in df.columns if c != BLOCK])
        return planner.Incremental(self.spark, df, {t for t in statement.tables if self.networks[t] is not None}, statement)

    def stream(self, sql: str, **options) -> Iterator:
        from .streaming.query import StreamingQuery

        return StreamingQuery(self, sql, **options).messages()


def _without_paths(plan: str) -> str:
    """A plan with paths of data files cut to their names."""
    return re.sub(r"(?:\w+:)?/(?:[^/\s,\[\]]+/)+([^/\s,\]]*)", r"\1", plan)


def _with_metrics(node, depth: int = 0) -> list[str]:
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _with_metrics(node.executedPlan(), depth)
    if kind.endswith("QueryStageExec"):
        return _with_metrics(node.plan(), depth)
    metrics, found = node.metrics(), []
    names = metrics.keys().toSeq()
    for i in range(names.size()):
        value = metrics.apply(names.apply(i))
        if value.value() > 0:
            found.append(f"{names.apply(i)}={value.value()}")
    children = node.children()
    lines = [f"{'  ' * depth}{node.nodeName()} [{', '.join(sorted(found))}]"]
    return lines + [line for i in range(children.size()) for line in _with_metrics(children.apply(i), depth + 1)]
