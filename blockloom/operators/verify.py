"""Verification: block hashes, transaction roots and receipt roots, computed anew from stored rows.

Transactions and logs meet their block in one shuffle each; a block's rows are bounded
by the chain's limit of gas, so that they fit in one row.  Blocks are then checked in
small groups on the executors, whose hashes are computed together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keccak import keccak256_many
from ..functions.rlp import rlp, trie_roots

RESULT = "block_num long, failed string, expected binary, computed binary, message string"
#: Blocks whose hashes are computed together.
GROUP = 32
#: Header fields in the order of the header, after which come those that later forks have added.
HEADER = ["parent_hash", "ommers_hash", "miner", "state_root", "transactions_root", "receipt_root", "logs_bloom", "difficulty", "block_num", "gas_limit", "gas_used", "seconds", "extra_data", "mix_hash"]
LATER = ["base_fee_per_gas", "withdrawals_root", "blob_gas_used", "excess_blob_gas", "parent_beacon_root", "requests_hash"]
TRANSACTION = [
    "tx_index", "type", "nonce", "gas_price", "max_fee_per_gas", "max_priority_fee_per_gas", "max_fee_per_blob_gas", "gas_limit", "to", "value", "input", "r", "s", "v_parity",
    "chain_id", "gas_used", "status", "state_root", "access_list", "blob_versioned_hashes", "authorization_list",
]
LOG = ["tx_index", "log_index", "address", "topic0", "topic1", "topic2", "topic3", "data"]


class Unverifiable(ValueError):
    """A row that has no canonical encoding."""


def _number(v) -> int:
    return int(v) & (1 << 64) - 1 if isinstance(v, int) and v < 0 else int(v)


def _word(v: bytes) -> int:
    return int.from_bytes(v, "big")


def header(block: dict) -> bytes:
    out = [_number(block[c]) if not isinstance(block[c], bytes) else block[c] for c in HEADER]
    out.append(_number(block["nonce"]).to_bytes(8, "big"))
    later = [block[c] for c in LATER]
    out += [v if isinstance(v, bytes) else _number(v) for v in later if v is not None]
    return rlp(out)


def envelope(tx: dict) -> bytes:
    """A signed transaction as it stands in its block's trie (EIP-155, 2930, 1559, 4844, 7702)."""

    def need(*names: str) -> list:
        for name in names:
            if tx[name] is None:
                raise Unverifiable(f"transaction {tx['tx_index']} of type {tx['type']} has no {name}")
        return [_number(tx[name]) for name in names]

    kind, parity = tx["type"], int(tx["v_parity"])
    signature = [_word(tx["r"]), _word(tx["s"])]
    call = [tx["to"] or b"", int(tx["value"]), tx["input"]]
    access = [[a["address"], list(a["storage_keys"])] for a in tx["access_list"] or []]
    if kind == 0:
        v = 27 + parity if tx["chain_id"] is None else 35 + 2 * tx["chain_id"] + parity
        return rlp([*need("nonce", "gas_price", "gas_limit"), *call, v, *signature])
    if kind == 1:
        body = [*need("chain_id", "nonce", "gas_price", "gas_limit"), *call, access]
    elif kind in (2, 3, 4):
        body = [*need("chain_id", "nonce", "max_priority_fee_per_gas", "max_fee_per_gas", "gas_limit"), *call, access]
        if kind == 3:
            body += [*need("max_fee_per_blob_gas"), list(tx["blob_versioned_hashes"] or [])]
        if kind == 4:
            body.append([[_number(a["chain_id"]), a["address"], _number(a["nonce"]), int(a["y_parity"]), _word(a["r"]), _word(a["s"])] for a in tx["authorization_list"] or []])
    else:
        raise Unverifiable(f"transaction {tx['tx_index']} has the unknown type {kind}")
    return bytes([kind]) + rlp([*body, parity, *signature])


def _marks(log: dict) -> list[bytes]:
    return [log["address"], *(t for t in (log[f"topic{k}"] for k in range(4)) if t is not None)]


def _bloom(marks: list[bytes], hashes: dict[bytes, bytes]) -> bytes:
    bits = 0
    for mark in marks:
        h = hashes[mark]
        for k in (0, 2, 4):
            bits |= 1 << (int.from_bytes(h[k : k + 2], "big") & 2047)
    return bits.to_bytes(256, "big")


def receipt(tx: dict, logs: list[dict], hashes: dict[bytes, bytes]) -> bytes:
    """A receipt as it stands in its block's trie; gas_used is cumulative, and state_root takes the place of status before Byzantium."""
    outcome = tx["state_root"] if tx["state_root"] is not None else int(tx["status"])
    bloom = _bloom([m for log in logs for m in _marks(log)], hashes)
    body = rlp([outcome, _number(tx["gas_used"]), bloom, [[_marks(log)[0], _marks(log)[1:], log["data"]] for log in logs]])
    return body if tx["type"] == 0 else bytes([tx["type"]]) + body


def check(blocks: list[dict]) -> Iterator[tuple]:
    """The result row of each block: the first of its commitments that does not hold, if any."""
    lists: list[list[bytes]] = []
    errors: list[str | None] = []
    marks = list({m for b in blocks for log in b["logs"] or [] for m in _marks(log)})
    hashes = dict(zip(marks, keccak256_many(marks), strict=True))
    for b in blocks:
        txs = sorted(b["transactions"] or [], key=lambda t: t["tx_index"])
        of: dict[int, list] = {}
        for log in sorted(b["logs"] or [], key=lambda g: g["log_index"]):
            of.setdefault(log["tx_index"], []).append(log)
        try:
            lists += [[envelope(t) for t in txs], [receipt(t, of.get(t["tx_index"], []), hashes) for t in txs]]
            errors.append(None)
        except Unverifiable as e:
            lists += [[], []]
            errors.append(str(e))
    roots = trie_roots(lists)
    heads = keccak256_many([header(b) for b in blocks])
    for k, b in enumerate(blocks):
        tests = [("block hash", b["hash"], heads[k]), ("transactions root", b["transactions_root"], roots[2 * k]), ("receipts root", b["receipt_root"], roots[2 * k + 1])]
        wrong = next(((n, e, c) for n, e, c in tests[: 1 if errors[k] else 3] if e != c), None)
        if wrong is None and errors[k]:
            wrong = ("transaction", None, None)
        yield (b["block_num"], *(wrong or (None, None, None)), errors[k] if wrong and wrong[0] == "transaction" else None)


def _gathered(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    return rows.groupBy("block_num").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in columns])).alias(name))


def verify(blocks: DataFrame, transactions: DataFrame, logs: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row for each block from start to end: `failed` names what does not hold (null where all does), with both values.

    Blocks without transactions or logs are held against the empty trie; rows whose
    block is not in `blocks` are not looked at; a transaction that lacks a field of
    its type, or has an unknown one, fails its block with a message.
    """
    blocks.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))

    def ranged(df: DataFrame) -> DataFrame:
        bounds: list[Column] = [F.col("_block_num") >= start] if start is not None else []
        bounds += [F.col("_block_num") <= end] if end is not None else []
        for b in bounds:
            df = df.filter(b)
        return df

    head = ranged(blocks).select("hash", *[c for c in HEADER if c != "seconds"], F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("seconds"), "nonce", *LATER)
    met = head.join(_gathered(ranged(transactions), TRANSACTION, "transactions"), "block_num", "left").join(_gathered(ranged(logs), LOG, "logs"), "block_num", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                rows = list(check(batch.slice(at, GROUP).to_pylist()))
                types = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string()]
                names = ["block_num", "failed", "expected", "computed", "message"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return met.mapInArrow(run, RESULT)
