"""Encodings against published values, tries against a plain recursive one, and tampered blocks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from blockloom.functions.keccak import keccak256, keccak256_many
from blockloom.functions.rlp import rlp, trie_roots
from blockloom.operators import verify as V

EMPTY_ROOT = bytes.fromhex("56e81f171bcc55a6ff8345e692c0f86e5b48e01b996cadc001622fb5e363b421")
BLOCKS = (
    "_block_num long, block_num long, timestamp timestamp, hash binary, parent_hash binary, ommers_hash binary, miner binary, state_root binary, transactions_root binary, receipt_root binary, logs_bloom binary, "
    "difficulty decimal(38,0), gas_limit long, gas_used long, extra_data binary, mix_hash binary, nonce long, base_fee_per_gas decimal(38,0), withdrawals_root binary, blob_gas_used long, excess_blob_gas long, "
    "parent_beacon_root binary, requests_hash binary"
)
TRANSACTIONS = (
    "_block_num long, block_num long, tx_index long, type int, nonce long, gas_price decimal(38,0), max_fee_per_gas decimal(38,0), max_priority_fee_per_gas decimal(38,0), max_fee_per_blob_gas decimal(38,0), "
    "gas_limit long, `to` binary, value string, input binary, r binary, s binary, v_parity boolean, chain_id long, gas_used long, status boolean, state_root binary, "
    "access_list array<struct<address: binary, storage_keys: array<binary>>>, blob_versioned_hashes array<binary>, "
    "authorization_list array<struct<chain_id: bigint, address: binary, nonce: bigint, y_parity: boolean, r: binary, s: binary>>"
)
LOGS = "_block_num long, block_num long, tx_index long, log_index long, address binary, topic0 binary, topic1 binary, topic2 binary, topic3 binary, data binary"
SIGNED = {"r": bytes.fromhex("28ef61340bd939bc2195fe537567866003e1a15d3c71ff63e1590620aa636276"), "s": bytes.fromhex("67cbe9d8997f761aecb703304b3800ccf556c9f3dc64214b297fb1966a3b6d83")}


def genesis() -> dict:
    """The first block of the main network."""
    return {
        "_block_num": 0, "block_num": 0, "seconds": 0, "hash": bytes.fromhex("d4e56740f876aef8c010b86a40d5f56745a118d0906a34e69aec8c0db1cb8fa3"), "parent_hash": bytes(32), "ommers_hash": keccak256(rlp([])), "miner": bytes(20),
        "state_root": bytes.fromhex("d7f8974fb5ac78d9ac099b9ad5018bedc2ce0a72dad1827a1709da30580f0544"), "transactions_root": EMPTY_ROOT, "receipt_root": EMPTY_ROOT, "logs_bloom": bytes(256), "difficulty": 0x400000000,
        "gas_limit": 5000, "gas_used": 0, "extra_data": bytes.fromhex("11bbe8db4e347b4e8c937c1c8370e4b5ed33adb3db69cbdb7a38e1e50b1b82fa"), "mix_hash": bytes(32), "nonce": 0x42,
        **dict.fromkeys(V.LATER),
    }


def transaction(number: int, index: int, kind: int) -> dict:
    return {
        "_block_num": number, "block_num": number, "tx_index": index, "type": kind, "nonce": 9 + index, "gas_price": 20 * 10**9, "max_fee_per_gas": 30 * 10**9, "max_priority_fee_per_gas": 10**9, "max_fee_per_blob_gas": 7,
        "gas_limit": 21000, "to": None if index == 3 else b"\x35" * 20, "value": str(10**18 + index), "input": bytes(index), **SIGNED, "v_parity": index % 2 == 1, "chain_id": None if index == 1 and kind == 0 else 1,
        "gas_used": 21000 * (index + 1), "status": index % 3 != 0, "state_root": b"\x07" * 32 if index == 2 else None, "access_list": [{"address": b"\x01" * 20, "storage_keys": [b"\x02" * 32]}],
        "blob_versioned_hashes": [b"\x03" * 32], "authorization_list": [{"chain_id": 1, "address": b"\x04" * 20, "nonce": 5, "y_parity": True, "r": b"\x05" * 32, "s": b"\x06" * 32}],
    }


def logs_of(number: int, index: int) -> list[dict]:
    topics = [b"\x0a" * 32, b"\x0b" * 32, None, None]
    return [{"_block_num": number, "block_num": number, "tx_index": index, "log_index": 10 * index + k, "address": b"\x22" * 20, **{f"topic{i}": t for i, t in enumerate(topics)}, "data": bytes([k])} for k in range(index % 3)]


def plain_root(items: list[bytes]) -> bytes:
    """A trie by the definition, node by node."""

    def compact(path, leaf):
        flag = 2 * leaf + len(path) % 2
        nibbles = ([flag] if len(path) % 2 else [flag, 0]) + path
        return bytes(nibbles[i] * 16 + nibbles[i + 1] for i in range(0, len(nibbles), 2))

    def node(pairs):
        if len(pairs) == 1:
            return [compact(pairs[0][0], 1), pairs[0][1]]
        shared = len(os.path.commonprefix([p for p, _ in pairs]))
        if shared:
            return [compact(pairs[0][0][:shared], 0), short([(p[shared:], v) for p, v in pairs])]
        return [short([(p[1:], v) for p, v in pairs if p[0] == n]) for n in range(16)] + [b""]

    def short(pairs):
        if not pairs:
            return b""
        made = node(pairs)
        return made if len(rlp(made)) < 32 else keccak256(rlp(made))

    if not items:
        return keccak256(rlp(b""))
    return keccak256(rlp(node([([n for b in rlp(i) for n in divmod(b, 16)], v) for i, v in enumerate(items)])))


def test_hashes_and_tries():
    rng = random.Random(5)
    messages = [rng.randbytes(n) for n in (0, 1, 135, 136, 137, 271, 272, 500)] * 2
    assert keccak256_many(messages) == [keccak256(m) for m in messages] and keccak256_many([]) == []
    lists = [[rng.randbytes(rng.randint(1, 90)) for _ in range(n)] for n in (0, 1, 2, 16, 127, 128, 129, 300)] + [[b"a", b"b"]]
    assert trie_roots(lists) == [plain_root(items) for items in lists]
    assert trie_roots([[]]) == [EMPTY_ROOT]


def test_published_values():
    block = genesis()
    assert keccak256(V.header(block)) == block["hash"]
    tx = {**transaction(0, 0, 0), "nonce": 9, "value": str(10**18), "v_parity": False}
    assert V.envelope(tx).hex() == (
        "f86c098504a817c800825208943535353535353535353535353535353535353535880de0b6b3a76400008025a028ef61340bd939bc2195fe537567866003e1a15d3c71ff63e1590620aa636276a0"
        "67cbe9d8997f761aecb703304b3800ccf556c9f3dc64214b297fb1966a3b6d83"
    )


@pytest.fixture(scope="module")
def chain(spark):
    blocks, txs, logs = [], [], []
    for n in range(8):
        own = [transaction(n, i, i % 5 if n > 1 else 0) for i in range(0 if n == 0 else 20 * n)]
        marks = [g for t in own for g in logs_of(n, t["tx_index"])]
        hashes = {m: keccak256(m) for g in marks for m in V._marks(g)}
        block = {**genesis(), "_block_num": n, "block_num": n, "seconds": 12 * n}
        if n > 3:
            block |= {"base_fee_per_gas": 7, "withdrawals_root": b"\x09" * 32, "blob_gas_used": 0, "excess_blob_gas": 0, "parent_beacon_root": bytes(32)}
        if n:
            block["transactions_root"] = plain_root([V.envelope(t) for t in own])
            block["receipt_root"] = plain_root([V.receipt(t, [g for g in marks if g["tx_index"] == t["tx_index"]], hashes) for t in own])
            block["hash"] = keccak256(V.header(block))
        blocks.append(block)
        txs += own
        logs += marks

    def frame(rows, schema):
        from pyspark.sql import types as T

        made = T._parse_datatype_string(schema)
        names = made.names
        cast = {f.name for f in made if isinstance(f.dataType, T.DecimalType)}
        from decimal import Decimal

        return spark.createDataFrame([tuple(Decimal(r[c]) if c in cast and r[c] is not None else r[c] for c in names) for r in rows], made)

    import datetime

    for b in blocks:
        b["timestamp"] = datetime.datetime.fromtimestamp(b["seconds"], datetime.UTC)
    rng = random.Random(1)
    rng.shuffle(txs)
    rng.shuffle(logs)
    return frame(blocks, BLOCKS), frame(txs, TRANSACTIONS), frame(logs, LOGS)


def failures(*tables, **options):
    return {r.block_num: r.failed for r in V.verify(*tables, **options).collect()}


def test_whole_chain_holds(chain):
    assert failures(*chain) == dict.fromkeys(range(8))
    assert sorted(failures(*chain, start=2, end=4)) == [2, 3, 4]
    empty = [t.limit(0) for t in chain]
    assert failures(*empty) == {}


def test_tampering_is_found(chain):
    blocks, txs, logs = chain
    assert failures(blocks, txs.filter("NOT (block_num = 5 AND tx_index = 7)"), logs)[5] == "transactions root"
    assert failures(blocks, txs, logs.filter("NOT (block_num = 6 AND log_index = 10)"))[6] == "receipts root"
    got = failures(blocks.withColumn("gas_used", F.expr("gas_used + IF(block_num = 3, 1, 0)")), txs, logs)
    assert {n for n, f in got.items() if f} == {3} and got[3] == "block hash"
    odd = {r.block_num: (r.failed, r.message) for r in V.verify(blocks, txs.withColumn("type", F.expr("CAST(IF(block_num = 2 AND tx_index = 1, 9, type) AS INT)")), logs).collect()}
    assert odd[2] == ("transaction", "transaction 1 has the unknown type 9")
    lacking = {r.block_num: r.message for r in V.verify(blocks, txs.withColumn("max_fee_per_gas", F.expr("IF(block_num = 4, NULL, max_fee_per_gas)")), logs).collect()}
    assert "has no max_fee_per_gas" in lacking[4] and lacking[3] is None
