"""Keccak-256 (the original padding), from the permutation's definition.

Rotation offsets and round constants are produced by the rules of the
specification: offsets by walking the lane matrix, constants by the LFSR.
"""

from __future__ import annotations

import numpy as np
_MASK = (1 << 64) - 1
_RATE = 136


def _round_constants() -> list[int]:
    out, state = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if state & 1:
                value |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        out.append(value)
    return out


def _offsets() -> dict[tuple[int, int], int]:
    out, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


_CONSTANTS, _TURNS = _round_constants(), _offsets()


def _rotate(v: int, n: int) -> int:
    return ((v << n) | (v >> (64 - n))) & _MASK if n else v


def _permute(a: list[list[int]]) -> list[list[int]]:
    for constant in _CONSTANTS:
        parity = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        flow = [parity[x - 1] ^ _rotate(parity[(x + 1) % 5], 1) for x in range(5)]
        b = [[0] * 5 for _ in range(5)]
        for x in range(5):
            for y in range(5):
                b[y][(2 * x + 3 * y) % 5] = _rotate(a[x][y] ^ flow[x], _TURNS[x, y])
        a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
        a[0][0] ^= constant
    return a


def keccak256(data: bytes) -> bytes:
    padded = bytearray(data + b"\x01" + bytes(-(len(data) + 1) % _RATE))
    padded[-1] |= 0x80
    state = [[0] * 5 for _ in range(5)]
    for at in range(0, len(padded), _RATE):
        for i in range(_RATE // 8):
            state[i % 5][i // 5] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        state = _permute(state)
    return b"".join(state[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


def keccak256_many(messages: list[bytes]) -> list[bytes]:
    """The hashes of many messages: those of as many blocks go through the permutation together, a lane an array."""
    out: list[bytes] = [b""] * len(messages)
    by_size: dict[int, list[int]] = {}
    for k, m in enumerate(messages):
        by_size.setdefault(len(m) // _RATE + 1, []).append(k)
    for size, places in by_size.items():
        padded = np.zeros((len(places), size * _RATE), np.uint8)
        for row, k in enumerate(places):
            padded[row, : len(messages[k])] = np.frombuffer(messages[k], np.uint8)
            padded[row, len(messages[k])] = 1
        padded[:, -1] |= 0x80
        words = padded.view("<u8").reshape(len(places), size, _RATE // 8)
        state = [[np.zeros(len(places), np.uint64) for _ in range(5)] for _ in range(5)]
        for at in range(size):
            for i in range(_RATE // 8):
                state[i % 5][i // 5] ^= words[:, at, i]
            state = _permute(state)
        digests = np.stack([state[i][0] for i in range(4)], axis=1).astype("<u8").tobytes()
        for row, k in enumerate(places):
            out[k] = digests[32 * row : 32 * row + 32]
    return out
