"""Recursive length prefixes, and roots of Merkle-Patricia tries of lists (Ethereum yellow paper, appendices B to D)."""

from __future__ import annotations

from dataclasses import dataclass, field

from .keccak import keccak256_many


def _head(base: int, size: int) -> bytes:
    if size < 56:
        return bytes([base + size])
    digits = size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([base + 55 + len(digits)]) + digits


def rlp(value) -> bytes:
    """Of bytes, of numbers from 0 (shortest big-endian form), and of lists of these."""
    if isinstance(value, list):
        return joined([rlp(v) for v in value])
    if isinstance(value, int):
        value = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return value if len(value) == 1 and value[0] < 0x80 else _head(0x80, len(value)) + value


def joined(encoded: list[bytes]) -> bytes:
    """The list of items that are encoded already."""
    body = b"".join(encoded)
    return _head(0xC0, len(body)) + body


@dataclass
class _Node:
    """A leaf (path, value), an extension (path, one child) or a branch (children by their nibble)."""

    path: list[int]
    value: bytes | None = None
    children: dict[int, _Node] = field(default_factory=dict)
    height: int = 0
    reference: bytes = b""

    def encode(self) -> bytes:
        if self.value is not None:
            return joined([rlp(_compact(self.path, 2)), rlp(self.value)])
        if self.path:
            return joined([rlp(_compact(self.path, 0)), self.children[0].reference])
        return joined([self.children[n].reference if n in self.children else rlp(b"") for n in range(16)] + [rlp(b"")])


def _compact(path: list[int], flag: int) -> bytes:
    nibbles = [flag + 1, *path] if len(path) % 2 else [flag, 0, *path]
    return bytes(16 * a + b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))


def _build(entries: list[tuple[list[int], bytes]], at: int, levels: list[list[_Node]]) -> _Node:
    """The node over entries in order of their paths, which agree before `at`; no path is another's beginning."""
    first, last = entries[0][0], entries[-1][0]
    shared = 0
    while len(entries) > 1 and first[at + shared] == last[at + shared]:
        shared += 1
    if len(entries) == 1:
        node = _Node(first[at:], entries[0][1])
    elif shared:
        node = _Node(first[at : at + shared], children={0: _build(entries, at + shared, levels)})
    else:
        groups: dict[int, list] = {}
        for entry in entries:
            groups.setdefault(entry[0][at], []).append(entry)
        node = _Node([], children={n: _build(g, at + 1, levels) for n, g in groups.items()})
    node.height = 1 + max((c.height for c in node.children.values()), default=-1)
    while len(levels) <= node.height:
        levels.append([])
    levels[node.height].append(node)
    return node


def trie_roots(lists: list[list[bytes]]) -> list[bytes]:
    """For each list, the root of the trie that has every item under the encoding of its place.

    Nodes of one height are hashed together, over all lists.
    """
    levels: list[list[_Node]] = []
    tops: list[_Node | None] = []
    for items in lists:
        paths = [[n for b in rlp(i) for n in (b >> 4, b & 15)] for i in range(len(items))]
        entries = sorted(zip(paths, items, strict=True))
        tops.append(_build(entries, 0, levels) if entries else None)
    roots = {id(t) for t in tops}
    whole: dict[int, bytes] = {}
    for nodes in levels:
        encoded = [n.encode() for n in nodes]
        long = [k for k, e in enumerate(encoded) if len(e) >= 32]
        hashes = dict(zip(long, keccak256_many([encoded[k] for k in long]), strict=True))
        for k, node in enumerate(nodes):
            node.reference = rlp(hashes[k]) if k in hashes else encoded[k]
            if id(node) in roots:
                whole[id(node)] = encoded[k]
    return keccak256_many([whole[id(t)] if t else rlp(b"") for t in tops])
