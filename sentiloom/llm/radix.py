"""Adaptive radix trees over byte strings.

A node keeps the bytes that all keys below it share (path compression) and its
children by their next byte, in one of four layouts that grow with their
number: 4 or 16 sorted bytes, an index of 48 slots, or 256 places.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator


class Sorted:
    """Up to ``size`` children beside their sorted bytes."""

    __slots__ = ("size", "bytes", "kids")

    def __init__(self, size: int):
        self.size, self.bytes, self.kids = size, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = self.bytes.find(byte)
        return None if at < 0 else self.kids[at]

    def put(self, byte: int, kid: Node):
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.kids[at] = kid
            return self
        if len(self.kids) == self.size:
            return moved(self, Sorted(16) if self.size == 4 else Indexed()).put(byte, kid)
        self.bytes.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.kids)


class Indexed:
    """Up to 48 children; each of 256 bytes has the number of its slot, or 0."""

    __slots__ = ("slots", "kids")

    def __init__(self):
        self.slots, self.kids = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        at = self.slots[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, kid: Node):
        at = self.slots[byte]
        if at:
            self.kids[at - 1] = kid
            return self
        if len(self.kids) == 48:
            return moved(self, Full()).put(byte, kid)
        self.kids.append(kid)
        self.slots[byte] = len(self.kids)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.kids[at - 1]) for b, at in enumerate(self.slots) if at)


class Full:
    """A place for each byte."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.kids[byte]

    def put(self, byte: int, kid: Node):
        self.kids[byte] = kid
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, k) for b, k in enumerate(self.kids) if k is not None)


def moved(small, large):
    for byte, kid in small.items():
        large = large.put(byte, kid)
    return large


class Node:
    """``prefix`` follows the byte that leads here; ``row`` is of some key below."""

    __slots__ = ("prefix", "kids", "row", "value")

    def __init__(self, prefix: bytes, row: int):
        self.prefix, self.kids, self.row, self.value = prefix, Sorted(4), row, None


def shared(a: bytes, b: bytes) -> int:
    """How many first bytes are equal."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    bits = (int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length()
    return n - (bits + 7) // 8


class Tree:
    """Keys with values that ``combine`` adds up, at one key and over all keys below a node."""

    def __init__(self, combine: Callable):
        self.root, self.combine = None, combine

    def insert(self, key: bytes, row: int, value) -> None:
        node = self._place(key, row)
        node.value = value if node.value is None else self.combine(node.value, value)

    def _place(self, key: bytes, row: int) -> Node:
        if self.root is None:
            self.root = Node(key, row)
            return self.root
        parent, byte, node, at = None, 0, self.root, 0
        while True:
            if not key.startswith(node.prefix, at):
                same = shared(node.prefix, key[at : at + len(node.prefix)])
                top = Node(node.prefix[:same], node.row)
                top.kids.put(node.prefix[same], node)
                node.prefix = node.prefix[same + 1 :]
                if parent is None:
                    self.root = top
                else:
                    parent.kids.put(byte, top)
                node = top
            at += len(node.prefix)
            if at == len(key):
                return node
            byte = key[at]
            at += 1
            kid = node.kids.get(byte)
            if kid is None:
                kid = Node(key[at:], row)
                node.kids = node.kids.put(byte, kid)
                return kid
            parent, node = node, kid

    def nodes(self) -> Iterator[tuple[int, int, int, object]]:
        """``(row, begin, end, value)``: the node covers key lengths above ``begin`` up to ``end``.

        No key ends and no two part in between; ``value`` combines all keys of
        at least these lengths.  The root begins below zero.
        """
        if self.root is None:
            return
        order = [(self.root, None, -1, len(self.root.prefix))]
        i = 0
        while i < len(order):
            node, _, _, end = order[i]
            order.extend((kid, i, end, end + 1 + len(kid.prefix)) for _, kid in node.kids.items())
            i += 1
        totals = [node.value for node, *_ in order]
        for i in range(len(order) - 1, -1, -1):
            node, parent, begin, end = order[i]
            yield node.row, begin, end, totals[i]
            if parent is not None:
                totals[parent] = totals[i] if totals[parent] is None else self.combine(totals[parent], totals[i])
