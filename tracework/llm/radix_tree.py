"""An adaptive radix tree over byte strings.

A node holds the bytes that all keys below it share (path compression) and its
children in the smallest layout that takes them: up to 4 or 16 sorted bytes with
children beside them, a table of 256 bytes that point at up to 48 children, or
256 children by byte. Nodes grow from one layout to the next. A key may be a
prefix of another; its value lies in the node it ends at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any


class Node:
    __slots__ = ("path", "value", "layout", "index", "children")

    def __init__(self, path: bytes, value: Any = None):
        self.path, self.value = path, value
        self.layout, self.index, self.children = 0, None, None  # a leaf

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            if not self.layout:
                return None
            at = bisect_left(self.index, byte)
            return self.children[at] if at < len(self.index) and self.index[at] == byte else None
        if self.layout == 48:
            return self.children[self.index[byte] - 1] if self.index[byte] else None
        return self.children[byte]

    def put(self, byte: int, node: Node) -> None:
        """A new child, or another one for a byte that has a child."""
        if self.layout == 0:
            self.layout, self.index, self.children = 4, bytearray(), []
        if self.layout <= 16:
            at = bisect_left(self.index, byte)
            if at < len(self.index) and self.index[at] == byte:
                self.children[at] = node
                return
            if len(self.children) < self.layout:
                self.index.insert(at, byte)
                self.children.insert(at, node)
                return
            if self.layout == 4:
                self.layout = 16
            else:
                places = bytearray(256)
                for place, b in enumerate(self.index, 1):
                    places[b] = place
                self.layout, self.index = 48, places
            return self.put(byte, node)
        if self.layout == 48:
            if self.index[byte]:
                self.children[self.index[byte] - 1] = node
                return
            if len(self.children) < 48:
                self.children.append(node)
                self.index[byte] = len(self.children)
                return
            self.children = [self.children[p - 1] if p else None for p in self.index]
            self.layout, self.index = 256, None
        self.children[byte] = node

    def ordered(self) -> list[tuple[int, Node]]:
        """Children by their bytes."""
        if self.layout == 0:
            return []
        if self.layout <= 16:
            return list(zip(self.index, self.children))
        if self.layout == 48:
            return [(b, self.children[p - 1]) for b, p in enumerate(self.index) if p]
        return [(b, c) for b, c in enumerate(self.children) if c is not None]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    low, high = 0, size  # the first ``low`` bytes agree, the first ``high`` do not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTree:
    def __init__(self) -> None:
        self.root: Node | None = None

    def insert(self, key: bytes, value: Any) -> None:
        if self.root is None:
            self.root = Node(key, value)
            return
        node, above, edge, at = self.root, None, 0, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                same = common(path, key[at : at + len(path)])
                split = Node(path[:same])
                split.put(path[same], node)
                node.path = path[same + 1 :]
                if at + same == len(key):
                    split.value = value
                else:
                    split.put(key[at + same], Node(key[at + same + 1 :], value))
                if above is None:
                    self.root = split
                else:
                    above.put(edge, split)
                return
            at += len(path)
            if at == len(key):
                node.value = value
                return
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            node, above, edge, at = below, node, key[at], at + 1

    def walk(self) -> Iterator[tuple[int, bytes, Node, bool, bool]]:
        """Nodes before their children, in the order of keys: bytes above the node, its own bytes (with the byte that leads to it), the node, and whether it lies on the way to the least and to the greatest key."""
        if self.root is None:
            return
        stack = [(0, self.root.path, self.root, True, True)]
        while stack:
            at, own, node, least, greatest = stack.pop()
            yield at, own, node, least, greatest
            below = node.ordered()
            for i in range(len(below) - 1, -1, -1):
                byte, child = below[i]
                first, last = i == 0 and node.value is None, i == len(below) - 1
                stack.append((at + len(own), bytes((byte,)) + child.path, child, least and first, greatest and last))
