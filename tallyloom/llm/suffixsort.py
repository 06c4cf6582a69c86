"""Deep-shallow ordering of byte strings: multikey quicksort, then blind tries."""

from __future__ import annotations

import numpy as np

#: Depth in bytes to which multikey quicksort goes; what still ties is ordered by a blind trie.
SHALLOW = 16
#: Ranges of up to this many strings go to the blind trie at once.
FEW = 12


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], among: list[int]) -> list[int]:
    """``among`` in the order of its strings, which may repeat and be prefixes of each other.

    A node is ``[depth, children, ends]``: children by the byte at ``depth``, and
    the strings that end there. Descent looks at branching bytes only; one
    comparison against any leaf below then gives the true branching depth.
    """
    first = among[0]
    root = [len(strings[first]), {}, [first]]
    for j in among[1:]:
        s = strings[j]
        node = root
        while node[1]:
            at = node[0]
            below = node[1].get(s[at]) if at < len(s) else None
            node = below or next(iter(node[1].values()))
        depth = common_prefix(s, strings[node[2][0]])
        parent, node = None, root
        while node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if node[0] > depth:
            other = strings[_leaf(node)]
            split = [depth, {other[depth]: node}, []]
            if parent is None:
                root = split
            else:
                parent[1][s[parent[0]]] = split
            node = split
        if len(s) == depth:
            node[2].append(j)
        else:
            node[1][s[depth]] = [len(s), {}, [j]]
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.extend(node[2])
        stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
    return out


def _leaf(node: list) -> int:
    while not node[2]:
        node = next(iter(node[1].values()))
    return node[2][0]


def order(strings: list[bytes], ranges: list[tuple[int, int]], known: int = 0) -> np.ndarray:
    """Positions of ``strings`` with every range [lo, hi) sorted in itself; its strings share ``known`` bytes."""
    out = np.arange(len(strings))
    symbols: dict[int, np.ndarray] = {}

    def symbol(depth: int, which: np.ndarray) -> np.ndarray:
        if depth not in symbols:
            cut = b"".join(s[depth : depth + 8].ljust(8, b"\0") for s in strings)
            symbols[depth] = np.frombuffer(cut, dtype=">u8").astype(np.uint64)
        return symbols[depth][which]

    todo = [(lo, hi, known) for lo, hi in ranges if hi - lo > 1]
    while todo:
        lo, hi, depth = todo.pop()
        part = out[lo:hi]
        if hi - lo <= FEW or depth >= known + SHALLOW:
            out[lo:hi] = blind_trie(strings, part.tolist())
            continue
        key = symbol(depth, part)
        pivot = np.partition(key, len(key) // 2)[len(key) // 2]
        less, same, more = key < pivot, key == pivot, key > pivot
        out[lo:hi] = np.concatenate([part[less], part[same], part[more]])
        a, b = lo + int(less.sum()), hi - int(more.sum())
        todo.extend((x, y, d) for x, y, d in ((lo, a, depth), (a, b, depth + 8), (b, hi, depth)) if y - x > 1)
    return out


def neighbour_lcp(strings: list[bytes], ranked: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Common prefix of each ranked string with the one before; -1 where a range starts. ``width``: the longest string."""
    if not len(strings):
        return np.zeros(0, dtype=np.int64)
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), width)
    size = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))[ranked]
    out = np.full(len(strings), -1, dtype=np.int64)
    for at in range(1, len(strings), 1 << 14):
        to = min(len(strings), at + (1 << 14))
        differ = flat[ranked[at:to]] != flat[ranked[at - 1 : to - 1]]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[at:to] = np.minimum(np.minimum(first, size[at:to]), size[at - 1 : to - 1])
    out[starts] = -1
    return out
