"""Deep-shallow ordering of strings with the common prefixes of neighbours.

Shallow: multikey quicksort whose characters are 8-byte words; a pass orders every open group by its
next word and splits it into groups of equal words. Deep: strings that still agree after ``SHALLOW``
bytes go into a blind trie, which looks only at the bytes where its strings branch, compares a new
string in full once, and gives order and common prefixes by a walk.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def words_at(data: np.ndarray, start: np.ndarray, length: np.ndarray, depth: int) -> np.ndarray:
    """Bytes [depth, depth + 8) of each string as a number (bytes past its end are 0)."""
    place = depth + np.arange(8)
    at = np.minimum(start[:, None] + place, len(data) - 1)
    return np.ascontiguousarray(np.where(place < length[:, None], data[at], 0).astype(np.uint8)).view(">u8").ravel()


def multikey(data: np.ndarray, start: np.ndarray, length: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each place): groups agree in their first ``depth`` bytes."""
    order = np.arange(len(start))
    group = np.zeros(len(start), np.int64)
    for t in range(0, depth, 8):
        size = np.bincount(group, minlength=len(order))
        live = np.flatnonzero(size[group] > 1)
        if not len(live):
            break
        word = words_at(data, start[order[live]], length[order[live]], t).astype(np.uint64)
        turn = np.lexsort((word, group[live]))
        order[live] = order[live][turn]
        word = word[turn]
        fresh = np.ones(len(order), bool)  # the first place of each group
        fresh[1:] = group[1:] != group[:-1]
        apart = (word[1:] != word[:-1]) & (live[1:] == live[:-1] + 1)
        fresh[live[1:][apart]] = True
        group = np.cumsum(fresh) - 1
    return order, group


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Inner nodes are [depth, {byte: node}] (-1: the string ends there), leaves are lists of numbers."""

    def __init__(self):
        self.root = None
        self.text: dict[int, bytes] = {}

    def add(self, number: int, s: bytes) -> None:
        self.text[number] = s
        if self.root is None:
            self.root = (number, [number])
            return
        node = self.root
        while type(node) is list:  # blind: only the branching bytes are looked at
            nxt = node[1].get(s[node[0]] if node[0] < len(s) else -1)
            node = nxt if nxt is not None else next(iter(node[1].values()))
        other = self.text[node[0]]
        same = common(s, other)
        if same == len(s) == len(other):
            node[1].append(number)
            return
        up, node = None, self.root
        while type(node) is list and node[0] < same:
            up, node = node, node[1][s[node[0]]]
        own = s[same] if same < len(s) else -1
        if type(node) is list and node[0] == same:
            node[1][own] = (number, [number])
            return
        split = [same, {(other[same] if same < len(other) else -1): node, own: (number, [number])}]
        if up is None:
            self.root = split
        else:
            up[1][s[up[0]]] = split

    def walk(self) -> tuple[list[int], list[int]]:
        """(numbers in order, common prefix of each with the one before it; -1 for the first)."""
        order, prefix, stack = [], [], [(self.root, -1)]
        while stack:
            node, depth = stack.pop()
            if type(node) is list:
                children = sorted(node[1].items(), reverse=True)
                stack += [(child, node[0]) for _, child in children[:-1]]
                stack.append((children[-1][1], depth))
            else:
                for n in node[1]:
                    order.append(n)
                    prefix.append(depth)
                    depth = len(self.text[n])
        return order, prefix


def deep_shallow(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the sorted order of data[start:start + length], and for each place the common
    prefix with the place before (0 for the first)."""
    n = len(start)
    order, group = multikey(data, start, length, SHALLOW)
    prefix = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        most = np.minimum(np.minimum(length[a], length[b]), SHALLOW)
        for t in range(0, SHALLOW, 8):
            open_ = np.flatnonzero(prefix[1:] == t)
            x = words_at(data, start[a[open_]], length[a[open_]], t).astype(np.uint64)
            x ^= words_at(data, start[b[open_]], length[b[open_]], t).astype(np.uint64)
            bytes_ = np.ascontiguousarray(x.astype(">u8")).view(np.uint8).reshape(-1, 8) != 0
            prefix[1 + open_] = t + np.where(bytes_.any(1), bytes_.argmax(1), 8)
        prefix[1:] = np.minimum(prefix[1:], most)
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else []
    for a, b in zip(cut, [*cut[1:], n]):
        if b - a > 1:
            trie = BlindTrie()
            for i in order[a:b].tolist():
                trie.add(i, data[start[i]:start[i] + length[i]].tobytes())
            numbers, depth = trie.walk()
            order[a:b] = numbers
            prefix[a + 1:b] = depth[1:]
    if n > 1:  # a group's first place may have changed: its prefix is still below SHALLOW, but exact
        for a in cut[1:]:
            i, j = order[a - 1], order[a]
            prefix[a] = common(data[start[i]:start[i] + length[i]][:SHALLOW + 8].tobytes(),
                               data[start[j]:start[j] + length[j]][:SHALLOW + 8].tobytes())
    return order, prefix
