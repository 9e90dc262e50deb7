"""Minimal acyclic transducer: a lexicon of words with id lists as outputs.

Words are added in byte order; a state whose right language is already known is
shared, so common endings are stored once. Each arc carries the number of words
that sort before it among its state's arcs; their sum along a path is the word's
number, and an offset table maps the number to the ids. All of it is a handful of
flat arrays in one file, read through a memory map.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable, Sequence

import numpy as np

MAGIC = b"MADT0001"


def compile_lexicon(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """File contents for (word, ids) pairs; words must be distinct and not empty."""
    entries = sorted(entries)
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def share(final: bool, arcs: list[list[int]]) -> int:
        key = (final, tuple(map(tuple, arcs)))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
        return registry[key]

    # the path of the last word: per depth [final, [[label, state], ...]]
    path: list[list] = [[False, []]]
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, arcs = path.pop()
            path[-1][1][-1][1] = share(final, arcs)

    for word, _ in entries:
        if not word or word == last:
            raise ValueError("words must be distinct and not empty")
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        for label in word[common:]:
            path[-1][1].append([label, -1])
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    root = share(*path[0])

    # targets are numbered before their sources, so one pass counts words
    words_below = np.zeros(len(states), np.int64)
    first, labels, targets, skips = [0], bytearray(), [], []
    for s, (final, arcs) in enumerate(states):
        total = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            skips.append(total)
            total += int(words_below[target])
        words_below[s] = total
        first.append(len(labels))
    ids = [list(i) for _, i in entries]
    offsets = np.cumsum([0, *map(len, ids)])
    flat = np.array([x for i in ids for x in i], np.uint32)
    finals = np.array([f for f, _ in states], np.uint8)
    arrays = [
        np.array(first, np.uint32), finals, np.frombuffer(bytes(labels), np.uint8), np.array(targets, np.uint32),
        np.array(skips, np.uint32), offsets.astype(np.uint32), flat,
    ]
    head = np.array([root, *(a.nbytes for a in arrays)], np.uint64).tobytes()
    return MAGIC + head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != MAGIC:
            raise ValueError(f"{path} is not a lexicon")
        head = np.frombuffer(self.map, np.uint64, 8, 8)
        self.root = int(head[0])
        at, views = 8 + 64, []
        for size in head[1:]:
            views.append(memoryview(self.map)[at : at + int(size)])
            at += int(size) + -int(size) % 8
        self.first, self.finals, labels, self.targets, self.skips, self.offsets, self.flat = views
        self.label_at = at_labels = 8 + 64 + sum(int(s) + -int(s) % 8 for s in head[1:3])
        self.label_end = at_labels + len(labels)
        self.first, self.targets, self.skips, self.offsets = (
            v.cast("I") for v in (self.first, self.targets, self.skips, self.offsets)
        )

    def ids(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit numbers; None if it is not in the lexicon."""
        state, number, find, base = self.root, 0, self.map.find, self.label_at
        first, targets, skips = self.first, self.targets, self.skips
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            number += skips[arc]
            state = targets[arc]
        if not self.finals[state]:
            return None
        return bytes(self.flat[4 * self.offsets[number] : 4 * self.offsets[number + 1]])
