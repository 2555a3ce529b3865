"""A minimal acyclic transducer: sorted byte strings with outputs, sharing prefixes and suffixes, in one mapped file.

States are made from the words in order; a state whose arcs equal those of an earlier one is that
state. Each arc carries how many words precede those behind it, so the sum along a word's path is
its number, which points at its output ids.
"""

from __future__ import annotations

import json
import mmap
import struct
from collections.abc import Iterable

import numpy as np

_MAGIC = b"SILVLEX1"


def minimal(words: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray, int]:
    """first arc of each state, arc labels, targets and skipped words, which states end a word, and the root."""
    known: dict[tuple, int] = {}
    size: list[int] = []
    arcs: list[tuple] = []
    final: list[bool] = []

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if (at := known.get(key)) is None:
            at = known[key] = len(arcs)
            arcs.append(key[1])
            final.append(node[0])
            size.append(node[0] + sum(size[t] for _, t in key[1]))
        return at

    path, before = [[False, []]], b""
    for word in words:
        if word <= before and (before or not word) and path[0][1:] != [[]]:
            raise ValueError("words must be sorted and distinct")
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        while len(path) > same + 1:
            at = close(path.pop())
            path[-1][1].append((before[len(path) - 1], at))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        before = word
    while len(path) > 1:
        at = close(path.pop())
        path[-1][1].append((before[len(path) - 1], at))
    root = close(path[0])
    first = np.zeros(len(arcs) + 1, np.uint32)
    first[1:] = np.cumsum([len(a) for a in arcs])
    labels, targets, skipped = bytearray(), [], []
    for a, end in zip(arcs, final, strict=True):
        below = int(end)
        for c, t in a:
            labels.append(c)
            targets.append(t)
            skipped.append(below)
            below += size[t]
    return first, bytes(labels), np.array(targets, np.uint32), np.array(skipped, np.uint32), np.array(final, np.uint8), root


def write(path: str, words: dict[bytes, tuple[int, ...]], extra: dict[str, np.ndarray]) -> None:
    """A file of the transducer of ``words`` with their ids, and further named arrays."""
    order = sorted(words)
    first, labels, targets, skipped, final, root = minimal(order)
    out = [words[w] for w in order]
    parts = {
        "first": first, "labels": np.frombuffer(labels, np.uint8), "targets": targets, "skipped": skipped, "final": final,
        "out_first": np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.uint32), "out": np.array([i for x in out for i in x], np.uint32), **extra,
    }
    head, at = {"root": root, "parts": {}}, 0
    for name, x in parts.items():
        head["parts"][name] = [at, len(x), x.dtype.str]
        at += -(-x.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 16) % 8)
    with open(path, "wb") as f:
        f.write(_MAGIC + struct.pack("<Q", len(text)) + text)
        for x in parts.values():
            f.write(x.tobytes() + b"\0" * (-x.nbytes % 8))


class Lexicon:
    """The file of ``write``, mapped: workers on a machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != _MAGIC:
            raise ValueError(f"{path} is no lexicon")
        size = struct.unpack("<Q", self.map[8:16])[0]
        head = json.loads(self.map[16 : 16 + size])
        self.root, self._parts, self._base = head["root"], head["parts"], 16 + size
        self._first, self._targets, self._skipped, self._out_first = (memoryview(self.array(n)) for n in ("first", "targets", "skipped", "out_first"))
        self._final, self._out = self.array("final"), self.array("out")
        self._labels = self._base + self._parts["labels"][0]
        first = self.array("first")
        self._arcs = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first)) << 8 | self.array("labels")

    def array(self, name: str) -> np.ndarray:
        at, size, kind = self._parts[name]
        return np.frombuffer(self.map, kind, size, self._base + at)

    def find(self, word: bytes) -> bytes | None:
        """The ids of a word as little-endian 32-bit integers, or None."""
        state, number, first, labels, find = self.root, 0, self._first, self._labels, self.map.find
        for k in range(len(word)):
            at = find(word[k : k + 1], labels + first[state], labels + first[state + 1])
            if at < 0:
                return None
            number += self._skipped[at - labels]
            state = self._targets[at - labels]
        return self._out[self._out_first[number] : self._out_first[number + 1]].tobytes() if self._final[state] else None


    def find_all(self, letters: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words as rows of bytes: where their ids begin in ``out`` and how many they are, and which words are there."""
        state = np.full(len(length), self.root, np.int64)
        number, there = np.zeros(len(length), np.int64), np.ones(len(length), bool)
        targets, skipped = self.array("targets"), self.array("skipped")
        for k in range(letters.shape[1]):
            rows = np.flatnonzero(there & (k < length))
            if not len(rows):
                break
            want = state[rows] << 8 | letters[rows, k]
            arc = np.minimum(np.searchsorted(self._arcs, want), len(self._arcs) - 1)
            hit = self._arcs[arc] == want
            there[rows[~hit]] = False
            rows, arc = rows[hit], arc[hit]
            number[rows] += skipped[arc]
            state[rows] = targets[arc]
        there &= self._final[state] > 0
        first = np.asarray(self.array("out_first"), np.int64)
        at = np.where(there, number, 0)
        return first[at], first[at + 1] - first[at], there


def pack(strings: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as one array and the borders between them."""
    strings = list(strings)
    return np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.uint32)
