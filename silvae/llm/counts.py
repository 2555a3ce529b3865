"""Token counts without tokens: words that are one whole token are counted as they stand, only the rest is merged.

Before any text is read, each string of the vocabulary is merged alone; those that come out as their
own single id are proved to be one token wherever the split makes a word of them. Texts are split
into words by classes of their characters, all of a block at once; a word found among the proved
ones counts 1, every other word counts as many tokens as its exact merge leaves.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from silvae.llm import bpe
from silvae.llm import words as W
from silvae.llm.lexicon import Lexicon
from silvae.llm.store import free, small_batches

#: Bytes of a block, bytes of a word that is looked up together with others, and words that are remembered.
BLOCK, ROW, SEEN_BITS, LONG_SEEN = 1 << 20, 16, 18, 20_000
OTHER, LETTER, DIGIT, SPACE = range(4)
_CACHED = 256


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, as the split tells them apart."""
    out = np.zeros(0x110000, np.uint8)
    for base in (0, 0xE000):
        text = "".join(map(chr, range(base, 0xD800 if base == 0 else 0x110000)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, f"[{bpe._SPACE}]+")):
            for m in regex.finditer(pattern, text):
                out[base + m.start() : base + m.end()] = kind
    return out


def split(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of the texts begin, in bytes. data: UTF-8 of all texts; offsets: their borders (len + 1)."""
    if not len(data):
        return np.zeros(0, np.int64)
    if data.max() < 0x80:
        c, place = data, None
    else:
        c = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(c)
    kind = classes()[c]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(place, offsets) if place is not None else offsets] = True
    opens = first[:n].copy()
    opens[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    goes_on = np.zeros(n, bool)
    goes_on[:-1] = ~first[1:n]
    # of white space before a word the last character stands alone, or is the word's first if it is a blank
    last = np.flatnonzero(space[:-1] & ~space[1:] & goes_on[:-1])
    opens[last] = True
    opens[last[c[last] == 0x20] + 1] = False
    # contractions: an apostrophe that begins a word and has one of seven endings behind it
    q = np.flatnonzero((c[: n - 1] == 0x27) & opens[: n - 1] & goes_on[: n - 1] & (kind[1:] == LETTER))
    if len(q):
        a = c[q + 1].astype(np.int64)
        b = np.where((q + 2 < n) & goes_on[q + 1], c[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        opens[q[one | two] + 1] = False
        behind = np.concatenate([q[one] + 2, q[two] + 3])
        opens[behind[behind < n]] = True
    start = np.flatnonzero(opens)
    return place[start] if place is not None else start


def _pieces(data: np.ndarray, offsets: np.ndarray, specials: re.Pattern | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts without special tokens, cut where these stood: bytes, borders, the text of each piece, and special tokens a text."""
    n = len(offsets) - 1
    special = np.zeros(n, np.int64)
    raw = data.tobytes()
    if specials is None or not specials.search(raw):
        return data, offsets, np.arange(n), special
    parts, of = [], []
    for k in range(n):
        text = raw[offsets[k] : offsets[k + 1]]
        got = specials.split(text)
        special[k] = len(got) - 1
        parts += got
        of += [k] * len(got)
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), np.array(of), special


def _blocks(data: np.ndarray, offsets: np.ndarray, limit: int):
    """(first border, last border, borders) of blocks of about ``limit`` bytes; a longer text is cut at blanks before ASCII, where a word always begins."""
    cuts = [offsets]
    for k in np.flatnonzero(np.diff(offsets) > 2 * limit).tolist():
        at, end = int(offsets[k]) + limit, int(offsets[k + 1])
        while at < end - 1:
            here, after = data[at : min(at + limit, end - 1)], data[at + 1 : min(at + limit, end - 1) + 1]
            free_ = np.flatnonzero((here == 0x20) & (after > 0x20) & (after < 0x7F))
            if len(free_):
                cuts.append(np.array([at + int(free_[0])]))
                at += int(free_[0])
            at += limit
    cuts = np.unique(np.concatenate(cuts))
    k = 0
    while k < len(cuts) - 1:
        last = max(k + 1, int(np.searchsorted(cuts, cuts[k] + limit, side="right")) - 1)
        yield cuts[k : last + 1]
        k = last


class Counter:
    """Counts the tokens of texts by a lexicon file of proved whole tokens."""

    def __init__(self, path: str):
        x = Lexicon(path)
        self._ranks = bpe._ranks(x.array("left"), x.array("right"), x.array("new"))
        self._pairs, self._letters = bpe.Ranks(self._ranks), x.array("letters").astype(np.int64)
        data, first = x.array("data").tobytes(), x.array("token_first").tolist()
        whole = [data[first[i] : first[i + 1]] for i in x.array("out").tolist()]
        self._long_whole = frozenset(w for w in whole if len(w) > ROW)
        self._whole = self._table([w for w in whole if len(w) <= ROW])
        self._seen, self._long = bpe._Pieces(SEEN_BITS), bpe._Cache(self._count, LONG_SEEN)
        s, first = x.array("special").tobytes(), x.array("special_first").tolist()
        special = sorted((s[a:b] for a, b in zip(first[:-1], first[1:], strict=True)), key=len, reverse=True)
        self._specials = re.compile(b"|".join(map(re.escape, special))) if special else None
        #: Words counted so far, those by merging, and those merged; a word is merged again only after its table was full.
        self.n_words = self.n_rest = self.n_merged = 0

    def _table(self, words: list[bytes]) -> bpe._Pieces:
        bits = 10
        while len(words) * 4 > 1 << bits:
            bits += 1
        table = bpe._Pieces(bits)
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        table.put(*self._keys(data, np.cumsum(size) - size, size), [b"\0" * 4] * len(words))
        return table

    @staticmethod
    def _keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All bytes of words of up to ROW, as two numbers and their length."""
        pad = np.concatenate([data, np.zeros(2 * ROW, np.uint8)])
        at = np.ndarray((len(data) + ROW,), "<u8", pad, 0, (1,))
        return at[start] & bpe._KEEP_BYTES[np.minimum(size, 8)], at[np.minimum(start + 8, len(data) + 8)] & bpe._KEEP_BYTES[np.clip(size - 8, 0, 8)], size.astype(np.uint64)

    def _count(self, word: bytes) -> int:
        self.n_merged += 1
        return len(bpe.merge(self._letters[np.frombuffer(word, np.uint8)].tolist(), self._ranks))

    def _merged(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many tokens the merges of different short words leave."""
        self.n_merged += len(low)
        letters = np.stack([low, high], 1).astype("<u8").view(np.uint8).reshape(-1, ROW)
        length = size.astype(np.int64)
        return self._pairs.merge(np.where(np.arange(ROW) < length[:, None], self._letters[letters], -1), length)[1]

    def _short(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.ones(len(low), np.int64)
        rest = np.flatnonzero(self._whole.find(low, high, size) < 0)
        self.n_rest += len(rest)
        if not len(rest):
            return out
        low, high, size = low[rest], high[rest], size[rest]
        slot = self._seen.find(low, high, size)
        if len(new := np.flatnonzero(slot < 0)):
            key = np.ascontiguousarray(np.stack([low[new], high[new], size[new]], 1)).view(np.dtype((np.void, 24)))[:, 0]
            _, once, back = np.unique(key, return_index=True, return_inverse=True)
            once = new[once]
            count = self._merged(low[once], high[once], size[once])
            out[rest[new]] = count[back]
            if self._seen.full + len(once) > self._seen.limit:
                self._seen.clear()
                slot = np.full(len(rest), -1)
                known = np.setdiff1d(np.arange(len(rest)), new)
                out[rest[known]] = self._merged(low[known], high[known], size[known])
            if len(once) <= self._seen.limit:
                self._seen.put(low[once], high[once], size[once], [b"\0" * (4 * c) for c in count.tolist()])
        there = slot >= 0
        out[rest[there]] = self._seen.count[slot[there]]
        return out

    def _block(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of a block begin, and the tokens of each."""
        base = int(cuts[0])
        block = data[base : int(cuts[-1])]
        start = split(block, cuts - base)
        size = np.diff(np.append(start, len(block)))
        count = np.ones(len(start), np.int64)
        short = np.flatnonzero(size <= ROW)
        count[short] = self._short(*self._keys(block, start[short], size[short]))
        for k in np.flatnonzero(size > ROW).tolist():
            word = block[start[k] : start[k] + size[k]].tobytes()
            if word not in self._long_whole:
                self.n_rest += 1
                count[k] = self._long[word] if len(word) <= _CACHED else self._count(word)
        self.n_words += len(start)
        return start + base, count

    def count(self, column: pa.Array) -> np.ndarray:
        """The number of tokens of each text; a null has none."""
        data, offsets = W.buffers(column)
        data, borders, of, total = _pieces(data, offsets, self._specials)
        for cuts in _blocks(data, borders, BLOCK):
            start, count = self._block(data, cuts)
            done = np.concatenate([[0], np.cumsum(count)])
            part = np.diff(done[np.searchsorted(start, cuts)])
            np.add.at(total, of[np.searchsorted(borders, cuts[:-1], side="right") - 1], part)
        return total


@functools.lru_cache(maxsize=1)
def _counter(name: str) -> Counter:
    return Counter(SparkFiles.get(name))


def count_tokens(docs: DataFrame, tokenizer_file: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the long column ``out``: how many tokens each whole text has by a byte-level BPE tokenizer file (JSON).

    No special token is added; the string of one in a text is one token. A null or empty text has 0;
    repeated rows get the same. ``out`` must not be a column of ``docs``. A text may have any length:
    it is split block by block, and only a single word is held in one piece.
    """
    free(docs, out)
    name = bpe.ship(docs, tokenizer_file)
    small_batches(docs.sparkSession)

    def run(batches):
        counter = _counter(name)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            count = [counter.count(column.slice(a, b - a)) for a, b in W.slices(column, BLOCK)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *count]))], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))
