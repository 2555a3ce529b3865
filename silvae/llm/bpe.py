"""Byte-level BPE, encoding and decoding, over a lexicon of whole words and exact merges for the rest.

The words of the vocabulary that its merges do produce, and the words that are frequent in a bounded
sample of the texts, are compiled with their ids into one minimal transducer, which each executor
gets as a file and maps. A word found there needs no merge; every other word is merged exactly, so
the sample changes the time and never the ids. A bounded cache of a worker keeps what either found.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvae.llm import words as W
from silvae.llm.lexicon import Lexicon, pack, write
from silvae.llm.store import free, put, small_batches

#: White space of Unicode.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the split of byte-level BPE.
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Words that a worker remembers, bits of its table of pieces, and bytes of a word that is merged together with others.
CACHE, PIECE_BITS, ROW = 60_000, 20, 24
#: Texts that frequent words are learned from, the bytes of the largest, and how many words are kept, at most.
LEARN, LEARN_BYTES, FREQUENT = 1000, 20_000, 20_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_NONE = 1 << 62


def merge(ids: list[int], ranks: dict[int, int]) -> list[int]:
    """Apply the merge of lowest rank, leftmost first, until none applies. ranks: of ``left << 20 | right``, ``rank << 20 | id``."""
    get = ranks.get
    if len(ids) < 60:
        near = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while near and (best := min(near)) != _NONE:
            k = near.index(best)
            ids[k : k + 2] = [new] = [best & 0xFFFFF]
            del near[k]
            if k:
                near[k - 1] = get(ids[k - 1] << 20 | new, _NONE)
            if k < len(near):
                near[k] = get(new << 20 | ids[k + 1], _NONE)
        return ids
    after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
    heap = [(r, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (r := get(ids[k] << 20 | ids[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, k, left, right = heapq.heappop(heap)
        n = after[k]
        if not alive[k] or ids[k] != left or n >= len(ids) or ids[n] != right:
            continue
        # ranks order pairs first, so equal pairs leave the heap from left to right
        ids[k], alive[n] = (new := r & 0xFFFFF), False
        after[k] = m = after[n]
        if m < len(ids):
            before[m] = k
            if (r := get(new << 20 | ids[m])) is not None:
                heapq.heappush(heap, (r, k, new, ids[m]))
        if (p := before[k]) >= 0 and (r := get(ids[p] << 20 | new)) is not None:
            heapq.heappush(heap, (r, p, ids[p], new))
    return [x for x, y in zip(ids, alive, strict=True) if y]


class Ranks:
    """The merges of a pair, for many pairs at once: an open table of ``left << 20 | right``."""

    def __init__(self, ranks: dict[int, int], bits: int = 18):
        while len(ranks) * 3 > 1 << bits:
            bits += 1
        self.bits = bits
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        key, value = np.array(list(ranks), np.int64), np.array(list(ranks.values()), np.int64)
        slot, left = self._home(key), np.arange(len(key))
        while len(left):
            free = self.key[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            now, to = left[free][one], slot[free][one]
            self.key[to], self.value[to] = key[now], value[now]
            go = np.ones(len(left), bool)
            go[np.flatnonzero(free)[one]] = False
            left, slot = left[go], (slot[go] + 1) & ((1 << bits) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        """The rank and id of each pair, _NONE where there is none."""
        slot = self._home(key)
        there = self.key[slot]
        out = np.where(there == key, self.value[slot], _NONE)
        left = np.flatnonzero((there != key) & (there >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.key[slot]
            same = there == key[left]
            out[left[same]] = self.value[slot[same]]
            go = ~same & (there >= 0)
            left, slot = left[go], slot[go]
        return out

    def merge(self, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many words: rows of ids, filled up with -1, one merge of each row at a time."""
        ids, length = ids.astype(np.int64), length.copy()
        rows = np.flatnonzero(length > 1)
        near = np.full((len(ids), max(1, ids.shape[1] - 1)), _NONE, np.int64)
        r, k = np.nonzero(np.arange(ids.shape[1] - 1) < (length - 1)[:, None])
        near[r, k] = self.of(ids[r, k] << 20 | ids[r, k + 1])
        columns = np.arange(ids.shape[1])
        while len(rows):
            here = near[rows]
            k = here.argmin(1)
            best = here[np.arange(len(rows)), k]
            rows, k, best = rows[best < _NONE], k[best < _NONE], best[best < _NONE]
            if not len(rows):
                break
            after = np.minimum(columns + (columns > k[:, None]), len(columns) - 1)
            moved = np.take_along_axis(ids[rows], after, 1)
            length[rows] -= 1
            moved[np.arange(len(rows)), k] = best & 0xFFFFF
            moved[columns >= length[rows][:, None]] = -1
            ids[rows] = moved
            shifted = np.take_along_axis(near[rows], np.minimum(columns[:-1] + (columns[:-1] >= k[:, None]), len(columns) - 2), 1)
            shifted[columns[:-1] >= (length[rows] - 1)[:, None]] = _NONE
            for j in (k - 1, k):
                ok = np.flatnonzero((j >= 0) & (j < length[rows] - 1))
                shifted[ok, j[ok]] = self.of(moved[ok, j[ok]] << 20 | moved[ok, j[ok] + 1])
            near[rows] = shifted
        return ids, length


def compile_lexicon(tokenizer_file: str, path: str, frequent: tuple[str, ...] = ()) -> None:
    """Compile a tokenizer file (byte-level BPE, JSON) and frequent words of any number of ids into one lexicon file."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab = spec["model"], spec["model"]["vocab"]
    if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
        raise ValueError("only byte-level BPE without a normalizer and prefix space")
    to_byte = {c: b for b, c in enumerate(byte_letters())}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens: list[bytes] = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for t, i in vocab.items():
        tokens[i] = bytes(to_byte[c] for c in t)
    for t, i in added.items():
        tokens[i] = t.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right, new = (np.array(x, np.uint32) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
    ranks = _ranks(left, right, new)
    letters = np.array([vocab[c] for c in byte_letters()], np.uint32)
    whole = {}
    for t, i in vocab.items():
        b = tokens[i]
        if merge([int(letters[x]) for x in b], ranks) == [i]:
            whole[b] = (i,)
    for word in frequent:
        b = word.encode()
        if b not in whole:
            whole[b] = tuple(merge([int(letters[x]) for x in b], ranks))
    data, first = pack(tokens)
    special, special_first = pack(t.encode() for t in added)
    extra = {"left": left, "right": right, "new": new, "letters": letters, "data": data, "token_first": first, "special": special, "special_first": special_first, "special_id": np.array(list(added.values()), np.uint32)}
    write(path, whole, extra)


def _ranks(left: np.ndarray, right: np.ndarray, new: np.ndarray) -> dict[int, int]:
    return {a << 20 | b: k << 20 | c for k, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), new.tolist(), strict=True))}


class _Cache(dict):
    """Ids of words, made when first asked for. When half full, what was not asked for since then is dropped."""

    def __init__(self, make, limit: int):
        self.make, self.half, self.old = make, limit // 2, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        if (out := self.old.get(word)) is None:
            out = self.make(word)
        self[word] = out
        return out


class _Pieces:
    """Ids of pieces of at most 16 bytes: a table open to vectorised look-up, keyed by all of a piece's bytes and its length."""

    def __init__(self, bits: int = PIECE_BITS):
        self.bits, self.limit = bits, (1 << bits) // 2
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.low, self.high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.size, self.count, self.at = np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.zeros(n, np.uint32)
        self.pool, self.used, self.full = np.zeros(1 << 16, np.uint32), 0, 0

    def _home(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (W.mix(low * np.uint64(0x9E3779B97F4A7C15) ^ W.mix(high + size)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The slot of each piece, or -1."""
        out = np.full(len(low), -1, np.int64)
        slot, left = self._home(low, high, size), np.arange(len(low))
        while len(left):
            same = (self.low[slot] == low[left]) & (self.high[slot] == high[left]) & (self.size[slot] == size[left])
            out[left[same]] = slot[same]
            go = ~same & (self.size[slot] > 0)
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def keep(self, ids: np.ndarray) -> int:
        """Append ids to the pool; where they begin."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def put(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, ids: list[bytes]) -> None:
        """Add pieces that are not there yet, all different."""
        count = np.array([len(x) // 4 for x in ids], np.int64)
        at = self.keep(np.frombuffer(b"".join(ids), np.uint32)) + np.cumsum(count) - count
        slot, left = self._home(low, high, size), np.arange(len(low))
        while len(left):
            free = self.size[slot] == 0
            _, one = np.unique(slot[free], return_index=True)
            now, to = left[free][one], slot[free][one]
            self.low[to], self.high[to], self.size[to], self.count[to], self.at[to] = low[now], high[now], size[now], count[now], at[now]
            go = np.ones(len(left), bool)
            go[np.flatnonzero(free)[one]] = False
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        self.full += len(low)


_KEEP_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _odd_texts(data: np.ndarray, offsets: np.ndarray, pad: np.ndarray) -> np.ndarray:
    """Texts that may hold white space beyond ASCII or a special token: byte patterns that begin one."""
    a, b, c = pad[: len(data)], pad[1 : len(data) + 1], pad[2 : len(data) + 2]
    bad = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0x3C) & (b == 0x7C)
    return np.unique(np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1)


class Codec:
    """Encodes texts to ids and decodes ids to texts by a lexicon file."""

    def __init__(self, path: str):
        self.lexicon = x = Lexicon(path)
        self._ranks = _ranks(x.array("left"), x.array("right"), x.array("new"))
        self._letters = x.array("letters").tolist()
        self._letter_ids, self._pairs = x.array("letters").astype(np.int64), Ranks(self._ranks)
        self._data, first = x.array("data"), x.array("token_first").astype(np.int64)
        self._first, self._length = first[:-1], np.diff(first)
        data = self._data.tobytes()
        self.tokens = [data[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        s, first = x.array("special").tobytes(), x.array("special_first").tolist()
        self._special = {s[a:b].decode(): np.uint32(i).tobytes() for a, b, i in zip(first[:-1], first[1:], x.array("special_id"), strict=True)}
        self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        # the byte pattern that sends a text the slow way
        self._vector = all(s.startswith("<|") for s in self._special)
        self._words, self._table = _Cache(self._word, CACHE), _Pieces()

    def _word(self, word: str) -> bytes:
        b = word.encode()
        found = self.lexicon.find(b)
        return found if found is not None else np.array(merge([self._letters[x] for x in b], self._ranks), np.uint32).tobytes()

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self._words.__getitem__, _SPLIT.findall(text)))

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids; words that are not known are looked up in the lexicon and merged all together."""
        split = list(map(_SPLIT.findall, pieces))
        known = self._words
        new = {w for words in split for w in words}
        new = [w for w in new if w not in known and w not in known.old]
        made = [w.encode() for w in new]
        short = [k for k, w in enumerate(made) if len(w) <= ROW]
        got: dict[str, bytes] = {}
        if short:
            length = np.array([len(made[k]) for k in short], np.int64)
            letters = np.frombuffer(b"".join(made[k].ljust(ROW, b"\0") for k in short), np.uint8).reshape(-1, ROW)
            at, count, there = self.lexicon.find_all(letters, length)
            out = self.lexicon.array("out")
            for i in np.flatnonzero(there).tolist():
                got[new[short[i]]] = out[at[i] : at[i] + count[i]].tobytes()
            rest = np.flatnonzero(~there)
            if len(rest):
                ids = np.where(np.arange(ROW) < length[rest, None], self._letter_ids[letters[rest]], -1)
                ids, length = self._pairs.merge(ids, length[rest])
                data, width = ids.astype(np.uint32).tobytes(), 4 * ROW
                for i, k, n in zip(rest.tolist(), range(len(rest)), length.tolist(), strict=True):
                    got[new[short[i]]] = data[k * width : k * width + 4 * n]
        if len(known) + len(got) >= known.half:
            known.old = dict(known)
            known.clear()
        known.update(got)
        return [b"".join([known[w] for w in words]) for words in split]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._specials and any(s in text for s in self._special):
            return b"".join(self._special.get(p) or self._pieces(p) for p in self._specials.split(text))
        return self._pieces(text)

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and each text's first (len + 1).

        Texts are cut before each space that stands before anything but white space: a word of the split
        always begins there. Equal pieces are encoded once."""
        data, offsets = W.buffers(column)
        pad = np.concatenate([data, np.zeros(16, np.uint8)])
        odd = _odd_texts(data, offsets, pad) if self._vector else np.arange(len(column))
        table, n = self._table, len(data)
        if table.full > table.limit:
            table.clear()
        opens = (pad[:n] == 0x20) & ~_IS_SPACE[pad[1 : n + 1]]
        opens[offsets[:-1][offsets[:-1] < n]] = True
        ends = offsets[1:][(offsets[1:] < n) & (offsets[1:] > 0)]
        opens[ends] = True
        start = np.flatnonzero(opens)
        size = np.diff(np.append(start, n))
        text_of = np.searchsorted(offsets, start, side="right") - 1
        slow = np.isin(text_of, odd)
        short = np.flatnonzero((size <= 16) & ~slow)
        words = np.ndarray((n + 9,), "<u8", pad, 0, (1,))
        low = words[start[short]] & _KEEP_BYTES[np.minimum(size[short], 8)]
        high = words[np.minimum(start[short] + 8, n + 8)] & _KEEP_BYTES[np.clip(size[short] - 8, 0, 8)]
        length = size[short].astype(np.uint64)
        slot = table.find(low, high, length)
        raw = data.tobytes()
        if len(missing := np.flatnonzero(slot < 0)):
            key = np.stack([low[missing], high[missing], length[missing]], 1)
            _, once = np.unique(np.ascontiguousarray(key).view(np.dtype((np.void, 24)))[:, 0], return_index=True)
            once = missing[once]
            ids = self._encode_pieces([raw[x : x + y].decode() for x, y in zip(start[short[once]].tolist(), length[once].tolist(), strict=True)])
            room = max(0, (1 << table.bits) // 8 * 7 - table.full)
            table.put(low[once[:room]], high[once[:room]], length[once[:room]], ids[:room])
            slot[missing] = table.find(low[missing], high[missing], length[missing])
        count, at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        known = slot >= 0
        count[short[known]], at[short[known]] = table.count[slot[known]], table.at[slot[known]]
        # longer pieces and odd texts go behind the pool for this batch
        rest = np.flatnonzero(~slow & (size > 16))
        rest = np.concatenate([rest, short[~known]])
        mark = table.used
        for k in rest.tolist():
            ids = np.frombuffer(self._pieces(raw[int(start[k]) : int(start[k] + size[k])].decode()), np.uint32)
            count[k], at[k] = len(ids), table.keep(ids)
        first_piece = np.searchsorted(text_of, odd)
        for d, k in zip(odd.tolist(), first_piece.tolist(), strict=True):
            if offsets[d + 1] > offsets[d]:
                ids = np.frombuffer(self.encode(raw[int(offsets[d]) : int(offsets[d + 1])].decode()), np.uint32)
                count[k], at[k] = len(ids), table.keep(ids)
        done = np.cumsum(count)
        ids = table.pool[np.repeat(at - (done - count), count) + np.arange(int(done[-1]) if len(done) else 0)]
        table.used = mark
        return ids, np.concatenate([[0], done])[np.searchsorted(start, offsets)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")

    def decode_batch(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The text of each row of ids, in UTF-8."""
        length = self._length[ids]
        done = np.concatenate([[0], np.cumsum(length)])
        data = self._data[np.repeat(self._first[ids] - done[:-1], length) + np.arange(done[-1])].tobytes()
        border = done[first]
        out = [data[a:b] for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True)]
        return [x if _valid(x) else x.decode("utf-8", "replace").encode() for x in out]


def _valid(x: bytes) -> bool:
    try:
        x.decode()
    except UnicodeDecodeError:
        return False
    return True


@functools.lru_cache(maxsize=1)
def _codec(name: str) -> Codec:
    return Codec(SparkFiles.get(name))


def frequent_words(docs: DataFrame, text_col: str) -> tuple[str, ...]:
    """The words that come twice or more in at most LEARN texts, the most frequent first."""
    t = F.col(f"`{text_col}`").cast("string")
    some = docs.select(t.alias("text")).where(F.octet_length("text") <= LEARN_BYTES)
    # take() looks at as few partitions as it needs; an iterator over a limit would shuffle that many rows of each
    count = Counter(w for r in some.take(LEARN) for w in _SPLIT.findall(r.text))
    return tuple(sorted((w for w, n in count.items() if n > 1 and len(w) > 1), key=lambda w: (-count[w], w))[:FREQUENT])


@functools.lru_cache(maxsize=4)
def _compiled(tokenizer_file: str, stamp: tuple, frequent: tuple[str, ...]) -> bytes:
    with tempfile.TemporaryDirectory(prefix="silvae-") as folder:
        path = os.path.join(folder, "lexicon")
        compile_lexicon(tokenizer_file, path, frequent)
        with open(path, "rb") as f:
            return f.read()


def ship(docs: DataFrame, tokenizer_file: str, text_col: str | None = None) -> str:
    """Compile a tokenizer file of the driver, put the lexicon in the shared folder and give it to every executor; its name there."""
    stat = os.stat(tokenizer_file)
    data = _compiled(tokenizer_file, (stat.st_mtime_ns, stat.st_size), frequent_words(docs, text_col) if text_col else ())
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:16]}"
    docs.sparkSession.sparkContext.addFile(put(docs.sparkSession, name, data))
    return name


def with_codec(rows: DataFrame, tokenizer_file: str, make, fields: list[T.StructField], text_col: str | None = None) -> DataFrame:
    """``rows`` with further columns that ``make(codec, batch)`` gives as Arrow arrays, in one pass with one codec a worker. None of them may be there already."""
    names = [f.name for f in fields]
    free(rows, *names)
    name = ship(rows, tokenizer_file, text_col)
    small_batches(rows.sparkSession)

    def run(batches):
        codec = _codec(name)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col)) if text_col else None
            for a, b in W.slices(column, 1 << 20) if text_col else ((k, min(k + 500, batch.num_rows)) for k in range(0, batch.num_rows, 500)):
                piece = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*piece.columns, *make(codec, piece)], [*piece.schema.names, *names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))


def ids_array(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """Rows of ids as an Arrow array column."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.view(np.int32)))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def encode(docs: DataFrame, tokenizer_file: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the array column ``out``: the ids of each whole text, as the tokenizer file gives them.

    No special token is added; the string of one in a text becomes its id. A null or empty text has
    no ids. ``out`` must not be a column of ``docs``.
    """

    def make(codec: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        return [ids_array(*codec.encode_batch(_column(batch, text_col)))]

    return with_codec(docs, tokenizer_file, make, [T.StructField(out, T.ArrayType(T.IntegerType()))], text_col)


def decode(rows: DataFrame, tokenizer_file: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text column ``out``: the text of each row's ids (of none or null: empty)."""

    def make(codec: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        ids = [x or [] for x in _column(batch, ids_col).to_pylist()]
        return [pa.array([codec.decode(x) for x in ids], pa.string())]

    return with_codec(rows, tokenizer_file, make, [T.StructField(out, T.StringType())])


def transcode(docs: DataFrame, tokenizer_file: str, text_col: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass, so that a worker keeps one codec and one table."""

    def make(codec: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        got, first = codec.encode_batch(_column(batch, text_col))
        return [ids_array(got, first), pa.array(codec.decode_batch(got, first), pa.binary()).cast(pa.string())]

    return with_codec(docs, tokenizer_file, make, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.StringType())], text_col)
