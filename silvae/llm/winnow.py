"""Benchmark decontamination by winnowing.

The smallest k-gram hash of each run of w k-grams is a fingerprint. Two texts that share
k + w - 1 words in a row therefore share a fingerprint, wherever the words stand. Benchmark
fingerprints are joined to those of the documents, and each hit is extended to the whole window
of the benchmark item, word by word.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvae.llm import words as W
from silvae.llm.store import free, put, small_batches

#: Words of a window; an item of fewer words is one window of its own length.
WINDOW = 13
#: Benchmark text is broadcast in blocks of at most so many bytes (a longer item is a block of its own).
BLOCK_BYTES = 16 << 20
#: Bytes of document text that a task holds while it goes through the blocks of a larger benchmark.
HELD = 64 << 20


def lengths(size: int) -> tuple[int, int]:
    """(k, w) with k + w - 1 = size: k-grams, and how many of them stand in a span of ``size`` words."""
    k = max(1, (size + 1) // 3)
    return k, size - k + 1


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each run of w values, in log w passes."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


class Table:
    """Membership and place of 64-bit values in a sorted table, behind a bit table of their high bits."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.shift = np.uint64(64 - min(24, max(8, int(len(self.values) * 16).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.values >> self.shift] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in x of known values, and their places in the table."""
        at = np.flatnonzero(self.bits[x >> self.shift])
        if not len(self.values):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        ok = self.values[place] == x[at]
        return at[ok], place[ok]


class Windows:
    """Fingerprints and windows of a block of benchmark items, by window length."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.names = sorted({i for i, _ in items if i is not None})
        place = {n: k for k, n in enumerate(self.names)}
        data, offsets = W.buffers(pa.array([t or "" for _, t in items], pa.large_string()))
        start, end, h, first = W.words(data, offsets, W.ALNUM)
        low = W.LOWER[data]
        found: dict[int, list] = {}
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b > a:
                size = min(WINDOW, b - a)
                gram, w = lengths(size)
                of, prints, whole = place.get(items[k][0], -1), *self._of(h[a:b], size, gram, w)
                found.setdefault(size, []).append((prints, whole, np.full(len(whole), of, np.int64), a))
        self.classes = []
        for size, parts in sorted(found.items()):
            table = Table(np.concatenate([p[1] for p in parts]))
            whole, of = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            starts = np.concatenate([np.arange(p[3], p[3] + len(p[1])) for p in parts])
            where = np.searchsorted(table.values, whole)
            pairs = np.unique(np.stack([where, of], 1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            bounds = np.searchsorted(pairs[:, 0], np.arange(len(table.values) + 1))
            one = np.zeros(len(table.values), np.int64)
            one[where] = starts
            text = [b" ".join(low[start[s + j] : end[s + j]].tobytes() for j in range(size)) for s in one.tolist()]
            self.classes.append((size, Table(np.concatenate([p[0] for p in parts])), table, bounds, pairs[:, 1], text))

    @staticmethod
    def _of(h: np.ndarray, size: int, gram: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(sliding_min(W.grams(h, gram), w)), W.grams(h, size)

    def scan(self, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """Of each text: its number of words, the spans of hit words and the names of the items found."""
        data, offsets = W.buffers(column)
        start, end, h, first = W.words(data, offsets, W.ALNUM)
        covered = np.zeros(len(h) + 1, np.int64)
        doc_of_word = np.repeat(np.arange(len(column)), np.diff(first))
        named = []
        for size, prints, table, bounds, of, text in self.classes:
            gram, w = lengths(size)
            if len(h) < size:
                continue
            least = sliding_min(W.grams(h, gram), w)
            turn = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            hit, _ = prints.find(least[turn])
            if not len(hit):
                continue
            stop = np.append(turn[1:], len(least))
            at = np.concatenate([np.arange(turn[i], stop[i]) for i in hit.tolist()])
            at = at[doc_of_word[at] == doc_of_word[at + size - 1]]
            if not len(at):
                continue
            whole = np.zeros(len(at), np.uint64)
            runs = np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1)
            for r in runs:
                whole[r] = W.grams(h[at[r[0]] : at[r[-1]] + size], size)
            k, place = table.find(whole)
            ok = [b" ".join(W.LOWER[data[start[s + j] : end[s + j]]].tobytes() for j in range(size)) == text[p] for s, p in zip(at[k].tolist(), place.tolist(), strict=True)]
            k, place = k[ok], place[ok]
            np.add.at(covered, at[k], 1)
            np.add.at(covered, at[k] + size, -1)
            for d, p in np.unique(np.stack([doc_of_word[at[k]], place], 1), axis=0).tolist():
                named.append(np.stack([np.full(bounds[p + 1] - bounds[p], d), of[bounds[p] : bounds[p + 1]]], 1))
        inside = np.cumsum(covered[:-1]) > 0
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
        if inside.any():
            border = np.zeros(len(h) + 1, bool)
            border[first[:-1]] = True
            edge = np.concatenate([[True], (inside[1:] != inside[:-1]) | border[1 : len(h)]])
            begin = np.flatnonzero(edge)
            close = np.append(begin[1:], len(h))
            for a, b in zip(begin.tolist(), close.tolist(), strict=True):
                if inside[a]:
                    d = int(doc_of_word[a])
                    spans[d].append((a - int(first[d]), b - int(first[d])))
        items: list[list[str]] = [[] for _ in range(len(column))]
        if named:
            for d, i in np.unique(np.concatenate(named), axis=0).tolist():
                items[d].append(self.names[i])
        return np.diff(first), spans, items


_RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])


def blocks(bench: DataFrame, id_col: str, text_col: str, limit: int) -> list[DataFrame]:
    """The benchmark in parts of about ``limit`` bytes of text."""
    bench = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = math.ceil(total / limit) or 1
    return [bench] if count == 1 else [bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) for k in range(count)]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of any order and overlap as sorted ones that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _through(docs: DataFrame, blocks_: list[Callable[[], Windows]], text_col: str, out: str) -> DataFrame:
    """``docs`` and a struct column ``out`` with the hits of all blocks, in one pass.

    A task holds some batches, goes through the blocks one after the other, and puts the hits of each row together."""
    small_batches(docs.sparkSession)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def found():
            got: list = [None] * len(held)
            for load in blocks_:
                known = load()
                for k, piece in enumerate(held):
                    n, spans, items = known.scan(piece.column(piece.schema.get_field_index(text_col)))
                    if got[k] is None:
                        got[k] = (n, spans, items)
                    else:
                        got[k] = (n, [union(x + y) if x and y else x or y for x, y in zip(got[k][1], spans, strict=True)], [sorted({*x, *y}) if x and y else x or y for x, y in zip(got[k][2], items, strict=True)])
            for piece, (n, spans, items) in zip(held, got, strict=True):
                rows = [{"n_words": int(x), "spans": [{"start": s, "stop": e} for s, e in y], "items": z} for x, y, z in zip(n, spans, items, strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(rows, _ARROW)], [*piece.schema.names, out])

        size = 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for a, b in W.slices(texts):
                held.append(batch.slice(a, b - a))
                size += len(W.buffers(texts.slice(a, b - a))[0])
                if size >= HELD or len(blocks_) == 1:
                    yield from found()
                    held, size = [], 0
        yield from found()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, _RESULT)]))


def _loader(name: str) -> Callable[[], Windows]:
    def load() -> Windows:
        with open(SparkFiles.get(name), "rb") as f:
            return pickle.load(f)  # noqa: S301 - written by find_benchmark

    return load


def find_benchmark(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", out: str = "hits", limit: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, spans of hit words (start, stop), and the sorted items found.

    Words are runs of digits, letters and bytes beyond ASCII, A-Z in lower case. A window is 13 words
    in a row of an item, or the whole of a shorter item; each document word inside an occurrence of
    a window is hit. A null or empty text has no words, and an item without words no window. An item
    with a null id marks words but is not named; repeated items are named once. An empty benchmark
    leaves all documents without hits; repeated rows get the same. ``out`` must not be a column of ``docs``.

    One pass over the documents without a shuffle. A benchmark of up to ``limit`` bytes is broadcast;
    a larger one goes to the executors as files of blocks of that size, of which a task holds one at a time.
    """
    free(docs, out)
    spark = docs.sparkSession
    made = (Windows([(r.item, r.text) for r in part.toLocalIterator()]) for part in blocks(bench, item_col, item_text, limit))
    first, second = next(made), next(made, None)
    if second is None:
        shared = spark.sparkContext.broadcast(first)
        return _through(docs, [lambda: shared.value], text_col, out)

    def ship(block: Windows) -> str:
        data = pickle.dumps(block)
        name = f"windows-{hashlib.sha256(data).hexdigest()[:24]}"
        spark.sparkContext.addFile(put(spark, name, data))
        return name

    names = [ship(first), ship(second), *map(ship, made)]
    return _through(docs, [_loader(n) for n in names], text_col, out)


def n_hit(hits: str = "hits") -> Column:
    """How many words are hit."""
    return F.aggregate(F.col(f"{hits}.spans"), F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])


def contaminated(hits: str = "hits") -> Column:
    """Whether at least one word in twenty, and one at all, is hit."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(f"{hits}.n_words"))


def digest(items: list[str]) -> str:
    """The query's digest of item names, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
