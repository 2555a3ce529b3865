"""Runs (maximal periodicities) of the words of texts, by the runs theorem.

Every run has a Lyndon root that is the longest Lyndon word at its place under the order of the words
or under its reverse. The longest Lyndon word at a place ends where the next smaller value of the
inverse suffix array stands, so both orders give at most two candidates a word. A candidate is
extended to both sides by longest common prefixes, of the sequence and of its mirror image, which
are range minima over the LCP array.

All texts of an Arrow batch are one sequence. Only stretches are looked at whose words all lie in
six words in a row that come twice or more in their text: a run of twelve words or more and of two
periods or more is such a stretch, or a part of one, and so is all that it could be extended by.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from silvae.llm import words as W
from silvae.llm.store import free, small_batches

#: Words of the shortest run, and of the stretches that come twice in every run.
LEAST, TWICE = 12, 6
#: Neighbours that a query of a range minimum compares one by one at most.
NEAR = 16
_NONE = np.zeros(0, np.int64)


def suffix_array(s: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffixes in order, the rank of each, and the ranks by the first 1, 2, 4 ... letters.

    ``s`` holds sequences that each end with a 0, smaller than all letters; ``end`` is the place of
    the 0 behind each letter. A suffix ends there, so equal suffixes of different sequences tie.
    """
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64)
    levels, k, at = [rank.astype(np.int32)], 1, np.arange(n)
    while True:
        after = at + k
        key = rank * (n + 1) + np.where(after <= end, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        if new[-1] == rank.max():
            return order, rank, levels
        rank = np.empty(n, np.int64)
        rank[order] = new
        levels.append(rank.astype(np.int32))
        k *= 2


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many letters the suffixes at ``a`` and ``b`` share, the 0 at their ends not counted."""
    a, b, out, n = a.copy(), b.copy(), np.zeros(len(a), np.int64), len(end)
    stop_a, stop_b = end[a], end[b]
    for k in range(len(levels) - 1, -1, -1):
        # ranks by more letters than are left tell whole suffixes, 0 and all
        same = (a < stop_a) & (b < stop_b) & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = np.where(same, np.minimum(1 << k, np.minimum(stop_a - a, stop_b - b)), 0)
        a, b, out = a + step, b + step, out + step
    return out


class RangeMinimum:
    """Minima of ranges: a sparse table over blocks of NEAR values, and the minima from each value to the ends of its block."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.int64)
        high = np.iinfo(np.int64).max
        full = np.full((len(x) // NEAR + 1) * NEAR, high)
        full[: len(x)] = x
        rows = full.reshape(-1, NEAR)
        self.head = np.minimum.accumulate(rows, 1).ravel()
        self.tail = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [rows.min(1)]
        while 2 << (len(self.table) - 1) <= len(rows):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of x[a:b] for each pair with a < b."""
        last = b - 1
        first_block, last_block = a // NEAR, last // NEAR
        out = np.minimum(self.tail[a], self.head[last])
        inner = last_block - first_block - 1
        wide = np.flatnonzero(inner > 0)
        level = np.zeros(len(a), np.int64)
        level[wide] = np.log2(inner[wide]).astype(np.int64)
        for k in np.unique(level[wide]):
            r = wide[level[wide] == k]
            t = self.table[k]
            out[r] = np.minimum(out[r], np.minimum(t[first_block[r] + 1], t[last_block[r] - (1 << int(k))]))
        inside = np.flatnonzero(first_block == last_block)
        least = self.x[a[inside]]
        for k in range(1, NEAR):
            more = a[inside] + k < b[inside]
            if not more.any():
                break
            least[more] = np.minimum(least[more], self.x[a[inside][more] + k])
        out[inside] = least
        return out


class Prefixes:
    """Longest common prefixes of suffixes of one sequence: the LCP array under range minima."""

    def __init__(self, s: np.ndarray, end: np.ndarray):
        order, self.rank, levels = suffix_array(s, end)
        self.place = np.empty(len(s), np.int64)
        self.place[order] = np.arange(len(s))
        self.minima = RangeMinimum(common(levels, order[:-1], order[1:], end))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of places a and b, never the same."""
        p, q = self.place[a], self.place[b]
        return self.minima.of(np.minimum(p, q), np.maximum(p, q))


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller value, or the length."""
    out, stack, values = [len(rank)] * len(rank), [], rank.tolist()
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = k
        stack.append(k)
    return np.array(out, np.int64)


def find_runs(sequences: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of LEAST letters or more, in order of start and period.

    ``sequences`` are letters from 1 on, one sequence after the other; ``first`` their borders (len + 1).
    """
    length = np.diff(first)
    if not len(sequences):
        return _NONE, _NONE, _NONE
    # each sequence with a 0 behind it
    shift = np.repeat(np.arange(len(length)), length)
    s = np.zeros(len(sequences) + len(length), np.int64)
    s[np.arange(len(sequences)) + shift] = sequences
    stop = np.cumsum(length + 1) - 1
    end = np.repeat(stop, length + 1)
    begin = end - np.repeat(length, length + 1)
    forward = Prefixes(s, end)
    mirror = np.where(np.arange(len(s)) < end, begin + end - 1 - np.arange(len(s)), end)
    backward = Prefixes(s[mirror], end)
    _, turned, _ = suffix_array(np.where(s > 0, s.max() + 1 - s, 0), end)
    found = []
    letters = np.flatnonzero(s > 0)
    for rank in (forward.rank, turned):
        i, j = letters, next_smaller(rank)[letters]
        inside = j < end[i]
        i, j = i[inside], j[inside]
        if not len(i):
            continue
        right = forward.of(i, j)
        left = np.zeros(len(i), np.int64)
        room = np.flatnonzero(i > begin[i])
        if len(room):
            left[room] = backward.of(mirror[i[room] - 1], mirror[j[room] - 1])
        a, b, p = i - left, j + right, j - i
        run = (b - a >= 2 * p) & (b - a >= LEAST)
        found.append(np.stack([a, p, b], 1)[run])
    rows = np.unique(np.concatenate([*found, np.zeros((0, 3), np.int64)]), axis=0)
    gone = np.searchsorted(stop, rows[:, 0])
    return rows[:, 0] - gone, rows[:, 2] - gone, rows[:, 1]


def stretches(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches of words that lie in TWICE words in a row which their text holds twice or more. text: the number of each word's text."""
    n = len(ids) - TWICE + 1
    if n <= 0:
        return _NONE, _NONE
    g = W.grams(W.mix(ids.astype(np.uint64) + np.uint64(1)), TWICE)
    at = np.flatnonzero(text[:n] == text[TWICE - 1 :])
    g = g[at] ^ W.mix(text[at].astype(np.uint64) << np.uint64(20))
    order = np.argsort(g, kind="stable")
    same = np.diff(g[order]) == 0
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    open_ = np.zeros(len(ids) + 1, np.int64)
    np.add.at(open_, at[twice], 1)
    np.add.at(open_, at[twice] + TWICE, -1)
    covered = np.cumsum(open_[:-1]) > 0
    edge = covered & np.concatenate([[True], ~covered[:-1] | (text[1:] != text[:-1])])
    last = covered & np.concatenate([~covered[1:] | (text[1:] != text[:-1]), [True]])
    start, end = np.flatnonzero(edge), np.flatnonzero(last) + 1
    long_ = end - start >= LEAST
    return start[long_], end[long_]


def runs_of(ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of each text the rows (start, length, period) of its runs, by start and period. ids: its words as numbers; first: borders of texts."""
    out = [np.zeros((0, 3), np.int64)] * (len(first) - 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start, end = stretches(ids, text)
    if not len(start):
        return out
    size = end - start
    border = np.concatenate([[0], np.cumsum(size)])
    where = np.repeat(start - border[:-1], size) + np.arange(border[-1])
    a, b, p = find_runs(np.unique(ids[where], return_inverse=True)[1] + 1, border)
    if not len(a):
        return out
    a, b = where[a], where[b - 1] + 1
    of = text[a]
    rows = np.stack([a - first[of], b - a, p], 1)
    for k in np.unique(of).tolist():
        out[k] = rows[of == k] if len(first) < 3 else rows[np.searchsorted(of, k) : np.searchsorted(of, k, side="right")]
    return out


def planted(n: int, doc_id: int | None) -> np.ndarray:
    """Which of its n words stands at each place of a document: for every tenth checksum of ids, words from a place on repeat with a period."""
    place = np.arange(n)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return place
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place[a:] = a + (place[a:] - a) % p
    return place


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


_FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")),
    T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType()),
]
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _batch_runs(texts: list[bytes], places) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Words and runs of each text; places(k, n) says which of its n words stands at each place."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words, ids = [], []
    for k, t in enumerate(texts):
        w = t.split()
        place = places(k, len(w))
        x = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
        if place is not None:
            w, x = [w[i] for i in place.tolist()], x[place]
        words.append(w)
        ids.append(x)
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return words, runs_of(np.concatenate([_NONE, *ids]), first)


def _over(docs: DataFrame, text_col: str, fields: list[T.StructField], make) -> DataFrame:
    free(docs, *(f.name for f in fields))
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, *fields])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for a, b in W.slices(column):
                piece = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*piece.columns, *make(piece)], [*piece.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(run, schema)


def _bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    data, first = W.buffers(batch.column(batch.schema.get_field_index(name)))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def detect_runs(docs: DataFrame, text_col: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of each whole text (array of start, length, period in words) and its words without what runs repeat.

    Words are what white space of ASCII separates. A run is a stretch of at least LEAST words and two
    periods that can't be extended; its period is the smallest. Runs may overlap. A null or empty text
    has none and collapses to ''. Repeated rows get the same; names of the results must not be there.
    A text is held whole: about 200 bytes for each of its words that lie in repeated stretches.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        words, found = _batch_runs(_bytes(batch, text_col), lambda k, n: None)
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x.tolist()] for x in found]
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        left = [b" ".join([w[i] for i in np.flatnonzero(kept_words(len(w), x)).tolist()]) if len(x) else b" ".join(w) for w, x in zip(words, found, strict=True)]
        return [pa.array(rows, kind), pa.array(left, pa.binary()).cast(pa.string())]

    return _over(docs, text_col, [T.StructField(runs, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType())], make)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the number of runs after ``planted``, the longest (ties: smallest start, then period; none: nulls), and digests of all runs and of the words left.

    Nulls, repeats and names as in ``detect_runs``; in a text with a null id nothing is planted.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
        words, found = _batch_runs(_bytes(batch, text_col), lambda k, n: planted(n, ids[k]))
        best, of_runs, of_words = [], [], []
        for w, x in zip(words, found, strict=True):
            if len(x):
                top = x[np.lexsort((x[:, 2], x[:, 0], -x[:, 1]))[0]].tolist()
                best.append((*top, 1000 * top[1] // top[2]))
                w = [w[i] for i in np.flatnonzero(kept_words(len(w), x)).tolist()]
            else:
                best.append((None,) * 4)
            of_runs.append(hashlib.sha256("".join(["%d,%d,%d\n" % tuple(r) for r in x.tolist()]).encode()).hexdigest())
            of_words.append(hashlib.sha256(b" ".join(w)).hexdigest())
        columns = list(zip(*best, strict=True)) if best else [[]] * 4
        return [pa.array([len(x) for x in found], pa.int64()), *(pa.array(c, pa.int64()) for c in columns), pa.array(of_runs, pa.string()), pa.array(of_words, pa.string())]

    return _over(docs, text_col, _FIELDS, make)
