"""Alignment of two tokenizers: the spans of a text where tokens of both end, and how often their tokens meet.

The texts of an Arrow batch are one array of bytes with the offsets of documents. The ends of the
tokens of A and of B are counted for each byte once; a group ends where both have one. Every result
of a document is a difference of prefix sums at its two offsets.

The count of a pair of ids is over all documents, so pairs are summed by a shuffle. The most
frequent pairs, HOT at most, go back to every task as one bounded table; only the others are joined
by a shuffle, and none of those has more than about 2 / HOT of all rows.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvae.llm import bpe
from silvae.llm import words as W
from silvae.llm.store import free, materialize, put, small_batches

#: Pairs that every task gets, pairs that are expanded at once, bytes of a word looked up together with others, words remembered.
HOT, EXPAND, ROW, TABLE_BITS, LONG_SEEN = 1 << 17, 1 << 21, 16, 19, 20_000
#: Bits of an id in a pair.
BITS = 20
_MARK = "▁"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class _Table(bpe._Pieces):
    """Pieces whose ids come one after the other in one array."""

    def put_all(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        at = self.keep(ids) + np.cumsum(count) - count
        slot, left = self._home(low, high, size), np.arange(len(low))
        while len(left):
            free_ = self.size[slot] == 0
            _, one = np.unique(slot[free_], return_index=True)
            now, to = left[free_][one], slot[free_][one]
            self.low[to], self.high[to], self.size[to], self.count[to], self.at[to] = low[now], high[now], size[now], count[now], at[now]
            go = np.ones(len(left), bool)
            go[np.flatnonzero(free_)[one]] = False
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        self.full += len(low)


class PlainCodec(bpe.Codec):
    """Byte-level BPE that reads the strings of special tokens as any other text."""

    def __init__(self, path: str):
        super().__init__(path)
        self._special, self._specials, self._vector = {}, None, True

    def lengths(self) -> np.ndarray:
        return self._length

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return _gather(self._data, self._first, self._length, ids)


class PieceCodec:
    """Ids of a sentencepiece model, word by word where that is proved to be the same: no piece goes on behind a blank, and text stays as it is."""

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.tokens = [bytes([int(n[3:5], 16)]) if m.is_byte(i) else n.replace(_MARK, " ").encode() for i, n in enumerate(names)]
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.first = np.cumsum(self.length) - self.length
        probe = "  ﬁ ①  x\t  é "
        as_is = m.normalize(probe) == _MARK + probe.replace(" ", _MARK)
        self.by_words = as_is and not any(_MARK in n.lstrip(_MARK) for n in names) and m.encode("a ")[-1] == m.piece_to_id(_MARK)
        self._lone = [m.piece_to_id(_MARK)]
        self._table, self._long = _Table(TABLE_BITS), {}

    def _make(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids words or whole texts have, and all their ids; the model itself puts a blank before each."""
        texts = [w[1:].decode("utf-8", "replace") for w in words]
        got = [x if t else self._lone for x, t in zip(self.model.encode(texts, num_threads=1), texts, strict=True)] if texts else []
        count = np.fromiter(map(len, got), np.int64, len(got))
        return count, np.fromiter(chain.from_iterable(got), np.uint32, int(count.sum()))

    def _long_ids(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of more than ROW bytes; those that are not known are encoded all at once."""
        new = list(dict.fromkeys(w for w in words if w not in self._long))
        count, ids = self._make(new)
        made = dict(zip(new, np.split(ids, np.cumsum(count)[:-1]), strict=True)) if new else {}
        out = [made[w] if w in made else self._long[w] for w in words]
        keep = {w: x.copy() for w, x in made.items() if len(w) <= 256}
        if len(self._long) + len(keep) > LONG_SEEN:
            self._long = {}
        if len(keep) <= LONG_SEEN:
            self._long.update(keep)
        return out

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each of which has a blank before it (or is empty), and each text's first (len + 1)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        opens = np.zeros(n, bool)
        if self.by_words:
            opens[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
            # a blank behind the mark that stands for blanks goes on with it
            mark = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
            opens[np.minimum(np.flatnonzero(mark) + 3, n - 1)] = False
        opens[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(opens)
        size = np.diff(np.append(start, n))
        raw, table = data.tobytes(), self._table
        if table.full > table.limit:
            table.clear()
        short = np.flatnonzero(size <= ROW)
        pad = np.concatenate([data, np.zeros(2 * ROW, np.uint8)])
        at8 = np.ndarray((n + ROW,), "<u8", pad, 0, (1,))
        low = at8[start[short]] & bpe._KEEP_BYTES[np.minimum(size[short], 8)]
        high = at8[np.minimum(start[short] + 8, n + 8)] & bpe._KEEP_BYTES[np.clip(size[short] - 8, 0, 8)]
        length = size[short].astype(np.uint64)
        slot = table.find(low, high, length)
        if len(missing := np.flatnonzero(slot < 0)):
            key = np.ascontiguousarray(np.stack([low[missing], high[missing], length[missing]], 1)).view(np.dtype((np.void, 24)))[:, 0]
            once = missing[np.unique(key, return_index=True)[1]]
            # what finds no room any more is encoded for this batch alone
            once = once[: max(0, (1 << table.bits) // 8 * 7 - table.full)]
            table.put_all(low[once], high[once], length[once], *self._make([raw[x : x + y] for x, y in zip(start[short[once]].tolist(), size[short[once]].tolist(), strict=True)]))
            slot[missing] = table.find(low[missing], high[missing], length[missing])
        count, at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        known = slot >= 0
        count[short[known]], at[short[known]] = table.count[slot[known]], table.at[slot[known]]
        mark = table.used
        rest = np.concatenate([np.flatnonzero(size > ROW), short[~known]])
        found = self._long_ids([raw[x : x + y] for x, y in zip(start[rest].tolist(), size[rest].tolist(), strict=True)])
        for k, ids in zip(rest.tolist(), found, strict=True):
            count[k], at[k] = len(ids), table.keep(ids)
        done = np.cumsum(count)
        ids = table.pool[np.repeat(at - (done - count), count) + np.arange(int(done[-1]))]
        table.used = mark
        return ids, np.concatenate([[0], done])[np.searchsorted(start, offsets)]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return _gather(self.data, self.first, self.length, ids)


def _gather(data: np.ndarray, first: np.ndarray, length: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The bytes of tokens, one after the other."""
    size = length[ids]
    done = np.cumsum(size)
    return data[np.repeat(first[ids] - (done - size), size) + np.arange(int(done[-1]) if len(done) else 0)]


@functools.lru_cache(maxsize=1)
def _decimals(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of all numbers below a limit, filled up with 0, and how many they are."""
    text = np.arange(limit).astype("S8").view(np.uint8).reshape(limit, 8)
    return text, (text > 0).sum(1)


class Alignment:
    """Tokens of both sides of a batch, their groups, and what each document has of them."""

    def __init__(self, a: np.ndarray, a_first: np.ndarray, a_length: np.ndarray, b: np.ndarray, b_first: np.ndarray, b_length: np.ndarray, offsets: np.ndarray):
        """a, b: ids of all texts; _first: each text's first (len + 1); _length: bytes of each token; offsets: borders of texts in bytes. The tokens of both sides are these bytes."""
        self.a, self.b, self.a_first, self.b_first, size = a.astype(np.int64), b.astype(np.int64), a_first, b_first, int(offsets[-1])
        a_end, b_end = np.cumsum(a_length), np.cumsum(b_length)
        both = (np.bincount(a_end, minlength=size + 1) > 0) & (np.bincount(b_end, minlength=size + 1) > 0)
        groups = np.cumsum(both)
        self.a_group, self.b_group = groups[np.maximum(a_end - 1, 0)], groups[np.maximum(b_end - 1, 0)]
        n = int(groups[-1]) if len(groups) else 0
        self.a_count, self.b_count = np.bincount(self.a_group, minlength=n), np.bincount(self.b_group, minlength=n)
        #: Each document's first group (len + 1).
        self.group_first = groups[offsets]
        self.n_groups = np.diff(self.group_first)
        links = np.concatenate([[0], np.cumsum(self.a_count * self.b_count)])
        self.n_links = np.diff(links[self.group_first])
        self.document = np.repeat(np.arange(len(offsets) - 1), self.n_groups)

    def pairs(self, limit: int = EXPAND):
        """(document, pair, links) of the different linked pairs of each document, in parts. Each part is in order, and no document's pair is in two; an id's links beyond ``limit`` are one part."""
        a, a_group, a_weight = self.a, self.a_group, np.ones(len(self.a), np.int64)
        b, b_group, b_weight = self.b, self.b_group, np.ones(len(self.b), np.int64)
        if int(self.n_links.sum()) > limit:
            a_group, a, a_weight = _weighed(a_group, a)
            b_group, b, b_weight = _weighed(b_group, b)
        b_count = np.bincount(b_group, minlength=len(self.b_count))
        b_start = np.cumsum(b_count) - b_count
        key = self.document[a_group] << BITS | a if len(a) else a
        order = np.argsort(key, kind="stable")
        a, a_group, a_weight, key = a[order], a_group[order], a_weight[order], key[order]
        each = b_count[a_group]
        done = np.cumsum(each)
        new = np.flatnonzero(np.diff(key, prepend=-1))
        at = 0
        while at < len(a):
            before = int(done[at - 1]) if at else 0
            stop = int(np.searchsorted(done, before + limit, side="right"))
            # up to the border between two ids
            k = int(np.searchsorted(new, stop, side="right")) - 1
            stop = len(a) if stop >= len(a) else int(new[k]) if int(new[k]) > at else int(new[k + 1]) if k + 1 < len(new) else len(a)
            here, n = slice(at, stop), each[at:stop]
            left = np.repeat(np.arange(at, stop), n)
            right = np.repeat(b_start[a_group[here]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            pair = a[left] << BITS | b[right]
            doc = self.document[a_group[left]]
            order = np.argsort(doc << 2 * BITS | pair, kind="stable")
            doc, pair, weight = doc[order], pair[order], (a_weight[left] * b_weight[right])[order]
            edge = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
            yield doc[edge], pair[edge], np.add.reduceat(weight, edge) if len(edge) else weight
            at = stop

    def _order(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokens of A and of B stand if each group's B follow its A."""
        a_done, b_done = np.cumsum(self.a_count), np.cumsum(self.b_count)
        b_before = b_done - self.b_count
        return np.arange(len(self.a)) + b_before[self.a_group], np.arange(len(self.b)) + a_done[self.b_group]

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups as ``a1,a2|b1;a3|b2``; '' for one without tokens."""
        a_at, b_at = self._order()
        n = len(self.a) + len(self.b)
        ids, group, of_b = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
        ids[a_at], ids[b_at], group[a_at], group[b_at], of_b[b_at] = self.a, self.b, self.a_group, self.b_group, True
        table, sizes = _decimals(1 << max(17, int(ids.max()).bit_length() if n else 0))
        digits = sizes[ids]
        width = int(digits.max()) + 1 if n else 1
        text = table[ids, :width]
        follows = np.append(group[1:] == group[:-1], False) if n else np.zeros(0, bool)
        turns = np.append(of_b[1:] != of_b[:-1], False) if n else np.zeros(0, bool)
        text[np.arange(n), digits] = np.where(~follows, ord(";"), np.where(turns, ord("|"), ord(",")))
        data = text[np.arange(width) <= digits[:, None]].tobytes()
        done = np.concatenate([[0], np.cumsum(digits + 1)])[self.a_first + self.b_first].tolist()
        return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(done[:-1], done[1:], strict=True)]


def _weighed(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids of each group, and how often they stand there."""
    key, count = np.unique(group << BITS | ids, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


def _aligned(a_codec: PlainCodec, b_codec: PieceCodec, column: pa.Array) -> Alignment:
    """The alignment of texts. Those that either side does not give back whole have no tokens."""
    spaced = pc.if_else(pc.greater(pc.binary_length(column), 0), pc.binary_join_element_wise(pa.scalar("", column.type), column, pa.scalar(" ", column.type)), pa.scalar("", column.type))
    data, offsets = W.buffers(spaced.fill_null(""))
    b, b_first = b_codec.encode_batch(data, offsets)
    a, a_first = a_codec.encode_batch(spaced)
    good = np.ones(len(column), bool)
    for ids, first, of in ((b, b_first, b_codec.bytes_of), (a, a_first, a_codec.bytes_of)):
        back = of(ids)
        if not np.array_equal(back, data):
            for k in range(len(good)):
                good[k] &= np.array_equal(of(ids[first[k] : first[k + 1]]), data[offsets[k] : offsets[k + 1]])
    if not good.all():
        a, a_first = _only(good, a, a_first)
        b, b_first = _only(good, b, b_first)
        offsets = np.concatenate([[0], np.cumsum(np.where(good, np.diff(offsets), 0))])
    return Alignment(a, a_first, a_codec.lengths()[a], b, b_first, b_codec.length[b], offsets)


def _only(good: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(first)
    return ids[np.repeat(good, size)], np.concatenate([[0], np.cumsum(np.where(good, size, 0))])


@functools.lru_cache(maxsize=1)
def _codecs(a_name: str, b_name: str) -> tuple[PlainCodec, PieceCodec]:
    return PlainCodec(SparkFiles.get(a_name)), PieceCodec(SparkFiles.get(b_name))


def _ship(docs: DataFrame, a_file: str, b_file: str, text_col: str) -> tuple[str, str]:
    spark = docs.sparkSession
    small_batches(spark)
    with open(b_file, "rb") as f:
        data = f.read()
    b_name = f"pieces-{hashlib.sha256(data).hexdigest()[:16]}"
    spark.sparkContext.addFile(put(spark, b_name, data))
    return bpe.ship(docs, a_file, text_col), b_name


def token_groups(docs: DataFrame, a_file: str, b_file: str, text_col: str = "text", out: str = "groups") -> DataFrame:
    """``docs`` with the array ``out`` of the groups of each whole text: the ids of A and of B, in order, that stand between two places where tokens of both end.

    A: byte-level BPE (JSON) of a blank and the text, B: a sentencepiece model that puts the blank
    itself. Texts that are null, empty, or not given back whole by either have no groups.
    """
    free(docs, out)
    names = _ship(docs, a_file, b_file, text_col)
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches):
        codecs = _codecs(*names)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for x, y in W.slices(column):
                g = _aligned(*codecs, column.slice(x, y - x))
                sides = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32))) for n, ids in ((g.a_count, g.a), (g.b_count, g.b))]
                groups = pa.ListArray.from_arrays(pa.array(g.group_first.astype(np.int32)), pa.StructArray.from_arrays(sides, ["a", "b"]))
                piece = batch.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([*piece.columns, groups.cast(kind)], [*piece.schema.names, out])

    side = T.ArrayType(T.IntegerType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.StructType([T.StructField("a", side), T.StructField("b", side)])))]))


def align(docs: DataFrame, a_file: str, b_file: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with the tokens, groups and links of each whole text, a digest of its groups, and what its links are corpus-wide.

    A link is an occurrence of a token of A and one of B in one group (see ``token_groups``). The count
    of a pair of ids is how many rows hold it linked. n_best: links whose count is the highest that
    their id of A has; count_sum: the counts of all links. Texts without groups get zeros and ''.
    Repeated rows count each. Names of the results must not be there. The text itself is not carried
    through the shuffles. A group of any size is expanded in parts of EXPAND pairs.
    """
    free(docs, *_COUNTS, "groups_sha256", "n_best", "count_sum")
    names = _ship(docs, a_file, b_file, text_col)
    keep = [f for f in docs.schema.fields if f.name != text_col]
    inner = [f"c{k}" for k in range(len(keep))]
    fields = [T.StructField(n, f.dataType) for n, f in zip(inner, keep, strict=True)]
    fields += [*(T.StructField(n, T.LongType()) for n in _COUNTS), T.StructField("groups_sha256", T.StringType())]
    pairs = [T.StructField("row", T.LongType()), T.StructField("head", T.BooleanType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("links", T.ArrayType(T.LongType()))]

    def run(batches):
        codecs = _codecs(*names)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = batch.column(0)
            for x, y in W.slices(column):
                g = _aligned(*codecs, column.slice(x, y - x))
                n = y - x
                info = [*batch.slice(x, n).columns[1:], *(pa.array(v) for v in (np.diff(g.a_first), np.diff(g.b_first), g.n_groups, g.n_links)), pa.array(g.digests(), pa.string())]
                row = pa.array(number + np.arange(n))
                number += n
                head = True
                for doc, pair, links in g.pairs() if len(g.a) else [(np.zeros(0, np.int64),) * 3]:
                    first = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(first, pa.array(v)) for v in (pair, links)]
                    # further parts of the same rows carry nothing but pairs
                    rest = info if head else [pa.nulls(n, c.type) for c in info]
                    yield pa.RecordBatch.from_arrays([*rest, row, pa.array([head] * n), *lists], [f.name for f in [*fields, *pairs]])
                    head = False

    found = docs.select(F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{f.name}`").alias(n) for f, n in zip(keep, inner, strict=True))).mapInArrow(run, T.StructType([*fields, *pairs]))
    found = materialize(found, "aligned")
    counts = materialize(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("rows")), "pairs")
    return _with_counts(found, counts, fields).select(*(F.col(n).alias(f.name) for f, n in zip(keep, inner, strict=True)), *_COUNTS, "groups_sha256", "n_best", "count_sum")


def hot_from(counts: DataFrame, limit: int = HOT) -> int:
    """The least power of two such that at most ``limit`` pairs come in so many rows."""
    sizes = {r.k: r.n for r in counts.groupBy(F.floor(F.log2("rows")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}
    total, k = 0, max(sizes, default=-1) + 1
    while k > 0 and total + sizes.get(k - 1, 0) <= limit:
        k -= 1
        total += sizes.get(k, 0)
    return 1 << k


def _with_counts(found: DataFrame, counts: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Rows of ``found`` with n_best and count_sum, by their pairs' rows in ``counts``."""
    spark = found.sparkSession
    side = F.shiftright("pair", BITS).alias("a")
    # a row for each id of A: its vocabulary bounds this table
    top = counts.groupBy(side).agg(F.max("rows").alias("top"))
    judged = counts.withColumn("a", side).join(F.broadcast(top), "a").select("pair", "rows", (F.col("rows") == F.col("top")).cast("long").alias("best"))
    border = hot_from(counts)
    hot = judged.where(F.col("rows") >= border).orderBy("pair").toArrow()
    table = spark.sparkContext.broadcast(tuple(np.asarray(hot.column(k).combine_chunks().to_numpy(zero_copy_only=False), np.int64) for k in range(3)))
    names = [f.name for f in fields]
    out = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in ("row", "pair", "links", "n_best", "count_sum"))])

    def look_up(batches):
        keys, rows, best = table.value
        for batch in batches:
            x = {n: batch.column(batch.schema.get_field_index(n)) for n in (*names, "row", "pairs", "links")}
            n = batch.num_rows
            first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x["pairs"]), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            pair, links = (np.asarray(pc.list_flatten(x[k]).to_numpy(zero_copy_only=False), np.int64) for k in ("pairs", "links"))
            at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            there = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            sums = []
            for values in (best, rows):
                got = np.zeros(len(pair), np.int64)
                got[there] = links[there] * values[at[there]]
                sums.append(np.diff(np.concatenate([[0], np.cumsum(got)])[first]))
            rest = np.flatnonzero(~there)
            owner = np.searchsorted(first, rest, side="right") - 1
            row = x["row"].to_numpy()
            # a row that carries the text's own columns has a key of its own, which no pair has
            nothing = np.zeros(len(rest), np.int64)
            where = pa.array(np.concatenate([np.arange(n), nothing]), mask=np.concatenate([np.zeros(n, bool), np.ones(len(rest), bool)]))
            longs = (np.concatenate(v) for v in ((row, row[owner]), (-1 - row, pair[rest]), (np.zeros(n, np.int64), links[rest]), (sums[0], nothing), (sums[1], nothing)))
            yield pa.RecordBatch.from_arrays([*(x[c].take(where) for c in names), *(pa.array(v) for v in longs)], out.names)

    # only pairs of fewer rows than the border are left to join
    spread = found.select(*names, "row", "pairs", "links").mapInArrow(look_up, out)
    rare = judged.where(F.col("rows") < border).select("pair", "rows", "best")
    joined = spread.join(rare, "pair", "left")
    total = lambda mine, theirs: F.sum(F.col(mine) + F.coalesce(F.col("links") * F.col(theirs), F.lit(0))).alias(mine)
    return joined.groupBy("row").agg(*(F.first(n, ignorenulls=True).alias(n) for n in names), total("n_best", "best"), total("count_sum", "rows"))
