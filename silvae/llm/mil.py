"""A document quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from how its bytes follow each other and
how its words repeat; a gate and an attention weight, both learned from labels of whole documents,
say how much it counts; the weighted mean of the encodings is scored. Poor passages can so decide
a document most of which is well written, without any label of a passage.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvae.llm import words as W
from silvae.llm.store import free, small_batches

#: Words of a passage.
PASSAGE = 40
#: Labelled documents that the model is fitted on, at most, and the largest text among them, in bytes.
SAMPLE, SAMPLE_BYTES = 2400, 50_000
#: Bytes of a text from which on it is worked on in blocks of about as many.
LONG = 1 << 20
#: Bytes of texts that are encoded together: what encoding holds is some 60 times as much.
SLICE = 1 << 18

_KIND = np.full(256, 9, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:], _KIND[:32] = 0, 1, 2, 10, 11
for _c, _k in ((" ", 3), ("\n", 4), (".", 5), (",", 6), ("|", 7), ("!", 8), ("?", 8)):
    _KIND[ord(_c)] = _k
_KINDS = 12
FEATURES = _KINDS + _KINDS * _KINDS + 4


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and each text's first passage (len + 1). A text without words is one empty passage."""
    data, offsets = W.buffers(column)
    start, end, h, first = W.words(data, offsets, W.NOT_SPACE)
    count = np.diff(first)
    bags = np.maximum(1, -(-count // PASSAGE))
    bag_first = np.concatenate([[0], np.cumsum(bags)])
    out = np.zeros((bag_first[-1], FEATURES), np.float32)
    if not len(h):
        return out, bag_first
    word_in = np.arange(len(h)) - np.repeat(first[:-1], count)
    of_word = np.repeat(bag_first[:-1], count) + word_in // PASSAGE
    opens = np.flatnonzero(word_in % PASSAGE == 0)
    used = of_word[opens]
    begin = start[opens]
    # bytes from a passage's first word to the next passage's, or its text's end
    doc_end = np.repeat(offsets[1:], np.bincount(np.searchsorted(bag_first, used, side="right") - 1, minlength=len(count)))
    stop = np.minimum(np.append(begin[1:], offsets[-1]), doc_end)
    size = stop - begin
    kinds = _KIND[data].astype(np.int64)
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    local = np.repeat(np.arange(len(used)), size)
    single = np.bincount(local * _KINDS + kinds[at], minlength=len(used) * _KINDS).reshape(-1, _KINDS)
    inner = np.flatnonzero(local[1:] == local[:-1])
    pair = kinds[at[inner]] * _KINDS + kinds[at[inner + 1]]
    double = np.bincount(local[inner] * _KINDS * _KINDS + pair, minlength=len(used) * _KINDS * _KINDS).reshape(-1, _KINDS * _KINDS)
    n = np.bincount(of_word, minlength=len(out))[used].astype(np.float32)
    order = np.lexsort([h, of_word])
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])])
    distinct = np.bincount(of_word[order][new], minlength=len(out))[used]
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    repeated = np.bincount(of_word, again, minlength=len(out))[used]
    length = np.bincount(of_word, end - start, minlength=len(out))[used]
    out[used, :_KINDS] = single / size[:, None]
    out[used, _KINDS : _KINDS + _KINDS * _KINDS] = double / np.maximum(size - 1, 1)[:, None]
    out[used, -4:] = np.stack([distinct / n, repeated / n, length / n / 10, n / PASSAGE], 1)
    return out, bag_first


def pieces(text: bytes) -> Iterator[np.ndarray]:
    """The features of ``passages`` of one text of any length, block by block; a block ends where a passage begins."""
    at, given = 0, False
    while at < len(text):
        end = at + LONG
        data = text[at:end]
        while True:
            # up to a byte that is in no word, and so many words that one passage is whole
            cut = len(data) if end >= len(text) else max((data.rfind(bytes([c])) for c in np.flatnonzero(~W.NOT_SPACE).tolist()), default=-1) + 1
            start, _, _, first = W.words(np.frombuffer(data[:cut], np.uint8), np.array([0, cut]), W.NOT_SPACE)
            if end >= len(text) or first[1] > PASSAGE:
                break
            end += LONG
            data = text[at:end]
        if end < len(text):
            cut = int(start[(first[1] - 1) // PASSAGE * PASSAGE])
        x, _ = passages(pa.array([data[:cut]], pa.large_binary()))
        if first[1] or not given and at + cut >= len(text):
            given = True
            yield x
        at += cut
    if not text:
        yield np.zeros((1, FEATURES), np.float32)


def _by_bag(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first[:-1], axis=0)


class Model:
    """Encoder, gated attention and scorer; ``fit`` learns all of them together."""

    HIDDEN, ATTENTION = 24, 12

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        e, a = self.HIDDEN, self.ATTENTION
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {"W": draw(FEATURES, e), "b": np.zeros(e, np.float32), "V": draw(e, a), "U": draw(e, a), "w": draw(a, 1)[:, 0], "c": draw(e, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.random = r

    def _forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        s = (t * g) @ p["w"]
        size = np.diff(first)
        s = np.exp(np.clip(s - np.repeat(np.maximum.reduceat(s, first[:-1]), size), -60, 0))
        a = s / np.repeat(_by_bag(s, first), size)
        z = _by_bag(a[:, None] * h, first)
        return h, t, g, a, z, z @ p["c"] + p["d"][0]

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each bag."""
        return 1 / (1 + np.exp(-np.clip(self._forward(self._standard(x), first)[-1].astype(np.float64), -30, 30)))

    def score_pieces(self, parts: Iterable[np.ndarray]) -> float:
        """``score`` of one bag that comes in parts: the weighted sum is carried on with the greatest weight so far."""
        p, most, total, z = self.p, -np.inf, 0.0, np.zeros(self.HIDDEN)
        for x in parts:
            h = np.tanh(self._standard(x) @ p["W"] + p["b"])
            s = ((np.tanh(h @ p["V"]) / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))) @ p["w"]).astype(np.float64)
            top = max(most, s.max())
            e, old = np.exp(s - top), np.exp(most - top)
            most, total, z = top, total * old + e.sum(), z * old + e @ h
        return float(1 / (1 + np.exp(-np.clip(z / total @ p["c"] + p["d"][0], -30, 30))))

    def attention(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The weight of each passage in its bag."""
        return self._forward(self._standard(x), first)[3]

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.004, decay: float = 1e-4) -> Model:
        self.mean, self.scale = x.mean(0), x.std(0) + np.float32(1e-3)
        x = self._standard(x)
        size = np.diff(first)
        prior = np.clip(y.mean(), 0.01, 0.99)
        self.p["d"][0] = np.log(prior / (1 - prior))
        m, v, step = {k: np.zeros_like(q) for k, q in self.p.items()}, {k: np.zeros_like(q) for k, q in self.p.items()}, 0
        for epoch in range(epochs):
            order = self.random.permutation(len(y))
            for k in range(0, len(order), batch):
                take = order[k : k + batch]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in take.tolist()])
                f = np.concatenate([[0], np.cumsum(size[take])])
                grads = self._gradients(x[rows], f, y[take])
                step += 1
                now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                for n, g in grads.items():
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.999 * v[n] + 0.001 * g * g
                    self.p[n] -= now * (m[n] / (1 - 0.9**step) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8) + decay * self.p[n])
        return self

    def _gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, size = self.p, np.diff(first)
        h, t, g, a, z, logit = self._forward(x, first)
        dl = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype(np.float32)
        dz = np.repeat(dl[:, None] * p["c"], size, axis=0)
        da = (dz * h).sum(1)
        ds = a * (da - np.repeat(_by_bag(a * da, first), size))
        dtg = ds[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ dl, "d": dl.sum(keepdims=True)}


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Model:
    """A model of the labels, from at most ``sample`` labelled documents outside fold ``held``, chosen by a hash of their id.

    Null labels are not used, nor texts of over SAMPLE_BYTES bytes. Where an id has several labels the
    greatest counts, where it has several texts that of the smallest hash. Without any labelled
    document every score is the prior of an unfitted model.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    # at most ``sample`` rows of two numbers are broadcast, and one text of each id goes on
    rows = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").cast("double").alias("y")).select("text", "y")
    small_batches(docs.sparkSession)

    def encode(batches):
        for batch in batches:
            for a, b in W.slices(batch.column(0), SLICE):
                x, first = passages(batch.column(0).slice(a, b - a))
                data = [x[i:j].astype(np.float16).tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), batch.column(1).slice(a, b - a)], ["x", "y"])

    got = sorted((bytes(r.x), r.y) for r in rows.mapInArrow(encode, "x binary, y double").toLocalIterator())
    model = Model()
    if not got:
        return model
    x = [np.frombuffer(b, np.float16).reshape(-1, FEATURES) for b, _ in got]
    first = np.concatenate([[0], np.cumsum([len(b) for b in x])])
    return model.fit(np.concatenate(x).astype(np.float32), first, np.array([float(y > 0) for _, y in got], np.float32))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the double column ``out``, between 0 and 1, of each whole text.

    A null or empty text is one empty passage; long ones are read block by block, repeated rows get the
    same. ``out`` must not be a column of ``docs``."""
    free(docs, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for a, b in W.slices(texts, SLICE):
                data, _ = W.buffers(texts.slice(a, b - a))
                if b - a == 1 and len(data) > LONG:
                    scores = [shared.value.score_pieces(pieces(data.tobytes()))]
                else:
                    scores = shared.value.score(*passages(texts.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(scores, pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
