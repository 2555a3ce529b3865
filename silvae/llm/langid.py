"""Language identification by language-bitmask n-gram filters.

One Bloom filter of each language, laid side by side: a cell holds a bit for each language, so the
AND of an n-gram's cells is the set of languages that hold it. The bits are counted over a text,
each language's count is freed of its filter's expected false positives, and the highest decides.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from silvae.llm import words as W
from silvae.llm.mil import fold
from silvae.llm.store import free, materialize, small_batches

#: Characters of an n-gram, cells (a power of two), hash functions, and languages of a word of a cell.
GRAM, CELL_BITS, PROBES, WORD = 4, 20, 3, 64
#: Labelled texts of each language that the filters are made from, at most.
SAMPLE = 500
#: Bytes of a text from which on it is worked on in blocks of as many.
LONG = 1 << 20
#: An n-gram is a language's if it is at least so frequent there as this part of its highest frequency in any.
SHARE = 0.2


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case code point of every letter, and 0 of all else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, the text each is of, and each text's number of letters.

    All but letters counts as one space between words; every text begins and ends with one."""
    data, offsets = W.buffers(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = leads[offsets]
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    low = _letters()[points]
    is_letter = low > 0
    letters = np.bincount(of[is_letter], minlength=len(n))
    # a space in front of every text and after the last, then runs of others shrunk to one
    text = np.insert(low, first[:-1], 0)
    of = np.insert(of, first[:-1], np.arange(len(n)))
    keep = text > 0
    keep[1:] |= text[:-1] > 0
    keep[0:1] = True
    keep[first[:-1] + np.arange(len(n))] = True
    text, of = np.append(text[keep], 0).astype(np.uint64), np.append(of[keep], -1)
    size = len(text) - GRAM + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), letters
    h = np.zeros(size, np.uint64)
    for k in range(GRAM):
        h = h << np.uint64(21) ^ h >> np.uint64(43)
        h ^= text[k : k + size]
    # the character after a text's last is the next text's opening space: a gram may end on it after a letter
    ends = (text[GRAM - 1 :] == 0) & (text[GRAM - 2 : GRAM - 2 + size] > 0)
    whole = (of[:size] == of[GRAM - 2 : GRAM - 2 + size]) & ((of[:size] == of[GRAM - 1 :]) | ends)
    return W.mix(h[whole]), of[:size][whole], letters


def pieces(text: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """The n-grams' hashes and the letters of one text of any length, block by block: those of ``grams``."""
    tail, at = np.zeros(1, np.uint32), 0
    while at < len(text):
        end = min(len(text), at + LONG)
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        low = _letters()[np.frombuffer(text[at:end].decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        at = end
        before = np.concatenate([tail[-1:], low[:-1]])
        norm = np.concatenate([tail, low[(low > 0) | (before > 0)]])
        if at == len(text) and norm[-1]:
            norm = np.append(norm, 0)
        yield _hashes(norm), int(np.count_nonzero(low))
        tail = norm[-(GRAM - 1) :]


def _hashes(norm: np.ndarray) -> np.ndarray:
    size = len(norm) - GRAM + 1
    h = np.zeros(max(0, size), np.uint64)
    for k in range(GRAM if size > 0 else 0):
        h = h << np.uint64(21) ^ h >> np.uint64(43)
        h ^= norm[k : k + size].astype(np.uint64)
    return W.mix(h)


class Filters:
    """Bit-sliced filters of several languages: a cell has a bit for each, in words of 64."""

    def __init__(self, languages: list[str], cells: np.ndarray):
        self.languages, self.cells = languages, cells
        bit = lambda b: cells[:, b // WORD] >> cells.dtype.type(b % WORD) & cells.dtype.type(1)
        self.false = np.array([np.count_nonzero(bit(b)) / len(cells) for b in range(len(languages))]) ** PROBES

    @staticmethod
    def empty(languages: list[str]) -> np.ndarray:
        """Cells without a bit, no wider than the languages need."""
        kind = next((k for k, b in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= b), np.uint64)
        return np.zeros((1 << CELL_BITS, max(1, -(-len(languages) // WORD))), kind)

    @staticmethod
    def at(h: np.ndarray, probe: int) -> np.ndarray:
        return (h >> np.uint64(CELL_BITS * probe)) & np.uint64((1 << CELL_BITS) - 1)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The set of languages of each n-gram, as bits of words."""
        out = self.cells[self.at(h, 0)]
        for p in range(1, PROBES):
            out &= self.cells[self.at(h, p)]
        return out

    def hits(self, h: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
        """How many n-grams of each of ``count`` texts each language holds."""
        masks = self.masks(h)
        one = masks.dtype.type(1)
        return np.stack([np.bincount(of[(masks[:, b // WORD] >> masks.dtype.type(b % WORD) & one) > 0], minlength=count) for b in range(len(self.languages))], 1)

    def decide(self, hits: np.ndarray, n: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each text by its counts, ``und`` without letters, and its share of all languages' evidence."""
        clean = np.clip((hits / np.maximum(1, n)[:, None] - self.false) / np.maximum(1 - self.false, 1e-12), 0, 1)
        best, share, some = clean.argmax(1), clean.max(1) / np.maximum(clean.sum(1), 1e-12), letters > 0
        return [self.languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, share, 0.0)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """``decide`` of texts, long ones block by block."""
        if not self.languages:
            return ["und"] * len(column), np.zeros(len(column))
        data, offsets = W.buffers(column)
        if len(column) == 1 and len(data) > LONG:
            total, n, letters = np.zeros((1, len(self.languages)), np.int64), 0, 0
            for h, some in pieces(data.tobytes()):
                total, n, letters = total + self.hits(h, np.zeros(len(h), np.int64), 1), n + len(h), letters + some
            return self.decide(total, np.array([n]), np.array([letters]))
        h, of, letters = grams(column)
        return self.decide(self.hits(h, of, len(column)), np.bincount(of, minlength=len(column)), letters)


def _once(batches):
    """(lang, gram) of each text's distinct n-grams."""
    for batch in batches:
        for a, b in W.slices(batch.column(1)):
            texts, names = batch.column(1).slice(a, b - a), batch.column(0).slice(a, b - a)
            if b - a == 1:
                parts = [np.unique(h) for h, _ in pieces(W.buffers(texts)[0].tobytes())]
                pairs = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]))
                of = np.zeros(len(pairs), np.int64)
            else:
                h, of, _ = grams(texts)
                both = np.unique(np.stack([of.astype(np.uint64), h], 1), axis=0)
                of, pairs = both[:, 0].astype(np.int64), both[:, 1]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), pa.array(pairs.view(np.int64))], ["lang", "gram"])


def _cells(batches):
    """(cell, word, mask): the bits that n-grams (gram, bit) set."""
    for batch in batches:
        h, bit = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        cell = np.concatenate([Filters.at(h, p) for p in range(PROBES)]).astype(np.int64)
        mask = np.left_shift(np.uint64(1), (bit % WORD).astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.tile(bit // WORD, PROBES).astype(np.int32)), pa.array(np.tile(mask, PROBES))], ["cell", "word", "mask"])


def sample_texts(docs: DataFrame, languages: dict[str, int], sample: int) -> DataFrame:
    """(lang, text): at most ``sample`` labelled texts of each language, by a hash of id and text; repeated rows count once.

    languages: about how many different hashes each has. A bound that some times as many of them as are
    wanted meet comes first, so one scan finds them and little is sorted; a language of few texts has no bound."""
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, min(1.0, 4 * sample / n)) for k, n in languages.items()], "lang string, share double")
    h = F.xxhash64("doc_id", "text")
    some = docs.join(F.broadcast(share), "lang").where(h.cast("double") / 2.0**64 + 0.5 <= F.col("share"))
    each = some.groupBy("lang", h.alias("h")).agg(F.min("text").alias("text"))
    w = Window.partitionBy("lang").orderBy("h")
    return each.withColumn("k", F.row_number().over(w)).where(F.col("k") <= sample).select("lang", "text")


def fit_languages(docs: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> Filters:
    """Filters of the labelled languages, from at most ``sample`` texts of each outside fold ``held``, chosen by a hash of id and text.

    One scan counts the languages, one takes the texts. N-grams are counted by the executors; the driver
    gets at most 2^20 cells for each 64 languages, 8 MB, and broadcasts as much. Rows with a null text
    or language are not used, repeated ones once. Without labelled texts every prediction is ``und``.
    """
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held))
    # of different texts, not of rows: copies of one text are sampled as one
    languages = {r.lang: max(1, r.n) for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text"), 0.03).alias("n")).toLocalIterator()}
    names = sorted(languages)
    cells = Filters.empty(names)
    if not names:
        return Filters(names, cells)
    small_batches(docs.sparkSession)
    texts = materialize(sample_texts(known, languages, sample), "sample")
    sizes = texts.groupBy("lang").agg(F.count("*").alias("size"))
    counted = texts.mapInArrow(_once, "lang string, gram long").groupBy("lang", "gram").agg(F.count("*").alias("n")).join(F.broadcast(sizes), "lang").withColumn("f", F.col("n") / F.col("size"))
    counted = materialize(counted.select("lang", "gram", "f"), "grams")
    # of each n-gram the languages that have it often enough; rows of one n-gram are no more than there are languages
    top = counted.groupBy("gram").agg(F.max("f").alias("top"))
    bits = docs.sparkSession.createDataFrame(list(enumerate(names)), "bit int, lang string")
    own = counted.join(top, "gram").where(F.col("f") >= SHARE * F.col("top")).join(F.broadcast(bits), "lang")
    set_ = own.select("gram", "bit").mapInArrow(_cells, "cell long, word int, mask long").groupBy("cell", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    cells[set_.column("cell").to_numpy(), set_.column("word").to_numpy()] = set_.column("mask").to_numpy().view(np.uint64).astype(cells.dtype)
    return Filters(names, cells)


def predict_language(docs: DataFrame, filters: Filters, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of each whole text and a score between 0 and 1.

    A null text and one without letters is ``und`` with score 0; ties go to the first language by name,
    repeated rows get the same. ``lang`` and ``score`` must not be columns of ``docs``.
    """
    free(docs, lang, score)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for a, b in W.slices(texts):
                names, scores = shared.value.predict(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, lang, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))
