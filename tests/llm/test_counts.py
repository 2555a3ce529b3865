"""Token counts against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from silvae.llm import bpe, counts, op11_counts
from tests.helpers import SF
from tests.llm.test_bpe import texts

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lex") / "lexicon")
    bpe.compile_lexicon(FILE, path)
    return counts.Counter(path)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def more_texts():
    r = random.Random(11)
    parts = ["'s", "'S", "'", "''", "'re", "'r", "'ve", "'ll", "'l", "don't", " ", "  ", "\n", " ", "x", "és", "12", "१", "!", "<|endoftext|>", "<|endof", "'d'm", "’s"]
    out = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    return out + ["<|endof", "text|>", "internationalisation" * 30, "z" * 1000, " " * 999, "漢" * 77]


def test_split_as_the_pattern_does():
    rows = [t or "" for t in texts() + more_texts()]
    data, offsets = counts.W.buffers(pa.array(rows))
    start = counts.split(data, offsets)
    cut = [x.decode() for x in np.split(np.frombuffer(data.tobytes(), np.uint8), start[1:]) for x in [x.tobytes()]]
    assert cut == [w for t in rows for w in bpe._SPLIT.findall(t)]


def test_counts_of_the_library(counter, library):
    rows = texts() + more_texts()
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in rows]
    assert counter.count(pa.array(rows)).tolist() == want
    assert counter.count(pa.array(rows)).tolist() == want
    assert [int(counter.count(pa.array([t], pa.string()))[0]) for t in rows[:400]] == want[:400]


def test_full_tables_start_anew(counter, library, monkeypatch):
    monkeypatch.setattr(counter, "_seen", bpe._Pieces(5))
    rows = texts()
    for k in range(0, len(rows), 40):
        assert counter.count(pa.array(rows[k : k + 40])).tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in rows[k : k + 40]]


def test_long_texts_block_by_block(counter, library, monkeypatch):
    monkeypatch.setattr(counts, "BLOCK", 64)
    r = random.Random(5)
    rows = ["".join(r.choice(["word ", "  two", "\n", " été", "it's ", "<|endoftext|>", "  ", "a" * 90]) for _ in range(200)) for _ in range(20)]
    assert counter.count(pa.array(rows)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in rows]


def test_proved_tokens_are_tokens(counter, library):
    """Whole tokens are exactly those that the library keeps whole, among all that its split leaves whole."""
    whole = {w.decode() for w in counter._long_whole}
    vocab = {bytes(x for x in map({c: b for b, c in enumerate(bpe.byte_letters())}.get, t) if x is not None): i for t, i in library.get_vocab().items()}
    for raw, i in vocab.items():
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if len(raw) > counts.ROW and bpe._SPLIT.findall(text) == [text] and "<|" not in text:
            assert (library.encode(text, add_special_tokens=False).ids == [i]) == (text in whole), text


def test_query_and_edges(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    n = {d.doc_id: len(library.encode(d.text or "", add_special_tokens=False).ids) for d in docs}
    want = sorted((d.doc_id, len((d.text or "").encode()), n[d.doc_id], n[d.doc_id] > 1024) for d in docs)
    assert sorted(map(tuple, op11_counts.op11_token_counts(spark, SF).collect())) == want
    df = spark.createDataFrame([(1, None), (None, ""), (3, "a b"), (3, "a b")], "doc_id long, text string").withColumn("n_words", F.lit(7))
    assert sorted((r.text or "", r.n_tokens, r.n_words) for r in counts.count_tokens(df, FILE).collect()) == [("", 0, 7), ("", 0, 7), ("a b", 2, 7), ("a b", 2, 7)]
    assert counts.count_tokens(df.limit(0), FILE).count() == 0
    with pytest.raises(ValueError, match="n_words"):
        counts.count_tokens(df, FILE, out="n_words")
