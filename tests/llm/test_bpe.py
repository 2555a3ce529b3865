"""BPE against the tokenizers library, and the transducer against a dictionary."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from silvae.llm import bpe, lexicon, op3_bpe
from tests.helpers import SF

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lex") / "lexicon")
    bpe.compile_lexicon(FILE, path)
    return bpe.Codec(path)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def texts():
    r = random.Random(4)
    letters = " \n\t\r\x0b\x85\xa0\u2003\u3000\x1c'sStTlLve rem1\u0967\u00bd\u2167\u00e9\u6f22\U0001f600<|endoftext|>-_.,\u0301\u200d"
    pieces = ["<|endoftext|>", "  ", "'ll", "'re", " \n", "hello", " world", "\u00a0 \u00a0", "  x"]
    out = ["", None, " ", "\n", "a" * 300, "x " * 500, "\u00e9" * 41, "<|", "<|endoftext|"]
    for i in range(1500):
        pool = letters if i % 2 else " \nab\u00e91."
        out.append("".join(r.choice(pieces) if r.random() < 0.15 else r.choice(pool) for _ in range(r.randint(0, 40))))
    return out


def test_one_by_one_and_together(codec, library):
    rows = texts()
    ids, first = codec.encode_batch(pa.array(rows))
    decoded = codec.decode_batch(ids, first)
    for k, t in enumerate(rows):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(t), np.uint32).tolist() == want, t
        assert ids[first[k] : first[k + 1]].tolist() == want, t
        assert decoded[k].decode() == library.decode(want, skip_special_tokens=False) == codec.decode(want) == (t or "")


def test_full_tables_start_anew(codec, library, monkeypatch):
    monkeypatch.setattr(codec, "_table", bpe._Pieces(6))
    rows = texts()
    for k in range(0, len(rows), 50):
        ids, first = codec.encode_batch(pa.array(rows[k : k + 50]))
        for j, t in enumerate(rows[k : k + 50]):
            assert ids[first[j] : first[j + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_ids_that_are_no_utf8(codec, library):
    ids = [library.token_to_id("Ã"), 50256, library.token_to_id("a")]
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    got = codec.decode_batch(np.array(ids, np.uint32), np.array([0, 3]))
    assert got[0].decode() == codec.decode(ids)


def test_transducer(tmp_path):
    r = random.Random(1)
    words = {bytes(r.choice(b"abc\x00\xff") for _ in range(r.randint(1, 7))): tuple(r.randrange(9) for _ in range(r.randint(0, 3))) for _ in range(400)}
    lexicon.write(str(tmp_path / "x"), words, {"more": np.arange(3)})
    x = lexicon.Lexicon(str(tmp_path / "x"))
    assert x.array("more").tolist() == [0, 1, 2]
    for w, ids in words.items():
        assert np.frombuffer(x.find(w), np.uint32).tolist() == list(ids)
    for _ in range(300):
        w = bytes(r.choice(b"abc\x00\xff") for _ in range(r.randint(1, 8)))
        assert (x.find(w) is not None) == (w in words)
    # suffixes are shared: far fewer states than a tree of the words has
    assert len(x.array("first")) - 1 < len({w[:k] for w in words for k in range(len(w) + 1)}) / 1.5


def test_merge_of_long_words(codec):
    r = random.Random(3)
    for n in (59, 60, 61, 500):
        ids = [codec._letters[r.choice(b"the ing")] for _ in range(n)]
        slow = list(ids)
        while True:
            best = min(((codec._ranks[a << 20 | b], k) for k, (a, b) in enumerate(zip(slow, slow[1:])) if a << 20 | b in codec._ranks), default=None)
            if best is None:
                break
            slow[best[1] : best[1] + 2] = [best[0] & 0xFFFFF]
        assert bpe.merge(list(ids), codec._ranks) == slow


def test_frames(spark, library):
    df = spark.createDataFrame([(1, "Hello <|endoftext|> world", "keep"), (2, None, None), (None, "", "x"), (1, "Hello <|endoftext|> world", "keep")], "doc_id long, text string, n_tokens string")
    got = bpe.decode(bpe.encode(df, FILE), FILE).collect()
    assert [(r.ids, r.decoded, r.n_tokens) for r in got] == [(library.encode(r.text or "", add_special_tokens=False).ids, r.text or "", r.n_tokens) for r in df.collect()]
    assert [(r.ids, r.decoded) for r in bpe.transcode(df, FILE).collect()] == [(r.ids, r.decoded) for r in got]
    assert bpe.encode(df.limit(0), FILE).count() == 0
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(df.withColumn("ids", F.lit(1)), FILE)


def test_query_against_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op3_bpe.op3_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_frequent_words_of_several_ids(spark, library, tmp_path):
    df = spark.createDataFrame([(" zyxwvu zyxwvu abc",), (None,), ("zyxwvu",)], "text string")
    words = bpe.frequent_words(df, "text")
    assert words == (" zyxwvu",)
    bpe.compile_lexicon(FILE, str(tmp_path / "x"), words)
    ids = library.encode(" zyxwvu", add_special_tokens=False).ids
    assert len(ids) > 1 and np.frombuffer(lexicon.Lexicon(str(tmp_path / "x")).find(b" zyxwvu"), np.uint32).tolist() == ids
