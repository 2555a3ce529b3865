"""Alignment against plain Python over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from silvae.llm import align, bpe, op13_align
from silvae.llm import words as W
from tests.helpers import SF
from tests.llm.test_bpe import texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def codecs(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lex") / "lexicon")
    bpe.compile_lexicon(A, path)
    return align.PlainCodec(path), align.PieceCodec(B)


def groups(library, text):
    """[(ids of A, ids of B)] by walking both lists of tokens."""
    if not text:
        return []
    t, m = library
    to_byte = {c: b for b, c in enumerate(bpe.byte_letters())}
    a = [(i, bytes(to_byte[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()) for i in m.encode(text)]
    want = (" " + text).encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return []
    ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
    cuts = sorted(ends[0] & ends[1])
    out = [([], []) for _ in cuts]
    for side, tokens in enumerate((a, b)):
        at = g = 0
        for i, x in tokens:
            at += len(x)
            while cuts[g] < at:
                g += 1
            out[g][side].append(i)
    return out


def expected(library, rows):
    all_ = [groups(library, t) for _, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in all_]
    count = Counter(p for c in links for p in c)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    for (doc_id, _), g, c in zip(rows, all_, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (
            doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), hashlib.sha256(text.encode()).hexdigest() if g else "",
            sum(n for p, n in c.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in c.items()),
        )


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def key(r):
    return tuple(str(x) for x in r)


def odd():
    r = random.Random(2)
    parts = [" ", "  ", "word", " a", "\n", "▁", "漢字", "😀🦊", "<s>", "</s>", "<0x41>", "<|endoftext|>", "é", "é", " ", "\t", "ﬁ", "12345", "\0", "'s"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(800)] + [" ", "   ", "a ", " a", "😀" * 60]


def test_pieces_word_by_word(library, codecs):
    rows = [t for t in [x or "" for x in texts()] + odd() if t]
    assert codecs[1].by_words
    data, offsets = W.buffers(pa.array([" " + t for t in rows]))
    ids, first = codecs[1].encode_batch(data, offsets)
    for k, t in enumerate(rows):
        assert ids[first[k] : first[k + 1]].tolist() == library[1].encode(t), t


def test_groups_of_odd_texts(library, codecs):
    rows = texts() + odd()
    g = align._aligned(*codecs, pa.array(rows))
    got = g.digests()
    for k, (want, t) in enumerate(zip((e for e in expected(library, list(enumerate(rows)))), rows, strict=True)):
        mine = (k, int(np.diff(g.a_first)[k]), int(np.diff(g.b_first)[k]), int(g.n_groups[k]), int(g.n_links[k]), got[k])
        assert mine == want[:6], t


def test_pairs_in_parts(codecs):
    g = align._aligned(*codecs, pa.array(odd()))
    whole = [x for d, p, n in g.pairs() for x in zip(d.tolist(), p.tolist(), n.tolist(), strict=True)]
    for limit in (1, 7, 300):
        assert sorted(x for d, p, n in g.pairs(limit) for x in zip(d.tolist(), p.tolist(), n.tolist(), strict=True)) == sorted(whole)


@pytest.mark.parametrize("hot", [0, 40, align.HOT])
def test_rows_against_plain_python(spark, library, monkeypatch, hot):
    monkeypatch.setattr(align.hot_from, "__defaults__", (hot,))
    monkeypatch.setattr(align.Alignment.pairs, "__defaults__", (500 if hot else align.EXPAND,))
    rows = [(i, t) for i, t in enumerate(texts()[:200] + odd()[:150])] + [(None, "the same"), (7, "the same"), (7, "the same"), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("pair", F.lit(None).cast("int")).repartition(5)
    got = align.align(df, A, B)
    assert got.columns == ["doc_id", "row", "pair", *COLUMNS[1:5], "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(key, got.select(*COLUMNS).collect())) == sorted(map(key, expected(library, rows)))


def test_query_against_plain_python(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(key, op13_align.op13_align(spark, SF).select(*COLUMNS).collect())) == sorted(map(key, expected(library, rows)))


def test_groups_as_a_column_and_edges(spark, library):
    rows = [(1, "Some wörds, 漢字"), (2, None), (3, ""), (4, "a▁b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(x.a, x.b) for x in r.groups] for r in align.token_groups(df, A, B).collect()}
    assert got == {i: groups(library, t) for i, t in rows}
    assert align.align(df.limit(0), A, B).count() == 0
    with pytest.raises(ValueError, match="n_best"):
        align.align(df.withColumn("n_best", F.lit(1)), A, B)
