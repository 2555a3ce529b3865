"""Near duplicates against brute force, kernels against plain Python, and the edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from silvae.llm import graph, minhash, registry
from silvae.llm import words as W
from silvae.llm.graph import components
from tests.helpers import SF, rows_of, rows_of_sql


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def brute(docs):
    """{id: (n, component)} by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    docs = []
    for i in range(150):
        w = [word() for _ in range(r.choice([0, 1, 3, 4, 5, 6, 40, 200]))]
        docs.append((len(docs), " ".join(w)))
        if i % 3 == 0 and w:
            for _ in range(r.randint(1, 4)):
                v = list(w)
                for _ in range(r.randint(0, max(1, len(v) // 30))):
                    v[r.randrange(len(v))] = word()
                docs.append((len(docs), r.choice([" ", "\n"]).join(v).upper() if r.random() < 0.2 else " ".join(v)))
        if i % 5 == 0:
            docs.append((len(docs), passage + " " + " ".join(word() for _ in range(r.randint(1, 80)))))
    return [*docs, (len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, " \t\n")]


def test_words_are_those_of_the_pattern():
    texts = ["", None, " a\tB\x0bc ", "é Ü\x1cx  y", "x" * 10, "\n"]
    data, offsets = W.buffers(pa.array(texts))
    s, e, h, first = W.words(data, offsets, W.NOT_SPACE)
    got = [[bytes(W.LOWER[data[s[i] : e[i]]]).decode() for i in range(first[k], first[k + 1])] for k in range(len(texts))]
    assert got == [[], [], ["a", "b", "c"], ["é", "Ü\x1cx", "y"], ["x" * 10], []]
    assert len(set(h.tolist())) == 7


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(3000)) + " " + "z" * 5000 + " end"
    whole = W.shingle_sets(pa.array([text, "a b", text]))
    monkeypatch.setattr(W, "BLOCK", 256)
    for a, b in zip(whole, W.shingle_sets(pa.array([text, "a b", text])), strict=True):
        assert np.array_equal(a, b)


def test_against_brute_force(spark):
    docs = corpus()
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(docs) - 40


def test_large_group_of_near_copies(spark):
    r = random.Random(1)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    docs = []
    for i in range(600):
        v = list(base)
        v[r.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(v)))
    docs += [(1000 + i, " ".join(base)) for i in range(400)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(16))
    assert {r.component_id for r in got.select("component_id").distinct().collect()} == {0}
    assert got.where("kept").count() == 1


def test_edges_of_the_table(spark):
    schema = "doc_id long, text string, n_shingles string, component_id string, d1 int"
    rows = [(1, "a b c d e f", "x", "y", 1), (1, "a b c d e f", "x", "y", 1), (None, "a b c d e f", None, None, None), (2, "A B C D E F", None, None, None), (3, None, None, None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("most", [500, 20_000])
@pytest.mark.parametrize("shape", ["chain", "star", "mixed"])
def test_components(spark, monkeypatch, shape, most):
    monkeypatch.setattr(graph, "FOREST", most)
    r = random.Random(5)
    n = 3000
    edges = {"chain": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "mixed": [(r.randrange(n), r.randrange(n)) for _ in range(1400)]}[shape]
    r.shuffle(edges)
    up = {i: i for e in edges for i in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (5, 5), (None, 1)], "a long, b long").repartition(7)).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    assert rows_of(registry.queries()[name](spark, SF)) == rows_of_sql(registry.oracle_sql()[name])


@pytest.mark.parametrize("size", [400, 1500])
def test_planted_pairs_in_a_template_family(spark, size):
    """Members of one template are at 0.71 to each other, pairs planted among them at 0.75 to 0.77: each is found, and nothing else."""
    template = [f"t{i}" for i in range(150)]
    docs, want = [], {}
    for i in range(size):
        own = [f"u{i}-{k}" for k in range(30)]
        docs.append((2 * i, " ".join(template + own)))
        want[2 * i] = 2 * i
        if i % 5 == 0:
            edit = 25 - i // 5 % 3
            docs.append((2 * i + 1, " ".join([*template, *own[:-edit], *(f"v{i}-{k}" for k in range(edit))])))
            want[2 * i + 1] = 2 * i
    sets = [shingles(t) for _, t in docs[:3]]
    assert 100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1]) and 100 * len(sets[0] & sets[2]) < 75 * len(sets[0] | sets[2])
    random.Random(size).shuffle(docs)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8))
    assert {x.doc_id: x.component_id for x in got.collect()} == want


def test_borders_of_short_and_empty_partitions(spark):
    """A few rows in very many partitions, which nothing puts together again."""
    docs = corpus(9)
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "60"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = minhash.near_duplicates(spark.createDataFrame(docs[:90], "doc_id long, text string"))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(docs[:90])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_what_a_border_looks_at():
    assert minhash.before({3: 5, 4: 1, 9: 40}, 6) == [(4, 1, 4), (3, 0, 4), (9, 1, 9), (4, 0, 9), (3, 0, 9)]
    assert minhash.before({}, 6) == [] and minhash.before({7: 1}, 6) == []


def test_rarest_shingles_are_shared(monkeypatch):
    """Sets of a similarity of 3/4 have one of their rarest shingles in common, whatever the tables of frequencies hold."""
    r = np.random.default_rng(4)
    for bits in (4, 12):
        monkeypatch.setattr(minhash, "RARE_BITS", bits)
        level = r.integers(0, 256, 2 << bits).astype(np.uint8)
        for n in (1, 2, 3, 7, 8, 100):
            base = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            for gone in range(n // 4 + 1):
                assert np.intersect1d(minhash.rarest(base, level), minhash.rarest(np.sort(base[gone:]), level)).size or 4 * (n - gone) < 3 * n


def test_one_id_with_different_texts(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f"), (3, "g h i j k l m n o p"), (4, "g h i j k l m n o p q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = sorted(map(tuple, minhash.near_duplicates(df).collect()))
    assert first == sorted(map(tuple, minhash.near_duplicates(df.repartition(5)).collect())) and len(first) == 5
    assert {r[2] for r in first if r[0] in (3, 4)} == {3}
