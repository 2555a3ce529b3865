"""Exact search against numpy: whole, and by balls."""

import numpy as np
import pytest

from silvae.operators import semantic


def brute(rows, queries, k, key=None):
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
    x, q = unit(np.array([r[2] for r in rows], float)), unit(np.array([r[1] for r in queries], float))
    s = np.round(q @ x.T, 12)
    out = []
    for j, (name, _) in enumerate(queries):
        hits = sorted((-s[j, i], rows[i][1], rows[i][0]) for i in range(len(rows)) if s[j, i] >= semantic.LEAST)
        seen = {}
        for score_, node, file in hits:
            g = file if key else None
            seen[g] = seen.get(g, 0) + 1
            if seen[g] <= k:
                out.append((name, file, node, round(-score_, 6), seen[g]))
    return sorted(out)


def data(spark, n, dims, q, seed, copies=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    x = centres[r.integers(0, 12, n)] + 0.35 * r.normal(size=(n, dims))
    x[:copies] = x[0]
    rows = [(f"f{i % 7}", f"n{i:05d}", [float(v) for v in x[i]]) for i in range(n)]
    queries = [(f"q{j}", [float(v) for v in x[(j * 37) % n] + 0.05 * r.normal(size=dims)]) for j in range(q)]
    bad = [("f0", "zero", [0.0] * dims), ("f0", "short", [1.0]), ("f0", "none", None)]
    v = spark.createDataFrame(rows + bad, "file_path string, node_path string, vector array<double>").repartition(5)
    return rows, queries, v, spark.createDataFrame(queries, "query string, vector array<double>")


@pytest.mark.parametrize("key", [None, "file_path"])
def test_whole_against_numpy(spark, monkeypatch, key):
    monkeypatch.setattr(semantic, "ROWS", 40)
    monkeypatch.setattr(semantic, "SCORES", 500)
    rows, queries, v, asked = data(spark, 600, 8, 30, 1, copies=200)
    got = sorted((r.query, r.file_path, r.node_path, round(r.score, 6), r.place) for r in semantic.topk_all(v, asked, 5, key).collect())
    assert got == brute(rows, queries, 5, key)


def test_queries_in_blocks_and_of_other_lengths(spark, monkeypatch):
    rows, queries, v, asked = data(spark, 200, 8, 30, 2)
    monkeypatch.setattr(semantic, "QUERIES", 640)
    got = sorted((r.query, r.file_path, r.node_path, round(r.score, 6), r.place) for r in semantic.topk_all(v, asked, 3).collect())
    assert got == brute(rows, queries, 3)
    with pytest.raises(ValueError, match="one length"):
        semantic.topk_all(v, asked.unionByName(spark.createDataFrame([("x", [1.0])], asked.schema)))
    assert semantic.topk_all(v, asked.limit(0)).count() == 0 and semantic.topk_all(v.limit(0), asked).count() == 0


@pytest.mark.parametrize(("slice_", "chunk", "copies"), [(4096, 4096, 0), (50, 7, 300)])
def test_balls_against_numpy(spark, monkeypatch, tmp_path, slice_, chunk, copies):
    monkeypatch.setattr(semantic, "SLICE", slice_)
    monkeypatch.setattr(semantic, "CHUNK", chunk)
    rows, queries, v, asked = data(spark, 1500, 8, 40, 3, copies)
    index = semantic.BallIndex(v, f"file://{tmp_path}/index", 8, balls=30)
    found = index.search(asked, f"file://{tmp_path}/search", 5).collect()
    assert sorted((r.query, r.file_path, r.node_path, round(r.score, 6), r.place) for r in found) == brute(rows, queries, 5)
    share = sum({r.query: r.compared for r in found}.values()) / (len(rows) * len(queries))
    assert 0 < share < 0.6, share
    assert index.search(asked.limit(0), f"file://{tmp_path}/none", 5).count() == 0
    empty = semantic.BallIndex(v.limit(0), f"file://{tmp_path}/empty", 8)
    assert empty.search(asked, f"file://{tmp_path}/nothing", 5).count() == 0


def test_many_similar_vectors_need_little_memory(spark):
    """20,000 vectors and 1,000 queries that are all similar: no list of all pairs."""
    import tracemalloc

    r = np.random.default_rng(4)
    x = 1 + 0.1 * r.normal(size=(20_000, 32))
    import pyarrow as pa

    best = semantic._Best(10, "node_path", None)
    asked = semantic._matrix(pa.array(x[:1000].tolist()), 32).T
    names = pa.array([f"n{i:05d}" for i in range(len(x))])
    tracemalloc.start()
    for at in range(0, len(x), 1048):
        piece = pa.RecordBatch.from_arrays([names[at : at + 1048]], ["node_path"])
        best.add(piece, semantic._matrix(pa.array(x[at : at + 1048].tolist()), 32) @ asked)
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    _, query, _, _ = best.settle()
    assert len(query) == 10_000
