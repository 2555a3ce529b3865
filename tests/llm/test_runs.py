"""Runs against brute force, and the query against plain Python over whole tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from silvae.llm import op12_runs, runs
from tests.helpers import SF


def brute(w, least=runs.LEAST):
    """All maximal stretches with a period, the smallest period of each, by trying every period."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= 2 * q:
                out.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in out.items() if b - a >= least)


def sequences(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        k = r.randint(1, 4)
        w = [r.randrange(k) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            part = [r.randrange(9) for _ in range(r.randint(1, 9))] * r.randint(2, 5)
            w += part[: r.randint(1, len(part))] + [r.randrange(30) for _ in range(r.randint(0, 6))]
        yield w


def test_runs_against_brute_force():
    rows = [*sequences(1, 800), [], [1] * 11, [1] * 12, [1] * 500, [1, 2] * 100 + [1], list(range(50)) * 2]
    rows.append([ord(c) for c in "abaab" * 20])
    first = np.concatenate([[0], np.cumsum([len(w) for w in rows])])
    got = runs.runs_of(np.array([x for w in rows for x in w], np.int64), first)
    for w, x in zip(rows, got, strict=True):
        assert [tuple(r) for r in x.tolist()] == brute(w), w


def test_every_run_of_any_length(monkeypatch):
    monkeypatch.setattr(runs, "LEAST", 2)
    rows = [w for w in sequences(2, 400) if w]
    first = np.concatenate([[0], np.cumsum([len(w) for w in rows])])
    a, b, p = runs.find_runs(np.array([x + 1 for w in rows for x in w], np.int64), first)
    of = np.searchsorted(first, a, side="right") - 1
    for k, w in enumerate(rows):
        got = sorted((int(s - first[k]), int(e - s), int(q)) for s, e, q, t in zip(a, b, p, of, strict=True) if t == k)
        assert got == brute(w, 2), w


@pytest.mark.parametrize("n", [1, 5, 16, 17, 100, 1000])
def test_minima_of_ranges(n):
    r = np.random.default_rng(n)
    x = r.integers(0, 1000, n)
    a, b = r.integers(0, n, 500), r.integers(0, n, 500)
    a, b = np.minimum(a, b), np.maximum(a, b) + 1
    assert runs.RangeMinimum(x).of(a, b).tolist() == [int(x[i:j].min()) for i, j in zip(a, b, strict=True)]


def expected(doc_id, text):
    raw = (text or "").encode()
    w = [x.decode() for x in raw.split()]
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    # brute force, over numbers and periods all at once
    x = np.array([hash(v) for v in w], np.int64)
    found = {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= q and b - a + q >= 12:
                found.setdefault((a, b + q), q)
    all_ = sorted((a, b - a, q) for (a, b), q in found.items())
    gone = {i for a, n, q in all_ for i in range(a + q, a + n)}
    best = min(all_, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(all_), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in all_).encode()).hexdigest(),
        hashlib.sha256(" ".join(v for i, v in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, op12_runs.op12_runs(spark, SF).collect()))
    assert got == sorted(expected(d.doc_id, d.text) for d in docs)


def test_nulls_repeats_and_clashes(spark):
    line = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, f"{line} {line} {line}"), (5, "x"), (5, "x"), (6, " ".join([line] * 400)), (7, "a b " * 30), (8, "A a " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, runs.run_digests(df).drop("text").collect())) == sorted(key(expected(*r)) for r in rows)
    assert runs.run_digests(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in runs.detect_runs(df.withColumn("start", F.lit(0))).where("doc_id is not null").collect()}
    assert got[6].collapsed == line and [tuple(x) for x in got[6].runs] == [(0, 2800, 7)]
    assert got[1].runs == [] and got[1].collapsed == "" and got[1].text is None
    with pytest.raises(ValueError, match="runs"):
        runs.detect_runs(df.withColumn("RUNS", F.lit(1)))
