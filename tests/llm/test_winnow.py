"""Decontamination against brute force."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silvae.llm import winnow


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench):
    out = {}
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, b in bench:
            v = words(b)
            size = min(13, len(v))
            for k in range(len(v) - size + 1 if size else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == v[k : k + size]:
                        hit |= set(range(p, p + size))
                        names |= {name} - {None}
        out[i] = (len(w), len(hit), tuple(sorted(map(str, names))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def corpus(seed=2):
    r = random.Random(seed)
    some = [f"w{i}" for i in range(40)] + ["é", "漢字", "x1"]
    text = lambda n: " ".join(r.choice(some) for _ in range(n))
    bench = [(str(i), text(r.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(25)] + [("n", None), ("e", ""), ("s", "..."), (None, text(20)), ("0", text(13)), ("d", text(40))]
    bench += [bench[3], ("twin", bench[4][1])]
    docs = []
    for i in range(120):
        parts = [text(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            b = (r.choice(bench)[1] or "").split(" ")
            a = r.randint(0, len(b) - 1)
            parts += [r.choice(["", "Mr. "]) + ", ".join(b[a : a + r.randint(1, 30)]).upper(), text(r.randint(0, 300))]
        docs.append((i, " ".join(parts)))
    return [*docs, (1000, None), (1001, ""), (1002, "!?")], bench


@pytest.mark.parametrize("limit", [winnow.BLOCK_BYTES, 400])
def test_against_brute_force(spark, limit):
    docs, bench = corpus()
    b = spark.createDataFrame(bench, "item_id string, text string").withColumn("hits", F.lit(1))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("x"))
    got = winnow.find_benchmark(d, b, limit=limit).select("doc_id", "hits.n_words", winnow.n_hit().alias("h"), "hits.items", winnow.contaminated().alias("c"), F.col("items").alias("own")).collect()
    assert {r.doc_id: (r.n_words, r.h, tuple(r["items"]), r.c) for r in got} == brute(docs, bench)
    assert {r.own for r in got} == {"x"}


def test_repeated_rows_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([("i", "b c"), ("j", "zz")], "item_id string, text string")
    for limit in (1 << 20, 1):
        got = sorted((r.doc_id or 0, len(r.hits["items"]), r.hits.n_words) for r in winnow.find_benchmark(d, b, limit=limit).collect())
        assert got == [(0, 1, 3), (1, 1, 3), (1, 1, 3), (2, 0, 0)]
    assert all(not r.hits.spans for r in winnow.find_benchmark(d, b.limit(0)).collect())
    assert winnow.find_benchmark(d.limit(0), b).count() == 0


def test_guarantee_of_every_shared_window():
    r = random.Random(9)
    item = [f"v{r.randrange(50)}" for _ in range(60)]
    known = winnow.Windows([("i", " ".join(item))])
    for k in range(len(item) - 12):
        text = " ".join(["q"] * 7 + item[k : k + 13] + ["q"] * 3)
        _, spans, names = known.scan(pa.array([text]))
        assert spans[0] == [(7, 20)] and names[0] == ["i"]
