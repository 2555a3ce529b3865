"""Shortest scripts against dynamic programming, and long texts."""

import random
import time
import tracemalloc

import pytest

from silvae.functions.script import script
from silvae.operators.edit import line_diff


def edits(a, b):
    """The fewest deletions and insertions."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    return row[-1]


def test_shortest_against_dynamic_programming():
    r = random.Random(1)
    for _ in range(1500):
        k = r.randint(1, 6)
        a, b = ([r.randrange(k) for _ in range(r.randint(0, 24))] for _ in range(2))
        if r.random() < 0.4:
            b = a[:]
            for _ in range(r.randint(0, 5)):
                at = r.randint(0, len(b))
                b[at : at + r.randint(0, 2)] = [r.randrange(9) for _ in range(r.randint(0, 2))]
        got = script(a, b)
        assert [x for t, i, j, _, _ in got if t != "Insert" for x in a[i:j]] == a and [x for t, _, _, k_, m in got if t != "Delete" for x in b[k_:m]] == b
        assert all(a[i:j] == b[k_:m] for t, i, j, k_, m in got if t == "Equal")
        assert sum(j - i + m - k_ for t, i, j, k_, m in got if t != "Equal") == edits(a, b), (a, b)
        assert all(x[0] != y[0] for x, y in zip(got, got[1:], strict=False))


def test_order_of_a_change():
    assert line_diff("a\nb\nc\n", "a\nx\ny\nc\n") == [("Equal", "a"), ("Delete", "b"), ("Insert", "x"), ("Insert", "y"), ("Equal", "c")]
    assert line_diff("", "") == [] and line_diff("", "a") == [("Insert", "a")] and line_diff("a", "") == [("Delete", "a")]


@pytest.mark.parametrize("kind", ["few", "moved", "all", "repeats"])
def test_hundred_thousand_lines(kind):
    r = random.Random(2)
    n = 100_000
    a = [f"line {i}" for i in range(n)] if kind != "repeats" else [f"line {r.randrange(50)}" for _ in range(n)]
    b = a[:]
    if kind == "moved":
        b = a[70_000:] + a[:70_000]
        a, b = a[:20_000] + a[70_000:75_000], b[:5000] + b[30_000:50_000]
    elif kind == "all":
        b = [f"other {i}" for i in range(n)]
    else:
        for _ in range(300):
            b[r.randrange(n)] = f"new {r.random()}"
    tracemalloc.start()
    began = time.time()
    got = script(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and time.time() - began < 120
    changed = sum(j - i + m - k for t, i, j, k, m in got if t != "Equal")
    assert changed == {"few": 2 * len({x for x in b if x.startswith("new")}), "all": 2 * n, "moved": 10_000}.get(kind, changed) and changed <= 2 * n
