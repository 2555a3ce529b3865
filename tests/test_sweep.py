"""Sweeps over random trees against plain recursion, and over one very large file."""

import random
import re

import pytest
from pyspark.sql import functions as F

from silvae.operators import code, holding, sweep, tree
from silvae.sources import files as source
from silvae.sources import trees as trees_
from silvae.sources import treestore

KINDS = ["function_item", "block", "identifier", "call", "impl_item"]
SCHEMA = "file_path string, seq int, seq_end int, parent_seq int, depth int, start_line int, end_line int, node_type string, n_children int, path string"


def random_tree(r, file, size):
    rows = []

    def grow(parent, depth, lo, hi, path):
        nonlocal left
        seq = len(rows)
        rows.append(None)
        kids, at = 0, lo
        while left > 0 and r.random() < 0.75 and depth < 9:
            left -= 1
            start = min(hi, max(lo, at + r.choice([-1, 0, 0, 1])))
            end = min(hi, start + r.randint(0, max(0, (hi - start) // 2)))
            grow(seq, depth + 1, start, end, f"{path}.{kids}" if path else str(kids))
            kids, at = kids + 1, end
        rows[seq] = (file, seq, len(rows) - 1, parent, depth, lo, hi, r.choice(KINDS), kids, path)

    left = size
    grow(None, 0, 1, 40, "")
    return rows


def trees(seed=1):
    r = random.Random(seed)
    return {f"f{i}": random_tree(r, f"f{i}", r.choice([0, 3, 30, 120])) for i in range(12)}


def above(rows, n):
    return [m for m in rows if m[1] < n[1] <= m[2]]


def first_down(rows, line):
    n, kids = rows[0], {}
    if not n[5] <= line <= n[6]:
        return None
    for m in rows:
        kids.setdefault(m[3], []).append(m)
    while c := next((m for m in kids.get(n[1], []) if m[5] <= line <= m[6]), None):
        n = c
    return n[1]


def last_down(rows, line):
    kids = {}
    for m in rows:
        kids.setdefault(m[3], []).append(m)

    def answer(n):
        found = n[1]
        for c in kids.get(n[1], []):
            if c[5] <= line <= c[6]:
                edge = any(s in c[7] for s in ("function", "block", "impl")) and (line <= c[5] + 1 or line >= c[6] - 1)
                found = n[1] if edge else answer(c)
        return found

    return answer(rows[0])


@pytest.mark.parametrize(("part", "lines"), [(sweep.PART, sweep.LINES), (1, 1), (3, 7), (10, 2)])
def test_against_recursion(spark, monkeypatch, part, lines):
    """Files whole, and cut anywhere."""
    monkeypatch.setattr(sweep, "PART", part)
    monkeypatch.setattr(sweep, "LINES", lines)
    all_ = trees()
    nodes = spark.createDataFrame([n for rows in all_.values() for n in rows], SCHEMA).repartition(5)
    got = {(x.file_path, x.seq): x.outer_seq for x in sweep.enclosing(nodes, F.col("node_type") == "call", F.col("node_type") == "block").collect()}
    assert got == {(f, n[1]): max((m[1] for m in above(rows, n) if m[7] == "block"), default=None) for f, rows in all_.items() for n in rows if n[7] == "call"}
    chain = {(x.file_path, x.seq): x.chain for x in sweep.chains(nodes).collect()}
    plain = {(f, n[1]): tuple(m[7] for m in above(rows, n) if m[3] is not None) for f, rows in all_.items() for n in rows}
    assert len(set(chain.values())) == len(set(plain.values())) == len({(chain[k], plain[k]) for k in plain})
    for strict in (False, True):
        seen = {(x.file_path, x.seq) for x in sweep.covered(nodes, F.col("node_type") == "block", strict, "c").where("c").collect()}
        assert seen == {(f, n[1]) for f, rows in all_.items() for n in rows if any(m[7] == "block" for m in above(rows, n)) or (not strict and n[7] == "block")}
    targets = [(f, line) for f in all_ for line in range(0, 43)]
    asked = spark.createDataFrame([*targets, targets[0], ("none", 1)], "file_path string, line int").repartition(3)
    down = {(x.file_path, x.line): x.seq for x in tree.at_lines(nodes, asked).collect()}
    assert down == {(f, line): s for f, line in targets if (s := first_down(all_[f], line)) is not None}
    place = {(x.file_path, x.line): x.seq for x in tree.insertion_parent(nodes, asked).collect()}
    assert place == {(f, line): last_down(all_[f], line) for f, line in targets}
    tops = [(f, n[1]) for f, rows in all_.items() for n in rows if n[1] % 7 == 2]
    below = {(x.file_path, x.seq) for x in tree.subtree(nodes, spark.createDataFrame(tops, "file_path string, seq int")).collect()}
    assert below == {(f, n[1]) for f, rows in all_.items() for n in rows if any((f, m[1]) in set(tops) for m in [*above(rows, n), n])}
    edit = {(x.file_path, x.target): x.ancestor for x in tree.editable_ancestor(nodes, nodes.select("file_path", "seq")).collect()}
    good = lambda n: any(s in n[7] for s in ("function", "block", "impl")) and n[8] > 0
    assert edit == {(f, n[1]): max((m[1] for m in above(rows, n) if good(m)), default=None) for f, rows in all_.items() for n in rows}


def test_one_very_large_file(spark, monkeypatch):
    """A file of 10^6 nodes in nests of four: linear, in many tasks, none of which holds more than a part's share."""
    n = F.col("id").cast("int")
    within = n % 4
    nodes = spark.range(1_000_000).select(F.lit("big").alias("file_path"), n.alias("seq"), F.when(n == 0, 999_999).otherwise(n - within + 3).alias("seq_end"), F.when(n == 0, None).when(within == 0, 0).otherwise(n - 1).alias("parent_seq"), F.when(within == 3, "call").otherwise("block").alias("node_type"), F.when(n == 0, 1).otherwise(F.floor(n / 4).cast("int") + 1).alias("start_line"), F.when(n == 0, 250_000).otherwise(F.floor(n / 4).cast("int") + 1).alias("end_line"))
    for part in (sweep.PART, 10_000):
        monkeypatch.setattr(sweep, "PART", part)
        found = sweep.enclosing(nodes, F.col("node_type") == "call", F.col("node_type") == "block")
        got = found.withColumn("task", F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.col("seq") - F.col("outer_seq")).alias("d"), F.count_distinct("task").alias("tasks")).first()
        assert (got.n, got.d) == (250_000, 250_000)
        assert got.tasks >= (8 if part == 10_000 else 3)
    lines = spark.range(1, 250_001).select(F.lit("big").alias("file_path"), F.col("id").alias("line"))
    for size in (sweep.LINES, 5000):
        monkeypatch.setattr(sweep, "LINES", size)
        assert sweep.first_down(nodes, lines).agg(F.count("*").alias("n"), F.max("seq").alias("m")).first() == (250_000, 999_999)


def _words(seed, count):
    r = random.Random(seed)
    return sorted({"".join(r.choice("abAB_") for _ in range(r.randint(0, 9))) for _ in range(count)})


def test_automaton_against_all_pairs():
    names, targets = _words(3, 200), _words(4, 200)
    fits = lambda n, t: n.lower() in t.lower() or t.lower() in n.lower()
    got = holding.first_match(names, targets)
    assert got == [min((k for k, t in enumerate(targets) if fits(n, t)), default=holding._NONE) for n in names]
    assert holding.first_match(["x"], []) == [holding._NONE] and holding.first_match([], ["x"]) == []


@pytest.mark.parametrize(("block", "bunch"), [(holding.BLOCK, holding.TARGETS), (50, 20)])
def test_fuzzy_match_against_all_pairs(spark, monkeypatch, block, bunch):
    monkeypatch.setattr(holding, "TARGETS", bunch)
    names, targets = _words(5, 60), _words(6, 60)
    table = lambda rows, c: spark.createDataFrame([(x,) for x in [*rows, rows[0], None]], f"{c} string").repartition(3)
    best = {x.name: x.target for x in holding.fuzzy_match(table(names, "name"), table(targets, "target"), block).collect()}
    hit = {n: [t for t in targets if n.lower() in t.lower() or t.lower() in n.lower()] for n in names}
    assert best == {n: n if n in targets else min(h) for n, h in hit.items() if h}


def test_many_names_and_targets(spark):
    """10^5 names of which a third hold the same short piece, against 10^5 targets: no stage of all pairs."""
    names = spark.range(100_000).select(F.concat(F.when(F.col("id") % 3 == 0, "f").otherwise("get_"), F.col("id").cast("string")).alias("name"))
    targets = spark.range(100_000).select(F.concat(F.lit("goal_"), (F.col("id") * 7).cast("string")).alias("target"))
    got = holding.fuzzy_match(names, targets.unionByName(spark.createDataFrame([("f",)], "target string")))
    assert got.where("target = 'f'").count() == 33_334
    assert got.count() == 33_334


def test_beginnings_of_paths(spark):
    r = random.Random(7)
    paths = sorted({(f"f{r.randrange(3)}", ".".join(str(r.randrange(12)) for _ in range(r.randint(0, 4))), r.random() < 0.5) for _ in range(200)})
    got = sorted((x.file_path, x.path, x.start) for x in sweep.beginnings(spark.createDataFrame([*paths, paths[0]], "file_path string, path string, opens boolean").repartition(4)).collect())
    assert got == sorted({(f, p, q) for f, p, o in paths if not o for g, q, o2 in paths if o2 and f == g and p.startswith(q)})


def _graph_rows(rows):
    """Points and edges of one file by the rule, one node after the other."""
    points, edges, by_path = [], [], {n[8]: n for n in rows}
    for n in sorted(rows, key=lambda x: x[2]):
        kind, name, content = n[9].lower(), n[15], (n[10] or "").strip()
        if ("function" in kind or "method" in kind or kind in ("struct_item", "impl_item")) and name is not None:
            points.append((n[2], f"{n[8]}:{name}", n[8], name, n[9]))
        if kind == "call_expression":
            parts = n[8].split(".")
            caller = next((p for k in range(len(parts) - 1, -1, -1) for p in points if p[2] == ".".join(parts[:k]) and "function" in p[4]), None)
            child = next((c[10].strip() for c in sorted(rows, key=lambda x: x[2]) if c[4] == n[2] and c[9] in ("identifier", "field_expression")), None)
            if caller and child is not None:
                low = child.lower()
                to = next((p for p in points if p[3] == child and "function" in p[4]), None) or next((p for p in points if low in p[3].lower() or p[3].lower() in low), None)
                if to:
                    edges.append((n[2], caller[1], to[1]))
        if kind == "use_declaration" and content not in ("", "::"):
            points.append((n[2], "use:" + content.replace("::", "_").replace(" ", "_"), n[8], content, n[9]))
    assert by_path
    return points, edges


CODE = {
    "a.rs": "use core::fmt as f;\nstruct S { v: i32 }\nimpl S {\n fn new() { make(); helper(); }\n fn make() { new(); Self::new(); ne(); }\n}\nfn helper() { S(); renew(); unknown(); helper(); }\n",
    "b.py": "import x\nclass C:\n    def m(self):\n        f()\n\ndef f():\n    return C().m()\n",
    "c.js": "import y from 'y';\nfunction f(x) { g(x); }\nclass K { m() { f(1); } }\nfunction gf() { f(2); F(3); h(); }\n",
    "d.sh": "run() {\n  step a\n}\nrun\n",
    "e.go": "func A() { B() }\nfunc B() { A(); fmtA() }\n",
}


def test_graph_by_the_rule(spark):
    files = spark.createDataFrame(list(CODE.items()), "file_path string, content string")
    points, edges = code.call_graph(treestore.nodes(files))
    for f, text in CODE.items():
        want_points, want_edges = _graph_rows(trees_.parse(f, text))
        assert sorted((p.seq, p.id, p.path, p.name, p.node_type) for p in points.where(F.col("file_path") == f).collect()) == want_points, f
        assert sorted((e.seq, e.from_id, e.to_id) for e in edges.where(F.col("file_path") == f).collect()) == want_edges, f
    assert {p.id for p in points.where("file_path = 'b.py'").collect()} and {e.from_name for e in edges.where("file_path = 'a.rs'").collect()} == {"make", "helper"}
    held = {(m.struct_id, m.method_id) for m in code.methods_of(points.where("file_path = 'a.rs'")).collect()}
    assert held == {("2:S", "2.1.0:new"), ("2:S", "2.1.1:make")}


def test_edges_of_a_file_are_one_sweep(spark):
    """Calls find their functions in one pass over a file, without a join, and as the joins of long files find them."""
    import random

    rnd = random.Random(5)
    name = lambda: "".join(rnd.choice("abAB_") for _ in range(rnd.randint(1, 3)))
    body = lambda d: " ".join(f"fn {name()}() {{ {body(d - 1)} }}" if d and rnd.random() < 0.3 else f"{rnd.choice(['', 'x.', '{ fn q() {} }; '])}{name()}({name()}({name()}));" for _ in range(4))
    odd = {f"r{k}.rs": f"use a::b;\nstruct {name()} {{ v: u8 }}\n{body(2)}\nfn {name()}() {{ {body(2)} }}\n" for k in range(40)}
    files = spark.createDataFrame([*CODE.items(), *odd.items()], "file_path string, content string")
    nodes = treestore.nodes(files)
    swept, joined, mixed = (code.call_graph(nodes, size)[1] for size in (None, 1, 60))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert "Join" not in swept._jdf.queryExecution().executedPlan().toString()
    assert rows(swept) == rows(joined) == rows(mixed) and swept.count() > 100


def test_callers_are_one_sweep(spark):
    """What is told of a caller and of the function it is in goes through the sweep: no join, as the project's functions would go through it."""
    files = spark.createDataFrame([*CODE.items()], "file_path string, content string")
    found = code.callers(treestore.nodes(files), "F")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.file_path, r.start_line, r.in_function or "", r.kind) for r in found.collect())
    want = sorted((n.file_path, n.start_line, n.path, n.seq) for n in treestore.nodes(files).where("node_type = 'call_expression' and lower(name) = 'f'").collect())
    assert {(f, line) for f, line, _, _ in want} <= {(f, line) for f, line, _, _ in got}
    assert ("c.js", 3, "m", "call") in got and ("c.js", 4, "gf", "call") in got and ("c.js", 4, "gf", "reference") in got and not any(k == "reference" and f.lower() == "f" for _, _, f, k in got)


# the store ---------------------------------------------------------------------------------------


def test_each_content_is_parsed_once(spark, tmp_path):
    files = spark.createDataFrame([*CODE.items(), ("copy.rs", CODE["a.rs"]), ("again/a.rs", CODE["a.rs"]), ("a.txt", CODE["a.rs"]), ("none", None), ("bad.py", "def")], "file_path string, content string").repartition(3)
    store = treestore.TreeStore(spark, f"file://{tmp_path}/trees")
    assert store.add(files) == 8 and store.add(files) == 0 and len(store.runs()) == 1
    more = files.unionByName(spark.createDataFrame([("new.rs", "fn a() {}"), ("new2.rs", "fn a() {}")], files.schema))
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(store.nodes(more).collect()) == key(source.nodes(more).collect())
    assert len(store.runs()) == 2 and store.add(more) == 0
    # a run that was not done is not read
    (tmp_path / "trees" / "0-lost").mkdir()
    assert len(store.runs()) == 2
    assert "MapInArrow" not in store.nodes(files)._jdf.queryExecution().executedPlan().toString()
    assert store.nodes(files.limit(0)).count() == 0


def test_plans_hold_no_parse(spark):
    from silvae.plans import queries as Q
    from tests.helpers import SF

    for name in ("call_graph", "graph_summary", "structural_diff", "uncalled"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        # what is left are sweeps; a parse would give all columns of nodes
        assert not re.search(r"MapInArrow[^\n]*start_col", plan), name


def test_contents_of_one_file_each_are_read_without_a_join(spark, tmp_path):
    joins = lambda df: "Join" in df._jdf.queryExecution().executedPlan().toString()
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    files = spark.createDataFrame([*CODE.items()], "file_path string, content string")
    store = treestore.TreeStore(spark, f"file://{tmp_path}/trees")
    first = store.nodes(files)
    assert not joins(first) and key(first.collect()) == key(source.nodes(files).collect())
    # the same files again, and these with another that has an old content
    again = store.nodes(files)
    assert not joins(again) and key(again.collect()) == key(source.nodes(files).collect())
    more = files.unionByName(spark.createDataFrame([("copy.rs", CODE["a.rs"]), ("copy.rs", CODE["a.rs"]), ("new.rs", "fn a() {}")], files.schema))
    assert key(store.nodes(more).collect()) == key(source.nodes(more).collect())


def test_large_sides_are_not_broadcast(spark):
    from silvae.plans import queries as Q
    from tests.helpers import SF

    for name in ("diff_to_batch", "graph_edges", "language_nodes", "graph_points", "graph_summary"):
        assert "BroadcastHashJoin" not in Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString(), name


def test_few_names_are_looked_for_as_many_are(monkeypatch):
    from silvae.operators import holding

    names, targets = ["a", "", "bcd", "Noop", "zz"], ["xA", "noop_1", "bc", "", "q"]
    few = holding.first_match(names, targets)
    monkeypatch.setattr(holding, "_FEW", -1)
    assert few == holding.first_match(names, targets) and holding.first_match(names, []) == [holding._NONE] * 5
