"""Steps that must not grow faster than their input: how often files are parsed, where rows of one name go, and what a task holds."""

import tracemalloc

from pyspark.sql import functions as F

from silvae.functions import script
from silvae.operators import code, compare, holding, tree
from silvae.plans.queries import QUERIES
from silvae.sources import files, treestore
from tests.helpers import SF


def planned(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_languages_are_one_run(spark, monkeypatch):
    asked, nodes = [], treestore.TreeStore.nodes
    monkeypatch.setattr(treestore.TreeStore, "nodes", lambda self, f: asked.append(1) or nodes(self, f))
    for name in ("language_nodes", "graph_points"):
        asked.clear()
        QUERIES[name](spark, SF)
        assert len(asked) == 1


def test_positions_parse_once(spark):
    assert planned(QUERIES["insert_positions"](spark, SF), "MapInArrow") == 1


def test_refactorings_look_once(spark):
    df = QUERIES["refactor_reports"](spark, SF)
    assert planned(df, "Relation [") == 1


def test_calls_of_one_name_are_spread(spark):
    calls = spark.range(4000).select(F.concat(F.lit("f"), "id").alias("from_file"), F.lit("0").alias("from_path"), F.when(F.col("id") % 100 > 0, "noop").otherwise(F.concat(F.lit("g"), "id")).alias("to_name"))
    defs = spark.createDataFrame([("b", "noop"), ("a", "noop"), ("c", "g100")], "file_path string, name string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = code.resolve(calls, defs)
        most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        rows = {(r.to_name, r.to_file, r.n) for r in got.groupBy("to_name", "to_file").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert most < 2000
    assert rows == {("noop", "a", 3960), ("g100", "c", 1)} | {(f"g{k}", None, 1) for k in range(0, 4000, 100) if k != 100}


def test_touched_files_are_spread_and_once(spark):
    relations = spark.range(300).select(F.concat(F.lit("c"), "id").alias("from_file"), F.lit("0").alias("from_path"), F.lit("x").alias("to_file"), F.explode(F.array(F.lit("m"), F.lit("n"))).alias("to_name"), F.lit("Call").alias("relation_type"))
    edited = spark.createDataFrame([("c0", "m"), ("c0", "n"), ("d", "m"), ("d", "m"), ("c1", "none")], "file_path string, name string")
    none = spark.createDataFrame([], "file_path string")
    rows = [(r.file_path, r.kind, r.detail) for r in code.pulse_all(relations, none, edited).collect()]
    assert sorted(rows) == sorted([("c0", "caller", f"c{k}") for k in range(1, 300)] + [("d", "caller", f"c{k}") for k in range(300)])


def test_automata_of_a_task_are_small():
    tracemalloc.start()
    made = holding.Automaton([str(k) for k in range(1_000_000, 1_020_000)])
    each = tracemalloc.get_traced_memory()[0] / len(made.step)
    tracemalloc.stop()
    # a byte makes a state at most; four tasks of an executor hold 4000 MB
    assert each * (holding.BLOCK + holding.TARGETS) < 1000e6


def test_one_change_needs_no_arrays(monkeypatch):
    def fail(a, b):
        raise AssertionError

    monkeypatch.setattr(script, "matches", fail)
    assert script.script(["one", "two", "three"], ["one", "N"]) == [("Equal", 0, 1, 0, 1), ("Delete", 1, 3, 1, 1), ("Insert", 3, 3, 1, 2)]
    assert script.script(["a"], ["a"]) == [("Equal", 0, 1, 0, 1)]
    assert script.script([], ["x"]) == [("Insert", 0, 0, 0, 1)]


def test_places_are_those_of_the_joins(spark):
    text = "use a;\nfn one() {\n    let x = 1;\n    two();\n}\nstruct S { v: i32 }\n\nfn two() {\n    if a {\n        b();\n    }\n}\n"
    n = files.nodes(spark.createDataFrame([("a.rs", text), ("b.txt", text), ("c.py", "def f():\n    return 1\n")], "file_path string, content string")).cache()
    targets = spark.createDataFrame([(f, k, k, i, None) for f in ("a.rs", "b.txt", "c.py", "none.rs") for k in range(-1, 16) for i in (True, False)], "file_path string, no int, line int, inserts boolean, content string")
    at = n.select("file_path", "seq", "path")
    edits = tree.editable_at(n, targets.select("file_path", "line")).join(at, ["file_path", "seq"])
    puts = tree.insert_position(n, tree.insertion_parent(n, targets.select("file_path", "line").distinct())).join(at, ["file_path", "seq"])
    want = {(r.file_path, r.line, False, r.path, None) for r in edits.collect()} | {(r.file_path, r.line, True, r.path, r.position) for r in puts.collect()}
    assert {(r.file_path, r.no, r.inserts, r.path, r.position) for r in tree.places(n, targets).collect()} == want and len(want) == 3 * 17 * 2
    # batches of few rows: what is known of a file goes on from one to the next
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {(r.file_path, r.no, r.inserts, r.path, r.position) for r in tree.places(n, targets).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_diffs_and_nodes_meet_in_one_sweep(spark):
    df = QUERIES["diff_to_batch"](spark, SF)
    assert planned(df, "MapIn") == 2 and planned(df, "Join") == 0


def test_edits_are_applied_once(spark):
    df = QUERIES["guarded_edit"](spark, SF)
    # applied, parsed, healed and parsed again; texts are joined with their operations alone
    assert planned(df, "MapInArrow") == 3 and planned(df, "Join") == 1


def test_trees_are_scanned_in_rounds(spark, monkeypatch):
    from silvae.plans import queries as Q
    from silvae.sources import stores
    from tests.helpers import rows_of, rows_of_sql

    written, write = [], stores.write_sources
    monkeypatch.setattr(stores, "write_sources", lambda files, scratch: written.append(write(files, scratch)))
    monkeypatch.setattr(Q, "_TREES", 100)
    got = rows_of(QUERIES["scan_rules"](spark, SF))
    # never all 200 parts' files are there at once, and all of them are written and scanned
    assert got == rows_of_sql(Q.ORACLE["scan_rules"]) and sum(written) == 1200 and max(written) < 900


def test_states_are_compared_without_their_nodes(spark):
    # what only one of two states tells comes from one aggregation of both, without a join of either with the other
    assert planned(QUERIES["structural_diff"](spark, SF), "LeftAnti") == 0
    n = files.nodes(spark.createDataFrame([("a.rs", "struct S { v: i32 }\nfn f() {}\n"), ("b.rs", "fn g() {}\n")], "file_path string, content string"))
    m = files.nodes(spark.createDataFrame([("a.rs", "fn f() {}\n"), ("c.rs", "fn g() {}\n")], "file_path string, content string"))
    many = [f"none_{k}" for k in range(70)] + ["struct_item"]
    for types in (["struct_item", "function_item"], many):
        got = {tuple(r) for r in compare.structural(n, m, types).collect()}
        assert {x for x in got if not x[1].endswith("_changed")} == {("a.rs", "removed", "struct_item S"), ("a.rs", "lost", "struct_item")}
