import json

from pyspark.sql import functions as F

from silvae.functions import scores, text
from silvae.operators import compare, edit, find, output, patch, semantic, side, temporal, tree
from silvae.sources import files, stores
from silvae.sources.files import nodes, text_nodes

RS = "fn add(a: i32, b: i32) -> i32 {\n    a + b\n}\n\nfn main() {\n    let x = 1;\n}\n"


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return df.select(col.alias("x")).first().x


def tree_of(spark, path, content):
    return nodes(spark.createDataFrame([(path, content)], "file_path string, content string"))


def test_scan_rules(spark, tmp_path):
    for p in ("a.py", "b.RS", ".git/c.py", "sub/d.py", "node_modules/e.py", "f.md", "sub/.x/g.py", "__init__.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    name = lambda rule: sorted(r.file_path.removeprefix(f"{tmp_path}/") for r in files.scan(spark, str(tmp_path), rule).collect())
    assert name(files.FIND) == ["__init__.py", "a.py", "b.RS", "sub/d.py"]
    assert name(files.Rule(("py",), recursive=False)) == ["__init__.py", "a.py"]
    assert name(files.BLAST) == ["__init__.py", "a.py", "b.RS", "sub/.x/g.py", "sub/d.py"] and "f.md" in name(files.LINT)
    assert files.scan(spark, [str(tmp_path / "f.md")], files.FIND).count() == 1


def test_log_and_stores(spark, tmp_path):
    row = {"id": "t1", "timestamp": "2024-01-01T00:00:00Z", "operation": "Edit", "file_path": "test.py", "node_path": "0.1", "before_hash": "h1", "after_hash": "h2", "description": "Test edit", "session_id": "s", "metadata": {}}
    (tmp_path / "log.jsonl").write_text(json.dumps(row) + "\n\n")
    log = stores.read_log(spark, str(tmp_path / "log.jsonl"))
    assert log.count() == 1 and log.first().after_hash == "h2"
    stores.append_log(log, str(tmp_path / "log2"))
    stores.append_log(log, str(tmp_path / "log2"))
    assert stores.read_log(spark, str(tmp_path / "log2")).count() == 2
    (tmp_path / "b").mkdir()
    (tmp_path / "b/1.json").write_text(json.dumps({"file_path": "a.txt", "timestamp": "2024-01-01T00:00:00Z", "tree": {}, "source_code": "hello world"}))
    (tmp_path / "b/2.json").write_text("{broken")
    b = stores.read_backups(spark, str(tmp_path / "b"))
    assert [(r.original_file_path, r.source_code) for r in b.collect()] == [("a.txt", "hello world")]
    labels = stores.read_labels(spark.createDataFrame([('{"f": {"h": {"labels": ["x"], "metadata": {}, "last_updated": "t"}}}',), ("no json",)], "value string"))
    assert [(r.file_path, r.content_hash, r.labels) for r in labels.collect()] == [("f", "h", ["x"])]
    ops = stores.read_batch(spark.createDataFrame([('{"operations": [{"search": "a", "replace": "b"}]}',), ("[",)], "value string"))
    assert ops.count() == 0
    assert [tuple(r) for r in stores.read_tags(spark, '[files."a.py"]\ntop = "0.1"\n').collect()] == [("a.py", "top", "0.1")]
    stores.write_by_file(spark.createDataFrame([("a", 1), ("b", 2)], "file_path string, v int"), str(tmp_path / "v"))
    stores.write_by_file(spark.createDataFrame([("a", 3)], "file_path string, v int"), str(tmp_path / "v"))
    assert sorted((r.file_path, r.v) for r in spark.read.parquet(str(tmp_path / "v")).collect()) == [("a", 3), ("b", 2)]


def test_names_and_places(spark):
    n = tree_of(spark, "a.rs", RS)
    assert find.by_name(n, "@fn:main").first().start_line == 5
    assert find.by_name(n, "@add").first().start_line == 1
    assert tree.at_line(n, 2).first().node_type in ("identifier", "block")
    target = spark.createDataFrame([("a.rs", 2), ("a.rs", 4), ("a.rs", 99)], "file_path string, line int")
    got = {r.line: r.seq for r in tree.insertion_parent(n, target).collect()}
    assert got == {2: 0, 4: 0, 99: 0}  # a scoping child resets the answer at its edges
    at = {r.line: r.position for r in tree.insert_position(n, tree.insertion_parent(n, target)).collect()}
    assert at == {2: 3, 4: 3, 99: 1}


def test_diff_of_code(spark):
    lines = patch.parse_diffs(spark.createDataFrame([("--- a/a.rs\n+++ b/a.rs\n@@ -5,3 +5,3 @@\n fn main() {\n-    let x = 1;\n+    let x = 2;\n }\n",)], "value string"))
    got = [(r.type, r.path, r.content) for r in patch.to_batch(lines, tree_of(spark, "a.rs", RS)).collect()]
    block = tree_of(spark, "a.rs", RS).where("node_type = 'block' and start_line = 5").first().path
    assert got == [("edit", block, "    let x = 2;\n    }")]


def test_edits(spark):
    t = F.lit("a\n  b\nc")
    assert one(spark, edit.replace_node(t, F.lit(2), F.lit(2), F.lit("X")), z=1) == "a\nX\nc"
    assert one(spark, edit.replace_node(t, F.lit(2), F.lit(2), F.lit("X"), F.lit(2), F.lit(3)), z=1) == "a\n  X\nc"
    assert one(spark, edit.insert_at(t, F.lit(1), F.lit("N\nM")), z=1) == "a\n  N\n  M\n  b\nc"
    assert one(spark, edit.insert_at(F.lit(""), F.lit(0), F.lit("N")), z=1) == "N"
    assert one(spark, edit.delete_node(t, F.lit(1), F.lit(2)), z=1) == "c"
    assert one(spark, edit.heal(F.lit("{ {"), F.lit("rs"), F.lit(1)), z=1) == "{ {}}"


def test_guard(spark):
    old = "if x { } else { } for y while z " * 4 + "// c"
    g = one(spark, edit.guard(F.lit(old), F.lit("x")), z=1)
    assert (g.tenths, g.level) == (1, "Critical")
    assert one(spark, edit.guard(F.lit(old), F.lit(old)), z=1).level == "Safe"


def test_batches_are_all_or_nothing(spark):
    fs = spark.createDataFrame([("a.txt", "original A\n"), ("b.txt", "original B\n")], "file_path string, content string")
    spec = lambda path: json.dumps({"operations": [{"type": "edit", "file": "a.txt", "path": "0", "content": "A2"}, {"type": "edit", "file": "b.txt", "path": path, "content": "B2"}]})
    ops = lambda p: stores.read_batch(spark.createDataFrame([(spec(p),)], "value string"))
    assert edit.committed(edit.apply_batch(fs, ops("0"))).count() == 2
    assert edit.committed(edit.apply_batch(fs, ops("9"))).count() == 0
    missing = stores.read_batch(spark.createDataFrame([('{"operations": [{"type": "delete", "file": "c.txt", "path": "0"}]}',)], "value string"))
    assert edit.apply_batch(fs, missing).first().error == "Failed to read c.txt"
    assert edit.guarded_edit(fs, ops("0")).where("error is null").count() == 2
    n = nodes(fs)
    moved = edit.clone_ops(n.where("file_path = 'a.txt' and seq > 0"), "0", "b.txt", "0", move=True)
    assert {r.file_path: r.after for r in edit.apply_batch(fs, moved).collect()} == {"a.txt": "", "b.txt": "original A\noriginal B"}


def test_diff_parser():
    lines = patch.hunk_lines("diff --git a/o b/n\nrename from o\nrename to n\n--- a/o\n+++ b/n\n@@ -1 +1,2 @@\n-x\n+y\n+--- z\n")
    assert [(r[7], r[8], r[9]) for r in lines] == [(1, "deletion", "x"), (2, "addition", "y"), (3, "addition", "--- z")]
    assert patch.hunk_lines("") == [] and patch.hunk_lines("no diff") == []


def test_tree_diff(spark):
    a, b = tree_of(spark, "a.json", '{"x": 1, "y": "s"}'), tree_of(spark, "a.json", '{"x": 2, "z": "s"}')
    got = sorted((r.change, r.path) for r in compare.diff(a, b).collect())
    assert got == [("addition", "z"), ("deletion", "y"), ("modification", "x")]


def test_cosine(spark):
    c = lambda a, b: one(spark, scores.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))), z=1)
    assert c([1.0, 0.0], [1.0, 0.0]) == 1 and c([1.0, 0.0], [0.0, 1.0]) == 0
    assert c([1.0], [1.0, 0.0]) == 0 and c([0.0], [0.0]) == 0


def test_chunks(spark):
    n = lambda k: [len(x) for x in one(spark, text.chunks(F.lit("é" * k), 10, 2, 15), z=1)]
    assert n(15) == [15] and n(18) == [10, 10] and n(19) == [10, 10, 3] and n(0) == [0]


def test_names_in_previews(spark):
    df = spark.createDataFrame([("pub fn  go(x)",), ("class A:",), ("nothing",), (None,)], "t string")
    assert [r.x for r in df.select(text.name_in_preview(F.col("t")).alias("x")).collect()] == ["go", "A", None, None]


def test_index_rows_and_proposals(spark):
    fs = spark.createDataFrame([("a.py", "def f():\n    return 42\n"), ("b.txt", "x" * 16000), ("c.txt", "")], "file_path string, content string")
    rows = semantic.index_rows(nodes(fs), fs)
    assert sorted(r.node_path for r in rows.collect()) == ["0", "chunk_0", "chunk_1"]
    assert semantic.changed_only(rows, rows).count() == 0
    v = spark.createDataFrame([("f", "0.1.2", [1.0, 0.0])], "file_path string, node_path string, vector array<double>")
    p = {i: semantic.propose(v, [1.0, 0.0], i).first() for i in ("after", "before", "inside", "replace")}
    assert [(p[i].op, p[i].parent_path, p[i].position) for i in p] == [("insert", "0.1", 3), ("insert", "0.1", 2), ("insert", "0.1.2", 1), ("edit", "0.1.2", 0)]


def test_quick_insert(spark):
    t = F.lit("use a;\nx\nuse b;\nuse c;\n")
    assert one(spark, text.quick_insert(t, "^use", "N  "), z=1) == "use a;\nN\nx\nuse b;\nN\nuse c;\nN\n"
    assert one(spark, text.quick_insert(t, "^use", "N", near="x"), z=1) == "use a;\nN\nx\nuse b;\nuse c;\n"
    assert one(spark, text.quick_insert(t, "^use", "use c;", unique=True), z=1) == "use a;\nx\nuse b;\nuse c;\n"


def test_scaffold():
    code = output.scaffold("rust:mod(name:auth, children:[struct:Profile(), fn:login(name:execute)])")
    assert "pub mod auth" in code and "pub struct Profile" in code and "pub fn execute" in code
    assert output.scaffold("python:class:A(children:[fn:go()])").splitlines()[:2] == ["class A:", "    def go():"]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "file_path string, content string")
    n = text_nodes(e)
    assert n.count() == 0 and find.find(n, text="x").count() == 0 and tree.at_line(n, 1).count() == 0 and nodes(e).count() == 0
    assert temporal.undo_state(spark.createDataFrame([], "id string, operation string")).first() == (0, 0)


def test_tags_conflict(spark):
    t = spark.createDataFrame([("a", "x", "0"), ("a", "y", "1")], "file_path string, name string, node_path string")
    assert side.rename_tag(t, "a", "x", "y").where("name = 'y'").count() == 1
    assert side.rename_tag(t, "a", "x", "z").where("name = 'z'").count() == 1
    assert side.tag_exists(t, "a", "x").first().found and not side.tag_exists(t, "b", "x").first().found


def test_stream(spark, tmp_path):
    from silvae.streaming import log as stream

    rows = [{"id": f"t{i}", "timestamp": f"2024-01-01T00:0{i}:00Z", "operation": "Edit", "file_path": "f", "after_hash": f"h{i}", "description": "undo" if i == 3 else "e", "session_id": "s", "metadata": {}} for i in range(5)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    s = stream.stream_log(spark, str(tmp_path / "in"))
    for name, df, mode in (("undo_q", stream.undo_state(s), "update"), ("win_q", stream.changes_by_window(s), "complete"), ("seen_q", stream.first_seen(s).select("id"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert tuple(spark.table("undo_q").first()) == ("s", 3, 0, "t4")
    assert spark.table("win_q").agg(F.sum("n")).first()[0] == 5 and spark.table("seen_q").count() == 5


def test_pulse_view_and_model(spark, tmp_path):
    before, after = tree_of(spark, "a.json", '{"x": 1}'), tree_of(spark, "a.json", '{"x": 1, "y": {"z": 2}}')
    got = [(r.section, r.line) for r in tree.pulse_view(before, after, "y").orderBy("section", "place").collect()]
    assert ("tree", "  [+] y [object]") in got and ("tree", "    [*] y.z [number]") in got and got[0] == ("lines", "1")
    stores.write_model(spark, str(tmp_path / "m"), "m1", 768)
    assert stores.read_model(spark, str(tmp_path / "m")).first()[:2] == ("m1", 768)


def test_arguments_and_roots(tmp_path):
    import io

    (tmp_path / "x.txt").write_text("from a file")
    assert [stores.argument("as it is"), stores.argument(f"@{tmp_path}/x.txt"), stores.argument("-", io.StringIO("from input"))] == ["as it is", "from a file", "from input"]
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    assert stores.project_root(str(tmp_path / "a/b")) == str(tmp_path)


def test_hunks_that_promise_too_much():
    lines = patch.hunk_lines("--- a/x\n+++ b/x\n@@ -1,9 +1,9 @@\n one\n-two\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n-p\n+q\n")
    assert [(r[0], r[8], r[9]) for r in lines] == [("b/x", "context", "one"), ("b/x", "deletion", "two"), ("b/y", "deletion", "p"), ("b/y", "addition", "q")]


def test_heal_or_refuse(spark):
    fs = spark.createDataFrame([("a.rs", "fn f() {}"), ("b.py", "x = 1"), ("c.rs", "fn f() {}")], "file_path string, content string")
    rows = spark.createDataFrame([("a.rs", "fn f() { g();"), ("b.py", "def (:"), ("c.rs", "fn g() {}")], "file_path string, content string")
    none = F.lit(None).cast("string")
    op = F.struct(F.lit("edit").alias("type"), F.lit("").alias("path"), none.alias("parent_path"), F.lit(None).cast("int").alias("position"), F.col("content").alias("content"))
    done = {r.file_path: r for r in edit.guarded_edit(fs, edit.batch_of(rows.select("file_path", F.array(op).alias("operations")))).collect()}
    assert done["a.rs"].after == "fn f() { g();}" and done["a.rs"].was_healed and done["c.rs"].after == "fn g() {}" and not done["c.rs"].was_healed
    assert done["b.py"].after is None and done["b.py"].error.startswith("Validation failed")


def test_commit_is_all_or_nothing(spark, tmp_path):
    from silvae.operators import write

    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("one\ntwo")
    fs = files.scan(spark, str(tmp_path), files.Rule(("txt",)))
    spec = lambda path: stores.read_batch(spark.createDataFrame([(json.dumps({"operations": [{"type": "edit", "file": f"{tmp_path}/a.txt", "path": "1", "content": "A"}, {"type": "edit", "file": f"{tmp_path}/b.txt", "path": path, "content": "B"}]}),)], "value string"))
    project = write.Project(spark, f"file://{tmp_path}/.project")
    assert {r.written for r in write.commit(project, fs, spec("9"), "s").collect()} == {False}
    assert (tmp_path / "a.txt").read_text() == "one\ntwo" and project.backups().count() == 0
    assert {r.written for r in write.commit(project, fs, spec("1"), "s", "second", actor="me").collect()} == {True}
    assert (tmp_path / "a.txt").read_text() == "one\nA" and (tmp_path / "b.txt").read_text() == "one\nB"
    log = project.log().orderBy("timestamp").collect()
    assert [r.operation for r in log] == ["SessionStart", "Edit", "Edit"] and all(r.before_hash and r.after_hash for r in log[1:])
    assert {r.actor for r in project.journal().collect()} == {"me"} and project.backups().count() == 2
    write.restore(project, files.scan(spark, str(tmp_path), files.Rule(("txt",))), "2000-01-01 00:00:00", "s")
    assert (tmp_path / "a.txt").read_text() == (tmp_path / "b.txt").read_text() == "one\ntwo"
    assert not list(tmp_path.glob("*.silvae-*"))


def test_sessions_begin_and_the_catalogue(spark):
    from silvae.operators import health, temporal

    got = temporal.session_rows(spark, "now", F.current_timestamp(), end_of="before").orderBy("id").collect()
    assert [(r.session_id, r.operation) for r in got] == [("before", "SessionEnd"), ("now", "SessionStart")]
    assert health.commands(spark).count() == len(health.CATALOGUE)


def test_ids_of_many_rows(spark):
    ids = spark.range(400_000).select(text.new_id("txn").alias("id"))
    assert ids.distinct().count() == 400_000


def test_scan_rules_takes_every_part(spark):
    from silvae.plans import queries as Q
    from tests.helpers import SF

    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    assert Q.QUERIES["scan_rules"](spark, SF).select("k").distinct().count() == parts
