"""Runs that are lost at any place, and steps that are undone and redone."""

import pytest
from pyspark.sql import functions as F

from silvae.operators import edit, write
from silvae.sources import files as source
from silvae.sources import stores

OP = "struct<type: string, path: string, parent_path: string, position: int, content: string>"


def make(spark, folder, n=4):
    for k in range(n):
        (folder / f"{k}.txt").write_text(f"old {k}\nsecond")
    return lambda: source.scan(spark, str(folder), source.Rule(("txt",)))


def batch(files, text):
    op = F.struct(F.lit("edit").alias("type"), F.lit("0").alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit(None).cast("int").alias("position"), F.lit(text).alias("content"))
    return edit.batch_of(files.select("file_path", F.array(op.cast(OP)).alias("operations")))


def texts(folder):
    return sorted(p.read_text().split("\n")[0] for p in folder.glob("*.txt"))


def staged(folder):
    return [p.name for p in folder.iterdir() if ".silvae" in p.name]


class Lost(BaseException):
    """The driver is gone: nothing that catches exceptions may help."""


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("moved", range(5))
def test_lost_after_any_number_of_moves(spark, tmp_path, monkeypatch, moved, forward):
    folder = tmp_path / "src"
    folder.mkdir()
    read = make(spark, folder)
    project = write.Project(spark, f"file://{tmp_path}/.project")
    real = stores.publish

    def publish(rows):
        real(rows.orderBy("file_path").limit(moved)).count()
        raise Lost

    monkeypatch.setattr(stores, "publish", publish)
    with pytest.raises(Lost):
        write.commit(project, read(), batch(read(), "new"), "s")
    monkeypatch.setattr(stores, "publish", real)
    assert texts(folder) == sorted(["new"] * moved + [f"old {k}" for k in range(moved, 4)])
    done = write.recover(project, forward)
    assert [x for _, x in done] == ["committed" if forward else "taken back"] and write.recover(project, forward) == []
    assert texts(folder) == (["new"] * 4 if forward else [f"old {k}" for k in range(4)]) and staged(folder) == []
    edits = project.log().where("operation = 'Edit'").count()
    assert edits == (4 if forward else 0) and project.journal().count() == edits
    assert project.backups().count() == 4
    # and the project goes on
    assert {r.written for r in write.commit(project, read(), batch(read(), "later"), "s").collect()} == {True}
    assert texts(folder) == ["later"] * 4


@pytest.mark.parametrize("phase", ["snapshots", "staged", "log", "journal"])
def test_lost_in_any_phase(spark, tmp_path, monkeypatch, phase):
    folder = tmp_path / "src"
    folder.mkdir()
    read = make(spark, folder, 2)
    project = write.Project(spark, f"file://{tmp_path}/.project")
    real = write.Run.mark

    def mark(self, state, text=""):
        if state == phase:
            raise Lost
        real(self, state, text)

    monkeypatch.setattr(write.Run, "mark", mark)
    with pytest.raises(Lost):
        write.commit(project, read(), batch(read(), "new"), "s")
    monkeypatch.setattr(write.Run, "mark", real)
    assert [x for _, x in write.recover(project)] == ["committed"]
    assert texts(folder) == ["new"] * 2 and staged(folder) == []
    assert project.log().where("operation = 'Edit'").count() == project.journal().count() == project.backups().count() == 2


def test_a_failed_write_is_taken_back(spark, tmp_path, monkeypatch):
    folder = tmp_path / "src"
    folder.mkdir()
    read = make(spark, folder)
    project = write.Project(spark, f"file://{tmp_path}/.project")
    real, calls = stores.publish, []

    def publish(rows):
        calls.append(1)
        if len(calls) == 1:
            real(rows.orderBy("file_path").limit(2)).count()
            raise OSError("disk full")
        return real(rows)

    monkeypatch.setattr(stores, "publish", publish)
    with pytest.raises(OSError, match="disk full"):
        write.commit(project, read(), batch(read(), "new"), "s")
    assert texts(folder) == [f"old {k}" for k in range(4)] and staged(folder) == [] and write.recover(project) == []
    assert project.log().where("operation = 'Edit'").isEmpty()


def test_undo_redo_and_sessions(spark, tmp_path):
    folder = tmp_path / "src"
    folder.mkdir()
    read = make(spark, folder, 2)
    project = write.Project(spark, f"file://{tmp_path}/.project")
    one = lambda k: read().where(F.col("file_path").endswith(f"{k}.txt"))
    write.commit(project, one(0), batch(one(0), "a"), "s1")
    write.commit(project, one(1), batch(one(1), "b"), "s1")
    write.commit(project, one(0), batch(one(0), "c"), "s2")
    assert texts(folder) == ["b", "c"]
    write.undo(project, read(), 2, "s2")
    assert texts(folder) == ["a", "old 1"]
    write.undo(project, read(), 1, "s2", redo=True)
    assert texts(folder) == ["a", "b"]
    write.undo(project, read(), 5, "s2", redo=True)
    assert texts(folder) == ["b", "c"] and write.undo(project, read(), 1, "s2", redo=True).isEmpty()
    write.undo(project, read(), 3, "s2")
    assert texts(folder) == ["old 0", "old 1"]
    # a new change: what was undone before it can't come back
    write.commit(project, one(1), batch(one(1), "d"), "s3")
    assert write.undo(project, read(), 3, "s3", redo=True).isEmpty() and texts(folder) == ["d", "old 0"]
    write.undo(project, read(), 1, "s3")
    write.undo(project, read(), 1, "s3", redo=True)
    assert texts(folder) == ["d", "old 0"]
    write.restore_session(project, read(), "s1", "s4")
    assert texts(folder) == ["old 0", "old 1"]


def test_edit_with_its_change_and_what_it_touches(spark):
    from silvae.operators import code
    from silvae.sources import treestore

    files = spark.createDataFrame([("src/a.rs", "fn f() { g(); }\nfn g() { }\n"), ("src/b.rs", "fn h() { f(); }\n"), ("src/c.rs", "fn f() { h(); }\n"), ("test_a.rs", "")], "file_path string, content string")
    op = F.struct(F.lit("edit").alias("type"), F.lit("0").alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit(None).cast("int").alias("position"), F.lit("fn f() { }").alias("content"))
    ops = edit.batch_of(files.where("file_path = 'src/a.rs'").select("file_path", F.array(op).alias("operations")))
    got = sorted((r.kind, r.n, r.detail) for r in edit.edit_report(files, ops, code.relation_index(treestore.nodes(files))).collect())
    assert got == [("Delete", 0, "fn f() { g(); }"), ("Equal", 2, "fn g() { }"), ("Insert", 1, "fn f() { }"), ("caller", 0, "src/b.rs"), ("test", 0, "test_a.rs")]


def test_files_are_written_by_all_tasks(spark, tmp_path):
    """Rows of files are small and come together in one partition; what is done for each of them is dealt to many."""
    rows = [(f"file://{tmp_path}/src/{k}.txt" if k % 2 else f"{tmp_path}/src/a b%20/{k}.txt", f"text {k}") for k in range(200)]
    files = spark.createDataFrame(rows, "file_path string, content string").coalesce(1)
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    staged = stores.stage(files, "x")
    assert tasks(staged) > 1
    # texts that are grouped by their path before are put together by their size
    assert tasks(stores.stage(files.groupBy("file_path").agg(F.max("content").alias("content")), "x")) > 1
    staged.coalesce(1).write.parquet(f"{tmp_path}/staged")
    assert tasks(stores.publish(spark.read.parquet(f"{tmp_path}/staged"))) > 1
    at = lambda path: path.removeprefix("file://")
    assert all(open(at(path)).read() == text for path, text in rows)
