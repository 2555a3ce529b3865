"""The project source: what it opens, how it deals folders out, and the rules."""

import pytest
from pyspark.sql import functions as F

from silvae.sources import files, project


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for k in range(40):
        for name in (f"d{k % 5}/e{k}/a{k}.py", f"d{k % 5}/b{k}.rs", f"big/{k}.py", f".x/h{k}.py", f"target/t{k}.rs", f"deep/1/2/3/4/{k}.md", f"_{k}.txt"):
            at = top / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(name)
    (top / "bad.bin").write_bytes(b"\xff\xfea")
    return top


def opened(folder):
    return sum(int(p.read_text()) for p in folder.iterdir()) if folder.exists() else 0


def names(df, top):
    rows = df.collect()
    out = sorted(r.file_path.removeprefix(f"{top}/") for r in rows)
    assert len(out) == len(set(out))
    return out


@pytest.mark.parametrize(("budget", "parts"), [(project.BUDGET, "8"), (1, "8"), (3, "2"), (256, "100")])
def test_all_files_once_however_they_are_dealt(spark, tree, monkeypatch, budget, parts):
    monkeypatch.setattr(project, "BUDGET", budget)
    got = files.project(spark, str(tree), files.Rule((), (), True), partitions=parts)
    assert names(got, tree) == sorted(str(p.relative_to(tree)) for p in tree.rglob("*") if p.is_file())
    assert {r.content for r in got.where("ext = 'rs'").collect()} == {str(p.relative_to(tree)) for p in tree.rglob("*.rs")}
    assert got.where("relative = 'bad.bin'").first().content == "��a"


def test_only_what_is_asked_for_is_opened(spark, tree, tmp_path):
    rule = files.Rule((), (), True)

    def run(k, test):
        got = test(files.project(spark, str(tree), rule, report=f"{tmp_path}/{k}"))
        return got.count(), opened(tmp_path / str(k))

    assert run(1, lambda d: d) == (281, 281)
    assert run(2, lambda d: d.where("ext = 'py'")) == (120, 120)
    assert run(3, lambda d: d.where(F.col("ext").isin("py", "md"))) == (160, 160)
    assert run(4, lambda d: d.where(F.col("relative").startswith("d1/"))) == (16, 16)
    assert run(5, lambda d: d.where(F.col("file_path").endswith("7.py") & F.col("relative").contains("e"))) == (4, 4)
    assert run(6, lambda d: d.where("length(relative) = 7")) == (len([p for p in tree.rglob("*") if p.is_file() and len(str(p.relative_to(tree))) == 7]), 281)
    listed = files.project(spark, str(tree), rule, report=f"{tmp_path}/7", content="false")
    assert listed.where("content is null").count() == 281 and opened(tmp_path / "7") == 0


def test_rules(spark, tree):
    at = lambda rule: names(files.scan(spark, str(tree), rule), tree)
    every = [str(p.relative_to(tree)) for p in tree.rglob("*") if p.is_file()]
    assert at(files.Rule(("py",))) == sorted(f for f in every if f.endswith(".py") and not f.startswith("."))
    assert at(files.Rule(("rs",), ("target",))) == sorted(f for f in every if f.endswith(".rs") and not f.startswith("target"))
    assert at(files.Rule((), (), True, False)) == sorted(f for f in every if "/" not in f)
    one = str(tree / "bad.bin")
    assert files.scan(spark, [one, one], files.Rule(("py",))).count() == 1
    (tree / "empty").mkdir(exist_ok=True)
    assert files.scan(spark, str(tree / "empty")).count() == 0


def test_many_folders_are_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "a.txt").write_text("x")
    got = files.project(spark, str(tmp_path), files.INDEX, partitions="4")
    assert got.rdd.getNumPartitions() <= 4 * project.SHARES
    assert got.count() == 300


def test_crowded_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    from silvae.sources import project

    (tmp_path / "sub/deep").mkdir(parents=True)
    names = [f"f{k}.txt" for k in range(60)] + ["sub/a.txt", "sub/deep/b.txt"]
    for n in names:
        (tmp_path / n).write_text(n)
    monkeypatch.setattr(project, "MANY", 20)
    reader = project.ProjectReader({"roots": str(tmp_path), "partitions": "4"})
    parts = reader.partitions()
    # the driver names none of the files of a folder that has many
    assert sum(len(p.files or []) for p in parts) <= 20
    got = [(r["relative"], r["content"]) for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert sorted(got) == sorted((n, n) for n in names)
