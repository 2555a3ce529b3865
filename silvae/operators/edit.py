"""Edits as functions of a file's lines, guarded and healed, and batches of them."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvae import schema
from silvae.functions.scores import guard_level, guard_tenths
from silvae.functions.script import script
from silvae.functions.text import error_line
from silvae.operators.sweep import apart
from silvae.sources import trees, treestore
from silvae.sources.files import extension, lines


def _joined(*parts: Column) -> Column:
    return F.array_join(F.concat(*parts), "\n")


def _cut(rows: Column, lo: Column, hi: Column) -> Column:
    """Lines lo to hi, counted from 1; none if lo is beyond hi."""
    return F.slice(rows, F.greatest(lo, F.lit(1)), F.greatest(hi - lo + 1, F.lit(0)))


def replace_node(text: Column, start: Column, end: Column, new: Column, start_col: Column | None = None, end_col: Column | None = None) -> Column:
    """Whole lines replaced; with columns above 0, only from the one to the other, in characters."""
    rows, n = lines(text), F.size(lines(text))
    whole = _joined(_cut(rows, F.lit(1), start - 1), F.array(new), _cut(rows, end + 1, n))
    if start_col is None or end_col is None:
        return whole
    first, last = F.element_at(rows, F.least(start, n)), F.element_at(rows, F.least(end, n))
    middle = F.concat(F.substring(first, F.lit(1), start_col), new, F.substring(last, end_col + 1, F.length(last)))
    exact = _joined(_cut(rows, F.lit(1), start - 1), F.array(middle), _cut(rows, end + 1, n))
    return F.when((start_col > 0) & (end_col > 0), exact).otherwise(whole)


def delete_node(text: Column, start: Column, end: Column) -> Column:
    rows = lines(text)
    return _joined(_cut(rows, F.lit(1), start - 1), _cut(rows, end + 1, F.size(rows)))


def insert_at(text: Column, after: Column, new: Column) -> Column:
    """Lines put in after a line (0: before all), with the indentation of the next line, or else of the one before."""
    rows, n = lines(text), F.size(lines(text))
    spaces = lambda i: F.regexp_extract(F.coalesce(F.try_element_at(rows, i), F.lit("")), r"^\s*", 0)
    here = spaces(F.least(after + 1, F.greatest(n, F.lit(1))))
    near = F.when(here == "", spaces(F.when((after > 0) & (after <= n), after).otherwise(F.greatest(n, F.lit(1))))).otherwise(here)
    indent = F.when(n == 0, "").otherwise(near)
    return _joined(_cut(rows, F.lit(1), after), F.transform(lines(new), lambda x: F.concat(indent, x)), _cut(rows, after + 1, n))


def insert_line(position: Column, kind: Column, content: Column, start: Column, end: Column, n_lines: Column, child_ends: Column, property_ends: Column) -> Column:
    """The line after which a child goes: 0 at the top, 1 at the end, 2 after the last property, 3 and more after a child."""
    top = F.when(F.ltrim(content).startswith("{"), start).otherwise(start - 1)
    bottom = F.when(kind == "source_file", F.least(end, n_lines)).otherwise(F.greatest(end - 1, F.lit(0)))
    after_property = F.coalesce(F.array_max(F.filter(property_ends, lambda e: e < end)), start)
    child = F.coalesce(F.try_element_at(child_ends, position - 2), F.try_element_at(child_ends, F.lit(-1)), start)
    return F.when(position == 0, top).when(position == 1, bottom).when(position == 2, after_property).otherwise(child)


def guard(old: Column, new: Column) -> Column:
    """(tenths, level) of an edit from the old to the new text."""
    t = guard_tenths(old, new)
    return F.struct(t.alias("tenths"), guard_level(t).alias("level"))


#: Languages whose missing closing braces are added.
BRACES = ["rs", "c", "cpp", "java", "js", "ts", "qml"]


def heal(text: Column, ext: Column, line: Column, strict: bool = False) -> Column:
    """A text with the closing braces it lacks, or, in Python, the colon its erroneous line lacks; null if there is nothing to heal.

    ``strict`` puts the colon at the end of the text."""
    lack = F.regexp_count(text, F.lit(r"\{")) - F.regexp_count(text, F.lit(r"\}"))
    rows = lines(text)
    bad = F.trim(F.coalesce(F.try_element_at(rows, line), F.lit("")))
    needs = (bad.startswith("def ") | bad.startswith("if ")) & ~bad.endswith(":")
    mended = F.array_join(F.transform(rows, lambda x, i: F.when(i + 1 == line, F.concat(x, F.lit(":"))).otherwise(x)), "\n")
    python = F.concat(text, F.lit(":")) if strict else mended
    return F.when(ext.isin(*BRACES) & (lack > 0), F.concat(text, F.repeat(F.lit("}"), lack))).when((ext == "py") & (line > 0) & needs, python)


def line_diff(old: str, new: str) -> list[tuple[str, str]]:
    """(Equal, Insert or Delete; line) of a shortest script between the lines of two texts."""
    a, b = trees.lines_of(old), trees.lines_of(new)
    return [(tag, x) for tag, i, j, k, m in script(a, b) for x in (b[k:m] if tag == "Insert" else a[i:j])]


def diffs(pairs: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, n, tag, line) of rows with ``before`` and ``after``."""

    kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [(k, n, tag, line) for k, old, new in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n, (tag, line) in enumerate(line_diff(old or "", new or ""))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [key, "n", "tag", "line"])

    return pairs.select(F.col(key).cast("string"), "before", "after").mapInArrow(run, f"{key} string, n int, tag string, line string")


def _put(text: str, after: int, new: str) -> str:
    rows = trees.lines_of(text)
    space = lambda s: s[: len(s) - len(s.lstrip())]
    indent = ""
    if rows:
        indent = space(rows[min(after, len(rows) - 1)]) or space(rows[after - 1 if 0 < after <= len(rows) else -1])
    return "\n".join(rows[:after] + [indent + x for x in trees.lines_of(new)] + rows[after:])


#: Characters of a text whose tree is kept for the next row that has the same, and how many are.
_SHORT, _KEPT = 1 << 12, 256


@functools.lru_cache(_KEPT)
def _short_tree(ext: str, text: str) -> list[list]:
    return trees.parse_columns(f"x.{ext}" if ext else "x", text)


def _tree(ext: str, text: str) -> list[list]:
    """The columns of a text's nodes, for looking only: short texts that are equal are parsed once."""
    return _short_tree(ext, text) if len(text) <= _SHORT else trees.parse_columns(f"x.{ext}" if ext else "x", text)


#: Places of the columns of ``_tree``.
_SEQ, _PARENT, _PATH, _TYPE, _TEXT, _START, _END, _START_COL, _END_COL, _ERROR = (schema.NODES.names.index(c) - 1 for c in ("seq", "parent_seq", "path", "node_type", "content", "start_line", "end_line", "start_col", "end_col", "error"))


def apply_op(ext: str, text: str, op: dict) -> str:
    """One operation on a text of a kind: edit, insert or delete, at a path of its tree."""
    found = _tree(ext, text)
    if found[_ERROR][0]:
        raise ValueError(found[_ERROR][0])
    want = op.get("parent_path") if op["type"] == "insert" else op.get("path")
    if (want or "") not in found[_PATH]:
        raise ValueError(f"Could not resolve path {want}")
    node = found[_PATH].index(want or "")
    rows, start, end, left, right = trees.lines_of(text), *(found[c][node] for c in (_START, _END, _START_COL, _END_COL))
    if op["type"] == "edit":
        if left > 0 and right > 0:
            return "\n".join([*rows[: start - 1], rows[start - 1][:left] + op["content"] + rows[end - 1][right:], *rows[end:]])
        return "\n".join([*rows[: start - 1], op["content"], *rows[end:]])
    if op["type"] == "delete":
        return "\n".join(rows[: start - 1] + rows[end:])
    kids = [k for k, up in enumerate(found[_PARENT]) if up == found[_SEQ][node]]
    at = int(op.get("position") or 0)
    if at == 0:
        after = start if found[_TEXT][node].lstrip().startswith("{") else start - 1
    elif at == 1:
        after = min(end, len(rows)) if found[_TYPE][node] == "source_file" else max(end - 1, 0)
    elif at == 2:
        after = max([found[_END][k] for k in kids if found[_TYPE][k] in ("ui_property", "ui_binding") and found[_END][k] < end], default=start)
    else:
        after = found[_END][kids[min(at - 3, len(kids) - 1)]] if kids else start
    return _put(text, after, op["content"] or "")


def apply_each(files: DataFrame, ops: DataFrame) -> DataFrame:
    """(file_path, before, after, applied, failures): every operation that can be is applied; those that fail are told and passed over."""
    return _applied(files, ops, False).select("file_path", "before", "after", "applied", "failures")


def batch_of(edits: DataFrame) -> DataFrame:
    """Batch rows (position, op) from a row for each file: (file_path, operations), an array of (type, path, parent_path, position, content)."""
    each = edits.select("file_path", F.posexplode("operations").alias("position", "e"))
    op = F.struct(F.col("e.type").alias("type"), F.col("file_path").alias("file"), F.col("e.path").alias("path"), F.col("e.parent_path").alias("parent_path"), F.col("e.position").cast("int").alias("position"), F.col("e.content").alias("content"))
    return each.select("position", op.alias("op"))


def apply_batch(files: DataFrame, ops: DataFrame) -> DataFrame:
    """(file_path, before, after, applied, error): operations (file, position, op) of a batch applied file by file, in order.

    The text is parsed anew after each. The first failure of a file ends its operations and leaves
    ``after`` null: a batch is written only if no file of it failed."""
    return _applied(files, ops, True).drop("failures")


def _applied(files: DataFrame, ops: DataFrame, stop: bool) -> DataFrame:
    """One row for each file that has operations: they follow each other on its text, so they go with it in one row."""
    op = F.struct("position", *(F.col(f"op.{a}").alias(b) for a, b in (("type", "type"), ("path", "path"), ("parent_path", "parent_path"), ("position", "at"), ("content", "content"))))
    wanted = ops.groupBy(F.col("op.file").alias("file_path")).agg(F.array_sort(F.collect_list(op)).alias("ops"))
    texts = files.select("file_path", F.col("content").alias("before"), F.lit(True).alias("there"))
    names = ["file_path", "before", "after", "applied", "error", "failures"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())]

    def one(path: str, there: bool, before: str | None, given: list[dict]) -> tuple:
        if not there:
            return path, None, None, 0, f"Failed to read {path}", [f"Failed to read {path}"] * (1 if stop else len(given))
        text, done, error, failures, ext = before or "", 0, None, [], path.rsplit(".", 1)[-1]
        for given_op in given:
            try:
                text = apply_op(ext, text, given_op | {"position": given_op["at"]})
                done += 1
            except (ValueError, IndexError, KeyError) as e:
                failures.append(str(e))
                if stop:
                    error = str(e)
                    break
        return path, before, None if error else text, done, error, failures

    def run(batches):
        for batch in batches:
            rows = [one(*r) for r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    both = wanted.join(apart(texts), "file_path", "left").select("file_path", F.coalesce("there", F.lit(False)).alias("there"), "before", "ops")
    return both.mapInArrow(run, "file_path string, before string, after string, applied long, error string, failures array<string>")


def preview_edit(files: DataFrame, ops: DataFrame) -> DataFrame:
    """(file_path, n, tag, line): what a batch would change in each file that it can be applied to, as lines; nothing is written."""
    return diffs(apply_batch(files, ops).where("error is null"))


def edit_report(files: DataFrame, ops: DataFrame, relations: DataFrame) -> DataFrame:
    """(file_path, kind, n, detail) of each file that a batch can be applied to: the lines of its change, as Equal, Delete and Insert, and what it touches: ``caller`` and ``test``.

    relations: the project's calls (see ``code.relation_index``), before the edit. Callers are the files elsewhere that call a name
    which the nodes edited have; tests stand where a file's tests would. Nothing is written."""
    from silvae.operators import code

    done = apply_batch(files, ops).where("error is null")
    changed = done.select("file_path", "before", "after")
    lines_ = diffs(changed).select("file_path", F.col("tag").alias("kind"), "n", F.col("line").alias("detail"))
    at = ops.select(F.col("op.file").alias("file_path"), F.coalesce("op.path", "op.parent_path").alias("path")).distinct()
    names = treestore.nodes(files.join(at.select("file_path").distinct(), "file_path", "left_semi")).where("name is not null").join(at, ["file_path", "path"]).select("file_path", "name").distinct()
    own = names.join(done.select("file_path"), "file_path", "left_semi")
    touched = code.pulse_all(relations, files, own).select("file_path", "kind", F.lit(0).alias("n"), "detail")
    return lines_.unionByName(touched)


def batch_summary(done: DataFrame) -> DataFrame:
    return done.agg(F.count_if(F.col("error").isNull()).alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def committed(done: DataFrame) -> DataFrame:
    """The new files of a batch, or none at all if any of it failed."""
    failed = done.where("error is not null").limit(1).select(F.lit(1).alias("x"))
    return done.join(failed, F.lit(True), "left_anti").select("file_path", F.col("after").alias("content"))


def guarded_edit(files: DataFrame, ops: DataFrame, force: bool = False) -> DataFrame:
    """A batch with, for each file, the guard's level of the change; a new text that does not parse is healed if it can be, else it is an error.

    A critical change is blocked unless forced."""
    done = apply_batch(files, ops)
    g = guard(F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))
    out = healed(done).withColumn("guard", F.when(F.col("after").isNotNull(), g))
    blocked = F.coalesce((F.col("guard.level") == "Critical") & F.lit(not force), F.lit(False))
    return out.withColumn("error", F.when(blocked, "GUARDIAN blocked the edit").otherwise(F.col("error"))).withColumn("after", F.when(~blocked, F.col("after")))


def _faults(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` (file_path and others) with what the parser says of their texts as the column ``name``; null where it takes them, and where there is none."""

    def run(batches):
        for batch in batches:
            said = [None if t is None else _tree(trees.extension(p), t)[_ERROR][0] for p, t in zip(batch.column("file_path").to_pylist(), batch.column(text).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def healed(done: DataFrame) -> DataFrame:
    """``done`` (file_path, after, error) with texts that do not parse healed, and ``was_healed``; what does not parse even then is an error without a text.

    Texts stay in their rows while they are parsed, healed and parsed again."""
    mended = F.when(F.col("fault").isNotNull(), heal(F.col("after"), extension(F.col("file_path")), F.coalesce(error_line(F.col("fault")), F.lit(0))))
    both = _faults(_faults(done, "after", "fault").withColumn("mended", mended), "mended", "still")
    well = F.col("fault").isNull() | (F.col("mended").isNotNull() & F.col("still").isNull())
    out = both.withColumn("error", F.when(well, F.col("error")).otherwise(F.concat(F.lit("Validation failed: "), F.coalesce("still", "fault"))))
    out = out.withColumn("was_healed", F.col("fault").isNotNull() & well).withColumn("after", F.when(F.col("fault").isNull(), F.col("after")).when(well, F.col("mended")))
    return out.drop("fault", "mended", "still")


def clone_ops(tree: DataFrame, path: str, target_file: str | Column, target_path: str, move: bool = False) -> DataFrame:
    """The batch rows that copy the node at a path to the end of another parent, in a file by name or by a column of ``file_path``, and, for a move, delete it first."""
    target = F.lit(target_file) if isinstance(target_file, str) else target_file
    src = tree.where(F.col("path") == path).groupBy("file_path").agg(F.min_by("content", "seq").alias("content"))
    none = F.lit(None).cast("string")

    def op(kind: str, file: Column, at: Column, parent: Column, position: Column, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), file.alias("file"), at.alias("path"), parent.alias("parent_path"), position.cast("int").alias("position"), content.alias("content"))

    put = src.select(F.lit(1).alias("position"), op("insert", target, none, F.lit(target_path), F.lit(1), F.col("content")).alias("op"))
    if not move:
        return put
    return src.select(F.lit(0).alias("position"), op("delete", F.col("file_path"), F.lit(path), none, F.lit(None), none).alias("op")).unionByName(put)


def intent_ops(rows: DataFrame) -> DataFrame:
    """Batch rows (position, op) of (position, intent, file, path, content): ``intent_op`` as columns; an unknown intent gives none."""
    kind, n, none = F.col("intent"), F.coalesce(F.substring_index("path", ".", -1).try_cast("int"), F.lit(0)), F.lit(None)
    parent = F.when(F.col("path").contains("."), F.regexp_replace("path", r"\.[^.]*$", "")).otherwise("")
    op = F.struct(
        F.when(kind == "Replace", "edit").when(kind == "Delete", "delete").when(kind.isin("AddProperty", "AddComponent", "InsertBefore", "InsertAfter"), "insert").alias("type"), "file",
        F.when(kind.isin("Replace", "Delete"), F.col("path")).alias("path"), F.when(kind.isin("AddProperty", "AddComponent"), F.col("path")).when(kind.isin("InsertBefore", "InsertAfter"), parent).alias("parent_path"),
        F.when(kind == "AddProperty", 2).when(kind == "AddComponent", 1).when(kind == "InsertBefore", F.when(n == 0, 0).otherwise(n + 2)).when(kind == "InsertAfter", n + 3).otherwise(none).cast("int").alias("position"),
        F.when(kind != "Delete", F.col("content")).alias("content"),
    )
    return rows.select("position", op.alias("op")).where("op.type is not null")


def intent_op(intent: str, file: str, path: str, content: str = "") -> dict:
    """The operation that an intent stands for: Replace, AddProperty, AddComponent, InsertBefore, InsertAfter or Delete."""
    parent, _, last = path.rpartition(".")
    n = int(last) if last.isdigit() else 0
    return {
        "Replace": {"type": "edit", "file": file, "path": path, "content": content},
        "AddProperty": {"type": "insert", "file": file, "parent_path": path, "position": 2, "content": content},
        "AddComponent": {"type": "insert", "file": file, "parent_path": path, "position": 1, "content": content},
        "InsertBefore": {"type": "insert", "file": file, "parent_path": parent, "position": 0 if n == 0 else n + 2, "content": content},
        "InsertAfter": {"type": "insert", "file": file, "parent_path": parent, "position": n + 3, "content": content},
        "Delete": {"type": "delete", "file": file, "path": path},
    }[intent]
