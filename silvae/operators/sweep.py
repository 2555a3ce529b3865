"""Sweeps over trees in pre-order: one sort by file and place, then one pass with a stack of open nodes.

A tree question that would be a join of intervals within a file is linear this way: a row is looked
at once, and what is held is the way from the root to it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a result that are put out at once.
_ROWS = 20_000


def apart(rows: DataFrame) -> DataFrame:
    """Rows that the next join doesn't broadcast: Spark guesses their size from compressed files, and before texts become lines and nodes."""
    return rows.hint("merge")


def in_order(rows: DataFrame, key: list[str], step: Callable[[], Callable[[tuple], Iterator[tuple]]], schema: str, kinds: list[pa.DataType], by: str | list[str] = "file_path", pick: Callable[[], Callable[[pa.RecordBatch], np.ndarray]] | None = None) -> DataFrame:
    """Rows of each file (or other values of ``by``) in the order of ``key``, given one after the other to a function that ``step`` makes for each task; an empty row ends them.

    Of each batch only the rows that ``pick``'s function marks are given, if there is one; it is made for each task as well."""
    names = [c.split()[0] for c in schema.split(", ")]
    by = [by] if isinstance(by, str) else by

    def run(batches):
        one, held, marks = step(), [], pick() if pick else None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) if held else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            if marks:
                batch = batch.filter(pa.array(marks(batch)))
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.extend(one(row))
                if len(held) >= _ROWS:
                    yield flush()
                    held = []
        held.extend(one(()))
        yield flush()

    # dealt by a hash of the file, which no plan below deals by: an exchange is always made here. A union of sides that are
    # dealt by file already would be taken as it is, and adaptive execution can still put its sides on partitions apart
    return rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *key).mapInArrow(run, schema)


#: Nodes of a file that one task sweeps over. A longer file is cut into parts of so many.
PART = 1 << 18


def _parts(first: str, last: Column, size: int | None) -> Column:
    """The parts of a file that a row belongs to whose places go from ``first`` to ``last``."""
    size = PART if size is None else size
    return F.explode(F.sequence(F.floor(F.col(first) / size).cast("int"), F.floor(F.greatest(F.col(first), last) / size).cast("int"))).alias("part")


def enclosing(nodes: DataFrame, inner: Column, outer: Column, size: int | None = None, own: Sequence[str] = (), around: Column | None = None) -> DataFrame:
    """(file_path, seq, outer_seq): each node of ``inner`` with the nearest node of ``outer`` around it, if any; behind them the
    columns ``own`` of the inner node, texts or whole numbers, and as ``around`` a text of the outer one, if they are asked for.

    A file goes in parts of ``size`` places. What is open where a part begins are the nodes of ``outer``
    that reach over its border: each goes to every part it reaches into, and stands before its rows by
    its place. So a part's stack begins as the stack of the whole file would stand there."""

    def step():
        at, stack = None, []

        def one(row):
            nonlocal at, stack
            if not row:
                return
            path, part, seq, end, is_inner, is_outer, *more = row
            if (path, part) != at:
                at, stack = (path, part), []
            while stack and stack[-1][1] < seq:
                stack.pop()
            if is_inner:
                top = stack[-1] if stack else (None, None, None)
                yield path, seq, top[0], *more[:many], *([top[2]] if about else ())
            if is_outer:
                stack.append((seq, end, more[many] if about else None))

        return one

    many, about = len(own), around is not None
    yes = lambda c: F.coalesce(c, F.lit(False))
    more = [F.when(yes(inner), F.col(c)).alias(f"own_{c}") for c in own] + ([F.when(yes(outer), around).alias("around")] if about else [])
    rows = nodes.select("file_path", "seq", "seq_end", yes(inner).alias("inner"), yes(outer).alias("outer"), *more).where("inner or outer")
    reach = rows.select("file_path", _parts("seq", F.when(F.col("outer"), F.col("seq_end")).otherwise(F.col("seq")), size), *rows.columns[1:])
    # in a part that a node only reaches into, it is no question
    mine = F.col("inner") & (F.col("part") == F.floor(F.col("seq") / (PART if size is None else size)))
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    columns = [("file_path", "string"), ("seq", "int"), ("outer_seq", "int"), *((c, nodes.schema[c].dataType.simpleString()) for c in own), *([("around", "string")] if about else [])]
    return in_order(reach.withColumn("inner", mine), ["seq"], step, ", ".join(f"{c} {t}" for c, t in columns), [kinds[t] for _, t in columns], ["file_path", "part"])


def chains(nodes: DataFrame, size: int | None = None) -> DataFrame:
    """(file_path, seq, chain): a digest of the types of all nodes above a node and below the root, the same for equal types in equal order.

    Parts as in ``enclosing``: all nodes above one come before it in its part."""

    def step():
        at, stack = None, []

        def one(row):
            nonlocal at, stack
            if not row:
                return
            path, part, seq, end, is_root, kind, own = row
            if (path, part) != at:
                at, stack = (path, part), []
            while stack and stack[-1][0] < seq:
                stack.pop()
            above = stack[-1][1] if stack else ""
            if own:
                yield path, seq, above
            if end > seq:
                stack.append((end, "" if is_root else hashlib.md5(f"{above}/{kind}".encode(), usedforsecurity=False).hexdigest()))

        return one

    rows = nodes.select("file_path", _parts("seq", F.col("seq_end"), size), "seq", "seq_end", F.col("parent_seq").isNull().alias("root"), "node_type")
    rows = rows.withColumn("own", F.col("part") == F.floor(F.col("seq") / (PART if size is None else size)))
    return in_order(rows, ["seq"], step, "file_path string, seq int, chain string", [pa.string(), pa.int32(), pa.string()], ["file_path", "part"])


def covered(nodes: DataFrame, top: Column, strict: bool, out: str, size: int | None = None) -> DataFrame:
    """``nodes`` with the boolean column ``out``: whether a node of ``top`` is the node itself or above it, or, ``strict``, above it.

    Parts as in ``enclosing``: nodes of ``top`` go, without their other columns, to all parts they reach into."""
    size = PART if size is None else size
    part = F.floor(F.col("seq") / size).cast("int")
    over = nodes.where(top).where(F.col("seq_end") >= (part + 1) * size).select("file_path", F.col("seq_end").alias("reach"), F.explode(F.sequence(part + 1, F.floor(F.col("seq_end") / size).cast("int"))).alias("_part"))
    # of those open where a part begins the one that reaches furthest is enough
    open_ = apart(over.groupBy("file_path", "_part").agg(F.max("reach").alias("_reach")))
    rows = nodes.withColumn("_part", part).join(open_, ["file_path", "_part"], "left")
    w = Window.partitionBy("file_path", "_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    before = F.greatest(F.coalesce(F.max(F.when(top, F.col("seq_end"))).over(w), F.lit(-1)), F.coalesce("_reach", F.lit(-1)))
    return rows.withColumn(out, before >= F.col("seq")).drop("_part", "_reach")


#: Lines of a file that one task looks for.
LINES = 1 << 16


def _lines(nodes: DataFrame, targets: DataFrame, edge: Column, last: bool, size: int | None = None) -> DataFrame:
    """(file_path, line, seq): the node at which each target line ends on its way down from the root.

    ``last``: of the children that hold a line the last one has it, unless the line is on its ``edge``,
    and the root has all lines. Else the first one, and the root only the lines it holds. A line's way
    meets no nodes but those that hold it, so a file goes in parts of ``size`` lines, each with the
    nodes that reach into it and the root."""
    size = LINES if size is None else size

    def step():
        at, stack, lines, answer = None, [], [], {}

        def close():
            yield from ((at[0], line, seq) for line, seq in sorted(answer.items()))

        def one(row):
            nonlocal at, stack, lines, answer
            if not row or row[:2] != at:
                yield from close()
                at, stack, lines, answer = row[:2], [], [], {}
            if not row:
                return
            _, _, is_node, seq, end, start, stop, on_edge = row
            if not is_node:
                if not lines or lines[-1] != seq:
                    lines.append(seq)
                return
            while stack and stack[-1][1] < seq:
                stack.pop()
            above = stack[-1][2] if stack else lines
            if stack or not last:
                a, b = bisect_left(above, start), bisect_right(above, stop)
                own = above[a:b]
            else:
                own = list(above)
            if stack and last and on_edge:
                # a scoping child gives the lines of its first and last two back to the node above
                low, high = bisect_right(own, start + 1), bisect_left(own, stop - 1)
                back = own[:low] + own[max(low, high) :]
                own = own[low : max(low, high)]
                answer.update((x, stack[-1][0]) for x in back)
            elif not last:
                del above[a:b]
            answer.update((x, seq) for x in own)
            stack.append((seq, end, own))

        return one

    none = F.lit(None).cast("int")
    part = lambda c: F.floor(c / size).cast("int")
    line = targets.where("line is not null").select("file_path", part(F.col("line")).alias("part"), F.lit(False).alias("node"), F.col("line").cast("int").alias("seq"), none.alias("seq_end"), none.alias("start_line"), none.alias("end_line"), F.lit(False).alias("edge"))
    reach = F.sequence(part(F.least("start_line", "end_line")), part(F.greatest("start_line", "end_line")))
    node = nodes.select("file_path", F.when(F.col("seq") > 0, reach).alias("parts"), F.lit(True).alias("node"), "seq", "seq_end", "start_line", "end_line", F.coalesce(edge, F.lit(False)).alias("edge"))
    asked = apart(line.select("file_path", "part").distinct())
    below = node.where("parts is not null").select("file_path", F.explode("parts").alias("part"), *node.columns[2:]).join(asked, ["file_path", "part"], "left_semi")
    root = node.where("parts is null").drop("parts").join(asked, "file_path").select(*line.columns)
    rows = line.unionByName(below.select(*line.columns)).unionByName(root)
    return in_order(rows, ["node", "seq"], step, "file_path string, line int, seq int", [pa.string(), pa.int32(), pa.int32()], ["file_path", "part"])


def first_down(nodes: DataFrame, targets: DataFrame, size: int | None = None) -> DataFrame:
    """(file_path, line, seq): of each target the deepest node that holds the line, going down to the first child that does."""
    return _lines(nodes, targets, F.lit(False), False, size)


def last_down(nodes: DataFrame, targets: DataFrame, edge: Column, size: int | None = None) -> DataFrame:
    """(file_path, line, seq): of each target the node reached by the last child that holds the line, not counting children of ``edge`` on whose borders it is."""
    return _lines(nodes, targets, edge, True, size)


def beginnings(paths: DataFrame) -> DataFrame:
    """(file_path, path, start): of each row (file_path, path, opens) that opens nothing the paths that open and that its own begins with, as strings.

    Paths are swept in order, in which all that begin with one follow it; what is held are the paths that the current one begins with."""

    def step():
        file, stack = None, []

        def one(row):
            nonlocal file, stack
            if not row:
                return
            path, own, is_asking = row
            if path != file:
                file, stack = path, []
            while stack and not own.startswith(stack[-1]):
                stack.pop()
            if is_asking:
                yield from ((path, own, s) for s in stack)
            elif not stack or stack[-1] != own:
                stack.append(own)

        return one

    rows = paths.select("file_path", "path", (~F.col("opens")).alias("asks")).distinct()
    return in_order(rows, ["path", "asks"], step, "file_path string, path string, start string", [pa.string(), pa.string(), pa.string()])
