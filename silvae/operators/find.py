"""Search, lists, skeletons and look-ups over the nodes relation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvae.functions.text import preview


def by_type(nodes: DataFrame, kind: str) -> DataFrame:
    """Nodes whose type contains ``kind``, in any letter case."""
    return nodes.where(F.lower("node_type").contains(kind.lower()))


def by_text(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose content contains ``text``, in any letter case."""
    return nodes.where(F.lower("content").contains(text.lower()))


def result(nodes: DataFrame) -> DataFrame:
    """What a search reports of a node."""
    return nodes.select("path", F.col("node_type").alias("type"), F.coalesce("name", F.lit("unnamed")).alias("name"), F.col("start_line").alias("line"), F.col("file_path").alias("file"), "seq")


def find(nodes: DataFrame, pattern: str | None = None, kind: str | None = None, text: str | None = None, limit: int | None = 100) -> DataFrame:
    """By type, else by text, else by a pattern of both, where a node that matches twice counts twice.

    Sorted by file, line and place, then cut."""
    if kind is not None:
        hits = by_type(nodes, kind)
    elif text is not None:
        hits = by_text(nodes, text)
    else:
        hits = by_type(nodes, pattern or "").unionByName(by_text(nodes, pattern or ""))
    out = result(hits).orderBy("file", "line", "seq")
    return out if limit is None else out.limit(limit)


def summary(found: DataFrame) -> DataFrame:
    """Matches of each file."""
    return found.groupBy("file").agg(F.count("*").alias("matches"))


def is_definition(kind: Column) -> Column:
    """Types that define a name."""
    return kind.contains("definition") | kind.contains("item")


def search(nodes: DataFrame, text: str, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Exact text and type, definitions before all else."""
    hits = nodes.where(F.col("content").contains(text))
    hits = hits if kind is None else hits.where(F.col("node_type") == kind)
    ranked = hits.withColumn("is_def", is_definition(F.col("node_type")) | F.col("node_type").contains("declaration"))
    return ranked.orderBy(F.desc("is_def"), "file_path", "seq").limit(limit)


def page(nodes: DataFrame, kind: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the nodes of a type, in file order."""
    hits = nodes if kind is None else nodes.where(F.col("node_type") == kind)
    return hits.orderBy("file_path", "seq").offset(offset).limit(limit)


def outline(nodes: DataFrame, labels: DataFrame, hash_col: Column, kind: str | None = None, depth: int = 3, limit: int = 5000) -> DataFrame:
    """Nodes down to a depth with the labels of their content; without labels an empty array."""
    hits = nodes.where(F.col("depth") <= depth)
    hits = hits if kind is None else hits.where(F.col("node_type") == kind)
    known = labels.select(F.col("file_path"), "content_hash", "labels")
    joined = hits.withColumn("content_hash", hash_col).join(known, ["file_path", "content_hash"], "left")
    return joined.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))).orderBy("file_path", "seq").limit(limit)


def skeleton(nodes: DataFrame, depth: int = 2, limit: int = 500) -> DataFrame:
    return nodes.where(F.col("depth") <= depth).orderBy("file_path", "seq").limit(limit)


def at_path(nodes: DataFrame, path: str) -> DataFrame:
    """Of each file the first node in pre-order with the path."""
    return _first(nodes.where(F.col("path") == path))


def _first(hits: DataFrame) -> DataFrame:
    """Of each file the first hit in pre-order."""
    row = F.struct(*(F.col(f"`{c}`") for c in hits.columns if c != "file_path"))
    return hits.groupBy("file_path").agg(F.min_by(row, "seq").alias("n")).select("file_path", "n.*").select(*hits.columns)


#: Kinds that stand for each other in ``@kind:name``.
SYNONYMS = {k: g for g in (("fn", "func", "function", "method"), ("struct", "class", "type")) for k in g}


def by_name(nodes: DataFrame, address: str) -> DataFrame:
    """``@kind:name`` or ``@name``: of each file the first node so named whose type contains the kind or a synonym of it."""
    kind, _, name = address.removeprefix("@").rpartition(":")
    hit = F.col("name") == name
    if kind:
        words = SYNONYMS.get(kind.lower(), (kind.lower(),))
        hit &= F.lower("node_type").rlike("|".join(map(re.escape, words)))
    hit &= ~F.col("node_type").isin("identifier", "type_identifier", "name", "field_identifier") if kind else F.lit(True)
    return _first(nodes.where(hit))


def search_file(nodes: DataFrame, file_path: str, text: str, limit: int = 500) -> DataFrame:
    """Nodes of one file whose content holds a text, in any letter case, in pre-order."""
    return by_text(nodes.where(F.col("file_path") == file_path), text).orderBy("seq").limit(limit)


def by_files(rows: DataFrame, patterns: list[str], col: str = "file_path") -> DataFrame:
    """Rows whose path contains any of the patterns."""
    return rows.where(F.exists(F.array(*map(F.lit, patterns)), lambda p: F.col(col).contains(p)))


def failed(nodes: DataFrame) -> DataFrame:
    """Files that could not be parsed, with the message."""
    return nodes.where("error is not null").select("file_path", "error")


def lint_totals(nodes: DataFrame) -> DataFrame:
    return nodes.where("seq = 0").agg(F.count("*").alias("files"), F.count_if(F.col("error").isNotNull()).alias("issues"))


def top_level(nodes: DataFrame) -> DataFrame:
    """Children of each file's root."""
    return nodes.groupBy("file_path").agg(F.count_if(F.col("depth") == 1).alias("top_level"))


def context(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Of the nodes ``of`` (file_path, seq): the parent's path, the number of children and the siblings' contents in order."""
    asked = nodes.join(of.select("file_path", "seq"), ["file_path", "seq"], "left_semi")
    up = nodes.select("file_path", F.col("seq").alias("parent_seq"), F.col("path").alias("parent_path"))
    # each family once, whatever number of its members is asked for
    families = asked.select("file_path", "parent_seq").distinct()
    kin = nodes.join(families, ["file_path", "parent_seq"], "left_semi").groupBy("file_path", "parent_seq").agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").alias("o"), F.col("content").alias("c")))).alias("all"))
    joined = asked.join(up, ["file_path", "parent_seq"], "left").join(kin, ["file_path", "parent_seq"], "left").withColumn("family", F.filter("all", lambda x: x["o"] != F.col("ordinal")))
    siblings = F.transform(F.coalesce("family", F.array().cast("array<struct<o:int,c:string>>")), lambda x: x["c"])
    return joined.select("file_path", "seq", "path", "parent_path", "n_children", siblings.alias("siblings"))


def path_map(nodes: DataFrame) -> DataFrame:
    """The last node in pre-order of each path."""
    return nodes.groupBy("file_path", "path").agg(F.max_by(F.struct("seq", "node_type", "content"), "seq").alias("n")).select("file_path", "path", "n.*")


def previews(nodes: DataFrame) -> DataFrame:
    return nodes.select("file_path", "seq", preview(F.col("content")).alias("preview"))


def file_marks(found: DataFrame) -> DataFrame:
    """Whether a row of a sorted result is the first of its file."""
    w = Window.partitionBy("file").orderBy("line", "seq")
    return found.withColumn("new_file", F.lag("file").over(w).isNull())
