"""Differences of trees, and reports of refactorings."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvae.functions.scores import percent_change
from silvae.operators import sweep
from silvae.operators.find import at_path


def _chains(nodes: DataFrame) -> DataFrame:
    """Nodes with a digest of the types of all their ancestors below the root."""
    return nodes.join(sweep.chains(nodes), ["file_path", "seq"])


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, change, path, old_type, new_type, old_content, new_content) between two states of files.

    Paths only in one are additions and deletions. A path in both is a modification if the contents
    differ, the old one is not blank, and the types of the node and of all above it are the same; only
    the root may change its type."""
    key = ["file_path", "path"]
    first = lambda n, name: n.groupBy(*key).agg(F.min_by(F.struct("node_type", "content", "chain", "depth"), "seq").alias(name))
    both = first(_chains(old), "o").join(first(_chains(new), "w"), key, "full")
    same = (F.col("o.node_type") == F.col("w.node_type")) & (F.col("o.chain") == F.col("w.chain"))
    changed = (same | (F.col("o.depth") == 0)) & ((F.col("o.content") != F.col("w.content")) | (F.col("o.node_type") != F.col("w.node_type"))) & (F.trim("o.content") != "")
    change = F.when(F.col("o").isNull(), "addition").when(F.col("w").isNull(), "deletion").when(changed, "modification")
    out = both.select("file_path", change.alias("change"), "path", F.col("o.node_type").alias("old_type"), F.col("w.node_type").alias("new_type"), F.col("o.content").alias("old_content"), F.col("w.content").alias("new_content"))
    return out.where("change is not null")


def diff_summary(changes: DataFrame) -> DataFrame:
    """Additions, deletions and modifications of each file."""
    count = lambda c: F.count_if(F.col("change") == c).alias(c + "s")
    return changes.groupBy("file_path").agg(count("addition"), count("deletion"), count("modification"), F.count("*").alias("total"))


def diff_nodes(nodes: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Two nodes of a file beside each other."""
    cut = lambda p, s: at_path(nodes, p).select("file_path", *(F.col(c).alias(f"{c}_{s}") for c in ("path", "node_type", "content", "n_children")))
    both = cut(path_a, "a").join(cut(path_b, "b"), "file_path")
    return both.withColumn("same_type", F.col("node_type_a") == F.col("node_type_b")).withColumn("same_content", F.col("content_a") == F.col("content_b"))


#: Types whose loss is worth a warning.
IMPORTANT = ["function_declaration", "function_definition", "function_item", "class_declaration", "class_definition", "struct_item", "enum_item", "impl_item", "method_declaration", "method_definition"]


def structural(before: DataFrame, after: DataFrame, important: list[str] = IMPORTANT) -> DataFrame:
    """(file_path, kind, detail) of files in both states: added and removed named children of the root, types that were lost, a root of another type, a count that changed by over half, and another depth."""
    # the important types of a file are bits of numbers, so that a state's totals are aggregated where its nodes are read
    bits = {kind: divmod(k, 60) for k, kind in enumerate(dict.fromkeys(important))}
    words = range(-(-len(bits) // 60))
    word = lambda w: functools.reduce(lambda out, x: out.when(F.col("node_type") == x[0], F.lit(1 << x[1][1]).cast("long")), ((k, b) for k, b in bits.items() if b[0] == w), F.when(F.lit(False), F.lit(0).cast("long")))
    has = lambda c, b: F.coalesce(F.col(c)[b[0]], F.lit(0).cast("long")).bitwiseAND(F.lit(1 << b[1]).cast("long")) != 0
    total = lambda n: n.groupBy("file_path").agg(F.count("*").alias("n"), F.max("depth").alias("d"), *(F.bit_or(word(w)).alias(f"w{w}") for w in words))
    root = lambda n: n.where("seq = 0").groupBy("file_path").agg(F.max("node_type").alias("t"))
    side = lambda n, name: total(n).join(sweep.apart(root(n)), "file_path", "left").select("file_path", F.struct("n", "d", "t", F.array(*(f"w{w}" for w in words)).alias("types")).alias(name))
    pair = side(before, "a").join(sweep.apart(side(after, "b")), "file_path")
    change = lambda c: F.concat_ws(" -> ", F.col(f"a.{c}").cast("string"), F.col(f"b.{c}").cast("string"))
    found = F.array(
        F.when(F.col("a.t") != F.col("b.t"), F.struct(F.lit("type_changed").alias("kind"), change("t").alias("detail"))),
        F.when(percent_change(F.col("a.n"), F.col("b.n")) > 50, F.struct(F.lit("count_changed").alias("kind"), change("n").alias("detail"))),
        F.when(F.col("a.d") != F.col("b.d"), F.struct(F.lit("depth_changed").alias("kind"), change("d").alias("detail"))),
        *(F.when(has("a.types", b) & ~has("b.types", b), F.struct(F.lit("lost").alias("kind"), F.lit(kind).alias("detail"))) for kind, b in bits.items()),
    )
    whole = pair.select("file_path", F.explode(F.array_compact(found)).alias("x")).select("file_path", "x.kind", "x.detail")

    # named children of both states meet in one aggregation; what only one of them has is a difference. Nothing else of the nodes is shuffled
    named = lambda n, old: n.where("depth = 1 and name is not null").select("file_path", F.concat_ws(" ", "node_type", "name").alias("detail"), F.lit(old).alias("old"))
    both = named(before, True).unionByName(named(after, False)).repartition("file_path")
    only = both.groupBy("file_path", "detail").agg(F.bool_or("old").alias("old"), F.bool_or(~F.col("old")).alias("new")).where("old <> new").join(sweep.apart(pair.select("file_path")), "file_path", "left_semi")
    return only.select("file_path", F.when(F.col("old"), "removed").otherwise("added").alias("kind"), "detail").unionByName(whole)


def rename(nodes: DataFrame, name: str, new: str) -> DataFrame:
    """Every node whose whole content is the name, in any letter case, as it is and as it would be."""
    return nodes.where(F.lower("content") == name.lower()).select("file_path", "seq", "path", "start_line", F.col("content").alias("old"), F.lit(new).alias("new"))


def refactor_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count("*").alias("changes"), F.count_distinct("file_path").alias("files"))


def refactor(nodes: DataFrame, kind: str, path: str, name: str = "", new: str = "") -> DataFrame:
    """A report of what a refactoring would touch; only ``rename`` finds references, nothing is written."""
    if kind == "rename":
        return rename(nodes, name, new)
    return refactors(nodes, [kind], path, new).drop("kind")


def refactors(nodes: DataFrame, kinds: list[str], path: str, new: str = "") -> DataFrame:
    """The reports of several refactorings at a path, each with its kind: the node is looked for once."""
    for kind in kinds:
        if kind not in ("extract", "move", "change_signature", "inline"):
            raise ValueError(f"no refactoring {kind}")
    at = at_path(nodes, path).select("file_path", "seq", "path", "start_line", F.col("content").alias("old"), "name", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return at.select("file_path", "seq", "path", "start_line", "old", F.concat("kind", F.lit(": "), F.coalesce("name", F.lit("unnamed")), F.lit(f" {new}".rstrip())).alias("new"), "kind")
