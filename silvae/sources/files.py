"""Scans of projects, and their trees as the nodes relation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvae import schema
from silvae.sources import trees
from silvae.sources.shared import scratch


@dataclass(frozen=True)
class Rule:
    """Which files of a directory a query reads. Folders count below the root only."""

    extensions: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    dots: bool = False
    recursive: bool = True


#: Folders that hold no sources, and the extensions that each project query reads.
BUILT = ("target", "node_modules", ".git")
FIND = Rule(("rs", "py", "js", "ts", "tsx", "jsx", "go", "java", "c", "cpp", "h", "hpp", "cs", "php"), BUILT)
BLAST = Rule(("rs", "py", "js", "ts", "go", "java"), BUILT, dots=True)
INSPECT = Rule(("rs", "py", "js", "ts", "go", "java", "c", "cpp", "h", "hpp"), BUILT)
REFACTOR = Rule(("rs", "py", "js", "ts"), BUILT, dots=True)
RELATIONS = Rule((), ("venv", "node_modules", "target", "__pycache__", "env"))
INDEX = Rule()
LINT = Rule(("py", "rs", "ts", "tsx", "js", "jsx", "php", "html", "htm", "qml", "go", "toml", "json", "yaml", "yml", "css", "md", "markdown", "txt", "xml", "svg", "xsl", "xsd", "rss", "atom"), dots=True)


def extension(path: Column) -> Column:
    """After the last dot of the file's name; empty without one."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")


def project(spark: SparkSession, root: str | list[str], rule: Rule = INDEX, **options: str) -> DataFrame:
    """(root, file_path, relative, ext, bytes, content) of the files of one or several roots that a rule accepts.

    Predicates of path and extension reach the source (``sources.project``): a file that they leave out is not opened."""
    from silvae.sources import project as source

    kept = {"extensions": " ".join(rule.extensions), "folders": " ".join(rule.folders), "dots": str(rule.dots).lower(), "recursive": str(rule.recursive).lower()}
    return source.load(spark, [root] if isinstance(root, str) else root, **kept, **options)


def scan(spark: SparkSession, root: str | list[str], rule: Rule = INDEX) -> DataFrame:
    """(file_path, content) of ``project``, a file of several roots once; a file given itself is always read.

    Spark's own listing passes over names that begin with a dot or an underscore. Bytes that are no UTF-8 become U+FFFD."""
    several = not isinstance(root, str) and len(root) > 1
    found = project(spark, root, rule).select("file_path", "content")
    return found.dropDuplicates(["file_path"]) if several else found


def language(ext: Column) -> Column:
    """The parser that an extension is sent to."""
    groups = {"rust": "rs", "python": "py", "javascript": "js jsx mjs cjs", "typescript": "ts tsx", "html": "html htm", "cpp": "cpp cc cxx hpp hxx hh", "c": "c h", "bash": "bash sh", "kotlin": "kt kts", "csharp": "cs", "yaml": "yaml yml", "markdown": "md markdown", "text": "txt", "xml": "xml svg xsl xsd rss atom"}
    out = None
    for name, ext_list in groups.items():
        hit = ext.isin(*ext_list.split())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    single = "slint php go java zig swift dart svelte sql qml css toml json".split()
    return out.when(ext.isin(*single), ext).otherwise("generic")


def lines(text: Column) -> Column:
    """Lines without their ends; a final end of line begins no further one."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.contains(text, F.lit("\r")), F.transform(parts, lambda x: F.regexp_replace(x, "\r$", ""))).otherwise(parts)


def text_nodes(files: DataFrame) -> DataFrame:
    """The trees of text files, by built-in functions: a root, and a node for each line."""
    base = files.select("file_path", F.coalesce("content", F.lit("")).alias("content"), extension(F.col("file_path")).alias("ext")).withColumn("lines", lines(F.col("content")))
    # place 0 is the root, whose line is not looked at
    each = base.select("file_path", "ext", "content", F.size("lines").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "lines")).alias("i", "line"))
    i, root = F.col("i"), F.col("i") == 0
    last = F.greatest(F.col("n"), F.lit(1))
    none, zero = F.lit(None), F.lit(0)
    columns = [
        F.col("file_path"), F.col("ext"), i, F.when(root, F.col("n")).otherwise(i), F.when(~root, zero), F.when(root, 0).otherwise(1), F.when(root, 0).otherwise(i - 1), F.when(root, "root").otherwise(F.concat(F.lit("line_"), (i - 1).cast("string"))),
        F.when(root, "0").otherwise((i - 1).cast("string")), F.when(root, "text_file").otherwise("text_line"), F.when(root, F.col("content")).otherwise(F.col("line")), F.when(root, 1).otherwise(i), F.when(root, last).otherwise(i), zero, zero, none, F.when(root, F.col("n")).otherwise(0), none,
    ]
    return each.select(*(c.cast(f.dataType).alias(f.name) for c, f in zip(columns, schema.NODES.fields, strict=True)))


#: Rows of nodes that a parsing task gives at once.
_NODES = 10_000


def node_batches(files: Iterable[tuple[tuple[str, ...], str, str | None]], names: T.StructType = schema.NODES) -> Iterator[pa.RecordBatch]:
    """The nodes relation of files (first columns, name, content), some rows at once; the name says the parser."""
    kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int32() for f in names.fields]
    held: list[list] = [[] for _ in kinds]

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names.names)

    known: dict[trees.Shape, tuple[list, list, list]] = {}
    size = 0

    def flush_known() -> pa.RecordBatch:
        """Files by their shape: a shape's columns are made for all of its files at once."""
        out: list[list[pa.Array]] = []
        for shape, (first, texts, lengths) in known.items():
            which = pa.array(np.repeat(np.arange(len(texts)), shape.n))
            out.append([*(pa.array(c, pa.string()).take(which) for c in zip(*first, strict=True)), *shape.arrow(texts, lengths)])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], names.names)

    for first, name, content in files:
        if (hit := trees.shape_of(name, content)) is not None:
            shape, lengths = hit
            rows = known.setdefault(shape, ([], [], []))
            for c, x in zip(rows, ((*first, trees.extension(name)), content, lengths), strict=True):
                c.append(x)
            size += shape.n
            if size >= _NODES:
                yield flush_known()
                known, size = {}, 0
            continue
        found = trees.parse_columns(name, content)
        for c, x in zip(held, first):  # noqa: B905
            c.extend([x] * len(found[0]))
        for c, new in zip(held[len(first) :], found, strict=True):
            c.extend(new)
        if len(held[0]) >= _NODES:
            yield flush()
            held = [[] for _ in kinds]
    if known:
        yield flush_known()
    yield flush()


def nodes(files: DataFrame) -> DataFrame:
    """The trees of files of any registered kind, parsed here and now. A file that cannot be parsed is one node of type ``error``."""

    def run(batches):
        yield from node_batches(((path,), path, text) for batch in batches for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))

    return files.select("file_path", "content").mapInArrow(run, schema.NODES)


#: Levels of JSON that one plan opens at most.
_LEVELS = 8


def _opened(at: DataFrame, levels: int) -> DataFrame:
    """Rows (file_path, path, v, depth) and all that is in them, so many levels down."""
    first = at.select("file_path", "path", "v", "depth", F.lit(0).alias("level"))
    for d in range(levels):
        own = "array(struct(path as path, v as v, depth as depth, level as level))"
        name = "concat_ws('.', nullif(path, ''), {})"
        fields = f"transform(map_entries(try_variant_get(v, '$', 'map<string,variant>')), e -> struct({name.format('e.key')} as path, e.value as v, depth + 1 as depth, {d + 1} as level))"
        items = f"transform(try_variant_get(v, '$', 'array<variant>'), (e, i) -> struct({name.format('cast(i as string)')} as path, e as v, depth + 1 as depth, {d + 1} as level))"
        below = f"if(level = {d}, concat({own}, coalesce({fields}, {items}, array())), {own})"
        first = first.select("file_path", F.explode(F.expr(below)).alias("x")).select("file_path", "x.path", "x.v", "x.depth", "x.level")
    return first


def json_nodes(files: DataFrame, depth: int | None = None) -> DataFrame:
    """Trees of JSON text by variants: (file_path, path, node_type, content, depth) of every value.

    Containers have no content; a text that is no JSON gives no rows. Each level is one explosion of
    what is open at it. Without a ``depth`` a plan opens some levels, _LEVELS at most, and writes them down, and the
    next begins with what is still open, until nothing is: the texts are read once."""
    at = files.select("file_path", F.expr("try_parse_json(content)").alias("v")).where("v is not null")
    at = at.select("file_path", F.lit("").alias("path"), "v", F.lit(0).alias("depth"))
    if depth is not None:
        rows = _opened(at, depth - 1)
    else:
        spark, root, rows, k = files.sparkSession, scratch(files.sparkSession, "json"), None, 0
        while True:
            levels = min(_LEVELS, 2 << k)
            opened = _opened(at, levels)
            opened.write.parquet(f"{root}/{k}")
            opened = spark.read.schema(opened.schema).parquet(f"{root}/{k}")
            one = opened.where(F.col("level") < levels)
            rows = one if rows is None else rows.unionByName(one)
            at = opened.where(F.col("level") == levels).drop("level")
            if at.isEmpty():
                break
            k += 1
    typed = rows.withColumn("t", F.expr("schema_of_variant(v)"))
    t = F.col("t")
    node_type = F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").otherwise("number")
    content = F.when(F.col("node_type").isin("object", "array"), "").when(F.col("node_type") == "null", "null").otherwise(F.expr("cast(v as string)"))
    return typed.withColumn("node_type", node_type).select("file_path", "path", "node_type", content.alias("content"), "depth")
