"""Trees kept by the content they were parsed from, so that equal and unchanged files are parsed once.

A store is a folder of runs. Each run holds the nodes of contents that no earlier run has, with the
digest of the content and the extension, which says the parser, and the first file that had it. A
run counts once Spark has marked it as done; a job that is lost leaves one that nothing reads.

A run whose contents were each one file's of those that are asked for is read as it is, by these
files' paths. Only other files are joined with the trees of their contents.
"""

from __future__ import annotations

import functools
import hashlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from silvae import schema
from silvae.sources import trees
from silvae.sources.files import extension, node_batches
from silvae.sources.shared import exists, folders, remove, scratch, shared_dir, system

#: The nodes relation by the content's digest, with the path of the first file that had the content.
TREES = T.StructType([T.StructField("key", T.StringType()), *schema.NODES.fields])
_BY = ["ext", "key"]


def parsers_version() -> str:
    """Changes with the parsers: a digest of their source and of those that were registered since."""
    return hashlib.sha256((trees.source() + repr(sorted(trees.registered()))).encode()).hexdigest()[:16]


def content_key(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


class TreeStore:
    """The store at a path, by default one for each state of the parsers in the shared folder.

    A parser that is registered under an extension later makes another store, if its module or name
    is another; one that only behaves otherwise needs a ``path`` of its own."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/silvae-file-trees-{parsers_version()}"

    def runs(self) -> list[str]:
        return [r for r in folders(self.spark, self.path) if exists(self.spark, f"{self.path}/{r}/_SUCCESS")]

    def trees(self, runs: list[str] | None = None) -> DataFrame:
        """All trees that are kept."""
        names = self.runs() if runs is None else runs
        if not names:
            return self.spark.createDataFrame([], TREES)
        return self.spark.read.schema(TREES).parquet(*(f"{self.path}/{r}" for r in names))

    def add(self, files: DataFrame) -> int:
        """Parse the contents of files (file_path, content) that are not kept yet, each once; how many these were."""
        return self._add(files)[1]

    def _add(self, files: DataFrame) -> tuple[str | None, int]:
        """The run that ``add`` made, if any, and its number of contents."""
        keyed = files.select(extension(F.col("file_path")).alias("ext"), content_key(F.col("content")).alias("key"), "file_path", "content")
        # a number of partitions: small contents take as long to parse as to ship, so they are not put together by size
        parts = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        while True:
            before = self.runs()
            new = keyed.repartition(parts, *_BY)
            if before:
                new = new.join(self.trees(before).where("seq = 0").select(*_BY).hint("merge"), _BY, "left_anti")
            new = new.groupBy(*_BY).agg(F.min(F.struct("file_path", "content")).alias("f"))
            run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
            _write(new.select(*_BY, "f.*"), f"{self.path}/{run}")
            count = self.trees([run]).where("seq = 0").count()
            if count == 0:
                remove(self.spark, f"{self.path}/{run}")
                return None, 0
            # a run that came in meanwhile may hold the same contents; the later of two gives way
            if not [r for r in self.runs() if r not in before and r != run]:
                return run, count
            remove(self.spark, f"{self.path}/{run}")

    def nodes(self, files: DataFrame) -> DataFrame:
        """The nodes relation of files (file_path, content), as ``files.nodes`` gives it. What is not kept is parsed first."""
        run, count = self._add(files)
        if run and count == files.count():
            # as many contents as files: each is one file's, which the run names
            return self.trees([run]).select(*schema.NODES.names)
        at = files.select("file_path", extension(F.col("file_path")).alias("ext"), content_key(F.col("content")).alias("key"))
        return self._of(at)

    def _of(self, at: DataFrame) -> DataFrame:
        """The nodes of files (file_path, ext, key) whose contents are kept."""
        by, runs = ["file_path", *_BY], self.runs()
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        first = self.trees(runs).where("seq = 0").select(*by, name.alias("run"))
        asked = at.groupBy(*by).agg(F.count("*").alias("n"))
        root = scratch(self.spark, "asked")
        asked.join(first.hint("merge"), by, "full").write.parquet(root)
        both = self.spark.read.parquet(root)
        whole = both.where("run is not null").groupBy("run").agg(F.bool_and(F.coalesce(F.col("n") == 1, F.lit(False))).alias("whole")).where("whole")
        taken = [r.run for r in whole.collect()]  # one row a run
        rest = both.where(F.col("n").isNotNull() & (F.col("run").isNull() | ~F.col("run").isin(taken)))
        out = [self.trees(taken).select(*schema.NODES.names)] if taken else []
        if not taken or not rest.isEmpty():
            each = rest.select("file_path", *_BY, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).drop("i")
            joined = each.join(self.trees(runs).drop("file_path").hint("merge"), _BY)
            out.append(joined.select(*schema.NODES.names))
        return functools.reduce(DataFrame.unionByName, out)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trees of (ext, key, file_path, content)."""

    def named():
        for batch in batches:
            for ext, key, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield (key, path), f"x.{ext}" if ext else "x", content

    return node_batches(named(), TREES)


#: Rows and bytes of trees that a task holds before it writes them as a group of rows.
ROWS, BYTES = 1 << 17, 64 << 20


@dataclass
class Written(WriterCommitMessage):
    """The file of a task, by the name it has until the write is committed."""

    file: str | None


class TreeWriter(DataSourceArrowWriter):
    """Parses contents where they are written: trees never become rows of Spark, which costs more than to parse them."""

    def __init__(self, path: str):
        self.path = path

    def _there(self) -> tuple[pafs.FileSystem, str, str]:
        files, root = pafs.FileSystem.from_uri(self.path)
        return files, root, f"{root}/_temporary"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, temporary = self._there()
        files.create_dir(temporary, recursive=True)
        out, name, held, rows, size = None, f"{temporary}/{uuid.uuid4().hex}.zstd.parquet", [], 0, 0

        def flush() -> None:
            nonlocal out, held, rows, size
            if out is None:
                out = pq.ParquetWriter(name, held[0].schema, filesystem=files, compression="zstd")
            out.write_table(pa.Table.from_batches(held))
            held, rows, size = [], 0, 0

        for batch in _batches(iterator):
            if batch.num_rows == 0:
                continue
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= ROWS or size >= BYTES:
                flush()
        if held:
            flush()
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        files, root, temporary = self._there()
        files.create_dir(root, recursive=True)
        for k, file in enumerate(m.file for m in messages if m and m.file):
            files.move(file, f"{root}/part-{k:05d}-{file.rpartition('/')[2]}")
        if files.get_file_info(temporary).type == pafs.FileType.Directory:
            files.delete_dir(temporary)
        files.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        files, _, _ = self._there()
        for file in (m.file for m in messages if m and m.file):
            if files.get_file_info(file).type == pafs.FileType.File:
                files.delete_file(file)


class TreeSource(DataSource):
    """``contents.write.format("silvae_trees").save(path)``: the trees of (ext, key, file_path, content) as a run of Parquet files, there once it is done."""

    @classmethod
    def name(cls) -> str:
        return "silvae_trees"

    def schema(self) -> str:
        return "ext string, key string, file_path string, content string"

    def writer(self, schema: T.StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"])


def _write(contents: DataFrame, path: str) -> None:
    """Write the trees of (ext, key, file_path, content) as a run."""
    spark, contents = contents.sparkSession, contents.select("ext", "key", "file_path", "content")
    files, at = system(spark, path)
    whole = files.makeQualified(at).toString()
    try:
        pafs.FileSystem.from_uri(whole)
    except (pa.ArrowException, OSError):
        # a file system that only Spark knows
        contents.mapInArrow(_batches, TREES).write.option("compression", "zstd").parquet(path)
        return
    spark.dataSource.register(TreeSource)
    contents.write.format("silvae_trees").mode("append").save(whole)


def nodes(files: DataFrame) -> DataFrame:
    """The nodes of files by the default store."""
    return TreeStore(files.sparkSession).nodes(files)
