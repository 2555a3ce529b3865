"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset in local mode (tests), a temporary one that is then set."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="silvae-")
        spark.conf.set("spark.checkpoint.dir", there)
        _made.append((spark, there))
    return there.rstrip("/")


#: Rows of texts that go to a Python worker at once.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of batches of texts: fewer rows at once than Spark's default, unless the session says how many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH))


def free(df: DataFrame, *names: str) -> None:
    """Refuse to add columns that are there already."""
    there = {c.lower() for c in df.columns}
    if taken := sorted(n for n in names if n.lower() in there):
        raise ValueError(f"the input has columns {taken} already; choose other names for the result")


def fresh(df: DataFrame, name: str) -> str:
    """A name for a column in between that is none of the input's."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/silvae/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """A small file in the shared folder, unless it is there already; its path."""
    path = f"{shared_dir(spark)}/silvae/{name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (system.exists(at) and system.getFileStatus(at).getLen() == len(data)):
        out = system.create(at, True)
        out.write(bytearray(data))
        out.close()
        _made.append((spark, path))
    return at.toString() if "://" in path else system.makeQualified(at).toString()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors lose none of it, and plans above start anew."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system of that path."""
    jvm, at = spark.sparkContext._jvm, None
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing will read again."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/silvae/" in file:
            remove(spark, file)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
