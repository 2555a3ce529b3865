"""Shards by extendible hashing: a directory over hash prefixes in which only buckets that are too large split.

Built-in functions only. The bytes of all rows are summed once for cells of a prefix some bits
longer than an even split needs, the cells are rolled up to every shorter prefix, and a bucket is
the shortest prefix that fits the limit. Cells that are still too large are looked at again with
more bits, and they alone. Rows of one key share all bits of their hash; where they alone are too
large, further bits are those of a number of each row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvae.llm.store import free, fresh, materialize

#: Bits of the key's hash and of the row's, and how many more than an even split needs are looked at in a round.
BITS, MORE = 60, 5


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5; a null key is an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _cell(bits: str, deep: int) -> Column:
    return F.call_function("shiftright", F.col(bits), F.lit(BITS - deep))


def _buckets(cells: DataFrame, low: int, deep: int, limit: int, last: bool) -> DataFrame:
    """(base, cell, depth, bucket, shard_bytes, shard_rows) of each cell of ``deep`` bits below a base: its bucket among prefixes of ``low`` bits and more, or null if all are too large."""
    levels = cells.select("base", "cell", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(deep))).alias("depth"))
    levels = levels.withColumn("bucket", F.call_function("shiftright", F.col("cell"), F.lit(deep) - F.col("depth")))
    sizes = levels.groupBy("base", "depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = sizes.where((F.col("shard_bytes") <= limit) | (F.lit(last) & (F.col("depth") == BITS)))
    found = levels.select("base", "cell", "depth", "bucket").join(fits, ["base", "depth", "bucket"])
    first = found.groupBy("base", "cell").agg(F.min(F.struct("depth", "bucket", "shard_bytes", "shard_rows")).alias("b"))
    return cells.select("base", "cell").join(first, ["base", "cell"], "left").select("base", "cell", "b.*")


def _prefix(bits: Column, depth: Column) -> Column:
    return F.when(depth > 0, F.lpad(F.bin(bits), depth, F.lit("0"))).otherwise("")


def shard(rows: DataFrame, key_col: str, size: Column, limit: int, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: the key) of each row with shard, depth, bytes, shard_bytes and shard_rows.

    shard is the bucket's prefix in binary, empty for a single bucket; depth its bits. Rows of one key
    stay together while they fit the limit; else their shards have over 60 bits, those beyond from a
    number of each row. Only a row that is too large by itself exceeds the limit, with those of its 120
    bits. A null size counts as 0, null keys are one key, repeated rows are counted each. Empty tables
    give none. The result's names must not be among ``keep``.
    """
    keep = keep or [key_col]
    free(rows.select(*(F.col(f"`{c}`") for c in keep)), "shard", "depth", "bytes", "shard_bytes", "shard_rows")
    h, s = fresh(rows, "key_bits"), fresh(rows, "row_bits")
    kept = [F.col(f"`{c}`") for c in keep]
    work = rows.select(*kept, hash_bits(F.col(f"`{key_col}`")).alias(h), hash_bits(F.monotonically_increasing_id()).alias(s), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"))
    left = work = materialize(work, "sizes")
    total = work.agg(F.sum("bytes")).first()[0] or 0
    deep, low, out, bits, base = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + MORE), 0, None, h, F.lit(0).cast("long")
    while True:
        by_row = bits == s
        placed = left.withColumn("base", base).withColumn("cell", _cell(bits, deep))
        cells = placed.groupBy("base", "cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        map_ = materialize(_buckets(cells, low, deep, limit, by_row), "directory")
        joined = placed.join(map_, ["base", "cell"])
        name = F.concat(_prefix(F.col(h), F.lit(BITS)), _prefix(F.col("bucket"), F.col("depth"))) if by_row else _prefix(F.col("bucket"), F.col("depth"))
        done = joined.where("bucket is not null").select(*kept, name.alias("shard"), (F.col("depth") + (BITS if by_row else 0)).alias("depth"), "bytes", "shard_bytes", "shard_rows")
        out = done if out is None else out.unionByName(done)
        over = map_.where("bucket is null").select("base", "cell")
        if over.isEmpty():
            return out
        left = materialize(placed.join(over, ["base", "cell"], "left_semi").drop("base", "cell"), "over")
        if deep == BITS:
            # single keys: each is a base of its own, split by rows
            bits, base, low, deep = s, F.col(h), 1, 12
        else:
            low, deep = deep + 1, min(BITS, deep + 8)


def write_shards(rows: DataFrame, key_col: str, size: Column, limit: int, path: str) -> None:
    """Write ``rows`` with a folder for each shard, the letter b and its prefix, each by one task: no shard is larger than the limit, so no task is."""
    out = shard(rows, key_col, size, limit, rows.columns).drop("depth", "shard_bytes", "shard_rows", "bytes").withColumn("shard", F.concat(F.lit("b"), "shard"))
    out.repartition("shard").write.mode("overwrite").partitionBy("shard").option("maxRecordsPerFile", "0").parquet(path)


def shard_sizes(written: DataFrame, size: Column) -> DataFrame:
    """(shard, files, bytes) of shards as they were written."""
    return written.withColumn("file", F.col("_metadata.file_path")).groupBy("shard").agg(F.count_distinct("file").alias("files"), F.sum(F.coalesce(size, F.lit(0))).alias("bytes"))
