"""URL rules by a sort-merge range join.

Hosts are turned round, label by label, so that a host and all its subdomains are one interval of
keys. URLs and rules are dealt to buckets of key ranges; a rule that spans several buckets goes to
each of them. Each bucket is swept in key order with a stack of the rules that are open at a key.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows sampled for each bucket's border; the sample is bounded by this times the number of buckets.
PER_BUCKET = 40
_LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z in lower case; empty without ://."""
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """Labels in reverse, each closed by a dot: all below a host begins with the host's key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Level:
    """The rules of one host by path, longest path first."""

    __slots__ = ("key", "paths", "sizes")

    def __init__(self, key: str):
        self.key, self.paths, self.sizes = key, {}, []

    def add(self, path: str, rule: str, block: bool) -> None:
        old = self.paths.get(path)
        if old is None or (block, rule) > (old[1], old[0]):
            self.paths[path] = (rule, block)
        if len(path) not in self.sizes:
            self.sizes = sorted([*self.sizes, len(path)], reverse=True)

    def fit(self, path: str) -> tuple[str, bool] | None:
        for n in self.sizes:
            if n <= len(path) and (hit := self.paths.get(path[:n])) is not None:
                return hit
        return None


_SWEPT = "id long, host string, path string, rule string, block boolean"


def sweep(rows):
    """Rows (bucket, key, kind, id, host, path, rule, block) in that order; yields each URL with its rule."""
    bucket, stack = None, []
    for b, key, kind, id_, host, path, rule, block in rows:
        if b != bucket:
            bucket, stack = b, []
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        if kind == 0:
            if not stack or stack[-1].key != key:
                stack.append(Level(key))
            stack[-1].add(path, rule, block)
            continue
        hit = next((x for level in reversed(stack) if (x := level.fit(path)) is not None), (None, None))
        yield id_, host, path, *hit


def _sweep(batches):
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True)

    held: list[tuple] = []
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]

    def flush():
        columns = list(zip(*held, strict=True)) if held else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "host", "path", "rule", "block"])

    for row in sweep(rows()):
        held.append(row)
        if len(held) == 20_000:
            yield flush()
            held = []
    yield flush()


def _deal(borders: list[tuple[str, int]], is_rule: bool):
    """Adds the bucket of each URL, or each bucket that a rule's interval meets."""

    def run(batches):
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            if is_rule:
                spans = [range(bisect_left(borders, (k,)), bisect_right(borders, (k + _LAST, 1 << 63)) + 1) for k in keys]
                take = [i for i, s in enumerate(spans) for _ in s]
                bucket = [b for s in spans for b in s]
                batch = batch.take(pa.array(take, pa.int64()))
            else:
                bucket = [bisect_right(borders, (k, -1 if i is None else i)) for k, i in zip(keys, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *batch.columns], ["bucket", *batch.schema.names])

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``pages``; ``rules`` has host, path and verdict (allow or block).

    A rule fits its host and all subdomains of it if the URL's path begins with the rule's. The rule
    of the longest host wins, of these that of the longest path; of rules equal in both, block. Without
    a rule, ``rule`` is null and the verdict ``default``. A null URL and one without :// have an empty
    host and path. Repeated rows are judged each; a rule with a null in host, path or verdict is void.
    """
    spark = pages.sparkSession
    url = F.col(f"`{url_col}`").cast("string")
    urls = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.select(key_of(F.col("host")).alias("key"), F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("boolean").alias("block"))
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    given = rules.where("host is not null and path is not null and verdict is not null")
    given = given.select(key_of(host).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), host.alias("host"), "path", F.concat(host, F.col("path")).alias("rule"), (F.col("verdict") == "block").alias("block"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a bound on a hash that about PER_BUCKET rows a bucket meet: what reaches the driver does not grow with the table,
    # and copies of one row, which no border can part, come once
    share = min(1.0, PER_BUCKET * buckets / max(1, urls.count()))
    own = urls.select("key", F.coalesce("id", F.lit(-1)).alias("id"))
    sample = own.where(F.xxhash64("key", "id").cast("double") / 2.0**64 + 0.5 <= share).distinct()
    seen = sorted((r.key, r.id) for r in sample.toLocalIterator())
    borders = sorted({seen[len(seen) * k // buckets] for k in range(1, buckets)}) if seen else []
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), *urls.schema.fields])
    dealt = urls.mapInArrow(_deal(borders, False), schema).unionByName(given.mapInArrow(_deal(borders, True), schema))
    swept = dealt.repartition("bucket").sortWithinPartitions("bucket", "key", "kind").mapInArrow(_sweep, _SWEPT)
    verdict = F.when(F.col("block"), "block").when(~F.col("block"), "allow").otherwise(default)
    return swept.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
