"""op7: shards of bounded size."""

from pyspark.sql import functions as F

from silvae.llm.sharding import shard

#: Bytes of text in a shard of the query, at most.
LIMIT = 1 << 20


def op7_extendible_sharding(spark, sf_dir):
    """Of each document its shard; see ``shard`` for nulls, repeats and keys that are too large."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs, "doc_id", F.octet_length("text"), LIMIT)


ORACLE = f"""
with r as materialized (select doc_id, ('0x' || md5(coalesce(doc_id::varchar, ''))[1:15])::bigint as h, coalesce(strlen(text), 0)::bigint as bytes from documents),
s as materialized (select d::int as depth, h >> (60 - d)::int as bucket, sum(bytes)::bigint as shard_bytes, count(*)::bigint as shard_rows from r, range(0, 61) t(d) group by 1, 2),
leaf as (
  select s.* from s left join s p on p.depth = s.depth - 1 and p.bucket = s.bucket >> 1
  where (s.shard_bytes <= {LIMIT} or s.depth = 60) and (s.depth = 0 or p.shard_bytes > {LIMIT}))
select doc_id, case when depth = 0 then '' else lpad(bin(bucket), depth, '0') end as shard, depth, bytes, shard_bytes, shard_rows
from r join leaf on h >> (60 - depth) = bucket
"""
