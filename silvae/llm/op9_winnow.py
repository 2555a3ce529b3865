"""op9: benchmark decontamination."""

from pyspark.sql import functions as F

from silvae.llm.winnow import contaminated, find_benchmark, n_hit


def op9_winnowing(spark, sf_dir):
    """Of each document what it holds of the benchmark; see ``find_benchmark`` for nulls, repeats and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = r"""
with d as materialized (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
b as materialized (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
v as materialized (
  select distinct item_id, least(len(w), 13) as size, unnest([array_to_string(w[k:k + least(len(w), 13) - 1], ' ') for k in range(1, greatest(len(w) - 12, 1) + 1)]) as win
  from b where len(w) > 0),
o as materialized (
  select doc_id, z.size, unnest(range(1, len(w) - z.size + 2)) as pos, unnest([array_to_string(w[k:k + z.size - 1], ' ') for k in range(1, len(w) - z.size + 2)]) as win
  from d, (select distinct size from v) z where len(w) >= z.size),
h as materialized (select o.doc_id, v.item_id, o.pos, o.size from o join v using (size, win)),
c as (select doc_id, count(distinct p)::bigint as n_hit from (select doc_id, unnest(range(pos, pos + size)) as p from (select distinct doc_id, pos, size from h)) group by doc_id),
i as (select doc_id, count(*)::bigint as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as names from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join i using (doc_id)
"""
