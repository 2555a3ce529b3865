"""op1: near-duplicate documents."""

from silvae.llm.minhash import near_duplicates


def op1_minhash_dedup(spark, sf_dir):
    """Of each document its group of near copies; see ``near_duplicates`` for nulls, repeats and ties."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive t as materialized (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as materialized (
  select doc_id, i.sh from (
    select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_distinct([array_to_string(w[k:k + 4], ' ') for k in range(1, len(w) - 3)]) end) as sh from t) i),
n as materialized (select doc_id, count(*) as c from s group by doc_id),
p as materialized (
  select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as materialized (
  select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * common >= 75 * (a.c + b.c - common)),
e as materialized (select x, y from l union select y, x from l),
r(doc_id, reach) as (select doc_id, doc_id from t union select r.doc_id, e.y from r join e on e.x = r.reach)
select t.doc_id, coalesce(n.c, 0)::bigint as n_shingles, m.c as component_id, t.doc_id = m.c as kept
from t left join n using (doc_id) join (select doc_id, min(reach) as c from r group by doc_id) m using (doc_id)
"""
