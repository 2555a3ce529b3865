"""The star-schema and document tables as the relations of the operators, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvae.schema import MUTATING
from silvae.sources.files import text_nodes
from silvae.sources.shared import scratch  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.format_string("doc/%d.txt", "doc_id").alias("file_path"), F.col("text").alias("content"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_nodes(files(spark, sf_dir))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = {"purchase": "Edit", "click": "Insert", "error": "Delete", "signup": "SessionStart", "view": "SessionEnd"}
    op = None
    for k, v in kind.items():
        op = F.when(F.col("event_type") == k, v) if op is None else op.when(F.col("event_type") == k, v)
    base = e.select("event_id", F.format_string("txn_%d", "event_id").alias("id"), F.col("ts").alias("timestamp"), op.alias("operation"), F.format_string("file_%d", "user_id").alias("file_path"), F.concat(F.lit("session_"), F.date_format("ts", "yyyyMMdd")).alias("session_id"), F.col("event_type").alias("description"))
    changes = F.col("operation").isin(*MUTATING)
    # rows of other operations stand apart, so that the previous row is the previous change
    w = Window.partitionBy("file_path", changes).orderBy("timestamp", "event_id")
    before = F.when(changes, F.lag("event_id").over(w).cast("string"))
    return base.withColumn("before_hash", before).withColumn("after_hash", F.when(changes, F.col("event_id").cast("string"))).withColumn("node_path", F.lit(None).cast("string")).drop("event_id")


def backups(log_: DataFrame) -> DataFrame:
    """A snapshot before every change."""
    rows = log_.where(F.col("operation").isin(*MUTATING))
    return rows.select(F.concat(F.lit("backup_"), "id").alias("backup_path"), "timestamp", F.col("file_path").alias("original_file_path"), F.col("before_hash").alias("content_hash"), F.col("description").alias("source_code"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.format_string("label_%d", "label").alias("file_path"), F.col("vec_id").cast("string").alias("node_path"), "vec_id", F.format_string("fn f%d()", "vec_id").alias("content_preview"), F.col("embedding").alias("vector"))


def query_vector(vectors_: DataFrame, vec_id: int = 0) -> list[float]:
    """One row: the vector that the searches ask for."""
    row = vectors_.where(F.col("vec_id") == vec_id).select("vector").first()
    return list(row.vector) if row else []


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "Intent").when(F.col("role") == "assistant", "Outcome").otherwise("Meta")
    return c.select("conv_id", "turn", F.col("role").alias("actor"), kind.alias("entry_type"), F.left("text", F.lit(40)).alias("message"), F.format_string("txn_%d", F.col("conv_id") * 8 + F.col("turn")).alias("transaction_id"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels")
    return t.select(F.format_string("doc/%d.txt", "doc_id").alias("file_path"), F.array(F.format_string("quality:%d", "quality"), F.format_string("toxic:%d", "toxic")).alias("labels"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.format_string("order_%d", "l_orderkey").alias("from_file"), F.format_string("%d.%d", "l_orderkey", "l_linenumber").alias("from_path"), F.format_string("part_%d", "l_partkey").alias("to_name"))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files that define the parts they have delivered."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.format_string("supplier_%d", "l_suppkey").alias("file_path"), F.format_string("part_%d", "l_partkey").alias("name"), F.lit("0").alias("path")).distinct()


def supplier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.concat_ws("/", "r_name", "n_name", "s_name").alias("file_path"))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all tasks by their key: a table of few bytes is one task's, and so would be all that is made from its rows."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, F.xxhash64(key))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, n): the keys of the orders, from which code, diffs and batches are made, and a number of 2 to 6 for each."""
    return dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), (F.col("o_orderkey") % 5 + 2).cast("int").alias("n")), "k")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Rust file of each order: an import, a type and n functions, each of which calls the one before it.

    The first of every fifth order is over 60 lines long; the last of every third has a leading underscore and no caller."""
    m = F.col("k") % 97
    name = lambda i: F.concat(F.when((i == F.col("n")) & (F.col("k") % 3 == 0), "_").otherwise(""), F.lit("f"), m.cast("string"), F.lit("_"), i.cast("string"))

    def function(i: Column) -> Column:
        blank = F.when((i == 1) & (F.col("k") % 5 == 0), F.repeat(F.lit("\n"), 60)).otherwise("")
        call = F.when(i == 1, "noop").otherwise(name(i - 1))
        return F.concat(F.lit("fn "), name(i), F.lit("() {\n"), blank, F.lit("    "), call, F.lit("();\n}\n"))

    head = F.format_string("use core::o%d;\nstruct S%d { v: i32 }\n", "k", "k")
    o = orders(spark, sf_dir)
    return o.select(F.format_string("src/o%d.rs", "k").alias("file_path"), F.concat(head, F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), function), "")).alias("content"))


def text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


#: The same relations as common table expressions, by name.
SQL = {
    "orders_": "orders_ as materialized (select o_orderkey as k, (o_orderkey % 5 + 2)::int as n from orders)",
    "functions": """functions as materialized (select k, n, i::int as i, 'src/o' || k || '.rs' as file_path, case when i = n and k % 3 = 0 then '_' else '' end || 'f' || (k % 97) || '_' || i as name,
    case when i = 1 then 'noop' else 'f' || (k % 97) || '_' || (i - 1) end as callee from (select k, n, unnest(range(1, n + 1)) as i from orders_))""",
    "files": "files as materialized (select 'doc/' || doc_id || '.txt' as file_path, text as content, doc_id from documents)",
    "nodes": """parts as materialized (select file_path, coalesce(content, '') as content, string_split(coalesce(content, ''), chr(10)) as p from files),
lined as materialized (select file_path, content, case when p[-1] = '' then p[:-2] else p end as l from parts),
nodes as materialized (
  select file_path, 0 as seq, len(l) as seq_end, null as parent_seq, 0 as depth, 0 as ordinal, '0' as path, 'text_file' as node_type, content, 1 as start_line, greatest(len(l), 1) as end_line, len(l) as n_children from lined
  union all select file_path, i, i, 0, 1, i - 1, (i - 1)::varchar, 'text_line', l[i], i, i, 0 from (select file_path, l, unnest(range(1, len(l) + 1)) as i from lined))""",
    "log": """logged as materialized (select event_id, 'txn_' || event_id as id, ts as timestamp, case event_type when 'purchase' then 'Edit' when 'click' then 'Insert' when 'error' then 'Delete' when 'signup' then 'SessionStart' when 'view' then 'SessionEnd' end as operation,
    'file_' || user_id as file_path, 'session_' || strftime(ts, '%Y%m%d') as session_id, event_type as description from events),
changes as materialized (select *, lag(event_id) over (partition by file_path order by timestamp, event_id)::varchar as before_hash, event_id::varchar as after_hash from logged where operation in ('Edit', 'Insert', 'Delete'))""",
    "backups": "backups as materialized (select 'backup_' || id as backup_path, timestamp, file_path as original_file_path, before_hash as content_hash, description as source_code from changes)",
    "journal": "journal as materialized (select conv_id, turn, role as actor, case role when 'user' then 'Intent' when 'assistant' then 'Outcome' else 'Meta' end as entry_type, left(text, 40) as message, 'txn_' || (conv_id * 8 + turn) as transaction_id from conversations)",
    "calls": "calls as materialized (select 'order_' || l_orderkey as from_file, l_orderkey || '.' || l_linenumber as from_path, 'part_' || l_partkey as to_name from lineitem)",
    "definitions": "definitions as materialized (select distinct 'supplier_' || l_suppkey as file_path, 'part_' || l_partkey as name from lineitem)",
    "supplier_files": "supplier_files as materialized (select r_name || '/' || n_name || '/' || s_name as file_path from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)",
    "scored": """q as (select vec_id::varchar as query, embedding::double[] as v from embeddings where vec_id % 50 = 0),
scored as materialized (select query, 'label_' || label as file_path, vec_id::varchar as node_path, list_dot_product(embedding::double[], q.v) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q.v, q.v))) as score from embeddings, q)""",
}
NEEDS = {"functions": ["orders_"], "nodes": ["files"], "backups": ["log"]}


def with_(names: str, select: str) -> str:
    """A query over the named relations."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    return "with " + ",\n".join(SQL[n] for n in order) + "\n" + select
