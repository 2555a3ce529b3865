"""One query of each operator over the tables, with the SQL of the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvae.functions import scores, text
from silvae.operators import code, compare, edit, find, health, output, patch, semantic, side, temporal, tree, write
from silvae.plans import bindings as B
from silvae.plans.bindings import with_
from silvae.plans.languages import SAMPLES
from silvae import schema
from silvae.sources import files as source
from silvae.sources import stores, treestore
from silvae.sources.shared import remove

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

T0, T1 = "2024-01-15 00:00:00", "2024-01-20 00:00:00"
S0 = "session_20240115"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


_FOUND = "path, node_type as type, 'unnamed' as name, start_line as line, file_path as file, seq"

# search -----------------------------------------------------------------------------------------


@query(with_("nodes", f"select {_FOUND} from nodes where contains(lower(content), 'license') order by file_path, start_line, seq limit 100"))
def find_text(spark, d):
    return find.find(B.nodes(spark, d), text="License")


@query(with_("nodes", f"select {_FOUND} from nodes where contains(lower(node_type), 'text_l') order by file_path, start_line, seq limit 100"))
def find_type(spark, d):
    return find.find(B.nodes(spark, d), kind="TEXT_L")


@query(with_("nodes", "select file, count(*) as matches from (select file_path as file from nodes where contains(lower(node_type), 'line') union all select file_path from nodes where contains(lower(content), 'line')) group by file"))
def find_pattern_union(spark, d):
    return find.summary(find.find(B.nodes(spark, d), pattern="Line", limit=None))


@query(with_("nodes", "select file_path as file, count(*) as matches from nodes where contains(lower(content), 'the') group by 1"))
def find_summary(spark, d):
    return find.summary(find.find(B.nodes(spark, d), text="the", limit=None))


@query(with_("nodes", "select count(*) as total, count(distinct file_path) as files from nodes where contains(lower(content), 'on')"))
def find_totals(spark, d):
    return find.find(B.nodes(spark, d), text="on", limit=None).agg(F.count("*").alias("total"), F.count_distinct("file").alias("files"))


@query(with_("nodes", "select file_path, seq, content from nodes where contains(content, 'License') and node_type = 'text_line' order by file_path, seq limit 100"))
def search_defs_first(spark, d):
    return find.search(B.nodes(spark, d), "License", "text_line").select("file_path", "seq", "content")


@query(with_("functions", "select file_path, name, type from (select file_path, name, 'function_item' as type, 0 as k, i from functions where contains(name, '_3') union all select file_path, callee, 'call_expression', 1, i from functions where contains(callee, '_3') and callee <> 'noop') order by k, file_path, i limit 100"))
def search_code_defs_first(spark, d):
    """Definitions that hold a text come before all calls that do."""
    n = treestore.nodes(B.code(spark, d)).where(F.col("node_type").isin("function_item", "call_expression"))
    own = n.where(F.col("name").contains("_3")).withColumn("content", F.col("name"))
    return find.search(own, "_3").select("file_path", "name", F.col("node_type").alias("type"))


@query(with_("nodes", "select file_path, seq from nodes where node_type = 'text_line' order by file_path, seq limit 25 offset 50"))
def list_page(spark, d):
    return find.page(B.nodes(spark, d), "text_line", 25, 50).select("file_path", "seq")


@query(with_("nodes", "select file_path, path, node_type, depth from nodes where depth <= 1 order by file_path, seq limit 500"))
def skeleton(spark, d):
    return find.skeleton(B.nodes(spark, d), 1).select("file_path", "path", "node_type", "depth")


@query(with_("nodes", "select n.file_path, n.seq, coalesce(array_to_string(['quality:' || quality, 'toxic:' || toxic], ','), '') as labels from nodes n join files f using (file_path) left join labels l using (doc_id) where n.depth <= 1 order by n.file_path, n.seq limit 5000"))
def list_labelled(spark, d):
    n = B.nodes(spark, d)
    known = B.labels(spark, d).withColumn("content_hash", F.lit("x"))
    return find.outline(n, known, F.lit("x"), depth=1).select("file_path", "seq", F.array_join("labels", ",").alias("labels"))


@query(with_("nodes", "select file_path, min(seq) as seq, arg_min(content, seq) as content from nodes where path = '0' group by file_path"))
def point_lookup(spark, d):
    return find.at_path(B.nodes(spark, d), "0").select("file_path", "seq", "content")


@query(with_("nodes", "select file_path, count(*) filter (where depth = 1) as top_level from nodes group by 1"))
def analyze_summary(spark, d):
    return find.top_level(B.nodes(spark, d))


@query(with_("nodes", "select file_path, path, max(seq) as seq, arg_max(node_type, seq) as node_type from nodes group by 1, 2"))
def path_map(spark, d):
    return find.path_map(B.nodes(spark, d)).select("file_path", "path", "seq", "node_type")


@query(with_("files", "select file_path from files where contains(file_path, '/1') or contains(file_path, '99')"))
def files_by_pattern(spark, d):
    return find.by_files(B.files(spark, d), ["/1", "99"]).select("file_path")


@query(with_("nodes", "select file_path, sum(case when file_path <> coalesce(prev, '') then 1 else 0 end)::bigint as marks, count(*) as hits from (select file_path, lag(file_path) over (partition by file_path order by start_line, seq) as prev from nodes where contains(lower(content), 'license')) group by 1"))
def find_marks(spark, d):
    marked = find.file_marks(find.find(B.nodes(spark, d), text="license", limit=None))
    return marked.groupBy(F.col("file").alias("file_path")).agg(F.count_if("new_file").alias("marks"), F.count("*").alias("hits"))


# trees ------------------------------------------------------------------------------------------


@query(with_("nodes", "select file_path, max(seq) as seq from nodes where start_line <= 3 and end_line >= 3 group by 1"))
def node_at_line(spark, d):
    return tree.at_line(B.nodes(spark, d), 3).select("file_path", "seq")


@query(with_("nodes", "select n.file_path, n.seq, '0' as parent_path, n.n_children, md5(coalesce((select string_agg(m.content, chr(10) order by m.ordinal) from nodes m where m.file_path = n.file_path and m.parent_seq = 0 and m.seq <> n.seq), '')) as siblings from nodes n where n.path = '1'"))
def node_context(spark, d):
    n = B.nodes(spark, d)
    c = find.context(n, n.where("path = '1'"))
    return c.select("file_path", "seq", "parent_path", "n_children", F.md5(F.array_join("siblings", "\n").cast("binary")).alias("siblings"))


@query(with_("nodes", "select file_path, node_type, count(*) as n from nodes group by 1, 2"))
def node_type_counts(spark, d):
    return code.type_counts(B.nodes(spark, d))


@query(with_("nodes", "select file_path, count(*) as n_nodes, max(depth) as max_depth from nodes group by 1"))
def tree_depth(spark, d):
    return tree.depth_and_count(B.nodes(spark, d))


@query(with_("nodes", "select n.file_path, n.seq from nodes n where n.seq <= 2 and n.n_children = 0 and n.depth = 1"))
def subtree_leaves(spark, d):
    n = B.nodes(spark, d)
    return tree.subtree(n, n.where("seq in (1, 2)")).select("file_path", "seq")


@query(with_("nodes", "select file_path, seq, 0 as parent_seq, lag(seq) over w as before, lead(seq) over w as after, count(*) over (partition by file_path) - 1 as n_siblings from nodes where depth = 1 window w as (partition by file_path order by seq)"))
def relatives(spark, d):
    return tree.relatives(B.nodes(spark, d))


_PATHS = "select l_orderkey, l_linenumber, (l_orderkey % 3) || '.' || (l_linenumber % 3) || '.' || (l_suppkey % 4) as p from lineitem"


@query(f"select l_orderkey, l_linenumber, (6 - 2 * case when split_part(p, '.', 1) <> '1' then 0 when split_part(p, '.', 2) <> '2' then 1 when split_part(p, '.', 3) <> '3' then 2 else 3 end)::int as distance from ({_PATHS})")
def tree_distance(spark, d):
    t = B.table(spark, d, "lineitem")
    p = F.concat_ws(".", (F.col("l_orderkey") % 3).cast("string"), (F.col("l_linenumber") % 3).cast("string"), (F.col("l_suppkey") % 4).cast("string"))
    return t.select("l_orderkey", "l_linenumber", text.tree_distance(p, F.lit("1.2.3")).alias("distance"))


@query(with_("nodes", "select file_path, ' ' || repeat('█', least(max(seq), 49)::int) as sparkline, max(depth) as complexity from nodes group by 1"))
def sparkline(spark, d):
    return tree.sparkline(B.nodes(spark, d))


@query(with_("nodes", "select file_path, seq, case when path = '0' then 'focus' when starts_with(path, '0') then 'descendant' else 'near' end as mark from nodes"))
def focus_view(spark, d):
    return tree.focus(B.nodes(spark, d), "0").select("file_path", "seq", "mark")


@query("select l_orderkey, l_linenumber, case when contains(p, '.') then regexp_replace(p, '\\.[^.]*$', '') else '' end as parent, split_part(p, '.', 3)::int as last from (" + _PATHS + ")")
def path_parts(spark, d):
    t = B.table(spark, d, "lineitem")
    p = F.concat_ws(".", (F.col("l_orderkey") % 3).cast("string"), (F.col("l_linenumber") % 3).cast("string"), (F.col("l_suppkey") % 4).cast("string"))
    return t.select("l_orderkey", "l_linenumber", text.parent_path(p).alias("parent"), text.last_index(p).alias("last"))


@query("select event_id, 'k' as path, 'number' as node_type, json_extract_string(props, '$.k') as content from events union all select event_id, '', 'object', '' from events")
def json_nodes(spark, d):
    e = B.table(spark, d, "events").select(F.col("event_id").cast("string").alias("file_path"), F.col("props").alias("content"))
    n = source.json_nodes(e)
    return n.select(F.col("file_path").cast("long").alias("event_id"), "path", "node_type", "content")


@query("select page_id, len(regexp_extract_all(html, '<a[ >]'))::int as links from pages")
def html_links(spark, d):
    return B.table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit("<a[ >]")).alias("links"))


@query("select page_id, tag, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) as tag from pages) group by 1, 2")
def html_nodes(spark, d):
    p = B.table(spark, d, "pages").select(F.format_string("page/%d.html", "page_id").alias("file_path"), F.col("html").alias("content"))
    tags = source.nodes(p).where("node_type = 'tag_name'").groupBy("file_path", "content").agg(F.count("*").alias("n"))
    return tags.select(F.regexp_extract("file_path", r"\d+", 0).cast("long").alias("page_id"), F.col("content").alias("tag"), "n")


@query(with_("nodes", r"select file_path, count(*)::bigint as paragraphs from (select file_path, seq, content, lag(content) over (partition by file_path order by seq) as above from nodes where depth = 1) where not regexp_full_match(content, '\s*') and (above is null or regexp_full_match(above, '\s*')) group by 1").replace("'doc/' || doc_id || '.txt'", "'doc/' || doc_id || '.md'"))
def markdown_nodes(spark, d):
    f = B.files(spark, d).withColumn("file_path", F.replace("file_path", F.lit(".txt"), F.lit(".md")))
    return source.nodes(f).where("depth = 1 and node_type = 'paragraph'").groupBy("file_path").agg(F.count("*").alias("paragraphs"))


@query("select 'doc/' || doc_id || '.xyz' as file_path, 'generic' as node_type, text as content from documents")
def generic_nodes(spark, d):
    f = B.files(spark, d).withColumn("file_path", F.replace("file_path", F.lit(".txt"), F.lit(".xyz")))
    return source.nodes(f).select("file_path", "node_type", "content")


@query("select case when x in ('rs') then 'rust' when x in ('py') then 'python' when x in ('js', 'jsx', 'mjs', 'cjs') then 'javascript' when x = 'md' then 'markdown' when x = '' then 'generic' else x end as lang, n from (select e[(p_partkey % 6 + 1)::int] as x, count(*) as n from part, (select ['rs', 'py', 'mjs', 'md', '', 'go'] as e) group by 1)")
def parser_dispatch(spark, d):
    p = B.table(spark, d, "part")
    name = F.element_at(F.array(*map(F.lit, ["a.b/x.rs", "x.py", "d/x.mjs", "x.md", "x.d/noext", "x.go"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.groupBy(source.language(source.extension(name)).alias("lang")).agg(F.count("*").alias("n"))


# differences ------------------------------------------------------------------------------------

def _neighbours(spark, d):
    """Every document and the one after it, as two states of one file."""
    n = B.nodes(spark, d)
    after = F.format_string("doc/%d.txt", F.regexp_extract("file_path", r"\d+", 0).cast("long") - 1)
    return n, n.withColumn("file_path", after)


_BOTH = with_(
    "nodes",
    """Z, later as materialized (select 'doc/' || (regexp_extract(file_path, '[0-9]+')::bigint - 1) || '.txt' as file_path, seq, path, node_type, content, depth from nodes),
x as materialized (select coalesce(a.file_path, b.file_path) as file_path, case when a.path is null then 'addition' when b.path is null then 'deletion' else 'modification' end as change, coalesce(a.path, b.path) as path,
  a.node_type as old_type, b.node_type as new_type, a.content as old_content, b.content as new_content
  from (select file_path, path, arg_min(node_type, seq) as node_type, arg_min(content, seq) as content, arg_min(depth, seq) as depth from nodes group by 1, 2) a
  full join (select file_path, path, arg_min(node_type, seq) as node_type, arg_min(content, seq) as content from later group by 1, 2) b on a.file_path = b.file_path and a.path = b.path
  where a.path is null or b.path is null or ((a.node_type = b.node_type or a.depth = 0) and (a.content <> b.content or a.node_type <> b.node_type) and trim(a.content) <> ''))
""",
).replace("\nZ, ", ",\n")


@query(_BOTH + "select file_path, change, path, old_type, new_type, md5(old_content) as old, md5(new_content) as new from x")
def ast_diff_paths(spark, d):
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return compare.diff(*_neighbours(spark, d)).select("file_path", "change", "path", "old_type", "new_type", digest("old_content").alias("old"), digest("new_content").alias("new"))


@query(_BOTH + "select file_path, count(*) filter (where change = 'addition') as additions, count(*) filter (where change = 'deletion') as deletions, count(*) filter (where change = 'modification') as modifications, count(*) as total from x group by 1")
def ast_diff_summary(spark, d):
    return compare.diff_summary(compare.diff(*_neighbours(spark, d)))


#: Names of a file's root children in generated code; the n of a file also gives its number of nodes.
_ITEMS = """a as (select file_path, k, n, 'function_item ' || name as item from functions union all select 'src/o' || k || '.rs', k, n, 'struct_item S' || k from orders_ union all select 'src/o' || k || '.rs', k, n, 'use_declaration core' from orders_),
b as (select 'src/o' || (k - 1) || '.rs' as file_path, item from a), s as (select 'src/o' || k || '.rs' as file_path, 9 + 5 * n as c, 'src/o' || (k - 1) || '.rs' as before from orders_)"""


@query(with_("functions", f"Z, {_ITEMS} select file_path, 'removed' as kind, item as detail from (select file_path, item from a where file_path in (select file_path from b) except select file_path, item from b) union all select file_path, 'added', item from (select file_path, item from b where file_path in (select file_path from a) except select file_path, item from a) union all select x.file_path, 'count_changed', x.c || ' -> ' || y.c from s x join s y on y.before = x.file_path where abs(y.c - x.c) / x.c > 0.5").replace("\nZ, ", ",\n"))
def structural_diff(spark, d):
    n = treestore.nodes(B.code(spark, d))
    later = n.withColumn("file_path", F.format_string("src/o%d.rs", F.regexp_extract("file_path", r"\d+", 0).cast("long") - 1))
    return compare.structural(n, later)


@query(with_("nodes", "select a.file_path, a.content as content_a, b.content as content_b, a.content = b.content as same_content from nodes a join nodes b using (file_path) where a.seq = 2 and b.seq = 3"))
def diff_two_nodes(spark, d):
    return compare.diff_nodes(B.nodes(spark, d).where("seq > 0"), "1", "2").select("file_path", "content_a", "content_b", "same_content")


@query(with_("nodes", "select file_path, seq, path, start_line, content as old, 'renamed' as new from nodes where lower(content) = 'released under the mit license.'"))
def rename_refs(spark, d):
    return compare.rename(B.nodes(spark, d), "Released under the MIT License.", "renamed")


@query(with_("nodes", "select count(*) as changes, count(distinct file_path) as files from nodes where lower(content) = 'released under the mit license.'"))
def refactor_summary(spark, d):
    return compare.refactor_summary(compare.refactor(B.nodes(spark, d), "rename", "0", "Released under the MIT License.", "x"))


@query(with_("nodes", "select file_path, seq from nodes where end_line - start_line + 1 > 50"))
def large_nodes(spark, d):
    return code.large_nodes(B.nodes(spark, d)).select("file_path", "seq")


# vectors ----------------------------------------------------------------------------------------


def _asked(spark, d):
    """All vectors, and as queries those whose id is divisible by 50."""
    v = B.vectors(spark, d)
    return v, v.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query"), "vector")


_BEST = "from (select *, row_number() over (partition by query{} order by score desc, node_path)::int as place from scored where score >= 0.2) where place <= {}"


@query(with_("scored", "select query, file_path, node_path, round(score, 4) as score, place " + _BEST.format("", 10)))
def cosine_topk(spark, d):
    return semantic.topk_all(*_asked(spark, d)).select("query", "file_path", "node_path", F.round("score", 4).alias("score"), "place")


@query(with_("scored", "select query, file_path, node_path, place " + _BEST.format(", file_path", 5)))
def cosine_zoom(spark, d):
    return semantic.topk_all(*_asked(spark, d), 5, "file_path").select("query", "file_path", "node_path", "place")


@query(with_("scored", "select query, file_path, node_path as anchor_path, 'insert' as op, '' as parent_path, node_path::int + 1 as position, round(score, 4) as score " + _BEST.format("", 1)))
def edit_proposal(spark, d):
    return semantic.propose_all(*_asked(spark, d), "after").withColumn("score", F.round("score", 4))


@query(with_("scored", "select query, node_path, 'f' || node_path as name, place, case when place = 1 then node_path::bigint % 3 end as impact " + _BEST.format("", 10)))
def sense_names(spark, d):
    """The searches of all queries; the functions are called by 0 to 2 files each."""
    v, q = _asked(spark, d)
    calls = v.select(F.explode(F.sequence(F.lit(1), (F.col("vec_id") % 3).cast("int"))).alias("i"), "vec_id").where("vec_id % 3 > 0")
    calls = calls.select(F.format_string("file_%d", "i").alias("from_file"), F.lit("0").alias("from_path"), F.lit(None).cast("string").alias("to_file"), F.format_string("f%d", "vec_id").alias("to_name"), F.lit("Call").alias("relation_type"))
    return semantic.sense_all(v, calls, q).select("query", "node_path", "name", "place", F.col("impact").cast("long").alias("impact"))


@query(with_("scored", "select query, file_path, node_path, place " + _BEST.format("", 10)))
def cosine_balls(spark, d):
    """The searches of all queries by an index of balls, which leaves out those that can't hold a hit."""
    root = B.scratch(spark, "balls")
    v, q = _asked(spark, d)
    dims = v.select(F.size("vector").alias("n")).first().n
    return semantic.BallIndex(v.select("file_path", "node_path", "vector"), f"{root}/index", dims).search(q, f"{root}/search").select("query", "file_path", "node_path", "place")


@query("select doc_id, i::int as i, length(c)::int as n, md5(c) as chunk from (select doc_id, case when length(text) > 15000 then [substr(text, s::int + 1, 10000) for s in range(0, length(text) - 10000 + 8999, 9000)] else [text] end as cs, unnest(range(0, len(cs))) as i, cs[i + 1] as c from documents)")
def chunk_text(spark, d):
    t = B.table(spark, d, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("i", "c"))
    return t.select("doc_id", "i", F.length("c").alias("n"), F.md5(F.col("c").cast("binary")).alias("chunk"))


@query("select doc_id, case when strlen(text) > 100 then left(text, 97) || '...' else text end as preview from documents")
def preview_text(spark, d):
    return B.table(spark, d, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("select label, count(*) as n from embeddings group by 1")
def index_by_label(spark, d):
    return B.vectors(spark, d).groupBy(F.substring("file_path", 7, 10).cast("int").alias("label")).agg(F.count("*").alias("n"))


@query("select label, round(avg(embedding[1]), 4) as x, round(avg(embedding[64]), 4) as y from embeddings group by 1")
def mean_pool(spark, d):
    m = semantic.mean_pool_by(B.table(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", F.round(F.element_at("vector", 1), 4).alias("x"), F.round(F.element_at("vector", 64), 4).alias("y"))


@query(with_("nodes", "select file_path, seq from nodes where strlen(content) between 30 and 5000 and not (strlen(content) > 100 and len(regexp_extract_all(content, '[{}]')) / strlen(content) > 0.15)"))
def quality_filter(spark, d):
    return semantic.worth_a_report(B.nodes(spark, d)).select("file_path", "seq")


# edits ------------------------------------------------------------------------------------------

_MD5 = "md5({}) as digest"


def _digest(c):
    return F.md5(c.cast("binary")).alias("digest")


@query("select doc_id, " + _MD5.format("replace(coalesce(text, ''), 'the', 'THE' || chr(10))") + " from documents")
def quick_replace(spark, d):
    return B.table(spark, d, "documents").select("doc_id", _digest(text.quick_replace(B.text("text"), "the", "THE\\n")))


@query(with_("nodes", "select file_path, " + _MD5.format("array_to_string(flatten(list_transform(l, lambda x: case when regexp_matches(x, 'License|Creative') then [x, '-- checked'] else [x] end)), chr(10))") + " from lined"))
def quick_insert(spark, d):
    return B.files(spark, d).select("file_path", _digest(text.quick_insert(B.text("content"), "License|Creative", "-- checked")))


@query(with_("nodes", "select file_path, " + _MD5.format("array_to_string(list_concat(l[:1], ['NEW'], l[3:]), chr(10))") + " from lined where len(l) >= 2"))
def edit_line(spark, d):
    f = B.files(spark, d).where(F.size(source.lines(F.col("content"))) >= 2)
    return f.select("file_path", _digest(edit.replace_node(F.col("content"), F.lit(2), F.lit(2), F.lit("NEW"))))


@query(with_("nodes", "select file_path, " + _MD5.format("array_to_string(list_concat(l[:1], [regexp_extract(l[2], '^\\s*') || 'NEW'], l[2:]), chr(10))") + " from lined where len(l) >= 2"))
def insert_line(spark, d):
    f = B.files(spark, d).where(F.size(source.lines(F.col("content"))) >= 2)
    return f.select("file_path", _digest(edit.insert_at(F.col("content"), F.lit(1), F.lit("NEW"))))


@query(with_("nodes", "select file_path, " + _MD5.format("array_to_string(list_concat(l[:1], l[3:]), chr(10))") + " from lined where len(l) >= 2"))
def delete_line(spark, d):
    f = B.files(spark, d).where(F.size(source.lines(F.col("content"))) >= 2)
    return f.select("file_path", _digest(edit.delete_node(F.col("content"), F.lit(2), F.lit(2))))


_MARK = " + ".join(f"(case when contains({{0}}, '{m}') then 1 else 0 end)" for m in scores.MARKS)


@query(
    f"""with t as (select doc_id, coalesce(text, '') as o, left(coalesce(text, ''), (length(text) // 3)::int) as n from documents),
g as (select doc_id, 10 - (case when strlen(n) < strlen(o) // 2 and strlen(o) > 100 then 3 else 0 end) - (case when ({_MARK.format("n")}) < ({_MARK.format("o")}) and ({_MARK.format("o")}) > 2 then 4 else 0 end)
  - (case when (contains(o, '//') or contains(o, '/*')) and not (contains(n, '//') or contains(n, '/*')) then 2 else 0 end) as tenths from t)
select doc_id, tenths, case when tenths <= 3 then 'Critical' when tenths <= 6 then 'Warning' when tenths <= 9 then 'Notice' else 'Safe' end as level from g"""
)
def guardian_audit(spark, d):
    t = B.table(spark, d, "documents").select("doc_id", B.text("text").alias("o"))
    new = F.expr("left(o, cast(length(o) div 3 as int))")
    return t.select("doc_id", edit.guard(F.col("o"), new).alias("g")).select("doc_id", "g.tenths", "g.level")


@query(
    """with m as (select event_id, case event_type when 'purchase' then 'Validation failed near line ' || event_id when 'click' then 'Node not found at path 0.1' when 'error' then 'GUARDIAN: blocked at 12, column' when 'signup' then 'Failed to parse x' else 'Failed to read y' end as message from events)
select event_id, case when contains(message, 'Validation failed') then 'syntax_error' when contains(message, 'not found') then 'path_resolution' when contains(message, 'GUARDIAN') then 'guardian_block' when contains(message, 'Failed to parse') then 'parse_error' else 'io_error' end as error_type,
  case when contains(message, ' 12,') then 12 when contains(message, 'line ') then event_id::int end as line from m"""
)
def error_classify(spark, d):
    e = F.col("event_type")
    m = F.when(e == "purchase", F.format_string("Validation failed near line %d", "event_id")).when(e == "click", "Node not found at path 0.1").when(e == "error", "GUARDIAN: blocked at 12, column").when(e == "signup", "Failed to parse x").otherwise("Failed to read y")
    rows = B.table(spark, d, "events").select("event_id", m.alias("message"))
    return health.diagnose(rows, F.col("message"), F.lit("py")).select("event_id", "error_type", "line")


@query(with_("orders_", "select k, t.text, t.start, t.stop, t.hint, t.style from (select k, length(k::varchar) as w from orders_), lateral (select * from (values ('// ... rest ' || k, 0, 12 + w, 'rest ' || k, 'SlashSlash'), ('# existing code', 15 + w, 30 + w, 'existing code', 'Hash'), ('/* ... */', 31 + w, 40 + w, null, 'SlashStar')) v(text, start, stop, hint, style)) t"))
def anchor_detection(spark, d):
    o = B.orders(spark, d).select("k", F.format_string("// ... rest %d\nx\n# existing code\n/* ... */ y", "k").alias("t"))
    return o.select("k", F.explode(scores.anchors(F.col("t"))).alias("a")).select("k", "a.text", "a.start", "a.stop", "a.hint", "a.style")


def _texts(spark, d):
    """A text of 100 numbered lines of each order."""
    o = B.orders(spark, d)
    return o.select(F.format_string("o%d.txt", "k").alias("file_path"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.concat(F.lit("l"), i.cast("string"))), "\n").alias("content"))


def _diff_texts(spark, d):
    """A unified diff of each order: hunk i at line 10 i replaces the line after it if k + i is even, else adds one."""
    o = B.orders(spark, d)

    def hunk(i):
        at = (i * 10).cast("string")
        even = (F.col("k") + i) % 2 == 0
        body = F.when(even, F.concat(F.lit("-l"), (i * 10 + 1).cast("string"), F.lit("\n+new "), i.cast("string"), F.lit("\n"))).otherwise(F.concat(F.lit("+more "), i.cast("string"), F.lit("\n")))
        sizes = F.when(even, F.concat(F.lit(",2 +"), at, F.lit(",2"))).otherwise(F.concat(F.lit(",1 +"), at, F.lit(",2")))
        return F.concat(F.lit("@@ -"), at, sizes, F.lit(" @@\n l"), at, F.lit("\n"), body)

    name = F.format_string("o%d.txt", "k")
    return o.select(F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), hunk), "")).alias("value"))


_HUNKS = "h as (select 'o' || k || '.txt' as file_path, i::int as hunk_no, (k + i) % 2 = 0 as even from (select k, unnest(range(1, n + 1)) as i from orders_))"


@query(with_("orders_", f"Z, {_HUNKS} select file_path, hunk_no, count(*) as additions, count(*) filter (where even) as deletions from h group by rollup(file_path, hunk_no)").replace("\nZ, ", ",\n"))
def diff_hunks(spark, d):
    return patch.totals(patch.parse_diffs(_diff_texts(spark, d)))


@query(with_("orders_", f"Z, {_HUNKS} select file_path, hunk_no, case when even then 'edit' else 'insert' end as type, case when even then '0' end as path, case when not even then (10 * hunk_no - 1)::varchar end as parent_path, case when not even then 1 end as position, case when even then 'new ' else 'more ' end || hunk_no as content from h").replace("\nZ, ", ",\n"))
def diff_to_batch(spark, d):
    return patch.to_batch(patch.parse_diffs(_diff_texts(spark, d)), source.text_nodes(_texts(spark, d)))


@query(with_("orders_", f"Z, {_HUNKS} select count(*) as operations, count(*) filter (where even) as edits from h").replace("\nZ, ", ",\n"))
def diff_batch_json(spark, d):
    """The batch as one document, read again as a batch."""
    ops = stores.read_batch(patch.batch_json(patch.to_batch(patch.parse_diffs(_diff_texts(spark, d)), source.text_nodes(_texts(spark, d)))))
    return ops.agg(F.count("*").alias("operations"), F.count_if(F.col("op.type") == "edit").alias("edits"))


def _small(spark, d):
    o = B.orders(spark, d)
    return o.select(F.format_string("o%d.txt", "k").alias("file_path"), F.lit("one\ntwo\nthree").alias("content"))


def _edits(spark, d):
    """(file_path, operations): line 2 replaced, line 3 deleted for even keys, and an edit that fails for every seventh."""
    none = F.lit(None).cast("string")

    def op(kind, path, content):
        return F.struct(F.lit(kind).alias("type"), F.lit(path).alias("path"), none.alias("parent_path"), F.lit(None).cast("int").alias("position"), content.alias("content"))

    some = F.array(op("edit", "1", F.format_string("N%d", "k")), F.when(F.col("k") % 2 == 0, op("delete", "2", none)), F.when(F.col("k") % 7 == 0, op("edit", "9", F.lit("x"))))
    return B.orders(spark, d).select(F.format_string("o%d.txt", "k").alias("file_path"), F.array_compact(some).alias("operations"))


_EDITED = "'one' || chr(10) || 'N' || k || case when k % 2 = 0 then '' else chr(10) || 'three' end"


@query(with_("orders_", f"select 'o' || k || '.txt' as file_path, case when k % 7 <> 0 then {_EDITED} end as after, 1 + (k % 2 = 0)::bigint as applied, case when k % 7 = 0 then 'Could not resolve path 9' end as error from orders_"))
def batch_preview(spark, d):
    return edit.apply_batch(_small(spark, d), edit.batch_of(_edits(spark, d))).select("file_path", "after", "applied", "error")


@query(with_("orders_", f"select 'o' || k || '.txt' as file_path, {_EDITED} as after, 1 + (k % 2 = 0)::bigint as applied, (k % 7 = 0)::int as failures from orders_"))
def batch_each(spark, d):
    return edit.apply_each(_small(spark, d), edit.batch_of(_edits(spark, d))).select("file_path", "after", "applied", F.size("failures").alias("failures"))


@query(with_("orders_", "select count(*) filter (where k % 7 <> 0) as completed, count(*) filter (where k % 7 = 0) as failed, 0::bigint as committed from orders_"))
def batch_totals(spark, d):
    done = edit.apply_batch(_small(spark, d), edit.batch_of(_edits(spark, d)))
    return edit.batch_summary(done).crossJoin(edit.committed(done).agg(F.count("*").alias("committed")))


@query(with_("orders_", "select 'o' || k as file_path, t.n, t.tag, t.line from orders_, lateral (select * from (values (0, 'Equal', 'a'), (1, 'Delete', 'b' || k), (2, 'Insert', 'B' || k), (3, 'Equal', 'c'), (4, 'Insert', 'd' || k)) v(n, tag, line)) t"))
def line_diff(spark, d):
    o = B.orders(spark, d)
    return edit.diffs(o.select(F.format_string("o%d", "k").alias("file_path"), F.format_string("a\nb%d\nc", "k").alias("before"), F.format_string("a\nB%d\nc\nd%d", "k", "k").alias("after")))


@query(with_("orders_", "select k, case k % 3 when 0 then 'fn f() { ' || repeat('if x { ', n) || repeat('}', n + 1) when 1 then 'def f' || k || '():' || chr(10) || '    pass' end as healed from orders_"))
def auto_heal(spark, d):
    k = F.col("k")
    o = B.orders(spark, d).withColumn("ext", F.when(k % 3 == 0, "rs").when(k % 3 == 1, "py").otherwise("md"))
    code_ = F.when(k % 3 == 0, F.concat(F.lit("fn f() { "), F.repeat(F.lit("if x { "), F.col("n")))).when(k % 3 == 1, F.format_string("def f%d()\n    pass", "k")).otherwise("{")
    return o.select("k", edit.heal(code_, F.col("ext"), F.lit(1)).alias("healed"))


_LOGIC = "if a\nelse b\nfor c\nwhile d\nmatch e\n" + "x = 1\n" * 15


@query(with_("orders_", "select 'o' || k || '.' || case when k % 4 = 3 then 'py' else 'txt' end as file_path, case k % 4 when 0 then 'Safe' when 1 then 'Critical' when 2 then 'Critical' else 'Safe' end as level, k % 4 = 3 as was_healed, case when k % 4 = 1 or k % 4 = 2 then 'GUARDIAN blocked the edit' end as error from orders_"))
def guarded_edit(spark, d):
    """Edits of four kinds: one that adds, two that lose logic, and one whose missing colon is put in."""
    k = F.col("k")
    o = B.orders(spark, d).withColumn("file_path", F.format_string("o%d.%s", "k", F.when(k % 4 == 3, "py").otherwise("txt")))
    files = o.select("file_path", F.when(k % 4 == 3, "def f():\n    pass").otherwise(_LOGIC).alias("content"))
    new = F.when(k % 4 == 0, _LOGIC + "y").when(k % 4 == 3, "def f()\n    pass").otherwise("y")
    none = F.lit(None).cast("string")
    op = F.struct(F.lit("edit").alias("type"), F.when(k % 4 == 3, "").otherwise("0").alias("path"), none.alias("parent_path"), F.lit(None).cast("int").alias("position"), new.alias("content"))
    done = edit.guarded_edit(files, edit.batch_of(o.select("file_path", F.array(op).alias("operations"))))
    return done.select("file_path", F.col("guard.level").alias("level"), "was_healed", "error")


@query(with_("orders_", "select 'o' || k || '.txt' as file_path, 'one' || chr(10) || 'three' as after from orders_ union all select 'm' || k || '.txt', 'two' || chr(10) || 'z' from orders_"))
def move_node(spark, d):
    files = _small(spark, d)
    targets = B.orders(spark, d).select(F.format_string("m%d.txt", "k").alias("file_path"), F.lit("z").alias("content"))
    ops = edit.clone_ops(source.text_nodes(files).where("seq > 0"), "1", F.regexp_replace("file_path", "^o", "m"), "0", move=True)
    return edit.apply_batch(files.unionByName(targets), ops).select("file_path", "after")


def _rust(spark, d):
    return B.orders(spark, d).select(F.format_string("o%d.rs", "k").alias("file_path"), F.lit("fn a() {}\nfn b() {}\nfn c() {}").alias("content"))


_LINES = "select 'o' || k || '.rs' as file_path, array_to_string(list_transform(case k % 5 when 0 then ['a', '', 'c'] when 1 then ['a', '', 'b', 'c'] when 2 then ['a', 'b', 'c', ''] when 3 then ['a', 'c'] else ['a', 'b', '', 'c'] end, lambda x: case x when '' then 'NEW' else 'fn ' || x || '() {}' end), chr(10)) as after from orders_"


@query(with_("orders_", _LINES))
def intent_edits(spark, d):
    """Replace, before, at the end, delete and after, at the second of three functions."""
    k = F.col("k") % 5
    intent = F.when(k == 0, "Replace").when(k == 1, "InsertBefore").when(k == 2, "AddComponent").when(k == 3, "Delete").otherwise("InsertAfter")
    rows = B.orders(spark, d).select(F.lit(0).alias("position"), intent.alias("intent"), F.format_string("o%d.rs", "k").alias("file"), F.when(k == 2, "").otherwise("1").alias("path"), F.lit("NEW").alias("content"))
    return edit.apply_batch(_rust(spark, d), edit.intent_ops(rows)).select("file_path", "after")


@query(with_("orders_", "select 'o' || k || '.rs' as file_path, p, case p when 0 then 0 when 1 then 3 when 2 then 1 else p - 2 end as after from orders_, (select unnest([0, 1, 2, 3, 4, 5])::int as p)"))
def insert_positions(spark, d):
    """The line after which a child of the root goes, at each position."""
    f = _rust(spark, d)
    root = F.max(F.when(F.col("seq") == 0, F.struct("node_type", "content", "start_line", "end_line"))).alias("root")
    below = F.array_sort(F.collect_list(F.when(F.col("depth") == 1, F.struct("ordinal", "end_line"))))
    # root and children meet in one aggregation: the files are parsed once
    one = source.nodes(f).where("depth <= 1").groupBy("file_path").agg(root, F.transform(below, lambda x: x["end_line"]).alias("ends")).where("size(ends) > 0")
    root = one.select("file_path", "ends", "root.*", F.explode(F.array(*map(F.lit, range(6)))).alias("p"))
    after = edit.insert_line(F.col("p"), F.col("node_type"), F.col("content"), F.col("start_line"), F.col("end_line"), F.lit(3), F.col("ends"), F.array().cast("array<int>"))
    return root.select("file_path", "p", after.cast("int").alias("after"))


# the log ----------------------------------------------------------------------------------------


@query(with_("log", "select id, timestamp, operation from logged where file_path = 'file_46'"))
def txn_file_history(spark, d):
    return temporal.of_file(B.log(spark, d), "file_46").select("id", "timestamp", "operation")


@query(with_("log", f"select id from logged where timestamp >= timestamp '{T0}'"))
def txn_since(spark, d):
    return temporal.since(B.log(spark, d), T0).select("id")


@query(with_("log", f"select id from logged where timestamp between timestamp '{T0}' and timestamp '{T1}'"))
def txn_range(spark, d):
    return temporal.between(B.log(spark, d), T0, T1).select("id")


@query(with_("log", f"select id from logged where session_id = '{S0}'"))
def txn_session(spark, d):
    return temporal.of_session(B.log(spark, d), S0).select("id")


@query(with_("log", "select id, file_path from logged where id = 'txn_77'"))
def txn_by_id(spark, d):
    return temporal.by_id(B.log(spark, d), "txn_77", S0).select("id", "file_path")


@query(with_("log", f"select distinct file_path from changes where timestamp >= timestamp '{T0}'"))
def txn_affected_files(spark, d):
    return temporal.touched_since(B.log(spark, d), T0)


@query(with_("log", f"select distinct file_path from changes where session_id = '{S0}'"))
def txn_session_files(spark, d):
    return temporal.session_files(B.log(spark, d), S0)


@query(with_("log", f"select file_path, count(*) as modifications from changes where timestamp >= timestamp '{T0}' group by 1"))
def txn_changes_since(spark, d):
    return temporal.changes_since(B.log(spark, d), T0)


@query(with_("log", f"select count(*) as n from changes where timestamp >= timestamp '{T0}'"))
def txn_count_since(spark, d):
    return temporal.mutating(temporal.since(B.log(spark, d), T0)).agg(F.count("*").alias("n"))


@query(with_("log", f"select min(timestamp) as start from logged where session_id = '{S0}'"))
def session_start(spark, d):
    return temporal.session_start(B.log(spark, d), S0)


@query(with_("log", f"select file_path, arg_max(id, (timestamp, event_id)) as id, max(timestamp) as timestamp from changes where timestamp < timestamp '{T0}' group by 1"))
def txn_last_before(spark, d):
    return temporal.last_before(B.log(spark, d), T0).select("file_path", "id", "timestamp")


@query(with_("log", f"select file_path, arg_min(id, (timestamp, event_id)) as id, min(timestamp) as timestamp from changes where timestamp > timestamp '{T0}' group by 1"))
def txn_next_after(spark, d):
    return temporal.next_after(B.log(spark, d), T0).select("file_path", "id", "timestamp")


@query(with_("log", "select id, lag(id) over w as previous, lead(id) over w as next from changes window w as (partition by file_path order by timestamp, event_id)"))
def txn_neighbours(spark, d):
    return temporal.with_neighbours(B.log(spark, d)).select("id", F.col("previous.id").alias("previous"), F.col("next.id").alias("next"))


_PLAN = f"""p as (select s.file_path, b.id as target_id, b.after_hash as target_hash, s.n as modifications from (select file_path, count(*) as n from changes where timestamp >= timestamp '{T0}' group by 1) s
  join (select file_path, arg_max(id, (timestamp, event_id)) as id, arg_max(after_hash, (timestamp, event_id)) as after_hash from changes where timestamp < timestamp '{T0}' group by 1) b using (file_path))"""


@query(with_("log", "select * from p").replace("\nselect * from p", f",\n{_PLAN}\nselect * from p"))
def restoration_plan(spark, d):
    return temporal.plan(B.log(spark, d), T0)


@query(with_("log backups", "select content_hash, max_by(backup_path, (timestamp, backup_path)) as backup_path from backups group by 1"))
def backup_newest_by_hash(spark, d):
    return temporal.by_hash(B.backups(B.log(spark, d))).select("content_hash", "backup_path")


@query(with_("log backups", "select c.id, max_by(b.backup_path, (b.original_file_path = c.file_path, b.timestamp, b.backup_path)) as backup_path from changes c left join backups b on b.content_hash = c.after_hash group by 1"))
def backup_by_hash(spark, d):
    log = B.log(spark, d)
    return temporal.snapshot_of(temporal.mutating(log), B.backups(log), "after_hash").select("id", "backup_path")


@query(with_("log backups", "select l.id, coalesce((select min_by(backup_path, (timestamp, backup_path)) from backups b where b.original_file_path = l.file_path and b.timestamp >= l.timestamp), (select max_by(backup_path, (timestamp, backup_path)) from backups b where b.original_file_path = l.file_path and b.timestamp <= l.timestamp)) as backup_path from logged l"))
def backup_asof(spark, d):
    log = B.log(spark, d)
    return temporal.snapshot_asof(log, B.backups(log))


_POINTS = """h as (select content_hash, max_by(backup_path, (timestamp, backup_path)) as path from backups group by 1),
r as (select c.id, c.file_path, h.path as direct, coalesce((select min_by(backup_path, (timestamp, backup_path)) from backups b where b.original_file_path = c.file_path and b.timestamp >= c.timestamp), (select max_by(backup_path, (timestamp, backup_path)) from backups b where b.original_file_path = c.file_path and b.timestamp <= c.timestamp)) as timed from changes c left join h on h.content_hash = c.after_hash)"""


@query(with_("log backups", "X").replace("\nX", f",\n{_POINTS}\nselect id, file_path, coalesce(direct, timed) as backup_path, case when direct is not null then 'hash' when timed is not null then 'timestamp' else 'none' end as method from r"))
def restore_chain(spark, d):
    log = B.log(spark, d)
    return temporal.restore_points(temporal.mutating(log), log, B.backups(log))


@query(with_("log backups", "X").replace("\nX", f",\n{_POINTS},\n{_PLAN}\nselect p.file_path, p.target_id, coalesce(direct, timed) as backup_path, case when direct is not null then 'hash' when timed is not null then 'timestamp' else 'none' end as method, coalesce(direct, timed) is not null as restored from p join r on r.id = p.target_id"))
def restore_project(spark, d):
    log = B.log(spark, d)
    return temporal.execute(log, B.backups(log), T0)


@query(with_("log backups", "X").replace("\nX", f",\n{_POINTS},\n{_PLAN}\nselect count(*) filter (where coalesce(direct, timed) is not null) as restored, count(*) as total, round(case when count(*) = 0 then 1.0 else count(*) filter (where coalesce(direct, timed) is not null) / count(*) end, 4) as success_rate from p join r on r.id = p.target_id"))
def restore_success(spark, d):
    log = B.log(spark, d)
    return temporal.execution_summary(temporal.execute(log, B.backups(log), T0))


@query(with_("log backups", "X").replace("\nX", f",\n{_POINTS}\nselect r.file_path, r.id, coalesce(direct, timed) as backup_path from r join (select file_path, arg_max(id, (timestamp, event_id)) as id from changes where timestamp < timestamp '{T1}' group by 1) b using (file_path, id)"))
def restore_files_before(spark, d):
    """All files by their names."""
    log = B.log(spark, d)
    some = log.select("file_path").distinct()
    return temporal.files_before(log, B.backups(log), some, T1).select("file_path", "id", "backup_path")


@query(with_("log", f"select s.file_path, b.id as target_id, b.after_hash as target_hash from (select distinct file_path from changes where session_id = '{S0}') s join (select file_path, arg_max(id, (timestamp, event_id)) as id, arg_max(after_hash, (timestamp, event_id)) as after_hash from changes where timestamp < (select min(timestamp) from logged where session_id = '{S0}') group by 1) b using (file_path)"))
def restore_session_plan(spark, d):
    return temporal.session_plan(B.log(spark, d), S0)


@query(with_("log backups", "select (select count(*) from backups) as backups, (select count(distinct original_file_path) from backups) as files, (select min(timestamp) from backups) as oldest, (select max(timestamp) from backups) as newest, (select count(*) from logged) as transactions"))
def restoration_stats(spark, d):
    log = B.log(spark, d)
    return temporal.stats(log, B.backups(log))


@query(with_("log", "select id, operation, row_number() over (order by timestamp desc, id desc)::int as place from changes order by timestamp desc, id desc limit 10"))
def undo_stack(spark, d):
    return temporal.undo_stack(B.log(spark, d)).select("id", "operation", "place")


_REPLAY = """Z, steps as (select session_id, list({'k': case when event_id % 5 = 0 then 'undo' when event_id % 7 = 0 then 'redo' when operation in ('Edit', 'Insert', 'Delete') then 'do' else '' end, 'd': 0::bigint, 'r': 0::bigint} order by timestamp, id) as l from logged group by 1)
select session_id, t.d as can_undo, t.r as can_redo from (select session_id, list_reduce(list_prepend({'k': '', 'd': 0::bigint, 'r': 0::bigint}, l), lambda a, x: {'k': x.k, 'd': case when x.k = 'undo' and a.d > 0 then a.d - 1 when (x.k = 'redo' and a.r > 0) or x.k = 'do' then a.d + 1 else a.d end, 'r': case when x.k = 'undo' and a.d > 0 then a.r + 1 when x.k = 'redo' and a.r > 0 then a.r - 1 when x.k = 'do' then 0 else a.r end}) as t from steps)"""


_TOPS = """Z, steps as (select session_id, list({'k': case when event_id % 5 = 0 then 'undo' when event_id % 7 = 0 then 'redo' when operation in ('Edit', 'Insert', 'Delete') then 'do' else '' end, 'd': [id], 'r': []::varchar[]} order by timestamp, id) as l from logged group by 1)
select session_id, t.d[-1] as last_undo, t.r[-1] as last_redo from (select session_id, list_reduce(list_prepend({'k': '', 'd': []::varchar[], 'r': []::varchar[]}, l), lambda a, x: {'k': x.k, 'd': case when x.k = 'undo' then a.d[:-2] when x.k = 'redo' then a.d || a.r[-1:] when x.k = 'do' then a.d || x.d else a.d end, 'r': case when x.k = 'undo' then a.r || a.d[-1:] when x.k = 'redo' then a.r[:-2] when x.k = 'do' then []::varchar[] else a.r end}) as t from steps)"""


@query(with_("log", _TOPS).replace("\nZ, ", ",\n"))
def undo_tops(spark, d):
    """The rows that each session would undo and redo next."""
    log = B.log(spark, d)
    n = F.regexp_extract("id", r"\d+", 0).cast("long")
    told = log.withColumn("description", F.when(n % 5 == 0, "undo").when(n % 7 == 0, "redo").otherwise("edit"))
    return temporal.undo_replay(told).select("session_id", "last_undo", "last_redo")


@query(with_("log", _REPLAY).replace("\nZ, ", ",\n"))
def undo_state(spark, d):
    log = B.log(spark, d)
    n = F.regexp_extract("id", r"\d+", 0).cast("long")
    told = log.withColumn("description", F.when(n % 5 == 0, "undo").when(n % 7 == 0, "redo").otherwise("edit"))
    return temporal.undo_replay(told).select("session_id", "can_undo", "can_redo")


@query(
    with_("log backups", "X").replace(
        "\nX",
        f""",\n{_POINTS}, f as (select c.id, max_by(b.backup_path, (b.original_file_path = c.file_path, b.timestamp, b.backup_path)) as own from changes c left join backups b on b.content_hash = c.before_hash group by 1),
s as (select id, operation, lag(id) over (partition by file_path order by timestamp, event_id) as other from changes)
select s.id, s.operation, coalesce(f.own, case when s.operation <> 'Edit' then coalesce(r.direct, r.timed) end) as backup_path from s join f using (id) left join r on r.id = s.other""",
    )
)
def undo_targets(spark, d):
    log = B.log(spark, d)
    return temporal.undo_targets(log, B.backups(log)).select("id", "operation", "backup_path")


@query(
    with_("log backups", "X").replace(
        "\nX",
        f""",\n{_POINTS}, f as (select c.id, max_by(b.backup_path, (b.original_file_path = c.file_path, b.timestamp, b.backup_path)) as own from changes c left join backups b on b.content_hash = c.after_hash group by 1),
s as (select id, operation, lead(id) over (partition by file_path order by timestamp, event_id) as other from changes)
select s.id, s.operation, coalesce(f.own, case when s.operation <> 'Edit' then coalesce(r.direct, r.timed) end) as backup_path from s join f using (id) left join r on r.id = s.other""",
    )
)
def redo_targets(spark, d):
    log = B.log(spark, d)
    return temporal.undo_targets(log, B.backups(log), redo=True).select("id", "operation", "backup_path")


@query(with_("log", "select id, timestamp from logged order by timestamp desc, id desc limit 20"))
def history_last_n(spark, d):
    return temporal.last_n(B.log(spark, d), 20).select("id", "timestamp")


@query(with_("log", "select id, operation from logged where operation in ('Edit', 'Insert', 'Delete', 'AddProperty', 'AddComponent', 'Move', 'Restore')"))
def reversible_rows(spark, d):
    return temporal.reversible(B.log(spark, d)).select("id", "operation")


@query(with_("log backups", "select backup_path, timestamp from backups"))
def backups_newest(spark, d):
    return stores.newest_first(B.backups(B.log(spark, d))).select("backup_path", "timestamp")


@query(with_("log", "select a.name, coalesce(x.s, a.name) as session_id from (select distinct session_id as name from logged union select 'today') a left join (select 'today' as name, 'session_20240130' as s) x using (name)"))
def session_alias(spark, d):
    names = B.log(spark, d).select(F.col("session_id").alias("name")).distinct().unionByName(spark.createDataFrame([("today",)], "name string"))
    return temporal.resolve_alias(names, spark.createDataFrame([("today", "session_20240130")], "alias string, session_id string"))


@query("select event_id, timestamp '2024-01-01 00:00:00' + to_seconds(event_id) as t from events")
def user_timestamps(spark, d):
    stamp = F.date_format(F.timestamp_seconds(F.col("event_id") + 1704067200), "yyyy-MM-dd HH:mm:ss")
    form = F.when(F.col("event_id") % 2 == 0, stamp).otherwise(F.concat(F.replace(stamp, F.lit(" "), F.lit("T")), F.lit("Z")))
    return B.table(spark, d, "events").select("event_id", text.user_timestamp(form).cast("timestamp_ntz").alias("t"))


# side stores ------------------------------------------------------------------------------------


@query(with_("journal", "select conv_id, turn, actor, entry_type from journal order by conv_id desc, turn desc limit 25"))
def journal_recent(spark, d):
    return side.recent(B.journal(spark, d), 25, ["conv_id", "turn"]).select("conv_id", "turn", "actor", "entry_type")


@query(with_("journal log", "select j.conv_id, j.turn, l.operation, l.file_path from journal j join logged l on l.id = j.transaction_id"))
def journal_report(spark, d):
    return side.with_transactions(side.reported(B.journal(spark, d)), B.log(spark, d)).select("conv_id", "turn", "operation", "file_path")


@query(with_("journal log", "select row_number() over (order by conv_id desc, turn desc)::int as place, '- **' || entry_type || '** ' || actor || ': ' || message || ' (' || operation || ' of `' || l.file_path || '`)' as line from journal j join logged l on l.id = j.transaction_id order by conv_id desc, turn desc limit 50"))
def engineering_report(spark, d):
    return side.report(B.journal(spark, d), B.log(spark, d), ["conv_id", "turn"])


@query(with_("journal", "select conv_id, turn from journal where transaction_id = 'txn_8' limit 1"))
def journal_by_txn(spark, d):
    return side.of_transaction(B.journal(spark, d), "txn_8").select("conv_id", "turn")


@query(with_("files", "select f.file_path, coalesce(array_to_string(['quality:' || quality, 'toxic:' || toxic], ','), '') as labels from files f left join labels l using (doc_id)"))
def labels_join(spark, d):
    known = B.labels(spark, d).withColumn("content_hash", F.lit(""))
    return side.labels_of(B.files(spark, d).withColumn("content_hash", F.lit("")), known).select("file_path", F.array_join("labels", ",").alias("labels"))


@query("select 'doc/' || doc_id || '.txt' as file_path, array_to_string(list_sort(['quality:' || quality, 'toxic:' || toxic, 'new']), ',') as labels from labels")
def labels_add(spark, d):
    known = B.labels(spark, d).withColumn("content_hash", F.lit(""))
    new = known.select("file_path", "content_hash", F.array(F.lit("new"), F.lit("new")).alias("labels"))
    return side.add_labels(known, new).select("file_path", F.array_join("labels", ",").alias("labels"))


@query("select 'doc/' || doc_id || '.txt' as file_path, case when toxic = 0 then 'quality:' || quality else 'quality:' || quality || ',toxic:1' end as labels from labels")
def labels_remove(spark, d):
    return side.remove_label(B.labels(spark, d), "toxic:0").select("file_path", F.array_join("labels", ",").alias("labels"))


def _tags(spark, d):
    return B.files(spark, d).select("file_path", F.lit("top").alias("name"), F.lit("0").alias("node_path"))


@query(with_("files", "select file_path, 'tag:top' as path, '0' as node_path from files union all select file_path, 'tag:none', null from files"))
def tag_resolve(spark, d):
    f = B.files(spark, d).select("file_path")
    asked = f.withColumn("path", F.lit("tag:top")).unionByName(f.withColumn("path", F.lit("tag:none")))
    return side.resolve_tags(asked, _tags(spark, d))


@query(with_("files", "select file_path, 'top' as name, '0' as node_path from files union all select file_path, 'end', '9' from files order by file_path, name"))
def tag_upsert(spark, d):
    t = _tags(spark, d)
    new = t.withColumn("node_path", F.lit("5")).unionByName(t.withColumn("name", F.lit("end")).withColumn("node_path", F.lit("9")))
    return side.list_tags(side.add_tags(t, new))


@query(with_("files", "select file_path, case when file_path = 'doc/1.txt' then 'head' else 'top' end as name from files where file_path <> 'doc/2.txt'"))
def tag_rename_remove(spark, d):
    t = side.rename_tag(_tags(spark, d), "doc/1.txt", "top", "head")
    return side.remove_tags(t, spark.createDataFrame([("doc/2.txt", "top")], "file_path string, name string")).select("file_path", "name")


# references -------------------------------------------------------------------------------------


@query(with_("definitions", "select name, file_path, row_number() over (partition by name order by file_path)::int as place from (select distinct name, file_path from definitions)"))
def symbol_table(spark, d):
    return code.symbol_table(B.definitions(spark, d))


@query(with_("calls definitions", "select distinct from_file, from_path, f.to_file, to_name, 'Call' as relation_type from calls left join (select name as to_name, min(file_path) as to_file from definitions group by 1) f using (to_name)"))
def relation_resolve(spark, d):
    return code.resolve(B.calls(spark, d), B.definitions(spark, d))


@query(with_("calls", "select distinct from_file, from_path from calls where to_name = 'part_7'"))
def impact_callers(spark, d):
    return code.impact_callers(code.resolve(B.calls(spark, d), B.definitions(spark, d)), "part_7")


@query(with_("calls", "select to_name, from_file, count(distinct from_path) as callers, min(from_path) as first_path from calls group by 1, 2"))
def callers_by_file(spark, d):
    return code.callers_by_file(B.calls(spark, d).withColumn("relation_type", F.lit("Call")))


@query(with_("calls", "select to_name, callers, files, round(risk, 4) as risk, case when risk < 0.2 then 'Low' when risk < 0.5 then 'Medium' when risk < 0.8 then 'High' else 'Critical' end as impact from (select to_name, count(*) as callers, count(distinct from_file) as files, (2.0 * count(*) + 1.5 * count(distinct from_file)) / 10.0 as risk from calls group by 1)"))
def blast_radius(spark, d):
    c = B.calls(spark, d).groupBy("to_name").agg(F.count("*").alias("callers"), F.count_distinct("from_file").alias("files"))
    r = scores.risk(F.col("callers"), F.lit(0), F.col("files"))
    return c.select("to_name", "callers", "files", F.round(r, 4).alias("risk"), scores.impact(r).alias("impact"))


@query("select 'doc/' || doc_id || '.txt' as file_path, '_doc_' || doc_id as name from documents where doc_id not in (select doc_id from labels)")
def orphans(spark, d):
    """A private function for each document, called by each label of it."""
    name = F.format_string("_doc_%d", "doc_id")
    node = lambda t, kind: B.table(spark, d, t).select(F.format_string("doc/%d.txt", "doc_id").alias("file_path"), F.lit(0).alias("seq"), F.lit("0").alias("path"), F.lit(kind).alias("node_type"), name.alias("name"), name.alias("content"), F.lit(1).alias("start_line"))
    return code.orphans(node("documents", "function_item").unionByName(node("labels", "call_expression"))).select("file_path", "name")


@query(with_("supplier_files", "select regexp_replace(file_path, '/[^/]*$', '') as folder, string_agg(split_part(file_path, '/', 3), ',' order by split_part(file_path, '/', 3)) as files from supplier_files group by 1"))
def blueprint_clusters(spark, d):
    return code.clusters(B.supplier_files(spark, d)).select("folder", F.array_join("files", ",").alias("files"))


@query(with_("calls definitions", "select distinct from_file, f.to_file from calls join (select name as to_name, min(file_path) as to_file from definitions group by 1) f using (to_name)"))
def blueprint_connections(spark, d):
    return code.connections(code.resolve(B.calls(spark, d), B.definitions(spark, d)))


@query("select 'src/part_' || p_partkey || '.rs' as edited, 'tests/test_part_' || p_partkey || '.rs' as test from part union all select 'src/part_' || p_partkey || '.rs', 'part_' || p_partkey || '_test.py' from part where p_size > 25")
def related_tests(spark, d):
    p = B.table(spark, d, "part").select(F.format_string("part_%d", "p_partkey").alias("s"), "p_size")
    tests = p.select(F.concat(F.lit("tests/test_"), "s", F.lit(".rs")).alias("file_path"))
    more = p.where("p_size > 25").select(F.concat("s", F.lit("_test.py")).alias("file_path"))
    return code.related_tests(tests.unionByName(more), p.select(F.concat(F.lit("src/"), "s", F.lit(".rs")).alias("file_path")))


@query("select distinct p_brand as name, 'Brand#1' as target from part where contains(p_brand, 'Brand#1')")
def fuzzy_targets(spark, d):
    names = B.table(spark, d, "part").select(F.col("p_brand").alias("name")).distinct()
    return code.fuzzy_match(names, spark.createDataFrame([("Brand#1",)], "target string"))


def _code(spark, d):
    return treestore.nodes(B.code(spark, d))


@query(with_("functions", "select f.file_path, f.name as from_name, g.name as to_name, 'calls' as edge from functions f join functions g on g.k = f.k and g.i = f.i - 1"))
def call_graph(spark, d):
    return code.call_graph(_code(spark, d))[1].select("file_path", "from_name", "to_name", "edge")


@query(with_("functions", "select file_path, name as in_function, kind from functions, (select unnest(['call', 'reference']) as kind) where i = 1"))
def callers_project(spark, d):
    return code.callers(_code(spark, d), "noop").select("file_path", "in_function", "kind")


_ONE = "src/o1.rs"


@query(with_("orders_", "select callers, 1::bigint as callees, files, round((2.0 * callers + 0.5 + 1.5 * files) / 10, 4) as risk, 'Critical' as impact from (select 2 * count(*) as callers, count(*) - 1 as files from orders_)"))
def blast_project(spark, d):
    return code.blast(_code(spark, d), _ONE, "2", "noop")


@query(with_("functions", f"select 'caller' as kind, file_path, name from functions, range(2) where i = 1 union all select 'callee', '{_ONE}', 'noop' union all select 'file', file_path, null from functions where i = 1 and file_path <> '{_ONE}'"))
def blast_report(spark, d):
    return code.blast_lists(_code(spark, d), _ONE, "2", "noop").select("kind", "file_path", "name")


@query(with_("functions", "select file_path, name from functions where i = n and k % 3 = 0"))
def inspect_orphans(spark, d):
    return code.inspect(_code(spark, d), "orphans").select("file_path", "name")


@query(with_("orders_", "select 'src/o' || k || '.rs' as file_path, n::bigint as functions, (k % 5 = 0)::bigint as large, case when k % 5 = 0 then 63 else 3 end as longest, (k % 3 = 0)::bigint as orphans from orders_"))
def inspect_metrics(spark, d):
    return code.inspect(_code(spark, d), "full").select("file_path", "functions", "large", "longest", "orphans")


@query(with_("orders_", "select 'src/o' || k || '.rs' as file_path, 1::bigint as structs, 0::bigint as implementations, 1::bigint as uses from orders_"))
def inspect_relations(spark, d):
    return code.inspect(_code(spark, d), "relations")


@query(with_("functions", "select file_path, 'call' as role from functions where i = 1"))
def inspect_callers(spark, d):
    return code.inspect(_code(spark, d), "callers", "noop").select("file_path", "role")


@query(with_("functions", "select file_path, name, i + 1 as place from functions where name not in (select callee from functions g where g.file_path = functions.file_path)"))
def uncalled(spark, d):
    n = _code(spark, d)
    return code.uncalled(n).join(n.select("file_path", "seq", "path"), ["file_path", "seq"]).select("file_path", "name", F.col("path").cast("int").alias("place"))


@query(with_("orders_", "select 'src/o' || k || '.rs' as file_path, (n + 2)::bigint as nodes, (n - 1)::bigint as edges, 1::bigint as orphans from orders_"))
def graph_summary(spark, d):
    return code.graph_summary(*code.call_graph(_code(spark, d)))


#: The points of each file in order, with the ids that graph languages get; the calls of each file in order.
_POINTS = """points as materialized (
  select file_path, 0 as seq, 'use:use_core_o' || k || ';' as id, 'use core::o' || k || ';' as name, 'use_declaration' as type, 1 as line from (select distinct k, file_path from functions)
  union all select file_path, 1, '1:S' || k, 'S' || k, 'struct_item', 2 from (select distinct k, file_path from functions)
  union all select file_path, i + 1, (i + 1) || ':' || name, name, 'function_item', case when i = 1 then 3 else 3 * i + case when k % 5 = 0 then 60 else 0 end end from functions),
edges as materialized (select file_path, i, (i + 1) || ':' || name as from_id, i || ':' || lag as to_id, name as from_name, lag as to_name from (select *, lag(name) over (partition by k order by i) as lag from functions) where i > 1),
drawn as (select file_path, string_agg({}, chr(10) order by seq) as p from points group by 1), called as (select file_path, string_agg({}, chr(10) order by i) as e from edges group by 1)"""
_FRAME = "━" * 35


def _drawn(head: str, point: str, edge: str, tail: str) -> str:
    return with_("functions", f"Z, {_POINTS.format(point, edge)} select file_path, {head} || p || {tail} as text from drawn join called using (file_path)").replace("\nZ, ", ",\n")


_NODE_ID, _FROM_ID, _TO_ID = ("translate({}, ':.', '__')".format(c) for c in ("id", "from_id", "to_id"))


@query(_drawn("'```mermaid' || chr(10) || 'flowchart LR' || chr(10)", f"'    ' || {_NODE_ID} || '(\"' || name || '\")'", f"'    ' || {_FROM_ID} || ' --> ' || {_TO_ID}", "chr(10) || e || chr(10) || '```' || chr(10)"))
def graph_mermaid(spark, d):
    return code.render_graph(*code.call_graph(_code(spark, d)))


@query(_drawn("'digraph G {' || chr(10) || '    rankdir=LR;' || chr(10) || '    node [shape=box];' || chr(10)", f"'    \"' || {_NODE_ID} || '\" [label=\"' || name || '\"];'", f"'    \"' || {_FROM_ID} || '\" -> \"' || {_TO_ID} || '\";'", "chr(10) || e || chr(10) || '}' || chr(10)"))
def graph_dot(spark, d):
    return code.render_graph(*code.call_graph(_code(spark, d)), "dot")


@query(
    _drawn(
        f"chr(10) || '🌳 CODE TREE' || chr(10) || '{_FRAME}' || chr(10) || chr(10) || '📦 Structs/Impls:' || chr(10)",
        # no path but those of ten and more begins with that of the type, 1, as a string
        "case when type = 'struct_item' then '  📦 ' || name || chr(10) || chr(10) || '🔧 Functions:' when type = 'function_item' then '  🔧 ' || name || '()' || coalesce((select chr(10) || '      → ' || to_name from edges x where x.file_path = points.file_path and x.from_id = points.id), '') end",
        "''", f"chr(10) || '{_FRAME}' || chr(10)",
    )
)
def graph_tree(spark, d):
    return code.render_graph(*code.call_graph(_code(spark, d)), "tree")


@query(
    _drawn(
        f"chr(10) || '🔗 CODE RELATION GRAPH' || chr(10) || '{_FRAME}' || chr(10) || 'File: ' || file_path || chr(10) || '📊 ' || (select (n + 2) || ' nodes, ' || (n - 1) || ' edges, 1 orphans' from functions f where f.file_path = drawn.file_path limit 1) || chr(10) || chr(10) || '📦 NODES (functions, structs, etc.):' || chr(10)",
        "case when seq <> 2 and type = 'function_item' then '' else '  [' || case when type = 'function_item' then (select max(n) from functions f where f.file_path = points.file_path) else 1 end || '] ' || type || chr(10) end || '    • ' || name || ' @ ' || line",
        "'  ' || from_name || ' → ' || to_name || ' [calls]'", f"chr(10) || chr(10) || '🔗 CALL RELATIONS:' || chr(10) || e || chr(10) || '{_FRAME}' || chr(10)",
    )
)
def graph_text(spark, d):
    return code.render_graph(*code.call_graph(_code(spark, d)), "text")


@query(with_("functions", "select f.file_path as from_file, (f.i + 1) || '.1.0' as from_path, g.to_file, f.callee as to_name from functions f left join (select name, min(file_path) as to_file from functions group by 1) g on g.name = f.callee"))
def relation_index(spark, d):
    return code.relation_index(_code(spark, d)).select("from_file", "from_path", "to_file", "to_name")


@query(with_("functions", f"select 'caller' as kind, file_path as file from functions where i = 1 and file_path <> '{_ONE}' union all select 'test', 'test_o1.rs'"))
def pulse(spark, d):
    f = B.code(spark, d)
    tests = f.where(F.col("file_path") == _ONE).select(F.lit("test_o1.rs").alias("file_path"))
    return code.pulse(code.relation_index(treestore.nodes(f)), f.select("file_path").unionByName(tests), _ONE, "noop").select("kind", "file")


@query(with_("functions", "select file_path, count(*) + 1 as definitions from functions group by 1"))
def definition_filter(spark, d):
    return code.definitions(_code(spark, d)).groupBy("file_path").agg(F.count("*").alias("definitions"))


@query(with_("orders_", "select k, kind, kind || ': f' || (k % 97) || '_1' as new from orders_, (select unnest(['extract', 'move', 'inline', 'change_signature']) as kind)"))
def refactor_reports(spark, d):
    kinds = ["extract", "move", "inline", "change_signature"]
    found = compare.refactors(_code(spark, d), kinds, "2")
    return found.select(F.regexp_extract("file_path", r"\d+", 0).cast("long").alias("k"), "kind", "new")


@query("select (select count(*) from orders) as files, (select count(*) from orders where o_orderkey % 4 = 0) as issues")
def lint(spark, d):
    bad = F.when(F.col("k") % 4 == 0, F.format_string("def f%d(:\n", "k")).otherwise(F.format_string("def f%d():\n    pass\n", "k"))
    return find.lint_totals(source.nodes(B.orders(spark, d).select(F.format_string("o%d.py", "k").alias("file_path"), bad.alias("content"))))


@query("select 'o' || o_orderkey || '.py' as file_path, true as located from orders where o_orderkey % 4 = 0")
def lint_files(spark, d):
    bad = F.when(F.col("k") % 4 == 0, F.format_string("def f%d(:\n", "k")).otherwise(F.format_string("def f%d():\n    pass\n", "k"))
    n = source.nodes(B.orders(spark, d).select(F.format_string("o%d.py", "k").alias("file_path"), bad.alias("content")))
    return find.failed(n).select("file_path", F.col("error").contains("line 1").alias("located"))


@query("select 25::bigint as pass, 0::bigint as fail, 0::bigint as warn, true as healthy")
def doctor(spark, d):
    """Twenty parsers, the three newest snapshots of all documents, and the log."""
    kept = stores.snapshot(B.files(spark, d), F.to_timestamp(F.lit(T0)))
    return health.doctor(health.parser_checks(spark).unionByName(health.backup_checks(kept)).unionByName(health.log_checks(B.log(spark, d))))


@query(with_("log", "select id, operation from changes"))
def history_export(spark, d):
    log = temporal.mutating(B.log(spark, d))
    out = stores.export_history(log.withColumn("metadata", F.create_map().cast("map<string,string>")))
    return out.select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.operation").alias("operation"))


@query("select '| r_name |' || chr(10) || '|---|' || chr(10) || string_agg('| ' || r_name || ' |', chr(10) order by r_regionkey) as value from region")
def table_output(spark, d):
    return output.as_table(B.table(spark, d, "region"), ["r_name"], ["r_regionkey"])


# parsers on generated texts ---------------------------------------------------------------------


def _parsed(spark, d, ext: str, content) -> DataFrame:
    """The trees of a text of each part, by its key and size."""
    p = B.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("int").alias("z"))
    n = treestore.nodes(p.select(F.format_string(f"%d.{ext}", "k").alias("file_path"), content.alias("content")))
    return n.withColumn("k", F.substring_index("file_path", ".", 1).cast("long"))


def _all_parsed(spark, d, texts: dict[str, str]) -> DataFrame:
    """The trees of a text of each extension for each part, by the part's key: all are kept by one run of the store."""
    p = B.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"))
    each = p.select("k", F.explode(F.create_map(*(c for ext, text_ in texts.items() for c in (F.lit(ext), F.format_string(text_, "k"))))).alias("ext", "content"))
    n = treestore.nodes(each.select(F.concat_ws(".", F.col("k").cast("string"), "ext").alias("file_path"), "content"))
    return n.withColumn("k", F.substring_index("file_path", ".", 1).cast("long"))


def _of_parts(columns: str, rows: str) -> str:
    """A row of each part for each of some values, in which k and z are its key and size."""
    names = columns.replace(" ", "").split(",")
    return f"select k, {', '.join('t.' + c for c in names)} from (select p_partkey::bigint as k, p_size::int as z from part), lateral (select * from (values {rows}) v({columns})) t"


@query(_of_parts("seq, node_type, path, content", "(0, 'stylesheet', '', ''), (1, 'rule', '0', ' .p' || k || ' { size: ' || z || '; }'), (2, 'selector', '0.selector', '.p' || k), (3, 'declarations', '0.declarations', ''), (4, 'declaration', '0.declarations.0', 'size: ' || z || ';'), (5, 'property', '0.declarations.0.property', 'size'), (6, 'value', '0.declarations.0.value', z::varchar)"))
def css_nodes(spark, d):
    return _parsed(spark, d, "css", F.format_string("/* c */ .p%d { size: %d; }", "k", "z")).select("k", "seq", "node_type", "path", "content")


@query(_of_parts("seq, node_type, content", "(0, 'document', ''), (1, 'element', '<r a=\"' || k || '\">t' || z || '<b/></r>'), (2, 'attributes', ''), (3, 'name', 'a'), (4, 'value', k::varchar), (5, 'text', 't' || z), (6, 'element', '<b/>')"))
def xml_nodes(spark, d):
    return _parsed(spark, d, "xml", F.format_string('<r a="%d">t%d<b/></r>', "k", "z")).select("k", "seq", "node_type", "content")


@query(_of_parts("path, node_type, content", "('', 'table', ''), ('a', 'integer', k::varchar), ('s', 'table', ''), ('s.x', 'array', ''), ('s.x.0', 'float', z || '.5'), ('s.b', 'boolean', 'true'), ('s.d', 'datetime', '2024-01-01')"))
def toml_nodes(spark, d):
    return _parsed(spark, d, "toml", F.format_string("a = %d\n[s]\nx = [%d.5]\nb = true\nd = 2024-01-01\n", "k", "z")).select("k", "path", "node_type", "content")


@query(_of_parts("path, node_type, content", "('', 'mapping', ''), ('a', 'sequence', ''), ('a.0', 'number', k::varchar), ('a.1', 'string', 'x' || z), ('b', 'null', 'null'), ('c', 'tagged', '!t v' || k)"))
def yaml_nodes(spark, d):
    return _parsed(spark, d, "yaml", F.format_string("a: [%d, x%d]\nb: null\nc: !t v%d\n", "k", "z", "k")).select("k", "path", "node_type", "content")


@query(_of_parts("node_type, name, start_line, end_line", "('class_definition', 'A' || k, 1, z + 3), ('function_definition', 'm', z + 2, z + 3)"))
def python_nodes(spark, d):
    text_ = F.concat(F.format_string("class A%d:\n", "k"), F.repeat(F.lit("\n"), F.col("z")), F.format_string("    def m(self):\n        return g(%d)\n", "k"))
    return _parsed(spark, d, "py", text_).where("node_type like '%_definition'").select("k", "node_type", "name", "start_line", "end_line")


@query(_of_parts("node_type, name, start_line", "('use_declaration', 'a', 1), ('struct_item', 'S' || k, 2), ('function_item', 'f' || k, z + 3), ('call_expression', 'g', z + 3)"))
def rust_nodes(spark, d):
    text_ = F.concat(F.format_string("use a::b;\nstruct S%d { v: i32 }\n", "k"), F.repeat(F.lit("\n"), F.col("z")), F.format_string("fn f%d() { g(1); }\n", "k"))
    return _parsed(spark, d, "rs", text_).where("node_type in ('use_declaration', 'struct_item', 'function_item', 'call_expression')").select("k", "node_type", "name", "start_line")


@query(_of_parts("node_type, content", "('keyword_select', 'SELECT'), ('identifier', 'a' || k), ('keyword_from', 'FROM'), ('identifier', 't'), ('number', z::varchar)"))
def sql_nodes(spark, d):
    return _parsed(spark, d, "sql", F.format_string("SELECT a%d FROM t; %d", "k", "z")).where("depth = 2").select("k", "node_type", "content")


@query(_of_parts("node_type, content", "('heading_1', 'T' || k), ('level', '1'), ('paragraph', 'a **b' || z || '** c'), ('text', 'a '), ('bold', 'b' || z), ('text', ' c'), ('list_unordered', ''), ('list_item', 'x'), ('text', 'x'), ('text', 'x'), ('code_block', 'y' || k), ('language', 'py'), ('block_quote', 'q'), ('horizontal_rule', '---')"))
def markdown_small(spark, d):
    return _parsed(spark, d, "md", F.format_string("# T%d\n\na **b%d** c\n\n- x\n\n```py\ny%d\n```\n> q\n\n---\n", "k", "z", "k")).where("depth > 0").select("k", "node_type", "content")


@query(_of_parts("node_type, ordinal, content", "('json_object', 0, '{\"k\": ' || k || '}'), ('json_key', 0, 'k'), ('json_number', 1, k::varchar)"))
def macro_nodes(spark, d):
    return _parsed(spark, d, "rs", F.format_string('fn f() { json!({"k": %d}) }', "k")).where("node_type like 'json_%'").select("k", "ordinal", "node_type", "content")


#: A text of each further language, with a name in it, and the types and names that its tree has of items and calls.
_LANGUAGES = {
    "ts": ("class C%d { m() { g(1); } }", [("class_declaration", "C"), ("method_declaration", "m"), ("call_expression", "g")]),
    "js": ("function f%d() { g(1); }", [("function_declaration", "f"), ("call_expression", "g")]),
    "go": ("package main\nfunc f%d() { g(1) }", [("function_declaration", "f"), ("call_expression", "g")]),
    "java": ("class C%d { void m() { g(1); } }", [("class_declaration", "C"), ("method_declaration", "m"), ("call_expression", "g")]),
    "c": ("int f%d(void) { return g(1); }", [("function_declaration", "f"), ("call_expression", "g")]),
    "cpp": ("namespace n%d { int f() { return g(1); } }", [("namespace_definition", "n"), ("method_declaration", "f"), ("call_expression", "g")]),
    "cs": ("class C%d { void m() { g(1); } }", [("class_declaration", "C"), ("method_declaration", "m"), ("call_expression", "g")]),
    "kt": ("fun f%d() { g(1) }", [("function_declaration", "f"), ("call_expression", "g")]),
    "swift": ("func f%d() { g(1) }", [("function_declaration", "f"), ("call_expression", "g")]),
    "php": ("<?php function f%d() { g(1); }", [("function_declaration", "f"), ("call_expression", "g")]),
    "dart": ("void f%d() { g(1); }", [("function_declaration", "f"), ("call_expression", "g")]),
    "zig": ("pub fn f%d() void { g(1); }", [("function_declaration", "f"), ("call_expression", "g")]),
    "slint": ("component C%d { r: g(1); }", [("component_definition", "C"), ("call_expression", "g")]),
    "sh": ("f%d() {\n  if g 1; then\n    h\n  fi\n}", [("function_definition", "f"), ("if_statement", "g"), ("command", "g"), ("command", "h")]),
    "qml": ("Item {\n  property int p%d: 1\n  width: 2\n  Text { text: 'a' }\n}", [("ui_object", "Item"), ("ui_property", "p"), ("ui_binding", "width"), ("ui_object", "Text"), ("ui_binding", "text")]),
}
_LANGUAGE_ROWS = ", ".join(f"('{ext}', '{kind}', {'null' if name is None else repr(name)}{' || k' if name and '%d' in text_ and (name + '%d') in text_ else ''})" for ext, (text_, found) in _LANGUAGES.items() for kind, name in found)


@query(_of_parts("ext, node_type, name", _LANGUAGE_ROWS))
def language_nodes(spark, d):
    """Items and calls of fifteen more languages."""
    kinds = sorted({kind for _, found in _LANGUAGES.values() for kind, _ in found})
    n = _all_parsed(spark, d, {ext: text_ for ext, (text_, _) in _LANGUAGES.items()})
    return n.where(F.col("node_type").isin(*kinds)).select("k", "ext", "node_type", "name")


@query("select s_suppkey as k, name, nodes, failed from supplier, (values ('a.py', 4::bigint, false), ('b.json', 2::bigint, false), ('c.py', 1::bigint, true), ('d.xyz', 1::bigint, false)) t(name, nodes, failed)")
def analyze_tolerant(spark, d):
    """Files and folders together, among them one that does not parse: an error is a row and not the end."""
    root = B.scratch(spark, "analyze")
    texts = {"sub/a.py": "x = 1\n", "sub/b.json": '{"a": 1}', "c.py": "def f(:\n", "d.xyz": "?"}
    given = F.explode(F.create_map(*(F.lit(x) for kv in texts.items() for x in kv)))
    f = B.table(spark, d, "supplier").select("s_suppkey", given.alias("name", "content"))
    at = F.concat(F.lit(f"{root}/"), F.when(F.col("name").startswith("sub/"), "tree/").otherwise(""), F.col("s_suppkey").cast("string"), F.lit("/"), "name")
    stores.write_sources(f.select(at.alias("file_path"), "content"), f"{root}/staged")
    files = source.project(spark, [f"{root}/tree", root], source.Rule((), ("tree", "staged"))).where(F.col("ext").isin("py", "json", "xyz")).select("file_path", "content")
    n = source.nodes(files).groupBy("file_path").agg(F.count("*").alias("nodes"), F.bool_or(F.col("error").isNotNull()).alias("failed"))
    return n.select(F.regexp_extract("file_path", r"/(\d+)/", 1).cast("long").alias("k"), F.substring_index("file_path", "/", -1).alias("name"), "nodes", "failed")


@query("select 'label_' || label as file_path, vec_id::varchar as node_path, md5('fn f' || vec_id || '()') as preview, list_sum(list_transform(embedding, lambda x: (x * 1000)::bigint))::bigint as total from embeddings")
def embedding_arrays(spark, d):
    """An index of JSON arrays, one file for each label, written and read again; a file that is no array is passed over."""
    root = B.scratch(spark, "arrays")
    stores.write_embedding_arrays(B.vectors(spark, d).select(*schema.EMBEDDINGS.names), f"{root}/index", f"{root}/staged")
    stores.write_sources(spark.createDataFrame([(f"{root}/index/none.json", '{"vector": []}'), (f"{root}/index/text.txt", "[]")], "file_path string, content string"), f"{root}/more")
    total = F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + F.bround(x.cast("float") * F.lit(1000).cast("float")).cast("long"))
    return stores.read_embedding_arrays(spark, f"{root}/index").select("file_path", "node_path", _digest(F.col("content_preview")).alias("preview"), total.alias("total"))


@query("select 'embeddings' as name, max(len(embedding))::int as dimensions from embeddings")
def model_info(spark, d):
    """What the vectors were made by, written and read again."""
    root = B.scratch(spark, "model")
    stores.write_model(spark, f"{root}/model", "embeddings", B.table(spark, d, "embeddings").agg(F.max(F.size("embedding"))).first()[0])
    return stores.read_model(spark, f"{root}/model").select("name", "dimensions")


@query("select n_nationkey as k, 'pub mod m' || n_nationkey || ' {' || chr(10) || '    pub struct ' || n_name || ' {' || chr(10) || '        // TODO: Add fields' || chr(10) || '    }' || chr(10) || chr(10) || '    pub fn f() {' || chr(10) || '        unimplemented!()' || chr(10) || '    }' || chr(10) || chr(10) || '}' || chr(10) as code, false as failed from nation where n_regionkey > 0 union all select n_nationkey, null, true from nation where n_regionkey = 0")
def scaffolded(spark, d):
    """Code of a plan of each nation; those of one region name no language."""
    n = B.table(spark, d, "nation")
    plan = F.concat(F.when(F.col("n_regionkey") > 0, "rust:").otherwise("cobol:"), F.lit("mod(name:m"), F.col("n_nationkey").cast("string"), F.lit(", children:[struct:"), "n_name", F.lit("(), fn:f()])"))
    made = output.scaffolds(n.select(F.col("n_nationkey").alias("k"), plan.alias("plan")), "k")
    return made.select("k", "code", F.col("error").isNotNull().alias("failed"))


@query(with_("log", "select session_id, count(*) as rows, count(*) filter (where event_id % 3 = 0) as tagged, max(event_id % 7) as most from logged group by 1"))
def metadata_maps(spark, d):
    """Log rows with maps of metadata, written, read again and asked by their keys."""
    root = B.scratch(spark, "metadata")
    n = F.regexp_extract("id", r"\d+", 0).cast("long")
    maps = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("seven").alias("k"), (n % 7).cast("string").alias("v")), F.when(n % 3 == 0, F.struct(F.lit("tag").alias("k"), F.lit("three").alias("v"))))))
    stores.append_log(B.log(spark, d).withColumn("metadata", maps), f"{root}/log")
    log = stores.read_log(spark, f"{root}/log")
    return log.groupBy("session_id").agg(F.count("*").alias("rows"), F.count_if(F.col("metadata")["tag"] == "three").alias("tagged"), F.max(F.col("metadata")["seven"].cast("long")).alias("most"))


@query("select p_partkey::bigint as k, section, place, replace(line, '{}', p_partkey::varchar) as line from part, (values ('lines', 0, '3'), ('lines', 1, '4'), ('sparkline', 0, 'DNA: [ ██] (Complexity: 1)'), ('tree', 0, '     [object]'), ('tree', 1, '  [+] a [number]'), ('tree', 2, '      b [number]')) t(section, place, line)")
def edit_pulse(spark, d):
    """What an edit of a JSON text of each part shows: line counts, sparkline and the tree around it."""
    p = B.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.format_string("%d.json", "p_partkey").alias("file_path"))
    tree_of = lambda form: treestore.nodes(p.select("file_path", F.format_string(form, "k").alias("content")))
    before, after = tree_of('{"a": %d,\n"b": 2\n}'), tree_of('{"a":\n %d,\n"b": 3\n}')
    return tree.pulse_views(before, after, "a").select(F.substring_index("file_path", ".", 1).cast("long").alias("k"), "section", "place", "line")


@query("select p_partkey::bigint as k, 'Item {' || chr(10) || '    width: 2' || chr(10) || '    Text {}' || chr(10) || '    Part' || p_partkey || ' {}' || chr(10) || '}' as after from part")
def add_component(spark, d):
    """A component put in at the end of an object of each part."""
    p = B.table(spark, d, "part").select(F.format_string("%d.qml", "p_partkey").alias("file"), F.lit(0).alias("position"), F.lit("AddComponent").alias("intent"), F.lit("root.0").alias("path"), F.format_string("Part%d {}", "p_partkey").alias("content"), F.lit("Item {\n    width: 2\n    Text {}\n}").alias("text"))
    done = edit.apply_batch(p.select(F.col("file").alias("file_path"), F.col("text").alias("content")), edit.intent_ops(p))
    return done.select(F.substring_index("file_path", ".", 1).cast("long").alias("k"), "after")


@query(with_("log", "Z, days as (select distinct session_id, (strptime(session_id[9:], '%Y%m%d') + interval 1 day)::timestamp as at from logged), open as (select d.session_id as s, (select arg_max(l.session_id, (l.timestamp, l.event_id)) from logged l where l.timestamp < d.at) as last, (select arg_max(l.operation, (l.timestamp, l.event_id)) from logged l where l.timestamp < d.at) as op from days d), started as (select 'new_' || session_id as id from days) select 'start' as kind, id as session_id, null as alias from started union all select 'alias', id, 'after ' || id[5:] from started union all select 'end', last, null from open where op <> 'SessionEnd'").replace("\nZ, ", ",\n"))
def session_starts(spark, d):
    """A session started after each day's: the end of the one that is open then, its start and its alias."""
    log = B.log(spark, d)
    named = log.select("session_id").distinct().select(F.concat(F.lit("after "), "session_id").alias("alias"), F.concat(F.lit("new_"), "session_id").alias("session_id"), (F.to_timestamp(F.substring("session_id", 9, 8), "yyyyMMdd") + F.expr("interval 1 day")).alias("at"))
    rows, aliases = temporal.begin_sessions(log, named)
    none = F.lit(None).cast("string")
    kind = F.when(F.col("operation") == "SessionStart", "start").otherwise("end").alias("kind")
    return rows.select(kind, "session_id", none.alias("alias")).unionByName(aliases.select(F.lit("alias").alias("kind"), "session_id", "alias"))


@query(with_("functions", "select file_path, 'Delete' as kind, case when i = 1 then 'fn ' || name || '() {' when i = 2 then 'noop();' else '}' end as detail from (select file_path, name, k, unnest([1, 2, 3]) as i from functions where i = 1 and k % 5 <> 0) union all select file_path, 'Insert', 'fn gone() {}' from functions where i = 1 and k % 5 <> 0 union all select distinct e.file_path, 'caller', c.file_path from functions e join functions c on c.callee = e.name and c.file_path <> e.file_path where e.i = 1 and e.k % 5 <> 0"))
def edit_reports(spark, d):
    """The first function of each short file replaced: its change, and the files elsewhere that call it."""
    f = B.code(spark, d)
    op = F.struct(F.lit("edit").alias("type"), F.lit("2").alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit(None).cast("int").alias("position"), F.lit("fn gone() {}").alias("content"))
    ops = edit.batch_of(f.where(~F.col("content").contains("\n\n\n")).select("file_path", F.array(op).alias("operations")))
    made = edit.edit_report(f, ops, code.relation_index(treestore.nodes(f)))
    return made.where("kind <> 'Equal'").select("file_path", "kind", F.ltrim("detail").alias("detail"))


def _quoted(text_: str) -> str:
    return "'" + text_.replace("'", "''") + "'"


@query(
    "select s_suppkey as k, ext, place, replace(outline, '%1$d', s_suppkey::varchar) as outline from supplier, (values "
    + ", ".join(f"('{ext}', {k}, {_quoted(o)})" for ext, (_, outlines) in SAMPLES.items() for k, o in enumerate(outlines))
    + ") t(ext, place, outline)"
)
def language_trees(spark, d):
    """All nodes of texts of 15 languages, of over twenty constructs each: depth and type of each node, and what the leaves say."""
    text_ = F.create_map(*(F.lit(x) for ext, (t, _) in SAMPLES.items() for x in (ext, t)))
    ext = F.explode(F.array(*map(F.lit, SAMPLES)))
    f = B.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), ext.alias("ext"))
    n = treestore.nodes(f.select(F.concat_ws(".", "k", "ext").alias("file_path"), F.replace(text_[F.col("ext")], F.lit("%1$d"), F.col("k")).alias("content")))
    node = F.concat(F.col("depth").cast("string"), "node_type", F.when(F.col("n_children") == 0, F.concat(F.lit("="), "content")).otherwise(""))
    each = n.where("seq > 0").groupBy("file_path", "ext", F.substring_index("path", ".", 1).cast("int").alias("place")).agg(F.array_sort(F.collect_list(F.struct("seq", node.alias("node")))).alias("nodes"))
    return each.select(F.substring_index("file_path", ".", 1).cast("long").alias("k"), "ext", "place", F.array_join(F.col("nodes.node"), " ").alias("outline"))


@query(with_("nodes", "select file_path, string_agg(format('  {}: {} unnamed [{}]', start_line, node_type, path), chr(10) order by start_line, seq) as text from nodes where contains(lower(content), 'license') group by 1"))
def text_output(spark, d):
    return output.as_text(find.find(B.nodes(spark, d), text="license", limit=None)).select(F.col("file").alias("file_path"), "text")


# stores and the write path ----------------------------------------------------------------------


#: Parts whose trees are on the disk at once in ``scan_rules``.
_TREES = 1 << 15


@query("select place, p_partkey::bigint as k from part, (values ('a.py', 'FIND BLAST INSPECT REFACTOR RELATIONS INDEX LINT'), ('b.RS', 'FIND BLAST INSPECT REFACTOR RELATIONS INDEX LINT'), ('sub/.x/g.py', 'BLAST REFACTOR LINT'), ('target/t.rs', 'INDEX LINT'), ('f.md', 'RELATIONS INDEX LINT'), ('_u.php', 'FIND RELATIONS INDEX LINT')) v(name, rules), (select unnest(['FIND', 'BLAST', 'INSPECT', 'REFACTOR', 'RELATIONS', 'INDEX', 'LINT']) as place) where contains(rules, place)")
def scan_rules(spark, d):
    """Trees of six files, of each part, written and scanned by every rule."""
    root = B.scratch(spark, "scan")
    names = ["a.py", "b.RS", "sub/.x/g.py", "target/t.rs", "f.md", "_u.php"]
    part = B.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"))
    # a file of few bytes takes blocks of the disk: trees are written, scanned and removed by so many parts at a time
    rounds = max(1, -(-part.count() // _TREES))
    for r in range(rounds):
        own = part.where(F.pmod(F.xxhash64("k"), F.lit(rounds)) == r).select("k", F.explode(F.array(*map(F.lit, names))).alias("name"))
        stores.write_sources(own.select(F.concat(F.lit(f"{root}/tree-{r}/"), F.col("k").cast("string"), F.lit("/"), "name").alias("file_path"), F.format_string("text of %d", "k").alias("content")), f"{root}/staged-{r}")
        out = None
        for rule in ("FIND", "BLAST", "INSPECT", "REFACTOR", "RELATIONS", "INDEX", "LINT"):
            one = source.scan(spark, f"{root}/tree-{r}", getattr(source, rule)).select(F.lit(rule).alias("place"), F.regexp_extract("content", r"\d+", 0).cast("long").alias("k"))
            out = one if out is None else out.unionByName(one)
        out.write.parquet(f"{root}/found/round={r}")
        for done in ("tree", "staged"):
            remove(spark, f"{root}/{done}-{r}")
    return spark.read.schema("place string, k long").parquet(*(f"{root}/found/round={r}" for r in range(rounds)))


#: Of a table's rows as texts, how many they are and a sum of their digests.
_SUM = "count(*) as n, sum(('0x' || md5(t)[1:12])::bigint)::decimal(38, 0) as total"


@query(
    with_("log journal calls definitions files", "select store, n, total from (")
    + " union all ".join(
        f"select '{name}' as store, {_SUM} from ({rows})"
        for name, rows in {
            "log": "select concat_ws('|', id, epoch_us(timestamp), operation, file_path, session_id, description) as t from logged",
            "backups": "select concat_ws('|', file_path, sha256(coalesce(content, '')), md5(coalesce(content, ''))) as t from files",
            "relations": "select distinct concat_ws('|', from_file, from_path, coalesce(f.to_file, '-'), to_name) as t from calls left join (select name as to_name, min(file_path) as to_file from definitions group by 1) f using (to_name)",
            "tags": "select concat_ws('|', file_path, 'top', '0') as t from files",
            "labels": "select concat_ws('|', 'doc/' || doc_id || '.txt', 'quality:' || quality, 'toxic:' || toxic) as t from labels",
            "journal": "select concat_ws('|', conv_id || '_' || turn, actor, transaction_id, entry_type, message) as t from journal",
            "vectors": "select concat_ws('|', 'label_' || label, vec_id, 'fn f' || vec_id || '()', list_sum(list_transform(embedding, lambda x: (x * 1000)::bigint))::bigint) as t from embeddings",
        }.items()
    )
    + ")"
)
def store_contents(spark, d):
    """Every side store written and read again: a sum over what its rows say."""
    read = _stored(spark, d)
    text_ = {
        "log": ["id", F.unix_micros(F.col("timestamp").cast("timestamp")).cast("string"), "operation", "file_path", "session_id", "description"], "backups": ["original_file_path", "content_hash", F.md5(F.col("source_code").cast("binary"))],
        "relations": ["from_file", "from_path", F.coalesce("to_file", F.lit("-")), "to_name"], "tags": ["file_path", "name", "node_path"], "labels": ["file_path", F.array_join("labels", "|")], "journal": ["id", "actor", "transaction_id", "entry_type", "message"],
        "vectors": ["file_path", "node_path", "content_preview", F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + F.bround(x.cast("float") * F.lit(1000).cast("float")).cast("long")).cast("string")],
    }
    digest = lambda cols: F.conv(F.substring(F.md5(F.concat_ws("|", *cols).cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return functools.reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n"), F.sum(digest(text_[name])).cast("decimal(38,0)").alias("total")).select(F.lit(name).alias("store"), "n", "total") for name, df in read.items()])


def _stored(spark, d) -> dict[str, DataFrame]:
    """Every side store written, and read again."""
    root = B.scratch(spark, "stores")
    none = F.create_map().cast("map<string,string>")
    stores.append_log(B.log(spark, d).withColumn("metadata", none), f"{root}/log")
    stores.append_backups(stores.snapshot(B.files(spark, d), F.to_timestamp(F.lit(T0))), f"{root}/backups")
    stores.write_relations(code.resolve(B.calls(spark, d), B.definitions(spark, d)), root)
    stores.write_tags(_tags(spark, d), f"{root}/tags")
    stores.write_labels(B.labels(spark, d).select("file_path", F.lit("h").alias("content_hash"), "labels", none.alias("metadata"), F.lit(T0).alias("last_updated")), f"{root}/labels")
    j = B.journal(spark, d).select(F.concat_ws("_", "conv_id", "turn").alias("id"), F.to_timestamp(F.lit(T0)).alias("timestamp"), "actor", "transaction_id", "entry_type", "message", F.array().cast("array<string>").alias("tags"), none.alias("metadata"))
    stores.append_journal(j, f"{root}/journal")
    stores.write_by_file(B.vectors(spark, d).select(*schema.EMBEDDINGS.names), f"{root}/vectors")
    return {
        "log": stores.read_log(spark, f"{root}/log"), "backups": stores.read_stored(spark, f"{root}/backups", schema.BACKUPS), "relations": stores.read_relations(spark, root), "tags": stores.read_stored(spark, f"{root}/tags", schema.TAGS),
        "labels": stores.read_stored(spark, f"{root}/labels", schema.LABELS), "journal": spark.read.schema(schema.JOURNAL).json(f"{root}/journal"), "vectors": stores.read_embeddings(spark, f"{root}/vectors"),
    }


@query("select 'backups' as store, (select count(*) from documents) as n union all select 'journal', (select count(*) from conversations) union all select 'labels', (select count(*) from labels) union all select 'log', (select count(*) from events) union all select 'relations', (select count(*) from (select distinct l_orderkey, l_linenumber, l_partkey from lineitem)) union all select 'tags', (select count(*) from documents) union all select 'vectors', (select count(*) from embeddings)")
def store_counts(spark, d):
    """Every side store written, and read again."""
    read = _stored(spark, d)
    out = None
    for name, df in read.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("with s as (select s_suppkey::bigint as k from supplier) select k, step, case when step = 'edited' then 'one' || chr(10) || 'N' || k || chr(10) || 'three' else 'one' || chr(10) || 'two' || chr(10) || 'three' end as content, case step when 'edited' then 1 else 2 end::bigint as snapshots from s, (select unnest(['edited', 'restored']) as step)")
def edit_and_restore(spark, d):
    """A file of each supplier: edited, read again, restored to what it was before, and read again, with its snapshots."""
    root = B.scratch(spark, "edits")
    k = F.regexp_extract("file_path", r"(\d+)\.txt", 1).cast("long").alias("k")
    files = B.table(spark, d, "supplier").select(F.concat(F.lit(f"{root}/src/"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("file_path"), F.lit("one\ntwo\nthree").alias("content"))
    stores.write_sources(files, f"{root}/staged")
    read = lambda: source.scan(spark, f"{root}/src").withColumn("file_path", F.when(F.col("file_path").contains("://"), F.col("file_path")).otherwise(F.concat(F.lit("file://"), "file_path")))
    project = write.Project(spark, f"{root}/project")
    none = F.lit(None).cast("string")
    op = F.struct(F.lit("edit").alias("type"), F.lit("1").alias("path"), none.alias("parent_path"), F.lit(None).cast("int").alias("position"), F.concat(F.lit("N"), F.regexp_extract("file_path", r"(\d+)\.txt", 1)).alias("content"))
    write.commit(project, read(), edit.batch_of(read().select("file_path", F.array(op).alias("operations"))), "s1", "number the second line")

    def seen(step: str) -> DataFrame:
        """The files and the number of their snapshots, as they are now."""
        taken = project.backups().groupBy(F.col("original_file_path").alias("file_path")).agg(F.count("*").alias("snapshots"))
        path = f"{root}/seen-{step}"
        read().join(taken, "file_path", "left").select(k, F.lit(step).alias("step"), "content", "snapshots").write.parquet(path)
        return spark.read.parquet(path)

    first = seen("edited")
    write.restore(project, read(), "2000-01-01 00:00:00", "s1")
    return first.unionByName(seen("restored"))


@query("select s_suppkey as k, step, content from supplier, lateral (values ('undone', 'one' || chr(10) || 'A' || s_suppkey || chr(10) || 'three'), ('redone', 'one' || chr(10) || 'B' || s_suppkey || chr(10) || 'three'), ('before the session', 'one' || chr(10) || 'two' || chr(10) || 'three')) t(step, content)")
def undo_and_redo(spark, d):
    """A file of each supplier, edited in two sessions: the second's changes undone, redone, and the first session restored, each read from the files."""
    root = B.scratch(spark, "undo")
    k = F.regexp_extract("file_path", r"(\d+)\.txt", 1)
    files = B.table(spark, d, "supplier").select(F.concat(F.lit(f"{root}/src/"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("file_path"), F.lit("one\ntwo\nthree").alias("content"))
    n = files.count()
    stores.write_sources(files, f"{root}/staged")
    read = lambda: source.scan(spark, f"{root}/src").withColumn("file_path", F.when(F.col("file_path").contains("://"), F.col("file_path")).otherwise(F.concat(F.lit("file://"), "file_path")))
    project = write.Project(spark, f"{root}/project")
    none = F.lit(None).cast("string")
    for session, mark in (("s1", "A"), ("s2", "B")):
        op = F.struct(F.lit("edit").alias("type"), F.lit("1").alias("path"), none.alias("parent_path"), F.lit(None).cast("int").alias("position"), F.concat(F.lit(mark), k).alias("content"))
        write.commit(project, read(), edit.batch_of(read().select("file_path", F.array(op).alias("operations"))), session)

    def seen(step: str) -> DataFrame:
        path = f"{root}/seen-{step.replace(' ', '-')}"
        read().select(k.cast("long").alias("k"), F.lit(step).alias("step"), "content").write.parquet(path)
        return spark.read.parquet(path)

    write.undo(project, read(), n, "s3")
    first = seen("undone")
    write.undo(project, read(), n, "s3", redo=True)
    second = seen("redone")
    write.restore_session(project, read(), "s1", "s3")
    return first.unionByName(second).unionByName(seen("before the session"))


@query(with_("scored", "select query, 'v' || node_path || '.rs' as file_path, 'fn f() {}' || chr(10) || 'fn near_' || query || '() {}' as after from (select *, row_number() over (partition by query order by score desc, node_path) as place from scored where score >= 0.2) where place = 1"))
def semantic_edit(spark, d):
    """A function put in behind the best hit of each query, in a file of its own for each vector."""
    v, q = _asked(spark, d)
    one = v.select(F.concat(F.lit("v"), "node_path", F.lit(".rs")).alias("file_path"), F.lit("0").alias("path"), "vector", F.col("node_path").alias("vec"))
    best = semantic.propose_all(v, q, "after").select("query", F.concat(F.lit("v"), "anchor_path", F.lit(".rs")).alias("file_path"), F.lit("0").alias("anchor_path"), "op", "parent_path", F.lit(1).alias("position"))
    files = one.select("file_path", F.lit("fn f() {}").alias("content"))
    done = edit.apply_each(files, semantic.edit_ops(best, F.concat(F.lit("fn near_"), "query", F.lit("() {}"))))
    return done.select(F.regexp_extract("after", r"near_(\d+)", 1).alias("query"), "file_path", "after")


# what is left of each section -------------------------------------------------------------------


@query(with_("functions", """Z, rel as (select distinct f.file_path as a, g.to_file as b from functions f join (select name, min(file_path) as to_file from functions group by 1) g on g.name = f.callee where f.file_path <> g.to_file),
f as (select distinct split_part(file_path, '/', 2) as name from functions union all select 'main.rs')
select 'clusters' as section, md5('- `src`: ' || string_agg(name, ', ' order by name)) as line from f union all select 'connections', md5('- ' || a || ' → ' || b) from (select * from rel order by a, b limit 15) union all select 'entry', md5('- src/main.rs')""").replace("\nZ, ", ",\n"))
def blueprint(spark, d):
    f = B.code(spark, d)
    rows = code.blueprint(f.select("file_path").unionByName(spark.createDataFrame([("src/main.rs",)], "file_path string")), code.relation_index(treestore.nodes(f)))
    return rows.select("section", _digest(F.col("line")).alias("line"))


@query(with_("supplier_files", "select '## Clusters' as head, count(distinct regexp_replace(file_path, '/[^/]*$', ''))::int + 1 as lines from supplier_files"))
def blueprint_text(spark, d):
    none = spark.createDataFrame([], "from_file string, from_path string, to_file string, to_name string, relation_type string")
    doc = code.blueprint_document(code.blueprint(B.supplier_files(spark, d), none))
    return doc.select(F.substring_index("value", "\n", 1).alias("head"), F.size(F.filter(F.split("value", "\n"), lambda x: x != "")).alias("lines"))


@query("select event_id, case when event_type = 'purchase' then 'l' || (event_id % 3 + 1) end as context_line, event_type <> 'view' as advised from events")
def error_context(spark, d):
    e = B.table(spark, d, "events")
    m = F.when(F.col("event_type") == "purchase", F.format_string("invalid syntax at line %d", F.col("event_id") % 3 + 1)).when(F.col("event_type") == "view", "odd").otherwise("Failed to read x")
    rows = health.diagnose(e.select("event_id", m.alias("message")), F.col("message"), F.lit("py"), F.lit("l1\nl2\nl3"))
    return rows.select("event_id", "context_line", F.col("suggestion").isNotNull().alias("advised"))


@query("select event_id::varchar as file_path, case when event_type = 'error' then 'error' else 'ok' end as status, case when event_type = 'error' then 'syntax_error' end as type, case when event_type = 'error' then event_id end as line from events")
def diagnostic_report(spark, d):
    e = B.table(spark, d, "events").select(F.col("event_id").cast("string").alias("f"), F.when(F.col("event_type") == "error", F.format_string("Validation failed near line %d", "event_id")).alias("m"))
    rows = health.diagnostic_report(e, F.lit("edit"), F.col("f"), F.lit("rs"), F.col("m"))
    part = lambda p: F.get_json_object("value", p)
    return rows.select("file_path", part("$.status").alias("status"), part("$.error.type").alias("type"), part("$.error.line").cast("long").alias("line"))


@query("select count(*) as n, count(*) as ids from events")
def new_ids(spark, d):
    return B.table(spark, d, "events").select(text.new_id("txn").alias("i")).agg(F.count("*").alias("n"), F.count_distinct("i").alias("ids"))


@query("select event_id, strftime(ts, '%H:%M:%S') as short, strftime(ts, '%Y-%m-%d %H:%M:%S') as long, strftime(ts, '%Y-%m-%d') as day from events")
def display_times(spark, d):
    return B.table(spark, d, "events").select("event_id", *(text.display_time(F.col("ts"), f).alias(f) for f in text.DISPLAY))


#: A Rust file of each part: a struct before ten items, so that paths of two digits begin as strings with its own, and an implementation that owns its functions.
_IMPL = "use a;\nstruct S%1$d { v: i32 }\n" + "".join(f"fn f{i}() {{ }}\n" for i in range(2, 10)) + "fn g%1$d() { f2(); }\nimpl S%1$d {\n  fn new() { g%1$d(); }\n  fn old() { new(); }\n}\n"


@query("select 'k' || p_partkey as file, s as struct_id, m as method_id from (select p_partkey, '1:S' || p_partkey as a, '11:S' || p_partkey as b, '10:g' || p_partkey as g from part), lateral (values (a, g), (a, '11.1.0:new'), (a, '11.1.1:old'), (b, '11.1.0:new'), (b, '11.1.1:old')) t(s, m)")
def struct_methods(spark, d):
    n = _parsed(spark, d, "rs", F.format_string(_IMPL, "k"))
    return code.methods_of(code.points_of(n)).select(F.concat(F.lit("k"), F.substring_index("file_path", ".", 1)).alias("file"), "struct_id", "method_id")


#: Files of several languages of each part, and their graphs by the rule: ids of points, and calls by the ids of their ends.
_GRAPHED = {
    "py": ("import x\nclass C%1$d:\n    def m(self):\n        f()\n\ndef f%1$d():\n    return 1\n", ["1.1:m", "2:f{}"], []),
    "js": ("function f%1$d(x) { g(x); }\nclass K { m() { f%1$d(1); } }\nfunction gf() { f%1$d(2); F%1$d(3); h(); }\n", ["0:f{}", "1.1.0:m", "2:gf"], [("2:gf", "0:f{}"), ("2:gf", "0:f{}")]),
    "rs": ("use core::fmt as f;\nimpl S%1$d {\n fn make() { new%1$d(); mak(); }\n}\nfn new%1$d() { make(); S%1$d(); none(); }\n", ["use:use_core_fmt_as_f;", "1:S{}", "1.1.0:make", "2:new{}"], [("1.1.0:make", "1.1.0:make"), ("2:new{}", "1.1.0:make"), ("2:new{}", "1:S{}")]),
    "sh": ("run%1$d() {\n  step a\n}\nrun%1$d\n", ["0:run{}"], []),
    "go": ("func A%1$d() { B() }\nfunc B() { A%1$d(); fmtB() }\n", ["0:A{}", "1:B"], [("1:B", "0:A{}"), ("1:B", "1:B")]),
}


def _graphs(spark, d, take):
    """What is taken of the trees, by file, with the part's key and the extension."""
    found = take(_all_parsed(spark, d, {ext: text_ for ext, (text_, _, _) in _GRAPHED.items()}))
    return found.withColumns({"k": F.substring_index("file_path", ".", 1).cast("long"), "ext": F.substring_index("file_path", ".", -1)})


def _of_parts(columns: str, rows: list[tuple]) -> str:
    """SQL of fixed rows for each part; ``{}`` in one stands for its key."""
    quoted = ", ".join("(" + ", ".join("replace('" + str(v).replace("'", "''") + "', '{}', p_partkey::varchar)" for v in r) + ")" for r in rows)
    return f"select p_partkey as k, t.* from part, lateral (values {quoted}) t({columns})"


@query(_of_parts("ext, id", [(ext, i) for ext, (_, ids, _) in _GRAPHED.items() for i in ids]))
def graph_points(spark, d):
    """The ids of the points of five languages."""
    return _graphs(spark, d, code.points_of).select("k", "ext", "id")


@query(_of_parts("ext, from_id, to_id", [(ext, *e) for ext, (_, _, edges) in _GRAPHED.items() for e in edges]))
def graph_edges(spark, d):
    """The calls between points of five languages, by their ids."""
    return _graphs(spark, d, lambda n: code.call_graph(n)[1]).select("k", "ext", "from_id", "to_id")


@query("select p_partkey::varchar as name, min(c_name) as target from part join customer on contains(lower(c_name), p_partkey::varchar) group by 1")
def fuzzy_names(spark, d):
    """Of each part's number the first customer whose name holds it."""
    names = B.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"))
    return code.fuzzy_match(names, B.table(spark, d, "customer").select(F.col("c_name").alias("target")))


@query(with_("nodes", "select seq, content from nodes where file_path = 'doc/1.txt' and contains(lower(content), 'the') order by seq limit 500"))
def search_one_file(spark, d):
    return find.search_file(B.nodes(spark, d), "doc/1.txt", "The").select("seq", "content")


@query(with_("functions", "select file_path, i + 1 as place from functions where name = 'f1_2'"))
def node_by_name(spark, d):
    return find.by_name(_code(spark, d), "@fn:f1_2").select("file_path", F.col("path").cast("int").alias("place"))


@query(with_("files", "select file_path, sha256(coalesce(content, '')) as hash from files"))
def content_hashes(spark, d):
    return B.files(spark, d).select("file_path", stores.content_hash(F.col("content")).alias("hash"))


def _entries(spark, d):
    return B.journal(spark, d).select(F.concat_ws("_", "conv_id", "turn").alias("id"), "actor", "entry_type", "message", "transaction_id", F.array().cast("array<string>").alias("tags"))


@query(with_("journal", "select count(*) as n, count(*) as ids, count(*) filter (where entry_type = 'Intent') as intents from journal"))
def journal_entries(spark, d):
    made = side.entries(_entries(spark, d))
    return made.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("entry_type") == "Intent").alias("intents"))


@query(with_("journal", "select conv_id || '_' || turn as id, case when conv_id = 1 and turn = 0 then 'changed' else message end as message, case when conv_id = 1 and turn = 0 then 'seen' else '' end as tags from journal"))
def journal_changes(spark, d):
    done = side.amend(side.tag_entry(_entries(spark, d), "1_0", "seen"), "1_0", "changed")
    return done.select("id", "message", F.array_join("tags", ",").alias("tags"))


@query(with_("files", "select exists(select 1 from files where file_path = 'doc/1.txt') as found"))
def tag_found(spark, d):
    return side.tag_exists(_tags(spark, d), "doc/1.txt", "top")


@query("select p_partkey::bigint as k, 'Item {' || chr(10) || '    property int p' || p_partkey || ': 1' || chr(10) || '    width: 2' || chr(10) || '    height: ' || p_size || chr(10) || '    Text {}' || chr(10) || '}' as after from part")
def add_property(spark, d):
    p = B.table(spark, d, "part").select(F.format_string("%d.qml", "p_partkey").alias("file"), F.lit(0).alias("position"), F.lit("AddProperty").alias("intent"), F.lit("root.0").alias("path"), F.format_string("height: %d", "p_size").alias("content"), F.format_string("Item {\n    property int p%d: 1\n    width: 2\n    Text {}\n}", "p_partkey").alias("text"))
    done = edit.apply_batch(p.select(F.col("file").alias("file_path"), F.col("text").alias("content")), edit.intent_ops(p))
    return done.select(F.substring_index("file_path", ".", 1).cast("long").alias("k"), "after")


@query("select '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' as value from region")
def json_output(spark, d):
    return output.as_json(B.table(spark, d, "region").select("r_regionkey", "r_name"))


@query(with_("orders_", "select 'o' || k || '.txt' as file_path, t.n, t.tag, t.line from orders_, lateral (select * from (values (0, 'Equal', 'one'), (1, 'Delete', 'two'), (2, case when k % 2 = 0 then 'Delete' else 'Insert' end, case when k % 2 = 0 then 'three' else 'N' || k end), (3, case when k % 2 = 0 then 'Insert' else 'Equal' end, case when k % 2 = 0 then 'N' || k else 'three' end)) v(n, tag, line)) t where k % 7 <> 0"))
def edit_preview(spark, d):
    return edit.preview_edit(_small(spark, d), edit.batch_of(_edits(spark, d)))
