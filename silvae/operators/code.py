"""Calls, callers, orphans, impact, references and blueprints of projects."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvae.functions.scores import impact, risk
from silvae.operators.holding import first_in_file, first_match, fuzzy_match  # noqa: F401
from silvae.operators.sweep import PART, apart, beginnings, enclosing, in_order
from silvae.sources.shared import scratch

#: Types of functions whose bodies own a call, of calls, and of definitions of types.
FUNCTIONS = ["function_item", "function_declaration", "method_declaration"]
CALLS = ["call_expression"]
_STRUCT = r"struct|class"


def is_function():
    return F.col("node_type").isin(*FUNCTIONS)


def called_name():
    """The name of a call, else its text."""
    return F.coalesce("name", F.trim("content"))


# inspect ---------------------------------------------------------------------------------------


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("file_path", "node_type").agg(F.count("*").alias("n"))


def metrics(nodes: DataFrame, large: int = 50) -> DataFrame:
    """Functions of each file, those of over ``large`` lines, and the longest."""
    size = F.col("end_line") - F.col("start_line") + 1
    return nodes.where(F.lower("node_type").isin(*FUNCTIONS) & F.col("name").isNotNull()).groupBy("file_path").agg(F.count("*").alias("functions"), F.count_if(size > large).alias("large"), F.max(size).alias("longest"))


def large_nodes(nodes: DataFrame, large: int = 50) -> DataFrame:
    return nodes.where(F.col("end_line") - F.col("start_line") + 1 > large)


def callers_of(nodes: DataFrame, symbol: str) -> DataFrame:
    """Calls whose name or text holds the symbol, and the definitions of it, each with its role."""
    call = F.col("node_type").contains("call") & called_name().contains(symbol)
    made = (F.col("node_type").contains("function") | F.col("node_type").contains("definition")) & (F.col("name") == symbol)
    return nodes.where(call | made).select("file_path", "seq", "path", "start_line", F.when(made, "definition").otherwise("call").alias("role"))


def orphans(nodes: DataFrame, strict: bool = False) -> DataFrame:
    """Private functions, those of a leading underscore, that nothing calls. ``strict`` gives none, as names that begin with an underscore are not reported then."""
    called = nodes.where(F.col("node_type").isin(*CALLS) | (F.col("node_type") == "call")).select(called_name().alias("name")).distinct()
    private = nodes.where(F.col("node_type").contains("function") & F.col("name").isNotNull() & F.startswith("name", F.lit("_")))
    found = private.join(called, "name", "left_anti").select("file_path", "seq", "path", "name", "start_line")
    return found.where(~F.startswith("name", F.lit("_"))) if strict else found


def uncalled(nodes: DataFrame) -> DataFrame:
    """Functions that no call in their file names."""
    called = nodes.where(F.col("node_type").isin(*CALLS)).select("file_path", called_name().alias("name")).distinct()
    return nodes.where(is_function()).join(apart(called), ["file_path", "name"], "left_anti").select("file_path", "seq", "name")


def type_relations(nodes: DataFrame) -> DataFrame:
    """Types, implementations and imports of each file."""
    kind = F.col("node_type")
    return nodes.groupBy("file_path").agg(F.count_if(kind.rlike(_STRUCT) & kind.rlike("item|declaration|definition")).alias("structs"), F.count_if(kind.contains("impl")).alias("implementations"), F.count_if(kind.startswith("use") | kind.startswith("import")).alias("uses"))


def inspect(nodes: DataFrame, mode: str, symbol: str = "") -> DataFrame:
    """One of the modes metrics, sizes, callers, orphans, relations and full; files without findings are left out."""
    if mode == "full":
        left = orphans(nodes).groupBy("file_path").agg(F.count("*").alias("orphans"))
        return metrics(nodes).join(left, "file_path", "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)))
    return {"metrics": lambda: type_counts(nodes), "sizes": lambda: large_nodes(nodes), "callers": lambda: callers_of(nodes, symbol), "orphans": lambda: orphans(nodes), "relations": lambda: type_relations(nodes)}[mode]()


# blast -----------------------------------------------------------------------------------------


def callers(nodes: DataFrame, name: str) -> DataFrame:
    """Calls of a function, and identifiers of its name inside other functions, in any letter case, with the function they are in."""
    low = name.lower()
    call = F.col("node_type").isin(*CALLS) & (F.lower("name") == low)
    mention = (F.col("node_type") == "identifier") & (F.lower("content") == low)
    # what is asked of a call and of the function around it goes through the sweep with them: nothing is joined
    hit = enclosing(nodes, call | mention, is_function(), own=["path", "start_line", "node_type"], around=F.col("name"))
    hit = hit.where((F.col("node_type") != "identifier") | F.col("outer_seq").isNotNull() & (F.lower(F.coalesce("around", F.lit(""))) != low))
    return hit.select("file_path", "seq", "path", "start_line", F.col("around").alias("in_function"), F.when(F.col("node_type") == "identifier", "reference").otherwise("call").alias("kind"))


def callees(nodes: DataFrame, file_path: str, path: str) -> DataFrame:
    """Names that the subtree at a path calls."""
    from silvae.operators.find import at_path
    from silvae.operators.tree import subtree

    own = nodes.where(F.col("file_path") == file_path)
    return subtree(own, at_path(own, path)).where(F.col("node_type").isin(*CALLS)).select(called_name().alias("callee"), "seq")


def blast(nodes: DataFrame, file_path: str, path: str, name: str) -> DataFrame:
    """One row: callers, callees, other files touched, the risk of a change, and its level."""
    up = callers(nodes, name).agg(F.count("*").alias("callers"), F.count_distinct(F.when(F.col("file_path") != file_path, F.col("file_path"))).alias("files"))
    down = callees(nodes, file_path, path).agg(F.count("*").alias("callees"))
    both = up.crossJoin(down).withColumn("risk", risk(F.col("callers"), F.col("callees"), F.col("files")))
    return both.select("callers", "callees", "files", F.round("risk", 4).alias("risk"), impact(F.col("risk")).alias("impact"))


def blast_lists(nodes: DataFrame, file_path: str, path: str, name: str) -> DataFrame:
    """(kind, file_path, path, name): the callers, callees and other files that ``blast`` counts."""
    up = callers(nodes, name)
    one = up.select(F.lit("caller").alias("kind"), "file_path", "path", F.col("in_function").alias("name"))
    down = callees(nodes, file_path, path).select(F.lit("callee").alias("kind"), F.lit(file_path).alias("file_path"), F.lit(path).alias("path"), F.col("callee").alias("name"))
    none = F.lit(None).cast("string")
    files = up.where(F.col("file_path") != file_path).select("file_path").distinct().select(F.lit("file").alias("kind"), "file_path", none.alias("path"), none.alias("name"))
    return one.unionByName(down).unionByName(files)


# graph -----------------------------------------------------------------------------------------


def _point() -> tuple[Column, Column, Column]:
    """Whether a node is a point of its file's graph, its id and its name there."""
    kind, content = F.lower("node_type"), F.trim("content")
    use = kind == "use_declaration"
    named = (kind.contains("function") | kind.contains("method") | kind.isin("struct_item", "impl_item")) & F.col("name").isNotNull()
    used = F.concat(F.lit("use:"), F.replace(F.replace(content, F.lit("::"), F.lit("_")), F.lit(" "), F.lit("_")))
    is_point = F.coalesce(named & ~use | use & ~content.isin("", "::"), F.lit(False))
    return is_point, F.when(use, used).otherwise(F.concat("path", F.lit(":"), "name")), F.when(use, content).otherwise(F.col("name"))


def points_of(nodes: DataFrame) -> DataFrame:
    """(file_path, seq, id, path, name, node_type, line) of a file's graph: named functions and methods, structs and implementations, and imports."""
    is_point, id_, name = _point()
    return nodes.where(is_point).select("file_path", "seq", id_.alias("id"), "path", name.alias("name"), "node_type", F.col("start_line").alias("line"))


def call_graph(nodes: DataFrame, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Points and edges of each file: named functions, methods, types and imports; calls from the function around them.

    A call is of what its first child says that is an identifier or a field. It leads to the first
    function of just that name, else to the first point whose name holds its own or is held by it,
    letter case apart; either must come before the call in the file.

    A file of up to ``size`` nodes is swept over once, by one task; those of longer ones are joined."""
    size = PART if size is None else size
    long = nodes.where((F.col("seq") == 0) & (F.col("seq_end") >= size)).select("file_path").distinct()
    if long.isEmpty():
        edges = _edges_swept(nodes)
    else:
        edges = _edges_swept(nodes.join(apart(long), "file_path", "left_anti")).unionByName(_edges_joined(nodes.join(apart(long), "file_path", "left_semi")))
    return points_of(nodes), edges.select("*", F.lit("calls").alias("edge"))


def _edges_swept(nodes: DataFrame) -> DataFrame:
    """The edges of files that one task can hold: it has a file's points, and the calls that wait for what they say or for a name that holds theirs."""

    def step():
        file, open_, functions, points, waiting, asked = None, [], {}, {}, {}, []

        def close():
            held, names = list(points), list(dict.fromkeys(name for _, name, _ in asked))
            found = dict(zip(names, first_match(names, held), strict=True))
            for seq, name, owner in asked:
                to = points[held[found[name]]] if found[name] < len(held) else None
                if to is not None and to[0] < seq:
                    yield file, seq, owner[2], owner[3], to[1], to[2]

        def one(row):
            nonlocal file, open_, functions, points, waiting, asked
            if not row or row[0] != file:
                if asked:
                    yield from close()
                file, open_, functions, points, waiting, asked = row[0] if row else None, [], {}, {}, {}, []
            if not row:
                return
            _, seq, kind, at, name, id_ = row
            if kind == _SAID:
                owner = waiting.pop(at, None)
                if owner is not None and name is not None:
                    to = functions.get(name)
                    if to is not None and to[0] < at:
                        yield file, at, owner[2], owner[3], to[1], to[2]
                    else:
                        asked.append((at, name, owner))
                return
            while open_ and open_[-1][0] < seq:
                open_.pop()
            if kind == _CALL:
                if open_:
                    waiting[seq] = open_[-1]
                return
            point = (seq, id_, name)
            points.setdefault(name, point)
            if kind == _FUNCTION:
                functions.setdefault(name, point)
                open_.append((at, seq, id_, name))

        return one

    is_point, id_, name = _point()
    call, said = F.lower("node_type") == "call_expression", F.col("node_type").isin("identifier", "field_expression") & F.col("parent_seq").isNotNull()
    kind = F.when(call, _CALL).when(said, _SAID).when(is_point, F.when(F.col("node_type").contains("function"), _FUNCTION).otherwise(_POINT))
    rows = nodes.select("file_path", "seq", kind.alias("kind"), F.when(said, F.col("parent_seq")).otherwise(F.col("seq_end")).alias("at"), F.when(said, F.trim("content")).when(is_point, name).alias("name"), F.when(is_point, id_).alias("id")).where("kind is not null")
    text, number = pa.string(), pa.int32()
    return in_order(rows, ["seq"], step, "file_path string, seq int, from_id string, from_name string, to_id string, to_name string", [text, number, text, text, text, text])


#: What a row of a file is when its edges are looked for.
_SAID, _CALL, _POINT, _FUNCTION = 0, 1, 2, 3


def _edges_joined(nodes: DataFrame) -> DataFrame:
    """The same of files of any length, by parts and joins."""
    points = points_of(nodes)
    function = F.col("node_type").contains("function")
    said = nodes.where(F.col("node_type").isin("identifier", "field_expression") & F.col("parent_seq").isNotNull())
    said = said.groupBy("file_path", F.col("parent_seq").alias("seq")).agg(F.trim(F.min_by("content", "seq")).alias("callee"))
    is_call = F.lower("node_type") == "call_expression"
    owner = enclosing(nodes, is_call, function & F.col("name").isNotNull()).where("outer_seq is not null")
    call = owner.join(apart(said), ["file_path", "seq"])
    target = points.select("file_path", F.col("seq").alias("t"), F.col("name").alias("target"), function.alias("fn"))
    exact = target.where("fn").groupBy("file_path", F.col("target").alias("callee")).agg(F.min("t").alias("e"))
    known = call.join(apart(exact), ["file_path", "callee"], "left").withColumn("e", F.when(F.col("e") < F.col("seq"), F.col("e")))
    near = first_in_file(known.where("e is null").select("file_path", F.col("callee").alias("name")), target)
    best = known.join(apart(near.select("file_path", F.col("name").alias("callee"), F.col("t").alias("f"))), ["file_path", "callee"], "left")
    best = best.select("file_path", "seq", "outer_seq", F.coalesce("e", F.when(F.col("f") < F.col("seq"), F.col("f"))).alias("t")).where("t is not null")
    end = lambda side, at: apart(points.select("file_path", F.col("seq").alias(at), F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name")))
    edges = best.join(end("from", "outer_seq"), ["file_path", "outer_seq"]).join(end("to", "t"), ["file_path", "t"])
    return edges.select("file_path", "seq", "from_id", "from_name", "to_id", "to_name")


def methods_of(points: DataFrame) -> DataFrame:
    """(file_path, struct_id, method_id): the functions whose path begins, as a string, with that of a struct or an implementation."""
    kind = F.col("node_type")
    is_type, is_function_ = kind.contains("struct") | kind.contains("impl"), kind.contains("function")
    # a function is never a type: of a node that is both by its type's name the function comes first
    rows = points.where(is_type | is_function_).select("file_path", "path", "id", is_function_.alias("asks"))
    held = beginnings(rows.select("file_path", "path", (~F.col("asks")).alias("opens")))
    types = rows.where("not asks").select("file_path", F.col("path").alias("start"), F.col("id").alias("struct_id"))
    functions = rows.where("asks").select("file_path", "path", F.col("id").alias("method_id"))
    return held.join(apart(functions), ["file_path", "path"]).join(apart(types), ["file_path", "start"]).select("file_path", "method_id", "struct_id")


def graph_summary(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, nodes, edges, orphans) of each file with points; an orphan is a function that no edge leads to."""
    one, zero = F.lit(1), F.lit(0)
    function = F.col("node_type").contains("function").cast("int")
    # points and the ends of edges meet by their id in one aggregation, so that neither is made twice
    both = points.select("file_path", "id", one.alias("n"), F.coalesce(function, zero).alias("f"), zero.alias("e")).unionByName(edges.select("file_path", F.col("to_id").alias("id"), zero.alias("n"), zero.alias("f"), one.alias("e")))
    each = both.groupBy("file_path", "id").agg(*(F.sum(c).alias(c) for c in "nfe"))
    out = each.groupBy("file_path").agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges"), F.sum(F.when(F.col("e") == 0, F.col("f")).otherwise(0)).alias("orphans"))
    return out.where("nodes > 0")


#: The line that frames a graph's text, and the heads of its forms and sections.
_RULE = "━" * 35
_HEADS = {"mermaid": "```mermaid\nflowchart LR", "dot": "digraph G {\n    rankdir=LR;\n    node [shape=box];", "text": f"\n🔗 CODE RELATION GRAPH\n{_RULE}", "tree": f"\n🌳 CODE TREE\n{_RULE}"}
_TAILS = {"mermaid": "```\n", "dot": "}\n", "text": f"{_RULE}\n", "tree": f"{_RULE}\n"}
_NODES, _CALLS, _TYPES, _OWN = "\n📦 NODES (functions, structs, etc.):", "\n🔗 CALL RELATIONS:", "\n📦 Structs/Impls:", "\n🔧 Functions:"


def _lines_of(rows: DataFrame, section: int, order: list, text: Column) -> DataFrame:
    """Lines of a part of each file's graph, in an order of up to three values."""
    keys = [F.lit(x) if isinstance(x, int) else F.col(x).cast("long") for x in [*order, -1, -1, -1][:3]]
    return rows.select("file_path", F.struct(F.lit(section).alias("s"), *(k.cast("long").alias(f"k{i}") for i, k in enumerate(keys)), text.alias("t")).alias("l"))


def _once(rows: DataFrame, section: int, text: str) -> DataFrame:
    return _lines_of(rows.select("file_path").distinct(), section, [], F.lit(text))


def _written(rows: DataFrame) -> DataFrame:
    """Rows that are asked for more than once, written down."""
    path = scratch(rows.sparkSession, "edges")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def render_graph(points: DataFrame, edges: DataFrame, form: str = "mermaid") -> DataFrame:
    """(file_path, text): the graph of each file that has one, as mermaid, dot, text or tree. A file's graph is one text, as a person looks at it."""
    node_id, plain = F.translate("id", ":.", "__"), F.replace("name", F.lit('"'), F.lit(""))
    a, b = F.translate("from_id", ":.", "__"), F.translate("to_id", ":.", "__")
    kind = F.col("node_type")
    if form == "mermaid":
        label = F.replace(F.replace(plain, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        parts = [_lines_of(points, 1, ["seq"], F.concat(F.lit("    "), node_id, F.lit('("'), label, F.lit('")'))), _lines_of(edges, 2, ["seq"], F.concat(F.lit("    "), a, F.lit(" --> "), b))]
    elif form == "dot":
        label = F.replace(plain, F.lit("\\"), F.lit("\\\\"))
        parts = [_lines_of(points, 1, ["seq"], F.concat(F.lit('    "'), node_id, F.lit('" [label="'), label, F.lit('"];'))), _lines_of(edges, 2, ["seq"], F.concat(F.lit('    "'), a, F.lit('" -> "'), b, F.lit('";')))]
    elif form == "text":
        edges = _written(edges)
        total = F.format_string("📊 %d nodes, %d edges, %d orphans", "nodes", "edges", "orphans")
        head = graph_summary(points, edges).select("*", F.concat(F.lit("File: "), "file_path", F.lit("\n"), total).alias("t"))
        # types in order of their first point
        kinds = points.groupBy("file_path", "node_type").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
        each = points.join(apart(kinds), ["file_path", "node_type"])
        parts = [
            _lines_of(head, 1, [], F.col("t")), _once(points, 2, _NODES), _lines_of(kinds, 3, ["first"], F.format_string("  [%d] %s", "n", "node_type")),
            _lines_of(each, 3, ["first", "seq"], F.format_string("    • %s @ %d", "name", "line")), _once(edges, 4, _CALLS), _lines_of(edges, 5, ["seq"], F.format_string("  %s → %s [%s]", "from_name", "to_name", "edge")),
        ]
    elif form == "tree":
        function = kind.contains("function")
        types, functions = points.where(~function & (kind.contains("struct") | kind.contains("impl"))), points.where(function)
        at = lambda p, prefix: p.select("file_path", F.col("id").alias(f"{prefix}_id"), F.col("seq").alias(f"{prefix}_seq"), F.col("name").alias(f"{prefix}_name"))
        methods = methods_of(points).join(apart(at(types, "struct")), ["file_path", "struct_id"]).join(apart(at(functions, "method")), ["file_path", "method_id"])
        calls = edges.join(apart(at(functions, "from").drop("from_name")), ["file_path", "from_id"])
        parts = [
            _once(types, 1, _TYPES), _lines_of(types, 2, ["seq"], F.format_string("  📦 %s", "name")), _lines_of(methods, 2, ["struct_seq", "method_seq"], F.format_string("    └── %s", "method_name")),
            _once(functions, 3, _OWN), _lines_of(functions, 4, ["seq"], F.format_string("  🔧 %s()", "name")), _lines_of(calls, 4, ["from_seq", "seq"], F.format_string("      → %s", "to_name")),
        ]
    else:
        raise ValueError(f"no form {form}")
    rows = functools.reduce(DataFrame.unionByName, parts)
    body = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]), "\n")
    return rows.groupBy("file_path").agg(F.concat(F.lit(_HEADS[form] + "\n"), body, F.lit("\n" + _TAILS[form])).alias("text"))


# references --------------------------------------------------------------------------------------


def definitions(nodes: DataFrame) -> DataFrame:
    """(file_path, name, path) of nodes that define a name."""
    return nodes.where((F.col("node_type").contains("definition") | F.col("node_type").contains("item")) & F.col("name").isNotNull()).select("file_path", "name", "path")


def symbol_table(defs: DataFrame) -> DataFrame:
    """(name, file_path, place): the files that define a name, each once, in order. Rows and not lists: a name may be in very many files."""
    w = Window.partitionBy("name").orderBy("file_path")
    return defs.select("name", "file_path").distinct().withColumn("place", F.row_number().over(w))


#: Names called most that ``resolve`` gives to every task, and bytes of one of them at most.
HOT, HOT_BYTES = 1 << 12, 1 << 10


def resolve(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """References (from_file, from_path, to_name) with the first file that defines the name, each once; null if none does."""
    first = defs.groupBy(F.col("name").alias("to_name")).agg(F.min("file_path").alias("to_file"))
    # one name has one file, so calls are made distinct before they are joined
    once = calls.select("from_file", "from_path", "to_name").distinct()
    # names that very many places call would make one task each of nearly all rows: they get their file from a
    # bounded table, and go into the join spread, by a number that no name there has
    hot = calls.groupBy("to_name").agg(F.count("*").alias("n")).where(F.octet_length("to_name") <= HOT_BYTES).orderBy(F.desc("n"), "to_name").limit(HOT).select("to_name")
    known = first.join(F.broadcast(hot), "to_name", "left_semi").select("to_name", F.col("to_file").alias("hot_file"), F.lit(True).alias("hot"))
    once = once.join(F.broadcast(known), "to_name", "left").withColumn("spread", F.when(F.col("hot"), F.xxhash64("from_file", "from_path").bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    found = once.join(apart(first.withColumn("spread", F.lit(0).cast("long"))), ["to_name", "spread"], "left")
    return found.select("from_file", "from_path", F.coalesce("hot_file", "to_file").alias("to_file"), "to_name", F.lit("Call").alias("relation_type"))


def relation_index(nodes: DataFrame) -> DataFrame:
    """All calls of a project, resolved over its files."""
    call = (F.col("node_type").contains("call") | F.col("node_type").contains("usage")) & F.col("name").isNotNull()
    return resolve(nodes.where(call).select(F.col("file_path").alias("from_file"), F.col("path").alias("from_path"), F.col("name").alias("to_name")), definitions(nodes))


def impact_callers(relations: DataFrame, name: str) -> DataFrame:
    return relations.where((F.col("to_name") == name) & (F.col("relation_type") == "Call")).select("from_file", "from_path").distinct()


def callers_by_file(relations: DataFrame) -> DataFrame:
    """(to_name, from_file, callers, first_path): of each name and file how many places call it, and the first of them."""
    return relations.where("relation_type = 'Call'").select("to_name", "from_file", "from_path").distinct().groupBy("to_name", "from_file").agg(F.count("*").alias("callers"), F.min("from_path").alias("first_path"))


#: Where the tests of a file may stand below the project's root, before and after its name.
TEST_PLACES = [("test_", ".rs"), ("", "_test.rs"), ("test_", ".py"), ("", "_test.py"), ("tests/test_", ".rs")]


def related_tests(files: DataFrame, edited: DataFrame, root: str = "") -> DataFrame:
    """(edited, test): the files of a project that stand where tests of an edited file would."""
    stem = F.regexp_replace(F.substring_index("edited", "/", -1), r"\.[^.]*$", "")
    places = F.array(*(F.concat(F.lit(root + before), stem, F.lit(after)) for before, after in TEST_PLACES))
    want = edited.select(F.col("file_path").alias("edited")).select("edited", F.explode(places).alias("test"))
    return want.join(files.select(F.col("file_path").alias("test")).distinct(), "test", "left_semi").select("edited", "test").distinct()


def pulse(relations: DataFrame, files: DataFrame, edited_file: str, name: str) -> DataFrame:
    """After an edit: (kind, file, detail) of callers elsewhere and tests to run."""
    one = files.where(F.col("file_path") == edited_file).select("file_path").limit(1)
    calls = impact_callers(relations, name).where(F.col("from_file") != edited_file).select(F.lit("caller").alias("kind"), F.col("from_file").alias("file"), F.col("from_path").alias("detail"))
    tests = related_tests(files, one).select(F.lit("test").alias("kind"), F.col("test").alias("file"), F.lit("run").alias("detail"))
    return calls.unionByName(tests)


#: Tasks that the pairs of one name's files are dealt to.
SPREAD = 16


def pulse_all(relations: DataFrame, files: DataFrame, edited: DataFrame) -> DataFrame:
    """(file_path, kind, detail) of each edited file (file_path, name): the files elsewhere that call its names, and the tests to run."""
    calls = relations.where("relation_type = 'Call'").select(F.col("to_name").alias("name"), "from_file").distinct()
    # a name's edited files times the files that call it are the result: both go to SPREAD tasks a name
    names = edited.groupBy("file_path").agg(F.collect_set("name").alias("names"))
    each = names.select("file_path", (F.size("names") > 1).alias("several"), F.explode("names").alias("name")).withColumn("part", F.pmod(F.xxhash64("file_path"), F.lit(SPREAD)))
    copies = calls.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    up = each.join(apart(copies), ["name", "part"]).where("from_file <> file_path").select("file_path", "several", F.lit("caller").alias("kind"), F.col("from_file").alias("detail"))
    # pairs are distinct already where only one name of a file is edited
    up = up.where("not several").drop("several").unionByName(up.where("several").drop("several").distinct())
    tests = related_tests(files, edited.select("file_path").distinct()).select(F.col("edited").alias("file_path"), F.lit("test").alias("kind"), F.col("test").alias("detail"))
    return up.unionByName(tests)


#: Files that a project is entered by.
ENTRIES = ["main.rs", "main.py", "index.ts", "lib.rs"]


def clusters(files: DataFrame) -> DataFrame:
    """(folder, files): names of each folder's files in order."""
    folder = F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise("")
    return files.groupBy(folder.alias("folder")).agg(F.array_sort(F.collect_list(F.substring_index("file_path", "/", -1))).alias("files"))


def connections(relations: DataFrame) -> DataFrame:
    """Distinct pairs of different files of which one calls into the other."""
    return relations.where("to_file is not null and from_file <> to_file").select("from_file", "to_file").distinct()


def entry_points(files: DataFrame) -> DataFrame:
    return files.where(F.substring_index("file_path", "/", -1).isin(*ENTRIES)).select("file_path")


def blueprint(files: DataFrame, relations: DataFrame, shown: int = 15) -> DataFrame:
    """(section, line) of a project's Markdown blueprint."""
    head = clusters(files).select(F.lit("clusters").alias("section"), F.concat(F.lit("- `"), "folder", F.lit("`: "), F.array_join("files", ", ")).alias("line"))
    links = connections(relations).orderBy("from_file", "to_file").limit(shown).select(F.lit("connections").alias("section"), F.concat(F.lit("- "), "from_file", F.lit(" → "), "to_file").alias("line"))
    entry = entry_points(files).select(F.lit("entry").alias("section"), F.concat(F.lit("- "), "file_path").alias("line"))
    return head.unionByName(links).unionByName(entry)


def blueprint_document(rows: DataFrame, form: str = "markdown") -> DataFrame:
    """One row: the sections of ``blueprint`` as a document, in Markdown or for a terminal. For one project's blueprint, which a person reads."""
    title = {"clusters": "Clusters", "connections": "Connections", "entry": "Entry points"}
    order = F.create_map(*(F.lit(x) for k, name in enumerate(title) for x in (name, k)))
    each = rows.groupBy("section").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body")).withColumn("k", order[F.col("section")])
    name = F.create_map(*(F.lit(x) for kv in title.items() for x in kv))[F.col("section")]
    if form == "markdown":
        text = F.concat(F.lit("## "), name, F.lit("\n\n"), "body")
    else:
        text = F.concat(F.upper(name), F.lit("\n"), F.regexp_replace("body", "(?m)^- `?|`", "  "))
    return each.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("value"))

