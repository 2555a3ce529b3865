import json

import pytest

from silvae.sources import trees
from silvae.sources.files import nodes


def kinds(ext, text):
    return [(r[8], r[9], r[10]) for r in trees.parse(f"x.{ext}", text)]


def test_nested_set_numbers():
    rows = trees.parse("x.json", '{"a": [1, {"b": null}], "c": "s"}')
    by_path = {r[8]: r for r in rows}
    assert [r[2] for r in rows] == list(range(6))
    assert by_path[""][3] == 5 and by_path["a"][3] == 4 and by_path["a.1"][3] == 4 and by_path["c"][3] == 5
    assert by_path["a.1.b"][4] == by_path["a.1"][2] and by_path["a.1.b"][5] == 3


def test_json_kinds():
    assert kinds("json", '{"k": true, "n": null, "l": [1.5]}') == [("", "object", ""), ("k", "boolean", "true"), ("n", "null", "null"), ("l", "array", ""), ("l.0", "number", "1.5")]


def test_toml_and_yaml():
    assert ("s.d", "datetime", "2024-01-01") in kinds("toml", "[s]\nd = 2024-01-01\ni = 3\nf = 1.5")
    assert {k for _, k, _ in kinds("yaml", "a: [1, x]\nb: !t v\nc: null")} == {"mapping", "sequence", "number", "string", "tagged", "null"}


def test_text_and_line_ends():
    assert [r[10] for r in trees.parse("x.txt", "a\r\nb\n")] == ["a\r\nb\n", "a", "b"]
    assert len(trees.parse("x.txt", "")) == 1 and len(trees.parse("x.txt", None)) == 1


def test_markdown_blocks():
    text = "# Title\n\npara *it* and **bold**\n\n```py\nx = 1\n```\n\n> quote\n\n---\n\n- one\n\n- two\n\nend\n\n1. first\n\n[l](u) `c`"
    rows = trees.parse("x.md", text)
    top = [r[9] for r in rows if r[5] == 1]
    assert top == ["heading_1", "paragraph", "code_block", "block_quote", "horizontal_rule", "list_unordered", "paragraph", "list_ordered", "paragraph"]
    assert [r[10] for r in rows if r[9] == "list_item"] == ["one", "two", "first"]
    # bold is looked for before italic, so that what stands before it is text
    assert [(r[9], r[10]) for r in rows if r[9] in ("bold", "italic", "link", "url", "inline_code")] == [("bold", "bold"), ("link", "l"), ("url", "u"), ("inline_code", "c")]


def test_css_rules():
    rows = kinds("css", "/* c */ body { margin: 0; color: red; }\n@media screen { a { top: 1px; } }")
    assert ("0.selector", "selector", "body") in rows and ("0.declarations.1.property", "property", "color") in rows
    assert ("1.name", "at_rule_name", "media") in rows and ("1.value", "at_rule_value", "screen") in rows
    assert any(k == "declaration" and c == "top: 1px;" for _, k, c in rows)
    assert trees.parse("x.css", "a {")[0][9] == "error"


def test_xml():
    rows = kinds("xml", '<?xml version="1.0"?>\n<!DOCTYPE r>\n<!-- n -->\n<r a="1">t<b/><![CDATA[x<y]]></r>')
    assert [k for p, k, _ in rows if "." not in p or k in ("xml_declaration", "doctype")][:5] == ["document", "xml_declaration", "doctype", "comment", "element"]
    assert ("cdata", "x<y") in [(k, c) for _, k, c in rows] and ("text", "t") in [(k, c) for _, k, c in rows] and ("value", "1") in [(k, c) for _, k, c in rows]
    assert ("element", "<b/>") in [(k, c) for _, k, c in rows]


def test_html_is_tolerant():
    rows = kinds("html", '<p id="x">a<br><b>c</p><script>if (1<2) {}</script>')
    assert ("raw_text", "if (1<2) {}") in [(k, c) for _, k, c in rows] and ("attribute_value", "x") in [(k, c) for _, k, c in rows]


@pytest.mark.parametrize(("ext", "text"), [("py", "def f(:\n  pass"), ("rs", "fn f() {"), ("slint", "component A { }}"), ("json", "{")])
def test_rejects(ext, text):
    row = trees.parse(f"x.{ext}", text)[0]
    assert row[9] == "error" and row[17].startswith("Syntax error")


def test_python_and_rust_items():
    py = trees.parse("x.py", "class A:\n    def m(self, x):\n        return g(x)\n")
    assert [(r[9], r[15]) for r in py if r[9].endswith("definition")] == [("class_definition", "A"), ("function_definition", "m")]
    rs = trees.parse("x.rs", "use a::b;\nstruct S { v: i32 }\nfn f() { g(1); }\n")
    assert [(r[9], r[15]) for r in rs if r[5] == 1] == [("use_declaration", "a"), ("struct_item", "S"), ("function_item", "f")]
    assert [(r[9], r[15], r[13]) for r in rs if r[9] == "call_expression"] == [("call_expression", "g", 9)]
    c = trees.parse("x.c", "int main(void) { return f(0); }")
    assert ("function_declaration", "main") in [(r[9], r[15]) for r in c]


def test_nodes_relation(spark):
    df = spark.createDataFrame([("a.json", json.dumps({"x": 1})), ("b.txt", "l"), ("c", None)], "file_path string, content string")
    got = {(r.file_path, r.seq): r.node_type for r in nodes(df).collect()}
    assert got == {("a.json", 0): "object", ("a.json", 1): "number", ("b.txt", 0): "text_file", ("b.txt", 1): "text_line", ("c", 0): "generic"}


def test_macro_bodies():
    rows = trees.parse("x.rs", 'fn f() { let a = json!({"name": "analyze", "version": 1}); if a != b { g!(x) } }')
    assert [(r[9], r[6]) for r in rows if r[9].startswith("json_")] == [("json_object", 0), ("json_key", 0), ("json_string", 1), ("json_key", 2), ("json_number", 3)]
    assert [r[9] for r in rows if r[9] == "macro_invocation"] == ["macro_invocation"] * 2
    assert len(trees.json_macro('["a", "b", 42]').children) == 3
    assert trees.parse("x.rs", "fn f() { json!(a b) }")[0][9] == "source_file"


def test_shell():
    text = "#!/bin/sh\n# note\nfunction go {\n  for x in a b; do\n    echo \"$x\" | grep -q '#' && run $x#1\n  done\n}\ncase $1 in\n  a) go;;\nesac\ngo 1\n"
    rows = trees.parse("x.sh", text)
    assert [(r[9], r[11], r[12]) for r in rows if r[9] in ("function_definition", "for_statement", "case_statement")] == [("function_definition", 3, 7), ("for_statement", 4, 6), ("case_statement", 8, 10)]
    assert [r[15] for r in rows if r[9] == "command"] == ["echo", "grep", "run", "go", "go"] and [r[10] for r in rows if r[9] == "comment"] == ["#!/bin/sh", "# note"]
    assert [r[10] for r in rows if r[9] in ("header", "pattern")] == ["x in a b", "$1 in", "a"] and ("word", "$x#1") in [(r[9], r[10]) for r in rows]
    assert trees.parse("x.sh", "if a; then b")[0][17].startswith("Syntax error: missing fi at line 1")


def test_qml():
    text = "import QtQuick 2.0\nItem {\n  id: root\n  property int n: 1 +\n    2\n  readonly property var v: [1,\n    2]\n  signal done(int x)\n  function f() { return { a: 1 } }\n  Text { text: n > 1 ? 'a' : 'b' }\n}\n"
    rows = trees.parse("x.qml", text)
    got = [(r[9], r[15], r[11], r[12]) for r in rows if r[9].startswith("ui_")]
    assert got == [("ui_import", "QtQuick", 1, 1), ("ui_object", "Item", 2, 11), ("ui_binding", "id", 3, 3), ("ui_property", "n", 4, 5), ("ui_property", "v", 6, 7), ("ui_signal", "done", 8, 8), ("ui_function", "f", 9, 9), ("ui_object", "Text", 10, 10), ("ui_binding", "text", 10, 10)]
    assert rows[0][8] == "root" and trees.parse("x.qml", "Item {")[0][9] == "error"
    from silvae.operators import edit

    put = edit.apply_op("qml", "Item {\n    property int a: 1\n    width: 2\n    Text {}\n}", {"type": "insert", "parent_path": "root.0", "position": 2, "content": "height: 3"})
    assert put.split("\n")[3] == "    height: 3"


def test_text_nodes_are_the_parser_s(spark):
    from silvae.sources.files import text_nodes

    df = spark.createDataFrame([("a.txt", "x\r\ny\n\nz"), ("b.txt", ""), ("c.txt", None), ("d.txt", "\n"), ("e.txt", "one")], "file_path string, content string")
    assert sorted(map(str, text_nodes(df).collect())) == sorted(map(str, nodes(df).collect()))


def test_json_of_any_depth(spark):
    from silvae.sources.files import json_nodes

    deep = "[" * 40 + "5" + "]" * 40
    df = spark.createDataFrame([("a", '{"x": 1, "y": [1, {"z": null, "w": "s [[{"}], "e": {}, "t": true}'), ("b", "nope"), ("c", deep), ("d", None), ("e", "5")], "file_path string, content string")
    got = {(r.file_path, r.path): (r.node_type, r.content, r.depth) for r in json_nodes(df).collect()}
    assert got["c", ".".join(["0"] * 40)] == ("number", "5", 40) and got["e", ""] == ("number", "5", 0) and ("b", "") not in got
    assert got["a", "y.1.w"] == ("string", "s [[{", 3) and got["a", "e"] == ("object", "", 1) and got["a", "y.1.z"] == ("null", "null", 3)
    assert len(got) == 9 + 41 + 1


def test_trees_are_written_by_the_tasks_that_parse(spark, tmp_path):
    """A run's trees don't pass through rows of Spark: its files are Arrow's own. They are the trees that a parse here and now gives, of known shape or not."""
    import pyarrow.parquet as pq

    from silvae.sources import files as source
    from silvae.sources.treestore import TreeStore

    rows = [(f"src/o{k}.rs", f"fn f{k}() {{ g{k}(); }}\n") for k in range(200)] + [("a.rs", "fn f( {"), ("b.rs", 'fn f() { "é"; }'), ("c.txt", "x\ny"), ("d.rs", None), ("e", "z"), ("f.rs", "fn é() { ü(); }")]
    given = spark.createDataFrame(rows, "file_path string, content string")
    store = TreeStore(spark, f"file://{tmp_path}/trees")
    assert sorted(map(tuple, store.nodes(given).collect()), key=str) == sorted(map(tuple, source.nodes(given).collect()), key=str)
    parts = list((tmp_path / "trees").glob("*/*.parquet"))
    assert parts and all("parquet-cpp-arrow" in pq.ParquetFile(p).metadata.created_by for p in parts)
    assert not list((tmp_path / "trees").glob("*/_temporary"))
    # nothing is parsed again, and nothing new is kept of it
    assert store.add(given) == 0 and len(store.runs()) == 1
