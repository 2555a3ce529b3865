"""Trees of files as rows: nested-set numbering, and the parsers of data, markup and code.

Every parser gives a ``Node``; ``rows`` numbers it. A parser that fails gives a one-node tree of
type ``error`` whose message says where, so that a project with a broken file can still be queried.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, time
from html.parser import HTMLParser
from itertools import accumulate
from xml.parsers import expat

import numpy as np
import pyarrow as pa

from silvae.sources import grammar


@dataclass(slots=True)
class Node:
    kind: str
    content: str = ""
    path: str = ""
    start: int = 1
    end: int = 1
    start_col: int = 0
    end_col: int = 0
    children: list[Node] = field(default_factory=list)
    node_id: str | None = None

    def add(self, kind: str, content: str = "", path: str | None = None, start: int | None = None, end: int | None = None) -> Node:
        """A new last child; by default on this node's first line and at the next number below its path."""
        start = self.start if start is None else start
        at = path if path is not None else f"{self.path}.{len(self.children)}" if self.path else str(len(self.children))
        self.children.append(child := Node(kind, content, at, start, start if end is None else end))
        return child


#: Types whose content is a name.
NAMED = {"identifier", "name", "type_identifier", "field_identifier"}


def name_of(node: Node) -> str | None:
    """Own content, else that of a naming child, else of the first naming grandchild."""
    if node.kind in NAMED:
        return node.content
    for n in node.children:
        if n.kind in NAMED:
            return n.content
    for c in node.children:
        for n in c.children:
            if n.kind in NAMED:
                return n.content
    return None


def columns(ext: str, root: Node, error: str | None = None) -> list[list]:
    """The columns of the nodes relation behind the file's path, in pre-order."""
    nodes: list[Node] = []
    parents: list[int | None] = []
    depths: list[int] = []
    ordinals: list[int] = []
    stack: list[tuple[Node, int | None, int, int]] = [(root, None, 0, 0)]
    while stack:
        node, parent, depth, ordinal = stack.pop()
        seq = len(nodes)
        nodes.append(node)
        parents.append(parent)
        depths.append(depth)
        ordinals.append(ordinal)
        if node.children:
            k = len(node.children)
            for c in reversed(node.children):
                k -= 1
                stack.append((c, seq, depth + 1, k))
    n = len(nodes)
    ends = list(range(n))
    for seq in range(n - 1, 0, -1):
        up = parents[seq]
        if ends[up] < ends[seq]:
            ends[up] = ends[seq]
    paths = [x.path for x in nodes]
    return [
        [ext] * n, list(range(n)), ends, parents, depths, ordinals, [x.node_id or x.path for x in nodes], paths, [x.kind for x in nodes], [x.content for x in nodes], [x.start for x in nodes],
        [x.end for x in nodes], [x.start_col for x in nodes], [x.end_col for x in nodes], [name_of(x) for x in nodes], [len(x.children) for x in nodes], [error] + [None] * (n - 1),
    ]


def lines_of(text: str) -> list[str]:
    """Lines without their ends; an end of line at the end of the text begins no further line."""
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


# data -----------------------------------------------------------------------------------------


def _scalar(value) -> str:
    if value is True or value is False:
        return str(value).lower()
    return "null" if value is None else value.isoformat() if isinstance(value, date | time) else str(value)


def value_tree(value, kind_of: Callable[[object], str], path: str = "", last: int = 1) -> Node:
    """A tree of nested lists and mappings; keys and positions make the paths, containers have no content."""
    node = Node(kind_of(value), "", path, 1, last)
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
    if items is None:
        node.content = _scalar(value)
        return node
    for k, v in items:
        node.children.append(value_tree(v, kind_of, f"{path}.{k}" if path else str(k), last))
    return node


def _json_kind(v) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _toml_kind(v) -> str:
    if isinstance(v, date | time | datetime):
        return "datetime"
    return "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "float" if isinstance(v, float) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "table"


def _yaml_kind(v) -> str:
    return "tagged" if isinstance(v, _Tagged) else "sequence" if isinstance(v, list) else "mapping" if isinstance(v, dict) else "string" if isinstance(v, str | date) else _json_kind(v)


class _Tagged(str):
    __slots__ = ()


def parse_json(text: str) -> Node:
    return value_tree(json.loads(text), _json_kind, last=max(1, len(lines_of(text))))


def parse_toml(text: str) -> Node:
    return value_tree(tomllib.loads(text), _toml_kind)


def parse_yaml(text: str) -> Node:
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_multi_constructor("!", lambda loader, suffix, n: _Tagged(f"!{suffix} {n.value if isinstance(n.value, str) else ''}".strip()))
    return value_tree(yaml.load(text, Loader), _yaml_kind)  # noqa: S506  (a safe loader)


# text -----------------------------------------------------------------------------------------


def parse_text(text: str) -> Node:
    lines = lines_of(text) if text else []
    root = Node("text_file", text, "0", 1, max(1, len(lines)), node_id="root")
    for k, line in enumerate(lines):
        root.add("text_line", line, str(k), k + 1).node_id = f"line_{k}"
    return root


def parse_generic(text: str) -> Node:
    return Node("generic", text, "0", 1, max(1, len(lines_of(text))))


# markup ---------------------------------------------------------------------------------------

_HEADING, _FENCE, _QUOTE = re.compile(r"(#{1,6})\s+(.+)"), re.compile(r"```(\w*)\s*"), re.compile(r">\s*(.+)")
_RULE, _ITEM = re.compile(r"[-*_]{3,}\s*"), re.compile(r"\s*([-*+]|\d+\.)\s+(.+)")
#: Inline forms in the order in which each is looked for in what is left of a text.
_INLINE = [("link", re.compile(r"\[(.+?)\]\((.+?)\)")), ("bold", re.compile(r"\*\*(.+?)\*\*")), ("inline_code", re.compile(r"`(.+?)`")), ("italic", re.compile(r"\*(.+?)\*"))]


def inline(text: str) -> list[Node]:
    """Links, then bold, code and italic spans; what stands before a span that is found is text."""
    out: list[Node] = []

    def put(kind: str, content: str) -> Node:
        out.append(node := Node(kind, content, f"inline_{len(out)}"))
        return node

    while text:
        hit = next(((kind, m) for kind, form in _INLINE if (m := form.search(text))), None)
        if hit is None:
            put("text", text)
            break
        kind, m = hit
        if m.start():
            put("text", text[: m.start()])
        node = put(kind, m[1])
        if kind == "link":
            node.add("url", m[2], f"{node.path}.url")
        text = text[m.end() :]
    return out


def parse_markdown(text: str) -> Node:
    """Blocks of a document: headings, fenced code, quotes, rules, lists of items and paragraphs."""
    lines, at = lines_of(text), 0
    root = Node("document", "", "", 1, len(lines) + 1)

    def starts(line: str) -> bool:
        return any(form.fullmatch(line) for form in (_HEADING, _FENCE, _ITEM, _QUOTE, _RULE))

    while at < len(lines):
        line, first = lines[at], at + 1
        if not line.strip():
            at += 1
        elif m := _FENCE.fullmatch(line):
            end = next((k for k in range(at + 1, len(lines)) if lines[k].strip().startswith("```")), len(lines))
            node = root.add("code_block", "\n".join(lines[at + 1 : end]), start=first, end=end + 2)
            node.add("language", m[1], f"{node.path}.lang")
            at = end + 1
        elif m := _HEADING.fullmatch(line):
            node = root.add(f"heading_{len(m[1])}", m[2], start=first)
            node.add("level", str(len(m[1])), f"{node.path}.level")
            at += 1
        elif _QUOTE.fullmatch(line):
            held = []
            while at < len(lines) and lines[at].strip() and (m := _QUOTE.fullmatch(lines[at])):
                held.append(m[1])
                at += 1
            root.add("block_quote", "\n".join(held), start=first, end=at + 1)
        elif _RULE.fullmatch(line):
            root.add("horizontal_rule", "---", start=first)
            at += 1
        elif m := _ITEM.fullmatch(line):
            node = root.add("list_ordered" if "." in m[1] else "list_unordered", start=first)
            while at < len(lines) and (not lines[at].strip() or (m := _ITEM.fullmatch(lines[at]))):
                if lines[at].strip():
                    item = node.add("list_item", m[2], start=first + len(node.children))
                    item.add("text", m[2], f"{item.path}.text").children = inline(m[2])
                at += 1
            node.end = at + 1
        else:
            held = [line]
            at += 1
            while at < len(lines) and lines[at].strip() and not starts(lines[at]):
                held.append(lines[at])
                at += 1
            node = root.add("paragraph", "\n".join(held), start=first, end=at + 1)
            node.children = inline(node.content)
    return root


_DECLARATION = re.compile(r"([a-zA-Z-]+)\s*:\s*([^;]+)\s*;")


def parse_css(text: str) -> Node:
    """At-rules, rules and declarations, without comments. An unmatched brace is an error."""
    text = re.sub(r"/\*.*?\*/", "", text)

    def close(at: int) -> int:
        depth = 0
        for k in range(at, len(text)):
            depth += (text[k] == "{") - (text[k] == "}")
            if text[k] == "}" and depth == 0:
                return k
        raise ValueError("Unmatched brace in CSS")

    def block(lo: int, hi: int, path: str, line: int) -> Node:
        sheet = Node("stylesheet", "", path, line, line)
        while (opening := text.find("{", lo, hi)) >= 0:
            head, end = text[lo:opening], close(opening)
            at_rule = re.search(r"@([a-zA-Z-]+)\s*([^{]*)", head)
            whole = text[lo + (at_rule.start() if at_rule else 0) : end + 1]
            height = len(lines_of(whole))
            node = sheet.add("at_rule" if at_rule else "rule", whole, start=line, end=line + height)
            if at_rule:
                node.add("at_rule_name", at_rule[1], f"{node.path}.name")
                if at_rule[2].strip():
                    node.add("at_rule_value", at_rule[2].strip(), f"{node.path}.value")
                node.children.append(block(opening + 1, end, f"{node.path}.content", line))
            else:
                node.add("selector", head.strip(), f"{node.path}.selector")
                held = node.add("declarations", "", f"{node.path}.declarations")
                for m in _DECLARATION.finditer(text, opening + 1, end):
                    one = held.add("declaration", f"{m[1]}: {m[2].strip()};", start=held.end)
                    one.add("property", m[1], f"{one.path}.property")
                    one.add("value", m[2].strip(), f"{one.path}.value")
                    held.end += 1
            line += height
            lo = end + 1
        sheet.end = line
        return sheet

    return block(0, len(text), "", 1)


_EMPTY_TAG = re.compile(rb"""<[^<>"'/]*(?:"[^"]*"|'[^']*'|/(?!>)|[^<>"'/])*/>""")


def parse_xml(text: str) -> Node:
    """Declaration, doctype, comments, and elements with attributes, text and CDATA, as the XML parser meets them."""
    data = text.encode()
    root = Node("document", "", "0", 1, max(1, len(lines_of(text))), node_id="root")
    parser = expat.ParserCreate("UTF-8")
    open_: list[Node] = [root]
    begun: list[int] = []
    cdata: list[str] | None = None

    def where() -> int:
        return parser.CurrentLineNumber

    def element(name: str, attributes: dict) -> None:
        top = open_[-1]
        node = top.add("element", "", str(len(top.children)) if top is root else None, where())
        begun.append(parser.CurrentByteIndex)
        node.content = name
        if attributes:
            held = node.add("attributes", "", f"{node.path}.attributes")
            for k, (key, value) in enumerate(attributes.items()):
                held.add("name", key, f"{held.path}.{k}.name")
                held.add("value", value, f"{held.path}.{k}.value")
        open_.append(node)

    def done(_name: str) -> None:
        node, first = open_.pop(), begun.pop()
        at = parser.CurrentByteIndex
        empty = _EMPTY_TAG.match(data, first)
        stop = empty.end() if empty else data.find(b">", at) + 1
        node.content, node.end = data[first : stop or len(data)].decode(), where()

    def chars(value: str) -> None:
        if cdata is not None:
            cdata.append(value)
        elif value.strip() and len(open_) > 1:
            open_[-1].add("text", value.strip(), start=where())

    def cdata_open() -> None:
        nonlocal cdata
        cdata = []

    def cdata_close() -> None:
        nonlocal cdata
        open_[-1].add("cdata", "".join(cdata or []), start=where())
        cdata = None

    def comment(value: str) -> None:
        open_[-1].add("comment", f"<!--{value}-->", str(len(root.children)) if open_[-1] is root else None, where())

    def declaration(version: str, encoding: str | None, standalone: int) -> None:
        root.add("xml_declaration", text[: text.index("?>") + 2], "0.xml_declaration", where())

    def doctype(name: str, *_: object) -> None:
        at = text.index("<!DOCTYPE")
        root.add("doctype", text[at : text.index(">", at) + 1], f"{len(root.children)}.doctype", where())

    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = element, done, chars
    parser.CommentHandler, parser.XmlDeclHandler, parser.StartDoctypeDeclHandler = comment, declaration, doctype
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = cdata_open, cdata_close
    parser.Parse(data, True)
    return root


#: Elements of HTML that have no end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Html(HTMLParser):
    def __init__(self, lines: int):
        super().__init__(convert_charrefs=True)
        self.root = Node("document", "", "", 1, lines)
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        kind = {"script": "script_element", "style": "style_element"}.get(tag, "element")
        node = self.open[-1].add(kind, self.get_starttag_text() or "", start=self.getpos()[0])
        start = node.add("start_tag", node.content)
        start.add("tag_name", tag)
        for k, v in attrs:
            one = start.add("attribute", k if v is None else f'{k}="{v}"')
            one.add("attribute_name", k)
            if v is not None:
                one.add("attribute_value", v)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].children[0].children[0].content == tag), None)
        if at is not None:
            for node in self.open[at:]:
                node.end = self.getpos()[0]
            self.open[at].add("end_tag", f"</{tag}>", start=self.getpos()[0])
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if data.strip():
            kind = "raw_text" if self.open[-1].kind in ("script_element", "style_element") else "text"
            self.open[-1].add(kind, data.strip(), start=self.getpos()[0])

    def handle_comment(self, data: str) -> None:
        self.open[-1].add("comment", f"<!--{data}-->", start=self.getpos()[0])

    def handle_decl(self, decl: str) -> None:
        self.open[-1].add("doctype", f"<!{decl}>", start=self.getpos()[0])


def parse_html(text: str) -> Node:
    parser = _Html(max(1, len(lines_of(text))))
    parser.feed(text)
    parser.close()
    for node in parser.open[1:]:
        node.end = parser.root.end
    return parser.root


# code -----------------------------------------------------------------------------------------

#: Names of the Python grammar's nodes for classes of the ast module; other classes keep their name in snake case.
_PY = {
    "Module": "module", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Call": "call", "Name": "identifier",
    "Import": "import_statement", "ImportFrom": "import_from_statement", "If": "if_statement", "For": "for_statement", "While": "while_statement", "Try": "try_statement", "With": "with_statement",
    "Return": "return_statement", "Assign": "assignment", "AugAssign": "augmented_assignment", "Expr": "expression_statement", "Attribute": "attribute", "BinOp": "binary_operator", "Compare": "comparison_operator",
    "Dict": "dictionary", "List": "list", "Tuple": "tuple", "Raise": "raise_statement", "Lambda": "lambda", "arguments": "parameters", "arg": "identifier", "Pass": "pass_statement",
}


def parse_python(text: str) -> Node:
    """By Python's own grammar; a syntax error raises with its line and column."""
    root = Node("module", text, "", 1, max(1, len(lines_of(text))))

    def walk(node: ast.AST, up: Node) -> None:
        kind = type(node).__name__
        if not hasattr(node, "lineno") and not isinstance(node, ast.arguments):
            for child in ast.iter_child_nodes(node):
                walk(child, up)
            return
        if isinstance(node, ast.arguments):
            if not (node.args or node.kwonlyargs or node.posonlyargs or node.vararg or node.kwarg):
                return
            here = up.add("parameters")
        else:
            value = "string" if isinstance(node, ast.Constant) and isinstance(node.value, str) else "integer" if isinstance(node, ast.Constant) else _PY.get(kind) or re.sub(r"(?<!^)(?=[A-Z])", "_", kind).lower()
            here = up.add(value, ast.get_source_segment(text, node) or "", start=node.lineno, end=node.end_lineno)
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                here.add("identifier", node.name)
            if isinstance(node, ast.Attribute):
                walk(node.value, here)
                here.add("identifier", node.attr)
                return
        for child in ast.iter_child_nodes(node):
            walk(child, here)

    for child in ast.iter_child_nodes(ast.parse(text)):
        walk(child, root)
    return root


def json_macro(text: str) -> Node:
    """The body of a ``json!`` macro: keys at even places of an object and their values at odd ones; an array's items."""

    def build(value, path: str) -> Node:
        kind = f"json_{_json_kind(value)}"
        node = Node(kind, json.dumps(value), path)
        parts = [x for kv in value.items() for x in kv] if isinstance(value, dict) else value if isinstance(value, list) else []
        for k, x in enumerate(parts):
            at = f"{path}.{k}" if path else str(k)
            node.children.append(Node("json_key", x, at) if isinstance(value, dict) and k % 2 == 0 else build(x, at))
        return node

    return build(json.loads(text), "")


#: Parsers of macro bodies by the macro's name; what one cannot read stays text.
MACROS: dict[str, Callable[[str], Node]] = {"json": json_macro}

#: Types of what a word opens, in Rust and in the other languages.
_RUST = {"fn": "function_item", "struct": "struct_item", "enum": "enum_item", "trait": "trait_item", "impl": "impl_item", "mod": "mod_item", "use": "use_declaration", "type": "type_item"}
_OTHER = {"function": "function_declaration", "func": "function_declaration", "fun": "function_declaration", "class": "class_declaration", "interface": "interface_declaration", "struct": "struct_item", "enum": "enum_declaration", "trait": "trait_declaration", "namespace": "namespace_definition", "component": "component_definition", "import": "import_declaration", "use": "use_declaration"}


def _of(words: str) -> dict[str, str]:
    """The items of a language, by its words."""
    return {w: _OTHER[w] for w in words.split()}


_LOOPS, _ENDS = grammar._COMMON, grammar._PLAIN
_LOCAL = {"let": "let_declaration", "var": "variable_declaration", "const": "const_declaration", "val": "variable_declaration"}
_CHARS = r'"(?:\\.|[^"\\])*"|' + r"'(?:\\.[^'\n]*|[^'\\\n])'"


def _local(words: str) -> dict[str, str]:
    return _ENDS | {w: _LOCAL[w] for w in words.split()}


_SCRIPT = grammar.Grammar(_of("function class import") | {"interface": "interface_declaration", "enum": "enum_declaration", "namespace": "namespace_definition", "type": "type_declaration"}, plain=_local("let var const") | {"case": "switch_case", "default": "switch_default"}, modifiers="export default async static public private protected readonly abstract declare get set override", typed=True, newline=True)
_C = grammar.Grammar(_of("struct enum") | {"union": "union_item", "typedef": "type_definition"}, blocks=_LOOPS, plain=_ENDS | {"goto": "goto_statement", "case": "case_statement", "default": "default_statement"}, modifiers="static extern inline const unsigned signed volatile register", comments=grammar.SLASHES + r"|\#[^\n]*", strings=grammar.QUOTES, typed=True, imports=(), fields=(".", "->", "::"))
#: The languages with braces.
GRAMMARS = {
    "rs": grammar.Grammar(_RUST, blocks={**{k: v for k, v in _LOOPS.items() if k in ("if", "for", "while")}, "match": "match_expression", "loop": "loop_expression", "unsafe": "unsafe_block"}, plain={**_ENDS, "let": "let_binding", "const": "const_item", "static": "static_item"}, modifiers="pub async unsafe extern default", strings=r'b?r(?P<hash>#*)".*?"(?P=hash)|b?' + _CHARS, word=r"[A-Za-z_$][\w$]*(?:!(?=\s*[(\[{]))?|'[A-Za-z_]\w*", strict=True, macros=MACROS),
    "slint": grammar.Grammar(_of("component struct enum import") | {"global": "global_definition", "function": "function_declaration"}, plain={**_ENDS, "property": "property_declaration", "callback": "callback_declaration", "in": "property_declaration", "out": "property_declaration", "private": "property_declaration"}, modifiers="export pure public protected", strict=True, trailing=False),
    "js": _SCRIPT,
    "php": grammar.Grammar(_of("function class interface trait namespace use enum"), blocks={**_LOOPS, "foreach": "foreach_statement", "match": "match_expression"}, plain=_ENDS | {"echo": "echo_statement", "case": "case_statement", "default": "default_statement", "const": "const_declaration"}, modifiers="public private protected static abstract final readonly", comments=grammar.SLASHES + r"|\#[^\n\[][^\n]*|<\?php|\?>", fields=("->", "?->", "::")),
    "go": grammar.Grammar(_of("func import") | {"type": "type_declaration", "package": "package_clause"}, blocks={"if": "if_statement", "for": "for_statement", "switch": "switch_statement", "select": "select_statement"}, plain=_local("var const") | {"go": "go_statement", "defer": "defer_statement", "case": "case_clause", "default": "default_clause"}, newline=True, composite=True),
    "c": _C,
    "cpp": grammar.Grammar(_C.items | _of("class namespace") | {"using": "using_declaration", "template": "template_declaration"}, blocks=_LOOPS, plain=_C.plain | _ENDS, modifiers=_C.modifiers + " virtual explicit constexpr friend mutable", comments=_C.comments, strings=r'R"\((?:.*?)\)"|' + grammar.QUOTES, typed=True, imports=("using",), fields=(".", "->", "::")),
    "java": grammar.Grammar(_of("class interface enum import") | {"package": "package_declaration", "record": "record_declaration"}, plain=_ENDS | {"case": "switch_label", "default": "switch_label", "assert": "assert_statement"}, modifiers="public private protected static final abstract synchronized native default volatile transient", strings=grammar.TRIPLE + grammar.QUOTES, typed=True),
    "zig": grammar.Grammar({"fn": "function_declaration", "test": "test_declaration"}, blocks={"if": "if_statement", "for": "for_statement", "while": "while_statement", "switch": "switch_statement", "comptime": "comptime_statement"}, plain=_local("var const") | {"defer": "defer_statement", "errdefer": "defer_statement"}, modifiers="pub export extern inline", strings=r"\\\\[^\n]*|" + grammar.QUOTES, comments=r"//[^\n]*"),
    "kt": grammar.Grammar(_of("fun class interface import") | {"object": "object_declaration", "package": "package_header", "typealias": "type_alias"}, blocks={**_LOOPS, "when": "when_expression", "init": "init_block"}, plain=_local("val var"), modifiers="public private protected internal open abstract final override suspend data sealed inline enum companion lateinit const operator", strings=grammar.TRIPLE + grammar.QUOTES, newline=True, trailing=True),
    "swift": grammar.Grammar(_of("func class struct enum import") | {"protocol": "protocol_declaration", "extension": "extension_declaration", "typealias": "type_alias"}, blocks={**_LOOPS, "guard": "guard_statement", "repeat": "repeat_statement", "defer": "defer_statement", "init": "init_declaration", "do": "do_statement"}, plain=_local("let var") | {"case": "case_clause", "default": "default_clause"}, modifiers="public private fileprivate internal open static final override mutating lazy weak", strings=grammar.TRIPLE + grammar.QUOTES, newline=True, trailing=True),
    "cs": grammar.Grammar(_of("class interface struct enum namespace") | {"using": "using_directive", "record": "record_declaration"}, blocks={**_LOOPS, "foreach": "foreach_statement", "lock": "lock_statement"}, plain=_ENDS | {"case": "switch_label", "default": "switch_label", "yield": "yield_statement"}, modifiers="public private protected internal static readonly abstract sealed override virtual async partial const", strings=r'[$@]+"(?:""|[^"])*"|' + grammar.QUOTES, comments=grammar.SLASHES + r"|\#[^\n]*", typed=True),
    "dart": grammar.Grammar(_of("class enum import") | {"mixin": "mixin_declaration", "extension": "extension_declaration", "typedef": "type_alias"}, plain=_local("var const") | {"case": "case_statement", "default": "default_statement", "final": "variable_declaration"}, modifiers="static abstract late external factory", strings=grammar.TRIPLE + "r?" + grammar.QUOTES, typed=True, imports=("import",)),
}


#: Kinds of tokens that hold no end of line.
_ONE_LINE = ("word", "number", "op")


def _moved_in(node: Node, up: Node) -> None:
    """A tree that a macro's reader made, below its invocation."""
    new = up.add(node.kind, node.content)
    for c in node.children:
        _moved_in(c, new)


def _finish(parts: list, up: Node, reader: grammar.Reader) -> None:
    """The nodes of parts, below one. No closure: it would be a cycle that holds each text until the collector comes."""
    text, tokens, lines, starts, own = reader.text, reader.tokens, reader.lines, reader.starts, up.children
    before = f"{up.path}." if up.path else ""
    for part in parts:
        if isinstance(part, Node):
            _moved_in(part, up)
            continue
        kind, _, _, b = tokens[part.hi]
        a, first = tokens[part.lo][2], lines[part.lo]
        # a word, number or sign is on one line
        last = lines[part.hi] if kind in _ONE_LINE else reader.place(b - 1)[0]
        own.append(node := Node(part.kind, text[a:b], f"{before}{len(own)}", first, last, a - starts[first - 1], b - starts[last - 1]))
        if part.children:
            _finish(part.children, node, reader)


#: Nodes of shapes that a worker keeps for each language, shapes it remembers to have met once, and characters of a text whose shape is looked for.
SHAPES, MET, SHAPED = 1 << 17, 1 << 16, 1 << 15
#: What stands in a shape for a token whose text no rule of a grammar looks at.
_STANDS, _MACRO = {"number": "\2", "string": "\3", "comment": "\4"}, "\5"


class Shape:
    """What texts have in common whose tokens differ in names, numbers, strings and comments alone: the same tree over the same tokens.

    Columns of nodes in pre-order are kept but for those that the texts' own letters make: content, columns of characters, and name."""

    def __init__(self, reader: grammar.Reader, parts: list):
        flat: list[tuple] = []
        stack = [(part, 0, 1, k, str(k)) for k, part in reversed(list(enumerate(parts)))]
        while stack:
            part, up, depth, k, path = stack.pop()
            seq = len(flat) + 1
            flat.append((part, up, depth, k, path))
            stack.extend((c, seq, depth + 1, j, f"{path}.{j}") for j, c in reversed(list(enumerate(part.children))))
        n = len(flat) + 1
        self.n, self.seq = n, list(range(n))
        self.parents, self.depths, self.ordinals, self.paths = [None, *(f[1] for f in flat)], [0, *(f[2] for f in flat)], [0, *(f[3] for f in flat)], ["", *(f[4] for f in flat)]
        self.kinds, self.counts, self.none = ["source_file", *(f[0].kind for f in flat)], [len(parts), *(len(f[0].children) for f in flat)], [None] * n
        self.ends = list(range(n))
        for seq in range(n - 1, 0, -1):
            self.ends[self.parents[seq]] = max(self.ends[self.parents[seq]], self.ends[seq])
        many = len(reader.tokens)
        spans = [(f[0].lo % many, f[0].hi % many) for f in flat]
        self.first = [reader.lines[lo] for lo, _ in spans]
        self.last = [reader.place(reader.tokens[hi][3] - 1)[0] for _, hi in spans]
        # ends of blanks and of tokens alternate: that a token begins at has its number twice, its own end comes behind
        self.spans = [(2 * lo, 2 * hi + 1) for lo, hi in spans]
        self.lines = max(1, len(lines_of(reader.text)))
        #: A line begins so many characters before its first token.
        begin: dict[int, tuple[int, int]] = {}
        for k, (t, line) in enumerate(zip(reader.tokens, reader.lines, strict=True)):
            begin.setdefault(line, (2 * k, t[2] - reader.starts[line - 1]))
        self.from_, self.to = ([(x, *begin.get(line, (0, 0))) for x, line in zip(at, where, strict=True)] for at, where in (([x for x, _ in self.spans], self.first), ([x for _, x in self.spans], self.last)))
        below: list[list[int]] = [[] for _ in range(n)]
        for seq in range(1, n):
            below[self.parents[seq]].append(seq)
        named = [k in NAMED for k in self.kinds]
        #: The node whose content is a node's name, as ``name_of`` finds it; the one behind the last has none.
        self.names = [seq if named[seq] else next((c for c in below[seq] if named[c]), next((d for c in below[seq] for d in below[c] if named[d]), n)) for seq in range(n)]
        self.name_at, self.nameless = np.array([k % n for k in self.names]), np.array([k == n for k in self.names])
        self.cuts = np.array([x for x, _ in self.spans] + [x for _, x in self.spans], np.int64)
        self.moves = [np.array(c, np.int64).reshape(-1, 3).T for c in (self.from_, self.to)]
        self.fixed: list[pa.Array] | None = None

    def columns(self, ext: str, text: str, lengths: list[int]) -> list[list]:
        """``columns`` of a text of this shape, by the lengths of its blanks and tokens."""
        n, at = self.n, list(accumulate(lengths))
        contents = [text, *[text[at[a] : at[b]] for a, b in self.spans]]
        of = [*contents, None]
        return [
            [ext] * n, self.seq, self.ends, self.parents, self.depths, self.ordinals, self.paths, self.paths, self.kinds, contents, [1, *self.first], [self.lines, *self.last],
            [0, *[at[x] - at[k] + before for x, k, before in self.from_]], [0, *[at[x] - at[k] + before for x, k, before in self.to]], [of[k] for k in self.names], self.counts, self.none,
        ]

    def arrow(self, texts: list[str], lengths: list[list[int]]) -> list[pa.Array]:
        """What ``columns`` gives for all of several texts, one after the other, as Arrow, behind the extension."""
        n, m = self.n, len(texts)
        at = np.cumsum(np.array(lengths, np.int32), axis=1, dtype=np.int32)
        contents: list[str] = []
        for text, ends in zip(texts, at[:, self.cuts].tolist(), strict=True):
            contents.append(text)
            contents.extend([text[a:b] for a, b in zip(ends[: n - 1], ends[n - 1 :])])  # noqa: B905
        content = pa.array(contents, pa.string())

        def places(which: list[tuple[int, int, int]]) -> pa.Array:
            x, k, before = self.moves[which is self.to]
            out = np.zeros((m, n), np.int32)
            out[:, 1:] = at[:, x] - at[:, k] + before
            return pa.array(out.ravel())

        names = (np.arange(m)[:, None] * n + self.name_at).ravel()
        if self.fixed is None:
            last = [self.lines, *self.last]
            self.fixed = [pa.array(c, k) for c, k in ((self.seq, pa.int32()), (self.ends, pa.int32()), (self.parents, pa.int32()), (self.depths, pa.int32()), (self.ordinals, pa.int32()), (self.paths, pa.string()), (self.kinds, pa.string()), ([1, *self.first], pa.int32()), (last, pa.int32()), (self.counts, pa.int32()))]
        again = pa.array(np.tile(np.arange(n), m))
        seq, ends_, parents, depths, ordinals, paths, kinds, first, last, counts = (c.take(again) for c in self.fixed)
        name = content.take(pa.array(names, mask=np.tile(self.nameless, m)))
        return [seq, ends_, parents, depths, ordinals, paths, paths, kinds, content, first, last, places(self.from_), places(self.to), name, counts, pa.nulls(n * m, pa.string())]


class _Stands(dict):
    """What stands in a shape for each token: names, numbers, strings and comments for all of their kind. A bounded table."""

    def __init__(self, g: grammar.Grammar):
        super().__init__()
        self.told, self.token, self.macros = grammar.told_apart(g), grammar.token(g), g.macros

    def __missing__(self, t: str) -> str:
        kind = self.token.match(t).lastgroup
        if kind == "op":
            # a sign could look like what stands for others
            out = t if t > " " else f"\0{t}"
        elif kind != "word":
            out = _STANDS[kind] + "\n" * t.count("\n")
        elif t[-1] == "!":
            # what a macro's reader makes is not known by its tokens
            out = _MACRO if t[:-1] in self.macros else t
        else:
            out = t if t in self.told or t[0] == "'" else "\1"
        if len(self) >= MET:
            self.clear()
        if len(t) <= 64:
            self[t] = out
        return out


def braced(g: grammar.Grammar) -> Callable[[str], Node]:
    """The parser of a language with braces; its attribute ``shaped`` tells texts that need not be read, as their tree is known."""
    cut, shapes, met, held = grammar.cut(g), {}, set(), 0
    stands = _Stands(g)

    def parse(text: str) -> Node:
        reader = grammar.Reader(g, text)
        root = Node("source_file", text, "", 1, max(1, len(lines_of(text))))
        _finish(reader.read().children, root, reader)
        return root

    def shaped(text: str) -> tuple[Shape, list[int]] | None:
        """The shape of a text, if it was met before, and the lengths of its blanks and tokens. Texts with strings have none."""
        nonlocal held
        if not text or len(text) > SHAPED or grammar.QUOTED.search(text):
            return None
        pieces = cut.split(text)
        own = list(map(stands.__getitem__, pieces[1::2]))
        what = (*own, *pieces[::2])
        shape = shapes.get(what)
        if shape is None:
            # a token that goes over lines has no end of line before it; what a macro's reader makes is not known by its tokens
            if len(what) < 3 or any(x == _MACRO or x[-1:] == "\n" for x in own):
                return None
            if (code := hash(what)) not in met:
                # worth keeping once it is met again
                if len(met) >= MET:
                    met.clear()
                met.add(code)
                return None
            reader = grammar.Reader(g, text)
            shape = Shape(reader, reader.read().children)
            if held + shape.n > SHAPES:
                shapes.clear()
                held = 0
            held += shape.n
            shapes[what] = shape
        return shape, list(map(len, pieces))

    parse.shaped = shaped
    return parse


#: What opens and closes in the braces of a template, and its type.
_SVELTE = {"if": "if_statement", "each": "each_statement", "await": "await_statement", "key": "key_statement"}


class _Svelte(_Html):
    """Markup whose braces hold expressions, and blocks from ``{#if}`` to ``{/if}``; a script's text is read as its language."""

    def handle_data(self, data: str) -> None:
        if self.open[-1].kind == "script_element":
            first = self.getpos()[0]
            node = self.open[-1].add("raw_text", data.strip(), start=first, end=first + data.count("\n"))
            for c in braced(_SCRIPT)(data).children:
                _moved(c, node, first - 1)
            return
        if self.open[-1].kind == "style_element":
            super().handle_data(data)
            return
        line = self.getpos()[0]
        for m in re.finditer(r"\{([#:/@]?)((?:[^{}]|\{[^{}]*\})*)\}|[^{]+|\{", data):
            here = line + data.count("\n", 0, m.start())
            sign, body = m[1], (m[2] or "").strip()
            word = re.match(r"\w*", body)[0]
            top = self.open[-1]
            if m[2] is None:
                if m[0].strip():
                    top.add("text", m[0].strip(), start=here)
            elif sign == "#":
                node = top.add(_SVELTE.get(word, "block_statement"), m[0], start=here)
                node.add("block_start", m[0]).add("expression", body[len(word) :].strip())
                self.open.append(node)
            elif sign == ":":
                top.add("else_clause" if word == "else" else f"{word}_clause", m[0], start=here)
            elif sign == "/":
                at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].kind == _SVELTE.get(word, "block_statement")), None)
                if at is not None:
                    for node in self.open[at:]:
                        node.end = here
                    self.open[at].add("block_end", m[0], start=here)
                    del self.open[at:]
            else:
                top.add("html_expression" if sign == "@" else "expression", body, start=here)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].children and self.open[k].children[0].kind == "start_tag" and self.open[k].children[0].children[0].content == tag), None)
        if at is not None:
            for node in self.open[at:]:
                node.end = self.getpos()[0]
            self.open[at].add("end_tag", f"</{tag}>", start=self.getpos()[0])
            del self.open[at:]


def _moved(node: Node, up: Node, lines: int) -> None:
    new = up.add(node.kind, node.content, start=node.start + lines, end=node.end + lines)
    new.start_col, new.end_col = node.start_col, node.end_col
    for c in node.children:
        _moved(c, new, lines)


def parse_svelte(text: str) -> Node:
    parser = _Svelte(max(1, len(lines_of(text))))
    parser.feed(text)
    parser.close()
    for node in parser.open[1:]:
        node.end = parser.root.end
    return parser.root


_SHELL = re.compile(r"#[^\n]*|'[^']*'|\"(?:\\.|[^\"\\])*\"|;;|&&|\|\||[;|&(){}\n]|(?:\\.|[^\s;|&(){}'\"#\\]|(?<=\S)#)+", re.S)
_OPENS = {"if": ("if_statement", "fi"), "for": ("for_statement", "done"), "while": ("while_statement", "done"), "until": ("while_statement", "done"), "case": ("case_statement", "esac"), "{": ("block", "}"), "(": ("subshell", ")")}
_CLAUSES = {"then", "else", "elif", "do", "in", "!"}


def parse_shell(text: str) -> Node:
    """Commands with their names and words, functions, and statements with their ends; one without its end is an error."""
    tokens = [(m[0], text.count("\n", 0, m.start()) + 1) for m in _SHELL.finditer(text)]
    root = Node("program", text, "", 1, max(1, len(lines_of(text))))
    open_: list[tuple[Node, str]] = [(root, "")]
    command: Node | None = None
    k = 0
    while k < len(tokens):
        t, line = tokens[k]
        up = open_[-1][0]
        if t.startswith("#"):
            up.add("comment", t, start=line)
        elif t in ("\n", ";", ";;", "|", "||", "&", "&&"):
            command = None
        elif command is None and (t == "function" or [x for x, _ in tokens[k + 1 : k + 3]] == ["(", ")"]):
            name = tokens[k + 1][0] if t == "function" and k + 1 < len(tokens) else t
            k += 1 if t == "function" else 2
            if t == "function" and [x for x, _ in tokens[k + 1 : k + 3]] == ["(", ")"]:
                k += 2
            node = up.add("function_definition", name, start=line)
            node.add("identifier", name)
            open_.append((node, "function"))
        elif command is None and t in _OPENS:
            node = up.add(_OPENS[t][0], t, start=line)
            open_.append((node, _OPENS[t][1]))
            # what a loop runs over and what a case looks at are words, and no command
            command = node.add("header") if t in ("for", "case") else None
        elif len(open_) > 1 and t == open_[-1][1] and (command is None or t in "})"):
            command = None
            open_.pop()[0].end = line
            while len(open_) > 1 and open_[-1][1] == "function":
                open_.pop()[0].end = line
        elif command is None and t in _CLAUSES:
            pass
        elif command is None and open_[-1][1] == "esac" and k + 1 < len(tokens) and tokens[k + 1][0] == ")":
            up.add("pattern", t, start=line)
            k += 1
        elif t in ("(", ")", "{", "}"):
            command = None
        elif command is None:
            command = up.add("command", t, start=line)
            command.add("name", t)
        else:
            command.content = f"{command.content} {t}".strip()
            command.add("word", t, start=line)
        k += 1
    if len(open_) > 1:
        raise SyntaxError(f"missing {open_[-1][1]}", ("", open_[-1][0].start, 1, ""))
    return root


_QML = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[A-Za-z_][\w.]*|\S", re.S)


#: Operators after or before which a value goes on in the next line.
_OPEN_END = {"+", "-", "*", "/", "?", ":", "&", "|", "."}


def parse_qml(text: str) -> Node:
    """Objects with their properties, bindings, signals and functions; a brace without its partner is an error."""
    tokens = [(m[0], m.start(), text.count("\n", 0, m.start()) + 1) for m in _QML.finditer(text) if not m[0].startswith(("//", "/*"))]
    root = Node("program", text, "root", 1, max(1, len(lines_of(text))))

    def close(k: int) -> int:
        depth = 0
        for j in range(k, len(tokens)):
            depth += (tokens[j][0] in "{[(") - (tokens[j][0] in "}])")
            if depth == 0:
                return j
        raise SyntaxError("missing closing brace", ("", tokens[k][2], 1, ""))

    def value_end(k: int, hi: int) -> int:
        """The last token of a value that begins at k: up to the end of its line, brackets taken whole."""
        line = tokens[k][2]
        while True:
            j = close(k) if tokens[k][0] in ("{", "[", "(") else k
            line = tokens[j][2]
            if j + 1 >= hi or tokens[j + 1][0] == ";" or (tokens[j + 1][2] > line and tokens[j][0] not in _OPEN_END and tokens[j + 1][0] not in _OPEN_END):
                return j
            k = j + 1

    def make(up: Node, kind: str, name: str, lo: int, hi: int) -> Node:
        node = up.add(kind, text[tokens[lo][1] : tokens[hi][1] + len(tokens[hi][0])], start=tokens[lo][2], end=tokens[hi][2])
        node.add("identifier", name)
        return node

    def walk(lo: int, hi: int, up: Node) -> None:
        k = lo
        while k < hi:
            t = tokens[k][0]
            after = tokens[k + 1][0] if k + 1 < hi else ""
            if t in ("property", "readonly", "default", "required") and k + 2 < hi:
                j = next((x for x in range(k, min(hi, k + 8)) if tokens[x][0] in (":", ";") or tokens[x][2] > tokens[k][2]), min(hi, k + 8))
                end = value_end(j + 1, hi) if j < hi and tokens[j][0] == ":" and j + 1 < hi else j - 1
                make(up, "ui_property", tokens[j - 1][0], k, end)
            elif t in ("signal", "function") and k + 1 < hi:
                j = next((x for x in range(k, hi) if tokens[x][0] == "{"), None) if t == "function" else None
                end = close(j) if j is not None else value_end(k + 1, hi)
                make(up, f"ui_{t}", after, k, end)
            elif t == "import":
                end = next((x - 1 for x in range(k + 1, hi) if tokens[x][2] > tokens[k][2]), hi - 1)
                make(up, "ui_import", after, k, end)
            elif after == "{" and t[0].isalpha():
                end = close(k + 1)
                node = make(up, "ui_object", t, k, end)
                walk(k + 2, end, node)
            elif after == ":" and k + 2 < hi:
                end = value_end(k + 2, hi)
                make(up, "ui_binding", t, k, end)
            elif t in "{[(":
                end = close(k)
            elif t in "}])":
                raise SyntaxError("unexpected brace", ("", tokens[k][2], 1, ""))
            else:
                end = k
            k = end + 1

    walk(0, len(tokens), root)
    return root


_SQL = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:''|[^'])*'|\"[^\"]*\"|[A-Za-z_]\w*|\d[\w.]*|[<>!=]=|\S", re.S)


def parse_sql(text: str) -> Node:
    """Statements of keywords, identifiers, literals and operators: a tree of the text, not a plan."""
    root, node = Node("program", text, "", 1, max(1, len(lines_of(text)))), None
    begun = 0
    for m in _SQL.finditer(text):
        t, line = m[0], text.count("\n", 0, m.start()) + 1
        if t.startswith(("--", "/*")):
            (node or root).add("comment", t, start=line)
            continue
        if node is None:
            node, begun = root.add("statement", "", start=line), m.start()
        if t == ";":
            node.content, node.end, node = text[begun : m.end()], line, None
            continue
        kind = "string" if t[0] == "'" else "number" if t[0].isdigit() else "identifier" if t[0] == '"' or (t[0].isalpha() or t[0] == "_") and t.upper() not in SQL_WORDS else f"keyword_{t.lower()}" if t[0].isalpha() else "operator"
        node.add(kind, t, start=line)
    if node is not None:
        node.content, node.end = text[begun:], root.end
    return root


SQL_WORDS = set("SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE VIEW DROP ALTER JOIN LEFT RIGHT INNER OUTER FULL ON AS AND OR NOT NULL IN IS DISTINCT UNION ALL CASE WHEN THEN ELSE END WITH EXISTS BETWEEN LIKE ASC DESC".split())

PARSERS: dict[str, Callable[[str], Node]] = {}
_LATER: list[tuple[str, str, str]] = []


def register(extensions: str, parser: Callable[[str], Node]) -> None:
    """Make a parser known for space-separated extensions; a later one replaces an earlier one."""
    for e in extensions.split():
        PARSERS[e] = parser
        _LATER.append((e, parser.__module__, parser.__qualname__))


register("py", parse_python)
for _name, _more in {"rs": "", "slint": "", "js": "jsx mjs cjs ts tsx", "php": "", "go": "", "c": "h", "cpp": "cc cxx hpp hxx hh", "java": "", "zig": "", "kt": "kts", "swift": "", "cs": "", "dart": ""}.items():
    register(f"{_name} {_more}", braced(GRAMMARS[_name]))
register("bash sh", parse_shell)
register("qml", parse_qml)
register("html htm", parse_html)
register("svelte", parse_svelte)
register("sql", parse_sql)
register("css", parse_css)
register("xml svg xsl xsd rss atom", parse_xml)
register("md markdown", parse_markdown)
register("txt", parse_text)
register("toml", parse_toml)
register("json", parse_json)
register("yaml yml", parse_yaml)
_LATER.clear()


def registered() -> list[tuple[str, str, str]]:
    """(extension, module, name) of the parsers that were registered beside those of this module."""
    return list(_LATER)


def source() -> str:
    """The text of the modules that the parsers are in."""
    import inspect
    import sys

    return inspect.getsource(sys.modules[__name__]) + inspect.getsource(grammar)


def extension(file_path: str) -> str:
    return file_path.rsplit(".", 1)[-1] if "." in file_path.rsplit("/", 1)[-1] else ""


def shape_of(file_path: str, text: str | None) -> tuple[Shape, list[int]] | None:
    """The shape that a file's text has, if its parser knows one, and what ``Shape.arrow`` takes of the text."""
    parser = PARSERS.get(extension(file_path))
    try:
        return parser.shaped(text or "") if hasattr(parser, "shaped") else None
    except Exception:
        # it is told where the text is read
        return None


def parse_columns(file_path: str, text: str | None) -> list[list]:
    """The columns of one file's rows, without its path; null content is empty."""
    ext, text = extension(file_path), text or ""
    try:
        parser = PARSERS.get(ext, parse_generic)
        known = parser.shaped(text) if hasattr(parser, "shaped") else None
        return known[0].columns(ext, text, known[1]) if known else columns(ext, parser(text))
    except Exception as e:
        line, col = getattr(e, "lineno", None), getattr(e, "offset", None)
        where = f" at line {line}, column {col}" if line else ""
        return columns(ext, Node("error", text, "", 1, max(1, len(lines_of(text)))), f"Syntax error: {e.msg if isinstance(e, SyntaxError) else e}{where}")


def parse(file_path: str, text: str | None) -> list[tuple]:
    """The rows of one file."""
    found = parse_columns(file_path, text)
    return list(zip([file_path] * len(found[0]), *found, strict=True))
