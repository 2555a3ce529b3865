"""The reader of languages with braces: outlines, places, errors, and no loss of any token."""

import random

import pytest

from silvae.plans.languages import SAMPLES
from silvae.sources import grammar, trees


def kinds(ext, text):
    return [(r[9], r[10]) for r in trees.parse(f"x.{ext}", text)]


@pytest.mark.parametrize("ext", sorted(SAMPLES))
def test_places_and_nesting(ext):
    text = SAMPLES[ext][0].replace("%1$d", "5")
    rows = trees.parse(f"x.{ext}", text)
    lines = text.split("\n")
    assert not rows[0][17] and not [r for r in rows if r[9] == "ERROR"] and len({r[9] for r in rows}) >= 20
    by_seq = {r[2]: r for r in rows}
    for r in rows[1:]:
        up = by_seq[r[4]]
        assert up[11] <= r[11] <= r[12] <= up[12] and up[2] < r[2] <= up[3]
        if ext != "svelte":
            # the content stands between its line and column and those of its end
            start = sum(len(x) + 1 for x in lines[: r[11] - 1]) + r[13]
            assert text[start : start + len(r[10])] == r[10]
            assert start + len(r[10]) == sum(len(x) + 1 for x in lines[: r[12] - 1]) + r[14]


def test_columns():
    rows = trees.parse("x.go", "func f() {\n\tg(1)\n}\n")
    assert [(r[9], r[11], r[13], r[12], r[14]) for r in rows if r[9] == "call_expression"] == [("call_expression", 2, 1, 2, 5)]


def test_errors_are_nodes_and_the_rest_is_read():
    got = kinds("js", "function f() { g(1; }\nfunction h() { i(2); }\n")
    assert ("ERROR", "(") in got and ("call_expression", "i(2)") in got and [c for k, c in got if k == "function_declaration"][1].startswith("function h")
    got = kinds("c", "int a() { b(); } }\nint c() { d(); }\n")
    assert ("ERROR", "}") in got and ("call_expression", "d()") in got
    assert ("ERROR", "{") in kinds("java", "class A { void m() { n(); }")
    assert trees.parse("x.rs", "fn f() { g(; }")[0][9] == "error"


def test_strings_and_comments_hold_no_code():
    for ext in ("js", "go", "c", "cpp", "java", "kt", "swift", "cs", "dart", "php", "rs"):
        head = "<?php " if ext == "php" else ""
        got = kinds(ext, head + 'f("a(b) { // x", 1); /* g(2) { */ h(3); // i(4)\n')
        assert [c for k, c in got if k == "call_expression"] == ['f("a(b) { // x", 1)', "h(3)"], ext


def test_precedence():
    def shape(text):
        rows = trees.parse("x.js", text)
        by = {r[2]: [x for x in rows if x[4] == r[2]] for r in rows}
        show = lambda r: f"({' '.join(show(c) for c in by[r[2]])})" if by[r[2]] else r[10]
        return show(by[0][0])

    assert shape("a + b * c - d") == "((a (b c)) d)"
    assert shape("a = b = c || d && e == f") == "(a (b (c (d (e f)))))"
    assert shape("!a.b(c)[0] ? d : e ? f : g") == "((((((a b) (c))) 0)) d (e f g))" or shape("a ? b : c ? d : e") == "(a b (c d e))"
    assert shape("a ** b << c < d") == "(((a b) c) d)"


def test_any_text_is_read_in_linear_time():
    r = random.Random(9)
    pieces = ["(", ")", "{", "}", "[", "]", "f", " x", ";", "\n", "=", "=>", "->", "if ", "else ", "class ", "fn ", "func ", "'", '"', "//", "/*", "*/", "<", ">", "::", ".", "?", ":", "1", "#", "@", "|", "case ", "try ", ","]
    for _ in range(400):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 60)))
        for ext in ("js", "c", "java", "go", "kt", "swift", "zig", "php", "cs", "dart", "cpp", "svelte"):
            rows = trees.parse(f"x.{ext}", text)
            assert rows[0][9] != "error" or "recursion" in (rows[0][17] or ""), (ext, text, rows[0][17])
    long = "int f(int a) { if (a > 1) { g(a); } return a + 1; }\n" * 2000
    assert sum(x[9] == "function_declaration" for x in trees.parse("x.c", long)) == 2000


def test_precedence_table_has_every_operator_once():
    ops = [o for row in grammar._ROWS for o in row.split()]
    assert len(ops) == len(set(ops))


def test_texts_of_one_shape_are_read_once(monkeypatch):
    """A text that differs from an earlier one in names and numbers alone gets its tree without being read; its rows are those of a reading."""
    from silvae.sources import grammar, trees

    parser = trees.braced(trees.GRAMMARS["rs"])
    monkeypatch.setitem(trees.PARSERS, "rs", parser)
    text = "use a::%s;\nstruct %s { v: i32 }\n\nfn %s(x: u8) {\n    // %s\n    if x > %d { g(1, %s); }\n}\n"
    texts = [text % (f"o{k}", "S" * (k + 1), f"f{k}", f"says {k}", 10**k, f"x{k}") for k in range(6)]
    texts += [t.replace("    if", "    match") for t in texts] + ["fn f() { json!(%s); }" % b for b in ("{x}", "[1]", "{x}", "[2]", "{x}")] + ["fn f( {", "fn g( {", "fn h( {", "", "\n", "\x01 a", "b a", "c a", "\x01 d"]
    want = [trees.columns("rs", trees.braced(trees.GRAMMARS["rs"])(t)) for t in texts[:12]]
    read = []
    own = grammar.Reader.read
    monkeypatch.setattr(grammar.Reader, "read", lambda self: read.append(self.text) or own(self))
    assert [trees.parse_columns("a.rs", t) for t in texts[:12]] == want
    # the second time a shape is met it is read to be kept
    assert read == texts[:2] + texts[6:8]
    for t in texts[12:]:
        known = trees.parse_columns("a.rs", t)
        with monkeypatch.context() as m:
            m.delattr(parser, "shaped")
            assert known == trees.parse_columns("a.rs", t), t
