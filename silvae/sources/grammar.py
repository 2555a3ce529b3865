"""Trees of languages with braces from tables: one reader of statements and expressions for all of them.

A language is a ``Grammar``: how its comments and strings look, which words open items and statements
and what these are called, which words may stand before them, whether functions are known by a type
and a parameter list instead of a word, and whether the end of a line ends a statement. Expressions
are read by the precedence of operators. A bracket without its partner becomes a node of type ERROR
where it stands, unless the language is ``strict``; what comes after it is read as before.
"""

from __future__ import annotations

import contextlib
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

OPEN, CLOSE = "({[", ")}]"
#: Operators by how tightly they bind, the loosest first; those of the first row assign, and bind to the right.
_ROWS = ["= += -= *= /= %= &= |= ^= <<= >>= := ??= ||= &&= **= ~=", "?? ?:", "|| or", "&& and", "|", "^", "&", "== != === !== is as in instanceof <=>", "< > <= >=", ".. ..= ... ..<", "<< >> >>>", "+ -", "* / %", "**"]
PRECEDENCE = {op: k for k, row in enumerate(_ROWS) for op in row.split()}
_PREFIX = {"!", "-", "+", "*", "&", "~", "++", "--", "...", "new", "await", "typeof", "not", "yield", "delete", "mut", "ref", "move", "try", "throw", "@", "^"}
_OPERATORS = sorted({*PRECEDENCE, "->", "=>", "::", "?.", "!.", "?->", ".", "++", "--", "&&=", "#", "@", "!", "?", "~", ":", ";", ",", "\\", "!!"} - {"or", "and", "is", "as", "in", "instanceof"}, key=len, reverse=True)
_WORD = r"[A-Za-z_$][\w$]*"
LITERALS = {"true": "boolean_literal", "false": "boolean_literal", "null": "null_literal", "nil": "null_literal", "nullptr": "null_literal", "undefined": "null_literal"}

SLASHES = r"//[^\n]*|/\*.*?\*/"
QUOTES = r'"(?:\\.|[^"\\])*"|' + r"'(?:\\.|[^'\\\n])*'"
TRIPLE = r'"""(?:\\.|[^\\])*?"""|'

#: What follows a statement's block as a part of it, and its type.
TAILS = {"else": "else_clause", "catch": "catch_clause", "finally": "finally_clause", "rescue": "catch_clause"}
_COMMON = {"if": "if_statement", "for": "for_statement", "while": "while_statement", "switch": "switch_statement", "do": "do_statement", "try": "try_statement"}
_PLAIN = {"return": "return_statement", "break": "break_statement", "continue": "continue_statement", "throw": "throw_statement"}


@dataclass(frozen=True)
class Grammar:
    #: Types by the word that opens them: items with a name, statements with blocks, and statements that end with their line.
    items: dict[str, str]
    blocks: dict[str, str] = field(default_factory=lambda: _COMMON)
    plain: dict[str, str] = field(default_factory=lambda: _PLAIN)
    modifiers: str = ""
    comments: str = SLASHES
    strings: str = QUOTES + "|`(?:\\\\.|[^`\\\\])*`"
    word: str = _WORD
    #: Functions are a name with parameters before a block: after a type, and in blocks also without one.
    typed: bool = False
    #: An end of line ends a statement that is whole.
    newline: bool = False
    strict: bool = False
    #: A block behind a call is an argument of it.
    trailing: bool = False
    #: Words that bring in other files; their parts are plain identifiers.
    imports: tuple[str, ...] = ("use", "import", "package", "using")
    #: What stands between a value and a field of it.
    fields: tuple[str, ...] = (".", "?.", "!.", "::")
    #: A type before braces makes a value of it.
    composite: bool = False
    #: Readers of the bodies of macros by their name.
    macros: dict[str, Callable] = field(default_factory=dict)


@dataclass(slots=True)
class Part:
    """A node on its way: its type, first and last token, and children."""

    kind: str
    lo: int
    hi: int
    children: list = field(default_factory=list)


_TOKENS: dict[int, tuple[Grammar, re.Pattern]] = {}


def token(g: Grammar) -> re.Pattern:
    """The pattern of a language's tokens, made once."""
    if id(g) not in _TOKENS:
        operators = _OPERATORS if g.trailing else [o for o in _OPERATORS if o != "?:"]
        _TOKENS[id(g)] = g, re.compile(rf"(?P<comment>{g.comments})|(?P<string>{g.strings})|(?P<number>\d(?:\w|\.(?=\d))*)|(?P<word>{g.word})|(?P<op>{'|'.join(map(re.escape, operators))}|\S)", re.S)
    return _TOKENS[id(g)][1]


#: Signs without which a text has no strings.
QUOTED = re.compile("[\"'`\\\\]")


def cut(g: Grammar) -> re.Pattern:
    """The tokens of a text without strings as one group, at which it is cut. Brackets and words come first, as nothing else begins with them."""
    operators = _OPERATORS if g.trailing else [o for o in _OPERATORS if o != "?:"]
    return re.compile(rf"([()\[\]{{}};,]|{g.word}|{g.comments}|\d(?:\w|\.(?=\d))*|{'|'.join(map(re.escape, operators))}|\S)", re.S)


#: Words that rules of this module ask for by themselves.
_ASKED = "public private protected case default enum class function fun func fn val var const inout else while do repeat guard for foreach catch match when switch if try new await"


def told_apart(g: Grammar) -> frozenset[str]:
    """All words whose text decides how something is read; of every other word only its place matters."""
    return frozenset({*g.items, *g.blocks, *g.plain, *g.modifiers.split(), *g.imports, *g.macros, *TAILS, *_PREFIX, *LITERALS, *PRECEDENCE, *_ASKED.split()})


_END = re.compile("\n")
#: Signs at the beginning of a line that go on with the statement before it.
_GOES_ON = {*PRECEDENCE, ".", "?.", "?", ":", ",", "=>", "->", ")"} - {"*", "&", "-", "..."}


class Reader:
    def __init__(self, g: Grammar, text: str):
        self.g, self.text = g, text
        self.tokens = [(m.lastgroup, m[0], *m.span()) for m in token(g).finditer(text)]
        self.starts = [0] + [m.end() for m in _END.finditer(text)]
        self.lines = [bisect_right(self.starts, t[2]) for t in self.tokens]
        self.modifiers = frozenset(g.modifiers.split())
        self.partner, self.lost = self._brackets()

    def place(self, at: int) -> tuple[int, int]:
        """Line, from 1, and column, from 0, of a character."""
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1]

    def _brackets(self) -> tuple[dict[int, int], set[int]]:
        partner, lost, held = {}, set(), []
        for k, (kind, t, at, _) in enumerate(self.tokens):
            if kind != "op" or len(t) != 1:
                continue
            if t in OPEN:
                held.append(k)
            elif t in CLOSE:
                want = OPEN[CLOSE.index(t)]
                # an opening bracket that something else closes is lost, if its own kind is open below it
                while held and self.tokens[held[-1]][1] != want and any(self.tokens[h][1] == want for h in held):
                    lost.add(held.pop())
                if held and self.tokens[held[-1]][1] == want:
                    partner[held.pop()] = k
                else:
                    lost.add(k)
        lost.update(held)
        if self.g.strict and lost:
            k = min(lost)
            line, column = self.place(self.tokens[k][2])
            say = "missing closing brace" if self.tokens[k][1] in OPEN else "unexpected brace"
            raise SyntaxError(f"Syntax error: {say}", ("", line, column + 1, ""))
        return partner, lost

    # looking ------------------------------------------------------------------------------------

    def is_(self, k: int, hi: int, *texts: str) -> bool:
        return k < hi and (token := self.tokens[k])[1] in texts and token[0] in ("op", "word")

    def kind(self, k: int, hi: int) -> str:
        return self.tokens[k][0] if k < hi else ""

    def opens(self, k: int, hi: int, bracket: str) -> bool:
        return k in self.partner and k < hi and self.tokens[k][1] == bracket

    def ends_line(self, k: int, hi: int) -> bool:
        """Whether a statement that is whole before token k ends there because k begins a line."""
        return self.g.newline and 0 < k < hi and self.lines[k] > self.lines[k - 1] and not (self.tokens[k][0] == "op" and self.tokens[k][1] in _GOES_ON)

    def generic_end(self, k: int, hi: int) -> int:
        """Behind the type arguments that begin at k, or k."""
        if not self.is_(k, hi, "<"):
            return k
        depth = 0
        for j in range(k, min(hi, k + 60)):
            kind, t = self.tokens[j][:2]
            depth += {"<": 1, "<<": 2, ">": -1, ">>": -2, ">>>": -3}.get(t, 0)
            if depth <= 0:
                return j + 1
            if kind in ("comment", "string") or kind == "number" or (kind == "op" and t not in "<>,.?&*[]:" and t not in ("<<", ">>", ">>>", "::", "=>")):
                return k
        return k

    def function_at(self, k: int, hi: int, inside: bool) -> tuple[int, int] | None:
        """(name, its block or the end of its declaration) of a function that begins at k by its type, or, in a block, by its name alone."""
        j, name = k, None
        while j < hi:
            kind, t = self.tokens[j][:2]
            if kind == "word" and t not in self.g.blocks and t not in self.g.plain and t not in TAILS and t not in _PREFIX:
                name, j = j, self.generic_end(j + 1, hi)
            elif kind == "op" and t in ("*", "&", "::", "?", "~", "."):
                j += 1
            elif self.opens(j, hi, "[") and self.partner[j] == j + 1:
                j += 2
            else:
                break
            if self.opens(j, hi, "("):
                break
        if name is not None and self.is_(name - 1, hi, ".", "->", "?."):
            return None
        if name is None or not self.opens(j, hi, "(") or j != self.generic_end(name + 1, hi) or not (name > k or inside):
            return None
        j = self.partner[j] + 1
        if self.is_(j, hi, ";") and name > k and not self.g.newline and not self.is_(name - 1, hi, "::"):
            return name, j
        while j < hi and not self.opens(j, hi, "{"):
            # what may stand between parameters and block: types, throws, initialisers
            if self.tokens[j][0] != "word" and self.tokens[j][1] not in (":", "->", "::", ",", "*", "&", "<", ">", ".", "?", "(", ")", "[", "]") and self.tokens[j][0] != "number" or self.ends_line(j, hi):
                return None
            j = self.partner[j] + 1 if j in self.partner else j + 1
        return (name, j) if j < hi else None

    # statements ---------------------------------------------------------------------------------

    def sequence(self, lo: int, hi: int, up: Part) -> None:
        k = lo
        while k < hi:
            k = max(k + 1, self.statement(k, hi, up))

    def leaf(self, up: Part, kind: str, k: int) -> Part:
        up.children.append(part := Part(kind, k, k))
        return part

    def statement(self, k: int, hi: int, up: Part) -> int:
        g, (kind, t, _, _) = self.g, self.tokens[k]
        if kind == "comment":
            self.leaf(up, "comment", k)
            return k + 1
        if k in self.lost:
            self.leaf(up, "ERROR", k)
            return k + 1
        if t in (";", ",") and kind == "op":
            return k + 1
        if self.opens(k, hi, "{"):
            return self.block(k, up)
        if kind == "word" and t in ("public", "private", "protected") and self.is_(k + 1, hi, ":"):
            self.leaf(up, "access_specifier", k)
            return k + 2
        j = k
        while self.kind(j, hi) == "word" and self.tokens[j][1] in self.modifiers and j + 1 < hi and (self.kind(j + 1, hi) == "word" or self.is_(j + 1, hi, "(", "*", "&", "<", "[")):
            j = self.partner[j + 1] + 1 if self.opens(j + 1, hi, "(") and self.kind(self.partner[j + 1] + 1, hi) == "word" else j + 1
        if self.kind(j, hi) == "word":
            word = self.tokens[j][1]
            if word in g.items and (self.kind(j + 1, hi) in ("word", "string") or self.is_(j + 1, hi, "{", "<", "(", "*") and not self.is_(j + 2, hi, ")")):
                return self.item(k, j, hi, up)
            if (word in g.blocks or word in g.plain) and not (word == "try" and not self.opens(j + 1, hi, "{")):
                return self.keyword(j, hi, up)
            if g.typed and (at := self.function_at(j, hi, up.kind == "block")):
                return self.function(k, *at, up)
            if g.typed and self.kind(e := self.type_end(j, hi), hi) == "word" and e > j and self.is_(e + 1, hi, "=", ";", ",", "[", ":", ")") or (g.typed and e > j and self.kind(e, hi) == "word" and e + 1 == hi):
                return self.declaration(k, j, e, hi, up)
        return max(j + 1, self.expression(j, hi, up))

    def type_end(self, k: int, hi: int) -> int:
        """Behind the type that begins at k."""
        if self.kind(k, hi) != "word" or self.tokens[k][1] in LITERALS or self.tokens[k][1] in _PREFIX:
            return k
        j = self.generic_end(k + 1, hi)
        while self.is_(j, hi, ".", "::") and self.kind(j + 1, hi) == "word":
            j = self.generic_end(j + 2, hi)
        while self.is_(j, hi, "*", "&", "?") or self.opens(j, hi, "[") and self.partner[j] == j + 1:
            j = self.partner[j] + 1 if j in self.partner else j + 1
        return j

    def words(self, lo: int, hi: int, up: Part, kind: str = "identifier") -> None:
        """Words and literals from lo to hi as they stand, brackets opened."""
        for k in range(lo, hi):
            if self.tokens[k][0] in ("word", "string", "number", "comment"):
                self.leaf(up, {"word": kind, "string": "string_literal", "number": "number_literal"}.get(self.tokens[k][0], "comment"), k)

    def block(self, k: int, up: Part, kind: str = "block") -> int:
        end = self.partner[k]
        up.children.append(part := Part(kind, k, end))
        self.sequence(k + 1, end, part)
        return end + 1

    def arms(self, k: int, up: Part) -> int:
        """A block of patterns, each with an arrow to what it leads to, or of other statements."""
        end, at = self.partner[k], k + 1
        up.children.append(part := Part("block", k, end))
        while at < end:
            arrow = at
            while arrow < end and not self.is_(arrow, end, "=>", "->", ";", ":") and not (arrow > at and self.ends_line(arrow, end)):
                arrow = self.partner.get(arrow, arrow) + 1
            if self.is_(at, end, ",") or not self.is_(arrow, end, "=>", "->"):
                at = max(at + 1, self.statement(at, end, part))
                continue
            part.children.append(arm := Part("match_arm", at, arrow))
            while at < arrow:
                at = max(at + 1, self.expression(at, arrow, arm, bare=True))
            at = self.block(arrow + 1, arm) if self.opens(arrow + 1, end, "{") else self.statement(arrow + 1, end, arm) if arrow + 1 < end else arrow + 1
            arm.hi = at - 1
        return end + 1

    def item(self, k: int, j: int, hi: int, up: Part) -> int:
        word, kind = self.tokens[j][1], self.g.items[self.tokens[j][1]]
        up.children.append(part := Part(kind, k, j))
        for m in range(k, j):
            if self.tokens[m][0] == "word":
                self.leaf(part, "modifier", m)
        if word in self.g.imports:
            end = j + 1
            while end < hi and not self.is_(end, hi, ";") and not (self.g.newline and self.lines[end] > self.lines[end - 1]):
                end = self.partner.get(end, end) + 1
            self.words(j + 1, end, part)
            part.hi = end if self.is_(end, hi, ";") else end - 1
            return part.hi + 1
        at = j + 1
        function = "function" in kind
        if function and self.opens(at, hi, "(") and self.kind(self.partner[at] + 1, hi) == "word" and self.is_(self.partner[at] + 2, hi, "(", "<"):
            at = self.parameters(at, part)
        if self.is_(at, hi, "*"):
            at += 1
        at = self.type_parameters(at, hi, part)
        while self.kind(at, hi) == "word" and self.tokens[at][1] in self.g.items and self.kind(at + 1, hi) == "word" and word == "enum":
            at += 1
        if self.kind(at, hi) == "word":
            self.leaf(part, "identifier" if function or "mod" in kind or "namespace" in kind else "type_identifier", at)
            at = self.type_parameters(at + 1, hi, part)
        return self.rest_of(part, at, hi, function)

    def type_parameters(self, at: int, hi: int, up: Part) -> int:
        end = self.generic_end(at, hi)
        if end > at:
            up.children.append(part := Part("type_parameters", at, end - 1))
            self.words(at, end, part, "type_identifier")
        return end

    def rest_of(self, part: Part, at: int, hi: int, function: bool) -> int:
        """What comes behind an item's name: parameters, types, and a block or an end."""
        seen = not function
        while at < hi:
            if at in self.lost:
                # a block that never ends: what is in it is read as what follows
                self.leaf(part, "ERROR", at)
                part.hi = at
                return at + 1
            if self.opens(at, hi, "("):
                at, seen = self.parameters(at, part), True
            elif self.opens(at, hi, "{"):
                at = self.block(at, part)
                part.hi = at - 1
                return at
            elif self.is_(at, hi, ";") or seen and self.ends_line(at, hi):
                part.hi = at if self.is_(at, hi, ";") else at - 1
                return part.hi + 1
            elif self.is_(at, hi, "=", "=>"):
                at = self.expression(at + 1, hi, part)
            elif self.tokens[at][0] == "comment":
                self.leaf(part, "comment", at)
                at += 1
            else:
                if self.tokens[at][0] in ("word", "string", "number"):
                    self.words(at, at + 1, part, "type_identifier")
                at += 1
            part.hi = at - 1
        return at

    def parameters(self, k: int, up: Part) -> int:
        end = self.partner[k]
        if end > k + 1:
            up.children.append(part := Part("parameters", k, end))
            if self.g.typed:
                self.sequence(k + 1, end, part)
            else:
                at = k + 1
                while at < end:
                    at = self.parameter(at, end, part)
        return end + 1

    def parameter(self, k: int, hi: int, up: Part) -> int:
        """A name before its type, up to a comma; behind it."""
        at, named = k, False
        up.children.append(part := Part("parameter", k, k))
        while at < hi and not self.is_(at, hi, ","):
            generic = self.type_parameters(at, hi, part)
            if generic > at:
                at = generic
            elif at in self.lost:
                self.leaf(part, "ERROR", at)
                at += 1
            elif self.is_(at, hi, "="):
                at = self.expression(at + 1, hi, part)
            elif at in self.partner:
                self.words(at, self.partner[at] + 1, part, "type_identifier")
                at = self.partner[at] + 1
            else:
                if self.tokens[at][0] == "comment":
                    self.leaf(part, "comment", at)
                elif self.is_(at, hi, "val", "var", "const", "inout"):
                    self.leaf(part, "modifier", at)
                elif self.tokens[at][0] == "word" and self.tokens[at][1] not in _PREFIX and self.tokens[at][1][0] != "'":
                    self.leaf(part, "type_identifier" if named else "identifier", at)
                    named = True
                at += 1
            part.hi = at - 1
        return at + 1

    def function(self, k: int, name: int, block: int, up: Part) -> int:
        up.children.append(part := Part("method_declaration" if up.kind == "block" else "function_declaration", k, self.partner.get(block, block)))
        for m in range(k, name):
            if self.tokens[m][0] == "word":
                self.leaf(part, "modifier" if self.tokens[m][1] in self.modifiers else "type_identifier", m)
        self.leaf(part, "identifier", name)
        # of types that stand before the name the name is found all the same: it is what is called an identifier
        part.children.sort(key=lambda c: c.kind == "type_identifier")
        at = self.parameters(self.generic_end(name + 1, block), part)
        self.words(at, block, part, "type_identifier")
        return self.block(block, part) if block in self.partner else block + 1

    def declaration(self, k: int, j: int, name: int, hi: int, up: Part) -> int:
        up.children.append(part := Part("parameter" if up.kind == "parameters" else "variable_declaration", k, name))
        self.words(k, name, part, "type_identifier")
        part.children = [c for c in part.children if self.tokens[c.lo][1] not in self.modifiers]
        at = name
        while at < hi and not self.is_(at, hi, ";") and not self.ends_line(at, hi):
            at = max(at + 1, self.expression(at, hi, part)) if not self.is_(at, hi, ",", ":", ")") else at + 1
            part.hi = at - 1
            if up.kind == "parameters":
                break
        part.hi = at if self.is_(at, hi, ";") else at - 1
        return part.hi + 1

    def keyword(self, k: int, hi: int, up: Part) -> int:
        """A statement by its word, with the blocks and clauses that belong to it."""
        word = self.tokens[k][1]
        if word in ("case", "default") and word in self.g.plain:
            return self.label(k, hi, up)
        held = word in self.g.blocks or word in TAILS
        up.children.append(part := Part(self.g.blocks.get(word) or self.g.plain.get(word) or TAILS[word], k, k))
        at = k + 1
        while not held and self.kind(at, hi) == "word" and self.g.plain.get(self.tokens[at][1]) == part.kind:
            at += 1
        if not held and self.is_(at, hi, "<"):
            at = self.type_parameters(at, hi, part)
        while at < hi:
            if self.is_(at, hi, ";") and (not held or not self.g.newline):
                part.hi = at
                at += 1
                # an else behind a statement without a block
                if held and word == "if" and self.is_(at, hi, "else"):
                    at = self.keyword(at, hi, part)
                    part.hi = at - 1
                return at
            if not held and self.ends_line(at, hi):
                return at
            if held and self.opens(at, hi, "{"):
                at = self.arms(at, part) if word in ("match", "when", "switch") else self.block(at, part)
                part.hi = at - 1
                while self.is_(at, hi, *TAILS) and word not in TAILS or self.is_(at, hi, "while") and word in ("do", "repeat"):
                    at = self.keyword(at, hi, part) if self.tokens[at][1] in TAILS else self.expression(at + 1, hi, part)
                    part.hi = at - 1
                return at
            if held and self.tokens[at][0] == "word" and (self.tokens[at][1] in self.g.blocks or self.tokens[at][1] in self.g.plain):
                at = self.keyword(at, hi, part)
                part.hi = at - 1
                return at
            if word == "guard" and self.is_(at, hi, "else"):
                at += 1
            elif held and self.is_(at, hi, "|"):
                bar = next((j for j in range(at + 1, hi) if self.is_(j, hi, "|")), at)
                part.children.append(load := Part("payload", at, bar))
                self.words(at + 1, bar, load)
                at = bar + 1
            elif self.tokens[at][1] in (",", ":", ";", "->", "=>") and self.tokens[at][0] == "op":
                at += 1
            elif self.tokens[at][0] == "comment":
                self.leaf(part, "comment", at)
                at += 1
            elif word in ("for", "foreach", "catch") and self.opens(at, hi, "("):
                end = self.partner[at]
                part.children.append(head := Part("header", at, end))
                self.sequence(at + 1, end, head)
                at = end + 1
            else:
                at = max(at + 1, self.expression(at, hi, part, bare=held))
            part.hi = at - 1
        return at

    def label(self, k: int, hi: int, up: Part) -> int:
        """A case with its values, and the statements up to the next one."""
        up.children.append(part := Part(self.g.plain[self.tokens[k][1]], k, k))
        at = k + 1
        while at < hi and not self.is_(at, hi, ":", ";", "=>") and not self.ends_line(at, hi):
            at = max(at + 1, self.expression(at, hi, part, 2)) if not self.is_(at, hi, ",") else at + 1
        if self.is_(at, hi, ":", "=>"):
            at += 1
            while at < hi and not (self.tokens[at][0] == "word" and self.tokens[at][1] in ("case", "default")):
                at = max(at + 1, self.statement(at, hi, part))
        part.hi = at - 1
        return at

    # expressions --------------------------------------------------------------------------------

    def expression(self, k: int, hi: int, up: Part, least: int = 0, bare: bool = False) -> int:
        """One expression from k, added to ``up``; behind it. ``bare``: a block ends it, as behind the condition of a statement."""
        held = Part("", k, k)
        at = self.operand(k, hi, held, bare)
        while held.children and at < hi and not self.ends_line(at, hi):
            kind, t = self.tokens[at][:2]
            row = PRECEDENCE.get(t) if kind in ("op", "word") else None
            if row is None and kind == "op" and t == "." and "." not in self.g.fields:
                row = PRECEDENCE["+"]
            if kind == "op" and t == "?" and least <= 1 and not self.is_(at + 1, hi, ":") and self.question(at, hi):
                node = Part("conditional_expression", held.children[0].lo, at, [held.children.pop()])
                at = self.expression(at + 1, hi, node, 1, bare)
                if self.is_(at, hi, ":"):
                    at = self.expression(at + 1, hi, node, 0, bare)
            elif kind == "op" and t in ("=>", "->") and least == 0 and held.children[-1].kind in ("parenthesized_expression", "identifier", "call_expression"):
                node = Part("lambda_expression", held.children[0].lo, at, [held.children.pop()])
                at = self.block(at + 1, node) if self.opens(at + 1, hi, "{") else self.expression(at + 1, hi, node, 0, bare)
            elif row is not None and row >= least and at + 1 < hi and not self.is_(at + 1, hi, ")", "]", "}", ",", ";"):
                node = Part("assignment_expression" if row == 0 else "binary_expression", held.children[0].lo, at, [held.children.pop()])
                at = self.expression(at + 1, hi, node, row if row == 0 else row + 1, bare)
            else:
                break
            node.hi = at - 1
            held.children.append(node)
        up.children.extend(held.children)
        return at

    def question(self, k: int, hi: int) -> bool:
        """Whether a question mark has its colon in this statement."""
        depth = 0
        j = k + 1
        while j < hi and not self.is_(j, hi, ";", ",") and not self.ends_line(j, hi):
            depth += self.is_(j, hi, "?") - self.is_(j, hi, ":")
            if depth < 0:
                return True
            j = self.partner.get(j, j) + 1
        return False

    def operand(self, k: int, hi: int, up: Part, bare: bool) -> int:
        if k >= hi:
            return k
        kind, t = self.tokens[k][:2]
        if k in self.lost:
            self.leaf(up, "ERROR", k)
            return k + 1
        if kind in ("string", "number", "comment"):
            part = self.leaf(up, "comment" if kind == "comment" else f"{kind}_literal", k)
            return k + 1 if kind == "comment" else self.postfix(part, k + 1, hi, up, bare)
        if kind == "word" and t.endswith("!"):
            at = self.macro(k, up)
            return self.postfix(up.children[-1], at, hi, up, bare)
        if self.g.composite and self.opens(k, hi, "[") and self.partner[k] == k + 1 and self.kind(k + 2, hi) == "word" and self.opens(k + 3, hi, "{"):
            up.children.append(part := Part("composite_literal", k, self.partner[k + 3]))
            self.leaf(part, "type_identifier", k + 2)
            return self.block(k + 3, part)
        if kind == "word" and t in self.g.items and "function" in self.g.items[t] and self.is_(k + 1, hi, "(", "*") or kind == "word" and t in self.g.items and self.kind(k + 1, hi) == "word" and t in ("function", "class", "fun", "func"):
            return self.item(k, k, hi, up)
        if kind == "word" and t in self.g.blocks and not bare and not (t == "try" and not self.opens(k + 1, hi, "{")):
            return self.keyword(k, hi, up)
        if self.g.strict and kind == "op" and t in ("|", "||"):
            # a closure's parameters stand between bars
            up.children.append(part := Part("closure_expression", k, k))
            bar = k if t == "||" else next((j for j in range(k + 1, hi) if self.is_(j, hi, "|")), k)
            self.words(k + 1, bar, part)
            at = self.expression(bar + 1, hi, part)
            part.hi = at - 1
            return at
        if t in _PREFIX and kind in ("op", "word") and k + 1 < hi and not self.is_(k + 1, hi, ")", ";", ",", "=", ".") and not (kind == "word" and self.is_(k + 1, hi, "(")):
            up.children.append(part := Part({"new": "new_expression", "await": "await_expression", "@": "annotation"}.get(t, "unary_expression"), k, k))
            at = self.operand(k + 1, hi, part, bare)
            part.hi = at - 1
            return at
        if kind == "word":
            part = self.leaf(up, LITERALS.get(t, "identifier"), k)
            return self.postfix(part, k + 1, hi, up, bare)
        if k in self.partner:
            if t == "{":
                return self.block(k, up)
            end = self.partner[k]
            up.children.append(part := Part("parenthesized_expression" if t == "(" else "array_expression", k, end))
            self.sequence(k + 1, end, part)
            return self.postfix(part, end + 1, hi, up, bare)
        return k + 1

    def postfix(self, part: Part, at: int, hi: int, up: Part, bare: bool) -> int:
        """Fields, calls and indexes behind an operand."""

        def wrap(kind: str, end: int) -> Part:
            up.children[-1] = new = Part(kind, part.lo, end, [part])
            return new

        while at < hi:
            generic = self.generic_end(at, hi) if part.kind in ("identifier", "field_expression") else at
            if self.is_(at, hi, "::") and (turbo := self.generic_end(at + 1, hi)) > at + 1:
                generic = turbo
            if generic > at and self.opens(generic, hi, "("):
                at = generic
            elif generic > at and (generic >= hi or self.is_(generic, hi, "=", ")", ",", ";", "{", ">", "]")) and not self.is_(at, hi, "::"):
                part = wrap("generic_type", generic - 1)
                self.words(at, generic, part, "type_identifier")
                at = generic
                continue
            if self.is_(at, hi, *self.g.fields) and self.kind(at + 1, hi) == "word":
                macro = self.tokens[at + 1][1].endswith("!")
                part = wrap("field_expression", at + 1)
                self.leaf(part, "field_identifier" if not macro else "macro_invocation", at + 1)
                at += 2
            elif self.opens(at, hi, "(") and not (self.g.newline and self.lines[at] > self.lines[at - 1]) and part.kind not in ("number_literal", "string_literal"):
                part = wrap("call_expression", self.partner[at])
                self.arguments(at, part)
                at = self.partner[at] + 1
            elif self.opens(at, hi, "[") and self.lines[at] == self.lines[at - 1]:
                part = wrap("index_expression", self.partner[at])
                self.sequence(at + 1, self.partner[at], part)
                at = self.partner[at] + 1
            elif self.g.trailing and not bare and self.opens(at, hi, "{") and part.kind in ("call_expression", "field_expression") and self.lines[at] == self.lines[at - 1]:
                part = part if part.kind == "call_expression" else wrap("call_expression", at)
                part.hi = self.partner[at]
                at = self.block(at, part)
            elif self.is_(at, hi, "++", "--") or self.is_(at, hi, "?", "!", "!!") and self.lines[at] == self.lines[at - 1] and (at + 1 >= hi or self.is_(at + 1, hi, ";", ")", ".", ",", "}")):
                part = wrap("postfix_expression", at)
                at += 1
            else:
                break
        return at

    def arguments(self, k: int, up: Part) -> None:
        end = self.partner[k]
        if end > k + 1:
            up.children.append(part := Part("arguments", k, end))
            self.sequence(k + 1, end, part)

    def macro(self, k: int, up: Part) -> int:
        close = self.partner.get(k + 1, k)
        up.children.append(part := Part("macro_invocation", k, close))
        reader = self.g.macros.get(self.tokens[k][1][:-1])
        if reader and close > k:
            with contextlib.suppress(ValueError):
                part.children.append(reader(self.text[self.tokens[k + 1][3] : self.tokens[close][2]]))
        return close + 1

    def read(self) -> Part:
        root = Part("source_file", 0, len(self.tokens) - 1)
        self.sequence(0, len(self.tokens), root)
        return root
