"""Scalar functions over text, paths, messages and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from silvae.sources.files import lines


def preview(text: Column, size: int = 100) -> Column:
    """A text of up to ``size`` bytes whole, else its first characters and three dots."""
    return F.when(F.octet_length(text) > size, F.concat(F.left(text, F.lit(size - 3)), F.lit("..."))).otherwise(text)


def chunks(text: Column, size: int = 10_000, overlap: int = 1_000, beyond: int = 15_000) -> Column:
    """Overlapping pieces of a text of over ``beyond`` characters, the last of which ends with it; a shorter one whole."""
    step, n = size - overlap, F.length(text)
    count = F.ceil((n - size) / step).cast("int") + 1
    many = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.substring(text, k * step + 1, F.lit(size)))
    return F.when(n > beyond, many).otherwise(F.array(text))


#: What stands before a name in a preview, in the order in which they are looked for.
BEFORE_NAME = ["fn ", "struct ", "enum ", "trait ", "impl ", "type ", "mod ", "def ", "class ", "func ", "function ", "let ", "const ", "var ", "void ", "int ", "bool ", "string ", "property "]


def name_in_preview(text: Column) -> Column:
    """The word after the first of the patterns that occurs and has one."""
    tries = []
    for p in BEFORE_NAME:
        rest = F.ltrim(F.substring(text, F.instr(text, p) + len(p), F.length(text)))
        tries.append(F.when(F.instr(text, p) > 0, F.nullif(F.regexp_extract(rest, r"^[\p{L}\p{N}_]+", 0), F.lit(""))))
    return F.coalesce(*tries)


def parent_path(path: Column) -> Column:
    """All but the last segment; empty for a single one."""
    return F.when(path.contains("."), F.regexp_replace(path, r"\.[^.]*$", "")).otherwise("")


def last_index(path: Column) -> Column:
    """The last segment as a number, 0 if it is none."""
    return F.coalesce(F.substring_index(path, ".", -1).try_cast("int"), F.lit(0))


def tree_distance(a: Column, b: Column) -> Column:
    """Steps between two paths by way of what they have in common from the start."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    same = F.zip_with(F.slice(x, 1, F.least(F.size(x), F.size(y))), F.slice(y, 1, F.least(F.size(x), F.size(y))), lambda p, q: p == q)
    first = F.array_position(same, False)
    common = F.when(first > 0, first - 1).otherwise(F.least(F.size(x), F.size(y)))
    return F.size(x) + F.size(y) - 2 * common


def ancestors(path: Column) -> Column:
    """The path itself and all above it, from the top."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def quick_replace(text: Column, old: str, new: str) -> Column:
    """Every literal occurrence; a written \\n or \\t stands for the character."""
    plain = lambda s: s.replace("\\n", "\n").replace("\\t", "\t")
    return F.replace(text, F.lit(plain(old)), F.lit(plain(new)))


def quick_insert(text: Column, anchor: str, content: str, near: str | None = None, unique: bool = False) -> Column:
    """``content`` after each line in which the regular expression ``anchor`` is found; a final end of line stays.

    With ``near``, only if that text is in the ten lines from the anchor's on; with ``unique``, not if
    the content is in the five lines from there on."""
    rows, put = lines(text), content.rstrip()

    def one(line: Column, i: Column) -> Column:
        hit = line.rlike(anchor)
        if near:
            hit &= F.array_join(F.slice(rows, i + 1, F.lit(10)), "\n").contains(near)
        if unique:
            hit &= ~F.array_join(F.slice(rows, i + 1, F.lit(5)), "\n").contains(put)
        return F.when(hit, F.array(line, F.lit(put))).otherwise(F.array(line))

    return F.concat(F.array_join(F.flatten(F.transform(rows, one)), "\n"), F.when(text.endswith("\n"), "\n").otherwise(""))


def strip_side(path: Column) -> Column:
    """A path of a diff without the a/ and b/ of its sides."""
    return F.regexp_replace(F.regexp_replace(path, "^a/", ""), "^b/", "")


def safe_id(text: Column) -> Column:
    """An identifier for graph languages."""
    return F.translate(text, "./:-\\", "_____")


def indentation(line: Column) -> Column:
    return F.regexp_extract(line, r"^\s*", 0)


# messages --------------------------------------------------------------------------------------

#: Error classes by what a message contains, in order.
ERROR_CLASSES = [
    ("syntax_error", ["Validation failed", "invalid syntax"]),
    ("path_resolution", ["Could not resolve", "not found"]),
    ("guardian_block", ["GUARDIAN"]),
    ("parse_error", ["Failed to parse"]),
    ("io_error", ["Failed to read", "Failed to write"]),
]


def error_class(message: Column) -> Column:
    out = None
    for name, marks in ERROR_CLASSES:
        hit = F.lit(False)
        for m in marks:
            hit |= message.contains(m)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def error_line(message: Column) -> Column:
    """A word of digits and a comma, else the number after the first ``line``."""
    word = F.regexp_extract(message, r"(?:^|\s)\+?([0-9]+),(?=\s|$)", 1)
    after = F.regexp_extract(message, r"(?s)^.*?line ([0-9]+)", 1)
    return F.coalesce(F.nullif(word, F.lit("")).try_cast("int"), F.nullif(after, F.lit("")).try_cast("int"))


def suggestion(kind: Column, lang: Column) -> Column:
    """Advice for an error class and language."""
    syntax = F.when(lang == "py", "Check indentation, and the colon after def, if, for and while").when(lang == "rs", "Check semicolons, braces and type annotations").when(lang.isin("js", "ts"), "Check brackets, braces and semicolons").when(lang == "go", "Check imports and braces").when(lang.isin("java", "kt"), "Check return types and braces").otherwise("Check braces, semicolons and punctuation")
    return (
        F.when(kind == "syntax_error", syntax)
        .when(kind == "path_resolution", "List the skeleton of the file to see its paths")
        .when(kind == "guardian_block", "The edit may remove logic; review it, or force it")
        .when(kind == "parse_error", F.concat(F.lit("The parser of "), lang, F.lit(" could not read this file; check encoding and mixed content")))
        .when(kind == "io_error", "Check the path and its permissions")
    )


def context_line(lines: Column, line: Column) -> Column:
    return F.when(line > 0, F.try_element_at(lines, line))


# times -----------------------------------------------------------------------------------------


def user_timestamp(text: Column, zone: str = "UTC") -> Column:
    """RFC 3339 with its offset; else a local date and time with a space or T between."""
    offset = text.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$")
    local = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return F.when(offset, F.try_to_timestamp(text)).otherwise(F.to_utc_timestamp(local, zone))


def new_id(prefix: str) -> Column:
    """An id by time that cannot clash: all rows of a query have the same time, so the whole random part (122 bits) is kept."""
    return F.concat(F.lit(prefix + "_"), F.unix_micros(F.current_timestamp()).cast("string"), F.lit("_"), F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))


#: Forms that times are shown in.
DISPLAY = {"short": "HH:mm:ss", "long": "yyyy-MM-dd HH:mm:ss", "day": "yyyy-MM-dd"}


def display_time(at: Column, form: str = "long") -> Column:
    """A time as reports show it."""
    return F.date_format(at, DISPLAY[form])
