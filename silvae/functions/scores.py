"""Scores: cosine similarity, edits under guard, risk, complexity, anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of other length, of none, or without a direction."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(ok, _dot(a, b) / F.when(norm > 0, norm)).otherwise(0.0)


#: Marks of logic that are counted once each.
MARKS = ["if ", "else", "for ", "while", "match ", "switch", "try", "catch", "unwrap", "expect"]


def complexity(text: Column) -> Column:
    """How many of the marks of logic occur."""
    return F.size(F.filter(F.array(*map(F.lit, MARKS)), lambda m: text.contains(m)))


def guard_tenths(old: Column, new: Column) -> Column:
    """The score of an edit in tenths: less for text, logic and comments lost."""
    lost = (F.octet_length(new) < F.floor(F.octet_length(old) / 2)) & (F.octet_length(old) > 100)
    plain = (complexity(new) < complexity(old)) & (complexity(old) > 2)
    comment = lambda t: t.contains("//") | t.contains("/*")
    return F.lit(10) - F.when(lost, 3).otherwise(0) - F.when(plain, 4).otherwise(0) - F.when(comment(old) & ~comment(new), 2).otherwise(0)


def guard_level(tenths: Column) -> Column:
    return F.when(tenths <= 3, "Critical").when(tenths <= 6, "Warning").when(tenths <= 9, "Notice").otherwise("Safe")


def risk(callers: Column, callees: Column, files: Column) -> Column:
    return (2.0 * callers + 0.5 * callees + 1.5 * files) / 10.0


def impact(risk_score: Column) -> Column:
    return F.when(risk_score < 0.2, "Low").when(risk_score < 0.5, "Medium").when(risk_score < 0.8, "High").otherwise("Critical")


def success_rate(done: Column, total: Column) -> Column:
    """1 where there was nothing to do."""
    return F.when(total == 0, 1.0).otherwise(done / F.nullif(total, F.lit(0)))


def percent_change(before: Column, after: Column) -> Column:
    """By how many percent a count changed, of 1 at least."""
    return F.abs(after - before) / F.greatest(before, F.lit(1)) * 100


def brace_density_ok(text: Column) -> Column:
    """Of 30 to 5000 bytes, and, beyond 100, with at most 15 braces in 100 bytes."""
    n = F.octet_length(text)
    dense = (n > 100) & (F.regexp_count(text, F.lit(r"[{}]")) / n > 0.15)
    return n.between(30, 5000) & ~dense


#: Forms of comments that stand for code left out, with the style of each.
ANCHORS = [
    (r"//\s*\.{3,}[^\n]*", "SlashSlash"),
    (r"//\s*(?:existing|rest of|previous|remaining|other)[^\n]*", "SlashSlash"),
    (r"/\*\s*\.{3,}[^*]*\*/", "SlashStar"),
    (r"#\s*\.{3,}[^\n]*", "Hash"),
    (r"#\s*(?:existing|rest of|previous|remaining|other)[^\n]*", "Hash"),
    (r"<!--\s*\.{3,}[^-]*-->", "Html"),
    (r"^\s*\.{3,}\s*$", "SlashSlash"),
]
_OPEN = {"SlashSlash": "^/+", "SlashStar": r"^(/\*)+|(\*/)+$", "Hash": "^#+", "Html": r"^(<!--)+|(-->)+$"}


def anchors(text: Column) -> Column:
    """Array of (text, start, stop, hint, style) of the anchors of a text, by place, in characters from 0.

    Of anchors that overlap the first stays, unless a later one has a hint and the one kept has none."""
    def of(form: str, style: str) -> Column:
        parts = F.split(text, form, -1)
        hits = F.regexp_extract_all(text, F.lit(form), 0)

        def place(hit: Column, i: Column) -> Column:
            before = F.length(F.array_join(F.slice(parts, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(hits, F.lit(1), i), ""))
            clean = F.trim(F.regexp_replace(hit, _OPEN[style], ""))
            hint = F.nullif(F.trim(F.regexp_replace(clean, r"^\.+|\.+$", "")), F.lit(""))
            return F.struct(before.alias("start"), (before + F.length(hit)).alias("stop"), hit.alias("text"), hint.alias("hint"), F.lit(style).alias("style"))

        return F.transform(hits, place)

    found = [of(form, style) for form, style in ANCHORS]
    kind = "array<struct<start:int,stop:int,text:string,hint:string,style:string>>"
    ordered = F.array_sort(F.flatten(F.array(*found)), lambda a, b: (a["start"] - b["start"]).cast("int"))

    def fold(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        better = x["hint"].isNotNull() & last["hint"].isNull()
        return F.when(F.size(acc) == 0, F.array(x)).when(x["start"] >= last["stop"], F.concat(acc, F.array(x))).when(better, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc)

    return F.aggregate(ordered.cast(kind), F.array().cast(kind), fold)
