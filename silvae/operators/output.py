"""Results as text: summaries, tables, JSON and a scaffold of code."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def as_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row: a table in Markdown. For results that a person reads; all rows meet in one text."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.agg(F.concat(F.lit(head), body).alias("value"))


def as_text(found: DataFrame) -> DataFrame:
    """(file, text): a search's results of each file, one line each."""
    line = F.format_string("  %d: %s %s [%s]", "line", "type", "name", "path")
    return found.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "seq", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def _items(text: str) -> list[tuple[str, str, list]]:
    """kind:name(children:[...], or nested items) separated by commas, as (kind, name, children)."""
    tokens = re.findall(r"[A-Za-z_]\w*|[:\[\](),]", text)
    at = 0

    def several(stop: str) -> list:
        nonlocal at
        out = []
        while at < len(tokens) and tokens[at] not in stop:
            if tokens[at] == ",":
                at += 1
                continue
            out.append(one())
        return out

    def one() -> tuple[str, str, list]:
        nonlocal at
        kind, name, kids = tokens[at], "", []
        at += 1
        if at < len(tokens) and tokens[at] == ":":
            name, at = tokens[at + 1], at + 2
        if at < len(tokens) and tokens[at] == "(":
            at += 1
            while at < len(tokens) and tokens[at] != ")":
                if tokens[at] == "name" and tokens[at + 1 : at + 2] == [":"]:
                    name, at = tokens[at + 2], at + 3
                elif tokens[at] == "children" and tokens[at + 1 : at + 3] == [":", "["]:
                    at += 3
                    kids += several("]")
                    at += 1
                elif tokens[at] == ",":
                    at += 1
                else:
                    kids.append(one())
            at += 1
        return kind, name, kids

    return several("")


def scaffold(plan: str) -> str:
    """Code of a plan ``language:items``, for Rust or Python."""
    language, _, items = plan.partition(":")
    if language.lower() not in ("rust", "python") or not items:
        raise ValueError(f"no scaffold of {plan!r}")
    rust = language.lower() == "rust"

    def emit(kind: str, name: str, kids: list, depth: int) -> list[str]:
        pad = "    " * depth
        inner = [line for k in kids for line in emit(*k, depth + 1)]
        if not rust:
            head = {"class": f"class {name}:", "fn": f"def {name}():"}.get(kind)
            return [pad + head, *(inner or [f"{pad}    pass", ""])] if head else [f"{pad}# {kind} {name}"]
        head = {"mod": f"pub mod {name} {{", "struct": f"pub struct {name} {{", "fn": f"pub fn {name}() {{", "impl": f"impl {name} {{"}.get(kind)
        if head is None:
            return [f"{pad}// {kind} {name}"]
        if kind == "struct":
            inner = [f"{pad}    pub {n}: String," for _, n, _ in kids] or [f"{pad}    // TODO: Add fields"]
        elif kind == "fn" and not kids:
            inner = [f"{pad}    unimplemented!()"]
        return [pad + head, *inner, pad + "}", ""]

    return "\n".join(line for i in _items(items) for line in emit(*i, 0))


def scaffolds(plans: DataFrame, key: str, plan: str = "plan") -> DataFrame:
    """(key, code, error): ``scaffold`` of each row's plan; a plan that none can be made of is an error."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for k, p in zip(pdf[key], pdf[plan], strict=True):
                try:
                    rows.append((k, scaffold(p or ""), None))
                except ValueError as e:
                    rows.append((k, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "code", "error"])

    return plans.select(key, plan).mapInPandas(run, f"{key} {dict(plans.dtypes)[key]}, code string, error string")
