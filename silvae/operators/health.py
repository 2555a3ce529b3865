"""Checks of parsers, snapshots and the log, and the catalogue of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvae.functions.text import context_line, error_class, error_line, suggestion
from silvae.sources.files import lines, nodes

#: A line of each language that its parser must accept.
SNIPPETS = {
    "py": "total = sum(range(3))", "rs": "struct Probe { n: u8 }", "js": "let probe = [1, 2].map(n => n + 1);", "ts": "type Probe = { n: number };", "go": "package probe\nvar n = 3", "java": "interface Probe { int n(); }", "c": "struct probe { int n; };",
    "cpp": "namespace probe { int n = 3; }", "html": "<p id=probe>n<br></p>", "css": ".probe > a { color: teal }", "json": "[1, {\"n\": null}]", "yaml": "- n\n- probe: 3", "toml": "n = 3", "sql": "delete from probe where n = 3",
    "sh": "for n in 1 2; do probe $n; done", "zig": "const n: u8 = 3;", "php": "<?php $n = probe(3);", "svelte": "{#if n}<b>{n}</b>{/if}", "dart": "int probe(int n) => n * 2;", "cs": "namespace Probe { enum N { A } }",
}


def parser_checks(spark: SparkSession) -> DataFrame:
    """(check, status, detail) of every parser on its line."""
    files = spark.createDataFrame([(f"check.{e}", t) for e, t in SNIPPETS.items()], "file_path string, content string")
    root = nodes(files).where("seq = 0")
    return root.select(F.concat(F.lit("parser "), "ext").alias("check"), F.when(F.col("error").isNull(), "pass").otherwise("fail").alias("status"), F.coalesce("error", F.lit("")).alias("detail"))


def backup_checks(backups: DataFrame, n: int = 3) -> DataFrame:
    """Whether the newest snapshots still have the content that their hash says."""
    newest = backups.orderBy(F.desc("timestamp"), "backup_path").limit(n)
    ok = F.sha2(F.coalesce("source_code", F.lit("")), 256) == F.col("content_hash")
    return newest.select(F.concat(F.lit("backup "), "backup_path").alias("check"), F.when(ok, "pass").otherwise("fail").alias("status"), F.lit("").alias("detail"))


def log_checks(log: DataFrame) -> DataFrame:
    """Whether there is a log, and whether its ids are unique."""
    n = log.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"))
    some = n.select(F.lit("log present").alias("check"), F.when(F.col("n") > 0, "pass").otherwise("warn").alias("status"), F.col("n").cast("string").alias("detail"))
    return some.unionByName(n.select(F.lit("log ids").alias("check"), F.when(F.col("n") == F.col("d"), "pass").otherwise("fail").alias("status"), (F.col("n") - F.col("d")).cast("string").alias("detail")))


def doctor(checks: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return checks.agg(count("pass"), count("fail"), count("warn"), F.bool_and(F.col("status") != "fail").alias("healthy"))


def diagnose(messages: DataFrame, message: Column, lang: Column, source: Column | None = None) -> DataFrame:
    """Messages with class, line, advice and the line of the source."""
    out = messages.withColumn("error_type", error_class(message)).withColumn("line", error_line(message)).withColumn("suggestion", suggestion(F.col("error_type"), lang))
    return out if source is None else out.withColumn("context_line", context_line(lines(source), F.col("line")))


def diagnostic_report(messages: DataFrame, tool: Column, file_path: Column, lang: Column, message: Column) -> DataFrame:
    """(file_path, value): a JSON report of each row: tool, file, language, whether it went well, and the error with class, line and advice if there is one."""
    kind = F.when(message.isNotNull(), F.struct(error_class(message).alias("type"), message.alias("message"), error_line(message).alias("line"), suggestion(error_class(message), lang).alias("suggestion")))
    report = F.struct(tool.alias("tool"), file_path.alias("file"), lang.alias("language"), F.when(message.isNull(), "ok").otherwise("error").alias("status"), kind.alias("error"))
    return messages.select(file_path.alias("file_path"), F.to_json(report).alias("value"))


#: Operations by name: whether they write, and where they are.
CATALOGUE = [
    ("analyze", False, "sources.files.nodes"), ("list", False, "operators.find.page"), ("show", False, "operators.find.at_path"), ("find", False, "operators.find.find"), ("search", False, "operators.find.search"),
    ("skeleton", False, "operators.find.skeleton"), ("inspect", False, "operators.code.inspect"), ("blast", False, "operators.code.blast"), ("graph", False, "operators.code.call_graph"), ("blueprint", False, "operators.code.blueprint"),
    ("diff", False, "operators.compare.diff"), ("refactor", False, "operators.compare.refactor"), ("edit", True, "operators.edit.guarded_edit"), ("insert", True, "operators.edit.guarded_edit"), ("delete", True, "operators.edit.guarded_edit"),
    ("clone", True, "operators.edit.clone_ops"), ("move", True, "operators.edit.clone_ops"), ("batch", True, "operators.edit.apply_batch"), ("diff-to-batch", False, "operators.patch.to_batch"), ("quick-replace", True, "functions.text.quick_replace"),
    ("quick-insert", True, "functions.text.quick_insert"), ("history", False, "operators.temporal.last_n"), ("undo", True, "operators.temporal.undo_targets"), ("redo", True, "operators.temporal.undo_targets"), ("restore-project", True, "operators.temporal.execute"),
    ("restore-files", True, "operators.temporal.files_before"), ("restore-session", True, "operators.temporal.session_plan"), ("tag", True, "operators.side.add_tags"), ("label", True, "operators.side.add_labels"), ("journal", True, "operators.side.entries"),
    ("report", False, "operators.side.report"), ("sense", False, "operators.semantic.sense"), ("propose", False, "operators.semantic.propose"), ("scaffold", False, "operators.output.scaffold"), ("lint", False, "operators.find.failed"), ("doctor", False, "operators.health.doctor"),
]


def commands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "command string, writes boolean, function string")
