"""Edits that are carried out: from operations to files, snapshots, log and journal.

A project keeps its side tables in one folder: ``backups``, ``log``, ``journal`` and, for each run,
what was decided and how far it has come. Everything is decided and written down before the first file is
replaced, each phase is marked when it is done, and none of them does anything twice. So a run that
was lost at any place can be carried on or, as long as not all its files are in place, taken back.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvae import schema
from silvae.functions.text import new_id
from silvae.operators import edit, side, temporal
from silvae.operators.sweep import apart
from silvae.sources import stores
from silvae.sources.shared import exists, folders, get_text, put_text


@dataclass(frozen=True)
class Project:
    """A project's side tables, in a folder that all executors share."""

    spark: SparkSession
    path: str

    def log(self) -> DataFrame:
        return stores.read_log(self.spark, f"{self.path}/log")

    def backups(self) -> DataFrame:
        return stores.read_stored(self.spark, f"{self.path}/backups", schema.BACKUPS)

    def journal(self) -> DataFrame:
        return self.spark.read.schema(schema.JOURNAL).json(f"{self.path}/journal")

    def begin(self, session_id: str) -> None:
        """The row that starts a session, unless there is one."""
        there = self.spark.createDataFrame([], schema.TRANSACTIONS)
        for name in ("log", "backups", "journal"):
            # an empty write makes each table, so that it can be read
            kind = {"log": schema.TRANSACTIONS, "backups": schema.BACKUPS, "journal": schema.JOURNAL}[name]
            empty = self.spark.createDataFrame([], kind).write.mode("append")
            empty.parquet(f"{self.path}/{name}") if name == "backups" else empty.json(f"{self.path}/{name}")
        there = self.log().where((F.col("session_id") == session_id) & (F.col("operation") == "SessionStart"))
        if there.isEmpty():
            stores.append_log(temporal.session_rows(self.spark, session_id, F.current_timestamp()), f"{self.path}/log")


#: Columns of what a run decides.
DONE = ["file_path string", "before string", "after string", "applied long", "error string", "was_healed boolean", "guard struct<tenths: int, level: string>", "id string", "before_hash string", "after_hash string"]


class Run:
    """A run's folder: what was decided (``done``), the rows for the side tables, and the marks of its phases."""

    #: Phases in order. From ``files`` on a run can only go forward.
    PHASES = ("snapshots", "staged", "files", "log", "journal")

    def __init__(self, project: Project, name: str | None = None):
        self.project, self.spark, self.name = project, project.spark, name or uuid.uuid4().hex
        self.path = f"{project.path}/runs/{self.name}"

    def marked(self, state: str) -> bool:
        return exists(self.spark, f"{self.path}/state-{state}")

    def mark(self, state: str, text: str = "") -> None:
        put_text(self.spark, f"{self.path}/state-{state}", text)

    def table(self, name: str, kind: str) -> DataFrame:
        return self.spark.read.schema(kind).parquet(f"{self.path}/{name}")

    def decide(self, rows: DataFrame, **how: str) -> None:
        """Write down (file_path, before, after, id, description, before_hash, after_hash) and all rows of side tables, and mark the run as decided."""
        rows.write.mode("overwrite").parquet(f"{self.path}/good")
        good = self.table("good", GOOD)
        now, none = F.current_timestamp(), F.lit(None).cast("string")
        stores.snapshot(good.select("file_path", F.col("before").alias("content")).distinct(), now).write.mode("overwrite").parquet(f"{self.path}/snapshots")
        log = good.select("id", now.alias("timestamp"), F.lit(how["operation"]).alias("operation"), "file_path", none.alias("node_path"), "before_hash", "after_hash", "description", F.lit(how["session_id"]).alias("session_id"), F.create_map().cast("map<string,string>").alias("metadata"))
        log.write.mode("overwrite").options(**stores.MICROS).json(f"{self.path}/log")
        notes = good.select(F.lit(how["actor"]).alias("actor"), F.lit("Auto").alias("entry_type"), F.concat_ws(" ", F.lit(how["operation"]), "file_path", "description").alias("message"), F.col("id").alias("transaction_id"))
        side.entries(notes).write.mode("overwrite").options(**stores.MICROS).json(f"{self.path}/journal")
        self.mark("decided", json.dumps(how))

    def _append(self, name: str) -> None:
        """Rows of a side table that it has not got yet."""
        there, key = {"snapshots": (self.project.backups, "backup_path"), "log": (self.project.log, "id"), "journal": (self.project.journal, "id")}[name]
        kind = {"snapshots": schema.BACKUPS, "log": schema.TRANSACTIONS, "journal": schema.JOURNAL}[name]
        own = self.spark.read.schema(kind)
        own = own.parquet(f"{self.path}/{name}") if name == "snapshots" else own.json(f"{self.path}/{name}")
        new = own.dropDuplicates([key]).join(apart(there().select(key)), key, "left_anti")
        {"snapshots": stores.append_backups, "log": stores.append_log, "journal": stores.append_journal}[name](new, f"{self.project.path}/{'backups' if name == 'snapshots' else name}")

    def _files(self) -> DataFrame:
        """The text that each file gets: of several rows of a file that of the last."""
        return self.table("good", GOOD).groupBy("file_path").agg(F.max_by("after", "id").alias("content"), F.min_by("before", "id").alias("before"))

    def _staged(self, name: str) -> DataFrame:
        return self.spark.read.schema(stores.STAGED).parquet(f"{self.path}/{name}")

    def carry_on(self) -> None:
        """Do the phases that are not done yet, in order."""
        for phase in self.PHASES:
            if self.marked(phase):
                continue
            if phase == "staged":
                stores.stage(self._files().select("file_path", "content"), self.name).write.mode("overwrite").parquet(f"{self.path}/staged")
            elif phase == "files":
                stores.publish(self._staged("staged")).count()
            else:
                self._append(phase)
            self.mark(phase)
        self.mark("committed")

    def take_back(self) -> None:
        """Bring back every file's old text, and remove what was staged; nothing of the run is in the log then."""
        if self.marked("files"):
            raise ValueError("all files of this run are in place; it can only be carried on")
        # old texts go over whatever is there, under another name than the new ones
        back = self._files().select("file_path", F.col("before").alias("content"))
        stores.stage(back, f"{self.name}-back").write.mode("overwrite").parquet(f"{self.path}/back")
        stores.publish(self._staged("back")).count()
        stores.unstage(back.select(F.concat("file_path", F.lit(f".silvae-{self.name}")).alias("staged"))).count()
        self.mark("taken-back")

    @property
    def open(self) -> bool:
        return self.marked("decided") and not self.marked("committed") and not self.marked("taken-back")


GOOD = "file_path string, before string, after string, id string, description string, before_hash string, after_hash string"


def recover(project: Project, forward: bool = True) -> list[tuple[str, str]]:
    """(run, what became of it) of each run that was decided and then lost: carried on, or, with ``forward`` off, taken back if its files are not all in place.

    After it every run's files are all new with their log rows, or all old without. What was lost before it was decided has touched nothing."""
    out = []
    for name in folders(project.spark, f"{project.path}/runs"):
        run = Run(project, name)
        if run.open:
            if forward or run.marked("files"):
                run.carry_on()
                out.append((name, "committed"))
            else:
                run.take_back()
                out.append((name, "taken back"))
    return out


def _carry_out(run: Run, good: DataFrame, **how: str) -> None:
    """Decide and carry out; if a write fails before all files are in place, they are brought back."""
    run.decide(good, **how)
    try:
        run.carry_on()
    except Exception:
        if not run.marked("files"):
            run.take_back()
        raise


def commit(project: Project, files: DataFrame, ops: DataFrame, session_id: str, description: str = "", actor: str = "silvae", force: bool = False, atomic: bool = True, operation: str = "Edit") -> DataFrame:
    """(file_path, applied, guard level, was_healed, error, id, written): carries a batch out on the files (file_path, content).

    Each file's edits are applied, guarded, parsed again and healed. What is decided is written down;
    then snapshots of the texts as they were, then the files, staged before the first is moved, then a
    row of the log and one of the journal for each. ``atomic``: nothing is written if any file failed."""
    run = Run(project)
    spark = project.spark
    project.begin(session_id)
    done = edit.guarded_edit(files, ops, force).withColumn("id", new_id("txn"))
    done = done.withColumn("before_hash", stores.content_hash(F.col("before"))).withColumn("after_hash", F.when(F.col("after").isNotNull(), stores.content_hash(F.col("after"))))
    done.withColumn("guard", F.col("guard").cast("struct<tenths: int, level: string>")).select(*(c.split()[0] for c in DONE)).write.parquet(f"{run.path}/done")
    done = spark.read.schema(", ".join(DONE)).parquet(f"{run.path}/done")
    good = done.where("error is null and after is not null")
    if atomic and not done.where("error is not null").isEmpty():
        good = good.limit(0)
    rows = good.select("file_path", "before", "after", "id", F.lit(description).alias("description"), "before_hash", "after_hash")
    _carry_out(run, rows, session_id=session_id, actor=actor, operation=operation)
    written = good.select("file_path", F.lit(True).alias("written"))
    return done.join(apart(written), "file_path", "left").select("file_path", "applied", F.col("guard.level").alias("level"), "was_healed", "error", "id", F.coalesce("written", F.lit(False)).alias("written"))


def _bring_back(project: Project, files: DataFrame, chosen: DataFrame, session_id: str) -> DataFrame:
    """(file_path, backup_path, written): the files (file_path, content) get the texts of chosen snapshots (file_path, hash, description, rank).

    The last rank of a file says its text; every row is logged. What is there now is kept as a snapshot as well."""
    run = Run(project)
    project.begin(session_id)
    found = temporal.snapshot_of(chosen, project.backups(), "hash")
    text = project.backups().select("backup_path", "source_code").dropDuplicates(["backup_path"])
    back = found.join(apart(text), "backup_path").join(apart(files.select("file_path", F.col("content").alias("before"))), "file_path")
    # ids grow with the rank, so that the last of a file is known by its id
    ids = F.concat(F.lit("txn_"), F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSSSSS"), F.lit("_"), F.lpad(F.col("rank").cast("string"), 10, "0"), F.lit("_"), F.substring(F.sha2(F.concat_ws("|", "file_path", "hash"), 256), 1, 32))
    made = back.select("file_path", "before", F.col("source_code").alias("after"), ids.alias("id"), "description", stores.content_hash(F.col("before")).alias("before_hash"), stores.content_hash(F.col("source_code")).alias("after_hash"))
    _carry_out(run, made, session_id=session_id, actor="silvae", operation="Restore")
    written = run.table("good", GOOD).select("file_path", F.lit(True).alias("written")).distinct()
    last = found.groupBy("file_path").agg(F.max_by("backup_path", "rank").alias("backup_path"))
    last.write.mode("overwrite").parquet(f"{run.path}/chosen")
    return run.table("chosen", "file_path string, backup_path string").join(apart(written), "file_path", "left").select("file_path", "backup_path", F.coalesce("written", F.lit(False)).alias("written"))


def _first_changes(rows: DataFrame, why: str) -> DataFrame:
    first = rows.groupBy("file_path").agg(F.min(F.struct("timestamp", "id", "before_hash")).alias("r"))
    return first.select("file_path", F.col("r.before_hash").alias("hash"), F.lit(why).alias("description"), F.lit(0).cast("long").alias("rank"))


def restore(project: Project, files: DataFrame, t, session_id: str) -> DataFrame:
    """(file_path, backup_path, written): brings the files (file_path, content) changed since ``t`` back to what they were before it.

    The snapshot taken before a file's first change since then is its text; what is there now is kept as a snapshot as well."""
    changed = temporal.mutating(project.log()).where(F.col("timestamp") > temporal.at(t))
    return _bring_back(project, files, _first_changes(changed, "restore"), session_id)


def restore_session(project: Project, files: DataFrame, restored: str, session_id: str) -> DataFrame:
    """``restore`` of the files that a session changed, to what they were before its first change of each."""
    changed = temporal.mutating(project.log()).where(F.col("session_id") == restored)
    return _bring_back(project, files, _first_changes(changed, f"restore session {restored}"), session_id)


def _stacks(log: DataFrame) -> DataFrame:
    """Rows that can be undone or redone: (id, file_path, timestamp, before_hash, after_hash, undone, turned), by what was said of each last.

    turned: when it was undone last. A row that was undone before a later change can't be redone."""
    said = log.where(F.col("operation") == "Restore").select(F.regexp_extract("description", r"^(undo|redo) (\S+)$", 1).alias("verb"), F.regexp_extract("description", r"^(undo|redo) (\S+)$", 2).alias("of"), F.struct("timestamp", "id").alias("at")).where("verb <> ''")
    last = said.groupBy(F.col("of").alias("id")).agg(F.max_by("verb", "at").alias("verb"), F.max("at").alias("turned"))
    own = temporal.reversible(log).where(~F.coalesce(F.col("description"), F.lit("")).rlike(r"^(undo|redo) \S+$"))
    newest = own.agg(F.max(F.struct("timestamp", "id")).alias("newest"))
    both = own.join(apart(last), "id", "left").crossJoin(F.broadcast(newest))  # one row
    undone = F.coalesce(F.col("verb") == "undo", F.lit(False))
    return both.where(~undone | (F.col("turned") > F.col("newest"))).select("id", "file_path", "timestamp", "before_hash", "after_hash", undone.alias("undone"), "turned")


def undo(project: Project, files: DataFrame, steps: int, session_id: str, redo: bool = False) -> DataFrame:
    """(file_path, backup_path, written): takes the last ``steps`` changes back, the latest first, on the files (file_path, content).

    With ``redo`` the changes that were undone last and not followed by another come back, the last undone first. Each step is
    logged as a Restore whose description names it; fewer changes than steps are all taken. Steps are chosen by a top-n, no session goes to one task."""
    stack = _stacks(project.log())
    if redo:
        top = stack.where("undone").orderBy(F.desc("turned")).limit(steps)
        place = F.row_number().over(Window.orderBy(F.desc("turned")))
    else:
        top = stack.where("not undone").orderBy(F.desc("timestamp"), F.desc("id")).limit(steps)
        place = F.row_number().over(Window.orderBy(F.desc("timestamp"), F.desc("id")))
    verb, side_ = ("redo", "after_hash") if redo else ("undo", "before_hash")
    chosen = top.withColumn("rank", place.cast("long")).select("file_path", F.col(side_).alias("hash"), F.concat(F.lit(f"{verb} "), "id").alias("description"), "rank")
    return _bring_back(project, files, chosen, session_id)
