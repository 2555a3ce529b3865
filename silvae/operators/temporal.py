"""The transaction log and its snapshots: history, as-of look-ups, restoration plans, undo and redo.

Ties in time are broken by id; of equal rows the last one is the latest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvae.functions.scores import success_rate
from silvae.schema import MUTATING, REVERSIBLE


def at(t: str | Column) -> Column:
    return F.to_timestamp_ntz(F.lit(t)) if isinstance(t, str) else t


def mutating(log: DataFrame) -> DataFrame:
    return log.where(F.col("operation").isin(*MUTATING))


def reversible(log: DataFrame) -> DataFrame:
    return log.where(F.col("operation").isin(*REVERSIBLE))


def of_file(log: DataFrame, file_path: str) -> DataFrame:
    return log.where(F.col("file_path") == file_path)


def since(log: DataFrame, t: str | Column) -> DataFrame:
    return log.where(F.col("timestamp") >= at(t))


def between(log: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    return log.where(F.col("timestamp").between(at(start), at(end)))


def of_session(log: DataFrame, session_id: str) -> DataFrame:
    return log.where(F.col("session_id") == session_id)


def by_id(log: DataFrame, id_: str, current: str | None = None) -> DataFrame:
    """The row of an id, that of the current session before all others."""
    rank = (F.col("session_id") == current).cast("int") if current else F.lit(0)
    return log.where(F.col("id") == id_).orderBy(rank.desc(), "timestamp").limit(1)


def last_n(log: DataFrame, n: int) -> DataFrame:
    """The last rows, in the order of the log."""
    return log.orderBy(F.desc("timestamp"), F.desc("id")).limit(n).orderBy("timestamp", "id")


def touched_since(log: DataFrame, t: str | Column) -> DataFrame:
    return mutating(since(log, t)).select("file_path").distinct()


def session_files(log: DataFrame, session_id: str) -> DataFrame:
    return mutating(of_session(log, session_id)).select("file_path").distinct()


def changes_since(log: DataFrame, t: str | Column) -> DataFrame:
    return mutating(since(log, t)).groupBy("file_path").agg(F.count("*").alias("modifications"))


def session_start(log: DataFrame, session_id: str) -> DataFrame:
    return of_session(log, session_id).agg(F.min("timestamp").alias("start"))


def stats(log: DataFrame, backups: DataFrame) -> DataFrame:
    """One row: snapshots, transactions, distinct files, oldest and newest snapshot."""
    b = backups.agg(F.count("*").alias("backups"), F.count_distinct("original_file_path").alias("files"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))
    return b.crossJoin(log.agg(F.count("*").alias("transactions")))


def last_before(log: DataFrame, t: str | Column) -> DataFrame:
    """Of each file its last mutating row before t."""
    row = F.struct("timestamp", "id", "operation", "after_hash")
    return mutating(log).where(F.col("timestamp") < at(t)).groupBy("file_path").agg(F.max(row).alias("r")).select("file_path", "r.*")


def next_after(log: DataFrame, t: str | Column) -> DataFrame:
    """Of each file its first mutating row after t."""
    row = F.struct("timestamp", "id", "operation", "before_hash")
    return mutating(log).where(F.col("timestamp") > at(t)).groupBy("file_path").agg(F.min(row).alias("r")).select("file_path", "r.*")


def with_neighbours(log: DataFrame, slice_: str = "day") -> DataFrame:
    """Mutating rows with the one before and after in their file.

    Each file is cut into slices of time, so that one with very many rows is shared out; what lies
    across a border comes from a table of the slices' first and last rows."""
    row = F.struct("timestamp", "id", "before_hash", "after_hash")
    rows = mutating(log).withColumn("__slice", F.date_trunc(slice_, F.col("timestamp")))
    w = Window.partitionBy("file_path", "__slice").orderBy("timestamp", "id")
    ends = rows.groupBy("file_path", "__slice").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    over = Window.partitionBy("file_path").orderBy("__slice")
    ends = ends.select("file_path", "__slice", F.lag("last").over(over).alias("__before"), F.lead("first").over(over).alias("__after"))
    both = rows.withColumn("__lag", F.lag(row).over(w)).withColumn("__lead", F.lead(row).over(w)).join(ends, ["file_path", "__slice"])
    return both.withColumn("previous", F.coalesce("__lag", "__before")).withColumn("next", F.coalesce("__lead", "__after")).drop("__slice", "__lag", "__lead", "__before", "__after")


def plan(log: DataFrame, t: str | Column) -> DataFrame:
    """Of each file changed since t the row to go back to, and how many changes that undoes; files without an earlier row are left out."""
    return changes_since(log, t).join(last_before(log, t), "file_path").select("file_path", F.col("id").alias("target_id"), F.col("after_hash").alias("target_hash"), "modifications")


def by_hash(backups: DataFrame) -> DataFrame:
    """Of each hash its newest snapshot."""
    newest = F.max(F.struct("timestamp", "backup_path", "original_file_path", "source_code"))
    return backups.groupBy("content_hash").agg(newest.alias("b")).select("content_hash", "b.backup_path", F.col("b.timestamp").alias("backup_time"), "b.original_file_path", "b.source_code")


def snapshot_of(rows: DataFrame, backups: DataFrame, hash_col: str) -> DataFrame:
    """Each row (id, file_path, hash) with the newest snapshot of its hash; one of its own file before those of others."""
    newest = F.max(F.struct("timestamp", "backup_path"))
    mine = backups.groupBy(F.col("content_hash").alias(hash_col), F.col("original_file_path").alias("file_path")).agg(newest.alias("mine"))
    any_ = backups.groupBy(F.col("content_hash").alias(hash_col)).agg(newest.alias("any"))
    both = rows.join(mine, [hash_col, "file_path"], "left").join(any_, hash_col, "left")
    found = both.withColumn("backup_path", F.coalesce("mine.backup_path", "any.backup_path")).withColumn("own_file", F.when(F.col("any").isNotNull(), F.col("mine").isNotNull()))
    return found.select(*rows.columns, "backup_path", "own_file")


def snapshot_asof(rows: DataFrame, backups: DataFrame, slice_: str = "day") -> DataFrame:
    """(id, backup_path) by time, in a row's own file: the first snapshot from it on, else the last one before.

    Rows and snapshots are sorted together within slices of a file's time, and snapshots carried over
    the rows in either direction; beyond the slice, by the first and last snapshots of the others."""
    none = F.lit(None)
    r = rows.select("file_path", "timestamp", "id", none.cast("string").alias("backup_path"))
    b = backups.select(F.col("original_file_path").alias("file_path"), "timestamp", none.cast("string").alias("id"), "backup_path")
    both = r.unionByName(b).withColumn("slice", F.date_trunc(slice_, F.col("timestamp"))).withColumn("stamp", F.when(F.col("backup_path").isNotNull(), F.struct("timestamp", "backup_path")))
    w = Window.partitionBy("file_path", "slice").orderBy("timestamp")
    near = both.withColumn("ahead", F.min("stamp").over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))).withColumn("behind", F.max("stamp").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    over = Window.partitionBy("file_path").orderBy("slice")
    ends = both.groupBy("file_path", "slice").agg(F.min("stamp").alias("first"), F.max("stamp").alias("last"))
    ends = ends.select("file_path", "slice", F.min("first").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("later"), F.max("last").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    found = near.where("id is not null").join(ends, ["file_path", "slice"])
    return found.select("id", F.coalesce("ahead.backup_path", "later.backup_path", "behind.backup_path", "earlier.backup_path").alias("backup_path"))


def restore_points(rows: DataFrame, log: DataFrame, backups: DataFrame) -> DataFrame:
    """Of each row (id, file_path, timestamp, after_hash) the snapshot of its state, and how it was found.

    By its hash; else, if the next change began from that hash, by the hash of that; else by time."""
    hashes = by_hash(backups).select("content_hash", "backup_path")
    following = with_neighbours(log).select("id", F.col("next.before_hash").alias("next_hash"))
    base = rows.select("id", "file_path", "timestamp", "after_hash").join(following, "id", "left")
    one = base.join(hashes.withColumnsRenamed({"content_hash": "after_hash", "backup_path": "direct"}), "after_hash", "left")
    two = one.join(hashes.withColumnsRenamed({"content_hash": "next_hash", "backup_path": "chained"}), "next_hash", "left")
    timed = snapshot_asof(rows, backups).withColumnRenamed("backup_path", "timed")
    all_ = two.join(timed, "id", "left").withColumn("chained", F.when(F.col("next_hash") == F.col("after_hash"), F.col("chained")))
    method = F.when(F.col("direct").isNotNull(), "hash").when(F.col("chained").isNotNull(), "next_hash").when(F.col("timed").isNotNull(), "timestamp").otherwise("none")
    return all_.select("id", "file_path", F.coalesce("direct", "chained", "timed").alias("backup_path"), method.alias("method"))


def execute(log: DataFrame, backups: DataFrame, t: str | Column) -> DataFrame:
    """The plan for t with the snapshot of each file; a file without one is a failure."""
    target = plan(log, t).join(log.select(F.col("id").alias("target_id"), "timestamp"), "target_id")
    points = restore_points(target.select(F.col("target_id").alias("id"), "file_path", "timestamp", F.col("target_hash").alias("after_hash")), log, backups)
    return points.select("file_path", F.col("id").alias("target_id"), "backup_path", "method", (F.col("method") != "none").alias("restored"))


def execution_summary(done: DataFrame) -> DataFrame:
    n = done.agg(F.count_if("restored").alias("restored"), F.count("*").alias("total"))
    return n.withColumn("success_rate", F.round(success_rate(F.col("restored"), F.col("total")), 4))


def files_before(log: DataFrame, backups: DataFrame, files: DataFrame, t: str | Column) -> DataFrame:
    """Of the given files the state before t."""
    last = last_before(log, t).join(files.select("file_path").distinct(), "file_path", "left_semi")
    return restore_points(last.select("id", "file_path", "timestamp", "after_hash"), log, backups)


def session_plan(log: DataFrame, session_id: str) -> DataFrame:
    """Of each file that a session changed its last row before the session began."""
    start = session_start(log, session_id)
    row = F.struct("timestamp", "id", "after_hash")
    earlier = mutating(log).crossJoin(F.broadcast(start)).where("timestamp < start")  # one row
    last = earlier.groupBy("file_path").agg(F.max(row).alias("r")).select("file_path", F.col("r.id").alias("target_id"), F.col("r.after_hash").alias("target_hash"))
    return session_files(log, session_id).join(last, "file_path")


def undo_stack(log: DataFrame, n: int = 10) -> DataFrame:
    """The last reversible rows, latest first, with their place from 1."""
    top = reversible(log).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("timestamp"), F.desc("id"))))


def undo_state(log: DataFrame, undone: int = 0) -> DataFrame:
    """How many steps can be undone and redone after ``undone`` steps back."""
    n = reversible(log).agg(F.count("*").alias("n"))
    back = F.least(F.lit(undone), F.col("n"))
    return n.select((F.col("n") - back).cast("long").alias("can_undo"), back.cast("long").alias("can_redo"))


def undo_replay(log: DataFrame) -> DataFrame:
    """(session_id, can_undo, can_redo, last_undo, last_redo): each session's stacks after all its rows, and the ids on top of them.

    A reversible row goes on the first stack and empties the second; one whose description is ``undo``
    moves the top of the first to the second, ``redo`` back. What is held is the open stacks of a session."""
    import pyarrow as pa

    from silvae.operators.sweep import in_order

    def step():
        session, done, undone = None, [], []

        def one(row):
            nonlocal session, done, undone
            if session is not None and (not row or row[0] != session):
                yield session, len(done), len(undone), done[-1] if done else None, undone[-1] if undone else None
            if not row:
                return
            if row[0] != session:
                session, done, undone = row[0], [], []
            if row[4] == "undo":
                if done:
                    undone.append(done.pop())
            elif row[4] == "redo":
                if undone:
                    done.append(undone.pop())
            elif row[3] in REVERSIBLE:
                done.append(row[2])
                undone = []

        return one

    rows = log.where("session_id is not null").select("session_id", "timestamp", "id", "operation", "description")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return in_order(rows, ["timestamp", "id"], step, "session_id string, can_undo long, can_redo long, last_undo string, last_redo string", kinds, by="session_id")


def undo_targets(log: DataFrame, backups: DataFrame, redo: bool = False) -> DataFrame:
    """Of each reversible row the snapshot that its undoing (or redoing) brings back.

    By the hash before (after) it; else, for all but Edit, the state of the change before (after) it."""
    col = "after_hash" if redo else "before_hash"
    first = snapshot_of(reversible(log).select("id", "file_path", "operation", "timestamp", "before_hash", "after_hash"), backups, col)
    side = with_neighbours(log).select("id", F.col("next" if redo else "previous")["id"].alias("other_id"))
    other = restore_points(mutating(log), log, backups).select(F.col("id").alias("other_id"), F.col("backup_path").alias("other_path"))
    both = first.join(side, "id", "left").join(other, "other_id", "left")
    fallback = F.when(F.col("operation") != "Edit", F.col("other_path"))
    return both.select("id", "file_path", "operation", F.coalesce("backup_path", fallback).alias("backup_path"))


def session_rows(spark, session_id: str, at_: Column, end_of: str | None = None) -> DataFrame:
    """The log rows that start a session, after the end of another if that is given."""
    rows = ([(end_of, "SessionEnd")] if end_of else []) + [(session_id, "SessionStart")]
    df = spark.createDataFrame([(i, s, o) for i, (s, o) in enumerate(rows)], "n int, session_id string, operation string")
    none = F.lit(None).cast("string")
    return df.select(F.concat(F.lit("txn_"), F.unix_micros(at_).cast("string"), F.lit("_"), "n").alias("id"), at_.alias("timestamp"), "operation", F.lit("").alias("file_path"), none.alias("node_path"), none.alias("before_hash"), none.alias("after_hash"), F.col("operation").alias("description"), "session_id", F.create_map().cast("map<string,string>").alias("metadata"))


def begin_sessions(log: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log rows, alias rows) that start sessions (alias, session_id, at): the end of the session that is open then, if any, and the start, with the alias that it goes by.

    Open is the session of the last row before ``at``, unless that row ends it. A session that the log has already is not started again, and keeps its alias."""
    new = named.join(log.select("session_id").distinct(), "session_id", "left_anti")
    # the log's last row before each start; what is started here counts as a row of its own
    rows = log.where("session_id is not null").select(F.col("timestamp").alias("at"), "session_id", F.col("operation").alias("op")).unionByName(new.select("at", "session_id", F.lit("SessionStart").alias("op")))
    last = rows.groupBy("at").agg(F.max(F.struct(F.col("op") != "SessionEnd", "session_id", "op")).alias("r")).select(F.col("at").alias("before"), F.col("r.session_id").alias("open_id"), F.col("r.op").alias("open_op"))
    slice_ = lambda c: F.to_date(c)
    ends = last.groupBy(slice_(F.col("before")).alias("day")).agg(F.max(F.struct("before", "open_id", "open_op")).alias("e"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    # a row a day: the last one of the days before, for starts that come first on theirs
    ends = ends.withColumn("earlier", F.max("e").over(w)).select("day", "earlier")
    same = new.withColumn("day", slice_(F.col("at"))).join(last.withColumn("day", slice_(F.col("before"))), "day", "left").where("before is null or before < at")
    best = same.groupBy("alias", "session_id", "at", "day").agg(F.max(F.struct("before", "open_id", "open_op")).alias("r"))
    full = new.withColumn("day", slice_(F.col("at"))).join(best.select("session_id", "r"), "session_id", "left").join(ends, "day", "left").withColumn("r", F.coalesce("r", "earlier"))
    ending = full.where("r is not null and r.open_op <> 'SessionEnd'").select(F.col("r.open_id").alias("session_id"), "at", F.lit("SessionEnd").alias("operation"), F.lit(0).alias("n"), F.col("session_id").alias("by"))
    starting = new.select("session_id", "at", F.lit("SessionStart").alias("operation"), F.lit(1).alias("n"), F.col("session_id").alias("by"))
    none = F.lit(None).cast("string")
    id_ = F.concat_ws("_", F.lit("txn"), F.unix_micros("at").cast("string"), F.substring(F.sha2("by", 256), 1, 8), F.col("n").cast("string"))
    made = ending.unionByName(starting).select(id_.alias("id"), F.col("at").alias("timestamp"), "operation", F.lit("").alias("file_path"), none.alias("node_path"), none.alias("before_hash"), none.alias("after_hash"), F.col("operation").alias("description"), "session_id", F.create_map().cast("map<string,string>").alias("metadata"))
    return made, new.select("alias", "session_id")


def resolve_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, session_id): an alias's session, else the name itself."""
    return names.join(aliases.select(F.col("alias").alias("name"), F.col("session_id").alias("s")), "name", "left").select("name", F.coalesce("s", "name").alias("session_id"))
