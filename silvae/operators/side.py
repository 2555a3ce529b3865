"""Tags, labels and the journal: changes give new relations, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvae.functions.text import new_id

# tags ------------------------------------------------------------------------------------------


def add_tags(tags: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """New tags; one that is there stays as it is, or is replaced by ``force``."""
    key = ["file_path", "name"]
    new = new.dropDuplicates(key)
    if force:
        return tags.join(new, key, "left_anti").unionByName(new)
    return tags.unionByName(new.join(tags, key, "left_anti"))


def rename_tag(tags: DataFrame, file_path: str, old: str, new: str) -> DataFrame:
    """Unless the new name is taken in that file."""
    taken = tags.where((F.col("file_path") == file_path) & (F.col("name") == new)).limit(1).select(F.lit(True).alias("taken"))
    here = (F.col("file_path") == file_path) & (F.col("name") == old)
    return tags.join(taken, F.lit(True), "left").withColumn("name", F.when(here & F.col("taken").isNull(), new).otherwise(F.col("name"))).drop("taken")


def remove_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone, ["file_path", "name"], "left_anti")


def list_tags(tags: DataFrame, file_path: str | None = None) -> DataFrame:
    return (tags if file_path is None else tags.where(F.col("file_path") == file_path)).orderBy("file_path", "name")


def tag_exists(tags: DataFrame, file_path: str, name: str) -> DataFrame:
    return tags.agg(F.coalesce(F.bool_or((F.col("file_path") == file_path) & (F.col("name") == name)), F.lit(False)).alias("found"))


def resolve_tags(paths: DataFrame, tags: DataFrame) -> DataFrame:
    """(file_path, path, node_path): ``tag:name`` by the file's tags, any other path itself."""
    t = tags.select("file_path", F.concat(F.lit("tag:"), "name").alias("path"), F.col("node_path").alias("tagged"))
    return paths.join(t, ["file_path", "path"], "left").select("file_path", "path", F.when(F.col("path").startswith("tag:"), F.col("tagged")).otherwise(F.col("path")).alias("node_path"))


# labels ----------------------------------------------------------------------------------------


def add_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, content_hash, labels) of both, each label once."""
    every = labels.select("file_path", "content_hash", "labels").unionByName(new.select("file_path", "content_hash", "labels"))
    return every.groupBy("file_path", "content_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))


def labels_of(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (file_path, content_hash) with their labels, of none an empty array."""
    known = labels.select("file_path", "content_hash", "labels")
    return rows.join(known, ["file_path", "content_hash"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def remove_label(labels: DataFrame, name: str) -> DataFrame:
    return labels.withColumn("labels", F.array_remove("labels", name))


# journal ---------------------------------------------------------------------------------------


def entries(rows: DataFrame) -> DataFrame:
    """Journal rows of (actor, entry_type, message, transaction_id) at the present time."""
    now = F.current_timestamp()
    return rows.select(new_id("alf").alias("id"), now.alias("timestamp"), "actor", "transaction_id", "entry_type", "message", F.array().cast("array<string>").alias("tags"), F.create_map().cast("map<string,string>").alias("metadata"))


def tag_entry(journal: DataFrame, id_: str, tag: str) -> DataFrame:
    return journal.withColumn("tags", F.when(F.col("id") == id_, F.array_union("tags", F.array(F.lit(tag)))).otherwise(F.col("tags")))


def amend(journal: DataFrame, id_: str, message: str) -> DataFrame:
    return journal.withColumn("message", F.when(F.col("id") == id_, message).otherwise(F.col("message")))


def recent(journal: DataFrame, n: int, position: list[str]) -> DataFrame:
    """The last entries by the columns of their position, latest first."""
    return journal.orderBy(*(F.desc(c) for c in position)).limit(n)


def of_transaction(journal: DataFrame, transaction_id: str) -> DataFrame:
    return journal.where(F.col("transaction_id") == transaction_id).limit(1)


def with_transactions(journal: DataFrame, log: DataFrame) -> DataFrame:
    t = log.select(F.col("id").alias("transaction_id"), "operation", "file_path", F.col("timestamp").alias("changed_at"))
    return journal.join(t, "transaction_id")


def reported(journal: DataFrame) -> DataFrame:
    """What a report takes: entries of a transaction, intents and risks."""
    return journal.where(F.col("transaction_id").isNotNull() | F.col("entry_type").isin("Intent", "Risk"))


def report(journal: DataFrame, log: DataFrame, position: list[str], limit: int = 50) -> DataFrame:
    """(place, line) of an engineering report in Markdown, latest first."""
    t = log.select(F.col("id").alias("transaction_id"), "operation", "file_path")
    rows = recent(reported(journal), limit, position).join(t, "transaction_id", "left")
    place = F.row_number().over(Window.orderBy(*(F.desc(c) for c in position)))
    change = F.when(F.col("operation").isNotNull(), F.format_string(" (%s of `%s`)", "operation", "file_path")).otherwise("")
    return rows.select(place.alias("place"), F.concat(F.format_string("- **%s** %s: %s", "entry_type", "actor", "message"), change).alias("line"))
