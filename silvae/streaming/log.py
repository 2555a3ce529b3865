"""The log as a stream: files of JSON lines as they arrive, counts by time, and undo state by project.

An extension: the relations are the same as in batch, so every stateless operator of
``operators.temporal`` also takes the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from silvae import schema
from silvae.schema import REVERSIBLE


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema.TRANSACTIONS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def changes_by_window(log: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Changes of each file in tumbling windows; rows later than ``late`` are dropped."""
    w = F.window("timestamp", length)
    out = log.withWatermark("timestamp", late).where(F.col("operation").isin(*schema.MUTATING)).groupBy(w.alias("w"), "file_path").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "file_path", "n")


def first_seen(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each content of a file once, within the watermark."""
    return log.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["file_path", "after_hash"])


UNDO = "session_id string, can_undo long, can_redo long, top string"


def _undo(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    depth, top, redo = state.get if state.exists else (0, None, 0)
    rows = pd.concat(list(batches)).sort_values(["timestamp", "id"])
    for r in rows.itertuples():
        if r.description == "undo" and depth:
            depth, redo = depth - 1, redo + 1
        elif r.description == "redo" and redo:
            depth, redo = depth + 1, redo - 1
        elif r.operation in REVERSIBLE:
            depth, redo, top = depth + 1, 0, r.id
    state.update((depth, top, redo))
    yield pd.DataFrame({"session_id": [key[0]], "can_undo": [depth], "can_redo": [redo], "top": [top]})


def undo_state(log: DataFrame) -> DataFrame:
    """Of each session, after each trigger, the steps that can be undone and redone. State is three values a session."""
    return log.groupBy("session_id").applyInPandasWithState(_undo, UNDO, "depth long, top string, redo long", "update", GroupStateTimeout.NoTimeout)
