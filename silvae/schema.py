"""Schemas of the relations: trees, log, snapshots, vectors, references and side stores."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()  # noqa: E741


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STRINGS, PAIRS = T.ArrayType(S), T.MapType(S, S)

FILES = _of(file_path=S, content=S)
#: ``seq`` numbers the nodes of a file in pre-order from 0; the nodes below one are those up to ``seq_end``.
NODES = _of(
    file_path=S, ext=S, seq=I, seq_end=I, parent_seq=I, depth=I, ordinal=I, node_id=S, path=S, node_type=S, content=S,
    start_line=I, end_line=I, start_col=I, end_col=I, name=S, n_children=I, error=S,
)
TRANSACTIONS = _of(id=S, timestamp=T.TimestampType(), operation=S, file_path=S, node_path=S, before_hash=S, after_hash=S, description=S, session_id=S, metadata=PAIRS)
BACKUPS = _of(backup_path=S, timestamp=T.TimestampType(), original_file_path=S, content_hash=S, source_code=S)
EMBEDDINGS = _of(file_path=S, node_path=S, content_preview=S, vector=T.ArrayType(T.FloatType()))
RELATIONS = _of(from_file=S, from_path=S, to_file=S, to_name=S, relation_type=S)
DEFINITIONS = _of(file_path=S, name=S, path=S)
TAGS = _of(file_path=S, name=S, node_path=S)
LABELS = _of(file_path=S, content_hash=S, labels=STRINGS, metadata=PAIRS, last_updated=S)
JOURNAL = _of(id=S, timestamp=T.TimestampType(), actor=S, transaction_id=S, entry_type=S, message=S, tags=STRINGS, metadata=PAIRS)
ALIASES = _of(alias=S, session_id=S)
BATCH_OP = _of(type=S, file=S, path=S, parent_path=S, position=I, content=S)
BATCH = _of(description=S, operations=T.ArrayType(BATCH_OP))
HUNK_LINES = _of(file_path=S, old_path=S, hunk_no=I, old_start=I, old_count=I, new_start=I, new_count=I, line_no=I, kind=S, text=S)

#: Domains of the string columns.
OPERATIONS = ["Edit", "Insert", "Delete", "AddProperty", "AddComponent", "Move", "Restore", "SessionStart", "SessionEnd"]
MUTATING = ["Edit", "Insert", "Delete"]
REVERSIBLE = ["Edit", "Insert", "Delete", "AddProperty", "AddComponent", "Move", "Restore"]
ENTRY_TYPES = ["Auto", "Intent", "Assumption", "Risk", "Outcome", "Meta"]
