"""Exact search by vectors, and edit proposals from it. The embedding function is the caller's."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvae.functions.scores import brace_density_ok, cosine
from silvae.functions.text import chunks, last_index, name_in_preview, parent_path, preview

#: A hit has at least this similarity; a best hit below the second figure is doubtful.
LEAST, SURE = 0.2, 0.5


def scored(vectors: DataFrame, query: Sequence[float] | Column, col: str = "vector") -> DataFrame:
    """Vectors with their similarity to the query, none below LEAST."""
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("score", cosine(F.col(col), q)).where(F.col("score") >= LEAST)


def topk(vectors: DataFrame, query: Sequence[float] | Column, k: int = 10, tie: str = "node_path", col: str = "vector") -> DataFrame:
    return scored(vectors, query, col).orderBy(F.desc("score"), tie).limit(k).withColumn("low_confidence", F.col("score") < SURE)


#: Bytes of the queries that go out at once, similarities that a task computes at once, and rows and hits that it holds before it drops what is beaten.
QUERIES, SCORES, ROWS, HITS = 64 << 20, 1 << 20, 1 << 14, 1 << 21


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of length 1; zeros for those of another length, of none or without a direction."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    values = pc.list_flatten(column)
    first = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    out = np.zeros((len(column), dims))
    ok = np.flatnonzero(length == dims)
    if len(ok) and dims:
        out[ok] = np.asarray(values.cast(pa.float64()).fill_null(np.nan))[first[ok, None] + np.arange(dims)]
        out[~np.isfinite(out).all(1)] = 0
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300)


def _places(values: pa.ChunkedArray) -> np.ndarray:
    """The rank of each value among all of them."""
    x = np.array(values.to_pylist(), object)
    none = np.array([v is None for v in x], bool)
    out = np.zeros(len(x), np.int64)
    if (~none).any():
        out[~none] = np.unique(x[~none], return_inverse=True)[1] + 1
    return out


class _Best:
    """The best k hits of each query (and key) among the rows seen so far, with the rows that they are in."""

    def __init__(self, k: int, tie: str, key: str | None):
        self.k, self.tie, self.key = k, tie, key
        self.rows: list[pa.RecordBatch] = []
        self.n = 0
        self.query, self.row, self.score = [], [], []
        self.size = 0

    def add(self, piece: pa.RecordBatch, score: np.ndarray) -> None:
        """score: of each row of the piece and each query."""
        # equal vectors score the same wherever they stand
        score = np.round(score, 12)
        if self.key is None and len(score) > self.k:
            # a query's hits below its k-th can't be among its best
            least = np.maximum(np.partition(score, len(score) - self.k, axis=0)[len(score) - self.k], LEAST)
            i, j = np.nonzero(score >= least)
        else:
            i, j = np.nonzero(score >= LEAST)
        if not len(i):
            return
        used, at = np.unique(i, return_inverse=True)
        self.rows.append(piece.take(pa.array(used)))
        self.query.append(j)
        self.row.append(at + self.n)
        self.score.append(score[i, j])
        self.n += len(used)
        self.size += len(i)
        if self.n > ROWS or self.size > HITS:
            self.settle()

    def settle(self) -> tuple[pa.Table | None, np.ndarray, np.ndarray]:
        """The rows that are left, and of each hit its query, row and score, the best first."""
        none = np.zeros(0, np.int64)
        if not self.rows:
            return None, none, none, none
        rows = pa.Table.from_batches(self.rows)
        query, row, score = (np.concatenate(x) for x in (self.query, self.row, self.score))
        of = _places(rows.column(self.key))[row] if self.key else np.zeros(len(row), np.int64)
        order = np.lexsort((_places(rows.column(self.tie))[row], -score, of, query))
        query, row, score, of = query[order], row[order], score[order], of[order]
        new = np.flatnonzero((np.diff(query, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        place = np.arange(len(query)) - np.repeat(new, np.diff(np.append(new, len(query))))
        keep = place < self.k
        query, row, score = query[keep], row[keep], score[keep]
        used, row = np.unique(row, return_inverse=True)
        rows = rows.take(pa.array(used)).combine_chunks()
        self.rows, self.n, self.size = rows.to_batches(), len(used), len(row)
        self.query, self.row, self.score = [query], [row], [score]
        return rows, query, row, score


def _hits(best: _Best, names: np.ndarray, rest: list[str]) -> pa.Table | None:
    """(query, the columns ``rest``, score) of what is best."""
    rows, query, row, score = best.settle()
    if rows is None:
        return None
    return pa.Table.from_arrays([pa.array(names[query].tolist(), pa.string()), *(rows.column(c).take(pa.array(row)) for c in rest), pa.array(score)], ["query", *rest, "score"])


def _one_length(queries: DataFrame) -> int:
    """How long all queries are; 0 without any."""
    lengths = [r.n for r in queries.select(F.size("vector").alias("n")).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError(f"queries must have one length, and have {sorted(lengths)}")
    return lengths[0] if lengths else 0


def topk_all(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str | None = None, tie: str = "node_path", col: str = "vector") -> DataFrame:
    """``topk`` (or, with ``key``, ``topk_by``) of every row of ``queries`` (query, vector): (query, the columns of ``vectors`` but the vector, score, place).

    Queries go out in blocks of a fixed size, mostly one; a task keeps the best k of each for what it has
    seen, and a window takes the best of those. No row is dropped before it has been compared. Queries
    have one length; a vector of another, or without a direction, is no hit."""
    spark, rest = vectors.sparkSession, [c for c in vectors.columns if c != col]
    out_schema = ", ".join(["query string", *(f"`{c}` {dict(vectors.dtypes)[c]}" for c in rest), "score double"])
    dims, total, found = _one_length(queries), queries.count(), None
    count = max(1, -(-total * dims * 8 // QUERIES))
    for b in range(count if dims else 0):
        part = queries.where(F.pmod(F.xxhash64("query"), F.lit(count)) == b) if count > 1 else queries
        given = part.select(F.col("query").cast("string").alias("query"), "vector").toArrow()
        if not given.num_rows:
            continue
        shared = spark.sparkContext.broadcast((np.array(given.column(0).to_pylist(), object), _matrix(given.column(1), dims).T.copy()))

        def run(batches, shared=shared):
            names, asked = shared.value
            best = _Best(k, tie, key)
            step = max(1, SCORES // asked.shape[1])
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    piece = batch.slice(at, step)
                    best.add(piece.select(rest), _matrix(piece.column(piece.schema.get_field_index(col)), dims) @ asked)
            if (hits := _hits(best, names, rest)) is not None:
                yield from hits.to_batches()

        one = vectors.mapInArrow(run, out_schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], f"{out_schema}, place int")
    w = Window.partitionBy("query", *([key] if key else [])).orderBy(F.desc("score"), tie)
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


#: Balls of an index at most, vectors of a ball that one task compares, and queries that it compares them with.
BALLS, SLICE, CHUNK = 128, 4096, 4096
#: What rounding may add to a bound.
_SLACK = 1e-9


class BallIndex:
    """Vectors dealt to balls around pivots, for exact search that leaves out balls which can't hold a hit.

    Pivots are a bounded sample of the vectors, chosen by a hash; each vector goes to the nearest and its
    ball knows how near and how far its vectors are. All is by the distance of directions, for which the
    triangle inequality holds: a ball whose pivot is further from a query than its radius and the distance
    of the query's k-th best can't hold a better one. Vectors of another length than ``dims`` or without a
    direction are hits of no query and left out."""

    def __init__(self, vectors: DataFrame, path: str, dims: int, balls: int = BALLS, tie: str = "node_path", col: str = "vector"):
        self.spark, self.tie, self.col, self.dims = vectors.sparkSession, tie, col, dims
        self.rest = [c for c in vectors.columns if c != col]
        h = F.pmod(F.xxhash64(tie), F.lit(1 << 30))
        own = vectors.where(F.size(col) == dims)
        n = own.count()
        wanted = max(1, min(balls, int(n**0.5)))
        # a bound that some times as many meet, so that no task sends more than its share of a bounded sample
        some = own.where(h < F.lit(min(1.0, 8 * wanted / max(1, n)) * (1 << 30))).select(col, h.alias("h"), F.xxhash64(tie, F.lit(1)).alias("o")).orderBy("o").limit(wanted).select(col).toArrow()
        pivots = _matrix(some.column(0), dims)
        self.pivots = pivots[(pivots != 0).any(1)]
        shared = self.spark.sparkContext.broadcast(self.pivots)
        fields = ", ".join([*(f"`{c}` {t}" for c, t in vectors.dtypes), "ball int, away double"])

        def deal(batches):
            pivots = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, max(1, SCORES // max(1, len(pivots)))):
                    piece = batch.slice(at, max(1, SCORES // max(1, len(pivots))))
                    x = _matrix(piece.column(piece.schema.get_field_index(col)), dims)
                    good = np.flatnonzero((x != 0).any(1)) if len(pivots) else np.zeros(0, np.int64)
                    score = x[good] @ pivots.T
                    ball = score.argmax(1) if len(good) else good
                    away = np.sqrt(np.maximum(0, 2 - 2 * score[np.arange(len(good)), ball])) if len(good) else np.zeros(0)
                    yield pa.RecordBatch.from_arrays([*(piece.column(k).take(pa.array(good)) for k in range(piece.num_columns)), pa.array(ball, pa.int32()), pa.array(away)], [*piece.schema.names, "ball", "away"])

        vectors.mapInArrow(deal, fields).write.mode("overwrite").parquet(path)
        self.table = self.spark.read.schema(fields).parquet(path)
        stats = {r.ball: r for r in self.table.groupBy("ball").agg(F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).collect()}
        m = len(self.pivots)
        self.size, self.near, self.far = (np.array([getattr(stats[b], f) if b in stats else 0 for b in range(m)]) for f in ("n", "near", "far"))

    def _pairs(self, queries: DataFrame, nearest: bool) -> DataFrame:
        """(query, vector, ball, slices): the balls to look into, the nearest of each query, or, with (least, first), all others that may hold a hit of ``least``."""
        shared = self.spark.sparkContext.broadcast((self.pivots, self.size, self.near, self.far))
        dims = self.dims

        def run(batches):
            pivots, size, near, far = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    piece = batch.slice(at, 1024)
                    away = np.sqrt(np.maximum(0, 2 - 2 * (_matrix(piece.column(1), dims) @ pivots.T)))
                    away[:, size == 0] = np.inf
                    if nearest:
                        i, ball = np.arange(piece.num_rows), away.argmin(1)
                    else:
                        least, first = (np.asarray(piece.column(k)) for k in (2, 3))
                        # the nearest that a vector of the ball can be
                        bound = np.maximum(0, np.maximum(away - far, near - away))
                        open_ = bound <= np.sqrt(2 - 2 * least)[:, None] + _SLACK
                        open_[np.arange(piece.num_rows), first] = False
                        i, ball = np.nonzero(open_ & (size > 0))
                    slices = np.maximum(1, -(-size[ball] // SLICE))
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(i)), piece.column(1).take(pa.array(i)), pa.array(ball, pa.int32()), pa.array(slices, pa.int32()), pa.array(size[ball], pa.int64())], ["query", "vector", "ball", "slices", "n"])

        return queries.mapInArrow(run, "query string, vector array<double>, ball int, slices int, n long")

    def _compare(self, pairs: DataFrame, k: int, chunks: int) -> DataFrame:
        """The best k of each query in each part of a ball that it looks into."""
        rest, col, tie, dims = self.rest, self.col, self.tie, self.dims
        total = F.element_at(F.array(*(F.lit(int(max(1, -(-n // SLICE)))) for n in self.size)), F.col("ball") + 1)
        rows = self.table.withColumn("slice", F.pmod(F.xxhash64(tie), total).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        asked = pairs.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int"))
        kinds = dict(self.table.dtypes)
        schema = ", ".join(["query string", *(f"`{c}` {kinds[c]}" for c in rest), "score double"])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            best = _Best(k, tie, None)
            names = np.array(left.column("query").to_pylist(), object)
            if left.num_rows and right.num_rows:
                given = _matrix(left.column("vector"), dims).T
                step = max(1, SCORES // given.shape[1])
                for batch in right.to_batches():
                    for at in range(0, batch.num_rows, step):
                        piece = batch.slice(at, step)
                        best.add(piece.select(rest), _matrix(piece.column(piece.schema.get_field_index(col)), dims) @ given)
            hits = _hits(best, names, rest)
            if hits is None:
                return pa.Table.from_arrays([pa.array([], pa.string()), *(right.schema.field(c).type and pa.array([], right.schema.field(c).type) for c in rest), pa.array([], pa.float64())], ["query", *rest, "score"])
            return hits

        by = ["ball", "slice", "chunk"]
        return asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(run, schema)

    def search(self, queries: DataFrame, path: str, k: int = 10) -> DataFrame:
        """(query, the columns of the vectors but the vector, score, place, compared): as ``topk_all``, and how many vectors each query was compared with.

        First each query looks into its nearest ball, then, with the k-th score it has found there, into
        those that its bound leaves. ``path``: a folder for what is found in between."""
        if _one_length(queries) not in (0, self.dims):
            raise ValueError(f"the index holds vectors of {self.dims} numbers")
        chunks = max(1, -(-queries.count() // CHUNK))
        asked = queries.select(F.col("query").cast("string").alias("query"), F.col("vector").cast("array<double>").alias("vector"))
        if not len(self.pivots):
            asked = asked.limit(0)
        self._pairs(asked, True).write.mode("overwrite").parquet(f"{path}/nearest")
        nearest = self.spark.read.parquet(f"{path}/nearest")
        self._compare(nearest, k, chunks).write.mode("overwrite").parquet(f"{path}/first")
        first = self.spark.read.parquet(f"{path}/first")
        w = Window.partitionBy("query").orderBy(F.desc("score"), self.tie)
        kth = first.withColumn("place", F.row_number().over(w)).where(F.col("place") == k).select("query", F.col("score").alias("least"))
        known = nearest.select("query", "vector", F.col("ball").alias("first")).join(kth, "query", "left").select("query", "vector", F.coalesce("least", F.lit(LEAST)).alias("least"), "first")
        self._pairs(known, False).write.mode("overwrite").parquet(f"{path}/others")
        others = self.spark.read.parquet(f"{path}/others")
        seen = nearest.select("query", "n").unionByName(others.select("query", "n")).groupBy("query").agg(F.sum("n").alias("compared"))
        both = first.unionByName(self._compare(others, k, chunks))
        ranked = both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
        return ranked.join(seen, "query")


def topk_by(vectors: DataFrame, query: Sequence[float] | Column, key: str, k: int = 5, tie: str = "node_path", col: str = "vector") -> DataFrame:
    """The best k of each file."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), tie)
    return scored(vectors, query, col).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def sense(vectors: DataFrame, relations: DataFrame, query: Sequence[float], file_path: str | None = None) -> DataFrame:
    """Ten hits of a project, or five of a file, with a name from the preview and, for the best, its callers' number."""
    hits = topk(vectors, query) if file_path is None else topk(vectors.where(F.col("file_path") == file_path), query, 5)
    named = hits.withColumn("name", name_in_preview(F.col("content_preview"))).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "node_path")))
    calls = relations.where("relation_type = 'Call'").groupBy(F.col("to_name").alias("name")).agg(F.count_distinct("from_file").alias("callers"))
    return named.join(calls, "name", "left").withColumn("impact", F.when(F.col("place") == 1, F.coalesce("callers", F.lit(0)))).drop("callers")


def sense_all(vectors: DataFrame, relations: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``sense`` of every row of ``queries`` (query, vector), over the whole project."""
    named = topk_all(vectors, queries, k).withColumn("name", name_in_preview(F.col("content_preview")))
    calls = relations.where("relation_type = 'Call'").groupBy(F.col("to_name").alias("name")).agg(F.count_distinct("from_file").alias("callers"))
    return named.join(calls, "name", "left").withColumn("impact", F.when(F.col("place") == 1, F.coalesce("callers", F.lit(0)))).drop("callers")


def propose(vectors: DataFrame, query: Sequence[float] | Column, intent: str, col: str = "vector", tie: str = "node_path") -> DataFrame:
    """Where an edit belongs, from the best hit: after, before, inside or replace."""
    best = scored(vectors, query, col).orderBy(F.desc("score"), tie).limit(1)
    path = F.col("node_path").cast("string")
    return best.select(path.alias("anchor_path"), *_where(path, intent), "score")


def _where(path: Column, intent: str) -> list[Column]:
    """Operation, parent and position of an intent at a path."""
    op, parent, position = {
        "after": ("insert", parent_path(path), last_index(path) + 1),
        "before": ("insert", parent_path(path), last_index(path)),
        "inside": ("insert", path, F.lit(1)),
        "replace": ("edit", path, F.lit(0)),
    }[intent.lower()]
    return [F.lit(op).alias("op"), parent.alias("parent_path"), position.cast("int").alias("position")]


def propose_all(vectors: DataFrame, queries: DataFrame, intent: str) -> DataFrame:
    """``propose`` for every row of ``queries`` (query, vector)."""
    best = topk_all(vectors, queries, 1)
    return best.select("query", "file_path", F.col("node_path").alias("anchor_path"), *_where(F.col("node_path"), intent), "score")


def edit_ops(proposals: DataFrame, content: Column) -> DataFrame:
    """The batch rows (position, op) that carry out proposals (file_path, anchor_path, op, parent_path, position) with a text."""
    edits = F.col("op") == "edit"
    op = F.struct(F.col("op").alias("type"), F.col("file_path").alias("file"), F.when(edits, F.col("anchor_path")).alias("path"), F.when(~edits, F.col("parent_path")).alias("parent_path"), F.when(~edits, F.col("position")).alias("position"), content.alias("content"))
    return proposals.select(F.lit(0).alias("position"), op.alias("op"))


def index_rows(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, node_path, content, content_preview, content_hash) to embed: definitions, and pieces of long files without any."""
    kind = F.col("node_type")
    defs = nodes.where((kind.contains("definition") | kind.contains("item")) & (F.trim("content") != "")).select("file_path", F.col("path").alias("node_path"), "content")
    rest = files.join(defs.select("file_path").distinct(), "file_path", "left_anti")
    pieces = rest.select("file_path", F.posexplode(chunks(F.coalesce("content", F.lit("")))).alias("i", "content")).where("content <> ''").select("file_path", F.concat(F.lit("chunk_"), F.col("i").cast("string")).alias("node_path"), "content")
    return defs.unionByName(pieces).withColumn("content_preview", preview(F.col("content"))).withColumn("content_hash", F.sha2("content", 256))


def changed_only(rows: DataFrame, indexed: DataFrame) -> DataFrame:
    """Rows whose file and content hash are not indexed yet."""
    return rows.join(indexed.select("file_path", "content_hash").distinct(), ["file_path", "content_hash"], "left_anti")


def embed(rows: DataFrame, function: Column) -> DataFrame:
    """Rows of the vectors relation; ``function`` is a column over ``content``, built-in or a pandas UDF."""
    return rows.select("file_path", "node_path", "content_preview", function.cast("array<float>").alias("vector"))


def mean_pool(tokens: Column) -> Column:
    """The mean of an array of vectors of one length."""
    n = F.size(tokens)
    total = F.reduce(F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), F.transform(F.element_at(tokens, 1), lambda x: x.cast("double")), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / n)


def mean_pool_by(rows: DataFrame, key: str, col: str) -> DataFrame:
    """(key, vector): the mean of the vectors of each key, place by place, so that no key's vectors meet in one row."""
    means = rows.select(key, F.posexplode(col).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))


def worth_a_report(nodes: DataFrame) -> DataFrame:
    """Nodes of a size and density that a quality report looks at."""
    return nodes.where(brace_density_ok(F.col("content")))
