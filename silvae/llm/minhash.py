"""Near-duplicate documents by an LSH forest of MinHash signatures.

Each distinct shingle set gets one signature. The signature is sorted in several orders, each
of which starts at other hash functions; in a sorted order, documents that share a long prefix
stand next to each other. How deep two documents must agree to become candidates depends on the
region: where few share a prefix, one shared value is enough, and where many do, only those in
a deeper, small enough region, plus direct neighbours. Candidates whose whole signatures agree
too little are dropped, all others are compared on their full shingle sets.

A document at the edge of a large family may resemble only some of it. So documents of crowded
regions are sorted once more, and those within a window that are not yet in one component become
candidates too: a family that already holds together costs nothing then.

What the caps of both passes may have passed over is joined exactly at last: two documents of a
similarity of 0.75 share one of their rarest shingles, a quarter of each, so documents of crowded
regions meet at each of these, unless they are in one component already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvae.llm import words as W
from silvae.llm.graph import components
from silvae.llm.store import drop, materialize, small_batches

#: Hash functions of a signature, sorted orders, the size up to which all of a region are candidates, and
#: the agreement below which candidates are dropped: at a similarity of 0.75, 34 of 64 is over 4 sigma below the mean.
HASHES, ORDERS, REGION, AGREE = 64, 12, 16, 34
#: The same of the second pass over crowded regions: orders, window, agreement.
MORE, WINDOW, AGREE_MORE = 16, 16, 40
_DEPTH = 8
#: The exact join: bits of a cell in each of the two tables of shingle frequencies, and rows of a shingle that one task pairs with all its others.
RARE_BITS, SALTED = 19, 1000
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Low and high half of each XORed byte: how many of the two 4-bit values agree.
_AGREE = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], dtype=np.uint8)
_ORDER = [[(4 * t + 5 * j) % HASHES for j in range(HASHES)] for t in range(max(ORDERS, MORE))]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES 32-bit minima for each non-empty set (zeros for empty ones)."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    if len(full):
        values = np.concatenate(sets)
        first = (np.cumsum(size) - size)[full]
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(((values ^ _XOR[k]) * _MUL[k]) >> np.uint64(32), first)
    return out


_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, sig binary"


def _sign(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in W.slices(texts):
            sets = W.shingle_sets(texts.slice(a, b - a))
            sig = signatures(sets)
            d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            d2 = np.array([W.mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "sig"],
            )


_ROWS = "tree int, head long, tail binary, n long, id long, part long"


def _orders(count: int):
    """Each signature once for each order: two whole values to sort by, then all values shortened to 4 bits."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, HASHES)
            for t, order in enumerate(_ORDER[:count]):
                s = sig[:, order]
                head = (s[:, 0].astype(np.uint64) << np.uint64(32) | s[:, 1]).view(np.int64)
                low = (W.mix(s.astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
                tail = low[:, 0::2] << 4 | low[:, 1::2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), t, np.int32)), pa.array(head), pa.array([x.tobytes() for x in tail], pa.binary()), batch.column(1), batch.column(0), batch.column(3)],
                    ["tree", "head", "tail", "n", "id", "part"],
                )

    return run


def neighbours(tree: np.ndarray, head: np.ndarray, tail: np.ndarray, n: np.ndarray, ids: np.ndarray, part: np.ndarray, again: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (i, j) of the candidate pairs among rows in sorted order, and which rows are in crowded regions.

    ``again``: the second pass, in which rows of one part are no candidates."""
    size = len(ids)
    none = np.zeros(0, np.int64)
    if size < 2:
        return none, none, np.zeros(size, bool)
    top = head.view(np.uint64) >> np.uint64(32)
    same = np.zeros((size - 1, _DEPTH), bool)
    same[:, 0] = (tree[1:] == tree[:-1]) & (top[1:] == top[:-1])
    same[:, 1] = head[1:] == head[:-1]
    for k in range(2, _DEPTH):
        byte, shift = k // 2, 4 * (1 - k % 2)
        same[:, k] = (tail[1:, byte] ^ tail[:-1, byte]) >> shift & 15 == 0
    depth = np.cumprod(same, axis=1).sum(1)
    edge = np.concatenate([[0], depth])
    region = np.zeros((_DEPTH + 1, size), np.int64)
    for d in range(1, _DEPTH + 1):
        g = np.cumsum(edge < d)
        region[d] = np.bincount(g)[g]
    left, right, shared = [none], [none], depth
    for lag in range(1, min(WINDOW if again else REGION, size)):
        if lag > 1:
            shared = np.minimum(shared[1:], depth[: len(depth) - lag + 1])
        i = np.arange(lag, size)
        i = i[(shared >= 1) & (True if again else (region[shared, i] <= REGION) | (lag == 1))]
        j = i - lag
        agree = _AGREE[tail[i] ^ tail[j]].sum(1)
        ok = (agree >= (AGREE_MORE if again else AGREE)) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])) & (part[i] != part[j])
        left.append(i[ok])
        right.append(j[ok])
    return np.concatenate(left), np.concatenate(right), region[1] > REGION


#: A pair, a crowded row (b is null), or a row at a border of partitions.
_FOUND = "border long, side int, a long, b long, tree int, head long, tail binary, n long, id long, part long"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
_KEEP = 40_000


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    tail = np.frombuffer(b"".join(batch.column("tail").to_pylist()), np.uint8).reshape(-1, HASHES // 2)
    return [batch.column("tree").to_numpy(), batch.column("head").to_numpy(), tail, batch.column("n").to_numpy(), batch.column("id").to_numpy(), batch.column("part").to_numpy()]


def _pairs(rows: list[np.ndarray], new: int, again: bool) -> pa.RecordBatch:
    """Candidates of which the later one stands at ``new`` or beyond, and crowded rows."""
    i, j, crowded = neighbours(*rows, again)
    i, j = i[i >= new], j[i >= new]
    x, y, z = rows[4][i], rows[4][j], np.unique(rows[4][crowded]) if not again else rows[4][:0]
    size = len(x) + len(z)
    none, small = pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32())
    first, second = np.concatenate([np.minimum(x, y), z]), np.concatenate([np.maximum(x, y), z])
    pair = np.arange(size) < len(x)
    return pa.RecordBatch.from_arrays(
        [none, small, pa.array(first), pa.array(second, mask=~pair), small, none, pa.nulls(size, pa.binary()), none, none, none],
        _NAMES,
    )


def _border(rows: list[np.ndarray], border: int, side: int) -> pa.RecordBatch:
    size = len(rows[0])
    none = pa.nulls(size, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, border, np.int64)), pa.array(np.full(size, side, np.int32)), none, none, pa.array(rows[0]), pa.array(rows[1]), pa.array([x.tobytes() for x in rows[2]], pa.binary()), pa.array(rows[3]), pa.array(rows[4]), pa.array(rows[5])],
        _NAMES,
    )


def _scan(again: bool):
    """Candidates within a sorted partition, and its first and last rows for the borders to its neighbours.

    Only some batches' rows are held: the last ones go before the next."""
    halo = max(REGION, WINDOW)

    def run(batches):
        at = TaskContext.get().partitionId()
        held: list[np.ndarray] | None = None
        ready: list[list[np.ndarray]] = []
        count = 0

        def take() -> pa.RecordBatch:
            nonlocal held, ready, count
            new = len(held[0]) if held is not None else 0
            rows = [np.concatenate([r[k] for r in ([held] if held is not None else []) + ready]) for k in range(6)]
            held, ready, count = [r[-halo:] for r in rows], [], 0
            return _pairs(rows, new, again)

        opening = halo
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _columns(batch)
            if opening:
                yield _border([r[:opening] for r in rows], at, 1)
                opening -= min(opening, len(rows[0]))
            ready.append(rows)
            count += len(rows[0])
            if count >= _KEEP:
                yield take()
        if count:
            yield take()
        if held is not None:
            yield _border(held, at, 0)

    return run


def before(sizes: dict[int, int], halo: int) -> list[tuple[int, int, int]]:
    """(partition, side, border): of each partition its first rows, and the last rows of as many partitions before it as hold ``halo`` of them."""
    out, order = [], sorted(sizes)
    for k, q in enumerate(order[1:], 1):
        out.append((q, 1, q))
        have, j = 0, k - 1
        while have < halo and j >= 0:
            out.append((order[j], 0, q))
            have, j = have + sizes[order[j]], j - 1
    return out


def _across(again: bool):
    """Candidates across the border of two sorted partitions, and crowded rows (b is null): the last rows before it and the first behind it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("tree", "ascending"), ("head", "ascending"), ("tail", "ascending"), ("id", "ascending")])
        rows = _columns(table.combine_chunks().to_batches()[0])
        new = int((table.column("side").to_numpy() == 0).sum())
        i, j, crowded = neighbours(*rows, again)
        i, j = i[(i >= new) & (j < new)], j[(i >= new) & (j < new)]
        x, y, z = rows[4][i], rows[4][j], np.unique(rows[4][crowded])
        pair = np.arange(len(x) + len(z)) < len(x)
        return pa.table({"a": np.concatenate([np.minimum(x, y), z]), "b": pa.array(np.concatenate([np.maximum(x, y), z]), mask=~pair)})

    return run


def _candidates(reps: DataFrame, again: bool) -> tuple[DataFrame, DataFrame]:
    """(distinct pairs, ids in crowded regions) of signatures (id, n, sig, part) in all orders."""
    key = ["tree", "head", "tail", "id"]
    rows = reps.select("id", "n", "sig", "part").mapInArrow(_orders(MORE if again else ORDERS), _ROWS)
    found = materialize(rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_scan(again), _FOUND), "found")
    edges = found.where("border is not null")
    # a row for each partition comes to the driver, and goes out again with the borders where its rows are looked at
    sizes = {r.border: r.n for r in edges.where("side = 0").groupBy("border").agg(F.count("*").alias("n")).toLocalIterator()}
    where = reps.sparkSession.createDataFrame(before(sizes, max(REGION, WINDOW)), "at long, side int, border long")
    across = edges.withColumnRenamed("border", "at").join(F.broadcast(where), ["at", "side"]).drop("at").groupBy("border").applyInArrow(_across(again), "a long, b long")
    both = materialize(found.where("border is null").select("a", "b").unionByName(across).distinct(), "pairs")
    return both.where("b is not null"), materialize(both.where("b is null").select(F.col("a").alias("id")), "crowded")


def cells(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of shingles in the two tables of frequencies, which lie behind each other."""
    high, low = s >> np.uint64(64 - RARE_BITS), s & np.uint64((1 << RARE_BITS) - 1)
    return high.astype(np.int64), low.astype(np.int64) + (1 << RARE_BITS)


def _cells(batches):
    """(cell, n): how many texts' shingles fall in each cell of the tables of frequencies."""
    total = np.zeros(2 << RARE_BITS, np.int64)
    for batch in batches:
        for a, b in W.slices(batch.column(1)):
            for at in cells(np.concatenate(W.shingle_sets(batch.column(1).slice(a, b - a)))):
                total += np.bincount(at, minlength=len(total))
    some = np.flatnonzero(total)
    for k in range(0, len(some), _KEEP):
        yield pa.RecordBatch.from_arrays([pa.array(some[k : k + _KEEP]), pa.array(total[some[k : k + _KEEP]])], ["cell", "n"])


def rarest(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The shingles, rarest first, of which sets of a similarity of 3/4 share one: a level of frequency and 56 bits of the hash."""
    p = len(s) - (3 * len(s) + 3) // 4 + 1
    one, two = cells(s)
    key = np.minimum(level[one], level[two]).astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
    return np.sort(np.partition(key, p - 1)[:p])


def _postings(level):
    """A row for each of the rarest shingles of a text."""

    def run(batches):
        for batch in batches:
            for a, b in W.slices(batch.column(1)):
                sets = W.shingle_sets(batch.column(1).slice(a, b - a))
                keys = [rarest(s, level.value) for s in sets]
                size = np.array([len(k) for k in keys], np.int64)
                h, pos = np.concatenate(keys), np.concatenate([np.arange(k) for k in size])
                of, n = np.repeat(np.arange(len(keys)), size), np.repeat([len(s) for s in sets], size)
                ids, part = batch.column(0).to_numpy()[a:b], batch.column(2).to_numpy()[a:b]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(pos), pa.array(n), pa.array(ids[of]), pa.array(part[of])], ["h", "pos", "n", "id", "part"])

    return run


def _exact(texts: DataFrame) -> DataFrame:
    """All pairs of different parts that may have a similarity of 3/4, of (id, text, part) with some shingles each: none is missing.

    The order of shingles by frequency only has to be the same for all, so two tables of cells do, whose size does not
    grow with the corpus: they keep the shingles of very many texts out of the rarest, whatever the rest are taken for.
    A shingle of many texts is dealt to several tasks; texts of the part that has most of its rows do not meet each other.
    """
    counts = texts.mapInArrow(_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    level = np.zeros(2 << RARE_BITS, np.uint8)
    level[counts.column("cell").to_numpy()] = np.minimum(255, 8 * np.log2(counts.column("n").to_numpy())).astype(np.uint8)
    rows = materialize(texts.mapInArrow(_postings(texts.sparkSession.sparkContext.broadcast(level)), "h long, pos long, n long, id long, part long"), "postings")
    parts = rows.groupBy("h", "part").agg(F.count("*").alias("c"))
    hs = parts.groupBy("h").agg(F.max_by("part", F.struct("c", "part")).alias("major"), (F.sum("c") - F.max("c")).alias("rest")).where("rest > 0")
    mixed = materialize(rows.join(hs.withColumn("salts", F.ceil(F.col("rest") / SALTED).cast("int")), "h"), "mixed")
    a = mixed.where("part <> major").select("h", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), *(F.col(c).alias(f"{c}_a") for c in ("pos", "n", "id", "part")))
    b = mixed.select("h", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "pos", "n", "id", "part", "major")
    # texts that meet first at these places have at most so many shingles in common, and need 3/7 of all
    met = a.join(b, ["h", "salt"]).where("part_a <> part and (part = major or id_a < id) and 4 * least(n_a, n) >= 3 * greatest(n_a, n) and 7 * least(n_a - pos_a, n - pos) >= 3 * (n_a + n)")
    pairs = materialize(met.select(F.least("id_a", "id").alias("a"), F.greatest("id_a", "id").alias("b")).distinct(), "exact")
    drop(rows)
    drop(mixed)
    return pairs


def _confirm(batches):
    """Pairs whose full shingle sets have a similarity of 3/4 at least."""
    for batch in batches:
        ta, tb = batch.column(2), batch.column(3)
        for x, y in W.slices(ta, beside=tb):
            one, two = W.shingle_sets(ta.slice(x, y - x)), W.shingle_sets(tb.slice(x, y - x))
            ok = []
            for p, q in zip(one, two, strict=True):
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= 75 * (len(p) + len(q) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Words are the runs of bytes that are neither space nor control characters 9 to 13, A-Z in lower
    case; a set holds the distinct runs of five words (a shorter text is one run). Documents of a
    similarity of 0.75 or more are linked; component_id is the smallest id reachable, and ``kept``
    is true for it alone. A null, empty or blank text has no shingles and is linked with nothing.
    A null id is never linked: component_id is null and ``kept`` true. Ids are read as long integers and meant
    to be unique: repeated rows get the same values, and where one id has different texts, that of the
    smallest hash is compared. Further columns of ``docs`` are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    signed = materialize(docs.mapInArrow(_sign, _SIGNED), "signed")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "classes")
    one = known.select("d1", "d2", F.col("doc_id").alias("id"), "n_shingles", "sig")
    reps = materialize(one.join(classes.select("d1", "d2", "id"), ["id", "d1", "d2"], "left_semi").select("id", F.col("n_shingles").alias("n"), "sig"), "reps")
    pairs, crowded = _candidates(reps.withColumn("part", F.col("id")), False)
    need = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(crowded.select(F.col("id").alias("doc_id"))).distinct()
    texts = docs.join(need.hint("shuffle_hash"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = materialize(texts, "texts")

    def links(of: DataFrame) -> DataFrame:
        sides = of.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        # written, so that what comes next does not keep a second Python worker beside this one
        return materialize(sides.select("a", "b", "ta", "tb").mapInArrow(_confirm, "a long, b long"), "links")

    label = materialize(components(links(pairs)), "components")
    if not crowded.isEmpty():
        parts = reps.join(crowded, "id", "left_semi").join(label.select(F.col("node").alias("id"), "component"), "id", "left")
        wider, _ = _candidates(parts.withColumn("part", F.coalesce("component", "id")), True)
        known = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
        label = materialize(components(links(wider).unionByName(known)), "components")
        drop(wider)
        left = texts.select(F.col("doc_id").alias("id"), "text").join(crowded, "id", "left_semi").join(label.select(F.col("node").alias("id"), "component"), "id", "left")
        rest = _exact(left.select("id", "text", F.coalesce("component", "id").alias("part")))
        known = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
        label = materialize(components(links(rest).unionByName(known)), "components")
        drop(rest)
    for x in (reps, pairs, texts):
        drop(x)
    shared = classes.where("copies > 1").join(label, F.col("id") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "id").alias("of_class"))
    shared = materialize(shared, "shared")
    out = signed.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("d1")).alias("d1"), "d2")
    out = out.join(shared, ["d1", "d2"], "left").join(label, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("of_class", "component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
