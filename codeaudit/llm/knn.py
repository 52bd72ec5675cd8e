"""Exact top-k search by a Voronoi join (operator 1).

Each component x of a vector becomes floor(scale * x); the score of a query
and a candidate is the integer inner product.  Inner products are turned into
distances by one more coordinate, sqrt(M - |x|^2) for candidates (M: the
largest |x|^2) and 0 for queries: the larger the product, the smaller the
distance.

Method: queries are grouped by their nearest pivot.  From summaries (for each
pivot the distances of the k + 1 nearest ids of the data to it, and the radius of its
queries) follows a distance within which all answers of the group lie; data
rows that the triangle inequality puts beyond it take no part in the group.
The rest goes, each row once with marks of its groups, in packs to parts of the
data; a part's task holds a share of the queries and streams the part's packs
past them, keeping each query's k best.  Products are formed in float32 with a
bound on their error; what may be among the best is scored exactly.  Parts and
shares have bounded sizes, and components pass exchanges in as few bytes as
the largest needs, so no task holds a group and rows are copied once for each
share alone.

Defined results: vectors (or ids) that are null, or vectors with null or
non-finite components, take no part; shorter vectors count as padded with
zeros, so an empty one scores 0; ties go to the smaller id; a query id given
by several rows is answered once, for the least of its vectors; every other
row is a candidate of its own unless it has the query's id; scores beyond a
long are cut to its range; empty tables give no rows; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeaudit.llm.common import map_batches, written
from codeaudit.llm.words import mix

#: Beyond this, products may leave float64's or a long's exact range.
_SAFE, _LONG = 1 << 20, 1 << 62
#: Less than any score.
_NONE = -(1 << 63)
#: Components of the queries that a task holds, of the data in a part and of a pack, at most or nearly so.
_HELD, _PART, _PACK = 1 << 22, 1 << 24, 1 << 20
#: Queries, or first rows, of one product; packs that are worth a part.
_BLOCK, _PACKS = 1024, 32


def _packed(column: pa.Array, scale: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Which rows of a list column of numbers are vectors, and for those the
    components as bytes, their number, square sum and largest size."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]].astype(np.float64)  # null is NaN
    at = at - at[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = bad[at[1:]] == bad[at[:-1]]
    flat = np.floor(np.clip(scale * np.where(np.isfinite(flat), flat, 0), -float(_LONG), float(_LONG)))
    square = np.zeros(len(at) - 1)
    most = np.zeros(len(at) - 1)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        square[some] = np.add.reduceat(flat * flat, at[some])
        most[some] = np.maximum.reduceat(np.abs(flat), at[some])
    rows = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(flat.astype(np.int64))])
    return good, [rows, pa.array(np.diff(at).astype(np.int32)), pa.array(square), pa.array(most.astype(np.int64))]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column, or of a column of packed rows, padded with
    zeros to `dims`."""
    if not len(column):
        return np.zeros((0, dims), np.int64)
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    else:
        column = column.cast(pa.large_binary())
        _, ends, held = column.buffers()
        at = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1] // 8
        flat = np.frombuffer(held, np.int64, int(at[-1])) if held is not None else np.zeros(0, np.int64)
    n = np.diff(at)
    if (n == dims).all():
        return flat[at[0]:at[-1]].reshape(-1, dims)
    out = np.zeros((len(n), dims), np.int64)
    out[np.arange(dims) < n[:, None]] = flat[at[0]:at[-1]]
    return out


def _augmented(v: np.ndarray, top: float, query: bool) -> np.ndarray:
    v = v.astype(np.float64)
    last = np.zeros(len(v)) if query else np.sqrt(np.maximum(top - (v * v).sum(1), 0))
    return np.column_stack([v, last])


def _distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] - 2 * a @ pivots.T + (pivots * pivots).sum(1)
    return np.sqrt(np.maximum(square, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(x).max(initial=0)))
    if most < _SAFE and q.shape[1] <= 1 << 12:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)  # below 2**52: exact
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, 1 - (1 << 63), (1 << 63) - 1).astype(np.int64) if exact.size else np.zeros(exact.shape, np.int64)


class _Best:
    """The k best rows so far of each of some queries, ties to smaller ids,
    without those whose id is the query's own.  `small`: components are below
    `_SAFE` and not too many, so float32 products have a bound on their error."""

    def __init__(self, own: np.ndarray, q: np.ndarray, k: int, small: bool):
        self.own, self.q, self.k, self.small, self.seen = own, q, k, small, 0
        self.score = np.full((len(q), k), _NONE, np.int64)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        if small:
            self.q32 = q.astype(np.float32)
            self.slack = (q.shape[1] + 2) * 2.0 ** -23 * np.sqrt((q.astype(np.float64) ** 2).sum(1))

    def put(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Few rows first: they raise what later ones must reach."""
        x32, size = (x.astype(np.float32), np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0))) if self.small else (None, 0)
        at = 0
        while at < len(ids):
            to = at + max(_BLOCK, 3 * self.seen)
            for s in range(0, len(self.q), _BLOCK):
                self._put(slice(s, s + _BLOCK), ids[at:to], x[at:to], x32[at:to] if self.small else None, size)
            self.seen += len(ids[at:to])
            at = to

    def _put(self, block: slice, ids: np.ndarray, x: np.ndarray, x32: np.ndarray | None, size: float) -> None:
        least, q, own, exact = self.score[block, -1], self.q[block], self.own[block], x32 is None
        last = least
        if exact:
            score, err = _scores(q, x), 0
        else:
            score, err = self.q32[block] @ x32.T, self.slack[block] * size + 1
            least = least - err
        if not self.seen and len(ids) > self.k:
            score[own[:, None] == ids] = _NONE if exact else -np.inf
            least = np.maximum(least, np.partition(score, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 2 * err)
        if not exact:
            least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        found = np.flatnonzero(score >= least[:, None])
        i, j = np.divmod(found, len(ids))
        other = own[i] != ids[j]
        i, j = i[other], j[other]
        if not exact and len(i) <= 1 << 16:
            s = np.einsum("ij,ij->i", q[i], x[j])
        else:
            s = (score if exact else _scores(q, x))[i, j]
        better = (s > last[i]) | ((s == last[i]) & (ids[j] < self.ids[block, -1][i]))
        i, s, d = i[better], s[better], ids[j][better]
        if not len(i):
            return
        hit = np.unique(i)
        i = np.concatenate([np.repeat(hit, self.k), i])
        s = np.concatenate([self.score[block][hit].ravel(), s])
        d = np.concatenate([self.ids[block][hit].ravel(), d])
        order = np.lexsort((d, ~s, i))
        i, s, d = i[order], s[order], d[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < self.k
        self.score[block][i[keep], rank[keep]] = s[keep]
        self.ids[block][i[keep], rank[keep]] = d[keep]

    def rows(self) -> pa.RecordBatch:
        i, r = np.nonzero(self.score != _NONE)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.own[i], self.ids[i, r], self.score[i, r])],
                                          names=["query_id", "vec_id", "score"])


def _part(task: int, sent: int, parts: int) -> int:
    """The part of a task's pack: in turn, from a place of the task's own, so
    parts are even whatever the ids and their order."""
    return int((mix(np.array([task + 1], np.uint64))[0] + np.uint64(sent)) % np.uint64(parts))


def knn_join(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10,
             scale: int = 1024, pivots: int = 8, pack_rows: int = 2048, query_rows: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best other
    rows.  `is_query` is a predicate on the column `vec_id`."""
    spark = vectors.sparkSession

    def pack_vectors(batches):
        for b in batches:
            at = b.column(1).offsets
            step = max(1, _PACK * b.num_rows // max(1, at[-1].as_py() - at[0].as_py())) if b.num_rows else 1
            for s in range(0, b.num_rows, step):
                some = b.slice(s, step)
                good, cols = _packed(some.column(1), scale)
                yield pa.RecordBatch.from_arrays([some.column(0), *cols], names=["vec_id", "x", "n", "square", "most"]).filter(pa.array(good))

    e = F.col(embedding)
    if vectors.select(e).schema[0].dataType.elementType.typeName() not in ("float", "double"):
        e = e.cast("array<double>")
    data = written(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("e")).filter("vec_id is not null and e is not null").mapInArrow(
        pack_vectors, "vec_id long, x binary, n int, square double, most long"), "vectors")

    def unpack(b: pa.RecordBatch) -> pa.RecordBatch:
        x = b.column(1).cast(pa.large_binary())
        lists = [np.frombuffer(v.as_buffer(), np.int64) for v in x]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["vec_id", "v"])

    queries = map_batches(data.filter(is_query).select("vec_id", "x"), unpack, "vec_id long, v array<long>").groupBy("vec_id").agg(
        F.min("v").alias("v"))
    dims, top, largest, n = data.agg(F.max("n"), F.max("square"), F.max("most"), F.count("*")).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], out)
    dims = max(dims, 1)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if largest <= np.iinfo(t).max)
    small = largest < _SAFE and dims <= 1 << 12
    pack_rows = max(1, min(pack_rows, _PACK // dims))
    chosen = data.orderBy(F.xxhash64("vec_id", "x"), "vec_id", "x").limit(pivots).select("x").collect()
    centre = _augmented(_matrix(pa.array([bytes(r["x"]) for r in chosen], pa.binary()), dims), top, False)
    groups = len(centre)
    held_centre = spark.sparkContext.broadcast(centre)

    # Summaries: the k + 1 nearest distances to each pivot, and the queries' radius.
    def nearest(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column(0).to_numpy()
        d = _distances(_augmented(_matrix(b.column(1), dims), top, False), held_centre.value)
        rows = []
        for g in range(groups):
            order = np.argsort(d[:, g], kind="stable")
            at = order[np.sort(np.unique(ids[order], return_index=True)[1])[:k + 1]]  # the nearest row of each id
            rows.append((np.full(len(at), g, np.int32), ids[at], d[at, g]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)],
                                          names=["g", "vec_id", "d"])

    near = map_batches(data.select("vec_id", "x"), nearest, "g int, vec_id long, d double").groupBy("g", "vec_id").agg(
        F.min("d").alias("d"))
    w = Window.partitionBy("g").orderBy("d", "vec_id")
    reach = {r["g"]: (r["d"], r["n"]) for r in near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
             .groupBy("g").agg(F.max("d").alias("d"), F.max("r").alias("n")).collect()}  # a row a pivot

    def assign(b: pa.RecordBatch) -> pa.RecordBatch:
        v = _matrix(b.column(1), dims)
        d = _distances(_augmented(v, top, True), held_centre.value)
        g = d.argmin(1) if len(d) else np.zeros(0, np.int64)
        rows = []
        for i in range(groups):
            mine = np.flatnonzero(g == i)
            for s in range(0, len(mine), query_rows):
                m = mine[s:s + query_rows]
                rows.append((i, float(d[m, i].max()), b.column(0).to_numpy()[m].tobytes(), v[m].astype(kind).tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            cols, (pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=["g", "radius", "qids", "qs"])

    asked = written(map_batches(queries.select("vec_id", "v"), assign, "g int, radius double, qids binary, qs binary"), "queries")
    asks = asked.groupBy("g").agg(F.max("radius").alias("r"), F.sum(F.octet_length("qids")).alias("n")).collect()  # a row a pivot
    bound = np.full(groups, -1.0)
    for r in asks:
        d, found = reach[r["g"]]
        # With k other rows or fewer every row is an answer.
        bound[r["g"]] = (2 * r["r"] + d) * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(top)) if found > k else np.inf
    limits = spark.sparkContext.broadcast(bound)
    # Every share of the queries meets every part of the data in a task of its own.
    shares = max(1, -(-sum(r["n"] for r in asks) // 8 * dims // _HELD))
    parts = max(1, -(-n * dims // _PART), min(-(-n // (_PACKS * pack_rows)), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def send(batches):
        """Packs of the rows that some group may need; a pack goes to a part in turn."""
        held, count, sent, task = [], 0, 0, TaskContext.get().partitionId()

        def pack() -> pa.RecordBatch:
            cols = [np.concatenate(c).tobytes() for c in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([_part(task, sent, parts)], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)],
                                              names=["part", "ids", "needs", "xs"])

        for b in batches:
            for s in range(0, b.num_rows, pack_rows):
                some = b.slice(s, pack_rows)
                v = _matrix(some.column(1), dims)
                needs = _distances(_augmented(v, top, False), held_centre.value) <= limits.value
                at = np.flatnonzero(needs.any(1))
                if len(at):
                    held.append((some.column(0).to_numpy()[at], np.packbits(needs[at], 1), v[at].astype(kind)))
                    count += len(at)
                if count >= pack_rows:
                    yield pack()
                    held, count, sent = [], 0, sent + 1
        if count:
            yield pack()

    packs = data.select("vec_id", "x").mapInArrow(send, "part int, ids binary, needs binary, xs binary").select(
        F.explode(F.expr(f"transform(sequence(0, {shares - 1}), s -> part * {shares} + s)")).alias("key"), F.lit(-1).alias("g"), "ids", "needs", "xs")
    asked = asked.select(
        F.explode(F.expr(f"transform(sequence(0, {parts - 1}), p -> cast(p * {shares} + pmod(xxhash64(qids), {shares}) as int))")).alias("key"),
        "g", F.col("qids").alias("ids"), F.lit(None).cast("binary").alias("needs"), F.col("qs").alias("xs"))
    met = packs.unionByName(asked).repartitionById(parts * shares, "key").sortWithinPartitions("key", F.desc(F.col("g") >= 0), "g")

    def solve(batches):
        """A key's queries come first and are held; its data passes by."""
        key, found, mine = None, {}, {}

        def opened() -> None:
            for g, rows in mine.items():
                own, q = (np.concatenate(c) for c in zip(*rows, strict=True))
                found[g] = _Best(own, q, k, small)
            mine.clear()

        for b in batches:
            for i in range(b.num_rows):
                now, g, ids, needs, xs = (c[i] for c in b.columns)
                if now.as_py() != key:
                    yield from (x.rows() for x in found.values())
                    key = now.as_py()
                    found.clear()
                    mine.clear()
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                x = np.frombuffer(xs.as_buffer(), kind).reshape(-1, dims).astype(np.int64)
                if g.as_py() >= 0:
                    mine.setdefault(g.as_py(), []).append((ids, x))
                    continue
                opened()
                needs = np.unpackbits(np.frombuffer(needs.as_buffer(), np.uint8).reshape(len(ids), -1), axis=1)[:, :groups].astype(bool)
                for h, best in found.items():
                    at = needs[:, h]
                    if at.any():
                        best.put(*((ids, x) if at.all() else (ids[at], x[at])))
        yield from (x.rows() for x in found.values())

    best = met.mapInArrow(solve, "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
