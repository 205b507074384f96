"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of about ``BLOCK`` rows and queries into blocks of about ``QUERIES``;
each pair of blocks meets in one group of bounded size.  There every dimension has its candidates in
sorted order, for all the group's queries.  A query reads its lists from the end that helps it, to depths
``DEPTHS``, scores what it has not seen, and stops once its kth score - of the block, or the one that a first
pass over some candidates promises - is above the threshold: what an unseen candidate could reach at most.
It goes on while the two are equal, as ties go to the smaller id.  The blocks' best are merged by rank.

The lists are those of the vectors rotated to their principal axes, where few dimensions hold most of what
scores are made of, so thresholds fall early if vectors are correlated at all; scores are exact, of the
vectors themselves.  Where no depth could stop a query - vectors that spread alike in all directions give
no list-wise bound, whatever the axes - the block is read along the axes instead: scores of the first axes,
and the product of the lengths of the rest, bound each candidate, and only those whose bound reaches the
kth score are scored whole.

Components are ``floor(scale * x)``.  Rows whose vector is null, empty, has null or non-finite components, or
whose id is null take no part; so do vectors of another length than the commonest (of equally common ones
the smallest).  Rows that repeat an id are rows of their own: a query's own row alone is left out.  Scores
that 64 bits cannot hold are clipped.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

BLOCK = 8192
QUERIES = 2048
#: Rows of each list read before a stop is tried, as divisors of the block's rows.
DEPTHS = (1024, 256, 64, 16, 8)
#: Dimensions up to which the axes are sought: their matrix is that squared.
MOST_AXES = 1024
#: Share of a query's squared length in the axes that are read first.
HEAD = 0.92
#: Share of what all lists may add to a score in those that are read.
LISTS = 0.9
#: What rounding may take from a bound of rotated vectors, as a share of the vectors' lengths.
SLACK = 1e-9


class Lists:
    """Sorted per-dimension lists over a block of vectors, along ``axes`` (orthonormal columns; else as they are)."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray | None = None):
        self.vectors = vectors
        self.axes = axes
        self.turned = self._turn(vectors)
        self.falling = np.argsort(-self.turned, axis=0, kind="stable")
        n = len(vectors)
        self.depths = [d for d in sorted({max(1, n // by) for by in DEPTHS}) if d < n]
        top = np.take_along_axis(self.turned, self.falling, axis=0)
        #: The lists' values at their ends and at the depths, from above and from below.
        self.high = top[[0, *(d - 1 for d in self.depths)]] if n else top
        self.low = top[[n - 1, *(n - d for d in self.depths)]] if n else top
        self.columns = np.ascontiguousarray(self.turned.T)
        self.squares = self.columns**2
        self.lengths = self.squares.sum(axis=0)
        #: Rows scored, and components read.
        self.read = self.components = 0

    def _turn(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors.astype(np.float64)
        return x if self.axes is None else x @ self.axes

    def search(self, queries: np.ndarray, k: int, ids: np.ndarray, uids: np.ndarray, own: np.ndarray, promised: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(places, scores)`` of each query's k best by score, then smaller id and uid; fewer, where others reach ``promised``."""
        turned = self._turn(queries)
        slack = SLACK * np.sqrt((turned**2).sum(axis=1) * self.lengths.max(initial=0.0)) + 1e-6
        floors = np.full(len(queries), -np.inf) if promised is None else promised
        place_of = {int(u): i for i, u in enumerate(uids)}
        for q in range(len(queries)):
            yield self._search(queries[q], turned[q], slack[q], k, ids, uids, place_of.get(int(own[q])), floors[q])

    def _search(self, query, turned, slack, k, ids, uids, own, floor):
        n = len(self.vectors)
        seen = np.zeros(n, bool)
        if own is not None:
            seen[own] = True
        best, scores = np.empty(0, np.int64), np.empty(0, self.vectors.dtype)

        def kth() -> float:
            return max(floor, float(scores[-1]) if len(scores) == k else -np.inf)

        def score(new: np.ndarray) -> None:
            nonlocal best, scores
            seen[new] = True
            self.read += len(new)
            self.components += len(new) * len(query)
            if len(new):
                places, values = np.r_[best, new], np.r_[scores, self.vectors[new] @ query]
                if len(places) > 4 * k:
                    least = np.partition(values, len(values) - k)[len(values) - k]
                    places, values = places[values >= least], values[values >= least]
                order = np.lexsort((uids[places], ids[places], -values))[:k]
                best, scores = places[order], values[order]

        # what each list may add at its end and at the depths; those that hold little of it are not read
        adds = np.where(turned > 0, self.high, self.low) * turned
        order = np.argsort(-adds[0])
        held = np.zeros(len(turned), bool)
        held[order[: int(np.searchsorted(np.cumsum(adds[0][order]), LISTS * adds[0].sum())) + 1]] = True
        bounds = adds[1:, held].sum(axis=1) + adds[0, ~held].sum() + slack
        up, down, last = np.flatnonzero(held & (turned > 0)), np.flatnonzero(held & (turned < 0)), 0
        for i, depth in enumerate(self.depths):
            if i and not (bounds[i:] < kth()).any():
                break  # no list would stop the search at what is known
            met = np.zeros(n, bool)
            met[self.falling[last:depth][:, up].ravel()] = True
            met[self.falling[n - depth : n - last][:, down].ravel()] = True
            score(np.flatnonzero(met & ~seen))
            last = depth
            if bounds[i] < kth():
                return best, scores
        rest = np.flatnonzero(~seen)
        if np.isfinite(kth()):
            # the axes that hold most of the query, and the lengths along the others
            order = np.argsort(-np.abs(turned))
            head = order[: int(np.searchsorted(np.cumsum(turned[order] ** 2), HEAD * (turned**2).sum())) + 1]
            other = np.sqrt(max(0.0, (turned**2).sum() - (turned[head] ** 2).sum()) * np.maximum(self.lengths - self.squares[head].sum(axis=0), 0))
            reach = turned[head] @ self.columns[head] + other + slack
            self.components += len(rest) * len(head)
            rest = rest[reach[rest] >= kth()]
        score(rest)
        return best, scores


def _matrix(table: pa.Table, name: str, dims: int) -> np.ndarray:
    column = table.column(name).combine_chunks()
    flat = (column.values if isinstance(column, pa.ListArray) else column.flatten()).to_numpy(zero_copy_only=False)
    first = column.offsets[0].as_py() if len(column) else 0
    return flat[first : first + len(column) * dims].reshape(-1, dims)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats while every partial sum of a product is below 2**53, else as Python integers."""
    most = (np.abs(a).max(initial=0)) * (np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return a, b
    whole = np.frompyfunc(int, 1, 1)
    return whole(a), whole(b)


FOUND = "query_id long, query_uid long, vec_id long, uid long, score long"


def _meet(k: int, dims: int, axes: np.ndarray | None):
    """What a block of candidates gives to a block of queries."""

    def run(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if candidates.num_rows and asked.num_rows:
            a, b = _exact(_matrix(candidates, "v", dims), _matrix(asked, "qv", dims))
            ids, uids, own, promised = *(candidates.column(c).to_numpy() for c in ("id", "uid")), asked.column("quid").to_numpy(), asked.column("promised").to_numpy()
            # rounding in huge numbers tells nothing of a bound: all is read
            lists = Lists(a, axes) if a.dtype != object else _Whole(a)
            for qid, quid, (places, scores) in zip(asked.column("qid").to_pylist(), own.tolist(), lists.search(b, k, ids, uids, own, promised), strict=True):
                out[0] += [qid] * len(places)
                out[1] += [quid] * len(places)
                out[2] += ids[places].tolist()
                out[3] += uids[places].tolist()
                out[4] += [max(-(2**63), min(2**63 - 1, int(s))) for s in scores]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "query_uid", "vec_id", "uid", "score"])

    return run


class _Whole:
    """Vectors of numbers beyond what floats hold."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors

    def search(self, queries, k, ids, uids, own, promised=None):
        for q, query in enumerate(queries):
            places = np.flatnonzero(uids != own[q])
            order = sorted(zip((-(self.vectors[places] @ query)).tolist(), ids[places].tolist(), uids[places].tolist(), places.tolist(), strict=True))[:k]
            yield np.array([o[3] for o in order], np.int64), [-o[0] for o in order]


def _axes(rows: DataFrame, dims: int) -> np.ndarray | None:
    """The principal axes of the vectors, from sums over all of them: a matrix of ``dims`` squared for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(pa.table([batch.column(0)], names=["v"]), "v", dims).astype(np.float64)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "sums"])

    # rows of the tasks' matrices are added where they meet, place by place
    parts = rows.select("v").mapInArrow(run, "row int, sums array<double>")
    added = parts.select("row", F.posexplode("sums").alias("at", "x")).groupBy("row", "at").agg(F.sum("x").alias("x")).collect()  # dims squared
    total = np.zeros((dims, dims))
    for r in added:
        total[r["row"], r["at"]] = r["x"]
    if not np.isfinite(total).all():
        return None
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1].copy()


def search(vectors: DataFrame, is_query: Column, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows that ``is_query`` marks, against all other rows."""
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
    ok &= ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("double") if scale else v).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = common.stage(rows.withColumn("uid", F.monotonically_increasing_id()), "topk-vectors", "zstd")
    sizes = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.min(F.size("v")), F.max(F.size("v"))).first()
    n, queries, dims, widest = sizes[0], sizes[1] or 0, sizes[2] or 0, sizes[3] or 0
    if dims != widest:
        dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]  # the commonest length
        rows = rows.where(F.size("v") == dims)
    axes = _axes(rows, dims) if 1 < dims <= MOST_AXES else None
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-queries // QUERIES))
    spread = lambda m: F.pmod(F.xxhash64("uid"), F.lit(m)).cast("int")
    asked = rows.where("q").select(F.col("id").alias("qid"), F.col("uid").alias("quid"), F.col("v").alias("qv"), spread(query_blocks).alias("qb"))
    if blocks > 1:
        # the first block's kth scores promise each query as much
        some = rows.where(spread(blocks) == 0).select("id", "uid", "v").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("b", F.lit(0))
        first = asked.withColumns({"b": F.lit(0), "promised": F.lit(float("-inf"))})
        seeds = some.groupBy("b", "qb").cogroup(first.groupBy("b", "qb")).applyInArrow(_meet(k, dims, axes), FOUND)
        least = seeds.groupBy("query_uid").agg(F.min("score").alias("promised"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        seeded = common.stage(asked.join(least.select(F.col("query_uid").alias("quid"), F.col("promised").cast("double")), "quid", "left").withColumn("promised", F.coalesce("promised", F.lit(float("-inf")))), "topk-queries")
    else:
        seeded = asked.withColumn("promised", F.lit(float("-inf")))
    left = rows.select("id", "uid", "v", spread(blocks).alias("b")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = seeded.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInArrow(_meet(k, dims, axes), FOUND)
    order = Window.partitionBy("query_id", "query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search_sql(every: int, k: int, scale: int, table: str = "embeddings", id_col: str = "vec_id", vector_col: str = "embedding") -> str:
    """The same as DuckDB SQL, for unlike ids."""
    return f"""WITH v AS (SELECT {id_col} AS id, list_transform({vector_col}, lambda x: floor(CAST(x AS DOUBLE) * {scale})) AS v FROM {table}
  WHERE {id_col} IS NOT NULL AND len({vector_col}) > 0 AND len(list_filter({vector_col}, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""
