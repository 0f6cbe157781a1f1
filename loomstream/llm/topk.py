"""Exact top-k inner product search over an impact-ordered index, score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEVELS = 64
#: Shares of a query's postings after which its bounds are looked at.
STOPS = (0.85, 1.0)


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component; null where the vector is null or holds a null or non-finite component."""
    c = F.col(vector)
    sound = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(c.isNotNull() & sound, F.transform(c, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


class ImpactIndex:
    """Posting segments of one block of integer vectors.

    A segment holds the vectors whose component in a dimension falls in one of LEVELS equal ranges; its level stands for
    their values.  A query's impact on a segment is its component times the level.  Segments of one dimension lie in the
    order of their levels, so those with impacts between two limits are one slice of the dimension's postings.
    """

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors, self.real = vectors, vectors.astype(np.float64)
        n, d = vectors.shape
        low = self.real.min(0)
        width = (self.real.max(0) - low + 1) / LEVELS
        step = np.floor((self.real - low) / width)
        level = low + (step + 0.5) * width
        order = np.argsort(step, axis=0, kind="stable")
        self.posting = np.ascontiguousarray(order.T)
        self.level = np.ascontiguousarray(np.take_along_axis(level, order, 0).T)
        # How far a row lies from its levels: by Cauchy and Schwarz no score is off by more than that times the query.
        self.off = np.sqrt(((self.real - level) ** 2).sum(1)) * (1 + 1e-9)
        self.longest = float(np.sqrt((self.real**2).sum(1).max()))
        self.most = float(np.abs(self.real).max())

    def search(self, query: np.ndarray, k: int, skip: int = -1, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) that hold the k best rows and their ties as far as scores reach floor; skip takes no part."""
        n, d = self.vectors.shape
        q = query.astype(np.float64)
        length = float(np.sqrt(q @ q))
        slack = self.off * length + 1 + 1e-9 * length * self.longest
        # The limits of impact that the stops lie at, from every 64th posting of each dimension.
        impacts = np.sort((q[:, None] * self.level[:, :: max(1, n // 64)]).reshape(-1))[::-1]
        limits = [impacts[int(stop * len(impacts)) - 1] if stop < 1 else -np.inf for stop in STOPS]
        # Until its segment is processed a dimension counts as the first limit, which is no less than what it can add.
        score = np.full(n, d * limits[0])
        done = np.zeros(d, np.int64)
        possible = np.arange(n)
        for at, limit in enumerate(limits):
            for j, x in enumerate(q):
                # Descending impact: from the largest level down for positive components, else from the least level up.
                if x > 0:
                    upto = n - np.searchsorted(self.level[j], limit / x, "right")
                elif x < 0:
                    upto = np.searchsorted(self.level[j], limit / x, "left")
                else:
                    upto = n if limit < 0 else 0
                begin, upto = done[j], max(done[j], upto)
                span = slice(begin, upto) if x <= 0 else slice(n - upto, n - begin)
                score[self.posting[j, span]] += x * self.level[j, span] - limits[0]
                done[j] = upto
            high = score + slack
            if skip >= 0:
                high[skip] = -np.inf
            least = floor
            if limit == -np.inf and n > k + (skip >= 0):
                low = score - slack
                if skip >= 0:
                    low[skip] = -np.inf
                least = max(floor, np.partition(low, n - k)[n - k])
            possible = np.flatnonzero(high >= least)
            # The bounds prove that no other row belongs to the result; scoring the rest is less than another step.
            if len(possible) * 8 <= n:
                break
        if skip >= 0:
            possible = possible[possible != skip]
        exact = self.most * float(np.abs(q).max(initial=0)) * d < 2**53
        found = (self.real[possible] @ q).astype(np.int64) if exact else self.vectors[possible] @ query
        return possible[found >= floor], found[found >= floor]


def exact_topk(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, block: int = 8192, query_block: int = 8192) -> DataFrame:
    """The k highest inner products of floor(scale * x) vectors for each query: query_id, rank, id, score.

    All of a query's candidates are searched but rows with the query's own id; with fewer, all are returned.  Ties go
    to the smaller id.  Vectors (and queries) that are null or hold a null or non-finite component take no part, nor
    do rows with a null id; only vectors of equal length are compared.  Of rows with one id and equal vectors each is
    a candidate; a query id that is given twice is searched once for each distinct vector.  Empty tables give no rows.

    Queries and candidates are dealt by hash into blocks and each pair of blocks is one group: a task holds at most a
    few times `block` vectors and `query_block` queries, so that a block is indexed once for thousands of queries.  It
    processes segments by descending impact and stops only when the score bounds prove which rows can be among the best;
    those are scored exactly.  Each query meets one block first; its k-th score there is a floor that all other blocks
    prune by, so that most of them return few of its rows or none.
    """
    as_rows = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), quantised(f"`{vec_col}`", scale).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    n_blocks, n_query_blocks = max(1, -(-vectors.count() // block)), max(1, -(-queries.count() // query_block))
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    home = F.pmod("qb", F.lit(n_blocks))
    others = F.filter(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda c: c != home)
    every = F.sequence(F.lit(0), F.lit(n_query_blocks - 1))
    left = as_rows(queries).distinct().withColumn("dims", F.size("vector")).withColumn("qb", deal(n_query_blocks, 1))
    right = as_rows(vectors).withColumn("dims", F.size("vector")).withColumn("cb", deal(n_blocks, 2)).withColumn("qb", F.explode(every))

    def matrix(table: pa.Table) -> np.ndarray:
        column = table["vector"].combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if len(asked) and len(there):
            order = np.argsort(there["id"].to_numpy(), kind="stable")
            ids, rows = there["id"].to_numpy()[order], matrix(there)[order]
            index = ImpactIndex(rows) if rows.shape[1] else None
            floors = asked["floor"].fill_null(np.iinfo(np.int64).min).to_pylist()
            for q, vector, floor in zip(asked["id"].to_numpy().tolist(), matrix(asked), floors, strict=True):
                a, b = np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")
                want = k + max(0, int(b - a) - 1)
                found, score = index.search(vector, want, int(a) if b > a else -1, floor) if index else (np.arange(len(ids)), np.zeros(len(ids), np.int64))
                own = ids[found] == q
                found, score = found[~own], score[~own]
                best = np.lexsort((ids[found], -score))[:k]
                for column, value in zip(out, (np.full(len(best), q), ids[found][best], score[best]), strict=True):
                    column.append(value)
        columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out]
        return pa.Table.from_arrays(columns, ["query_id", "id", "score"])

    keys = ["dims", "qb", "cb"]
    search = lambda asked, there: asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(run, "query_id long, id long, score long")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    first = search(left.withColumn("cb", home.cast("int")).withColumn("floor", F.lit(None).cast("long")), right.where(F.col("cb") == home))
    if n_blocks > 1:
        first = written(first)
        floors = first.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        asked = left.join(floors, "id", "left").withColumn("cb", F.explode(others))
        first = first.unionByName(search(asked, right.where(F.col("cb") != home)))
    ranked = first.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
