"""Nearest neighbours by a block matrix join with int8 tiles; exact.

Queries and candidates are dealt into blocks; each pair of a query group and a candidate slot is one task.  There, unit
vectors are rounded to int8 and multiplied as a tile (sums of small integers, exact in float32).  The rounding errors'
norms bound how far a tile's value can be from the cosine, so whatever can't reach a query's k nearest is dropped; the
rest is computed again in double precision on the original vectors, and heaps merge the tiles' results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, prepare

#: Bytes of candidates in a slot and of queries in a group, about.
SLOT_BYTES, GROUP_BYTES = 16 << 20, 32 << 20
#: Rows and columns of a tile.
TILE = 2048
#: Products of int8 summed exactly in float32.
EXACT = 1000


def _blocks(batches: Iterator[pd.DataFrame], rows: int = 2000) -> Iterator[pd.DataFrame]:
    """Valid vectors of one length each, as blobs: (part, dim, ids, vectors)."""
    held: dict[int, tuple[list, list]] = {}

    def pour(dim: int) -> pd.DataFrame:
        ids, vectors = held.pop(dim)
        part = int(np.array(ids, dtype=np.int64).sum()) & 0x7FFFFFFF
        return pd.DataFrame([(part, dim, np.array(ids, dtype="<i8").tobytes(), np.stack(vectors).astype("<f8").tobytes())], columns=["part", "dim", "ids", "vectors"])

    for pdf in batches:
        for i, v in zip(pdf["vec_id"].tolist(), pdf["embedding"], strict=True):
            if i is None or i != i or v is None or not len(v):
                continue
            x = np.array([np.nan if c is None else c for c in v] if getattr(v, "dtype", object) == object else v, dtype=np.float64)
            if np.isfinite(x).all() and x.any():
                ids, vectors = held.setdefault(len(x), ([], []))
                ids.append(int(i))
                vectors.append(np.ldexp(x, -np.frexp(np.abs(x).max())[1]))  # a power of two: no cosine changes, and no square overflows
                if len(ids) >= rows:
                    yield pour(len(x))
    for dim in list(held):
        yield pour(dim)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values as float32, their scale, norm of the rounding error) of unit vectors."""
    scale = np.abs(v).max(axis=1) / 127
    q = np.rint(v / scale[:, None])
    return q.astype(np.float32), scale, np.sqrt(((v - q * scale[:, None]) ** 2).sum(axis=1))


def tile(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows, exact: longer vectors are summed in pieces."""
    if q.shape[1] <= EXACT:
        return (q @ c.T).astype(np.float64)
    return sum((q[:, b : b + EXACT] @ c[:, b : b + EXACT].T).astype(np.float64) for b in range(0, q.shape[1], EXACT))


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    big = np.abs(v).max(axis=1, keepdims=True)
    norm = np.sqrt(((v / big) ** 2).sum(axis=1, keepdims=True)) * big
    return v / norm, norm[:, 0]


def _read(pdf: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(pdf["ids"]), "<i8"), np.frombuffer(b"".join(pdf["vectors"]), "<f8").reshape(-1, dim)


def _distinct(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that differ in id or vector, those of an id together."""
    rows = np.column_stack([ids.view("<f8"), v + 0.0])  # + 0.0: no negative zeros
    some = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1] * 8}")[:, 0], return_index=True)[1]
    some = some[np.argsort(ids[some], kind="stable")]
    return ids[some], v[some]


def search(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, cosine) of each query's k nearest candidates of another id, ties to the smaller id.

    Of rows that repeat an id the nearest counts: bounds, floors and heaps are those of ids, not of rows.
    """
    repeats = len(np.unique(cids)) < len(cids)
    if repeats:
        cids, c = _distinct(cids, c)
    qu, qn = _unit(q)
    cu, cn = _unit(c)
    q8, qs, qe = quantise(qu)
    c8, cs, ce = quantise(cu)
    best: list[list[tuple[float, int]]] = [[] for _ in qids]
    for a in range(0, len(qids), TILE):
        rows = slice(a, a + TILE)
        for b in range(0, len(cids), TILE):
            cols = slice(b, b + TILE)
            near = tile(q8[rows], c8[cols]) * qs[rows, None] * cs[None, cols]
            # |u.v - u'.v'| <= |u-u'||v'| + |u||v-v'|, with |u| = 1 and |v'| <= 1 + |v-v'|
            error = qe[rows, None] * (1 + ce[None, cols]) + ce[None, cols] + 1e-12
            near[qids[rows, None] == cids[None, cols]] = -np.inf
            floor = np.array([h[0][0] if len(h) == k else -np.inf for h in best[rows]])
            least, floors = near - error, floor[:, None]
            if repeats:  # ids are in order: one column an id, and no row counts that is surely farther than another of its id
                begins = np.flatnonzero(np.r_[True, np.diff(cids[cols]) != 0])
                least = np.maximum.reduceat(least, begins, axis=1)
                floors = np.repeat(least, np.diff(np.r_[begins, near.shape[1]]), axis=1)
            if least.shape[1] > k:
                floor = np.maximum(floor, np.partition(least, -k, axis=1)[:, -k])
            floors = np.maximum(floors, floor[:, None])
            left, right = np.nonzero((near + error >= floors) & (near > -np.inf))
            score = np.empty(len(left))
            for some in np.array_split(np.arange(len(left)), 1 + len(left) * q.shape[1] // (1 << 21)):
                i, j = a + left[some], b + right[some]
                score[some] = (q[i] * c[j]).sum(axis=1) / (qn[i] * cn[j])
            ids = cids[b + right]
            order = np.lexsort((ids, -score, left))
            if repeats:
                best_of = np.lexsort((-score, ids, left))
                same = np.r_[False, (np.diff(left[best_of]) == 0) & (np.diff(ids[best_of]) == 0)]
                first = np.zeros(len(order), dtype=bool)
                first[best_of[~same[: len(best_of)]]] = True
                order = order[first[order]]
            begin = np.searchsorted(left[order], np.arange(len(floor) + 1))
            for row in range(len(floor)):
                heap = best[a + row]
                for at in order[begin[row] : min(begin[row + 1], begin[row] + k)].tolist():
                    item = (float(score[at]), -int(ids[at]))
                    known = next((n for n, x in enumerate(heap) if x[1] == item[1]), -1) if repeats else -1
                    if known >= 0:  # an id whose rows lie in two tiles
                        heap[known] = max(heap[known], item)
                        heapq.heapify(heap)
                    elif len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
    return [(int(i), -v, s) for i, heap in zip(qids, best, strict=True) for s, v in heap]


def _searched(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = search(*_read(queries, key[2]), *_read(candidates, key[2]), k) if len(candidates) and len(queries) else []
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of the largest cosine, ties to the smaller vec_id.

    vectors and queries have vec_id and embedding (an array of numbers); other columns are ignored.  Candidates are all
    rows of another vec_id and of the same length; fewer than k are all returned.  Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without an id, take no part; ids may be negative, components of any size.  Rows that repeat a vec_id count once, with
    the best score.  score is in double precision on the original vectors.
    """
    spark = vectors.sparkSession
    prepare(spark)
    shape = "part int, dim int, ids binary, vectors binary"
    size = F.octet_length("vectors")
    own = [materialize(df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(_blocks, shape), "nearest-blocks") for df in (vectors, queries)]
    bytes_of = [t.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] for t in own]
    slots, groups = max(1, -(-bytes_of[0] // SLOT_BYTES)), max(1, -(-bytes_of[1] // GROUP_BYTES))
    candidates = own[0].withColumn("slot", F.pmod(F.xxhash64("part", "ids"), F.lit(slots)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = own[1].withColumn("grp", F.pmod(F.xxhash64("part", "ids"), F.lit(groups)).cast("int")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    keys = ["slot", "grp", "dim"]
    found = candidates.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(lambda key, a, b: _searched(key, a, b, k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = materialize(once.withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    forget(*own)
    return out


#: Of op 5's query.
ORACLE = """
WITH v AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
           WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.norm * c.norm) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
