"""Nearest neighbours by a block matrix join with int8 tiles.

Queries are sent to the tasks in blocks of at most `query_bytes`, one pass over the candidates for each block; the
candidates stay where they are and are not shuffled. In a task, blocks of `block_rows` candidates meet
`tile_rows` queries at a time: unit vectors quantised to int8 (one scale a vector) are multiplied as tiles;
with e the length of a vector's quantisation error, the true cosine lies within
e_q (1 + e_c) + e_c of the tile's value (plus float rounding). A pair survives if its upper bound reaches the k-th
largest lower bound of the query's first tile and, from then on, the k-th best cosine that the task has found for the query.
Survivors are recomputed, from the original vectors in double precision, and kept in the query's heap of k. The
heaps of all tasks, k rows each, are merged by a
window over (score, vec_id). So results are exact, whatever the quantisation loses.

Equal vectors of a block are compared once, with the k + 1 smallest ids that they have, which are all that may be among
the k nearest of a query; so a vector that a third of all rows hold costs no more than another.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those whose
length differs from the query's. Every row is a candidate of every query but itself: rows of a repeated id find each other, and each such
row for which the condition holds is a query of its own. Ties go to the smaller vec_id; a null id takes no part. With fewer than k candidates, all are
returned. Empty tables give no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, share, table, tidy


@dataclass(frozen=True)
class Nearest:
    """k neighbours; bytes of the vectors of a query block; rows of a candidate block; queries in a tile."""

    k: int = 5
    query_bytes: int = 32 << 20
    block_rows: int = 4096
    tile_rows: int = 512


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x with that of y, in double precision, summed component by component."""
    dot, xx, yy = (np.zeros(len(x)) for _ in range(3))
    for d in range(x.shape[1]):
        dot += x[:, d] * y[:, d]
        xx += x[:, d] * x[:, d]
        yy += y[:, d] * y[:, d]
    return np.clip(dot / np.sqrt(xx * yy), -1.0, 1.0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, lengths of the errors) of the unit vectors of x."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1) + 1e-6


class Queries:
    """Query vectors of one length, with the heaps of a task. rows: keys of the vectors' rows."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, p: Nearest):
        self.rows, self.vectors, self.p = rows, vectors, p
        self.codes, self.scale, self.error = quantised(vectors)

    def start(self) -> None:
        self.heaps: list[list[tuple[float, int, int]]] = [[] for _ in self.rows]  # (score, -id, row)
        self.bound = np.full(len(self.rows), -np.inf)

    def meet(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        k = self.p.k
        order = np.lexsort((rows, ids))
        ids, rows, vectors = ids[order], rows[order], np.ascontiguousarray(vectors[order])
        _, first, group = np.unique(vectors.view(np.dtype((np.void, vectors.strides[0]))).ravel(), return_index=True, return_inverse=True)
        held = np.argsort(group, kind="stable")  # rows of a group, smallest id first
        begin = np.searchsorted(group[held], np.arange(len(first) + 1))
        vectors = vectors[first]
        codes, scale, error = quantised(vectors)
        codes = codes.astype(np.float32).T
        for a in range(0, len(self.rows), self.p.tile_rows):
            b = min(len(self.rows), a + self.p.tile_rows)
            near = self.codes[a:b].astype(np.float32) @ codes  # int8 products, exact in float32 up to 1,040 components
            near *= self.scale[a:b, None].astype(np.float32)
            near *= scale.astype(np.float32)
            slack = self.error[a:b, None] * (1 + error) + error + (1e-5 if vectors.shape[1] <= 1040 else 1e-4)
            if np.isneginf(self.bound[a:b]).any() and near.shape[1] > k + 1:  # one of the k + 1 nearest groups may be the query itself
                low = np.partition(near - slack, near.shape[1] - k - 1, axis=1)[:, near.shape[1] - k - 1]
                self.bound[a:b] = np.maximum(self.bound[a:b], low)
            q, c = np.nonzero(near + slack >= self.bound[a:b, None])
            if not len(q):
                continue
            scores = cosine(self.vectors[a + q], vectors[c])
            for i, j, score in zip((q + a).tolist(), c.tolist(), scores.tolist(), strict=True):
                heap = self.heaps[i]
                for at in held[begin[j] : min(begin[j + 1], begin[j] + k + 1)].tolist():
                    if rows[at] != self.rows[i]:
                        entry = (score, -int(ids[at]), int(rows[at]))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                        else:
                            break
                if len(heap) == k and heap[0][0] > self.bound[i]:
                    self.bound[i] = heap[0][0]


def valid(df: DataFrame) -> DataFrame:
    """(row, id, v array<double>) of the vectors that take part; row is a key of the row."""
    v = F.col("embedding").cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists(v, lambda x: x != 0.0))
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), v.alias("v"))


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, vectors) of each length of vectors in a batch (row, id, v)."""
    rows, ids, v = (batch.column(k) for k in range(3))
    lengths = np.diff(v.offsets.to_numpy())
    for d in np.unique(lengths).tolist():
        at = pa.array(np.flatnonzero(lengths == d))
        yield rows.take(at).to_numpy(), ids.take(at).to_numpy(), v.take(at).flatten().to_numpy().reshape(-1, d)


def nearest(vectors: DataFrame, queries, p: Nearest = Nearest()) -> DataFrame:
    """(query_id, rank, vec_id, score): of vectors(vec_id, embedding), the k nearest of each row for which the Column `queries` of id holds."""
    spark = vectors.sparkSession
    rows = materialise(valid(vectors), "vectors")
    asked = rows.where(queries)
    size = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // p.query_bytes))
    heaps = None
    for k in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k)
        by: dict[int, list] = {}
        for batch in block.toArrow().to_batches():  # about query_bytes
            for keys, ids, x in _arrays(batch):
                by.setdefault(x.shape[1], []).append((keys, ids, x))
        shared = share(spark, {d: [np.concatenate(c) for c in zip(*parts, strict=True)] for d, parts in by.items()})

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = {d: Queries(keys, x, p) for d, (keys, _, x) in shared.value.items()}
            for q in asked.values():
                q.start()
            for batch in batches:
                for rows, ids, x in _arrays(batch):
                    if x.shape[1] in asked:
                        for a in range(0, len(ids), p.block_rows):
                            asked[x.shape[1]].meet(ids[a : a + p.block_rows], rows[a : a + p.block_rows], x[a : a + p.block_rows])
            for d, q in asked.items():
                found = [(int(key), int(query), -e[1], e[0]) for key, query, heap in zip(q.rows, shared.value[d][1], q.heaps, strict=True) for e in heap]
                yield pa.RecordBatch.from_pydict({n: pa.array([f[k] for f in found], t) for k, (n, t) in enumerate((("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

        part = rows.mapInArrow(tidy(search), "row long, query_id long, vec_id long, score double")
        if blocks > 1:
            part = materialise(part, "heaps")
            shared.unpersist()
        heaps = part if heaps is None else heaps.union(part)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return heaps.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLE = """
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5"""


def oracle() -> str:
    return ORACLE
