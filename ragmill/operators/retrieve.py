"""Exact nearest neighbours under four metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bytes of query vectors that a task holds at a time; more queries go in further blocks.
QUERY_BYTES = 4 << 20
#: Distances that a task holds at a time.
CELLS = 1 << 21
DESCENDING = {"ip"}


def scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows); the smaller the nearer."""
    if metric == "ip":
        return -(q @ v.T)
    out = np.empty((len(q), len(v)))
    for i, x in enumerate(q):
        d = v - x
        out[i] = (d * d).sum(axis=1) if metric == "l2" else np.abs(d).sum(axis=1) if metric == "l1" else np.abs(d).max(axis=1)
    return out


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """(qid, rank, chunk_id, distance): the k nearest rows of ``corpus`` (chunk_id, embedding) for each of
    ``queries`` (qid, embedding); ties by chunk_id; fewer rows than k give what there is. A qid is one query: rows that
    repeat it count once, by the vector that sorts first; rows without a qid or a vector ask nothing.

    The corpus stays where it is. Queries stream through the driver in blocks of QUERY_BYTES. Each task keeps the k best of
    its rows for a block, so that the shuffle carries k rows per query and task; the rest is a ranked window, cut at k."""
    if metric not in ("l2", "ip", "l1", "linf"):
        raise ValueError(metric)
    asked = queries.where("qid IS NOT NULL AND embedding IS NOT NULL").groupBy("qid").agg(F.min("embedding").alias("embedding"))
    out, block = None, []

    def search():
        got = _nearest(np.array([r.qid for r in block]), np.array([r.embedding for r in block], np.float64), corpus, k, metric, exclude_self)
        return got if out is None else out.unionByName(got)

    for row in asked.orderBy("qid").toLocalIterator():
        block.append(row)
        if len(block) * 8 * len(row.embedding) >= QUERY_BYTES:
            out, block = search(), []
    if block:
        out = search()
    if out is None:
        return corpus.sparkSession.createDataFrame([], "qid long, rank int, chunk_id long, distance double")
    rank = F.row_number().over(W.partitionBy("qid").orderBy("distance", "chunk_id"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("qid", "rank", "chunk_id", (-F.col("distance") if metric in DESCENDING else F.col("distance")).alias("distance"))


#: Pairs whose distance is taken by itself at a time.
PAIRS = 1 << 15


def near(q: np.ndarray, v: np.ndarray, metric: str, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the pairs that can be among the k nearest: scores up to ``bar``, a number a query; where that
    is infinite up to the k-th of these rows; all ties. Under L2 a matrix product gives bounds that no rounding breaks, and
    distances are taken, as ``scores`` takes them, of pairs within them."""
    squares = (q * q).sum(axis=1)[:, None], (v * v).sum(axis=1)[None, :]
    bounded = metric == "l2" and all(np.isfinite(x).all() for x in squares)
    slack = 0.0
    if bounded:
        share = 4 * (q.shape[1] + 8) * np.finfo(np.float64).eps
        slack = 2 * share * (squares[0][:, 0] + squares[1].max(initial=0.0))
        low = (squares[0] + squares[1]) * (1 - share)
        low -= 2 * (q @ v.T)
    else:
        low = scores(q, v, metric)
    unset = np.flatnonzero(np.isinf(bar))
    if len(unset) and len(v) > k:
        bar = bar.copy()
        kth = np.partition(low[unset], k - 1, axis=1)[:, k - 1] + (slack[unset] if bounded else 0.0)
        bar[unset] = np.where(np.isnan(kth), np.inf, kth)
    row, col = np.nonzero(low <= bar[:, None])
    if not bounded:
        return row, col, low[row, col]
    d = np.empty(len(row))
    for at in range(0, len(row), PAIRS):
        x = v[col[at : at + PAIRS]] - q[row[at : at + PAIRS]]
        d[at : at + PAIRS] = (x * x).sum(axis=1)
    return row, col, d


def matrix(vectors, size: int) -> np.ndarray:
    """The rows of an Arrow list column."""
    flat = vectors.flatten()
    if not vectors.null_count and len(flat) == size * len(vectors) and (np.diff(vectors.offsets.to_numpy()) == size).all():
        return flat.to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
    return np.stack(vectors.to_numpy(zero_copy_only=False)).astype(np.float64)


def _nearest(ids, q, corpus, k, metric, exclude_self):
    def run(batches):
        import pyarrow as pa

        # the best so far, by query, distance and id; and each query's k-th distance
        row, best_i, best_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bar = np.full(len(ids), np.inf)
        step = max(64, CELLS // max(1, len(q)))
        for b in batches:
            there = b.column(0).to_numpy(zero_copy_only=False)
            v = matrix(b.column(1), q.shape[1]) if b.num_rows else np.zeros((0, q.shape[1]))
            for lo in range(0, len(v), step):
                r, c, d = near(q, v[lo : lo + step], metric, k + exclude_self, bar)
                i = there[lo + c]
                fits = np.isfinite(d) & (i != ids[r] if exclude_self else True)
                row, best_i, best_d = np.concatenate((row, r[fits])), np.concatenate((best_i, i[fits])), np.concatenate((best_d, d[fits]))
                order = np.lexsort((best_i, best_d, row))
                order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
                row, best_i, best_d = row[order], best_i[order], best_d[order]
                last = np.searchsorted(row, np.arange(len(ids)), side="right") - 1
                full = np.bincount(row, minlength=len(ids)) == k
                bar[full] = best_d[last[full]]
        yield pa.RecordBatch.from_arrays([pa.array(ids[row].astype(np.int64)), pa.array(best_i.astype(np.int64)), pa.array(best_d)], names=["qid", "chunk_id", "distance"])

    return corpus.select("chunk_id", "embedding").mapInArrow(run, "qid long, chunk_id long, distance double")


RETRIEVERS = {"exact": knn, "faiss": knn}
