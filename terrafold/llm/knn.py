"""Approximate nearest neighbours by a block matrix join over int8 tiles.

Vectors are packed into blocks (one row per block). Query blocks meet every candidate block in an
equi-join on a stripe number; each resulting tile is one int8 matrix product. With per-vector
quantisation ``x = s*q + r`` and ``e = |r|``, the triangle inequality gives
``| |x-y| - |x^-y^| | <= e_x + e_y``. Per query the k-th smallest upper bound of a tile gives
the cut; candidates whose lower bound passes it are recomputed in double precision, so the k nearest
are exact. A task keeps one heap of the k best for each query of the block at hand while that block meets the candidates of
its stripe; heaps of different stripes are merged in two levels.

Bounds hold at any magnitude: a tile works in units of a power of two above its largest scale, rounding is bounded by the norms, and
distances whose squares leave the range of doubles are recomputed from scaled differences.

Edge cases: null, zero, empty or non-finite vectors and null ids take no part, as query or as
candidate. Vectors are compared only with vectors of the same length. Rows that share a query's id
count as its own row; equal rows of other ids are kept apart by id, and a repeated (id, vector) row
counts once. Ties go to the smaller id. A distance beyond the largest double is infinite. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

BLOCK = "dim int, block long, ids binary, codes binary, scale binary, slack binary, vectors binary"
HITS = "query_id long, vec_id long, score double, stripe int"


def usable(df: DataFrame, is_query: Column, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, query): distinct finite vectors that are not zero."""
    v = F.col(vec_col)
    return (
        df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .where(F.exists("v", lambda x: x != 0.0))
        .groupBy("id", "v")
        .agg(F.max("query").alias("query"))
    )


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and residual norm (rounded up) of each row."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127.0, 1e-300)
    part = x / scale[:, None]
    codes = np.rint(part).astype(np.int8)
    slack = (np.sqrt(((part - codes) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12 * math.sqrt(x.shape[1])) * scale
    return codes, scale, slack


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pair of rows, in doubles, component by component."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.zeros(len(a))
        for j in range(a.shape[1]):
            out += (a[:, j] - b[:, j]) ** 2
        far = np.flatnonzero(~np.isfinite(out) | (out < 1e-280))
        out = np.sqrt(out)
        if len(far):  # squares out of range: in units of the largest difference
            diff = np.abs(a[far] - b[far])
            top = diff.max(axis=1)
            part = diff / np.where((top > 0) & np.isfinite(top), top, 1.0)[:, None]
            out[far] = np.where(np.isfinite(top), top * np.sqrt((part**2).sum(axis=1)), np.inf)
    return out


def _pack(batches):
    for batch in batches:
        ids, dims, blocks, rows = (batch.column(i) for i in range(4))
        for i in range(batch.num_rows):
            key = np.asarray(ids[i].values.to_numpy(zero_copy_only=False), np.int64)
            x = rows[i].values.flatten().to_numpy(zero_copy_only=False).reshape(len(key), -1).astype(np.float64)
            codes, scale, slack = quantise(x)
            yield pa.RecordBatch.from_pydict(
                {"dim": pa.array([dims[i].as_py()], pa.int32()), "block": pa.array([blocks[i].as_py()], pa.int64())}
                | {n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(("ids", "codes", "scale", "slack", "vectors"), (key, codes, scale, slack, x))}
            )


def blocks(df: DataFrame, rows: int) -> DataFrame:
    """One row per block of about ``rows`` vectors of a written table; their number follows from a count."""
    n = max(1, -(-df.count() // rows))
    return (
        df.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(n)).alias("block"))
        .agg(F.collect_list(F.struct("id", "v")).alias("x"))
        .select(F.col("x.id").alias("ids"), "dim", "block", F.col("x.v").alias("rows"))
        .mapInArrow(_pack, BLOCK)
    )


def tile_hits(q: tuple, c: tuple, d: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, distance) of candidates that may be among a query's k nearest of this tile; ``q``, ``c``: ids, codes, scale, slack, vectors."""
    (qid, qc, qs, qe, qx), (cid, cc, cs, ce, cx) = q, c
    # float32 holds the int8 products exactly while d * 127 ** 2 < 2 ** 24
    kind = np.float32 if d < 1000 else np.float64
    unit = 2.0 ** math.frexp(max(qs.max(), cs.max()))[1]
    qs, cs, qe, ce = qs / unit, cs / unit, qe / unit, ce / unit
    qc, cc = qc.astype(kind), cc.astype(kind)
    qn, cn = (qc.astype(np.float64) ** 2).sum(1) * qs**2, (cc.astype(np.float64) ** 2).sum(1) * cs**2
    step = max(1, (1 << 21) // max(1, len(cid)))
    out = []
    for lo in range(0, len(qid), step):
        hi = min(lo + step, len(qid))
        near2 = qn[lo:hi, None] + cn[None, :]
        rounding = 1e-14 * near2 + 1e-290
        near2 -= 2 * (qc[lo:hi] @ cc.T).astype(np.float64) * qs[lo:hi, None] * cs[None, :]
        slack = qe[lo:hi, None] + ce[None, :]
        own = qid[lo:hi, None] == cid[None, :]
        upper = np.sqrt(np.maximum(near2, 0) + rounding) + slack
        upper = np.where(own, np.inf, upper * (1 + 1e-12))
        kth = min(k, upper.shape[1]) - 1
        least = np.partition(upper, kth, axis=1)[:, kth]
        lower = np.sqrt(np.maximum(near2 - rounding, 0)) * (1 - 1e-12) - slack
        r, col = np.nonzero(~(lower > least[:, None]) & ~own)
        out.append((lo + r, cid[col], distances(qx[lo + r], cx[col])))
    return tuple(np.concatenate(x) for x in zip(*out))


def best_of(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each row by score, then id."""
    order = np.lexsort((ids, score, rows))
    rows, ids, score = rows[order], ids[order], score[order]
    top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[top], ids[top], score[top]


def _tiles(k: int):
    def run(batches):
        key, qid, heaps = None, None, None

        def done():
            rows, ids, score = heaps
            return pa.RecordBatch.from_pydict({"query_id": qid[rows], "vec_id": ids, "score": score, "stripe": pa.array(np.full(len(rows), key[1]), pa.int32())})

        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)  # noqa: B023, E731
                d, now = batch.column("dim")[i].as_py(), tuple(batch.column(c)[i].as_py() for c in ("dim", "stripe", "q_block"))
                side = lambda p: (cell(p + "ids", np.int64), cell(p + "codes", np.int8).reshape(-1, d), cell(p + "scale", np.float64), cell(p + "slack", np.float64), cell(p + "vectors", np.float64).reshape(-1, d))  # noqa: B023, E731
                q = side("q_")
                found = tile_hits(q, side(""), d, k)
                if now != key:
                    if key is not None:
                        yield done()
                    key, qid, heaps = now, q[0], best_of(*found, k)
                else:
                    heaps = best_of(*(np.concatenate(x) for x in zip(heaps, found)), k)
        if key is not None:
            yield done()

    return run


def merged(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest of ``hits`` for each key, as a sorted array ``x``."""
    return hits.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("x"))


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", query_rows: int = 1024, rows: int = 4096, stripes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest other vectors by Euclidean distance.

    ``stripes`` deals the candidate blocks into that many join keys (one a shuffle partition by default); each key gets one copy of the
    query blocks, so the shuffle holds the candidates once and the queries ``stripes`` times, and a query has at most
    ``stripes * k`` hits to merge, however large the table is.
    """
    spark = df.sparkSession
    stripes = stripes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_ = stash(usable(df, is_query, id_col, vec_col), "knn-vectors")
    queries = blocks(all_.where("query"), query_rows)
    queries = queries.select("dim", F.col("block").alias("q_block"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "codes", "scale", "slack", "vectors")))
    queries = queries.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    candidates = blocks(all_, rows).withColumn("stripe", F.pmod("block", F.lit(stripes)).cast("int")).drop("block")
    # a tile holds two blocks, so Arrow batches of few rows keep workers small
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    # query blocks are the streamed side: one of them meets all candidates of its stripe, then the next
    hits = queries.hint("merge").join(candidates, ["dim", "stripe"]).mapInArrow(_tiles(k), HITS)
    groups = max(1, math.isqrt(stripes))
    some = merged(hits.withColumn("group", F.pmod("stripe", F.lit(groups))), ["query_id", "group"], k)
    best = merged(some.select("query_id", F.explode("x").alias("h")).select("query_id", "h.*"), ["query_id"], k)
    return best.select("query_id", F.posexplode("x").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
