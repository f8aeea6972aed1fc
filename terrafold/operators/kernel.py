"""Ridge in its dual form, for features wider than the training side: n x n kernels from products of blocks of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fit import beside_total, ridge_path, summed
from .ranks import row_numbers, written


class TooManyRowsError(ValueError):
    """A kernel of so many rows has no place in one task; the primal form has."""


def ridge_dual(rows: DataFrame, vec: str, y: str, fold: str, order: list[str], alphas: list[float], block: int = 256, chunk: int = 4096, most: int = 4096) -> DataFrame:
    """(fold, alpha, n_train, r2): standardised ridge on each fold's complement, as ``fit.ridge_path`` gives it.

    Rows (named by ``order``) are dealt into blocks and their vectors into chunks; pairs of blocks meet chunk by chunk, each pair gives its part of every fold's
    kernel under that fold's own standardisation, and the parts are summed. A task holds two blocks of one chunk, then one kernel: ``most`` rows
    are allowed, beyond that it is an error. Vectors may be of any width.
    """
    src = rows.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(fold).cast("int").alias("fold"), F.col(vec).alias("v"), F.col(y).cast("double").alias("y")).where("v is not null and y is not null")
    src = written(row_numbers(src, [], [F.col("fold"), *(F.col(f"_o{i}") for i in range(len(order)))], "place"), "kernel-rows")
    n = src.count()
    if n > most:
        raise TooManyRowsError(f"{n} rows, {most} allowed")
    if not n:
        return rows.sparkSession.createDataFrame([], "fold int, alpha double, n_train long, r2 double")
    known = src.select("fold", "y").orderBy("place").collect()  # ``most`` rows at most
    folds, target = np.array([r["fold"] for r in known]), np.array([r["y"] for r in known])
    pieces = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / chunk).cast("int")), lambda i: F.slice(c, i * chunk + 1, F.lit(chunk)))

    # mean and deviation of each fold's training side, chunk by chunk
    x = src.select("fold", "place", F.posexplode(pieces("v")).alias("chunk", "part"))
    sums = summed(x.select("fold", "chunk", F.concat(F.array(F.lit(1.0)), "part", F.transform("part", lambda v: v * v)).alias("s")), ["chunk", "fold"], "s")
    sums = beside_total(sums, ["chunk"], "s").withColumn("t", F.zip_with("total_s", "s", lambda a, b: a - b))
    sides = sums.groupBy("chunk").agg(F.collect_list(F.struct("fold", "t")).alias("sides"))  # a row a fold

    cells = x.groupBy(F.floor((F.col("place") - 1) / block).cast("int").alias("b"), "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "part"))).alias("m"))
    cells = written(cells.select("b", "chunk", F.col("m.part").alias("m")), "kernel-blocks")
    left, right = cells.select("chunk", F.col("b").alias("i"), F.col("m").alias("mi")), cells.select("chunk", F.col("b").alias("j"), F.col("m").alias("mj"))
    pairs = left.join(right, "chunk").where("i <= j").join(sides, "chunk")

    def products(batches):
        for pdf in batches:
            out = []
            for i, j, mi, mj, side in zip(pdf["i"], pdf["j"], pdf["mi"], pdf["mj"], pdf["sides"]):
                a, b = np.stack(list(mi)), np.stack(list(mj))
                for s in side:
                    t, d = np.asarray(s["t"]), a.shape[1]
                    if t[0] < 1:
                        continue
                    mean = t[1 : 1 + d] / t[0]
                    sd = np.sqrt(np.maximum(t[1 + d :] / t[0] - mean**2, 0))
                    sd[sd <= 1e-12 * np.abs(mean)] = 1
                    sd[sd == 0] = 1
                    out.append((s["fold"], i, j, (((a - mean) / sd) @ ((b - mean) / sd).T).ravel()))
            yield pd.DataFrame(out, columns=["fold", "i", "j", "k"])

    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row holds two blocks
    parts = pairs.select("i", "j", "mi", "mj", "sides").mapInPandas(products, "fold int, i int, j int, k array<double>")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["fold"].iloc[0])
        k = np.zeros((n, n))
        for i, j, v in zip(pdf["i"], pdf["j"], pdf["k"]):
            a, b = slice(i * block, min(n, (i + 1) * block)), slice(j * block, min(n, (j + 1) * block))
            k[a, b] = np.reshape(v, (a.stop - a.start, b.stop - b.start))
            k[b, a] = k[a, b].T
        train, out = folds != f, []
        yt, ys = target[train], target[~train]
        my, sst = yt.mean(), ((ys - ys.mean()) ** 2).sum()
        w, q = np.linalg.eigh(k[np.ix_(train, train)])
        for alpha in alphas:
            dual = q @ ((q.T @ (yt - my)) / (np.maximum(w, 0) + alpha))
            sse = ((ys - my - k[np.ix_(~train, train)] @ dual) ** 2).sum()
            out.append((f, alpha, int(train.sum()), float(1 - sse / sst) if sst > 0 and len(ys) >= 8 else None))
        return pd.DataFrame(out, columns=["fold", "alpha", "n_train", "r2"])

    whole = written(summed(parts, ["fold", "i", "j"], "k"), "kernels")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    return whole.groupBy("fold").applyInPandas(solve, "fold int, alpha double, n_train long, r2 double")


def ridge(rows: DataFrame, vec: str, y: str, fold: str, order: list[str], alphas: list[float], most: int = 4096) -> DataFrame:
    """(fold, alpha, n_train, r2) by the form whose matrix is smaller: the dual one where vectors are longer than there are rows."""
    size = rows.where(F.col(vec).isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
    if size["n"] and size["d"] > size["n"] and size["n"] <= most:
        return ridge_dual(rows, vec, y, fold, order, alphas, most=most)
    return ridge_path(rows, vec, y, fold, alphas).select("fold", "alpha", "n_train", "r2")
