"""Per-fold read-outs from sufficient statistics: one aggregation, tiny solves, no refits over rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import dealt, row_numbers, written

PERIOD = 365.25
#: Numbers of sums of products that a task holds before it passes them on.
GRAM_NUMBERS = 2_000_000


def harmonic_design(doy: str, order: int) -> list[Column]:
    w = F.col(doy) * (2 * math.pi / PERIOD)
    return [F.lit(1.0)] + [f(w * k) for k in range(1, order + 1) for f in (F.cos, F.sin)]


def polynomial_design(x: str, degree: int) -> list[Column]:
    return [F.pow(F.col(x).cast("double"), F.lit(float(d))) for d in range(degree + 1)]


def summed(df: DataFrame, keys: list[str], *arrays: str) -> DataFrame:
    """(keys, arrays): sums of arrays of one length, element by element, with partial sums before the shuffle."""
    x = df.select(*keys, *(array_to_vector(c).alias(c) for c in arrays)).groupBy(*keys).agg(*(Summarizer.sum(F.col(c)).alias(c) for c in arrays))
    return x.select(*keys, *(vector_to_array(c).alias(c) for c in arrays))


def gram_parts(batches, keys: list[str], matrix, numbers: int):
    """Frames of (keys, gram) whose grams add up to those of all ``batches``; never more than ``numbers`` numbers, or those of one batch, are held."""
    acc: dict[tuple, np.ndarray] = {}
    part = lambda: pd.DataFrame([(*k, a.ravel()) for k, a in acc.items()], columns=[*keys, "gram"])
    for pdf in batches:
        for k, g in pdf.groupby(keys):
            z = matrix(g)
            acc[k] = acc.get(k, 0) + z.T @ z
        if acc and len(acc) * next(iter(acc.values())).size > numbers:
            yield part()
            acc.clear()
    yield part()


def grams(src: DataFrame, keys: list[str], schema: str, matrix) -> DataFrame:
    """(keys, gram): z'z of the rows of each key, where ``matrix(pdf)`` gives z; partitions emit a matrix a key, or several where keys are many, and only matrices are shuffled."""
    return summed(src.mapInPandas(lambda batches: gram_parts(batches, keys, matrix, GRAM_NUMBERS), f"{schema}, gram array<double>"), keys, "gram")


def beside_total(own: DataFrame, keys: list[str], *arrays: str) -> DataFrame:
    """``own`` (one row a fold) with ``total_<array>`` over all folds of its keys: a training side is the total minus its own part."""
    own = written(own, "fold-sums")
    total = summed(own, keys, *arrays).select(*keys, *(F.col(c).alias(f"total_{c}") for c in arrays))
    return own.join(total, keys) if keys else own.join(F.broadcast(total))  # one row


def seen_outside(rows: DataFrame, x: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, fold, seen): how many values of ``x`` the rows outside each fold have; with ``keys``, inside each of them."""
    keys = keys or []
    per = rows.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.min("fold").alias("low"), F.max("fold").alias("high"))
    alone = per.where("low = high").groupBy(*keys, F.col("low").alias("fold")).agg(F.count("*").alias("alone"))
    total = per.groupBy(*keys).agg(F.count("*").alias("n"))
    every = rows.select(*keys, "fold").distinct().join(alone, [*keys, "fold"], "left")
    every = every.join(total, keys) if keys else every.join(F.broadcast(total))  # one row
    return every.select(*keys, "fold", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("seen"))


def with_fold(rows: DataFrame, folds: DataFrame | None, keys: list[str]) -> DataFrame:
    return rows.where("fold is not null") if folds is None else rows.join(folds, keys)


def fit_by_fold(rows: DataFrame, folds: DataFrame | None, design: list[Column], y: str, x: str, least_distinct: int, keys: list[str], ridge: float = 0.0) -> DataFrame:
    """(fold, n_train, coef) of least squares on each fold's complement; a fold with too few distinct x has no coefficients.

    ``rows`` carry a key of ``folds`` (keys, fold), which names each row's test fold; without ``folds`` they carry ``fold`` itself, and nothing is joined. Sums of products are
    aggregated per fold once; a fold's training sums are the totals minus its own, and each fold is solved by itself.
    """
    p = len(design)
    d = with_fold(rows, folds, keys).select("fold", F.col(y).cast("double").alias("_y"), F.col(x).alias("_x"), F.array(*design).alias("_d")).where("_y is not null")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    item = lambda i: F.get("_d", F.lit(i))
    sums = [F.sum(item(i) * item(j)) for i, j in pairs] + [F.sum(item(i) * F.col("_y")) for i in range(p)] + [F.count("*").cast("double")]
    own = beside_total(d.groupBy("fold").agg(F.array(*sums).alias("s")), [], "s").join(seen_outside(d, "_x"), "fold")

    def solve(batches):
        for pdf in batches:
            out = []
            for f, mine, total, seen in zip(pdf["fold"], pdf["s"], pdf["total_s"], pdf["seen"]):
                t = np.asarray(total) - np.asarray(mine)
                a = np.zeros((p, p))
                for v, (i, j) in zip(t, pairs):
                    a[i, j] = a[j, i] = v
                coef = np.linalg.lstsq(a + ridge * np.eye(p), t[len(pairs) : -1], rcond=None)[0].tolist() if seen >= least_distinct else None
                out.append((f, round(t[-1]), coef))
            yield pd.DataFrame(out, columns=["fold", "n_train", "coef"])

    return own.select("fold", "s", "total_s", "seen").mapInPandas(solve, "fold int, n_train long, coef array<double>")


def fit_all(rows: DataFrame, design: list[Column], y: str) -> DataFrame:
    """(coef): least squares over all rows, for reports; never for a score of held-out rows."""
    p = len(design)
    src = rows.select(F.array(*design, F.col(y).cast("double")).alias("v")).where(F.col(y).isNotNull())
    x = grams(src.withColumn("k", F.lit(0)), ["k"], "k int", lambda g: np.stack(g["v"].to_list()))

    def solve(batches):
        for pdf in batches:
            g = [np.reshape(v, (p + 1, -1)) for v in pdf["gram"]]
            yield pd.DataFrame({"coef": [np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0].tolist() for m in g]})

    return x.mapInPandas(solve, "coef array<double>")


def residual_ridge(rows: DataFrame, design: list[Column], w: str, y: str, x: str, alpha: float, least_distinct: int) -> DataFrame:
    """(fold, n_train, curve, coef, intercept, sigma): for each test fold a curve and then a standardised ridge of its residuals, both from the same training rows.

    One matrix of [design, w, y] per fold holds all: the totals minus a fold's own give its curve, and the curve turns the same sums into those of the residuals,
    so no row has residuals of its own and nothing of the test fold reaches its training side. ``sigma`` is the sample deviation of the training residuals.
    ``rows``: fold, the columns of ``design``, ``w`` (array), ``y``. A fold with fewer distinct ``x`` than ``least_distinct`` outside it has no model.
    """
    p = len(design)
    src = rows.select(F.col("fold").cast("int").alias("fold"), F.col(x).alias("x"), F.concat(F.array(*design), w, F.array(F.col(y).cast("double"))).alias("v")).where("v is not null").where(F.forall("v", lambda e: e.isNotNull()))
    own = grams(src.select("fold", "v"), ["fold"], "fold int", lambda g: np.stack(g["v"].to_list()))
    both = beside_total(own, [], "gram").join(seen_outside(src, "x"), "fold")

    def solve(batches):
        for pdf in batches:
            out = []
            for f, mine, total, seen in zip(pdf["fold"], pdf["gram"], pdf["total_gram"], pdf["seen"]):
                t = np.asarray(total) - np.asarray(mine)
                size = math.isqrt(len(t))
                t = t.reshape(size, size)
                n = t[0, 0]
                if n < 2 or seen < least_distinct:
                    continue
                dd, dw, dy = t[:p, :p], t[:p, p:-1], t[:p, -1]
                curve = np.linalg.lstsq(dd, dy, rcond=None)[0]
                sw, sa = dw[0], dy[0] - dd[0] @ curve
                wa = t[p:-1, -1] - dw.T @ curve
                aa = t[-1, -1] - 2 * curve @ dy + curve @ dd @ curve
                mean, ma = sw / n, sa / n
                cov, cwa = t[p:-1, p:-1] - n * np.outer(mean, mean), wa - n * mean * ma
                sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
                sd[sd == 0] = 1
                coef = np.linalg.solve(cov / np.outer(sd, sd) + alpha * np.eye(len(sd)), cwa / sd) / sd
                sse = aa - n * ma * ma - 2 * coef @ cwa + coef @ cov @ coef
                out.append((f, round(n), curve.tolist(), coef.tolist(), float(ma - mean @ coef), math.sqrt(max(sse, 0.0) / (n - 1))))
            yield pd.DataFrame(out, columns=["fold", "n_train", "curve", "coef", "intercept", "sigma"])

    return both.select("fold", "gram", "total_gram", "seen").mapInPandas(solve, "fold int, n_train long, curve array<double>, coef array<double>, intercept double, sigma double")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def residual_predictions(rows: DataFrame, models: DataFrame, design: list[Column], w: str, y: str) -> DataFrame:
    """``rows`` (fold: the test fold of each) with ``a``, what the fold's curve leaves of ``y``, its prediction ``p`` and the model's ``sigma``."""
    x = rows.join(models, "fold")
    return x.withColumn("a", F.col(y) - dot(F.array(*design), "curve")).withColumn("p", dot(w, "coef") + F.col("intercept")).drop("curve", "coef", "intercept")


def predict(rows: DataFrame, folds: DataFrame | None, models: DataFrame, design: list[Column], keys: list[str]) -> DataFrame:
    """``rows`` of each test fold with the prediction of the model fitted without it; ``folds`` as in ``fit_by_fold``."""
    return with_fold(rows, folds, keys).join(models, "fold").withColumn("pred", F.when(F.col("coef").isNotNull(), dot(F.array(*design), "coef")))


def ridge_path(rows: DataFrame, vec: str, y: str, fold: str, alphas: list[float], by: str | None = None) -> DataFrame:
    """(fold, alpha, n_train, coef, intercept, r2): standardised ridge on each fold's complement, all alphas from one Gram.

    With ``by`` (an integer column, first in the result) each of its values is a problem of its own, with folds of its own. Each fold is solved by itself.
    """
    group = F.col(by).cast("int") if by else F.lit(0)
    src = rows.select(group.alias("by"), F.col(fold).cast("int").alias("fold"), F.col(vec).alias("v"), F.col(y).cast("double").alias("y")).where("v is not null and y is not null")

    own = grams(src, ["by", "fold"], "by int, fold int", lambda g: np.column_stack([np.ones(len(g)), np.stack(g["v"].to_list()), g["y"].to_numpy()]))

    def solve(batches):
        for pdf in batches:
            out = []
            for problem, f, mine, total in zip(pdf["by"], pdf["fold"], pdf["gram"], pdf["total_gram"]):
                size = math.isqrt(len(mine))
                mine = np.reshape(mine, (size, size))
                t = np.reshape(total, (size, size)) - mine
                n, d = t[0, 0], size - 2
                if n < 1:
                    continue
                mean, my = t[0, 1 : 1 + d] / n, t[0, -1] / n
                cov, cxy = t[1 : 1 + d, 1 : 1 + d] - n * np.outer(mean, mean), t[1 : 1 + d, -1] - n * mean * my
                sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
                sd[sd == 0] = 1
                a, b = cov / np.outer(sd, sd), cxy / sd
                w, q = np.linalg.eigh(a)
                for alpha in alphas:
                    coef = (q @ ((q.T @ b) / (np.maximum(w, 0) + alpha))) / sd
                    icpt = my - mean @ coef
                    k, sx, sy, sxx, sxy, syy = mine[0, 0], mine[0, 1 : 1 + d], mine[0, -1], mine[1 : 1 + d, 1 : 1 + d], mine[1 : 1 + d, -1], mine[-1, -1]
                    sse = syy + coef @ sxx @ coef + k * icpt**2 - 2 * coef @ sxy - 2 * icpt * sy + 2 * icpt * (sx @ coef)
                    sst = syy - sy**2 / k
                    out.append((problem, f, alpha, round(n), coef.tolist(), float(icpt), float(1 - sse / sst) if sst > 0 and k >= 8 else None))
            yield pd.DataFrame(out, columns=["by", "fold", "alpha", "n_train", "coef", "intercept", "r2"])

    out = beside_total(own, ["by"], "gram").select("by", "fold", "gram", "total_gram").mapInPandas(solve, "by int, fold int, alpha double, n_train long, coef array<double>, intercept double, r2 double")
    return out.withColumnRenamed("by", by) if by else out.drop("by")


def nested_alpha(rows: DataFrame, inner: DataFrame, vec: str, y: str, alphas: list[float]) -> DataFrame:
    """(outer, alpha, inner_r2): for each outer fold the alpha of best mean score over its inner folds; a tie goes to the stronger.

    ``inner`` (outer, cube, inner) deals only the training cubes of each outer fold, so no test row takes part in the choice.
    """
    x = rows.join(inner, "cube").select("outer", "inner", vec, y)
    x = ridge_path(x, vec, y, "inner", alphas, by="outer").groupBy("outer", "alpha").agg(F.avg("r2").alias("inner_r2"))
    return x.where("inner_r2 is not null").groupBy("outer").agg(F.max(F.struct("inner_r2", "alpha")).alias("x")).select("outer", "x.alpha", "x.inner_r2")


def best_alpha(path: DataFrame) -> DataFrame:
    """The alpha of best mean score over the folds of ``path``, to report; ``nested_alpha`` is what chooses one without looking at test rows."""
    x = path.groupBy("alpha").agg(F.avg("r2").alias("r2_mean"))
    return x.agg(F.max(F.struct("r2_mean", "alpha")).alias("x")).select("x.alpha", "x.r2_mean")


def permutation(rows: DataFrame, seed: str, keys: tuple[str, ...] = ("fold", "side")) -> DataFrame:
    """Permutation null: inside each side of each fold, every frame (keys, cube, acq_idx) gets another frame's place: ``from_cube``, ``from_acq``.

    Frames in order of their names meet frames in order of md5(name, seed, side), place by place; both orders are taken in ranges, so no side is sorted in one
    task. Frames are permuted, not cells, so the cells of a frame keep one sky (``with_sky``).
    """
    keys = list(keys)
    x = written(rows.select(*keys, "cube", "acq_idx"), "permutation-rows")
    name = F.concat_ws("|", *(F.col(k).cast("string") for k in ("cube", "acq_idx", *keys)), F.lit(seed))
    a = row_numbers(x, keys, [F.col("cube"), F.col("acq_idx")], "place", table=True)
    b = row_numbers(x.withColumn("h", F.md5(name)), keys, [F.col("h"), F.col("cube"), F.col("acq_idx")], "place", table=True)
    return a.join(b.select(*keys, "place", F.col("cube").alias("from_cube"), F.col("acq_idx").alias("from_acq")), [*keys, "place"]).drop("place")


def same_cube_share(permuted: DataFrame, keys: tuple[str, ...] = ("fold", "side")) -> DataFrame:
    """(keys, n, share): rows of each side that got a frame of their own cube; a side of one cube cannot do otherwise (1)."""
    return permuted.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("cube") == F.col("from_cube")).cast("double")).alias("share"))


def with_sky(cells: DataFrame, permuted: DataFrame, sky: DataFrame, n: int | None = None) -> DataFrame:
    """``cells`` (cube, acq_idx, ...) of each fold and side with the ``sky`` (cube, acq_idx, ...) of the frame that theirs was dealt.

    With ``n``, about how many rows that gives, cells are dealt by frame, so that tasks join and then group a bounded number by frame.
    """
    other = sky.withColumnsRenamed({"cube": "from_cube", "acq_idx": "from_acq"})
    if n is not None:
        cells = dealt(cells, ["cube", "acq_idx"], n)
    return cells.join(permuted.join(other, ["from_cube", "from_acq"]), ["cube", "acq_idx"])
