"""Classifiers, boosted trees, principal components and the Gaussian score: read-outs beside the plain ridge path."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fit import grams, summed
from .ranks import percentiles_by, written


#: Cells of binned features that one task boosts.
CELLS = 1_000_000


def crps_of(e: Column, sigma: Column) -> Column:
    """Closed-form CRPS of a Gaussian whose mean misses by ``e``; null without a positive sigma."""

    @F.pandas_udf("double")
    def crps(e: pd.Series, sigma: pd.Series) -> pd.Series:
        z = (e / sigma.where(sigma > 0)).to_numpy()
        cdf = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
        return sigma * (z * (2 * cdf - 1) + 2 * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))

    return crps(e, sigma)


def gaussian_crps(df: DataFrame, y: str, pred: str, fold: str) -> DataFrame:
    """Closed-form CRPS of a Gaussian around ``pred``; sigma is the sample deviation of the other folds' residuals.

    Sigma comes from sums per fold, totals minus own. Null where the other folds hold under two rows or no spread.
    """

    e = F.col(y).cast("double") - F.col(pred)
    own = df.groupBy(fold).agg(F.count(e).alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("q"))
    w = Window.partitionBy(F.lit(0))  # one row a fold
    n, s, q = (F.sum(c).over(w) - F.col(c) for c in ("n", "s", "q"))
    sigma = own.select(fold, F.when(n > 1, F.sqrt(F.greatest((q - s * s / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))).alias("sigma"))
    return df.join(sigma, fold).withColumn("crps", crps_of(e, F.col("sigma")))


def ridge_classifier(rows: DataFrame, vec: str, label: str, fold: str, alpha: float = 1.0, balanced: bool = False) -> DataFrame:
    """(fold, models: array of label, coef, intercept): one-vs-rest ridge on -1/+1 targets, fitted on each fold's complement.

    Partitions emit one Gram matrix per (fold, class); weights n / (K * n_c), targets and standardisation all
    follow from them, so no row is read twice.
    """
    src = rows.select(F.col(fold).cast("int").alias("fold"), F.col(label).cast("string").alias("label"), F.col(vec).alias("v")).where("v is not null and label is not null")

    own = written(grams(src, ["fold", "label"], "fold int, label string", lambda g: np.column_stack([np.ones(len(g)), np.stack(g["v"].to_list())])), "classes")
    # for each fold and class the total and the fold's own part; a task holds one fold's classes
    total = summed(own, ["label"], "gram").withColumnRenamed("gram", "total").join(F.broadcast(own.select("fold").distinct()))  # a number a fold
    parts = total.join(own, ["fold", "label"], "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["fold"].iloc[0])
        size = math.isqrt(len(pdf["total"].iloc[0]))
        left = {c: np.reshape(t, (size, size)) - (0 if g is None else np.reshape(g, (size, size))) for c, t, g in sorted(zip(pdf["label"], pdf["total"], pdf["gram"]), key=lambda x: x[0])}
        left = {c: a for c, a in left.items() if a[0, 0] > 0.5}
        if len(left) < 2:
            return pd.DataFrame([(f, None)], columns=["fold", "models"])
        plain = sum(left.values())
        n, mean = plain[0, 0], plain[0, 1:] / plain[0, 0]
        sd = np.sqrt(np.maximum(np.diag(plain)[1:] / n - mean**2, 0))
        sd[sd < 1e-12] = 1
        weight = {c: n / (len(left) * a[0, 0]) if balanced else 1.0 for c, a in left.items()}
        gram = sum(weight[c] * a for c, a in left.items())
        m, centre = gram[0, 0], gram[0, 1:] / gram[0, 0]
        cov = (gram[1:, 1:] - m * np.outer(centre, centre)) / np.outer(sd, sd) + alpha * np.eye(size - 1)
        models = []
        for c in left:
            sign = {k: 1.0 if k == c else -1.0 for k in left}
            zy = sum(weight[k] * sign[k] * a[0] for k, a in left.items())
            my = zy[0] / m
            coef = np.linalg.solve(cov, (zy[1:] - m * centre * my) / sd) / sd
            models.append((c, coef.tolist(), float(my - centre @ coef)))
        return pd.DataFrame([(f, models)], columns=["fold", "models"])

    kind = "array<struct<label:string,coef:array<double>,intercept:double>>"
    return parts.groupBy("fold").applyInPandas(solve, f"fold int, models {kind}")


def classified(rows: DataFrame, models: DataFrame, vec: str, fold: str) -> DataFrame:
    """``rows`` with ``guess``: the class of the highest score (ties: the greatest label) of the model fitted without the row's fold."""

    def score(m):
        return F.aggregate(F.zip_with(F.col(vec), m["coef"], lambda a, b: a * b), m["intercept"], lambda s, v: s + v)

    best = F.array_max(F.transform("models", lambda m: F.struct(score(m).alias("s"), m["label"].alias("label"))))
    return rows.join(models.withColumnRenamed("fold", fold), fold).withColumn("guess", best["label"]).drop("models")


def logistic_by_fold(rows: DataFrame, vec: str, label: str, folds: list[int], fold: str, c: float = 1.0, balanced: bool = False) -> DataFrame:
    """``rows`` of each fold with the multinomial logistic ``guess`` fitted on the other folds (regParam 1 / (c * n))."""
    x = rows.withColumn("_x", array_to_vector(vec)).withColumn("_y", F.col(label).cast("double"))
    out = None
    for f in folds:
        train = x.where(F.col(fold) != f)
        per = train.groupBy("_y").agg(F.count("*").alias("_c"))
        n, k = per.agg(F.sum("_c"), F.count("*")).first()
        if balanced:
            train = train.join(per.select("_y", (n / (k * F.col("_c"))).alias("_w")), "_y")
        fit = LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", regParam=1 / (c * n), family="multinomial", standardization=True, maxIter=100)
        model = (fit.setWeightCol("_w") if balanced else fit).fit(train)
        part = model.transform(x.where(F.col(fold) == f)).select(*rows.columns, F.col("_p").cast(rows.schema[label].dataType).alias("guess"))
        out = part if out is None else out.unionByName(part)
    return out


def grown(bins: np.ndarray, n: np.ndarray, s: np.ndarray, width: int, depth: int, least: int) -> np.ndarray:
    """A regression tree as rows (feature or -1, last bin on the left, mean) of a heap, node i above 2i + 1 and 2i + 2; ``bins``: a row a cell, which holds ``n`` rows with the sum ``s`` of their targets.

    Level by level, the split that lowers the squared error most among those that leave ``least`` rows on both sides.
    """
    tree = np.full((2 ** (depth + 1) - 1, 3), -1.0)
    at = np.zeros(len(bins), int)
    for level in range(depth + 1):
        first, many = 2**level - 1, 2**level
        here = np.flatnonzero(at >= first)
        if not len(here):
            break
        node = at[here] - first
        cn, cs = (np.bincount(node, v[here], many) for v in (n, s))
        tree[first : first + many, 2] = cs / np.maximum(cn, 1)
        if level == depth:
            break
        best, split = np.zeros(many), np.full((many, 2), -1.0)
        for f in range(bins.shape[1]):
            ln, ls = (np.bincount(node * width + bins[here, f], v[here], many * width).reshape(many, width).cumsum(axis=1) for v in (n, s))
            rn, rs = cn[:, None] - ln, cs[:, None] - ls
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((ln >= max(least, 1)) & (rn >= max(least, 1)), ls**2 / ln + rs**2 / rn - (cs**2 / np.maximum(cn, 1))[:, None], 0.0)
            top = gain.argmax(axis=1)
            better = gain[np.arange(many), top] > best
            best[better], split[better] = gain[better, top[better]], np.column_stack([np.full(better.sum(), f), top[better]])
        tree[first : first + many, :2] = split
        f, last = split[node].T.astype(int)
        at[here] = np.where(f < 0, -1, 2 * at[here] + 1 + (bins[here, f] > last))
    return tree


def tree_values(tree: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
    at = np.zeros(len(bins), int)
    for _ in range(depth):
        f = tree[at, 0].astype(int)
        at = np.where(f < 0, at, 2 * at + 1 + (bins[np.arange(len(bins)), f] > tree[at, 1]))
    return tree[at, 2]


def boosted(bins: np.ndarray, n: np.ndarray, s: np.ndarray, width: int, rounds: int, step: float, depth: int, least: int) -> np.ndarray:
    """``rounds`` trees, weights in their means: the first of the target, each other of twice the residual (as MLlib has it) by ``step``. All rows of a cell have one prediction, so sums by cell are all that a round needs."""
    pred, out = np.zeros(len(n)), []
    for i in range(rounds):
        tree = grown(bins, n, s if i == 0 else 2 * (s - n * pred), width, depth, least)
        tree[:, 2] *= step if i else 1.0
        pred += tree_values(tree, bins, depth)
        out.append(tree)
    return np.stack(out)


def edges(train: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """For each feature the upper ends of all bins but the last: between neighbours where it has few values, else quantiles of all rows."""
    out, many = [], train.approxQuantile(features, [k / bins for k in range(1, bins)], 1e-4)
    for f, q in zip(features, many):
        few = sorted(r[0] for r in train.select(f).distinct().limit(bins + 1).collect())
        out.append(sorted(set(q)) if len(few) > bins else [(a + b) / 2 for a, b in zip(few[:-1], few[1:])])
    return out


def boosted_by_fold(rows: DataFrame, features: list[str], y: str, folds: list[int], fold: str, rounds: int = 200, step: float = 0.1, least_leaf: int = 20, seed: int = 0, depth: int = 5, bins: int = 32) -> DataFrame:
    """``rows`` of each fold with the boosted-tree prediction ``pred`` fitted on the other folds; ``rows`` become a table first, since each fit reads them several times.

    Trees split only between bins, so rows of the same bins are one cell, and a fold's rounds need no more than the sums of its cells: one aggregation a fold, then all rounds in one task.
    Where features are so many that cells exceed ``CELLS``, MLlib reads the rows again in each round. Null or missing numbers are errors.
    """
    table = written(rows, "boosted")
    there = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null {c}")).cast("double")).otherwise(F.col(c).cast("double")).alias(c)
    x = table.select(F.col(fold).alias("_f"), there(y).alias("_y"), *map(there, features))
    cut = {f: edges(x.where(F.col("_f") != f), features, bins) for f in folds}
    codes = lambda f, of: [sum((F.when(of(c) > e, 1).otherwise(0) for e in ends), F.lit(0)).cast("int") for c, ends in zip(features, cut[f])]
    names = [f"b{i}" for i in range(len(features))]
    cells = None
    for f in folds:
        own = x.where(F.col("_f") != f).select(F.lit(f).alias("fold"), "_y", *(c.alias(b) for b, c in zip(names, codes(f, F.col))))
        own = own.groupBy("fold", *names).agg(F.count("*").cast("double").alias("n"), F.sum("_y").alias("s"))
        cells = own if cells is None else cells.unionByName(own)
    cells = written(cells, "boosted-cells")
    if (cells.groupBy("fold").count().agg(F.max("count")).first()[0] or 0) > CELLS:
        x = table.withColumn("_x", array_to_vector(F.array(*(F.col(c).cast("double") for c in features))))
        model = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="pred", maxIter=rounds, stepSize=step, minInstancesPerNode=least_leaf, maxDepth=depth, maxBins=bins, seed=seed)
        parts = [model.fit(x.where(F.col(fold) != f)).transform(x.where(F.col(fold) == f)).select(*rows.columns, "pred") for f in folds]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names)
        trees = boosted(pdf[names].to_numpy(int), pdf["n"].to_numpy(), pdf["s"].to_numpy(), bins, rounds, step, depth, least_leaf)
        return pd.DataFrame({"fold": pdf["fold"].iloc[:1], "trees": [trees.ravel()]})

    models = cells.groupBy("fold").applyInPandas(fit, "fold int, trees array<double>").collect()  # 63 nodes a tree
    models = {r["fold"]: np.reshape(r["trees"], (rounds, -1, 3)) for r in models}

    @F.pandas_udf("double")
    def predicted(f: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(f), np.nan)
        for k, trees in models.items():
            at = np.flatnonzero(f.to_numpy() == k)
            if len(at):
                cell, back = np.unique(np.stack(b.iloc[at].to_list()), axis=0, return_inverse=True)
                out[at] = sum(tree_values(t, cell, depth) for t in trees)[back.ravel()]
        return pd.Series(out)

    out = table.where(F.col(fold).isin(folds))
    code = F.lit(None).cast("array<int>")
    for f in folds:
        code = F.when(F.col(fold) == f, F.array(*codes(f, lambda c: F.col(c).cast("double")))).otherwise(code)
    return out.withColumn("pred", F.nanvl(predicted(F.col(fold).cast("int"), code), F.lit(None).cast("double")))


def pca_scores(rows: DataFrame, vec: str, k: int = 2) -> DataFrame:
    """``rows`` with ``scores`` (standardised, projected on k components, divided by sqrt(D)), ``explained`` and ``radius``.

    ``explained`` holds each component's share of the variance; ``radius`` is the 99th percentile of the scores' length. A component's sign is free.
    """
    x = rows.withColumn("_x", array_to_vector(vec))
    x = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(x).transform(x)
    model = PCA(k=k, inputCol="_z", outputCol="_s").fit(x)
    x = model.transform(x).withColumn("scores", F.transform(vector_to_array("_s"), lambda v: v / math.sqrt(model.pc.numRows)))
    length = F.sqrt(F.aggregate("scores", F.lit(0.0), lambda s, v: s + v * v))
    radius = percentiles_by(x.select(length.alias("r")), [], "r", {"radius": 0.99})
    explained = F.array(*(F.lit(float(v)) for v in model.explainedVariance))
    return x.drop("_x", "_z", "_s").withColumn("explained", explained).crossJoin(F.broadcast(radius))
