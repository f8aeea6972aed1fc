"""The appearance table: one-vs-rest ridge read-outs of many configurations from one matrix a class and fold, tuned on inner folds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fit import summed
from .jobs import TEST
from .ranks import written

#: Numbers of models (their coefficients) that may be broadcast to the rows; beyond, both are shuffled by fold.
BROADCAST = 4_000_000
#: Rows that are scored at once by all models of a side.
SCORED = 1_024


def one_vs_rest(sides: dict[str, np.ndarray], features: list[int], alphas: list[float], balanced: bool) -> list[list[tuple[str, list[float], float]]]:
    """For each of ``alphas`` the (label, coefficients, intercept) of every class: standardised ridge on +1 and -1, from the sums of products of [1, vec] of each class."""
    at = [0, *(1 + i for i in features)]
    sides = {c: a[np.ix_(at, at)] for c, a in sides.items() if a[0, 0] > 0.5}
    if len(sides) < 2:
        return []
    plain = sum(sides.values())
    n, mean = plain[0, 0], plain[0, 1:] / plain[0, 0]
    sd = np.sqrt(np.maximum(np.diag(plain)[1:] / n - mean**2, 0))
    sd[sd < 1e-12] = 1
    weight = {c: n / (len(sides) * a[0, 0]) if balanced else 1.0 for c, a in sides.items()}
    gram = sum(weight[c] * a for c, a in sides.items())
    m, centre = gram[0, 0], gram[0, 1:] / gram[0, 0]
    values, vectors = np.linalg.eigh((gram[1:, 1:] - m * np.outer(centre, centre)) / np.outer(sd, sd))
    targets = {}
    for c, a in sides.items():
        zy = 2 * weight[c] * a[0] - gram[0]
        my = zy[0] / m
        targets[c] = my, vectors.T @ ((zy[1:] - m * centre * my) / sd)
    out = []
    for alpha in alphas:
        found = []
        for c, (my, turned) in targets.items():
            coef = (vectors @ (turned / (np.maximum(values, 0) + alpha))) / sd
            found.append((c, coef.tolist(), float(my - centre @ coef)))
        out.append(found)
    return out


def models(cells: DataFrame, keys: list[str], sets: dict[str, list[int]], alphas: list[float]) -> DataFrame:
    """(keys, outer, inner, feature_set, weights, alpha, n_train, majority, classes): every model of ``cells`` (keys, outer, inner, label, gram); inner is the side that it is scored on.

    A task holds the matrices of one outer fold: classes times inner folds of them. A side whose training rows have fewer than two classes has no model.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        size = math.isqrt(len(pdf["gram"].iloc[0]))
        parts: dict[int, dict[str, np.ndarray]] = {}
        for i, label, g in zip(pdf["inner"], pdf["label"], pdf["gram"]):
            parts.setdefault(int(i), {})[label] = np.reshape(g, (size, size))
        head, out = [pdf[k].iloc[0] for k in [*keys, "outer"]], []
        for scored in parts:
            train: dict[str, np.ndarray] = {}
            for i, own in parts.items():
                if i not in (TEST, scored):
                    for label, g in own.items():
                        train[label] = train.get(label, 0) + g
            train = dict(sorted(train.items()))
            counts = {c: round(a[0, 0]) for c, a in train.items()}
            most = max(counts, key=lambda c: (counts[c], c), default=None)
            for name, features in sets.items():
                for weights in ("none", "balanced"):
                    for alpha, found in zip(alphas, one_vs_rest(train, features, alphas, weights == "balanced")):
                        out.append((*head, scored, name, weights, alpha, sum(counts.values()), most, [(c, [0.0 if i not in features else coef[features.index(i)] for i in range(size - 1)], b) for c, coef, b in found]))
        return pd.DataFrame(out, columns=[*keys, "outer", *"inner feature_set weights alpha n_train majority classes".split()])

    kind = ", ".join([*(f"{k} string" for k in keys), "outer int, inner int, feature_set string, weights string, alpha double, n_train long, majority string, classes array<struct<label:string,coef:array<double>,intercept:double>>"])
    return cells.groupBy(*keys, "outer").applyInPandas(solve, kind)


def kind_of(keys: list[str]) -> list[tuple[str, pa.DataType]]:
    return [*((k, pa.string()) for k in keys), ("outer", pa.int32()), ("inner", pa.int32()), ("label", pa.string())]


def dealt(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """((keys, outer, inner, label), vectors) of each batch: a row stands in every place that its cube was dealt, without a copy of it in Spark."""
    for b in batches:
        if not b.num_rows:
            continue
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b["outer"]).to_numpy())
        v = pc.list_flatten(b["v"]).to_numpy(zero_copy_only=False).reshape(b.num_rows, size)
        values, code = [], np.zeros(len(row), "int64")
        for c in [*keys, "label"]:
            d = pc.dictionary_encode(b[c])
            values.append(d.dictionary.to_pylist())
            code = code * len(values[-1]) + d.indices.to_numpy()[row]
        for c in ("outer", "inner"):
            u, i = np.unique(pc.list_flatten(b[c]).to_numpy(), return_inverse=True)
            values.append(u.tolist())
            code = code * len(u) + i
        order = np.argsort(code, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(code[order]) != 0)) if len(order) else []
        for at in np.split(order, heads[1:]) if len(order) else []:
            name, rest = [], code[at[0]]
            for u in reversed(values):
                name.append(u[rest % len(u)])
                rest //= len(u)
            inner, outer, label, *k = name
            yield (*reversed(k), outer, inner, label), v[row[at]]


def table(rows: list[tuple], kind: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kind)], [n for n, _ in kind])


def class_grams(batches, keys: list[str], size: int, kind: list) -> Iterator[pa.RecordBatch]:
    """(keys, outer, inner, label, gram): sums of products of [1, vec] of a partition's rows in each place."""
    acc: dict[tuple, np.ndarray] = {}
    for name, v in dealt(batches, keys, size):
        z = np.column_stack([np.ones(len(v)), v])
        acc[name] = acc.get(name, 0) + z.T @ z
    yield from table([(*k, a.ravel()) for k, a in acc.items()], [*kind, ("gram", pa.list_(pa.float64()))])


def sides_of(found: list, keys: list[str]) -> dict[tuple, tuple[list[tuple], list[str], np.ndarray, np.ndarray]]:
    """(keys, outer, inner) -> (configurations, classes, coefficients, intercepts) of ``models``: all models of a side know the same classes."""
    out: dict[tuple, list] = {}
    for r in found:
        out.setdefault((*(r[k] for k in keys), r["outer"], r["inner"]), []).append(r)
    config = ["feature_set", "weights", "alpha", "n_train", "majority"]
    return {
        k: ([tuple(r[c] for c in config) for r in of], [c["label"] for c in of[0]["classes"]], np.array([[c["coef"] for c in r["classes"]] for r in of]), np.array([[c["intercept"] for c in r["classes"]] for r in of]))
        for k, of in out.items()
    }


def guess_counts(batches, keys: list[str], size: int, known: dict, kind: list) -> Iterator[pa.RecordBatch]:
    """(keys, outer, inner, label, configuration, guess, _n): the class of greatest score (ties: the greatest label) by every model that did not see a row's side, counted."""
    acc: dict[tuple, np.ndarray] = {}
    for name, v in dealt(batches, keys, size):
        if name[:-1] not in known:
            continue
        configs, classes, coef, intercept = known[name[:-1]]
        for i in range(0, len(v), SCORED):
            s = np.broadcast_to(intercept, (len(v[i : i + SCORED]), *intercept.shape))
            for j in range(size):
                s = s + v[i : i + SCORED, j, None, None] * coef[None, :, :, j]
            best = len(classes) - 1 - np.argmax(s[:, :, ::-1], axis=2)
            n = np.bincount((best + np.arange(len(configs)) * len(classes)).ravel(), minlength=len(configs) * len(classes))
            acc[name] = acc.get(name, 0) + n
    out = []
    for name, n in acc.items():
        configs, classes, *_ = known[name[:-1]]
        out += [(*name, *configs[i // len(classes)], classes[i % len(classes)], n[i]) for i in np.flatnonzero(n)]
    yield from table(out, [*kind, ("feature_set", pa.string()), ("weights", pa.string()), ("alpha", pa.float64()), ("n_train", pa.int64()), ("majority", pa.string()), ("guess", pa.string()), ("_n", pa.int64())])


def appearance(rows: DataFrame, deal: DataFrame, keys: list[str], vec: str, size: int, label: str, sets: dict[str, list[int]], alphas: list[float]) -> DataFrame:
    """(keys, outer, feature_set, weights, alpha, at_edge, inner_score, n_train, n_test, balanced_accuracy, macro_f1, dummy): tuned one-vs-rest ridges of all configurations.

    ``rows``: keys (text), cube, ``vec`` (``size`` numbers), ``label`` (text); ``deal``: keys without those of the target, cube, outer, inner. One matrix a class,
    outer and inner fold holds all feature sets, strengths and both weightings; then each row is scored by the models that did not see its side, all at once in an
    Arrow batch, and only counts of (class, guess) are shuffled. Among strengths of equal mean inner balanced accuracy the strongest is taken; outer test rows take no part in it. ``dummy``
    is the balanced accuracy of guessing the training side's commonest class (ties: the greatest), 1 / classes where it occurs. A row with a null label or a null
    or non-finite number takes no part; a fold without rows on either side, or of one class, has no result.
    """
    names = [*keys, "outer", "inner"]
    x = rows.select(*(F.col(k).cast("string").alias(k) for k in keys), "cube", F.col(label).cast("string").alias("label"), F.col(vec).alias("v")).dropna(subset=keys)
    x = x.where("label is not null and v is not null").where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    by = [k for k in deal.columns if k in keys] + ["cube"]
    places = deal.groupBy(*by).agg(F.collect_list(F.struct(F.col("outer").cast("int").alias("outer"), F.col("inner").cast("int").alias("inner"))).alias("places"))  # one an outer fold
    x = x.join(places, by).select(*keys, "label", "v", F.col("places.outer").alias("outer"), F.col("places.inner").alias("inner"))
    kind = ", ".join([*(f"{k} string" for k in keys), "outer int, inner int, label string"])
    cells = summed(x.mapInArrow(lambda batches: class_grams(batches, keys, size, kind_of(keys)), kind + ", gram array<double>"), [*names, "label"], "gram")
    m = written(models(cells, keys, sets, alphas), "appearance-models")
    numbers = m.agg(F.sum(F.size("classes") * (size + 1))).first()[0] or 0
    config = ["feature_set", "weights", "alpha", "n_train", "majority"]
    if numbers <= BROADCAST:
        known = sides_of(m.collect(), keys)
        y = x.mapInArrow(lambda batches: guess_counts(batches, keys, size, known, kind_of(keys)), kind + ", feature_set string, weights string, alpha double, n_train long, majority string, guess string, _n long")
        y = y.groupBy(*names, *config, "label", "guess").agg(F.sum("_n").alias("_n"))
    else:
        y = x.select(*keys, "label", "v", F.explode(F.arrays_zip("outer", "inner")).alias("p")).select(*keys, "label", "v", "p.*").join(m, names)
        s = lambda c: F.aggregate(F.zip_with("v", c["coef"], lambda a, b: a * b), c["intercept"], lambda t, e: t + e)
        guess = F.array_max(F.transform("classes", lambda c: F.struct(s(c).alias("s"), c["label"].alias("l"))))["l"]
        y = y.select(*names, *config, "label", guess.alias("guess")).groupBy(*names, *config, "label", "guess").agg(F.count("*").alias("_n"))
    y = written(y, "appearance-counts")
    every = [*names, *config]
    per = y.groupBy(*every, "label").agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("label") == F.col("guess"), F.col("_n")).otherwise(0)).alias("tp"))
    guessed = y.groupBy(*every, F.col("guess").alias("label")).agg(F.sum("_n").alias("p"))
    f1 = 2 * F.col("tp") / (F.col("n") + F.coalesce("p", F.lit(0)))
    hit = F.max((F.col("label") == F.col("majority")).cast("int")) / F.count("*")
    got = per.join(guessed, [*every, "label"], "left").groupBy(*every).agg(F.avg(F.col("tp") / F.col("n")).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"), F.sum("n").alias("n_test"), hit.alias("dummy"))
    one = [*keys, "outer", "feature_set", "weights"]
    inner = got.where(F.col("inner") != TEST).groupBy(*one, "alpha").agg(F.round(F.avg("balanced_accuracy"), 12).alias("inner_score"))
    best = inner.groupBy(*one).agg(F.max(F.struct("inner_score", "alpha")).alias("b")).select(*one, "b.alpha", "b.inner_score")
    out = got.where(F.col("inner") == TEST).join(best, [*one, "alpha"])
    return out.select(*one, "alpha", F.col("alpha").isin(min(alphas), max(alphas)).alias("at_edge"), "inner_score", "n_train", "n_test", "balanced_accuracy", "macro_f1", "dummy")
