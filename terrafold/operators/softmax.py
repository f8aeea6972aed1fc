"""Multinomial logistic read-outs over a grid of strengths, tuned inside each outer fold: Newton steps of all problems in one aggregation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fit import summed
from .ranks import written

#: The row is a test row of the outer fold; as an inner fold, it names the fit on the whole outer training side.
WHOLE = -1
#: The row takes no part in the outer fold.
ABSENT = -2
#: Newton decrement after which one more step is the last: its error is of the order of the square.
DECREMENT = 1e-6


class NotConvergedError(RuntimeError):
    """A fit did not settle within the steps that it was allowed."""


def dealt(rows: DataFrame, outer: DataFrame, inner: DataFrame, vec: str, label: str, labels: list[str], n_outer: int) -> DataFrame:
    """(deal, code, vec) of ``rows`` (cube, acq_idx, vec, label): for each outer fold the row's inner fold, WHOLE on the test side, ABSENT on neither.

    ``outer``: (cube, acq_idx, fold, side); ``inner``: (outer, cube, inner). Rows with a null vector, component or label take no part.
    """
    x = rows.where(F.col(vec).isNotNull() & F.col(label).isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v)))
    x = x.select("cube", "acq_idx", F.col(vec).alias("vec"), F.col(label).cast("string").alias("label"))
    sides = outer.join(inner.withColumnRenamed("outer", "fold"), ["fold", "cube"], "left")
    place = F.when(F.col("side") == "test", WHOLE).otherwise(F.coalesce("inner", F.lit(ABSENT)))
    sides = sides.groupBy("cube", "acq_idx").agg(F.map_from_entries(F.collect_list(F.struct("fold", place.alias("p")))).alias("_m"))  # an entry a fold
    x = x.join(sides, ["cube", "acq_idx"])
    deal = F.transform(F.sequence(F.lit(0), F.lit(n_outer - 1)), lambda o: F.coalesce(F.try_element_at("_m", o), F.lit(ABSENT)))
    return written(x.select(deal.alias("deal"), (F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1).cast("int").alias("code"), "vec").where("code >= 0"), "softmax-rows")


def moments(rows: DataFrame, k: int) -> dict[tuple[int, int], np.ndarray]:
    """Per (outer, inner fold): class counts, then sums of the vectors and of their squares. One row a pair of folds comes to the driver."""

    def run(batches):
        for pdf in batches:
            deal, v = np.stack(pdf["deal"].to_list()), np.stack(pdf["vec"].to_list())
            code = np.eye(k)[pdf["code"]]
            z = np.hstack([code, v, v * v])
            for o in range(deal.shape[1]):
                for i in np.unique(deal[deal[:, o] >= 0, o]):
                    yield pd.DataFrame({"outer": [o], "inner": [int(i)], "s": [z[deal[:, o] == i].sum(0)]})

    x = summed(rows.mapInPandas(run, "outer int, inner int, s array<double>"), ["outer", "inner"], "s")
    return {(r["outer"], r["inner"]): np.asarray(r["s"]) for r in x.collect()}


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Problem:
    """One training side with its weights: scaling, the classes it has, and where its Newton path stands. It grows with classes and dimensions, not with rows."""

    def __init__(self, outer: int, inner: int, balanced: bool, sums: np.ndarray, k: int):
        self.outer, self.inner, self.balanced, self.k = outer, inner, balanced, k
        counts, n = sums[:k], sums[:k].sum()
        d = (len(sums) - k) // 2
        self.n_train, self.present = round(n), counts > 0
        self.mean = sums[k : k + d] / n
        sd = np.sqrt(np.maximum(sums[k + d :] / n - self.mean**2, 0))
        self.sd = np.where(sd < 1e-12, 1.0, sd)
        self.weight = np.where(self.present, n / (max(self.present.sum(), 1) * np.maximum(counts, 1)), 0.0) if balanced else np.ones(k)
        self.at = self.trial = np.zeros((k, d + 1))
        self.begin()

    def begin(self) -> None:
        """Start the next strength from the last solution."""
        self.trial, self.loss, self.step, self.done = self.at, math.inf, 1.0, False

    def takes(self, deal: np.ndarray) -> np.ndarray:
        mine = deal[:, self.outer]
        return (mine >= 0) & (mine != self.inner)

    def scaled(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(v), 1)), (v - self.mean) / self.sd])

    def scores(self, z: np.ndarray, model: np.ndarray) -> np.ndarray:
        return np.where(self.present, z @ model.T, -np.inf)

    def sums(self, v: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Loss, gradient and Hessian of the rows at the trial point, without penalty."""
        z, w = self.scaled(v), self.weight[code]
        s = self.scores(z, self.trial)
        p = softmax(s)
        top = s.max(1)
        loss = w @ (np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(len(code)), code])
        grad = ((p - np.eye(self.k)[code]) * w[:, None]).T @ z
        each = (p[:, :, None] * z[:, None, :]).reshape(len(z), -1)
        hess = -(each * w[:, None]).T @ each
        d = z.shape[1]
        for c in range(self.k):
            hess[c * d : c * d + d, c * d : c * d + d] += (z * (w * p[:, c])[:, None]).T @ z
        return np.concatenate([[loss], grad.ravel(), hess.ravel()])

    def direction(self, sums: np.ndarray, c: float) -> np.ndarray:
        """Penalised loss, squared Newton decrement and Newton direction at the trial point; the intercept is not penalised."""
        size = self.trial.size
        d = self.trial.shape[1]
        pen = np.ones(self.trial.shape)
        pen[:, 0] = 0
        loss = c * sums[0] + 0.5 * (pen * self.trial**2).sum()
        grad = c * sums[1 : 1 + size] + (pen * self.trial).ravel()
        hess = c * sums[1 + size :].reshape(size, size) + np.diag(pen.ravel())
        # all intercepts may rise together: fix their sum; a class that the side lacks stays at zero
        first = np.where(self.present)[0] * d
        hess[np.ix_(first, first)] += max(np.trace(hess[np.ix_(first, first)]) / max(len(first), 1), 1e-12)
        gone = np.repeat(~self.present, d)
        grad[gone] = 0
        hess[gone, :] = hess[:, gone] = 0
        hess[gone, gone] = 1
        step = -np.linalg.solve(hess, grad)
        return np.concatenate([[loss, -grad @ step], step])

    def advance(self, answer: np.ndarray) -> None:
        """Take the trial point if it is good enough, and the next trial; else go half as far."""
        loss, decrement, step = answer[0], answer[1], answer[2:].reshape(self.trial.shape)
        if math.isfinite(self.loss) and loss > self.loss - 1e-4 * self.step * self.decrement + 1e-12 * abs(loss):
            self.step /= 2
            self.trial = self.at + self.step * self.way
            return
        self.at, self.loss, self.decrement, self.way, self.step = self.trial, loss, decrement, step, 1.0
        self.trial = self.at + step
        if decrement <= DECREMENT**2:
            self.at, self.done = self.trial, True


def newton_step(rows: DataFrame, problems: list[Problem], c: float) -> None:
    """One step of all ``problems``: partitions add up their sums, the total is solved in its own task, and only directions come to the driver."""

    def run(batches):
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            deal, v, code = np.stack(pdf["deal"].to_list()), np.stack(pdf["vec"].to_list()), pdf["code"].to_numpy()
            for i, p in enumerate(problems):
                m = p.takes(deal)
                if m.any():
                    acc[i] = acc.get(i, 0) + p.sums(v[m], code[m])
        for i, s in acc.items():
            yield pd.DataFrame({"problem": [i], "s": [s]})

    def solve(batches):
        for pdf in batches:
            yield pd.DataFrame({"problem": pdf["problem"], "s": [problems[i].direction(np.asarray(s), c) for i, s in zip(pdf["problem"], pdf["s"])]})

    kind = "problem int, s array<double>"
    for r in summed(rows.mapInPandas(run, kind), ["problem"], "s").mapInPandas(solve, kind).collect():
        problems[r["problem"]].advance(np.asarray(r["s"]))


def paths(rows: DataFrame, k: int, grid: list[float], weightings: tuple[bool, ...] = (False, True), most_steps: int = 100) -> list[tuple[Problem, dict[float, np.ndarray]]]:
    """Each problem with its models (classes x (intercept, coefficients), of standardised vectors) by strength.

    ``rows`` as ``dealt`` gives them. Problems: for each outer fold the side without each inner fold, and the whole side. All take a step in one pass; the
    grid is walked upwards, each strength starting from the solution of the last. Loss: c * sum of weights * log loss + half the squared coefficients.
    """
    cells = moments(rows, k)
    problems = []
    for o in sorted({o for o, _ in cells}):
        total = sum(s for (a, _), s in cells.items() if a == o)
        sides = {WHOLE: total} | {i: total - s for (a, i), s in sorted(cells.items()) if a == o}
        problems += [Problem(o, i, b, s, k) for i, s in sides.items() for b in weightings if (s[:k] > 0.5).sum() > 1]
    found: list[dict[float, np.ndarray]] = [{} for _ in problems]
    for c in sorted(grid):
        for p in problems:
            p.begin()
        for _ in range(most_steps):
            open_ones = [p for p in problems if not p.done]
            if not open_ones:
                break
            newton_step(rows, open_ones, c)
        if any(not p.done for p in problems):
            raise NotConvergedError(f"{sum(not p.done for p in problems)} fits at C = {c} after {most_steps} steps")
        for p, f in zip(problems, found):
            f[c] = p.at
    return list(zip(problems, found))


def confusion(rows: DataFrame, fits: list[tuple[Problem, dict[float, np.ndarray]]]) -> DataFrame:
    """(balanced, outer, inner, c, label, guess, n): what each model says of the rows that it is tested on; inner WHOLE is the outer test side."""

    def run(batches):
        for pdf in batches:
            deal, v, code = np.stack(pdf["deal"].to_list()), np.stack(pdf["vec"].to_list()), pdf["code"].to_numpy()
            out = []
            for p, models in fits:
                m = deal[:, p.outer] == p.inner
                if not m.any():
                    continue
                z = p.scaled(v[m])
                for c, model in models.items():
                    pairs, n = np.unique(code[m] * p.k + p.scores(z, model).argmax(1), return_counts=True)
                    out += [(p.balanced, p.outer, p.inner, c, int(a) // p.k, int(a) % p.k, int(b)) for a, b in zip(pairs, n)]
            yield pd.DataFrame(out, columns=["balanced", "outer", "inner", "c", "label", "guess", "n"])

    x = rows.mapInPandas(run, "balanced boolean, outer int, inner int, c double, label int, guess int, n long")
    return x.groupBy("balanced", "outer", "inner", "c", "label", "guess").agg(F.sum("n").alias("n"))


def confusion_scores(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_test, balanced_accuracy, macro_f1) over the classes that the test side has."""
    hit = F.sum(F.when(F.col("label") == F.col("guess"), F.col("n")).otherwise(0)).alias("tp")
    truth = table.groupBy(*keys, "label").agg(F.sum("n").alias("n"), hit)
    said = table.groupBy(*keys, F.col("guess").alias("label")).agg(F.sum("n").alias("p"))
    f1 = 2 * F.col("tp") / (F.col("n") + F.coalesce("p", F.lit(0)))
    return truth.join(said, [*keys, "label"], "left").groupBy(*keys).agg(F.sum("n").alias("n_test"), F.avg(F.col("tp") / F.col("n")).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))


def chosen(scores: DataFrame) -> DataFrame:
    """(balanced, outer, c, inner_score): the strength of best mean balanced accuracy over an outer fold's inner folds; a tie goes to the smaller C, the stronger penalty."""
    x = scores.where(F.col("inner") != WHOLE).groupBy("balanced", "outer", "c").agg(F.round(F.avg("balanced_accuracy"), 12).alias("inner_score"))
    return x.groupBy("balanced", "outer").agg(F.max(F.struct("inner_score", (-F.col("c")).alias("_c"))).alias("_x")).select("balanced", "outer", (-F.col("_x._c")).alias("c"), "_x.inner_score")


def tuned(rows: DataFrame, outer: DataFrame, inner: DataFrame, vec: str, label: str, grid: list[float], weightings: tuple[bool, ...] = (False, True)) -> DataFrame:
    """(balanced, outer, c, inner_score, at_edge, n_train, n_test, balanced_accuracy, macro_f1): logistic read-outs with C chosen on inner folds.

    Labels are compared as text. An outer fold whose training side has fewer than two classes has no row, as has an empty table.
    """
    labels = [r["l"] for r in rows.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("l")).distinct().orderBy("l").collect()]  # classes
    n_outer = (outer.agg(F.max("fold").alias("m")).first()["m"] or 0) + 1
    kind = "balanced boolean, outer int, n_train long"
    x = dealt(rows, outer, inner, vec, label, labels, n_outer) if labels else None
    fits = paths(x, len(labels), grid, weightings) if labels else []
    sizes = rows.sparkSession.createDataFrame([(p.balanced, p.outer, p.n_train) for p, _ in fits if p.inner == WHOLE], kind)
    if not fits:
        return sizes.select("balanced", "outer", F.lit(0.0).alias("c"), F.lit(0.0).alias("inner_score"), F.lit(False).alias("at_edge"), "n_train", F.lit(0).cast("long").alias("n_test"), F.lit(0.0).alias("balanced_accuracy"), F.lit(0.0).alias("macro_f1"))
    scores = written(confusion_scores(confusion(x, fits), ["balanced", "outer", "inner", "c"]), "softmax-scores")
    best = chosen(scores).withColumn("at_edge", F.col("c").isin(min(grid), max(grid)))
    out = scores.where(F.col("inner") == WHOLE).drop("inner").join(best, ["balanced", "outer", "c"]).join(sizes, ["balanced", "outer"])
    return out.select("balanced", "outer", "c", "inner_score", "at_edge", "n_train", "n_test", "balanced_accuracy", "macro_f1")
