"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are its byte 2-, 3- and 4-grams inside words (letters only, A-Z folded). Each is
hashed to a bucket with an embedding; the mean embedding goes through a linear softmax. Training is
minibatch stochastic gradient descent in numpy on a bounded sample of labelled rows: ``per_label`` rows
a label, whole texts. Tasks turn the sampled texts into counts of buckets, so the driver gets at most
``2 ** bits`` numbers a sampled row, whatever its length. Whole texts are scored;
since mean and softmax layer are linear, workers get one table of bucket-by-label scores
(``2 ** bits * labels`` floats, a bound that does not grow with the data). Only texts go to Python workers.

The sample is the rows of least hash of each label. Since hashes spread evenly, the rows below a label's share of the hash range are
nearly always enough, and only those are ranked; a label for which they are too few is ranked whole.

Rejection is calibrated on sampled rows kept out of training: a temperature is fitted, and the
threshold is the ``keep`` quantile of their scores, so nearly all clean texts pass.

Edge cases: a text of one letter has no subword and goes by the bias alone; a null text or one without any letter is ``und`` with score 0 and rejected; an empty text
likewise; without any labelled row every document is ``und``; repeated rows and ties predict alike
(ties between labels go to the first in order); extra columns are kept by ``keep_known``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, rounds, text_bytes, trimmed


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    table: np.ndarray  # [2 ** bits, labels], already divided by the temperature
    bias: np.ndarray
    threshold: float


_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, and the text that each belongs to; n-grams never cross a text's end."""
    piece, at = _FOLD[data[at[0] : at[-1]]], at - at[0]
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    x, gap = piece.astype(np.uint32), piece == 32
    buckets, owners = [], []
    code = x.copy()
    for n in (2, 3, 4):
        if len(x) < n:
            break
        code = code[:-1] * np.uint32(257) + x[n - 1 :] + np.uint32(n)
        ok = owner[: len(code)] == owner[n - 1 :]
        inner = np.zeros(len(code), bool)
        for i in range(1, n - 1):
            inner |= gap[i : i + len(code)]
        ok &= ~inner & ~(gap[: len(code)] & gap[n - 1 :])
        h = code[ok] * np.uint32(2654435761)
        buckets.append((h >> np.uint32(32 - bits)).astype(np.int32))
        owners.append(owner[: len(code)][ok])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def has_letter(texts: Column) -> Column:
    return F.coalesce(texts.rlike(r"\p{L}"), F.lit(False))


def bags(column: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text, and how often each occurs."""
    data, at = text_bytes(column)
    out = []
    for lo, hi in rounds(at):
        b, owner = subwords(data, at[lo : hi + 1], bits)
        key, count = np.unique(owner.astype(np.int64) << bits | b, return_counts=True)
        cut = np.searchsorted(key >> bits, np.arange(hi - lo + 1))
        b = (key & (1 << bits) - 1).astype(np.int32)
        out += [(b[i:j], count[i:j].astype(np.int32)) for i, j in zip(cut[:-1], cut[1:])]
    return out


def train(found: list[tuple[np.ndarray, np.ndarray]], labels: list[str], bits: int = 16, dim: int = 16, epochs: int = 4, steps: int = 400, batch: int = 32, rate: float = 0.5, keep: float = 0.001, seed: int = 3) -> Model | None:
    """Fit on four fifths of the sample (``bags`` of its texts), calibrate on the rest."""
    names = tuple(sorted(set(labels)))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([names.index(v) for v in labels])
    order = rng.permutation(len(found))
    held = order[: len(order) // 5] if len(order) >= 20 else order
    fit = order[len(order) // 5 :] if len(order) >= 20 else order
    emb, out, bias = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32), np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    buckets, counts = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in ([b for b, _ in found], [c for _, c in found]))
    sizes = np.array([len(b) for b, _ in found])
    # each bucket's share of its text
    weight = (counts / np.repeat([max(1, c.sum()) for _, c in found], sizes)).astype(np.float32)
    begin = np.cumsum(sizes) - sizes

    def logits(rows):
        at = np.repeat(begin[rows] - (np.cumsum(sizes[rows]) - sizes[rows]), sizes[rows]) + np.arange(sizes[rows].sum())
        idx, w, who = buckets[at], weight[at], np.repeat(np.arange(len(rows)), sizes[rows])
        mean = np.zeros((len(rows), dim), np.float32)
        full = np.flatnonzero(sizes[rows])
        if len(full):
            mean[full] = np.add.reduceat(emb[idx] * w[:, None], (np.cumsum(sizes[rows]) - sizes[rows])[full])
        return idx, w, who, mean, mean @ out + bias

    epochs = max(epochs, steps * batch // max(1, len(fit)))  # a small sample is gone through more often
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        fit = rng.permutation(fit)
        for lo in range(0, len(fit), batch):
            rows = fit[lo : lo + batch]
            idx, w, who, mean, z = logits(rows)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            back = p @ out.T
            out -= step * (mean.T @ p) / len(rows)
            bias -= step * p.mean(0)
            order = np.argsort(idx, kind="stable")
            first = np.flatnonzero(np.diff(idx[order], prepend=-1)) if len(idx) else order
            if len(first):
                # averaging makes a subword's gradient tiny; its rate is raised by as much as a short text has subwords
                emb[idx[order][first]] -= step * 20 * np.add.reduceat(back[who[order]] * w[order][:, None], first)
    z = logits(held)[4].astype(np.float64)

    def loss(t):
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(held)), y[held]]))

    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    s = z / heat
    p = np.exp(s - s.max(1, keepdims=True))
    p = (p / p.sum(1, keepdims=True)).max(1)
    chance = 1.0 / len(names)
    threshold = float(min(np.quantile(p, keep), chance + 0.5 * (1 - chance))) * 0.9
    return Model(names, (emb @ out / heat).astype(np.float32), (bias / heat).astype(np.float32), threshold)


def labelled(docs: DataFrame) -> DataFrame:
    """(lang, text, k): rows to learn from, with a hash of text and id."""
    text = F.col("text").cast("string")
    return docs.where(F.col("lang").isNotNull() & has_letter(text)).select(F.col("lang").cast("string").alias("lang"), text.alias("text"), F.xxhash64(text, "doc_id").alias("k"))


def least(rows: DataFrame, limits: dict[str, int], per_label: int) -> DataFrame:
    """(lang, text): of each label in ``limits`` the rows of least hash up to its limit, at most ``per_label``."""
    if not limits:
        return rows.select("lang", "text").limit(0)
    below = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col("lang")]
    w = Window.partitionBy("lang").orderBy("k", "text")
    return rows.where(F.col("k") <= below).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_label).select("lang", "text")


def fit(docs: DataFrame, per_label: int = 600, bits: int = 16) -> Model | None:
    bounded_batches(docs.sparkSession)
    rows = labelled(docs)
    # one row a label, as the model has one column a label
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    top = 2**63 - 1

    def run(batches):
        for batch in batches:
            found = bags(batch.column(1), bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int32()))], names=["lang", "buckets", "counts"])

    def sampled(limits):
        x = least(rows, limits, per_label).mapInArrow(trimmed(run), "lang string, buckets array<int>, counts array<int>").toArrow().combine_chunks()
        lists = []
        for c in ("buckets", "counts"):
            for column in x.column(c).chunks:
                # views of Arrow's numbers; Python objects would take ten times as much of the driver
                numbers, at = column.values.to_numpy(), column.offsets.to_numpy()
                lists.append([numbers[i:j] for i, j in zip(at[:-1], at[1:])])
        return list(zip(x.column("lang").to_pylist(), *lists))

    # the share of the hash range that holds twice as many rows of the label as wanted
    found = sampled({lang: min(top, -(2**63) + 2**64 * 2 * per_label // m) for lang, m in n.items()})
    got = Counter(lang for lang, *_ in found)
    few = {lang for lang, m in n.items() if got[lang] < min(per_label, m)}
    if few:
        found = [x for x in found if x[0] not in few] + sampled(dict.fromkeys(few, top))
    # by label, then numbers: their bytes, the highest first, are in the order of the numbers
    found.sort(key=lambda x: (x[0], x[1].astype(">i4").tobytes(), x[2].astype(">i4").tobytes()))
    model = train([(b, c) for _, b, c in found], [lang for lang, _, _ in found], bits)
    del found
    give_back()
    return model


def predict_batch(model: Model | None, column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label index (-1: no model), calibrated score and rejection of each text; a text without subwords has what the bias says."""
    n = len(column)
    best, score = np.full(n, -1, np.int32), np.zeros(n)
    if model is None or not n:
        return best, score, np.ones(n, bool)
    data, at = text_bytes(column)
    for lo, hi in rounds(at):
        b, owner = subwords(data, at[lo : hi + 1], bits)
        count = np.bincount(owner, minlength=hi - lo)
        z = np.stack([np.bincount(owner, model.table[b, k], hi - lo) for k in range(len(model.labels))], 1)
        z = z / np.maximum(count, 1)[:, None] + model.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best[lo:hi] = p.argmax(1)
        score[lo:hi] = p.max(1)
    return best, score, score < model.threshold


def predict(docs: DataFrame, model: Model | None, bits: int = 16) -> DataFrame:
    """(row, lang_pred, score, rejected): ``docs`` (any columns) as ``row``; only texts go to Python workers and only predictions come back."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<best:int,score:double,rejected:boolean>")
    def guess(texts: pa.Array) -> pa.Array:
        best, score, reject = predict_batch(shared.value, texts, bits)
        return pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(score), pa.array(reject)], ["best", "score", "rejected"])

    text = F.col("text").cast("string")
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    x = docs.select(row, has_letter(text).alias("letter"), guess(text).alias("p"))
    known = F.col("letter") & (F.col("p.best") >= 0)
    labels = F.array(*map(F.lit, model.labels)) if model else F.array(F.lit("und"))
    lang = F.when(known, F.get(labels, F.col("p.best"))).otherwise("und")
    return x.select("row", lang.alias("lang_pred"), F.when(known, F.col("p.score")).otherwise(0.0).alias("score"), (F.col("p.rejected") | ~known).alias("rejected"))


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that the model does not reject, with their own columns."""
    return predict(docs, model).where(~F.col("rejected")).select("row.*")
