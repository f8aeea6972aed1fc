"""Spelling variant grouping: asymmetric q-chunks find all pairs of words one edit apart.

A word cut into two disjoint chunks keeps one of them whole under one edit, so the other word holds it among its positional grams,
shifted by one place at most. The half that the edit falls into is cut in two again (long words: more often) and keeps one part of
itself for the same reason; that part goes into the key beside the whole chunk, so a bucket holds words that agree on all but a
quarter of their letters. Of the positional grams only those are made that a chunk can meet: those before the edit are not shifted, and those
after it are shifted by the difference in length. The shorter word gives the chunks, the longer one the grams; of two words of one
length the lesser does. A key is a hash, and every pair that shares one is verified.

Edge cases: a null text has no words, a null id counts as the empty string; a word that repeats in a row counts each time. Ties of forms go to the least
word in code-point order. An empty table gives no rows. Extra columns are ignored. A text of any length is read in blocks that end between words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, bounded_batches, hot_join, stash, trimmed, unstash

#: Words that a task holds before it hands their counts on.
HELD = 200_000
#: Code points of a text that are cut into words at once.
BLOCK = 1 << 20

LETTER = "A-Za-zÀ-ÿ"


def blocks(text: str, size: int = BLOCK):
    """Parts of ``text`` of about ``size`` code points; a run of letters lies in one part whole."""
    at, gap = 0, re.compile(f"[^{LETTER}]")
    while at < len(text):
        m = gap.search(text, at + size) if at + size < len(text) else None
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def folded(text: str) -> str:
    """Only A-Z become lower case."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def damaged(word: str, seed: int, every: int) -> str:
    """``word`` without one of its code points if ``every`` divides its hash; ``seed`` is the crc32 of what stands before it."""
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"), seed)
    return word[: h % len(word)] + word[h % len(word) + 1 :] if h % every == 0 else word


def word_counts(docs: DataFrame, least_length: int = 7, least_n: int = 2, every: int = 31) -> DataFrame:
    """(word, n): words of ``docs`` (doc_id, text) of enough letters, after one letter of every ``every``-th (document, word) was lost."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        held: Counter[str] = Counter()
        # a shorter run is no word, with or without a lost letter
        find = re.compile(f"[{LETTER}]{{{least_length},}}").findall

        def handed():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                text, seed = batch.column(1)[i].as_py(), zlib.crc32(f"{batch.column(0)[i].as_py() or ''}:".encode())
                for part in blocks(text or ""):
                    for word, n in Counter(find(folded(part))).items():
                        word = damaged(word, seed, every)
                        if len(word) >= least_length:
                            held[word] += n
                    if len(held) >= HELD:
                        yield handed()
        yield handed()

    x = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return x.mapInArrow(trimmed(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def keyed(words: DataFrame, longer: int, name: str) -> DataFrame:
    """``words`` (word, n, len) once for each place of an edit, with its key: what a word ``longer`` letters shorter keeps of itself there."""
    cut = f"(len - {longer})"
    parts = f"(CASE WHEN {cut} <= 16 THEN 4 WHEN {cut} <= 64 THEN 8 ELSE 16 END)"
    before = f"substring(word, 1, CAST(k * {cut} DIV {parts} AS INT))"
    after = f"substring(word, CAST((k + 1) * {cut} DIV {parts} AS INT) + {longer} + 1)"
    keys = F.expr(f"transform(sequence(0, {parts} - 1), k -> xxhash64({cut}, k, {before}, {after}))")
    return words.select(F.explode(keys).alias("key"), F.col("word").alias(name), F.col("n").alias(f"n_{name}"), F.col("len").alias(f"len_{name}"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of ``words`` (word, n; each word once) that differ by exactly one inserted, deleted or replaced code point, once."""
    x = words.withColumn("len", F.length("word"))
    chunks, grams = keyed(x, 0, "a"), keyed(x, 0, "b").unionByName(keyed(x.where("len > 1"), 1, "b"))
    near = F.levenshtein("a", "b", 1) == 1
    one_of_two = (F.col("len_b") > F.col("len_a")) | (F.col("a") < F.col("b"))
    return chunks.join(grams.hint("merge"), "key").where(one_of_two & (F.col("len_b") - F.col("len_a")).between(0, 1) & near).select("a", "n_a", "b", "n_b").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): where following forms ends; counts grow along it, so it ends. Each round doubles the steps taken."""
    roots = stash(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        held = roots.groupBy("root").agg(F.count("*").alias("h"))
        inner = stash(roots.select(F.col("word").alias("root"), F.col("root").alias("further")).join(held, "root"), "variant-inner")
        if not inner.head(1):
            unstash(inner)
            return roots
        further = hot_join(roots, inner, ["root"], F.col("h") > roots.count() * HOT, ["word"], "left")
        found = stash(further.select("word", F.coalesce("further", "root").alias("root")), "variant-roots")
        unstash(roots, inner)
        roots = found


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each of ``words`` (word, n): its near word of largest count if that is ``ratio`` times its own, and where forms lead."""
    words = stash(words.select("word", "n"), "variant-words")
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("x"), F.max("n_a").alias("own"))
    enough = -F.col("x.less") >= F.col("own") * ratio
    best = stash(best.select("word", "n_near", F.when(enough, F.col("x.form")).alias("form"), F.when(enough, -F.col("x.less")).alias("form_n")), "variant-near")
    roots = last_forms(best.where("form is not null"))
    x = words.join(best, "word", "left").join(roots, "word", "left")
    return x.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
