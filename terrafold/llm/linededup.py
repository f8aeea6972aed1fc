"""Line dedup: repeated runs of lines, found with ranks of line sequences by prefix doubling.

Lines that are not blank form each document's sequence of line ids. Prefix doubling ranks all positions by
their first 1, 2, 4, ... lines (the suffix array's order to that depth): a group of equal rank is split by
the rank of the position as many lines further on. Positions whose rank is unique begin no repeated run and drop out. A group of
equal rank at depth ``d`` is the longest-common-prefix interval of depth ``d``. A run counts if it has ``min_words`` words or more;
every such run is the union of its smallest blocks that reach ``min_words`` going forward and going backward, so doubling
stops at the depth that these blocks need, and their union gives the maximal repeated runs exactly. Of each repeated block the
first copy stays, by (doc_id, hash of the text, place of the row, line); lines in later copies are deleted. Each line's first copy always stays.

All steps are DataFrame operations over lines; a document is named by the place of its row (``common.placed``), so rows without an
id or of equal ids are documents of their own and meet in no common task. Ranks inside a group are prefix sums in two levels over
distinct pairs, in as many buckets as their count asks for. Joins on a line or block split the rows of those that hold more than
``HOT`` of all rows.

Edge cases: a null text has no lines and stays null; blank lines stay; lines are compared exactly; of equal rows the copies
after the first lose their repeated lines; rows without an id come last; an empty table gives no rows; extra columns
of any name pass through.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT, bounded_batches, hot_join, placed, stash

WORD = r"[^\x20\x09-\x0D]+"
DOC = ["rf", "ri"]
#: Distinct pairs that one task ranks.
RANK_ROWS = 65_536


def _reach(words: Column, least: int) -> Column:
    """How many of these lines it takes to have ``least`` words; null if all have fewer."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"))
    step = lambda acc, w: F.struct((acc["s"] + w).alias("s"), (acc["n"] + F.when(acc["s"] < least, 1).otherwise(0)).alias("n"))
    return F.aggregate(words, start, step, lambda acc: F.when(acc["s"] >= least, acc["n"]))


def positions(docs: DataFrame, min_words: int) -> DataFrame:
    """(rf, ri, d, t, i, line, h, g, ahead, back) of (rf, ri, doc_id, text): a row per line that is not blank; ``line`` counts all lines from 0."""
    text = F.col("text").cast("string")
    line = F.filter(
        F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("h"), F.xxhash64(x, F.lit(1)).alias("g"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("w"))),
        lambda s: s["w"] > 0,
    )
    x = docs.select(*DOC, F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("t"), line.alias("lines"))
    x = x.where(F.size("lines") > 0).withColumn("w", F.col("lines.w")).withColumn("r", F.reverse("w")).withColumn("n", F.size("w"))
    rows = F.transform(
        "lines",
        lambda s, i: F.struct(
            i.cast("long").alias("i"), s["line"].alias("line"), s["h"].alias("h"), s["g"].alias("g"),
            _reach(F.slice("w", i + 1, F.lit(min_words)), min_words).alias("ahead"),
            _reach(F.slice("r", F.col("n") - i, F.lit(min_words)), min_words).alias("back"),
        ),
    )
    return x.select(*DOC, "d", "t", F.explode(rows).alias("x")).select(*DOC, "d", "t", "x.*")


def ranked(pairs: DataFrame, first: str, second: list[str], bits: Column) -> DataFrame:
    """Distinct (first, second) that occur twice or more, with their rank (``first`` plus how many rows of it sort before) and number ``n``.

    ``bits`` is what ``second`` is sorted by first, as a number from 0 to 1; it deals each ``first`` into buckets.
    """
    groups = stash(pairs.groupBy(first, *second).agg(F.count("*").alias("n")).where("n > 1"), "line-groups")
    groups = groups.withColumn("b", F.floor(bits * F.lit(float(-(-groups.count() // RANK_ROWS)))))
    tops = groups.groupBy(first, "b").agg(F.sum("n").alias("m"))
    before = Window.partitionBy(first).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(first, "b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("top"))
    inner = Window.partitionBy(first, "b").orderBy(*second).rowsBetween(Window.unboundedPreceding, -1)
    out = groups.withColumn("in", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(tops, [first, "b"])
    return stash(out.select(first, *second, (F.col(first) + F.col("top") + F.col("in")).alias("rank"), "n"), "line-names")


def at(offset: int, col: str) -> Column:
    """``col`` of the line ``offset`` further on in the same document, null if it has dropped out."""
    return F.first(col).over(Window.partitionBy(*DOC).orderBy("i").rangeBetween(offset, offset))


def doubled(pos: DataFrame, depth: int) -> DataFrame:
    """``pos`` with rank_0 .. rank_depth: the rank by the first 2 ** k lines, null where that is unique."""
    total = max(1, pos.count())
    hot = F.col("n") > total * HOT
    names = ranked(pos.withColumn("zero", F.lit(0).cast("long")), "zero", ["h", "g"], F.col("h") / F.lit(2.0**64) + 0.5)
    x = hot_join(pos, names.select("h", "g", F.col("rank").alias("rank_0"), "n"), ["h", "g"], hot, [*DOC, "i"]).drop("h", "g", "n")
    for k in range(depth):
        x = stash(x.withColumn("b_", at(1 << k, f"rank_{k}")).withColumn("a", F.when(F.col("b_").isNotNull(), F.col(f"rank_{k}"))), "line-ranks")
        names = ranked(x.where("a is not null").select("a", "b_"), "a", ["b_"], F.col("b_") / F.lit(float(total)))
        new = names.select("a", "b_", F.col("rank").alias(f"rank_{k + 1}"), "n")
        # positions without a pair have nothing to be joined with
        both = hot_join(x.where("a is not null"), new, ["a", "b_"], hot, [*DOC, "i"], "left").drop("n")
        x = both.unionByName(x.where("a is null").withColumn(f"rank_{k + 1}", F.lit(None).cast("long"))).drop("a", "b_")
    return stash(x, "line-ranks")


def later_copies(pos: DataFrame, min_words: int) -> DataFrame:
    """(rf, ri, removed): numbers of the lines that are later copies, as a sorted array."""
    depth = min_words.bit_length() - 1
    x = doubled(pos, depth)
    ranks, blocks = {}, []
    for way in ("ahead", "back"):
        for size in range(1, min_words + 1):
            # a block is named by the ranks of its first and of its last 2**k lines, 2**k <= size
            k = size.bit_length() - 1
            head, tail = (0, size - (1 << k)) if way == "ahead" else (1 - size, 1 - (1 << k))
            p, q = ((f"r{k}_{o + min_words}", o) for o in (head, tail))
            ranks |= {name: at(o, f"rank_{k}") for name, o in (p, q)}
            start = F.col("i") + head
            whole = (F.col(way) == size) & F.col(p[0]).isNotNull() & F.col(q[0]).isNotNull()
            blocks.append(F.when(whole, F.struct(start.alias("start"), F.lit(size).alias("size"), F.col(p[0]).alias("p"), F.col(q[0]).alias("q"))))
    found = x.withColumns(ranks).select(*DOC, "d", "t", F.explode(F.filter(F.array(*blocks), lambda s: s.isNotNull())).alias("x")).select(*DOC, "d", "t", "x.*")
    place = F.struct(F.col("d").isNull().alias("no"), "d", "t", *DOC, "start")
    found = stash(found, "line-blocks")
    first = found.groupBy("size", "p", "q").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = hot_join(found, stash(first, "line-firsts"), ["size", "p", "q"], F.col("n") > max(1, found.count()) * HOT, [*DOC, "start"]).where(place > F.col("first"))
    hit = later.select(*DOC, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("i")).distinct()
    hit = hit.join(x.select(*DOC, "i", "line"), [*DOC, "i"])
    return hit.groupBy(*DOC).agg(F.array_sort(F.collect_set("line")).alias("removed"))


def removals(docs: DataFrame, min_words: int = 5) -> DataFrame:
    return later_copies(stash(positions(docs, min_words), "line-positions"), min_words)


@F.pandas_udf(T.StringType())
def without_lines(text: pd.Series, removed: pd.Series) -> pd.Series:
    def one(t, gone):
        if t is None or gone is None:
            return t
        gone = set(gone)
        return "\n".join([line for i, line in enumerate(t.split("\n")) if i not in gone])

    return pd.Series([one(t, g) for t, g in zip(text, removed)], dtype=object)


def dedup_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """(row, text, removed): the row as it was, its text without later copies, and the numbers of the lines taken out."""
    bounded_batches(docs.sparkSession)
    x = placed(docs, F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = stash(removals(x.select("doc_id", "text", *DOC), min_words), "line-removals")
    # both sides grow with the input, so neither is broadcast at any size; the texts are shuffled once
    x = x.select(*DOC, "row", "text").join(gone.hint("merge"), DOC, "left")
    return x.select("row", without_lines("text", "removed").alias("text"), "removed")


def clean_documents(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """``docs`` with later copies of lines taken out; a document that loses all its words goes."""
    x = dedup_lines(docs, min_words).where(F.col("removed").isNull() | F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return x.select(*(F.col("text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
