"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents are shuffled by a hash and queued twice over, since a source may give up to twice its words. An
entry's virtual finish time is its source's cumulative words divided by its source's target. All entries are sorted by finish
time over all sources, and the queue is cut where the words taken would pass the total budget.

The sort runs in ranges of finish time: all sources still send at any time up to 1, so ranges of equal width hold
about equal numbers of words. Sums of whole ranges say where each range begins and which is the last that the budget
reaches; each range is then sorted by itself. Cumulative words run likewise in ranges of the shuffle key inside a source. The
numbers of ranges follow from row counts, so neither a hot source nor the queue is ordered in one task. Sources
are joined by broadcast up to ``FEW_SOURCES`` of them, and with salted keys beyond.

Edge cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, last
in order; repeated rows are queued as rows of their own; empty tables give empty results. Extra
columns, whatever their names, pass through ``mix_documents`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a range, and sources up to which their table is broadcast.
RANGE_ROWS, FEW_SOURCES, SALTS = 65_536, 100_000, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranges_for(df: DataFrame, rows: int, range_rows: int) -> int:
    """A range for each shuffle partition at least, and for each ``range_rows`` rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // range_rows))


def numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``_n``: the source's place from 0 by code point, null last; counted range by range."""
    ranges = max(1, -(-sizes.count() // RANGE_ROWS))
    order = [F.col("source").isNull(), F.col("source")]
    x = stash(sizes.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    tops = x.groupBy("_p").agg(F.count("*").alias("_part")).select("_p", F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_top"))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return x.withColumn("_in", inner).join(tops, "_p").withColumn("_n", F.col("_top") + F.col("_in") - 1).drop("_p", "_in", "_top")


def targets(sizes: DataFrame, total: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, the excess over the caps reshared until none is above.

    Each round is one aggregate over the source list: the words that the capped sources leave, over the weights of the others.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod("_n", F.lit(len(weights))) + 1).cast("int"))
    x = stash(numbered(sizes).withColumn("_w", w).withColumn("_cap", F.col("source_size") * most), "mix-sizes")
    first = x.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    budget, level = (first["size"] or 0) * total, None
    if first["w"]:
        level = budget / first["w"]
        while level is not None:
            full = F.col("_w") * level > F.col("_cap")
            left = x.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("w")).first()
            new = (budget - left["cap"]) / left["w"] if left["w"] else None
            if new is not None and new <= level:
                break
            level = new
    target = F.col("_cap") if level is None else F.least("_cap", F.col("_w") * level)
    return x.select("source", "source_size", target.alias("target"))


def queue(slim: DataFrame, rows: int) -> DataFrame:
    """``slim`` (_source, _size, _k, ...) with _cum: the source's words up to this row, in order of the shuffle key ``_k``."""
    buckets = ranges_for(slim, rows, RANGE_ROWS)
    x = slim.withColumn("_b", F.floor(F.conv(F.substring("_k", 1, 8), 16, 10).cast("long") * F.lit(float(buckets)) / float(1 << 32)).cast("int")).withColumn("_sb", F.md5(F.concat(F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n")), F.lit("|"), F.col("_b").cast("string"))))
    head = x.groupBy("_sb", "_source", "_b").agg(F.sum("_size").alias("_part"))
    w = Window.partitionBy("_source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    head = head.select("_sb", F.coalesce(F.sum("_part").over(w), F.lit(0)).alias("_before"))
    # summed and joined on one key, so the rows are shuffled once
    inner = Window.partitionBy("_sb").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_in", F.sum("_size").over(inner)).join(head.hint("merge"), "_sb")
    return x.withColumn("_cum", F.col("_before") + F.col("_in")).drop("_sb", "_before", "_in", "_b")


def with_source(rows: DataFrame, goals: DataFrame, few: int = FEW_SOURCES) -> DataFrame:
    """``rows`` (_source, _k) with the columns of their source's row of ``goals`` (a written table)."""
    goals = goals.withColumnRenamed("source", "_goal")
    same = F.col("_source").eqNullSafe(F.col("_goal"))
    if goals.count() <= few:
        return rows.join(F.broadcast(goals), same).drop("_goal")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_k"), F.lit(SALTS)))
    goals = goals.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(goals, same & (F.col("_salt") == F.col("_salt2"))).drop("_goal", "_salt", "_salt2")


def entries(queued: DataFrame, goals: DataFrame) -> DataFrame:
    """The queue: (_source, _size, _k, _at, _finish), two entries for each row with words."""
    e = with_source(queued.where("_size > 0").select("_source", "_size", "_cum", "_k"), goals)
    e = e.withColumn("_pass", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_at", F.col("_cum") + F.col("_pass") * F.col("source_size"))
    return e.select("_source", "_size", "_k", "_at", (F.col("_at") / F.col("target")).alias("_finish"))


def cut(queued: DataFrame, goals: DataFrame, rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(source, source_size, target, reach): up to which of its (twice queued) words each source is taken.

    The queue is sorted by finish time over all sources; entries are taken while the words so far stay within the sum of the targets.
    """
    ranges = ranges_for(queued, 2 * rows, range_rows)
    e = entries(queued, goals).withColumn("_r", F.floor(F.col("_finish") * ranges))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    tops = e.groupBy("_r").agg(F.sum("_size").alias("_part"))
    tops = stash(tops.select("_r", F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_before")), "mix-ranges")
    budget = goals.agg(F.sum("target")).first()[0] or 0.0
    budget = budget * (1 + 1e-12) + 1e-6  # a sum of doubles, compared with whole words
    last = tops.where(F.col("_before") <= budget).agg(F.max("_r")).first()[0]
    run = Window.partitionBy("_r").orderBy("_finish", F.col("_source").isNull(), "_source", "_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    e = e.where(F.col("_r") <= F.lit(last)).withColumn("_so_far", F.sum("_size").over(run)).join(tops, "_r")
    taken = e.where(F.col("_before") + F.col("_so_far") <= budget).groupBy(F.col("_source").alias("_taken")).agg(F.max("_at").alias("reach"))
    x = goals.join(taken, F.col("source").eqNullSafe(F.col("_taken")), "left")
    return x.select("source", "source_size", "target", F.coalesce("reach", F.lit(0)).alias("reach"))


def plan(slim: DataFrame, rows: int, total: float, most: float, weights: tuple[int, ...], range_rows: int) -> DataFrame:
    """``cut`` for a queued table with _source, _size, _cum, _k."""
    sizes = slim.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    goals = stash(targets(stash(sizes, "mix-sizes"), total, most, weights), "mix-targets")
    return stash(cut(slim, goals, rows, range_rows), "mix-reach")


def passes() -> Column:
    """How often a row is taken: its place in the first and in the second round lies within reach."""
    return (F.col("_cum") <= F.col("reach")).cast("int") + (F.col("_cum") + F.col("source_size") <= F.col("reach")).cast("int")


def slim_columns(seed: int) -> list[Column]:
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text").cast("string")))
    return [F.col("source").cast("string").alias("_source"), word_count(F.col("text").cast("string")).alias("_size"), key.alias("_k")]


def mix_sizes(docs: DataFrame, total: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: int = 7, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document row: doc_id, size, source, source_size, target, taken (words)."""
    row = stash(docs.select("doc_id", *slim_columns(seed)), "mix-slim")
    rows = row.count()
    slim = stash(queue(row, rows), "mix-queue")
    out = with_source(slim, plan(slim, rows, total, most, weights, range_rows))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source").alias("source"), "source_size", "target", (F.col("_size") * passes()).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, total: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: int = 7, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mixed corpus itself: every column of ``docs``, a row for each time that a document is taken."""
    rows = docs.count()
    queued = queue(docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), *slim_columns(seed)), rows)
    slim = stash(queue(docs.select(*slim_columns(seed)), rows), "mix-queue")
    # documents without words cost nothing and stay once
    times = F.when(F.col("_size") == 0, F.lit(1)).otherwise(passes())
    out = with_source(queued, plan(slim, rows, total, most, weights, range_rows))
    out = out.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.select("_row.*")
