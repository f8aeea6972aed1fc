"""Leakage-safe fold tables: (cube, acq_idx, fold, side); a row absent from a fold is on neither side."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import dealt, row_numbers, written


class LeakageError(ValueError):
    """A fold table would put one cube on both sides."""


class SingleYearError(ValueError):
    """A split by year needs two years or more."""


class SingleTileError(ValueError):
    """A split by tile needs two tiles or more."""


def phases(histogram: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first, last, turn): of the groups of that size, those of ranks first to last - 1 go to the folds of ``turn`` in rotation.

    ``histogram`` has (size, groups of that size), largest first. Each group goes to the lightest fold, the lowest of a tie. For groups of
    one size that is a merge of k arithmetic series of loads: a fold takes part from the round in which the others have caught up with it.
    """
    load, out = [0] * k, []
    for size, groups in histogram:
        start = [v // size for v in load]
        order = sorted(range(k), key=lambda j: (load[j] % size, j))
        rank, levels = 0, [*sorted(set(start)), None]
        for level, following in zip(levels, levels[1:]):
            turn = [j for j in order if start[j] <= level]
            n = groups - rank if following is None else min(groups - rank, len(turn) * (following - level))
            if n:
                out.append((size, rank, rank + n, turn))
                for i, j in enumerate(turn):
                    load[j] += size * (n // len(turn) + (i < n % len(turn)))
            rank += n
    return out


def balanced_groups(rows: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): groups by size, largest first, then by label, each to the lightest fold so far (lowest index of a tie).

    Only the histogram of group sizes reaches the driver (n rows have less than the root of 2 n different sizes); groups find their fold by their rank
    among groups of the same size.
    """
    counts = written(rows.groupBy(group).agg(F.count("*").alias("_size")), "fold-groups")
    histogram = [(r["_size"], r["n"]) for r in counts.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("_size")).collect()]
    found = rows.sparkSession.createDataFrame(phases(histogram, k), "_size2 long, _first long, _last long, _turn array<int>")
    x = row_numbers(counts, ["_size"], [F.col(group)], "_rank").withColumn("_rank", F.col("_rank") - 1)
    x = x.join(F.broadcast(found), (F.col("_size") == F.col("_size2")) & F.col("_rank").between(F.col("_first"), F.col("_last") - 1))
    return x.select(group, F.get("_turn", ((F.col("_rank") - F.col("_first")) % F.size("_turn")).cast("int")).alias("fold"))


def _sides(rows: DataFrame, groups: DataFrame, group: str, k: int) -> DataFrame:
    x = rows.join(groups.withColumnRenamed("fold", "own"), group)
    x = x.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return x.select("cube", "acq_idx", "fold", F.when(F.col("fold") == F.col("own"), "test").otherwise("train").alias("side"))


def group_folds(rows: DataFrame, group: str = "cube", k: int = 5, clamp: bool = False) -> DataFrame:
    """Folds by cube, tile or block. Only with ``clamp`` may there be fewer groups than folds."""
    n = rows.select(group).distinct().count()
    if group == "tile" and n < 2:
        raise SingleTileError("one tile only")
    if n < (2 if clamp else k):
        raise ValueError(f"{n} groups of {group} for {k} folds")
    k = min(k, n)
    return _sides(rows, balanced_groups(rows, group, k), group, k)


def leave_one_out(rows: DataFrame, group: str = "cube") -> DataFrame:
    """(group, fold): every group is a fold of its own, in order of their labels."""
    return row_numbers(rows.select(group).distinct(), [], [F.col(group)], "fold").withColumn("fold", (F.col("fold") - 1).cast("int"))


def year_folds(rows: DataFrame, k: int = 5) -> DataFrame:
    mixed = rows.groupBy("cube").agg(F.countDistinct("year").alias("n")).where("n > 1").limit(1).count()
    if rows.select("year").distinct().count() < 2:
        raise SingleYearError("one year only")
    if mixed:
        raise LeakageError("a cube spans several years")
    return group_folds(rows, "year", k, clamp=True)


def crossed_folds(rows: DataFrame, k: int = 5) -> DataFrame:
    """Test: cube and year both of fold i; train: neither; the rest on neither side."""
    n = min(k, rows.select("year").distinct().count(), rows.select("cube").distinct().count())
    if n < 2:
        raise SingleYearError("crossed folds need two years and two cubes")
    c, y = balanced_groups(rows, "cube", n), balanced_groups(rows, "year", n)
    x = rows.join(c.withColumnRenamed("fold", "cf"), "cube").join(y.withColumnRenamed("fold", "yf"), "year")
    x = written(x.select("cube", "acq_idx", "cf", "yf"), "fold-cells")
    cells = {(r["cf"], r["yf"]): r["n"] for r in x.groupBy("cf", "yf").agg(F.count("*").alias("n")).collect()}  # at most k * k
    alive = [i for i in range(n) if cells.get((i, i)) and any(c != i and y != i for c, y in cells)]
    if not alive:
        raise SingleYearError("no fold has rows on both sides")
    x = x.withColumn("fold", F.explode(F.array(*map(F.lit, alive))))
    side = F.when((F.col("cf") == F.col("fold")) & (F.col("yf") == F.col("fold")), "test").when((F.col("cf") != F.col("fold")) & (F.col("yf") != F.col("fold")), "train")
    return x.select("cube", "acq_idx", "fold", side.alias("side")).where("side is not null")


def temporal_folds(rows: DataFrame, cutoff: str) -> DataFrame:
    """One fold: each cube goes whole to its majority side of the cutoff (a tie to train); rows of the other side go."""
    c = F.lit(cutoff).cast("date")
    w = Window.partitionBy("cube")
    early, late = F.count_if(F.col("ts") < c).over(w), F.count_if(F.col("ts") > c).over(w)
    x = rows.withColumn("side", F.when(late > early, "test").otherwise("train"))
    x = x.where(F.when(F.col("side") == "test", F.col("ts") > c).otherwise(F.col("ts") < c))
    return x.select("cube", "acq_idx", F.lit(0).alias("fold"), "side")


def spatial_blocks(boxes: DataFrame, size: int) -> DataFrame:
    """(id, block): integer grid blocks of the box centres."""
    return boxes.select("id", F.concat_ws("_", F.floor((F.col("r0") + F.col("r1")) / (2 * size)), F.floor((F.col("c0") + F.col("c1")) / (2 * size))).alias("block"))


def linkage(points: np.ndarray, n_blocks: int) -> np.ndarray:
    """Complete linkage: the two clusters whose farthest members are nearest are joined until ``n_blocks`` are left; a tie goes to the pair of earliest
    first members. Clusters are numbered by their first members."""
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    d[np.tril_indices(len(d))] = np.inf
    label = np.arange(len(d))
    for _ in range(len(d) - n_blocks):
        a, b = divmod(int(d.argmin()), len(d))  # the first of equal minima: least a, then least b
        for i in range(len(d)):
            if i not in (a, b) and not np.isinf(d[min(a, i), max(a, i)]):
                d[min(a, i), max(a, i)] = max(d[min(a, i), max(a, i)], d[min(b, i), max(b, i)])
        d[b, :] = d[:, b] = np.inf
        label[label == b] = a
    return np.searchsorted(np.unique(label), label)


def spatial_clusters(boxes: DataFrame, n_blocks: int, limit: int = 512) -> DataFrame:
    """(id, block) of ``boxes`` (id, tile, r0, r1, c0, c1). Several tiles: the block is the tile. One tile: complete linkage of the box centres into ``n_blocks``.

    Up to ``limit`` different centres are linked exactly. Beyond, centres share square cells, the finest (sides double) of which no more than ``limit`` are
    occupied; the cell's least id stands for it. So what one task links is bounded, and the result depends on the boxes alone.
    """
    tiles = [r["tile"] for r in boxes.select("tile").distinct().limit(2).collect()]
    if len(tiles) > 1:
        return boxes.select("id", F.col("tile").cast("string").alias("block"))
    # twice the centre, so that it is whole
    x = boxes.groupBy("id").agg(F.first("tile").alias("tile"), F.min(F.col("r0") + F.col("r1")).alias("y"), F.min(F.col("c0") + F.col("c1")).alias("x"))
    cells, level = written(x.groupBy(F.col("y").alias("cy"), F.col("x").alias("cx")).agg(F.min(F.struct("id", "y", "x", "tile")).alias("first")), "fold-cells"), 0
    while cells.count() > limit:
        level += 1
        cells = written(cells.groupBy(F.floor(F.col("cy") / 2).alias("cy"), F.floor(F.col("cx") / 2).alias("cx")).agg(F.min("first").alias("first")), "fold-cells")
    if cells.count() < n_blocks:
        raise ValueError(f"{n_blocks} blocks of {cells.count()} places")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        pdf["block"] = linkage(pdf[["y", "x"]].to_numpy(float) / 2, n_blocks)
        return pdf[["cy", "cx", "block"]]

    blocks = cells.select(F.lit(0).alias("k"), "cy", "cx", "first.id", "first.y", "first.x").groupBy("k").applyInPandas(link, "cy long, cx long, block int")
    side = F.lit(2**level)
    x = x.withColumns({"cy": F.floor(F.col("y") / side), "cx": F.floor(F.col("x") / side)}).join(F.broadcast(blocks), ["cy", "cx"])  # ``limit`` rows at most
    return x.select("id", F.concat(F.col("tile").cast("string"), F.lit("/block"), F.col("block")).alias("block"))


def _on_both(folds: DataFrame) -> DataFrame:
    """(fold, n): cubes on both sides, from one aggregation by fold and cube."""
    x = folds.groupBy("fold", "cube").agg(F.min("side").alias("least"), F.max("side").alias("most")).where("least < most")
    return x.groupBy("fold").agg(F.count("*").alias("n"))


def leakage(folds: DataFrame, n: int | None = None) -> DataFrame:
    """(fold, n): cubes that a fold has on both sides; empty when the table is safe. ``n``: how many rows ``folds`` has, counted if not given."""
    return _on_both(dealt(folds.select("fold", "cube", "side"), ["cube"], n))


#: Split modes by name: rows (cube, acq_idx, and year, tile, block or ts as the mode needs) and options to a fold table.
MODES: dict[str, Callable[..., DataFrame]] = {
    "cube": lambda rows, k=5: group_folds(rows, "cube", k),
    "loco": lambda rows, k=None: _sides(rows, leave_one_out(rows), "cube", rows.select("cube").distinct().count()),
    "crossed": lambda rows, k=5: crossed_folds(rows, k),
    "year": lambda rows, k=5: year_folds(rows, k),
    "tile": lambda rows, k=5: group_folds(rows, "tile", k, clamp=True),
    "block": lambda rows, k=5: group_folds(rows, "block", k, clamp=True),
    "temporal": lambda rows, cutoff: temporal_folds(rows, cutoff),
}


def fold_table(rows: DataFrame, mode: str, **options) -> DataFrame:
    """The fold table of a mode by its name."""
    if mode not in MODES:
        raise ValueError(f"unknown fold mode {mode}; known: {', '.join(MODES)}")
    return MODES[mode](rows, **options)


def inner_folds(outer: DataFrame, k: int = 3) -> DataFrame:
    """(outer, cube, inner): each outer fold's training cubes in k balanced groups, by the same greedy rule, all outer folds at once."""
    counts = written(outer.where("side = 'train'").groupBy(F.col("fold").alias("outer"), "cube").agg(F.count("*").alias("_size")), "fold-inner")
    found = []
    sizes: dict[int, list] = {}
    for r in counts.groupBy("outer", "_size").agg(F.count("*").alias("n")).orderBy("outer", F.desc("_size")).collect():
        sizes.setdefault(r["outer"], []).append((r["_size"], r["n"]))
    for fold, histogram in sizes.items():
        found += [(fold, *p) for p in phases(histogram, k)]
    found = outer.sparkSession.createDataFrame(found, "_outer int, _size2 long, _first long, _last long, _turn array<int>")
    x = row_numbers(counts, ["outer", "_size"], [F.col("cube")], "_rank").withColumn("_rank", F.col("_rank") - 1)
    x = x.join(F.broadcast(found), (F.col("outer") == F.col("_outer")) & (F.col("_size") == F.col("_size2")) & F.col("_rank").between(F.col("_first"), F.col("_last") - 1))
    return x.select("outer", "cube", F.get("_turn", ((F.col("_rank") - F.col("_first")) % F.size("_turn")).cast("int")).alias("inner"))


def members(units: DataFrame, frames: list[str], folds: DataFrame) -> DataFrame:
    """``units`` (cube and the frames that each touches, in columns ``frames``) with fold and side: a unit is on a side only with all its frames.

    A unit with some frames of a fold on a side and others not is left out of that fold if its frames are on no side, and is an error
    (``whole`` false) if they are on both.
    """
    n = len(frames)
    x = units.withColumn("_u", F.struct(*units.columns)).withColumn("acq_idx", F.explode(F.array(*frames)))
    x = x.join(folds, ["cube", "acq_idx"]).groupBy("_u", "fold").agg(F.count_if(F.col("side") == "test").alias("_t"), F.count_if(F.col("side") == "train").alias("_r"))
    side = F.when(F.col("_t") == n, "test").when(F.col("_r") == n, "train")
    return x.select("_u.*", "fold", side.alias("side"), ((F.col("_t") == 0) | (F.col("_r") == 0)).alias("whole")).where("side is not null or not whole")


def gate(folds: DataFrame, n: int | None = None) -> DataFrame:
    """(fold, problem, n): what a safe fold table does not have: cubes or rows on both sides, and sides without rows.

    Rows are dealt by cube, so those of a cube, and of a frame, are counted where they lie; ``n``: how many ``folds`` has, counted if not given.
    """
    x = dealt(folds, ["cube"], n)
    cubes = _on_both(x).select("fold", F.lit("cube_on_both_sides").alias("problem"), "n")
    rows = x.groupBy("fold", "cube", "acq_idx").agg(F.count("*").alias("s")).where("s > 1").groupBy("fold").agg(F.count("*").alias("n")).select("fold", F.lit("row_repeated").alias("problem"), "n")
    empty = folds.groupBy("fold").agg(F.count_if(F.col("side") == "test").alias("t"), F.count_if(F.col("side") == "train").alias("r")).where("t = 0 or r = 0")
    return cubes.unionByName(rows).unionByName(empty.select("fold", F.lit("side_empty").alias("problem"), F.lit(0).cast("long").alias("n")))
