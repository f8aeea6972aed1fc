"""Leave-year-out day-of-year climatology, and anomalies against it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days of the year that windows go around.
DAYS = 366


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of rows sorted by ``keys``, cut anew so that none splits a key, each with the rows at which a key starts: one batch and one key are held at a time."""
    rest = None
    for b in batches:
        new = pa.Table.from_batches([b])
        t = new if rest is None else pa.concat_tables([rest, new])
        if not t.num_rows:
            continue
        t = t.combine_chunks()
        starts = key_starts(t, keys)
        if len(starts) > 1:
            yield t.slice(0, starts[-1]), starts[:-1]
        rest = t.slice(starts[-1])
    if rest is not None:
        rest = rest.combine_chunks()
        yield rest, key_starts(rest, keys)


def key_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for k in keys:
        c = t[k].combine_chunks() if isinstance(t[k], pa.ChunkedArray) else t[k]
        change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


class Series:
    """Rows of whole keys, in time inside each: group, day number, year, day of year, value and whether it is known (not null)."""

    def __init__(self, t: pa.Table, starts: np.ndarray):
        self.starts, self.sizes = starts, np.diff(np.append(starts, t.num_rows))
        self.group = np.repeat(np.arange(len(starts)), self.sizes)
        day = t["_t"].to_numpy().astype("datetime64[D]")
        year = day.astype("datetime64[Y]")
        self.t, self.y, self.doy = day.astype("int64").astype(float), year.astype("int64") + 1970, (day - year.astype("datetime64[D]")).astype("int64") + 1
        self.known, self.value = pc.is_valid(t["value"]).to_numpy(), pc.fill_null(t["value"], 0.0).to_numpy()

    def rows_of(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(problem, row): every row of the group of each problem, in order of problem and time."""
        return spread(self.starts[groups], self.sizes[groups])

    def day_means(self, problem: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(problem, doy, mean), in this order, of each problem's rows: nulls filled between neighbours in time (no extrapolation), then days averaged."""
        known, v, t = self.known[row], self.value[row], self.t[row]
        at, n = np.arange(len(row)), len(row)
        new = np.ones(n, bool)
        new[1:] = problem[1:] != problem[:-1]
        empty = np.flatnonzero(~known)
        if len(empty):
            first = np.maximum.accumulate(np.where(new, at, 0))[empty]
            last = np.minimum.accumulate(np.where(np.append(new[1:], True), at, n)[::-1])[::-1][empty]
            a = np.maximum.accumulate(np.where(known, at, -1))[empty]
            b = np.minimum.accumulate(np.where(known, at, n)[::-1])[::-1][empty]
            ok = (a >= first) & (b <= last)
            empty, a, b = empty[ok], a[ok], b[ok]
            ok = t[b] > t[a]
            empty, a, b = empty[ok], a[ok], b[ok]
            v[empty] = v[a] + (v[b] - v[a]) * ((t[empty] - t[a]) / (t[b] - t[a]))
            known[empty] = True
        key, v = (problem * (DAYS + 1) + self.doy[row])[known], v[known]
        if not len(key):
            return key, key, v
        order = np.argsort(key, kind="stable")
        key, v = key[order], v[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[heads] // (DAYS + 1), key[heads] % (DAYS + 1), np.add.reduceat(v, heads) / np.diff(np.append(heads, len(v)))

    def without_own_year(self) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row's problem, first row of each problem, day means): a problem is a year of a key, left out of the key's other years."""
        new = np.ones(len(self.y), bool)
        new[1:] = (self.y[1:] != self.y[:-1]) | (self.group[1:] != self.group[:-1])
        own, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        problem, row = self.rows_of(self.group[heads])
        other = own[row] != problem
        return own, heads, self.day_means(problem[other], row[other])


def spread(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, lo[i] + 0 ... lo[i] + n[i] - 1) for each i."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


def means_around(days: tuple[np.ndarray, np.ndarray, np.ndarray], problem: np.ndarray, doy: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, mean) of the day means from ``before`` days before to ``after`` days after each asked day of its problem, around the year's wrap."""
    key, total, n = days[0] * (DAYS + 1) + days[1], np.zeros(len(doy)), np.zeros(len(doy), "int64")
    for shift in (0, -DAYS, DAYS):
        lo, hi = np.maximum(doy - before + shift, 1), np.minimum(doy + after + shift, DAYS)
        some = np.flatnonzero(lo <= hi)
        a = np.searchsorted(key, problem[some] * (DAYS + 1) + lo[some])
        i, at = spread(a, np.searchsorted(key, problem[some] * (DAYS + 1) + hi[some], "right") - a)
        total += np.bincount(some[i], days[2][at], len(doy))
        n += np.bincount(some[i], minlength=len(doy))
    return n, total / np.maximum(n, 1)


def every_day(days: tuple[np.ndarray, np.ndarray, np.ndarray], problems: int, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, mean), problems x 366: the same for every day of the year."""
    at = (days[0] * DAYS)[:, None] + (days[1][:, None] - 1 + np.arange(-after, before + 1)) % DAYS
    n = np.bincount(at.ravel(), minlength=problems * DAYS)
    total = np.bincount(at.ravel(), np.repeat(days[2], before + after + 1), problems * DAYS)
    return n.reshape(problems, DAYS), (total / np.maximum(n, 1)).reshape(problems, DAYS)


def by_series(obs: DataFrame, keys: list[str], near: list[str], kind: str, make: Callable[[pa.Table, Series], pa.Table]) -> DataFrame:
    """``make`` of the whole series of each key of ``obs`` (keys, ts, value, ...): one shuffle by ``near`` and one sort; a task holds one batch and one series.

    Rows with a null key or time take no part, as in a join on them.
    """
    x = obs.dropna(subset=[*keys, "ts"]).withColumn("value", F.col("value").cast("double")).repartition(*near).sortWithinPartitions(*keys, "ts").withColumn("_t", F.unix_date("ts"))

    def run(batches):
        for t, starts in whole_keys(batches, keys):
            yield from make(t, Series(t, starts)).to_batches()

    return x.mapInArrow(run, kind)


def kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def leave_year_out(obs: DataFrame, keys: list[str], before: int = 15, after: int = 14) -> DataFrame:
    """``obs`` (keys, ts, value) -> (keys, excluded, doy, clim) for days 1..366.

    For each excluded year: observations of all other years, averaged by day of year after linear filling of
    nulls between neighbours in time (no extrapolation), then a centred mean of 30 days around the year's
    wrap, nulls left out. Keys of a single year have no row.
    """

    def make(t, s):
        _, heads, days = s.without_own_year()
        n, clim = every_day(days, len(heads), before, after)
        problem, doy = np.nonzero(n)
        out = t.select(keys).take(heads[problem])
        return out.append_column("excluded", pa.array(s.y[heads[problem]], pa.int32())).append_column("doy", pa.array(doy + 1, pa.int32())).append_column("clim", pa.array(clim[problem, doy]))

    return by_series(obs, keys, keys, kinds(obs, keys) + ", excluded int, doy int, clim double", make)


def leave_year_out_totals(obs: DataFrame, keys: list[str], near: list[str] | None = None, before: int = 15, after: int = 14) -> DataFrame:
    """(keys, excluded, n, total): how many days ``leave_year_out`` has for each key and year, and the sum of their means, without a row a day.

    ``near``: keys to shuffle by, where results are summed over the others.
    """

    def make(t, s):
        _, heads, days = s.without_own_year()
        n, clim = every_day(days, len(heads), before, after)
        some = n.any(axis=1)
        out = t.select(keys).take(heads[some])
        return out.append_column("excluded", pa.array(s.y[heads[some]], pa.int32())).append_column("n", pa.array((n[some] > 0).sum(axis=1))).append_column("total", pa.array(clim[some].sum(axis=1)))

    return by_series(obs, keys, near or keys, kinds(obs, keys) + ", excluded int, n long, total double", make)


def anomalies(obs: DataFrame, keys: list[str], near: list[str] | None = None, before: int = 15, after: int = 14) -> DataFrame:
    """``obs`` (keys, ts, value, ...) with ``anomaly``, value minus ``leave_year_out`` without the value's own year, at its day of year alone.

    A null value, and one without a day of other years in its window, has no row. ``near``: keys to shuffle by, where results are summed over the others.
    """
    names = obs.columns

    def make(t, s):
        own, _, days = s.without_own_year()
        row = np.flatnonzero(s.known)
        n, clim = means_around(days, own[row], s.doy[row], before, after)
        row, clim = row[n > 0], clim[n > 0]
        return t.select(names).take(row).append_column("anomaly", pa.array(s.value[row] - clim))

    kind = ", ".join(f"`{n}` {'double' if n == 'value' else obs.schema[n].dataType.simpleString()}" for n in names)
    return by_series(obs, keys, near or keys, kind + ", anomaly double", make)


def sides_by_frame(sides: DataFrame) -> DataFrame:
    """(cube, acq_idx, sides): a frame's places in a fold table, as 2 * fold, + 1 on the test side."""
    return sides.groupBy("cube", "acq_idx").agg(F.collect_list((2 * F.col("fold") + (F.col("side") != "train").cast("int")).cast("int")).alias("sides"))  # a few a frame: one a fold


def trained_years(dates: DataFrame, sides: DataFrame) -> dict[int, set[int]]:
    """The years of each fold's training rows, by ``dates`` (cube, acq_idx, ts): folds times years."""
    rows = dates.select("cube", "acq_idx", "ts").join(sides.where("side = 'train'"), ["cube", "acq_idx"]).select("fold", F.year("ts").alias("y")).distinct().dropna().collect()
    out: dict[int, set[int]] = {}
    for fold, y in rows:
        out.setdefault(fold, set()).add(y)
    return out


def strict_anomalies(obs: DataFrame, keys: list[str], trained: dict[int, set[int]], before: int = 15, after: int = 14) -> DataFrame:
    """(keys, acq_idx, ts, fold, side, anomaly) of ``obs`` (keys, cube first, acq_idx, ts, value, sides as ``sides_by_frame`` gives them, null for none).

    Against the climatology of a fold's training years alone (``trained``), for a training row less its own year. A year that no training row of the fold has
    enters none of them, so what is held out changes nothing in training. Each series forms only the sets of years that its own rows ask for.
    """
    folds, every = sorted(trained), sorted(set().union(*trained.values()))
    low = every[0] if every else 0
    table = np.zeros((len(folds), (every[-1] - low if every else 0) + 1), bool)
    for i, f in enumerate(folds):
        table[i, [y - low for y in trained[f]]] = True
    names = [*keys, "acq_idx", "ts"]

    def make(t, s):
        lists = t["sides"].combine_chunks()
        row = np.repeat(np.arange(t.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        code = pc.list_flatten(lists).to_numpy().astype("int64")
        place = np.searchsorted(folds, code // 2)
        use = s.known[row] & np.isin(code // 2, folds)
        row, code, place = row[use], code[use], place[use]
        excluded = np.where(code % 2 == 0, s.y[row], 0)
        asked, own = np.unique((s.group[row] * len(folds) + place) * 10_000 + excluded, return_inverse=True)
        problem, other = s.rows_of(asked // 10_000 // max(len(folds), 1))
        y = s.y[other]
        inside = (y >= low) & (y < low + table.shape[1]) & (y != (asked % 10_000)[problem])
        problem, other, y = problem[inside], other[inside], y[inside]
        inside = table[(asked // 10_000 % max(len(folds), 1))[problem], y - low]
        n, clim = means_around(s.day_means(problem[inside], other[inside]), own, s.doy[row], before, after)
        row, code, clim = row[n > 0], code[n > 0], clim[n > 0]
        return t.select(names).take(row).append_column("_code", pa.array(code, pa.int32())).append_column("anomaly", pa.array(s.value[row] - clim))

    x = by_series(obs, keys, keys[:1], kinds(obs, names) + ", _code int, anomaly double", make)
    return x.select(*names, F.floor(F.col("_code") / 2).cast("int").alias("fold"), F.when(F.col("_code") % 2 == 0, "train").otherwise("test").alias("side"), "anomaly")


def crossed_anomalies(obs: DataFrame, keys: list[str], sides: DataFrame, strict: bool) -> DataFrame:
    """(keys, acq_idx, ts, fold, side, anomaly) of the rows of a fold table, null values left out.

    Not strict: against the mean year of all years but the row's own, the held-out ones too, so a training target still feels them a little.
    Strict: ``strict_anomalies``. A row without a day of year in its climatology has no anomaly and is left out.
    """
    if strict:
        trained = trained_years(obs.select("cube", "acq_idx", "ts").distinct(), sides)
        return strict_anomalies(obs.join(sides_by_frame(sides), ["cube", "acq_idx"], "left"), keys, trained)
    return anomalies(obs, keys).join(sides, ["cube", "acq_idx"]).select(*keys, "acq_idx", "ts", "fold", "side", "anomaly")
