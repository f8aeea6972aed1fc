"""Shared helpers: tables in the shared folder, byte-level tokens, token hashes.

Tokens are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z fold to a-z.
All array work happens inside Arrow batches of bounded size.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; documents are long, so far fewer than Spark's 10,000.
BATCH_ROWS = 256
#: Bytes of text that one round of array work takes (a longer document is a round of its own).
ROUND_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one is made only where it is unset on a single machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stash(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder (in parts by the columns ``by``) and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(*tables: DataFrame) -> None:
    """Delete tables made by ``stash`` that nothing needs any more."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        if files:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def placed(docs: DataFrame, *cols: Column) -> DataFrame:
    """``cols`` of ``docs`` with each row's own name: ``rf`` (its file, hashed) and ``ri`` (its place in it).

    No two rows share a name, whether or not they have an id, and it is the same at each reading. Tables that are
    not read from Parquet files are written first.
    """
    place = (F.xxhash64("_metadata.file_path").alias("rf"), F.col("_metadata.row_index").alias("ri"))
    try:
        return docs.select(*cols, *place)
    except AnalysisException:
        return stash(docs.select(*cols), "rows").select("*", *place)


#: A key is hot if it holds more than this share of all rows, so there are at most 1 / HOT hot keys.
HOT = 1 / 1024


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], hot: Column, by: list[str], how: str = "inner", spread: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key), rows of a ``hot`` key dealt over ``spread`` tasks by a hash of ``by``.

    ``hot`` is a condition on ``table`` that at most 1 / HOT rows meet: their keys are broadcast, and those rows of
    ``table`` repeated for each task. Keys are not null.
    """
    spread = spread or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = table.where(hot).select(*on, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(spread)).cast("int")).otherwise(0)
    left = rows.join(F.broadcast(keys), on, "left").withColumn("_salt", salt).drop("_hot")
    right = table.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory of this worker to the system: idle workers live on beside busy ones."""
    gc.collect(1)  # the young; a full collection walks all that the libraries hold
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def trimmed(run):
    """``run`` (an Arrow batch function) whose worker gives freed memory back when its task ends."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def rounds(at: np.ndarray, size: int = ROUND_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``size`` bytes."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, step in enumerate((_STEP, _BACK)):
            steps = np.full(n, step, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token starts, ends (relative to ``at[0]``) and tokens per text for texts ``data[at[i]:at[i+1]]``."""
    piece, at = data[at[0] : at[-1]], at - at[0]
    word = ~_SPACE[piece]
    edge = np.zeros(len(piece) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False]))
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, at))


def token_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens (case folded) in order, and tokens per text."""
    starts, ends, counts = tokens(data, at)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    piece = data[at[0] : at[-1]]
    up, down = _power(len(piece) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[piece] * up[:-1], dtype=np.uint64)))
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64)), counts


def windows_of(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` tokens inside each text; a text of 1 to n-1 tokens is one run.

    Returns hashes and runs per text.
    """
    key = np.uint64(0xA24BAED4963EE407)
    if len(h) >= n:
        run = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            run = run * key + h[i : len(h) - n + 1 + i]
        run = mix(run)
    else:
        run = np.zeros(0, np.uint64)
    begin = np.cumsum(counts) - counts
    full = np.maximum(counts - n + 1, 0)
    short = (counts > 0) & (counts < n)
    out_counts = np.where(short, 1, full)
    out = np.empty(int(out_counts.sum()), np.uint64)
    base = np.cumsum(out_counts) - out_counts
    src = np.repeat(begin - base, out_counts) + np.arange(len(out))
    ok = np.repeat(~short, out_counts)
    out[ok] = run[src[ok]]
    for i in np.flatnonzero(short):
        v = np.uint64(counts[i])
        for x in h[begin[i] : begin[i] + counts[i]]:
            v = np.uint64((int(v) * int(key) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        out[base[i]] = mix(np.array([v], np.uint64))[0]
    return out, out_counts

