"""Document fingerprints: 128-bit SimHash, and permuted block tables for near fingerprints.

Each distinct word votes with weight ``1 + ln(times)`` on the signed bits of its hash. Likeness of two
fingerprints is the share of equal bits. ``neighbours`` splits fingerprints into ``like + 2`` blocks of bits: two
fingerprints within ``like`` bits agree on two blocks at least, so one table per block (its value the key), searched by
each later block, finds them all. A row gets two counts, of almost equal fingerprints (3 bits) and of those of like texts
(16 bits), and the least id among the latter as their representative. Equal fingerprints are one entry with a weight,
and large buckets are compared in tiles, so no task holds an unbounded bucket.

Texts are sorted by descending id in ranges, so each meets its successor in its own task; the last of a range and the first
of the next are written with the rows and brought together afterwards.

Edge cases: a null or blank text has the all-zero fingerprint; documents of equal id follow each other in
order of a hash of their texts; rows without an id come last; a single document is followed by itself; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, bounded_batches, hot_join, mix, rounds, stash, text_bytes, token_hashes, trimmed

BYTES = 16
_SIGNS = np.where(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) > 0, 1.0, -1.0)


def fingerprints(texts: list[str]) -> np.ndarray:
    """[len(texts), 16] bytes."""
    data, at = text_bytes(pa.array(texts, pa.string()))
    out = np.zeros((len(texts), BYTES), np.uint8)
    for lo, hi in rounds(at):
        h, n = token_hashes(data, at[lo : hi + 1])
        owner = np.repeat(np.arange(hi - lo), n)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))) if len(h) else np.zeros(0, np.int64)
        weight = 1.0 + np.log(np.diff(np.append(new, len(h))))
        h, owner = h[new], owner[new]
        both = np.stack([h, mix(h ^ np.uint64(0xC3A5C85C97CB3127))], 1).view(np.uint8).reshape(-1, BYTES)
        for first in range(0, hi - lo, 256):  # bounded tables of votes
            a, b = np.searchsorted(owner, [first, first + 256])
            m, base = min(256, hi - lo - first), (owner[a:b] - first) * 256
            votes = np.stack([np.bincount(base + both[a:b, i], weight[a:b], m * 256).reshape(m, 256) @ _SIGNS for i in range(BYTES)], 1)
            out[lo + first : lo + first + m] = np.packbits(votes > 1e-9, axis=2).reshape(m, BYTES)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(a ^ b).sum(1) / (8.0 * BYTES)


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


EDGES = ROWS + ", part int, edge string, text string"
RANGE_ROWS = 8192


def row_batch(ids: list, texts: list[str], following: list[str], fps: np.ndarray, next_fps: np.ndarray) -> dict[str, pa.Array]:
    """The columns of ``ROWS`` for texts, what follows them, and the fingerprints of both."""
    edited = [edit(t, f) for t, f in zip(texts, following)]
    efps = fingerprints(edited)
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        "fingerprint": pa.array([f.tobytes().hex() for f in fps], pa.string()),
        "edited_fingerprint": pa.array([f.tobytes().hex() for f in efps], pa.string()),
        "near_edited": pa.array(likeness(fps, efps), pa.float64()),
        "near_next": pa.array(likeness(fps, next_fps), pa.float64()),
    }


def fingerprint_edits(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // range_rows))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("t")]
    x = x.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    names = [c.split()[0] for c in ROWS.split(", ")]

    def edge(part, kind, doc, text):
        blank = {n: pa.nulls(1, k) for n, k in zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))}
        return pa.RecordBatch.from_pydict(blank | {"doc_id": pa.array([doc], pa.int64()), "part": pa.array([part], pa.int32()), "edge": [kind], "text": [text]})

    def run(batches):
        held = part = None  # the last row, which still waits for its successor: (doc_id, text, fingerprint)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            fps = fingerprints(texts)
            if held:
                ids, texts, fps = [held[0], *ids], [held[1], *texts], np.concatenate([held[2][None], fps])
            else:
                part = batch.column(0)[0].as_py()
                yield edge(part, "head", ids[0], texts[0])
            held, n = (ids[-1], texts[-1], fps[-1]), len(ids) - 1
            if n:
                yield pa.RecordBatch.from_pydict(row_batch(ids[:n], texts[:n], texts[1:], fps[:n], fps[1:]) | {"part": pa.array([part] * n, pa.int32()), "edge": pa.nulls(n, pa.string()), "text": pa.nulls(n, pa.string())})
        if held:
            yield edge(part, "tail", held[0], held[1])

    def meet(batches):
        for batch in batches:
            ids, texts, following = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_pydict(row_batch(ids, texts, following, fingerprints(texts), fingerprints(following)))

    found = stash(x.mapInArrow(trimmed(run), EDGES), "simhash-rows")
    # one head and one tail a range; after the last range comes the first
    heads, tails = (found.where(F.col("edge") == e).select("part", "doc_id", "text") for e in ("head", "tail"))
    nexts = heads.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"), F.min("part").over(Window.partitionBy(F.lit(1))).alias("first"))
    nexts = nexts.select("part", F.coalesce("next", "first").alias("next")).join(heads.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")
    last = tails.join(nexts, "part").select("doc_id", "text", "following").mapInArrow(trimmed(meet), ROWS)
    return found.where("edge is null").select(*names).unionByName(last)


#: Bits within which two fingerprints are of like texts: edits that leave a 5-word Jaccard of 0.8 move about 7 to 12 of
#: 128 bits on average (15 at most among the linked pairs of sf0.01), while unrelated texts lie 27 bits or more apart there.
LIKE = 16
#: Compared at once: sides of a matrix of pairs.
SIDE = 1024


def block_ranges(blocks: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of ``blocks`` bit ranges of a fingerprint's two 64-bit words; no range lies in both words."""
    cuts = [[64 * i // half for i in range(half + 1)] for half in (blocks // 2, blocks - blocks // 2)]
    return [(w, lo, hi - lo) for w in range(2) for lo, hi in zip(cuts[w], cuts[w][1:])]


def close_pairs(words: np.ndarray, masks: np.ndarray, table: int, radius: int):
    """(a, b, bits): index pairs, each once, of fingerprints within ``radius`` bits, of a bucket whose rows agree on block ``table``.

    Only pairs that agree on no earlier block count, so of all tables one has the pair. Two within the radius agree
    on a later block too: either runs of rows that agree on one are compared, or all rows, whichever is less.
    """
    n = len(words)

    def checked(a, b, later=None):
        x = words[a] ^ words[b]
        far = np.bitwise_count(x).sum(1)
        ok = np.flatnonzero(far <= radius)
        a, b, x, far = a[ok], b[ok], x[ok], far[ok]
        seen = np.zeros(len(a), bool)
        for k in [*range(table), *range(table + 1, table + 1 if later is None else later)]:
            seen |= ((x & masks[k]) == 0).all(1)
        return a[~seen], b[~seen], far[~seen]

    def square(rows, later=None):
        """All pairs of ``rows``."""
        for i in range(0, len(rows), SIDE):
            for j in range(i, len(rows), SIDE):
                left, right = words[rows[i : i + SIDE]], words[rows[j : j + SIDE]]
                near = np.bitwise_count(left[:, None, 0] ^ right[None, :, 0]) + np.bitwise_count(left[:, None, 1] ^ right[None, :, 1]) <= radius
                a, b = np.nonzero(np.triu(near, 1) if i == j else near)
                yield checked(rows[i + a], rows[j + b], later)

    laters = range(table + 1, len(masks))
    runs = []
    for later in laters if n > 64 else ():
        value = words[:, 0] & masks[later, 0] | words[:, 1] & masks[later, 1]
        order = np.argsort(value, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], value[order][1:] != value[order][:-1])))
        runs.append((later, order, first, np.diff(np.append(first, n))))
    if not runs or sum(int((size * size).sum()) for *_, size in runs) >= n * n:
        yield from square(np.arange(n))
        return
    for later, order, first, size in runs:
        for i in np.flatnonzero(size > 64):
            yield from square(order[first[i] : first[i] + size[i]], later)
        short = np.flatnonzero((size > 1) & (size <= 64))
        end = np.repeat((first + size)[short], size[short])
        at = end - np.repeat(size[short], size[short]) + np.arange(len(end)) - np.repeat(np.cumsum(size[short]) - size[short], size[short])
        step = 1
        while len(at := at[(keep := at + step < end)]):
            end = end[keep]
            yield checked(order[at], order[at + step], later)
            step += 1


def neighbours(prints: DataFrame, radius: int = 3, tile: int = 1 << 16, like: int | None = None) -> DataFrame:
    """(fingerprint, n_near, n_like, like_id, n_rows), one row per distinct fingerprint of ``prints`` (fingerprint: hex; doc_id if there is one).

    n_near, n_like: how many rows lie within ``radius`` and within ``like`` bits (``radius`` by default), itself left out.
    like_id: the least doc_id of all rows within ``like`` bits, its own included; null if none has an id.
    """
    like = radius if like is None else max(radius, like)
    # two within the radius differ in `like` blocks at most: they agree on two or more
    ranges = block_ranges(like + 2)
    masks = np.zeros((len(ranges), 2), np.uint64)
    for i, (word, shift, width) in enumerate(ranges):
        masks[i, word] = np.uint64(((1 << width) - 1) << shift)
    doc = F.col("doc_id").cast("long") if "doc_id" in prints.columns else F.lit(None).cast("long")
    words = [F.conv(F.substring("fingerprint", 1 + 16 * i, 16), 16, -10).cast("long").alias(f"w{i}") for i in range(2)]
    entries = stash(prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(doc).alias("id")).select(*words, "n", "id"), "simhash-prints")
    block = F.array(*(F.shiftrightunsigned(f"w{w}", s).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for w, s, n in ranges))
    tables = entries.select("*", F.posexplode(block).alias("table", "block"))
    # bounded by the blocks and their widths, whatever the input: broadcast
    crowds = tables.groupBy("table", "block").agg(F.count("*").alias("size")).where("size > 1").withColumn("cuts", F.ceil(F.col("size") / tile).cast("int"))
    x = tables.join(F.broadcast(stash(crowds, "simhash-crowds")), ["table", "block"]).withColumn("cut", F.pmod(F.xxhash64("w0", "w1"), F.col("cuts")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    # small buckets share a group; a tile of a large bucket is a group of its own
    low, high = F.least("cut", "other").alias("low"), F.greatest("cut", "other").alias("high")
    groups = max(8, entries.count() * len(ranges) // 16384)
    task = F.when(F.col("size") < 8192, F.pmod(F.xxhash64("table", "block"), F.lit(groups))).otherwise(F.xxhash64("table", "block", low, high)).alias("task")
    x = x.select(task, "table", "block", low, high, "cut", "w0", "w1", "n", "id")
    none = np.iinfo(np.int64).max

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf["id"] = pdf["id"].astype("Int64").fillna(none).astype(np.int64)
        for (table, _, low, high), g in pdf.groupby(["table", "block", "low", "high"], sort=False):
            fp = g[["w0", "w1"]].to_numpy(np.int64).view(np.uint64)
            n, cut, doc = g["n"].to_numpy(np.int64), g["cut"].to_numpy(), g["id"].to_numpy()
            near, alike, least = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64), np.full(len(g), none)
            for a, b, bits in close_pairs(np.ascontiguousarray(fp), masks, table, like):
                if low != high:
                    apart = cut[a] != cut[b]
                    a, b, bits = a[apart], b[apart], bits[apart]
                for own, far in ((a, b), (b, a)):
                    np.add.at(alike, own, n[far])
                    np.add.at(near, own, np.where(bits <= radius, n[far], 0))
                    np.minimum.at(least, own, doc[far])
            hit = np.flatnonzero(alike)
            out.append(pd.DataFrame({"w0": fp[hit, 0].view(np.int64), "w1": fp[hit, 1].view(np.int64), "near": near[hit], "alike": alike[hit], "least": least[hit]}))
        out = pd.concat(out)
        return out.groupby(["w0", "w1"], as_index=False).agg({"near": "sum", "alike": "sum", "least": "min"})

    # a fixed number of tasks: groups are few rows but much work
    tasks = min(groups, 4 * int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = x.repartition(tasks, "task").groupBy("task").applyInPandas(compare, "w0 long, w1 long, near long, alike long, least long")
    found = found.groupBy("w0", "w1").agg(F.sum("near").alias("near"), F.sum("alike").alias("alike"), F.min("least").alias("least"))
    count = lambda c: (F.col("n") - 1 + F.coalesce(c, F.lit(0)))
    fingerprint = F.lower(F.concat(*(F.lpad(F.hex(f"w{i}"), 16, "0") for i in range(2)))).alias("fingerprint")
    like_id = F.least("id", F.nullif("least", F.lit(none))).alias("like_id")
    return entries.join(found, ["w0", "w1"], "left").select(fingerprint, count("near").alias("n_near"), count("alike").alias("n_like"), like_id, F.col("n").alias("n_rows"))


def fingerprint_all(docs: DataFrame, radius: int = 3, like: int = LIKE, range_rows: int = RANGE_ROWS) -> DataFrame:
    rows = fingerprint_edits(docs, range_rows)  # written but for one row a range
    found = stash(neighbours(rows.select("doc_id", "fingerprint"), radius, like=like), "simhash-near")
    # a very common text has one fingerprint
    found = hot_join(rows, found, ["fingerprint"], F.col("n_rows") > rows.count() * HOT, ["doc_id", "edited_sha256"])
    return found.select(*(c.split()[0] for c in ROWS.split(", ")), "n_near", "n_like", "like_id")
