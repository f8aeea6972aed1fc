"""N-gram Jaccard join: MinHash banding for candidates, exact Jaccard on full shingle sets for links.

Documents with the same words in the same order form a class, named by a 128-bit digest. Each class has a MinHash signature of ``bands * rows``
values; classes that share a band's hash are candidates. Band and row counts follow from the similarity and a target
recall (``banding``). Candidates are kept as one edge from each class to the least class of its bucket, so a bucket of any size costs
its own length; connected components of these edges hold every candidate pair.

Pairs are verified on full shingle sets. A component of at most ``tile`` classes is one matrix of intersection sizes, so each set travels
once. A larger component is not taken as a whole: each of its buckets is, in tiles of at most ``tile`` classes a side, and a pair counts in
the first band that its classes share, so work follows the buckets and not the square of a chain of near copies. A tile
returns only each class's number of links and edges to the least linked class. Pairs are never listed, yet every candidate pair is decided exactly.

A row is named by its place (``common.placed``), and the text of a class is taken from the row of least place that holds it, so
rows without an id or of equal ids never meet on a common key. Classes with more than ``HOT`` of all rows are joined to their rows with salted keys.

Edge cases: a null or blank text has no shingles: such texts form one class (their words are equal) without other links; a
text of 1 to 4 words is one shingle; texts that differ only in case or white space are one class; repeated rows are copies of each other;
rows without an id take part, and count as the last of their class; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, bounded_batches, hot_join, mix, placed, rounds, stash, text_bytes, token_hashes, trimmed, windows_of
from .components import components


def banding(similarity: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which ``bands * rows <= most`` reach the recall at the similarity."""
    best = (most, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


_SEEDS = np.random.default_rng(77).integers(1, 2**32, (2, 1024), dtype=np.uint32)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """MinHash values of a set of 64-bit shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    a, b = _SEEDS[0, :size, None] | np.uint32(1), _SEEDS[1, :size, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):
        h = (x[None, lo : lo + 2048] ^ b) * a
        h ^= h >> np.uint32(15)
        np.minimum(out, (h * np.uint32(0x85EBCA6B)).min(axis=1), out=out)
    return out


#: A row's place.
PLACE = ["rf", "ri"]


def digest(text: str) -> bytes:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def shingle_sets(texts: pa.Array, n: int):
    """The distinct shingles of each text, sorted."""
    data, at = text_bytes(texts)
    for lo, hi in rounds(at):
        h, counts = windows_of(*token_hashes(data, at[lo : hi + 1]), n)
        cut = np.concatenate(([0], np.cumsum(counts)))
        for i in range(hi - lo):
            yield np.unique(h[cut[i] : cut[i + 1]])


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(rf, ri, doc_id, words, bands) of (rf, ri, doc_id, text): each row's digest of words, and the band hashes of its shingles (null without any)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            bands_of = []
            for s in shingle_sets(batch.column(3), n):
                if len(s):
                    sig = signature(s, bands * rows).astype(np.uint64).reshape(bands, rows)
                    h = np.arange(bands, dtype=np.uint64)
                    for j in range(rows):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
                    bands_of.append(h.view(np.int64))
                else:
                    bands_of.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([digest(t) for t in texts], pa.binary()), pa.array(bands_of, pa.list_(pa.int64()))], names=[*PLACE, "doc_id", "words", "bands"])

    return docs.select(*PLACE, "doc_id", "text").mapInArrow(trimmed(run), "rf long, ri long, doc_id long, words binary, bands array<long>")


def candidates(classes: DataFrame) -> DataFrame:
    """(u, v): an edge from each class to the least class of each of its buckets."""
    x = buckets(classes)
    least = x.groupBy("band", "hash").agg(F.min("cid").alias("v"), F.count("*").alias("n")).where("n > 1")
    return x.join(least, ["band", "hash"]).where("cid <> v").select(F.col("cid").alias("u"), "v").distinct()


def buckets(classes: DataFrame) -> DataFrame:
    return classes.select("cid", F.posexplode("bands").alias("band", "hash"))


def groups_to_verify(classes: DataFrame, comps: DataFrame, tile: int) -> DataFrame:
    """(cid, grp, band, cuts): what each class (of ``comps``: cid, comp) is compared in, and into how many slices that is cut.

    A component of at most ``tile`` classes is one group (band -1); of a larger one, every bucket of two classes or more is a group.
    """
    sizes = comps.groupBy("comp").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") <= tile).select("comp")
    whole = comps.join(small, "comp").select("cid", F.xxhash64("comp").alias("grp"), F.lit(-1).alias("band"), F.lit(1).alias("cuts"))
    large = comps.join(sizes.where(F.col("n") > tile).select("comp"), "comp").select("cid")
    x = buckets(classes.join(large, "cid"))
    cuts = x.groupBy("band", "hash").agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts"), F.count("*").alias("n")).where("n > 1").drop("n")
    return whole.unionByName(x.join(cuts, ["band", "hash"]).select("cid", F.col("hash").alias("grp"), "band", "cuts"))


def link_matrix(sets: list[np.ndarray], top: int, bottom: int) -> np.ndarray:
    """Which pairs of sets have Jaccard similarity >= top / bottom (integer comparison, diagonal false)."""
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    held = np.diff(np.append(first, len(flat)))
    both = np.zeros(m * m, np.int64)
    for d in np.unique(held[held > 1]):
        at = first[held == d]
        if d <= 12:
            rows = owner[at[:, None] + np.arange(d)]
            i, j = np.triu_indices(d, 1)
            for lo in range(0, len(rows), 1 << 16):
                part = rows[lo : lo + (1 << 16)]
                pair, count = np.unique((part[:, i] * m + part[:, j]).ravel(), return_counts=True)
                both[pair] += count
    both = both.reshape(m, m)
    both = both + both.T
    often = np.flatnonzero(held > 12)
    for lo in range(0, len(often), 2048):
        part = often[lo : lo + 2048]
        x = np.zeros((m, len(part)), np.float32)
        for c, f in enumerate(part):
            x[owner[first[f] : first[f] + held[f]], c] = 1
        both += np.rint(x @ x.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    out = bottom * both >= top * union
    np.fill_diagonal(out, False)
    return out


LINKS = "cid long, n long, u long, v long"


def verified(sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(cid, n, u, v): a class's links in one tile (weighted by copies), and an edge to the least class linked there.

    ``sets`` has (grp, band, cuts, cid, copies, bands, shingles), a row for each class and group.
    """
    x = sets.withColumn("cut", F.pmod(F.xxhash64("cid"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    low, high = F.least("cut", "other"), F.greatest("cut", "other")
    tasks = 8 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("grp", "band"), F.lit(tasks))).otherwise(F.xxhash64("grp", "band", low, high))
    x = x.select(task.alias("task"), "grp", "band", low.alias("low"), high.alias("high"), "cut", "cid", "copies", "bands", "shingles")
    none = np.iinfo(np.int64).max

    def one(g: list[tuple]) -> list[tuple]:
        band, low, high = g[0][1:4]
        links = link_matrix([np.frombuffer(r[8], np.uint64) for r in g], *similarity)
        if low != high:
            cut = np.array([r[4] for r in g])
            links &= cut[:, None] != cut[None, :]
        if band > 0:  # a pair that shares an earlier band is counted there
            i, j = np.nonzero(links)
            bands = np.array([r[7][:band] for r in g], np.int64)
            for lo in range(0, len(i), 1 << 16):
                a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                seen = (bands[a] == bands[b]).any(axis=1)
                links[a[seen], b[seen]] = False
        cid, copies = np.array([r[5] for r in g], np.int64), np.array([r[6] for r in g], np.int64)
        near = np.where(links, cid[None, :], none).min(axis=1)
        # an edge to the least linked class keeps a component together: follow least labels inside the tile
        label = np.minimum(cid, near)
        while True:
            new = np.minimum(label, np.where(links, label[None, :], none).min(axis=1))
            if (new == label).all():
                break
            label = new
        n = links @ copies
        return [(int(c), int(k), int(c), int(v)) for c, k, v in zip(cid, n, label) if k]

    def run(batches):
        # rows arrive sorted by task, group and tile: one tile is held at a time
        key, held = None, []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[1:])):
                if row[:4] != key:
                    if len(held) > 1:
                        out += one(held)
                    key, held = row[:4], []
                held.append(row)
            if len(out) > 4096:
                yield _links(out)
                out = []
        if len(held) > 1:
            out += one(held)
        yield _links(out)

    x = x.repartition(max(1, tasks // 2), "task").sortWithinPartitions("task", "grp", "band", "low", "high", "cid")
    return x.mapInArrow(trimmed(run), LINKS)


def _links(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in LINKS.split(", ")])


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``wanted`` (rf, ri, ...) with the shingles of the text at that place."""
    names = [c for c in wanted.columns if c not in PLACE]
    # both sides grow with the input, so neither is broadcast at any size
    x = docs.select(*PLACE, "text").join(wanted.hint("merge"), PLACE).select(*names, "text")

    def run(batches):
        for batch in batches:
            sets = pa.array([s.tobytes() for s in shingle_sets(batch.column(len(names)), n)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sets], names=[*names, "shingles"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields[:-1])
    return x.mapInArrow(trimmed(run), f"{kinds}, shingles binary")


def grouped(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (4, 5), recall: float = 0.9995, tile: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Rows (rf, ri, doc_id, words) of placed ``docs`` (rf, ri, doc_id, text), and classes (words, class_id, n_copies, links, root).

    ``root`` names the group, with or without ids. Both are written tables, or follow from such by joins on keys without hot ones.
    """
    bands, rows = banding(similarity[0] / similarity[1], recall)
    rows_of = stash(sketches(docs, n, bands, rows), "near-sketches")
    classes = rows_of.groupBy("words").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(*PLACE)).alias("at"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    # from here on a class has a number of its own
    classes = stash(classes.select(F.monotonically_increasing_id().alias("cid"), "words", "class_id", "at.*", "copies", "bands"), "near-classes")
    comps = components(candidates(classes)).select(F.col("node").alias("cid"), F.col("root").alias("comp"))
    wanted = stash(classes.join(comps, "cid").select("cid", *PLACE, "copies", "bands"), "near-candidates")
    # one row a class with all its groups (a bucket a band at most): each set is joined once and repeated afterwards
    groups = groups_to_verify(classes, comps, tile).groupBy("cid").agg(F.collect_list(F.struct("grp", "band", "cuts")).alias("groups"))
    sets = sets_of(docs, wanted, n).join(groups.hint("merge"), "cid").select("cid", "copies", "bands", "shingles", F.explode("groups").alias("g")).select("cid", "copies", "bands", "shingles", "g.*")
    links = stash(verified(sets, similarity), "near-links")
    counts = links.groupBy("cid").agg(F.sum("n").alias("links"))
    groups = components(links.select("u", "v")).select(F.col("node").alias("cid"), "root")
    slim = classes.select("cid", "words", "class_id", F.col("copies").alias("n_copies")).join(groups, "cid", "left").join(counts, "cid", "left")
    return rows_of.select(*PLACE, "doc_id", "words"), slim.withColumn("root", F.coalesce("root", "cid")).drop("cid")


def with_class(rows_of: DataFrame, classes: DataFrame) -> DataFrame:
    """Each row with the columns of its class (a written table with words and n_copies)."""
    return hot_join(rows_of, classes, ["words"], F.col("n_copies") > rows_of.count() * HOT, PLACE)


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, class_id, n_copies, n_links, group_id.

    class_id: the least doc_id with the same words. n_links: other rows with similarity >= 4/5, copies counted in.
    group_id: the least class_id of all that links connect it with. Options are those of ``grouped``.
    """
    rows_of, slim = grouped(placed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), **options)
    least = slim.groupBy("root").agg(F.min("class_id").alias("group_id"))
    slim = slim.join(least, "root").select("words", "class_id", "n_copies", (F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "group_id")
    return with_class(rows_of, stash(slim, "near-classes")).select("doc_id", "class_id", "n_copies", "n_links", "group_id")


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group: that of least id (rows without an id come last), and of least place among equal ids."""
    x = placed(docs, F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows_of, classes = grouped(x.select(*PLACE, "doc_id", "text"), **options)
    # the first row of each class, then of each group: what is shuffled is one row a class
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *PLACE)).alias("x")
    keep = rows_of.groupBy("words").agg(first).join(classes.select("words", "root"), "words").groupBy("root").agg(F.min("x").alias("x"))
    keep = stash(keep.select("x.rf", "x.ri"), "near-keep")
    return x.select("row", *PLACE).join(keep.hint("merge"), PLACE, "left_semi").select("row.*")
