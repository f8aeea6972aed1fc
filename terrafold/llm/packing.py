"""Packing token sequences by best-fit decreasing.

Overlong documents are first cut into full windows; what is left of each document (1 to capacity-1
ids) is packed best-fit decreasing. The packer works on the histogram of left-over lengths, which has
at most ``capacity - 1`` entries however large the corpus is: windows of equal free space and equal
history are one class with a count, and a segment tree over free space finds the tightest class that
fits. The outcome is the item-by-item best-fit-decreasing packing of all documents; documents get
their place in it by their rank among documents of the same length.

Edge cases: a null text is empty and holds the end id alone; repeated rows (also of one doc_id) are
packed as documents of their own; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stash, trimmed

#: Segments whose ids a worker keeps, in two generations of half as many: those not asked for again go with the older one.
KEPT = 400_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for a worker process, so that tasks after the first find their words known."""
    return Encoder(path)


class Encoder:
    """Ids of whole texts with a byte-level BPE, reusing the ids of segments seen before.

    Byte-level BPE splits text before it merges, always so at a single space or line feed between
    two characters that aren't white space. Texts with any other white space, or with an added token of the
    vocabulary, are encoded whole.
    """

    def __init__(self, path: str):
        import re

        self.model = _tokenizer(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        # white space of any kind but the space and the line feed
        self.other = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.merger = self._merger()
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def odd(self, t: str) -> bool:
        """Whether a text must be encoded whole."""
        if not t or t[0] in " \n" or t[-1] in " \n" or "  " in t or " \n" in t or "\n " in t or "\n\n" in t or "\0" in t:
            return True
        return self.other.search(t) is not None or any(a in t for a in self.added)

    def _merger(self):
        """The same vocabulary in a merger that is quicker on new words; only if its ids are its merge order."""
        import json

        import public_tokenizers
        import tiktoken

        spec = json.loads(self.model.to_str())["model"]
        vocab = {t: i for t, i in spec["vocab"].items() if t not in self.added}
        made = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in spec["merges"]]
        if spec["type"] != "BPE" or None in made or made != sorted(made):
            return None
        # byte-level vocabularies write printable bytes as they are and number the others from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in plain)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _segments(self, parts: list[str]) -> list[bytes]:
        if self.merger is None:
            return self._encode(parts)
        encode = self.merger.encode_ordinary
        return [array("I", encode(p)).tobytes() for p in parts]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if self.odd(t)]
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        if len(self.seen) > KEPT // 2:
            self.seen, self.older = {}, self.seen
        seen, older = self.seen, self.older
        for i, t in enumerate(texts):
            if out[i] is None:
                # each segment starts with its own space or line feed, but for the first
                parts = t.replace("\n", " \n").replace(" ", "\0 ").replace(" \n", "\n").split("\0")
                new = [p for p in parts if p not in seen]
                if new:
                    new = dict.fromkeys(new)
                    known = {p: older[p] for p in new if p in older}
                    seen.update(known)
                    new = [p for p in new if p not in known]
                    seen.update(zip(new, self._segments(new), strict=True))
                out[i] = b"".join([seen[p] for p in parts])
        return out  # type: ignore[return-value]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every document cut into full windows and a rest: doc_id, start, length, ids_crc32, doc_tokens[, ids]."""
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for i in range(0, len(texts), 64):
                for doc, ids in zip(doc_ids[i : i + 64], encode(texts[i : i + 64]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for lo in range(0, n, capacity):
                        part = ids[4 * lo : 4 * (lo + capacity)]
                        rows.append((doc, lo, len(part) // 4, zlib.crc32(part), n, part if with_ids else None))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), PIECES)
    return out if with_ids else out.drop("ids")


class FreeSpaceTree:
    """Segment tree over free space 0..capacity: which is the least free space >= x that some class has?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, space: int, on: bool) -> None:
        i = space + self.size
        self.any[i] = on
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places as runs (length, first_rank, count, first_window, per_window, first_offset).

    Items ``first_rank + j`` (j < count) of that length lie in window ``first_window + j // per_window``
    at offset ``first_offset + (j % per_window) * length``. Windows are numbered from 0. A class of
    windows is a range of numbers with equal free space.
    """
    tree, free, runs, windows = FreeSpaceTree(capacity), {}, [], 0

    def put(space: int, first: int, count: int) -> None:
        if count and space:
            if not free.setdefault(space, []):
                tree.set(space, True)
            free[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            space = tree.tightest(length)
            if space is None:
                fit = capacity // length
                count = -(-left // fit)
                first, space = windows, capacity
                windows += count
            else:
                first, count = free[space].pop()
                if not free[space]:
                    tree.set(space, False)
                fit = space // length
            full, rest = min(count, left // fit), 0
            if full < count:
                rest = left - full * fit
            taken = full * fit + rest
            runs.append((length, rank, taken, first, fit, capacity - space))
            put(space - fit * length, first, full)
            if rest:
                put(space - rest * length, first + full, 1)
            untouched = count - full - (rest > 0)
            put(space, first + count - untouched, untouched)
            rank, left = rank + taken, left - taken
    return runs


#: Pieces that one task ranks.
RANK_ROWS = 65_536


def pack(parts: DataFrame, capacity: int = 1024, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``parts`` (a written table from ``pieces``) with sequence_id and offset."""
    spark = parts.sparkSession
    names = parts.columns
    buckets = max(1, -(-parts.count() // rank_rows))
    parts = parts.withColumn("_k", F.xxhash64("doc_id", "start", "ids_crc32")).withColumn("_b", F.pmod("_k", F.lit(buckets)).cast("int"))
    # ranks among pieces of equal length, in two levels: a very common length is no single task
    heads = parts.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    heads = stash(heads.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "pack-heads")
    counts = {int(r["length"]): int(r["n"]) for r in heads.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    n_full = counts.pop(capacity, 0)
    runs = best_fit_decreasing(counts, capacity)
    places = [(length, rank, rank + taken, first + n_full, fit, at) for length, rank, taken, first, fit, at in runs] + ([(capacity, 0, n_full, 0, 1, 0)] if n_full else [])
    place = spark.createDataFrame(places, "length long, _from long, _to long, _first long, _fit long, _at long")
    within = Window.partitionBy("length", "_b").orderBy("_k", "doc_id", "start")
    ranked = parts.withColumn("_in", F.row_number().over(within) - 1).join(heads.drop("_n"), ["length", "_b"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    # runs of a length are few; the join key is the length, the run is found by its range of ranks
    runs_of = place.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "_first", "_fit", "_at"))).alias("_runs"))
    out = ranked.join(F.broadcast(runs_of), "length")  # one row a length: at most `capacity` rows
    run = F.filter("_runs", lambda r: (r["_from"] <= F.col("_rank")) & (F.col("_rank") < r["_to"]))[0]
    j = F.col("_rank") - F.col("_run._from")
    out = out.withColumn("_run", run)
    return out.select(*names, (F.col("_run._first") + F.floor(j / F.col("_run._fit"))).cast("long").alias("sequence_id"), (F.col("_run._at") + j % F.col("_run._fit") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    return pack(stash(pieces(docs, tokenizer, capacity, end_id, with_ids), "pack-pieces"), capacity)
