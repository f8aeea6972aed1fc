"""Language-model scoring with a log-frequency Bloom filter over quantised n-gram counts.

An n-gram model of ``ORDER`` (2: bigrams) with hierarchical smoothing: ``P(w) = (c(w) + 1) / (N + V + 1)`` and, from order to order,
``P(w|u) = (c(u,w) + k * P(w|shorter u)) / (c(u) + k)``, where ``k = 1 + c(u) ** 0.6`` stands for the different tokens seen after ``u``.
The counts of all orders, over all training documents, are quantised to levels that grow by ``GROWTH``; an n-gram of level ``q`` is in the
filter as (n-gram, 1) ... (n-gram, q), and is read back by probing level after level. All probes of an
entry fall into one 64-bit word, so a probe is one look into memory; more bits an entry make up for it
(under 1% false positives). A count read back is clamped by those of its context and of its shorter n-gram, so
that no probability passes 1 and a false positive after an unseen context counts for nothing.

Counting: tasks emit sorted blocks of (hash, count) per hash bucket; buckets are summed
and turned into filter blocks by the tasks that hold them. The number of buckets follows the number
of documents, so a task's share stays the same; a block that a task emits is an ever smaller part of its
bucket, down to a key a row, which is an ordinary shuffle of pre-aggregated counts. Where buckets are many, blocks are first merged in groups, so that a
bucket with a very common n-gram never gets a row from every task.

The filter is broadcast. Beyond ``round_bytes`` it goes in rounds, each a range of buckets: the distinct n-grams of every chunk of documents are
written once, by round; a round reads its own n-grams only and writes their levels, and the levels join the documents at the end. So texts are
not written again, each n-gram is probed once, memory is bounded and no n-gram is dropped however large the corpus.

The exact baseline needs each token's exact count: each chunk asks the buckets for the counts of
its own vocabulary and gets one dictionary back, to which its documents are joined. A chunk is ``CHUNK_ROWS`` neighbouring rows of a
file, or fewer long ones: rows of like length share chunks of at most ``CHUNK_BYTES`` of text (a longer text is a chunk of its own).

Edge cases: a null text is empty and holds the end token alone; a null doc_id is a training row (its hash has no remainder);
repeated rows count and are scored each; an empty table gives no rows; with no training document
all counts are 0 and every token has probability 1 / (N + V + 1) = 1; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, mix, placed, rounds, stash, text_bytes, token_hashes, trimmed

GROWTH = 1.2
BITS, PROBES = 13, 6
ORDER = 2
#: Also the context of a text's first token: both are seen once a text.
END = np.uint64(0x51ED270B7A4B3C9D)
GRAM, COUNT = 0, 1
FLUSH = 1_000_000
#: Documents a hash bucket, and buckets up to which blocks go straight to their bucket.
BUCKET_DOCS, DIRECT_BITS = 1024, 12
CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 26
STRIDE = 6


def _levels() -> tuple[np.ndarray, np.ndarray]:
    first = [1]
    while first[-1] < 1 << 40:
        first.append(max(first[-1] + 1, int(first[-1] * GROWTH)))
    f = np.array(first, np.float64)
    return f, np.concatenate(([0.0], np.sqrt(f[:-1] * np.maximum(f[:-1], f[1:] - 1)), f[-1:]))


FIRST, VALUE = _levels()


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(FIRST, counts, "right")


def planes(a: np.ndarray) -> bytes:
    """Byte planes of 64-bit numbers, compressed unless few: high bytes that are alike take little room."""
    raw = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return b"\1" + len(a).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True) if len(a) >= 64 else b"\0" + raw


def unplanes(b: bytes) -> np.ndarray:
    raw = pa.decompress(b[5:], 8 * int.from_bytes(b[1:5], "little"), "zstd", asbytes=True) if b[0] else b[1:]
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def steps(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys as the steps between them, whose high bytes are empty."""
    return planes(np.diff(sorted_keys, prepend=np.uint64(0)))


def unsteps(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b), dtype=np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    k = keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(counts[order], first)


def token_stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with one end token after each text, and tokens per text."""
    h, n = token_hashes(data, at)
    out = np.empty(len(h) + len(n), np.uint64)
    ends = np.cumsum(n + 1) - 1
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = h, END
    return out, n + 1


def grams(stream: np.ndarray, n: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For orders 2 to ``order``: keys (48-bit fingerprints in the upper bits) of the n-grams that end at each token, and which tokens have one.

    A text's first token has the end token before it; an n-gram reaches no further back.
    """
    out, last, place = [], stream, np.arange(len(stream)) - np.repeat(np.cumsum(n) - n, n)
    for m in range(2, order + 1):
        before = np.concatenate(([END], last[:-1])) if len(last) else last
        before = np.where(place == 0, END, before)
        last = mix(before * np.uint64(0x9E3779B97F4A7C15) + stream + np.uint64(m - 2))
        out.append((last & np.uint64(0xFFFFFFFFFFFF0000), place >= m - 2))
    return out


@dataclass
class Filter:
    """Filter blocks of the buckets from ``first`` on, side by side in 64-bit words; ``size[kind, bucket]`` is 0 where there is none."""

    shift: int
    first: int
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def holds(self, kind: int, keys: np.ndarray, level: int) -> np.ndarray:
        """Which keys pass all probes at this level (places)."""
        bucket = (keys >> np.uint64(self.shift)).astype(np.int64) - self.first
        size = self.size[kind][bucket]
        word, mask = probes(keys, size, kind, level)
        found = self.data[word + self.start[kind][bucket]]
        return np.flatnonzero(((found & mask) == mask) & (size > 0))

    def level(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Levels read by probing 1, 2, 3, then every STRIDE-th, then one by one inside the last stride."""
        out = np.zeros(len(keys), np.uint8)
        alive, q = np.arange(len(keys)), 0
        for nxt in [1, 2, 3, *range(3 + STRIDE, len(FIRST) + 1, STRIDE)]:
            hit = self.holds(kind, keys[alive], nxt)
            if nxt - q > 1:
                stopped = np.delete(alive, hit)
                for mid in range(q + 1, nxt):
                    stopped = stopped[self.holds(kind, keys[stopped], mid)] if len(stopped) else stopped
                    out[stopped] = mid
            alive, q = alive[hit], nxt
            out[alive] = nxt
            if not len(alive):
                break
        return out


def probes(keys: np.ndarray, words: np.ndarray, kind: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (key, level): its word among ``words`` and the PROBES bits it has there; keys are well mixed already."""
    odd = mix(np.array([kind * 1000 + level], np.uint64)) | np.uint64(1)
    a = keys * odd
    a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    bits = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    mask = np.uint64(1) << (bits >> np.uint64(58))
    for i in range(1, PROBES):
        mask |= np.uint64(1) << ((bits >> np.uint64(58 - 6 * i)) & np.uint64(63))
    return ((a >> np.uint64(32)) * words) >> np.uint64(32), mask


def build_block(kind: int, keys: np.ndarray, counts: np.ndarray) -> bytes:
    q = level_of(counts)
    data = np.zeros(max(1, -(-int(q.sum()) * BITS // 64)), np.uint64)
    for level in range(1, int(q.max(initial=0)) + 1):
        word, mask = probes(keys[q >= level], np.uint64(len(data)), kind, level)
        np.bitwise_or.at(data, word.astype(np.int64), mask)
    return data.astype("<u8").tobytes()


PART = "kind int, bucket int, chunk long, keys binary, counts binary"
NAMES = [c.split()[0] for c in PART.split(", ")]


def parts_of(kind: int, chunk: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """A row for each bucket that sorted keys fall into."""
    cut = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
    rows = np.flatnonzero(cut[:-1] < cut[1:])
    part = lambda a, to: pa.array([to(a[cut[i] : cut[i + 1]]) for i in rows], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array(rows, pa.int32()), pa.array([chunk] * len(rows), pa.int64()), part(keys, steps), part(counts, planes)], names=NAMES)


class Chunks:
    """What rows of open chunks have gathered: rows of one room (length class) come chunk after chunk."""

    def __init__(self, finish):
        self.open: dict[int, tuple[int, list]] = {}
        self.finish = finish

    def add(self, room: int, chunk: int, item):
        """The finished chunk that this row's one replaces, if any."""
        done = self.finish(*self.open.pop(room)) if room in self.open and self.open[room][0] != chunk else None
        self.open.setdefault(room, (chunk, []))[1].append(item)
        return done

    def rest(self):
        for chunk, items in self.open.values():
            yield self.finish(chunk, items)


def by_chunk(chunks: np.ndarray, rooms: np.ndarray):
    """(room, chunk, rows of it) in order of first appearance."""
    for chunk in dict.fromkeys(chunks.tolist()):
        rows = chunks == chunk
        yield int(rooms[np.argmax(rows)]), chunk, rows


def _count_words(bits: int):
    """Each chunk's vocabulary with training counts."""

    def finish(chunk, words):
        return parts_of(COUNT, chunk, *summed(*(np.concatenate(x) for x in zip(*words))), bits)

    def run(batches):
        held = Chunks(finish)
        for batch in batches:
            chunks, rooms, train = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            data, at = text_bytes(batch.column(3))
            for lo, hi in rounds(at):
                stream, n = token_stream(data, at[lo : hi + 1])
                learned = np.repeat(train[lo:hi].astype(np.uint64), n)
                for room, chunk, rows in by_chunk(chunks[lo:hi], rooms[lo:hi]):
                    own = np.repeat(rows, n)
                    done = held.add(room, chunk, summed(stream[own], learned[own]))
                    if done is not None:
                        yield done
                    words = held.open[room][1]
                    if sum(len(w[0]) for w in words) > FLUSH:
                        words[:] = [summed(*(np.concatenate(x) for x in zip(*words)))]
        yield from held.rest()

    return run


def _count_grams(bits: int, order: int):
    """N-grams of training documents; ``chunk`` is a number that spreads the blocks of a bucket."""

    def run(batches):
        held, size, spread = [], 0, 0
        for batch in batches:
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            data, at = text_bytes(batch.column(3))
            for lo, hi in rounds(at):
                stream, n = token_stream(data, at[lo : hi + 1])
                learned = np.repeat(train[lo:hi], n)
                spread = spread or int(stream[0]) >> 1
                keys = np.concatenate([k[has & learned] for k, has in grams(stream, n, order)])
                held.append(summed(keys, np.ones(len(keys), np.uint64)))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield parts_of(GRAM, spread, *summed(*(np.concatenate(x) for x in zip(*held))), bits)
                    held, size, spread = [], 0, spread + 1
        if held:
            yield parts_of(GRAM, spread, *summed(*(np.concatenate(x) for x in zip(*held))), bits)

    return run


OUT = "kind int, bucket int, chunk long, keys binary, counts binary, tokens long, words long"


def _row(kind, bucket, chunk=0, keys=None, counts=None, tokens=0, words=0):
    return {"kind": kind, "bucket": bucket, "chunk": chunk, "keys": keys, "counts": counts, "tokens": tokens, "words": words}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def _total(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([unsteps(b) for b in pdf["keys"]]), np.concatenate([unplanes(b) for b in pdf["counts"]]))


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Several blocks of one bucket as one."""
    keys, counts = _total(pdf)
    row = (int(pdf["kind"].iloc[0]), int(pdf["bucket"].iloc[0]), int(pdf["chunk"].min()), steps(keys), planes(counts))
    give_back()
    return pd.DataFrame([row], columns=NAMES)


def _gram_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket of n-grams: its filter block."""
    out = _frame([_row(10 + GRAM, int(pdf["bucket"].iloc[0]), keys=build_block(GRAM, *_total(pdf)))])
    give_back()
    return out


def _word_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket of tokens: its filter block, and each chunk's own counts back to it."""
    bucket, (k, c) = int(pdf["bucket"].iloc[0]), _total(pdf)
    seen = c > 0
    rows = [_row(10 + COUNT, bucket, keys=build_block(COUNT, k[seen], c[seen]), tokens=int(c.sum()), words=int(seen.sum()))]
    for chunk, keys in zip(pdf["chunk"], pdf["keys"]):
        rows.append(_row(COUNT, bucket, chunk, keys, planes(c[np.searchsorted(k, unsteps(keys))])))
    give_back()
    return _frame(rows)


@dataclass
class Model:
    """Counts of a corpus: ``table`` holds filter blocks (kind >= 10) and chunk dictionaries (kind COUNT)."""

    table: DataFrame
    docs: DataFrame
    bits: int
    order: int
    tokens: int
    words: int
    size: int

    def ranges(self, round_bytes: int) -> list[tuple[int, int]]:
        """Ranges of buckets whose filter blocks hold about ``round_bytes`` (or one bucket): hashes spread evenly."""
        n = min(1 << self.bits, max(1, -(-self.size // round_bytes)))
        cut = [(i << self.bits) // n for i in range(n + 1)]
        return list(zip(cut[:-1], cut[1:]))

    def filter(self, lo: int, hi: int) -> Filter:
        """The filter over buckets lo to hi - 1."""
        blocks = self.table.where((F.col("kind") >= 10) & F.col("bucket").between(lo, hi - 1))
        data = np.zeros(max(1, (blocks.agg(F.sum(F.length("keys"))).first()[0] or 0) // 8), np.uint64)
        start, size, at = np.zeros((2, hi - lo), np.uint64), np.zeros((2, hi - lo), np.uint64), 0
        for row in blocks.select("kind", "bucket", "keys").toLocalIterator():
            block, where = np.frombuffer(row["keys"], "<u8"), (row["kind"] - 10, row["bucket"] - lo)
            data[at : at + len(block)] = block
            start[where], size[where] = at, len(block)
            at += len(block)
        return Filter(64 - self.bits, lo, data, start, size)


def prepare(docs: DataFrame, is_training) -> DataFrame:
    """chunk, room, training, text, doc_id: ``CHUNK_ROWS`` neighbouring rows of a file make a chunk, or fewer where texts are long."""
    text = F.col("text").cast("string")
    x = placed(docs, F.col("doc_id").cast("long").alias("doc_id"), is_training.alias("training"), text.alias("text"))
    short = (CHUNK_BYTES // CHUNK_ROWS).bit_length() - 1
    # powers of 4: few long rows lie scattered, and each chunk has a dictionary of its own
    room = F.greatest(2 * F.ceil(F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1.0) / 2), F.lit(short)).cast("int")
    rows = F.greatest(F.lit(1), F.call_function("shiftright", F.lit(CHUNK_BYTES), F.least("room", F.lit(CHUNK_BYTES.bit_length() - 1))))
    return x.withColumn("room", room).select(F.xxhash64("rf", "room", F.floor(F.col("ri") / rows)).alias("chunk"), "room", "training", "text", "doc_id")


def learn(docs: DataFrame, is_training, order: int = ORDER, bucket_docs: int = BUCKET_DOCS, direct_bits: int = DIRECT_BITS) -> Model:
    """Count ``docs`` (doc_id, text); ``is_training`` says which rows to learn from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = prepare(docs, is_training)
    bits = max(4, int(np.ceil(np.log2(max(1, docs.count()) / bucket_docs + 1))))
    # texts are read once for words and once for longer n-grams: cheaper than keeping the parts of both in a table
    parts = lambda run: rows.select("chunk", "room", "training", "text").mapInArrow(trimmed(run), PART)
    blocks = parts(_count_grams(bits, order))
    if bits > direct_bits:
        blocks = blocks.groupBy("bucket", F.pmod("chunk", F.lit(1 << (bits - direct_bits)))).applyInPandas(_merge, PART)
    blocks = stash(blocks.groupBy("bucket").applyInPandas(_gram_block, OUT), "lm-grams")
    words = stash(parts(_count_words(bits)).groupBy("bucket").applyInPandas(_word_block, OUT), "lm-words")
    n = words.agg(F.sum("tokens").alias("t"), F.sum("words").alias("w")).first()
    table = words.unionByName(blocks)
    size = table.where("kind >= 10").agg(F.sum(F.length("keys"))).first()[0] or 0
    return Model(table, rows, bits, order, int(n.t or 0), int(n.w or 0), size)


def log_probability(values: list[np.ndarray], n: np.ndarray, tokens: int, words: int) -> np.ndarray:
    """log10 probability of each token; ``values[m - 1]`` are the counts of the n-grams of order m that end at each token."""
    first = np.cumsum(n) - n
    lower = np.minimum(values[0], tokens)
    p = (lower + 1) / (tokens + words + 1)
    for m, count in enumerate(values[1:], 2):
        context = np.concatenate(([0.0], lower[:-1])) if len(lower) else lower
        context[first] = lower[first + n - 1] if m == 2 else 0.0  # the end token stands before the first
        count = np.minimum(count, np.minimum(context, lower))
        k = 1 + context**0.6
        p = (count + k * p) / (context + k)
        lower = count
    return np.log10(p)


def values_of(stream: np.ndarray, n: np.ndarray, order: int, level) -> list[np.ndarray]:
    """Counts of the n-grams of each order at each token, from ``level(kind, sorted distinct keys)``."""
    u, inverse = np.unique(stream, return_inverse=True)
    out = [VALUE[level(COUNT, u)][inverse]]
    for keys, has in grams(stream, n, order):
        u, inverse = np.unique(keys, return_inverse=True)  # in order: probes of neighbouring keys fall into the same filter block
        out.append(np.where(has, VALUE[level(GRAM, u)][inverse], 0.0))
    return out


def per_text(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.cumsum(n) - n) if len(n) else np.zeros(0, x.dtype)


def levels_by_chunk(model: Model, ranges: list[tuple[int, int]], spark) -> DataFrame:
    """(kind, chunk, keys, counts): the levels of every chunk's n-grams, round by round."""
    bits, order = model.bits, model.order
    starts = np.array([lo for lo, _ in ranges])

    def asks(batches):
        def finish(chunk, items):
            rows = []
            for kind in (COUNT, GRAM):
                keys = np.unique(np.concatenate([x[kind] for x in items]))
                turn = np.searchsorted(starts, (keys >> np.uint64(64 - bits)).astype(np.int64), "right") - 1
                rows += [(int(i), kind, chunk, steps(keys[turn == i])) for i in np.unique(turn)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["round", "kind", "chunk", "keys"])

        held = Chunks(finish)
        for batch in batches:
            chunks, rooms = (batch.column(i).to_numpy() for i in (0, 1))
            data, at = text_bytes(batch.column(3))
            for lo, hi in rounds(at):
                stream, n = token_stream(data, at[lo : hi + 1])
                keys = grams(stream, n, order)
                for room, chunk, rows in by_chunk(chunks[lo:hi], rooms[lo:hi]):
                    own = np.repeat(rows, n)
                    item = {COUNT: np.unique(stream[own]), GRAM: np.unique(np.concatenate([k[has & own] for k, has in keys]))}
                    done = held.add(room, chunk, item)
                    if done is not None:
                        yield done
        yield from held.rest()

    asked = model.docs.select("chunk", "room", "training", "text").mapInArrow(trimmed(asks), "round int, kind int, chunk long, keys binary")
    asked = stash(asked, "lm-asked", "round")

    def answers(shared):
        def run(batches):
            for batch in batches:
                kinds, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                found = [pa.compress(shared.value.level(k, unsteps(b)).tobytes(), "zstd", asbytes=True) for k, b in zip(kinds, keys)]
                yield pa.RecordBatch.from_arrays([pa.array([20 + k for k in kinds], pa.int32()), batch.column(1), batch.column(2), pa.array(found, pa.binary())], names=["kind", "chunk", "keys", "counts"])

        return run

    out = None
    for i, (lo, hi) in enumerate(ranges):
        shared = spark.sparkContext.broadcast(model.filter(lo, hi))
        part = stash(asked.where(F.col("round") == i).select("kind", "chunk", "keys").mapInArrow(trimmed(answers(shared)), "kind int, chunk long, keys binary, counts binary"), "lm-levels")
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_all(model: Model, round_bytes: int = 192 << 20) -> DataFrame:
    """Model and exact add-one unigram scores of every document of the model's corpus."""
    tokens, words, order = model.tokens, model.words, model.order
    spark = model.docs.sparkSession
    ranges = model.ranges(round_bytes)
    shared = spark.sparkContext.broadcast(model.filter(*ranges[0])) if len(ranges) == 1 else None

    def pack(batches):
        """Rows of a chunk travel as one compressed block, scored if the whole filter is here."""
        for batch in batches:
            if shared:
                data, at = text_bytes(batch.column(3))
                score = [np.zeros(0)]
                for lo, hi in rounds(at, 1 << 19):
                    stream, n = token_stream(data, at[lo : hi + 1])
                    score.append(per_text(log_probability(values_of(stream, n, order, shared.value.level), n, tokens, words), n))
                score = pa.array(np.concatenate(score))
            else:
                score = pa.nulls(batch.num_rows, pa.float64())
            ids = batch.column(0).to_numpy()
            batch = pa.RecordBatch.from_arrays([batch.column(4), batch.column(2), batch.column(3), score], names=["doc_id", "training", "text", "score"])
            chunks, blocks = list(dict.fromkeys(ids.tolist())), []
            for chunk in chunks:
                part, sink = batch.filter(pa.array(ids == chunk)), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                blocks.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blocks, pa.binary())], names=["chunk", "rows"])

    def run(docs: pa.Table, own: pa.Table) -> pa.Table:
        found = {}
        for kind, read in ((COUNT, unplanes), (20 + COUNT, None), (20 + GRAM, None)):
            rows = own.filter(pc.equal(own["kind"], kind)) if docs.num_rows else own.slice(0, 0)
            keys = [unsteps(b) for b in rows["keys"].to_pylist()]
            if read:
                values = [unplanes(b) for b in rows["counts"].to_pylist()]
            else:
                values = [np.frombuffer(pa.decompress(b, len(k), "zstd", asbytes=True), np.uint8) for k, b in zip(keys, rows["counts"].to_pylist())]
            keys, values = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, values))
            order_ = np.argsort(keys)
            found[kind] = keys[order_], values[order_]
        level = lambda kind, keys: found[20 + kind][1][np.searchsorted(found[20 + kind][0], keys)]
        out = []
        for block in docs["rows"]:  # one block's texts at a time
            for part in pa.ipc.open_stream(block.as_buffer()):
                data, at = text_bytes(part["text"])
                total, known, base, score = [], [], [], []
                for lo, hi in rounds(at):
                    stream, n = token_stream(data, at[lo : hi + 1])
                    c = found[COUNT][1][np.searchsorted(found[COUNT][0], stream)]
                    total.append(n)
                    known.append(per_text((c > 0).astype(np.int64), n))
                    base.append(per_text(np.log10((c + 1.0) / (tokens + words + 1.0)), n))
                    if not shared:
                        score.append(per_text(log_probability(values_of(stream, n, order, level), n, tokens, words), n))
                held_out, score = pc.invert(part["training"]), pa.array(np.concatenate(score)) if score else part["score"]
                out.append([part["doc_id"], held_out, *(pa.array(np.concatenate(x), pa.int64()) for x in (total, known)), pa.array(np.full(part.num_rows, tokens), pa.int64()), pa.array(np.concatenate(base)), score])
        give_back()
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.chunked_array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in RESULT.split(", ")])

    asked = model.table.where(F.col("kind") == COUNT).select("kind", "chunk", "keys", "counts")
    if not shared:
        asked = asked.unionByName(levels_by_chunk(model, ranges, spark))
    packed = model.docs.mapInArrow(trimmed(pack), "chunk long, rows binary")
    return packed.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(run, RESULT)
