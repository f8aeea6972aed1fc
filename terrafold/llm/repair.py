"""Conversation structure repair: a Viterbi search over role states that emits edits as soon as all survivors agree on them.

A conversation is right if its roles' first letters are a system turn or none, then pairs of user and assistant turns, or if it has no rows. Rows are kept, given
another role or deleted, and empty turns are inserted, at least cost; of equally cheap edits the least in ASCII order of their letters (D, I, K, R) wins.

Each state's survivor is a path in a backpointer tree whose nodes count their references: a node that no survivor needs is freed, and once all survivors
share an ancestor, the edits up to it are emitted and freed. A survivor that another state's beats whatever follows is dropped, so that the survivor that
deletes all does not keep the rest from meeting. Tied survivors are compared by their whole unresolved suffixes: these end with the edit of
the same row, so none is the start of another, and their order at the row before and the new edits decide it.
What stays unresolved takes some 300 bytes a row and survivor, and holds no texts: the search reads one letter and the fault of each row, and its edits meet the texts
in a second pass that merges both in order.

Edge cases: null roles and texts are one space; rows of a conversation are ordered by turn (nulls first), then role, then a digest of the text, so ties and repeated
rows have one order; a null conversation id is a conversation of its own; a conversation without rows (``lost``) has no edits. A role that starts with another letter is
never kept. An empty table gives no rows. Extra columns are ignored. The rows of one conversation are read in order by one task, a batch at a time.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, hot_join, stash

#: Bytes that are no character of a turn.
BLANK = r"[\x20\x09-\x0D]"
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, after the system turn, after a user's, after an assistant's; with what follows each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)


@dataclass(frozen=True)
class Costs:
    """What edits cost; ``truncated`` is added for a truncated row that stays."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def turn_of(state: int) -> str:
    """The role that an inserted or renamed row takes after ``state``."""
    return "a" if state == USER else "u"


def inserted(state: int) -> list[tuple[str, int]]:
    """(edits, state) after none, one or two inserted rows; more lead to none but these states at a higher cost."""
    one = NEXT[state][turn_of(state)]
    return [("", state), ("I", one), ("II", NEXT[one][turn_of(one)])]


def row_edits(state: int, letter: str, fault: str, c: Costs) -> list[tuple[str, int, int]]:
    """(edits, cost, state) of all ways to take a row after ``state``: inserted rows come before it."""
    found = []
    for before, at in inserted(state):
        base = c.insert * len(before)
        found.append((before + "D", base + c.delete, at))
        if fault in ("blank", "duplicate"):
            continue
        stays = base + (c.truncated if fault == "truncated" else 0)
        if letter in NEXT[at]:
            found.append((before + "K", stays + c.keep, NEXT[at][letter]))
        found.append((before + "R", stays + c.rerole, NEXT[at][turn_of(at)]))
    return found


@lru_cache
def beaten_by(c: Costs) -> dict[tuple[int, int], int]:
    """By how much state t may be dearer than s and still be as good: what may have to be paid to follow s's best end from t."""
    far = 10**9
    extra = {(s, t): 0 if s == t else far for s in range(4) for t in range(4)}
    extra[START, ASSISTANT] = c.delete  # a system turn that only the start could keep is deleted
    extra[SYSTEM, ASSISTANT] = extra[ASSISTANT, START] = extra[SYSTEM, START] = 0
    for t in range(4):
        s = inserted(t)[1][1]
        extra[s, t] = min(extra[s, t], c.insert)
    for m in range(4):
        for s in range(4):
            for t in range(4):
                extra[s, t] = min(extra[s, t], extra[s, m] + extra[m, t])
    return extra


@lru_cache(1 << 16)
def step(survivors: tuple[tuple[int, int], ...], letter: str, fault: str, c: Costs) -> tuple[int, tuple[tuple[int, int, int, str], ...]]:
    """What a row makes of ``survivors`` ((state, cost above the cheapest) in the order of their edits): (cost of the cheapest, its new survivors).

    A new survivor is (state, cost above the cheapest, place of the one it goes on from, edits), again in the order of all their edits.
    """
    best: dict[int, tuple[int, int, str]] = {}
    for place, (state, cost) in enumerate(survivors):
        for edits, more, to in row_edits(state, letter, fault, c):
            found = (cost + more, place, edits)
            if to not in best or found < best[to]:
                best[to] = found
    extra = beaten_by(c)
    alive = [s for s in best if not any(t != s and best[t][0] + extra[s, t] < best[s][0] for t in best)]
    low = min(best[s][0] for s in alive)
    alive.sort(key=lambda s: best[s][1:])
    return low, tuple((s, best[s][0] - low, best[s][1], best[s][2]) for s in alive)


@lru_cache(1 << 12)
def ending(survivors: tuple[tuple[int, int], ...], c: Costs) -> tuple[int, int, str]:
    """(cost, place of the survivor, last edits) of the cheapest right end."""
    found = [(cost + c.insert * len(edits), place, edits) for place, (state, cost) in enumerate(survivors) for edits, to in inserted(state) if to in ENDS]
    return min(found)


class Search:
    """The edits of one conversation: ``row`` and ``end`` give what has been decided since, (row number, edits) in order."""

    def __init__(self, costs: Costs = Costs()):
        self.costs, self.cost, self.rows = costs, 0, 0
        self.survivors: tuple[tuple[int, int], ...] = ((START, 0),)
        # node: [parent, row, edits, references, xor of its children's numbers]
        self.nodes: dict[int, list] = {0: [-1, -1, "", 1, 0]}
        self.heads, self.root, self.made = [0], 0, 0

    def _release(self, n: int) -> None:
        while n >= 0:
            node = self.nodes[n]
            node[3] -= 1
            if node[3]:
                return
            del self.nodes[n]
            if node[0] >= 0:
                self.nodes[node[0]][4] ^= n
            n = node[0]

    def _decided(self) -> list[tuple[int, str]]:
        out = []
        while self.root not in self.heads and self.nodes[self.root][3] == 1:
            n = self.nodes[self.root][4]  # the only child
            del self.nodes[self.root]
            self.root = n
            node = self.nodes[n]
            node[0] = -1
            out.append((node[1], node[2]))
        return out

    def _advance(self, found) -> None:
        heads = []
        for place, edits in found:
            parent = self.heads[place]
            self.made += 1
            self.nodes[self.made] = [parent, self.rows, edits, 1, 0]
            self.nodes[parent][3] += 1
            self.nodes[parent][4] ^= self.made
            heads.append(self.made)
        for n in self.heads:
            self._release(n)
        self.heads = heads

    def row(self, letter: str, fault: str) -> list[tuple[int, str]]:
        low, found = step(self.survivors, letter, fault, self.costs)
        self.cost += low
        self._advance([x[2:] for x in found])
        self.survivors = tuple(x[:2] for x in found)
        self.rows += 1
        return self._decided()

    def end(self) -> list[tuple[int, str]]:
        more, place, edits = ending(self.survivors, self.costs)
        self.cost += more
        self._advance([(place, edits)])
        return self._decided()


# --- rows in, edits out -----------------------------------------------------------------------------

ORDER = ["conv_id", "last", "turn", "role", "h", "kind", "place"]


def _narrow(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, blank, truncated): what the search needs of the rows that are not lost; ``h`` digests role and text."""
    text = F.col("text")
    return rows.where("not lost").select("conv_id", "turn", "role", _digest(), (~text.rlike("[^\\x20\\x09-\\x0D]")).alias("blank"),
                                         (~text.rlike(f"[.!?]{BLANK}*\\z")).alias("truncated"))


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("h")


def _clean(rows: DataFrame) -> DataFrame:
    lost = F.coalesce("lost", F.lit(False)) if "lost" in rows.columns else F.lit(False)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), lost.alias("lost"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, blank, truncated, repeats): ``repeats`` where a row of an earlier turn has the same role and text.

    Of equal rows of one turn the search takes all but the first as repeated. First turns are found by partial aggregation and joined with hot texts dealt over tasks.
    """
    conv = {"c": F.coalesce("conv_id", F.lit(0)), "cn": F.col("conv_id").isNull()}  # keys of a join are not null
    x = _narrow(rows).withColumns(conv)
    seen = F.struct(F.col("turn").isNotNull().alias("late"), F.col("turn").alias("turn"))
    first = stash(x.groupBy("c", "cn", "h").agg(F.min(seen).alias("first"), F.count("*").alias("copies")).where("copies > 1"), "repair-first")
    total = first.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    x = hot_join(x, first, ["c", "cn", "h"], F.col("copies") > F.lit(max(total, 1) * HOT), ["turn"], "left")
    return x.select("conv_id", "turn", "role", "h", "blank", "truncated", (F.col("copies").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("repeats"))


EDITS = "conv_id long, last int, turn long, role string, h binary, kind int, place long, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def edits(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The edits of each row (``place`` in its conversation; rows inserted before it come first), and for each conversation one row
    (``last`` 1) with the edits after its last row, its counts of faults and the cost."""
    ordered = faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h")

    def run(batches):
        now, conv, seen = None, None, False
        out: list[tuple] = []
        keys: dict[int, tuple] = {}

        def put(decided):
            for n, found in decided:
                out.append((conv, 0, *keys.pop(n), 1, n, found, None, None, None, None, None, None))

        def finish():
            decided = now.end()
            put([x for x in decided if x[0] < now.rows])
            tail = next((e for n, e in decided if n == now.rows), "")
            gaps = high - low + 1 - distinct if low is not None else 0
            out.append((conv, 1, None, "", b"", 1, now.rows, tail, gaps, *counts, now.cost))

        for batch in batches:
            for c, turn, role, h, blank, truncated, repeats in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if not seen or c != conv:
                    if seen:
                        finish()
                    now, conv, seen = Search(costs), c, True
                    counts, low, high, distinct, before = [0, 0, 0, 0], None, None, 0, None
                if turn is not None:
                    distinct += high != turn
                    low, high = turn if low is None else low, turn
                duplicate = repeats or before is not None and before[:3] == (turn, role, h)
                fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else ""
                if fault:
                    counts[("blank", "duplicate", "truncated").index(fault)] += 1
                letter = role[:1]
                if before is not None and before[1][:1] + letter not in ("su", "ua", "au"):
                    counts[3] += 1
                before = (turn, role, h)
                keys[now.rows] = before
                put(now.row(letter if letter in "sua" else "", fault))
            if len(out) > 4096:
                yield _table(out, EDITS)
                out = []
        if seen:
            finish()
        yield _table(out, EDITS)

    return ordered.mapInArrow(run, EDITS)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds)], names=list(names))


REPAIRED = "conv_id long, seq long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def repair(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The edits of each conversation in order, partitioned by conv_id: (seq, edit, role, text), and a last row with its counts, whose ``edit`` is null.

    ``rows``: conv_id, turn, role, text; with a column ``lost``, rows where it is true only name their conversation. Deleted rows have a null role and text.
    """
    rows = _clean(rows)
    found = edits(rows, costs)
    texts = rows.select("conv_id", F.lit(0).alias("last"), "turn", "role", _digest(), F.when(F.col("lost"), -1).otherwise(0).alias("kind"), F.lit(0).cast("long").alias("place"), F.when(~F.col("lost"), F.col("text")).alias("text"))
    both = texts.unionByName(found, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*ORDER)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches):
        conv, seen, n, at, letter, text, role, told = None, False, 0, START, "", None, None, False
        out: list[tuple] = []
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "last", "role", "kind", "text", "edits", *counts)]
            for c, last, r, kind, t, change, *numbers in zip(*cols):
                if not seen or c != conv:
                    if seen and not told:
                        out.append((conv, 0, None, None, None, 0, 0, 0, 0, 0, 0))
                    conv, seen, n, at, told = c, True, 0, START, False
                if kind < 1:
                    role, text = r, t
                    continue
                for e in change:
                    if e == "D":
                        out.append((c, n, e, None, None) + (None,) * 6)
                    else:
                        letter = role[:1] if e == "K" else turn_of(at)
                        at = NEXT[at][letter]
                        out.append((c, n, e, role if e == "K" else ROLES[letter], "" if e == "I" else text) + (None,) * 6)
                    n += 1
                if last:
                    out.append((c, n, None, None, None, *numbers))
                    told = True
            if len(out) > 1024:
                yield _table(out, REPAIRED)
                out = []
        if seen and not told:
            out.append((conv, 0, None, None, None, 0, 0, 0, 0, 0, 0))
        yield _table(out, REPAIRED)

    return both.mapInArrow(run, REPAIRED)


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digest(repaired: DataFrame) -> DataFrame:
    """One row a conversation: counts, cost, the letters of its edits, and the digest of its repaired rows. ``repaired`` as ``repair`` returns it."""

    def run(batches):
        sha, audit, first = hashlib.sha256(), [], True
        for batch in batches:
            out = []
            for conv, _, edit, role, text, *numbers in zip(*(batch.column(i).to_pylist() for i in range(11))):
                if edit is None:
                    out.append((conv, *numbers, "".join(audit), sha.hexdigest()))
                    sha, audit, first = hashlib.sha256(), [], True
                    continue
                audit.append(edit)
                if edit != "D":
                    sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    first = False
            yield _table(out, DIGEST)

    return repaired.mapInArrow(run, DIGEST)


def damage(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): rows with faults put in by crc32 of ``conv_id:turn`` (nulls one space) modulo 20: 0 loses the row, 1 empties its text,
    2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    x = df.select("conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(space("role")).alias("role"), text.alias("text"), (k == 0).alias("lost"), F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return x.drop("_copy")
