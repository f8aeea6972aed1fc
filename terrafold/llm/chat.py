"""Chat formatting: a finite-state machine over roles and a declarative template.

``segments`` emits, per turn, a header, the escaped body and a footer, each with its loss flag, and
the machine's state. ``digest`` reads the formatted text back and sums it up per conversation.
Conversations are streamed in turn order: a task never holds more than an Arrow batch, however long
one conversation is.

Escaping: a backslash goes before every backslash and before every first character of a control
string inside a text, so no control string survives in a body and unescaping is exact.

Edge cases: null text or role is the empty string; turns are ordered by turn (nulls first), then
role, then text, so ties and repeated rows have one order; a null conversation id is a conversation
of its own. A role without a template entry gets the ``other`` header and moves the machine to
``error`` (its turns are still formatted). An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points that are escaped or unescaped at once, so that long texts take little beside themselves.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Template:
    """Headers per role, the footer, roles that are learned from, and the allowed role changes."""

    headers: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Other [{}]: "
    footer: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",), "error": ()}
    )

    @property
    def special(self) -> str:
        return "".join(dict.fromkeys("\\" + "".join(x[0] for x in (*self.headers.values(), self.other, self.footer)) + "]"))

    def escape(self, text: str) -> str:
        special = re.compile(f"([{re.escape(self.special)}])")
        return "".join(special.sub(r"\\\1", text[i : i + BLOCK]) for i in range(0, len(text), BLOCK))

    def unescape(self, text: str) -> str:
        return "".join(re.sub(r"\\(.)", r"\1", part, flags=re.S) for part in escaped_blocks(text))

    def header(self, role: str) -> str:
        return self.headers.get(role) or self.other.format(self.escape(role))

    def move(self, state: str, role: str) -> str:
        return role if role in self.moves.get(state, ()) else "error"

    def reader(self) -> re.Pattern:
        """Reads one turn: header (with its role), escaped body, footer."""
        # possessive: a body ends at the first special character without a backslash, and nothing is kept for going back
        body = rf"(?P<body>(?:[^{re.escape(self.special)}]++|\\.)*+)"
        known = "|".join(re.escape(h) for h in self.headers.values())
        odd = re.escape(self.other).replace(r"\{\}", rf"(?P<odd>(?:[^{re.escape(self.special)}]++|\\.)*+)")
        return re.compile(rf"(?:(?P<head>{known})|{odd}){body}{re.escape(self.footer)}", re.S)


def escaped_blocks(text: str):
    """Parts of an escaped text; none ends between a backslash and what it escapes."""
    at = 0
    while at < len(text):
        end, n = min(at + BLOCK, len(text)), 0
        while end - n > at and text[end - 1 - n] == "\\":
            n += 1
        end += n % 2
        yield text[at:end]
        at = end


SEGMENTS = "conv_id long, turn_no long, seg_no int, text string, loss boolean, state string"


def ordered(df: DataFrame) -> DataFrame:
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def segments(df: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turn_no, seg_no, text, loss, state; three segments a turn, in order, partitioned by conv_id.

    The concatenated texts of a conversation are its formatted text.
    """

    def run(batches):
        last, state, n, seen = None, "start", 0, False
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not seen or conv != last:
                    last, state, n, seen = conv, "start", 0, True
                state = template.move(state, role)
                parts = (template.header(role), template.escape(text), template.footer)
                for i, part in enumerate(parts):
                    out.append((conv, n, i, part, i == 1 and role in template.loss_roles, state))
                n += 1
            for lo in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 4096]), _TYPES)], names=_NAMES)

    return ordered(df).mapInArrow(run, SEGMENTS)


_NAMES = ["conv_id", "turn_no", "seg_no", "text", "loss", "state"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, error_turn long"


def digest(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """What reading the formatted text back finds, one row per conversation.

    ``parts`` must be as ``segments`` returns it: partitioned by conv_id, in order of conv_id, turn_no and seg_no inside a
    partition. A table that was written or shuffled in between has to be put in that order again.
    """
    roles = {h: r for r, h in template.headers.items()}

    def run(batches):
        read = template.reader()
        last, seen, acc = None, False, None

        def result():
            return {"conv_id": [last], "n_turns": [acc["n"]], "turns_sha256": [acc["turns"].hexdigest()], "loss_chars": [acc["chars"]], "loss_sha256": [acc["loss"].hexdigest()],
                    "formatted_chars": [acc["all"]], "valid": [acc["bad"] is None], "error_turn": [acc["bad"]]}

        rows: list[dict] = []
        turn: list[tuple[str, bool]] = []
        for batch in batches:
            for conv, seg, text, loss, state in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seg_no", "text", "loss", "state"))):
                if not seen or conv != last:
                    if seen:
                        rows.append(result())
                    last, seen = conv, True
                    acc = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "bad": None}
                turn.append((text, loss))
                if seg < 2:
                    continue
                whole = "".join(t for t, _ in turn)
                m = read.fullmatch(whole)
                role = roles[m["head"]] if m["head"] else template.unescape(m["odd"])
                body = template.unescape(m["body"])
                acc["turns"].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                masked = template.unescape("".join(t for t, on in turn if on))
                acc["loss"].update(masked.encode("utf-8", "surrogatepass"))
                acc["chars"] += len(masked)
                acc["all"] += len(whole)
                if state == "error" and acc["bad"] is None:
                    acc["bad"] = acc["n"]
                acc["n"] += 1
                turn = []
            if rows:
                yield _rows(rows)
                rows = []
        if seen:
            yield _rows([result()])

    return parts.mapInArrow(run, DIGEST)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"turns_sha256": pa.string(), "loss_sha256": pa.string(), "valid": pa.bool_()}
    return pa.RecordBatch.from_pydict({k: pa.array([r[k][0] for r in rows], kinds.get(k, pa.int64())) for k in rows[0]})
