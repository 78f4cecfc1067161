"""Chat formatting with typed content parts (operator 8).

A turn's content is a text or a list of typed parts. A visitor flattens text, image, audio and
document parts into one string with ordered placeholders, and records for each attachment its
placeholder's position, its reference and the tokens it expands to. Turns become

    ### <role>: <content> </turn>\n

Control strings inside roles and texts are escaped, so the output reads back without loss, and the loss
mask spans the assistant's content alone.

Formatting is a map over rows. Digests parse the formatted conversation itself: its text arrives in pieces from sorted
partitions, a reader finds the turns in the stream whatever the pieces are, and running hashes take them, so a conversation
of any length needs the memory of its longest turn; it is still one task's work, as its digest is one sequence.

Edge cases: null text and null role count as empty; null conv_ids are one conversation; turns tie in
the order of their formatted text, null turns first; repeated rows are repeated turns; an empty
table gives an empty result; other columns are never read. Unknown part types raise ValueError.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import tune

OPEN, CLOSE, AFTER_ROLE = "### ", " </turn>\n", ": "
#: Escapes of the control strings. `:` matters in roles only.
ESCAPES = {"\\": "\\b", "###": "\\h", "</turn>": "\\e"}
_TAG = re.compile(r"<(?=(?:image|audio|document) \d+>)")
_FIND = re.compile(r"\\|###|</turn>|<(?=(?:image|audio|document) \d+>)")
_BACK = {"b": "\\", "h": "###", "e": "</turn>", "l": "<", "c": ":"}
_ESCAPED = re.compile(r"\\([bhelc])")
ASSISTANT = "assistant"
#: Tokens that attachments expand to: image patches of 28 x 28 pixels, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE = 28, 25, 512


def escape(text: str | None) -> str:
    return _FIND.sub(lambda m: ESCAPES.get(m[0], "\\l"), text or "")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


@dataclass
class Flat:
    """A flattened content: escaped text with placeholders, and attachments (kind, ref, offset, tokens) in order."""

    text: str = ""
    attachments: list[tuple[str, str, int, int]] = field(default_factory=list)


class Flattener:
    """Visitor of typed parts: a method for each type."""

    def __init__(self):
        self.out = Flat()

    def visit(self, part: dict) -> None:
        kind = part.get("type")
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown content part: {kind!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.out.text += escape(part.get("text"))

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * FRAMES))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * PAGE)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.attachments.append((kind, part.get("ref") or "", len(self.out.text), tokens))
        self.out.text += f"<{kind} {len(self.out.attachments) - 1}>"


def flatten(content: str | list[dict] | None) -> Flat:
    """A text or a list of parts, flattened. Texts that meet could form a control string, so they are joined first."""
    visitor = Flattener()
    parts: list[dict] = []
    for part in [{"type": "text", "text": content}] if content is None or isinstance(content, str) else content:
        if part.get("type") == "text" and parts and parts[-1].get("type") == "text":
            parts[-1] = {"type": "text", "text": (parts[-1].get("text") or "") + (part.get("text") or "")}
        else:
            parts.append(part)
    for part in parts:
        visitor.visit(part)
    return visitor.out


def format_turn(role: str | None, content: str | list[dict] | None) -> tuple[str, int, int, Flat]:
    """The formatted turn, the span of its loss mask (0, 0 for others than the assistant) and its flat content."""
    flat = flatten(content)
    head = OPEN + escape(role).replace(":", "\\c") + AFTER_ROLE
    span = (len(head), len(head) + len(flat.text)) if role == ASSISTANT else (0, 0)
    return head + flat.text + CLOSE, *span, flat


def read_turn(turn: str) -> tuple[str, str]:
    """Role and text behind a formatted turn; placeholders stay as they are."""
    role, _, rest = turn[len(OPEN) :].partition(AFTER_ROLE)
    return unescape(role), unescape(rest[: -len(CLOSE)])


def format_conversation(turns: list[tuple[str, str | list[dict]]]) -> tuple[str, list[tuple[int, int]], list[tuple[str, str, int, int]]]:
    """Formatted conversation, loss spans and attachments, with offsets in the whole."""
    out, spans, attachments = "", [], []
    for role, content in turns:
        turn, lo, hi, flat = format_turn(role, content)
        start = len(out) + turn.index(AFTER_ROLE) + len(AFTER_ROLE)
        attachments += [(k, ref, start + at, n) for k, ref, at, n in flat.attachments]
        if hi > lo or role == ASSISTANT:
            spans.append((len(out) + lo, len(out) + hi))
        out += turn
    return out, spans, attachments


class Reader:
    """Finds the turns of a formatted conversation that arrives in pieces: an unescaped close never occurs inside a turn."""

    def __init__(self):
        self.rest: list[str] = []

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """(role, text) of the turns that end in this piece."""
        tail = "".join(self.rest)[1 - len(CLOSE) :] if self.rest else ""
        if CLOSE not in tail + piece:
            self.rest.append(piece)
            return []
        *turns, rest = ("".join(self.rest) + piece).split(CLOSE)
        self.rest = [rest] if rest else []
        return [read_turn(t + CLOSE) for t in turns]


def read_conversation(text: str) -> list[tuple[str, str]]:
    """Turns behind a formatted conversation."""
    return Reader().feed(text)


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_from, loss_to, attachments for each row of conv_id, turn, role and text.

    A column `parts` (array of structs with type, text, ref, width, height, seconds, pages), where it
    exists and is not null, is the content instead of text.
    """
    tune(conversations.sparkSession)
    typed = "parts" in conversations.columns

    @F.pandas_udf("formatted string, loss_from long, loss_to long, attachments array<struct<kind: string, ref: string, at: long, tokens: long>>")
    def turn(roles: pd.Series, texts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        rows = []
        for role, text, part in zip(roles, texts, parts, strict=True):
            done, lo, hi, flat = format_turn(role, text if part is None or isinstance(part, str) else [dict(p) for p in part])
            rows.append((done, lo, hi, [dict(zip(("kind", "ref", "at", "tokens"), a, strict=True)) for a in flat.attachments]))
        return pd.DataFrame(rows, columns=["formatted", "loss_from", "loss_to", "attachments"])

    made = turn("role", "text", F.col("parts") if typed else F.lit("").alias("parts"))
    return conversations.select("conv_id", "turn", made.alias("t")).select("conv_id", "turn", "t.*")


def _digests(batches):
    """The formatted text of conversations in sorted pieces, with the loss mask, to one row for each conversation, parsed back."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state = None

    def row():
        if state["reader"].rest:
            raise ValueError("a formatted conversation ends inside a turn")
        return tuple(x.hexdigest() if hasattr(x, "hexdigest") else x for x in (state[c] for c in names))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)], names=names)

    for batch in batches:
        rows = []
        for key, piece, lo, hi in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
            if state is None or state["conv_id"] != key:
                rows += [row()] if state else []
                state = dict(zip(names, (key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0), strict=True)) | {"reader": Reader()}
            for role, text in state["reader"].feed(piece):
                state["n_turns"] += 1
                state["turns_sha256"].update(f"{role}\n{text}\n".encode())
            taught = unescape(piece[lo:hi])
            state["loss_chars"] += len(taught)
            state["loss_sha256"].update(taught.encode())
            state["formatted_chars"] += len(piece)
        yield batch_of(rows)
    if state:
        yield batch_of([row()])


def conversation_digest(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = formatted_turns(conversations).select("conv_id", "turn", "formatted", "loss_from", "loss_to")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts are control strings, formatted with the others.
HARD_TEXT = "\\### Assistant: </turn> ok"


def with_hard_case(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(hard)
