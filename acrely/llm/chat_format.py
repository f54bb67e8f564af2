"""Chat formatting with typed content parts.

A turn is a list of parts: text, image, audio or document. A visitor flattens the parts of a
conversation into one string: text is escaped, every other part becomes a placeholder that is
numbered in the order of appearance, with its reference and the number of tokens it will expand to
kept beside the string. Turns are marked with control strings.

    <turn>ROLE<body>CONTENT</turn>        placeholders: <image:0>, <audio:1>, <document:2>

Escaping puts a backslash before every backslash and "<" of a role or text, so a control string
begins with a "<" that no backslash precedes, and `read_back` recovers the exact conversation.

The loss mask is a list of character spans [start, end) of the string: the text parts of the
assistant's turns. Rows of a conversation are put in order by one sort of the partitions and stream
through a task.

`format_turns` gives a row per turn, with its place in the string; a task holds one turn, so a conversation may
be of any length, and `digests` folds the rows in order. `format_chats` gives a row per conversation with the whole
string, which a task holds and which therefore has to fit a cell of a table (2 GB).

Defined cases: a null or empty text is an empty part; a null part and a part without a kind are left out; an unknown
kind is an error; a null role is an empty role; turns with equal numbers are ordered by role, then content, and nulls come
first; repeated rows are turns of their own; an empty table gives no rows; rows without an identifier form one
conversation; identifiers may be of any type that can be cast to text and back; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENT = "struct<placeholder:string,kind:string,ref:string,turn:int,tokens:bigint>"
SPAN = "struct<first:bigint,end:bigint>"
FORMATTED = f"conv_id string, n_turns long, formatted string, loss array<{SPAN}>, attachments array<{ATTACHMENT}>, tokens long"

IMAGE_PATCH = 28        # pixels along the side of the square that one token stands for
AUDIO_TOKENS = 25       # per second
PAGE_TOKENS = 1_000     # per page of a document

_SPECIAL = re.compile(r"[\\<]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn>((?:\\.|[^\\<])*)<body>((?:\\.|[^\\<]|<(?:image|audio|document):\d+>)*)</turn>", re.DOTALL)
_PLACEHOLDER = re.compile(r"((?:\\.|[^\\<])+)|<(image|audio|document):(\d+)>", re.DOTALL)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def text_part(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    part = F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
    return F.array(part)


def count_words(text: str) -> int:
    return len(text.split())


@dataclass
class Flattener:
    """Visitor over the parts of one conversation."""

    count: object = count_words
    pieces: list[str] = field(default_factory=list)
    at: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0
    turn: int = 0
    seen: int = 0           # attachments that were taken

    def _put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.at += len(piece)

    def visit_turn(self, role: str | None, parts: Sequence[dict] | None) -> None:
        self._put(f"<turn>{escape(role or '')}<body>")
        for part in parts or ():
            if part is None or part["kind"] is None:
                continue
            visit = getattr(self, f"visit_{part['kind']}", None)
            if visit is None:
                raise ValueError(f"no such kind of part: {part['kind']}")
            visit(part, role == "assistant")
        self._put("</turn>")
        self.turn += 1

    def visit_text(self, part: dict, learn: bool) -> None:
        text = part["text"] or ""
        start = self.at
        self._put(escape(text))
        self.tokens += self.count(text)
        if learn and text:
            self.loss.append((start, self.at))

    def _attach(self, part: dict, tokens: int) -> None:
        mark = f"<{part['kind']}:{self.seen + len(self.attachments)}>"
        self._put(mark)
        self.attachments.append(
            {"placeholder": mark, "kind": part["kind"], "ref": part["ref"], "turn": self.turn, "tokens": tokens})
        self.tokens += tokens

    def visit_image(self, part: dict, learn: bool) -> None:
        across, down = (-(-max(part[side] or 0, 1) // IMAGE_PATCH) for side in ("width", "height"))
        self._attach(part, across * down)

    def visit_audio(self, part: dict, learn: bool) -> None:
        self._attach(part, max(1, round((part["seconds"] or 0) * AUDIO_TOKENS)))

    def visit_document(self, part: dict, learn: bool) -> None:
        self._attach(part, max(1, part["pages"] or 0) * PAGE_TOKENS)

    def take(self) -> tuple[str, list[tuple[int, int]], list[dict], int]:
        """What the turns since the last call gave: the piece, its loss spans and attachments, its tokens."""
        out = "".join(self.pieces), self.loss, self.attachments, self.tokens
        self.seen += len(self.attachments)
        self.pieces, self.loss, self.attachments, self.tokens = [], [], [], 0
        return out

    def row(self, conv_id: str | None) -> dict:
        return {
            "conv_id": conv_id, "n_turns": self.turn, "formatted": "".join(self.pieces),
            "loss": [{"first": a, "end": b} for a, b in self.loss], "attachments": self.attachments, "tokens": self.tokens}


def read_back(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) per turn; a part is ("text", its text) or ("image", the number of the placeholder)."""
    at = 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        parts = [
            ("text", unescape(m.group(1))) if m.group(1) is not None else (m.group(2), m.group(3))
            for m in _PLACEHOLDER.finditer(turn.group(2))]
        yield unescape(turn.group(1)), parts
        at = turn.end()


def tokenizer_count(ranks_path: str, pattern: str) -> object:
    """A token counter over a public vocabulary file of byte-pair ranks; the path is the caller's."""
    import base64

    import tiktoken
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def _in_order(turns: DataFrame, conv_id: str, turn: str, role: str, parts: str) -> DataFrame:
    """The rows of a conversation one after the other. Identifiers are text inside."""
    source = turns.select(
        F.col(conv_id).cast("string").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(parts).alias("parts"))
    return source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")


def format_chats(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    counter: object = None,
) -> DataFrame:
    """One row per conversation; `counter` makes the token counter inside a task (words by default)."""
    def run(batches):
        count = counter() if counter else count_words
        current, visitor, out, held = None, None, [], 0
        for batch in batches:
            ids, roles, bodies = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for id_, role_, parts_ in zip(ids, roles, bodies):
                if visitor is None or id_ != current:
                    if visitor is not None:
                        out.append(visitor.row(current))
                        held += visitor.at
                    current, visitor = id_, Flattener(count)
                visitor.visit_turn(role_, parts_)
                if held > 8_000_000:
                    yield _batch(out)
                    out, held = [], 0
        if visitor is not None:
            out.append(visitor.row(current))
        if out:
            yield _batch(out)

    made = _in_order(turns, conv_id, turn, role, parts).mapInArrow(run, FORMATTED)
    return made.withColumn("conv_id", F.col("conv_id").cast(turns.schema[conv_id].dataType))


_PAIR = pa.struct([("first", pa.int64()), ("end", pa.int64())])
_ATTACHED = pa.struct([
    ("placeholder", pa.string()), ("kind", pa.string()), ("ref", pa.string()), ("turn", pa.int32()), ("tokens", pa.int64())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([
        ("conv_id", pa.string()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(_PAIR)),
        ("attachments", pa.list_(_ATTACHED)), ("tokens", pa.int64())]))


TURNS = f"conv_id string, place long, start long, piece string, loss array<{SPAN}>, attachments array<{ATTACHMENT}>, tokens long"


def format_turns(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    counter: object = None,
) -> DataFrame:
    """One row per turn: its place in the conversation from 0, the piece of the formatted string that it is, where that starts,
    and loss spans, attachments and tokens of the turn, spans counted from the start of the conversation.

    The rows of a conversation are in one partition and in order, as `digests` needs them.
    """
    schema = pa.schema([
        ("conv_id", pa.string()), ("place", pa.int64()), ("start", pa.int64()), ("piece", pa.string()), ("loss", pa.list_(_PAIR)),
        ("attachments", pa.list_(_ATTACHED)), ("tokens", pa.int64())])

    def run(batches):
        count = counter() if counter else count_words
        current, visitor, out, held = None, None, [], 0
        for batch in batches:
            ids, roles, bodies = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for id_, role_, parts_ in zip(ids, roles, bodies):
                if visitor is None or id_ != current:
                    current, visitor = id_, Flattener(count)
                start = visitor.at
                visitor.visit_turn(role_, parts_)
                piece, loss, attachments, tokens = visitor.take()
                out.append({"conv_id": id_, "place": visitor.turn - 1, "start": start, "piece": piece,
                            "loss": [{"first": a, "end": b} for a, b in loss], "attachments": attachments, "tokens": tokens})
                held += len(piece)
                if held > 8_000_000 or len(out) == 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    made = _in_order(turns, conv_id, turn, role, parts).mapInArrow(run, TURNS)
    return made.withColumn("conv_id", F.col("conv_id").cast(turns.schema[conv_id].dataType))


DIGESTS = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Folded:
    """What the pieces of a conversation say when they are read back, one after the other."""

    def __init__(self, conv_id: str | None) -> None:
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.learnt = hashlib.sha256(), hashlib.sha256()

    def add(self, start: int, piece: str, loss: Sequence[dict]) -> None:
        if start != self.chars:
            raise ValueError(f"conversation {self.conv_id}: a piece starts at {start}, the one before ends at {self.chars}")
        for role, parts in read_back(piece):
            self.all.update(f"{role}\n{''.join(x for kind, x in parts if kind == 'text')}\n".encode())
            self.turns += 1
        for span in loss:
            text = unescape(piece[span["first"] - start:span["end"] - start])
            self.learnt.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(piece)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars,
                "loss_sha256": self.learnt.hexdigest(), "formatted_chars": self.chars}


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings and loss masks say when they are read back, one row per conversation. Takes the rows of
    `format_turns`, as they come from it, or of `format_chats`."""
    whole = "formatted" in formatted.columns
    source = formatted.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.lit(0).cast("long").alias("start") if whole else F.col("start"),
        F.col("formatted" if whole else "piece").alias("piece"), "loss")
    schema = pa.schema([
        ("conv_id", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        current, out = None, []
        for batch in batches:
            for id_, start, piece, loss in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if current is None or start == 0:  # only the first piece of a conversation starts at 0
                    if current is not None:
                        out.append(current.row())
                    current = _Folded(id_)
                current.add(start, piece, loss)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if current is not None:
            out.append(current.row())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return source.mapInArrow(run, DIGESTS).withColumn("conv_id", F.col("conv_id").cast(formatted.schema["conv_id"].dataType))
