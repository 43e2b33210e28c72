"""Chat formatting: typed content parts are flattened into one rendered segment for each turn.

A visitor walks a turn's parts in order. Text is escaped; an image, audio or document part becomes a numbered placeholder,
and its reference and the number of tokens it will expand to are recorded. Inside texts a backslash stands before every
backslash and before every control string, so nothing in a text can close or open a turn, and reading back is exact.

Turns travel sorted within partitions of whole conversations and are rendered as they pass, so a conversation of any
length needs no more memory than a turn.

Defined cases: a null text is empty; a null role is the empty role; a null turn comes first; equal turn numbers are
ordered by role and text; repeated rows are turns of their own; rows with a null conversation form one conversation; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

# The template's control strings.
BOS, EOS, INST, END_INST, ROLE, END_ROLE = "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"
PLACEHOLDER = r"<\|(?:image|audio|document):\d+\|>"
_CONTROL = re.compile("|".join([r"\\", *map(re.escape, (BOS, EOS, INST, END_INST, ROLE, END_ROLE)), PLACEHOLDER]))
_ESCAPED = re.compile(r"\\(.)", re.S)
_USER = re.compile(r"<s>\[INST\] ((?:[^\\]|\\.)*?) \[/INST\]", re.S)
_ASSISTANT = re.compile(r" ((?:[^\\]|\\.)*?) </s>", re.S)
_OTHER = re.compile(r"<s>\[ROLE\] ((?:[^\\]|\\.)*?) \[/ROLE\] ((?:[^\\]|\\.)*?) </s>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


@dataclass(frozen=True)
class Costs:
    """Expanded tokens of attachments: image tiles, audio frames a second, document pages."""

    image_tile: int = 512
    tokens_per_tile: int = 170
    image_base: int = 85
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 600


@dataclass
class PartVisitor:
    """Flattens a turn's parts: rendered text, and (kind, reference, tokens) of each attachment in order."""

    costs: Costs = Costs()
    first: int = 0
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = self.costs.image_tile
        tiles = math.ceil((part.get("width") or side) / side) * math.ceil((part.get("height") or side) / side)
        self._attach("image", part, self.costs.image_base + tiles * self.costs.tokens_per_tile)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.costs.audio_tokens_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 1) * self.costs.tokens_per_page)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"unknown part type {part.get('type')!r}")

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.append(f"<|{kind}:{self.first + len(self.attachments)}|>")
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "tokens": int(tokens)})


def render(role: str, body: str) -> tuple[str, int, int]:
    """A turn's segment, and where its loss mask starts and ends (code points; both 0 if none)."""
    if role == "user":
        return f"{BOS}{INST} {body} {END_INST}", 0, 0
    if role == "assistant":
        return f" {body} {EOS}", 1, 1 + len(body)
    return f"{BOS}{ROLE} {escape(role)} {END_ROLE} {body} {EOS}", 0, 0


def parse(segment: str) -> list[tuple[str, str]]:
    """(role, unescaped text) of every turn in rendered text."""
    at, out = 0, []
    while at < len(segment):
        for role, pattern in (("user", _USER), (None, _OTHER), ("assistant", _ASSISTANT)):
            if m := pattern.match(segment, at):
                out.append((unescape(m[1]) if role is None else role, unescape(m[m.lastindex])))
                at = m.end()
                break
        else:
            raise ValueError(f"no turn at {at}")
    return out


PARTS = "array<struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>>"
_SEGMENT = "conv_id long, segment long, role string, rendered string, mask_start long, mask_end long, attachments array<struct<kind:string,ref:string,tokens:long>>, attachment_tokens long"
_ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
_SEGMENT_ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("role", pa.string()), ("rendered", pa.string()), ("mask_start", pa.int64()), ("mask_end", pa.int64()), ("attachments", _ATTACHMENTS), ("attachment_tokens", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _formatter(costs: Costs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, attached = object(), 0, 0
        for batch in batches:
            rows = []
            for c, role, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != conv:
                    conv, n, attached = c, 0, 0
                v = PartVisitor(costs, attached)
                for part in parts or []:
                    if part is not None:
                        v.visit(part)
                attached += len(v.attachments)
                text, a, b = render(role, "".join(v.out))
                rows.append((c, n, role, text, a, b, v.attachments, sum(x["tokens"] for x in v.attachments)))
                n += 1
            yield _table(rows, _SEGMENT_ARROW)

    return run


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, costs: Costs = Costs()) -> DataFrame:
    """One row per turn, in order within a partition: see _SEGMENT; a conversation is its segments' rendered texts, joined.

    parts_col: a column of PARTS; else each turn is one text part of text_col.
    """
    ship(turns.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")) if parts_col is None else None
    parts: Column = F.col(parts_col).cast(PARTS) if parts_col else F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "long"), ("height", "long"), ("seconds", "double"), ("pages", "long")))))
    d = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"), F.col(turn_col).alias("turn"))
    d = d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.to_json("parts"))
    return d.select("conv_id", "role", "parts").mapInArrow(_formatter(costs), _SEGMENT)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachment_tokens long"
_DIGEST_ARROW = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _DIGEST.split(", ")])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state = object(), None

    def done(c, s) -> tuple:
        return (c, s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"], s["tokens"])

    for batch in batches:
        rows = []
        for c, text, a, b, tokens in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 7)), strict=True):
            if c != conv:
                if state:
                    rows.append(done(conv, state))
                conv, state = c, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "tokens": 0}
            for role, body in parse(text):
                state["n"] += 1
                state["turns"].update(f"{role}\n{body}\n".encode())
            learnt = unescape(text[a:b])
            state["chars"] += len(learnt)
            state["loss"].update(learnt.encode())
            state["formatted"] += len(text)
            state["tokens"] += tokens
        yield _table(rows, _DIGEST_ARROW)
    if state:
        yield _table([done(conv, state)], _DIGEST_ARROW)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of what the rendered segments say, for segments in the order format_conversations() leaves them in."""
    return segments.mapInArrow(_read_back, _DIGEST)
