"""Chat formatting with typed content parts.

A message's content is a list of parts. A visitor flattens them, in order,
into one string: text stays text, an image, audio or document part becomes a
placeholder, and its reference and the tokens it will expand to are recorded.
Each message becomes one marked turn; control strings inside texts are
escaped so that the marks are the template's alone and the texts come back
unchanged. The formatted conversation is its turns strung together; a loss
span gives the code points of each assistant body.

Formatting looks at one message at a time. Reading back streams each
conversation in order through one running parser, so a conversation of any
length takes bounded memory.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: Tokens that attachments expand to: one per square of so many pixels, per second of audio, per page.
IMAGE_SQUARE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
PARTS = ("array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No control string is left: a backslash is doubled, and one stands
    between ``<`` and ``|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


@dataclass
class Flattener:
    """Visits parts in order; ``out`` is the flat content, ``attachments``
    the (place, type, ref, tokens) of its placeholders."""

    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(k) or 0) / IMAGE_SQUARE) for k in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        """A type without a rule of its own: a placeholder without tokens."""
        self._attach("file", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"place": len(self.attachments), "type": kind, "ref": part.get("ref"),
                                 "tokens": max(0, int(tokens))})
        self.out.append(f"<|{kind}|>")


def format_turn(role: str | None, parts: list[dict], loss_role: str = LOSS_ROLE):
    """(formatted, [start, end] of the body under the loss mask or None, attachments)."""
    f = Flattener()
    for part in parts:
        f.visit(part)
    body, head = "".join(f.out), f"{START}{escape_role(role or '')}\n"
    span = (len(head), len(head) + len(body)) if role == loss_role else None
    return f"{head}{body}{END}\n", span, f.attachments


_FORMATTED = ("conv_id bigint, turn bigint, formatted string, loss_start int, loss_end int, "
              "attachments array<struct<place:int,type:string,ref:string,tokens:bigint>>")


def format_messages(messages: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One formatted turn per row of ``messages``: ``conv_id``, ``turn``,
    ``role`` and either ``parts`` (``PARTS``) or ``text`` (null: empty).

    Returns ``conv_id``, ``turn``, ``formatted``, the code points
    ``loss_start`` to ``loss_end`` of ``formatted`` that carry loss (null:
    none) and ``attachments``. A null role is empty; other columns are
    ignored; an empty table gives an empty result.
    """
    typed = "parts" in messages.columns

    def turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv, turn, role, content in zip(b["conv_id"].astype("Int64"), b["turn"].astype("Int64"), b["role"],
                                                 b["content"]):
                if typed:
                    parts = [p.asDict() if hasattr(p, "asDict") else dict(p)
                             for p in (content if content is not None else [])]
                else:
                    parts = [{"type": "text", "text": content}]
                text, span, attached = format_turn(role, parts, loss_role)
                rows.append((conv, turn, text, *(span or (None, None)), attached))
            out = pd.DataFrame(rows, columns=["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments"])
            yield out.astype({"conv_id": "Int64", "turn": "Int64", "loss_start": "Int32", "loss_end": "Int32"})

    content = F.col("parts").cast(PARTS) if typed else F.col("text").cast("string")
    return messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), content.alias("content")).mapInPandas(turns, _FORMATTED)


class Reader:
    """Parses one conversation from pieces of its formatted text, and its
    loss spans, into running digests."""

    def __init__(self):
        self.rest, self.n_turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, span: tuple[int, int] | None) -> None:
        self.chars += len(text)
        if span:
            said = unescape(text[span[0]:span[1]])
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))
        self.rest += text
        at = 0
        for m in _TURN.finditer(self.rest):
            turn = f"{unescape(m[1])}\n{unescape(m[2])}\n"
            self.turns.update(turn.encode("utf-8", "surrogatepass"))
            self.n_turns, at = self.n_turns + 1, m.end()
        self.rest = self.rest[at:]


_DIGEST = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
           "formatted_chars bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation of formatted turns: ``n_turns``,
    ``turns_sha256`` (role, line feed, text, line feed per turn),
    ``loss_chars`` and ``loss_sha256`` of the unescaped text under the loss
    mask, and ``formatted_chars``. Turns are read by ``turn`` (null first;
    ties by their text). Rows without conv_id are one conversation."""
    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, reader = None, None

        def done() -> pd.DataFrame:
            row = (current[0], reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(),
                   reader.chars)
            return pd.DataFrame([row], columns=[c.split()[0] for c in _DIGEST.split(", ")]).astype({"conv_id": "Int64"})

        for b in batches:
            out = []
            for conv, text, start, end in zip(b["conv_id"].astype("Int64"), b["formatted"],
                                              b["loss_start"].astype("Int64"), b["loss_end"].astype("Int64")):
                key = (None if pd.isna(conv) else int(conv),)
                if key != current:
                    if reader:
                        out.append(done())
                    current, reader = key, Reader()
                reader.feed(text, None if pd.isna(start) else (int(start), int(end)))
            if out:
                yield pd.concat(out, ignore_index=True)
        if reader:
            yield done()

    order = ["conv_id", "turn", "formatted"]
    return (formatted.select(*order, "loss_start", "loss_end").repartition("conv_id")
            .sortWithinPartitions(*order).mapInPandas(digests, _DIGEST))
