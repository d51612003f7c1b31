"""Chat formatting with a compiled template and generation markers.

Rows (conv_id, turn, role, text) become the training text of a conversation.
The template (see ``template``) marks turns; the parts inside its generation
blocks are the loss mask. Control strings inside texts and roles are guarded
by a backslash after their first character (one more where backslashes stand
there already), which ``unguard`` takes back exactly.

Rows are hash-partitioned by conversation and sorted by turn; rendering and
reading back run lazily along the sorted partition, so a conversation is
never gathered: ``format_chats`` gives its text in order, in pieces of about
``piece_chars`` characters with the spans of the loss mask inside each piece.

Defined results for odd input: NULL text or role is empty; turns that repeat
are ordered by role and text, repeated rows are all kept; NULL turns come
first; rows with a NULL conv_id form one conversation; an empty table gives
an empty result; extra columns are ignored. A role may be any text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.template import Template

# Strings that mean something to chat models' tokenizers.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = CONTROL[:2]
TEMPLATE = (
    "{% for message in messages %}"
    f"{OPEN}" "{{ message.role | guard_line }}\n"
    '{% if message.role == "assistant" %}{% generation %}{{ message.text | guard }}{% endgeneration %}'
    "{% else %}{{ message.text | guard }}{% endif %}"
    f"{CLOSE}\n"
    "{% endfor %}")
PIECE_CHARS = 1 << 16

_GUARD = re.compile("|".join(rf"(?<={re.escape(c[0])})(?=\\*{re.escape(c[1:])})" for c in CONTROL))
_UNGUARD = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROL))


def guard(text: str) -> str:
    return _GUARD.sub(r"\\", text)


def unguard(text: str) -> str:
    return _UNGUARD.sub("", text)


def guard_line(text: str) -> str:
    """``guard`` for a field that ends at the line's end."""
    return guard(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unguard_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unguard(text))


FILTERS = {"guard": guard, "guard_line": guard_line}


def _rows(it) -> Iterator[tuple]:
    for batch in it:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _pieces(parts: Iterable[tuple[str, bool]], piece_chars: int):
    """(text, [(start, end)]) of about piece_chars characters each."""
    buf, size, spans = [], 0, []
    for text, generated in parts:
        if generated:
            if spans and spans[-1][1] == size:
                spans[-1] = (spans[-1][0], size + len(text))
            else:
                spans.append((size, size + len(text)))
        buf.append(text)
        size += len(text)
        if size >= piece_chars:
            yield "".join(buf), spans
            buf, size, spans = [], 0, []
    if buf:
        yield "".join(buf), spans


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_chats(conversations: DataFrame, template: str = TEMPLATE, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(conv_id, piece, text, loss) in order within each partition; a
    conversation's pieces are consecutive. ``loss`` holds the character
    ranges of ``text`` under the loss mask."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(it):
        compiled = Template(template, FILTERS)
        out, size = [], 0
        for conv, group in groupby(_rows(it), key=lambda r: r[0]):
            messages = ({"role": r[2], "text": r[3]} for r in group)
            for k, (text, spans) in enumerate(_pieces(compiled.render(messages=messages), piece_chars)):
                out.append((conv, k, text, [{"start": a, "end": b} for a, b in spans]))
                size += len(text)
                if size > 1 << 22:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    def _batch(out):
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), _SPANS), strict=True)],
            ["conv_id", "piece", "text", "loss"])

    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(run, "conv_id long, piece long, text string, loss array<struct<start:long,end:long>>"))


class Reader:
    """Reads one formatted conversation back, piece by piece."""

    def __init__(self):
        self.turns = self.chars = self.loss_chars = 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()
        self._text, self._loss, self._open = "", [], False

    def feed(self, text: str, spans: list[tuple[int, int]]) -> None:
        self.chars += len(text)
        at = 0
        for a, b in spans:
            if a > at or not self._open:
                self._end_loss()
            self._loss.append(text[a:b])
            self._open, at = True, b
        if at < len(text):
            self._end_loss()
        self._text += text
        at = 0
        while (end := self._text.find(CLOSE + "\n", at)) >= 0:
            head = self._text.index("\n", at)
            if not self._text.startswith(OPEN, at) or head > end:
                raise ValueError("not a formatted conversation")
            role = unguard_line(self._text[at + len(OPEN):head])
            self.turns_sha.update(f"{role}\n{unguard(self._text[head + 1:end])}\n".encode())
            self.turns += 1
            at = end + len(CLOSE) + 1
        self._text = self._text[at:]

    def _end_loss(self) -> None:
        if self._loss:
            text = unguard("".join(self._loss))
            self.loss_chars += len(text)
            self.loss_sha.update(text.encode())
        self._loss, self._open = [], False

    def close(self) -> tuple:
        self._end_loss()
        if self._text:
            raise ValueError("text after the last turn")
        return self.turns, self.turns_sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation the digests of what its formatted text says. Runs on
    ``format_chats``' output as it is: ordered, pieces consecutive."""
    def run(it):
        out = []
        for conv, pieces in groupby(_rows(it), key=lambda r: r[0]):
            reader = Reader()
            for _, _, text, spans in pieces:
                reader.feed(text, [(s["start"], s["end"]) for s in spans])
            out.append((conv, *reader.close()))
            if len(out) >= 4096:
                yield _table(out)
                out = []
        if out:
            yield _table(out)

    return formatted.select("conv_id", "piece", "text", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")


def _table(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                      names)
