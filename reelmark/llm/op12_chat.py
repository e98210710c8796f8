"""Chat formatting: every assistant turn becomes an example of its own, with all turns before it as context.

Only the reply of an example is trainable: ``loss_start`` and ``loss_end`` are its code points within the
example's ``text``. An example's context is its whole prefix of the conversation. What a conversation has
formatted so far is kept open up to `PAGE` code points and copied into each example; beyond that it is
closed as a page, a row of its own, which later examples name by ``pages`` instead of copying it. Every
example is thus whole (its context is that many pages of the conversation, then its own text up to the
reply) while a conversation of any length takes space in proportion to its length, not to its square.
A conversation that does not end with a reply gets a last row without a reply, so no turn is lost.

Rows meet by conversation and stream through a task in turn order; a task holds an open page and a batch.

The template writes a turn as ``<|im_start|>role``, a line break, the text and ``<|im_end|>`` with a line
break. Inside texts and roles every ``<``, any number of backslashes and ``|`` gets one backslash more, so
no text can hold a control string and `unescaped` gives it back; roles also escape line breaks.

Defined results: a null text or role is empty; rows without a conversation id are one conversation; null
turns come first, and rows of one turn are ordered by role and text, repeated rows stay. An empty table gives
no rows. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 1 << 16  # code points of context that examples copy
BATCH = 4 << 20  # code points in a batch of rows handed on
#: The template's control strings and the role that is trained.
START, END, REPLY = "<|im_start|>", "<|im_end|>", "assistant"

MARK, MARKED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    return MARK.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return MARKED.sub(r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role), flags=re.S)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _expanded(turns: Iterator[tuple], page: int) -> Iterator[tuple]:
    """(conversation, part, kind, pages, text, loss_start, loss_end) of turns in order."""
    now, open_text, part, pages, answered = None, "", 0, 0, True
    for conversation, role, text in turns:
        if now is None or conversation != now[0]:
            if not answered:
                yield now[0], part, "rest", pages, open_text, 0, 0
            now, open_text, part, pages, answered = (conversation,), "", 0, 0, True
        head = f"{open_text}{START}{escaped_role(role)}\n"
        reply = escaped(text)
        open_text = f"{head}{reply}{END}\n"
        answered = role == REPLY
        if answered:
            yield conversation, part, "example", pages, open_text, len(head), len(head) + len(reply)
            part += 1
        if len(open_text) >= page:
            yield conversation, part, "page", pages, open_text, 0, 0
            open_text, part, pages = "", part + 1, pages + 1
    if not answered:
        yield now[0], part, "rest", pages, open_text, 0, 0


def _batched(rows: Iterator[tuple], schema: pa.Schema, text: int | None = None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[text]) if text is not None else 0)
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format_examples(turns: DataFrame, page: int = PAGE) -> DataFrame:
    """Formatted rows of every conversation, those of one in order of ``part`` within a partition.

    (conv_id, part, kind, pages, text, loss_start, loss_end): kind is ``example`` (train on the span of its
    reply), ``page`` (closed context, the pages of a conversation in order) or ``rest`` (turns after the last
    reply). ``pages`` is how many of the conversation's pages go before ``text``.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        "turn",
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    columns = "conv_id long, part long, kind string, pages long, text string, loss_start long, loss_end long"
    schema = pa.schema(
        [(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split() for c in columns.split(", "))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_expanded(_rows(batches), page), schema, text=4)

    return ordered.select("conv_id", "role", "text").mapInArrow(work, columns)


class _Reader:
    """What the formatted rows of one conversation say."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = self.pages = self.page_chars = 0
        self.open_text = ""
        self.said, self.trained = hashlib.sha256(), hashlib.sha256()

    def take(self, kind: str, pages: int, text: str, loss_start: int, loss_end: int) -> None:
        if pages != self.pages or not text.startswith(self.open_text):
            raise ValueError("an example's context is not the conversation before it")
        at = len(self.open_text)
        while at < len(text):
            line, close = text.index("\n", at), text.index(END, at)
            role, body = text[at + len(START) : line], text[line + 1 : close]
            self.turns += 1
            self.said.update(f"{unescaped_role(role)}\n{unescaped(body)}\n".encode("utf-8", "surrogatepass"))
            at = close + len(END) + 1
        if kind == "page":
            self.pages, self.page_chars, self.open_text = self.pages + 1, self.page_chars + len(text), ""
            return
        self.open_text = text
        self.chars += self.page_chars + len(text)
        if kind == "example":
            reply = unescaped(text[loss_start:loss_end])
            self.loss_chars += len(reply)
            self.trained.update(reply.encode("utf-8", "surrogatepass"))

    def digest(self, conversation: int | None) -> tuple:
        return conversation, self.turns, self.said.hexdigest(), self.loss_chars, self.trained.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted rows alone.

    ``formatted`` lies as `format_examples` gives it: a conversation in one partition, by ``part``.
    ``formatted_chars`` is the length of all examples (and of the rest), each with its whole context.
    Fails where an example's context isn't the conversation up to it.
    """
    columns = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = pa.schema(
        [(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split() for c in columns.split(", "))]
    )

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, reader = None, None
        for conversation, _, kind, pages, text, loss_start, loss_end in rows:
            if now is None or conversation != now[0]:
                if now is not None:
                    yield reader.digest(now[0])
                now, reader = (conversation,), _Reader()
            reader.take(kind, pages, text, loss_start, loss_end)
        if now is not None:
            yield reader.digest(now[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(digests(_rows(batches)), schema)

    return formatted.mapInArrow(work, columns)


def example_texts(formatted: DataFrame) -> DataFrame:
    """Examples with their context written out: (conv_id, part, context, reply); for conversations of usual length.

    Each example meets its conversation's pages by a join; an example's string is as long as its context.
    """
    pages = formatted.where("kind = 'page'").select(F.col("conv_id").alias("_of"), F.col("pages").alias("_page"), F.col("text").alias("_text"))
    examples = formatted.where("kind = 'example'")
    own = F.col("conv_id").eqNullSafe(F.col("_of")) & (F.col("_page") < F.col("pages"))
    joined = examples.join(pages, own, "left")
    told = joined.groupBy("conv_id", "part", "text", "loss_start", "loss_end").agg(
        F.sort_array(F.collect_list(F.when(F.col("_page").isNotNull(), F.struct("_page", "_text")))).alias("_pages")
    )
    before = F.concat_ws("", F.col("_pages._text"), F.expr("substring(text, 1, CAST(loss_start AS INT))"))
    return told.select(
        "conv_id", "part", before.alias("context"),
        F.expr("substring(text, CAST(loss_start + 1 AS INT), CAST(loss_end - loss_start AS INT))").alias("reply"),
    )
