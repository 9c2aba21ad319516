"""Chat formatting with loss spans found by incremental black-box rendering."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Render = Callable[[list[tuple[str, str]], bool], str]

#: Characters of marked turns that a worker remembers.
REMEMBERED = 32 << 20
#: Fixed values of the default template: what opens and closes a turn, and how those strings are written in a text.
OPEN, CLOSE = "### ", " </turn>\n"
_ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e", ":": "\\c"}
_BACK = {v: k for k, v in _ESCAPES.items()}


def escape(text: str, role: bool = False) -> str:
    """``text`` without any string that opens or closes a turn (or ends a role); ``unescape`` gives it back."""
    return re.sub(r"\\|###|</turn>" + ("|:" if role else ""), lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\hec]", lambda m: _BACK[m[0]], text)


class _Marked(dict):
    """Marked turns by role and text, so that a prefix that is rendered again costs no new escapes."""

    def __init__(self) -> None:
        self.size = 0

    def __missing__(self, turn: tuple[str, str]) -> str:
        if self.size > REMEMBERED:
            self.clear()
            self.size = 0
        self[turn] = found = f"{OPEN}{escape(turn[0], True)}: {escape(turn[1])}{CLOSE}"
        self.size += len(found)
        return found


_marked = _Marked()


def marked_turns(turns: list[tuple[str, str]], prompt: bool = False) -> str:
    """The default template: every turn is its role and text between marks; ``prompt`` opens an assistant's turn."""
    return "".join(map(_marked.__getitem__, turns)) + (f"{OPEN}assistant: " if prompt else "")


def parsed_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a text of ``marked_turns``."""
    out = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, text = part.removeprefix(OPEN).partition(": ")
        out.append((unescape(role), unescape(text)))
    return out


def turn_spans(turns: list[tuple[str, str]], render: Render) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The formatted text, per turn its start and end and the start and end of its loss (equal where there is none),
    and whether the template rewrites history.

    Nothing is known of the template: prefixes with one more turn each are rendered, and what an output adds to the
    one before is that turn's span. An assistant's text begins where the prefix's generation prompt ends, and ends
    where the output of the same turn with an empty text resumes. If an output does not continue the one before, the
    template changes earlier turns, there are no spans and nothing may be learnt from the text.
    """
    before, spans = render([], False), []
    for k, (role, text) in enumerate(turns):
        after = render(turns[: k + 1], False)
        if not after.startswith(before):
            return render(turns, False), [], True
        first = last = len(after)
        if role == "assistant":
            prompt = render(turns[:k], True)
            empty = render([*turns[:k], (role, "")], False)
            tail = empty[len(prompt) :]
            if not (prompt.startswith(before) and after.startswith(prompt) and empty.startswith(prompt) and after.endswith(tail)):
                return render(turns, False), [], True
            first, last = len(prompt), len(after) - len(tail)
        spans.append((len(before), len(after), first, last))
        before = after
    return before, spans, False


def format_conversations(
    rows: DataFrame,
    render: Render = marked_turns,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``id``, ``formatted``, ``spans`` (per turn: start, end, loss_start, loss_end, in code points) and ``rewrites``
    for every conversation of ``rows``.

    Turns are in order of ``turn_col``, null first; ties are in order of role and text, and repeated rows are turns of
    their own. A null role or text is empty; rows without id are one conversation. Other columns are not read; an
    empty table gives no rows. Rows are dealt out by conversation and sorted, and a task holds one conversation at a
    time, as its formatted text is one value (so of less than 2 GB). As nothing is known of a template, each turn renders
    the turns before it again: the characters joined and compared grow with the square of a conversation's turns, but
    each turn is escaped once.
    """
    layout = "id long, formatted string, spans array<struct<start:int,end:int,loss_start:int,loss_end:int>>, rewrites boolean"
    kinds = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "loss_start", "loss_end")]))

    def run(batches):
        current, turns, out, size = (), [], [], 0

        def finished():
            text, spans, rewrites = turn_spans(turns, render)
            return current[0], text, [dict(zip(("start", "end", "loss_start", "loss_end"), s)) for s in spans], rewrites

        def batch_of(done):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.int64(), pa.string(), kinds, pa.bool_()))], ["id", "formatted", "spans", "rewrites"])

        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if current and current[0] != conv:
                    out.append(finished())
                    size += len(out[-1][1])
                    turns = []
                    if size > 1 << 20:
                        yield batch_of(out)
                        out, size = [], 0
                current = (conv,)
                turns.append((role, text))
        if current:
            yield batch_of([*out, finished()])

    own = rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    dealt = own.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return dealt.select("id", "role", "text").mapInArrow(run, layout)


def read_back(formatted: DataFrame) -> DataFrame:
    """What a trainer reads from texts of the default template: ``id``, ``n_turns``, ``turns_sha256`` (over role, line
    feed, text, line feed of every turn), ``loss_chars`` and ``loss_sha256`` (of the unescaped text under the loss
    spans) and ``formatted_chars``. A template that rewrites history has no loss, nor has a conversation without assistant:
    0 characters and the digest of the empty text. An empty text has no turns; null and repeated ids are rows as they
    come; no rows give none."""

    def run(batches):
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                turns = parsed_turns(text)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[s["loss_start"] : s["loss_end"]]) for s in spans)
                sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (told, loss)]
                out.append((conv, len(turns), sha[0], len(loss), sha[1], len(text)))
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return formatted.mapInArrow(run, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
