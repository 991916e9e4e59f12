"""Chat formatting (operator 1): render, reparse, compare, escape until the parse gives the source back.

Template: ``[INST]text[/INST]`` for user, ``<s>text</s>`` for assistant, ``<<SYS>>text<</SYS>>``
for system, ``<|role|>role<|text|>text<|end|>`` for any other role. Inside a text a control
string is literal when an odd number of backslashes stands before it; the escape doubles
the backslashes that stand before a control string or at the end and adds one before a control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's control strings.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>"]
FRAMES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}

_CONTROL = "|".join(map(re.escape, CONTROLS))
_TOKEN = re.compile(rf"(?<!\\)(\\*)({_CONTROL})")
_CONFLICT = re.compile(rf"(?<!\\)(\\*)({_CONTROL}|\Z)")
_CLOSE = {open_: (close, role) for role, (open_, close) in FRAMES.items()}


def escape(text: str) -> str:
    """Make every control string in ``text`` literal (reversible, see ``unescape``)."""
    return _CONFLICT.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)


def unescape(text: str) -> str:
    """Invert ``escape`` on what stands between a turn's markers."""
    return _CONFLICT.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def render(turns: list[tuple[str, str]], escaped: set[int]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the assistant texts (the loss mask)."""
    out: list[str] = []
    mask: list[tuple[int, int]] = []
    at = 0
    for i, (role, text) in enumerate(turns):
        body = escape(text) if i in escaped else text
        name = escape(role) if i in escaped else role
        head, tail = FRAMES.get(role) or (f"<|role|>{name}<|text|>", "<|end|>")
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, tail)
        at += len(head) + len(body) + len(tail)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """Read the turns back; None where the text doesn't follow the grammar."""
    turns: list[tuple[str, str]] = []
    at, state, role, start = 0, "between", "", 0
    for m in _TOKEN.finditer(formatted):
        if len(m[1]) % 2:
            continue  # a literal
        what = m[2]
        if state == "between":
            if m.start() != at:
                return None
            if what == "<|role|>":
                state, start = "role", m.end()
            elif what in _CLOSE:
                state, (close, role), start = "text", _CLOSE[what], m.end()
            else:
                return None
        elif state == "role":
            if what != "<|text|>":
                return None
            role, start, state, close = unescape(formatted[start:m.start(2)]), m.end(), "text", "<|end|>"
        else:
            if what != close:
                return None
            turns.append((role, unescape(formatted[start:m.start(2)])))
            state, at = "between", m.end()
    return turns if state == "between" and at == len(formatted) else None


def round_trip(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], int]:
    """Escape content until the parse equals the source: first no turn, then those
    whose own rendering doesn't come back, last all. Returns text, mask, turns escaped."""
    escaped: set[int] = set()
    for widen in (lambda: {i for i, t in enumerate(turns) if parse(render([t], set())[0]) != [t]},
                  lambda: set(range(len(turns))), None):
        formatted, mask = render(turns, escaped)
        if parse(formatted) == turns:
            return formatted, mask, len(escaped)
        if widen:
            escaped = widen()
    raise ValueError("a conversation does not survive its round trip")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in, a formatted conversation a row out; only one conversation is held."""
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())),
                        ("loss_ends", pa.list_(pa.int64())), ("turns_escaped", pa.int64())])
    done: list[tuple] = []
    size = 0

    def flush():
        cols = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def close(conv, turns):
        formatted, mask, n = round_trip(turns)
        done.append((conv, formatted, [a for a, _ in mask], [b for _, b in mask], n))
        return len(formatted)

    conv, turns, first = None, [], True
    for b in batches:
        ids, roles, bodies = (b.column(c).to_pylist() for c in ("conv_id", "role", "text"))
        for i, role, body in zip(ids, roles, bodies):
            if first or i != conv or i is None:
                if not first:
                    size += close(conv, turns)
                    if size > 4_000_000:
                        yield flush()
                        size = 0
                conv, turns, first = i, [], False
            turns.append((role, body))
    if not first:
        close(conv, turns)
    if done:
        yield flush()


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_starts, loss_ends, turns_escaped.

    Turns go by ``turn``; ties by role, then text; a null turn comes first. Null roles and
    texts are empty strings. A row without a conv_id is a conversation of its own with a null id.
    Repeated rows are turns of their own. An empty table gives an empty table. Other columns
    are not read. ``loss_starts``/``loss_ends`` are code points in ``formatted`` around each assistant text.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
                             F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))  # rows without an id are spread
    return (c.repartition("conv_id", alone).sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text")
            .mapInArrow(_rows, "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>, turns_escaped long"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for b in batches:
        out = []
        for conv, text, starts, ends in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends"))):
            turns = parse(text)
            said = hashlib.sha256()
            for role, body in turns:
                said.update(f"{role}\n{body}\n".encode())
            loss, chars = hashlib.sha256(), 0
            for s, e in zip(starts, ends):
                body = unescape(text[s:e])
                loss.update(body.encode())
                chars += len(body)
            out.append((conv, len(turns), said.hexdigest(), chars, loss.hexdigest(), len(text)))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What a reader of ``formatted`` gets back from it: turns and text under the loss mask, as digests."""
    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
