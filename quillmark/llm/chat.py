"""Chat formatting with budgeted windows.

A conversation's turns, in order, are rendered under a template whose control strings are escaped
inside texts.  Where a budget is given, prefix sums of turn sizes choose spans aligned to turns:
each window repeats the system turn and up to ``history`` of the budget of turns before it, and
targets that an earlier window has shown are masked.  Without a budget there is one window.  The
query's budget is ``BUDGET`` tokens; a turn's size is its rendered text's tokens, taken by itself.

Escaping: an escape sign U+001B is put after the first character of every control string and after
every escape sign, so no control string is left in a text and one removal of the signs inverts it.
The template: ``<s>`` once, then per turn ``[TURN] role`` newline text ``[/TURN]``; an assistant text
is followed by ``</s>``.  Loss covers assistant texts only.

Defined cases: a null text is empty; a null role or turn is rendered empty or first; equal turns
keep every row, ordered by turn, role, text; a null conv_id is a conversation of its own; a
conversation without assistant turns has an empty mask; an empty table gives only what is added;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing
from . import vectext as V
from .tables import table

BEGIN, END = "<s>", "</s>"
OPEN, CLOSE = "[TURN]", "[/TURN]"
CONTROL = (BEGIN, END, OPEN, CLOSE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESC = "\x1b"
TARGET = "assistant"
#: Tokens of a window: those of a packed sequence.
BUDGET = packing.CAPACITY
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL) + "|" + ESC)
_ESCAPED = re.compile(f"(?s)(.){ESC}")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + ESC + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _line(role: str) -> str:
    return escape(role.replace(ESC, ESC + "e").replace("\n", ESC + "n"))


def _unline(head: str) -> str:
    return re.sub(f"{ESC}[en]", lambda m: ESC if m[0][1] == "e" else "\n", unescape(head))


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text, and where its own text lies in it."""
    head, body = f"{OPEN} {_line(role)}\n", escape(text)
    return head + body + CLOSE + (END if role == TARGET else ""), len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    out = []
    for part in formatted.removeprefix(BEGIN).split(OPEN + " ")[1:]:
        head, _, rest = part.partition("\n")
        out.append((_unline(head), unescape(rest[: rest.rindex(CLOSE)])))
    return out


def windows(sizes: list[int], fixed: int, budget: int, history: float) -> Iterator[tuple[int, int, int]]:
    """(first shown, first new, end) of turns: prefix sums pick the longest run of new turns that
    fits beside ``fixed`` and a repeated history of at most its share.  A turn over the budget
    stands alone, whole."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    room, new = max(budget - fixed, 1), 0
    while new < len(sizes):
        back = bisect_left(total, total[new] - int(room * history))
        if total[new + 1] - total[back] > room:
            back = min(bisect_left(total, total[new + 1] - room), new)
        end = new + 1
        while end < len(sizes) and total[end + 1] - total[back] <= room:
            end += 1
        yield back, new, end
        new = end


def _windowed(made: list[tuple[str, int, int]], roles: list[str], sizes: list[int] | None, budget: int | None, history: float) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
    """(formatted, loss spans as character ranges, leading turns that repeat) of each window of
    rendered turns with their sizes."""
    lead = bool(budget) and bool(roles) and roles[0] == "system"
    fixed = made[0][0] if lead else ""
    body, roles = made[lead:], roles[lead:]
    if budget is None or not body:
        spans = [(0, 0, len(body))]
    else:
        spans = windows(sizes[lead:], sizes[0] if lead else 0, budget, history)
    for back, new, end in spans:
        text, loss = [BEGIN, fixed], []
        at = len(BEGIN) + len(fixed)
        for k in range(back, end):
            if k >= new and roles[k] == TARGET:
                loss.append((at + body[k][1], at + body[k][2]))
            text.append(body[k][0])
            at += len(body[k][0])
        yield "".join(text), loss, (lead + new - back if new else 0)


def format_conversation(turns: Iterable[tuple[str, str]], budget: int | None = None, history: float = 0.25) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(formatted, loss spans as character ranges) of each window; the budget is in characters."""
    rows = [(r or "", t or "") for r, t in turns]
    made = [render_turn(*r) for r in rows]
    room = max(1, budget - len(BEGIN)) if budget else None
    for text, loss, _ in _windowed(made, [r for r, _ in rows], [len(m[0]) for m in made], room, history):
        yield text, loss


def token_sizes(path: str) -> Callable[[list[str]], list[int]]:
    """The number of tokens of each text."""
    enc = packing._ENCODERS.get(path) or packing._ENCODERS.setdefault(path, packing.WordEncoder(path))

    def sizes(texts: list[str]) -> list[int]:
        raw, offs, _ = V.column(pa.array(texts, pa.string()))
        return [len(x) for i, j in V.slices(offs, 2 << 20) for x in enc.encode(raw, offs, i, j)]

    return sizes


def format_all(conversations: DataFrame, budget: int | None = None, history: float = 0.25) -> DataFrame:
    """conv_id, window, formatted, loss (array of ranges) and repeated (leading turns that an earlier
    window has shown), one row a window; the budget is in tokens.

    Rows are sorted into conversations by the shuffle and streamed through; a task holds one
    conversation's texts at a time."""
    schema = "conv_id bigint, window int, formatted string, loss array<struct<start:bigint,end:bigint>>, repeated int"
    path = packing.tokenizer_path() if budget else None
    loss_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_sizes(path) if path else None
        room = max(1, budget - count([BEGIN])[0]) if path else None

        def out(conv: int | None, turns: list[tuple]) -> Iterator[pa.RecordBatch]:
            made, roles, sizes = map(list, zip(*turns))
            for n, (text, loss, old) in enumerate(_windowed(made, roles, sizes, room, history)):
                spans = [{"start": a, "end": b} for a, b in loss]
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([n], pa.int32()), pa.array([text], pa.string()), pa.array([spans], loss_type), pa.array([old], pa.int32())], ["conv_id", "window", "formatted", "loss", "repeated"])

        key, turns = None, []
        for batch in batches:
            roles = [r or "" for r in batch.column(2).to_pylist()]
            made = [render_turn(r, t or "") for r, t in zip(roles, batch.column(3).to_pylist())]
            sizes = count([m[0] for m in made]) if count else [0] * len(made)  # a batch's turns at once
            for *own, turn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), zip(made, roles, sizes)):
                if own != key and turns:
                    yield from out(key[0], turns)
                    turns = []
                key = own
                turns.append(turn)
        if turns:
            yield from out(key[0], turns)

    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("conv_id").isNull().alias("none"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").cast("bigint").alias("turn"))
    return rows.repartition("conv_id").sortWithinPartitions("none", "conv_id", "turn", "role", "text").select("conv_id", "none", "role", "text").mapInArrow(run, schema)


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, what reading its windows and their masks back in order gives: new turns once,
    and the text under the masks.  The windows of one follow each other, as ``format_all`` leaves them."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        sha = None

        def out() -> pa.RecordBatch:
            row = [conv, n, sha.hexdigest(), chars, under.hexdigest(), size]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for k in range(batch.num_rows):
                own, window, text, loss, old = (batch.column(c)[k].as_py() for c in range(5))
                if window == 0:
                    if sha:
                        yield out()
                    conv, n, chars, size, sha, under = own, 0, 0, len(BEGIN), hashlib.sha256(), hashlib.sha256()
                turns = parse(text)[old:]
                n += len(turns)
                for role, body in turns:
                    sha.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                size += sum(len(OPEN) + 1 + len(x) for x in text.removeprefix(BEGIN).split(OPEN + " ")[1 + old :])
                for s in loss:
                    part = unescape(text[s["start"] : s["end"]])
                    chars += len(part)
                    under.update(part.encode("utf-8", "surrogatepass"))
        if sha:
            yield out()

    return formatted.select("conv_id", "window", "formatted", "loss", "repeated").mapInArrow(run, schema)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role"), F.col("text"))
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(sign).alias("text"))
    return digest(format_all(rows.unionByName(extra), BUDGET))


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(t) + len(regexp_extract_all(t, '</?s>|\[/?TURN\]|\[/?INST\]|<</?SYS>>|\x1b')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
CAST(sum(CASE WHEN r = 'assistant' THEN len(t) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' ORDER BY turn, r, t), '')) AS loss_sha256,
CAST(3 + sum(7 + len(r) + 1 + n + 7 + CASE WHEN r = 'assistant' THEN 4 ELSE 0 END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""
