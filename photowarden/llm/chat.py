"""Chat formatting by incremental black-box rendering.

A template is any function from a list of messages to a string. Rendering the first 0, 1, ... n messages and comparing
consecutive outputs locates every turn's span without knowing the template; rendering a turn with a marker in place of
its text locates the text inside the span. A template whose output for a longer prefix does not start with the output
for the shorter one rewrites history: that is reported by turn, and no span before it is trusted.

Rendering every prefix, plain and with the marker, costs a conversation of n turns the length of its 2n outputs: that is the
price for knowing nothing of the template. The default template goes on from what it rendered last, so a prefix costs it a
turn and a copy.

Defined results: null text or role is empty; very long texts are kept whole; a text or role may hold control strings or
any marker; turns are ordered by (turn, role, text), so repeated rows stay and ties
have one order; a null conv_id is one more conversation; an empty table gives no rows; extra columns are ignored.
A conversation is the unit of rendering: its turns are held by one task.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photowarden.llm import common

Message = dict[str, str]
#: Control strings of the default template.
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Reversible; the result holds no control string, because "<|" never occurs in it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


#: The last renderings of the default template: messages and output.
_RECENT: deque[tuple[list[Message], str]] = deque(maxlen=3)


def marked_template(messages: list[Message]) -> str:
    """The default template: a start mark with the role, the escaped text, an end mark. Messages aren't changed in place
    between renderings."""
    if not messages:
        return ""
    head = messages[:-1]
    before = next((out for made, out in _RECENT if made == head), None)
    if before is None:
        before = "".join(map(_marked_turn, head))
    out = before + _marked_turn(messages[-1])
    _RECENT.append((list(messages), out))
    return out


def _marked_turn(m: Message) -> str:
    return f"{START}{escape_role(m['role'])}\n{escape(m['text'])}{END}\n"


def parse_marked(output: str) -> list[tuple[str, str]]:
    """Roles and texts read back from the default template's output."""
    at, turns = 0, []
    while at < len(output):
        m = _TURN.match(output, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def unused(messages: list[Message]) -> str:
    """A marker that no role or text of the conversation holds."""
    mark = "\x02mark\x03"
    held = "\n".join(v for m in messages for v in m.values() if "\x02" in v)
    k = 0
    while mark in held:
        k += 1
        mark = f"\x02mark{k}\x03"
    return mark


def locate(messages: list[Message], render: Callable[[list[Message]], str]) -> dict:
    """Output, turn spans, text spans and the turns at which the template rewrote its earlier output."""
    before, spans, texts, rewrites, mark = render([]), [], [], [], unused(messages)
    for k, m in enumerate(messages):
        now = render(messages[: k + 1])
        if not now.startswith(before):
            rewrites.append(k)
            same = next((i for i, (a, b) in enumerate(zip(before, now, strict=False)) if a != b), min(len(before), len(now)))
            spans = [s if s and s[1] <= same else None for s in spans]
            texts = [t if t and t[1] <= same else None for t in texts]
            spans.append(None)
            texts.append(None)
            before = now
            continue
        start, end = len(before), len(now)
        spans.append((start, end))
        probe = render([*messages[:k], {**m, "text": mark}])
        at = probe.find(mark, start) if probe.startswith(before) else -1
        if at < 0:
            texts.append(None)
        else:
            tail = len(probe) - at - len(mark)
            texts.append((at, end - tail) if at <= end - tail else None)
        before = now
    return {"output": before, "spans": spans, "texts": texts, "rewrites": rewrites}


def format_conversations(rows: DataFrame, render: Callable[[list[Message]], str] = marked_template, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, n_turns, spans (start, end, text start, text end; -1: not located),
    loss (start, end) of the texts under the loss mask, rewrites (turns at which the template rewrote history)."""
    common.prepare(rows.sparkSession)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches):
        for batch in common.slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                messages = [{"role": t["role"], "text": t["text"]} for t in turns]
                got = locate(messages, render)
                spans = [[*(s or (-1, -1)), *(t or (-1, -1))] for s, t in zip(got["spans"], got["texts"], strict=True)]
                loss = [list(t) for m, t in zip(messages, got["texts"], strict=True) if m["role"] == loss_role and t]
                for column, value in zip(out, (conv, got["output"], len(messages), spans, loss, got["rewrites"]), strict=True):
                    column.append(value)
            pairs = pa.list_(pa.list_(pa.int64()))
            kinds = [pa.int64(), pa.string(), pa.int64(), pairs, pairs, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["conv_id", "formatted", "n_turns", "spans", "loss", "rewrites"])

    return grouped.mapInArrow(run, "conv_id long, formatted string, n_turns long, spans array<array<long>>, loss array<array<long>>, rewrites array<long>")


def read_back(formatted: DataFrame, parse: Callable[[str], list[tuple[str, str]]] = parse_marked, plain: Callable[[str], str] = unescape) -> DataFrame:
    """Digests of what the formatted strings hold: turns, text under the loss mask, length in characters. An output that
    `parse` refuses ends the read."""
    common.prepare(formatted.sparkSession)

    def run(batches):
        for batch in common.slices(batches):
            rows = []
            for conv, output, loss in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                turns = parse(output)
                under = "".join(plain(output[a:b]) for a, b in loss)
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(under), sha(under), len(output)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
