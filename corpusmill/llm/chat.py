"""Chat formatting that is proved by reparsing: what the parser recovers must equal the source.

A turn is ``<|turn|>role``, a newline, the text, ``<|end|>`` and a newline. The parser accepts no control
string inside a text; where a text holds one (of this template or of other well-known ones), a backslash
goes behind its first character, and one more is added to each text that already looks escaped.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Control strings of this template and of other public chat templates.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_RAW = re.compile(rf"([<\[])(?={_TAILS})")
_LIKE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")
_TURN = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}\n", re.S)
RENDERED = "conv_id long, seq long, formatted string, start long, loss_start long, loss_end long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class GrammarError(ValueError):
    """The text is not a sequence of turns of this template."""


def escape(text: str) -> str:
    return _LIKE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation; GrammarError if it is none."""
    turns, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m or _RAW.search(m[1]) or _RAW.search(m[2]):
            raise GrammarError(f"no turn at character {at}")
        turns.append((_role_in(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the span of its text. The text goes in as it is if that parses back to the
    same turn, else escaped; whatever is returned has been parsed back and compared."""
    head = f"{OPEN}{_role_out(role)}\n"
    for body in (text, escape(text)):
        out = f"{head}{body}{CLOSE}\n"
        try:
            if parse(out) == [(role, text)]:
                return out, len(head), len(head) + len(body)
        except GrammarError:
            pass
    raise GrammarError("a turn does not survive the round trip")


def _render(loss_role: str):
    def run(batches):
        conv, seq, at = (), 0, 0  # one conversation at a time, whatever its length
        for batch in batches:
            out = []
            for c, role, text in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if c != conv:
                    conv, seq, at = c, 0, 0
                formatted, a, b = render_turn(role or "", text or "")
                learn = role == loss_role
                out.append((c, seq, formatted, at, at + a if learn else None, at + b if learn else None))
                seq, at = seq + 1, at + len(formatted)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["conv_id", "seq", "formatted", "start", "loss_start", "loss_end"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return run


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """A row per turn: conv_id, seq (from 0), formatted, start (its offset in the conversation's text) and the
    span [loss_start, loss_end) of that text under the loss mask (null for other roles).

    The rows of a conversation lie in one partition in order, so its text is the concatenation of
    ``formatted``; a turn at a time is held, so a conversation of any length passes. Order: turn (null
    first), then role, then text. Null text or role counts as empty; a null conv_id is a conversation of
    its own; repeated rows are repeated turns. Further columns are ignored; no rows give no rows.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")
    return in_batches(rows, _render(loss_role), RENDERED)


def _digest(batches):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def close(s):
        return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

    state = None
    for batch in batches:
        out = []
        for c, _, formatted, start, a, b in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if state is None or c != state[0]:
                if state:
                    out.append(close(state))
                state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if a is not None:
                learnt = unescape(formatted[a - start : b - start])
                state[3] += len(learnt)
                state[4].update(learnt.encode("utf-8", "surrogatepass"))
            state[5] += len(formatted)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(close(state), kinds, strict=True)], names)


def conversation_digest(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from the output of ``format_conversations`` by the parser.

    The rows must lie as ``format_conversations`` left them. Null ids are one conversation, no rows give no rows;
    a conversation without a turn under the loss mask has 0 characters and the hash of the empty text.
    """
    return in_batches(rendered, _digest, DIGEST)
