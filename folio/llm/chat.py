"""Chat formatting in budgeted windows (operator 1).

Turns are formatted as `<|turn|>role` newline `text<|end|>` newline, with control strings inside roles and
texts escaped reversibly. Running sums of turn tokens cut each conversation into turn-aligned windows of at
most `budget` tokens: every window repeats the leading system turn and up to `history` tokens of the turns
before it, and only assistant texts that are new in a window are under its loss mask. A window holds one turn
at least, so a turn longer than the budget makes a longer window, marked over_budget; nothing is cut.

Conversations stream through sorted partitions; a task holds one window and its history, not a conversation.

Defined results: null text and null role count as empty; rows with a null conv_id form one conversation; null
turns come first; rows that share a turn number are ordered by role, then text, and repeated rows are turns of
their own; an empty table gives no windows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import common
from folio.llm.tokens import encoder

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: First characters of control strings of chat templates: any `<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`, `<<SYS>>`, `<</SYS>>`.
_CONTROL = re.compile(r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\([\\&n])")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.DOTALL)

WINDOW = "conv_id long, window int, text string, turns int, repeated int, loss array<struct<begin:int,end:int>>, tokens long, over_budget boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    r"""Double each backslash and put \& after the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0] + "\\&", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", "&": "", "n": "\n"}[m[1]], text)


class _Conversation:
    """Windows of one conversation, turn by turn."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.windows, self.system = 0, None
        #: (formatted, role, length of what stands before the text) of the turns kept, and prefix sums of their tokens
        self.turns: list[tuple[str, str, int]] = []
        self.sums = [0]
        self.first_new = 0

    def add(self, turn: tuple[str, str, int], tokens: int) -> Iterator[tuple]:
        if self.system is None:
            self.system = (turn, tokens) if turn[1] == "system" else ()
        base = self.system[1] if self.system and self.windows else 0  # the first window holds it as a new turn
        if len(self.turns) > self.first_new and base + self.sums[-1] - self.sums[0] + tokens > self.budget:
            yield self.close()
            base = self.system[1] if self.system else 0
            # the earliest turn from which history fits its own limit and, with the new turn, the budget
            room = min(self.history, self.budget - base - tokens)
            keep = min(bisect_left(self.sums, self.sums[-1] - room) if room > 0 else len(self.turns), len(self.turns))
            if self.system and self.windows == 1:
                keep = max(keep, 1)  # the system turn is repeated anyhow
            self.turns, self.sums = self.turns[keep:], self.sums[keep:]
            self.first_new = len(self.turns)
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + tokens)

    def close(self) -> tuple:
        shown, tokens = self.turns, self.sums[-1] - self.sums[0]
        repeated = self.first_new
        if self.system and self.windows:
            shown, tokens, repeated = [self.system[0], *shown], tokens + self.system[1], repeated + 1
        loss, at = [], 0
        for k, (formatted, role, head) in enumerate(shown):
            if k >= repeated and role == "assistant":
                loss.append({"begin": at + head, "end": at + len(formatted) - len(CLOSE)})
            at += len(formatted)
        row = (self.conv_id, self.windows, "".join(t[0] for t in shown), len(shown), repeated, loss, tokens, tokens > self.budget)
        self.windows += 1
        return row


_WINDOW_TYPES = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.int64(), pa.bool_())
_WINDOW_NAMES = ["conv_id", "window", "text", "turns", "repeated", "loss", "tokens", "over_budget"]


def _windows(vocabulary: str, budget: int, history: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, conv, out, size = encoder(vocabulary, True), None, [], 0
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _WINDOW_TYPES)], _WINDOW_NAMES)
        for batch in common.byte_slices(batches, "text", 2_000_000):
            ids, roles, texts = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "role", "text"))
            heads = [f"{OPEN}{escape_role(r)}\n" for r in roles]
            turns = [h + escape(t) + CLOSE for h, t in zip(heads, texts)]
            tokens = np.diff(enc.encode(pa.array(turns, pa.string()))[1]).tolist()
            for conv_id, role, head, turn, n in zip(ids, roles, heads, turns, tokens):
                if conv is None or conv.conv_id != conv_id:
                    if conv is not None:
                        out.append(conv.close())
                    conv = _Conversation(conv_id, budget, history)
                out += conv.add((turn, role, len(head)), n)
                size += len(turn)
                if size > 4_000_000 and out:
                    yield batch_of(out)
                    out, size = [], 0
        if conv is not None:
            out.append(conv.close())
        if out:
            yield batch_of(out)

    return run


def chat_windows(conversations: DataFrame, vocabulary: str, budget: int = 2048, history: int = 512) -> DataFrame:
    """Formatted windows of conversations (conv_id, turn, role, text)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(_windows(vocabulary, budget, history), WINDOW)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order -> a digest of each conversation, parsed back from the formatted text and its mask."""
    state, out = None, []

    def done(s):
        return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

    for batch in common.byte_slices(batches, "text", 4_000_000):
        for conv_id, text, repeated, loss in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "text", "repeated", "loss"))):
            if state is None or state[0] != conv_id:
                if state is not None:
                    out.append(done(state))
                state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for k, m in enumerate(_TURN.finditer(text)):
                if k >= repeated:
                    state[1] += 1
                    state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            for span in loss:
                target = unescape(text[span["begin"] : span["end"]])
                state[3] += len(target)
                state[4].update(target.encode())
            state[5] += len(text)
    if state is not None:
        out.append(done(state))
    if out:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(windows: DataFrame) -> DataFrame:
    """A row per conversation, from its windows alone."""
    dealt = windows.select("conv_id", "window", "text", "repeated", "loss").repartition("conv_id")
    return dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "window").mapInArrow(_digests, DIGEST)


def op1_chat_windows(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(chat_windows(rows.unionByName(extra), vocabulary or public_tokenizers.path("byte_bpe_50k.json")))
