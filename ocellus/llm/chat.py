"""Chat formatting by assembling tokens.

Role and text of every turn are encoded on their own and put between reserved ids that no text can produce, so no content can
forge a turn. Control strings in a content are escaped as well, so that the written-out form is unambiguous: a backslash goes
in after their first character, and backslashes are doubled. Where each segment begins, and so the loss mask, follows from
prefix sums of segment lengths.

The token stream of a conversation is kept as one row per turn with its offset, so a conversation of any length needs no more
memory than its longest turn. Reading back goes through the turns in order, since a digest of a conversation is sequential.

Defined cases: a null role or text is empty; a null ``turn`` comes first; rows that share conversation and turn are ordered by
role and text, and repeated rows are turns of their own; all rows with a null ``conv_id`` are one conversation; texts of any length
are encoded pre-token by pre-token, in time that grows with their length; other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocellus.llm import bpe

# Control strings of this template and of common others.
CONTROLS = ["<|turn|>", "<|body|>", "<|end|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TURN, BODY, END = CONTROLS[:3]
LOSS_ROLE = "assistant"

_ESCAPES = re.compile(r"\\|" + "|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\\\|\\(?!\\)")


def escape(text: str) -> str:
    """``text`` without any control string; :func:`unescape` brings it back."""
    return _ESCAPES.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if len(m[0]) == 2 else "", text)


class Template:
    """A byte-level vocabulary plus three reserved ids right after it."""

    def __init__(self, path: str):
        self.plain = bpe.coder(path)
        top = max(self.plain.tokens) + 2  # one id above the ranks is taken by the vocabulary's own end mark
        self.turn, self.body, self.end = top, top + 1, top + 2
        self.names = {self.turn: TURN, self.body: BODY, self.end: END}

    def segments(self, role: str, text: str) -> list[list[int]]:
        """The segments of a turn, reserved ids included, each encoded on its own."""
        enc = self.plain.encode
        return [[self.turn], enc(escape(role)), [self.body], enc(escape(text)), [self.end]]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.plain.tokens.__getitem__, ids)).decode()

    def render(self, ids: list[int]) -> str:
        """The written-out form of a token stream."""
        out, begin = [], 0
        for i, x in enumerate(ids):
            if x in self.names:
                out += [self.decode(ids[begin:i]), self.names[x]]
                begin = i + 1
        return "".join(out) + self.decode(ids[begin:])

    def parse(self, ids: list[int]) -> list[tuple[str, str]]:
        """(role, text) of each turn of a token stream."""
        turns, begin, role = [], 0, ""
        for i, x in enumerate(ids):
            if x == self.body:
                role = unescape(self.decode(ids[begin:i]))
            elif x == self.end:
                turns.append((role, unescape(self.decode(ids[begin:i]))))
            if x in self.names:
                begin = i + 1
        return turns


@lru_cache(maxsize=2)
def template(path: str) -> Template:
    return Template(path)


def format_turns(conversations: DataFrame, path: str) -> DataFrame:
    """One row per turn: conv_id, pos (from 0), ids, offset (tokens of the conversation before it), loss_begin and loss_end
    (the part of the conversation's stream under the loss mask; equal where nothing is)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(path)
        for batch in batches:
            ids, at, size = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                parts = own.segments(role, text)
                ids.append(sum(parts, []))
                at.append(sum(map(len, parts[:3])))
                size.append(len(parts[3]) if role == LOSS_ROLE else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(at, pa.int64()), pa.array(size, pa.int64())], ["conv_id", "turn", "role", "text", "ids", "at", "size"])

    made = rows.mapInArrow(run, "conv_id long, turn long, role string, text string, ids array<int>, at long, size long")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.size("ids").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = made.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "ids", before.alias("offset"), "at", "size")
    begin = F.col("offset") + F.col("at")
    return placed.select("conv_id", "pos", "ids", "offset", begin.alias("loss_begin"), (begin + F.col("size")).alias("loss_end"))


def assemble(turns: DataFrame) -> DataFrame:
    """conv_id, ids and mask (0 or 1 per id) as whole arrays, for conversations that fit in a row."""
    parts = turns.withColumn("mask", F.transform(F.sequence(F.col("offset"), F.col("offset") + F.size("ids") - 1), lambda i: F.when((i >= F.col("loss_begin")) & (i < F.col("loss_end")), 1).otherwise(0)))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids", "mask"))).alias("parts"))
    return whole.select("conv_id", F.flatten("parts.ids").alias("ids"), F.flatten("parts.mask").alias("mask"))


def read_back(turns: DataFrame, path: str) -> DataFrame:
    """Digest of each conversation, worked out from its token stream and mask alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    # Window in format_turns has dealt and sorted the rows by conversation and position already; this keeps it so if a caller has not.
    dealt = turns.select("conv_id", "pos", "ids", "offset", "loss_begin", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = template(path), []
        now: object = run  # no conversation yet
        n = loss = chars = 0
        turn_sha = loss_sha = hashlib.sha256()

        def close() -> None:
            out.append((now, n, turn_sha.hexdigest(), loss, loss_sha.hexdigest(), chars))

        def flush() -> pa.RecordBatch:
            rows = list(zip(*out, strict=True)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

        for batch in batches:
            for conv, _, ids, offset, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    if now is not run:
                        close()
                    now, n, loss, chars, turn_sha, loss_sha = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in own.parse(ids):
                    n += 1
                    turn_sha.update(f"{role}\n{text}\n".encode())
                masked = unescape(own.decode(ids[begin - offset : end - offset]))
                loss += len(masked)
                loss_sha.update(masked.encode())
                chars += len(own.render(ids))
            yield flush()
        if now is not run:
            close()
        yield flush()

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
