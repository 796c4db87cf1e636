"""Chat formatting by columnar byte assembly, and reading formatted conversations back.

Turns are dealt by ranges of (conversation, turn), so that a very long conversation spreads over tasks. A task computes
the lengths of all segments of a batch (start mark, role, line end, text, end mark), their cumulative offsets and the
places that each column's bytes scatter to, in numpy, and copies every column once into one preallocated Arrow buffer.
The result is pieces of conversations of bounded size, with the byte ranges under the loss mask.

Control strings inside texts get a backslash after their `<`, one more than they have, and lose it when read back; so
`<|` only ever begins a mark. Line ends and backslashes in roles are escaped too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, utf8, written

START, LINE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
#: Bytes of a piece of a conversation, beyond which the next turn begins a new piece.
PIECE_BYTES = 1 << 20
PIECES = "conv_id long, piece long, formatted string, loss array<long>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escaped(column: pa.Array) -> pa.Array:
    """Texts in which no `<|` is left."""
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def escaped_role(column: pa.Array) -> pa.Array:
    """Roles without line ends and `<|`."""
    return escaped(pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n"))


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescaped(role))


def assembled(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns' bytes in one buffer, the n + 1 offsets of the turns, and where each turn's text begins."""
    n = len(role)
    constant = [np.frombuffer(x, np.uint8) for x in (START, LINE, END)]
    columns = [utf8(escaped_role(role)), utf8(escaped(text))]
    length = np.empty((n, 5), np.int64)
    length[:, 0], length[:, 2], length[:, 4] = (len(c) for c in constant)
    length[:, 1], length[:, 3] = (np.diff(at) for _, at in columns)
    ends = np.cumsum(length.ravel()).reshape(n, 5)
    begins = ends - length
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, c in zip((0, 2, 4), constant, strict=True):
        out[begins[:, k, None] + np.arange(len(c))] = c
    for k, (raw, at) in zip((1, 3), columns, strict=True):
        out[np.repeat(begins[:, k] - at[:-1], length[:, k]) + np.arange(len(raw))] = raw
    return out, np.append(0, ends[:, -1]), begins[:, 3]


def formatted(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Pieces of all conversations: conv_id, piece (its order), formatted, and loss, the begin and end bytes in the piece of each text of loss_role.

    Turns need conv_id, turn, role and text; other columns are not read. Turns are ordered by turn, then role and text,
    nulls first; null roles and texts are empty, and all turns with a null conv_id are one conversation. A piece has
    whole turns of one conversation.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column(0)
            out, ends, text_at = assembled(batch.column(1), batch.column(2))
            code = conv.fill_null(0).to_numpy()
            null = conv.is_null().to_numpy(zero_copy_only=False)
            cut = np.append(True, (code[1:] != code[:-1]) | (null[1:] != null[:-1]))
            first = [0]
            for i in range(1, n):
                if cut[i] or ends[i + 1] - ends[first[-1]] > PIECE_BYTES:
                    first.append(i)
            first = np.array(first)
            own = np.searchsorted(first, np.arange(n), side="right") - 1
            base = ends[first][own]
            masked = pc.equal(batch.column(1), loss_role).to_numpy(zero_copy_only=False)
            spans = np.stack([text_at - base, ends[1:] - len(END) - base], 1)[masked].ravel()
            spans_of = np.append(0, np.cumsum(np.bincount(own[masked], minlength=len(first)) * 2))
            data = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(ends[first], ends[-1]).astype(np.int64)), pa.py_buffer(out))
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(piece + np.arange(len(first))), data.cast(pa.string()), pa.ListArray.from_arrays(pa.array(spans_of, pa.int32()), pa.array(spans))], ["conv_id", "piece", "formatted", "loss"])
            piece += len(first)

    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(assemble, PIECES)


class _Reader:
    """What is read back of one conversation, piece by piece."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, text: str, loss: list[int]) -> None:
        self.chars += len(text)
        at = 0
        for m in _TURN.finditer(text):
            if m.start() != at:
                raise ValueError("text between turns")
            at = m.end()
            self.n += 1
            self.turns.update(f"{unescaped_role(m[1])}\n{unescaped(m[2])}\n".encode())
        if at != len(text):
            raise ValueError("text after the last turn")
        raw = text.encode() if loss else b""
        for a, b in zip(loss[::2], loss[1::2], strict=True):
            part = unescaped(raw[a:b].decode())
            self.loss_chars += len(part)
            self.loss.update(part.encode())

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame) -> DataFrame:
    """Turns and masked text of formatted conversations as counts and digests, one row for each conversation.

    Pieces of a conversation arrive in order and are read one at a time, so that its length doesn't count in memory.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reader | None = None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in DIGEST.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            done = []
            for conv, text, loss in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = _Reader(conv)
                now.add(text.as_py(), loss.as_py())
            if done:
                yield made(done)
        if now:
            yield made([now.row()])

    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return dealt.select("conv_id", "formatted", "loss").mapInArrow(read, DIGEST)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts hold the template's own marks, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    return read_back(written(formatted(turns.unionByName(more)), "pieces"))
