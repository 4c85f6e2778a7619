"""Chat formatting by token-level assembly.

Each turn's segments (markers, role, text) are encoded separately. Markers are reserved ids spliced in between, so no
text can produce them; control strings that occur in texts are escaped all the same, for readers of the decoded form.
Masks and offsets are prefix sums over segment lengths.

Control strings: <s> begins a conversation; [INST] text [/INST] is a user's turn, <<SYS>> text <</SYS>> a system turn,
text </s> an assistant's, [ROLE] role [/ROLE] text </s> anyone else's (blanks here only for reading). In texts and
roles a backslash is doubled and a control string gets a backslash after its first character.

Scale: encoding, the costly part, works on rows as they come. Assembly streams over conversations that are sorted
within partitions and holds one batch, however long a conversation is; what it gives are chunks of sequences.

Defined cases: a null text or role is empty; null conversation ids are one conversation; rows are ordered by turn (null
first), then role and text; repeated rows are turns of their own; an empty table gives an empty result; further columns
are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_bytes

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_BEGIN, _END, _INST, _INST_END, _SYS, _SYS_END, _ROLE, _ROLE_END = range(8)
_AROUND = {"user": (_INST, _INST_END), "system": (_SYS, _SYS_END), "assistant": (None, _END)}
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    # a lookahead, so that control strings that overlap are each broken
    return _BREAK.sub(lambda m: m[0] + "\\", text) if "<" in text or "[" in text else text


_BREAK = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class Encoder:
    """Byte-level BPE from a file of ranks; the reserved ids follow the vocabulary."""

    _own: dict[int, Encoder] = {}

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.plain = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.first = max(table.values()) + 2

    @classmethod
    def of(cls, ranks: bytes, pattern: str) -> Encoder:
        if (key := hash((ranks, pattern))) not in cls._own:
            cls._own[key] = cls(ranks, pattern)
        return cls._own[key]

    def segments(self, role: str, text: str) -> list[tuple[list[int], bool]]:
        """Ids with whether they are learned, one segment after the other."""
        text = self.plain.encode_ordinary(escape(text))
        before, after = _AROUND.get(role, (_ROLE, _END))
        head = [] if before is None else [([self.first + before], False)]
        if before == _ROLE:
            head += [(self.plain.encode_ordinary(escape(role)), False), ([self.first + _ROLE_END], False)]
        return [*head, (text, role == "assistant"), ([self.first + after], False)]

    def decode(self, ids: list[int]) -> str:
        return self.plain.decode(ids)


def _turns(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks.value, pattern)
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                ids, lengths, learned = [], [], []
                for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = encoder.segments(role or "", text or "")
                    ids.append(np.array([i for x, _ in own for i in x], dtype="<u4").tobytes())
                    lengths.append([len(x) for x, _ in own])
                    learned.append([m for _, m in own])
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), part.column("tie"), pa.array(ids, pa.binary()), pa.array(lengths, pa.list_(pa.int32())), pa.array(learned, pa.list_(pa.bool_()))],
                    ["conv_id", "turn", "tie", "ids", "lengths", "learned"],
                )

    return run


def _assemble(first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, offset, fresh = None, 0, True
        for batch in batches:
            out = []
            for c, ids, lengths, learned in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "ids", "lengths", "learned")], strict=True):
                begins = fresh or c != conv
                if begins:
                    conv, offset, fresh = c, 0, False
                    ids, lengths, learned = np.uint32(first + _BEGIN).tobytes() + ids, [1, *lengths], [False, *learned]
                # the mask: +1 where a learned segment begins, -1 where it ends, summed up
                ends = np.cumsum(lengths)
                edges = np.zeros(ends[-1] + 1, dtype="i1")
                for e, n, m in zip(ends, lengths, learned, strict=True):
                    if m and n:
                        edges[e - n] += 1
                        edges[e] -= 1
                out.append((c, offset, ids, np.cumsum(edges[:-1], dtype="i1").tobytes()))
                offset += int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], batch.schema.field("conv_id").type), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.binary())],
                ["conv_id", "start", "ids", "mask"],
            )

    return run


def format_chats(turns: DataFrame, ranks_path: str, pattern: str, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, start, ids (unsigned 32 bits each, little-endian), mask (a byte an id, 1: learned), in order within partitions.

    The chunks of a conversation, by start, are its sequence.
    """
    raw_ranks = read_bytes(ranks_path)
    ranks = turns.sparkSession.sparkContext.broadcast(raw_ranks)
    first = Encoder.of(raw_ranks, pattern).first
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.struct(role.alias("role"), F.xxhash64(text).alias("text")).alias("tie"), role.alias("role"), text.alias("text"))
    coded = rows.mapInArrow(_turns(ranks, pattern), "conv_id long, turn long, tie struct<role:string,text:long>, ids binary, lengths array<int>, learned array<boolean>")
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "tie", "ids")
    return ordered.mapInArrow(_assemble(first), "conv_id long, start long, ids binary, mask binary")


def read_back(formatted: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """What format_chats() gave, read turn by turn from its ids alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ranks = formatted.sparkSession.sparkContext.broadcast(read_bytes(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks.value, pattern)
        first, state = encoder.first, None
        names = {v: k for k, v in _AROUND.items()}
        closers = {None: "assistant", **{b: names[b, e] for b, e in _AROUND.values() if b is not None}}
        done = []

        def finish() -> None:
            if state:
                done.append((state["conv"], state["turns"], state["sha"].hexdigest(), state["loss"], state["loss_sha"].hexdigest(), state["chars"]))

        for batch in batches:
            for c, start, ids, mask in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "start", "ids", "mask")], strict=True):
                if start == 0:
                    finish()
                    state = {"conv": c, "turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0, "open": None, "role": None}
                ids, mask = np.frombuffer(ids, dtype="<u4"), np.frombuffer(mask, dtype="i1")
                marks = np.flatnonzero(ids >= first)
                before = 0
                for m in marks:
                    part = encoder.decode(ids[before:m].tolist())
                    mark = int(ids[m]) - first
                    state["chars"] += len(part) + len(CONTROLS[mark])
                    if mark in (_INST, _SYS, _ROLE):
                        state["open"] = mark
                    elif mark == _ROLE_END:
                        state["role"] = unescape(part)
                    elif mark != _BEGIN:
                        role = state["role"] if state["open"] == _ROLE else closers[state["open"]]
                        text = unescape(part)
                        state["sha"].update(f"{role}\n{text}\n".encode())
                        state["turns"] += 1
                        state["open"] = None
                    on = np.flatnonzero(mask[before : m + 1])
                    if len(on):
                        learned = unescape(encoder.decode(ids[before + on[0] : before + on[-1] + 1].tolist()))
                        state["loss"] += len(learned)
                        state["loss_sha"].update(learned.encode())
                    before = m + 1
            yield _digests(done)
            done = []
        finish()
        yield _digests(done)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
