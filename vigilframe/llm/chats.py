"""Chat formatting: whole conversations in a template, encoded once with offsets, loss masks from turn spans and token spans.

A turn reads ``### User: `` + text + ``</turn>`` and a line break; other roles than the three known ones read ``### Other: `` + role +
``</role>`` + text. These control strings are special tokens of the tokenizer, so no token crosses the border of a text. Inside texts
and roles ``\\`` becomes ``\\\\``, ``###`` ``\\h``, ``</turn>`` ``\\t`` and ``</role>`` ``\\r``, so no control string is left in them and all of it can be undone.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADS = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
OTHER, ROLE_END, TURN_END = "### Other: ", "</role>", "</turn>"
ESCAPES = {"\\": "\\\\", "###": "\\h", TURN_END: "\\t", ROLE_END: "\\r"}

_CONTROL = re.compile("|".join(map(re.escape, ESCAPES)))
_ESCAPED = re.compile("|".join(re.escape(e) for e in ESCAPES.values()))
_BACK = {escaped: plain for plain, escaped in ESCAPES.items()}

FORMATTED = "conv_id long, part int, seq int, edge boolean, n_turns long, text string, tokens array<int>, loss array<boolean>"


@dataclass(frozen=True)
class Format:
    """Tokenizer file (read on every executor), roles under the loss, characters after which a long conversation gets a further row."""

    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.json"
    trained: tuple[str, ...] = ("assistant",)
    piece: int = 1 << 20


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPES[m.group()], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m.group()], text)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The vocabulary at ``path`` with the control strings as special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.add_special_tokens([*HEADS.values(), OTHER, ROLE_END, TURN_END])
    return made


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The formatted text of (role, text) turns, and (role, begin, end) of each turn's text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = HEADS[role] if role in HEADS else OTHER + escaped(role) + ROLE_END, escaped(text)
        out += [head, body, TURN_END, "\n"]
        spans.append((role, at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(TURN_END) + 1
    return "".join(out), spans


def parsed(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; the reverse of ``rendered``."""
    at, known = 0, {head: role for role, head in HEADS.items()}
    while at < len(text):
        end = text.index(TURN_END, at)
        head = next((h for h in known if text.startswith(h, at)), None)
        if head:
            role, begin = known[head], at + len(head)
        else:
            stop = text.index(ROLE_END, at, end)
            if not text.startswith(OTHER, at):
                raise ValueError(f"no head of a turn at {at}")
            role, begin = unescaped(text[at + len(OTHER) : stop]), stop + len(ROLE_END)
        yield role, unescaped(text[begin:end])
        at = end + len(TURN_END) + 1


def loss_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (sorted spans of characters) share a character with one of the sorted ``spans``."""
    mask = np.zeros(len(offsets) + 1, dtype=np.int64)
    if offsets and spans:
        token, span = np.array(offsets, dtype=np.int64), np.array(spans, dtype=np.int64)
        span = span[span[:, 0] < span[:, 1]]
        first = np.searchsorted(token[:, 1], span[:, 0], side="right")
        stop = np.searchsorted(token[:, 0], span[:, 1], side="left")
        np.add.at(mask, first, 1)
        np.add.at(mask, stop, -1)
    return np.cumsum(mask[:-1]) > 0


def _pieces(form: Format):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = tokenizer(form.tokenizer), TaskContext.get().partitionId()

        def piece(conv, seq, edge, turns):
            text, spans = rendered(turns)
            code = coder.encode(text, add_special_tokens=False)
            mask = loss_mask(code.offsets, [(a, b) for role, a, b in spans if role in form.trained])
            columns = [[conv], [part], [seq], [edge], [len(turns)], [text], [code.ids], [mask.tolist()]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)

        seq, now, turns, size, cut, first = 0, None, [], 0, False, True
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if turns and (conv != now or size >= form.piece):
                    more = conv == now
                    # Rows at either end of a partition may have a neighbour in another one.
                    yield piece(now, seq, first or cut or more, turns)
                    first, cut = first and more, more
                    seq, turns, size = seq + 1, [], 0
                now = conv
                turns.append((role or "", text or ""))
                size += len(turns[-1][1])
        if turns:
            yield piece(now, seq, True, turns)

    return run


_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())]
_NAMES = [c.split()[0] for c in FORMATTED.split(", ")]


def formatted(turns: DataFrame, form: Format = Format()) -> DataFrame:
    """Rows of formatted text, token ids and loss mask; a conversation is one row, or several consecutive ones (by part and seq).

    ``turns`` has conv_id (long), turn (long), role and text; further columns are ignored. Turns are in the order of turn, then role, then
    text, nulls first; repeated rows are turns of their own. A null text or role is an empty one. Rows without conv_id are one conversation of
    that (null) id. An empty table gives no rows.

    Rows are dealt into sorted ranges of (conv_id, turn, role, text), so a conversation that holds a large share of all turns is formatted
    by many tasks, and a task holds one row at a time. A conversation that a range border or ``piece`` characters cut goes on in the
    next row, with ``edge`` set on every row of it. Each row begins and ends with a special token, so its tokens are those that the
    whole conversation has there. A token is under the loss if it shares a character with the text of a turn of a trained role.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "role", "text").mapInArrow(_pieces(form), FORMATTED)


class _Reading:
    """What the rows of one conversation hold, taken from their tokens."""

    def __init__(self, form: Format):
        self.coder = tokenizer(form.tokenizer)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_tokens = 0

    def add(self, text: str, ids: list[int], loss: list[bool]) -> None:
        whole = self.coder.decode(ids, skip_special_tokens=False)
        if whole != text:
            raise ValueError("tokens do not give back the text")
        for role, body in parsed(whole):
            self.turns.update(f"{role}\n{body}\n".encode())
            self.n_turns += 1
        mask = np.array([False, *loss, False])
        for a, b in np.flatnonzero(mask[1:] != mask[:-1]).reshape(-1, 2):
            body = unescaped(self.coder.decode(ids[a:b], skip_special_tokens=False))
            self.loss.update(body.encode())
            self.loss_chars += len(body)
        self.chars += len(whole)
        self.n_tokens += len(ids)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def _read(form: Format):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, reading = [], None, None

        def close():
            done.append((now, reading.n_turns, reading.turns.hexdigest(), reading.loss_chars, reading.loss.hexdigest(), reading.chars, reading.n_tokens))

        def batch_of(rows):
            kinds = [pa.string() if " string" in c else pa.int64() for c in READ.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in READ.split(", ")])

        for batch in batches:
            for i in range(len(batch)):
                conv, text, ids, loss = (batch.column(c)[i].as_py() for c in ("conv_id", "text", "tokens", "loss"))
                if reading is None or conv != now:
                    if reading is not None:
                        close()
                    now, reading = conv, _Reading(form)
                reading.add(text, ids, loss)
            if done:
                yield batch_of(done)
                done = []
        if reading is not None:
            close()
            yield batch_of(done)

    return run


def read_back(rows: DataFrame, form: Format = Format()) -> DataFrame:
    """Per conversation, from the tokens of ``formatted``: digests of its turns and of the text under the loss, and their sizes.

    ``turns_sha256`` covers role, line break, text, line break of each turn; ``loss_sha256`` the unescaped text of all tokens under the loss;
    ``loss_chars`` counts its code points, ``formatted_chars`` those of the formatted text. Rows whose tokens do not decode to their text
    raise an error. Only conversations cut by a border are brought together, and then streamed in order.
    """
    columns = ["conv_id", "text", "tokens", "loss"]
    cut = rows.where("edge").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return rows.where("not edge").select(columns).mapInArrow(_read(form), READ).unionByName(cut.select(columns).mapInArrow(_read(form), READ))
