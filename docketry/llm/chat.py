r"""Chat formatting (op 10): whole conversations rendered, encoded once with offsets, and a loss mask from the
intersection of sorted turn spans with token spans by binary search.

Template: each turn is `<turn ROLE>TEXT</turn>` and a line feed. In roles and texts a backslash is doubled and a
backslash goes before each `<turn` and `</turn`, and in roles before each `>`; reading back removes them, so nothing
in a text can pass for a mark. The marks are extra vocabulary entries of the tokenizer, which cut what is around
them: the ids of a conversation are those of its turns in order, so a conversation that holds most rows is rendered
and encoded in pieces of whole turns, spread over tasks by a range sort, and still is what encoding it once gives.

Cases: null text and null role are empty; turns order by turn (null first), then role and text, repeats kept; a
conversation without assistant turns has an empty loss text; an empty table has no conversations; null conv_id is one
conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import small_batches, stored

#: The template's control strings.
OPEN, SHUT, END = "<turn ", ">", "</turn>\n"
_MARKS = re.compile(r"\\|<turn|</turn")
_ROLE_MARKS = re.compile(r"\\|<turn|</turn|>")
_TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>((?:[^\\<]|\\.|<(?!turn|/turn))*)</turn>\n", re.S)
#: Pieces hold about so many characters; a longer turn is a piece of its own.
PIECE = 1 << 18


def escape(text: str, marks: re.Pattern = _MARKS) -> str:
    return marks.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns, and the sorted spans of assistants' texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, _ROLE_MARKS)}{SHUT}", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + END)
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Reads formatted turns back."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def mask_spans(tokens: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """tokens: (n, 2) sorted token spans. For each turn span its tokens by binary search, and the text spans they cover, cut to the turn."""
    mask, covered = np.zeros(len(tokens), np.uint8), []
    if len(tokens):
        for start, end in spans:
            a, b = int(np.searchsorted(tokens[:, 1], start, side="right")), int(np.searchsorted(tokens[:, 0], end, side="left"))
            mask[a:b] = 1
            if a < b:
                covered.append((max(start, int(tokens[a:b, 0].min())), min(end, int(tokens[a:b, 1].max()))))
    return mask, covered


_MODELS: dict[str, object] = {}


def _model(path: str):
    if path not in _MODELS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        # Ordinary additions: they are matched in the template only, as texts have a backslash before them.
        t.add_tokens([AddedToken(x, normalized=False) for x in ("<turn", "</turn>\n")])
        t.encode_special_tokens = True
        _MODELS[path] = t
    return _MODELS[path]


FORMATTED = "conv_id long, part int, piece int, n_turns int, formatted string, ids array<int>, token_starts array<int>, token_ends array<int>, mask binary, loss array<struct<start:int,end:int>>"


def _format(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, piece = _model(path), TaskContext.get().partitionId(), 0
        held: list[tuple[str, str]] = []
        conv: object = ()
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal piece, size
            formatted, spans = render(held)
            e = model.encode(formatted, add_special_tokens=False)
            tokens = np.array(e.offsets, np.int64).reshape(-1, 2)
            mask, covered = mask_spans(tokens, spans)
            loss = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            values = [conv, part, piece, len(held), formatted, e.ids, tokens[:, 0], tokens[:, 1], mask.tobytes(), [{"start": a, "end": b} for a, b in covered]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), loss]
            piece, size = piece + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[c.split()[0] for c in FORMATTED.split(", ")])

        for b in batches:
            for c, role, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if held and (c != conv or size >= PIECE):
                    yield flush()
                conv = c
                held.append((role, text))
                size += len(text)
        if held:
            yield flush()

    return run


def format_conversations(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """The formatted conversations in pieces of whole turns: text, ids, token offsets, mask and the spans under it; ordered by conv_id, part, piece."""
    small_batches(rows.sparkSession)
    empty = F.lit("")
    r = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    r = r.repartitionByRange(*order[:3], F.xxhash64("text")).sortWithinPartitions(*order[:3], F.xxhash64("text"), order[3])
    return r.mapInArrow(_format(tokenizer_path), FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv: object = ()
    state: list = []
    done: list[tuple] = []

    def close() -> None:
        if state:
            turns, loss, n, chars, size, tokens = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, tokens))

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        cols = list(zip(*done, strict=True)) or [[]] * len(kinds)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])

    for b in batches:
        for i in range(b.num_rows):
            c, formatted, loss, tokens = (b.column(k)[i].as_py() for k in (0, 1, 2, 3))
            if c != conv or not state:
                close()
                conv, state = c, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0]
            for role, text in parse(formatted):
                state[0].update(f"{role}\n{text}\n".encode())
                state[2] += 1
            under = "".join(unescape(formatted[s["start"] : s["end"]]) for s in loss)
            state[1].update(under.encode())
            state[3] += len(under)
            state[4] += len(formatted)
            state[5] += tokens
        if done:
            yield out()
    close()
    if done:
        yield out()


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Reads formatted pieces back, one row for each conversation; its digests run over the pieces in order, holding one at a time."""
    f = formatted.select("conv_id", "formatted", "loss", F.size("ids").cast("long").alias("n_tokens"), "part", "piece")
    f = f.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return f.mapInArrow(_digest, DIGEST)


def chat_output(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """Formats, stores in the shared folder, and reads back."""
    return digest_conversations(stored(format_conversations(rows, tokenizer_path), "chat"))
