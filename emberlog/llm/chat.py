"""Chat formatting: conversations as one text each, assembled in columns, with the parts that count for the loss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import whole_groups

# The template, and the control strings of common templates, which must not come out of a text.
HEAD, BREAK, FOOT = b"<|im_start|>", b"\n", b"<|im_end|>\n"
CONTROLS = (b"<|", b"|>", b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>")
CONTROL = re.compile(b"(?=(" + b"|".join(map(re.escape, CONTROLS)) + b"))")
ESCAPE = ord("\\")
ESCAPED = re.compile(rb"\\(.)", re.DOTALL)
TURN = re.compile(re.escape(HEAD) + rb"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(FOOT), re.DOTALL)
#: Bytes assembled at once, but for a longer conversation.
PIECE = 1 << 23


def escape(data: np.ndarray, offsets: np.ndarray, breaks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a backslash before each backslash (and, if ``breaks``, line feed) and after the first byte of each control string."""
    ends = np.array([(m.start(), m.end(1)) for m in CONTROL.finditer(data)], np.int64).reshape(-1, 2)
    inside = ends[:, 1] <= offsets[np.searchsorted(offsets, ends[:, 0], side="right")] if len(ends) else np.zeros(0, bool)
    special = (data == ESCAPE) | (data == 10) if breaks else data == ESCAPE
    at = np.sort(np.concatenate([np.flatnonzero(special), ends[inside, 0] + 1]))
    return np.insert(data, at, ESCAPE), offsets + np.searchsorted(at, offsets)


def unescape(data: bytes) -> bytes:
    return ESCAPED.sub(rb"\1", data)


def _buffers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as empty."""
    array = column.cast(pa.large_binary()).combine_chunks().fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def assemble(role: pa.ChunkedArray, text: pa.ChunkedArray) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """All turns in one buffer: the buffer, where each turn starts (and the end), and where its text starts and ends.

    Every turn is five segments of a pool of source bytes; segment lengths give offsets, offsets give for every byte of the
    buffer the place in the pool that it is copied from.
    """
    roles, role_at = escape(*_buffers(role), breaks=True)
    texts, text_at = escape(*_buffers(text))
    fixed = np.frombuffer(HEAD + BREAK + FOOT, np.uint8)
    pool = np.concatenate([fixed, roles, texts])
    n, base = len(role), len(fixed)
    lengths, sources = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for k, (start, size) in enumerate([
            (0, len(HEAD)), (base + role_at[:-1], np.diff(role_at)), (len(HEAD), len(BREAK)),
            (base + len(roles) + text_at[:-1], np.diff(text_at)), (len(HEAD) + len(BREAK), len(FOOT))]):
        sources[:, k], lengths[:, k] = start, size
    ends = np.cumsum(lengths.ravel())
    starts = ends - lengths.ravel()
    total = int(ends[-1]) if n else 0
    out = pa.allocate_buffer(total)
    index = np.repeat(sources.ravel() - starts, lengths.ravel()) + np.arange(total)
    np.take(pool, index, out=np.frombuffer(out, np.uint8)) if total else None
    grid = starts.reshape(n, 5)
    return out, np.append(grid[:, 0], total), np.stack([grid[:, 3], grid[:, 4]], axis=1)


def format_chat(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                loss_role: str = "assistant") -> DataFrame:
    """(conversation, n_turns, formatted, loss): one row per conversation.

    Turns follow each other by ``turn`` (null first; ties by role, then text), each as start mark, role, line feed, text, end
    mark. Control strings in roles and texts are escaped so that ``read_chat`` gives back what went in; a null role or text is
    empty. ``loss`` lists the spans, in characters of ``formatted``, of the texts of ``loss_role``. A row without a conversation
    is a conversation of its own; repeated rows are repeated turns; an empty table gives an empty one.
    """
    kind = rows.schema[conversation].dataType.simpleString()
    named = rows.select(
        F.col(conversation).alias("id"), F.when(F.col(conversation).isNull(), F.monotonically_increasing_id()).otherwise(-1).alias("alone"),
        F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["id", "alone"]):
            sizes = np.cumsum([0, *(np.diff(at))])
            weight = np.concatenate([[0], np.cumsum(pa.compute.binary_length(table.column("text")).to_numpy())])[sizes]
            cuts = np.unique(np.searchsorted(weight, np.arange(PIECE, int(weight[-1]), PIECE)))  # conversations, so many bytes at a time
            for first, last in zip([0, *cuts], [*cuts, len(at) - 1]):
                if first < last:
                    yield piece(table.slice(at[first], at[last] - at[first]), at[first:last + 1] - at[first])

    def piece(table: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        out, turns, texts = assemble(table.column("role"), table.column("text"))
        begins = turns[at]
        characters = np.concatenate([[0], np.cumsum((np.frombuffer(out, np.uint8) & 0xC0) != 0x80, dtype=np.int64)])
        counted = np.asarray(table.column("role").to_numpy() == loss_role)
        home = np.repeat(np.arange(len(at) - 1), np.diff(at))[counted]
        spans = characters[texts[counted]] - characters[begins[home]][:, None]
        lists = np.searchsorted(home, np.arange(len(at)))
        return pa.RecordBatch.from_arrays([
            table.column("id").take(pa.array(at[:-1])).combine_chunks(), pa.array(np.diff(at)),
            pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(begins)), out).cast(pa.string()),
            pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start", "end"]))],
            ["id", "n_turns", "formatted", "loss"])

    return named.repartition("id", "alone").sortWithinPartitions("id", "alone", "turn", "role", "text").mapInArrow(
        work, f"id {kind}, n_turns long, formatted string, loss array<struct<start:long,end:long>>").withColumnRenamed("id", conversation)


def read_chat(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation, as they went in."""
    return [(unescape(r).decode(), unescape(t).decode()) for r, t in TURN.findall(formatted.encode())]


def digest(chats: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What can be read back from ``format_chat``'s output: digests of all turns and of the text under the loss spans."""
    kind = chats.schema[conversation].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for formatted, loss in zip(batch.column(1), batch.column(2)):
                whole = formatted.as_py()
                turns, spans, counted = read_chat(whole), hashlib.sha256(), 0
                every = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                for span in loss.as_py():
                    part = unescape(whole[span["start"]:span["end"]].encode())
                    spans.update(part)
                    counted += len(part.decode())
                out.append((len(turns), every.hexdigest(), counted, spans.hexdigest(), len(whole)))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], [
                "id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select(F.col(conversation).alias("id"), "formatted", "loss").mapInArrow(
        work, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", conversation)
