"""SentencePiece byte-pair encoding and decoding, in rounds of merges over flat arrays of symbols.

A text is cut into words at places that no piece spans. The distinct words of a batch are encoded together: their symbols lie in
one flat array, each round takes the least rank among each word's pairs, merges all its places from the left, and compacts,
until no word has a pair that makes a piece.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import hidden, shown

#: Stands for the blank inside pieces.
SPACE = "▁"
CODES = 0x110000
#: Kinds of pieces, and kinds of models, in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: What an unknown piece is decoded to, unless the model says otherwise.
UNKNOWN_TEXT = " ⁇ "
#: Symbols merged at once, but for a longer word; words that a task remembers, and the longest of them.
CHUNK, REMEMBERED, LONGEST = 1 << 18, 200_000, 64
#: In place of a rank where a pair makes no piece; ends a table of pairs.
NONE, NO_PAIR = np.iinfo(np.int32).max, np.iinfo(np.int64).max


class Model(NamedTuple):
    """Tables of a model, as plain data: they are of the vocabulary's size, so they are broadcast."""

    pieces: int
    prefix: bool
    char_ids: np.ndarray  # the piece of a code point, or -1
    byte_ids: np.ndarray
    pairs: np.ndarray  # left symbol * (pieces + CODES) + right symbol, sorted
    ranks: np.ndarray  # of pairs: smaller is merged earlier
    merged: np.ndarray  # of pairs: the piece they make
    inner: np.ndarray  # pairs of code points that stand side by side in a piece, sorted
    words: str  # pattern of the words of a text
    data: np.ndarray  # bytes that each piece is decoded to, end to end
    starts: np.ndarray
    lengths: np.ndarray
    spaced: np.ndarray  # whether a piece starts with the blank
    is_byte: np.ndarray


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a message in the protocol-buffer wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at:at + size]
            at += size


def load(path: str) -> Model:
    """The model in the file ``path``, read on the driver.

    Models of the byte-pair kind with byte fallback, without rules for normalising, user-defined or unused pieces; for others
    a ValueError says what is not covered.
    """
    with open(path, "rb") as f:
        top = list(_fields(f.read()))
    trainer, normal = (dict(x for n, v in top if n == field for x in _fields(v)) for field in (2, 3))
    rows = [dict(_fields(v)) for n, v in top if n == 1]
    names = [r[1].decode() for r in rows]
    scores = np.array([struct.unpack("<f", r[2])[0] if 2 in r else 0.0 for r in rows])
    kinds = np.array([r.get(3, NORMAL) for r in rows])
    for fault, what in ((trainer.get(3, 1) != BPE, "its kind is not byte-pair encoding"), (not trainer.get(35, 0), "it has no byte fallback"),
                        (bool(normal.get(2)), "it normalises texts"), (bool(normal.get(4, 1)), "it removes blanks"),
                        (not normal.get(5, 1), "it keeps blanks as they are"), (np.isin(kinds, (USER_DEFINED, UNUSED)).any(), "it has pieces of other kinds"),
                        (bool(trainer.get(24, 0)), "blanks end its words")):
        if fault:
            raise ValueError(f"{path}: {what}")
    n = len(names)
    char_ids = np.full(CODES, -1, np.int32)
    known = {p: i for i, p in enumerate(names) if kinds[i] == NORMAL}
    for p, i in known.items():
        if len(p) == 1:
            char_ids[ord(p)] = i
    symbol = lambda part: known.get(part, n + ord(part) if len(part) == 1 else None)
    pairs = [(left * (n + CODES) + right, i) for p, i in known.items() for k in range(1, len(p))
             if (left := symbol(p[:k])) is not None and (right := symbol(p[k:])) is not None]
    keys, makes = np.array([*sorted(pairs), (NO_PAIR, 0)], np.int64).T
    by_score = np.unique(-scores, return_inverse=True)[1]
    inner = {(a, b) for p in known for a, b in zip(p, p[1:])}
    words = _words(inner)
    shown_as = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else
                trainer.get(44, UNKNOWN_TEXT.encode()) if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(names, kinds.tolist())]
    lengths = np.array([len(b) for b in shown_as], np.int64)
    byte_ids = np.zeros(256, np.int64)
    for i in np.flatnonzero(kinds == BYTE).tolist():
        byte_ids[shown_as[i][0]] = i
    return Model(n, bool(normal.get(3, 1)), char_ids, byte_ids, keys, by_score[makes].astype(np.int32), makes.astype(np.int32),
                 np.array([*sorted(ord(a) * CODES + ord(b) for a, b in inner), NO_PAIR], np.int64), words,
                 np.frombuffer(b"".join(shown_as), np.uint8), np.cumsum(lengths) - lengths, lengths,
                 np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(names, kinds)]), kinds == BYTE)


def _letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def _words(inner: set[tuple[str, str]]) -> str:
    """A pattern that cuts a text where no piece goes on, given the pairs of characters that stand side by side in a piece."""
    if any(b == SPACE != a for a, b in inner):
        return r"(?s).+"
    feed = "" if any("\n" in x for x in inner) else "\n"
    tail = f"|{SPACE}+" + ("|\n" if feed else "")
    pairs = [p for p in inner if p[0] != SPACE]
    odd = {c for p in pairs if _letter(p[0]) != _letter(p[1]) for c in p if _letter(c)}  # letters that stand with others
    if any((_letter(a) and a not in odd) != (_letter(b) and b not in odd) for a, b in pairs):
        return f"{SPACE}*[^{SPACE}{feed}]+{tail}"
    odd = re.escape("".join(sorted(odd)))
    return rf"{SPACE}*(?:[^\W\d_{odd}]+|(?:[^\w{SPACE}{feed}]|[\d_{odd}])+){tail}"


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _ranked(model: Model, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each pair of symbols (NONE if it makes no piece), and the piece it makes."""
    at, there = _found(model.pairs, left * (model.pieces + CODES) + right)
    return np.where(there, model.ranks[at], NONE), model.merged[at]


def merge(model: Model, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of words that start at ``starts``: the symbols left, and how many each word has.

    The rule to meet: of a word's pairs the one of least rank is merged first, of equal ones the leftmost. In a round every word
    merges all places of its least rank, from the left without overlap. Where a merge makes a new pair of no higher rank with
    its neighbour, the places after it wait for the next round, as that pair comes first.
    """
    counts = np.diff(np.append(starts, len(sym)))
    left_over, sizes, word = [], np.zeros(len(starts), np.int64), np.arange(len(starts))

    def ranks_of(sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, makes = _ranked(model, sym, np.append(sym[1:], 0))
        rank[np.append(starts[1:], len(sym)) - 1] = NONE
        return rank, makes

    rank, makes = ranks_of(sym, starts) if len(sym) else (sym, sym)
    while len(starts):
        least = np.minimum.reduceat(rank, starts)
        open_ = least != NONE
        if not open_.all():
            gone = np.repeat(~open_, counts)
            sizes[word[~open_]] = counts[~open_]
            left_over.append((word[~open_], sym[gone]))
            sym, rank, makes = sym[~gone], rank[~gone], makes[~gone]
            counts, word, least = counts[open_], word[open_], least[open_]
            starts = np.cumsum(counts) - counts
            if not len(starts):
                break
        of = np.repeat(np.arange(len(starts)), counts)
        at = np.flatnonzero(rank == least[of])
        chain = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))  # neighbours overlap: every other one of a chain
        at = at[(np.arange(len(at)) - np.repeat(chain, np.diff(np.append(chain, len(at))))) % 2 == 0]
        new, mine, bound = makes[at].astype(np.int64), of[at], least[of[at]]
        before = np.where(at > starts[mine], sym[at - 1], -1)
        joined = np.append(False, (at[1:] == at[:-1] + 2) & (mine[1:] == mine[:-1]))
        before[joined] = new[:-1][joined[1:]]
        after_at = at + 2
        has_after = after_at < (starts + counts)[mine]
        after = np.where(has_after, sym[np.minimum(after_at, len(sym) - 1)], -1)
        rank_before = np.where(before >= 0, _ranked(model, np.maximum(before, 0), new)[0], NONE)
        rank_after = np.where(has_after, _ranked(model, new, np.maximum(after, 0))[0], NONE)
        disturbs = np.minimum(rank_before, rank_after) <= bound
        if disturbs.any():  # of each word, up to the first place that does
            first = np.full(len(starts), len(at))
            np.minimum.at(first, mine[disturbs], np.flatnonzero(disturbs))
            stays = np.arange(len(at)) <= first[mine]
            at, new, mine = at[stays], new[stays], mine[stays]
        sym[at] = new
        kept = np.ones(len(sym), bool)
        kept[at + 1] = False
        place = np.cumsum(kept) - 1
        counts = counts - np.bincount(mine, minlength=len(starts))
        starts = np.cumsum(counts) - counts
        sym, rank, makes = sym[kept], rank[kept], makes[kept]
        ends = starts + counts - 1
        changed = np.zeros(len(sym), bool)
        changed[place[at]] = True
        changed[:-1] |= changed[1:]
        fresh = np.flatnonzero(changed)
        rank[fresh], makes[fresh] = _ranked(model, sym[fresh], sym[np.minimum(fresh + 1, len(sym) - 1)])
        rank[ends] = NONE
    out = np.empty(int(sizes.sum()), np.int64)
    to = np.cumsum(sizes) - sizes
    for words, symbols in left_over:
        out[_ranges(to[words], sizes[words])] = symbols
    return out, sizes


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... lengths[0] of them, then those of the next."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _spelled(model: Model, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of symbols; a code point that is no piece becomes the pieces of its UTF-8 bytes."""
    code = sym - model.pieces
    width = np.where(code < 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
    to = np.cumsum(width) - width
    ids = np.empty(int(width.sum()), np.int64)
    ids[to[code < 0]] = sym[code < 0]
    heads = {1: 0, 2: 0xC0, 3: 0xE0, 4: 0xF0}
    for n, head in heads.items():
        of = (code >= 0) & (width == n)
        for k in range(n):
            bits = code[of] >> 6 * (n - 1 - k)
            ids[to[of] + k] = model.byte_ids[head | bits if k == 0 else 0x80 | bits & 0x3F]
    word = np.repeat(np.arange(len(sizes)), sizes)
    return ids, np.bincount(word, weights=width, minlength=len(sizes)).astype(np.int64)


def encode_words(model: Model, words: list[str]) -> list[bytes]:
    """The ids of each word, as the bytes of 32-bit numbers."""
    out, start = [], 0
    while start < len(words):
        end, size = start + 1, len(words[start])
        while end < len(words) and size + len(words[end]) <= CHUNK:
            size += len(words[end])
            end += 1
        some = words[start:end]
        code = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.array([len(w) for w in some], np.int64)
        opens = np.zeros(len(code), bool)
        opens[np.cumsum(lengths) - lengths] = True
        first = np.flatnonzero(opens)
        opens[1:] |= ~_found(model.inner, code[:-1] * CODES + code[1:])[1]  # no piece spans these two
        parts = np.flatnonzero(opens)
        sym = model.char_ids[code].astype(np.int64)
        sym, sizes = merge(model, np.where(sym < 0, model.pieces + code, sym), parts)
        ids, sizes = _spelled(model, sym, sizes)
        each = np.add.reduceat(sizes, np.searchsorted(parts, first))
        data, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(each)).tolist()
        out += [data[a:b] for a, b in zip([0, *ends], ends)]
        start = end
    return out


class Encoder:
    """Encodes batches of texts, and remembers the short words it has met, up to a number of them."""

    def __init__(self, model: Model):
        self.model, self.words, self.known = model, re.compile(model.words), {}

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every whole text; none for null and empty texts."""
        head = SPACE if self.model.prefix else ""
        cut = [self.words.findall(head + t.replace(" ", SPACE)) if t else [] for t in texts]
        coded = pa.array(chain.from_iterable(cut), pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        ids = list(map(self.known.get, distinct))
        fresh = [i for i, b in enumerate(ids) if b is None]
        for i, b in zip(fresh, encode_words(self.model, [distinct[i] for i in fresh])):
            ids[i] = b
            if len(distinct[i]) <= LONGEST:
                self.known[distinct[i]] = b
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        code = coded.indices.to_numpy(zero_copy_only=False)
        data = np.frombuffer(b"".join(ids), "<i4")[_ranges((np.cumsum(lengths) - lengths)[code], lengths[code])]
        ends = np.append(0, np.cumsum(lengths[code]))[np.cumsum([0, *map(len, cut)])].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]


def decode_ids(model: Model, ids: np.ndarray) -> bytes:
    """The text of ids in UTF-8, gathered from the bytes of the pieces.

    The blank that the encoder puts before a text is taken off the first piece that has any text. Bytes that are no UTF-8 become
    one U+FFFD each. Ids outside the vocabulary raise an IndexError.
    """
    if not len(ids):
        return b""
    ids = ids.astype(np.int64)
    if ids.min() < 0 or ids.max() >= model.pieces:
        raise IndexError("an id is not in the vocabulary")
    starts, lengths = model.starts[ids], model.lengths[ids]
    if model.prefix:
        first = int(np.argmax(lengths > 0))
        if model.spaced[ids[first]]:
            starts[first] += 1
            lengths[first] -= 1
    data = model.data[_ranges(starts, lengths)].tobytes()
    if model.is_byte[ids].any():
        try:
            data.decode()
        except UnicodeDecodeError:
            return _mended(model, ids, data, lengths)
    return data


def _mended(model: Model, ids: np.ndarray, data: bytes, lengths: np.ndarray) -> bytes:
    """``data`` with U+FFFD in place of each byte that is no part of a character within its run of byte pieces."""
    is_byte, ends = model.is_byte[ids], np.cumsum(lengths)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], is_byte, [False]]).astype(np.int8)))
    out, done = [], 0
    for a, b in edges.reshape(-1, 2).tolist():
        start, end = int(ends[a] - lengths[a]), int(ends[b - 1])
        out.append(data[done:start])
        while start < end:
            size = next((n for n in range(1, min(4, end - start) + 1) if _is_character(data[start:start + n])), 0)
            out.append(data[start:start + size] if size else "�".encode())
            start += size or 1
        done = end
    return b"".join([*out, data[done:]])


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def _added(df: DataFrame, model: Model, name: str, kind: str, of: str, start) -> DataFrame:
    """``df`` and column ``name``, computed from column ``of``; ``start(model)`` gives a function of one batch's column."""
    inner, names = hidden(df)
    tables = df.sparkSession.sparkContext.broadcast(tuple(model))
    columns = list(names.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start(Model(*tables.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, compute(batch.column(columns.index(names[of])))], [*columns, "_new"])

    out = inner.mapInArrow(run, ", ".join([*(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, df.schema.fields)), f"_new {kind}"]))
    return shown(out, names, {name: F.col("_new")})


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` and the ids of every whole text as an array, as the model in the file ``path`` encodes it.

    Null and empty texts have no ids. Rows are independent, so repeated rows, null keys and an empty table need nothing; ``ids``
    takes the place of a column of that name in any case. A word without blank or line feed is one value in one task.
    """
    def start(model: Model):
        encoder = Encoder(model)

        def compute(column: pa.Array) -> pa.Array:
            found = encoder(column.to_pylist())
            sizes = np.array([0, *map(len, found)], np.int32)
            return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.concatenate([np.zeros(0, "<i4"), *found])))

        return compute

    return _added(docs, load(path), ids, "array<int>", text, start)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` and the text of every array of ids; null stays null, no ids give an empty text, null ids fail the job."""
    def start(model: Model):
        return lambda column: pa.array([None if x is None else decode_ids(model, np.array(x, np.int64)).decode() for x in column.to_pylist()], pa.string())

    return _added(rows, load(path), text, "string", ids, start)


def digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: its text encoded, and the ids decoded again, in one pass.

    The digests are of the decimal ids joined by commas, and of the decoded text in UTF-8.
    """
    import hashlib

    tables = docs.sparkSession.sparkContext.broadcast(tuple(load(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*tables.value)
        encoder, decimal = Encoder(model), [str(i) for i in range(model.pieces)]
        for batch in batches:
            sizes, joined, decoded = [], [], []
            for ids in encoder(batch.column(1).to_pylist()):
                sizes.append(len(ids))
                joined.append(hashlib.sha256(",".join([decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                decoded.append(hashlib.sha256(decode_ids(model, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(joined, pa.string()), pa.array(decoded, pa.string())],
                ["_key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    out = rows.mapInArrow(run, f"_key {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_key", key)
