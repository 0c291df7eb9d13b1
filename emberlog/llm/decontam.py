"""Benchmark decontamination: shared q-grams in overlapping diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A leak is a stretch of WINDOW characters of an item (all of a shorter one) with at most one edit in EVERY characters.
#: Items of fewer than LEAST characters are leaked by an exact copy between word ends only: an edit may make them other words.
WINDOW, EVERY, GRAM, LEAST = 64, 16, 12, 24
#: Bytes of item text searched for in one pass over the documents; q-gram hits, and bytes of text, looked at at once.
BLOCK_BYTES, HITS, PIECE = 1 << 20, 1 << 21, 1 << 20
BLANK = 32


def _fold_table() -> np.ndarray:
    """Characters as compared: letters in lower case, ASCII characters but letters and digits as blanks, the rest as they are."""
    fold = np.arange(0x10000, dtype=np.uint32)
    for c in range(len(fold)):
        if c < 128:
            fold[c] = ord(chr(c).lower()) if chr(c).isalnum() else BLANK
        elif chr(c).isupper() and len(chr(c).lower()) == 1:
            fold[c] = ord(chr(c).lower())
    return fold


FOLD = _fold_table()


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 texts as compared, a number a character: all texts, their offsets, and of each character the place in its text.

    Case is folded, and a run of characters that count as blank is one blank.
    """
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    at = before[offsets]
    folded = np.where(codes < len(FOLD), FOLD[np.minimum(codes, len(FOLD) - 1)], codes)
    blank = folded == BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    starts = at[:-1][at[:-1] < at[1:]]
    keep[starts] = ~blank[starts]
    kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    places = np.flatnonzero(keep)
    sizes = np.diff(kept[at])
    return folded[keep], kept[at], places - np.repeat(at[:-1], sizes)


def grams(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` characters from each place on, but for the last size - 1 places."""
    n = len(codes) - size + 1
    if n <= 0 or size <= 0:
        return np.zeros(0, np.uint64)
    base, out, done = 0x9E3779B97F4A7C15, None, 0
    part, width = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), 1
    while True:  # characters as a polynomial, by parts that double
        if size & width:
            out = part[done:done + n] if out is None else out * np.uint64(pow(base, width, 1 << 64)) + part[done:done + n]
            done += width
        if done == size:
            break
        part = part[:-width] * np.uint64(pow(base, width, 1 << 64)) + part[width:]
        width *= 2
    mixed = (out ^ out >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD)
    return mixed ^ mixed >> np.uint64(29)


class Index(NamedTuple):
    """Where the q-grams of one size stand in the items."""

    gram: int
    whole: bool  # whether a gram is a whole item
    hashes: np.ndarray  # distinct, in order
    first: np.ndarray  # where each hash's places start in ``places``
    places: np.ndarray
    seen: np.ndarray  # by the top bits of a hash: whether any q-gram has them

    @staticmethod
    def of(codes: np.ndarray, spans: list[np.ndarray], gram: int, whole: bool) -> Index:
        places = np.concatenate(spans)
        every = grams(codes, gram)[places]
        order = np.argsort(every, kind="stable")
        hashes, first = np.unique(every[order], return_index=True)
        bits = max(16, int(len(hashes)).bit_length() + 5)
        seen = np.zeros(1 << bits, bool)
        seen[hashes >> np.uint64(64 - bits)] = True
        return Index(gram, whole, hashes, np.append(first, len(places)), places[order], seen)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``codes`` whose q-gram stands in an item, and which of ``hashes`` it is."""
        shift = np.uint64(64 - self.seen.size.bit_length() + 1)
        hashed = grams(codes, self.gram)
        at = np.flatnonzero(self.seen[hashed >> shift])
        found = np.minimum(np.searchsorted(self.hashes, hashed[at]), len(self.hashes) - 1)
        real = self.hashes[found] == hashed[at]
        return at[real], found[real]


def gram_size(lengths: np.ndarray) -> np.ndarray:
    """The size of the q-grams for items of these lengths.

    A window of w characters with at most e edits shares w + 1 - q - e q of its q-grams with its copy: q is GRAM, or as large as
    leaves one to share. Items of fewer than LEAST characters are one gram.
    """
    window = np.minimum(lengths, WINDOW)
    return np.where(lengths < LEAST, lengths, np.minimum(GRAM, window // (window // EVERY + 1)))


class Items(NamedTuple):
    """Normalised items in one buffer, with an index for each size of q-grams. Equal items are searched once."""

    ids: list  # of each distinct text, the ids of the items that have it
    codes: np.ndarray
    offsets: np.ndarray
    indexes: list[Index]

    @staticmethod
    def of(ids: list, texts: list[str]) -> Items:
        same: dict[str, list] = {}
        for i, t in zip(ids, texts):
            same.setdefault(t, []).append(i)
        raw = [t.encode() for t in same]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
        codes, offsets, _ = normalise(np.frombuffer(b"".join(raw), np.uint8), offsets)
        # blanks at the end of an item are no part of it
        lengths = np.diff(offsets)
        lengths = lengths - [bool(n) and codes[b - 1] == BLANK for n, b in zip(lengths, offsets[1:])]
        keep = np.concatenate([np.arange(a, a + n) for a, n in zip(offsets[:-1], lengths)] or [np.zeros(0, np.int64)]).astype(np.int64)
        codes, offsets = codes[keep], np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        sizes, indexes = gram_size(lengths), []
        # items that are one gram and longer ones with grams of the same size are searched apart
        for short in (True, False):
            mine = (lengths < LEAST) == short
            for q in np.unique(sizes[mine & (sizes > 0)]):
                which = np.flatnonzero(mine & (sizes == q))
                indexes.append(Index.of(codes, [np.arange(offsets[i], offsets[i + 1] - q + 1) for i in which], int(q), short))
        return Items(list(same.values()), codes, offsets, indexes)


def edits(patterns: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern against its region, which may start and end anywhere in it, and the diagonal it ends on.

    A row of ``regions`` has as many more bytes than its pattern as there are diagonals beside the first.
    """
    n, length = patterns.shape
    width = regions.shape[1] - length + 1
    steps = np.arange(width, dtype=np.int16)
    cost = np.zeros((n, width), np.int16)
    for i in range(length):
        now = cost + (regions[:, i:i + width] != patterns[:, i:i + 1])
        now[:, :-1] = np.minimum(now[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(now - steps, axis=1) + steps
    return cost.min(axis=1), cost.argmin(axis=1)


def _around(codes: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """``length`` bytes from each start; bytes outside low..high equal nothing."""
    at = start[:, None] + np.arange(length)
    inside = (at >= low[:, None]) & (at < high[:, None])
    return np.where(inside, codes[np.clip(at, 0, len(codes) - 1)], 0)


def _verify(items: Items, codes: np.ndarray, offsets: np.ndarray, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray,
            start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of items from ``start`` on: whether they align, with how many edits, and where in the text they end."""
    lengths = np.minimum(np.diff(items.offsets)[item], WINDOW)
    ok, cost, end = np.zeros(len(item), bool), np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    for length in np.unique(lengths):
        budget = int(length) // EVERY
        band = 2 * (budget + 1)
        here = np.flatnonzero(lengths == length)
        for part in np.array_split(here, max(1, len(here) // 4096)):
            i, t = item[part], text[part]
            patterns = items.codes[(items.offsets[i] + start[part])[:, None] + np.arange(length)]
            origin = offsets[t] + start[part] + diagonal[part] - budget
            regions = _around(codes, offsets[t], offsets[t + 1], origin, int(length) + band + 2 * budget)
            cost[part], ends = edits(patterns, regions)
            ok[part] = cost[part] <= budget
            end[part] = np.clip(origin + length + ends, offsets[t], offsets[t + 1]) - offsets[t]
    return ok, cost, end


def _hits(items: Items, index: Index, codes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Hits (text, item, place in the text, place in the item), a piece of some texts at a time."""
    ats, founds = [], []
    for start in range(0, len(codes), PIECE):
        at, found = index.find(codes[start:start + PIECE + index.gram - 1])
        ats.append(at + start)
        founds.append(found)
    at, found = np.concatenate(ats), np.concatenate(founds)
    text = np.searchsorted(offsets, at, side="right") - 1
    inside = at + index.gram <= offsets[text + 1]
    at, found, text = at[inside], found[inside], text[inside]
    many = index.first[found + 1] - index.first[found]
    total = np.cumsum(many)
    cuts = np.searchsorted(total, np.arange(HITS, int(total[-1]) if len(total) else 0, HITS))
    for a, b in zip([0, *cuts], [*cuts, len(at)]):
        n = many[a:b]
        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.first[found[a:b]], n)
        place = index.places[flat]
        item = np.searchsorted(items.offsets, place, side="right") - 1
        row = np.repeat(text[a:b], n)
        yield row, item, np.repeat(at[a:b], n) - offsets[row], place - items.offsets[item]


def leaks(items: Items, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """``_leaks`` of all texts, so many at a time that their bytes stay within PIECE, but for a longer text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not items.indexes or not len(texts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    cuts = np.unique(np.searchsorted(at, np.arange(at[0], at[-1] + 1, PIECE), side="left"))
    cuts = [0, *cuts[(cuts > 0) & (cuts < len(texts))], len(texts)]
    parts = [_leaks(items, texts.slice(a, b - a), a) for a, b in zip(cuts[:-1], cuts[1:])]
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(5))


def _leaks(items: Items, texts: pa.Array, before: int) -> tuple[np.ndarray, ...]:
    """Leaks in whole texts: index of the text (``before`` more), index of the item, start and end in the text's characters, edits.

    One row per text and item, that of the fewest edits, the leftmost if several.
    """
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    codes, offsets, places = normalise(data, at - at[0])
    out = []
    for index in items.indexes:
        if len(codes) >= index.gram:
            out.append((_copies if index.whole else _aligned)(items, index, codes, offsets))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    text, item, end, cost = (np.concatenate([o[k] for o in out]) for k in range(4))
    order = np.lexsort((end, cost, item, text))
    text, item, end, cost = text[order], item[order], end[order], cost[order]
    new = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])) if len(text) else np.zeros(0, bool)
    text, item, end, cost = text[new], item[new], end[new], cost[new]
    begin = np.maximum(end - np.minimum(np.diff(items.offsets), WINDOW)[item], 0)
    # places among the characters compared as characters of the text
    last = offsets[text + 1] - offsets[text] - 1
    start = places[offsets[text] + np.minimum(begin, last)]
    return text + before, item, start, places[offsets[text] + end - 1] + 1, cost


def _copies(items: Items, index: Index, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Exact copies of short items between word ends: text, item, where it ends in the text, and no edits."""
    out = []
    for text, item, place, _ in _hits(items, index, codes, offsets):
        start, n = offsets[text] + place, index.gram
        same = (codes[start[:, None] + np.arange(n)] == items.codes[items.offsets[item][:, None] + np.arange(n)]).all(axis=1)
        opens = (place == 0) | (codes[start - 1] == BLANK)
        ends = (start + n == offsets[text + 1]) | (codes[np.minimum(start + n, len(codes) - 1)] == BLANK)
        real = same & opens & ends
        out.append((text[real], item[real], place[real] + n, np.zeros(real.sum(), np.int64)))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


def _aligned(items: Items, index: Index, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of items that align with a text within their edits: text, item, where it ends in the text, edits.

    By the q-gram lemma a window of w characters with at most e edits shares w + 1 - q - e q of its q-grams with the text, on
    diagonals at most e apart; bands are 2 (e + 1) diagonals wide and start every e + 1, so one band has them all. Bands with
    fewer hits are dropped; in the others the windows that have enough hits are aligned, the one with the most hits first.
    """
    lengths = np.minimum(np.diff(items.offsets), WINDOW)
    budget = lengths // EVERY
    enough = lengths + 1 - index.gram - budget * index.gram
    span = int(np.diff(offsets).max() + np.diff(items.offsets).max()) + 2
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for row, item, place, inside in _hits(items, index, codes, offsets):
        shifted = place - inside + np.diff(items.offsets)[item]
        band = shifted // (budget[item] + 1)
        for less in (0, 1):
            held.append(((row * len(lengths) + item) * span + np.maximum(band - less, 0), inside))
        if sum(len(k) for k, _ in held) > 8 * HITS:
            held = [_compact(held, enough, span, len(lengths), row[-1])]
    nothing = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not held:
        return nothing
    key, inside = _compact(held, enough, span, len(lengths), None)
    if not len(key):
        return nothing
    # of each band, the windows with enough hits; the one with most first
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    bands, group = key[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    item = bands // span % len(lengths)
    text = bands // span // len(lengths)
    diagonal = bands % span * (budget[item] + 1) - np.diff(items.offsets)[item]
    wide = int(np.diff(items.offsets).max()) + WINDOW + 1
    line = group * wide + inside
    until = np.searchsorted(line, line + lengths[item][group] - index.gram, side="right")
    hits = until - np.arange(len(line))
    last = np.diff(items.offsets)[item] - lengths[item]
    best = np.lexsort((inside, -hits, group))[first]
    ok, cost, end = _verify(items, codes, offsets, text, item, diagonal, np.minimum(inside[best], last))
    out = [(text[ok], item[ok], end[ok], cost[ok])]
    settled = set(zip(text[ok].tolist(), item[ok].tolist()))
    # the other windows with enough hits of bands whose best window did not align
    rest = [g for g in np.flatnonzero(~ok) if (int(text[g]), int(item[g])) not in settled]
    for part in np.array_split(rest, max(1, len(rest) // 256)) if rest else []:
        owner, starts = [], []
        for g in part:
            mine = inside[first[g]:first[g + 1] if g + 1 < len(first) else None]
            every = np.arange(0, last[g] + 1)
            some = np.searchsorted(mine, every + lengths[item[g]] - index.gram, side="right") - np.searchsorted(mine, every) >= enough[item[g]]
            starts.append(every[some])
            owner.append(np.full(some.sum(), g))
        owner, starts = np.concatenate(owner), np.concatenate(starts)
        fine, price, stop = _verify(items, codes, offsets, text[owner], item[owner], diagonal[owner], starts)
        owner = owner[fine]
        out.append((text[owner], item[owner], stop[fine], price[fine]))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


def _compact(held: list[tuple[np.ndarray, np.ndarray]], enough: np.ndarray, span: int, items: int, still: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hits in order of band and place in the item; bands with too few go, unless the text ``still`` has hits to come."""
    key, inside = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    order = np.lexsort((inside, key))
    key, inside = key[order], inside[order]
    new = np.append(True, (key[1:] != key[:-1]) | (inside[1:] != inside[:-1])) if len(key) else np.zeros(0, bool)
    key, inside = key[new], inside[new]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    stays = n[at] >= enough[key // span % items]
    if still is not None:
        stays |= key // span // items == still
    return key[stays], inside[stays]


def _plain(items: Items) -> tuple:
    """Items as plain data, so that workers need no copy of the package."""
    return (*items[:-1], [tuple(i) for i in items.indexes])


def _items(plain: tuple) -> Items:
    return Items(*plain[:-1], [Index(*i) for i in plain[-1]])


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of about ``block_bytes``, so that one block's index has a bounded size; null texts are left out.

    Equal texts are one text with several ids.
    """
    known = benchmark.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    for b in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect() if size else []
        rows.sort(key=lambda r: (r["key"] is None, r["key"] or 0, r["text"]))
        yield Items.of([r["key"] for r in rows], [r["text"] for r in rows])


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, item_key, start, end, edits): a row per input row and item of which the whole text holds a leak.

    Texts are compared character by character in lower case, each run of ASCII characters other than letters and digits as one
    blank. An item of fewer than LEAST such characters is leaked where it stands exactly between word ends. ``start``
    and ``end`` are the leak in characters of the text, exact to within the edits. Null and empty texts and items hold and are
    no leaks; items with the same text are all reported; rows with the same key are reported each; empty tables give none.
    """
    spark, found = docs.sparkSession, None
    names = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    for items in item_blocks(benchmark, item_key, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(_plain(items))  # within block_bytes of text

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _items(shared.value)
            ids = items.ids
            for batch in batches:
                row, item, start, end, cost = leaks(items, batch.column(1))
                copies = np.array([len(ids[i]) for i in item], np.int64)
                named = [i for k in item for i in ids[k]]
                row, start, end, cost = (np.repeat(x, copies) for x in (row, start, end, cost))
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column(0).take(pa.array(row)), "item": pa.array(named, _arrow(names[1])), "start": start, "end": end, "edits": cost})

        part = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
            search, f"key {names[0]}, item {names[1]}, start long, end long, edits long")
        found = part if found is None else found.unionByName(part)
    return found.toDF(key, "item_id" if item_key.lower() == key.lower() else item_key, "start", "end", "edits")


def _arrow(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose whole text holds no leak; rows with a null or empty text stay."""
    for items in item_blocks(benchmark, item_key, item_text, block_bytes):
        docs = docs.filter(_clean(docs.sparkSession, items)(text))
    return docs


def _clean(spark, items: Items):
    """Whether each whole text holds no leak of ``items``."""
    shared = spark.sparkContext.broadcast(_plain(items))  # within block_bytes of text

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        held = np.ones(len(texts), bool)
        held[leaks(_items(shared.value), texts)[0]] = False
        return pa.array(held)

    return clean
