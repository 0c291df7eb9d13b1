"""A bidirectional FM-index over a vocabulary, and the search for words that are one error away."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Codes in the indexed text: its end, and what stands before and after every word. Letters follow.
END, EDGE = 0, 1
#: Words looked up at once, and rows of an interval that are listed at once.
BLOCK, LISTED = 8192, 1 << 21


class Interval(NamedTuple):
    """Where a pattern stands: its first suffix rank, that of the reversed pattern in the reversed text, and how often it occurs."""

    at: np.ndarray
    back: np.ndarray
    size: np.ndarray

    def of(self, which: np.ndarray) -> Interval:
        return Interval(self.at[which], self.back[which], self.size[which])


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the suffixes in order, by doubling. The text ends with END, which stands nowhere else."""
    n, width = len(text), 62 // bits
    key = np.zeros(n, np.int64)
    for i in range(width):
        key <<= bits
        key[:max(0, n - i)] |= text[i:]
    while True:
        order = np.argsort(key)
        rank = np.append(0, np.cumsum(key[order[1:]] != key[order[:-1]]))
        if rank[-1] == n - 1:
            return order
        place = np.empty(n, np.int64)
        place[order] = rank
        key = place * (n + 1)
        key[:n - width] += place[width:] + 1
        width *= 2


class Ranks:
    """A sequence of codes as a wavelet matrix: how many of a range are a code, and how many are less, in a step per bit."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.bits, self.zeros, self.split = bits, [], []
        self.total = np.bincount(codes, minlength=1 << bits)
        self.before = np.cumsum(self.total) - self.total
        for bit in reversed(range(bits)):
            one = (codes >> bit & 1).astype(bool)
            self.zeros.append(np.append(0, np.cumsum(~one)).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            codes = np.concatenate([codes[~one], codes[one]])
        every = np.arange(1 << bits)
        self.opens = self._walk(every, np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64))[0]

    def _walk(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        less = np.zeros(len(code), np.int64)
        for level, bit in enumerate(reversed(range(self.bits))):
            zeros, one = self.zeros[level], (code >> bit & 1).astype(bool)
            low0, high0 = zeros[low], zeros[high]
            less += np.where(one, high0 - low0, 0)
            low = np.where(one, self.split[level] + low - low0, low0)
            high = np.where(one, self.split[level] + high - high0, high0)
        return low, high, less

    def __call__(self, code: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For codes put before intervals: the first rank, how often, and how many in the interval are less."""
        low, high, less = self._walk(code, at, at + size)
        return self.before[code] + low - self.opens[code], high - low, less


class Index:
    """Both directions of a vocabulary of distinct words, each between two EDGEs; ``reverse`` reads it from right to left."""

    def __init__(self, words: list[str]):
        lengths = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        alphabet, codes = np.unique(letters, return_inverse=True)
        self.letters = len(alphabet)
        text = np.full(len(letters) + len(words) + 2, EDGE, np.int64)
        text[np.arange(len(letters)) + 1 + np.repeat(np.arange(len(words)), lengths)] = codes + 2
        text[-1] = END
        back = np.append(text[-2::-1], END)
        bits = max(1, int(self.letters + 1).bit_length())
        suffixes = suffix_array(text, bits)
        self.left = Ranks(text[suffixes - 1], bits)
        self.before_left = text[suffixes - 1]
        reversed_suffixes = suffix_array(back, bits)
        self.right = Ranks(back[reversed_suffixes - 1], bits)
        self.before_right = back[reversed_suffixes - 1]
        self.text, self.lengths = text, lengths
        self.starts = 1 + np.cumsum(lengths + 1) - lengths - 1
        self.word_at = np.cumsum(text == EDGE)[suffixes] - 1
        self.forward, self.other = True, None

    def reverse(self) -> Index:
        """The same index with left and right exchanged: words are spelled backwards."""
        if self.other is None:
            new = object.__new__(Index)
            new.__dict__.update(self.__dict__)
            new.left, new.right, new.before_left, new.before_right = self.right, self.left, self.before_right, self.before_left
            new.text = np.append(self.text[-2::-1], END)
            new.starts = len(self.text) - 1 - (self.starts + self.lengths)
            new.forward, new.other, self.other = not self.forward, self, new
        return self.other

    def all(self, n: int) -> Interval:
        """Intervals of the empty pattern."""
        return Interval(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(self.text), np.int64))

    def extend_left(self, found: Interval, code: np.ndarray) -> Interval:
        at, size, less = self.left(code, found.at, found.size)
        return Interval(at, found.back + less, size)

    def extend_right(self, found: Interval, code: np.ndarray) -> Interval:
        back, size, less = self.right(code, found.back, found.size)
        return Interval(found.at + less, back, size)

    def letters_after(self, found: Interval) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which letters stand right of patterns, as (pattern, code): read off short intervals, all letters tried for long ones."""
        many = np.flatnonzero(found.size > self.letters)
        step = max(1, LISTED // max(1, self.letters))
        for start in range(0, len(many), step):
            some = many[start:start + step]
            yield np.repeat(some, self.letters), np.tile(np.arange(2, self.letters + 2), len(some))
        few = np.flatnonzero(found.size <= self.letters)
        if len(few):
            size = found.size[few]
            pattern = np.repeat(few, size)
            code = self.before_right[np.repeat(found.back[few] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            both = np.unique((pattern << 32 | code)[code > EDGE])
            yield both >> 32, both & 0xFFFFFFFF

    def words(self, found: Interval) -> np.ndarray:
        """The word of each interval of a pattern EDGE word EDGE."""
        return self.word_at[found.at if self.forward else found.back]


def one_error(index: Index, word: np.ndarray, longer: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words one error away from the given ones, as (place in ``word``, the other word), each once.

    The error stands at one of the places first to last - 1 of the longer of the two words, counted in reading order of the
    index: the letters before match exactly, from the place next to the error out to the edge; then the pattern grows the
    other way, with one error and exactly behind it. With ``longer`` the other word has a letter more, else it has as many or
    one fewer. Of several places of a letter in a row that one could take out the last in the words' own reading order counts,
    which is the place where the two words part.
    """
    for start in range(0, len(word), BLOCK):
        part = slice(start, start + BLOCK)
        for which, other in _one_error(index, word[part], longer[part], first[part], last[part]):
            yield which + start, other


def _one_error(index: Index, word, longer, first, last):
    opens, length, text = index.starts[word], index.lengths[word], index.text

    def exact_left(found: Interval) -> Interval:
        place = first - 1
        active = np.arange(len(word))
        at, back, size = (x.copy() for x in found)
        while len(active):  # the letters before the error, then the edge before the word
            grown = index.extend_left(Interval(at[active], back[active], size[active]), text[opens[active] + place[active]])
            at[active], back[active], size[active] = grown
            place[active] -= 1
            active = active[(grown.size > 0) & (place[active] >= -1)]
        return Interval(at, back, size)

    def finish(who, found, place):
        """Match the rest of words exactly, the edge included."""
        while len(who):
            live = found.size > 0
            who, found, place = who[live], found.of(live), place[live]
            done = place > length[who]
            if done.any():
                yield who[done], index.words(found.of(done))
                who, found, place = who[~done], found.of(~done), place[~done]
            if len(who):
                found = index.extend_right(found, text[opens[who] + place])
                place = place + 1

    found = exact_left(index.all(len(word)))
    who, place = np.arange(len(word)), first.copy()
    while True:
        live = (found.size > 0) & (place < last[who]) & (place <= length[who])
        who, found, place = who[live], found.of(live), place[live]
        if not len(who):
            return
        here = text[opens[who] + place]  # the edge, behind the last letter
        beside = here if index.forward else text[opens[who] + place - 1]
        after = text[opens[who] + place + 1 * (place < length[who])] if index.forward else beside
        fewer = np.flatnonzero(~longer[who] & (here != EDGE) & (here != after))
        yield from finish(who[fewer], found.of(fewer), place[fewer] + 1)
        for pattern, code in index.letters_after(found):
            other = np.where(longer[who[pattern]], code != beside[pattern], (code != here[pattern]) & (here[pattern] != EDGE))
            pattern, code = pattern[other], code[other]
            yield from finish(who[pattern], index.extend_right(found.of(pattern), code), place[pattern] + ~longer[who[pattern]])
        found, place = index.extend_right(found, here), place + 1
