"""One finite-state pass over UTF-8 bytes: words, capitals, code points, symbols, distinct words.

A byte has a class; state and class give the next state and what is written out (``WRITES``): the
start or the end of a word, a capital, a code point, a symbol.  The state after a byte follows from
the byte alone, so all steps of a piece are looked up together.  The pass hands word spans to an
open-addressing hash table.  A span that meets an entry with its hash and length is compared byte by
byte before it counts as a repetition, so equal hashes of different words do no harm.

Texts are cut into pieces of ``PIECE`` bytes.  State, open word and table go from a piece to the next, so
memory beyond the text itself is one piece and the distinct words of one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialsift.llm.common import others, quoted
from trialsift.llm.shingles import mix

PIECE = 1 << 20

SPACE, CAPITAL, SYMBOL, ASCII, LEAD, CONTINUATION = range(6)
BETWEEN, INSIDE = 0, 1
START, END, UPPER, POINT, SIGN = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    table = np.full(256, ASCII, dtype=np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = SPACE
    table[ord("A") : ord("Z") + 1] = CAPITAL
    table[[ord(c) for c in "#$%&*|"]] = SYMBOL
    table[0x80:0xC0] = CONTINUATION
    table[0xC0:] = LEAD
    return table


CLASSES = _classes()
# Next state by class, from either state.
NEXT = np.array([BETWEEN, INSIDE, INSIDE, INSIDE, INSIDE, INSIDE], dtype=np.uint8)
# What is written, by state and class.  A continuation byte belongs to the code point before it.
_OWN = np.array([POINT, POINT | UPPER, POINT | SIGN, POINT, POINT, 0], dtype=np.uint8)
WRITES = np.stack([_OWN | START * (NEXT == INSIDE), _OWN | END * (NEXT == BETWEEN)]).astype(np.uint8)

# An odd base for hashes of spans, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for every place of a piece."""

    def row(base: int) -> np.ndarray:
        out = np.full(PIECE + 1, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return row(BASE), row(INVERSE)


class DistinctWords:
    """Open-addressing table of word spans of one buffer; equal hashes are verified on the bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.start = self.length = np.zeros(0, dtype=np.int64)
        self.owner = np.zeros(0, dtype=np.int64)
        self.hash = np.zeros(0, dtype=np.uint64)

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the spans ``a`` and ``b``, of equal lengths, hold the same bytes."""
        out = np.ones(len(a), dtype=bool)
        lengths = self.length[a]
        for i in np.flatnonzero(lengths > PIECE // 16):
            x, y, n = self.start[a[i]], self.start[b[i]], lengths[i]
            out[i] = np.array_equal(self.data[x : x + n], self.data[y : y + n])
        some = np.flatnonzero(lengths <= PIECE // 16)
        while len(some):
            upto = np.searchsorted(np.cumsum(lengths[some]), PIECE, side="right")
            now, some = some[: max(1, upto)], some[max(1, upto) :]
            n = lengths[now]
            ends = np.cumsum(n)
            inside = np.arange(ends[-1]) - np.repeat(ends - n, n)
            x = self.data[np.repeat(self.start[a[now]], n) + inside]
            y = self.data[np.repeat(self.start[b[now]], n) + inside]
            wrong = np.cumsum(x != y)
            out[now] = wrong[ends - 1] == np.r_[0, wrong[ends - 1][:-1]]
        return out

    def _place(self, entries: np.ndarray, verify: bool) -> np.ndarray:
        """Probe slots for the entries; true for those that found no equal entry before them."""
        mask = len(self.slots) - 1
        new = np.zeros(len(entries), dtype=bool)
        left = np.arange(len(entries))
        at = (self.hash[entries] & np.uint64(mask)).astype(np.int64)
        while len(left):
            mine, here = entries[left], at[left]
            free = self.slots[here] < 0
            # Written backwards, so that the first of several entries for one slot has it.
            self.slots[here[free][::-1]] = mine[free][::-1]
            holder = self.slots[here]
            own = holder == mine
            new[left[own]] = True
            again = ~own
            if verify:
                same = again & (self.hash[holder] == self.hash[mine])
                same &= (self.length[holder] == self.length[mine]) & (self.owner[holder] == self.owner[mine])
                spot = np.flatnonzero(same)
                again[spot[self._equal(mine[spot], holder[spot])]] = False
            left = left[again]
            at[left] = (at[left] + 1) & mask
        return new

    def insert(self, start: np.ndarray, length: np.ndarray, owner: np.ndarray, hash: np.ndarray) -> np.ndarray:
        """Which of the spans are the first of their owner with their bytes; these are kept."""
        kept = self.size
        for name, more in (("start", start), ("length", length), ("owner", owner), ("hash", hash)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        wanted = len(self.slots)
        while wanted < 2 * len(self.start):
            wanted *= 2
        if wanted > len(self.slots):
            self.slots = np.full(wanted, -1, dtype=np.int64)
            self._place(np.arange(kept), verify=False)
        new = self._place(np.arange(kept, len(self.start)), verify=True)
        # New entries close up, and their slots follow.
        stays = np.r_[np.ones(kept, dtype=bool), new]
        moved = np.cumsum(stays) - 1
        held = self.slots >= 0
        self.slots[held] = moved[self.slots[held]]
        for name in ("start", "length", "owner", "hash"):
            setattr(self, name, getattr(self, name)[stays])
        self.size = len(self.start)
        return new


class _Pass:
    """The transducer over consecutive texts of one buffer; ``counts`` has a row per text."""

    def __init__(self, data: np.ndarray, n: int):
        self.data = data
        self.words = DistinctWords(data)
        self.counts = np.zeros((n, 5), dtype=np.int64)  # words, distinct, capitals, code points, symbols
        self.open: tuple[int, int] | None = None  # start and hash of a word that goes on

    def piece(self, first: int, bounds: np.ndarray, goes_on: bool) -> None:
        """Texts ``first``, ``first + 1``, ... between ``bounds``; the last may go on in the next piece."""
        low, high = int(bounds[0]), int(bounds[-1])
        size = high - low
        if not size:
            return
        texts = len(bounds) - 1
        classes = CLASSES[self.data[low:high]]
        after = NEXT[classes]
        state = np.empty(size, dtype=np.uint8)
        state[0] = INSIDE if self.open else BETWEEN
        state[1:] = after[:-1]
        edges = bounds[:-1] - low
        filled = np.flatnonzero(bounds[1:] > bounds[:-1])
        state[edges[filled[filled > 0]]] = BETWEEN
        written = WRITES[state, classes]
        owner_ends = bounds[1:] - low

        def per_text(bit: int) -> np.ndarray:
            found = np.flatnonzero(written & bit)
            return np.diff(np.searchsorted(found, np.r_[edges[0], owner_ends]))

        rows = slice(first, first + texts)
        for column, bit in ((2, UPPER), (3, POINT), (4, SIGN)):
            self.counts[rows, column] += per_text(bit)

        starts = np.flatnonzero(written & START)
        # A word ends at white space or with its text.
        last = owner_ends[filled] - 1
        closing = last[after[last] == INSIDE]
        unfinished = goes_on and after[-1] == INSIDE
        if unfinished:
            closing = closing[:-1]
        ends = np.sort(np.concatenate([np.flatnonzero(written & END), closing + 1]))
        power, inverse = _powers()
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((self.data[low:high].astype(np.uint64) + np.uint64(1)) * power[:size], out=sums[1:])

        if self.open:
            begin, partial = self.open
            scale = np.uint64(pow(BASE, low - begin, 1 << 64))
            stop = int(ends[0]) if len(ends) else size
            with np.errstate(over="ignore"):
                whole = np.uint64(partial) + scale * sums[stop]
            if not len(ends):
                self.open = (begin, int(whole)) if unfinished else None
                return
            head = (np.array([begin]), np.array([low + stop - begin]), np.array([whole], dtype=np.uint64))
            ends = ends[1:]
            self.open = None
        else:
            head = None
        if unfinished:
            begin = int(starts[-1])
            starts = starts[:-1]
            with np.errstate(over="ignore"):
                self.open = (low + begin, int((sums[size] - sums[begin]) * inverse[begin]))
        begin, length = starts + low, ends - starts
        hashes = (sums[ends] - sums[starts]) * inverse[starts]
        if head:
            begin, length, hashes = (np.concatenate(p) for p in zip(head, (begin, length, hashes)))
        owner = np.searchsorted(bounds, begin, side="right") - 1
        owner = first + np.maximum(owner, 0)
        salted = mix(hashes + owner.astype(np.uint64) * np.uint64(BASE))
        new = self.words.insert(begin, length, owner, salted)
        self.counts[:, 0] += np.bincount(owner, minlength=len(self.counts))
        self.counts[:, 1] += np.bincount(owner[new], minlength=len(self.counts))


def count_texts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols of the texts between ``bounds``."""
    n = len(bounds) - 1
    run = _Pass(data, n)
    at = 0
    while at < n:
        upto = int(np.searchsorted(bounds, bounds[at] + PIECE, side="right")) - 1
        if upto > at:
            run.piece(at, bounds[at : upto + 1], goes_on=False)
            at = upto
        else:
            end = int(bounds[at + 1])
            for low in range(int(bounds[at]), end, PIECE):
                high = min(low + PIECE, end)
                run.piece(at, np.array([low, high], dtype=np.int64), goes_on=high < end)
            at += 1
        run.words.clear()
    return run.counts


NAMES = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def _text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of the texts, NULLs empty, without copies of the bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return raw, bounds.astype(np.int64)


def _counts_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        counts = count_texts(*_text_buffer(texts)) if len(texts) else np.zeros((0, 5), dtype=np.int64)
        yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in counts.T], list(NAMES))


def text_counts(docs: DataFrame, text: str = "text", name: str = "counts") -> DataFrame:
    """All columns of ``docs`` and the struct ``name`` of the counts ``NAMES`` of the whole text.

    Words are maximal runs of other bytes than ASCII white space, case-sensitive; capitals are A-Z;
    symbols are ``#$%&*|``.  A NULL or empty text has zeros.  Every row is counted by itself, so that
    ties and repeated rows change nothing; an empty table gives an empty table; a column ``name`` is replaced.
    """
    fields = ", ".join(f"{n} long" for n in NAMES)
    count = F.arrow_udf(_counts_of, f"struct<{fields.replace(' long', ': bigint')}>")
    return docs.select(*others(docs, (name,)), count(quoted(text).cast("string")).alias(name))
