"""Adaptive context-mixing range coder for token ids, many blocks side by side.

Every block starts from an empty model.  For each id the model predicts:

* order 2: what followed the last two ids the last time, with a confidence (how often in a row it was right);
* order 1: what followed the last id the last time, with a confidence;
* order 0: counts so far in the block of the upper bytes of ids that neither of them foretold.  The
  lower byte is taken as even, so it is kept as it is.

How much of the probability the two predictions get is itself learned: the share of right guesses at
each confidence, per block.  The interval of the coder is laid out as ``[order 2 | order 1 | order 0]``.
Counts are gathered as ids come and turned into intervals at the places of ``_REFRESH``.  Encoder and decoder
agree on every machine: all is done on whole numbers, but for single divisions and products that IEEE 754 fixes.

Blocks are the columns of NumPy arrays and one step codes the next id of each of them.  A payload has the
words of the range coder, padding to four bytes, and the lower bytes from its end backwards.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1024  # ids of a block
LANES = 6144  # blocks coded together, or up to half as many more: a step costs much the same for a few of them
_SLOTS = 512  # entries of the context tables
_SHARE = 12  # bits of the scale of shares
_COUNT = 14  # bits of the scale of order 0
_TOTAL = _SHARE + _COUNT
_MOST = 3584  # largest share of one prediction
_FIRST, _GAIN = 3, 24  # order 0: what every symbol starts with, and what one adds
_START = np.array([0, 1024, 2048, 3072])  # shares at each confidence before there are counts; none without an entry
_WEIGHT = 8  # guesses that a first share stands for
_REFRESH = (16, 48, 112, 208, 336, 512, 720)  # ids of a block after which counts are used
_LOW = np.uint64(1 << 32)
_HALF = np.uint64(32)
_HASH = np.array([2654435761, 2246822519], dtype=np.uint32)
_SHIFT = np.uint32(23)


class _Model:
    """State of the blocks of a batch, which are sorted by falling length: ``n`` of them go on."""

    def __init__(self, n: int, length: int):
        row = np.arange(n)
        self.slots, self.cells, self.sums, self.rows = row * _SLOTS, row * 8, row * 257, row * 256
        self.table = [np.zeros(n * _SLOTS, dtype=np.int32) for _ in range(2)]  # id << 2 | confidence
        self.share = [np.repeat(np.tile(_START, n), 2).astype(np.int32) for _ in range(2)]
        # Guesses at each confidence, and how many of them held.
        self.tried = [np.full(n * 4, _WEIGHT) for _ in range(2)]
        self.held = [np.tile(_START * _WEIGHT >> _SHARE, n) for _ in range(2)]
        self.counts = np.full((n, 256), _FIRST, dtype=np.int32)
        self.hash = np.zeros(n, dtype=np.uint32)
        self.older = np.zeros(n, dtype=np.uint32)
        # What happened since counts were used: twice the cell of a guess, one more if it held; upper bytes.
        places = [0, *(r for r in _REFRESH if r < length), length]
        span = max(b - a for a, b in zip(places, places[1:]))
        self.seen = [np.zeros((span, n), dtype=np.int64) for _ in range(2)]
        self.upper = np.zeros((span, n), dtype=np.int64)
        self.missed = np.zeros((span, n), dtype=bool)
        self.widths: list[int] = []
        self._intervals()

    def _intervals(self) -> None:
        """Running sums of order 0, scaled so that every symbol has one unit at least."""
        sums = np.cumsum(self.counts, axis=1, dtype=np.int32)
        scale = (np.float32((1 << _COUNT) - 256) / sums[:, -1:].astype(np.float32)).astype(np.float32)
        scaled = (sums.astype(np.float32) * scale).astype(np.int16)
        bounds = np.zeros((len(sums), 257), dtype=np.int16)
        np.add(scaled, np.arange(1, 257, dtype=np.int16), out=bounds[:, 1:])
        bounds[:, 256] = 1 << _COUNT
        self.bounds = bounds.ravel()
        self.coarse = np.ascontiguousarray(bounds[:, 16:256:16].T)

    def _recent(self, kept: np.ndarray) -> np.ndarray:
        """Rows of the steps since the last call, one after another."""
        if self.widths[-1] == kept.shape[1]:
            return kept[: len(self.widths)].ravel()
        return np.concatenate([kept[t, :n] for t, n in enumerate(self.widths)])

    def refresh(self) -> None:
        """Take the counts of the steps since the last call into the model."""
        for k in range(2):
            found = np.bincount(self._recent(self.seen[k]), minlength=len(self.cells) * 8).reshape(-1, 2)
            self.tried[k] += found[:, 0] + found[:, 1]
            self.held[k] += found[:, 1]
            share = np.minimum((self.held[k] << _SHARE) // self.tried[k], _MOST).astype(np.int32)
            share[::4] = 0  # without an entry
            self.share[k][::2] = share
        upper = self._recent(self.upper)[self._recent(self.missed)]
        found = np.bincount(upper, minlength=len(self.rows) * 256).astype(np.int32)
        self.counts += _GAIN * found.reshape(-1, 256)
        self._intervals()
        self.widths = []

    def predict(self, n: int) -> None:
        last, step = self.hash[:n], len(self.widths)
        keys = ((last + self.older[:n]) >> _SHIFT, last >> _SHIFT)
        self.at = [self.slots[:n] + k for k in keys]
        self.entry = [t.take(a, mode="clip") for t, a in zip(self.table, self.at)]
        self.guess = [e >> 2 for e in self.entry]
        self.sure = [e & 3 for e in self.entry]
        cells = [np.add(self.cells[:n], s << 1, out=b[step, :n]) for s, b in zip(self.sure, self.seen)]
        two, one = (p.take(c, mode="clip") for p, c in zip(self.share, cells))
        one = ((1 << _SHARE) - two) * one >> _SHARE
        joint = one * (self.guess[0] == self.guess[1])
        self.two, self.one = two + joint, one - joint
        self.base = two + one
        self.room = (1 << _SHARE) - self.base

    def order0(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals within order 0 that begin at the places ``at`` of the running sums."""
        low = self.bounds.take(at, mode="clip").astype(np.int32)
        return low * self.room, (self.bounds.take(at + 1, mode="clip") - low) * self.room

    def find0(self, n: int, want: np.ndarray) -> np.ndarray:
        """Upper bytes whose intervals within order 0 hold ``want``."""
        goal = (want / self.room).astype(np.int16)  # exact: whole numbers below 2^26
        coarse = self.coarse if n == self.coarse.shape[1] else self.coarse[:, :n]
        group = np.add.reduce((coarse <= goal).view(np.int8), axis=0, dtype=np.int8)
        inner = np.zeros(n, dtype=np.int8)
        first = self.sums[:n] + (group.astype(np.int64) << 4)
        for step in (8, 4, 2, 1):
            at = first + inner
            at += step
            inner += (self.bounds.take(at, mode="clip") <= goal).view(np.int8) * np.int8(step)
        return (group.astype(np.int32) << 4) + inner

    def update(self, n: int, ids: np.ndarray, upper: np.ndarray, missed: np.ndarray) -> None:
        """``missed`` is true where order 0 had to code the id."""
        step, fresh = len(self.widths), ids << 2 | 1
        for k in range(2):
            hit = self.guess[k] == ids
            # Right once more, up to three times; otherwise the new id takes the place.
            self.table[k][self.at[k]] = fresh + np.minimum(self.sure[k], 2) * hit
            self.seen[k][step, :n] += hit
        np.add(self.rows[:n], upper, out=self.upper[step, :n])
        self.missed[step, :n] = missed
        self.widths.append(n)
        np.multiply(self.hash[:n], _HASH[1], out=self.older[:n])
        np.multiply(ids.view(np.uint32), _HASH[0], out=self.hash[:n])


def _batches(lengths: np.ndarray):
    """Blocks in groups of about equal size that are coded together, each sorted by falling length."""
    order = np.argsort(-lengths, kind="stable")
    count = max(1, round(len(order) / LANES))
    yield from (g for g in np.array_split(order, count) if len(g))


def encode_blocks(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Payload and checksum of each block of ``ids``."""
    payloads: list[bytes] = [b""] * len(starts)
    wide = np.ascontiguousarray(ids, dtype="<u4")
    checks = [zlib.crc32(wide[s : s + n]) for s, n in zip(starts.tolist(), lengths.tolist())]
    for group in _batches(lengths):
        first, size, n_all = starts[group], lengths[group], len(group)
        longest = int(size.max(initial=0))
        model = _Model(n_all, longest)
        low = np.zeros(n_all, dtype=np.uint64)
        width = np.full(n_all, (1 << 64) - 1, dtype=np.uint64)
        words = np.zeros((longest * _TOTAL // 32 + 4) * n_all, dtype=np.int64)
        place = np.arange(n_all)  # of each block's next word
        missing = np.zeros((longest, n_all), dtype=bool)
        lower = np.zeros((longest, n_all), dtype=np.uint8)
        alive = np.searchsorted(-size, -np.arange(longest), side="left").tolist()
        for t, n in enumerate(alive):
            if t in _REFRESH:
                model.refresh()
            symbol = wide[first[:n] + t].astype(np.int32)
            upper = symbol >> 8
            model.predict(n)
            hit2 = (model.two > 0) & (symbol == model.guess[0])
            hit1 = (model.one > 0) & (symbol == model.guess[1])
            missed = ~(hit2 | hit1)
            begin, part = model.order0(model.sums[:n] + upper)
            start = np.where(missed, (model.base << _COUNT) + begin, model.two * (~hit2) << _COUNT)
            freq = np.where(missed, part, np.where(hit2, model.two, model.one) << _COUNT)
            unit = width[:n] >> np.uint64(_TOTAL)
            old = low[:n].copy()
            low[:n] += unit * start.astype(np.uint64)
            np.multiply(unit, freq.astype(np.uint64), out=width[:n])
            carry = np.flatnonzero(low[:n] < old)
            words[place[carry] - n_all] += 1
            narrow = np.flatnonzero(width[:n] < _LOW)
            words[place[narrow]] = (low[narrow] >> _HALF).astype(np.int64)
            place[narrow] += n_all
            low[narrow] <<= _HALF
            width[narrow] <<= _HALF
            missing[t, :n] = missed
            lower[t, :n] = symbol & 255
            model.update(n, symbol, upper, missed)
        for half in (low >> _HALF, low & (_LOW - np.uint64(1))):  # the interval's lower end
            words[place] = half.astype(np.int64)
            place += n_all
        words = words.reshape(-1, n_all)
        for k in range(len(words) - 1, 0, -1):
            words[k - 1] += words[k] >> 32
        out = np.ascontiguousarray(words.T.astype("<u4"))
        used = (place // n_all).tolist()
        kept, ends = lower.T[missing.T], np.cumsum(missing.sum(axis=0)).tolist()
        for i, (g, a, b) in enumerate(zip(group.tolist(), [0, *ends], ends)):
            payloads[g] = out[i, : used[i]].tobytes() + bytes((a - b) % 4) + kept[a:b][::-1].tobytes()
    return payloads, checks


def decode_blocks(payloads: list[bytes], lengths: np.ndarray, checks: list[int]) -> list[np.ndarray]:
    """Ids of each block; a block that does not match its checksum is an error."""
    result: list[np.ndarray] = [np.array([], dtype="<u4")] * len(payloads)
    for group in _batches(lengths):
        size, n_all = lengths[group], len(group)
        own = [payloads[g] for g in group.tolist()]
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=n_all)
        if (sizes % 4).any() or (sizes < 8).any():
            raise ValueError("a block of token ids is cut off")
        raw = np.frombuffer(b"".join(own), dtype=np.uint8)
        flat = raw.view("<u4").astype(np.uint64)
        ends = np.cumsum(sizes)
        at, last, behind = (ends - sizes) // 4, len(flat) - 1, ends - 1
        longest = int(size.max(initial=0))
        model = _Model(n_all, longest)
        code = (flat[at] << _HALF) | flat[at + 1]
        at = at + 2
        width = np.full(n_all, (1 << 64) - 1, dtype=np.uint64)
        out = np.zeros((longest, n_all), dtype="<u4")
        alive = np.searchsorted(-size, -np.arange(longest), side="left").tolist()
        for t, n in enumerate(alive):
            if t in _REFRESH:
                model.refresh()
            model.predict(n)
            unit = width[:n] >> np.uint64(_TOTAL)
            slot = np.minimum(code[:n] // unit, np.uint64((1 << _TOTAL) - 1)).astype(np.int32)
            coarse = slot >> _COUNT
            hit2 = coarse < model.two
            missed = coarse >= model.base
            base = model.base << _COUNT
            upper = model.find0(n, (slot - base) * missed)
            begin, part = model.order0(model.sums[:n] + upper)
            symbol = np.where(missed, upper << 8 | raw.take(behind[:n], mode="clip"), np.where(hit2, *model.guess))
            symbol = symbol.astype(np.int32)
            behind[:n] -= missed
            start = np.where(missed, base + begin, model.two * (~hit2) << _COUNT)
            freq = np.where(missed, part, np.where(hit2, model.two, model.one) << _COUNT)
            code[:n] -= unit * start.astype(np.uint64)
            np.multiply(unit, freq.astype(np.uint64), out=width[:n])
            narrow = np.flatnonzero(width[:n] < _LOW)
            code[narrow] = (code[narrow] << _HALF) | flat[np.minimum(at[narrow], last)]
            at[narrow] += 1
            width[narrow] <<= _HALF
            out[t, :n] = symbol
            model.update(n, symbol, symbol >> 8, missed)
        out = np.ascontiguousarray(out.T)
        for i, (g, n) in enumerate(zip(group.tolist(), size.tolist())):
            found = out[i, :n]
            if zlib.crc32(found) != checks[g]:
                raise ValueError("a block of token ids does not match its checksum")
            result[g] = found
    return result
