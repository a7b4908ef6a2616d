"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks that are reset and checksummed independently. Inside a
block the probability of an id is a mixture of three distributions:

* order 0: how often each id has been seen in the block;
* order 1: the id that has followed the last id, in a table by it;
* order 2: the id that has followed the last two ids, in a table by them.

The weights of the orders adapt: for each confidence of a table's prediction
the coder keeps how often it was right lately. An id that several orders
predict gets the sum of their shares in one interval, so nothing is lost
between them. Ids that order 0 has not had yet are an interval of their own,
followed by the id in adaptive frequencies of its high byte. The intervals
drive a range coder of 48 bits that gives out 16 bits at a time; carries are
added to the words that are out.

A block is cut into stretches that are coded side by side, a step of all of
them by each numpy operation; the more stretches, the less of its time is spent
on anything but their ids. They share one model, which learns after each step
what all of them had, so that it sees the whole block and takes about two MB.
All arithmetic is in whole numbers, so a block decodes alike
everywhere. Blocks with ids beyond 16 bits are coded as twice as many halves.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids in a block: enough for a model, and the most. Stretches of it that are coded side by side: at most so many, and none much shorter than ``_SHORTEST``.
BLOCK, MOST, LANES, _SHORTEST = 3 << 18, 3 << 20, 6144, 256
MAGIC, VERSION = b"LSRC", 4
_HEAD = struct.Struct("<4sBBII")  # magic, version, bytes of an id, ids, crc32 of the ids as little-endian unsigned 32-bit
_SIZES = struct.Struct("<HB")  # the fewest words of a stretch, and whether what the others have beyond it takes two bytes or one
#: What stands for all ids that order 0 has not had, and for none.
_NEW, _NONE = 1 << 16, (1 << 16) + 1
#: Weights are shares of ``_ONE``, from ``_FEWEST`` to ``_MOST``, so no interval is empty. Order 0 is made anew after at most so many steps. Slots of the table of order 2.
_ONE_BITS, _REFRESH, _SECOND = 12, 32, 1 << 16
_ONE, _FEWEST, _MOST = 1 << _ONE_BITS, 16, (1 << _ONE_BITS) * 15 // 16
_LEAST, _STATE = 1 << 32, 1 << 48


class CorruptBlock(ValueError):
    """A block is not what was written."""


def _shape(n: int) -> tuple[int, int]:
    """How many stretches ``n`` symbols are cut into, and their length; only the last one may be shorter."""
    steps = -(-n // min(LANES, max(1, n // _SHORTEST)))
    return -(-n // steps), steps


def _at(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``table[places]``, faster; all places are inside."""
    return table.take(places, mode="clip")


#: A step of a stretch is told by the confidences of order 1 and 2 and whether both say the same (bits 4 to 6, 0 to 2 and 3), ...
_STEPS = np.arange(128)
_SURE1, _SURE2, _OWN1 = _STEPS >> 4, _STEPS & 15, np.where(_STEPS & 8, 0, _STEPS >> 4)
#: ... then by two bits more, whether order 2 and 1 were right. By these, what a slot's confidence becomes, and whether its id stays.
_ENDED = np.arange(512)


def _moves(sure: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(hit, sure < 7, -(sure + 1 >> 1)).astype(np.int32), -(hit | (sure > 1)).astype(np.int32)


_MOVE2, _STAY2 = _moves(_ENDED >> 2 & 7, _ENDED >> 1 & 1 == 1)
_MOVE1, _STAY1 = _moves(_ENDED >> 6, _ENDED & 1 == 1)


class _Model:
    """The adaptive state of a block; the arrays that ``predict`` makes have a place for each stretch."""

    def __init__(self, lanes: int):
        self.counts = np.zeros(1 << 16, np.int64)
        self.news = 1
        self.seen = self.steps = 0  # steps that order 0 has, and all
        self.share, self.under = np.zeros(_NONE + 1, np.int32), np.zeros(_NONE + 1, np.int32)
        # A slot is one number, so that a look touches one place in memory: id * 8 + confidence.
        self.first, self.second = np.full(1 << 16, _NONE << 3, np.int32), np.full(_SECOND, _NONE << 3, np.int32)
        start = np.array([0, 60, 500, 1200, 1800, 2400, 2900, 3200], np.int32)
        self.right2, self.right1 = np.concatenate((start, np.minimum(start * 3 // 2, _MOST))), start // 2
        self.high = np.ones(256, np.int64)
        self.last, self.before, self.at1 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32), np.zeros(lanes, np.intp)
        self._share_out()

    def _share_out(self) -> None:
        """The shares of order 0, in all ``1 << self.bits``, and the id that each point belongs to."""
        some = np.flatnonzero(self.counts > 0)
        self.bits = 16 if len(some) < 1 << 15 else 17
        spare = (1 << self.bits) - len(some) - 1
        counts = np.append(self.counts[some], self.news)
        shares = counts * spare // int(counts.sum()) + 1
        shares[counts.argmax()] += (1 << self.bits) - int(shares.sum())
        ends = np.cumsum(shares)
        some = np.append(some, _NEW).astype(np.int32)
        self.share[some], self.under[some] = shares, ends - shares
        self.at = np.repeat(some, shares)
        self._weigh()

    def _weigh(self) -> None:
        """For each kind of step, the weights of order 2 and 1, and what is left to order 0."""
        weight2 = self.right2[_SURE2]
        left = _ONE - weight2
        weight1 = left * self.right1[_OWN1] >> _ONE_BITS
        self.weight2, self.weight1, self.left = weight2 << self.bits, weight1 << self.bits, left - weight1

    def refresh(self, rows: np.ndarray) -> None:
        """Order 0 from the rows since the last time; often in the beginning."""
        if self.steps - self.seen < min(_REFRESH, max(1, self.seen // 2)):
            return
        had = np.bincount(rows[self.seen : self.steps].ravel(), minlength=1 << 16)
        self.news += int(had.sum() - had[self.counts > 0].sum())
        self.counts += had
        self.seen = self.steps
        self._share_out()

    def predict(self, k: int) -> None:
        """The candidates of the first ``k`` stretches and their intervals; what is beyond is order 0 without the candidates, times ``rest``.

        All intervals together are ``_ONE << self.bits`` long.
        """
        self.last, self.before, self.at1 = self.last[:k], self.before[:k], self.at1[:k]
        at2 = self.last * np.int32(0x9E3779B) + self.before * np.int32(0x5EBCA6B)
        at2 >>= 13
        at2 &= _SECOND - 1
        self.at2 = at2.astype(np.intp)
        self.slot1, self.slot2 = _at(self.first, self.at1), _at(self.second, self.at2)
        self.c1, self.c2 = self.slot1 >> 3, self.slot2 >> 3
        same = (self.c1 == self.c2).astype(np.int32)
        self.step = self.slot1 & 7
        self.step <<= 1
        self.step |= same
        self.step <<= 3
        self.step |= self.slot2 & 7
        step, self.at_c2, self.at_c1 = self.step.astype(np.intp), self.c2.astype(np.intp), self.c1.astype(np.intp)
        self.end2, self.end1, self.rest = _at(self.weight2, step), _at(self.weight1, step), _at(self.left, step)
        self.share2, self.share1 = _at(self.share, self.at_c2), _at(self.share, self.at_c1)
        same -= 1
        self.share1 &= same  # what both say is all order 2's
        self.end2 += self.rest * self.share2
        self.end1 += self.end2
        self.end1 += self.rest * self.share1

    def intervals(self, share: np.ndarray, under: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin and size of the intervals of ids with these places in order 0 without the candidates, or of the candidates where they are right; and masks of where."""
        self.hits2, self.hits1 = hit2.astype(np.int32), hit1.astype(np.int32)
        is2 = -self.hits2
        is1 = -self.hits1 & ~is2
        other = ~(is2 | is1)
        begin = self.rest * under
        begin += self.end1
        begin &= other
        begin |= self.end2 & is1
        size = self.rest * share
        size &= other
        size |= self.end2 & is2
        size |= self.end1 - self.end2 & is1
        return begin, size, is2, is1

    def find(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at points beyond the candidates' intervals, and the candidates' shares before them; anything for points in these."""
        point = (np.maximum(point - self.end1, 0) / self.rest).astype(np.int32)  # exact, for both are far below 2**53
        lower = self.c1 < self.c2
        before = self.share2 * (point >= _at(self.under, self.at_c2) - self.share1 * lower)
        before += self.share1 * (point >= _at(self.under, self.at_c1) - self.share2 * ~lower)
        point += before
        return _at(self.at, point.astype(np.intp)), before

    def learn(self, x: np.ndarray, at: np.ndarray) -> None:
        """``x``: the ids of this step, ``at`` the same as places."""
        self.steps += 1
        ended = self.step
        ended <<= 1
        ended |= self.hits2
        ended <<= 1
        ended |= self.hits1
        ended = ended.astype(np.intp)
        if self.steps < 16 or self.steps % 4 == 0:
            times = np.bincount(ended, minlength=512)
            tried2, tried1 = times.reshape(8, 16, 2, 2).sum((0, 3)), times.reshape(8, 2, 8, 2, 2)[:, 0, :, 0].sum(1)
            for right, tried in ((self.right2, tried2), (self.right1, tried1)):
                n = tried.sum(1)
                right += ((tried[:, 1] * _ONE - n * right) // (n + 64)).astype(np.int32)
                np.minimum(np.maximum(right, _FEWEST, out=right), _MOST, out=right)
                right[::8] = 0  # there is no prediction, or it is that of order 2
            self._weigh()
        fresh = x << 3
        fresh += 1
        for table, place, slot, move, stay in ((self.second, self.at2, self.slot2, _MOVE2, _STAY2), (self.first, self.at1, self.slot1, _MOVE1, _STAY1)):
            slot += _at(move, ended)
            slot ^= fresh
            slot &= _at(stay, ended)
            slot ^= fresh
            table[place] = slot
        self.before, self.last, self.at1 = self.last, x, at


class _Encoder:
    """Low ends and ranges of all stretches, and a row with the words that each has given out."""

    def __init__(self, lanes: int, most: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, _STATE, np.int64)
        self.words = np.zeros((lanes, most), np.int32)
        self.flat, self.next = self.words.ravel(), np.arange(lanes) * most
        self.most = 0  # no row has more words

    def _give(self, whose: np.ndarray, words: np.ndarray) -> None:
        if self.most == self.words.shape[1]:
            self.most = int(self._sizes().max())
            if 4 * self.most > 3 * self.words.shape[1]:
                self.next += np.arange(len(self.words)) * self.words.shape[1]
                self.words = np.hstack((self.words, np.zeros_like(self.words)))
                self.flat = self.words.ravel()
        at = self.next[whose]
        self.flat[at] = words
        at += 1
        self.next[whose] = at
        self.most += 1

    def _sizes(self) -> np.ndarray:
        return self.next - np.arange(len(self.words)) * self.words.shape[1]

    def put(self, at, begin: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        """Takes the new intervals of stretches ``at``, indices or the first ones by a slice."""
        self.low[at] += unit * begin
        width = self.range[at] = unit * size
        short = np.flatnonzero(width < _LEAST)
        if isinstance(at, np.ndarray):
            short = at[short]
        while len(short):
            low = self.low[short]
            self._give(short, low >> 32)
            low &= _LEAST - 1
            low <<= 16
            self.low[short] = low
            width = self.range[short]
            width <<= 16
            self.range[short] = width
            if width.min() >= _LEAST:
                break
            short = short[width < _LEAST]

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        """How many words each stretch has, and all words, one stretch after the other."""
        self._give(np.arange(len(self.low)), self.low + _LEAST - 1 >> 32)
        sizes = self._sizes()
        words = self.words[np.arange(self.words.shape[1]) < sizes[:, None]]
        while len(over := np.flatnonzero(words >> 16)):  # a stretch's first word is never more than 16 bits
            words[over] &= 0xFFFF
            words[over - 1] += 1
        return sizes, words.astype("<u2")


class _Decoder:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        lanes = np.arange(len(sizes))
        self.words = np.zeros(len(words) + 2 * len(sizes), np.int64)  # two zeros behind each stretch, for what its last word stands for
        self.words[np.arange(len(words)) + np.repeat(2 * lanes, sizes)] = words
        self.next = np.cumsum(sizes) - sizes + 2 * lanes
        self.code, self.range = np.zeros(len(sizes), np.int64), np.full(len(sizes), _STATE, np.int64)
        for _ in range(3):
            self.code = self.code << 16 | self._word(lanes)

    def _word(self, short: np.ndarray) -> np.ndarray:
        """The next word of these stretches."""
        at = self.next[short]
        self.next[short] = at + 1
        return _at(self.words, at)

    def take(self, at, begin: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        self.code[at] -= unit * begin
        width = self.range[at] = unit * size
        short = np.flatnonzero(width < _LEAST)
        if isinstance(at, np.ndarray):
            short = at[short]
        while len(short):
            code = self.code[short]
            code <<= 16
            code |= self._word(short)
            self.code[short] = code
            width = self.range[short]
            width <<= 16
            self.range[short] = width
            if width.min() >= _LEAST:
                break
            short = short[width < _LEAST]


def _new_ends(model: _Model) -> tuple[np.ndarray, int]:
    """The ends of the intervals of high bytes, and the length of all; low bytes share them evenly."""
    ends = np.cumsum(model.high)
    return ends, int(ends[-1]) << 8


def _put_new(model: _Model, coder: _Encoder, lanes: np.ndarray, ids: np.ndarray) -> None:
    ends, total = _new_ends(model)
    high, low = ids >> 8, ids & 255
    share = model.high[high]
    coder.put(lanes, (ends[high] - share << 8) + low * share, share, coder.range[lanes] // total)
    model.high += np.bincount(high, minlength=256)


def _inside(point: np.ndarray, total: int) -> np.ndarray:
    """Points, none of which the coder puts beyond all intervals."""
    if point.max() >= total:
        raise CorruptBlock("a block has what the coder never writes")
    return point


def _take_new(model: _Model, coder: _Decoder, lanes: np.ndarray) -> np.ndarray:
    ends, total = _new_ends(model)
    unit = coder.range[lanes] // total
    point = _inside(coder.code[lanes] // unit, total)
    high = np.searchsorted(ends << 8, point, side="right")
    share = model.high[high]
    begin = ends[high] - share << 8
    low = (point - begin) // share
    coder.take(lanes, begin + low * share, share, unit)
    model.high += np.bincount(high, minlength=256)
    return high << 8 | low


def _encode(symbols: np.ndarray) -> bytes:
    n = len(symbols)
    if not n:
        return b""
    lanes, steps = _shape(n)
    table = np.ascontiguousarray(np.pad(symbols.astype("<u2"), (0, lanes * steps - n)).reshape(lanes, steps).T)
    model, coder = _Model(lanes), _Encoder(lanes, steps + 8)
    for step in range(steps):
        k = lanes if (lanes - 1) * steps + step < n else lanes - 1
        x = table[step, :k].astype(np.int32)
        at = x.astype(np.intp)
        model.predict(k)
        hit2, hit1 = model.c2 == x, model.c1 == x
        share, under = _at(model.share, at), _at(model.under, at)
        under -= model.share2 * (model.c2 < x)
        under -= model.share1 * (model.c1 < x)
        new = np.flatnonzero(share == 0)
        if len(new):
            new = new[~(hit2 | hit1)[new]]
            share[new] = model.share[_NEW]
            under[new] = model.under[_NEW] - model.share2[new] - model.share1[new]
        begin, size, _, _ = model.intervals(share, under, hit2, hit1)
        coder.put(slice(0, k), begin, size, coder.range[:k] >> _ONE_BITS + model.bits)
        if len(new):
            _put_new(model, coder, new, x[new])
        model.learn(x, at)
        if k == lanes:
            model.refresh(table)
    sizes, words = coder.flush()
    least = int(sizes.min())
    wide = int(sizes.max()) - least > 255
    return _SIZES.pack(least, wide) + (sizes - least).astype("<u2" if wide else "u1").tobytes() + words.tobytes()


def _decode(coded: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "<u2")
    lanes, steps = _shape(n)
    if len(coded) < _SIZES.size + 2 * lanes:
        raise CorruptBlock("a block is cut short")
    least, wide = _SIZES.unpack_from(coded)
    sizes = np.frombuffer(coded, "<u2" if wide else "u1", lanes, _SIZES.size).astype(np.int64) + least
    words = np.frombuffer(coded, "u1", offset=_SIZES.size + lanes * (2 if wide else 1))
    if 2 * int(sizes.sum()) != len(words):
        raise CorruptBlock("a block is cut short")
    words = np.frombuffer(words.tobytes(), "<u2")
    table = np.zeros((steps, lanes), "<u2")
    model, coder = _Model(lanes), _Decoder(sizes, words)
    for step in range(steps):
        k = lanes if (lanes - 1) * steps + step < n else lanes - 1
        model.predict(k)
        unit = coder.range[:k] >> _ONE_BITS + model.bits
        # exact: codes are below 2**48 and units below 2**21, so what is no whole number is further from one than doubles are off
        point = _inside(coder.code[:k] / unit, _ONE << model.bits).astype(np.int32)
        x, before = model.find(point)
        at = x.astype(np.intp)
        begin, size, is2, is1 = model.intervals(_at(model.share, at), _at(model.under, at) - before, point < model.end2, point < model.end1)
        x &= ~(is2 | is1)
        x |= model.c2 & is2
        x |= model.c1 & is1
        coder.take(slice(0, k), begin, size, unit)
        new = np.flatnonzero(x == _NEW)
        if len(new):
            x[new] = _take_new(model, coder, new)
        table[step, :k] = x
        model.hits1 = (model.c1 == x).astype(np.int32)  # also where order 2 says the same
        model.learn(x, x.astype(np.intp))
        if k == lanes:
            model.refresh(table)
    return table.T.reshape(-1)[:n]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Codes blocks of at most ``MOST`` ids (unsigned, below 2**32); one self-contained string each."""
    out = []
    for block in blocks:
        if len(block) > MOST:
            raise ValueError(f"a block has at most {MOST} ids")
        ids = np.ascontiguousarray(block, "<u4")
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        out.append(_HEAD.pack(MAGIC, VERSION, width, len(ids), zlib.crc32(ids)) + _encode(ids if width == 2 else ids.view("<u2")))
    return out


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of coded blocks as little-endian unsigned 32-bit arrays; raises ``CorruptBlock`` for what fails its checksum."""
    out = []
    for c in coded:
        if len(c) < _HEAD.size or c[:4] != MAGIC:
            raise CorruptBlock("this is not a block of ids")
        _, version, width, n, crc = _HEAD.unpack(c[: _HEAD.size])
        if version != VERSION or width not in (2, 4) or n > MOST:
            raise CorruptBlock("this block is of another version")
        symbols = _decode(c[_HEAD.size :], n * width // 2)
        ids = symbols.astype("<u4") if width == 2 else symbols.view("<u4")
        if zlib.crc32(ids) != crc:
            raise CorruptBlock("a block fails its checksum")
        out.append(ids)
    return out
