"""Lossless WebP (VP8L): a decoder to pixel arrays, and an encoder for media columns.

The decoder handles all of the format: simple and normal prefix codes, groups of codes chosen by an entropy image,
back-references, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms. Images with one
group of codes are decoded by arrays, several at a time: what a code word at each bit would be is looked up for all bits, a chain of steps finds
the bits where code words begin, and copies and cached colours are followed back to their literals by pointer doubling.

The encoder chooses for each image what takes the fewest bits by estimate: no transform, subtract-green, the predictors from
the left or from above, or a palette; no colour cache or one; then back-references and prefix codes made from the counts, or level
codes of one length where those with their lists of lengths take fewer bits. Images of all sizes go the same way.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import mul
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import Batches, column_bytes, limit_batches, unused_name

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed values of the format: order in which the lengths of the length code are stored.
_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: Fixed values of the format: columns to the left and rows up for the 120 short distance codes.
_NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
_CACHE_FACTOR = 0x1E35A7BD
#: Images of fewer pixels are decoded one by one, which costs less than arrays do.
_BY_ARRAYS = 96
#: Bits of one image whose code words are looked up at once, and bits of several images that are read together.
_AT_ONCE = 1 << 17
_READ_TOGETHER = 1 << 17
_EIGHT = np.arange(8, dtype=np.uint32)


class BadImage(ValueError):
    """The bytes are not a lossless WebP image, or end too early."""


class Bits:
    """Reads the least significant bits first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def block(self, at: int, n: int) -> int:
        """n bits from a place on, however many."""
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & (1 << n) - 1

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.size:
            raise BadImage("the data end too early")
        return value

    def fields(self, count: int, width: int) -> np.ndarray:
        """The next count * width bits as rows of bits."""
        first, last = self.at >> 3, -(-(self.at + count * width) // 8)
        if last > len(self.data):
            raise BadImage("the data end too early")
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, last - first, first), bitorder="little")
        skip = self.at & 7
        self.at += count * width
        return bits[skip : skip + count * width].reshape(count, width)


@lru_cache(maxsize=16)
def _reversal(bits: int) -> np.ndarray:
    """The numbers below 2**bits with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


_SEVEN = _reversal(7).tolist()


class PrefixCode:
    """A canonical prefix code of lengths up to 15, as a table over the next `bits` bits."""

    def __init__(self, lengths: bytes) -> None:
        of = np.frombuffer(lengths, np.uint8)
        used = of.nonzero()[0]
        self.most = int(used[-1]) if len(used) else 0
        if len(used) < 2:  # a lone symbol takes no bits
            self.bits = 0
            self.table, self.sizes = np.array([self.most], np.uint16), np.zeros(1, np.uint8)
        else:
            of = of[used]
            order = of.argsort(kind="stable")  # canonical: words go up with (length, symbol)
            of = of[order]
            self.bits = int(of[-1])
            spans = 1 << self.bits - of.astype(np.int64)
            if spans.sum() != 1 << self.bits:
                raise BadImage("a prefix code is not complete")
            back = _reversal(self.bits)
            self.table = used[order].astype(np.uint16).repeat(spans)[back]
            self.sizes = of.repeat(spans)[back]
        self.symbols, self.lengths = memoryview(self.table), memoryview(self.sizes)

    @property
    def fixed(self) -> bool:
        """All symbols have codes of one length."""
        return bool((self.sizes == self.bits).all())

    def read(self, bits: Bits) -> int:
        at = bits.peek(self.bits) if self.bits else 0
        bits.at += self.lengths[at]
        if bits.at > bits.size:
            raise BadImage("the data end too early")
        return self.symbols[at]


@lru_cache(maxsize=512)
def _code(lengths: bytes) -> PrefixCode:
    return PrefixCode(lengths)


def _few_entries(lengths: bytearray) -> list[tuple[int, int]]:
    """Symbol and length of the code word at the start of each seven bits, of a code of lengths up to 7; a lone symbol takes no bits."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return [(used[0][1] if used else 0, 0)] * 128
    if sum(128 >> n for n, _ in used) != 128:
        raise BadImage("a prefix code is not complete")
    table, word = [(0, 0)] * 128, 0
    for n, s in used:
        table[_SEVEN[word] :: 1 << n] = [(s, n)] * (128 >> n)
        word += 128 >> n
    return table


#: Extra bits and least number of the repeats that the length symbols from 16 on stand for.
_REPEATS = ((2, 3), (3, 3), (7, 11))


def _read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = bytearray(alphabet)
    if bits.read(1):
        two = bits.read(1)
        for width in [1 + 7 * bits.read(1)] + [8] * two:
            s = bits.read(width)
            if s >= alphabet:
                raise BadImage("a symbol is not in its alphabet")
            lengths[s] = 1
        return _code(bytes(lengths))
    of, count = bytearray(19), 4 + bits.read(4)
    sent = bits.block(bits.at, 3 * count)
    bits.at += 3 * count
    for s in _LENGTH_ORDER[:count]:
        of[s] = sent & 7
        sent >>= 3
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    table = _few_entries(of)
    at, last, data, place = 0, 8, bits.data, bits.at
    while at < alphabet and left > 0:
        window = int.from_bytes(data[place >> 3 : (place >> 3) + 29], "little") >> (place & 7)  # 16 code words of 7 bits and 7 more
        for _ in range(min(left, 16)):
            s, n = table[window & 127]
            if s < 16:
                if s:
                    lengths[at] = last = s
                at += 1
            else:
                extra, times = _REPEATS[s - 16]
                times += window >> n & (1 << extra) - 1
                n += extra
                if at + times > alphabet:
                    raise BadImage("code lengths run over")
                if s == 16:
                    lengths[at : at + times] = bytes([last]) * times
                at += times
            place += n
            if at == alphabet:
                break
            window >>= n
        left -= 16
    bits.at = place
    if bits.at > bits.size:
        raise BadImage("the data end too early")
    return _code(bytes(lengths))


def _read_codes(bits: Bits, alphabets: tuple[int, ...]) -> list[PrefixCode]:
    """One code after the other; the same bits again, for the same alphabet, are the same code."""
    out: list[PrefixCode] = []
    last = None
    for a in alphabets:
        if last is not None and last[0] == a and bits.at + last[2] <= bits.size and bits.block(bits.at, last[2]) == last[1]:
            bits.at += last[2]
            out.append(out[-1])
            continue
        began = bits.at
        out.append(_read_code(bits, a))
        last = (a, bits.block(began, bits.at - began), bits.at - began)
    return out


def _long_value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return (2 + (prefix & 1) << extra) + bits.read(extra) + 1


class _Opened(NamedTuple):
    """An entropy-coded image whose codes are read; of `bits`, its pixels come next."""

    bits: Bits
    width: int
    total: int
    cache_bits: int
    groups: list[list[PrefixCode]]
    groups_of: list[int] | None
    block: int


def _opened(bits: Bits, width: int, height: int, main: bool) -> _Opened:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("the colour cache is too large")
    block, groups_of = 0, None
    n_groups = 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        groups_of = (_read_pixels(bits, _blocks(width, block), _blocks(height, block), False) >> np.uint32(8) & np.uint32(0xFFFF)).tolist()
        n_groups = max(groups_of) + 1
    groups = [_read_codes(bits, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)) for _ in range(n_groups)]
    return _Opened(bits, width, width * height, cache_bits, groups, groups_of, block)


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB values (uint32), row after row."""
    return _pixels_of([_opened(bits, width, height, main)])[0]


def _pixels_of(images: list[_Opened]) -> list[np.ndarray]:
    """The ARGB values of each image; those with one group of codes are read together."""
    out, together = {}, []
    for i, image in enumerate(images):
        green = image.groups[0][0]
        if len(image.groups) == 1 and green.most < 256 and all(c.fixed for c in image.groups[0][:4]):
            out[i] = _fixed_pixels(image.bits, image.groups[0], image.total)
        elif image.groups_of is None and green.bits and (len(images) > 1 or image.total >= _BY_ARRAYS):
            together.append(i)
        else:
            out[i] = _one_by_one(image)
    if together:
        for i, found in zip(together, _array_pixels([images[i] for i in together]), strict=True):
            out[i] = _one_by_one(images[i]) if found is None else found
    return [out[i] for i in range(len(images))]


def _one_by_one(image: _Opened) -> np.ndarray:
    bits, width, total, cache_bits, groups, groups_of, block = image
    across = _blocks(width, block)
    out: list[int] = []
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift, cached = 32 - cache_bits, 0
    group = groups[0]
    while len(out) < total:
        at = len(out)
        if groups_of is not None:
            y, x = divmod(at, width)
            group = groups[groups_of[(y >> block) * across + (x >> block)]]
        s = group[0].read(bits)
        if s < 256:
            r = group[1].read(bits)
            b = group[2].read(bits)
            out.append(group[3].read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            length = _long_value(bits, s - 256)
            distance = _long_value(bits, group[4].read(bits))
            if distance > 120:
                distance -= 120
            else:
                dx, dy = _NEAR[distance - 1]
                distance = max(1, dx + dy * width)
            if distance > at or at + length > total:
                raise BadImage("a back-reference leaves the image")
            for i in range(at - distance, at - distance + length):
                out.append(out[i])
        else:
            for p in out[cached:]:
                cache[(p * _CACHE_FACTOR & 0xFFFFFFFF) >> shift] = p
            cached = at
            out.append(cache[s - 280])
    return np.array(out, np.uint32)


def _extra(prefix: np.ndarray) -> np.ndarray:
    return np.maximum(prefix - 2 >> 1, 0)


def _values(prefix: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Lengths or distances of prefixes, whose extra bits are the lowest of `window`."""
    extra = _extra(prefix)
    return np.where(prefix < 4, prefix, (2 + (prefix & 1) << extra) + (window & (1 << extra) - 1)) + 1


def _laid(tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tables one after the other, and where each begins."""
    sizes = np.array([len(t) for t in tables])
    return np.concatenate(tables), sizes.cumsum() - sizes


def _tokens(images: list[_Opened]) -> list[np.ndarray]:
    """Number of the image, green symbol, pixel count, distance code (of copies) and colour (of literals) of each code word, image by image."""
    groups = [image.groups[0] for image in images]
    like = [next(j for j in range(i + 1) if all(g[j] is g[i] for g in groups)) for i in range(5)]  # the first code of the five that is the same in all images
    tables, sizes, begins, masks = [], [], [], []
    for i in range(5):
        if like[i] < i:
            for x in (tables, sizes, begins, masks):
                x.append(x[like[i]])
            continue
        table, begin = _laid([g[i].table for g in groups])
        tables.append(table)
        sizes.append(np.concatenate([g[i].sizes for g in groups]))
        begins.append(begin)
        masks.append(np.array([(1 << g[i].bits) - 1 for g in groups]))
    table = tables[0]
    kinds = sizes[0] | np.where(table < 256, 0, np.where(table < 280, 64, 128)).astype(np.uint8)
    left = [image.total for image in images]
    found: list[list[np.ndarray]] = []
    while open_ := [i for i, n in enumerate(left) if n > 0]:
        parts, froms, ends, byte = [], [], [], 0
        for i in open_:
            bits = images[i].bits
            n = min(_AT_ONCE, bits.size - bits.at)
            if n <= 0:
                raise BadImage("the data end too early")
            skip, length = bits.at & 7, ((bits.at & 7) + n + 160 >> 3) + 4
            parts.append(bits.data[bits.at >> 3 : (bits.at >> 3) + length].ljust(length, b"\0"))
            froms.append(8 * byte + skip)
            ends.append(8 * byte + skip + n)
            byte += length
        raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
        words = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
        window = (words[:, None] >> _EIGHT).ravel().astype(np.int64)  # 25 bits or more from each bit on
        here = np.arange(len(window))
        kind = np.zeros(len(window), np.uint8)  # 0 between the images
        looked = {j: np.zeros(len(window), np.uint8) for j in (1, 2, 3) if like[j] == j and masks[j].any()}
        for i, b, e in zip(open_, froms, ends, strict=True):
            group, start = groups[i], begins[0][i]
            kinds[start : start + len(group[0].table)].take(window[b:e] & (1 << group[0].bits) - 1, out=kind[b:e], mode="clip")
            for j, into in looked.items():
                if group[j].bits:
                    group[j].sizes.take(window[b : e + 64] & (1 << group[j].bits) - 1, out=into[b : e + 64], mode="clip")
        green_bits = kind & 63
        end = here + green_bits
        for j in (1, 2, 3):
            if like[j] in looked:
                end += looked[like[j]].take(end, mode="clip")
        end -= here
        literal = kind - np.uint8(1) < 127  # others are cached colours or lie between the images
        step = green_bits + (end.astype(np.uint8) - green_bits) * literal
        copies = ((kind & 64) > 0).nonzero()[0]
        numbers, begin_of, end_of = np.array(open_), np.array(froms), np.array(ends)
        if len(copies):
            image = numbers[begin_of.searchsorted(copies, "right") - 1]
            at = copies + green_bits[copies]
            at += _extra(table.take(begins[0][image] + (window[copies] & masks[0][image])).astype(np.int64) - 256)
            entry = begins[4][image] + (window[at] & masks[4][image])
            step[copies] = at + sizes[4].take(entry) + _extra(tables[4].take(entry).astype(np.int64)) - copies
        second = here + step
        twice = step.take(second, mode="clip") + step  # the code word at each bit and the next, if that begins here too
        chain, places, stops, taken = twice.tobytes(), array("q"), [], [0]
        add = places.append
        for p, e in zip(froms, ends, strict=True):
            while p < e:
                add(p)
                p += chain[p]
            stops.append(p)
            taken.append(len(places))
        at = np.frombuffer(places, np.int64)
        each = np.repeat(np.arange(len(open_)), 2 * np.diff(taken))
        at = np.stack([at, second[at]], axis=1).ravel()
        inside = at < end_of[each]
        at, each = at[inside], each[inside]
        start, image = at, numbers[each]
        entry = begins[0][image] + (window[at] & masks[0][image])
        symbol = table[entry].astype(np.int64)
        at = at + sizes[0][entry]
        count, distance, colour = np.ones(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.uint32)
        copies = np.flatnonzero((symbol >= 256) & (symbol < 280))
        if len(copies):
            prefix, place, of = symbol[copies] - 256, at[copies], image[copies]
            count[copies] = _values(prefix, window[place])
            place = place + _extra(prefix)
            entry = begins[4][of] + (window[place] & masks[4][of])
            prefix = tables[4][entry].astype(np.int64)
            distance[copies] = _values(prefix, window[place + sizes[4][entry]])
        literals = np.flatnonzero(symbol < 256)
        place, value, of = at[literals], symbol[literals].astype(np.uint32) << np.uint32(8), image[literals]
        for j, shift in zip((1, 2, 3), (16, 0, 24), strict=True):
            entry = begins[j][of] + (window[place] & masks[j][of])
            value |= tables[j][entry].astype(np.uint32) << np.uint32(shift)
            place = place + sizes[j][entry]
        colour[literals] = value
        done = np.cumsum(count)
        firsts = each.searchsorted(np.arange(len(open_) + 1))
        before = done[firsts[:-1]] - count[firsts[:-1]]
        lasts = done.searchsorted(before + np.array([left[i] for i in open_]))
        keep = np.ones(len(at), bool)
        for k, (i, last, stop, until, base) in enumerate(zip(open_, lasts.tolist(), stops, firsts[1:].tolist(), before.tolist(), strict=True)):
            if last < until:  # the image ends with this code word
                if done[last] - base != left[i]:
                    raise BadImage("a back-reference leaves the image")
                if last + 1 < until:
                    stop = int(start[last + 1])
                    keep[last + 1 : until] = False
                left[i] = 0
            else:
                left[i] -= int(done[until - 1]) - base
            bits = images[i].bits
            bits.at += stop - froms[k]
            if bits.at > bits.size:
                raise BadImage("the data end too early")
        found.append([x[keep] for x in (image, symbol, count, distance, colour)])
    out = [np.concatenate(x) for x in zip(*found, strict=True)]
    if len(found) > 1 and len(images) > 1:
        order = out[0].argsort(kind="stable")
        out = [x[order] for x in out]
    return out


def _roots(parent: np.ndarray, of: np.ndarray) -> None:
    """Point each node in `of` at the end of its chain."""
    while len(of):
        now = parent[of]
        ahead = parent[now]
        moved = now != ahead
        parent[of[moved]] = ahead[moved]
        of = of[moved]


@lru_cache(maxsize=32)
def _near_distances(width: int) -> np.ndarray:
    return np.array([0] + [max(1, dx + dy * width) for dx, dy in _NEAR])


def _array_pixels(images: list[_Opened]) -> list[np.ndarray | None]:
    """The pixels of images with one group of codes each; None, nothing read, where a cached colour was never set."""
    began = [image.bits.at for image in images]
    of, symbol, count, distance, colour = _tokens(images)
    totals = np.array([image.total for image in images])
    first = totals.cumsum() - totals
    total = int(totals.sum())
    start = np.cumsum(count) - count
    out = np.zeros(total + 1, np.uint32)
    single = (symbol < 256) | (symbol >= 280)
    out[start[single]] = colour[single]
    parent = np.arange(total + 1, dtype=np.int64)
    copies = np.flatnonzero(~single)
    copied = np.zeros(0, np.int64)
    if len(copies):
        d = distance[copies]
        widths = sorted({image.width for image in images})
        near = np.stack([_near_distances(w) for w in widths])[np.searchsorted(widths, [image.width for image in images])[of[copies]], np.minimum(d, 120)]
        d = np.where(d > 120, d - 120, near)
        if (d > start[copies] - first[of[copies]]).any():
            raise BadImage("a back-reference leaves the image")
        n = count[copies]
        copied = np.repeat(start[copies] - np.cumsum(n) + n, n) + np.arange(n.sum())
        parent[copied] = copied - np.repeat(d, n)
        _roots(parent, copied)
    cached = symbol >= 280
    lost = set()
    if cached.any():
        number = np.repeat(np.arange(len(images)), totals)
        shift = np.array([32 - max(1, image.cache_bits) for image in images], np.uint32)
        slot = ((out[:-1] * np.uint32(_CACHE_FACTOR)) >> np.repeat(shift, totals)).astype(np.uint16)
        places = start[cached]
        slot[places] = symbol[cached] - 280
        slot[copied] = slot[parent[copied]]
        order = np.argsort(slot, kind="stable")  # by slot, then image by image
        before = np.full(total, total)  # the pixel that was last put into the slot
        now, last = order[1:], order[:-1]
        same = (slot[now] == slot[last]) & (number[now] == number[last])
        before[now[same]] = last[same]
        parent[places] = before[places]
        _roots(parent, np.concatenate([places, copied]))
        lost = set(number[places[parent[places] == total]].tolist())
    pixels = out[parent[:total]]
    found: list[np.ndarray | None] = []
    for i, (a, n) in enumerate(zip(first.tolist(), totals.tolist(), strict=True)):
        if i in lost:
            images[i].bits.at = began[i]
        found.append(None if i in lost else pixels[a : a + n])
    return found


def _fixed_pixels(bits: Bits, codes: list[PrefixCode], total: int) -> np.ndarray:
    """Literals only, and every code of one length: places are known ahead, so all symbols are looked up at once."""
    rows = bits.fields(total, sum(c.bits for c in codes[:4]))
    out, at = np.zeros(total, np.uint32), 0
    for code, place in zip(codes[:4], (8, 16, 0, 24), strict=True):
        index = np.packbits(rows[:, at : at + code.bits], axis=1, bitorder="little").astype(np.uint32) if code.bits else np.zeros((total, 1), np.uint32)
        value = index[:, 0] | (index[:, 1] << np.uint32(8) if index.shape[1] > 1 else np.uint32(0))
        out |= code.table.astype(np.uint32)[value] << np.uint32(place)
        at += code.bits
    return out


def _blocks(size: int, bits: int) -> int:
    return -(-size // (1 << bits))


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _half(a: int, b: int) -> int:
    return ((a ^ b) & 0xFEFEFEFE) // 2 + (a & b)


def _each(f, *pixels: int) -> int:
    out = 0
    for s in (0, 8, 16, 24):
        out |= f(*(p >> s & 255 for p in pixels)) << s
    return out


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for s in (0, 8, 16, 24):
        a, b, c = left >> s & 255, top >> s & 255, corner >> s & 255
        to_left += abs(b - c)
        to_top += abs(a - c)
    return left if to_left < to_top else top


def predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The predictor modes; right and corner are the pixels above to the right and above to the left."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _half(_half(left, right), top)
    if mode == 6:
        return _half(left, corner)
    if mode == 7:
        return _half(left, top)
    if mode == 8:
        return _half(corner, top)
    if mode == 9:
        return _half(top, right)
    if mode == 10:
        return _half(_half(left, corner), _half(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _each(lambda a, b, c: _clamp(a + b - c), left, top, corner)
    if mode == 13:
        return _each(lambda a, c: _clamp(a + int((a - c) / 2)), _half(left, top), corner)
    return 0xFF000000


def _undo_predictor(pixels: np.ndarray, width: int, height: int, bits: int, modes: list[int]) -> np.ndarray:
    kinds = {m >> 8 & 15 for m in modes}
    if kinds <= {1} or kinds <= {2}:  # sums along rows or columns
        out = pixels.view(np.uint8).reshape(height, width, 4).copy()
        out[0, 0, 3:] += np.uint8(255)
        if kinds == {1}:
            out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
            return np.cumsum(out, axis=1, dtype=np.uint8).view(np.uint32).ravel()
        out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
        return np.cumsum(out, axis=0, dtype=np.uint8).view(np.uint32).ravel()
    out, across = pixels.tolist(), _blocks(width, bits)
    for y in range(height):
        row = y * width
        for x in range(width):
            i = row + x
            if not y:
                p = out[i - 1] if x else 0xFF000000
            elif not x:
                p = out[i - width]
            else:
                p = predict(modes[(y >> bits) * across + (x >> bits)] >> 8 & 15, out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
            out[i] = _add(out[i], p)
    return np.array(out, np.uint32)


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint8).view(np.int8).astype(np.int32)


def _undo_cross(pixels: np.ndarray, width: int, height: int, bits: int, elements: np.ndarray) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    e = elements[(y >> bits) * _blocks(width, bits) + (x >> bits)]
    green = _signed(pixels >> np.uint32(8) & np.uint32(255))
    red = (pixels >> np.uint32(16) & np.uint32(255)).astype(np.int32) + (_signed(e & np.uint32(255)) * green >> 5) & 255
    blue = (pixels & np.uint32(255)).astype(np.int32) + (_signed(e >> np.uint32(8) & np.uint32(255)) * green >> 5) + (_signed(e >> np.uint32(16) & np.uint32(255)) * _signed(red) >> 5) & 255
    return pixels & np.uint32(0xFF00FF00) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def _undo_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> np.uint32(8) & np.uint32(255)
    both = (pixels & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green)
    return pixels & np.uint32(0xFF00FF00) | both & np.uint32(0x00FF00FF)


def _undo_palette(pixels: np.ndarray, packed: int, width: int, height: int, bits: int, colours: np.ndarray) -> np.ndarray:
    index = (pixels >> np.uint32(8) & np.uint32(255)).reshape(height, packed)
    if bits:
        each = 8 >> bits
        shifts = np.arange(1 << bits, dtype=np.uint32) * np.uint32(each)
        index = (index[:, :, None] >> shifts & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index].ravel()


def _parsed(data: bytes) -> tuple[_Opened, int, bool, list[tuple]]:
    """The main image of a file, its height, whether it is opaque, and the transforms to undo."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadImage("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise BadImage("no lossless image in it")
        at += 8 + struct.unpack_from("<I", data, at + 4)[0]
        at += at & 1
    bits = Bits(data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]])
    if bits.read(8) != 0x2F:
        raise BadImage("the signature is wrong")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    opaque = not bits.read(1)
    if bits.read(3):
        raise BadImage("unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform repeats")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            image = _read_pixels(bits, _blocks(now, size), _blocks(height, size), False)
            undo.append((kind, now, size, image))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, now, 0, None))
        else:
            n = bits.read(8) + 1
            deltas = _read_pixels(bits, n, 1, False).view(np.uint8).reshape(n, 4)
            colours = np.cumsum(deltas, axis=0, dtype=np.uint8).view(np.uint32).ravel()
            size = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, now, size, colours))
            now = _blocks(now, size)
    return _opened(bits, now, height, True), height, opaque, undo


def decode(data: bytes) -> np.ndarray:
    """Pixel array (height, width, 4) of RGBA samples. Raises BadImage where the bytes are no lossless WebP image."""
    return decode_all([data])[0]


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """As `decode`, of several files, whose pixels are read together."""
    out: list[np.ndarray] = []
    parsed = [_parsed(data) for data in files]
    for a, b in _stretches([image.bits.size for image, *_ in parsed], _READ_TOGETHER):
        out += _samples(parsed[a:b])
    return out


def _stretches(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """From and to of stretches of sizes that add up to `most` at most, or of one size."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if held + n > most and i > begin:
            yield begin, i
            begin, held = i, 0
        held += n
    if sizes:
        yield begin, len(sizes)


def _samples(parsed: list[tuple[_Opened, int, bool, list[tuple]]]) -> list[np.ndarray]:
    all_pixels, shapes = [], []
    for pixels, (image, height, opaque, undo) in zip(_pixels_of([p[0] for p in parsed]), parsed, strict=True):
        for kind, w, size, sub in reversed(undo):
            if kind == PREDICTOR:
                pixels = _undo_predictor(pixels, w, height, size, sub.tolist())
            elif kind == CROSS_COLOUR:
                pixels = _undo_cross(pixels, w, height, size, sub)
            elif kind == SUBTRACT_GREEN:
                pixels = _undo_green(pixels)
            else:
                pixels = _undo_palette(pixels, _blocks(w, size), w, height, size, sub)
        all_pixels.append(pixels | np.uint32(0xFF000000) if opaque else pixels)
        shapes.append((height, len(pixels) // height, 4))
    argb = np.concatenate(all_pixels)
    rgba = argb & np.uint32(0xFF00FF00)
    rgba |= argb >> np.uint32(16) & np.uint32(255)
    rgba |= (argb & np.uint32(255)) << np.uint32(16)
    out, at = [], 0
    for shape in shapes:
        n = shape[0] * shape[1]
        out.append(rgba[at : at + n].view(np.uint8).reshape(shape))
        at += n
    return out


class BitWriter:
    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def header(writer: BitWriter, width: int, height: int, alpha: bool = False) -> None:
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3)):
        writer.write(value, n)


def write_lone(writer: BitWriter, symbol: int) -> None:
    """A code of one symbol below 256."""
    for value, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
        writer.write(value, n)


def _write_bytes_code(writer: BitWriter, alphabet: int) -> None:
    """A code that gives each of the symbols 0 to 255 eight bits, and the others none."""
    writer.write(0, 1)
    writer.write(12 - 4, 4)
    of = {16: 1, 8: 2, 18: 2}
    for s in _LENGTH_ORDER[:12]:
        writer.write(of.get(s, 0), 3)
    writer.write(0, 1)
    writer.write(0b01, 2)  # length 8, as its bits are sent: the code 10
    for _ in range(42):
        writer.write(0, 1)
        writer.write(3, 2)  # six more
    writer.write(0, 1)
    writer.write(0, 2)  # three more
    if alphabet > 256:
        writer.write(0b11, 2)
        writer.write(alphabet - 256 - 11, 7)


def wrap(bits: bytes) -> bytes:
    """A WebP file around a bit stream."""
    padded = bits + b"\0" * (len(bits) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(bits)) + padded


def _depths(weights: list[int]) -> list[int]:
    """Depths in a tree of least weight, of two or more leaves that are in order of weight."""
    n, most = len(weights), sum(weights) + 1
    leaves, inner = [*weights, most], [most] * n
    of_leaf, of_inner = [0] * n, [0] * n
    leaf = node = 0
    for new in range(n - 1):
        a, b = leaves[leaf], inner[node]
        if a <= b:
            of_leaf[leaf] = new
            leaf += 1
        else:
            a = b
            of_inner[node] = new
            node += 1
        b, c = leaves[leaf], inner[node]
        if b <= c:
            of_leaf[leaf] = new
            leaf += 1
        else:
            b = c
            of_inner[node] = new
            node += 1
        inner[new] = a + b
    depth = [0] * (n - 1)
    for i in range(n - 3, -1, -1):
        depth[i] = depth[of_inner[i]] + 1
    return [depth[i] + 1 for i in of_leaf]


def _lengths(weights: list[int], most: int) -> list[int]:
    """Lengths, up to `most`, of a prefix code for symbols that occur `weights` times, each more than 0; a lone symbol has length 1."""
    out = [1] * len(weights)
    while len(weights) > 1:
        order = sorted(range(len(weights)), key=weights.__getitem__)
        depths = _depths([weights[i] for i in order])
        if max(depths) <= most:
            for i, n in zip(order, depths, strict=True):
                out[i] = n
            break
        weights = [n // 2 + 1 for n in weights]
    return out


def _words(code: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Code words, as they are sent, of symbols in order; `code` is the number of each one's prefix code, of two or more symbols."""
    order = (code << 4 | lengths).argsort(kind="stable")
    spans = 1 << 15 - lengths[order]
    words = np.empty(len(code), np.uint64)
    words[order] = _reversal(15)[spans.cumsum() - spans & 0x7FFF]  # a code's spans add up to 1 << 15
    return words


#: What is sent of a list of lengths, by number: a length, 3 to 6 repeats, 3 to 10 zeros, 11 to 138 zeros; its symbol, extra bits and their number.
_SENT = np.array([(i, 0, 0) for i in range(16)] + [(s, i, n) for s, n in ((16, 2), (17, 3), (18, 7)) for i in range(1 << n)]).T
_ORDER = np.array(_LENGTH_ORDER)


def _listed(used: np.ndarray, lengths: np.ndarray, first: np.ndarray, alphabets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in `_SENT` of lists of lengths, and the list of each: those of the symbols in `used`, which are not 0; lists begin at `first`, whose last is the end."""
    many, n = len(alphabets), len(used)
    of = np.repeat(np.arange(many), np.diff(first))
    place = np.arange(n) + of  # after each list's symbols comes its end
    end = first[1:] + np.arange(many)
    number = np.repeat(np.arange(many), np.diff(first) + 1)
    symbol, length = np.empty(n + many, np.int64), np.zeros(n + many, np.int64)
    symbol[place], length[place], symbol[end] = used, lengths, alphabets
    gap = np.diff(symbol, prepend=-1) - 1
    gap[end[:-1] + 1] = symbol[end[:-1] + 1]
    again = np.append(False, length[1:] == length[:-1]) & (gap == 0)
    again[end] = False
    stop = again & ~np.append(again[1:], False)  # where runs of one length end
    run = np.zeros(n + many, np.int64)
    at = np.flatnonzero(stop)
    run[at] = np.diff(np.append(0, again.cumsum()[at]))
    longest, zeros, most, rest = gap // 138, gap % 138, run // 6, run % 6
    once = ~again
    once[end] = False
    what = np.stack([np.full(n + many, 155), np.where(zeros < 3, 0, 17 + zeros), length, np.full(n + many, 19), np.where(rest < 3, length, 13 + rest)], axis=1)
    times = np.stack([longest, np.where(zeros < 3, zeros, 1), once, most, np.where(rest < 3, rest, 1)], axis=1)
    return np.repeat(what.ravel(), times.ravel()), np.repeat(number, times.sum(axis=1))


def _sent_codes(codes: list[tuple[list[int], list[int], int]]) -> list[tuple[int, int]]:
    """Codes as they are sent, as numbers and their bits, each of the symbols in use, their lengths and the size of the alphabet."""
    out: list[tuple[int, int] | None] = [None] * len(codes)
    listed = []
    for i, (used, _, _) in enumerate(codes):
        if len(used) > 2 or used and used[-1] > 255:
            listed.append(i)
        elif len(used) == 2:
            out[i] = 0b111 | used[0] << 3 | used[1] << 11, 19
        else:
            out[i] = 0b101 | (used[0] if used else 0) << 3, 11
    if not listed:
        return out
    many = len(listed)
    first = np.array([0, *accumulate(len(codes[i][0]) for i in listed)])
    used, lengths = (np.array([x for i in listed for x in codes[i][k]], np.int64) for k in (0, 1))
    sent, of = _listed(used, lengths, first, np.array([codes[i][2] for i in listed]))
    symbol, extra, extra_bits = _SENT[:, sent]
    entry = of * 19 + symbol
    few = np.zeros(19 * many, np.int64)
    counts = np.bincount(entry, minlength=19 * many)
    some = counts.nonzero()[0]
    owner = some // 19
    bounds, weights = owner.searchsorted(np.arange(many + 1)).tolist(), counts[some].tolist()
    few[some] = [n for a, b in zip(bounds, bounds[1:]) for n in _lengths(weights[a:b], 7)]
    words, sizes = np.zeros(19 * many, np.uint64), np.zeros(19 * many, np.int64)
    coded = np.diff(bounds)[owner] > 1  # a lone symbol takes no bits
    words[some[coded]], sizes[some[coded]] = _words(owner[coded], few[some[coded]]), few[some[coded]]
    size = sizes[entry]
    bodies = _joined(words[entry] | extra.astype(np.uint64) << size.astype(np.uint64), size + extra_bits, of, many)
    ordered = few.reshape(many, 19)[:, _ORDER]
    count = np.maximum(4, 19 - (ordered[:, ::-1] > 0).argmax(axis=1))
    heads = (count - 4 << 1) + (ordered << 5 + 3 * np.arange(19)).sum(axis=1)
    for i, head, n, (body, m) in zip(listed, heads.tolist(), (6 + 3 * count).tolist(), bodies, strict=True):
        out[i] = head | body << n, n + m
    return out


def _level(lengths: np.ndarray) -> np.ndarray:
    """Lengths of a code of one length for the symbols in use and as many beside them, in the narrowest gaps first, as make it complete."""
    on = lengths > 0
    bits = int(on.sum() - 1).bit_length()
    while left := (1 << bits) - int(on.sum()):
        used = on.nonzero()[0]
        gaps = np.diff(used) - 1
        if gaps.any():
            i = int(np.where(gaps > 0, gaps, len(on)).argmin())
            on[used[i] + 1 : used[i] + 1 + min(int(gaps[i]), left)] = True
        else:
            on[used[-1] + 1 : used[-1] + 1 + left] = True
            left = (1 << bits) - int(on.sum())
            on[used[0] - left : used[0]] = True
    return np.where(on, bits, 0)


#: Bits a symbol in use that a list of equal lengths is expected to save at most.
_MOST_SAVED = 4


class _Made(NamedTuple):
    """A prefix code as it is sent, its bits, the symbols in it and their lengths."""

    sent: int
    size: int
    used: list[int]
    lengths: list[int]


def _made(counts: list[tuple[np.ndarray, int]]) -> list[_Made]:
    """Codes, each of which is written so many times, for counts of symbols: fitted to them or level, whichever takes fewer bits in all."""
    plans, tried = [], []
    for i, (c, times) in enumerate(counts):
        among = c.nonzero()[0]
        used, weights = among.tolist(), c[among].tolist()
        lengths = _lengths(weights, 15)
        plans.append((used, lengths, len(c)))
        if len(used) > 2:
            more = (len(used) - 1).bit_length() * sum(weights) - sum(map(mul, weights, lengths))
            if more < times * _MOST_SAVED * len(used):
                level = _level(c)
                among = level.nonzero()[0]
                tried.append((i, more, (among.tolist(), level[among].tolist(), len(c))))
    sent = _sent_codes(plans + [level for *_, level in tried])
    made = [_Made(*s, *plan[:2]) for s, plan in zip(sent[: len(plans)], plans, strict=True)]
    for (i, more, level), s in zip(tried, sent[len(plans) :], strict=True):
        if more < counts[i][1] * (made[i].size - s[1]):
            made[i] = _Made(*s, *level[:2])
    return made


def _made_code(counts: np.ndarray, times: int = 1) -> tuple[BitWriter, np.ndarray]:
    """As `_made`, of one code: as it is sent, and all lengths."""
    made, lengths, writer = _made([(counts, times)])[0], np.zeros(len(counts), np.int64), BitWriter()
    writer.write(made.sent, made.size)
    lengths[made.used] = made.lengths
    return writer, lengths


def _write_code(writer: BitWriter, lengths: np.ndarray) -> None:
    used = lengths.nonzero()[0]
    writer.write(*_sent_codes([(used.tolist(), lengths[used].tolist(), len(lengths))])[0])


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefixes, extra bits and their number, of lengths or distances."""
    u = values - 1
    extra = np.maximum(np.frexp(np.maximum(u, 1).astype(float))[1] - 2, 0)
    return np.where(u < 4, u, 2 * extra + 2 + (u >> extra & 1)), np.where(u < 4, 0, u & (1 << extra) - 1), np.where(u < 4, 0, extra)


_LEAST_COPY, _MOST_COPY, _FARTHEST = 4, 4096, (1 << 20) - 120


_PLACE = np.uint64((1 << 20) - 1)  # an image has at most 64 x 16384 pixels


def _copies(pixels: np.ndarray, first: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Starts, lengths and distances of back-references, by the last earlier place of the next four pixels, in order; images begin at `first`, whose last is the end."""
    total = len(pixels)
    if total <= _LEAST_COPY:
        return [], [], []
    m = total - _LEAST_COPY + 1
    pairs = pixels[:-1].astype(np.uint64) << np.uint64(32) | pixels[1:]
    ahead, second = pairs[:m], pairs[2:]
    key = (ahead ^ ahead >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) ^ second
    key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) & ~_PLACE
    distance = np.zeros(m, np.int64)
    spans = [(a, b - _LEAST_COPY + 1) for a, b in zip(first, first[1:]) if b - a > _LEAST_COPY]
    begin, inside, up = np.zeros(m, np.int64), np.zeros(m, bool), np.arange(m, dtype=np.uint64)
    for a, b in spans:
        own = key[a:b]
        own |= up[: b - a]
        own.sort()  # by hash, then by place
        begin[a:b] = a
        inside[a + 1 : b] = True  # the first of an image has none before
    if not spans:
        return [], [], []
    same = np.flatnonzero(inside)
    same = same[(key[same] ^ key[same - 1]) <= _PLACE]
    now, before = ((key[i] & _PLACE).astype(np.int64) + begin[same] for i in (same, same - 1))
    ok = (ahead[now] == ahead[before]) & (second[now] == second[before])
    now, before = now[ok], before[ok]
    distance[now] = np.where(now - before <= _FARTHEST, now - before, 0)
    places = np.flatnonzero(distance)
    if not len(places):
        return [], [], []
    ends = np.flatnonzero(np.append(distance[1:] != distance[:-1], True))  # of runs of one distance; between images it is 0
    length = ends[np.searchsorted(ends, places)] - places + _LEAST_COPY
    at, reach, far = places.tolist(), length.tolist(), distance[places].tolist()
    starts, lengths, distances, done, i = [], [], [], 0, 0
    while i < len(at):
        if at[i] < done:
            i = bisect_left(at, done, i)
            continue
        n = min(reach[i], _MOST_COPY)
        starts.append(at[i])
        lengths.append(n)
        distances.append(far[i])
        done = at[i] + n
        i += 1
    return starts, lengths, distances


@lru_cache(maxsize=8)
def _distance_codes(width: int) -> dict[int, int]:
    codes: dict[int, int] = {}
    for i, d in enumerate(_near_distances(width)[1:].tolist(), 1):
        codes.setdefault(d, i)
    return codes


def _costs(counts: np.ndarray, owner: np.ndarray, n: int, codes: int = 1) -> np.ndarray:
    """For each of n owners of counts: bits of symbols under a code made for them, and of the code; or of as many codes of the same number of symbols.

    Sums of whole numbers (1024ths of bits), which don't depend on what is counted beside them.
    """
    used = counts.nonzero()[0]
    v, of = counts[used].astype(float), owner[used]
    own = np.bincount(of, np.rint(v * np.log2(v) * 1024), n)
    each = np.bincount(of, v, n) / codes
    whole = np.rint(codes * each * np.log2(np.maximum(each, 1)) * 1024)
    return (whole - own) / 1024 + 4 * np.bincount(of, minlength=n) + 20 * codes


def _write_images(writers: list[BitWriter], parts: list[np.ndarray], widths: list[int], main: bool) -> None:
    """An entropy-coded image of ARGB values into each writer; what can be counted and looked up for all at once is."""
    many, sizes = len(parts), [len(p) for p in parts]
    numbers, pixels = np.arange(many), np.concatenate(parts)
    total, first = len(pixels), [0, *accumulate(sizes)]
    image = np.repeat(numbers, sizes)
    starts, lengths, distances = _copies(pixels, first) if main else ([], [], [])
    literal = np.ones(total, bool)
    n, at = np.array(lengths, np.int64), np.array(starts, np.int64)
    if len(at):
        literal[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())] = False
    owner = image[at]
    codes = [_distance_codes(w) for w in widths]
    far_codes = [codes[i].get(d, d + 120) for i, d in zip(owner.tolist(), distances, strict=True)]
    (length_prefix, far_prefix), (length_extra, far_extra), (length_bits, far_bits) = (x.reshape(2, -1) for x in _prefixes(np.array([*lengths, *far_codes], np.int64)))
    samples = pixels.view(np.uint8).reshape(-1, 4)
    blue, green, red, alpha = (samples[:, i].astype(np.int64) for i in range(4))
    literals = literal.nonzero()[0]
    of_literals = image[literals]
    copied = np.bincount(owner * 24 + length_prefix, minlength=24 * many)

    def counted(symbol: np.ndarray, plain: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the green code, whose symbols begin for each image at a place of its own, and of the one for red and blue, which is made and read once."""
        greens = np.bincount(begins[of_literals] + symbol, minlength=begins[-1])
        greens[(begins[:-1, None] + np.arange(256, 280)).ravel()] = copied
        base = image[plain] * 256
        return greens, np.bincount(np.concatenate([base + red[plain], base + blue[plain]]), minlength=256 * many)

    def bits_of(counts: tuple[np.ndarray, np.ndarray], begins: np.ndarray) -> np.ndarray:
        colour_owner = np.repeat(numbers, 256)
        again = np.bincount(colour_owner[counts[1] > 0], minlength=many)
        return _costs(counts[0], np.repeat(numbers, np.diff(begins)), many) + _costs(counts[1], colour_owner, many) + 4 * again

    cache_bits = [0] * many
    symbol, plain = green[literals], literals
    begins = np.arange(many + 1) * 280
    counts = counted(symbol, plain, begins)
    greens, colours = list(counts[0].reshape(many, 280)), counts[1].reshape(many, 256)
    if main:
        wide = np.array([min(11, max(1, size.bit_length() - 2)) for size in sizes])
        slot = ((pixels * np.uint32(_CACHE_FACTOR)) >> np.repeat((32 - wide).astype(np.uint32), sizes)).astype(np.uint16)
        order = slot.argsort(kind="stable")
        now, before = order[1:], order[:-1]
        hit = np.zeros(total, bool)
        hit[now] = (pixels[now] == pixels[before]) & (image[now] == image[before])  # of equal colours, equal slots
        hit = hit[literals]
        if hit.any():
            cached = np.append(0, (280 + (1 << wide)).cumsum())
            other_symbol, other_plain = np.where(hit, slot[literals] + np.int64(280), symbol), literals[~hit]
            other = counted(other_symbol, other_plain, cached)
            better = bits_of(other, cached) < bits_of(counts, begins)
            if better.any():
                other_colours = other[1].reshape(many, 256)
                for i in better.nonzero()[0].tolist():
                    cache_bits[i], greens[i] = int(wide[i]), other[0][cached[i] : cached[i + 1]]
                colours = np.where(better[:, None], other_colours, colours)
                taken = better[of_literals]
                symbol, plain = np.where(taken, other_symbol, symbol), literals[~(hit & taken)]
    alike = np.logical_and.reduceat(alpha == np.repeat(alpha[first[:-1]], sizes), first[:-1]).tolist()
    alphas = None if all(alike) else np.bincount(image[plain] * 256 + alpha[plain], minlength=256 * many).reshape(many, 256)
    fars = np.bincount(owner * 40 + far_prefix, minlength=40 * many).reshape(many, 40)
    wanted = [(c, times) for i in range(many) for c, times in ((greens[i], 1), (colours[i], 2), (None if alike[i] else alphas[i], 1), (fars[i], 1))]
    codes_made = iter(_made([x for x in wanted if x[0] is not None]))
    places, of_code, sizes_of = [], [], []
    bases, base = [[], [], [], []], 0
    for k, (c, times) in enumerate(wanted):
        i, k = divmod(k, 4)
        writer = writers[i]
        if not k:
            writer.write(1 | cache_bits[i] << 1 if cache_bits[i] else 0, 5 if cache_bits[i] else 1)
            if main:
                writer.write(0, 1)  # one group of codes
        bases[k].append(base)
        if c is None:  # one symbol, which takes no bits
            write_lone(writer, int(alpha[first[i]]))
            base += 256
            continue
        made = next(codes_made)
        for _ in range(times):
            writer.write(made.sent, made.size)
        if len(made.used) > 1:  # a lone symbol takes no bits
            places.append(np.array(made.used) + base)
            of_code.append(len(made.used))
            sizes_of += made.lengths
        base += len(c)
    words_at, sizes_at = np.zeros(base, np.uint64), np.zeros(base, np.int64)
    if places:
        where, lengths_of = np.concatenate(places), np.array(sizes_of)
        words_at[where], sizes_at[where] = _words(np.repeat(np.arange(len(of_code)), of_code), lengths_of), lengths_of
    green_at, colour_at, alpha_at, far_at = (np.array(b) for b in bases)
    value, size = np.zeros(total, np.uint64), np.zeros(total, np.int64)
    entry = green_at[of_literals] + symbol
    value[literals], size[literals] = words_at[entry], sizes_at[entry]
    words, long = value[plain], size[plain]
    for channel, at_base in ((red, colour_at), (blue, colour_at), *([] if alphas is None else [(alpha, alpha_at)])):
        entry = at_base[image[plain]] + channel[plain]
        words |= words_at[entry] << long.astype(np.uint64)
        long += sizes_at[entry]
    value[plain], size[plain] = words, long
    if len(at):
        entry, far_entry = green_at[owner] + 256 + length_prefix, far_at[owner] + far_prefix
        words, long = words_at[entry], sizes_at[entry]
        for v, k in ((length_extra, length_bits), (words_at[far_entry], sizes_at[far_entry]), (far_extra, far_bits)):
            words = words | v.astype(np.uint64) << long.astype(np.uint64)
            long = long + k
        value[at], size[at] = words, long
        literal[at] = True
        value, size, image = value[literal], size[literal], image[literal]
    for writer, joined in zip(writers, _joined(value, size, image, many), strict=True):
        writer.write(*joined)


def _joined(value: np.ndarray, size: np.ndarray, image: np.ndarray, many: int) -> list[tuple[int, int]]:
    """For each image, its values of `size` bits (each up to 64, at least one value) one after the other, as a number, and its bits."""
    ends = size.cumsum()
    firsts = image.searchsorted(np.arange(many + 1))
    until = ends[firsts[1:] - 1]
    before = np.append(0, until[:-1])
    words_of = (until - before >> 6) + 2
    begin = words_of.cumsum() - words_of  # each image in words of its own
    starts = ends - size + (64 * begin - before)[image]
    word, shift = starts >> 6, (starts & 63).astype(np.uint64)
    first = np.append(0, (word[1:] != word[:-1]).nonzero()[0] + 1)
    out = np.zeros(int(words_of.sum()), np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(value << shift, first)
    last = np.append(first[1:], len(value)) - 1  # only the last that begins in a word reaches into the next
    out[word[last] + 1] |= value[last] >> np.uint64(1) >> np.uint64(63) - shift[last]
    whole = out.tobytes()
    return [(int.from_bytes(whole[8 * b : 8 * (b + n)], "little"), bits) for b, n, bits in zip(begin.tolist(), words_of.tolist(), (until - before).tolist(), strict=True)]


_SAMPLES = np.arange(256)
_OFFSETS = np.arange(0, 768, 256, dtype=np.uint16)


def _by_channel(rgb: np.ndarray) -> np.ndarray:
    """How often each sample occurs, first for red, then green, then blue."""
    return np.bincount((rgb.reshape(-1, 3) + _OFFSETS).ravel(), minlength=768)


def _channel_costs(images: list[np.ndarray]) -> list[float]:
    return _costs(np.concatenate([_by_channel(x) for x in images]), np.repeat(np.arange(len(images)), 768), len(images), 3).tolist()


def _predicted(rgb: np.ndarray, mode: int) -> np.ndarray:
    """What is left of an image under one predictor, from the left (1) or from above (2)."""
    out = rgb.copy()
    if mode == 1:
        out[:, 1:] -= rgb[:, :-1]
        out[1:, 0] -= rgb[:-1, 0]
    else:
        out[1:] -= rgb[:-1]
        out[0, 1:] -= rgb[0, :-1]
    return out


def _argb(rgb: np.ndarray, alpha: int) -> np.ndarray:
    out = np.empty((rgb.size // 3, 4), np.uint8)
    out[:, :3], out[:, 3] = rgb.reshape(-1, 3)[:, ::-1], alpha
    return out.view("<u4").ravel()


#: The most colours that get a palette, and the bits a sample from which on transforms are tried, since codes alone take less for prose.
_FEW, _POORLY = 16, 5.2
#: Pixels from which on prose is stored in less than 0.7 of its payload, as the tests hold; the encoder does not look at it.
_LEAST_PIXELS = 1536
#: Samples of images that are worked on together; a larger image is on its own.
_STORED_TOGETHER = 1 << 18
#: Bytes of texts that are stored and read back at a time; a longer text is on its own.
_AT_A_TIME = 1 << 20


def encode(pixels: np.ndarray) -> bytes:
    """An opaque RGB image (height, width, 3) of 8-bit samples as lossless WebP, with the transform, cache, back-references and
    prefix codes that seem to take the fewest bits; literals of eight bits where codes would take more."""
    return encode_all([pixels])[0]


def encode_all(images: list[np.ndarray]) -> list[bytes]:
    """As `encode`, of several images, which are worked on together; none has a part in another's stored form."""
    out: list[bytes] = []
    for a, b in _stretches([x.size for x in images], _STORED_TOGETHER):
        out += _encoded(images[a:b])
    return out


def _encoded(images: list[np.ndarray]) -> list[bytes]:
    files: list[bytes | None] = [None] * len(images)
    writers, parts, widths = [], [], []
    for i, (pixels, plain) in enumerate(zip(images, _channel_costs(images), strict=True)):
        w = BitWriter()
        header(w, pixels.shape[1], pixels.shape[0])
        now = _transformed(w, pixels, plain)
        if now is None:
            files[i] = _with_bytes(pixels)
            continue
        w.write(0, 1)
        writers.append(w)
        parts.append(now[0])
        widths.append(now[1])
    if writers:
        _write_images(writers, parts, widths, True)
    done = iter(writers)
    for i, file in enumerate(files):
        if file is None:
            w = next(done)
            files[i] = wrap(w.value.to_bytes(-(-w.size // 8), "little"))
    return files


def _transformed(w: BitWriter, pixels: np.ndarray, plain: float) -> tuple[np.ndarray, int] | None:
    """ARGB values of an image and their width after the transform that is written, if any; None where literals of eight bits take less."""
    height, width, _ = pixels.shape
    whole = _argb(pixels, 255)
    few = len(set(whole[: 4 * _FEW].tolist())) <= _FEW and len(np.unique(whole[:1024])) <= _FEW  # no more, if so many places have no more
    colours = np.unique(whole) if few else whole
    if few and len(colours) <= _FEW:
        for value, n in ((1, 1), (PALETTE, 2), (len(colours) - 1, 8)):
            w.write(value, n)
        deltas = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
        _write_images([w], [np.ascontiguousarray(deltas).view(np.uint32).ravel()], [len(colours)], False)
        bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        index = np.searchsorted(colours, whole).reshape(height, width)
        packed = np.zeros((height, _blocks(width, bits)), np.int64)
        for k in range(1 << bits):
            part = index[:, k :: 1 << bits]
            packed[:, : part.shape[1]] |= part << k * (8 >> bits)
        return packed.ravel().astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), packed.shape[1]
    if plain <= _POORLY * pixels.size:
        return whole, width
    green = pixels.copy()
    green[:, :, [0, 2]] -= pixels[:, :, 1:2]
    choices = {SUBTRACT_GREEN: green, (PREDICTOR, 1): _predicted(pixels, 1), (PREDICTOR, 2): _predicted(pixels, 2)}
    costs = {None: plain} | dict(zip(choices, _channel_costs(list(choices.values())), strict=True))
    chosen = min(costs, key=costs.get)
    if costs[chosen] >= 8 * pixels.size:
        return None
    if chosen is None:
        return whole, width
    if chosen == SUBTRACT_GREEN:
        w.write(1 | SUBTRACT_GREEN << 1, 3)
        return _argb(green, 255), width
    w.write(1 | PREDICTOR << 1 | (9 - 2 << 3 & 56), 6)
    blocks = _blocks(width, 9) * _blocks(height, 9)
    _write_images([w], [np.full(blocks, chosen[1] << 8 | 0xFF000000, np.uint32)], [_blocks(width, 9)], False)
    return _argb(choices[chosen], 0), width  # of alpha nothing is left: the first pixel's predictor is opaque, the others have its like


_REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1).ravel()


@lru_cache(maxsize=1024)
def _prologue(width: int, height: int) -> tuple[int, int]:
    w = BitWriter()
    header(w, width, height)
    w.write(0, 1)  # no transform
    w.write(0, 1)  # no colour cache
    w.write(0, 1)  # one group of codes
    for alphabet in (280, 256, 256):
        _write_bytes_code(w, alphabet)
    write_lone(w, 255)
    write_lone(w, 0)
    return w.value, w.size


def _with_bytes(pixels: np.ndarray) -> bytes:
    """Literals under prefix codes of eight bits each."""
    height, width, _ = pixels.shape
    value, size = _prologue(width, height)
    samples = _REVERSED[pixels.reshape(-1, 3)[:, [1, 0, 2]].ravel()]
    head = np.unpackbits(np.frombuffer(value.to_bytes(-(-size // 8), "little"), np.uint8), bitorder="little")[:size]
    body = np.unpackbits(samples, bitorder="little")
    return wrap(np.packbits(np.concatenate([head, body]), bitorder="little").tobytes())


ROW = 192
_HIGHEST = 16384


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW if text else ROW)


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of 192 bytes as images of 64 columns and at most 16384 rows, one file after the other."""
    return store_all([payload])[0]


def store_all(payloads: list[bytes]) -> list[bytes]:
    """As `store`, of several payloads, whose images are worked on together."""
    step = ROW * _HIGHEST
    counts = [-(-len(p) // step) for p in payloads]
    files = iter(encode_all([np.frombuffer(p[i : i + step], np.uint8).reshape(-1, 64, 3) for p in payloads for i in range(0, len(p), step)]))
    return [b"".join([next(files) for _ in range(n)]) for n in counts]


def read_back(media: bytes) -> np.ndarray:
    """The pixel array of all images in `media`, one below the other."""
    return read_all([media])[0]


def read_all(stored: list[bytes]) -> list[np.ndarray]:
    """As `read_back`, of several media, whose images are read together."""
    files, counts = [], []
    for media in stored:
        at, before = 0, len(files)
        while at < len(media):
            size = 8 + struct.unpack_from("<I", media, at + 4)[0]
            files.append(media[at : at + size])
            at += size
        counts.append(len(files) - before)
    parts = iter(decode_all(files))
    return [next(parts) if n == 1 else np.concatenate([next(parts) for _ in range(n)]) for n in counts]


def features(pixels: np.ndarray) -> str:
    """Size, mean and deviation of each colour, and a 64-bit average hash, of a pixel array."""
    height, width, _ = pixels.shape
    rgb = pixels[:, :, :3].reshape(-1, 3)
    grey = rgb.astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)
    cells = np.minimum(np.arange(height) * 8 // height, 7)[:, None] * 8 + np.minimum(np.arange(width) * 8 // width, 7)[None, :]
    counts = np.bincount(cells.ravel(), minlength=64)
    means = np.bincount(cells.ravel(), grey, 64) / np.maximum(counts, 1)
    hashed = int.from_bytes(np.packbits(means > means.mean()).tobytes(), "big")
    n, each = len(rgb), _by_channel(rgb).reshape(3, 256)
    sums, squares = (each @ _SAMPLES).tolist(), (each @ _SAMPLES**2).tolist()
    means_of, deviations = [a / n for a in sums], [math.sqrt(n * b - a * a) / n for a, b in zip(sums, squares, strict=True)]
    return f"{width}x{height} mean {' '.join(f'{v:.2f}' for v in means_of)} std {' '.join(f'{v:.2f}' for v in deviations)} hash {hashed:016x}"


def decode_images(df: DataFrame, columns: list[str], image_col: str = "image") -> DataFrame:
    """`columns` of `df` and `width, height, pixels, error`: pixels are RGBA samples, row after row (binary).

    A null, empty or damaged image has null size and pixels, and says why in `error`. Columns of these names are replaced.
    """
    limit_batches(df.sparkSession, 64)
    added = ["width", "height", "pixels", "error"]
    own = unused_name(columns, "__image")
    kept = df.select(*[c for c in columns if c not in added], F.col(image_col).cast("binary").alias(own))
    schema = kept.drop(own).schema.add("width", "integer").add("height", "integer").add("pixels", "binary").add("error", "string")

    def some(files: list[bytes]) -> list[tuple]:
        try:
            return [(p.shape[1], p.shape[0], p.tobytes(), None) for p in decode_all(files)]
        except (BadImage, IndexError, struct.error) as e:
            if len(files) == 1:
                return [(None, None, None, str(e) or "damaged")]
        half = len(files) // 2  # one is damaged
        return some(files[:half]) + some(files[half:])

    def run(batches: Batches) -> Batches:
        for b in batches:
            files = [x or b"" for x in b.column(b.num_columns - 1).to_pylist()]
            made = [row for i, j in _stretches([len(x) for x in files], _AT_A_TIME) for row in some(files[i:j])]
            yield pa.record_batch([*b.columns[:-1], *[pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]], schema.names)

    return kept.mapInArrow(run, schema)


def media_rows(docs: DataFrame) -> DataFrame:
    """Every text stored as an image, read back from the stored bytes: sizes, digests and features of (doc_id, text); null is empty. No shuffle."""
    limit_batches(docs.sparkSession)
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    kept = docs.select("doc_id", F.col("text").alias("__text"))
    schema = kept.drop("__text").schema
    for name, kind in fields:
        schema.add(name, "string" if kind == pa.string() else "long")

    def some(texts: list[bytes]) -> Iterator[tuple]:
        media = store_all([payload_of(t) for t in texts])
        for text, stored, pixels in zip(texts, media, read_all(media), strict=True):
            read = np.ascontiguousarray(pixels[:, :, :3]).tobytes()
            yield len(text), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(pixels)

    def run(batches: Batches) -> Batches:
        for b in batches:
            texts = column_bytes(b.column(1))
            made = [row for i, j in _stretches([len(t) + ROW for t in texts], _AT_A_TIME) for row in some(texts[i:j])]
            yield pa.record_batch([b.column(0), *[pa.array([m[i] for m in made], kind) for i, (_, kind) in enumerate(fields)]], schema.names)

    return kept.mapInArrow(run, schema)
