"""Progressive JPEG: a decoder for any Huffman-coded 8-bit file, and a lossless store of bytes as coefficients.

The decoder accumulates the scans of a progressive file, by spectral selection and successive
approximation, into arrays of coefficients. For a scan's first approximation the steps from
every bit are looked up at once and followed from code to code; numpy then reads all symbols,
runs and values together. A refinement is read symbol by symbol, as the bits behind a symbol
depend on what is known, but all corrections and new coefficients are set together. What is
left (restarts, sequential files) is decoded coefficient by coefficient.

The store codes a text's bytes by Huffman tables made for that text, as any optimising encoder.

Small files are coded, decoded and transformed many at a time, with the same results as one by one.
"""

from __future__ import annotations

import math
import re
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np

#: Bytes that one 8x8 block stores, one in each coefficient.
UNIT = 64


def _zigzag() -> np.ndarray:
    """Position in a row-major block of each coefficient in zigzag order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
#: Blocks that are transformed and coloured at a time.
BAND_BLOCKS = 4096
#: Fixed-point bits of the inverse transform. Sums stay below 2**53, so they are exact in any order.
SCALE = 20


def _inverse_basis() -> np.ndarray:
    """Row: coefficient in zigzag order; column: sample, row-major; scaled to integers."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    cosine = np.where(k == 0, math.sqrt(0.5), 1.0) / 2 * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.rint(np.kron(cosine, cosine)[ZIGZAG] * (1 << SCALE))


BASIS = _inverse_basis()


def _transformed(values: np.ndarray) -> np.ndarray:
    """values @ BASIS, 64 rows at a time: products this small are left to one thread, which a task has."""
    whole = len(values) // 64 * 64
    out = np.empty(values.shape)
    np.matmul(values[:whole].reshape(-1, 64, 64).astype(float), BASIS, out=out[:whole].reshape(-1, 64, 64))
    out[whole:] = values[whole:] @ BASIS
    return out


def _samples(values: np.ndarray) -> np.ndarray:
    """Samples (uint8), row-major, of blocks of quantised coefficients."""
    samples = _transformed(values)
    samples += (1 << (SCALE - 1)) + (128 << SCALE)
    samples *= 1.0 / (1 << SCALE)
    return np.clip(np.floor(samples, out=samples), 0, 255, out=samples).astype(np.uint8)


def _colour(planes: list[np.ndarray], out: np.ndarray) -> None:
    """Fill an array of RGB with samples of its size: grey, or luma and two of chroma."""
    if len(planes) == 1:
        out[:] = planes[0][..., None]
        return
    half = 1 << 15
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out[..., 0] = np.clip((y + 91881 * cr + half) >> 16, 0, 255)
    out[..., 1] = np.clip((y - 22554 * cb - 46802 * cr + half) >> 16, 0, 255)
    out[..., 2] = np.clip((y + 116130 * cb + half) >> 16, 0, 255)


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks in a row, padded to whole MCUs
    high: int = 0
    own_wide: int = 0  # blocks in a row that scans of this component alone hold
    own_high: int = 0
    base: int = 0  # its first block among those of files decoded together
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))


@dataclass
class Frame:
    height: int
    width: int
    components: list[Component]
    quantisers: dict[int, np.ndarray]
    comments: list[bytes]

    def sampling(self) -> tuple[int, int]:
        """Blocks of an MCU, across and down, of the component that has most."""
        top_h, top_v = max(c.h for c in self.components), max(c.v for c in self.components)
        if any(top_h % c.h or top_v % c.v for c in self.components):
            raise ValueError("fractional sampling factors are not supported")
        return top_h, top_v

    def planes(self) -> list[np.ndarray]:
        """Samples (uint8) of each component at its own resolution, by the inverse transform in numpy, in bands of block rows."""
        out = []
        for c in self.components:
            plane = np.empty((c.high, 8, c.wide, 8), np.uint8)
            step = max(1, BAND_BLOCKS // c.wide)
            for at in range(0, c.high, step):
                values = c.blocks[at * c.wide : (at + step) * c.wide] * self.quantisers[c.table]
                plane[at : at + step] = _samples(values).reshape(-1, c.wide, 8, 8).swapaxes(1, 2)
            out.append(plane.reshape(c.high * 8, c.wide * 8))
        return out

    def rgb(self) -> np.ndarray:
        """Full-resolution RGB, uint8 of shape (height, width, 3); chroma is upsampled by repetition, band by band."""
        top_h, top_v = self.sampling()
        planes = self.planes()
        out = np.empty((self.height, self.width, 3), np.uint8)
        step = max(1, BAND_BLOCKS * 64 // (self.width * top_v)) * top_v
        for at in range(0, self.height, step):
            n = min(step, self.height - at)
            full = []
            for c, plane in zip(self.components, planes):
                down, across = top_v // c.v, top_h // c.h
                part = plane[at // down : -(-(at + n) // down)]
                big = part.repeat(down, axis=0).repeat(across, axis=1) if (down, across) != (1, 1) else part
                full.append(big[:n, : self.width])
            _colour(full, out[at : at + n])
        return out


def features(rgb: np.ndarray) -> list[float]:
    """Mean and deviation of each channel, and the mean steps of green across and down: eight numbers that describe a tensor."""
    counts, steps, step = np.zeros((3, 256), np.int64), [0, 0], max(1, BAND_BLOCKS * 64 // rgb.shape[1])
    for at in range(0, len(rgb), step):
        band = rgb[at : at + step]
        for c in range(3):
            counts[c] += np.bincount(band[:, :, c].ravel(), minlength=256)
        green = rgb[at : at + step + 1, :, 1].astype(np.int16)
        steps[0] += int(np.abs(np.diff(green[: len(band)], axis=1)).sum())
        steps[1] += int(np.abs(np.diff(green, axis=0)).sum())
    n, levels = rgb.shape[0] * rgb.shape[1], np.arange(256)
    mean = counts @ levels / n
    deviation = np.sqrt(np.maximum(counts @ levels**2 / n - mean**2, 0))
    return [*np.column_stack([mean, deviation]).ravel().tolist(), steps[0] / n, steps[1] / n]


#: A step that no code with its value takes.
NO_CODE = 255
_EIGHT = np.arange(8)


@lru_cache(maxsize=64)
class Table:
    """A Huffman table. Files often share theirs, so tables are kept by content."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols = counts, symbols

    @cached_property
    def width(self) -> int:
        """Bits of the longest code."""
        return max((k + 1 for k in range(16) if self.counts[k]), default=1)

    @cached_property
    def found(self) -> np.ndarray:
        """For each `width` bits that may come next: length of the code << 8 | symbol, or 0."""
        bits = np.repeat(np.arange(1, 17), np.frombuffer(self.counts, np.uint8))
        entries = np.repeat(bits << 8 | np.frombuffer(self.symbols, np.uint8), 1 << (self.width - bits))
        found = np.zeros(1 << self.width, np.int32)
        found[: len(entries)] = entries
        return found

    @cached_property
    def look(self) -> list[int]:
        return self.found.tolist()

    @cached_property
    def dc_steps(self) -> np.ndarray:
        return _dc_steps(self.found)

    @cached_property
    def ac_steps(self) -> np.ndarray:
        return _ac_steps(self.found)


def _steps(found: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return np.where(found > 0, np.minimum((found >> 8) + extra, NO_CODE), NO_CODE).astype(np.uint8)


def _dc_steps(found: np.ndarray) -> np.ndarray:
    """Bits of the code and of the value behind it; NO_CODE where there is none."""
    return _steps(found, found & 255)


def _ac_steps(found: np.ndarray) -> np.ndarray:
    """The same for ACs: the bits behind a code are a value's, or those of the length of a run of ended blocks."""
    run, size = found >> 4 & 15, found & 15
    return _steps(found, np.where(size > 0, size, np.where(run < 15, run, 0)))


def _words(data: np.ndarray) -> np.ndarray:
    """The 24 bits from each byte on; behind the data stand ones, which no code consists of."""
    padded = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.int32)
    return padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]


def _walked(data: np.ndarray, steps: np.ndarray, width: int, chunk: int = 1 << 16):
    """Where the codes of a scan stand, in bits: arrays of positions with the words around them, until no code follows."""
    p, base = 0, 0
    while base < len(data):
        words = _words(data[base : base + chunk + 8])
        n = min(chunk, len(data) - base)
        every = steps[words[:n, None] >> (24 - width - _EIGHT) & ((1 << width) - 1)]
        step, stands, end = every.tobytes(), bytearray(8 * n), 8 * n
        while p < end:
            stands[p] = 1
            p += step[p]
        at = np.flatnonzero(np.frombuffer(stands, np.uint8))
        none = every.ravel()[at] == NO_CODE
        if none.any():
            yield at[: int(none.argmax())], words
            return
        yield at, words
        base, p = base + chunk, p - 8 * chunk


def _read(words: np.ndarray, at: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the codes at these bits, and the 16 bits behind each."""
    sixteen = lambda at: words[at >> 3] >> (8 - (at & 7)) & 65535
    found = table.found[sixteen(at) >> (16 - table.width)]
    return found & 255, sixteen(at + (found >> 8))


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Values of `size` bits that stand first in 16."""
    value = bits >> (16 - size)
    return value - (bits < 32768) * ((1 << size) - 1)  # without bits nothing is taken off


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\xff\xff\xff\xff", 0

    def peek16(self) -> int:
        i, shift = self.at >> 3, self.at & 7
        if i + 4 > len(self.data) + 2:
            raise EOFError("a scan ends early")
        return int.from_bytes(self.data[i : i + 3].ljust(3, b"\xff"), "big") >> (8 - shift) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        found = self.peek16() >> (16 - n)
        self.at += n
        return found

    def symbol(self, table: Table) -> int:
        found = table.look[self.peek16() >> (16 - table.width)]
        if not found:
            raise ValueError("a code that is in no table")
        self.at += found >> 8
        return found & 255

    def value(self, size: int) -> int:
        bits = self.take(size)
        return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1


def _block_order(high: int, wide: int, row: int, v: int, h: int) -> np.ndarray:
    """Numbers of high x wide blocks in rows of `row`, a line for each MCU of v x h blocks."""
    if high * wide > 1 << 14:
        return _ordered(high, wide, row, v, h)
    return _kept_order(high, wide, row, v, h)


def _ordered(high: int, wide: int, row: int, v: int, h: int) -> np.ndarray:
    corner = (np.arange(high // v)[:, None] * v * row + np.arange(wide // h) * h).reshape(-1, 1)
    return corner + (np.arange(v)[:, None] * row + np.arange(h)).reshape(1, -1)


_kept_order = lru_cache(maxsize=512)(_ordered)  # small files are often of one shape

_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


@dataclass
class Scan:
    parts: list[tuple[Component, Table | None, Table | None]]
    first: int
    last: int
    high: int
    low: int
    restart: int

    def order(self) -> list[tuple[Component, np.ndarray]]:
        """For one component alone the index of its blocks; for several, of every MCU's."""
        if len(self.parts) == 1:
            c = self.parts[0][0]
            return [(c, _block_order(c.own_high, c.own_wide, c.wide, 1, 1))]
        return [(c, _block_order(c.high, c.wide, c.wide, c.v, c.h)) for c, _, _ in self.parts]

    def decode(self, data: bytes) -> None:
        order = self.order()
        if not self.restart and not _RESTART.search(data):
            if self._decode_at_once(data.replace(b"\xff\x00", b"\xff"), order):
                return
        units = len(order[0][1])
        pieces = [p.replace(b"\xff\x00", b"\xff") for p in _RESTART.split(data)]
        step = self.restart or units
        for k, start in enumerate(range(0, units, step)):
            self._decode_units(Bits(pieces[k]), order, range(start, min(units, start + step)))

    def _decode_at_once(self, data: bytes, order) -> bool:
        """Decode a scan without restarts in numpy; False, with nothing done, if it is of a kind that is left."""
        array = np.frombuffer(data, np.uint8)
        if self.first == 0 and self.high:  # one bit a block
            per_unit = sum(ix.shape[1] for _, ix in order)
            n = len(order[0][1]) * per_unit
            bits = np.unpackbits(array, count=n).reshape(-1, per_unit)
            at = 0
            for c, ix in order:
                c.blocks[ix, 0] |= bits[:, at : at + ix.shape[1]].astype(np.int16) << self.low
                at += ix.shape[1]
            return True
        if self.first == 0:
            return not self.last and self._dc_at_once(array, order)
        if self.parts[0][2] is None:
            return False
        if self.high:
            return self._refined_at_once(array, order[0][1][:, 0])
        return self._ac_at_once(array, order[0][1][:, 0])

    def _dc_at_once(self, data: np.ndarray, order) -> bool:
        tables = [dc for _, dc, _ in self.parts]
        if any(t is not tables[0] for t in tables) or tables[0] is None:
            return False
        values = []
        for at, words in _walked(data, tables[0].dc_steps, tables[0].width):
            size, behind = _read(words, at, tables[0])
            values.append(_signed(behind, size))
        per_unit = sum(ix.shape[1] for _, ix in order)
        n = len(order[0][1]) * per_unit
        values = np.concatenate(values) if values else np.zeros(0, np.int64)
        if len(values) < n:
            raise EOFError("a scan ends early")
        values, at = values[:n].reshape(-1, per_unit), 0
        for c, ix in order:
            steps = values[:, at : at + ix.shape[1]]
            c.blocks[ix, 0] = np.cumsum(steps.ravel()).reshape(steps.shape) << self.low
            at += ix.shape[1]
        return True

    def _ac_at_once(self, data: np.ndarray, ix: np.ndarray) -> bool:
        """Coefficients of a band in a row, block by block: a value stands its run behind the last, an ended block leads to the next."""
        (c, _, table), band = self.parts[0], self.last - self.first + 1
        lin = 0
        for at, words in _walked(data, table.ac_steps, table.width):
            symbol, behind = _read(words, at, table)
            if not len(symbol):
                continue
            run, size = symbol >> 4, symbol & 15
            ended = np.flatnonzero((size == 0) & (run < 15))
            ahead = np.where(size > 0, run + 1, 16)
            ahead[ended] = 0
            past = np.cumsum(ahead)
            if len(ended):
                length = (1 << run[ended]) + (behind[ended] >> (16 - run[ended]))
                shift, shifts = lin, []
                for reached, blocks in zip(past[ended].tolist(), length.tolist()):
                    shift += ((reached + shift) // band + blocks) * band - (reached + shift)
                    shifts.append(shift)
                edges = np.diff(np.concatenate(([0], ended, [len(symbol)])))
                past = past + np.repeat(np.array([lin, *shifts]), edges)
                lin = int(past[-1])  # an ended block's own place is where it leads to
            else:
                past = past + lin
                lin = int(past[-1])
            known = size > 0
            place = past[known] - 1
            if len(place) and place[-1] >= len(ix) * band:
                raise ValueError("a scan leads beyond its blocks")
            c.blocks[ix[place // band], self.first + place % band] = _signed(behind[known], size[known]) << self.low
        if lin < len(ix) * band:
            raise EOFError("a scan ends early")
        return True

    def _refined_at_once(self, data: np.ndarray, ix: np.ndarray) -> bool:
        c, _, table = self.parts[0]
        _refined(c.blocks, ix, [len(ix)], _Joined.of([data], [table]), self.first, self.last, self.low)
        return True

    def _decode_units(self, bits: Bits, order, units: range) -> None:
        before = [0] * len(order)
        run = 0
        for unit in units:
            for k, ((c, ix), (_, dc, ac)) in enumerate(zip(order, self.parts)):
                for block in ix[unit].tolist():
                    row = c.blocks[block]
                    if self.first == 0:
                        if self.high:
                            row[0] |= bits.take(1) << self.low
                        else:
                            before[k] += bits.value(bits.symbol(dc))
                            row[0] = before[k] << self.low
                            if self.last:  # a sequential file: the other coefficients follow
                                self._ac_first(bits, row, ac, 1, 0)
                    elif self.high:
                        run = self._ac_refine(bits, row, ac, run)
                    else:
                        run = self._ac_first(bits, row, ac, self.first, run)

    def _ac_first(self, bits: Bits, row: np.ndarray, ac: Table, k: int, run: int) -> int:
        if run:
            return run - 1
        while k <= self.last:
            symbol = bits.symbol(ac)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                row[k] = bits.value(size) << self.low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                return (1 << zeros) - 1 + bits.take(zeros)
        return 0

    def _ac_refine(self, bits: Bits, row: np.ndarray, ac: Table, run: int) -> int:
        one, k = 1 << self.low, self.first

        def correct(at: int) -> None:
            if bits.take(1) and not abs(int(row[at])) & one:
                row[at] += one if row[at] > 0 else -one

        if not run:
            while k <= self.last:
                symbol = bits.symbol(ac)
                zeros, size = symbol >> 4, symbol & 15
                new = 0
                if size:
                    new = one if bits.take(1) else -one
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= self.last:
                    if row[k]:
                        correct(k)
                    elif zeros == 0:
                        if new:
                            row[k] = new
                        k += 1
                        break
                    else:
                        zeros -= 1
                    k += 1
        if run:
            for at in range(k, self.last + 1):
                if row[at]:
                    correct(at)
            run -= 1
        return run


def decode(data: bytes) -> Frame:
    """Coefficients of a baseline, extended or progressive Huffman-coded JPEG of 8 bits; ValueError or EOFError if it is damaged."""
    with _damage():
        frame, scans = _parsed(data)
        for c in frame.components:
            c.blocks = np.zeros((c.wide * c.high, 64), np.int16)
        for scan, coded in scans:
            scan.decode(coded)
        return frame


@contextmanager
def _damage():
    try:
        yield
    except (IndexError, KeyError, TypeError, AttributeError, OverflowError, struct.error) as e:
        raise ValueError("a damaged JPEG") from e


def _parsed(data: bytes) -> tuple[Frame, list[tuple[Scan, bytes]]]:
    """The frame, yet without blocks, and its scans with their coded data."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, frame, restart = 2, None, 0
    tables: dict[tuple[int, int], Table] = {}
    quantisers: dict[int, np.ndarray] = {}
    comments: list[bytes] = []
    scans: list[tuple[Scan, bytes]] = []
    while True:
        found = _MARKER.search(data, at)
        if not found:
            raise EOFError("a JPEG without an end")
        marker, at = data[found.start() + 1], found.end()
        if marker == 0xD9:
            break
        (length,) = struct.unpack_from(">H", data, at)
        body, at = data[at + 2 : at + length], at + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = Table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xFE:
            comments.append(body)
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker in (0xC0, 0xC1, 0xC2):
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or not height or not width:
                raise ValueError("only 8-bit files of known size are supported")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            top_h, top_v = max(c.h for c in parts), max(c.v for c in parts)
            across, down = -(-width // (8 * top_h)), -(-height // (8 * top_v))
            for c in parts:
                c.wide, c.high = across * c.h, down * c.v
                c.own_wide, c.own_high = -(-(-(-width * c.h // top_h)) // 8), -(-(-(-height * c.v // top_v)) // 8)
            frame, by_id = Frame(height, width, parts, quantisers, comments), {c.id: c for c in parts}
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan before the frame")
            n = body[0]
            parts = [(by_id[body[1 + 2 * i]], tables.get((0, body[2 + 2 * i] >> 4)), tables.get((1, body[2 + 2 * i] & 15))) for i in range(n)]
            first, last, steps = body[1 + 2 * n : 4 + 2 * n]
            end = _MARKER.search(data, at)
            if not end:
                raise EOFError("a scan without an end")
            scans.append((Scan(parts, first, last, steps >> 4, steps & 15, restart), data[at : end.start()]))
            at = end.start()
        elif 0xC3 <= marker <= 0xCF:
            raise ValueError("arithmetic, lossless and hierarchical files are not supported")
    if frame is None:
        raise ValueError("a JPEG without a frame")
    return frame, scans


# --- Many files at a time ---------------------------------------------------------------------
# Small files are decoded together: the first scans of all, then the second ones, and so on. Those
# of one kind lie in a row, each with its own table, and are read by the same few calls of numpy.


#: Blocks, and entries of tables, that files decoded together have at most, but for the last file.
TOGETHER_BLOCKS, TOGETHER_ENTRIES = 2048, 1 << 20


@dataclass
class _Joined:
    """The data of scans in a row, ones behind each, and their tables likewise."""

    data: np.ndarray
    words: np.ndarray
    begin: np.ndarray  # bytes
    end: np.ndarray
    scan: np.ndarray  # of each byte
    found: np.ndarray
    offset: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, pieces: list[np.ndarray], tables: list[Table]) -> _Joined:
        ones = np.full(8, 255, np.uint8)
        data = np.concatenate([x for piece in pieces for x in (piece, ones)])
        size = np.array([len(piece) for piece in pieces])
        begin = np.cumsum(size + 8) - size - 8
        found, offset, width = _found_of(tables)
        return cls(data, _words(data), begin, begin + size, np.repeat(np.arange(len(pieces), dtype=np.int32), size + 8), found, offset, width)

    def at(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What codes at these bits are, so many in each scan."""
        left, offset = np.repeat((32 - self.width).astype(np.uint32), counts), np.repeat(self.offset, counts)
        ahead = self.words.take(p >> 3).astype(np.uint32) << ((p & 7) + 8).astype(np.uint32)
        return self.found.take((ahead >> left) + offset)

    def behind(self, p: np.ndarray) -> np.ndarray:
        """The 16 bits from each of these on."""
        return self.words[p >> 3] >> (8 - (p & 7)) & 65535

    def everywhere(self, entries: np.ndarray) -> np.ndarray:
        """The entries, parallel to `found`, of the code at every bit."""
        out = np.empty((len(self.data), 8), entries.dtype)
        left, offset = (32 - self.width).astype(np.uint32), self.offset.astype(np.uint32)
        for at in range(0, len(out), 1 << 14):
            scan = self.scan[at : at + (1 << 14)]
            words, shift, base = self.words[at : at + len(scan)].astype(np.uint32) << 8, left[scan], offset[scan]
            for bit in range(8):
                out[at : at + len(scan), bit] = entries.take((words << bit >> shift) + base, mode="clip")
        return out.ravel()

    def walked(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the codes of all scans stand, in bits, each scan until no code follows, and how many stand before each scan and before the end."""
        every = self.everywhere(np.where(steps == NO_CODE, 0, steps).astype(np.uint8))
        every.reshape(-1, 8)[(self.end[:, None] + _EIGHT).ravel()] = 0  # behind a scan, and where no code follows, a walk stays
        step, stands = every.tobytes(), bytearray(len(every))
        for p in (8 * self.begin).tolist():
            while step[p]:
                stands[p] = 1
                p += step[p]
                stands[p] = 1
                p += step[p]
                stands[p] = 1
                p += step[p]
                stands[p] = 1
                p += step[p]
        at = np.flatnonzero(np.frombuffer(stands, bool) & (every > 0)).astype(np.int32)
        return at, np.append(np.searchsorted(at, 8 * self.begin), len(at))


def _found_of(tables: list[Table]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table.found of all tables in a row, and where each begins in it and its width."""
    numbers = {id(t): t for t in tables}
    each = list(numbers.values())
    if len(each) == 1:
        return each[0].found, np.zeros(len(tables), np.int32), np.full(len(tables), each[0].width, np.int32)
    counts = np.frombuffer(b"".join(t.counts for t in each), np.uint8).reshape(-1, 16)
    n = counts.sum(axis=1, dtype=np.int64)
    if n.tolist() != [len(t.symbols) for t in each]:
        raise ValueError("a damaged table")
    bits = np.repeat(np.tile(np.arange(1, 17), len(each)), counts.ravel())
    width = np.array([t.width for t in each], np.int32)
    of = np.repeat(np.arange(len(each)), n)
    span = 1 << (width[of] - bits)
    rest = (1 << width) - np.bincount(of, span, minlength=len(each)).astype(np.int64)
    ends = np.cumsum(n)
    entries = np.insert(bits << 8 | np.frombuffer(b"".join(t.symbols for t in each), np.uint8), ends, 0)
    found = np.repeat(entries.astype(np.int32), np.insert(span, ends, rest))
    at = {key: k for k, key in enumerate(numbers)}
    of = np.array([at[id(t)] for t in tables])
    return found, (np.cumsum(1 << width) - (1 << width))[of].astype(np.int32), width[of]


def _refined(blocks: np.ndarray, rows: np.ndarray, counts: list[int], joined: _Joined, first: int, last: int, low: int) -> None:
    """Symbols one by one; the corrections behind each, and all new coefficients, at once.

    Scans have the blocks `rows`, as many as `counts` tells. Places that are still zero are numbered through
    all blocks, so a symbol leads to a number, and the corrections behind it are as many as places are known between.
    """
    band = last - first + 1
    part = blocks[rows, first : last + 1].ravel()
    is_zero = part == 0
    known, zero = np.flatnonzero(part), np.flatnonzero(is_zero)
    before = np.zeros(len(part) + 1, np.int32)  # zeros before each place
    np.cumsum(is_zero, out=before[1:])
    places, ends = memoryview(zero), memoryview(before[::band].copy())
    words = memoryview(joined.words)
    # bits of a code with what stands behind it but corrections, and the zeros it leads over; or 16 and what tells the length of a run of ended blocks
    run = joined.found >> 4 & 15
    lasts = (joined.found & 15 == 0) & (run < 15)
    every = joined.everywhere(((joined.found >> 8) + np.where(lasts, run, joined.found & 15 > 0) + (run + 16 * lasts << 8)).astype(np.uint16))
    step, ahead = every.astype(np.uint8).tobytes(), (every >> 8).astype(np.uint8).tobytes()
    del every
    codes, leads, scan_edges = [], [], []  # where codes stand, in bits, and the places behind those they lead to
    stop = 0
    try:
        for count, p, over in zip(counts, (8 * joined.begin).tolist(), (8 * joined.end).tolist()):
            block, stop = stop, stop + count
            z, limit = ends[block], (block + 1) * band
            done = block * band - z
            scan_edges.append(len(codes))
            while block < stop:
                codes.append(p)
                zeros = ahead[p]
                p += step[p]
                if zeros < 16:
                    z += zeros
                    at = places[z] + 1
                    z += 1
                    if at == limit:
                        block += 1
                        limit += band
                else:
                    if zeros == 16:
                        block += 1
                    else:
                        zeros -= 16
                        block += (1 << zeros) + ((words[p - zeros >> 3] >> (8 - (p - zeros & 7)) & 65535) >> (16 - zeros))
                        if block > stop:
                            block = stop
                    z, at = ends[block], block * band
                    limit = at + band
                leads.append(at)
                at -= z
                p += at - done  # a correction of each place that is known
                done = at
            if p > over:
                raise EOFError("a scan ends early")
    except IndexError as e:
        raise EOFError("a scan ends early") from e
    codes, leads = np.array(codes, np.int64), np.array(leads, np.int64)
    found = joined.at(codes, np.diff(np.append(scan_edges, len(codes))))
    if not found.all():
        raise ValueError("a code that is in no table")
    size, run = found & 15, found >> 4 & 15
    begun = np.concatenate(([0], leads[:-1]))
    begun[scan_edges] = (np.cumsum(counts) - counts) * band
    if ((leads - 1) // band != begun // band)[(size > 0) | (run == 15)].any():
        raise ValueError("a scan leads beyond a block")
    signs = (codes + (found >> 8))[size > 0]
    starts = codes + np.frombuffer(step, np.uint8)[codes]
    stops = starts + (leads - before[leads]) - (begun - before[begun])
    flat, one = np.unpackbits(joined.data), np.int16(1 << low)
    edges = np.zeros(len(flat) + 1, np.int8)
    some = stops > starts
    edges[starts[some]] = 1
    edges[stops[some]] -= 1
    held = part.take(known)
    fresh = flat.take(np.flatnonzero(np.cumsum(edges[:-1], dtype=np.int8).view(bool))) * ((np.abs(held) >> low) & 1 == 0)
    part[known] = held + np.where(held > 0, fresh, -fresh.astype(np.int16)) * one
    part[leads[size > 0] - 1] = np.where(flat[signs], one, -one)
    blocks[rows, first : last + 1] = part.reshape(-1, band)


@lru_cache(maxsize=256)
def _stream(parts: tuple[tuple[int, ...], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a scan of DCs, component by component: blocks, numbered from the first component's, places in the scan, and how many blocks each has.

    A part is: offset from the first component, rows and columns of blocks, blocks in a row, and those of an MCU.
    """
    order = [base + _ordered(*shape) for base, *shape in parts]
    per_unit = sum(ix.shape[1] for ix in order)
    places, at = [], 0
    for ix in order:
        places.append((np.arange(len(ix))[:, None] * per_unit + at + np.arange(ix.shape[1])).ravel())
        at += ix.shape[1]
    return np.concatenate([ix.ravel() for ix in order]), np.concatenate(places), np.array([ix.size for ix in order])


def _streams(scans: list[Scan]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_stream() of many scans in a row, among the blocks of all files and the places of all scans, and how many places each scan has."""
    found = []
    for scan in scans:
        first = scan.parts[0][0]
        if len(scan.parts) == 1:
            shapes = ((0, first.own_high, first.own_wide, first.wide, 1, 1),)
        else:
            shapes = tuple((c.base - first.base, c.high, c.wide, c.wide, c.v, c.h) for c, _, _ in scan.parts)
        found.append(_stream(shapes))
    n = np.array([len(rows) for rows, _, _ in found])
    base = np.repeat(np.array([scan.parts[0][0].base for scan in scans]), n)
    past = np.repeat(np.cumsum(n) - n, n)
    rows, places = np.concatenate([r for r, _, _ in found]) + base, np.concatenate([p for _, p, _ in found]) + past
    return rows, places, np.concatenate([k for _, _, k in found]), n


def _dcs_together(blocks: np.ndarray, scans: list[Scan], pieces: list[np.ndarray]) -> None:
    joined = _Joined.of(pieces, [scan.parts[0][1] for scan in scans])
    rows, places, sizes, n = _streams(scans)
    at, edges = joined.walked(_dc_steps(joined.found))
    if (np.diff(edges) < n).any():
        raise EOFError("a scan ends early")
    at = at[np.arange(n.sum()) + np.repeat(edges[:-1] - (np.cumsum(n) - n), n)]
    found = joined.at(at, n)
    step = _signed(joined.behind(at + (found >> 8)), found & 255)[places]
    value = np.concatenate(([0], np.cumsum(step)))
    blocks[rows, 0] = value[1:] - np.repeat(value[np.cumsum(sizes) - sizes], sizes) << scans[0].low


def _dcs_refined_together(blocks: np.ndarray, scans: list[Scan], pieces: list[np.ndarray]) -> None:
    rows, places, _, n = _streams(scans)
    begin = np.cumsum(n) - n
    size = np.array([8 * len(piece) for piece in pieces])
    at = places - np.repeat(begin, n)  # in its own scan
    there = at < np.repeat(size, n)  # what a scan lacks counts as 0
    flat = np.append(np.unpackbits(np.concatenate(pieces)), 0)
    bits = np.where(there, flat[np.where(there, at + np.repeat(np.cumsum(size) - size, n), 0)], 0)
    blocks[rows, 0] |= bits.astype(np.int16) << scans[0].low


def _rows_of(scans: list[Scan]) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of scans of one component each, and how many each scan has."""
    parts = [scan.parts[0][0] for scan in scans]
    n, own, wide, base = (np.array(x) for x in zip(*[(c.own_high * c.own_wide, c.own_wide, c.wide, c.base) for c in parts]))
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = np.repeat(own, n)
    return np.repeat(base, n) + k // own * np.repeat(wide, n) + k % own, n


def _acs_together(blocks: np.ndarray, scans: list[Scan], pieces: list[np.ndarray]) -> None:
    """Values stand their runs behind the last; an ended block leads to the first place of another, so what lies between two of them is counted by itself."""
    joined = _Joined.of(pieces, [scan.parts[0][2] for scan in scans])
    rows, n = _rows_of(scans)
    first, band = scans[0].first, scans[0].last - scans[0].first + 1
    at, edges = joined.walked(_ac_steps(joined.found))
    if (np.diff(edges) == 0).any():
        raise EOFError("a scan ends early")
    found = joined.at(at, np.diff(edges))
    behind = joined.behind(at + (found >> 8))
    run, size = found >> 4 & 15, found & 15
    ended = (size == 0) & (run < 15)
    past = np.cumsum((run + 1) * ~ended, dtype=np.int32)  # places that are led over; a run of 15 without a value is 16 too
    # stretches: up to an ended block or the end of a scan
    closes = ended.copy()
    closes[edges[1:] - 1] = True
    close = np.flatnonzero(closes)
    before = np.concatenate(([0], past[close[:-1]]))
    led = (past[close] - before) // band + np.where(ended[close], (1 << run[close]) + (behind[close] >> (16 - run[close])), 0)
    reached = np.concatenate(([0], np.cumsum(led)))
    scan_edges = np.searchsorted(close, edges)  # the first stretch of each scan
    own = reached[:-1] - np.repeat(reached[scan_edges[:-1]], np.diff(scan_edges))
    if (own[scan_edges[1:] - 1] + led[scan_edges[1:] - 1] < n).any():
        raise EOFError("a scan ends early")
    scan = np.repeat(np.arange(len(scans)), np.diff(scan_edges))
    known = np.flatnonzero(size)
    of = np.repeat(np.arange(len(close), dtype=np.int32), np.diff(np.concatenate(([-1], close))))[known]
    place = (own * band - before - 1).astype(np.int32)[of] + past[known]
    block, over = np.divmod(place, np.int32(band))
    if (block >= n[scan].astype(np.int32)[of]).any():
        raise ValueError("a scan leads beyond its blocks")
    at = rows[(np.cumsum(n) - n)[scan].astype(np.int32)[of] + block] * 64 + first + over
    blocks.reshape(-1)[at] = _signed(behind[known], size[known]) << scans[0].low


def _acs_refined_together(blocks: np.ndarray, scans: list[Scan], pieces: list[np.ndarray]) -> None:
    joined = _Joined.of(pieces, [scan.parts[0][2] for scan in scans])
    rows, n = _rows_of(scans)
    _refined(blocks, rows, n.tolist(), joined, scans[0].first, scans[0].last, scans[0].low)


def _together(scan: Scan, data: bytes):
    """The function that decodes scans of this kind together, or None."""
    if scan.restart or _RESTART.search(data) or not data:
        return None
    if scan.first == 0:
        if scan.high:
            return _dcs_refined_together
        tables = [dc for _, dc, _ in scan.parts]
        return None if scan.last or tables[0] is None or any(t is not tables[0] for t in tables) else _dcs_together
    if len(scan.parts) > 1 or scan.parts[0][2] is None:
        return None
    return _acs_refined_together if scan.high else _acs_together


def decode_each(files: Iterable[bytes]) -> Iterator[Frame]:
    """decode() of each file, in order; small ones are held and decoded together."""
    held, blocks, entries = [], 0, 0
    for data in files:
        with _damage():
            frame, scans = _parsed(data)
            blocks += sum(c.wide * c.high for c in frame.components)
            entries += sum(1 << t.width for scan, _ in scans for t in scan.parts[0][1:] if t is not None)
        held.append((frame, scans, data))
        if blocks >= TOGETHER_BLOCKS or entries >= TOGETHER_ENTRIES:
            yield from _decoded(held)
            held, blocks, entries = [], 0, 0
    yield from _decoded(held)


def _decoded(held: list[tuple[Frame, list[tuple[Scan, bytes]], bytes]]) -> Iterator[Frame]:
    large = [sum(c.wide * c.high for c in frame.components) > TOGETHER_BLOCKS for frame, _, _ in held]
    small = [item for item, alone in zip(held, large) if not alone]
    with _damage():
        _decode_together([(frame, scans) for frame, scans, _ in small])
    for (frame, _, data), alone in zip(held, large):
        yield decode(data) if alone else frame


def with_tensors(frames: Iterable[Frame]) -> Iterator[tuple[Frame, np.ndarray]]:
    """Each frame with its rgb(), in order; small ones are held, transformed and coloured together."""
    held, blocks = [], 0
    for frame in frames:
        held.append(frame)
        blocks += sum(len(c.blocks) for c in frame.components)
        if blocks >= TOGETHER_BLOCKS:
            yield from zip(held, _tensors(held))
            held, blocks = [], 0
    yield from zip(held, _tensors(held))


def _tensors(frames: list[Frame]) -> list[np.ndarray]:
    out, kinds = [None] * len(frames), defaultdict(list)
    for k, frame in enumerate(frames):
        if sum(len(c.blocks) for c in frame.components) > TOGETHER_BLOCKS:
            out[k] = frame.rgb()
        else:
            kinds[tuple((c.h, c.v) for c in frame.components)].append(k)
    for kind, numbers in kinds.items():
        top_h, top_v = frames[numbers[0]].sampling()
        planes = []
        for i, (h, v) in enumerate(kind):
            of = [(frames[k].components[i], frames[k].quantisers) for k in numbers]
            values = np.concatenate([c.blocks[_block_order(c.high, c.wide, c.wide, v, h).ravel()] * quantisers[c.table] for c, quantisers in of])
            plane = _samples(values).reshape(-1, v, h, 8, 8).swapaxes(2, 3).reshape(-1, 8 * v, 8 * h)
            down, across = top_v // v, top_h // h
            planes.append(plane.repeat(down, axis=1).repeat(across, axis=2) if (down, across) != (1, 1) else plane)
        rgb, at = np.empty((*planes[0].shape, 3), np.uint8), 0
        _colour(planes, rgb)
        for k in numbers:
            c = frames[k].components[0]
            down, across = c.high // c.v, c.wide // c.h
            tiles = rgb[at : at + down * across].reshape(down, across, 8 * top_v, 8 * top_h, 3)
            out[k] = tiles.swapaxes(1, 2).reshape(down * 8 * top_v, across * 8 * top_h, 3)[: frames[k].height, : frames[k].width]
            at += down * across
    return out


def _decode_together(files: list[tuple[Frame, list[tuple[Scan, bytes]]]]) -> None:
    components = [c for frame, _ in files for c in frame.components]
    blocks, at = np.zeros((sum(c.wide * c.high for c in components), 64), np.int16), 0
    for c in components:
        c.base, c.blocks, at = at, blocks[at : at + c.wide * c.high], at + c.wide * c.high
    for k in range(max((len(scans) for _, scans in files), default=0)):
        kinds = defaultdict(list)
        for _, scans in files:
            if k < len(scans):
                scan, data = scans[k]
                together = _together(scan, data)
                if together is None:
                    scan.decode(data)
                else:
                    kinds[together, scan.first, scan.last, scan.high, scan.low].append((scan, np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8)))
        for (together, *_), found in kinds.items():
            together(blocks, *map(list, zip(*found)))


# --- Storing bytes -------------------------------------------------------------------------
# A byte is the coefficient that tells its distance from the payload's middle byte, so common bytes
# are small numbers or zeros. All but the lowest bit is sent first; distances of one are zeros then
# and become known in the refinement only. Files are coded many at a time: arrays hold the blocks,
# symbols and bits of all of them in a row, each file with its own tables, and only bytes are cut apart.


#: Bits of the longest code that the store makes.
LONGEST = 12
#: Bits of numbers below 512.
BIT_LENGTH = np.array([k.bit_length() for k in range(512)], np.int32)


def _tables_for(symbol: np.ndarray, owner: np.ndarray, n: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """For each of n owners a table of prefix codes, as long as the shares of its symbols ask for, as a file holds it; codes by owner << 8 | symbol, and their bits."""
    often = np.bincount(owner << 8 | symbol, minlength=n << 8)
    used = np.flatnonzero(often)
    of, count = used >> 8, often[used]
    kinds = np.bincount(of, minlength=n)
    # a share is count / total + 2 ** (1 - LONGEST), in integers; one share more stands for the code of all ones, which is not used
    total = np.add.reduceat(count, np.cumsum(kinds) - kinds)
    share, shares = (count << (LONGEST - 1)) + total[of], (total * ((1 << (LONGEST - 1)) + kinds + 1))[of]
    lengths = 1 + (share[:, None] << np.arange(1, LONGEST) < shares[:, None]).sum(axis=1)
    order = np.argsort(of << 12 | lengths << 8 | used & 255)
    ordered, m, by = used[order], lengths[order], of[order]
    # a code follows the one before it, with zeros behind it as far as it is longer
    ends = np.cumsum(1 << (LONGEST - m))
    edges = np.concatenate(([0], np.cumsum(kinds)))
    ends -= np.concatenate(([0], ends))[edges[:-1]][by]
    code, bits = np.zeros(n << 8, np.int32), np.zeros(n << 8, np.int32)
    code[ordered], bits[ordered] = (ends >> (LONGEST - m)) - 1, m
    counts = np.bincount(of * 17 + lengths, minlength=n * 17).reshape(n, 17)[:, 1:].astype(np.uint8).tobytes()
    symbols = ordered.astype(np.uint8).tobytes()
    return [counts[16 * k : 16 * k + 16] + symbols[a:b] for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist()))], code, bits


#: Spectral bands of the first scans of luma and of each chroma.
BANDS = {1: ((1, 5), (6, 63)), 2: ((1, 63),), 3: ((1, 63),)}


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(parts: list[tuple[int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(parts), *[x for part in parts for x in part], first, last, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _packed(values: np.ndarray, sizes: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """The last `sizes` bits (1 to 32) of each value in a row, as bytes of the stretches between the edges; the last byte of each is filled up with ones."""
    past = np.zeros(len(sizes) + 1, np.int32 if len(sizes) < 1 << 26 else np.int64)
    np.cumsum(sizes, out=past[1:])
    bits = np.diff(past[edges])
    held = (bits + 7) >> 3
    begin = np.cumsum(held) - held
    at = past[:-1] + np.repeat((8 * begin - past[edges[:-1]]).astype(past.dtype), np.diff(edges))
    word, whole = at >> 5, values.astype(np.uint64) << (64 - (at & 31) - sizes).astype(np.uint64)
    n = int(held.sum())
    words = np.zeros(n // 4 + 2, np.uint32)
    if len(word):
        heads = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
        both = np.bitwise_or.reduceat(whole, heads)  # what begins in a word reaches into the next one at most
        words[word[heads]] = both >> np.uint64(32)
        words[word[heads] + 1] |= both.astype(np.uint32)
    out = words.astype(">u4").view(np.uint8)[:n].copy()
    some = held > 0
    out[(begin + held - 1)[some]] |= ((1 << (-bits & 7)) - 1)[some].astype(np.uint8)
    out = out.tobytes()
    return [out[a : a + k] for a, k in zip(begin.tolist(), held.tolist())]


@dataclass
class _Symbols:
    """Symbols of scans in their order, the bits behind each, the place from which each leads on, and its block."""

    symbol: np.ndarray
    extra: np.ndarray
    size: np.ndarray
    start: np.ndarray
    block: np.ndarray

    def coded(self, owner: np.ndarray, code: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = owner << 8 | self.symbol
        return code[of] << self.size | self.extra, bits[of] + self.size


def _inserter(where: np.ndarray, n: int):
    """A function that puts numbers before these places, in order, of an array of n."""
    at = where + np.arange(len(where))
    others = np.ones(n + len(where), bool)
    others[at] = False

    def insert(x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(others), y.dtype)
        out[at], out[others] = y, x
        return out

    return insert


#: Blocks in the longest run of ended blocks.
LONGEST_RUN = 32767


def _symbols_of(new: np.ndarray, known: np.ndarray | None, extra: np.ndarray, size: np.ndarray | int, begins: np.ndarray) -> _Symbols:
    """Symbols that send the coefficients `new` of a band of blocks, with `size` bits `extra` for each; scans begin at the blocks `begins`.

    Places that are `known` count in no run of zeros. A first approximation knows none.
    """
    n, band = new.shape
    kind = np.int32 if new.size < 1 << 31 else np.int64
    place = np.flatnonzero(new).astype(kind)
    block = place // kind(band)
    if known is None:
        rank, zero, first = place, None, block * band
    else:
        zero = np.flatnonzero(~known).astype(kind)
        before = np.concatenate(([0], np.cumsum(~known, dtype=kind)))  # zeros before each place
        rank, first = before[place], before[block * band]
    behind, begin = first.copy(), block * band
    if len(place):
        same = block[1:] == block[:-1]
        behind[1:][same] = rank[:-1][same] + 1
        begin[1:][same] = place[:-1][same] + 1
    zeros = rank - behind
    events = (zeros >> 4) + 1
    at = np.cumsum(events) - 1
    total = int(at[-1]) + 1 if len(at) else 0
    symbol, bits, width = np.full(total, 0xF0, np.int32), np.zeros(total, np.int32), np.zeros(total, np.int32)
    symbol[at], bits[at], width[at] = (zeros & 15) << 4 | size, extra, size
    start, of = begin, block
    if total > len(place):
        of = np.repeat(block, events)
        sixteens = np.arange(total) - np.repeat(at - events + 1, events)
        start = np.repeat(begin, events)
        later = np.flatnonzero(sixteens)
        reached = (np.repeat(behind, events) + 16 * sixteens - 1)[later]
        start[later] = (reached if zero is None else zero[reached]) + 1
    # runs of ended blocks: blocks without anything new belong to the run before them, if that is of their scan
    ended, busy = ~new[:, -1], np.zeros(n + 1, bool)
    busy[block] = True
    opens = ended & busy[:-1]
    opens[1:] |= ended[1:] & ~ended[:-1]
    opens[begins] = ended[begins]
    run = np.flatnonzero(opens)
    if not len(run):
        return _Symbols(symbol, bits, width, start, of)
    busy[begins] = busy[n] = True
    stops = np.flatnonzero(busy)
    length = stops[np.searchsorted(stops, run, "right")] - run
    if length.max() > LONGEST_RUN:
        parts = (length - 1) // LONGEST_RUN + 1
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        run, length = np.repeat(run, parts) + k * LONGEST_RUN, np.minimum(np.repeat(length, parts) - k * LONGEST_RUN, LONGEST_RUN)
    log = np.frexp(length)[1] - 1
    before = np.searchsorted(place, (run + 1) * band) - 1
    opened = np.maximum(run * band, np.where(before >= 0, place[before] + 1, 0) if len(place) else 0)
    insert = _inserter(np.searchsorted(of, run, "right"), total)
    return _Symbols(insert(symbol, log << 4), insert(bits, length - (1 << log)), insert(width, log), insert(start, opened), insert(of, run))


def _sent_first(part: np.ndarray, begins: np.ndarray) -> _Symbols:
    """The first approximation of a band: all bits but the lowest."""
    half = (part + (part < 0)) >> 1
    new = half != 0
    value = half[new].astype(np.int32)
    size = BIT_LENGTH[np.abs(value)]
    return _symbols_of(new, None, np.where(value < 0, value + (1 << size) - 1, value), size, begins)


def _sent_last(part: np.ndarray, begins: np.ndarray) -> tuple[_Symbols, np.ndarray, np.ndarray, np.ndarray]:
    """The refinement: what is new, the corrections of what is known, before how many of them each symbol stands, and how many stand before each scan."""
    much = np.abs(part)
    known, new = much > 1, much == 1
    symbols = _symbols_of(new, known, (part[new] > 0).astype(np.int32), 1, begins)
    held = np.flatnonzero(known)
    return symbols, (much[known] & 1).astype(np.int32), np.searchsorted(held, symbols.start), np.searchsorted(held, begins * part.shape[1])


_COMMENT = b"blocks "


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients are the bytes of payload (a positive multiple of 64 of them).

    Luma blocks take the first bytes, row by row, then Cb and Cr; what is over is filled with
    empty blocks. DCs are sent as steps and then refined by a bit; ACs in spectral bands, first
    all bits but the lowest, which a last scan of each component adds. Huffman tables are made
    for the symbols of this file: one for DCs, one for first scans and one for refinements.
    """
    return encode_payloads([payload])[0]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """encode_payload() of each, all at once: what one file costs numpy in calls is shared by all. Memory is in proportion to their sum."""
    if not all(p and len(p) % UNIT == 0 for p in payloads):
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    if not payloads:
        return []
    files = len(payloads)
    file = np.arange(files, dtype=np.int32)
    n = np.array([len(p) // UNIT for p in payloads])
    across = np.array([math.isqrt(-(-k // 6) - 1) + 1 for k in n.tolist()])
    down = -(-(-(-n // 6)) // across)
    total = across * down
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    of = np.repeat(file, n)
    if files == 1:
        often = np.bincount(data.ravel(), minlength=256)[None]
    else:
        often = np.bincount((of[:, None] << 8 | data).ravel(), minlength=files << 8).reshape(files, 256)
    middle = (np.cumsum(often, axis=1) < (32 * n)[:, None]).sum(axis=1)
    begin = np.cumsum(6 * total) - 6 * total
    blocks = np.zeros((6 * int(total.sum()), UNIT), np.int16)
    blocks[np.arange(len(data)) + np.repeat(begin - (np.cumsum(n) - n), n)] = data - middle.astype(np.int16)[of, None]
    # the blocks of each MCU: four of luma, in two rows, and two of chroma
    mcus, mcu_of = np.cumsum(total) - total, np.repeat(file, total)
    k, wide, base = np.arange(len(mcu_of)) - mcus[mcu_of], across[mcu_of], begin[mcu_of]
    corner = base + k // wide * 4 * wide + k % wide * 2
    dc = blocks[np.column_stack([corner, corner + 1, corner + 2 * wide, corner + 2 * wide + 1, base + 4 * total[mcu_of] + k, base + 5 * total[mcu_of] + k]), 0]
    half, steps = (dc >> 1).astype(np.int64), np.empty(dc.shape, np.int64)
    for columns in (slice(0, 4), slice(4, 5), slice(5, 6)):
        flat = half[:, columns].ravel()
        step, starts = np.diff(flat, prepend=0), mcus * (columns.stop - columns.start)
        step[starts] = flat[starts]
        steps[:, columns] = step.reshape(-1, columns.stop - columns.start)
    steps, owner = steps.ravel(), np.repeat(mcu_of, 6)
    step_size = BIT_LENGTH[np.abs(steps)]
    dc_tables, dc_code, dc_bits = _tables_for(step_size, owner, files)
    value = np.where(steps < 0, steps + (1 << step_size) - 1, steps)
    step_owner = owner << 8 | step_size
    edges = 6 * np.append(mcus, len(mcu_of))
    dc_first = _packed(dc_code[step_owner] << step_size | value, dc_bits[step_owner] + step_size, edges)
    dc_last = _packed((dc & 1).ravel(), np.ones(dc.size, np.int64), edges)
    # first scans, of luma and chroma apart, as their bands differ
    luma_of, chroma_of = np.repeat(file, 4 * total), np.repeat(file, 2 * total)
    is_luma = np.arange(len(blocks)) - np.repeat(begin, 6 * total) < np.repeat(4 * total, 6 * total)
    luma, chroma = (blocks[: len(luma_of)], blocks[len(luma_of) :]) if files == 1 else (blocks[is_luma], blocks[~is_luma])
    chroma_begins = np.column_stack([2 * mcus, 2 * mcus + total]).ravel()
    bands = [(luma, luma_of, 4 * mcus, band) for band in BANDS[1]] + [(chroma, chroma_of, chroma_begins, BANDS[2][0])]
    first = []
    for part, part_of, begins, band in bands:
        symbols = _sent_first(part[:, band[0] : band[1] + 1], begins)
        first.append((symbols, part_of[symbols.block], begins))
    ac_tables, *ac_codes = _tables_for(np.concatenate([s.symbol for s, _, _ in first]), np.concatenate([by for _, by, _ in first]), files)
    ac_first = [_packed(*s.coded(by, *ac_codes), np.append(np.searchsorted(s.block, begins), len(s.block))) for s, by, begins in first]
    # refinements
    begins = np.column_stack([begin, begin + 4 * total, begin + 5 * total]).ravel()
    symbols, corrections, where, held = _sent_last(blocks[:, 1:], begins)
    by = np.repeat(file, 6 * total)[symbols.block]
    end_tables, *end_codes = _tables_for(symbols.symbol, by, files)
    values, sizes = symbols.coded(by, *end_codes)
    insert = _inserter(where, len(corrections))
    edges = np.append(np.searchsorted(symbols.block, begins) + held, len(values) + len(corrections))
    ac_last = _packed(insert(corrections, values), insert(1, sizes), edges)
    out, every = [], [(1, 0), (2, 0), (3, 0)]
    for f in range(files):
        size = struct.pack(">BHHB", 8, 16 * int(down[f]), 16 * int(across[f]), 3) + b"\1\x22\0\2\x11\0\3\x11\0"
        tables = b"\0" + dc_tables[f] + b"\x10" + ac_tables[f] + b"\x11" + end_tables[f]
        made = [b"\xff\xd8", _segment(0xFE, _COMMENT + b"%d %d" % (n[f], middle[f])), _segment(0xC2, size)]
        made += [_segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC4, tables)]
        made.append(_scan(every, 0, 0, 0, 1, dc_first[f]))
        of_bands = [(1, BANDS[1][0], ac_first[0][f]), (1, BANDS[1][1], ac_first[1][f]), (2, BANDS[2][0], ac_first[2][2 * f]), (3, BANDS[3][0], ac_first[2][2 * f + 1])]
        made += [_scan([(id, 0)], *band, 0, 1, scan) for id, band, scan in of_bands]
        made.append(_scan(every, 0, 0, 1, 0, dc_last[f]))
        made += [_scan([(id, 1)], 1, 63, 1, 0, ac_last[3 * f + id - 1]) for id in (1, 2, 3)]
        made.append(b"\xff\xd9")
        out.append(b"".join(made))
    return out


def encode_each(payloads: Iterable[bytes]) -> Iterator[bytes]:
    """encode_payload() of each, in order; small ones are held and coded together."""
    held, size = [], 0
    for payload in payloads:
        if len(payload) > TOGETHER_BLOCKS * UNIT:
            yield from encode_payloads(held)
            yield encode_payload(payload)
            held, size = [], 0
            continue
        held.append(payload)
        size += len(payload)
        if size >= TOGETHER_BLOCKS * UNIT:
            yield from encode_payloads(held)
            held, size = [], 0
    yield from encode_payloads(held)


def payload_of(frame: Frame) -> bytes:
    """The bytes that encode_payload() stored."""
    told = [c[len(_COMMENT) :].split() for c in frame.comments if c.startswith(_COMMENT)]
    if not told:
        raise ValueError("this JPEG stores no payload")
    n, middle = map(int, told[0])
    values = np.concatenate([c.blocks[: max(0, n)] for c in frame.components])[:n]
    return (values + np.int16(middle)).astype(np.uint8).tobytes()
