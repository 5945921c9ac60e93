"""FLAC as a binary column: encode 8-bit samples, decode to PCM blocks with sample offsets.

The encoder writes mono streams of fixed block size; each frame takes the cheapest of a
constant, a fixed predictor of order 0 to 2 and a quantised linear predictor of order
``LPC_ORDER``, with Rice-coded residuals. The decoder reads any mono or stereo stream of up to
16 bits: it checks the CRC-8 of frame headers, the CRC-16 of frames and the MD5 of the samples,
and raises ValueError where one fails. Mono frames of one shape are decoded together, one sample
of all frames at a time; other frames one by one.

All arithmetic that decides bytes is on integers or on single IEEE operations, so equal samples
give equal streams on any layout.

Defined results: a null or empty text is a payload of 192 spaces, so a stream of one frame, and
counts no bytes of its own; a text of any length is one stream, encoded and decoded whole,
alone in its slice above about 1 MB; repeated rows and equal texts give equal values; ids may be of
any type and null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import slices, table, text_buffers, text_slices

BLOCK = 192
SAMPLE_RATE = 8000
LPC_ORDER = 4
LPC_PRECISION = 10
PARTITION_ORDER = 2
FRAMES_AT_ONCE = 4096

# Fixed values of the format: block size codes, sample size codes, fixed predictors.
BLOCK_CODES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 1 << c for c in range(8, 16)}}
SAMPLE_SIZES = {1: 8, 2: 12, 4: 16}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(polynomial: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for value in range(256):
        value <<= width - 8
        for _ in range(8):
            value = ((value << 1) ^ (polynomial if value & top else 0)) & mask
        out.append(value)
    return np.array(out, np.uint32)


CRC8 = _crc_table(0x07, 8)
CRC16 = _crc_table(0x8005, 16)


def _crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges together, longest first so that finished ones fall away."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    crc = np.zeros(len(at), np.uint32)
    alive = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for step, n in enumerate(alive):
        byte = data[at[:n] + step]
        crc[:n] = ((crc[:n] << 8) & 0xFFFF) ^ CRC16[(crc[:n] >> 8) ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


# --- encoding ------------------------------------------------------------------------------


def _lpc(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor coefficients (order, frames) and shifts, by Levinson's recursion."""
    corr = [
        (frames[lag:] * frames[: BLOCK - lag]).sum(axis=0, dtype=np.int64).astype(np.float64)
        for lag in range(LPC_ORDER + 1)
    ]
    error = corr[0] + 1.0
    coefs = np.zeros((LPC_ORDER, frames.shape[1]))
    for i in range(LPC_ORDER):
        rest = corr[i + 1].copy()
        for j in range(i):
            rest -= coefs[j] * corr[i - j]
        reflect = rest / error
        old = coefs.copy()
        coefs[i] = reflect
        for j in range(i):
            coefs[j] = old[j] - reflect * old[i - 1 - j]
        error = np.maximum(error * (1.0 - reflect * reflect), 1.0)
    limit = (1 << (LPC_PRECISION - 1)) - 1
    largest = np.abs(coefs).max(axis=0)
    shift = np.zeros(frames.shape[1], np.int64)
    for candidate in range(1, 15):
        shift[largest * float(1 << candidate) <= limit] = candidate
    quantised = np.rint(coefs * np.ldexp(1.0, shift.astype(np.int32))).astype(np.int64)
    return np.clip(quantised, -limit - 1, limit), shift


def _folded(residual: np.ndarray) -> np.ndarray:
    """Signed to unsigned: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    return (residual << 1) ^ (residual >> 31)


def _rice_parameters(folded: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Rice parameter of each partition (partitions, frames): the least k with mean < 2^k."""
    part = BLOCK >> PARTITION_ORDER
    sums = np.add.reduceat(folded, range(0, BLOCK, part), axis=0)
    counts = np.full(sums.shape, part)
    counts[0] -= orders
    return sum((sums > (counts << j)).astype(np.int32) for j in range(12))


def _number_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8-like code: bytes (6, frames) and their count."""
    limits = np.array([1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31])
    count = np.searchsorted(limits, numbers, side="right") + 1
    out = np.zeros((6, len(numbers)), np.int64)
    for n in range(1, 7):
        rows = count == n
        value = numbers[rows]
        for place in range(n):
            piece = value >> (6 * (n - 1 - place))
            lead = 0 if n == 1 else (0xFF << (8 - n)) & 0xFF
            out[place, rows] = (lead | piece) if place == 0 else 0x80 | (piece & 0x3F)
    return out, count


def _encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of (BLOCK, n) samples: all their bytes and the length of each."""
    n = samples.shape[1]
    residuals = {("fixed", 0): samples}
    for order in range(1, 3):
        residuals["fixed", order] = np.diff(residuals["fixed", order - 1], axis=0)
    coefs, shift = _lpc(samples)
    predicted = np.zeros((BLOCK - LPC_ORDER, n), np.int32)
    for j in range(LPC_ORDER):
        predicted += coefs[j].astype(np.int32) * samples[LPC_ORDER - 1 - j : BLOCK - 1 - j]
    residuals["lpc", LPC_ORDER] = samples[LPC_ORDER:] - (predicted >> shift.astype(np.int32))

    # The predictor with the least sum of sizes, charged for what it stores beside residuals.
    least = np.full(n, np.iinfo(np.int32).max)
    choice = np.zeros(n, np.int64)
    chosen = np.zeros((BLOCK, n), np.int32)
    for index, ((kind, order), residual) in enumerate(residuals.items()):
        size = np.abs(residual).sum(axis=0, dtype=np.int32) + order * (16 if kind == "lpc" else 8)
        better = size < least
        choice[better], least[better] = index, size[better]
        np.copyto(chosen[order:], residual, where=better)
        chosen[:order] *= ~better
    folded = _folded(chosen)
    kept = list(residuals)
    constant = (samples == samples[0]).all(axis=0)
    choice[constant] = -1

    # One column per field, in stream order; a field of 0 bits is absent.
    head, head_bytes = _number_bytes(numbers)
    values, widths = [], []

    def field(value, width):
        values.append(np.broadcast_to(np.asarray(value, np.int64), (n,)))
        widths.append(np.broadcast_to(np.asarray(width, np.int64), (n,)))

    fixed_head = [0xFF, 0xF8, 0x14, 0x02]  # sync and fixed blocks, 192 samples at 8 kHz, mono 8 bit
    crc = np.zeros(n, np.uint32)
    for byte in fixed_head:
        field(byte, 8)
        crc = CRC8[crc ^ np.uint32(byte)]
    for place in range(6):
        there = place < head_bytes
        field(head[place], 8 * there)
        crc = np.where(there, CRC8[crc ^ head[place].astype(np.uint32)], crc)
    field(crc, 8)
    kinds = np.zeros(n, np.int64)
    orders = np.zeros(n, np.int64)
    for index, (kind, order) in enumerate(kept):
        rows = choice == index
        orders[rows] = order
        kinds[rows] = (0b100000 | (order - 1)) if kind == "lpc" else (0b001000 | order)
    field(kinds << 1, 8)
    coded = choice >= 0
    is_lpc = coded & (kinds >= 0b100000)
    for place in range(LPC_ORDER):
        there = (place < orders) | ((place == 0) & ~coded)
        field(samples[place] & 0xFF, 8 * there)
    field(LPC_PRECISION - 1, 4 * is_lpc)
    field(shift, 5 * is_lpc)
    for j in range(LPC_ORDER):
        field(coefs[j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION * is_lpc)
    field(PARTITION_ORDER, 6 * coded)
    part = BLOCK >> PARTITION_ORDER
    params = _rice_parameters(folded, orders)
    values, widths = np.array(values, np.int32), np.array(widths, np.int32)
    k = np.repeat(params, part, axis=0)
    live = coded & (np.arange(BLOCK)[:, None] >= orders)
    rice_width = ((folded >> k) + 1 + k) * live
    rice_value = (1 << k) | (folded & ((1 << k) - 1))
    # A partition's parameter stands before its first residual.
    blocks_v, blocks_w = [values], [widths]
    for p in range(1 << PARTITION_ORDER):
        blocks_v += [params[p : p + 1], rice_value[p * part : (p + 1) * part]]
        blocks_w += [(4 * coded).astype(np.int32)[None, :], rice_width[p * part : (p + 1) * part]]
    values, widths = np.concatenate(blocks_v), np.concatenate(blocks_w)
    ends = np.cumsum(widths, axis=0, dtype=np.int64)
    lengths = (ends[-1] + 7) // 8 + 2
    starts = np.cumsum(lengths) - lengths
    ends += starts * 8 - 1
    # A code's set bits are its last 16 at most; leading zeros need no writing.
    last = ends >> 3
    aligned = (values * (widths > 0)) << (7 - (ends & 7))
    total = int(lengths.sum())
    out = np.zeros(total + 3, np.float64)
    for back in range(3):
        piece = (aligned >> (8 * back)) & 0xFF
        out += np.bincount((last - (back - 2)).ravel(), weights=piece.ravel(), minlength=total + 3)
    data = out[2 : total + 2].astype(np.uint8)
    check = _crc16(data, starts, lengths - 2)
    data[starts + lengths - 2] = check >> 8
    data[starts + lengths - 1] = check & 0xFF
    return data, lengths


def _stream_info(payload: bytes, frame_sizes: np.ndarray) -> bytes:
    low, high = (int(frame_sizes.min()), int(frame_sizes.max())) if len(frame_sizes) else (0, 0)
    packed = (SAMPLE_RATE << 44) | (0 << 41) | (7 << 36) | len(payload)
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    return b"".join(
        [
            b"fLaC\x80\x00\x00\x22",
            BLOCK.to_bytes(2, "big") * 2,
            low.to_bytes(3, "big"),
            high.to_bytes(3, "big"),
            packed.to_bytes(8, "big"),
            hashlib.md5(signed).digest(),
        ]
    )


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of 8-bit payloads (offset binary), each a multiple of BLOCK long."""
    counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
    if any(len(p) % BLOCK for p in payloads):
        raise ValueError(f"a payload is not a multiple of {BLOCK} bytes")
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    first = np.cumsum(counts) - counts
    numbers = np.arange(len(flat)) - np.repeat(first, counts)
    pieces, sizes = [], []
    for start in range(0, len(flat), FRAMES_AT_ONCE):
        part = flat[start : start + FRAMES_AT_ONCE].T.astype(np.int32) - 128
        data, lengths = _encode_frames(part, numbers[start : start + FRAMES_AT_ONCE])
        pieces.append(data.tobytes())
        sizes.append(lengths)
    data, sizes = b"".join(pieces), np.concatenate([*sizes, np.zeros(0, np.int64)])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return [
        _stream_info(p, sizes[f : f + c]) + data[ends[f] : ends[f + c]]
        for p, f, c in zip(payloads, first, counts)
    ]


# --- decoding ------------------------------------------------------------------------------


class _Bits:
    """Reads one stream bit by bit: the general way, for frames of unusual shape."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise ValueError("the stream ends inside a frame")
        value = int.from_bytes(self.data[first:last], "big")
        self.at += n
        return (value >> (last * 8 - self.at)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        zeros = 0
        while not self.take(1):
            zeros += 1
        return zeros


def _subframe(bits: _Bits, size: int, depth: int) -> list[int]:
    kind = bits.take(8)
    if kind & 0x80:
        raise ValueError("a subframe starts with a set bit")
    wasted = bits.unary() + 1 if kind & 1 else 0
    kind, depth = (kind >> 1) & 0x3F, depth - wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind <= 12 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        coefs, shift = FIXED[order] if kind <= 12 else None, 0
        if coefs is None:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            coefs = [bits.signed(precision) for _ in range(order)]
        width = 4 + bits.take(2)
        partitions = 1 << bits.take(4)
        for p in range(partitions):
            k = bits.take(width)
            raw = bits.take(5) if k == (1 << width) - 1 else None
            for _ in range(size // partitions - (order if p == 0 else 0)):
                if raw is None:
                    code = (bits.unary() << k) | bits.take(k)
                    residual = (code >> 1) ^ -(code & 1)
                else:
                    residual = bits.signed(raw)
                guess = sum(c * out[-1 - j] for j, c in enumerate(coefs))
                out.append(residual + (guess >> shift))
    else:
        raise ValueError(f"reserved subframe type {kind}")
    return [value << wasted for value in out]


def _crc_of(data: bytes, table_: np.ndarray, width: int) -> int:
    crc, mask = 0, (1 << width) - 1
    for byte in data:
        crc = ((crc << 8) & mask) ^ int(table_[((crc >> (width - 8)) ^ byte) & 0xFF])
    return crc


def _frame_slowly(data: bytes, at: int, depth: int) -> tuple[list[list[int]], int]:
    """Channels of the frame at byte ``at`` and the byte after it."""
    bits = _Bits(data, at)
    if bits.take(15) != 0x7FFC:
        raise ValueError(f"no frame starts at byte {at}")
    bits.take(1)
    block_code, rate_code = bits.take(4), bits.take(4)
    channels, size_code = bits.take(4), bits.take(3)
    bits.take(1)
    lead = bits.take(8)
    more = 0
    while lead & (0x80 >> more):
        more += 1
    bits.take(8 * max(0, more - 1))
    size = bits.take(8) + 1 if block_code == 6 else bits.take(16) + 1 if block_code == 7 else BLOCK_CODES[block_code]
    bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    head = bits.at // 8
    if _crc_of(data[at:head], CRC8, 8) != bits.take(8):
        raise ValueError(f"CRC-8 of the frame header at byte {at} differs")
    depth = SAMPLE_SIZES.get(size_code, depth)
    side = {8: 1, 9: 0, 10: 1}.get(channels)
    count = 2 if side is not None else channels + 1
    out = [_subframe(bits, size, depth + (c == side)) for c in range(count)]
    if channels == 8:
        out[1] = [a - b for a, b in zip(*out)]
    elif channels == 9:
        out[0] = [a + b for a, b in zip(*out)]
    elif channels == 10:
        mids = [(m << 1) | (s & 1) for m, s in zip(*out)]
        out = [[(m + s) >> 1 for m, s in zip(mids, out[1])], [(m - s) >> 1 for m, s in zip(mids, out[1])]]
    end = (bits.at + 7) // 8
    if _crc_of(data[at:end], CRC16, 16) != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError(f"CRC-16 of the frame at byte {at} differs")
    return out, end + 2


class Stream:
    """Fields of STREAMINFO and where the frames start."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last = 4, False
        self.block = self.samples = self.depth = self.channels = 0
        while not last:
            kind, length = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + length]
            last, at = bool(kind & 0x80), at + 4 + length
            if kind & 0x7F == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.block = int.from_bytes(body[2:4], "big")
                self.channels, self.depth = ((packed >> 41) & 7) + 1, ((packed >> 36) & 31) + 1
                self.samples, self.md5 = packed & ((1 << 36) - 1), body[18:34]
        if not self.block:
            raise ValueError("the stream has no STREAMINFO")
        self.first = at


def _frame_starts(data: np.ndarray, info: Stream) -> np.ndarray | None:
    """Byte offsets of plain mono frames (8 bit, 192 samples), else None.

    A start is a sync code whose CRC-8 is right and whose frame number follows the last one.
    """
    if info.channels != 1 or info.depth != 8 or info.block != BLOCK or info.samples % BLOCK:
        return None
    spots = np.flatnonzero(data[:-1] == 0xFF)
    spots = spots[data[spots + 1] == 0xF8]
    spots = spots[(spots >= info.first) & (spots + 6 < len(data))]
    spots = spots[((data[spots + 2] & 0xF0) == 0x10) & ((data[spots + 3] & 0xFE) == 0x02)]
    if (data[spots + 2] & 0x0F >= 12).any():
        return None
    count = info.samples // BLOCK
    numbers, sizes = _read_numbers(data, spots)
    crc = np.zeros(len(spots), np.uint32)
    for step in range(4 + (int(sizes.max()) if len(sizes) else 0)):
        byte = data[np.minimum(spots + step, len(data) - 1)]
        crc = np.where(step < 4 + sizes, CRC8[(crc ^ byte) & 0xFF], crc)
    right = crc == data[np.minimum(spots + 4 + sizes, len(data) - 1)]
    spots, numbers = spots[right], numbers[right]
    if len(spots) != count or (numbers != np.arange(count)).any():
        return None
    return spots


def _read_numbers(data: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lead = data[spots + 4].astype(np.int64)
    sizes = np.ones(len(spots), np.int64)
    value = lead.copy()
    for n in range(2, 7):
        rows = lead >= ((0xFF << (8 - n)) & 0xFF)
        sizes[rows] = n
        value[rows] = lead[rows] & (0x7F >> n)
    out = value
    for place in range(1, 6):
        rows = place < sizes
        byte = data[np.minimum(spots + 4 + place, len(data) - 1)].astype(np.int64)
        out = np.where(rows, (out << 6) | (byte & 0x3F), out)
    return out, sizes


def _leading_zeros() -> np.ndarray:
    out = np.zeros(1 << 16, np.int64)
    for bit in range(16):
        out[1 << bit : 2 << bit] = 15 - bit
    out[0] = 16
    return out


ZEROS = _leading_zeros()


class _Windows:
    """32 bits from any bit position of a byte array, for many positions together."""

    def __init__(self, data: np.ndarray):
        wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
        n = len(data) + 3
        self.at = np.zeros(n, np.int64)
        for place in range(5):
            self.at = (self.at << 8) | wide[place : n + place]

    def peek(self, bits: np.ndarray, n) -> np.ndarray:
        """The next n <= 32 bits at each position."""
        return (self.at[bits >> 3] >> (40 - n - (bits & 7))) & ((np.int64(1) << n) - 1)


def _decode_frames(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Samples (BLOCK, frames) of mono 8-bit frames that start at these bytes."""
    windows = _Windows(data)
    _, number_bytes = _read_numbers(data, starts)
    at = (starts + 5 + number_bytes) * 8
    kind = windows.peek(at, 8)
    at = at + 8
    out = np.zeros((BLOCK, len(starts)), np.int64)
    for code in np.unique(kind):
        rows = np.flatnonzero(kind == code)
        if code & 0x81:
            raise _Unusual
        shape = code >> 1
        if shape == 0:
            out[:, rows] = _sign(windows.peek(at[rows], 8), 8)
        elif shape == 1:
            for i in range(BLOCK):
                out[i, rows] = _sign(windows.peek(at[rows] + 8 * i, 8), 8)
        elif 8 <= shape <= 12 or shape >= 32:
            order = int(shape - 8 if shape <= 12 else shape - 31)
            out[:, rows] = _decode_predicted(windows, at[rows], order, shape >= 32)
        else:
            raise ValueError(f"reserved subframe type {shape}")
    return out


class _Unusual(Exception):
    """A frame that only the general way reads."""


def _sign(value: np.ndarray, bits) -> np.ndarray:
    return value - ((value >> (bits - 1)) << bits)


def _decode_predicted(windows: _Windows, at: np.ndarray, order: int, lpc: bool) -> np.ndarray:
    n = len(at)
    out = np.zeros((BLOCK, n), np.int64)
    for i in range(order):
        out[i] = _sign(windows.peek(at, 8), 8)
        at = at + 8
    shift = np.zeros(n, np.int64)
    coefs = np.repeat(np.array(FIXED[order] if not lpc else [0] * order, np.int64)[:, None], n, axis=1)
    if lpc:
        precision = windows.peek(at, 4) + 1
        shift = _sign(windows.peek(at + 4, 5), 5)
        at = at + 9
        for j in range(order):
            coefs[j] = _sign(windows.peek(at, precision), precision)
            at = at + precision
    if (shift < 0).any():
        raise _Unusual
    width = 4 + windows.peek(at, 2)
    partition = BLOCK >> windows.peek(at + 2, 4)
    at = at + 6
    k = np.zeros(n, np.int64)
    residual = np.zeros((BLOCK, n), np.int64)
    firsts = [i for i in range(BLOCK) if i % int(partition.min()) == 0] if n else []
    firsts = {max(order, i) for i in firsts}
    for i in range(order, BLOCK):
        if i in firsts:
            new = (i == order) | (i % partition == 0)
            k = np.where(new, windows.peek(at, width), k)
            if (k == (1 << width) - 1).any():
                raise _Unusual
            at = at + np.where(new, width, 0)
            low_mask = (np.int64(1) << k) - 1
        # 33 bits are at hand: a quotient below 16 and the low bits fit.
        word = (windows.at[at >> 3] << (at & 7)) & 0xFFFFFFFFFF
        zeros = ZEROS[word >> 24]
        code = (zeros << k) | ((word >> (39 - zeros - k)) & low_mask)
        length = zeros + 1 + k
        for column in np.flatnonzero(zeros == 16):
            quotient, bit = 0, int(at[column])
            while not windows.peek(bit, 1):
                quotient, bit = quotient + 1, bit + 1
                if bit >> 3 >= len(windows.at) - 4:
                    raise ValueError("the stream ends inside a frame")
            code[column] = (quotient << k[column]) | windows.peek(bit + 1, k[column])
            length[column] = quotient + 1 + k[column]
        at = at + length
        residual[i] = (code >> 1) ^ -(code & 1)
    if not lpc:
        # Undo the differences: the last order first.
        level = [out[:order]]
        for _ in range(order):
            level.append(np.diff(level[-1], axis=0))
        rest = residual[order:]
        for d in range(order - 1, -1, -1):
            rest = np.cumsum(np.concatenate([level[d][-1:], rest]), axis=0)[1:]
        out[order:] = rest
        return out
    for i in range(order, BLOCK):
        guess = coefs[0] * out[i - 1]
        for j in range(1, order):
            guess += coefs[j] * out[i - 1 - j]
        out[i] = residual[i] + (guess >> shift)
    return out


def _decode_slowly(data: bytes, info: Stream) -> tuple[np.ndarray, list[int]]:
    """Interleaved samples and the byte offset of each frame."""
    at, found, total, offsets = info.first, [], 0, []
    while total < info.samples if info.samples else at < len(data):
        offsets.append(at)
        channels, at = _frame_slowly(data, at, info.depth)
        found.append(np.array(channels, np.int64).T.reshape(-1))
        total += len(channels[0])
    return np.concatenate([*found, np.zeros(0, np.int64)]), offsets


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Samples and frame byte offsets of each stream; ValueError where a check fails."""
    infos = [Stream(s) for s in streams]
    arrays = [np.frombuffer(s, np.uint8) for s in streams]
    starts = [_frame_starts(a, i) for a, i in zip(arrays, infos)]
    out: list = [None] * len(streams)
    plain = [i for i, s in enumerate(starts) if s is not None]
    if plain:
        data = np.concatenate([arrays[i] for i in plain])
        shifts = np.cumsum([0] + [len(arrays[i]) for i in plain])
        at = np.concatenate([starts[i] + shift for i, shift in zip(plain, shifts)])
        after = np.concatenate(
            [
                np.append(starts[i], len(arrays[i]))[1:][: len(starts[i])] + shift
                for i, shift in zip(plain, shifts)
            ]
        )
        sound = True
        found = np.zeros((len(at), BLOCK), np.int16)
        for first in range(0, len(at), FRAMES_AT_ONCE):
            now = slice(first, first + FRAMES_AT_ONCE)
            low, high = int(at[now][0]), int(after[now][-1])
            window, begins = data[low:high], at[now] - low
            lengths = after[now] - at[now] - 2
            check = (window[begins + lengths].astype(np.uint32) << 8) | window[begins + lengths + 1]
            sound = sound and bool((_crc16(window, begins, lengths) == check).all())
            try:
                found[now] = _decode_frames(window, begins).T if sound else 0
            except _Unusual:
                sound = False
        if sound:
            row = 0
            for i in plain:
                count = len(starts[i])
                out[i] = (found[row : row + count].reshape(-1), starts[i])
                row += count
    for i, info in enumerate(infos):
        if out[i] is None:
            samples, offsets = _decode_slowly(streams[i], info)
            out[i] = (samples, np.array(offsets, np.int64))
        width = (info.depth + 7) // 8
        raw = out[i][0].astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
        if any(info.md5) and hashlib.md5(raw).digest() != info.md5:
            raise ValueError("MD5 of the samples differs")
    return out


# --- columns -------------------------------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    """A text's bytes, filled with spaces to a positive multiple of BLOCK."""
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


def _with(batch: pa.RecordBatch, drop: str, names: list[str], arrays: list) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != drop]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *arrays], names=[*keep, *names])


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        raw, offsets = text_buffers(batch.column("text"))
        texts = [raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        media = encode([payload_of(t) for t in texts])
        yield _with(
            batch,
            "text",
            ["n_bytes", "media"],
            [pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary())],
        )


def encode_text_media(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text as a FLAC stream; a null text is empty."""
    wanted = docs.select(F.col(key), F.col("text").cast("string").alias("text"))
    kind = wanted.schema[key].dataType.simpleString()
    return wanted.mapInArrow(_encode_batches, f"`{key}` {kind}, n_bytes long, media binary")


def _media_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        media = batch.column("media").to_pylist()
        for start, stop in slices(np.array([len(m or b"") for m in media], np.int64)):
            yield batch.slice(start, stop - start), media[start:stop]


def block_rows(stream: bytes, samples: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """(block, first_sample, n_samples, byte_offset, pcm) of each frame of a decoded stream."""
    info = Stream(stream)
    step = info.block * info.channels
    pcm, width = samples.astype("<i2").tobytes(), 2 * info.channels
    for number, offset in enumerate(offsets.tolist()):
        part = pcm[number * 2 * step : (number + 1) * 2 * step]
        yield number, number * info.block, len(part) // width, offset, part


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name = None
    for batch, media in _media_slices(batches):
        name = name or next(n for n in batch.schema.names if n != "media")
        present = [i for i, m in enumerate(media) if m is not None]
        rows: list[tuple] = []
        for i, (samples, offsets) in zip(present, decode([media[i] for i in present])):
            rows += [(i, *block) for block in block_rows(media[i], samples, offsets)]
        columns = list(zip(*rows)) if rows else [[] for _ in range(6)]
        keys = batch.column(name).take(pa.array(columns[0], pa.int64()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(columns[1:], kinds)]
        yield pa.RecordBatch.from_arrays(
            [keys, *arrays], names=[name, "block", "first_sample", "n_samples", "byte_offset", "pcm"]
        )


def pcm_blocks(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per frame: its number, first sample, samples, place in the stream, 16-bit PCM.

    ``first_sample`` and ``byte_offset`` make each block seekable. Null media give no blocks;
    fixed-blocksize streams only, as the offsets follow from the frame numbers.
    """
    wanted = media.select(key, "media")
    kind = wanted.schema[key].dataType.simpleString()
    return wanted.mapInArrow(
        _block_batches,
        f"`{key}` {kind}, block long, first_sample long, n_samples long, byte_offset long, pcm binary",
    )


def describe(samples: np.ndarray, frames: int) -> str:
    """Whole-number features: frames, range, sum, energy, sign changes."""
    wide = samples.astype(np.int64)
    turns = int(((wide[1:] < 0) != (wide[:-1] < 0)).sum())
    low, high = (int(wide.min()), int(wide.max())) if len(wide) else (0, 0)
    return (
        f"frames={frames};min={low};max={high};sum={int(wide.sum())};"
        f"energy={int((wide * wide).sum())};turns={turns}"
    )


DIGEST = {
    "payload_bytes": "long",
    "payload_sha256": "string",
    "tail_crc32": "long",
    "media_bytes": "long",
    "media_sha256": "string",
    "feature": "string",
    "n_blocks": "long",
    "seek_sha256": "string",
}


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the block rows of each stream hold, put together again in their order."""
    for batch, media in _media_slices(batches):
        columns: list[list] = [[] for _ in DIGEST]
        for stream, (decoded, offsets) in zip(media, decode(media)):
            blocks = list(block_rows(stream, decoded, offsets))
            samples = np.frombuffer(b"".join(b[-1] for b in blocks), "<i2")
            payload = (samples.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()
            seeks = "".join([f"{first}:{offset}\n" for _, first, _, offset, _ in blocks])
            row = (
                len(payload),
                hashlib.sha256(payload).hexdigest(),
                zlib.crc32(payload[-16:]),
                len(stream),
                hashlib.sha256(stream).hexdigest(),
                describe(samples, len(blocks)),
                len(blocks),
                hashlib.sha256(seeks.encode()).hexdigest(),
            )
            for column, value in zip(columns, row):
                column.append(value)
        kinds = [pa.int64() if kind == "long" else pa.string() for kind in DIGEST.values()]
        yield _with(batch, "media", list(DIGEST), [pa.array(c, k) for c, k in zip(columns, kinds)])


def media_digests(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of each text's stream and of its PCM blocks: payload, features, seek table."""
    media = encode_text_media(docs, key)
    kind = media.schema[key].dataType.simpleString()
    added = ", ".join(f"{name} {kind}" for name, kind in DIGEST.items())
    return media.mapInArrow(_digest_batches, f"`{key}` {kind}, n_bytes long, {added}")


def op2_flac_media(spark, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
