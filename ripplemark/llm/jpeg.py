"""Progressive JPEG: a reader for its scans, and a writer that stores bytes losslessly as coefficients.

Reading follows the format: every scan adds a band of coefficients (spectral selection) or one more bit
of them (successive approximation) to one coefficient array for each component. The arrays then go
through the inverse transform as one matrix product, chroma is repeated to full resolution, and colours
are converted to RGB. The inverse transform works in scaled integers, which float64 holds exactly, so the
same file gives the same pixels however it is batched.

Writing puts 64 bytes in each luma block: byte 0 in the DC coefficient (256 + b), the others in AC
coefficients of size class 8, whose raw bits are the byte. Scans: DC and AC bands without their last
bit, then refinements with it. A chroma block's DC holds the sum of the bytes that its luma blocks
hold. Scans use codes with one symbol, so all fields have fixed widths, and both directions run as
array operations; files with other codes are read bit by bit.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: markers.
SOI, EOI, SOF2, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE
#: Largest side in blocks.
MOST_BLOCKS = 8191
#: Bits of the scaled transform.
SCALE = 13


def zigzag() -> np.ndarray:
    """Place in a block, row by row, of each coefficient: diagonals in alternating directions."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()


def _basis() -> np.ndarray:
    """Pixels of each coefficient in zigzag order, scaled to integers."""
    wave = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.5) if u == 0 else 1) / 2 for x in range(8)] for u in range(8)])
    full = np.einsum("uy,vx->uvyx", wave, wave).reshape(64, 64)
    return np.rint(full[ZIGZAG] * (1 << SCALE))


BASIS = _basis()


@dataclass
class Component:
    number: int
    h: int
    v: int
    table: int
    across: int = 0
    down: int = 0
    #: blocks x 64, in zigzag order
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes


# -- writing --


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int, slot: int, bits: int, symbol: int) -> bytes:
    counts = bytearray(16)
    counts[bits - 1] = 1
    return _segment(DHT, bytes([kind << 4 | slot]) + bytes(counts) + bytes([symbol]))


def _scan(component: int, dc: int, ac: int, low: int, high: int, before: int, now: int) -> bytes:
    return _segment(SOS, bytes([1, component, dc << 4 | ac, low, high, before << 4 | now]))


def _dc_first(values: np.ndarray) -> bytes:
    """DC values 256 to 511 without their last bit, each restarted so that it stands for itself."""
    n = len(values)
    half = (values >> 1).astype(np.uint8)
    fields = np.empty((n, 4), np.uint8)
    fields[:, 0], fields[:, 1], fields[:, 2], fields[:, 3] = 0, half, 0xFF, 0xD0 + np.arange(n) % 8
    flat = fields.ravel()[:-2]
    full = np.flatnonzero(half == 0xFF)
    return (np.insert(flat, 4 * full + 2, 0) if len(full) else flat).tobytes()


def _bits(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]) if pad else bits).tobytes().replace(b"\xff", b"\xff\x00")


_HEAD_TABLES = _one_code(0, 0, 8, 8) + _one_code(1, 0, 1, 7) + _one_code(1, 1, 1, 0)
_QUANT = _segment(DQT, bytes([0]) + bytes([1] * 64))
_RESTART, _NO_RESTART = _segment(DRI, struct.pack(">H", 1)), _segment(DRI, struct.pack(">H", 0))


def write_payload(payload: bytes, comment: bytes = b"") -> bytes:
    """A progressive 4:2:0 JPEG that holds a payload of a positive multiple of 64 bytes."""
    n = len(payload) // 64
    if n < 1 or len(payload) % 64:
        raise ValueError("a payload has a positive multiple of 64 bytes")
    across = min(MOST_BLOCKS, math.ceil(math.sqrt(n)))
    down = -(-n // across)
    if down > MOST_BLOCKS:
        raise ValueError("the payload is too long for one picture")
    luma = np.zeros((down * across, 64), np.uint8)
    luma[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    sums = luma.sum(axis=1, dtype=np.int64).reshape(down, across)
    wide = np.zeros((down + down % 2, across + across % 2), np.int64)
    wide[:down, :across] = sums
    chroma = (wide.reshape(len(wide) // 2, 2, -1, 2).sum(axis=(1, 3)) % 256).ravel()
    planes = {1: luma[:, 0].astype(np.int64) + 256, 2: chroma + 256, 3: 511 - chroma}
    frame = struct.pack(">BHHB", 8, 8 * down, 8 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(COM, struct.pack(">Q", n) + comment), _QUANT, _segment(SOF2, frame), _HEAD_TABLES, _RESTART]
    for c, values in planes.items():
        out += [_scan(c, 0, 0, 0, 0, 0, 1), _dc_first(values)]
    out.append(_NO_RESTART)
    half = luma >> 1  # a 1-bit code, then 7 bits that are the byte without its last bit
    out += [_scan(1, 0, 0, 1, 5, 0, 1), half[:, 1:6].tobytes(), _scan(1, 0, 0, 6, 63, 0, 1), half[:, 6:].tobytes()]
    for c, values in planes.items():
        out += [_scan(c, 0, 0, 0, 0, 1, 0), _bits((values & 1).astype(np.uint8))]
    last = (luma & 1) ^ (luma < 128)
    last[:, 0] = 0  # the end-of-band code, then a bit for each coefficient
    out += [_scan(1, 0, 1, 1, 63, 1, 0), _bits(last.ravel()), b"\xff\xd9"]
    return b"".join(out)


# -- reading --


class _Codes:
    def __init__(self, counts: bytes, symbols: bytes):
        self.only = (next(i + 1 for i, c in enumerate(counts) if c), symbols[0]) if len(symbols) == 1 else None
        self.read: dict[tuple[int, int], int] = {}
        code = at = 0
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                self.read[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1


class _BitReader:
    """Bits of one scan; its restart intervals are read one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at, self.bit = data, 0, 0

    def one(self) -> int:
        if self.at >= len(self.data):
            raise ValueError("a scan ends too early")
        out = self.data[self.at] >> (7 - self.bit) & 1
        self.bit += 1
        if self.bit == 8:
            self.bit, self.at = 0, self.at + 1
        return out

    def many(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.one()
        return out

    def symbol(self, codes: _Codes) -> int:
        code = length = 0
        while length < 16:
            code, length = code << 1 | self.one(), length + 1
            if (length, code) in codes.read:
                return codes.read[length, code]
        raise ValueError("a code is not in the table")

    def signed(self, n: int) -> int:
        v = self.many(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _entropy_end(data: bytes, at: int) -> int:
    """Where the entropy-coded data that begin here end."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("the file has no end")
        nxt = data[at + 1]
        if nxt and not 0xD0 <= nxt <= 0xD7:
            return at
        at += 2


def _scan_blocks(c: Component, p: Picture, hmax: int, vmax: int) -> tuple[int, int]:
    """Blocks across and down of a component in a scan by itself."""
    return -(-(-(-p.width * c.h // hmax)) // 8), -(-(-(-p.height * c.v // vmax)) // 8)


def _fixed_scan(own: Component, at: np.ndarray, raw: bytes, dc: _Codes | None, ac: _Codes | None, low: int, high: int, before: int, now: int, restart: int) -> bool:
    """Read a scan whose fields all have the same width, as arrays; False if it isn't one."""
    n, co = len(at), own.coefficients
    if low == 0:
        if before:
            if restart:
                return False
            bits = np.unpackbits(np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8))[:n]
            co[at, 0] |= bits.astype(np.int32) << now
            return len(bits) == n
        if dc is None or dc.only is None or dc.only[0] + dc.only[1] != 16 or dc.only[0] != 8 or restart != 1:
            return False
        plain = np.frombuffer(raw.replace(b"\xff\x00", b"\xff") + b"\xff\xd0", np.uint8)
        if len(plain) != 4 * n:
            return False
        size = dc.only[1]
        v = plain.reshape(n, 4)[:, 1].astype(np.int32)
        co[at, 0] = np.where(v >> (size - 1), v, v - (1 << size) + 1) << now
        return True
    width = high - low + 1
    if ac is None or ac.only is None or restart:
        return False
    if not before:
        bits, symbol = ac.only
        if symbol >> 4 or bits + (symbol & 15) != 8 or bits != 1:
            return False
        plain = np.frombuffer(raw, np.uint8)
        if len(plain) != n * width or (plain & 0x80).any():
            return False
        size = symbol & 15
        v = plain.reshape(n, width).astype(np.int32)
        co[at, low : high + 1] = np.where(v >> (size - 1), v, v - (1 << size) + 1) << now
        return True
    if ac.only != (1, 0) or (width + 1) % 8 or not (co[at, low : high + 1] != 0).all():
        return False
    bits = np.unpackbits(np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8))
    if len(bits) != n * (width + 1):
        return False
    bits = bits.reshape(n, width + 1)
    if bits[:, 0].any():
        return False
    band = co[at, low : high + 1]
    co[at, low : high + 1] = band + np.sign(band) * (bits[:, 1:].astype(np.int32) << now)
    return True


def _general_scan(units: list[list[tuple[Component, int]]], raw: bytes, tables: dict, low: int, high: int, before: int, now: int, restart: int) -> None:
    """Read a scan bit by bit. units: for each unit between restarts' counts, the blocks (component, block) in order."""
    intervals, start, at = [], 0, 0
    while (at := raw.find(b"\xff", at)) >= 0:
        if 0xD0 <= raw[at + 1] <= 0xD7:
            intervals.append(raw[start:at])
            start = at + 2
        at += 2
    intervals.append(raw[start:])
    per = restart or len(units)
    for k, part in enumerate(intervals):
        reader = _BitReader(part.replace(b"\xff\x00", b"\xff"))
        previous: dict[int, int] = {}
        run = 0
        for unit in units[k * per : (k + 1) * per]:
            for c, block in unit:
                co = c.coefficients[block]
                dc, ac = tables[c.number]
                if low == 0:
                    if before:
                        co[0] |= reader.one() << now
                    else:
                        previous[c.number] = previous.get(c.number, 0) + reader.signed(reader.symbol(dc))
                        co[0] = previous[c.number] << now
                elif before:
                    run = _refine(reader, co, ac, low, high, now, run)
                else:
                    run = _band(reader, co, ac, low, high, now, run)


def _band(reader: _BitReader, co: np.ndarray, ac: _Codes, low: int, high: int, now: int, run: int) -> int:
    if run:
        return run - 1
    k = low
    while k <= high:
        r, s = divmod(reader.symbol(ac), 16)
        if s:
            k += r
            co[k] = reader.signed(s) * (1 << now)
            k += 1
        elif r < 15:
            return (1 << r) + reader.many(r) - 1
        else:
            k += 16
    return 0


def _refine(reader: _BitReader, co: np.ndarray, ac: _Codes, low: int, high: int, now: int, run: int) -> int:
    def correct(k: int) -> None:
        if reader.one():
            co[k] += (1 << now) if co[k] > 0 else -(1 << now)

    k = low
    while k <= high and not run:
        r, s = divmod(reader.symbol(ac), 16)
        value = 0
        if s:
            value = (1 << now) if reader.one() else -(1 << now)
        elif r < 15:
            run = (1 << r) + reader.many(r)
            break
        while k <= high:
            if co[k]:
                correct(k)
            elif r:
                r -= 1
            else:
                if value:
                    co[k] = value
                k += 1
                break
            k += 1
    if run:
        while k <= high:
            if co[k]:
                correct(k)
            k += 1
        run -= 1
    return run


def read(data: bytes, fixed: bool = True) -> Picture:
    """The coefficient arrays of a progressive JPEG. fixed: read scans of fixed-width fields as arrays."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, restart, comment = 2, 0, b""
    quant: dict[int, np.ndarray] = {}
    codes: dict[tuple[int, int], _Codes] = {}
    picture: Picture | None = None
    hmax = vmax = 1
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == EOI:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == COM:
            comment = body
        elif marker == DQT:
            while body:
                wide, slot = body[0] >> 4, body[0] & 15
                n = 64 * (1 + wide)
                quant[slot] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15] = _Codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == DRI:
            restart = struct.unpack(">H", body)[0]
        elif marker == SOF2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hmax, vmax = max(c.h for c in parts), max(c.v for c in parts)
            for c in parts:
                c.across, c.down = -(-width // (8 * hmax)) * c.h, -(-height // (8 * vmax)) * c.v
                c.coefficients = np.zeros((c.across * c.down, 64), np.int32)
            picture = Picture(width, height, parts, quant, comment)
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only progressive Huffman-coded files are read")
        elif marker == SOS:
            if picture is None:
                raise ValueError("a scan stands before the frame")
            own = [next(c for c in picture.components if c.number == body[1 + 2 * i]) for i in range(body[0])]
            tables = {c.number: (codes.get((0, body[2 + 2 * i] >> 4)), codes.get((1, body[2 + 2 * i] & 15))) for i, c in enumerate(own)}
            low, high, bits = body[1 + 2 * body[0] :][:3]
            end = _entropy_end(data, at)
            raw, at = data[at:end], end
            if len(own) == 1:
                c = own[0]
                across, down = _scan_blocks(c, picture, hmax, vmax)
                places = (np.arange(down)[:, None] * c.across + np.arange(across)).ravel()
                if fixed and _fixed_scan(c, places, raw, *tables[c.number], low, high, bits >> 4, bits & 15, restart):
                    continue
                units = [[(c, b)] for b in places.tolist()]
            else:
                units = [
                    [(c, (my * c.v + y) * c.across + mx * c.h + x) for c in own for y in range(c.v) for x in range(c.h)]
                    for my in range(-(-picture.height // (8 * vmax)))
                    for mx in range(-(-picture.width // (8 * hmax)))
                ]
            _general_scan(units, raw, tables, low, high, bits >> 4, bits & 15, restart)
    if picture is None:
        raise ValueError("the file has no frame")
    picture.comment = comment
    return picture


def payload_of(picture: Picture) -> bytes:
    """The payload that write_payload stored."""
    n = struct.unpack_from(">Q", picture.comment)[0]
    luma = picture.components[0]
    across = -(-picture.width // 8)
    co = luma.coefficients.reshape(luma.down, luma.across, 64)[: -(-picture.height // 8), :across].reshape(-1, 64)[:n]
    out = np.where(co < 0, co + 255, co)
    out[:, 0] = co[:, 0] - 256
    return out.astype(np.uint8).tobytes()


def _plane(c: Component, quant: np.ndarray) -> np.ndarray:
    """Samples of a component: inverse transform in exact scaled integers."""
    pixels = (c.coefficients * quant).astype(np.float64) @ BASIS
    samples = np.clip((pixels.astype(np.int64) + (1 << (SCALE - 1)) >> SCALE) + 128, 0, 255).astype(np.uint8)
    return samples.reshape(c.down, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.down, 8 * c.across)


def rgb(picture: Picture) -> np.ndarray:
    """height x width x 3 samples at full resolution."""
    hmax, vmax = max(c.h for c in picture.components), max(c.v for c in picture.components)
    planes = []
    for c in picture.components:
        plane = _plane(c, picture.quant[c.table])
        full = plane.repeat(vmax // c.v, axis=0).repeat(hmax // c.h, axis=1) if (c.v, c.h) != (vmax, hmax) else plane
        planes.append(full[: picture.height, : picture.width])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, axis=2)
    # integer weights with 16 bits after the point
    y = planes[0].astype(np.int32) * 65536 + 32768
    cb, cr = planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for i, (b, r) in enumerate(((0, 91881), (-22554, -46802), (116130, 0))):
        out[..., i] = np.clip((y + b * cb + r * cr) >> 16, 0, 255)
    return out
