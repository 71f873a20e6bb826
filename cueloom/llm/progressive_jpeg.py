"""Progressive JPEG media columns (operator 1).

``decode`` reads a progressive JPEG: it accumulates spectral-selection and successive-approximation scans into coefficient
arrays, inverse-transforms them in numpy, upsamples chroma by replication and gives a full-resolution RGB tensor.
Everything after the coefficients is integer arithmetic (products of integers below 2**53 in the matrix product), so equal
files give equal pixels on any machine.

``encode`` stores a payload of bytes losslessly in the format's own unit, the quantised coefficient: a block holds 64
bytes, and the quantisation table is all ones. The DC coefficient is the byte, an AC coefficient the byte plus 2, so none
is zero in the first pass. Blocks go to 4:2:0 units of four Y, one Cb and one Cr block; units beyond the payload hold
zero bytes, and a comment segment has the payload's length. The scans are DC then two bands of AC without their lowest
bit, then the lowest bits. The Huffman codes are chosen so that code and magnitude bits together have a fixed length,
which the decoder notices and reads as a matrix of bits; any other table is decoded symbol by symbol.

Null and empty texts give one block of 64 zero bytes. Arithmetic coding, 12-bit samples, sequential files and more than
three components are refused with ValueError.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import documents, per_text

BLOCK = 64
_FIX = 13


def _zigzag() -> np.ndarray:
    """Row-major index of each coefficient in zigzag order."""
    order = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([u * 8 + v for u, v in order])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Fixed-point inverse DCT: a row for each coefficient in zigzag order, a column for each sample."""
    x = np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, math.sqrt(0.5), 1.0) / 2
    both = np.einsum("uy,vx->uvyx", one, one).reshape(64, 64)
    return np.rint(both[ZIGZAG] * (1 << _FIX))


BASIS = _basis()


# --- Huffman tables -------------------------------------------------------------------------------------------------


@dataclass
class Huffman:
    """Canonical code of a DHT segment: ``counts[i]`` codes of length i + 1."""

    counts: list[int]
    symbols: list[int]

    def __post_init__(self) -> None:
        self.codes: dict[tuple[int, int], int] = {}
        self.code_of: dict[int, tuple[int, int]] = {}
        code = at = 0
        for length, n in enumerate(self.counts, 1):
            for _ in range(n):
                self.codes[length, code] = self.symbols[at]
                self.code_of[self.symbols[at]] = code, length
                code, at = code + 1, at + 1
            code <<= 1

    @property
    def fixed_bits(self) -> int:
        """The number of bits that a symbol and its magnitude take, if it is the same for all symbols and no symbol has a
        zero run or ends a block; else 0."""
        totals = {length + s for s, (_, length) in self.code_of.items()}
        return totals.pop() if len(totals) == 1 and max(self.code_of, default=99) < 16 else 0

    def values(self, bits: int) -> np.ndarray:
        """For each bit string of ``fixed_bits`` bits the signed value that it stands for."""
        out = np.zeros(1 << bits, dtype=np.int32)
        for size, (code, length) in self.code_of.items():
            extra = np.arange(1 << size)
            out[(code << size) + extra] = np.where(extra >= 1 << (size - 1), extra, extra - (1 << size) + 1) if size else 0
        return out

    def segment(self, kind: int, slot: int) -> bytes:
        return struct.pack(">BBHB", 0xFF, 0xC4, 19 + len(self.symbols), kind << 4 | slot) + bytes(self.counts) + bytes(self.symbols)


def _fixed_table(sizes: list[int], total: int) -> Huffman:
    """The table in which size s has a code of ``total - s`` bits."""
    counts = [0] * 16
    for s in sizes:
        counts[total - s - 1] += 1
    return Huffman(counts, sorted(sizes, reverse=True))


_DC = _fixed_table(list(range(8)), 8)
_AC = _fixed_table(list(range(1, 9)), 9)
_REFINE = Huffman([0, 0, 0, 15] + [0] * 12, [r << 4 for r in range(15)])


def _bit_strings(table: Huffman, least: int, most: int) -> np.ndarray:
    """Code and magnitude bits, as a number, of the values from least to most; index 0 is least."""
    out = []
    for v in range(least, most + 1):
        size = abs(v).bit_length()
        code, _ = table.code_of.get(size, (0, 0))
        out.append(code << size | (v if v >= 0 else v + (1 << size) - 1))
    return np.array(out, dtype=np.uint16)


_DC_BITS = _bit_strings(_DC, -127, 127).astype(np.uint8)
_AC_BITS = _bit_strings(_AC, 0, 128).astype(">u2")


# --- Encoding -------------------------------------------------------------------------------------------------------


def _stuffed(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes: filled up with ones, and a zero after each 0xFF."""
    if len(bits) % 8:
        bits = np.concatenate([bits, np.ones(-len(bits) % 8, dtype=np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(components: list[int], start: int, end: int, high: int, low: int, data: bytes, dc: int = 0, ac: int = 0) -> bytes:
    head = bytes([len(components), *(x for c in components for x in (c, dc << 4 | ac)), start, end, high << 4 | low])
    return b"\xff\xda" + struct.pack(">H", 2 + len(head)) + head + data


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload``, whose length is a positive multiple of 64."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("the payload's length must be a positive multiple of 64")
    units = -(-len(payload) // (6 * BLOCK))
    across = math.isqrt(units - 1) + 1
    down = -(-units // across)
    blocks = np.zeros(across * down * 6 * BLOCK, dtype=np.uint8)
    blocks[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    mcu = blocks.reshape(down, across, 6, BLOCK)
    luma = mcu[:, :, :4].reshape(down, across, 2, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, BLOCK)
    planes = [luma, mcu[:, :, 4].reshape(-1, BLOCK), mcu[:, :, 5].reshape(-1, BLOCK)]

    first = (mcu[..., 0] >> 1).astype(np.int16).reshape(-1, 6)
    diff = np.empty_like(first)
    diff[:, 1:4] = np.diff(first[:, :4], axis=1)
    diff[:, 0] = first[:, 0] - np.concatenate([[0], first[:-1, 3]])
    diff[:, 4:] = np.diff(first[:, 4:], axis=0, prepend=np.zeros((1, 2), np.int16))
    scans = [_scan([1, 2, 3], 0, 0, 0, 1, _DC_BITS[diff.ravel() + 127].tobytes().replace(b"\xff", b"\xff\x00"))]
    for a, b in ((1, 5), (6, 63)):
        for c, plane in enumerate(planes, 1):
            words = _AC_BITS[(plane[:, a : b + 1].astype(np.uint16) + 2) >> 1]
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8)).reshape(-1, 16)[:, 7:]
            scans.append(_scan([c], a, b, 0, 1, _stuffed(bits.ravel())))
    scans.append(_scan([1, 2, 3], 0, 0, 1, 0, _stuffed(mcu[..., 0].ravel() & 1)))
    for c, plane in enumerate(planes, 1):
        parts = []
        for at in range(0, len(plane), 32767):
            low = plane[at : at + 32767, 1:] & 1
            size = len(low).bit_length() - 1
            code, length = _REFINE.code_of[size << 4]
            head = code << size | len(low) - (1 << size)
            parts += [np.array([head >> i & 1 for i in range(length + size - 1, -1, -1)], dtype=np.uint8), low.ravel()]
        scans.append(_scan([c], 1, 63, 1, 0, _stuffed(np.concatenate(parts)), ac=1))
    head = [
        b"\xff\xd8",
        b"\xff\xfe" + struct.pack(">HQ", 10, len(payload)),
        b"\xff\xdb" + struct.pack(">HB", 67, 0) + b"\x01" * 64,
        b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]),
        _DC.segment(0, 0),
        _AC.segment(1, 0),
        _REFINE.segment(1, 1),
    ]
    if max(down, across) * 16 > 65535:
        raise ValueError("the payload is too long for one image")
    return b"".join([*head, *scans, b"\xff\xd9"])


# --- Decoding -------------------------------------------------------------------------------------------------------


@dataclass
class Component:
    h: int
    v: int
    quant: int
    across: int = 0  # blocks, filled up to whole units
    down: int = 0
    own_across: int = 0  # blocks that a scan of this component alone has
    own_down: int = 0
    coefficients: np.ndarray = field(default=None, repr=False)  # in zigzag order


class _Bits:
    """Bits of one entropy-coded segment without its stuffing."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), dtype=np.uint8))
        self.at = 0

    def take(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("a scan ends too early")
        self.at += n
        return out

    def number(self, n: int) -> int:
        x = 0
        for b in self.take(n).tolist():
            x = x << 1 | b
        return x

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(self.take(1)[0])
            if (s := table.codes.get((length, code))) is not None:
                return s
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        x = self.number(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comment: bytes

    def rgb(self) -> np.ndarray:
        """Full-resolution samples, height x width x 3 (uint8)."""
        tall, wide = max(c.v for c in self.components), max(c.h for c in self.components)
        planes = []
        for c in self.components:
            sums = (c.coefficients.astype(np.float64) * self.quants[c.quant]) @ BASIS
            s = ((sums.astype(np.int64) + (1 << (_FIX - 1))) >> _FIX) + 128
            s = np.clip(s, 0, 255).astype(np.int32).reshape(c.down, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(c.down * 8, c.across * 8)
            if tall // c.v > 1:
                s = np.repeat(s, tall // c.v, axis=0)
            if wide // c.h > 1:
                s = np.repeat(s, wide // c.h, axis=1)
            planes.append(s[: self.height, : self.width])
        if len(planes) == 1:
            planes *= 3
            return np.stack(planes, axis=2).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.empty((self.height, self.width, 3), dtype=np.uint8)
        out[..., 0] = np.clip(y + ((91881 * cr + 32768) >> 16), 0, 255)
        out[..., 1] = np.clip(y + ((-22554 * cb - 46802 * cr + 32768) >> 16), 0, 255)
        out[..., 2] = np.clip(y + ((116130 * cb + 32768) >> 16), 0, 255)
        return out


def decode(data: bytes) -> Image:
    """Coefficients of a progressive JPEG after all its scans."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quants, tables, comment, interval = 2, {}, {}, b"", 0
    image: Image | None = None
    by_id: dict[int, Component] = {}
    while at + 4 <= len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, slot = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quants[slot] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                tables[body[0]] = Huffman(counts, list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or n not in (1, 3):
                raise ValueError("only 8-bit files of one or three components are read")
            image = Image(width, height, [], quants, b"")
            for i in range(n):
                ident, hv, q = body[6 + 3 * i : 9 + 3 * i]
                by_id[ident] = Component(hv >> 4, hv & 15, q)
                image.components.append(by_id[ident])
            tall, wide = max(c.v for c in by_id.values()), max(c.h for c in by_id.values())
            for c in by_id.values():
                c.across, c.down = -(-width // (8 * wide)) * c.h, -(-height // (8 * tall)) * c.v
                c.own_across, c.own_down = -(-(-(-width * c.h // wide)) // 8), -(-(-(-height * c.v // tall)) // 8)
                c.coefficients = np.zeros((c.across * c.down, 64), dtype=np.int32)
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan comes before the frame")
            end = at
            while (end := data.find(b"\xff", end)) >= 0 and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                end += 2
            end = len(data) if end < 0 else end
            _read_scan(body, data[at:end], by_id, tables, interval)
            at = end
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only progressive Huffman-coded files are read")
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def _read_scan(head: bytes, data: bytes, by_id: dict[int, Component], tables: dict[int, Huffman], interval: int) -> None:
    n = head[0]
    members = [(by_id[head[1 + 2 * i]], head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15) for i in range(n)]
    start, end, approx = head[1 + 2 * n : 4 + 2 * n]
    high, low = approx >> 4, approx & 15
    blocks, owner = _order(members)
    units = len(blocks) // sum(c.h * c.v for c, _, _ in members) if n > 1 else len(blocks)
    per_unit = len(blocks) // max(1, units)
    segments = _segments(data) if interval else [data]
    step = (interval or units) * per_unit
    for i, segment in enumerate(segments):
        part, own = blocks[i * step : (i + 1) * step], owner[i * step : (i + 1) * step]
        bits = _Bits(segment)
        if start == 0 and not high:
            _dc_first(bits, part, own, members, tables, low)
        elif start == 0:
            for m, (c, _, _) in enumerate(members):
                c.coefficients[part[own == m], 0] |= bits.bits[: len(part)][own == m].astype(np.int32) << low
        elif not high:
            _ac_first(bits, part, members[0][0], tables[0x10 | members[0][2]], start, end, low)
        else:
            _ac_refine(bits, part, members[0][0], tables[0x10 | members[0][2]], start, end, low)


def _segments(data: bytes) -> list[bytes]:
    out, at, start = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0:
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at += 2
    return [*out, data[start:]]


def _order(members: list[tuple[Component, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Block numbers in the order of a scan, and the member that each belongs to."""
    if len(members) == 1:
        c = members[0][0]
        grid = np.arange(c.across * c.down).reshape(c.down, c.across)[: c.own_down, : c.own_across]
        return grid.ravel(), np.zeros(grid.size, dtype=np.int64)
    parts, owner = [], []
    for m, (c, _, _) in enumerate(members):
        grid = np.arange(c.across * c.down).reshape(c.down // c.v, c.v, c.across // c.h, c.h).transpose(0, 2, 1, 3).reshape(-1, c.v * c.h)
        parts.append(grid)
        owner.append(np.full(grid.shape, m))
    return np.concatenate(parts, axis=1).ravel(), np.concatenate(owner, axis=1).ravel()


def _fixed_values(bits: _Bits, table: Huffman, n: int) -> np.ndarray | None:
    """n values, where code and magnitude have a fixed number of bits; else None."""
    width = table.fixed_bits
    if not width or width > 16:
        return None
    rows = bits.take(n * width).reshape(n, width)
    if width == 8:
        index = np.packbits(rows, axis=None)
    else:
        padded = np.zeros((n, 16), dtype=np.uint8)
        padded[:, 16 - width :] = rows
        index = np.packbits(padded, axis=None).view(">u2")
    return table.values(width)[index]


def _dc_first(bits: _Bits, part: np.ndarray, own: np.ndarray, members: list, tables: dict[int, Huffman], low: int) -> None:
    used = [tables[d] for _, d, _ in members]
    diffs = _fixed_values(bits, used[0], len(part)) if all(t is used[0] for t in used) else None
    if diffs is None:
        diffs = np.array([bits.signed(bits.symbol(used[m])) for m in own.tolist()], dtype=np.int32)
    for m, (c, _, _) in enumerate(members):
        mine = own == m
        c.coefficients[part[mine], 0] = np.cumsum(diffs[mine]) << low


def _ac_first(bits: _Bits, part: np.ndarray, c: Component, table: Huffman, start: int, end: int, low: int) -> None:
    width = end - start + 1
    if 0 not in table.code_of and (values := _fixed_values(bits, table, len(part) * width)) is not None:
        c.coefficients[part, start : end + 1] = values.reshape(-1, width) << low
        return
    skip = 0
    for b in part.tolist():
        if skip:
            skip -= 1
            continue
        k = start
        while k <= end:
            run, size = divmod(bits.symbol(table), 16)
            if size:
                k += run
                c.coefficients[b, k] = bits.signed(size) << low
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) + bits.number(run) - 1
                break


def _ac_refine(bits: _Bits, part: np.ndarray, c: Component, table: Huffman, start: int, end: int, low: int) -> None:
    def correct(rows: np.ndarray, first: int) -> None:
        """A correction bit for each coefficient from ``first`` on that isn't zero, block by block."""
        band = c.coefficients[rows, first : end + 1]
        known = band != 0
        bit = bits.take(int(known.sum())).astype(np.int32) << low
        band[known] += np.where(band[known] < 0, -bit, bit)
        c.coefficients[rows, first : end + 1] = band

    i, n = 0, len(part)
    while i < n:
        b, k = part[i], start
        while k <= end:
            run, size = divmod(bits.symbol(table), 16)
            if not size and run < 15:
                blocks = (1 << run) + bits.number(run)
                if k > start:
                    correct(part[i : i + 1], k)
                    correct(part[i + 1 : i + blocks], start)
                else:
                    correct(part[i : i + blocks], start)
                i += blocks - 1
                break
            value = (1 if bits.number(1) else -1) << low if size else 0
            while k <= end:
                x = int(c.coefficients[b, k])
                if x:
                    if bits.number(1):
                        c.coefficients[b, k] += (1 if x > 0 else -1) << low
                elif run == 0:
                    c.coefficients[b, k] = value
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        i += 1


def payload_of(image: Image) -> bytes:
    """The bytes that ``encode`` stored in the coefficients."""
    luma, cb, cr = image.components
    mcu = np.empty((cb.down, cb.across, 6, BLOCK), dtype=np.uint8)
    mcu[:, :, :4] = luma.coefficients.reshape(cb.down, 2, cb.across, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(cb.down, cb.across, 4, BLOCK)
    mcu[:, :, 4] = cb.coefficients.reshape(cb.down, cb.across, BLOCK)
    mcu[:, :, 5] = cr.coefficients.reshape(cb.down, cb.across, BLOCK)
    mcu[..., 1:] -= 2
    return mcu.tobytes()[: struct.unpack(">Q", image.comment)[0]]


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def feature(rgb: np.ndarray) -> str:
    """Size, sums of the three channels and CRC-32 of the samples."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{sums[0]}:{sums[1]}:{sums[2]}:{zlib.crc32(rgb):08x}"


# --- Columns --------------------------------------------------------------------------------------------------------


def encode_media(df: DataFrame, text: str = "text") -> DataFrame:
    """Appends ``media binary``: each text's bytes, filled up to a positive multiple of 64, as a progressive JPEG."""
    return per_text(df, lambda: lambda texts: {"media": [encode(padded(t)) for t in texts]}, "media binary", text)


def decode_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Appends ``height``, ``width`` and ``rgb binary`` (row-major height x width x 3 samples) of progressive JPEGs. A null,
    empty or damaged file gives nulls."""

    def tensor(data: bytes) -> tuple:
        try:
            rgb = decode(data).rgb()
        except (ValueError, IndexError, KeyError, struct.error):
            return None, None, None
        return rgb.shape[0], rgb.shape[1], rgb.tobytes()

    def run(files: list[bytes]) -> dict:
        made = [tensor(x) for x in files]
        return {k: [m[i] for m in made] for i, k in enumerate(("height", "width", "rgb"))}

    return per_text(df, lambda: run, "height int, width int, rgb binary", media)


def media_digests(df: DataFrame, text: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back, and appends digests of both, the RGB tensor (row-major height x width x
    3 samples) and a feature of it."""

    def one(t: bytes) -> tuple:
        media = encode(padded(t))
        image = decode(media)
        back, rgb = payload_of(image), image.rgb()
        return len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(rgb), rgb.shape[0], rgb.shape[1], rgb.tobytes()

    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb")

    def run(texts: list[bytes]) -> dict:
        made = [one(t) for t in texts]
        return {k: [m[i] for m in made] for i, k in enumerate(names)}

    return per_text(df, lambda: run, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary", text)


def op1_media_jpeg(spark, sf_dir):
    return media_digests(documents(spark, sf_dir, "doc_id", "text")).drop("text")
