"""Media columns as progressive JPEG.

A payload byte is stored in one DCT coefficient, 192 bytes to a 4:4:4 unit of three blocks. The encoder writes DC and AC in
separate scans (spectral selection), high bits before the lowest one (successive approximation). The decoder reads any
Huffman-coded progressive file of 8 bits with one or three components: it gathers all scans in coefficient arrays, inverts the
transform in numpy, repeats chroma to full size and gives an RGB tensor. Where a scan's codes turn out to be of one length,
which it verifies on every one, it reads them all at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_slices

UNIT = 192
#: Rows of units a JPEG can have at most; stored images are as narrow as that allows, so that hardly a unit is left empty.
MOST_ROWS = 8191
#: Coefficients hold byte + AC_BASE, or +-(byte + DC_BASE) by turns, so that magnitudes, and DC steps, have one length each.
AC_BASE, DC_BASE = 256, 512


def _zigzag() -> np.ndarray:
    """Natural position of each coefficient in zigzag order: along anti-diagonals, up and down by turns."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_ANGLE = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8)[None, :] * np.pi / 16) / 2
_ANGLE[:, 0] *= 0.5**0.5
#: samples = IDCT @ coefficients in zigzag order
IDCT = np.einsum("yv,xu->yxvu", _ANGLE, _ANGLE).reshape(64, 64)[:, ZIGZAG].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, slot: int, symbols: list[tuple[int, int]]) -> bytes:
    """DHT body for symbols (length, symbol) by length."""
    counts = [sum(1 for n, _ in symbols if n == k) for k in range(1, 17)]
    return bytes([kind << 4 | slot, *counts, *(s for _, s in symbols)])


def _bits(rows: np.ndarray, width: int) -> np.ndarray:
    """Each value's `width` bits, high first."""
    wide = rows.astype(">u2").view(np.uint8).reshape(-1, 2)
    return np.unpackbits(wide, axis=1)[:, 16 - width :]


def _coded(bits: np.ndarray) -> bytes:
    """Bits padded with ones and stuffed."""
    pad = -len(bits) % 8
    if pad:
        bits = np.concatenate([bits, np.ones(pad, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")


def _scan(components: list[int], first: int, last: int, high: int, low: int, bits: np.ndarray, table: int = 0) -> bytes:
    head = bytes([len(components), *(x for c in components for x in (c, table)), first, last, high << 4 | low])
    return _segment(0xDA, head) + _coded(bits)


_ONES = _segment(0xDB, bytes([0] + [1] * 64))
#: DC steps of 9 or 10 bits; AC magnitudes of 8 bits; end-of-band runs of 2^0 to 2^14 blocks.
_TABLES = _segment(0xC4, _huffman(0, 0, [(2, 9), (2, 10)])) + _segment(0xC4, _huffman(1, 0, [(1, 8)])) + _segment(0xC4, _huffman(1, 1, [(4, n << 4) for n in range(15)]))


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold the payload, a positive multiple of UNIT bytes."""
    units = len(payload) // UNIT
    wide = -(-units // MOST_ROWS)
    high = -(-units // wide)
    data = np.frombuffer(payload, np.uint8)
    if units < wide * high:
        data = np.concatenate([data, np.zeros((wide * high - units) * UNIT, np.uint8)])
    n = wide * high
    blocks = data.reshape(n, 3, 64).astype(np.int32)
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _ONES]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))))
    out.append(_TABLES)
    sign = np.where(np.arange(n) % 2, -1, 1)[:, None]
    dc = sign * (blocks[:, :, 0] + DC_BASE)
    step = np.diff(dc >> 1, axis=0)
    code = np.where(step > 0, step, step + 1023)
    # a component's first code has 2 + 9 bits, all others 2 + 10: code words are 00 and 01
    bits = np.concatenate([_bits((dc[0] >> 1), 11).ravel(), _bits((code | 1 << 10).ravel(), 12).ravel()])
    out.append(_scan([1, 2, 3], 0, 0, 0, 1, bits))
    out.append(_scan([1, 2, 3], 0, 0, 1, 0, (dc & 1).astype(np.uint8).ravel()))
    for c in range(3):
        ac = blocks[:, c, 1:] + AC_BASE
        out.append(_scan([c + 1], 1, 63, 0, 1, _bits((ac >> 1).ravel(), 9).ravel()))
        low = (ac & 1).astype(np.uint8)
        parts = []
        for at in range(0, n, 1 << 14):  # runs of blocks without new coefficients, each with its blocks' lowest bits
            run = min(n - at, 1 << 14)
            k = run.bit_length() - 1
            parts += [_bits(np.array([k]), 4)[0], _bits(np.array([run - (1 << k)]), 16)[0, 16 - k :], low[at : at + run].ravel()]
        out.append(_scan([c + 1], 1, 63, 1, 0, np.concatenate(parts), table=1))
    return b"".join(out) + b"\xff\xd9"


class _Reader:
    """Bits of one entropy-coded segment."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        end = self.at + n
        if end > len(self.bits):
            raise ValueError("scan ends early")
        for b in self.bits[self.at : end].tolist():
            v = v << 1 | b
        self.at = end
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n, b in enumerate(self.bits[self.at : self.at + 16].tolist(), 1):
            code = code << 1 | b
            if (s := table.get((n, code))) is not None:
                self.at += n
                return s
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1

    def peek(self, table: dict[tuple[int, int], int]) -> tuple[int, int, int]:
        """Length, code and symbol of what comes next, which stays unread; zeros if nothing fits."""
        code = 0
        for n, b in enumerate(self.bits[self.at : self.at + 16].tolist(), 1):
            code = code << 1 | b
            if (s := table.get((n, code))) is not None:
                return n, code, s
        return 0, 0, 0

    def rows(self, n: int, width: int) -> np.ndarray | None:
        """The next n groups of width bits, if there are as many."""
        end = self.at + n * width
        return self.bits[self.at : end].reshape(n, width) if end <= len(self.bits) else None


def _numbers(bits: np.ndarray) -> np.ndarray:
    return bits.astype(np.int32) @ (1 << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.int32))


class Decoder:
    """Coefficients (in zigzag order) of a progressive JPEG's components."""

    def __init__(self, data: bytes):
        self.tables: dict[int, dict[tuple[int, int], int]] = {}
        self.quant: dict[int, np.ndarray] = {}
        self.comment = b""
        self.restart = 0
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        while at < len(data):
            marker = data[at + 1]
            if marker == 0xD9:
                return
            n = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    counts, total = body[1:17], sum(body[1:17])
                    table, code, k = {}, 0, 17
                    for length, count in enumerate(counts, 1):
                        for _ in range(count):
                            table[length, code] = body[k]
                            code, k = code + 1, k + 1
                        code <<= 1
                    self.tables[body[0]] = table
                    body = body[17 + total :]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, *range(0xC5, 0xD0)):
                raise ValueError("only Huffman-coded progressive frames are read")
            elif marker == 0xDA:
                end = at
                while True:  # to the next marker that is neither a stuffed byte nor a restart
                    end = data.index(b"\xff", end)
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                    else:
                        break
                self._scan(body, data[at:end])
                at = end

    def _frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8:
            raise ValueError("only 8 bits a sample are read")
        self.parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
        self.h, self.v = max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values())
        self.wide, self.high = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        self.coefficients = {c: np.zeros((self.high * v * self.wide * h, 64), np.int32) for c, (h, v, _) in self.parts.items()}

    def _order(self, ids: list[int]) -> list[list[tuple[int, int]]]:
        """The blocks (component, index) of each unit of a scan."""
        if len(ids) == 1:
            c = ids[0]
            h, v, _ = self.parts[c]
            across, down = -(-self.width * h // (8 * self.h)), -(-self.height * v // (8 * self.v))
            return [[(c, y * self.wide * h + x)] for y in range(down) for x in range(across)]
        return [[(c, (y * v + j) * self.wide * h + x * h + i) for c in ids for h, v, _ in [self.parts[c]] for j in range(v) for i in range(h)] for y in range(self.high) for x in range(self.wide)]

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        ids = [body[1 + 2 * k] for k in range(n)]
        dc = {body[1 + 2 * k]: self.tables.get(body[2 + 2 * k] >> 4) for k in range(n)}
        ac = self.tables.get(0x10 | body[2] & 15)
        first, last, low, refine = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] & 15, body[3 + 2 * n] >> 4
        whole = self.restart == 0 and self.width % (8 * self.h) == 0 and self.height % (8 * self.v) == 0
        if whole and (n == 1 or self.h == self.v == 1) and self._at_once([self.coefficients[c] for c in ids], _Reader(data), dc[ids[0]] if len({id(t) for t in dc.values()}) == 1 else None, ac, first, last, low, refine):
            return
        units = self._order(ids)
        step = self.restart or len(units)
        cuts, at = [], 0
        if self.restart:
            while (at := data.find(b"\xff", at)) >= 0:
                if 0xD0 <= data[at + 1] <= 0xD7:
                    cuts.append(at)
                at += 2
        starts, ends = [0, *(c + 2 for c in cuts)], [*cuts, len(data)]
        for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
            reader = _Reader(data[a:b])
            part = [x for u in units[k * step : (k + 1) * step] for x in u]
            if first == 0:
                self._dc(reader, part, dc, low, refine)
            else:
                self._ac(reader, part, ac, first, last, low, refine)

    def _at_once(self, outs: list[np.ndarray], r: _Reader, dc: dict | None, ac: dict | None, first: int, last: int, low: int, refine: int) -> bool:
        """Reads a scan whose codes are all of one length; changes nothing and returns False where they are not."""
        out = outs[0]
        n, m, span = len(out), len(outs), last - first + 1
        if first == 0 and refine:
            if (rows := r.rows(n, m)) is None:
                return False
            for k, o in enumerate(outs):
                o[:, 0] |= rows[:, k].astype(np.int32) << low
            return True
        if first == 0:
            if dc is None:
                return False
            start = [r.signed(r.symbol(dc)) for _ in outs]
            length, code, size = r.peek(dc) if n > 1 else (1, 0, 1)
            rows = r.rows((n - 1) * m, length + size) if length and size else None
            if rows is None or (_numbers(rows[:, :length]) != code).any():
                return False
            v = _numbers(rows[:, length:])
            steps = np.where(v >> (size - 1), v, v - (1 << size) + 1).reshape(n - 1, m)
            values = np.cumsum(np.concatenate([[start], steps]), axis=0) << low
            for k, o in enumerate(outs):
                o[:, 0] = values[:, k]
            return True
        if not refine:
            length, code, size = r.peek(ac)
            rows = r.rows(n * span, length + size) if 0 < size < 16 else None
            if rows is None or (rows[:, 0].any() if length == 1 and code == 0 else (_numbers(rows[:, :length]) != code).any()):
                return False
            if size == 8:
                v = np.packbits(rows[:, length:], axis=1)[:, 0].astype(np.int32)
            else:
                v = _numbers(rows[:, length:])
            if not rows[:, length].all():
                v = np.where(v >> (size - 1), v, v - (1 << size) + 1)
            out[:, first : last + 1] = v.reshape(n, span) << low
            return True
        band = out[:, first : last + 1]
        if not band.all():
            return False
        at, found = 0, []
        while at < n:  # end-of-band runs, each followed by a correction bit for every coefficient
            s = r.symbol(ac)
            if s & 15 or s >> 4 == 15:
                return False
            run = (1 << (s >> 4)) + r.take(s >> 4)
            rows = r.rows(run * span, 1) if at + run <= n else None
            if rows is None:
                return False
            r.at += run * span
            found.append(rows[:, 0])
            at += run
        more = (np.concatenate(found) if len(found) > 1 else found[0]).reshape(n, span).astype(np.int32) << low
        band += more if (band > 0).all() else more * np.sign(band)
        return True

    def _dc(self, r: _Reader, part: list[tuple[int, int]], dc: dict, low: int, refine: int) -> None:
        before = dict.fromkeys(dc, 0)
        for c, k in part:
            if refine:
                self.coefficients[c][k, 0] |= r.take(1) << low
            else:
                before[c] += r.signed(r.symbol(dc[c]))
                self.coefficients[c][k, 0] = before[c] << low

    def _ac(self, r: _Reader, part: list[tuple[int, int]], ac: dict, first: int, last: int, low: int, refine: int) -> None:
        run = 0
        for c, b in part:
            x = self.coefficients[c][b]
            k = first
            if run == 0:
                while k <= last:
                    s = r.symbol(ac)
                    zeros, size = s >> 4, s & 15
                    if size == 0 and zeros < 15:
                        run = (1 << zeros) + r.take(zeros)
                        break
                    value = 0
                    if size:
                        value = (1 if r.take(1) else -1) << low if refine else r.signed(size) << low
                    if not refine:
                        k += zeros
                        if size:
                            x[k] = value
                        k += 1
                        continue
                    while k <= last:  # pass `zeros` zeros; coefficients that have a value get a correction bit
                        if x[k]:
                            self._correct(r, x, k, low)
                        elif zeros == 0:
                            x[k] = value
                            k += 1
                            break
                        else:
                            zeros -= 1
                        k += 1
            if run:
                if refine:
                    for j in range(k, last + 1):
                        if x[j]:
                            self._correct(r, x, j, low)
                run -= 1

    @staticmethod
    def _correct(r: _Reader, x: np.ndarray, k: int, low: int) -> None:
        if r.take(1):
            x[k] += 1 << low if x[k] > 0 else -(1 << low)

    def rgb(self) -> np.ndarray:
        """Height x width x 3 bytes."""
        planes = []
        for c, (h, v, q) in self.parts.items():
            x = self.coefficients[c] * self.quant[q]
            s = (x @ IDCT.T).reshape(self.high * v, self.wide * h, 8, 8).swapaxes(1, 2).reshape(self.high * v * 8, self.wide * h * 8) + 128
            if (h, v) != (self.h, self.v):
                s = s.repeat(self.v // v, axis=0).repeat(self.h // h, axis=1)
            planes.append(s[: self.height, : self.width])
        if len(planes) == 1:
            planes = planes * 3
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
        out = np.empty((self.height, self.width, 3), np.uint8)
        for k, p in enumerate(planes):
            np.clip(np.rint(p), 0, 255, out=p)
            out[:, :, k] = p
        return out

    def payload(self) -> bytes:
        """What encode() stored."""
        if not self.comment.startswith(b"payload "):
            raise ValueError("holds no payload")
        n = int(self.comment[8:])
        units = n // UNIT
        out = np.empty((len(self.coefficients[1]), 3, 64), np.uint8)
        for c in range(3):
            x = self.coefficients[c + 1]
            out[:, c, 0] = np.abs(x[:, 0]) - DC_BASE
            out[:, c, 1:] = x[:, 1:] - AC_BASE
        return out[:units].tobytes()


def padded(text: str | None) -> tuple[int, bytes]:
    """The text's bytes, how many, and padded with spaces to a positive multiple of UNIT."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return len(b), b + b" " * (-len(b) % UNIT or (0 if b else UNIT))


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, media (binary). A null text is empty; rows of other columns don't matter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in text_slices(batches, "t"):
            made = [(n, encode(p)) for n, p in map(padded, pdf["t"])]
            yield pd.DataFrame({"doc_id": pd.array([None if x is None else int(x) for x in pdf["id"]], "Int64"), "n_bytes": [m[0] for m in made], "media": [m[1] for m in made]})

    read = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("t"))
    return read.mapInPandas(run, "doc_id long, n_bytes long, media binary")


def decode_column(media: DataFrame, with_rgb: bool = False) -> DataFrame:
    """Per row of (doc_id, n_bytes, media): what is read back - payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (size of the tensor, mean of each channel, its checksum) and, if asked for, the rgb tensor's bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in text_slices(batches, "media"):
            rows = []
            for m in pdf["media"]:
                d = Decoder(m)
                p, rgb = d.payload(), d.rgb()
                means = rgb.reshape(-1, 3).mean(axis=0)
                feature = f"{d.height}x{d.width}x3:" + ",".join(f"{x:.3f}" for x in means) + f":{zlib.crc32(rgb):08x}"
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, *([rgb.tobytes()] if with_rgb else [])))
            out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["rgb"] * with_rgb])
            out.insert(0, "n_bytes", pdf["n_bytes"].to_numpy())
            out.insert(0, "doc_id", pd.array([None if x is None else int(x) for x in pdf["id"]], "Int64"))
            yield out

    read = media.select(F.col("doc_id").cast("string").alias("id"), "n_bytes", "media")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read.mapInPandas(run, schema + ", rgb binary" * with_rgb)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_rgb: bool = False) -> DataFrame:
    """Stores every whole text as a progressive JPEG in a written table, and reads that back: see decode_column.

    with_rgb: the decoded tensors are a column too (height x width x 3 bytes), to be written with the rest. A null or empty text is one unit of spaces; equal texts have equal values; repeated rows and null ids stay as they are;
    other columns are not read; an empty table gives an empty result.
    """
    return decode_column(materialise(encode_column(docs, id_col, text_col), "media", "zstd"), with_rgb)  # zstd: headers are much alike
