"""Media columns: payloads as progressive JPEG, and full-resolution RGB tensors from the stored bytes.

A payload byte is one quantised coefficient, so the file holds it without loss although its pixels are clamped.
The file is progressive in both ways: spectral selection (DC, then bands of AC) and successive approximation (all
but the last bit first, refinement after; DC comes in eight refinements).  Chroma is subsampled 2 x 2.

Decoding accumulates the scans in one coefficient array for each component.  Scans whose Huffman table has one
code for all (as ours have) are fixed-length and are read with numpy; any other progressive scan goes through the
bit-by-bit reader.  Coefficients are transformed back with one matrix product, chroma is upsampled, and the tensor
is the RGB image at full resolution.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
#: MCUs of 16 x 16 pixels in a row of the image at most; JPEG's sides end at 65,535.
MAX_COLUMNS = 4095
#: AC bands of each component's scans.
BANDS = (((1, 5), (6, 63)), ((1, 63),), ((1, 63),))
_AC_SIZE = 8
_BATCH_BYTES = 16 << 20
_MARKER = re.compile(rb"\xff[^\x00\xff]")


@cache
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order: along anti-diagonals, in turns up and down."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@cache
def _inverse_transform() -> np.ndarray:
    """64 x 64 matrix from coefficients in zigzag order to the 64 samples of a block."""
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) / 2
    basis[:, 0] /= np.sqrt(2)
    return np.kron(basis, basis).T[zigzag()].astype(np.float32)


def pad(text: str | None) -> tuple[bytes, int]:
    """The payload of a text (UTF-8, filled with spaces to a positive multiple of UNIT) and its length before."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, counts: dict[int, int], symbols: bytes) -> bytes:
    return _segment(0xC4, bytes([kind, *(counts.get(n, 0) for n in range(1, 17))]) + symbols)


@cache
def _preamble() -> bytes:
    """Quantisation by ones; DC differences are always 0, first AC values always have 8 bits, runs of ended blocks take 4 bits."""
    return _segment(0xDB, bytes([0] + [1] * 64)) + _table(0x00, {1: 1}, b"\x00") + _table(0x10, {1: 1}, bytes([_AC_SIZE])) + _table(0x11, {4: 15}, bytes(r << 4 for r in range(15)))


@cache
def _scan_header(components: tuple[int, ...], start: int, end: int, high: int, low: int, table: int) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c + 1, table]) for c in components) + bytes([start, end, high << 4 | low])
    return _segment(0xDA, body)


def _entropy_coded(bits: np.ndarray) -> bytes:
    """Bits filled up with ones, with a zero byte after each byte 255."""
    spare = -len(bits) % 8
    if spare:
        bits = np.concatenate([bits, np.ones(spare, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _nine_bit_fields(values: np.ndarray) -> bytes:
    """A zero bit and 8 value bits for each value, filled up with ones, with a zero byte after each byte 255."""
    n = len(values)
    v = np.zeros((-(-n // 8), 10), np.uint16)
    full = np.zeros(len(v) * 8, np.uint8)
    full[:n] = values
    v[:, 1:9] = full.reshape(-1, 8)
    j = np.arange(9, dtype=np.uint16)
    out = ((v[:, :9] << (8 - j)) | (v[:, 1:] >> (j + 1))).astype(np.uint8).ravel()[: -(-9 * n // 8)]
    if spare := -9 * n % 8:
        out[-1] |= (1 << spare) - 1
    return out.tobytes().replace(b"\xff", b"\xff\x00")


def _read_nine_bit_fields(data: bytes, n: int) -> np.ndarray | None:
    """The values of _nine_bit_fields; None where a field's first bit isn't zero."""
    groups = -(-n // 8)
    raw = np.zeros(groups * 9, np.uint8)
    raw[: -(-9 * n // 8)] = np.frombuffer(data, np.uint8, -(-9 * n // 8))
    raw = raw.reshape(-1, 9).astype(np.uint16)
    i = np.arange(8, dtype=np.uint16)
    fields = (((raw[:, :8] << 8) | raw[:, 1:]) >> (7 - i)).ravel()[:n] & 511
    return None if (fields > 255).any() else fields


@lru_cache(256)
def _mcu_order(rows: int, columns: int) -> np.ndarray:
    """Of the blocks of Y, then Cb, then Cr, each in raster order: their order by MCU."""
    luma = np.arange(4 * rows * columns).reshape(rows, 2, columns, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    chroma = 4 * rows * columns + np.arange(rows * columns)[:, None]
    return np.concatenate([luma, chroma, chroma + rows * columns], 1).ravel()


def encode(payload: bytes, n_bytes: int | None = None) -> bytes:
    """A progressive JPEG whose coefficients are the payload (a positive multiple of UNIT bytes)."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"a payload is a positive multiple of {UNIT} bytes")
    mcus = -(-len(payload) // 384)
    columns = min(mcus, MAX_COLUMNS)
    rows = -(-mcus // columns)
    n = rows * columns
    values = np.zeros((6 * n, 64), np.uint8)
    values.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    comment = b"payload" + struct.pack(">QQ", len(payload), len(payload) if n_bytes is None else n_bytes)
    frame = struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, comment), _segment(0xC2, frame), _preamble()]

    out += [_scan_header((0, 1, 2), 0, 0, 0, 8, 0), _entropy_coded(np.zeros(6 * n, np.uint8))]
    planes = np.unpackbits(values[_mcu_order(rows, columns), :1], axis=1)
    for low in range(7, -1, -1):
        out += [_scan_header((0, 1, 2), 0, 0, low + 1, low, 0), _entropy_coded(planes[:, 7 - low])]
    spans = ((0, 4 * n), (4 * n, 5 * n), (5 * n, 6 * n))
    for component, (first, last) in enumerate(spans):
        for start, end in BANDS[component]:  # coefficient 256 + byte: its upper bits are 128 + byte // 2
            band = (values[first:last, start : end + 1].ravel() >> 1) | np.uint8(128)
            out += [_scan_header((component,), start, end, 0, 1, 0), _nine_bit_fields(band)]
    for component, (first, last) in enumerate(spans):
        for start, end in BANDS[component]:
            last_bits = values[first:last, start : end + 1] & 1
            pieces = []
            for at in range(0, last - first, 32767):
                run = min(32767, last - first - at)
                r = run.bit_length() - 1
                code = np.array([int(b) for b in f"{r:04b}" + (f"{run - (1 << r):0{r}b}" if r else "")], np.uint8)
                pieces += [code, last_bits[at : at + run].ravel()]
            out += [_scan_header((component,), start, end, 1, 0, 1), _entropy_coded(np.concatenate(pieces))]
    return b"".join([*out, b"\xff\xd9"])


class _Bits:
    """Reader of single bits and Huffman codes."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | b
        self.at += n
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = length = 0
        while (length, code) not in table or not length:
            code, length = code << 1 | int(self.bits[self.at]), length + 1
            self.at += 1
        return table[length, code]


def _signed(value: int, size: int) -> int:
    return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


@lru_cache(256)
def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _slow_scan(data: bytes, coefficients: np.ndarray, blocks: np.ndarray, start: int, end: int, high: int, low: int, tables: list) -> None:
    """One scan of any progressive file without restarts; `blocks` are rows of `coefficients` in scan order, each with its table."""
    bits = _Bits(data)
    if start == 0:
        before: dict[int, int] = {}
        for b, (component, table) in zip(blocks.tolist(), tables, strict=True):
            if high:
                coefficients[b, 0] |= bits.take(1) << low
            else:
                size = bits.symbol(table)
                before[component] = before.get(component, 0) + _signed(bits.take(size), size)
                coefficients[b, 0] = before[component] << low
        return
    table, run = tables[0][1], 0
    for b in blocks.tolist():
        row = coefficients[b]
        k = start
        while k <= end and not run:
            zeros, size = divmod(bits.symbol(table), 16)
            if size == 0 and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            value = 0 if not size else _signed(bits.take(size), size) << low if not high else (1 if bits.take(1) else -1) << low
            if not high:
                k += zeros
                if size:
                    row[k] = value
                k += 1
                continue
            while k <= end:  # pass over `zeros` coefficients that are still zero, refining the others
                if row[k]:
                    if bits.take(1):
                        row[k] += (1 if row[k] > 0 else -1) << low
                elif zeros == 0:
                    row[k] = value
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
        if run:
            if high:
                for k in range(k, end + 1):
                    if row[k] and bits.take(1):
                        row[k] += (1 if row[k] > 0 else -1) << low
            run -= 1


def _quick_scan(data: bytes, coefficients: np.ndarray, blocks: np.ndarray, start: int, end: int, high: int, low: int, tables: list) -> bool:
    """A scan of fixed-length codes, read at once; False if it isn't one."""
    n, width = len(blocks), end - start + 1
    if start == 0 and high:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n)
        coefficients[blocks, 0] |= bits.astype(np.int32) << low
        return True
    table = tables[0][1]
    if start == 0:
        if all(t == {(1, 0): 0} for _, t in tables[:6]):
            coefficients[blocks, 0] = 0
            return True
        return False
    first, last = int(blocks[0]), int(blocks[-1]) + 1
    if last - first != n:
        return False
    if not high:
        if len(table) != 1 or (1, 0) not in table or not 0 < table[1, 0] < 16:
            return False
        size = table[1, 0]
        if 8 * len(data) < n * width * (1 + size):
            return False
        if size == 8:
            value = _read_nine_bit_fields(data, n * width)
            if value is None:
                return False
            value = value.astype(np.int32)
        else:
            bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width * (1 + size)).reshape(-1, 1 + size)
            if bits[:, 0].any():
                return False
            value = bits[:, 1:] @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
        value = np.where(value >> (size - 1), value, value - (1 << size) + 1)
        coefficients[first:last, start : end + 1] = value.reshape(n, width) << low
        return True
    band = coefficients[first:last, start : end + 1]
    if len(table) != 15 or set(table) != {(4, c) for c in range(15)} or not band.all():
        return False
    bits, at, done = np.unpackbits(np.frombuffer(data, np.uint8)), 0, 0
    step = np.zeros(band.shape, np.int32)
    while done < n:
        symbol = table[4, int(bits[at : at + 4] @ np.array([8, 4, 2, 1], np.uint8))]
        if symbol & 15 or symbol >> 4 == 15:
            return False
        r = symbol >> 4
        run = (1 << r) + (int("".join(map(str, bits[at + 4 : at + 4 + r].tolist())), 2) if r else 0)
        at += 4 + r
        step[done : done + run] = bits[at : at + run * width].reshape(-1, width)  # one correction bit each
        at += run * width
        done += run
    coefficients[first:last, start : end + 1] = band + np.where(band > 0, step, -step) * (1 << low) if (band < 0).any() else band + (step << low)
    return True


class Decoded:
    """Coefficients (blocks of Y, Cb, Cr in raster order, zigzag inside), grid of MCUs, quantisation, lengths from the comment."""

    def __init__(self, media: bytes, quick: bool = True):
        at, huffman, quantisers, self.lengths = 2, {}, {}, None
        while True:
            marker = media[at + 1]
            if marker == 0xD9:
                break
            length = struct.unpack_from(">H", media, at + 2)[0]
            body = media[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xFE and body[:7] == b"payload":
                self.lengths = struct.unpack(">QQ", body[7:])
            elif marker == 0xDB:
                quantisers[body[0]] = np.frombuffer(body[1:65], np.uint8).astype(np.float32)
            elif marker == 0xC4:
                huffman[body[0]] = _codes(body[1:17], body[17:])
            elif marker == 0xC2:
                _, height, width, _ = struct.unpack(">BHHB", body[:6])
                if body[6:] != bytes([1, 0x22, body[8], 2, 0x11, body[11], 3, 0x11, body[14]]):
                    raise ValueError("only three components with 2 x 2 subsampled chroma are read")
                self.height, self.width = height, width
                self.rows, self.columns = -(-height // 16), -(-width // 16)
                n = self.rows * self.columns
                self.spans = ((0, 4 * n), (4 * n, 5 * n), (5 * n, 6 * n))
                self.coefficients = np.zeros((6 * n, 64), np.int32)
                self.quantiser_of = (body[8], body[11], body[14])
                order = _mcu_order(self.rows, self.columns)
            elif marker == 0xDA:
                scan = [(body[1 + 2 * k] - 1, body[2 + 2 * k]) for k in range(body[0])]
                start, end, approximation = body[-3:]
                found = _MARKER.search(media, at)
                data = media[at : found.start()].replace(b"\xff\x00", b"\xff")
                at = found.start()
                if len(scan) == 3:
                    blocks = order
                    each = [(c, huffman.get(t >> 4)) for c, t in scan]
                    tables = [each[0]] * 4 + each[1:]
                    tables = tables * (len(order) // 6) if not quick else tables
                else:
                    component, table = scan[0]
                    blocks = np.arange(*self.spans[component])
                    tables = [(component, huffman.get((table >> 4) if start == 0 else 0x10 | table & 15))]
                    tables = tables * len(blocks) if start == 0 and not quick else tables
                arguments = (data, self.coefficients, blocks, start, end, approximation >> 4, approximation & 15)
                if not (quick and _quick_scan(*arguments, tables)):
                    if start == 0 and len(tables) != len(blocks):
                        tables = tables * (len(blocks) // len(tables))
                    _slow_scan(*arguments, tables)
        self.quantisers = [quantisers[q] for q in self.quantiser_of]

    def payload(self) -> tuple[bytes, int]:
        """The payload and its length before padding."""
        values = self.coefficients.astype(np.uint8)  # AC coefficients are 256 + byte, which the cast takes off
        return values.tobytes()[: self.lengths[0]], self.lengths[1]

    def rgb(self) -> np.ndarray:
        """The image, height x width x 3 samples of 8 bits."""
        planes = []
        for k, (first, last) in enumerate(self.spans):
            r, c = self.rows * (2 if k == 0 else 1), self.columns * (2 if k == 0 else 1)
            samples = (self.coefficients[first:last] * self.quantisers[k]) @ _inverse_transform()
            planes.append(np.clip(np.rint(samples) + 128, 0, 255).reshape(r, c, 8, 8).transpose(0, 2, 1, 3).reshape(8 * r, 8 * c))
        y, cb, cr = planes[0], *(np.repeat(np.repeat(p - 128, 2, 0), 2, 1) for p in planes[1:])
        out = np.empty((*y.shape, 3), np.uint8)
        for k, plane in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            out[..., k] = np.clip(plane + 0.5, 0, 255)
        return out[: self.height, : self.width]


def feature(image: np.ndarray) -> str:
    """Size, mean of each channel and CRC-32 of an RGB tensor."""
    means = image.reshape(-1, 3).sum(0, dtype=np.int64) / (image.shape[0] * image.shape[1])
    return f"{image.shape[1]}x{image.shape[0]} " + " ".join(f"{m:.4f}" for m in means) + f" {zlib.crc32(image.tobytes()):08x}"


def _slices(columns: list[list], schema: pa.Schema, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size."""
    first = total = 0
    for k, size in enumerate(sizes):
        total += size
        if total >= _BATCH_BYTES or k + 1 == len(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(c[first : k + 1], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            first, total = k + 1, 0


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media (progressive JPEG) of each row; a null text counts as empty, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])
        for batch in batches:
            media: list[bytes] = []
            ids: list = []
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(one)
                media.append(encode(*pad(text.as_py())))
                if sum(map(len, media[-64:])) > _BATCH_BYTES or len(media) >= 2048:
                    yield from _slices([ids, media], schema, [len(m) for m in media])
                    ids, media = [], []
            yield from _slices([ids, media], schema, [len(m) for m in media])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, media binary")


def rgb_tensors(media: DataFrame) -> DataFrame:
    """doc_id, height, width and rgb (samples by row, column, channel) of rows (doc_id, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])
        for batch in batches:
            for one, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = Decoded(stored.as_py()).rgb()
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((one, *image.shape[:2], image.tobytes()), schema, strict=True)], schema=schema)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, height int, width int, rgb binary")


def read_back(media: DataFrame) -> DataFrame:
    """Digest of each stored row (doc_id, media): what the payload and the tensor read from it are.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 16 payload bytes), media_bytes, media_sha256,
    feature.  Equal texts have equal values; repeated rows and null ids pass through; no rows give no rows.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for stored in batch.column(1):
                raw = stored.as_py()
                image = Decoded(raw)
                payload, n_bytes = image.payload()
                out.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(image.rgb())))
            columns = zip(*out, strict=True) if out else [[]] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=names)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
