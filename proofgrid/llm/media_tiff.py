"""Media columns: TIFF files walked, decoded and split into one row per page.

The reader follows the chain of image directories in either byte order, takes strips or tiles, decodes stored,
PackBits, LZW or deflate data, undoes the horizontal predictor, and yields the samples of every page: 1, 4, 8, 16 or
32 bits (also signed or floating). The writer makes such files from raw bytes, so that reading back is an exact round
trip. The query stores every text in one of the FORMS, which its bytes decide, so equal texts have equal files.

Defined cases: null or empty media has no page; a broken or hostile file gives the pages before the fault and one row
with the error, and does not stop the job: counts, places and sizes are checked against the file before anything is
made of them, decoding stops at the size that the page needs, and a page beyond PAGE_BYTES is refused; a directory
chain that returns to an earlier place ends there; equal media give equal rows; a payload beyond PAGE_ROWS rows is
cut into pages, so strips and pages stay small whatever the length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .store import map_texts, read

#: Fixed values of the TIFF 6.0 specification: bytes of a field type and its struct code, tags, compressions.
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 339
TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES = 322, 323, 324, 325
STORED, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773

PAGE_WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 1 << 14, 512
#: Bytes of samples of the largest page that is decoded.
PAGE_BYTES = 1 << 30
#: How texts are stored: compression, predictor, tile (rows, columns) and byte order.
FORMS = [(DEFLATE, 2, None, "<"), (LZW, 1, None, ">"), (PACKBITS, 1, (32, 32), "<"), (DEFLATE, 2, (64, 32), ">")]


class TiffError(ValueError):
    pass


def unpack_bits(data: bytes, need: int) -> bytes:
    """PackBits: a signed count, then that many literal bytes or one byte to repeat; up to need bytes or a little more."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < need:
        k = data[i]
        i += 1
        if k < 128:
            out += data[i : i + k + 1]
            i += k + 1
        elif k > 128:
            out += data[i : i + 1] * (257 - k)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """PackBits by runs of three or more equal bytes."""
    a = np.frombuffer(data, np.uint8)
    edge = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a)) if len(a) else np.zeros(1, np.int64)
    long = np.flatnonzero(np.diff(edge) > 2)
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, end in zip(edge[long].tolist(), edge[long + 1].tolist(), strict=True):
        literal(start)
        for i in range(start, end, 128):
            k = min(128, end - i)
            out += bytes([257 - k if k > 1 else 0, data[start]])
        at = end
    literal(len(data))
    return bytes(out)


def unpack_lzw(data: bytes, need: int) -> bytes:
    """TIFF's LZW: codes from the high bit, widths of 9 to 12 bits that grow one code early; up to need bytes or a little more."""
    out: list[bytes] = []
    made = 0
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last = list(base), 9, b""
    bits = held = 0
    for byte in data:
        bits = bits << 8 | byte
        held += 8
        while held >= width:
            held -= width
            code = bits >> held
            bits &= (1 << held) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = list(base), 9, b""
                continue
            if not last:
                entry = table[code] if code < 256 else None
            elif code < len(table):
                entry = table[code]
                table.append(last + entry[:1])
            elif code == len(table):
                entry = last + last[:1]
                table.append(entry)
            else:
                entry = None
            if entry is None:
                raise TiffError("bad LZW code")
            out.append(entry)
            made += len(entry)
            if made >= need:
                return b"".join(out)
            last = entry
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    """The counterpart of unpack_lzw."""
    out, bits, held, width = bytearray(), 0, 0, 9
    codes: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal bits, held
        bits = bits << width | code
        held += width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
            bits &= (1 << held) - 1

    def clear() -> None:
        nonlocal codes, width
        put(256)
        codes, width = {bytes([i]): i for i in range(256)}, 9

    clear()
    size, word = 258, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = size
        size += 1
        if size == 4094:
            clear()
            size = 258
        elif size + 1 > (1 << width) and width < 12:
            width += 1
        word = data[i : i + 1]
    if word:
        put(codes[word])
        size += 1
        if size + 1 > (1 << width) and width < 12:
            width += 1
    put(257)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


PACK = {STORED: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda data: zlib.compress(data, 1)}


def _inflate(data: bytes, need: int) -> bytes:
    return zlib.decompressobj().decompress(data, max(need, 1))


UNPACK = {STORED: lambda data, need: data[:need], PACKBITS: unpack_bits, LZW: unpack_lzw, DEFLATE: _inflate, DEFLATE_OLD: _inflate}


@dataclass
class Page:
    """Samples of one page: rows x columns x channels."""

    number: int
    samples: np.ndarray
    compression: int
    predictor: int
    tiled: bool


def _fields(media: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    """Values by tag of one directory, and the place of the next. A tag without values is left out."""
    (n,) = struct.unpack_from(order + "H", media, at)
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * k)
        if kind not in TYPES or not count:
            continue
        size = struct.calcsize(order + TYPES[kind]) * count
        place = at + 2 + 12 * k + 8
        if size > 4:
            (place,) = struct.unpack_from(order + "I", media, place)
        if place + size > len(media):
            raise TiffError(f"the values of tag {tag} lie beyond the file")
        out[tag] = struct.unpack_from(order + TYPES[kind] * count, media, place)
    return out, struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]


def _sample_kind(bits: tuple, form: int, order: str) -> tuple[np.dtype, int]:
    """The kind of a sample and its bits; kinds of less than a byte are unpacked to bytes."""
    found = {1: "u", 2: "i", 3: "f", 4: "u"}.get(form)
    if len(set(bits)) > 1 or (found, bits[0]) not in {("u", 1), ("u", 4), *((f, b) for f in "ui" for b in (8, 16, 32)), ("f", 32), ("f", 64)}:
        raise TiffError(f"{bits} bits a sample of format {form} are not supported")
    return np.dtype(f"{order}{found}{max(1, bits[0] // 8)}"), bits[0]


def _segment(raw: bytes, compression: int, predictor: int, rows: int, columns: int, channels: int, kind: np.dtype, bits: int) -> np.ndarray:
    """Samples of one strip or tile; the predictor adds up each row, channel by channel."""
    if compression not in UNPACK:
        raise TiffError(f"compression {compression} is not supported")
    if predictor not in (1, 2) or (predictor == 2 and (bits < 8 or kind.kind == "f")):
        raise TiffError(f"predictor {predictor} is not supported for {bits} bits of kind {kind.kind}")
    width = -(-columns * channels * bits // 8)  # bytes of a row
    data = UNPACK[compression](raw, rows * width)
    if len(data) < rows * width:
        raise TiffError("a strip or tile is too short")
    if bits < 8:
        each = np.unpackbits(np.frombuffer(data, np.uint8, rows * width).reshape(rows, width), axis=1)
        if bits == 4:
            each = each.reshape(rows, -1, 4) @ np.array([8, 4, 2, 1], np.uint8)
        return each[:, : columns * channels].reshape(rows, columns, channels)
    part = np.frombuffer(data, kind, rows * columns * channels).reshape(rows, columns, channels)
    return np.cumsum(part, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else part


def pages(media: bytes) -> Iterator[Page]:
    """All pages in the order of their directories."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if order is None or len(media) < 8 or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", media, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        f, after = _fields(media, at, order)

        def first(tag: int, default: int | None = None, f: dict = f) -> int:
            if tag not in f and default is None:
                raise TiffError(f"a directory without tag {tag}")
            value = f.get(tag, (default,))[0]
            if not isinstance(value, int) or value < 0:
                raise TiffError(f"tag {tag} is {value}")
            return value

        width, length, channels = first(WIDTH), first(LENGTH), first(SAMPLES, 1)
        kind, bits = _sample_kind(f.get(BITS, (1,)), first(FORMAT, 1), order)
        compression, predictor, planes = first(COMPRESSION, 1), first(PREDICTOR, 1), 1
        inside = channels
        if first(PLANAR, 1) == 2:
            planes, inside = channels, 1
        tiled = TILES in f
        if tiled:
            across, down = first(TILE_WIDTH), first(TILE_LENGTH)
            offsets, sizes = f[TILES], f.get(TILE_BYTES, ())
        else:
            across, down = width, min(first(ROWS_PER_STRIP, length), length) or 1
            offsets, sizes = f.get(STRIPS, ()), f.get(STRIP_BYTES, ())
        if not all(isinstance(v, int) for v in (*offsets, *sizes)):
            raise TiffError("places or sizes of strips or tiles are not whole numbers")
        if max(width * length, across * down) * max(channels, 1) * kind.itemsize > PAGE_BYTES or not across * down * channels and width * length:
            raise TiffError(f"a page of {width} x {length} x {channels} in parts of {across} x {down} is not supported")
        columns, rows = -(-width // max(across, 1)), -(-length // max(down, 1))
        if len(offsets) != columns * rows * planes or len(sizes) != len(offsets):
            raise TiffError("strips or tiles don't cover the page")
        out = np.zeros((length, width, channels), kind.newbyteorder("="))
        for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
            plane, r, c = k // (rows * columns), k // columns % rows, k % columns
            tall = down if tiled else min(down, length - r * down)
            part = _segment(media[offset : offset + size], compression, predictor, tall, across, inside, kind, bits)
            y, x = r * down, c * across
            where = slice(plane, plane + 1) if planes > 1 else slice(None)
            out[y : y + tall, x : x + across, where] = part[: length - y, : width - x]
        yield Page(len(seen) - 1, out, compression, predictor, tiled)
        at = after


def write_tiff(planes: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<", bits: int | None = None) -> bytes:
    """A file of pages (rows x columns of numbers) in strips, or in tiles of (rows, columns). bits: 1 or 4 to pack bytes."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in planes:
        length, width = page.shape
        down, across = tile or (strip_rows, width)
        places, sizes = [], []
        for y in range(0, length, down):
            for x in range(0, width, across):
                part = page[y : y + down, x : x + across]
                if tile:
                    part = np.pad(part, ((0, down - part.shape[0]), (0, across - part.shape[1])))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], 1)
                if bits:
                    part = np.packbits((part[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8) & 1).reshape(part.shape[0], -1), axis=1)
                raw = PACK[compression](np.ascontiguousarray(part.astype(part.dtype.newbyteorder(order), copy=False)).tobytes())
                places.append(len(out))
                sizes.append(len(raw))
                out += raw
        out += b"\0" * (len(out) % 2)
        lists = {}
        for values in (places, sizes):
            lists[id(values)] = len(out)
            if len(values) > 1:
                out += struct.pack(order + f"{len(values)}I", *values)
        fields = {WIDTH: width, LENGTH: length, BITS: bits or 8 * page.dtype.itemsize, FORMAT: {"u": 1, "i": 2, "f": 3}[page.dtype.kind], COMPRESSION: compression, PHOTOMETRIC: 1, SAMPLES: 1, PREDICTOR: predictor}
        fields |= {TILE_WIDTH: across, TILE_LENGTH: down, TILES: places, TILE_BYTES: sizes} if tile else {STRIPS: places, ROWS_PER_STRIP: down, STRIP_BYTES: sizes}
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields))
        for tag, value in sorted(fields.items()):
            if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PREDICTOR, FORMAT):  # short numbers stand first in their four bytes
                out += struct.pack(order + "HHIHH", tag, 3, 1, value, 0)
                continue
            many = isinstance(value, list)
            out += struct.pack(order + "HHII", tag, 4, len(value) if many else 1, value if not many else value[0] if len(value) == 1 else lists[id(value)])
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def as_planes(payload: bytes) -> list[np.ndarray]:
    """A payload whose length is a multiple of PAGE_WIDTH as pages of at most PAGE_ROWS rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH)
    return [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]


def features(samples: np.ndarray) -> str:
    """Size, extremes, mean, spread, entropy in bits and mean step along the rows of samples, in text of a fixed form."""
    values, counts = (np.arange(256), np.bincount(samples.ravel(), minlength=256)) if samples.dtype == np.uint8 else np.unique(samples, return_counts=True)
    values, counts = values[counts > 0].astype(np.float64), counts[counts > 0]
    share = counts / counts.sum()
    mean = float((values * share).sum())
    step = np.abs(np.diff(samples.astype(np.float64 if samples.dtype.kind == "f" else np.int64 if samples.dtype.itemsize > 1 else np.int16), axis=1))
    told = {"mean": mean, "std": float((np.square(values - mean) * share).sum()) ** 0.5, "entropy": float(-(share * np.log2(share)).sum()) + 0.0, "step": float(step.mean()) if step.size else 0.0}
    return f"{samples.shape[1]}x{samples.shape[0]}x{samples.shape[2]};min={samples.min()};max={samples.max()};" + ";".join(f"{k}={v:.4f}" for k, v in told.items())


_PAGES = "page int, width int, height int, channels int, compression int, predictor int, tiled boolean, samples binary, feature string, error string"


def tiff_pages(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """media(key, column binary) -> one row for each page, samples row by row as bytes of the machine's order."""
    kind = dict(media.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *(c.split()[0] for c in _PAGES.split(", "))]
        for frame in frames:
            for name, data in zip(frame[key], frame[column], strict=True):
                if data is None or not len(data):
                    continue
                rows = []
                try:
                    for p in pages(bytes(data)):
                        h, w, c = p.samples.shape
                        rows.append((name, p.number, w, h, c, p.compression, p.predictor, p.tiled, p.samples.tobytes(), features(p.samples) if p.samples.size else "empty", None))
                except (ValueError, LookupError, ArithmeticError, MemoryError, zlib.error, struct.error) as e:
                    rows.append((name, None, None, None, None, None, None, None, None, None, str(e) or type(e).__name__))
                out = pd.DataFrame(rows, columns=names)
                for c in ("page", "width", "height", "channels", "compression", "predictor"):
                    out[c] = out[c].astype("Int32")
                yield out

    return media.select(key, column).mapInPandas(run, f"{key} {kind}, {_PAGES}")


def stored(raw: bytes) -> bytes:
    """The padded bytes as a file of one of the FORMS."""
    compression, predictor, tile, order = FORMS[zlib.crc32(raw) % len(FORMS)]
    return write_tiff(as_planes(padded(raw)), compression, predictor, STRIP_ROWS, tile, order)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the UTF-8 bytes of each text, padded with 0 to a positive multiple of 64, as TIFF."""

    def store(text: str | None) -> tuple[int, bytes]:
        raw = (text or "").encode()
        return len(raw), stored(raw)

    return map_texts(docs, store, "n_bytes long, media binary")


def padded(raw: bytes, unit: int = PAGE_WIDTH) -> bytes:
    return raw + b"\0" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text as TIFF, read it back and keep digests; the media stay in their task."""

    def digest(text: str | None) -> tuple:
        raw = (text or "").encode()
        media = stored(raw)
        found = list(pages(media))
        payload = b"".join(p.samples.tobytes() for p in found)
        whole = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH, 1)
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(whole), len(found)

    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int"
    return map_texts(docs, digest, fields)


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read(spark, sf_dir, "documents"))
