"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized by integral images, kept as NPY tiles with
difference hashes.

decode() reads P1 to P6 and BMP of 1, 4, 8, 24 and 32 bits without compression, and of 16 and 32 bits with bit-field masks. area_resize() averages the exact area that each
target pixel covers, by interpolating in the integral image. tile() gives NPY bytes, difference_hash() 64 bits.
image_columns() does this for a column of image bytes; write_tiles() writes a Parquet table of NPY bytes, a tile a row, through Spark's own file systems.

payload_images() stores texts as images: the UTF-8 bytes, padded by zero bytes to a positive multiple of 64, become an
8-bit grey image 64 pixels wide, a BMP or a binary PGM by a bit of the payload's CRC-32, so either format holds texts of every length; what it
returns is computed from the stored bytes.

Null text counts as empty and gives one row of zeros. Null or undecodable image bytes, samples beyond the header's maximum and sizes that the bytes cannot hold give
null columns and an error text. Very long texts and images are held one at a time, with eight bytes a pixel for the integral image.
Rows are independent: repeated rows, ties and extra columns change nothing, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal

WIDTH = 64
TILE = 32
_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")


def encode_pgm(image: np.ndarray) -> bytes:
    """A binary PGM of an 8-bit grey array."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """An 8-bit BMP, grey palette, rows from the bottom and padded to 4 bytes."""
    h, w = image.shape
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    rows = np.zeros((h, (w + 3) // 4 * 4), np.uint8)
    rows[:, :w] = image[::-1]
    start = 14 + 40 + 1024
    return struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = int(data[1:2])
    at, head = 2, []
    while len(head) < (2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("Netpbm header is cut short")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    top = head[2] if len(head) == 3 else 1
    deep = 3 if kind in (3, 6) else 1
    if w < 1 or h < 1 or not 0 < top < 65536:
        raise ValueError("Netpbm header out of range")
    n = w * h * deep
    if n > 8 * len(data):
        raise ValueError("Netpbm samples are cut short")
    if kind == 4:
        line = (w + 7) // 8
        bits = np.frombuffer(data, np.uint8, line * h, at + 1).reshape(h, line)
        values = 1 - np.unpackbits(bits, axis=1)[:, :w].ravel()
    elif kind == 1:
        values = 49 - np.frombuffer(re.sub(rb"#[^\r\n]*|\s", b"", data[at:])[:n], np.uint8).astype(np.int64)
    elif kind in (2, 3):
        values = np.array(re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
    else:
        values = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if values.size < n:
        raise ValueError("Netpbm samples are cut short")
    if values.min() < 0 or values.max() > top:
        raise ValueError("Netpbm sample out of range")
    if top != 255:
        values = (values.astype(np.int64) * 255 + top // 2) // top
    values = values.astype(np.uint8)
    return values.reshape((h, w, 3) if deep == 3 else (h, w))


def _channel(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask, spread over 0 to 255."""
    if not mask:
        raise ValueError("BMP mask is empty")
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    return ((((pixels & np.uint32(mask)) >> np.uint32(low)).astype(np.int64) * 255 + top // 2) // top).clip(0, 255).astype(np.uint8)


def _decode_bmp(data: bytes) -> np.ndarray:
    (start,), (head, w, h, _, bits, packed) = struct.unpack_from("<I", data, 10), struct.unpack_from("<IiiHHI", data, 14)
    if head < 40 or packed not in (0, 3) or bits not in ((16, 32) if packed else (1, 4, 8, 24, 32)) or w < 1 or not h:
        raise ValueError("BMP of a kind that is not read")
    line = (w * bits + 31) // 32 * 4
    if start + line * abs(h) > len(data):
        raise ValueError("BMP rows are cut short")
    rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)
    if h > 0:
        rows = rows[::-1]
    if packed:
        pixels = np.ascontiguousarray(rows[:, : w * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.uint32)
        return np.stack([_channel(pixels, mask) for mask in struct.unpack_from("<III", data, 54)], 2)  # the masks follow a header of 40 bytes or are part of a longer one
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1])
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    if 14 + head + colours * 4 > len(data):
        raise ValueError("BMP palette is cut short")
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    index = rows if bits == 8 else np.stack([(rows >> s) & ((1 << bits) - 1) for s in range(8 - bits, -1, -bits)], 2).reshape(abs(h), -1)
    index = index[:, :w]
    return np.ascontiguousarray(palette[:, 0][index] if (palette == palette[:, :1]).all() else palette[index])


def decode(data: bytes) -> np.ndarray:
    """(height, width) grey or (height, width, 3) RGB, uint8."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else ((image * np.array([299, 587, 114])).sum(2) / 1000).round().astype(np.uint8)


def integral(image: np.ndarray) -> np.ndarray:
    """Sums of all pixels above and to the left, one row and column larger than the image."""
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(image, 0, dtype=np.int64), 1, out=out[1:, 1:])
    return out


def area_resize(image: np.ndarray, height: int, width: int, sums: np.ndarray | None = None) -> np.ndarray:
    """The mean of the area that each target pixel covers, as doubles; image is grey, sums its integral."""
    sums = integral(image) if sums is None else sums

    def cuts(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(m + 1) * (n / m)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    (r, fr), (c, fc) = cuts(image.shape[0], height), cuts(image.shape[1], width)
    rows = sums[r] * (1 - fr)[:, None] + sums[r + 1] * fr[:, None]
    both = rows[:, c] * (1 - fc) + rows[:, c + 1] * fc
    return np.diff(np.diff(both, axis=0), axis=1) * (height * width / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray, sums: np.ndarray | None = None) -> str:
    """64 bits in hex: whether each of 8 x 8 cells is darker than the one to its right."""
    small = area_resize(image, 8, 9, sums)
    return np.packbits(small[:, :-1] < small[:, 1:] - 1e-9).tobytes().hex()


def tile(image: np.ndarray, side: int = TILE, sums: np.ndarray | None = None) -> bytes:
    """NPY bytes of the image resized to side x side, uint8."""
    out = io.BytesIO()
    np.save(out, np.clip(area_resize(image, side, side, sums).round(), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


_IMAGE = pa.schema([("id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                image = decode(data.as_py() or b"")
                flat = grey(image)
                sums = integral(flat)
                rows.append((i, *image.shape[:2], 1 if image.ndim == 2 else 3, tile(flat, TILE, sums), difference_hash(flat, sums), None))
            except (ValueError, struct.error, IndexError, TypeError, OverflowError) as e:
                rows.append((i, None, None, None, None, None, str(e)))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _IMAGE, strict=True)] if rows else [pa.array([], f.type) for f in _IMAGE], schema=_IMAGE)


def image_columns(df: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """id, height, width, channels, npy, dhash, error of each image."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(bytes_col).alias("data")).mapInArrow(frugal(_images), "id long, height int, width int, channels int, npy binary, dhash string, error string")


def write_tiles(images: DataFrame, path: str) -> None:
    """The tiles as a Parquet table of NPY bytes by id and hash, which any reader of NPY takes row by row."""
    images.filter("error is null").select("id", "dhash", "npy").write.parquet(path)


_PAYLOAD = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def store(payload: bytes) -> bytes:
    """The image that holds a payload of whole rows."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_bmp(image) if zlib.crc32(payload) & 1 else encode_pgm(image)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _PAYLOAD]
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_py() or b""
            media = store(raw + bytes(-len(raw) % WIDTH if raw else WIDTH))
            image = decode(media)
            back = image.tobytes()
            sums = integral(image)
            npy = tile(image, TILE, sums)
            for column, value in zip(out, (i, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(image, sums)}:{zlib.crc32(npy):08x}"), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PAYLOAD, strict=True)], schema=_PAYLOAD)


def payload_images(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every text."""
    bounded_batches(df)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(frugal(_payloads), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
