"""Media columns: text payloads stored as PNG images in a binary column.

A payload becomes 8-bit greyscale samples, 64 to a row. The encoder filters
each row (none, left or up, whichever leaves the smallest residue), compresses
the rows with zlib and frames them as PNG chunks. The decoder tests the
signature, every chunk's CRC-32 and zlib's Adler-32, undoes the row filters
(all five of the format) with numpy, and returns exactly the stored samples. A
picture's feature is a perceptual hash: the signs, against their median, of the
lowest 8 x 8 frequencies of a cosine transform of its 32 x 32 reduction.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffers

WIDTH = 64
SIDE = 32
KEEP = 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format


class MediaError(ValueError):
    """A stored image that fails a checksum or breaks the format."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


#: Rows of an image that the encoder works on at once.
_BAND = 4096


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A greyscale PNG of a (rows, width) uint8 array, filtered band by band."""
    rows, width = samples.shape
    packer, packed = zlib.compressobj(level), []
    for at in range(0, rows, _BAND):
        band = samples[at : at + _BAND]
        left = band.copy()
        left[:, 1:] -= band[:, :-1]
        up = band.copy()
        up[1:] -= band[:-1]
        if at:
            up[0] -= samples[at - 1]
        choices = np.stack([band, left, up])
        cost = np.abs(choices.view(np.int8).astype(np.int16)).sum(2)
        kind = cost.argmin(0).astype(np.uint8)
        lines = np.empty((len(band), width + 1), np.uint8)
        lines[:, 0] = kind
        lines[:, 1:] = choices[kind, np.arange(len(band))]
        packed.append(packer.compress(lines.tobytes()))
    packed.append(packer.flush())
    header = struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", b"".join(packed)) + _chunk(b"IEND", b"")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise MediaError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise MediaError("cut short")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) != n or struct.unpack_from(">I", data.ljust(at + 12 + n), at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError(f"checksum of {kind!r}")
        yield kind, body
        at += 12 + n


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo PNG row filters of one byte a pixel; lines are (rows, 1 + width)."""
    kind, out = lines[:, 0], lines[:, 1:].copy()
    if kind.size and kind.max() > 4:
        raise MediaError("unknown row filter")
    out[kind == 1] = np.cumsum(out[kind == 1], axis=1, dtype=np.uint8)
    runs = np.flatnonzero(np.diff(kind, prepend=255))
    for a, b in zip(runs, np.append(runs[1:], len(kind))):
        above = out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        if kind[a] == 2:
            out[a:b] = np.cumsum(np.concatenate([above[None], out[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kind[a] > 2:
            out[a:b] = _predicted(out[a:b], above, kind[a] == 4)
    return out


def _predicted(rows: np.ndarray, above: np.ndarray, paeth: bool) -> np.ndarray:
    """Undo the average or the Paeth filter of consecutive rows. A sample needs
    its left, upper and upper left neighbours, so samples whose row and column
    add up to the same number are independent, and each such diagonal is one
    step over all rows."""
    n, width = rows.shape
    out = np.zeros((n + 1, width + 1), np.int16)  # a row above and a column of zeros
    out[0, 1:] = above
    for d in range(n + width - 1):
        y = np.arange(max(0, d - width + 1), min(n, d + 1))
        x = d - y
        west, north = out[y + 1, x], out[y, x + 1]
        if paeth:
            north_west = out[y, x]
            e = west + north - north_west
            to_west, to_north, to_both = np.abs(e - west), np.abs(e - north), np.abs(e - north_west)
            guess = np.where((to_west <= to_north) & (to_west <= to_both), west, np.where(to_north <= to_both, north, north_west))
        else:
            guess = (west + north) // 2
        out[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """The (rows, width) samples of an 8-bit greyscale PNG; MediaError if any
    checksum fails or the image is of another kind."""
    header, body, ended = None, [], False
    for kind, part in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
    if not header or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise MediaError("unsupported or incomplete image")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    width, rows = header[:2]
    if len(raw) != rows * (width + 1):
        raise MediaError("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(rows, width + 1))


_FREQUENCY = np.cos(np.pi * (2 * np.arange(SIDE) + 1) * np.arange(KEEP)[:, None] / (2 * SIDE))


def _reduced(samples: np.ndarray) -> np.ndarray:
    """SIDE x SIDE means of (nearly) equal cells; small images repeat samples."""
    for axis in (0, 1):
        n = samples.shape[axis]
        at = (np.arange(SIDE + 1) * n) // SIDE
        sums = np.concatenate([np.zeros_like(samples.take([0], axis), dtype=np.int64), np.cumsum(samples, axis=axis, dtype=np.int64)], axis)
        low, high = at[:-1], np.maximum(at[1:], at[:-1] + 1)
        width = (high - low).reshape((-1, 1) if axis == 0 else (1, -1))
        samples = (sums.take(high, axis) - sums.take(low, axis)) * 1000 // width
    return samples


def dct_hash(samples: np.ndarray) -> str:
    """16 hex digits: which low frequencies lie above their median."""
    low = np.round(_FREQUENCY @ _reduced(samples).astype(float) @ _FREQUENCY.T, 3).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload_samples(text: bytes) -> np.ndarray:
    """Bytes, zero-padded to a positive multiple of the row width, as rows."""
    size = max(1, -(-len(text) // WIDTH)) * WIDTH
    return np.frombuffer(text.ljust(size, b"\0"), np.uint8).reshape(-1, WIDTH)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index("text")))
        data = data.tobytes()
        media = [encode_png(payload_samples(data[offsets[i] : offsets[i + 1]])) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a lossless PNG.

    Defined cases: a null or empty text has n_bytes 0 and one row of zeros;
    repeated rows and null ids are kept as they are; other columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "intact"]
    for batch in batches:
        out = []
        for media in batch.column(batch.schema.get_field_index("media")):
            media = media.as_py()
            try:
                samples = decode_png(media)
            except (MediaError, TypeError):
                out.append((None, None, None, None if media is None else len(media), media and hashlib.sha256(media).hexdigest(), None, False))
                continue
            payload = samples.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), dct_hash(samples), True))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        columns = [pa.array([row[i] for row in out], kinds[i]) for i in range(len(kinds))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and perceptual hash of stored images, read back and tested.

    A null or damaged image gives null payload columns and intact = false.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, intact boolean"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, schema)
