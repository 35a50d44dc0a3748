"""Media columns: 8-bit grey PNG in a binary column, read back with checksum tests, and cosine-transform hashes.

write: bytes, padded with zeros to a positive multiple of 64, become the rows (64 samples each) of a PNG with one IDAT
chunk; rows take the given filter types in turn. Unfiltered text deflates best, so three rows of four are of type 0, and
the fourth ones go through the other types.
read: chunks are walked, each CRC is tested, IDAT is inflated (its Adler checksum is zlib's own test), the filters are
undone with numpy, for all images of a batch at once, and the pixels must have the size that IHDR names. hash: pixels are averaged to 32 x 32, cosine
transformed, and the 8 x 8 low frequencies are compared with their median (the constant term aside): 64 bits.

Null and empty payloads become one row of zeros; repeated rows and ties give equal values, since nothing depends on the
row's place; an empty table gives no rows; columns other than the id and the text are not looked at, whatever their
names. A file that fails a test raises an error with its reason.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Filter types of the rows in turn: 0 none, 1 sub, 2 up, 3 average, 4 Paeth.
FILTERS = (0, 0, 0, 1, 0, 0, 0, 2, 0, 0, 0, 3, 0, 0, 0, 4)
LEVEL = 6
SMALL, LOW = 32, 8

_DCT = np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SMALL) + 1) / (2 * SMALL))


def payload(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(data: bytes, filters: tuple[int, ...] = FILTERS) -> bytes:
    """data: a positive multiple of WIDTH bytes."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)
    rows = np.empty((len(pixels), WIDTH + 1), dtype=np.uint8)
    kinds = rows[:, 0] = np.resize(np.array(filters, dtype=np.uint8), len(pixels))
    rows[:, 1:] = pixels
    for kind in np.unique(kinds[kinds > 0]):
        at = np.flatnonzero(kinds == kind)
        left = np.zeros((len(at), WIDTH), dtype=np.int16)
        left[:, 1:] = pixels[at, :-1]
        up = np.where(at[:, None] > 0, pixels[at - 1], 0).astype(np.int16)
        corner = np.zeros_like(left)
        corner[:, 1:] = up[:, :-1]
        rows[at, 1:] -= _guess(int(kind), left, up, corner).astype(np.uint8)
    head = struct.pack(">IIBBBBB", WIDTH, len(pixels), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("PNG: signature")
    at = 8
    while at < len(png):
        (size,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body, crc = png[at + 8 : at + 8 + size], png[at + 8 + size : at + 12 + size]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(kind + body):
            raise ValueError(f"PNG: checksum of {kind!r}")
        yield kind, body
        at += 12 + size


def _guess(kind: int, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What a filter type expects of a sample from its neighbours (16-bit numbers)."""
    if kind == 1:
        return left
    if kind == 2:
        return up
    if kind == 3:
        return (left + up) >> 1
    by_left, by_up, by_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    return np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))


def unfilter(raw: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """raw: rows of a filter type and one byte a sample; first: marks the rows that begin an image (none: the very first).

    Types 0 and 1 need no other row. Rows of the other types are undone in waves: those right below a row of type 0 or 1
    (or the top) at once, then those below them, and so on; a wave's rows go column by column together.
    """
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if not len(rows):
        return rows
    if kinds.max() > 4:
        raise ValueError("PNG: filter type")
    if first is None:
        first = np.arange(len(rows)) == 0
    sub = kinds == 1
    rows[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    waiting = kinds >= 2
    # A row's wave is its place in a run of waiting rows; an image's top opens a run.
    place = np.arange(len(rows))
    opens = waiting & (first | ~np.concatenate([[False], waiting[:-1]]))
    wave = np.where(waiting, place - np.maximum.accumulate(np.where(opens, place, 0)), -1)
    order = np.argsort(wave, kind="stable")
    bounds = np.searchsorted(wave[order], np.arange(wave.max() + 2))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        at = order[lo:hi]
        above = np.where(first[at][:, None], 0, rows[at - 1]).astype(np.int16)
        for kind in np.unique(kinds[at]):
            mine = kinds[at] == kind
            here, up = at[mine], above[mine]
            if kind == 2:
                rows[here] += up.astype(np.uint8)
                continue
            left = corner = np.zeros(len(here), dtype=np.int16)
            for x in range(rows.shape[1]):
                left = (rows[here, x] + _guess(int(kind), left, up[:, x], corner)) & 255
                corner = up[:, x]
                rows[here, x] = left
    return rows


def inflated(png: bytes) -> np.ndarray:
    """The filtered rows of an 8-bit grey PNG, every checksum tested."""
    parts = list(chunks(png))
    if not parts or parts[0][0] != b"IHDR" or parts[-1][0] != b"IEND":
        raise ValueError("PNG: order of chunks")
    width, height, depth, colour, packing, filtering, lace = struct.unpack(">IIBBBBB", parts[0][1])
    if (depth, colour, packing, filtering, lace) != (8, 0, 0, 0, 0):
        raise ValueError("PNG: not 8-bit grey without interlace")
    raw = np.frombuffer(zlib.decompress(b"".join(body for kind, body in parts if kind == b"IDAT")), dtype=np.uint8)
    if raw.size != height * (width + 1):
        raise ValueError("PNG: size of the image data")
    return raw.reshape(height, width + 1)


def read_png(png: bytes) -> np.ndarray:
    """The pixels of an 8-bit grey PNG."""
    return unfilter(inflated(png))


def read_all(pngs: list[bytes]) -> list[np.ndarray]:
    """The pixels of each PNG; images of one width are unfiltered together."""
    raws, out = [inflated(p) for p in pngs], [None] * len(pngs)
    by_width: dict[int, list[int]] = {}
    for k, raw in enumerate(raws):
        by_width.setdefault(raw.shape[1], []).append(k)
    for ks in by_width.values():
        ends = np.cumsum([len(raws[k]) for k in ks])
        first = np.zeros(int(ends[-1]), dtype=bool)
        first[[0, *ends[:-1][ends[:-1] < ends[-1]]]] = len(first) > 0
        pixels = unfilter(np.concatenate([raws[k] for k in ks]), first)
        for k, part in zip(ks, np.split(pixels, ends[:-1]), strict=True):
            out[k] = part
    return out


def _means(x: np.ndarray, n: int) -> np.ndarray:
    """Rows averaged into n bands (a row may lie in several if there are fewer than n)."""
    lo = np.arange(n) * len(x) // n
    hi = np.maximum(lo + 1, (np.arange(n) + 1) * len(x) // n)
    sums = np.vstack([np.zeros((1, x.shape[1]), dtype=np.int64), np.cumsum(x, axis=0, dtype=np.int64)])
    return (sums[hi] - sums[lo]) / (hi - lo)[:, None]


def cosine_hash(pixels: np.ndarray) -> bytes:
    """8 bytes: the signs of the low frequencies about their median."""
    small = _means(np.round(_means(pixels, SMALL) * 256).astype(np.int64).T, SMALL).T
    low = (_DCT @ small @ _DCT.T).ravel()
    low = np.round(low, 3)
    return np.packbits(low > np.median(low[1:])).tobytes()


def stored(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write (id, n_bytes, media): each whole text's PNG in a binary column."""
    common.ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(x) for x in data], type=pa.int64()), pa.array([write_png(payload(x)) for x in data], type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "media"])

    frame = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col)).mapInArrow(encode, "id long, n_bytes long, media binary")
    frame.write.option("compression", "uncompressed").parquet(path)
    return docs.sparkSession.read.schema(frame.schema).parquet(path)


FEATURES = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, cosine_hash binary"


def features(media: DataFrame) -> DataFrame:
    """Read the stored files: payload digests, and the cosine hash in a binary column."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            pngs = batch.column(2).to_pylist()
            for png, pixels in zip(pngs, read_all(pngs), strict=True):
                data = pixels.tobytes()
                row = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(pixels))
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return media.select("id", "n_bytes", "media").mapInArrow(decode, FEATURES)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(common.table(spark, sf_dir, "documents"), f"{common.workspace(spark)}/media")
    found = features(media)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("cosine_hash")).alias("feature"))
