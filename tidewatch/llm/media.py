"""Media columns: Netpbm and BMP to arrays, area resize, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
_HEADER = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """Any of P1 to P6 as an array of height x width (x 3); samples above 8 bits are scaled down."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    at, numbers = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _HEADER.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    width, height, top = *numbers[:2], numbers[2] if len(numbers) > 2 else 1
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    count = int(np.prod(shape))
    if kind == b"P1":
        found = re.findall(rb"[01]", re.sub(rb"#[^\n]*", b"", data[at:]))
        samples = 1 - np.array(found[:count], dtype="S1").astype(np.int64)
    elif kind in (b"P2", b"P3"):
        samples = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:count], dtype=np.int64)
    elif kind == b"P4":
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        samples = 1 - np.unpackbits(rows, axis=1)[:, :width].astype(np.int64)
    else:
        samples = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count, at + 1)
    if samples.size != count:
        raise ValueError("too few samples")
    if top < 1 or top > 65535 or (count and int(samples.max()) > top):
        raise ValueError("a sample above the largest one")
    if top == 255:
        return samples.reshape(shape).astype(np.uint8)
    return ((samples.astype(np.int64) * 255 + top // 2) // top).reshape(shape).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP of 8, 24 or 32 bits as height x width x 3, or height x width if its palette is grey."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    offset, header, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    order = [2, 1, 0]  # the bytes of red, green and blue in a pixel
    if packing == 3:
        masks = struct.unpack_from("<III", data, 54)
        if bits == 8 or any(m not in (0xFF, 0xFF00, 0xFF0000, 0xFF000000) for m in masks):
            raise ValueError("only bit fields of whole bytes")
        order = [(m.bit_length() - 1) // 8 for m in masks]
    rows, stride = abs(height), (width * bits // 8 + 3) // 4 * 4
    pixels = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    pixels = pixels[:, : width * bits // 8].reshape(rows, width, bits // 8)
    pixels = pixels if height < 0 else pixels[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(used, 4)
        colours = palette[pixels[:, :, 0]][:, :, 2::-1]
        grey = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
        return colours[:, :, 0] if grey else colours
    return pixels[:, :, order]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area that each output pixel covers, read off an integral image.

    The integral of a piecewise constant image is bilinear within a pixel, so interpolating it at
    fractional corners is exact.
    """
    grey = image.mean(axis=2) if image.ndim == 3 else image.astype(np.float64)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0), axis=1, out=total[1:, 1:])

    def at(edges: np.ndarray, axis: int, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), table.shape[axis] - 2)
        part = (edges - low).reshape((-1, 1) if axis == 0 else (1, -1))
        return np.take(table, low, axis) * (1 - part) + np.take(table, low + 1, axis) * part

    corners = at(np.arange(height + 1) * grey.shape[0] / height, 0, total)
    corners = at(np.arange(width + 1) * grey.shape[1] / width, 1, corners)
    sums = np.diff(np.diff(corners, axis=0), axis=1)
    return sums / (grey.shape[0] / height * grey.shape[1] / width)


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 cells is darker than its right neighbour.

    Cells are rounded to 1/1024 first, so the last bits of a sum do not decide.
    """
    small = np.round(area_resize(image, 8, 9) * 1024)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def write_npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def read_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def text_image(text: str | None) -> tuple[int, bytes]:
    """The unpadded length, and a PGM whose samples are the text's bytes, zero-padded to whole rows of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH)
    return len(raw), encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))


DECODED = "height int, width int, channels int, tile binary, feature string"


def media_columns(media: DataFrame, tile: tuple[int, int] | None = None) -> DataFrame:
    """(id, media binary) to (id, height, width, channels, tile binary, feature string).

    ``tile`` is the NPY form of the image, resized to (height, width) if given, else of all its
    samples. Null, empty or broken media give nulls. Rows are independent: repeated rows repeat.
    """

    def one(data: bytes | None) -> tuple:
        try:
            image = decode(bytes(data))
            if not image.size:
                raise ValueError("no samples")
        except (ValueError, TypeError, struct.error):
            return None, None, None, None, None
        out = image if tile is None else np.round(area_resize(image, *tile)).astype(np.uint8)
        return (*image.shape[:2], image.shape[2] if image.ndim == 3 else 1, write_npy(out), difference_hash(image))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([one(x) for x in batch["media"]], columns=[c.split()[0] for c in DECODED.split(", ")])
            rows = rows.astype({"height": "Int32", "width": "Int32", "channels": "Int32"})
            rows.insert(0, "id", batch["id"].to_numpy())
            yield rows

    return media.select(F.col("id").cast("long").alias("id"), "media").mapInPandas(kernel, f"id long, {DECODED}")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text as an image, decode it, write an NPY tile of all samples, read that back, and take features.

    Null and empty texts are one row of 64 zero samples; repeated rows repeat; an empty table gives
    no rows; other columns are ignored.
    """

    def one(text: str | None) -> tuple:
        n, image = text_image(text)
        stored = write_npy(decode(image))
        back = read_npy(stored)
        payload = back.tobytes()
        return (
            n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]),
            len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(back),
        )

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([one(t) for t in batch["text"]], columns=[c.split()[0] for c in FEATURES.split(", ")[1:]])
            rows.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield rows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(kernel, FEATURES)
