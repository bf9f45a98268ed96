"""Walks through the structure of image files, from the signature to the end mark.

PNG: every chunk with its length and CRC, header first, image data, end last, nothing after. JPEG: every segment
with its length, frame and scan headers that agree with their number of components, scan data with
only the marks that may stand in it, end mark last. WebP: the size in the RIFF header and that of every chunk add up to the
file, and the first chunk is an image of a known kind with a plausible header.

A PNG with any byte changed is found. JPEG and WebP have no sums over their image data: there a change is
found where it breaks the structure, a cut always.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures and marks of the formats.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_CHANNELS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
JPEG_FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
JPEG_ALONE = {0x01, *range(0xD0, 0xD8)}
WEBP_KINDS = {b"VP8 ", b"VP8L", b"VP8X"}


def png_ok(data: bytes) -> bool:
    """Whole PNG: all chunks with right sums, a sound header, image data, and the end."""
    if data[:8] != PNG_SIGNATURE:
        return False
    at, order = 8, []
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        end = at + 12 + size
        if end > len(data) or zlib.crc32(data[at + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return False
        if not order:
            if kind != b"IHDR" or size != 13:
                return False
            width, height, depth, color = struct.unpack_from(">IIBB", data, at + 8)
            if not width or not height or depth not in PNG_CHANNELS.get(color, ()):
                return False
        order.append(kind)
        at = end
        if kind == b"IEND":
            break
    return bool(order) and order[-1] == b"IEND" and b"IDAT" in order and at == len(data)


def jpeg_ok(data: bytes) -> bool:
    """Whole JPEG: segments that follow each other up to a scan, its data, and the end mark."""
    if data[:2] != b"\xff\xd8":
        return False
    at, parts, scans = 2, 0, 0
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            return False
        mark = data[at + 1]
        if mark == 0xFF:  # filling
            at += 1
            continue
        at += 2
        if mark == 0xD9:
            return scans > 0 and at == len(data)
        if mark in JPEG_ALONE:
            continue
        if mark < 0xC0 or at + 2 > len(data):
            return False
        (size,) = struct.unpack_from(">H", data, at)
        if size < 2 or at + size > len(data):
            return False
        if mark in JPEG_FRAMES:
            if size < 8:
                return False
            _, height, width, parts = struct.unpack_from(">BHHB", data, at + 2)
            if not width or not parts or size != 8 + 3 * parts:
                return False
        at += size
        if mark == 0xDA:
            inside = data[at - size + 2]
            if not 0 < inside <= parts or size != 6 + 2 * inside:
                return False
            scans += 1
            at = _scan_end(data, at)
    return False


def _scan_end(data: bytes, at: int) -> int:
    """Where the data of a scan ends: the next mark that is neither a stuffed byte nor a restart."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return len(data)
        following = data[at + 1]
        if following == 0 or 0xD0 <= following <= 0xD7:
            at += 2
        elif following == 0xFF:
            at += 1
        else:
            return at


def webp_ok(data: bytes) -> bool:
    """Whole WebP: RIFF and chunk sizes add up, and the image chunk begins as its kind must."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        return False
    (size,) = struct.unpack_from("<I", data, 4)
    if size + 8 != len(data):
        return False
    at, kinds = 12, []
    while at + 8 <= len(data):
        kind, own = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body, at = at + 8, at + 8 + own + own % 2
        if at > len(data):
            return False
        if kind == b"VP8 " and (own < 10 or data[body + 3 : body + 6] != b"\x9d\x01\x2a"):
            return False
        if kind == b"VP8L" and (own < 5 or data[body] != 0x2F or data[body + 4] >> 5):
            return False
        if kind == b"VP8X" and own != 10:
            return False
        kinds.append(kind)
    has_image = b"VP8 " in kinds or b"VP8L" in kinds or b"ANMF" in kinds
    return at == len(data) and bool(kinds) and kinds[0] in WEBP_KINDS and has_image


def image_ok(data: bytes | None) -> bool:
    """Whether a file is a whole JPEG, PNG or WebP; false for a missing or empty one."""
    return bool(data) and (png_ok(data) or jpeg_ok(data) or webp_ok(data))


def _all_ok(content: pd.Series) -> pd.Series:
    return content.map(image_ok).astype(bool)


def structure_ok(content: Column) -> Column:
    """:func:`image_ok` of a column of files, in Arrow batches."""
    return F.pandas_udf(_all_ok, "boolean")(content)
