import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from authorloom.functions.images import image_ok, jpeg_ok, png_ok, webp_ok
from authorloom.operators.media import drop_damaged
from authorloom.sources.media import read_media, read_media_folders


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width=7, height=5, seed=0):
    rng = random.Random(seed)
    raw = b"".join(b"\0" + rng.randbytes(3 * width) for _ in range(height))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    packed = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", packed[:20]) + chunk(
        b"IDAT", packed[20:]
    ) + chunk(b"IEND", b"")


def segment(mark, data):
    return bytes((0xFF, mark)) + struct.pack(">H", len(data) + 2) + data


def jpeg(scans=1):
    frame = struct.pack(">BHHB", 8, 16, 24, 3) + b"\x01\x22\0\x02\x11\x01\x03\x11\x01"
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + segment(0xDB, b"\0" + bytes(range(1, 65)))
    out += segment(0xC2 if scans > 1 else 0xC0, frame) + segment(0xC4, b"\0" + bytes(16))
    for _ in range(scans):
        out += segment(0xDA, b"\x03\x01\0\x02\x11\x03\x11\0\x3f\0") + b"\x12\x34\xff\0\x56\xff\xd0\x78\x9a\xff\xff\0"
    return out + b"\xff\xd9"


def riff(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for k, d in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


LOSSLESS = riff((b"VP8L", b"\x2f\x03\0\0\0" + b"abcdef"))
LOSSY = riff((b"VP8 ", b"\x10\0\0\x9d\x01\x2a\x08\0\x08\0" + b"data"))
EXTENDED = riff((b"VP8X", bytes(10)), (b"EXIF", b"odd"), (b"VP8 ", b"\x10\0\0\x9d\x01\x2a\x08\0\x08\0"))
WHOLE = [(png_ok, png()), (png_ok, png(1, 1)), (jpeg_ok, jpeg()), (jpeg_ok, jpeg(3)), (webp_ok, LOSSLESS), (webp_ok, LOSSY), (webp_ok, EXTENDED)]


@pytest.mark.parametrize(("walk", "data"), WHOLE)
def test_whole_files_stay_and_cut_ones_go(walk, data):
    assert walk(data) and image_ok(data)
    assert sum(f(data) for f in (png_ok, jpeg_ok, webp_ok)) == 1
    assert not any(image_ok(data[:n]) for n in range(len(data)))
    assert not image_ok(data + b"\0\0")
    assert not image_ok(data[1:])


def test_any_changed_bit_of_a_png():
    data = png()
    for at in range(len(data)):
        for bit in range(8):
            changed = bytearray(data)
            changed[at] ^= 1 << bit
            assert not image_ok(bytes(changed)), (at, bit)


@pytest.mark.parametrize("data", [jpeg(), jpeg(2), LOSSLESS, LOSSY, EXTENDED])
def test_changed_structure_of_others(data):
    """Signatures, sizes, marks and headers; image data has no sums in these formats."""
    fatal = 0
    for at in range(min(20, len(data))):
        changed = bytearray(data)
        changed[at] ^= 0x80
        fatal += not image_ok(bytes(changed))
    assert fatal >= 6
    assert not image_ok(data.replace(b"\xff\xd9", b"\xff\x01").replace(b"RIFF", b"RIFX"))


def test_swapped_and_missing_parts():
    whole = png()
    header, rest = whole[8:33], whole[33:]
    assert not png_ok(whole[:8] + rest) and not png_ok(whole[:8] + rest[:-12] + header + rest[-12:])
    assert not png_ok(whole[:8] + header + whole[-12:])
    assert not jpeg_ok(jpeg(0)) and not image_ok(b"") and not image_ok(None)
    assert not webp_ok(riff((b"EXIF", b"ab"))) and not webp_ok(riff())


@pytest.fixture
def folders(tmp_path):
    names = ["a1", "a2", "b1", "f0", "zz", "0a"]
    for name in names:
        for i, data in enumerate((png(seed=1), jpeg(), LOSSLESS[:-1])):
            path = tmp_path / "media" / name / f"image{i}.bin"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(data)
    (tmp_path / "media" / "loose.txt").write_text("not in a folder")
    (tmp_path / "media" / "empty").mkdir()
    return str(tmp_path / "media")


def test_damaged_images_are_dropped(spark, folders, rows):
    left = drop_damaged(read_media(spark, folders))
    assert rows(left, "content_id", "image") == [(n, f"image{i}.bin") for n in ("0a", "a1", "a2", "b1", "f0", "zz") for i in (0, 1)]


def test_folders_listed_by_tasks(spark, folders, rows):
    columns = ["content_id", "image", "length", "content"]
    expected = rows(read_media(spark, folders).where("content_id != 'media'"), *columns)
    got = read_media_folders(spark, folders)
    assert rows(got, *columns) == expected and got.rdd.getNumPartitions() == 17
    assert rows(read_media_folders(spark, folders, prefixes="a,zz"), *columns) == expected
    assert "content" not in read_media_folders(spark, folders, with_bytes=False).columns
    assert read_media_folders(spark, folders, with_bytes=False).count() == len(expected)
    assert read_media_folders(spark, folders + "/none").count() == 0


def test_filters_leave_matching_folders_only(spark, folders, rows):
    media = read_media_folders(spark, folders, with_bytes=False)
    some = media.where(F.col("content_id").startswith("a"))
    assert rows(some, "content_id") == [("a1",)] * 3 + [("a2",)] * 3 and some.rdd.getNumPartitions() == 2
    named = media.where(F.col("content_id").isin("a2", "zz", "nobody"))
    assert rows(named, "content_id") == [("a2",)] * 3 + [("zz",)] * 3 and named.rdd.getNumPartitions() == 2
    one = media.where("content_id = 'f0' and image = 'image1.bin'")
    assert rows(one, "content_id", "image") == [("f0", "image1.bin")] and one.rdd.getNumPartitions() == 1
    assert media.where("content_id = 'a1' and content_id = 'b1'").count() == 0
