"""Kind and pixel size of a tile payload, read from its header: PNG, JPEG, WebP, TIFF."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Magic bytes, the JPEG markers that start a frame, and what the base tile class allows.
PNG, JPEG, TIFF = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", (b"II*\0", b"MM\0*")
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
CORE = ("png", "jpeg")
SIZES = StructType([StructField("format", StringType()), StructField("width", LongType()), StructField("height", LongType())])


def _jpeg(b: bytes) -> tuple[int, int]:
    at = 2
    while True:
        while b[at] == 0xFF and b[at + 1] == 0xFF:  # fill bytes
            at += 1
        marker, (size,) = b[at + 1], struct.unpack(">H", b[at + 2 : at + 4])
        if b[at] != 0xFF:
            raise ValueError("no marker")
        if marker in FRAMES:
            height, width = struct.unpack(">HH", b[at + 5 : at + 9])
            return width, height
        at += 2 + size


def _webp(b: bytes) -> tuple[int, int]:
    kind = b[12:16]
    if kind == b"VP8X":
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
    if kind == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        if b[20] != 0x2F or len(b) < 25:
            raise ValueError("lossless header")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and b[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", b[26:30])
        return width & 0x3FFF, height & 0x3FFF
    raise ValueError("unknown chunk")


def _tiff(b: bytes) -> tuple[int, int]:
    end = "<" if b[:2] == b"II" else ">"
    (at,) = struct.unpack(end + "I", b[4:8])
    (n,) = struct.unpack(end + "H", b[at : at + 2])
    found = {}
    for k in range(n):
        entry = b[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind = struct.unpack(end + "HH", entry[:4])
        if tag in (256, 257):
            (found[tag],) = struct.unpack(end + ("H" if kind == 3 else "I"), entry[8:10] if kind == 3 else entry[8:12])
    return found[256], found[257]


def probe(payload: bytes | None) -> tuple[str, int, int] | None:
    """(format, width, height); None for null, a header that ends early, or anything else."""
    b = payload or b""
    try:
        if b.startswith(PNG) and b[12:16] == b"IHDR":
            return "png", *struct.unpack(">II", b[16:24])
        if b.startswith(JPEG):
            return "jpeg", *_jpeg(b)
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            return "webp", *_webp(b)
        if b[:4] in TIFF:
            return "tiff", *_tiff(b)
    except (struct.error, IndexError, KeyError, ValueError):
        pass
    return None


def probes():
    """Arrow function: payload to format, width and height."""

    @F.arrow_udf(SIZES)
    def run(payload: pa.Array) -> pa.Array:
        out = [p and dict(zip(SIZES.names, p, strict=True)) for p in map(probe, payload.to_pylist())]
        return pa.array(out, pa.struct([("format", pa.string()), ("width", pa.int64()), ("height", pa.int64())]))

    return run


def looks_like_one(payload: Column) -> Column:
    """Whether a payload begins as one of the four formats does."""
    starts = lambda *magic: F.hex(F.substring(payload, 1, len(magic[0]))).isin(*[m.hex().upper() for m in magic])
    webp = starts(b"RIFF") & (F.hex(F.substring(payload, 9, 4)) == b"WEBP".hex().upper())
    return F.coalesce(starts(PNG) | starts(JPEG) | starts(*TIFF) | webp, F.lit(False))
