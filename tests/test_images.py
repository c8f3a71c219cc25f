import struct

import pytest
from pyspark.sql import functions as F

from terrane.functions import images

PNG = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + struct.pack(">II", 256, 128)
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9) + b"\xff\xff\xc2" + struct.pack(">HBHH", 17, 8, 300, 400) + bytes(10)
WEBP_X = b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + bytes(4) + (511).to_bytes(3, "little") + (255).to_bytes(3, "little")
WEBP_L = b"RIFF\0\0\0\0WEBPVP8L" + struct.pack("<I", 10) + b"\x2f" + (99 | 49 << 14).to_bytes(4, "little")
WEBP = b"RIFF\0\0\0\0WEBPVP8 " + struct.pack("<I", 10) + bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", 640, 480)
TIFF = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHxx", 256, 3, 1, 77) + struct.pack("<HHII", 257, 4, 1, 88)
BIG = b"MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHIHxx", 256, 3, 1, 77) + struct.pack(">HHII", 257, 4, 1, 88)
CASES = [(PNG, ("png", 256, 128)), (JPEG, ("jpeg", 400, 300)), (WEBP_X, ("webp", 512, 256)), (WEBP_L, ("webp", 100, 50)), (WEBP, ("webp", 640, 480)), (TIFF, ("tiff", 77, 88)), (BIG, ("tiff", 77, 88)), (b"GIF89a", None), (b"", None), (None, None)]


@pytest.mark.parametrize(("payload", "want"), CASES)
def test_probe(payload, want):
    assert images.probe(payload) == want
    for k in range(len(payload or b"")):
        images.probe(payload[:k])  # a header that ends early doesn't crash


def test_in_spark(spark):
    df = spark.createDataFrame([(k, None if p is None else bytearray(p)) for k, (p, _) in enumerate(CASES)], "k int, p binary").coalesce(1)
    got = {r.k: r.s and tuple(r.s) for r in df.select("k", images.probes()(F.col("p")).alias("s")).collect()}
    assert got == {k: w for k, (_, w) in enumerate(CASES)}
