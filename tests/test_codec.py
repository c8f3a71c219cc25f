import math
import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrane.functions import binary, codec

DOUBLES = [0.0, -0.0, 1.0, -1.5, 1e308, -1e308, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.pi, 1 / 3, float("inf"), float("-inf"), 4503599627370496.5]


def line(points, order="<", dims=0):
    width = (2, 3, 3, 4)[dims]
    return struct.pack(order + "BII", order == "<", 1000 * dims + 2, len(points)) + b"".join(struct.pack(f"{order}{width}d", *p) for p in points)


def test_doubles_are_exact(spark):
    rows = [(struct.pack("<d", v), struct.pack(">d", v), v) for v in DOUBLES]
    df = spark.createDataFrame([(bytearray(a), bytearray(b), v) for a, b, v in rows], "a binary, b binary, v double")
    got = df.select(binary.double(F.col("a"), 0).alias("a"), binary.double(F.col("b"), 0, False).alias("b"), "v").collect()
    for r in got:
        assert struct.pack("<d", r.a) == struct.pack("<d", r.v) and struct.pack("<d", r.b) == struct.pack("<d", r.v)
    nan = spark.createDataFrame([(bytearray(struct.pack("<d", math.nan)),)], "a binary").select(binary.double(F.col("a"), 0).alias("a")).first()
    assert math.isnan(nan.a)


def test_header_in_both_orders_and_bad_ones(spark):
    good = codec.header(-1, [1.0, 2.0, 3.0, 4.0], False, True) + line([(1, 3), (2, 4)])
    big = b"GP\0" + bytes([0b0000010]) + struct.pack(">i4d", 27700, 1.0, 2.0, 3.0, 4.0) + line([(1, 3)], ">")
    xyzm = b"GP\0" + bytes([0b0001001]) + struct.pack("<i8d", 5, *range(8)) + line([(1, 3)])
    blobs = [good, big, xyzm, b"", b"GP", b"XP\0\1\0\0\0\0", b"GP\1\1\0\0\0\0", b"GP\0\x0b\0\0\0\0", b"GP\0\3\0\0\0\0\0", None]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in enumerate(blobs)], "k int, b binary").coalesce(1)
    h = binary.header(F.col("b"))
    got = {r.k: r for r in binary.with_header_envelope(df.withColumn("h", h), "b").withColumn("e", binary.header_envelope(F.col("b"))).withColumn("body", binary.body(F.col("b"))).collect()}
    assert (got[0].h.srs_id, got[0].h.extended, got[0].h.body_offset, got[0].minx, got[0].maxy) == (-1, True, 40, 1.0, 4.0)
    assert (got[1].h.srs_id, got[1].h.little, got[1].maxx) == (27700, False, 2.0) and bytes(got[1].body) == line([(1, 3)], ">")
    assert (got[2].h.indicator, got[2].h.body_offset, got[2].miny) == (4, 72, 2.0)
    assert all(got[k].h is None and got[k].minx is None and got[k].e is None for k in range(3, 10))
    assert all((got[k].e and tuple(got[k].e)) == ((got[k].minx, got[k].maxx, got[k].miny, got[k].maxy) if got[k].minx is not None else None) for k in range(10))


finite = st.floats(-1e6, 1e6, allow_nan=False)
any_float = st.floats(allow_nan=True, allow_infinity=True)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(any_float, any_float, any_float), max_size=8), st.sampled_from("<>"), st.sampled_from([1, 3]))
def test_scan_finds_the_box(points, order, dims):
    rows = [(*p, 0.0)[: 3 if dims == 1 else 4] for p in points]
    body = line(rows, order, dims)
    found = codec.scan(body + b"trailing")
    good = [p for p in points if math.isfinite(p[0]) and math.isfinite(p[1])]
    assert found.size == len(body) and found.dimensions == dims and found.empty == (not good)
    if good:
        assert found.box == [min(p[0] for p in good), max(p[0] for p in good), min(p[1] for p in good), max(p[1] for p in good)]
    z = [p[2] for p in points if math.isfinite(p[2])]
    assert (found.z == [min(z), max(z)]) if z else found.z[0] > found.z[1]
    blob, _ = codec.encode(body + b"trailing", 4326)
    values, empty, rest = codec.split_header(blob)
    assert rest == body and empty == (not good) and len(values) == (0 if not good else 6 if z else 4)


def test_nested_and_refused_bodies():
    point = struct.pack("<BIdd", 1, 1, 5.0, 6.0)
    ring = struct.pack("<BII", 1, 3, 1) + struct.pack("<I8d", 4, 0, 0, 4, 0, 4, 3, 0, 0)
    both = struct.pack("<BII", 1, 7, 2) + point + ring
    assert codec.scan(both).box == [0.0, 5.0, 0.0, 6.0]
    arc = struct.pack("<BII6d", 1, 8, 3, -1, 0, 0, 1, 1, 0)
    assert codec.scan(arc).box == [-1.0, 1.0, 0.0, 1.0] and codec.scan(arc).curves == {8}
    with pytest.raises(codec.GeometryError, match="may not hold"):
        codec.encode(struct.pack("<BII", 1, 7, 1) + arc, 0)
    compound = struct.pack("<BII", 1, 9, 1) + arc
    assert codec.encode(compound, 0)[0][3] & 32
    deep = point
    for _ in range(40):
        deep = struct.pack("<BII", 1, 7, 1) + deep
    for bad in (deep, b"", b"\2" + point[1:], point[:-1], struct.pack("<BI", 1, 0x20000001) + b"\0" * 16, struct.pack("<BII", 1, 14, 0), struct.pack("<BI", 1, 15) + b"\0" * 20, struct.pack("<BII", 1, 2, 2**31)):
        with pytest.raises(codec.GeometryError):
            codec.scan(bad)


def test_arcs():
    assert sorted(codec.arc_box((0, 0), (4, 0), (0, 0))) == [(0.0, 0.0), (2.0, -2.0), (2.0, 2.0), (4.0, 0.0)]
    assert codec.arc_box((0, 0), (1, 1), (2, 2)) == [] and codec.arc_box((0, 0), (math.nan, 1), (2, 2)) == []
    assert codec.arc_box((5, 0), (0, 5), (-5, 0)) == [(0.0, 5.0)] or (0.0, 5.0) in codec.arc_box((5, 0), (0, 5), (-5, 0))


@settings(max_examples=80, deadline=None)
@given(st.floats(-100, 100), st.floats(-100, 100), st.floats(0.1, 50), st.floats(0, 6.28), st.floats(0.3, 5.9))
def test_arc_box_holds_the_arc(cx, cy, r, start, sweep):
    at = lambda t: (cx + r * math.cos(t), cy + r * math.sin(t))
    p = [at(start), at(start + sweep / 2), at(start + sweep)]
    xs, ys = zip(*p, *codec.arc_box(*p), strict=True)
    for k in range(50):
        x, y = at(start + sweep * k / 49)
        assert min(xs) - 1e-6 <= x <= max(xs) + 1e-6 and min(ys) - 1e-6 <= y <= max(ys) + 1e-6
    assert max(xs) <= cx + r + 1e-6 and min(ys) >= cy - r - 1e-6
    for direction in (1, -1):  # no extreme that the arc doesn't reach, whichever way it runs
        for x, y in codec.arc_box(*p[::direction]):
            past = (math.atan2(y - cy, x - cx) - start) % math.tau
            assert past <= sweep + 1e-6 or past >= math.tau - 1e-6


def test_spark_encoders_agree_with_the_walker(spark):
    rows = [(1.0, 2.0), (3.5, -4.25), (None, None), (math.nan, math.nan), (math.inf, 1.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "x double, y double").coalesce(1)
    for with_envelope in (True, False):
        blobs = df.select("x", "y", codec.encode_points(4326, with_envelope)(F.col("x"), F.col("y")).alias("b"))
        for r in blobs.withColumn("e", codec.envelopes()(F.col("b"))).collect():
            if r.x is None and r.y is None:
                assert r.b is None and r.e is None
            elif r.x is not None and r.y is not None and math.isfinite(r.x) and math.isfinite(r.y):
                assert tuple(r.e) == (r.x, r.x, r.y, r.y) and codec.wkt(bytes(r.b)) == f"POINT ({r.x!r} {r.y!r})"
                assert bytes(r.b) == (codec.encode(struct.pack("<BIdd", 1, 1, r.x, r.y), 4326)[0] if with_envelope else codec.header(4326, [], False, False) + struct.pack("<BIdd", 1, 1, r.x, r.y))
            else:
                assert r.e is None and bytes(r.b)[3] & 16
    flat = spark.createDataFrame([([0.0, 0.0, 10.0, -3.0, 4.0, 8.0],), ([],), (None,)], "v array<double>").select(codec.encode_lines(0)(F.col("v")).alias("b")).collect()
    assert codec.wkt(bytes(flat[0].b)) == "LINESTRING (0.0 0.0, 10.0 -3.0, 4.0 8.0)" and bytes(flat[1].b)[3] & 16 and flat[2].b is None


def test_malformed_blobs_are_data_not_errors(spark):
    df = spark.createDataFrame([(bytearray(b),) for b in (b"GP\0\1\0\0\0\0\1", b"nonsense", codec.header(0, [], True, False))], "b binary")
    assert [r.e for r in df.select(codec.envelopes()(F.col("b")).alias("e")).collect()] == [None] * 3
    enc = df.select(codec.encode_wkb(0)(F.col("b")).alias("e")).collect()
    assert all(r.e.geom is None and r.e.error for r in enc)


def test_plain_bodies_are_encoded_without_a_walk(monkeypatch):
    """Points and lines of a batch at once give what the walk gives, beside bodies that are walked or refused."""
    nan, inf = math.nan, math.inf
    plain = [line([]), line([(1, 3), (2, -4)]), line([(nan, 1), (5, 6)]), line([(inf, 1)]), line([(0, 0)]) + b"trailing", struct.pack("<BIdd", 1, 1, 7.5, 8), struct.pack("<BIdd", 1, 1, nan, nan), None]
    odd = [b"", b"\1\2", line([(1, 2)])[:-1], line([(1, 2)], ">"), line([(1, 2, 3)], "<", 1), struct.pack("<BII", 1, 2, 2**32 - 1), struct.pack("<BII", 1, 4, 0)]
    for bodies in (plain, odd, plain + odd, odd[::-1] + plain[::-1], []):
        got = codec.encode_wkb(4326).func(pa.array([None, *bodies], pa.binary()).slice(1)).to_pylist()
        for b, r in zip(bodies, got, strict=True):
            try:
                blob, found = codec.encode(b, 4326) if b is not None else (None, None)
            except codec.GeometryError as e:
                assert r["error"] == str(e) and r["geom"] is None
                continue
            assert (r["geom"], r["error"], r["geom_empty"]) == (blob, None, found and found.empty)
            assert [r[c] for c in ("minx", "maxx", "miny", "maxy")] == (found.box if found and not found.empty else [None] * 4)
    monkeypatch.setattr(codec, "scan", lambda _: pytest.fail("walked"))
    codec.encode_wkb(4326).func(pa.array(plain, pa.binary()))
    codec.encode_lines(0).func(pa.array([[1.0, 2.0, 3.0], [], None, [None, 1.0]], pa.list_(pa.float64())))


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 100])
def test_lines_of_runs(rows):
    """Runs of keys that batches of any size cut, among them a null key and one that fills several batches."""
    keys = [None, None, 1, 2, 2, *[3] * 9, 4, 0, 0]
    table = pa.table({"fid": pa.array(keys, pa.int64()), "x": [float(k) for k in range(len(keys))], "y": pa.array([None if k == 3 else -1.0 - k for k in range(len(keys))])})
    got = [(r["fid"], r["geom"]) for b in codec.lines_of_runs(0)(iter(table.to_batches(max_chunksize=rows))) for r in b.to_pylist()]
    want = []
    for key in (None, 1, 2, 3, 4, 0):
        own = [k for k, v in enumerate(keys) if v == key]
        want.append((key, codec.encode(line([(k, math.nan if k == 3 else -1 - k) for k in own]), 0)[0]))
    assert got == want
