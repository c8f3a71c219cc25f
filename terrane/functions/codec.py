"""Encoding geometry blobs and walking WKB bodies, as Arrow functions over whole batches.

Envelope rules: a pair counts only if both its coordinates are finite; Z ranges over every finite Z; M never
widens; a body without a finite pair is empty and gets no envelope.  Arcs count with the extremes of their
circle that they reach.
"""

from __future__ import annotations

import cmath
import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from terrane.functions.types import GEOMETRY_TYPES

# Nesting allowed, tolerance under which three points count as collinear.
MAX_DEPTH, COLLINEAR = 32, 1e-14
POINT, LINE, POLYGON, CIRCULAR = 1, 2, 3, 8


class GeometryError(ValueError):
    """A blob or body that is malformed or that may not be written."""


def arc_box(first: tuple[float, float], middle: tuple[float, float], last: tuple[float, float]) -> list[tuple[float, float]]:
    """Extremes of its circle that the arc through three points reaches; none for a straight or broken one.

    Equal end points mean a full circle with first-middle as a diameter.  The centre lies where the bisectors of
    the two chords from the middle point cross; an extreme counts if the turn from the first point through
    the middle one to the last passes its direction.
    """
    a, m, b = (complex(*p) for p in (first, middle, last))
    if a == b:
        centre = a + (m - a) / 2
        passed = lambda turn: True
    else:
        u, v = a - m, b - m
        area = (u.conjugate() * v).imag  # twice the triangle's, signed
        longest = max(abs(u.real), abs(u.imag), abs(v.real), abs(v.imag))
        if not math.isfinite(area) or abs(area) <= COLLINEAR * longest * longest:
            return []
        # A point of the first bisector is u/2 + t i u; the second one's condition |c| = |c - v| gives t.
        t = ((v - u) * v.conjugate()).real / (2 * area)
        centre = m + u / 2 + complex(0, t) * u
        start = cmath.phase(a - centre)
        sweep = lambda z: (cmath.phase(z) - start) % math.tau
        if sweep(m - centre) <= sweep(b - centre):
            passed = lambda turn: (turn - start) % math.tau <= sweep(b - centre)
        else:
            passed = lambda turn: (start - turn) % math.tau <= (start - cmath.phase(b - centre)) % math.tau
    radius = abs(m - centre)
    if not (cmath.isfinite(centre) and math.isfinite(radius)):
        return []
    cardinal = {0.0: radius, math.pi / 2: complex(0, radius), math.pi: -radius, -math.pi / 2: complex(0, -radius)}
    return [((centre + away).real, (centre + away).imag) for turn, away in cardinal.items() if passed(turn)]


@dataclass
class Scan:
    """What one walk of a WKB body finds."""

    dimensions: int = 0
    size: int = 0
    box: list[float] = field(default_factory=lambda: [math.inf, -math.inf, math.inf, -math.inf])
    z: list[float] = field(default_factory=lambda: [math.inf, -math.inf])
    curves: set[int] = field(default_factory=set)

    @property
    def empty(self) -> bool:
        return self.box[0] > self.box[1]

    def add(self, xy: np.ndarray, z: np.ndarray | None) -> None:
        good = np.isfinite(xy).all(axis=1)
        if good.any():
            (x0, y0), (x1, y1) = xy[good].min(axis=0).tolist(), xy[good].max(axis=0).tolist()
            b = self.box
            self.box = [min(b[0], x0), max(b[1], x1), min(b[2], y0), max(b[3], y1)]
        if z is not None and (z := z[np.isfinite(z)]).size:
            self.z = [min(self.z[0], float(z.min())), max(self.z[1], float(z.max()))]


def scan(body: bytes) -> Scan:
    """Walk an ISO WKB body; GeometryError if it is malformed, nested too deep, abstract or of the extended dialect."""
    out = Scan()
    view = memoryview(body)

    def take(at: int, size: int) -> memoryview:
        if at + size > len(view):
            raise GeometryError("the body ends early")
        return view[at : at + size]

    def walk(at: int, depth: int) -> tuple[int, int]:
        if depth > MAX_DEPTH:
            raise GeometryError("nested too deep")
        order = take(at, 1)[0]
        if order > 1:
            raise GeometryError(f"byte order {order}")
        end = "<" if order else ">"
        (code,) = struct.unpack(end + "I", take(at + 1, 4))
        base, dims = code % 1000, code // 1000
        if code & 0xE0000000 or dims > 3 or not 1 <= base <= 14:
            raise GeometryError(f"type code {code}")
        at += 5
        width = (2, 3, 3, 4)[dims]
        if base >= CIRCULAR:
            out.curves.add(base)

        def points(at: int, n: int) -> tuple[int, np.ndarray]:
            xy = np.frombuffer(take(at, 8 * width * n), dtype=end + "f8").reshape(n, width)
            out.add(xy[:, :2], xy[:, 2] if dims in (1, 3) else None)
            return at + 8 * width * n, xy

        def count(at: int) -> tuple[int, int]:
            return at + 4, struct.unpack(end + "I", take(at, 4))[0]

        if base == POINT:
            at, _ = points(at, 1)
        elif base in (LINE, CIRCULAR):
            at, n = count(at)
            at, xy = points(at, n)
            if base == CIRCULAR:
                p = [tuple(q) for q in xy[:, :2].tolist()]
                for k in range(2, n, 2):
                    if extra := arc_box(p[k - 2], p[k - 1], p[k]):
                        out.add(np.array(extra), None)
        elif base == POLYGON:
            at, n = count(at)
            for _ in range(n):
                at, k = count(at)
                at, _ = points(at, k)
        elif base in (13, 14):
            raise GeometryError("an abstract type has no body")
        else:
            at, n = count(at)
            for _ in range(n):
                at, _ = walk(at, depth + 1)
        return at, dims

    out.size, out.dimensions = walk(0, 0)
    return out


def header(srs_id: int, envelope: list[float], empty: bool, extended: bool) -> bytes:
    """Little-endian header: no envelope, XY (4 doubles) or XYZ (6)."""
    indicator = {0: 0, 4: 1, 6: 2}[len(envelope)]
    return struct.pack(f"<2sBBi{len(envelope)}d", b"GP", 0, 1 | indicator << 1 | empty << 4 | extended << 5, srs_id, *envelope)


def encode(body: bytes, srs_id: int) -> tuple[bytes, Scan]:
    """A blob from a WKB body, which is cut where the walk ends; curves inside a core container are refused."""
    found = scan(body)
    own = struct.unpack("<I" if body[0] else ">I", body[1:5])[0] % 1000
    if own < CIRCULAR and found.curves:
        raise GeometryError(f"{GEOMETRY_TYPES[own]} may not hold {GEOMETRY_TYPES[min(found.curves)]}")
    box = [] if found.empty else found.box + (found.z if found.z[0] <= found.z[1] else [])
    return header(srs_id, box, found.empty, own >= CIRCULAR) + body[: found.size], found


def split_header(blob: bytes) -> tuple[list[float], bool, bytes]:
    """Envelope values, empty flag and body of a blob; GeometryError if the header is bad."""
    if len(blob) < 8 or blob[:2] != b"GP" or blob[2]:
        raise GeometryError("bad header")
    kind = blob[3] >> 1 & 7
    if kind > 4:
        raise GeometryError(f"envelope indicator {kind}")
    n = (0, 4, 6, 6, 8)[kind]
    if len(blob) < 8 + 8 * n:
        raise GeometryError("the header ends early")
    return list(struct.unpack(f"{'<' if blob[3] & 1 else '>'}{n}d", blob[8 : 8 + 8 * n])), bool(blob[3] & 16), blob[8 + 8 * n :]


def envelope_of(blob: bytes | None) -> tuple[float, float, float, float] | None:
    """minx, maxx, miny, maxy: none for null, the empty flag or no finite pair; the header's where it has one, else by walking."""
    if blob is None:
        return None
    values, empty, rest = split_header(blob)
    if empty:
        return None
    if values:
        return None if any(map(math.isnan, values[:4])) else tuple(values[:4])
    found = scan(rest)
    return None if found.empty else tuple(found.box)


BOX = StructType([StructField(n, DoubleType()) for n in ("minx", "maxx", "miny", "maxy")])
SCANNED = StructType([*BOX.fields, StructField("geom_empty", BooleanType()), StructField("geom_type", IntegerType()), StructField("dims", IntegerType()), StructField("error", StringType())])
ENCODED = StructType([StructField("geom", BinaryType()), *SCANNED.fields])


def _box_array(boxes: list) -> pa.Array:
    return pa.array([None if b is None else dict(zip(("minx", "maxx", "miny", "maxy"), b, strict=True)) for b in boxes], pa.struct([(n, pa.float64()) for n in ("minx", "maxx", "miny", "maxy")]))


def envelopes():
    """Arrow function: blob to minx, maxx, miny, maxy, walking the body where the header has no envelope; null if empty or malformed."""

    @F.arrow_udf(BOX)
    def run(blob: pa.Array) -> pa.Array:
        out = []
        for b in blob.to_pylist():
            try:
                out.append(envelope_of(b))
            except GeometryError:
                out.append(None)
        return _box_array(out)

    return run


def encode_points(srs_id: int, with_envelope: bool = True):
    """Arrow function: x and y to point blobs, a batch at once; a null or non-finite pair is an empty point, null in both is null."""

    @F.arrow_udf(BinaryType())
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        none = np.array(x.is_null()) & np.array(y.is_null())
        xs, ys = (np.array(c.cast(pa.float64()).fill_null(math.nan), dtype="<f8") for c in (x, y))
        good = np.isfinite(xs) & np.isfinite(ys)
        size = 61 if with_envelope else 29
        rows = np.zeros((len(xs), size), dtype=np.uint8)
        rows[:, :8] = np.frombuffer(header(srs_id, [0.0] * (4 if with_envelope else 0), False, False)[:8], dtype=np.uint8)
        if with_envelope:
            rows[:, 8:40] = np.column_stack((xs, xs, ys, ys)).view(np.uint8).reshape(-1, 32)
        rows[:, -21:-16] = np.frombuffer(struct.pack("<BI", 1, POINT), dtype=np.uint8)
        rows[:, -16:] = np.column_stack((xs, ys)).view(np.uint8).reshape(-1, 16)
        hollow = header(srs_id, [], True, False) + struct.pack("<BIdd", 1, POINT, math.nan, math.nan)
        data = rows.tobytes()
        return pa.array([None if n else data[k * size : (k + 1) * size] if g else hollow for k, (n, g) in enumerate(zip(none.tolist(), good.tolist(), strict=True))], pa.binary())

    return run


def _boxes(xy: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """minx, maxx, miny, maxy of runs of so many pairs, over finite pairs; inf, -inf, inf, -inf where a run has none."""
    out = np.tile(np.array([math.inf, -math.inf, math.inf, -math.inf]), (len(counts), 1))
    held = counts > 0
    if held.any():
        good = np.isfinite(xy).all(axis=1)[:, None]
        first = (np.cumsum(counts) - counts)[held]
        out[held, 0::2] = np.minimum.reduceat(np.where(good, xy, math.inf), first)
        out[held, 1::2] = np.maximum.reduceat(np.where(good, xy, -math.inf), first)
    return out


def _headed(boxes: np.ndarray, srs_id: int, bodies: Iterable[bytes]) -> list[bytes]:
    """Blobs of core XY bodies whose boxes are known."""
    heads = np.empty((len(boxes), 40), dtype=np.uint8)
    heads[:, :8] = np.frombuffer(header(srs_id, [0.0] * 4, False, False)[:8], dtype=np.uint8)
    heads[:, 8:] = np.ascontiguousarray(boxes, dtype="<f8").view(np.uint8).reshape(-1, 32)
    data, hollow = heads.tobytes(), header(srs_id, [], True, False)
    return [(hollow if e else data[40 * k : 40 * k + 40]) + b for k, (e, b) in enumerate(zip((boxes[:, 0] > boxes[:, 1]).tolist(), bodies, strict=True))]


def _lines(xy: np.ndarray, counts: np.ndarray, srs_id: int) -> list[bytes]:
    """Blobs of lines of so many pairs each."""
    heads = np.empty((len(counts), 9), dtype=np.uint8)
    heads[:, :5] = np.frombuffer(struct.pack("<BI", 1, LINE), dtype=np.uint8)
    heads[:, 5:] = counts.astype("<u4").view(np.uint8).reshape(-1, 4)
    data, drawn, ends = heads.tobytes(), xy.tobytes(), (16 * np.cumsum(counts)).tolist()
    bodies = (data[9 * k : 9 * k + 9] + drawn[a:b] for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)))
    return _headed(_boxes(xy, counts), srs_id, bodies)


def encode_lines(srs_id: int):
    """Arrow function: a flat list of coordinates x0, y0, x1, y1 and so on to line blobs, a batch at once."""

    @F.arrow_udf(BinaryType())
    def run(flat: pa.Array) -> pa.Array:
        there = np.array(flat.is_valid(), dtype=bool)
        lists = flat.drop_null()
        sizes = np.array(lists.value_lengths(), dtype=np.int64)
        values = np.array(lists.flatten().cast(pa.float64()).fill_null(math.nan), dtype="<f8")
        odd = (np.cumsum(sizes) - 1)[sizes % 2 == 1]  # a last coordinate without its pair
        xy, counts = np.delete(values, odd).reshape(-1, 2), sizes // 2
        blobs = iter(_lines(xy, counts, srs_id))
        return pa.array([next(blobs) if t else None for t in there.tolist()], pa.binary())

    return run


def lines_of_runs(srs_id: int):
    """For mapInArrow: rows of (key, x, y) in the order of their keys to (key, geom), a line for each run of equal keys through its pairs in their order."""

    def starts(keys: pa.Array, before: pa.Scalar | None) -> np.ndarray:
        """Where a run begins; the first row goes on with the one before, if they are equal."""
        fresh = np.ones(len(keys), dtype=bool)
        there, values = np.array(keys.is_valid(), dtype=bool), np.array(keys.fill_null(0))
        fresh[1:] = (values[1:] != values[:-1]) | (there[1:] != there[:-1])
        fresh[0] = before is None or before.as_py() != keys[0].as_py()
        return np.flatnonzero(fresh)

    def drawn(pending: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, x, y = (pa.concat_arrays([b.column(k) for b in pending]) for k in range(3))
        xy = np.column_stack([np.array(c.cast(pa.float64()).fill_null(math.nan), dtype="<f8") for c in (x, y)])
        at = starts(keys, None)
        lines = _lines(np.ascontiguousarray(xy), np.diff(at, append=len(xy)), srs_id)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(lines, pa.binary())], [pending[0].schema.names[0], "geom"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            found = starts(batch.column(0), pending[-1].column(0)[-1] if pending else None)
            last = int(found[-1]) if len(found) else -1
            if last > 0 or (last == 0 and pending):  # the last run may go on in the next batch
                yield drawn([*pending, batch.slice(0, last)])
                pending = []
            pending.append(batch.slice(max(last, 0)))
        if pending:
            yield drawn(pending)

    return run


def _plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of bodies in data: which are whole little-endian XY points and lines, and of those the type, the number of pairs and where they begin."""
    kind, pairs = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    long = np.flatnonzero(ends - starts >= 9)
    if len(long):
        first = data[starts[long][:, None] + np.arange(9)]
        codes = np.ascontiguousarray(first[:, 1:5]).view("<u4").ravel().astype(np.int64)
        kind[long] = np.where((first[:, 0] == 1) & np.isin(codes, (POINT, LINE)), codes, 0)
        pairs[long] = np.where(codes == POINT, 1, np.ascontiguousarray(first[:, 5:9]).view("<u4").ravel())
    begin = starts + np.where(kind == POINT, 5, 9)
    plain = (kind > 0) & (begin + 16 * pairs <= ends)
    return plain, kind[plain], pairs[plain], begin[plain]


def encode_wkb(srs_id: int):
    """Arrow function: WKB body to blob with its sidecar columns; error instead of a blob where it is refused.

    Points and lines as nearly all writers make them, little-endian and XY, are done a batch at once; any other body is walked.
    """

    @F.arrow_udf(ENCODED)
    def run(body: pa.Array) -> pa.Array:
        out: dict[str, list] = {n: [None] * len(body) for n in ENCODED.names}
        there = np.flatnonzero(np.array(body.is_valid(), dtype=bool))
        whole = body.drop_null().cast(pa.large_binary())
        at = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, dtype=np.int64)
        raw = memoryview(whole.buffers()[2] or b"") if len(whole) else memoryview(b"")
        data = np.frombuffer(raw, dtype=np.uint8)
        plain, kind, pairs, begin = _plain(data, at[:-1], at[1:])
        if len(kind):
            edges = np.zeros(len(data) + 1, dtype=np.int8)
            held = pairs > 0
            edges[begin[held]] += 1
            edges[(begin + 16 * pairs)[held]] -= 1
            xy = data[np.cumsum(edges[:-1], dtype=np.int8).view(bool)].view("<f8").reshape(-1, 2)
            boxes = _boxes(xy, pairs)
            bodies = (bytes(raw[a:b]) for a, b in zip(at[:-1][plain].tolist(), (begin + 16 * pairs).tolist(), strict=True))
            empty = boxes[:, 0] > boxes[:, 1]
            sides = [[None if e else v for e, v in zip(empty.tolist(), boxes[:, k].tolist(), strict=True)] for k in range(4)]
            done = {"geom": _headed(boxes, srs_id, bodies), **dict(zip(BOX.names, sides, strict=True)), "geom_empty": empty.tolist(), "geom_type": kind.tolist(), "dims": [0] * len(kind)}
            rows = there[plain].tolist()
            for name, values in done.items():
                column = out[name]
                for k, v in zip(rows, values, strict=True):
                    column[k] = v
        for j in np.flatnonzero(~plain).tolist():
            k, b = there[j], bytes(raw[at[j] : at[j + 1]])
            try:
                out["geom"][k], found = encode(b, srs_id)
                out["geom_empty"][k], out["geom_type"][k], out["dims"][k] = found.empty, struct.unpack("<I" if b[0] else ">I", b[1:5])[0] % 1000, found.dimensions
                if not found.empty:
                    for name, side in zip(BOX.names, found.box, strict=True):
                        out[name][k] = side
            except GeometryError as e:
                out["error"][k] = str(e)
        kinds = {DoubleType: pa.float64(), BinaryType: pa.binary(), BooleanType: pa.bool_(), IntegerType: pa.int32(), StringType: pa.string()}
        return pa.StructArray.from_arrays([pa.array(out[f.name], kinds[type(f.dataType)]) for f in ENCODED.fields], ENCODED.names)

    return run


def wkt(blob: bytes | None) -> str | None:
    """XY text of the linear types, for inspection; 'EMPTY' for an empty point."""
    if blob is None:
        return None
    _, _, rest = split_header(blob)

    def walk(at: int) -> tuple[int, str, str]:
        end = "<" if rest[at] else ">"
        (code,) = struct.unpack(end + "I", rest[at + 1 : at + 5])
        base, width = code % 1000, (2, 3, 3, 4)[code // 1000]
        name, at = GEOMETRY_TYPES[base], at + 5

        def run(at: int, n: int) -> tuple[int, str]:
            xy = np.frombuffer(rest, dtype=end + "f8", count=n * width, offset=at).reshape(n, width)
            return at + 8 * n * width, "(" + ", ".join(f"{x!r} {y!r}" for x, y in xy[:, :2].tolist()) + ")"

        if base == POINT:
            at, text = run(at, 1)
            return at, name, "EMPTY" if "nan" in text else text
        (n,) = struct.unpack(end + "I", rest[at : at + 4])
        at += 4
        if base in (LINE, CIRCULAR):
            at, text = run(at, n)
            return at, name, text if n else "EMPTY"
        parts = []
        for _ in range(n):
            if base == POLYGON:
                (k,) = struct.unpack(end + "I", rest[at : at + 4])
                at, text = run(at + 4, k)
            else:
                at, inner, text = walk(at)
                text = f"{inner} {text}" if base == 7 else text
            parts.append(text)
        return at, name, "(" + ", ".join(parts) + ")" if parts else "EMPTY"

    _, name, text = walk(0)
    return f"{name} {text}"


def texts():
    """Arrow function: blob to the text of its geometry; null for a malformed one."""

    @F.arrow_udf(StringType())
    def run(blob: pa.Array) -> pa.Array:
        out = []
        for b in blob.to_pylist():
            try:
                out.append(wkt(b))
            except (GeometryError, struct.error, IndexError):
                out.append(None)
        return pa.array(out, pa.string())

    return run


def bound(side: str):
    """Arrow function: blob to one side of its envelope."""
    at = BOX.names.index(side)

    @F.arrow_udf(DoubleType())
    def run(blob: pa.Array) -> pa.Array:
        boxes = [_tolerant(envelope_of, b) for b in blob.to_pylist()]
        return pa.array([None if b is None else b[at] for b in boxes], pa.float64())

    return run


def emptiness():
    """Arrow function: blob to whether it is empty; null for null or a malformed blob."""

    def empty(blob: bytes) -> bool:
        _, flagged, rest = split_header(blob)
        return flagged or scan(rest).empty

    @F.arrow_udf(BooleanType())
    def run(blob: pa.Array) -> pa.Array:
        return pa.array([None if b is None else _tolerant(empty, b) for b in blob.to_pylist()], pa.bool_())

    return run


def _tolerant(f, blob: bytes | None):
    try:
        return f(blob)
    except GeometryError:
        return None
