"""SimHash near-dedup by tiled exact comparison.

A text's fingerprint has the bits that are set in over half of its shingles' XXH64 values.  Distinct
fingerprints are compared exactly, tile by tile, with numpy's exclusive-or and bit counts.  Comparing all
tiles would cost the square of the corpus, so tiles are formed by the pigeonhole principle: of n segments
of the 64 bits, two fingerprints at r or fewer differing bits agree wholly in n - r at least, so each
choice of n - r segments deals the fingerprints into tiles by their value there and no link is lost.  A
tile above TILE fingerprints is cut into bands of population counts and those into slices; pairs of bands
whose counts differ beyond the radius are never formed.  Inside a task links shrink to a star for each
cluster, and components() joins the stars.

Nulls: a null text has no words, like an empty one; its fingerprint is zero and links like any other.  A
null id is larger than every other; a component of null ids alone has a null component_id.  Repeated rows
share a fingerprint.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from terrane.llm.common import packed, settle, table, unpacked
from terrane.llm.components import components

SHINGLE, SEED, RADIUS, TILE = 4, 42, 4, 2048
#: The segment choices are made finer until a tile has about so many fingerprints.
AIM = 64
LAST = (1 << 63) - 1


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one UTF-8 text, unsigned."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: only A-Z change, and only the six white space characters cut
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[-1:] if len(words) < width else ends[width - 1 :]
    hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x) for x in text.to_pylist()], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with fp, the fingerprint as a signed long."""
    return docs.withColumn("fp", _fingerprints(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def segment_masks(radius: int, distinct: int) -> list[int]:
    """Masks of n - radius out of n segments, as signed longs, with n so that tiles stay near AIM."""
    n = radius + 1
    while n < radius + 4 and distinct > AIM * 2 ** (64 * (n - radius) / n):
        n += 1
    cuts = [round(64 * i / n) for i in range(n + 1)]
    segments = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(segments, n - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _stars(values: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Roots of the links between values[left] and values[right], as indices into values."""
    root, a, b = np.arange(len(values)), values[left], values[right]
    for at in range(0, len(a), 512):
        near = np.bitwise_count(a[at : at + 512, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = left[at + i], right[j]
        while len(i):
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(hop := root[root], root):
                root = hop
    return root


def _linker(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile; a tile is whole before it is compared."""
        rest: pa.Table | None = None

        def of(tiles: pa.Table) -> pa.RecordBatch:
            tile = np.column_stack([tiles.column(c).to_numpy() for c in ("t", "m", "p")])
            fp = tiles.column("fp").to_numpy().view(np.uint64)
            side = tiles.column("side").to_numpy()
            cuts = np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1
            out_a, out_b = [], []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                if e - s < 2:
                    continue
                values, sides = fp[s:e], side[s:e]
                here = np.arange(e - s)
                left, right = (here, here) if (sides == 2).all() else (here[sides == 0], here[sides == 1])
                root = _stars(values, left, right, radius)
                moved = np.flatnonzero(root != here)
                out_a.append(values[moved])
                out_b.append(values[root[moved]])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (out_a, out_b))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            tile = np.column_stack([rows.column(c).to_numpy() for c in ("t", "m", "p")])
            changes = np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1))
            last = int(changes[-1]) + 1 if len(changes) else 0
            rest = rows.slice(last)
            if last:
                yield of(rows.slice(0, last))
        if rest is not None and rest.num_rows:
            yield of(rest)

    return link


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect the fingerprints of nodes (fp) as all pairs at radius or less do.

    Every edge is between two fingerprints of one cluster; a cluster gets a star in each tile, not all pairs.
    """
    masks, wide = segment_masks(radius, nodes.count()), radius + 1
    dealt = nodes.select("fp", F.floor(F.bit_count("fp") / wide).cast("int").alias("band"), F.posexplode(F.array(*[F.lit(m) for m in masks]))).select("fp", "band", F.col("pos").alias("t"), F.col("fp").bitwiseAND(F.col("col")).alias("m"))
    bands = dealt.groupBy("t", "m", "band").agg(F.count(F.lit(1)).alias("n"))
    slices = F.ceil(F.col("n") / tile).cast("int")
    large = bands.groupBy("t", "m").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("band", slices.alias("s")))).alias("cut")).where(F.col("n") > tile).select("t", "m", "cut")
    placed = dealt.join(large, ["t", "m"], "left")
    # A whole tile is pair 0; of a cut one, a row goes to the pairs that its slice has with its own band and the two beside it.
    own = F.pmod(F.xxhash64("fp"), F.expr("cut[band]")).cast("int")
    pairs = F.expr("""
        CASE WHEN cut IS NULL THEN array(struct(0L AS p, 2 AS side)) ELSE concat(
            transform(sequence(0, cut[band] - 1), x -> struct(xxhash64(band, least(x, own), band, greatest(x, own)) AS p, IF(x = own, 2, IF(own < x, 0, 1)) AS side)),
            IF(cut[band + 1] IS NULL, array(), transform(sequence(0, cut[band + 1] - 1), x -> struct(xxhash64(band, own, band + 1, x) AS p, 0 AS side))),
            IF(cut[band - 1] IS NULL, array(), transform(sequence(0, cut[band - 1] - 1), x -> struct(xxhash64(band - 1, x, band, own) AS p, 1 AS side)))) END""")
    spread = placed.withColumn("own", own).select("t", "m", "fp", F.explode(pairs).alias("x")).select("t", "m", F.col("x.p").alias("p"), F.col("x.side").alias("side"), "fp")
    tiles = spread.repartition("t", "m", "p").sortWithinPartitions("t", "m", "p")
    return tiles.mapInArrow(_linker(radius), "a long, b long")


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, th (a hash of the text), fp, component_id and root (the component's own fingerprint) of each row of docs."""
    thin = settle(fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("th"))).select("doc_id", "th", "fp"))
    nodes = settle(thin.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = nodes.join(member, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = linked.join(least, "root").select("fp", "root", "component_id")
    # Written, so that the join below has a plain exchange on either side, which is split where one fingerprint has many rows.
    named = settle(nodes.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return thin.join(named, "fp")


def survivors(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component, by its root as ids can be null or shared: the smallest id, then the smallest text hash."""
    keep = grouped(docs, radius).groupBy("root").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("i"), "th")).alias("k"))
    keep = keep.select(F.col("k.i").alias("_i"), F.col("k.th").alias("_th")).distinct()
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("_i"), F.xxhash64("text").alias("_th"), packed(docs))
    return unpacked(keyed.join(keep, ["_i", "_th"], "left_semi").dropDuplicates(["_i", "_th"]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
