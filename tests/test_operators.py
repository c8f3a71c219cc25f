import random
import sqlite3
import struct
import uuid

import pytest
from pyspark.sql import functions as F

from terrane.functions import binary, codec, grid, ordering
from terrane.operators import container as c
from terrane.operators import index, pyramid, relations, validate
from terrane.operators.layer import BoundingBox, Layer, LayerError, fold_extent, spatial_join
from terrane.sources import sqlite
from terrane.streaming.upserts import stream_into, tile_activity


def wkb(x, y):
    return bytearray(struct.pack("<BIdd", 1, 1, x, y))


@pytest.fixture
def places(spark, tmp_path):
    box = c.Container.create(spark, f"{tmp_path}/box")
    box.create_table(c.TableSpec("Places", [c.ColumnSpec("name", "TEXT"), c.ColumnSpec("pop", "INTEGER", default=7)], c.GeometrySpec("POINT", 4326)))
    rows = [(1, "alpha", 100, wkb(1, 2)), (2, "béta ☃", 200, wkb(3.5, -4.25)), (3, "gamma", 300, wkb(10, 20)), (4, "hollow", 1, wkb(float("nan"), float("nan"))), (5, "null", 2, None)]
    box.insert("Places", spark.createDataFrame(rows, "fid long, name string, pop long, geom binary"))
    return box


def test_layer_reads(places):
    layer = places.layer("places")
    ids = lambda x: sorted(r.fid for r in x.rows().collect())
    assert ids(layer) == [1, 2, 3, 4, 5] and ids(layer.features_in(BoundingBox(1, 2, 3.5, 2))) == [1]
    assert ids(layer.features_in(BoundingBox(-90, -90, 90, 90))) == [1, 2, 3] and ids(layer.features_in(BoundingBox(3.5, -4.25, 3.5, -4.25))) == [2]
    assert ids(layer.select("pop > :p AND name <> :n", p=50, n="it's")) == [1, 2, 3]
    assert layer.with_columns("pop", "name").rows().columns == ["fid", "name", "pop"] and layer.without_geometry().rows().columns == ["fid", "name", "pop"]
    assert [r.fid for r in layer.page(2, 2).collect()] == [2, 3] and layer.count().first().n == 5
    assert tuple(layer.measured_extent().first()) == (1.0, -4.25, 10.0, 20.0)
    for bad in (lambda: layer.with_columns("nope"), lambda: layer.without_geometry().geometry(), lambda: layer.column_values("geom"), lambda: places.layer("nope"), lambda: places.attributes("Places")):
        with pytest.raises(LayerError):
            bad()
    assert "PushedFilters: [IsNotNull(minx)" in layer.features_in(BoundingBox(0, 0, 1, 1)).explain()


def test_writes(spark, places):
    name, row = "Places", "fid long, name string, pop long, geom binary"
    assert places.update(name, spark.createDataFrame([(1, "new", 5, wkb(-50, 60)), (99, "x", 1, None)], row)) == 1
    assert places.update_columns(name, spark.createDataFrame([(2, None)], "fid long, name string")) == 1
    assert places.delete(name, spark.createDataFrame([(3,), (77,)], "fid long")) == 1
    places.insert(name, spark.createDataFrame([("auto", wkb(7, 7))], "name string, geom binary"))
    got = {r.fid: (r.name, r.pop) for r in places.layer(name).rows().collect()}
    assert got == {1: ("new", 5), 2: (None, 200), 4: ("hollow", 1), 5: ("null", 2), 6: ("auto", 7)}
    bounds = places.contents().where("table_name = 'Places'").first()
    assert (bounds.min_x, bounds.max_x, bounds.max_y) == (-50.0, 10.0, 60.0)  # a deletion doesn't shrink them
    places.recompute_extent(name)
    assert places.contents().where("table_name = 'Places'").first().max_x == 7.0
    first = c.Container.open(spark, places.path, version=3)
    assert first.state["tables"][name]["deletes"] == [] and len(places.state["tables"][name]["parts"]) == 4  # nothing was rewritten
    with pytest.raises(ValueError, match="repeats"):
        places.update_columns(name, spark.createDataFrame([(2, "a"), (2, "b")], "fid long, name string"))
    before = sorted(map(str, places.table(name).drop("geom").collect()))
    places.compact(name)
    assert places.state["tables"][name]["deletes"] == [] and sorted(map(str, places.table(name).drop("geom").collect())) == before
    assert first.layer(name).count().first().n == 5
    for bad in (lambda: places.insert(name, spark.createDataFrame([(1, "again")], "fid long, name string")), lambda: places.insert(name, spark.createDataFrame([(1, 1)], "fid long, nope long")), lambda: places.create_table(c.TableSpec("gpkg_x")), lambda: places.create_table(c.TableSpec("t", [], c.GeometrySpec("POINT", 1234)))):
        with pytest.raises(ValueError):
            bad()
    line = bytearray(struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1))
    with pytest.raises(Exception, match="geometry type"):
        places.insert(name, spark.createDataFrame([(50, "line", 1, line)], row))
    assert c.Container.open(spark, places.path).layer(name).count().first().n == 5


def test_catalogue(spark, places, tmp_path):
    assert [r.table_name for r in places.layers().collect()] == ["Places"] and [r.srs_id for r in places.srs_list().collect()] == [-1, 0, 4326]
    assert places.add_epsg_srs(32633) and not places.add_epsg_srs(32633)
    assert "UTM zone 33N" in places.srs_list().where("srs_id = 32633").first().definition
    places.create_table(c.TableSpec("notes", [c.ColumnSpec("note", "TEXT")]))
    places.insert("notes", spark.createDataFrame([("a",), ("b",)], "note string"))
    assert sorted(r.fid for r in places.attributes("NOTES").rows().collect()) == [1, 2]
    other, left = places.copy_to(f"{tmp_path}/copy")
    assert left == [] and other.layer("places").count().first().n == 5 and other.attributes("notes").count().first().n == 2
    places.register((None, None, "acme_x", "d", "read-write"))
    with pytest.raises(LayerError, match="blocks"):
        places.insert("notes", spark.createDataFrame([("c",)], "note string"))
    assert "extension: acme_x" in c.Container.open(spark, places.path, lenient=True).warnings
    with pytest.raises(ValueError, match="not empty"):
        c.Container.create(spark, places.path)


def test_parameters_outside_of_quotes_only(spark):
    layer = Layer(spark.createDataFrame([(1, "a :b", 1.5), (2, "it's", float("inf")), (3, None, -2.0)], "fid long, note string, v double"), geom=None)
    ids = lambda where, **p: [r.fid for r in layer.select(where, **p).rows().collect()]
    assert ids("note = 'a :b' AND v > :least", least=1.0) == [1] and ids("v = :v", v=float("inf")) == [2]
    assert ids("note = :n", n="it's") == [2] and ids("note <=> :n -- :comment", n=None) == [3] and ids("fid::int = :k", k=3) == [3] and ids("fid = :k", k=1 << 40) == []
    for where, params in (("v = :v", {}), ("v = 1", {"v": 1})):
        with pytest.raises(LayerError):
            layer.select(where, **params)


def test_a_write_is_one_state(spark, places, monkeypatch):
    name, row = "Places", "fid long, name string, pop long, geom binary"
    before = places.state["version"]
    places.insert(name, spark.createDataFrame([(70, "x", 1, wkb(80, 80))], row))
    assert places.state["version"] == before + 1
    assert c.Container.open(spark, places.path, version=before).contents().first().max_x == 10.0 and c.Container.open(spark, places.path).contents().first().max_x == 80.0
    other = c.Container.open(spark, places.path, version=before)
    with pytest.raises(LayerError, match="another writer"):
        other.insert(name, spark.createDataFrame([(71, "y", 1, wkb(0, 0))], row))

    def fails(box):
        box.insert(name, spark.createDataFrame([(72, "z", 1, wkb(0, 0))], row))
        box.delete(name, spark.createDataFrame([(70,)], "fid long"))
        assert sorted(r.fid for r in box.table(name).collect()) == [1, 2, 3, 4, 5, 72]
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        places.transaction(fails)
    assert places.table(name).where("fid = 70").count() == 1 and places.table(name).where("fid = 72").count() == 0
    places.transaction(lambda box: (box.insert(name, spark.createDataFrame([(72, "z", 1, wkb(0, 0))], row)), box.delete(name, spark.createDataFrame([(72,), (70,)], "fid long")), box.insert(name, spark.createDataFrame([(70, "again", 1, None)], row))))
    assert sorted((r.fid, r.name) for r in c.Container.open(spark, places.path).table(name).where("fid >= 70").collect()) == [(70, "again")]


def test_what_may_not_be_written(spark, places):
    places.create_table(c.TableSpec("codes", [c.ColumnSpec("code", "TEXT", not_null=True, unique=True), c.ColumnSpec("size", "INTEGER"), c.ColumnSpec("kind", "TEXT"), c.ColumnSpec("tag", "TEXT")]))
    schema = "fid long, code string, size long, kind string, tag string"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    c.add_column_constraint(places, spark.createDataFrame([("sizes", "range", None, 1.0, True, 9.0, False, None), ("kinds", "enum", "a", None, None, None, None, None), ("kinds", "enum", "b", None, None, None, None, None), ("tags", "glob", "t[0-9]*", None, None, None, None, None)], c.CONSTRAINTS))
    described = [("codes", "size", None, None, None, None, "sizes"), ("codes", "kind", None, None, None, None, "kinds"), ("codes", "tag", None, None, None, None, "tags"), ("codes", "code", None, None, None, None, "none")]
    c.set_data_columns(places, spark.createDataFrame(described, c.DATA_COLUMNS))
    assert places.insert("codes", rows((1, "x", 1, "a", "t1"), (2, "y", None, None, None)), constraints=True) == 2
    assert places.insert("codes", rows((3, "z", 9, "q", "u")), constraints=False) == 1  # constraints are looked at where that is asked for
    refused = [(rows((4, None, 1, "a", "t1")), "code is null"), (rows((4, "w", 9, "a", "t1")), "size"), (rows((4, "w", 8, "c", "t1")), "kind"), (rows((4, "w", 8, "b", "s1")), "tag")]
    for bad, reason in refused:
        with pytest.raises(Exception, match=reason):
            places.insert("codes", bad, constraints=True)
    for bad in (rows((4, "x", 1, "a", "t1")), rows((4, "n", 1, "a", "t1"), (5, "n", 1, "a", "t1"))):
        with pytest.raises(ValueError, match="code repeats"):
            places.insert("codes", bad)
    with pytest.raises(ValueError, match="code repeats"):
        places.update_columns("codes", spark.createDataFrame([(2, "x")], "fid long, code string"))
    with pytest.raises(Exception, match="code is null"):
        places.update_columns("codes", spark.createDataFrame([(2, None)], "fid long, code string"))
    assert places.update("codes", rows((1, "x", 2, "b", "t2"))) == 1  # a row may keep its own value
    told = c.violations(places, "codes", rows((6, None, 12, "c", "t"), (7, "y", 1, "a", "t7"), (8, "new", None, None, None)))
    assert {r.fid: sorted(r.violations) for r in told.collect()} == {6: ["code", "kind", "size", "tag"], 7: ["code"], 8: []}
    assert places.table("codes").count() == 3
    for bad in (("r", "range", None, 3.0, True, 1.0, True, None), ("e", "enum", None, None, None, None, None, None), ("u", "odd", "v", None, None, None, None, None), ("sizes", "glob", "*", None, None, None, None, None)):
        with pytest.raises(LayerError):
            c.add_column_constraint(places, spark.createDataFrame([bad], c.CONSTRAINTS))


def test_index_life_cycle(spark, places):
    name, row = "Places", "fid long, name string, pop long, geom binary"
    assert places.index_status(name) == "current"  # the sidecar
    places.create_index(name)
    assert places.audit_index(name).first().entries == 3 and places.index_status(name) == "current"
    places.insert(name, spark.createDataFrame([(20, "far", 1, wkb(100, 50))], row))
    assert places.index_status(name) == "stale" and places.audit_index(name).first().missing == 1
    assert places.repair_index(name) and not places.repair_index(name)
    assert places.drop_index(name) and places.index_status(name) == "absent" and not places.drop_index(name)
    assert places.table("extensions").where("extension_name = 'gpkg_rtree_index'").count() == 0


def test_reference_systems_and_extensions(spark, places):
    for code, name in ((3857, "WGS 84 / Pseudo-Mercator"), (25832, "ETRS89 / UTM zone 32N"), (32733, "WGS 84 / UTM zone 33S"), (4269, "NAD83")):
        assert places.add_epsg_srs(code)
        found = places.srs(code)
        assert found["srs_name"] == name and f'ID["EPSG",{code}]]' in found["definition_12_063"] and f'AUTHORITY["EPSG","{code}"]' in found["definition"]
        assert all(found[c].count("[") == found[c].count("]") for c in ("definition", "definition_12_063"))
    for bad in (lambda: places.add_epsg_srs(999_999), lambda: places.srs(12345)):
        with pytest.raises(LayerError):
            bad()
    places.register((None, None, "acme_x", "d", "read-write"))
    with pytest.raises(LayerError, match="blocks"):
        places.delete("Places", spark.createDataFrame([(1,)], "fid long"))
    places.allow_extension("acme_x")
    assert places.delete("Places", spark.createDataFrame([(1,)], "fid long")) == 1
    assert places.unregister("acme_x") and not places.unregister("acme_x")
    assert [r.extension_name for r in places.table_extensions("places").collect()] == ["gpkg_rtree_index"]
    c.add_metadata(places, spark.createDataFrame([(1, "dataset", "u", "text/xml", "m")], c.METADATA))
    assert c.metadata_record(places, 1)["metadata"] == "m" and c.references_to(places, 1).count() == 0
    with pytest.raises(LayerError):
        c.metadata_record(places, 2)


def test_chains_of_any_length(spark):
    refs = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 201), (201, 202), (202, 201), (300, 300)], "md_file_id long, md_parent_id long")
    start = spark.createDataFrame([(0,), (200,), (300,), (99,), (500,)], "id long")
    got = relations.ancestors(refs, start).collect()
    assert sorted(r.depth for r in got if r.id == 0) == list(range(1, 101)) and all(r.ancestor == r.depth and r.error is None for r in got if r.id == 0)
    assert sorted((r.depth, r.ancestor, r.error) for r in got if r.id == 200) == [(1, 201, None), (2, 202, None), (3, 201, "cycle")]
    assert [(r.depth, r.ancestor, r.error) for r in got if r.id == 300] == [(1, 300, "cycle")] and [r.ancestor for r in got if r.id == 99] == [100]


def test_join_of_boxes_of_every_size(spark):
    rng = random.Random(3)
    side = lambda: rng.choice([0.0, rng.uniform(0, 1), rng.uniform(0, 400), 3e9])
    make = lambda n: [(k, x := rng.uniform(-200, 200), x + side(), y := rng.uniform(-90, 90), y + side()) for k in range(n)]
    inf = float("inf")
    left, right = [*make(150), (900, -inf, inf, -inf, inf), (901, None, None, None, None), (902, 0.0, inf, 1.0, 1.0)], [*make(40), (950, -inf, inf, -5.0, 5.0)]
    schema = "long, minx double, maxx double, miny double, maxy double"
    a, b = spark.createDataFrame(left, "fid " + schema), spark.createDataFrame(right, "box_id " + schema)
    want = sorted((q[0], p[0]) for p in left for q in right if p[1] is not None and p[1] <= q[2] and p[2] >= q[1] and p[3] <= q[4] and p[4] >= q[3])
    assert sorted((r.box_id, r.fid) for r in spatial_join(a, b, 2.0).collect()) == want


def test_key_runs_across_ranges(spark):
    rng = random.Random(4)
    ids = sorted(rng.sample(range(40_000), 900) + [k for s in (0, 9_000, 33_000) for k in range(s, s + 500)])
    ids = sorted(set(ids))
    want, lo = [], ids[0]
    for p, q in zip(ids, [*ids[1:], None], strict=True):
        if q is None or q - p > 64:
            want.append((lo, p))
            lo = q
    runs = ordering.key_runs(spark.createDataFrame([(k,) for k in ids], "id long").repartition(3), "id")
    assert sorted((r.lo, r.hi) for r in runs.collect()) == want
    grouped = ordering.key_runs(spark.createDataFrame([(k % 2, k) for k in ids] , "g long, id long"), "id", "g", gap=2)
    for g in (0, 1):
        own = [k for k in ids if k % 2 == g]
        assert sum(r.n for r in grouped.where(f"g = {g}").collect()) == len(own) and grouped.where(f"g = {g}").count() == 1 + sum(q - p > 2 for p, q in zip(own, own[1:], strict=False))


def test_box_filter_against_brute_force(spark):
    rng = random.Random(1)
    boxes = [(k, a := rng.uniform(-50, 50), a + rng.choice([0, rng.uniform(0, 30)]), b := rng.uniform(-50, 50), b + rng.uniform(0, 30)) for k in range(300)]
    df = spark.createDataFrame([*boxes, (900, None, None, None, None), (901, *[float("nan")] * 4)], "fid long, minx double, maxx double, miny double, maxy double")
    probes = [(k, *b[1:]) for k, b in enumerate(rng.sample(boxes, 40))]
    for _, x0, x1, y0, y1 in probes[:5]:
        got = {r.fid for r in Layer(df, geom="geom").features_in(BoundingBox(x0, y0, x1, y1)).df.where(Layer(df, geom="geom").features_in(BoundingBox(x0, y0, x1, y1)).predicate & ~F.isnan("maxx")).collect()}
        assert got == {b[0] for b in boxes if b[1] <= x1 and b[2] >= x0 and b[3] <= y1 and b[4] >= y0}
    other = spark.createDataFrame(probes, "box_id long, minx double, maxx double, miny double, maxy double")
    want = sorted((p[0], b[0]) for p in probes for b in boxes if b[1] <= p[2] and b[2] >= p[1] and b[3] <= p[4] and b[4] >= p[3])
    for cell in (3.0, 25.0, 1000.0):
        assert sorted((r.box_id, r.fid) for r in spatial_join(df, other, cell).collect()) == want


def test_index_after_writes(spark):
    rng = random.Random(2)
    make = lambda ids: spark.createDataFrame([(k, x := rng.uniform(-180, 180), x + 1, y := rng.uniform(-90, 90), y + 1) for k in ids], "fid long, minx double, maxx double, miny double, maxy double")
    layer = make(range(200))
    built = index.build(layer)
    written, gone = make(range(100, 260)), layer.where("fid < 20")
    after = layer.where("fid BETWEEN 20 AND 99").unionByName(written)
    kept = index.maintain(built, written, gone)
    assert index.is_consistent(index.audit(after, kept)).first().is_consistent and not index.is_consistent(index.audit(after, built)).first().is_consistent
    leaves = index.packed(built, 10).groupBy("leaf").count().collect()
    assert sorted(r.leaf for r in leaves) == list(range(20)) and {r["count"] for r in leaves} == {10}
    box = (-20.0, -10.0, 40.0, 30.0)
    exact = {r.fid for r in layer.where(f"minx <= {box[2]} AND maxx >= {box[0]} AND miny <= {box[3]} AND maxy >= {box[1]}").collect()}
    assert exact <= {r.id for r in index.candidates(built, *box).collect()}
    empty = fold_extent(spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0)], "k string, min_x double, min_y double, max_x double, max_y double"), spark.createDataFrame([("a", None, None, None, None), ("b", 5.0, 6.0, 7.0, 8.0)], "k string, minx double, maxx double, miny double, maxy double"), ["k"])
    assert {tuple(r) for r in empty.collect()} == {("a", 0.0, 0.0, 1.0, 1.0), ("b", 5.0, 7.0, 6.0, 8.0)}


def test_pyramid(spark):
    m = grid.ladder(spark, grid.WORLD, 0, 2, base=(2, 1))
    png = lambda n: bytearray(bytes.fromhex("89504E470D0A1A0A0000000D49484452") + struct.pack(">II", n, n))
    tiles = spark.createDataFrame([(1, 0, 0, png(256)), (1, 3, 1, png(256)), (2, 4, 2, png(256))], "zoom_level long, tile_column long, tile_row long, tile_data binary")
    p = pyramid.Pyramid(grid.WORLD, m, tiles)
    assert p.faults().count() == 0 and [r.zoom_level for r in p.zoom_levels().collect()] == [0, 1, 2]
    assert p.cursor_in(1, BoundingBox(100, -80, 170, -50)).count() == 1 and p.cursor_in(1, BoundingBox(200, 0, 210, 1)).count() == 0 and p.get(2, 4, 2).count() == 1
    with pytest.raises(LayerError, match="no zoom"):
        p.cursor_in(9, BoundingBox(0, 0, 1, 1))
    new = spark.createDataFrame([(1, 0, 0, png(256)), (1, 9, 0, png(256)), (7, 0, 0, png(256)), (2, 0, 0, png(64)), (2, 0, 0, bytearray(b"other")), (2, 1, 0, bytearray(b"\xff\xd8\xff\xe0")), (2, 1, 1, bytearray(b"RIFF\x16\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (63).to_bytes(3, "little") * 2))], "zoom_level long, tile_column long, tile_row long, tile_data binary").coalesce(1)
    assert sorted(str(r.error) for r in p.checked(new).collect()) == ["None", "None", "outside the grid", "payload", "payload size", "payload size", "unknown zoom"]


def test_relations_and_metadata(spark):
    contents = spark.createDataFrame([("Sites",), ("notes",)], "table_name string")
    none = spark.createDataFrame([], "id long, base_table_name string, related_table_name string, relation_name string, mapping_table_name string")
    new = spark.createDataFrame([(1, "sites", "NOTES", "features", "m"), (2, "sites", "nowhere", "media", "m"), (3, "sites", "notes", "bad", "m")], none.schema)
    good, bad = relations.add_relation(none, contents, new)
    assert [r.id for r in good.collect()] == [1] and {(r.id, r.error) for r in bad.collect()} == {(2, "unknown table"), (3, "relation name")}
    refs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (12, None), (11, 40)], "md_file_id long, md_parent_id long")
    start = spark.createDataFrame([(1,), (10,), (12,)], "id long")
    records = spark.createDataFrame([(k,) for k in (1, 2, 3, 10, 11)], "id long")
    got = sorted((r.id, r.depth, r.ancestor, r.error) for r in relations.ancestors(refs, start, records).collect())
    assert got == [(1, 1, 2, None), (1, 2, 3, None), (1, 3, 1, "cycle"), (10, 1, 11, None), (10, 2, 12, "dangling")]
    with pytest.raises(ValueError, match="scope"):
        relations.metadata_for(refs, "table", row_id_value=3)
    found = validate.validate(contents=contents, tables=spark.createDataFrame([("sites",)], "name string"), relations=new)
    assert [(r.severity, r.kind, r.table_name) for r in found.collect()][:3] == [("error", "missing mapping table", "m")] * 3


def test_container_tiles_relations_metadata(spark, places):
    m = grid.ladder(spark, grid.WORLD, 0, 1, base=(2, 1))
    c.create_pyramid(places, "world", grid.WORLD, m)
    png = bytearray(bytes.fromhex("89504E470D0A1A0A0000000D49484452") + struct.pack(">II", 256, 256))
    webp = bytearray(b"RIFF\x16\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (255).to_bytes(3, "little") * 2)
    c.put_tiles(places, "world", spark.createDataFrame([(0, 0, 0, png), (1, 1, 1, webp)], c.TILES))
    c.put_tiles(places, "world", spark.createDataFrame([(0, 0, 0, webp)], c.TILES))
    p = c.open_pyramid(places, "WORLD")
    assert {r.zoom_level: r.n for r in p.counts().collect()} == {0: 1, 1: 1} and bytes(p.get(0, 0, 0).first().tile_data) == bytes(webp)
    assert [r.table_name for r in c.tile_pyramids(places).collect()] == ["world"] and places.table("extensions").where("extension_name = 'gpkg_webp'").count() == 1
    c.delete_tiles(places, "world", spark.createDataFrame([(1, 1, 1)], "zoom_level long, tile_column long, tile_row long"))
    assert c.open_pyramid(places, "world").tiles.count() == 1
    c.add_metadata(places, spark.createDataFrame([(1, "dataset", "u", "text/xml", "m")], c.METADATA))
    c.add_references(places, spark.createDataFrame([("table", "Places", None, None, None, 1, None)], c.REFERENCES))
    relation = lambda k, name, mapping: spark.createDataFrame([(k, "places", "fid", "world", "id", name, mapping)], c.RELATIONS)
    c.add_relations(places, relation(1, "tiles", "map"))
    c.add_mappings(places, "map", spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "base_id long, related_id long"))
    assert sorted(r.related_id for r in relations.related_ids(places.table("map"), 1).collect()) == [2, 2]
    describe = lambda title: spark.createDataFrame([("Places", "pop", "pop", title, None, None, None)], c.DATA_COLUMNS)
    c.set_data_columns(places, describe("old"))
    c.set_data_columns(places, describe("Population"))
    got = {r.column_name: (r.declared, r.title, r.is_primary_key) for r in c.table_schema(places, "places").collect()}
    assert got["pop"] == ("INTEGER", "Population", False) and got["fid"][2] and got["geom"][0] == "POINT"
    bad = [
        lambda: c.create_pyramid(places, "twice", grid.WORLD, m.union(m)),
        lambda: c.put_tiles(places, "world", spark.createDataFrame([(0, 9, 0, png)], c.TILES)),
        lambda: c.add_references(places, spark.createDataFrame([("table", "t", None, None, None, 9, None)], c.REFERENCES)),
        lambda: c.add_relations(places, relation(2, "odd", "map2")),
        lambda: c.add_relations(places, relation(2, "tiles", "MAP")),
        lambda: c.open_pyramid(places, "nope"),
    ]
    for f in bad:
        with pytest.raises(LayerError):
            f()


@pytest.fixture
def file(tmp_path):
    path = f"{tmp_path}/file.db"
    con = sqlite3.connect(path)
    con.executescript("""
        PRAGMA application_id = 1196444487; PRAGMA user_version = 10400;
        CREATE TABLE gpkg_spatial_ref_sys (srs_id INTEGER); CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT);
        CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);
        INSERT INTO gpkg_contents VALUES ('Spread', 'features'); INSERT INTO gpkg_geometry_columns VALUES ('Spread', 'geom', 'POINT', 4326, 0, 0);
        CREATE TABLE spread (fid INTEGER PRIMARY KEY, b BOOLEAN, i INTEGER, db DOUBLE, txt TEXT, bl BLOB, dt DATE, dtm DATETIME, vc VARCHAR(9), geom POINT);""")
    point = codec.encode(bytes(wkb(1.5, 2.5)), 4326)[0]
    bare = codec.header(4326, [], False, False) + bytes(wkb(30, 40))
    con.executemany("INSERT INTO spread VALUES (?,?,?,?,?,?,?,?,?,?)", [(1, 1, 42, 1.5, "é☃", b"\x00\xff", "2026-07-24", "2026-07-24T12:34:56.789Z", "v", point), (2, 2, "oops", 7, "t", b"", "2026-7-4", "2026-07-24 12:34:56+02:00", "w", bare), (3, *[None] * 9), (900, 0, 5, 2.5, "z", b"z", "1999-01-01", "bad", "x", b"junk")])
    con.commit()
    con.close()
    return path


def test_file_source(spark, file):
    assert sqlite.file_warnings(file) == ["case differs: Spread"]
    df = sqlite.read(spark, file, "Spread", errors="problems")
    got = {r.fid: r for r in df.collect()}
    assert got[1].b is True and got[1].i == 42 and got[1].txt == "é☃" and bytes(got[1].bl) == b"\x00\xff" and str(got[1].dt) == "2026-07-24" and got[1].minx == 1.5 and got[1].problems is None
    assert got[2].db == 7.0 and got[2].i is None and got[2].dt is None and (got[2].minx, got[2].miny) == (30.0, 40.0) and "text in INTEGER" in got[2].problems and "DATE: malformed" in got[2].problems
    assert got[3].geom_empty is None and got[3].txt is None and "bad header" in got[900].problems
    assert [r.fid for r in df.where("i > 10 AND db < 5.0").collect()] == [1] and df.where("fid = 900").count() == 1 and df.rdd.getNumPartitions() == 8
    strict = {r.fid: r for r in sqlite.read(spark, file, "spread", strict="true").collect()}
    assert strict[2].b is None and strict[2].dtm is None and strict[1].dtm is not None


def test_columns_and_bad_text(spark, file):
    df = sqlite.read(spark, file, "spread", columns="fid,txt")
    assert df.columns == ["fid", "txt"] and {r.fid: r.txt for r in df.collect()} == {1: "é☃", 2: "t", 3: None, 900: "z"}
    con = sqlite3.connect(file)
    con.execute("UPDATE spread SET txt = CAST(x'ff41' AS TEXT) WHERE fid = 2")
    con.commit()
    assert {r.fid: (r.txt, r.e) for r in sqlite.read(spark, file, "spread", columns="fid,txt", errors="e").collect()}[2] == (None, "txt: not UTF-8")
    with pytest.raises(Exception, match="no such column"):
        sqlite.read(spark, file, "spread", columns="nope").collect()


def test_export_and_box(spark, places, tmp_path):
    m = grid.ladder(spark, grid.WORLD, 0, 0, base=(2, 1))
    c.create_pyramid(places, "world", grid.WORLD, m)
    c.put_tiles(places, "world", spark.createDataFrame([(0, 1, 0, bytearray(b"data"))], c.TILES))
    places.create_table(c.TableSpec("notes", [c.ColumnSpec("note", "TEXT", not_null=True, unique=True), c.ColumnSpec("day", "DATE")]))
    places.insert("notes", spark.createDataFrame([("a",), ("b",)], "note string"))
    path = f"{tmp_path}/out.file"
    sqlite.export(places, path)
    assert sqlite.file_warnings(path) == [] and sqlite.index_state(path, "places") == "current"
    con = sqlite3.connect(path)
    assert con.execute("SELECT count(*) FROM rtree_Places_geom").fetchone() == (3,) and con.execute("PRAGMA integrity_check").fetchone() == ("ok",)
    assert con.execute("SELECT min_x, max_y FROM gpkg_contents WHERE table_name = 'Places'").fetchone() == (1.0, 20.0)
    assert con.execute("SELECT tile_data FROM world").fetchone() == (b"data",) and con.execute("SELECT note FROM notes ORDER BY fid").fetchall() == [("a",), ("b",)]
    with pytest.raises(sqlite3.IntegrityError):
        con.execute("INSERT INTO notes (note) VALUES ('a')")
    df = sqlite.read(spark, path, "places")
    assert {r.fid: (r.name, bytes(r.geom)) for r in df.where("geom IS NOT NULL").collect()} == {r.fid: (r.name, bytes(r.geom)) for r in places.table("Places").where("geom IS NOT NULL").collect()}
    assert sorted(r.fid for r in Layer(df).features_in(BoundingBox(0, -10, 5, 3)).rows().collect()) == [1, 2]
    con.execute("DELETE FROM rtree_Places_geom WHERE id = 2")  # what the index doesn't tell isn't read: so the box went through it
    con.commit()
    box = lambda **o: sorted(r.fid for r in Layer(sqlite.read(spark, path, "places", **o)).features_in(BoundingBox(0, -10, 5, 3)).rows().collect())
    assert box() == [1] and box(index="false") == [1, 2]
    with pytest.raises(ValueError, match="there already"):
        sqlite.export(places, path)


def test_export_sends_no_rows_to_the_driver(spark, tmp_path, monkeypatch):
    """Tasks write the rows and pack the index; the file is whole, its R-tree well-formed on every number of levels."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(self, *_, **__):
        raise AssertionError("rows are sent to the driver")

    box = c.Container.create(spark, f"{tmp_path}/many")
    sizes = {"none": 0, "full": 51, "deep": 9000}  # no level, one, three
    for name, n in sizes.items():
        box.create_table(c.TableSpec(name, [c.ColumnSpec("v", "TEXT"), c.ColumnSpec("at", "DATETIME")], c.GeometrySpec("POINT", 4326)))
        k = F.col("fid")
        points = spark.range(n).select(F.col("id").alias("fid")).withColumn("geom", F.when(k % 10 != 7, binary.body(codec.encode_points(4326)(((k * 7919) % 3600) / 10.0 - 180, ((k * 104_729) % 1800) / 10.0 - 90))))
        box.insert(name, points.withColumn("v", F.concat(F.lit("v"), k.cast("string"))).withColumn("at", F.timestamp_seconds(k)))
    path = f"{tmp_path}/many.file"
    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    sqlite.export(box, path)
    monkeypatch.undo()
    con = sqlite3.connect(path)
    for name, n in sizes.items():
        rows = con.execute(f"SELECT fid, v, at, geom FROM {name}").fetchall()
        assert [r[:2] for r in rows] == [(k, f"v{k}") for k in range(n)]
        assert [r[3] for r in rows] == [r.geom and bytes(r.geom) for r in box.table(name).orderBy("fid").collect()]
        assert con.execute("SELECT rtreecheck(?)", (f"rtree_{name}_geom",)).fetchone() == ("ok",)
        assert con.execute(f"SELECT count(*) FROM rtree_{name}_geom").fetchone() == (sum(k % 10 != 7 for k in range(n)),)
        wanted = [k for k in range(n) if k % 10 != 7 and 0 <= (k * 7919) % 3600 / 10.0 - 180 <= 20.5 and -30 <= (k * 104_729) % 1800 / 10.0 - 90 <= 20]
        assert [r[0] for r in con.execute(f"SELECT id FROM rtree_{name}_geom WHERE minx <= 20.5 AND maxx >= 0 AND miny <= 20 AND maxy >= -30 ORDER BY id")] == wanted
        assert sqlite.index_state(path, name) == "current"
    assert rows[60][2] == "1970-01-01T00:01:00.000Z" and con.execute("SELECT seq FROM sqlite_sequence WHERE name = 'deep'").fetchone() == (8999,)
    con.execute("DELETE FROM rtree_deep_geom WHERE id < 4000")  # the module goes on from the packed nodes
    con.executemany("INSERT INTO rtree_deep_geom VALUES (?, 0, 1, 0, 1)", [(k,) for k in range(3000)])
    assert con.execute("SELECT rtreecheck('rtree_deep_geom')").fetchone() == ("ok",) and con.execute("PRAGMA integrity_check").fetchone() == ("ok",)


def test_an_insert_makes_its_rows_once(spark, tmp_path):
    """Keys are tested on the part that was written, not on rows that are made a second time; a refused part leaves nothing."""
    marks = tmp_path / "marks"
    marks.mkdir()

    def marked(batches):
        (marks / uuid.uuid4().hex).touch()
        yield from batches

    box = c.Container.create(spark, f"{tmp_path}/once")
    box.create_table(c.TableSpec("points", [], c.GeometrySpec("POINT", 4326)))
    rows = lambda low, high: spark.range(low, high, 1, 1).selectExpr("id AS fid").withColumn("geom", binary.body(codec.encode_points(4326)(F.lit(1.0), F.lit(2.0)))).mapInArrow(marked, "fid long, geom binary")
    assert box.insert("points", rows(0, 50)) == 50 and len(list(marks.iterdir())) == 1
    version = box.state["version"]
    for bad in (rows(49, 60), rows(60, 70).union(rows(69, 71))):
        with pytest.raises(ValueError, match="fid repeats"):
            box.insert("points", bad)
    assert box.state["version"] == version and box.table("points").count() == 50 and len([p for p in (tmp_path / "once").iterdir() if p.name.startswith("points")]) == 1


def test_hilbert_keys_are_compiled(spark):
    """The table gives what the fold over single bits gives, with no lambda in the plan."""

    def fold(x: int, y: int) -> int:
        at = 0
        for s in (1 << k for k in range(15, -1, -1)):
            rx, ry = int(x & s > 0), int(y & s > 0)
            at += s * s * (3 * rx ^ ry)
            if not ry:
                x, y = (s - 1 - x, s - 1 - y) if rx else (x, y)
                x, y = y & (s - 1), x & (s - 1)
        return at

    rnd = random.Random(3)
    cells = [(0, 0), (65535, 0), (0, 65535), (65535, 65535), *((rnd.randrange(1 << 16), rnd.randrange(1 << 16)) for _ in range(500))]
    df = spark.createDataFrame(cells, "x long, y long").select("x", "y", ordering.hilbert(F.col("x"), F.col("y")).alias("key"))
    assert all(r.key == fold(r.x, r.y) for r in df.collect()) and "lambda" not in df._jdf.queryExecution().toString()


def test_import(spark, file, tmp_path):
    con = sqlite3.connect(file)
    con.execute("DELETE FROM spread WHERE fid = 900")
    con.commit()
    box = c.Container.create(spark, f"{tmp_path}/imported")
    sqlite.import_layer(spark, file, "spread", box)
    layer = box.layer("spread")
    assert sorted(r.fid for r in layer.features_in(BoundingBox(0, 0, 35, 45)).rows().collect()) == [1, 2]


def test_streaming_upserts(spark, tmp_path):
    box = c.Container.create(spark, f"{tmp_path}/box")
    box.create_table(c.TableSpec("t", [c.ColumnSpec("v", "INTEGER")]))
    source = f"{tmp_path}/in"
    schema = "fid long, v long, at long"
    for rows in ([(1, 10, 1), (2, 20, 1), (1, 11, 2)], [(2, 21, 5), (3, 30, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream_into(spark.readStream.schema(schema).parquet(source), box, "t", ["fid"], "at", f"{tmp_path}/ck").awaitTermination()
    assert {(r.fid, r.v) for r in box.table("t").collect()} == {(1, 11), (2, 21), (3, 30)}
    events = spark.readStream.format("rate").load().selectExpr("timestamp AS at", "1L AS zoom_level", "value AS tile_column", "0L AS tile_row")
    assert tile_activity(events, "at").isStreaming
