import struct

from terrane.__main__ import main
from terrane.functions import grid
from terrane.operators import container as c


def test_commands(spark, tmp_path, capsys):
    path = f"{tmp_path}/box"
    box = c.Container.create(spark, path)
    box.create_table(c.TableSpec("towns", [c.ColumnSpec("name", "TEXT")], c.GeometrySpec("POINT", 4326)))
    box.insert("towns", spark.createDataFrame([("a", bytearray(struct.pack("<BIdd", 1, 1, 5.0, 6.0)))], "name string, geom binary"))
    c.create_pyramid(box, "world", grid.WORLD, grid.ladder(spark, grid.WORLD, 0, 0, base=(2, 1)))
    c.put_tiles(box, "world", spark.createDataFrame([(0, 1, 0, bytearray(b"data"))], c.TILES))
    assert main(["info", path], spark) == 0 and "towns\tfeatures\t4326\t1" in capsys.readouterr().out
    assert main(["validate", path], spark) == 0
    assert main(["rebuild", path, "towns"], spark) == 0 and main(["copy", path, f"{tmp_path}/copy"], spark) == 0
    assert main(["tiles", path, "world"], spark) == 0 and "0\t1" in capsys.readouterr().out
    assert main(["tile", path, "world", "0", "1", "0", f"{tmp_path}/t"], spark) == 0 and (tmp_path / "t").read_bytes() == b"data"
    assert main(["tile", path, "world", "0", "0", "0", f"{tmp_path}/u"], spark) == 1
    box = c.Container.open(spark, path)
    box.commit({"contents": box.table("contents").replace("world", "gone", "table_name")})
    assert main(["validate", path], spark) == 1


def test_validate_audits_the_index(spark, tmp_path, capsys):
    path = f"{tmp_path}/box"
    box = c.Container.create(spark, path)
    box.create_table(c.TableSpec("towns", [c.ColumnSpec("name", "TEXT")], c.GeometrySpec("POINT", 4326)))
    town = lambda x: spark.createDataFrame([("a", bytearray(struct.pack("<BIdd", 1, 1, x, 6.0)))], "name string, geom binary")
    box.insert("towns", town(5.0))
    assert main(["index", path, "towns"], spark) == 0 and main(["validate", "--strict", path], spark) == 0
    c.Container.open(spark, path).insert("towns", town(9.0))
    assert main(["validate", path], spark) == 1 and "index out of step" in capsys.readouterr().out
    assert main(["repair", path, "towns"], spark) == 0 and "rebuilt" in capsys.readouterr().out
    assert main(["validate", path], spark) == 0 and main(["drop-index", path, "towns"], spark) == 0 and main(["drop-index", path, "towns"], spark) == 1
    c.Container.open(spark, path).register(("towns", None, "acme_x", "d", "read-write"))
    assert main(["validate", path], spark) == 0 and main(["validate", "--strict", path], spark) == 1
