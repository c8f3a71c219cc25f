"""Every registered query against its SQL on small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")

from terrane.plans import catalogue  # noqa: E402

NAMES = sorted(catalogue.queries())


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        made.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return made


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in found.description]
    want = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in found.fetchall())
    assert sorted(names) == columns and got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_box_filter_reaches_the_scan(spark):
    from terrane.plans import inputs, layers

    plan = inputs.stored_points(spark, FOLDER).features_in(layers.BOX).with_columns("c_name").explain()
    assert "LessThanOrEqual(minx" in plan and "geom" not in plan[plan.index("ReadSchema") :].split("\n")[0]


def test_a_box_skips_row_groups(spark, tmp_path, monkeypatch):
    """Rows that the scan gives out: a layer lies in Hilbert order, so a small box reads few of its row groups."""
    from pyspark.sql import functions as F

    from terrane.functions import codec
    from terrane.functions.binary import body
    from terrane.operators import container as c
    from terrane.operators.layer import BoundingBox

    monkeypatch.setattr(c, "ROW_GROUP", 64 << 10)
    box = c.Container.create(spark, f"{tmp_path}/box")
    box.create_table(c.TableSpec("points", [], c.GeometrySpec("POINT", 4326)))
    k = F.col("fid")
    points = spark.range(20_000).select(F.col("id").alias("fid")).withColumn("geom", body(codec.encode_points(4326)(((k * 7919) % 3600) / 10.0 - 180, ((k * 104_729) % 1800) / 10.0 - 90)))
    box.insert("points", points)
    box.delete("points", spark.range(5))

    def given(frame) -> tuple[int, int]:
        n = len(frame.collect())
        scans = [p for p in walk(frame._jdf.queryExecution().executedPlan()) if p.nodeName().startswith("Scan")]
        return n, max(p.metrics().apply("numOutputRows").value() for p in scans)

    def walk(plan) -> list:
        if plan.nodeName() == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return walk(plan.plan())
        inner = plan.children()
        return [plan, *[x for i in range(inner.size()) for x in walk(inner.apply(i))]]

    layer = box.layer("points")
    whole, few = given(layer.rows()), given(layer.features_in(BoundingBox(0, 0, 20, 20)).without_geometry().rows())
    assert whole[1] == 20_000 and 0 < few[0] <= few[1] < 4_000


@pytest.mark.parametrize("name", ["segment_runs", "packed_leaves", "bbox_spatial_join", "stored_join"])
def test_no_exchange_to_one_partition_of_rows(spark, name):
    """One partition may hold a row for each range or partial aggregate, never the rows themselves."""
    plan = __spark_entry__.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for at in [k for k in range(len(plan)) if plan.startswith("Exchange SinglePartition", k)]:
        below = plan[at:].split("\n")[1]
        assert "HashAggregate" in below or "Window" in below or "Project" in below, below


@pytest.mark.parametrize("name", ["file_index_state"])
def test_a_file_is_written_without_rows_at_the_driver(spark, monkeypatch, name):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_, **__: pytest.fail("rows are sent to the driver"))
    assert __spark_entry__.queries()[name](spark, FOLDER).first().state == "current"
