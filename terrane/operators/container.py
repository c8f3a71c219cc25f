"""A container: a folder of Parquet parts with a catalogue, written in versions.

A table is a list of parts and of deletes, each with the version that wrote it: a delete takes away the rows of
older parts whose keys it lists.  So a write adds files and rewrites none; compact() merges them.  The
catalogue's own tables, one short row for each table, are kept in the state file itself.

A commit writes its files and then one state file that names all, under a passing name that is renamed; a
reader follows one state and sees all of a commit or nothing.  There is one writer at a time.  Paths go through
Spark's file systems, so a container can be in any store that Spark reads.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import codec, convert, names, types
from terrane.functions.grid import Extent, is_power_of_two, matrix_faults
from terrane.operators import index
from terrane.operators.layer import SIDECAR, Layer, LayerError, next_fids
from terrane.operators.pyramid import ADDRESS, Pyramid, latest, upsert
from terrane.operators.relations import add_relation, assembled, check_references, enforce
from terrane.operators.shared import settled

CONTENTS = (
    "table_name string, data_type string, identifier string, description string, last_change timestamp, "
    "min_x double, min_y double, max_x double, max_y double, srs_id int"
)
GEOMETRY_COLUMNS = "table_name string, column_name string, geometry_type_name string, srs_id int, z int, m int"
SRS = "srs_name string, srs_id int, organization string, organization_coordsys_id int, definition string, description string, definition_12_063 string"
EXTENSIONS = "table_name string, column_name string, extension_name string, definition string, scope string"
UNDEFINED = [
    ("Undefined Cartesian SRS", -1, "NONE", -1, "undefined", "undefined Cartesian coordinate reference system", "undefined"),
    ("Undefined geographic SRS", 0, "NONE", 0, "undefined", "undefined geographic coordinate reference system", "undefined"),
    ("WGS 84", 4326, "EPSG", 4326, names.WGS84_WKT1, None, names.WGS84_WKT2),
]
RESERVED = "gpkg_"
CATALOGUE = {"contents": CONTENTS, "geometry_columns": GEOMETRY_COLUMNS, "srs": SRS, "extensions": EXTENSIONS}
#: Rows of one sorted file of a layer, and bytes of its row groups: a box skips whole groups.
ROWS_A_FILE, ROW_GROUP = 2_000_000, 16 << 20


@dataclass
class ColumnSpec:
    name: str
    declared: str
    not_null: bool = False
    unique: bool = False
    default: object = None


@dataclass
class GeometrySpec:
    geometry_type: str
    srs_id: int
    column: str = "geom"
    z: int = 0
    m: int = 0


@dataclass
class TableSpec:
    """What a new table is to be; columns() of a Spark schema make one."""

    name: str
    columns: list[ColumnSpec] = field(default_factory=list)
    geometry: GeometrySpec | None = None
    primary_key: str = "fid"
    identifier: str | None = None
    description: str = ""
    spatial_index: bool = True

    @staticmethod
    def of_schema(name: str, schema: T.StructType, primary_key: str = "fid") -> TableSpec:
        """Binary fields with CRS metadata become the geometry; the primary key's field is skipped."""
        columns, geometry = [], None
        for f in schema.fields:
            if f.name == primary_key:
                continue
            if isinstance(f.dataType, T.BinaryType) and "crs" in f.metadata:
                geometry = GeometrySpec("GEOMETRY", int(f.metadata["crs"]), f.name)
            else:
                columns.append(ColumnSpec(f.name, types.declared_type(f.dataType), not f.nullable))
        return TableSpec(name, columns, geometry, primary_key)

    def schema(self) -> T.StructType:
        fields = [T.StructField(self.primary_key, T.LongType(), False)]
        fields += [T.StructField(c.name, types.spark_type(c.declared), not c.not_null, {"declared": c.declared}) for c in self.columns]
        if self.geometry:
            g = self.geometry
            fields += [T.StructField(g.column, T.BinaryType(), True, {"crs": g.srs_id, "geometry_type": g.geometry_type, "z": g.z, "m": g.m})]
            fields += [T.StructField(c, T.DoubleType()) for c in SIDECAR] + [T.StructField("geom_empty", T.BooleanType()), T.StructField("geom_type", T.IntegerType()), T.StructField("dims", T.IntegerType())]
        return T.StructType(fields)


class Container:
    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path.rstrip("/"), state
        self.warnings: list[str] = []

    # -- files

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Container:
        """An empty container with three reference systems; ValueError if something is there already."""
        fs, p = cls._fs(spark, path)
        if fs.exists(p) and len(fs.listStatus(p)):
            raise ValueError(f"{path} is not empty")
        new = cls(spark, path, {"version": 0, "tables": {}, "specs": {}})
        srs = [dict(zip(_fields(SRS), row, strict=True)) for row in UNDEFINED]
        new.commit(catalogue={**{n: [] for n in CATALOGUE}, "srs": srs})
        return new

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None, lenient: bool = False) -> Container:
        """The newest state, or a version's.  Strictly, a missing catalogue table is an error; leniently, a warning."""
        fs, p = cls._fs(spark, path)
        found = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("state-")) if fs.exists(p) else []
        if version is not None:
            found = [f for f in found if f == f"state-{version:012d}.json"]
        if not found:
            raise LayerError(f"no container at {path}")
        out = cls(spark, path, json.loads(cls._text(spark, f"{path.rstrip('/')}/{found[-1]}")))
        for name in CATALOGUE:
            if name not in out.state["tables"]:
                if not lenient:
                    raise LayerError(f"no catalogue table {name}")
                out.warnings.append(f"missing catalogue table {name}")
                out.state["tables"][name] = {"schema": _schema(CATALOGUE[name]).json(), "rows": []}
        if lenient:
            out.warnings += [r.warning for r in out.open_warnings().collect()]
        return out

    @classmethod
    def _text(cls, spark: SparkSession, path: str) -> str:
        """A small file as text."""
        fs, p = cls._fs(spark, path)
        stream = fs.open(p)
        try:
            return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, tables: dict, specs: dict, version: int | None = None) -> None:
        version = version or self.state["version"] + 1
        state = {"version": version, "tables": tables, "specs": specs}
        fs, passing = self._fs(self.spark, f"{self.path}/.state-{uuid.uuid4().hex}")
        finals = [self._fs(self.spark, f"{self.path}/state-{v:012d}.json")[1] for v in range(self.state["version"] + 1, version + 1)]
        out = fs.create(passing, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if any(fs.exists(p) for p in finals) or not fs.rename(passing, finals[-1]):
            fs.delete(passing, False)
            raise LayerError(f"another writer has written after version {self.state['version']}")
        self.state = state

    def _store(self, name: str, df: DataFrame) -> str:
        """A folder of the container with df, which no state names yet."""
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/{folder}")
        return folder

    def _part(self, name: str, folder: str) -> DataFrame:
        return self.spark.read.schema(self._schema_of(name)).parquet(f"{self.path}/{folder}")

    def _drop(self, *folders: str) -> None:
        for folder in folders:
            fs, p = self._fs(self.spark, f"{self.path}/{folder}")
            fs.delete(p, True)

    def commit(
        self,
        frames: dict[str, DataFrame] | None = None,
        specs: dict[str, dict] | None = None,
        dropped: tuple[str, ...] = (),
        catalogue: dict[str, list[dict]] | None = None,
        changes: dict[str, tuple[str | None, str | None, tuple[str, ...]]] | None = None,
        created: dict[str, T.StructType] | None = None,
    ) -> None:
        """Write a new state.

        frames: tables that are replaced as a whole.  created: schemas of empty new ones.  catalogue: rows of the catalogue's own tables.  changes: for a
        table, the folder of a new part, the folder of a delete, and the delete's key columns.
        """
        tables = {k: v for k, v in self.state["tables"].items() if k not in dropped}
        tables |= {name: {"schema": schema.json(), "parts": [], "deletes": []} for name, schema in (created or {}).items()}
        version = self.state["version"] + 1
        for name, df in (frames or {}).items():
            if name in CATALOGUE:
                catalogue = {**(catalogue or {}), name: [r.asDict() for r in df.collect()]}  # a row for each table or so
            else:
                tables[name] = {"schema": df.schema.json(), "parts": [{"folder": self._store(name, df), "version": version}], "deletes": []}
        for name, rows in (catalogue or {}).items():
            tables[name] = {"schema": _schema(CATALOGUE[name]).json(), "rows": [{k: _stored(v) for k, v in r.items()} for r in rows]}
        for name, (part, delete, key) in (changes or {}).items():
            at = tables[self._named(name)]
            parts = at["parts"] + ([{"folder": part, "version": version}] if part else [])
            deletes = at["deletes"] + ([{"folder": delete, "version": version, "key": list(key)}] if delete else [])
            tables[self._named(name)] = {**at, "parts": parts, "deletes": deletes if parts else []}
        self._publish(tables, {**self.state["specs"], **(specs or {})})

    def _named(self, name: str) -> str:
        match = next((k for k in self.state["tables"] if k.lower() == name.lower()), None)
        if match is None:
            raise LayerError(f"no such table: {name}")
        return match

    def _schema_of(self, name: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.state["tables"][self._named(name)]["schema"]))

    def rows(self, name: str) -> list[dict]:
        """Rows of one of the catalogue's own tables."""
        return [{k: _restored(k, v) for k, v in r.items()} for r in self.state["tables"][name]["rows"]]

    def table(self, name: str) -> DataFrame:
        """A table as the state has it: its parts without the rows that later deletes name."""
        at, schema = self.state["tables"][self._named(name)], self._schema_of(name)
        if "rows" in at:
            return self.spark.createDataFrame([tuple(r.get(f) for f in schema.names) for r in self.rows(self._named(name))], schema)
        if not at["parts"]:
            return self.spark.createDataFrame([], schema)
        ages: dict[int, list[str]] = {}
        for part in at["parts"]:
            ages.setdefault(sum(d["version"] <= part["version"] for d in at["deletes"]), []).append(f"{self.path}/{part['folder']}")
        out = []
        for age, paths in sorted(ages.items()):
            df = self.spark.read.schema(schema).parquet(*paths)
            by_key: dict[tuple[str, ...], list[str]] = {}
            for d in at["deletes"][age:]:
                by_key.setdefault(tuple(d["key"]), []).append(f"{self.path}/{d['folder']}")
            for key, gone in by_key.items():
                df = df.join(self.spark.read.schema(T.StructType([schema[c] for c in key])).parquet(*gone), list(key), "left_anti")
            out.append(df.select(*schema.names))
        return reduce(DataFrame.union, out)

    def compact(self, name: str) -> None:
        """One part and no deletes: the table is written anew, a layer with an index in its order."""
        spec = self.state["specs"].get(self._named(name), {})
        table = self.table(name)
        self.commit({self._named(name): self._clustered(settled(table)) if spec.get("spatial_index") else table})

    # -- catalogue

    def contents(self) -> DataFrame:
        return self.table("contents").orderBy("table_name")

    def srs_list(self) -> DataFrame:
        return self.table("srs").orderBy("srs_id")

    def srs(self, srs_id: int) -> dict:
        """A reference system by id; LayerError for one that isn't listed."""
        row = next((r for r in self.rows("srs") if r["srs_id"] == srs_id), None)
        if row is None:
            raise LayerError(f"no reference system {srs_id}")
        return row

    def extensions(self) -> DataFrame:
        return self.table("extensions").orderBy(F.asc_nulls_first("table_name"), F.asc_nulls_first("column_name"), "extension_name")

    def table_extensions(self, name: str) -> DataFrame:
        """Extensions on a table, and those on the whole container."""
        return self.extensions().where(F.col("table_name").isNull() | (F.lower("table_name") == name.lower()))

    def layers(self) -> DataFrame:
        return feature_layers(self.table("contents"), self.table("geometry_columns"))

    def geometry_columns(self) -> DataFrame:
        return self.table("geometry_columns").orderBy("table_name", "column_name")

    def geometry_column(self, name: str) -> dict:
        """The geometry column of a layer; LayerError if there is none, or its type or its z or m code isn't one of the format's."""
        row = next((r for r in self.rows("geometry_columns") if r["table_name"].lower() == name.lower()), None)
        if row is None:
            raise LayerError(f"no geometry column of {name}")
        if (row["geometry_type_name"] or "").upper() not in types.GEOMETRY_TYPES:
            raise LayerError(f"{name}: no geometry type {row['geometry_type_name']}")
        if row["z"] not in (0, 1, 2) or row["m"] not in (0, 1, 2):
            raise LayerError(f"{name}: z {row['z']}, m {row['m']}")
        return row

    def open_warnings(self) -> DataFrame:
        return open_warnings(self.table("contents"), self.table("geometry_columns"), self.table("extensions"), sorted(self.state["tables"]))

    def _kind(self, name: str) -> str | None:
        return next((r["data_type"] for r in self.rows("contents") if r["table_name"].lower() == name.lower()), None)

    def layer(self, name: str) -> Layer:
        """A feature layer by name in any case; LayerError for no such one or one of another kind."""
        kind = self._kind(name)
        if kind is None:
            raise LayerError(f"no such layer: {name}")
        if kind != "features":
            raise LayerError(f"{name} holds {kind}")
        g = self.geometry_column(name)
        return Layer(self.table(name), self._key(name), g["column_name"], srs_id=g["srs_id"])

    def attributes(self, name: str) -> Layer:
        if self._kind(name) != "attributes":
            raise LayerError(f"no such attribute table: {name}")
        return Layer(self.table(name), self._key(name), None)

    def _spec(self, name: str) -> dict:
        return self.state["specs"][self._named(name)]

    def _key(self, name: str) -> str:
        return next((s["primary_key"] for k, s in self.state["specs"].items() if k.lower() == name.lower()), "fid")

    # -- writing

    def create_table(self, spec: TableSpec) -> None:
        """Catalogue rows and an empty table; its name may not start as the catalogue's do, and its reference system has to be listed."""
        names.quote(spec.name)
        if spec.name.lower().startswith(RESERVED) or spec.name.lower() in {t.lower() for t in self.state["tables"]}:
            raise LayerError(f"the name {spec.name} is taken")
        g = spec.geometry
        if g:
            self.srs(g.srs_id)
        row = dict.fromkeys(_fields(CONTENTS)) | {
            "table_name": spec.name,
            "data_type": "features" if g else "attributes",
            "identifier": spec.identifier or spec.name,
            "description": spec.description,
            "last_change": datetime.datetime.now(),
            "srs_id": g.srs_id if g else None,
        }
        catalogue = {"contents": [*self.rows("contents"), row]}
        if g:
            column = dict(zip(_fields(GEOMETRY_COLUMNS), (spec.name, g.column, g.geometry_type, g.srs_id, g.z, g.m), strict=True))
            catalogue["geometry_columns"] = [*self.rows("geometry_columns"), column]
            if spec.spatial_index:
                catalogue["extensions"] = self._with_extension((spec.name, g.column, "gpkg_rtree_index", "spatial index", "write-only"))
        kept = {
            "primary_key": spec.primary_key,
            "geometry": g.column if g else None,
            "srs_id": g.srs_id if g else None,
            "spatial_index": bool(g and spec.spatial_index),
            "z": g.z if g else 0,
            "m": g.m if g else 0,
            "type": g.geometry_type if g else None,
            "columns": [c.name for c in spec.columns],
            "not_null": [c.name for c in spec.columns if c.not_null],
            "unique": [c.name for c in spec.columns if c.unique],
            "defaults": {c.name: c.default for c in spec.columns if c.default is not None},
        }
        self.commit(catalogue=catalogue, specs={spec.name: kept}, created={spec.name: spec.schema()})

    def _with_extension(self, row: tuple, rows: list[dict] | None = None) -> list[dict]:
        """The extension rows with one added, or put in the place of that of the same table, column and name."""
        new, own = dict(zip(_fields(EXTENSIONS), row, strict=True)), ("table_name", "column_name", "extension_name")
        rest = [r for r in (self.rows("extensions") if rows is None else rows) if any(r[c] != new[c] for c in own)]
        return [*rest, new]

    def _prepared(self, name: str, rows: DataFrame, constraints: bool = False) -> DataFrame:
        """rows with WKB in the geometry column, encoded and with sidecar columns; refused rows raise at execution.

        A null in a column that may not be null is refused, and with constraints what breaks a column's constraint.
        """
        self.check_writable(name)
        spec, schema = self._spec(name), self._schema_of(name)
        g, key = spec["geometry"], spec["primary_key"]
        if unknown := sorted(set(rows.columns) - {key, g, *spec["columns"]}):
            raise LayerError(f"no such column: {', '.join(unknown)}")
        for c in spec["columns"]:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(spec["defaults"].get(c)).cast(schema[c].dataType))
        problem = F.lit(None).cast("string")
        for c in spec["not_null"]:
            problem = F.coalesce(problem, F.when(F.col(c).isNull(), f"{c} is null"))
        if constraints and (rules := constraint_rules(self, name)):
            rows = enforce(rows, rules).withColumnRenamed("violations", "_violations")
            problem = F.coalesce(problem, F.when(F.size("_violations") > 0, F.concat(F.lit("constraint of "), F.array_join("_violations", ", "))))
        if g:
            enc = codec.encode_wkb(spec["srs_id"])(F.col(g)) if g in rows.columns else F.lit(None).cast(codec.ENCODED)
            rows = rows.withColumn("_e", enc)
            code = F.col("_e.geom_type")
            declared = types.geometry_code(F.lit(spec["type"]))
            has_z, has_m = F.col("_e.dims").isin(1, 3), F.col("_e.dims").isin(2, 3)
            flat = types.zm_allowed(F.lit(spec["z"]), has_z) & types.zm_allowed(F.lit(spec["m"]), has_m)
            problem = F.coalesce(
                problem,
                F.col("_e.error"),
                F.when(code.isNotNull() & ~types.type_matches(declared, code), "geometry type"),
                F.when(code.isNotNull() & ~flat, "z or m"),
            )
            rows = rows.withColumn("_problem", problem).withColumn(g, F.col("_e.geom"))
            rows = rows.withColumns({c: F.col(f"_e.{c}") for c in (*SIDECAR, "geom_empty", "geom_type", "dims")})
        else:
            rows = rows.withColumn("_problem", problem)
        return rows.where(accepted(F.col("_problem")))

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._schema_of(name).fields])

    def _clustered(self, table: DataFrame) -> DataFrame:
        """A table in Hilbert order, cut into as many files as its rows need."""
        return index.clustered(table, max(1, -(-table.count() // ROWS_A_FILE))).select(*table.columns)

    def _staged(self, name: str, rows: DataFrame) -> str:
        """The folder of a new part; a layer's geometries are encoded once, and put in order from there."""
        shaped = self._shaped(name, rows)
        return self._store(name, self._clustered(settled(shaped)) if self._spec(name)["spatial_index"] else shaped)

    def _catalogued(self, name: str, table: DataFrame | None, shrink: bool = False) -> dict[str, list[dict]]:
        """The catalogue's rows after a write: the bounds grown by those of table (or set to them), last_change, and extensions for curves."""
        spec, contents = self._spec(name), self.rows("contents")
        row = next((r for r in contents if r["table_name"].lower() == name.lower()), {})
        row["last_change"] = datetime.datetime.now()
        out = {"contents": contents}
        if spec["geometry"] and table is not None:
            curved = F.collect_set(F.when(F.col("geom_type") >= 8, F.col("geom_type"))).alias("curved")  # seven types at most
            e = table.agg(*Layer.bounds(), curved).first()
            for c, fold in (("min_x", min), ("min_y", min), ("max_x", max), ("max_y", max)):
                known = [v for v in (None if shrink else row.get(c), e[c]) if v is not None]
                row[c] = fold(known) if known else None
            if e.curved:
                extensions = self.rows("extensions")
                for t in sorted(e.curved):
                    extensions = self._with_extension((name, spec["geometry"], f"gpkg_geom_{types.GEOMETRY_TYPES[t]}", "curved geometry", "read-write"), extensions)
                out["extensions"] = extensions
        return out

    def _check_unique(self, name: str, new: DataFrame, old: DataFrame) -> None:
        """ValueError if a value of a unique column comes twice; nulls may."""
        for c in self._spec(name)["unique"]:
            values = new.where(F.col(c).isNotNull()).select(c)
            if values.groupBy(c).count().where("count > 1").limit(1).count() or values.join(old.select(c), c, "left_semi").limit(1).count():
                raise ValueError(f"{c} repeats")

    def _put(self, name: str, rows: DataFrame, gone: DataFrame | None, key: list[str], specs: dict | None = None, fresh: bool = False) -> int:
        """Add rows, in place of those of older parts whose keys are in gone, as one commit; how many were added.

        fresh: ValueError for a key that is there already or comes twice, as the part that was written tells.
        """
        part, delete = self._staged(name, rows), None
        try:
            new = self._part(name, part)
            if fresh:
                ids = new.select(*key)
                self._once(ids, *key)
                if self.state["tables"][self._named(name)]["parts"] and ids.join(self.table(name).select(*key), key, "left_semi").limit(1).count():
                    raise ValueError(f"{key[0]} repeats")
            if self._spec(name)["unique"]:
                old = self.table(name)
                self._check_unique(name, new, old if gone is None else old.join(gone, key, "left_anti"))
            delete = None if gone is None else self._store(f"{name}-gone", gone.select(*key))
            added = new.count()
            self.commit(specs=specs, catalogue=self._catalogued(name, new), changes={name: (part, delete, tuple(key))})
        except Exception:
            self._drop(part, *([delete] if delete else []))
            raise
        return added

    @staticmethod
    def _once(ids: DataFrame, key: str) -> None:
        if ids.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} repeats")

    def insert(self, name: str, rows: DataFrame, constraints: bool = False) -> int:
        """Add rows; ids are given or follow the largest.  ValueError for an id that is there already or comes twice."""
        key, new = self._spec(name)["primary_key"], self._prepared(name, rows, constraints)
        if key not in rows.columns:
            last = self.table(name).agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
            new = next_fids(new, last, key)
        return self._put(name, new, None, [key], fresh=key in rows.columns)

    write_all = insert

    def update(self, name: str, rows: DataFrame, constraints: bool = False) -> int:
        """Whole rows by id, each id once; how many matched."""
        key = self._spec(name)["primary_key"]
        self._once(rows.select(key), key)
        there = rows.join(self.table(name).select(key), key, "left_semi").select(*rows.columns)
        return self._put(name, self._prepared(name, there, constraints), there.select(key), [key])

    def update_columns(self, name: str, rows: DataFrame, constraints: bool = False) -> int:
        """Only the columns of rows, by id, each id once; LayerError for an unknown one."""
        spec, old = self._spec(name), self.table(name)
        key = spec["primary_key"]
        if unknown := sorted(set(rows.columns) - {key, *spec["columns"]}):
            raise LayerError(f"no such column: {', '.join(unknown)}")
        self.check_writable(name)
        self._once(rows.select(key), key)
        changed = partial_update(old.join(rows.select(key), key, "left_semi").select(*old.columns), rows, key)
        bad = [F.when(F.col(c).isNull(), f"{c} is null") for c in spec["not_null"] if c in rows.columns]
        if constraints and (rules := {c: r for c, r in constraint_rules(self, name).items() if c in rows.columns}):
            changed = enforce(changed, rules)
            bad.append(F.when(F.size("violations") > 0, F.concat(F.lit("constraint of "), F.array_join("violations", ", "))))
        if bad:
            changed = changed.where(accepted(F.coalesce(*bad)))
        return self._put(name, changed, rows.select(key), [key])

    def upsert(self, name: str, rows: DataFrame, key: list[str], order: Column | None = None, constraints: bool = False, specs: dict | None = None) -> None:
        """Rows in place of those of equal key, and added; of several new ones the last by order counts.

        A table that the container made itself is written as insert() does; another one as it is.
        """
        new = rows if order is None else latest(rows, key, order)
        if self._named(name) in self.state["specs"]:
            fields = [self._spec(name)["primary_key"], self._spec(name)["geometry"], *self._spec(name)["columns"]]
            own = new.select(*[c for c in new.columns if c in fields])
            self._put(name, self._prepared(name, own, constraints), new.select(*key).distinct(), key, specs)
            return
        part = self._store(name, self._shaped(name, new))
        delete = self._store(f"{name}-gone", self._part(name, part).select(*key).distinct())
        self.commit(specs=specs, changes={name: (part, delete, tuple(key))})

    def remove(self, name: str, keys: DataFrame, key: list[str]) -> None:
        """Take rows away by any key."""
        self.commit(changes={name: (None, self._store(f"{name}-gone", keys.select(*key).distinct()), tuple(key))})

    def delete(self, name: str, ids: DataFrame) -> int:
        """Rows by id; the recorded bounds stay.  How many there were."""
        self.check_writable(name)
        key = self._spec(name)["primary_key"]
        gone = ids.select(F.col(ids.columns[0]).cast("long").alias(key)).distinct()
        folder = self._store(f"{name}-gone", gone)
        listed = self.spark.read.schema(T.StructType([T.StructField(key, T.LongType())])).parquet(f"{self.path}/{folder}")
        matched = self.table(name).join(listed, key, "left_semi").count()
        self.commit(catalogue=self._catalogued(name, None), changes={name: (None, folder, (key,))})
        return matched

    def transaction(self, work: Callable[[Container], None]) -> None:
        """Run several writes as one: work gets a container whose commits stay its own until all are done; if it raises, nothing is written."""
        inner = _Pending(self.spark, self.path, self.state)
        try:
            work(inner)
        except Exception:
            known = {f for t in self.state["tables"].values() for f in _folders(t)}
            self._drop(*{f for t in inner.state["tables"].values() for f in _folders(t)} - known)
            raise
        if inner.state["version"] > self.state["version"]:  # its versions were counted up inside, which keeps deletes after what they delete
            self._publish(inner.state["tables"], inner.state["specs"], inner.state["version"])

    def recompute_extent(self, name: str) -> None:
        self.commit(catalogue=self._catalogued(name, self.table(name), shrink=True))

    def add_srs(self, row: tuple) -> bool:
        """A reference system (its columns in order, the last may be left out); False if its id is listed."""
        new = dict(zip(_fields(SRS), (*row, *[None] * (len(_fields(SRS)) - len(row))), strict=True))
        if any(r["srs_id"] == new["srs_id"] for r in self.rows("srs")):
            return False
        self.commit(catalogue={"srs": [*self.rows("srs"), new]})
        return True

    def add_epsg_srs(self, code: int) -> bool:
        """A reference system of the EPSG by code; LayerError for one whose definition isn't known here."""
        known = names.epsg_definition(code)
        if known is None:
            raise LayerError(f"no definition of EPSG:{code}")
        return self.add_srs((known.name, code, "EPSG", code, known.wkt1, None, known.wkt2))

    def register(self, row: tuple) -> None:
        self.commit(catalogue={"extensions": self._with_extension(row)})

    def unregister(self, name: str, table: str | None = None, column: str | None = None) -> bool:
        """Take an extension row away; False if there is none."""
        same = lambda r: r["extension_name"] == name and (r["table_name"] or "").lower() == (table or "").lower() and (r["column_name"] or "").lower() == (column or "").lower()
        left = [r for r in self.rows("extensions") if not same(r)]
        if len(left) == len(self.rows("extensions")):
            return False
        self.commit(catalogue={"extensions": left})
        return True

    def check_writable(self, name: str) -> None:
        """LayerError if an extension that isn't recognised stands on the table or on the whole container, and isn't allowed."""
        allowed = self.state["specs"].get("_allowed", {}).get("extensions", [])
        for r in self.rows("extensions"):
            if (r["table_name"] is None or r["table_name"].lower() == name.lower()) and names.support_of(r["extension_name"]) == "unrecognised" and r["extension_name"] not in allowed:
                raise LayerError(f"extension {r['extension_name']} blocks writing")

    def allow_extension(self, name: str) -> None:
        """Write in spite of an extension that isn't recognised; the caller answers for what it means."""
        allowed = self.state["specs"].get("_allowed", {}).get("extensions", [])
        self.commit(specs={"_allowed": {"extensions": sorted({*allowed, name})}})

    def copy_to(self, path: str) -> tuple[Container, list[str]]:
        """All feature and attribute tables to a new container, and the tables left behind."""
        other = Container.create(self.spark, path)
        kept = sorted(k for k in self.state["specs"] if k in self.state["tables"])
        catalogue = {n: self.rows(n) for n in CATALOGUE}
        catalogue["contents"] = [r for r in catalogue["contents"] if r["table_name"] in kept]
        other.commit({n: self.table(n) for n in kept}, self.state["specs"], catalogue=catalogue)
        return other, sorted(set(self.state["tables"]) - set(kept) - set(CATALOGUE))

    # -- spatial index

    def create_index(self, name: str) -> None:
        """The stored index of a layer: a table of bounds, rounded outward, by id.  Written again, it is built anew."""
        spec = self._spec(name)
        if not spec["geometry"]:
            raise LayerError(f"{name} has no geometry")
        built = index.build(self.table(name), spec["primary_key"])
        extensions = self._with_extension((self._named(name), spec["geometry"], "gpkg_rtree_index", "spatial index", "write-only"))
        self.commit({index_name(self._named(name)): built}, {self._named(name): {**spec, "spatial_index": True}}, catalogue={"extensions": extensions})

    def drop_index(self, name: str) -> bool:
        """Take the stored index and its registration away; False if there is none."""
        spec, stored = self._spec(name), index_name(self._named(name))
        there = stored in self.state["tables"] or spec["spatial_index"]
        own = lambda r: r["extension_name"] == "gpkg_rtree_index" and (r["table_name"] or "").lower() == name.lower()
        self.commit(specs={self._named(name): {**spec, "spatial_index": False}}, dropped=(stored,), catalogue={"extensions": [r for r in self.rows("extensions") if not own(r)]})
        return there

    def audit_index(self, name: str) -> DataFrame:
        """One row: indexable, entries, missing, extra, not_covering, is_consistent.  The sidecar stands for an index that isn't stored."""
        stored, key = index_name(self._named(name)), self._key(name)
        table = self.table(name)
        entries = self.table(stored) if stored in self.state["tables"] else index.build(table, key)
        return index.is_consistent(index.audit(table, entries, key))

    def repair_index(self, name: str) -> bool:
        """Build the stored index anew if it is out of step; whether it was."""
        if self.audit_index(name).first().is_consistent:
            return False
        self.create_index(name)
        return True

    def index_status(self, name: str) -> str:
        """absent; current; or stale where the index is registered and its entries are out of step."""
        if not self._spec(name)["spatial_index"]:
            return "absent"
        return "current" if self.audit_index(name).first().is_consistent else "stale"


class _Pending(Container):
    """A container whose states aren't written."""

    def _publish(self, tables: dict, specs: dict, version: int | None = None) -> None:
        self.state = {"version": self.state["version"] + 1, "tables": tables, "specs": specs}


def accepted(problem: Column) -> Column:
    """A filter that lets all rows through, and raises for one with a problem.

    A row number in it, which decides nothing but is no function of the row, keeps the optimizer from trying rows that the
    caller's filters leave out.
    """
    refused = F.raise_error(F.concat(F.lit("refused: "), problem)).cast("boolean")
    return F.when(problem.isNull(), F.monotonically_increasing_id() >= 0).otherwise(refused)


def index_name(table: str) -> str:
    return f"rtree_{table}"


def _folders(table: dict) -> list[str]:
    return [x["folder"] for x in (*table.get("parts", ()), *table.get("deletes", ()))]


def _fields(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def _stored(value):
    """A catalogue value as the state file keeps it."""
    return value.isoformat() if isinstance(value, datetime.datetime) else value


def _restored(column: str, value):
    return datetime.datetime.fromisoformat(value) if column == "last_change" and isinstance(value, str) else value


MATRIX_SET = "table_name string, srs_id int, min_x double, min_y double, max_x double, max_y double"
MATRIX = "table_name string, zoom_level long, matrix_width long, matrix_height long, tile_width long, tile_height long, pixel_x_size double, pixel_y_size double"
TILES = "zoom_level long, tile_column long, tile_row long, tile_data binary"
METADATA = "id long, md_scope string, md_standard_uri string, mime_type string, metadata string"
REFERENCES = "reference_scope string, table_name string, column_name string, row_id_value long, timestamp timestamp, md_file_id long, md_parent_id long"
RELATIONS = "id long, base_table_name string, base_primary_column string, related_table_name string, related_primary_column string, relation_name string, mapping_table_name string"
DATA_COLUMNS = "table_name string, column_name string, name string, title string, description string, mime_type string, constraint_name string"
CONSTRAINTS = "constraint_name string, constraint_type string, value string, min double, min_is_inclusive boolean, max double, max_is_inclusive boolean, description string"


def optional(box: Container, name: str, schema: str) -> DataFrame:
    """A catalogue table that a container may lack: empty then."""
    return box.table(name) if name in box.state["tables"] else box.spark.createDataFrame([], schema)


def create_pyramid(box: Container, name: str, extent: Extent, matrices: DataFrame, allow_zoom_other: bool = False) -> None:
    """An empty tile pyramid; LayerError for faulty matrices, or for a ladder that isn't of halves unless that is allowed."""
    named = matrices.withColumn("table_name", F.lit(name))
    fault = matrix_faults(named, extent).where("fault IS NOT NULL").first()
    if fault:
        raise LayerError(f"zoom {fault.zoom_level}: {fault.fault}")
    halves = is_power_of_two(named, "table_name").first().is_ladder
    if not halves and not allow_zoom_other:
        raise LayerError("pixel sizes are not halved from zoom to zoom")
    if name.lower() in {t.lower() for t in box.state["tables"]}:
        raise LayerError(f"the name {name} is taken")
    row = dict.fromkeys(_fields(CONTENTS)) | {"table_name": name, "data_type": "tiles", "identifier": name, "description": "", "last_change": datetime.datetime.now(), "srs_id": extent.srs_id}
    row |= {c: float(getattr(extent, c)) for c in ("min_x", "min_y", "max_x", "max_y")}
    sets = box.spark.createDataFrame([(name, extent.srs_id, extent.min_x, extent.min_y, extent.max_x, extent.max_y)], MATRIX_SET)
    frames = {
        "tile_matrix_set": optional(box, "tile_matrix_set", MATRIX_SET).unionByName(sets),
        "tile_matrix": optional(box, "tile_matrix", MATRIX).unionByName(named.select(*_fields(MATRIX))),
        name: box.spark.createDataFrame([], TILES),
    }
    catalogue = {"contents": [*box.rows("contents"), row]}
    if not halves:
        catalogue["extensions"] = box._with_extension((name, "tile_data", "gpkg_zoom_other", "other zoom intervals", "read-write"))
    box.commit(frames, catalogue=catalogue)


def open_pyramid(box: Container, name: str) -> Pyramid:
    row = optional(box, "tile_matrix_set", MATRIX_SET).where(F.lower("table_name") == name.lower()).first()
    if row is None:
        raise LayerError(f"no tile pyramid: {name}")
    matrices = box.table("tile_matrix").where(F.lower("table_name") == name.lower()).drop("table_name")
    return Pyramid(Extent(row.min_x, row.min_y, row.max_x, row.max_y, row.srs_id), matrices, box.table(name))


def tile_pyramids(box: Container) -> DataFrame:
    """Names of tile tables that have a matrix set, matched in any case, in order."""
    sets = optional(box, "tile_matrix_set", MATRIX_SET).select(F.lower("table_name").alias("_t")).distinct()
    return box.table("contents").where("data_type = 'tiles'").join(sets, F.lower("table_name") == F.col("_t"), "left_semi").select("table_name").orderBy("table_name")


def put_tiles(box: Container, name: str, new: DataFrame, order: str | None = None) -> None:
    """Upsert tiles; LayerError for one at an unknown zoom, outside the grid, or of another pixel size than its zoom's.  WebP is registered once."""
    box.check_writable(name)
    pyramid = open_pyramid(box, name)
    checked = pyramid.checked(new)
    if bad := checked.where("error IS NOT NULL").first():
        raise LayerError(f"tile {bad.zoom_level}/{bad.tile_column}/{bad.tile_row}: {bad.error}")
    webp = new.where((F.hex(F.substring("tile_data", 1, 4)) == "52494646") & (F.hex(F.substring("tile_data", 9, 4)) == "57454250")).limit(1).count()
    box.upsert(name, new, list(ADDRESS), F.col(order) if order else F.xxhash64("tile_data"))
    if webp:
        box.register((name, "tile_data", "gpkg_webp", "WebP tiles", "read-write"))


def delete_tiles(box: Container, name: str, addresses: DataFrame) -> None:
    box.remove(name, addresses, list(ADDRESS))


def add_metadata(box: Container, rows: DataFrame) -> None:
    box.commit({"metadata": optional(box, "metadata", METADATA).unionByName(rows)})


def metadata_record(box: Container, record: int) -> dict:
    """A metadata record by id; LayerError for none."""
    row = optional(box, "metadata", METADATA).where(F.col("id") == record).first()
    if row is None:
        raise LayerError(f"no metadata {record}")
    return row.asDict()


def references_to(box: Container, record: int) -> DataFrame:
    """References that carry a metadata record, in the order of scope and target."""
    found = optional(box, "metadata_reference", REFERENCES).where(F.col("md_file_id") == record)
    return found.orderBy("reference_scope", "table_name", "column_name", "row_id_value")


def add_references(box: Container, rows: DataFrame) -> None:
    """Metadata references; LayerError for one whose scope, targets, parent or record is wrong."""
    if bad := check_references(rows, optional(box, "metadata", METADATA)).where("error IS NOT NULL").first():
        raise LayerError(f"reference to {bad.md_file_id}: {bad.error}")
    box.commit({"metadata_reference": optional(box, "metadata_reference", REFERENCES).unionByName(rows)})


def add_relations(box: Container, rows: DataFrame) -> None:
    """Relations and their empty mapping tables; LayerError for a name that doesn't conform, an unknown end or a mapping name that is taken."""
    good, bad = add_relation(optional(box, "relations", RELATIONS), box.table("contents"), rows)
    if first := bad.first():
        raise LayerError(f"relation {first.id}: {first.error}")
    mappings = [r[0] for r in rows.select("mapping_table_name").distinct().collect()]  # one name a relation
    if taken := {m.lower() for m in mappings} & {t.lower() for t in box.state["tables"]}:
        raise LayerError(f"the name {min(taken)} is taken")
    box.commit({"relations": good, **{m: box.spark.createDataFrame([], "base_id long, related_id long") for m in mappings}})


def add_mappings(box: Container, mapping: str, pairs: DataFrame) -> None:
    box.commit({mapping: box.table(mapping).unionByName(pairs.select("base_id", "related_id"))})


def set_data_columns(box: Container, rows: DataFrame) -> None:
    """Column descriptions by table and column; those that were there are replaced."""
    box.commit({"data_columns": upsert(optional(box, "data_columns", DATA_COLUMNS), rows, ["table_name", "column_name"])})


def add_column_constraint(box: Container, rows: DataFrame) -> None:
    """Constraint rows (CONSTRAINTS); LayerError for an unknown kind, a range without an end or with its ends turned, or a name of two kinds."""
    kind, low, high = F.col("constraint_type"), F.col("min"), F.col("max")
    fault = (
        F.when(~F.coalesce(kind.isin("range", "enum", "glob"), F.lit(False)), "unknown kind")
        .when((kind == "range") & (low.isNull() | high.isNull() | (low > high)), "ends of the range")
        .when((kind != "range") & F.col("value").isNull(), "no value")
    )
    if bad := rows.withColumn("_fault", fault).where("_fault IS NOT NULL").first():
        raise LayerError(f"constraint {bad.constraint_name}: {bad._fault}")
    every = optional(box, "data_column_constraints", CONSTRAINTS).unionByName(rows)
    if two := every.groupBy("constraint_name").agg(F.countDistinct("constraint_type").alias("n"), F.count(F.when(kind != "enum", 1)).alias("m")).where("n > 1 OR m > 1").first():
        raise LayerError(f"constraint {two.constraint_name} is there already")
    box.commit({"data_column_constraints": every})


def constraint_rules(box: Container, name: str) -> dict[str, dict]:
    """The constraint of each described column of a table, as constraints.constraint() takes it; a column without one is left out."""
    told = optional(box, "data_columns", DATA_COLUMNS).where((F.lower("table_name") == name.lower()) & F.col("constraint_name").isNotNull())
    named = {r.column_name: r.constraint_name for r in told.select("column_name", "constraint_name").collect()}  # a row for each column of one table
    rows = optional(box, "data_column_constraints", CONSTRAINTS).where(F.col("constraint_name").isin(*named.values())) if named else None
    found = {r.constraint_name: r for r in assembled(rows).collect()} if named else {}
    out = {}
    for column, constraint in named.items():
        r = found.get(constraint)
        if r is None:
            continue
        if r.constraint_type == "range":
            out[column] = {"kind": "range", "low": r.min, "high": r.max, "low_inclusive": r.min_is_inclusive, "high_inclusive": r.max_is_inclusive}
        elif r.constraint_type == "enum":
            out[column] = {"kind": "enum", "members": r.members}
        else:
            out[column] = {"kind": "glob", "pattern": r.members[0]}
    return out


def violations(box: Container, name: str, rows: DataFrame) -> DataFrame:
    """rows with `violations`: the columns whose constraint a row breaks, or that may not be null and are, or that are unique and come twice."""
    spec = box._spec(name)
    told = enforce(rows, constraint_rules(box, name))
    null = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in spec["not_null"]]).cast("array<string>"), lambda x: x.isNotNull())
    told = told.withColumn("violations", F.array_union(null, "violations"))
    for c in spec["unique"]:
        # Counted before the join, so that a value that very many rows share is one row here.
        twice = rows.select(c).unionByName(box.table(name).select(c)).where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).count().where("count > 1").select("_v")
        told = told.join(twice, F.col(c) == F.col("_v"), "left").withColumn("violations", F.when(F.col("_v").isNull(), F.col("violations")).otherwise(F.array_union("violations", F.array(F.lit(c))))).drop("_v")
    return told


def table_schema(box: Container, name: str) -> DataFrame:
    """Columns of a table in order with type, declared type, nullability and description."""
    schema = box.table(name).schema
    rows = [(k, f.name, f.dataType.simpleString(), f.metadata.get("declared") or f.metadata.get("geometry_type"), f.nullable, f.name == box._key(name)) for k, f in enumerate(schema.fields)]
    columns = box.spark.createDataFrame(rows, "ordinal int, column_name string, type string, declared string, nullable boolean, is_primary_key boolean")
    told = optional(box, "data_columns", DATA_COLUMNS).where(F.lower("table_name") == name.lower()).select("column_name", "title", "description", "constraint_name")
    return columns.join(told, "column_name", "left").orderBy("ordinal")


def feature_layers(contents: DataFrame, geometry_columns: DataFrame) -> DataFrame:
    """table_name of feature layers with a geometry column, names matched in any case, in order."""
    g = geometry_columns.select(F.lower("table_name").alias("_t")).distinct()
    return contents.where("data_type = 'features'").join(g, F.lower("table_name") == F.col("_t"), "left_semi").select("table_name").distinct().orderBy("table_name")


def open_warnings(contents: DataFrame, geometry_columns: DataFrame, extensions: DataFrame, tables: list[str]) -> DataFrame:
    """warning of each oddity that a lenient open tolerates."""
    there = F.array(*[F.lit(t) for t in tables]) if tables else F.array().cast("array<string>")
    lower = F.transform(there, F.lower)
    case = contents.where(~F.array_contains(there, F.col("table_name")) & F.array_contains(lower, F.lower("table_name"))).select(F.concat(F.lit("case differs: "), "table_name").alias("warning"))
    g = geometry_columns.select(F.lower("table_name").alias("_t")).distinct()
    bare = contents.where("data_type = 'features'").join(g, F.lower("table_name") == F.col("_t"), "left_anti").select(F.concat(F.lit("no geometry column: "), "table_name").alias("warning"))
    odd = extensions.where(names.extension_support(F.col("extension_name")).isin("unrecognised", "removed")).select(F.concat(F.lit("extension: "), "extension_name").alias("warning")).distinct()
    return case.union(bare).union(odd)


def partial_update(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """old with the columns of changes in place where the key matches, nulls included; of a key that comes twice the greatest row counts."""
    changed = [c for c in changes.columns if c != key]
    new = changes.groupBy(key).agg(F.max(F.struct(*changed)).alias("_new"))
    both = old.join(new, key, "left")
    return both.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns])


def read_value(df: DataFrame, column: str, declared: str, options: convert.Options = convert.LENIENT_READING) -> DataFrame:
    """column of text or number as its declared type, with `<column>_error` beside it."""
    c = F.col(column)
    if declared == "DATE":
        return df.withColumn(f"{column}_error", convert.date_error(c)).withColumn(column, convert.date(c))
    if declared == "DATETIME":
        loose = options.loose_datetime
        return df.withColumn(f"{column}_error", convert.datetime_error(c, loose)).withColumn(column, convert.datetime(c, loose))
    if declared == "BOOLEAN":
        value = convert.boolean(c) if options.any_boolean else convert.boolean_strict(c)
        return df.withColumn(f"{column}_error", F.when(c.isNotNull() & value.isNull(), "not a boolean")).withColumn(column, value)
    kind = types.spark_type(declared)
    value = c.try_cast(kind)
    refused = isinstance(kind, T.DoubleType) and not options.integer_as_real and isinstance(df.schema[column].dataType, T.IntegralType)
    value = F.lit(None).cast(kind) if refused else value
    return df.withColumn(f"{column}_error", F.when(c.isNotNull() & value.isNull(), F.lit(f"not {declared}"))).withColumn(column, value)
