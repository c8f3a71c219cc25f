"""Reading feature, attribute and tile tables of a SQLite container file as a Python data source, and writing such files.

    spark.dataSource.register(ContainerFile)
    spark.read.format("container").option("table", "roads").load("/shared/file")

Executors open the file themselves, so it has to be in a folder that all of them see.  The scan is split by
ranges of the integer key; comparisons with literals on value columns go into the file's own WHERE clause, and
those of a box on minx, maxx, miny and maxy into its R-tree, where it has one (option index=false: not).  Option
columns names the columns that are read, the others aren't touched.
Values follow the declared types: lenient by default, option strict=true to refuse what lenient widens;
what cannot be read is null, with the reason in the column named by option "errors", if one is given.
Geometry columns come as stored, with sidecar columns minx, maxx, miny, maxy and geom_empty.

export() writes tables of a container to one file, as the format wants it: tasks write ranges of the key to files of
their own and pack the leaves of an index, and one connection of the driver copies those, in their order, into the one.
"""

from __future__ import annotations

import datetime
import itertools
import re
import sqlite3
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from terrane.functions import codec, ordering, types

# Rows of a batch that is read, bytes of a piece of a file that tasks hand over.
BATCH, PIECE = 8192, 256 << 10
STRICT_DATETIME = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)\.(\d{3})Z", re.A)
LENIENT_DATETIME = re.compile(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d(?::?\d\d)?)?", re.A)
SIDECAR = [("minx", T.DoubleType()), ("maxx", T.DoubleType()), ("miny", T.DoubleType()), ("maxy", T.DoubleType()), ("geom_empty", T.BooleanType())]


def quote(name: str) -> str:
    if not name or "\0" in name:
        raise ValueError(f"not an identifier: {name!r}")
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    """A connection that reads; text that isn't UTF-8 comes with its bytes escaped."""
    con = sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "surrogateescape")
    return con


#: Storage classes by the type of the value that comes out.
CLASSES = {int: "integer", float: "real", str: "text", bytes: "blob"}


def convert(raw, declared: str, strict: bool):
    """(value, error) of a stored value under a declared type."""
    if raw is None:
        return None, None
    kind = CLASSES[type(raw)]
    name = re.sub(r"\s*\(.*", "", declared.strip().upper())
    if name == "BOOLEAN":
        return (raw != 0, None) if kind == "integer" and (not strict or raw in (0, 1)) else (None, f"{kind} in BOOLEAN")
    if name in ("TINYINT", "SMALLINT", "MEDIUMINT", "INT", "INTEGER"):
        return (raw, None) if kind == "integer" else (None, f"{kind} in {name}")
    if name in ("FLOAT", "DOUBLE", "REAL"):
        return (float(raw), None) if kind == "real" or (kind == "integer" and not strict) else (None, f"{kind} in {name}")
    if name in ("TEXT", "DATE", "DATETIME"):
        if kind != "text":
            return None, f"{kind} in {name}"
        if not raw.isascii() and not _is_utf8(raw):
            return None, "not UTF-8"
        if name == "TEXT":
            return raw, None
        try:
            return (_date(raw) if name == "DATE" else _datetime(raw, strict)), None
        except ValueError as e:
            return None, f"{name}: {e}"
    if name == "BLOB" or name in types.GEOMETRY_TYPES:
        return (raw, None) if kind == "blob" else (None, f"{kind} in {name}")
    target = types.spark_type(declared)
    if isinstance(target, T.LongType):
        return (raw, None) if kind == "integer" else (None, f"{kind} in {name}")
    if isinstance(target, T.DoubleType):
        return (float(raw), None) if kind in ("integer", "real") else (None, f"{kind} in {name}")
    if isinstance(target, T.StringType):
        return (raw, None) if kind == "text" and _is_utf8(raw) else (None, f"{kind} in {name}")
    return (raw if kind == "blob" else raw.encode("utf-8", "surrogateescape"), None) if kind in ("blob", "text") else (None, f"{kind} in {name}")


def _is_utf8(value: str) -> bool:
    try:
        value.encode("utf-8")
    except UnicodeEncodeError:
        return False
    return True


def column(values: tuple, declared: str, strict: bool) -> tuple[list, dict[int, str]]:
    """The values of a column under its declared type, and what is wrong with some, by row.

    A column whose values all have the type that is looked for is taken as it is.
    """
    kinds = set(map(type, values)) - {type(None)}
    name = re.sub(r"\s*\(.*", "", declared.strip().upper())
    plain = {"TINYINT": {int}, "SMALLINT": {int}, "MEDIUMINT": {int}, "INT": {int}, "INTEGER": {int}, "BLOB": {bytes}, "FLOAT": {float}, "DOUBLE": {float}, "REAL": {float}}.get(name)
    if plain is None and name in types.GEOMETRY_TYPES:
        plain = {bytes}
    if plain is not None and kinds <= plain:
        return list(values), {}
    if name == "TEXT" and kinds <= {str} and all(v is None or v.isascii() for v in values):
        return list(values), {}
    told = [convert(v, declared, strict) for v in values]
    return [v for v, _ in told], {k: e for k, (_, e) in enumerate(told) if e}


def _date(s: str) -> datetime.date:
    if not re.fullmatch(r"\d{4}-\d\d-\d\d", s, re.A):
        raise ValueError("malformed")
    return datetime.date.fromisoformat(s)


def _datetime(s: str, strict: bool) -> datetime.datetime:
    m = (STRICT_DATETIME if strict else LENIENT_DATETIME).fullmatch(s)
    if not m:
        raise ValueError("malformed")
    parts = [int(x) for x in m.groups()[:6]]
    micros = int((m[7] or "").ljust(9, "0")[:6]) if m[7] else 0
    zone = m[8] if m.re is LENIENT_DATETIME and m[8] not in (None, "Z") else None
    moment = datetime.datetime(*parts, micros, tzinfo=datetime.UTC)
    if zone:
        hours, minutes = int(zone[1:3]), int(zone[3:].lstrip(":") or 0)
        if hours > 23 or minutes > 59:
            raise ValueError("offset out of range")
        shift = datetime.timedelta(hours=hours, minutes=minutes)
        moment = moment - shift if zone[0] == "+" else moment + shift
    return moment


class Described:
    """A table as the file declares it."""

    def __init__(self, path: str, name: str):
        con = connect(path)
        try:
            tables = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")]
            found = next((t for t in tables if t == name), None) or next((t for t in tables if t.lower() == name.lower()), None)
            if found is None:
                raise ValueError(f"no such table: {name}")
            self.name = found
            info = [(r[1], r[2] or "", r[3], r[5]) for r in con.execute(f"PRAGMA table_info({quote(found)})")]
            keys = [c for c, _, _, pk in info if pk]
            self.key = keys[0] if len(keys) == 1 else None
            self.columns = [(c, t) for c, t, _, _ in info]
            self.geometry = None
            if "gpkg_geometry_columns" in tables:
                row = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE lower(table_name) = lower(?)", (found,)).fetchone()
                self.geometry = row[0] if row else None
            self.key_sql = quote(self.key) if self.key else "rowid"
            rtree = self.geometry and f"rtree_{found}_{self.geometry}"
            self.index = next((t for t in tables if rtree and t.lower() == rtree.lower()), None)
            integer = self.key is None or re.match("INT", dict(self.columns)[self.key].upper())
            low, high = con.execute(f"SELECT min({self.key_sql}), max({self.key_sql}) FROM {quote(found)}").fetchone() if integer else (None, None)
            self.range = (low, high) if isinstance(low, int) and isinstance(high, int) else None
        finally:
            con.close()


class KeyRange(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))
        self.low, self.high = low, high


class ContainerReader(DataSourceReader):
    COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.strict = options.get("strict", "false").lower() == "true"
        self.errors = options.get("errors")
        self.use_index = options.get("index", "true").lower() != "false"
        self.pieces = int(options.get("partitions", "8"))
        self.where: list[str] = []
        self.params: list = []
        self.box: list[str] = []
        self.sides: list[float] = []

    def pushFilters(self, filters):
        """Comparisons of plain columns with literals, and of the sides of a box that the R-tree's entries, rounded outward, can tell; Spark tests every filter again."""
        table = Described(self.path, self.table)
        sides = {"minx": (LessThan, LessThanOrEqual), "miny": (LessThan, LessThanOrEqual), "maxx": (GreaterThan, GreaterThanOrEqual), "maxy": (GreaterThan, GreaterThanOrEqual)}
        plain = {c: t for c, t in table.columns if isinstance(types.spark_type(t), (T.LongType, T.DoubleType, T.StringType)) and re.sub(r"\W.*", "", t.upper()) not in ("DATE", "DATETIME", "BOOLEAN")}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if table.index and self.use_index and isinstance(f, sides.get(column, ())):
                self.box.append(f"{column} {self.COMPARE[type(f)]} ?")
                self.sides.append(float(f.value))
            elif column in plain:
                if type(f) in self.COMPARE and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                    self.where.append(f"{quote(column)} {self.COMPARE[type(f)]} ?")
                    self.params.append(f.value)
                elif isinstance(f, IsNotNull):
                    self.where.append(f"{quote(column)} IS NOT NULL")
            yield f

    def partitions(self):
        span = Described(self.path, self.table).range
        if span is None:
            return [KeyRange(None, None)]
        low, high = span
        n = max(1, min(self.pieces, high - low + 1))
        cuts = [low + (high - low + 1) * k // n for k in range(n + 1)]
        return [KeyRange(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        table = Described(self.path, self.table)
        wanted = {f.name for f in self.schema.fields}
        boxed = bool(table.geometry) and not wanted.isdisjoint(n for n, _ in SIDECAR)
        columns = [(c, t) for c, t in table.columns if c in wanted or (boxed and c == table.geometry)]
        picked = ", ".join(quote(c) for c, _ in columns) or "NULL"
        tests, params = list(self.where), list(self.params)
        if self.box:
            tests.append(f"{table.key_sql} IN (SELECT id FROM {quote(table.index)} WHERE {' AND '.join(self.box)})")
            params += self.sides
        if partition.low is not None:
            tests.append(f"{table.key_sql} BETWEEN ? AND ?")
            params += [partition.low, partition.high]
        sql = f"SELECT {picked} FROM {quote(table.name)}" + (f" WHERE {' AND '.join(tests)}" if tests else "") + f" ORDER BY {table.key_sql}"
        arrow = to_arrow_schema(self.schema)
        con = connect(self.path)
        try:
            cursor = con.execute(sql, params)
            while rows := cursor.fetchmany(BATCH):
                out: dict[str, list] = {}
                problems: dict[int, list[str]] = {}
                for (c, declared), values in zip(columns, zip(*rows, strict=True), strict=False):
                    out[c], wrong = column(values, declared, self.strict)
                    for k, error in wrong.items():
                        problems.setdefault(k, []).append(f"{c}: {error}")
                if boxed:
                    out |= self._sidecar(table.geometry, out[table.geometry], problems)
                if self.errors:
                    out[self.errors] = ["; ".join(problems[k]) if k in problems else None for k in range(len(rows))]
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        finally:
            con.close()

    @staticmethod
    def _sidecar(name: str, blobs: list, problems: dict[int, list[str]]) -> dict[str, list]:
        """minx, maxx, miny, maxy and geom_empty of a column of blobs."""
        rows = []
        for k, blob in enumerate(blobs):
            try:
                box = codec.envelope_of(blob)
                rows.append((*(box or (None,) * 4), None if blob is None else box is None))
            except codec.GeometryError as e:
                rows.append((None,) * 5)
                problems.setdefault(k, []).append(f"{name}: {e}")
        return dict(zip((n for n, _ in SIDECAR), map(list, zip(*rows, strict=True)), strict=True))


class ContainerFile(DataSource):
    """Options: path, table; columns (a list with commas), strict, errors, partitions, index."""

    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> T.StructType:
        table = Described(self.options["path"], self.options["table"])
        fields = [T.StructField(c, types.spark_type(t), c != table.key, {"declared": t}) for c, t in table.columns]
        if table.geometry:
            fields += [T.StructField(c, t) for c, t in SIDECAR]
        if named := self.options.get("columns"):
            chosen = [c.strip() for c in named.split(",")]
            if unknown := sorted(set(chosen) - {f.name for f in fields}):
                raise ValueError(f"no such column: {', '.join(unknown)}")
            fields = [f for f in fields if f.name in chosen]
        if self.options.get("errors"):
            fields.append(T.StructField(self.options["errors"], T.StringType()))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ContainerReader(schema, self.options)


def read(spark, path: str, table: str, **options):
    """A table of a container file as a DataFrame, with filters pushed into the file."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContainerFile)
    return spark.read.format("container").options(table=table, **options).load(path)


def file_warnings(path: str) -> list[str]:
    """What a lenient open tolerates: an old application id, a missing geometry catalogue, names that differ in case; ValueError if it isn't a container."""
    con = connect(path)
    try:
        (app,), (user,) = con.execute("PRAGMA application_id").fetchone(), con.execute("PRAGMA user_version").fetchone()
        tables = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
        if not {"gpkg_spatial_ref_sys", "gpkg_contents"} <= tables:
            raise ValueError("no catalogue in this file")
        version = {1196437808: "1.0", 1196437809: "1.1"}.get(app)
        out = [f"legacy application id of version {version}"] if version else []
        if not version and not (app == 1196444487 and user >= 10200):
            out.append(f"application id {app} with version {user}")
        if "gpkg_geometry_columns" not in tables:
            out.append("no geometry catalogue")
        for (name,) in con.execute("SELECT table_name FROM gpkg_contents"):
            if name not in tables:
                out.append(f"case differs: {name}" if name.lower() in {t.lower() for t in tables} else f"missing table: {name}")
        return out
    finally:
        con.close()


def import_layer(spark, path: str, table: str, container, **options) -> None:
    """Copy a feature or attribute table of a file into a Parquet container, geometry bodies unchanged."""
    from terrane.functions.binary import body
    from terrane.operators.container import ColumnSpec, GeometrySpec, TableSpec

    d = Described(path, table)
    df = read(spark, path, table, **options)
    con = connect(path)
    try:
        row = con.execute("SELECT geometry_type_name, srs_id, z, m FROM gpkg_geometry_columns WHERE lower(table_name) = lower(?)", (d.name,)).fetchone() if d.geometry else None
    finally:
        con.close()
    g = GeometrySpec(row[0].upper(), row[1], d.geometry, row[2], row[3]) if row else None
    columns = [ColumnSpec(c, t) for c, t in d.columns if c not in (d.key, d.geometry)]
    container.create_table(TableSpec(d.name, columns, g, d.key or "fid"))
    rows = df.select(*[c for c, _ in d.columns])
    if g:
        from pyspark.sql import functions as F

        rows = rows.withColumn(d.geometry, body(F.col(d.geometry)))
    container.insert(d.name, rows)


# The catalogue's tables as the format declares them, the application id and version.
APPLICATION, VERSION = 1196444487, 10400
DECLARED = {
    "gpkg_spatial_ref_sys": "srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT, definition_12_063 TEXT NOT NULL DEFAULT 'undefined'",
    "gpkg_contents": "table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys(srs_id)",
    "gpkg_geometry_columns": "table_name TEXT NOT NULL UNIQUE REFERENCES gpkg_contents(table_name), column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL REFERENCES gpkg_spatial_ref_sys(srs_id), z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name)",
    "gpkg_extensions": "table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL, UNIQUE (table_name, column_name, extension_name)",
    "gpkg_tile_matrix_set": "table_name TEXT NOT NULL PRIMARY KEY REFERENCES gpkg_contents(table_name), srs_id INTEGER NOT NULL REFERENCES gpkg_spatial_ref_sys(srs_id), min_x DOUBLE NOT NULL, min_y DOUBLE NOT NULL, max_x DOUBLE NOT NULL, max_y DOUBLE NOT NULL",
    "gpkg_tile_matrix": "table_name TEXT NOT NULL REFERENCES gpkg_contents(table_name), zoom_level INTEGER NOT NULL, matrix_width INTEGER NOT NULL, matrix_height INTEGER NOT NULL, tile_width INTEGER NOT NULL, tile_height INTEGER NOT NULL, pixel_x_size DOUBLE NOT NULL, pixel_y_size DOUBLE NOT NULL, PRIMARY KEY (table_name, zoom_level)",
}
TILE_TABLE = "id INTEGER PRIMARY KEY AUTOINCREMENT, zoom_level INTEGER NOT NULL, tile_column INTEGER NOT NULL, tile_row INTEGER NOT NULL, tile_data BLOB NOT NULL, UNIQUE (zoom_level, tile_column, tile_row)"


def index_triggers(table: str, geometry: str, key: str) -> dict[str, str]:
    """Statements that keep an R-tree in step with its table, by the suffix of their names; writers of the file supply the ST_ functions."""
    t, g, k, r = quote(table), quote(geometry), quote(key), quote(f"rtree_{table}_{geometry}")
    has = lambda row: f"({row}.{g} NOT NULL AND NOT ST_IsEmpty({row}.{g}))"
    hasnt = lambda row: f"({row}.{g} ISNULL OR ST_IsEmpty({row}.{g}))"
    sides = {"minx": "ST_MinX", "maxx": "ST_MaxX", "miny": "ST_MinY", "maxy": "ST_MaxY"}
    put = f"INSERT OR REPLACE INTO {r} VALUES (NEW.{k}, {', '.join(f'{f}(NEW.{g})' for f in sides.values())});"
    move = f"UPDATE {r} SET {', '.join(f'{c} = {f}(NEW.{g})' for c, f in sides.items())} WHERE id = NEW.{k};"
    drop = lambda ids: f"DELETE FROM {r} WHERE id IN ({ids});"
    same, other = f"OLD.{k} = NEW.{k}", f"OLD.{k} != NEW.{k}"
    rules = {  # event, condition, what is done
        "insert": ("INSERT", has("NEW"), put),
        "update2": (f"UPDATE OF {g}", f"{same} AND {hasnt('NEW')}", drop(f"OLD.{k}")),
        "update4": ("UPDATE", f"{other} AND {hasnt('NEW')}", drop(f"OLD.{k}, NEW.{k}")),
        "update5": ("UPDATE", f"{other} AND {has('NEW')}", drop(f"OLD.{k}") + " " + put),
        "update6": (f"UPDATE OF {g}", f"{same} AND {has('NEW')} AND {has('OLD')}", move),
        "update7": (f"UPDATE OF {g}", f"{same} AND {has('NEW')} AND {hasnt('OLD')}", put),
        "delete": ("DELETE", f"OLD.{g} NOT NULL", drop(f"OLD.{k}")),
    }
    named = lambda suffix: quote(f"rtree_{table}_{geometry}_{suffix}")
    return {s: f"CREATE TRIGGER {named(s)} AFTER {event} ON {t} WHEN {when} BEGIN {then} END" for s, (event, when, then) in rules.items()}


def export(container, path: str, tables: list[str] | None = None) -> None:
    """Write tables of a container (by default all features, attributes and tiles) to a new file; ValueError if it is there.

    The file is written under a passing name and renamed, so that a reader never sees half of it.
    """
    import os

    path = path.removeprefix("file:")
    if os.path.exists(path):
        raise ValueError(f"{path} is there already")
    passing = f"{path}.writing"
    con = sqlite3.connect(passing)
    try:
        con.execute(f"PRAGMA application_id = {APPLICATION}")
        con.execute(f"PRAGMA user_version = {VERSION}")
        con.execute("PRAGMA synchronous = OFF")  # until the end: what a crash leaves behind is thrown away
        kept = [r for r in container.rows("contents") if tables is None or r["table_name"].lower() in {t.lower() for t in tables}]
        named = {r["table_name"] for r in kept}
        for name, columns in DECLARED.items():
            con.execute(f"CREATE TABLE {name} ({columns})")
        for r in container.rows("srs"):
            _put(con, "gpkg_spatial_ref_sys", [{**r, "definition_12_063": r.get("definition_12_063") or "undefined"}])
        for r in kept:
            stamp = r["last_change"].astimezone(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{r['last_change'].microsecond // 1000:03d}Z"
            _put(con, "gpkg_contents", [{**r, "last_change": stamp}])
        _put(con, "gpkg_geometry_columns", [r for r in container.rows("geometry_columns") if r["table_name"] in named])
        indexed = lambda name: container.state["specs"].get(name, {}).get("spatial_index")
        _put(con, "gpkg_extensions", [r for r in container.rows("extensions") if r["table_name"] is None or r["table_name"] in named])
        for name in ("tile_matrix_set", "tile_matrix"):
            if name in container.state["tables"]:
                _put(con, f"gpkg_{name}", [r.asDict() for r in container.table(name).collect() if r.table_name in named])  # a row a pyramid, a row a zoom
        for r in kept:
            name = r["table_name"]
            if r["data_type"] == "tiles":
                _fill(con, name, TILE_TABLE, container.table(name), ["zoom_level", "tile_row", "tile_column"])
                continue
            spec, schema = container.state["specs"][name], container._schema_of(name)
            hidden = {n for n, _ in SIDECAR} | {"geom_type", "dims"} if spec["geometry"] else set()
            fields = [f for f in schema.fields if f.name not in hidden]
            declared = [f"{quote(f.name)} " + _declaration(f, spec) for f in fields]
            _fill(con, name, ", ".join(declared), container.table(name).select(*[f.name for f in fields]), [spec["primary_key"]])
            if spec["geometry"] and indexed(name):
                _index(con, container, name, spec)
        con.commit()
        con.execute("PRAGMA synchronous = FULL")
        con.close()
        os.replace(passing, path)
    except BaseException:
        con.close()
        os.remove(passing)
        raise


def _declaration(f: T.StructField, spec: dict) -> str:
    if f.name == spec["primary_key"]:
        return "INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL"
    declared = f.metadata.get("declared") or f.metadata.get("geometry_type") or types.declared_type(f.dataType)
    return declared + " NOT NULL" * (f.name in spec["not_null"]) + " UNIQUE" * (f.name in spec["unique"])


def _put(con: sqlite3.Connection, table: str, rows: list[dict]) -> None:
    for r in rows:
        con.execute(f"INSERT INTO {quote(table)} ({', '.join(map(quote, r))}) VALUES ({', '.join('?' * len(r))})", list(r.values()))


def _stored(value):
    """A value as the file stores it."""
    if isinstance(value, datetime.datetime):
        value = value.astimezone(datetime.UTC) if value.tzinfo else value
        return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"
    if isinstance(value, datetime.date):
        return value.isoformat()
    return bytes(value) if isinstance(value, bytearray) else int(value) if isinstance(value, bool) else value


def _fill(con: sqlite3.Connection, table: str, columns: str, rows, order: list[str]) -> None:
    """Create a table and put rows there in their order."""
    con.execute(f"CREATE TABLE {quote(table)} ({columns})")
    names = ", ".join(map(quote, rows.columns))
    whole = [r[1] for r in con.execute(f"PRAGMA table_info({quote(table)})")] == rows.columns  # then SQLite may copy records as they are
    put = f"INSERT INTO main.{quote(table)} " + ("SELECT *" if whole else f"({names}) SELECT {names}") + f" FROM part.{quote(table)}" + (" ORDER BY rowid" if not whole else "")
    _merge(con, rows.repartitionByRange(*order).sortWithinPartitions(*order), _table_part(table, columns, rows.columns), [put])


def _table_part(table: str, columns: str, names: list[str]):
    """A function that puts batches of rows into a file with this table."""

    def write(con: sqlite3.Connection, batches: Iterator[pa.RecordBatch]) -> None:
        con.execute(f"CREATE TABLE {quote(table)} ({columns})")
        put = f"INSERT INTO {quote(table)} ({', '.join(map(quote, names))}) VALUES ({', '.join('?' * len(names))})"
        for batch in batches:
            con.executemany(put, zip(*(map(_stored, c.to_pylist()) for c in batch.columns), strict=True))

    return write


def _merge(con: sqlite3.Connection, rows, write, statements: list[str]) -> None:
    """Rows into con: each task writes those of its partition to a file of its own, as write(file, batches) says, and the statements copy
    what is in it, attached as `part`, in the order of the partitions.

    The files go through the shared folder as rows of Parquet, so nothing of them passes through Spark's driver, and a task that is
    run twice counts once; a file at a time is on the driver's disk.
    """
    import os
    import tempfile

    import pyarrow.parquet as pq

    from terrane.operators.shared import scratch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with tempfile.TemporaryDirectory() as own:
            made = sqlite3.connect(f"{own}/part")
            made.execute("PRAGMA synchronous = OFF")
            made.execute("PRAGMA journal_mode = OFF")
            write(made, itertools.chain([first], batches))
            made.commit()
            made.close()
            with open(f"{own}/part", "rb") as f:
                while piece := f.read(PIECE):
                    yield pa.RecordBatch.from_arrays([pa.array([piece], pa.binary())], ["piece"])

    spark, folder = rows.sparkSession, scratch(rows.sparkSession, "export")
    rows.mapInArrow(run, "piece binary").write.option("maxRecordsPerFile", 0).option("parquet.enable.dictionary", "false").option("parquet.block.size", 16 << 20).parquet(folder)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    source = hadoop(folder)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        for name in sorted(n for n in (s.getPath().getName() for s in files.listStatus(source)) if n.startswith("part-")):
            with tempfile.TemporaryDirectory() as own:
                files.copyToLocalFile(False, hadoop(f"{folder}/{name}"), hadoop(f"file://{own}/pieces"), True)
                with open(f"{own}/part", "wb") as out, pq.ParquetFile(f"{own}/pieces") as pieces:
                    for batch in pieces.iter_batches(batch_size=16):
                        out.writelines(p.as_py() for p in batch.column(0))
                os.remove(f"{own}/pieces")
                if not os.path.getsize(f"{own}/part"):
                    continue
                con.commit()  # nothing is attached inside a transaction
                con.execute("ATTACH ? AS part", (f"{own}/part",))
                for statement in statements:
                    con.execute(statement)
                con.commit()
                con.execute("DETACH part")
    finally:
        files.delete(source, True)


def _index(con: sqlite3.Connection, container, name: str, spec: dict) -> None:
    """The R-tree of a layer, from its sidecar columns, and the triggers that keep it.

    Its nodes are packed in Hilbert order: the leaves and the keys' places by the tasks, the levels above, a node for each
    full one below, from the file itself.  The root is node 1 and the leaves follow.
    """
    from pyspark.sql import functions as F

    from terrane.operators import index
    from terrane.operators.shared import settled

    key, shadow = spec["primary_key"], lambda s: quote(f"rtree_{name}_{spec['geometry']}{s}")
    con.execute(f"CREATE VIRTUAL TABLE {shadow('')} USING rtree(id, minx, maxx, miny, maxy)")
    ((size,),) = con.execute(f"SELECT length(data) FROM {shadow('_node')} WHERE nodeno = 1")
    fanout = (size - ordering.NODE_HEADER) // ordering.CELL
    entries = settled(index.packed(index.build(container.table(name), key), fanout).select("id", *(c for c, _ in SIDECAR[:4]), "hilbert", F.col("leaf").cast("long").alias("leaf")))
    several = entries.where("leaf > 0").limit(1).count() > 0
    places = entries.select(F.col("id").alias("rowid"), (F.col("leaf") + (2 if several else 1)).alias("nodeno"))
    columns = "rowid INTEGER PRIMARY KEY, nodeno"
    _merge(con, places.repartitionByRange("rowid").sortWithinPartitions("rowid"), _table_part("places", columns, places.columns), [f"INSERT INTO main.{shadow('_rowid')} SELECT * FROM part.places"])
    leaves = entries.repartitionByRange("leaf").sortWithinPartitions("leaf", "hilbert", "id").drop("hilbert")
    if several or entries.limit(1).count():
        con.execute(f"DELETE FROM {shadow('_node')}")
        _merge(con, leaves, _leaf_part(size, 2 if several else 1), [f"INSERT INTO main.{shadow('_node')} SELECT * FROM part.leaves"])
    if several:
        _levels(con, shadow, size)
    for statement in index_triggers(name, spec["geometry"], key).values():
        con.execute(statement)


CELLS = np.dtype([("id", ">i8"), ("minx", ">f4"), ("maxx", ">f4"), ("miny", ">f4"), ("maxy", ">f4")])


def _nodes(cells: np.ndarray, counts: np.ndarray, size: int, depth: int = 0) -> list[bytes]:
    """Nodes of so many cells each, as the R-tree stores them: depth (which the root alone tells), number of cells, cells."""
    fanout = (size - ordering.NODE_HEADER) // ordering.CELL
    body = np.zeros((len(counts), fanout), dtype=CELLS)
    body[np.arange(fanout) < counts[:, None]] = cells
    heads = np.column_stack((np.full(len(counts), depth), counts)).astype(">u2")
    rest = bytes(size - ordering.NODE_HEADER - ordering.CELL * fanout)
    return [h.tobytes() + b.tobytes() + rest for h, b in zip(heads, body, strict=True)]


def _leaf_part(size: int, first: int):
    """A function that puts the leaves of rows in their order into a file; leaf 0 is node `first`."""

    def write(con: sqlite3.Connection, batches: Iterator[pa.RecordBatch]) -> None:
        con.execute("CREATE TABLE leaves (nodeno INTEGER PRIMARY KEY, data)")
        left, numbers = np.zeros(0, dtype=CELLS), np.zeros(0, dtype=np.int64)

        def put(cells: np.ndarray, numbers: np.ndarray) -> None:
            found, counts = np.unique(numbers, return_counts=True)
            con.executemany("INSERT INTO leaves VALUES (?, ?)", zip((found + first).tolist(), _nodes(cells, counts, size), strict=True))

        for batch in batches:
            new = np.zeros(batch.num_rows, dtype=CELLS)
            for c in CELLS.names:
                new[c] = batch.column(c).to_numpy(zero_copy_only=False)
            left, numbers = np.concatenate((left, new)), np.concatenate((numbers, batch.column("leaf").to_numpy(zero_copy_only=False)))
            whole = int(np.searchsorted(numbers, numbers[-1]))  # the last leaf may go on in the next batch
            put(left[:whole], numbers[:whole])
            left, numbers = left[whole:], numbers[whole:]
        put(left, numbers)

    return write


def _levels(con: sqlite3.Connection, shadow, size: int) -> None:
    """The levels above the leaves, nodes 2 and on: a few hundred nodes of a level at a time are in memory."""
    fanout = (size - ordering.NODE_HEADER) // ordering.CELL
    low, (high,), depth = 2, con.execute(f"SELECT max(nodeno) FROM {shadow('_node')}").fetchone(), 0
    while low <= high:
        depth += 1
        root, above, at = high - low < fanout, high + 1, low
        while at <= high:
            rows = con.execute(f"SELECT data FROM {shadow('_node')} WHERE nodeno BETWEEN ? AND ? ORDER BY nodeno", (at, min(high, at + 16 * fanout - 1))).fetchall()
            below = np.frombuffer(b"".join(r[0] for r in rows), dtype=np.uint8).reshape(-1, size)
            held = np.ascontiguousarray(below[:, 2:4]).view(">u2").astype(np.int64)
            inner = np.ascontiguousarray(below[:, ordering.NODE_HEADER : ordering.NODE_HEADER + ordering.CELL * fanout]).view(CELLS)
            used, cells = np.arange(fanout) < held, np.zeros(len(below), dtype=CELLS)
            cells["id"] = np.arange(at, at + len(below))
            for c in CELLS.names[1:]:
                cells[c] = np.where(used, inner[c], np.inf).min(axis=1) if c.startswith("min") else np.where(used, inner[c], -np.inf).max(axis=1)
            counts = np.full(-(-len(cells) // fanout), fanout)
            counts[-1] = len(cells) - fanout * (len(counts) - 1)
            numbers = [1] if root else range(above, above + len(counts))
            con.executemany(f"INSERT INTO {shadow('_node')} VALUES (?, ?)", zip(numbers, _nodes(cells, counts, size, depth if root else 0), strict=True))
            parents = np.repeat(np.array(numbers), counts).tolist()
            con.executemany(f"INSERT INTO {shadow('_parent')} VALUES (?, ?)", zip(cells["id"].tolist(), parents, strict=True))
            above += len(counts)
            at += len(cells)
        if root:
            return
        low, high = high + 1, above - 1


def index_state(path: str, table: str) -> str:
    """absent, current, legacy or stale: what a file's R-tree and its triggers say."""
    d = Described(path, table)
    con = connect(path)
    try:
        prefix = f"rtree_{d.name}_{d.geometry}_"
        suffixes = {r[0][len(prefix) :] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'trigger'") if r[0].startswith(prefix)}
    finally:
        con.close()
    old, new = bool(suffixes & {"update1", "update3"}), bool(suffixes & {"update5", "update6", "update7"})
    if not d.index:
        return "stale" if old or new else "absent"
    return "legacy" if old else "current" if new else "stale"
