"""Identifiers, versions, extension names, relation names, metadata scopes and reference systems."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions.types import GEOMETRY_TYPES

# Application ids, extension names by what can be done with them, relation names, metadata and reference scopes.
APP_10, APP_11, APP_NOW = 1196437808, 1196437809, 1196444487
IMPLEMENTED = ["gpkg_rtree_index", "gpkg_zoom_other", "gpkg_webp", "gpkg_crs_wkt", "gpkg_crs_wkt_1_1", "gpkg_metadata", "gpkg_schema", "related_tables", "gpkg_related_tables"]
KNOWN = ["gpkg_2d_gridded_coverage", "2d_gridded_coverage", "gpkg_elevation_tiles", "gdal_aspatial"]
REMOVED = ["gpkg_geometry_type_trigger", "gpkg_srs_id_trigger"]
RELATIONS = ["media", "simple_attributes", "features", "attributes", "tiles"]
METADATA_SCOPES = ["undefined", "fieldSession", "collectionSession", "series", "dataset", "featureType", "feature", "attributeType", "attribute", "tile", "model", "catalog", "schema", "taxonomy", "software", "service", "collectionHardware", "nonGeographicDataset", "dimensionGroup", "style"]
REFERENCE_TARGETS = {"table": ("table_name",), "column": ("table_name", "column_name"), "row": ("table_name", "row_id_value"), "row/col": ("table_name", "column_name", "row_id_value")}
WHOLE_FILE = "file"  # our containers' scope of a whole file; it has no targets.  Callers name that of other files.
CURVED = GEOMETRY_TYPES[8:]


def quote(name: str) -> str:
    """A SQL identifier in backticks; ValueError for an empty name or one with NUL."""
    if not name or "\0" in name:
        raise ValueError(f"not an identifier: {name!r}")
    return "`" + name.replace("`", "``") + "`"


def version(application_id: Column, user_version: Column) -> Column:
    """1.0 to 1.4 from a file's two pragmas; null for any other pair."""
    hundreds = F.floor(user_version / 100)
    newer = F.when(hundreds == 102, "1.2").when(hundreds == 103, "1.3").when(hundreds >= 104, "1.4")
    return F.when(application_id == APP_10, "1.0").when(application_id == APP_11, "1.1").when(application_id == APP_NOW, newer)


def extension_support(name: Column) -> Column:
    """implemented, known, removed or unrecognised.  Case counts, except in the geometry type of a gpkg_geom_ name."""
    kind = F.when(name.startswith("gpkg_geom_"), F.upper(F.substring(name, 11, 1000)))
    return F.when(kind.isin(*CURVED) | name.isin(*IMPLEMENTED), "implemented").when(name.isin(*KNOWN), "known").when(name.isin(*REMOVED), "removed").otherwise("unrecognised")


def support_of(name: str) -> str:
    """extension_support() of one name."""
    if name in IMPLEMENTED or (name.startswith("gpkg_geom_") and name[10:].upper() in CURVED):
        return "implemented"
    return "known" if name in KNOWN else "removed" if name in REMOVED else "unrecognised"


def relation_conforms(name: Column) -> Column:
    """One of five names, or x-<author>_<name> with both parts; the author ends at the first underscore."""
    return name.isin(*RELATIONS) | name.rlike(r"(?s)^x-[^_]+_.+$")


def metadata_scope_listed(scope: Column) -> Column:
    return scope.isin(*METADATA_SCOPES)


def reference_targets(scope: Column, whole: str = WHOLE_FILE) -> Column:
    """Array of the target columns that a reference of this scope fills, none for that of a whole file; null for an unknown scope."""
    out = F.when(scope == whole, F.array().cast("array<string>"))
    for name, targets in REFERENCE_TARGETS.items():
        out = out.when(scope == name, F.array(*[F.lit(t) for t in targets]))
    return out


def srs_name(wkt2: Column, code: Column) -> Column:
    """The first quoted string of a WKT2 text, else EPSG:code."""
    found = F.regexp_extract(wkt2, r'(?s)^[^"]*"([^"]*)"', 1)
    return F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(F.concat(F.lit("EPSG:"), code.cast("string")))


@dataclass(frozen=True)
class Geographic:
    """A geographic reference system: its datum and ellipsoid with their codes, and the UTM codes built on it, as the code of zone 0 and the zones."""

    name: str
    datum: tuple[str, str, int]  # as in the older text, as in the newer, its code
    ellipsoid: tuple[str, str, int]
    utm: dict[str, tuple[int, range]]


# EPSG codes and parameters.
GEOGRAPHIC = {
    4326: Geographic("WGS 84", ("WGS_1984", "World Geodetic System 1984", 6326), ("WGS 84", "298.257223563", 7030), {"N": (32600, range(1, 61)), "S": (32700, range(1, 61))}),
    4258: Geographic("ETRS89", ("European_Terrestrial_Reference_System_1989", "European Terrestrial Reference System 1989", 6258), ("GRS 1980", "298.257222101", 7019), {"N": (25800, range(28, 39))}),
    4269: Geographic("NAD83", ("North_American_Datum_1983", "North American Datum 1983", 6269), ("GRS 1980", "298.257222101", 7019), {"N": (26900, range(1, 24))}),
}
DEGREE = "0.0174532925199433"


def _older(code: int) -> str:
    g = GEOGRAPHIC[code]
    mark = lambda c: f'AUTHORITY["EPSG","{c}"]'
    datum = f'DATUM["{g.datum[0]}",SPHEROID["{g.ellipsoid[0]}",6378137,{g.ellipsoid[1]},{mark(g.ellipsoid[2])}],{mark(g.datum[2])}]'
    return f'GEOGCS["{g.name}",{datum},PRIMEM["Greenwich",0,{mark(8901)}],UNIT["degree",{DEGREE},{mark(9122)}],{mark(code)}]'


def _newer(code: int, keyword: str = "GEOGCRS") -> str:
    g = GEOGRAPHIC[code]
    datum = f'DATUM["{g.datum[1]}",ELLIPSOID["{g.ellipsoid[0]}",6378137,{g.ellipsoid[1]},LENGTHUNIT["metre",1]]]'
    axes = "" if keyword != "GEOGCRS" else f'CS[ellipsoidal,2],AXIS["geodetic latitude (Lat)",north,ORDER[1],ANGLEUNIT["degree",{DEGREE}]],AXIS["geodetic longitude (Lon)",east,ORDER[2],ANGLEUNIT["degree",{DEGREE}]],'
    return f'{keyword}["{g.name}",{datum},PRIMEM["Greenwich",0,ANGLEUNIT["degree",{DEGREE}]],{axes}ID["EPSG",{code}]]'


WGS84_WKT1, WGS84_WKT2 = _older(4326), _newer(4326)


def _utm_older(base: int, name, code, meridian, northing) -> list:
    """The pieces of the older text of a UTM zone."""
    return ['PROJCS["', name, f'",{_older(base)},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",', meridian, '],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",', northing, '],UNIT["metre",1,AUTHORITY["EPSG","9001"]],AXIS["Easting",EAST],AXIS["Northing",NORTH],AUTHORITY["EPSG","', code, '"]]']


def _projected_newer(base: int, name: str, code: int, method: tuple[str, int], parameters: list[tuple[str, str, str, int]]) -> str:
    unit = {"degree": f'ANGLEUNIT["degree",{DEGREE}]', "unity": 'SCALEUNIT["unity",1]', "metre": 'LENGTHUNIT["metre",1]'}
    listed = "".join(f',PARAMETER["{n}",{v},{unit[u]},ID["EPSG",{c}]]' for n, v, u, c in parameters)
    conversion = f'CONVERSION["{name.split(" / ")[-1]}",METHOD["{method[0]}",ID["EPSG",{method[1]}]]{listed}]'
    axes = f'CS[Cartesian,2],AXIS["(E)",east,ORDER[1],{unit["metre"]}],AXIS["(N)",north,ORDER[2],{unit["metre"]}]'
    return f'PROJCRS["{name}",{_newer(base, "BASEGEOGCRS")},{conversion},{axes},ID["EPSG",{code}]]'


class Definition(NamedTuple):
    name: str
    wkt1: str
    wkt2: str


def epsg_definition(code: int) -> Definition | None:
    """Name and texts of a reference system: the geographic ones above, their UTM zones and web mercator; None for another code."""
    if code in GEOGRAPHIC:
        return Definition(GEOGRAPHIC[code].name, _older(code), _newer(code))
    if code == 3857:
        name = "WGS 84 / Pseudo-Mercator"
        extension = 'EXTENSION["PROJ4","+proj=merc +a=6378137 +b=6378137 +lat_ts=0 +lon_0=0 +x_0=0 +y_0=0 +k=1 +units=m +nadgrids=@null +wktext +no_defs"]'
        older = f'PROJCS["{name}",{_older(4326)},PROJECTION["Mercator_1SP"],PARAMETER["central_meridian",0],PARAMETER["scale_factor",1],PARAMETER["false_easting",0],PARAMETER["false_northing",0],UNIT["metre",1,AUTHORITY["EPSG","9001"]],AXIS["Easting",EAST],AXIS["Northing",NORTH],{extension},AUTHORITY["EPSG","3857"]]'
        parameters = [("Latitude of natural origin", "0", "degree", 8801), ("Longitude of natural origin", "0", "degree", 8802), ("False easting", "0", "metre", 8806), ("False northing", "0", "metre", 8807)]
        return Definition(name, older, _projected_newer(4326, name, code, ("Popular Visualisation Pseudo Mercator", 1024), parameters))
    for base, g in GEOGRAPHIC.items():
        for side, (first, zones) in g.utm.items():
            if code - first in zones:
                zone = code - first
                name, meridian, northing = f"{g.name} / UTM zone {zone}{side}", 6 * zone - 183, 10_000_000 * (side == "S")
                parameters = [
                    ("Latitude of natural origin", "0", "degree", 8801),
                    ("Longitude of natural origin", str(meridian), "degree", 8802),
                    ("Scale factor at natural origin", "0.9996", "unity", 8805),
                    ("False easting", "500000", "metre", 8806),
                    ("False northing", str(northing), "metre", 8807),
                ]
                older = "".join(map(str, _utm_older(base, name, code, meridian, northing)))
                return Definition(name, older, _projected_newer(base, name, code, ("Transverse Mercator", 9807), parameters))
    return None


def utm_zone(code: Column) -> Column:
    """name, zone, north, central_meridian and false_northing of an EPSG code of a WGS 84 UTM zone; null for another."""
    north, south = code.between(32601, 32660), code.between(32701, 32760)
    zone = code % 100
    name = F.concat(F.lit("WGS 84 / UTM zone "), zone.cast("string"), F.when(north, "N").otherwise("S"))
    fields = F.struct(name.alias("name"), zone.cast("int").alias("zone"), north.alias("north"), (zone * 6 - 183).cast("int").alias("central_meridian"), F.when(north, 0).otherwise(10_000_000).alias("false_northing"))
    return F.when(north | south, fields)


def utm_definition(code: Column) -> Column:
    """WKT1 of a WGS 84 UTM zone; null for another code."""
    zone = utm_zone(code)
    parts = _utm_older(4326, zone["name"], code, zone["central_meridian"], zone["false_northing"])
    return F.when(zone.isNotNull(), F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def crs_code(metadata: Column) -> Column:
    """The code of the top-level id in a field's CRS metadata: PROJJSON, or EPSG:n as text; null if there is none."""
    document = F.get_json_object(metadata, "$.crs.id.code").try_cast("int")
    short = F.regexp_extract(F.get_json_object(metadata, "$.crs"), r"^EPSG:([0-9]+)$", 1).try_cast("int")
    return F.coalesce(document, short)


def projjson(code: int) -> dict | None:
    """The head of a reference system's PROJJSON document: kind, name and id; None for a code that isn't known here."""
    known = epsg_definition(code)
    if known is None:
        return None
    kind = "GeographicCRS" if code in GEOGRAPHIC else "ProjectedCRS"
    return {"$schema": "https://proj.org/schemas/v0.7/projjson.schema.json", "type": kind, "name": known.name, "id": {"authority": "EPSG", "code": code}}


def crs_metadata(srs_id: int) -> str:
    """Field metadata that names a reference system: its document where it is known, else its code; {} for an undefined one."""
    if srs_id <= 0:
        return "{}"
    document = projjson(srs_id)
    return json.dumps({"crs": document} if document else {"crs": f"EPSG:{srs_id}", "crs_type": "authority_code"})


def index_status(has_table: Column, generation: Column) -> Column:
    """absent, current, legacy or stale, from whether the index table is there and what its triggers are (none, v1_4, pre_v1_4, mixed)."""
    return F.when(~has_table & (generation == "none"), "absent").when(has_table & (generation == "v1_4"), "current").when(has_table & generation.isin("pre_v1_4", "mixed"), "legacy").otherwise("stale")


def trigger_generation(suffixes: Column) -> Column:
    """none, v1_4, pre_v1_4 or mixed, from the trigger name suffixes of an index."""
    old, new = F.arrays_overlap(suffixes, F.array(F.lit("update1"), F.lit("update3"))), F.arrays_overlap(suffixes, F.array(F.lit("update5"), F.lit("update6"), F.lit("update7")))
    return F.when(old & new, "mixed").when(old, "pre_v1_4").when(new, "v1_4").otherwise("none")
