"""STEP physical files: instances, the elements among them, their relations, property sets and quantities.

A file is read in parts that end with a semicolon at the end of a line, so large files are split among tasks; a text never holds a line's end. Parts with several
instances are split at the semicolons outside of texts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as tx
from ..functions import values
from ..operators.graph import EQUIPMENT, TERMINALS

# Entities that are elements or containers.
ENTITIES = (
    "IfcProject", "IfcSite", "IfcBuilding", "IfcBuildingStorey", "IfcSpace", "IfcWall", "IfcWallStandardCase", "IfcSlab", "IfcRoof", "IfcBeam", "IfcColumn", "IfcDoor", "IfcWindow",
    "IfcStair", "IfcStairFlight", "IfcRailing", "IfcRamp", "IfcCovering", "IfcMember", "IfcPlate", "IfcFooting", "IfcPile", "IfcCurtainWall", "IfcFurniture", "IfcFurnishingElement",
    "IfcBuildingElementProxy", "IfcFlowTerminal", "IfcPipeSegment", "IfcDuctSegment", "IfcOpeningElement", "IfcZone", "IfcChimney", "IfcSanitaryTerminal",
    "IfcSpatialZone", "IfcEarthworksFill", "IfcEarthworksCut", "IfcDiscreteAccessory", "IfcMechanicalFastener", "IfcElementAssembly", "IfcReinforcingBar", "IfcTransportElement", "IfcShadingDevice", "IfcBuildingElementPart",
)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, one behind the other, and where each begins; a null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def _split(texts: pa.Array, mark: int, nested: bool) -> pa.Array:
    """The parts of texts between marks that stand outside of quotes and, if nested, of parentheses, trimmed; a batch at a time.

    A mark stands outside where the running counts of quotes and open parentheses are as at the text's beginning.
    """
    data, at = _flat(texts)
    begin = at[:-1]
    of = np.repeat(np.arange(len(begin)), np.diff(at))
    since = lambda counts: counts - np.concatenate([np.zeros(1, np.int64), counts])[begin][of]
    plain = since(np.cumsum(data == ord("'"), dtype=np.int64)) % 2 == 0
    found = (data == mark) & plain
    if nested:
        found &= since(np.cumsum(((data == ord("(")) & plain).astype(np.int64) - ((data == ord(")")) & plain))) == 0
    cut = np.flatnonzero(found)
    # a text with k marks has k + 1 parts
    sizes = np.bincount(of[cut], minlength=len(begin)) + 1
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    ends = np.empty(first[-1], np.int64)
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    ends[last], ends[~last] = at[1:], cut
    ends -= np.concatenate([np.zeros(1, np.int64), np.cumsum(found)])[ends]  # as the marks are taken out
    buffers = [pa.py_buffer(x.tobytes()) for x in (np.concatenate([np.zeros(1, np.int64), ends]), data[~found])]
    parts = pa.LargeStringArray.from_buffers(len(ends), *buffers)
    return pa.LargeListArray.from_arrays(pa.array(first), pc.utf8_trim_whitespace(parts)).cast(pa.list_(pa.string()))


@F.arrow_udf(ArrayType(StringType()))
def split_arguments(texts: pa.Array) -> pa.Array:
    """Top-level arguments of instances."""
    return _split(texts, ord(","), True)


@F.arrow_udf(ArrayType(StringType()))
def split_instances(texts: pa.Array) -> pa.Array:
    """Instances in parts of a file."""
    return _split(texts, ord(";"), False)


_PATTERN = r"^#(\d+)\s*=\s*([A-Z0-9_]+)\s*\((.*)\)$"


def parsed(parts: DataFrame) -> DataFrame:
    """(dataset, if parts have one, id, entity, args, line) of parts (line, value) that end between instances."""
    key = _key(parts)
    rows = parts.select(*key, "line", F.regexp_replace("value", r"\s*[\r\n]\s*", " ").alias("v"))
    rows = rows.select(*key, "line", F.posexplode(split_instances("v")).alias("n", "v"))
    found = rows.where(F.col("v").rlike(_PATTERN))
    return found.select(*key, F.regexp_extract("v", _PATTERN, 1).cast("long").alias("id"), F.regexp_extract("v", _PATTERN, 2).alias("entity"), split_arguments(F.regexp_extract("v", _PATTERN, 3)).alias("args"), F.struct("line", "n").alias("line"))


def _parts(spark: SparkSession, path: str) -> DataFrame:
    first = spark.read.option("lineSep", "\n").text(path).limit(1).first()
    end = ";\r\n" if first and first[0].endswith("\r") else ";\n"
    return spark.read.option("lineSep", end).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("dataset"), F.monotonically_increasing_id().alias("line"), "value")


def instances(spark: SparkSession, path: str) -> DataFrame:
    """(id, entity, args, line) of all instances of one file; line grows along it."""
    return parsed(_parts(spark, path).drop("dataset"))


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """(dataset, id, entity, args, line) of all instances of files; dataset is a file's stem."""
    parts = [_parts(spark, p) for p in paths]
    return parsed(reduce(DataFrame.unionByName, parts))


def _key(rows: DataFrame) -> list[str]:
    return [c for c in ("dataset",) if c in rows.columns]


def arg(k: int) -> Column:
    """The k-th argument, null beyond the last."""
    return F.get("args", F.lit(k - 1))


def ref(k: int) -> Column:
    """The instance that an argument points to, null if it points to none."""
    return F.regexp_extract(arg(k), r"^#(\d+)$", 1).try_cast("long")


def refs(k: int) -> Column:
    """The instances that an argument points to, in order."""
    return F.regexp_extract_all(arg(k), F.lit(r"#(\d+)"), F.lit(1)).cast("array<long>")


def _text(k: int) -> Column:
    """A text argument without its quotes; null for anything else."""
    c = arg(k)
    return F.when(c.startswith("'"), F.regexp_replace(F.regexp_replace(c, "^'|'$", ""), "''", "'"))


def class_of(entity: Column) -> Column:
    """The class of an entity in capitals: as listed, else with Ifc before the rest in title case."""
    names = {e.upper(): e for e in (*ENTITIES, *EQUIPMENT, *TERMINALS)}
    listed = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[entity]
    return F.coalesce(listed, F.concat(F.lit("Ifc"), F.initcap(F.substring(entity, 4, 100))))


def type_class_of(entity: Column) -> Column:
    """The class of a type object: that of its occurrences, and Type."""
    return F.concat(class_of(F.regexp_replace(entity, "TYPE$", "")), F.lit("Type"))


def elements(all_: DataFrame) -> DataFrame:
    """(express_id, global_id, ifc_class, name, description, object_type, tag), each express id once, by its first instance.

    Elements are the listed entities, and any other with an identifier, a placement and a shape; relations, types and property sets are none.
    """
    key, names = _key(all_), [e.upper() for e in ENTITIES]
    other = F.col("entity").rlike("^IFC") & ~F.col("entity").rlike("^IFC(REL|PROPERTY|QUANTITY|ELEMENTQUANTITY)|TYPE$|STYLE$") & arg(1).rlike("^'[0-9A-Za-z_$]{22}'$") & arg(6).rlike(r"^(#\d+|\$)$")
    rows = all_.where((F.size("args") >= 8) & (F.col("entity").isin(*names) | F.coalesce(F.when(F.size("args") >= 8, other), F.lit(False))))
    rows = rows.groupBy(*key, "id").agg(F.min_by(F.struct("entity", "args"), "line").alias("r")).select(*key, "id", "r.*")
    return rows.select(*key, F.col("id").alias("express_id"), _text(1).alias("global_id"), class_of(F.col("entity")).alias("ifc_class"), *[tx.blank_to_null(_text(k)).alias(n) for k, n in ((3, "name"), (4, "description"), (5, "object_type"), (8, "tag"))])


def _value(c: Column) -> Column:
    """A value as stored JSON: texts, numbers, booleans; null for anything else."""
    inner = F.regexp_extract(c, r"^[A-Z0-9_]+\((.*)\)$", 1)
    raw = F.when(inner != "", inner).otherwise(c)
    text = F.regexp_replace(F.regexp_replace(raw, "^'|'$", ""), "''", "'")
    number = F.regexp_replace(raw, r"\.(?=$|[eE])", "")
    return (
        F.when(raw.startswith("'"), values.encoded(text)).when(raw.isin(".T.", ".F."), F.when(raw == ".T.", "json:true").otherwise("json:false"))
        .when(number.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.concat(F.lit("json:"), number))
    )


def _sets(all_: DataFrame, set_entity: str, members: int) -> DataFrame:
    """(element_id, set_name, member) of sets that relations assign to elements."""
    key = _key(all_)
    given = all_.where("entity = 'IFCRELDEFINESBYPROPERTIES'").select(*key, F.explode(refs(5)).alias("element_id"), F.explode(refs(6)).alias("set"))
    sets = all_.where(F.col("entity") == set_entity).select(*key, F.col("id").alias("set"), _text(3).alias("set_name"), F.explode(refs(members)).alias("member"))
    return given.join(sets, [*key, "set"]).select(*key, "element_id", "set_name", "member")


def properties(all_: DataFrame) -> DataFrame:
    """(element_id, pset_name, property_name, value, is_official) of single values in property sets."""
    key = _key(all_)
    single = all_.where("entity = 'IFCPROPERTYSINGLEVALUE'").select(*key, F.col("id").alias("member"), _text(1).alias("property_name"), _value(arg(3)).alias("value"))
    rows = _sets(all_, "IFCPROPERTYSET", 5).join(single.where("property_name IS NOT NULL"), [*key, "member"])
    return rows.select(*key, "element_id", F.col("set_name").alias("pset_name"), "property_name", "value", F.col("set_name").startswith("Pset_").cast("int").alias("is_official"))


def quantities(all_: DataFrame) -> DataFrame:
    """(element_id, qto_name, quantity_name, value, is_official) of simple quantities in element quantities."""
    key = _key(all_)
    simple = all_.where(F.col("entity").rlike("^IFCQUANTITY(LENGTH|AREA|VOLUME|COUNT|WEIGHT|TIME)$")).select(*key, F.col("id").alias("member"), _text(1).alias("quantity_name"), F.regexp_replace(arg(4), r"\.$", "").try_cast("double").alias("value"))
    rows = _sets(all_, "IFCELEMENTQUANTITY", 6).join(simple.where("quantity_name IS NOT NULL"), [*key, "member"])
    return rows.select(*key, "element_id", F.col("set_name").alias("qto_name"), "quantity_name", "value", F.col("set_name").startswith("Qto_").cast("int").alias("is_official"))


def contained(all_: DataFrame) -> DataFrame:
    """(id, parent) by express id, from containment and aggregation relations."""
    inside = all_.where("entity = 'IFCRELCONTAINEDINSPATIALSTRUCTURE'").select(*_key(all_), F.explode(refs(5)).alias("id"), ref(6).alias("parent"))
    parts = all_.where("entity = 'IFCRELAGGREGATES'").select(*_key(all_), F.explode(refs(6)).alias("id"), ref(5).alias("parent"))
    return inside.unionByName(parts).distinct()


# Relation entities with the positions of their two sides, and the relation from the first to the second.
RELATIONS = {
    "IFCRELDEFINESBYTYPE": (5, 6, "typed_by"),
    "IFCRELASSOCIATESCLASSIFICATION": (5, 6, "classified_as"),
    "IFCRELCONNECTSELEMENTS": (6, 7, "ifc_connected_to"),
    "IFCRELCONNECTSPATHELEMENTS": (6, 7, "path_connected_to"),
    "IFCRELSPACEBOUNDARY": (5, 6, "space_bounded_by"),
    "IFCRELVOIDSELEMENT": (5, 6, "voids"),
    "IFCRELFILLSELEMENT": (5, 6, "fills"),
    "IFCRELASSIGNSTOGROUP": (5, 7, "belongs_to_system"),
}


def relations(all_: DataFrame, openings: bool = False) -> DataFrame:
    """(src, dst, relation) by express id. An element that fills an opening is hosted by what the opening voids, or, with openings, by the opening, and that by what it voids; groups are zones or systems by
    their entity."""
    key, parts = _key(all_), []
    for entity, (a, b, name) in RELATIONS.items():
        rows = all_.where(F.col("entity").isin(entity, entity + "1STLEVEL", entity + "2NDLEVEL")).where(F.size("args") >= max(a, b))
        parts.append(rows.select(*key, F.explode(refs(a)).alias("src"), refs(b).alias("to")).select(*key, "src", F.explode("to").alias("dst"), F.lit(name).alias("relation")))
    found = reduce(DataFrame.unionByName, parts)
    voids, fills = found.where("relation = 'voids'"), found.where("relation = 'fills'")
    if openings:
        held = voids.select(*key, F.col("src").alias("host"), F.col("dst").alias("guest")).unionByName(fills.select(*key, F.col("src").alias("host"), F.col("dst").alias("guest")))
    else:
        held = voids.select(*key, F.col("src").alias("host"), F.col("dst").alias("opening")).join(fills.select(*key, F.col("src").alias("opening"), F.col("dst").alias("guest")), [*key, "opening"])
    groups = all_.where("entity = 'IFCZONE'").select(*key, F.col("id").alias("dst"), F.lit(True).alias("zone"))
    plain_ = found.where("relation NOT IN ('voids', 'fills')").join(groups, [*key, "dst"], "left")
    plain_ = plain_.select(*key, "src", "dst", F.when((F.col("relation") == "belongs_to_system") & F.col("zone"), "in_zone").otherwise(F.col("relation")).alias("relation"))
    turned = lambda rows, name: rows.select(*key, F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(name).alias("relation"))
    bounded = turned(plain_.where("relation = 'space_bounded_by'"), "bounds_space")
    hosts = held.select(*key, F.col("host").alias("src"), F.col("guest").alias("dst"), F.lit("hosts").alias("relation"))
    return reduce(DataFrame.unionByName, (plain_, bounded, hosts, turned(hosts, "hosted_by"))).where("src <> dst").distinct()
