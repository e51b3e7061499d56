"""Count, list, aggregate and group requests over elements and their attributes, compiled to one lazy plan each.

``Tables`` holds elements (express_id, global_id, ifc_class, predefined_type, name, description, object_type, tag, level, level_key, type_name) and two
long tables: properties (element_id, pset_name, property_name, value, is_official, id) and quantities (element_id, qto_name,
quantity_name, value, is_official, id). A ``dataset`` column in all three, if there, is part of each key: several models are one plan.
Property values are texts, ``json:`` and compact JSON for typed ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import classes
from .request import Field, Filter, Request
from .staging import kept

LISTED = ("express_id", "global_id", "ifc_class", "predefined_type", "name", "level")
# Columns that requests may filter and group by.
FILTERABLE = ("express_id", "global_id", "ifc_class", "level", "level_key", "predefined_type", "type_name", "name")
GROUPABLE = ("ifc_class", "level", "predefined_type", "type_name", "name")
#: Order of listed elements: nulls first, then a total order.
ELEMENT_ORDER = ("name", "ifc_class", "global_id", "express_id")


@dataclass(frozen=True)
class Tables:
    elements: DataFrame
    properties: DataFrame
    quantities: DataFrame
    #: Intervals of a class hierarchy (classes.intervals); without it a class has the subtypes that are listed.
    classes: DataFrame | None = None

    @property
    def key(self) -> list[str]:
        return [c for c in ("dataset",) if c in self.elements.columns]


def decoded(value: Column) -> tuple[Column, Column]:
    """(text, number) of a stored value: JSON numbers and booleans (1, 0) are numbers, JSON texts and lists texts, JSON null neither; values without json: are texts."""
    is_json = value.startswith("json:")
    body = F.when(is_json, F.substring(value, 6, 1 << 30))
    number = F.when(body == "true", F.lit(1.0)).when(body == "false", F.lit(0.0)).when(body.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), body.try_cast("double"))
    # a JSON text is unquoted as a member of an object
    inner = F.get_json_object(F.concat(F.lit('{"v":'), body, F.lit("}")), "$.v")
    text = F.when(~is_json, value).when(body.startswith('"') | body.startswith("[") | body.startswith("{"), inner)
    return text, number


def is_bool(value: Column) -> Column:
    return value.isin("json:true", "json:false")


def compare(op: str, wanted, text: Column, number: Column) -> Column:
    """Typed comparison: numbers and texts are never equal, and any text is above any number. Numeric operators on a number read a text's numeric prefix."""
    if op == "like":
        return tx.like(F.coalesce(text, number.cast("string")), str(wanted))
    if isinstance(wanted, bool):
        # a boolean is a number, but reads no text's prefix
        value, there = F.lit(float(wanted)), text.isNotNull() | number.isNotNull()
        if op in ("eq", "neq"):
            same = F.coalesce(number == value, F.lit(False))
            return same & there if op == "eq" else there & ~same
        side = {"lt": number < value, "lte": number <= value, "gt": number > value, "gte": number >= value}[op]
        return F.when(number.isNotNull(), side).when(text.isNotNull(), F.lit(op in ("gt", "gte")))
    if isinstance(wanted, int | float):
        side, value = F.coalesce(number, tx.numeric_prefix(text)), F.lit(float(wanted))
        return {"eq": side == value, "neq": side != value, "lt": side < value, "lte": side <= value, "gt": side > value, "gte": side >= value}[op]
    value = F.lit(wanted)
    there = text.isNotNull() | number.isNotNull()
    if op == "eq":
        return F.coalesce(text == value, F.lit(False)) & there
    if op == "neq":
        return there & F.coalesce(text != value, F.lit(True))
    below = {"lt": text < value, "lte": text <= value, "gt": text > value, "gte": text >= value}[op]
    return F.when(text.isNotNull(), below).when(number.isNotNull(), F.lit(op in ("lt", "lte")))


def _attribute(tables: Tables, field: Field | Filter) -> DataFrame:
    """Rows of one attribute: element_id, id, is_official, text, number, raw. The key predicate lies on the scan."""
    group, _, name = field.name.rpartition(".") if field.name.count(".") == 1 else ("", "", field.name)
    if field.name.count(".") > 1:
        group, _, name = field.name.partition(".")
    if field.source == "property":
        rows, names = tables.properties, ("pset_name", "property_name")
        text, number = decoded(F.col("value"))
    else:
        rows, names = tables.quantities, ("qto_name", "quantity_name")
        text, number = F.lit(None).cast("string"), F.col("value").cast("double")
    rows = rows.where(F.col(names[1]) == name)
    if group:
        rows = rows.where(F.col(names[0]) == group)
    return rows.select(*tables.key, F.col("element_id").alias("express_id"), "id", "is_official", text.alias("text"), number.alias("number"), F.col("value").cast("string").alias("raw"))


def first_values(tables: Tables, field: Field, only: DataFrame | None = None) -> DataFrame:
    """One value per element: official rows first, then the smallest id. With only (key, express_id), as few as a caller names, just of these."""
    w = Window.partitionBy(*tables.key, "express_id").orderBy(F.desc("is_official"), F.asc("id"))
    rows = _attribute(tables, field)
    if only is not None:
        rows = rows.join(F.broadcast(only), [*tables.key, "express_id"], "left_semi")
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "id", "is_official")


def element_predicates(request: Request, by_class: bool = True) -> list[Column]:
    """The request's conditions on the elements' own columns, that on their class left out if it is met elsewhere."""
    out = []
    if request.ifc_class and by_class:
        out.append(F.col("ifc_class").isin(tx.with_subtypes(request.ifc_class)))
    if request.level:
        out.append(F.col("level_key") == tx.level_key_of(request.level))
    for name, wanted in (("predefined_type", request.predefined_type), ("type_name", request.type_name)):
        if wanted:
            out.append(tx.ascii_lower(F.coalesce(name, F.lit(""))) == tx.ascii_lower(F.lit(wanted)))
    if request.text_match and tx.terms(request.text_match):
        out.append(tx.has_all_terms(request.text_match, *map(F.col, ("name", "type_name", "object_type", "description"))))
    own = [f for f in request.filters if f.source == "element"]
    for f in own:
        if f.name not in FILTERABLE:
            raise ValueError(f"elements can't be filtered by {f.name}")
        c = F.col(f.name)
        numeric = f.name == "express_id"
        wanted = f.value if numeric or f.op == "like" else str(f.value)
        out.append(compare(f.op, float(wanted) if numeric and f.op != "like" else wanted, F.lit(None).cast("string") if numeric else c, c.cast("double") if numeric else F.lit(None).cast("double")))
    if not request.ifc_class and (request.text_match or any(f.name == "name" for f in own)):
        out.append((F.col("ifc_class") != "IfcTypeObject") & ~tx.like(F.col("ifc_class"), "%Type"))
    return out


def scope(tables: Tables, request: Request) -> DataFrame:
    """The elements a request is about: plain predicates on the scan, one semi-join per attribute filter."""
    rows = tables.elements
    if request.ifc_class and tables.classes is not None:
        asked = tables.elements.sparkSession.createDataFrame([(c,) for c in tx.with_subtypes(request.ifc_class)], "class_ string")
        # as many rows as a schema has classes
        hits = classes.subtypes(tables.classes, asked).select(F.col("subtype").alias("ifc_class")).distinct()
        rows = rows.join(hits, "ifc_class", "left_semi")
    for p in element_predicates(request, tables.classes is None):
        rows = rows.where(p)
    for f in request.filters:
        if f.source != "element":
            hits = _attribute(tables, f).where(compare(f.op, f.value, F.col("text"), F.col("number")))
            rows = rows.join(hits.select(*tables.key, "express_id"), [*tables.key, "express_id"], "left_semi")
    return rows


def _distinct(tables: Tables) -> Column:
    return F.countDistinct(*tables.key, "express_id")


def count(tables: Tables, request: Request) -> DataFrame:
    return scope(tables, request).agg(_distinct(tables).alias("count"))


def listing(tables: Tables, request: Request) -> DataFrame:
    """The listed columns of distinct elements, in a total order, cut at the limit."""
    names = [*tables.key, *LISTED]
    return scope(tables, request).select(*names).distinct().orderBy(*[F.asc_nulls_first(c) for c in ELEMENT_ORDER], *tables.key).limit(request.limit)


def _with_field(tables: Tables, request: Request, field: Field) -> DataFrame:
    """Scoped elements with text, number, raw of a field; null where they lack it. An element's own blank text is absent."""
    rows = scope(tables, request)
    if field.source == "element":
        if field.name not in GROUPABLE and field.name not in FILTERABLE:
            raise ValueError(f"no such element field: {field.name}")
        c = F.col(field.name).cast("string")
        there = F.when(F.trim(c) != "", c)
        return rows.select(*tables.key, "express_id", there.alias("text"), F.lit(None).cast("double").alias("number"), there.alias("raw"))
    return rows.select(*tables.key, "express_id").join(first_values(tables, field), [*tables.key, "express_id"], "left")


def aggregate(tables: Tables, request: Request) -> DataFrame:
    """One row: value, matched_count (elements that have the field), missing_count and non_numeric (values that sum, avg, min and max can't take)."""
    if request.aggregate_field is None:
        return scope(tables, request).agg(_distinct(tables).cast("double").alias("value"), _distinct(tables).alias("matched_count"), F.lit(0).cast("long").alias("missing_count"), F.lit(0).cast("long").alias("non_numeric"))
    if request.aggregate_field.source == "element" and request.aggregate_op != "count":
        raise ValueError("element fields can only be counted")
    rows = _with_field(tables, request, request.aggregate_field)
    there = F.col("text").isNotNull() | F.col("number").isNotNull()
    how = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    value = F.count(F.when(there, 1)).cast("double") if request.aggregate_op == "count" else how[request.aggregate_op]("number")
    bad = F.count_if(F.col("text").isNotNull() | is_bool(F.col("raw"))) if request.aggregate_op != "count" else F.lit(0).cast("long")
    return rows.agg(value.alias("value"), F.count(F.when(there, 1)).alias("matched_count"), F.count(F.when(~there, 1)).alias("missing_count"), bad.alias("non_numeric"))


def checked(result: DataFrame) -> float | None:
    """The value of an aggregate on the driver; raises if the field isn't numeric."""
    row = result.first()
    if row.non_numeric:
        raise ValueError("the field is not numeric")
    return row.value


def guarded(result: DataFrame) -> DataFrame:
    """An aggregate whose plan fails where values aren't numeric, as a sum of texts means nothing."""
    stop = F.raise_error(F.lit("the field is not numeric")).cast("double")
    return result.withColumn("value", F.when(F.col("non_numeric") > 0, stop).otherwise(F.col("value")))


def group(tables: Tables, request: Request) -> DataFrame:
    """(value, count) of distinct elements per value of a field, largest first. Numbers and equal-looking texts are different groups."""
    rows = _with_field(tables, request, request.group_by).where("text IS NOT NULL OR number IS NOT NULL")
    shown = F.coalesce(F.col("text"), F.when(F.col("number") == F.floor("number"), F.col("number").cast("long").cast("string")).otherwise(F.col("number").cast("string")))
    grouped = rows.groupBy(shown.alias("value"), F.col("text").isNotNull().alias("is_text")).agg(_distinct(tables).alias("count"))
    return grouped.orderBy(F.desc("count"), "value", "is_text").select("value", "count").limit(request.limit)


def coverage(tables: Tables, request: Request, field: Field) -> DataFrame:
    """(matched_count, missing_count): elements with and without a field."""
    there = F.col("text").isNotNull() | F.col("number").isNotNull()
    return _with_field(tables, request, field).agg(F.count(F.when(there, 1)).alias("matched_count"), F.count(F.when(~there, 1)).alias("missing_count"))


def evidence(tables: Tables, request: Request, k: int = 3) -> DataFrame:
    """The first k distinct elements that a request is about, in the order of lists."""
    names = [*tables.key, *LISTED]
    return scope(tables, request).select(*names).distinct().orderBy(*[F.asc_nulls_first(c) for c in ELEMENT_ORDER], *tables.key).limit(k)


def totals(tables: Tables, request: Request) -> DataFrame:
    """One row beside a request's answer: for count and list total_count; for aggregate and group also matched_count and missing_count of the field."""
    total = scope(tables, request).agg(_distinct(tables).alias("total_count"))
    field = request.group_by if request.intent == "group" else request.aggregate_field
    return total if field is None or request.intent in ("count", "list") else total.crossJoin(F.broadcast(coverage(tables, request, field)))


def execute(tables: Tables, request: Request) -> DataFrame:
    """The plan of any request."""
    return {"count": count, "list": listing, "aggregate": aggregate, "group": group}[request.intent](tables, request)


def leaves(properties: DataFrame, key: list[str]) -> DataFrame:
    """(key, element_id, path, value): the leaves of nested property values, by set, name and the keys down to them; lists and empty objects are leaves. Values that aren't objects are left out.

    Each round takes one layer of objects apart; there are as many as values are deep.
    """
    spark = properties.sparkSession
    inner = properties.where(F.col("value").startswith("json:{")).select(*key, "element_id", F.concat_ws(".", "pset_name", "property_name").alias("path"), F.try_parse_json(F.substring("value", 6, 1 << 30)).alias("v")).where("v IS NOT NULL")
    done = None
    filled = F.schema_of_variant("v").startswith("OBJECT<") & (F.schema_of_variant("v") != "OBJECT<>")
    while True:
        opened = inner.where(filled).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("_key"), F.col("value").alias("_value")))
        inner = kept(opened.select(*key, "element_id", F.concat_ws(".", "path", "_key").alias("path"), F.to_json("_value").alias("j")))
        inner = inner.select(*key, "element_id", "path", F.parse_json("j").alias("v"), "j")
        ends = inner.where(~filled).select(*key, "element_id", "path", F.concat(F.lit("json:"), "j").alias("value"))
        done = ends if done is None else done.unionByName(ends)
        if inner.where(filled).isEmpty():
            return done


def attribute_keys(tables: Tables, samples: int = 3) -> DataFrame:
    """(key, n_elements, samples) of all attributes: bare and dotted names, and the leaves of nested values by the whole way to them, with the first few distinct values."""
    rows = [leaves(tables.properties, tables.key).select(F.col("path").alias("key"), *tables.key, "element_id", "value")]
    for frame, a, b in ((tables.properties, "pset_name", "property_name"), (tables.quantities, "qto_name", "quantity_name")):
        for key in (F.col(b), F.concat_ws(".", a, b)):
            rows.append(frame.select(key.alias("key"), *tables.key, F.col("element_id"), F.col("value").cast("string").alias("value")))
    both = reduce(DataFrame.unionByName, rows)
    n = both.groupBy("key").agg(F.countDistinct(*tables.key, "element_id").alias("n_elements"))
    ranked = both.select("key", "value").distinct().withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("value"))).where(F.col("k") <= samples)
    return n.join(ranked.groupBy("key").agg(F.sort_array(F.collect_list("value")).alias("samples")), "key", "left")


def bounded(rows: DataFrame, order: list[Column], limit: int, cap: int = 100) -> DataFrame:
    """The first rows in an order, with total_found, returned_count and truncated; the total is an aggregate of its own, so the rows are only ever a top-k."""
    limit = max(1, min(limit, cap))
    total = rows.agg(F.count("*").alias("total_found"))
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(total)).withColumns({"returned_count": F.least("total_found", F.lit(limit).cast("long")), "truncated": F.col("total_found") > limit}).orderBy(*order)
