"""Constraints on STEP files: what refers to nothing, comes twice, or has other arguments than its entity takes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import kept
from . import step

# Arguments of entities: how many at least, and what kind some places hold (ref, refs, numbers, number, text; with ? also nothing).
ARGUMENTS = {
    "IFCCARTESIANPOINT": (1, {1: "numbers"}), "IFCDIRECTION": (1, {1: "numbers"}), "IFCLOCALPLACEMENT": (2, {1: "ref?", 2: "ref"}), "IFCAXIS2PLACEMENT3D": (3, {1: "ref", 2: "ref?", 3: "ref?"}), "IFCAXIS2PLACEMENT2D": (2, {1: "ref", 2: "ref?"}),
    "IFCEXTRUDEDAREASOLID": (4, {1: "ref", 2: "ref?", 3: "ref", 4: "number"}), "IFCSHAPEREPRESENTATION": (4, {2: "text?", 4: "refs"}), "IFCPRODUCTDEFINITIONSHAPE": (3, {3: "refs"}), "IFCRECTANGLEPROFILEDEF": (5, {3: "ref?", 4: "number", 5: "number"}),
    "IFCPROPERTYSINGLEVALUE": (4, {1: "text"}), "IFCPROPERTYSET": (5, {5: "refs"}), "IFCELEMENTQUANTITY": (6, {6: "refs"}), "IFCRELDEFINESBYPROPERTIES": (6, {5: "refs", 6: "ref"}), "IFCRELDEFINESBYTYPE": (6, {5: "refs", 6: "ref"}),
    "IFCRELAGGREGATES": (6, {5: "ref", 6: "refs"}), "IFCRELCONTAINEDINSPATIALSTRUCTURE": (6, {5: "refs", 6: "ref"}), "IFCRELVOIDSELEMENT": (6, {5: "ref", 6: "ref"}), "IFCRELFILLSELEMENT": (6, {5: "ref", 6: "ref"}),
}
_NUMBER = r"-?[0-9]+(\.[0-9]*)?([eE][-+]?[0-9]+)?"
# Every form is one pass from left to right.
_FORMS = {"ref": r"#[0-9]+", "refs": r"(\([# 0-9,]*\)|#[0-9]+)", "numbers": r"\([-+.0-9eE, ]*\)", "number": _NUMBER, "text": r"'[^\n]*'"}


#: So many missing ids are sent to the references at most.
SENT = 100_000


def problems(all_: DataFrame) -> DataFrame:
    """(dataset, rule, id, message) of instances (dataset, id, entity, args, line):

    dangling: an argument refers to an instance that isn't there, one row for each such reference; double: an id comes more than once; arguments: too few of them, or one of another kind than the entity takes there;
    same_global_id: several instances with one identifier; project: a file without, or with several, projects (id null). References in texts are none. A file without faults has no rows.
    """
    key = ["dataset"]
    # texts may hold anything, so they go first
    bare = F.regexp_replace(F.array_join("args", ","), "'[^']*'", "")
    to = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"#(\d+)"), F.lit(1)).cast("array<long>"))
    # how often each id that is there or referred to comes: one aggregate, so that what everything refers to is a row for each task
    ends = all_.select(*key, F.explode(F.concat(F.array(F.struct("id", F.lit(1).alias("own"))), F.transform(to, lambda x: F.struct(x.alias("id"), F.lit(0).alias("own"))))).alias("e"))
    odd = kept(ends.groupBy(*key, "e.id").agg(F.sum("e.own").alias("n")).where("n <> 1"))
    lost = odd.where("n = 0").select(*key, F.col("id").alias("to"))
    # bounded: a file that lacks more is met by a shuffle
    lost = F.broadcast(lost) if lost.limit(SENT + 1).count() <= SENT else lost
    dangling = all_.select(*key, "id", F.explode(to).alias("to")).join(lost, [*key, "to"], "left_semi").select(*key, F.lit("dangling").alias("rule"), "id", F.concat(F.lit("refers to #"), F.col("to").cast("string")).alias("message"))
    double = odd.where("n > 1").select(*key, F.lit("double").alias("rule"), "id", F.concat(F.lit("comes "), F.col("n").cast("string"), F.lit(" times")).alias("message"))
    wrong = F.lit(None).cast("string")
    for entity, (least, kinds) in ARGUMENTS.items():
        faults = F.when(F.size("args") < least, F.lit(f"{entity} takes {least} arguments"))
        for place, kind in kinds.items():
            form, optional = _FORMS[kind.rstrip("?")], kind.endswith("?")
            fits = step.arg(place).rlike(f"^{form}$") | (step.arg(place).isin("$", "*") if optional else F.lit(False))
            faults = faults.when(~F.coalesce(fits, F.lit(False)), F.lit(f"argument {place} of {entity} is no {kind.rstrip('?')}"))
        wrong = F.when(F.col("entity") == entity, faults).otherwise(wrong)
    listed = all_.where(F.col("entity").isin(*ARGUMENTS)).select(*key, F.lit("arguments").alias("rule"), "id", wrong.alias("message")).where("message IS NOT NULL")
    named = all_.where(step.arg(1).rlike("^'[0-9A-Za-z_$]{22}'$")).select(*key, "id", step._text(1).alias("gid"))
    again = named.groupBy(*key, "gid").agg(F.min("id").alias("first"), F.count_distinct("id").alias("n")).where("n > 1")
    same = named.join(again, [*key, "gid"]).where("id > first").select(*key, F.lit("same_global_id").alias("rule"), "id", F.concat(F.lit("has the identifier of #"), F.col("first").cast("string")).alias("message"))
    projects = all_.groupBy(*key).agg(F.count_distinct(F.when(F.col("entity") == "IFCPROJECT", F.col("id"))).alias("n")).where("n <> 1")
    projects = projects.select(*key, F.lit("project").alias("rule"), F.lit(None).cast("long").alias("id"), F.concat(F.col("n").cast("string"), F.lit(" projects")).alias("message"))
    return reduce(DataFrame.unionByName, (dangling, double, listed, same, projects))


def refuse(all_: DataFrame, shown: int = 5) -> None:
    """Raises ValueError with the number of problems and the first few, if there are any."""
    found = problems(all_)
    n = found.count()
    if n:
        first = [f"{r.dataset} #{r.id} {r.rule}: {r.message}" for r in found.orderBy("dataset", "rule", F.asc_nulls_first("id"), "message").limit(shown).collect()]
        raise ValueError(f"{n} problems in STEP files: " + "; ".join(first))
