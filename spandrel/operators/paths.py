"""Ways through a graph with their evidence: which nodes, over which edges, stated by what.

A search between two nodes goes out from both ends and stops where they meet. Ways back are put together for all targets at once by pointer doubling: each round makes the known piece of every way twice as long, so that there
are as many joins as the length has binary digits, and no job for a hop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import EXPLICIT, HIERARCHY, SPATIAL, STATED_TOPOLOGY, TOPOLOGY, counted, known_relations, moves, sent, steps
from .staging import kept


class NoPath(ValueError):
    """There is no way, or (code path_too_long) none as short as asked for."""

    def __init__(self, code: str, text: str):
        super().__init__(text)
        self.code = code


def source_of(relation: Column) -> Column:
    """Where edges of a relation come from if they don't say so: files, boxes or plans."""
    return F.when(relation.isin(*STATED_TOPOLOGY, *EXPLICIT), "ifc").when(relation.isin(*SPATIAL), "heuristic").when(relation.isin(*TOPOLOGY), "topology")


def paths(reach: DataFrame, depth: int) -> DataFrame:
    """(seed, id, depth, path): the nodes from the seed to each node of a walk (seed, id, depth, parent) of so many levels."""
    rows = reach.select("seed", "id", "depth", F.col("parent").alias("up"), F.array("id").alias("path"))
    for _ in range(max(0, depth).bit_length()):
        above = rows.select("seed", F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        rows = kept(rows.join(above, ["seed", "up"], "left").select("seed", "id", "depth", F.col("next").alias("up"), F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path")))
    return rows.select("seed", "id", "depth", "path")


def grounded(rows: DataFrame, edges: DataFrame, key: list[str], relations=None) -> DataFrame:
    """rows (key, path, ...), few of them, with steps: hop, from_id, to_id, relation, source and direction of the edge that each hop goes by.

    Among parallel edges a forward one is preferred, then explicit, topology, spatial and hierarchy ones, then the first by name.
    """
    e = edges if relations is None else edges.where(F.col("relation").isin(known_relations(relations)))
    stated = F.col("source") if "source" in e.columns else F.lit(None).cast("string")
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("hop"), F.get("path", i - 1).alias("from_id"), F.get("path", i).alias("to_id"))))
    hops = rows.where(F.size("path") > 1).select(*key, pair.alias("h")).select(*key, "h.*")
    ends = kept(hops.select("from_id", "to_id").distinct())
    rank = reduce(lambda c, x: c.when(F.col("relation").isin(*x[1]), x[0]), list(enumerate((TOPOLOGY, SPATIAL, HIERARCHY), 1)), F.when(F.col("relation").isin(*EXPLICIT), 0))
    e = e.select("src", "dst", "relation", F.coalesce(stated, source_of(F.col("relation"))).alias("source"))
    # the hops are turned, not the edges, which are read once and stay where they are if hops are few
    ways = ends.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("back"))
    ways = ways.select("*", F.when(F.col("back") == 0, F.col("from_id")).otherwise(F.col("to_id")).alias("src"), F.when(F.col("back") == 0, F.col("to_id")).otherwise(F.col("from_id")).alias("dst"))
    best = e.join(sent(ways, counted(ways)), ["src", "dst"]).groupBy("from_id", "to_id").agg(F.min(F.struct("back", rank.alias("rank"), "relation", "source")).alias("e"))
    direction = F.when(F.col("e.back") == 0, "forward").otherwise("backward").alias("direction")
    made = hops.join(best, ["from_id", "to_id"], "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("hop", "from_id", "to_id", F.col("e.relation").alias("relation"), F.col("e.source").alias("source"), direction))).alias("steps"))
    none = F.array().cast(made.schema["steps"].dataType)
    return rows.join(made, key, "left").withColumn("steps", F.coalesce("steps", none))


def _climbed(seen: DataFrame, node, depth: int) -> list:
    """The nodes above one, nearest first: jumps of 1, 2, 4, ... levels are made of one another, then each jump doubles what is known of the way."""
    spark = seen.sparkSession
    jumps = [seen.where("parent IS NOT NULL").select("id", F.col("parent").alias("up"))]
    while 2 ** len(jumps) <= depth:
        last = jumps[-1]
        jumps.append(kept(last.join(last.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up"))))
    kind = seen.schema["id"].dataType.simpleString()
    known = spark.createDataFrame([(node, 0)], f"id {kind}, n long")
    for k in range(len(jumps) - 1, -1, -1):
        known = known.unionByName(F.broadcast(known).join(jumps[k], "id").select(F.col("up").alias("id"), (F.col("n") + 2**k).alias("n")))
    # as many rows as the way has nodes
    return [r.id for r in known.where(F.col("n") <= depth).groupBy("n").agg(F.min("id").alias("id")).orderBy("n").collect()]


def between(edges: DataFrame, start, end, relations=None, longest: int | None = None) -> list:
    """The nodes of a shortest way between two, edges taken both ways; NoPath if there is none, or none of at most `longest` hops.

    Levels are added at the end whose frontier is smaller. Of equal ways it is the one over the least node where both ends meet, and over least parents from there.
    """
    if start == end:
        return [start]
    spark, kind = edges.sparkSession, "string" if isinstance(start, str) else "long"
    e = edges if relations is None else edges.where(F.col("relation").isin(known_relations(relations)))
    move = moves(steps(e, None, "any"), again=True)
    first = lambda node: spark.createDataFrame([(node, None, 0)], f"id {kind}, parent {kind}, depth int")
    seen, front, depth, size = [first(start), first(end)], [first(start), first(end)], [0, 0], [1, 1]
    while True:
        k = int(size[1] < size[0])
        depth[k] += 1
        new = move.join(sent(front[k].select("id"), size[k]), F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        front[k] = kept(new.join(seen[k].select("id"), "id", "left_anti").select("id", "parent", F.lit(depth[k]).alias("depth")))
        met = front[k].join(seen[1 - k].select("id", F.col("depth").alias("there")), "id", "left")
        found = met.agg(F.count("*").alias("n"), F.min(F.when(F.col("there").isNotNull(), F.struct("there", "id"))).alias("m")).first()
        size[k], seen[k] = found.n, seen[k].unionByName(front[k])
        if found.m is not None:
            break
        if not found.n:
            raise NoPath("no_path", f"there is no way from {start!r} to {end!r}")
    length = depth[k] + found.m.there
    if longest is not None and length > longest:
        raise NoPath("path_too_long", f"the shortest way from {start!r} to {end!r} has {length} hops, more than {longest}")
    depths = [depth[0] if k == 0 else found.m.there, depth[1] if k == 1 else found.m.there]
    head, tail = (_climbed(seen[s], found.m.id, depths[s]) for s in (0, 1))
    return head[::-1] + tail[1:]
