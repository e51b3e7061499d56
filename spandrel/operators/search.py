"""Ranked search over elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.fuzzy import weighted_ratio
from .graph import is_container

# Scores and least scores.
ID, LABEL, CLASS, LEAST_SEARCH, LEAST_FUZZY, TYPE_BIAS = 100, 96, 92, 55.0, 50.0, 8.0
TYPE_TERMS = ("type", "family", "template", "style", "kind")
# Words that name a container class, words that say nothing, and what is added and taken for a query of such words only.
CONTAINER_WORDS = {"building": "IfcBuilding", "site": "IfcSite", "floor": "IfcBuildingStorey", "level": "IfcBuildingStorey", "storey": "IfcBuildingStorey", "room": "IfcSpace", "space": "IfcSpace", "project": "IfcProject"}
FILLERS = ("a", "an", "any", "at", "by", "for", "in", "inside", "is", "near", "of", "on", "outside", "that", "the", "this", "to")
CANONICAL, SECONDARY, PROXY = 60.0, 4.0, 18.0


def element_set(nodes: DataFrame, query: str, fields: tuple[str, ...], label: str = "label") -> DataFrame:
    """(id, label, exact_fields, matched_fields, extra_terms) of nodes whose fields together hold all tokens of the query, best first.

    A field is exact if its tokens are the query's, matched if it has any of them.
    """
    wanted = tx.terms(query)
    if not wanted:
        raise ValueError("the query has no token")
    q = F.array(*map(F.lit, wanted))
    hits = nodes.where(tx.has_all_terms(query, *map(F.col, fields)))
    own = [tx.tokens(tx.combined(F.col(f))) for f in fields]
    exact = sum(((F.size(t) == len(wanted)) & (F.size(F.array_except(t, q)) == 0)).cast("int") for t in own)
    some = sum(F.arrays_overlap(t, q).cast("int") for t in own)
    extra = F.size(F.array_except(tx.tokens(tx.combined(*map(F.col, fields))), q))
    return hits.select("id", F.col(label).alias("label"), exact.alias("exact_fields"), some.alias("matched_fields"), extra.alias("extra_terms"))


def substring_search(nodes: DataFrame, query: str) -> DataFrame:
    """(id, label, class_, score) of nodes whose id, label or class holds the query."""
    q = query.strip().lower()
    score = F.when(F.lower("id").contains(q), ID).when(F.lower("label").contains(q), LABEL).when(F.lower("class_").contains(q), CLASS)
    return nodes.select("id", "label", "class_", score.alias("score")).where("score IS NOT NULL")


def search(nodes: DataFrame, query: str) -> DataFrame:
    """The same, and nodes whose fields are like the query by 55 at least."""
    q = query.strip().lower()
    fuzzy = weighted_ratio(q, F.lower("label"), F.lower("class_"))
    score = F.when(F.lower("id").contains(q), float(ID)).when(F.lower("label").contains(q), float(LABEL)).when(F.lower("class_").contains(q), float(CLASS)).otherwise(fuzzy)
    return nodes.select("id", "label", "class_", F.round(score, 1).alias("score")).where(F.col("score") >= LEAST_SEARCH)


def fuzzy_nodes(nodes: DataFrame, query: str, fields: tuple[str, ...] = ("label", "class_"), least: float = LEAST_FUZZY) -> DataFrame:
    """(id, label, class_, score) of nodes by the best fuzzy ratio of their fields; types rank higher only if the query asks for types."""
    words = set(tx.terms(query))
    bias = TYPE_BIAS if words & set(TYPE_TERMS) else -TYPE_BIAS
    typed = F.when(F.col("class_").endswith("Type") | (F.col("class_") == "IfcTypeObject"), bias).otherwise(0.0)
    score = F.round(weighted_ratio(query, *map(F.col, fields)) + typed + container_bias(words), 1)
    return nodes.select("id", "label", "class_", score.alias("score")).where(F.col("score") >= least)


def container_target(words: set[str]) -> str | None:
    """The container class that a query means if it holds nothing but words for one, like "the floor"."""
    named = {CONTAINER_WORDS.get(w) for w in words - set(FILLERS)}
    return named.pop() if len(named) == 1 else None


def container_bias(words: set[str]) -> Column:
    """What a query for a container adds: most to its class, a little to other containers; proxies lose."""
    target = container_target(words)
    if target is None:
        return F.lit(0.0)
    return F.when(F.col("class_") == target, CANONICAL).when(F.col("class_").isin(*set(CONTAINER_WORDS.values())), SECONDARY).when(F.col("class_") == "IfcBuildingElementProxy", -PROXY).otherwise(0.0)


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One page of ranked rows (score, label, id), with the page count; a number beyond the last page gives the last.

    The rows are counted first, so that a number too large sorts no more than there is, and only a page's rows are numbered.
    """
    total = rows.count()
    pages = max(1, -(-total // size))
    before = (min(number, pages) - 1) * size
    order = (F.desc("score"), "label", "id")
    top = rows.orderBy(*order).offset(before).limit(size)
    rank = F.row_number().over(Window.orderBy(*order)) + before
    return top.withColumns({"rank": rank, "total": F.lit(total).cast("long"), "pages": F.lit(pages)})


def recents(rows: DataFrame, keep: int = 8) -> DataFrame:
    """The first rows (id, name, pinned, last_used): pinned ones, then those used last; of equals by name and id."""
    return rows.orderBy(F.desc("pinned"), F.desc_nulls_last("last_used"), "name", "id").limit(keep)


def merged_evidence(rows: DataFrame, group: str, key: str, order: str, keep: int = 5) -> DataFrame:
    """(group, key, ordinal): each group's first few keys, every key once."""
    once = rows.groupBy(group, key).agg(F.min(order).alias("_at"))
    w = Window.partitionBy(group).orderBy("_at", key)
    return once.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= keep).select(group, key, "ordinal")


def like_class(classes: DataFrame, wanted: str, least: float = 72.0) -> str | None:
    """The class (class_) that a name means: the same without case and Ifc, else the one most alike, if alike enough."""
    plain = F.regexp_replace(F.lower("class_"), "^ifc", "")
    q = wanted.strip().lower().removeprefix("ifc")
    rank = F.when(plain == q, F.lit(200.0)).otherwise(weighted_ratio(q, plain))
    best = classes.select("class_").distinct().withColumn("score", rank).where(F.col("score") >= least).orderBy(F.desc("score"), "class_").first()
    return best.class_ if best else None


def class_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("class_").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.lower("class_"), "class_")
