"""Class hierarchies: Turtle files, closures, intervals and requests that use them."""

import json
import random

import pytest

from spandrel.operators import classes
from spandrel.operators.request import Request
from spandrel.plans.model import Model
from spandrel.sources import ontology, turtle

from .test_model import element

TURTLE = '''# Classes. A comment that ends like a statement .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
PREFIX ifc: <http://example.org/ifc#>
@prefix : <http://example.org/other/> . @base <http://example.org/base/> .
ifc:IfcWall a rdfs:Class ; # a type
    rdfs:subClassOf ifc:IfcBuiltElement , :Thing ;
    rdfs:comment "not ; the end . of \\"it\\" # no comment"@en , \'\'\'long .
 text; rdfs:subClassOf ifc:IfcNothing .
\'\'\' ; rdfs:label "w\\u00e4ll"^^<http://www.w3.org/2001/XMLSchema#string> .
ifc:IfcBuiltElement rdfs:subClassOf <http://example.org/ifc#IfcElement>.
<IfcDoor> rdfs:subClassOf ifc:IfcBuiltElement; rdfs:seeAlso [ rdfs:subClassOf ifc:IfcHidden ; rdfs:label "x" ] ; rdfs:comment ( ifc:IfcA ifc:IfcB ) .
ifc:Pset_WallCommon rdfs:subClassOf ifc:Pset_Common . ifc:IfcReal rdfs:comment 3.5 , true .
ifc:IfcWall.Special rdfs:subClassOf ifc:IfcWall .
[] rdfs:subClassOf ifc:IfcWall .
'''


def test_turtle(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TURTLE)
    rows = [tuple(r) for r in turtle.triples(spark, str(tmp_path)).collect()]
    wall = "http://example.org/ifc#IfcWall"
    texts = {o for s, p, o, is_text in rows if is_text and s == wall}
    assert texts == {'not ; the end . of "it" # no comment', "long .\n text; rdfs:subClassOf ifc:IfcNothing .\n", "wäll"}
    assert (wall, turtle.TYPE, "http://www.w3.org/2000/01/rdf-schema#Class", False) in rows
    assert ("http://example.org/ifc#IfcReal", "http://www.w3.org/2000/01/rdf-schema#comment", "3.5", False) in rows
    got = {tuple(r) for r in turtle.hierarchy(spark, str(tmp_path)).collect()}
    assert got == {("IfcWall", "IfcBuiltElement"), ("IfcBuiltElement", "IfcElement"), ("IfcDoor", "IfcBuiltElement"), ("Pset_WallCommon", "Pset_Common"), ("IfcWall.Special", "IfcWall")}


def test_closure_and_intervals_equal_walks(spark):
    rnd = random.Random(6)
    pairs = {(f"c{k:02}", f"c{rnd.randrange(k):02}") for k in range(1, 40)} | {("c30", "c02"), ("c31", "c05"), ("c05", "c01")} | {(f"x{k}", f"x{k + 1}") for k in range(20)} | {("r1", "r2"), ("r2", "r1"), ("r3", "r1")}
    df = spark.createDataFrame(sorted(pairs), "child string, parent string")
    up = {}
    for a, b in pairs:
        up.setdefault(a, set()).add(b)

    def above(c):
        seen, front, n, out = {c}, [c], 0, {}
        while front:
            n += 1
            front = [p for x in front for p in up.get(x, ()) if p not in seen and not seen.add(p) and not out.update({p: n})]
        return out

    names = {x for p in pairs for x in p}
    assert {(r.child, r.parent): r.distance for r in classes.closure(df).collect()} == {(c, a): n for c in names for a, n in above(c).items()}
    spans = classes.intervals(df)
    wanted = spark.createDataFrame([(n,) for n in sorted(names)] + [("unknown",)], "class_ string")
    got = {}
    for r in classes.subtypes(spans, wanted).collect():
        got.setdefault(r.class_, set()).add(r.subtype)
    assert got.pop("unknown") == {"unknown"}
    for n in names:
        assert got[n] == ({n} if n.startswith("r") else {c for c in names if n in above(c)} | {n})
    assert classes.intervals(df.limit(0)).count() == 0 and classes.closure(df.limit(0)).count() == 0


def test_requests_take_in_loaded_subtypes(spark, tmp_path):
    rows = [element(1, "A", "IfcWallStandardCase", "one", None, None), element(2, "B", "IfcRetainingWall", "two", None, None), element(3, "C", "IfcDoor", "three", None, None), element(4, "D", "IfcGate", "four", None, None)]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "o.json").write_text(json.dumps({"IfcRetainingWall": ["IfcWall", "IfcBuiltElement"], "IfcGate": ["IfcDoor", "IfcBuiltElement"]}))
    m = Model.read(spark, str(tmp_path / "m.jsonl"))
    count = lambda model, c: model.run(Request("count", c)).first()["count"]
    assert [count(m, c) for c in ("wall", "door", "IfcBuiltElement")] == [1, 1, 0]
    more = m.with_classes(ontology.read(spark, str(tmp_path / "o.json")))
    assert [count(more, c) for c in ("wall", "door", "IfcBuiltElement", "IfcGate", "IfcRoof")] == [2, 2, 3, 1, 0]
    assert more.ask("How many walls are there?")[1].first()["count"] == 2
    with pytest.raises(ValueError):
        m.run(Request("group", "wall"))
