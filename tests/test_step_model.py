"""STEP files to models: placements, shapes of all kinds, units, attributes of types, relations."""

import json

import numpy as np
import pytest

from spandrel.plans.model import Model
from spandrel.sources import step, step_check, step_model

TEXT = """ISO-10303-21;
HEADER;
FILE_DESCRIPTION(('a; b'),'2;1');
ENDSEC;
DATA;
#1=IFCSIUNIT(*,.LENGTHUNIT.,.MILLI.,.METRE.);
#2=IFCUNITASSIGNMENT((#1,#3));
#3=IFCSIUNIT(*,.AREAUNIT.,$,.SQUARE_METRE.);
#4=IFCPROJECT('p',$,'Project',$,$,$,$,$,#2);
#5=IFCBUILDINGSTOREY('s',$,'Level 2',$,$,#13,$,$,.ELEMENT.,0.);
#10=IFCCARTESIANPOINT((1000.,2000.,0.));
#11=IFCDIRECTION((0.,0.,1.));
#12=IFCDIRECTION((0.,1.,0.));
#13=IFCLOCALPLACEMENT($,#14);
#14=IFCAXIS2PLACEMENT3D(#10,#11,#12);
#15=IFCLOCALPLACEMENT(#13,#16);
#16=IFCAXIS2PLACEMENT3D(#17,#18,#19);
#17=IFCCARTESIANPOINT((0.,500.,1.E2));
#18=IFCDIRECTION((0.,3.,4.));
#19=IFCDIRECTION((1.,0.,0.));
#20=IFCCARTESIANPOINTLIST3D(((0.,0.,0.),(1000.,0.,0.),(1000.,200.,0.),(0.,200.,3000.),(0.,0.,0.)));
#21=IFCTRIANGULATEDFACESET(#20,$,.T.,((1,2,3)),$);
#22=IFCSHAPEREPRESENTATION($,'Body','Tessellation',(#21));
#23=IFCPRODUCTDEFINITIONSHAPE($,$,(#24,#22));
#24=IFCSHAPEREPRESENTATION($,'Axis','Curve2D',(#21));
#25=IFCWALL('w',$,'Wall; (one)',$,'kind',#15,#23,'t',.SOLIDWALL.);
#30=IFCRECTANGLEPROFILEDEF(.AREA.,$,#31,400.,200.);
#31=IFCAXIS2PLACEMENT2D(#32,#33);
#32=IFCCARTESIANPOINT((100.,0.));
#33=IFCDIRECTION((0.,1.));
#34=IFCEXTRUDEDAREASOLID(#30,#35,#11,2500.);
#35=IFCAXIS2PLACEMENT3D(#36,$,$);
#36=IFCCARTESIANPOINT((0.,0.,50.));
#37=IFCSHAPEREPRESENTATION($,'Body','SweptSolid',(#34));
#38=IFCPRODUCTDEFINITIONSHAPE($,$,(#37));
#39=IFCCOLUMN('c',$,'Column',$,$,#13,#38,$,$);
#40=IFCREPRESENTATIONMAP(#41,#37);
#41=IFCAXIS2PLACEMENT3D(#36,$,$);
#42=IFCCARTESIANTRANSFORMATIONOPERATOR3D($,$,#10,2.,$);
#43=IFCMAPPEDITEM(#40,#42);
#44=IFCSHAPEREPRESENTATION($,'Body','MappedRepresentation',(#43));
#45=IFCPRODUCTDEFINITIONSHAPE($,$,(#44));
#46=IFCDOOR('d',$,'Door',$,$,#47,#45,$,2100.,900.,.GATE.,$,$);
#47=IFCLOCALPLACEMENT($,#41);
#50=IFCCARTESIANPOINT((0.,0.,0.));
#51=IFCCARTESIANPOINT((500.,0.,0.));
#52=IFCCARTESIANPOINT((0.,500.,700.));
#53=IFCPOLYLOOP((#50,#51,#52));
#54=IFCFACEOUTERBOUND(#53,.T.);
#55=IFCFACE((#54));
#56=IFCCLOSEDSHELL((#55));
#57=IFCFACETEDBREP(#56);
#58=IFCSHAPEREPRESENTATION($,'Body','Brep',(#57));
#59=IFCPRODUCTDEFINITIONSHAPE($,$,(#58));
#60=IFCSLAB('f',$,'Slab',$,$,#47,#59,$,.FLOOR.);
#61=IFCBEAM('round',$,'Loop',$,$,#62,#59,$,$);
#62=IFCLOCALPLACEMENT(#63,#41);
#63=IFCLOCALPLACEMENT(#62,#41);
#64=IFCPILE('alone',$,'No shape',$,$,#47,$,$,$);
#65=IFCPLATE('gone',$,'No placement above',$,$,#66,#59,$,$);
#66=IFCLOCALPLACEMENT(#999,#41);
#70=IFCRELCONTAINEDINSPATIALSTRUCTURE('r1',$,$,$,(#25,#39,#60),#5);
#71=IFCRELAGGREGATES('r2',$,$,$,#60,(#61));
#72=IFCWALLTYPE('wt',$,'Type A',$,$,(#73),$,$,$,.SOLIDWALL.);
#73=IFCPROPERTYSET('ps1',$,'Pset_WallCommon',$,(#74,#75));
#74=IFCPROPERTYSINGLEVALUE('FireRating',$,IFCLABEL('of the type'),$);
#75=IFCPROPERTYSINGLEVALUE('Lent',$,IFCREAL(2.),$);
#76=IFCRELDEFINESBYTYPE('r3',$,$,$,(#25),#72);
#77=IFCPROPERTYSET('ps2',$,'Pset_WallCommon',$,(#78));
#78=IFCPROPERTYSINGLEVALUE('FireRating',$,IFCLABEL('its own'),$);
#79=IFCRELDEFINESBYPROPERTIES('r4',$,$,$,(#25),#77);
#80=IFCELEMENTQUANTITY('q',$,'Qto_Wall',$,$,(#81));
#81=IFCQUANTITYLENGTH('Length',$,$,3.5,$);
#82=IFCRELDEFINESBYPROPERTIES('r5',$,$,$,(#25),#80);
#83=IFCMATERIAL('brick',$,$);
#84=IFCMATERIALLAYER(#83,100.,$,$,$,$,$);
#85=IFCMATERIALLAYERSET((#86,#84),$,$);
#86=IFCMATERIALLAYER(#87,100.,$,$,$,$,$);
#87=IFCMATERIAL(' plaster ',$,$);
#88=IFCMATERIALLAYERSETUSAGE(#85,.AXIS2.,.POSITIVE.,0.,$);
#89=IFCRELASSOCIATESMATERIAL('r6',$,$,$,(#25),#88);
#90=IFCZONE('z',$,'Quiet',$,$,$);
#91=IFCRELASSIGNSTOGROUP('r7',$,$,$,(#25),$,#90);
#92=IFCCLASSIFICATION($,$,$,'Uniclass',$,$,$);
#93=IFCCLASSIFICATIONREFERENCE($,'W1','Walls',#92,$,$);
#94=IFCRELASSOCIATESCLASSIFICATION('r8',$,$,$,(#25),#93);
#95=IFCRELVOIDSELEMENT('r9',$,$,$,#25,#96);
#96=IFCOPENINGELEMENT('o',$,'Hole',$,$,#47,$,$,.OPENING.);
#97=IFCRELFILLSELEMENT('r10',$,$,$,#96,#46);
ENDSEC;
END-ISO-10303-21;
"""


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("step")
    (folder / "one.ifc").write_text(TEXT)
    (folder / "two.ifc").write_bytes(TEXT.replace("MILLI", "CENTI").replace("\n", "\r\n").encode())
    return Model.read_step(spark, str(folder / "one.ifc"), str(folder / "two.ifc"))


def shapes(model, dataset):
    return {r.global_id: r for r in model.nodes.where(f"dataset = '{dataset}' AND global_id IS NOT NULL").collect()}


def test_placements_and_meshes(model):
    got = shapes(model, "one")
    storey = np.array([[0.0, -1, 0, 1000], [1, 0, 0, 2000], [0, 0, 1, 0], [0, 0, 0, 1]])
    wall = np.array([[1.0, 0, 0, 0], [0, 0.8, 0.6, 500], [0, -0.6, 0.8, 100], [0, 0, 0, 1]])
    points = np.array([(0, 0, 0, 1), (1000, 0, 0, 1), (1000, 200, 0, 1), (0, 200, 3000, 1)]) @ (storey @ wall).T / 1000
    have = np.array(got["w"].mesh)
    assert np.allclose(have, points[:, :3])
    assert np.allclose(got["w"].centre, points[:, :3].mean(axis=0)) and np.allclose(got["w"].lo, points[:, :3].min(axis=0)) and np.allclose(got["w"].hi, points[:, :3].max(axis=0))
    # the other file's unit is ten times as long
    assert np.allclose(np.array(shapes(model, "two")["w"].mesh), have * 10)


def test_extrusions_mapped_items_and_bodies(model):
    got = shapes(model, "one")
    column = np.array([(x, y, z) for z in (50, 2550) for x, y in ((0, 200), (0, -200), (200, -200), (200, 200))])
    placed = np.stack([1000 - column[:, 1], 2000 + column[:, 0], column[:, 2]], axis=1) / 1000
    sort = lambda p: np.array(sorted(map(tuple, np.round(p, 9).tolist())))
    assert np.allclose(sort(np.array(got["c"].mesh)), sort(placed))
    # from the map's origin, twice as large, then to the target, then to the placement
    door = ((column - [0, 0, 50]) * 2 + [1000, 2000, 0] + [0, 0, 50]) / 1000
    assert np.allclose(sort(np.array(got["d"].mesh)), sort(door))
    assert np.allclose(sort(np.array(got["f"].mesh)), sort(np.array([(0, 0, 50), (500, 0, 50), (0, 500, 750)]) / 1000))
    # a placement that leads to itself, no shape, and one above that isn't there
    assert got["round"].mesh is None and got["alone"].centre is None and np.allclose(got["gone"].lo, got["f"].lo)


def test_plans_and_oriented_boxes(model):
    wall = model.nodes.where("dataset = 'one' AND global_id = 'w'").select("footprint", "mesh").first()
    plan = [(p.x, p.y) for p in wall.footprint]
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(plan, plan[1:] + plan[:1])) / 2
    assert area > 0 and all(any(np.allclose(p, v[:2]) for v in wall.mesh) for p in plan)


def test_measures_equal_numpy(spark):
    rng = np.random.default_rng(5)
    clouds = [rng.normal(size=(n, 3)) * [3, 1, 2] @ np.array([[0.8, 0.6, 0], [-0.6, 0.8, 0], [0, 0, 1]]) for n in (3, 40, 7)]
    rows = [(k, c.tolist()) for k, c in enumerate(clouds)] + [(9, None), (10, []), (11, [[1.0, 2.0, 3.0]])]
    got = {r.id: r.f for r in spark.createDataFrame(rows, "id long, v array<array<double>>").select("id", step_model.measured("v").alias("f")).collect()}
    assert got[9] is None and got[10] is None and got[11].center is None and got[11].footprint is None and got[11].lo == [1, 2, 3]
    for k, c in enumerate(clouds):
        f = got[k]
        assert np.allclose(f.centre, c.mean(axis=0)) and np.allclose(f.lo, c.min(axis=0)) and np.allclose(f.hi, c.max(axis=0))
        vectors = np.linalg.eigh(np.cov((c[:, :2] - c[:, :2].mean(axis=0)).T))[1]
        u = vectors[:, 1]
        assert np.isclose(abs(u @ f.axes[0][:2]), 1)
        along = (c[:, :2] - f.center[:2]) @ f.axes[0][:2]
        assert np.isclose(along.max(), f.extents[0]) and np.isclose(along.min(), -f.extents[0])
        assert all(np.isclose(abs((np.array(p) - f.center[:2]) @ f.axes[0][:2]), f.extents[0]) for p in f.corners_xy)


def test_attributes_and_relations(model):
    t = model.tables
    values = {(r.pset_name, r.property_name): json.loads(r.value[5:]) for r in t.properties.where("dataset = 'one' AND element_id = 25").collect()}
    assert values == {("Pset_WallCommon", "FireRating"): "its own", ("Pset_WallCommon", "Lent"): 2.0}
    wall = t.elements.where("dataset = 'one' AND express_id = 25").first()
    assert (wall.name, wall.level, wall.level_key, wall.type_name, wall.predefined_type) == ("Wall; (one)", "Level 2", "level 2", "Type A", "SOLIDWALL")
    assert t.elements.where("dataset = 'one' AND express_id = 46").first().predefined_type == "GATE"
    assert t.elements.where("dataset = 'one' AND express_id = 61").first().level == "Level 2"
    assert [r.value for r in t.quantities.where("dataset = 'one'").collect()] == [3.5]
    assert shapes(model, "one")["w"].Materials == ["plaster", "brick"]
    edges = {(r.src, r.relation, r.dst) for r in model.stated.where("src LIKE 'Element::one::w'").collect()}
    assert ("Element::one::w", "in_zone", "Zone::one::Quiet") in edges and ("Element::one::w", "classified_as", "Classification::one::Uniclass:W1:Walls") in edges
    assert ("Element::one::w", "hosts", "Element::one::o") in edges and ("Element::one::w", "typed_by", "Element::one::wt") in edges
    assert model.get_elements_in_storey("Storey::one::s").count() == 4
    assert model.ask("How many walls are on level 2?")[1].first()["count"] == 2


def test_batches_are_split_as_one_by_one(spark):
    texts = ["a,'b,(c',(d,(e,f)),''", "", "(x", "'open, text", "1", "','',','y',((,))", None, "ü,'ß,'"]

    def plain(text):
        out, depth, quoted = [""], 0, False
        for c in text or "":
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            if c == "," and not quoted and depth == 0:
                out.append("")
            else:
                out[-1] += c
        return [x.strip() for x in out]

    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(step.split_arguments("t").alias("a")).collect()
    assert [r.a for r in got] == [plain(t) for t in texts]


def test_problems_are_listed_or_refused(spark, tmp_path):
    good = """DATA;
#1=IFCPROJECT('0000000000000000000001',$,'#99 in a text',$,$,$,$,$,$);
#2=IFCCARTESIANPOINT((0.,1.E-3,-2.));
#3=IFCAXIS2PLACEMENT3D(#2,$,$);
#4=IFCLOCALPLACEMENT($,#3);
#5=IFCRELAGGREGATES('0000000000000000000005',$,'a (#98)',$,#1,(#6));
#6=IFCSITE('0000000000000000000006',$,'it''s #97',$,$,#4,$,$,$,$,$,$,$,$);
ENDSEC;
"""
    bad = good.replace("#3,$,$);\n#4", "").replace("IFCAXIS2PLACEMENT3D(#2,$,$)", "IFCAXIS2PLACEMENT3D(#2,$)").replace("(0.,1.E-3,-2.)", "#6").replace("(#6));", "(#6,#50,(#51)));").replace("'0000000000000000000006'", "'0000000000000000000005'").replace("IFCPROJECT", "IFCSITE") + "#2=IFCDIRECTION((1.,0.));\n"
    (tmp_path / "good.ifc").write_text(good)
    (tmp_path / "bad.ifc").write_text(bad)
    assert step_check.problems(step.read(spark, str(tmp_path / "good.ifc"))).count() == 0
    got = {tuple(r) for r in step_check.problems(step.read(spark, str(tmp_path / "bad.ifc"))).collect()}
    assert got == {
        ("bad", "arguments", 3, "IFCAXIS2PLACEMENT3D takes 3 arguments"), ("bad", "arguments", 2, "argument 1 of IFCCARTESIANPOINT is no numbers"), ("bad", "arguments", 5, "argument 6 of IFCRELAGGREGATES is no refs"),
        ("bad", "dangling", 5, "refers to #50"), ("bad", "dangling", 5, "refers to #51"), ("bad", "double", 2, "comes 2 times"), ("bad", "same_global_id", 6, "has the identifier of #5"), ("bad", "project", None, "0 projects"),
    }
    with pytest.raises(ValueError, match="8 problems"):
        step_model.read(spark, str(tmp_path / "bad.ifc"), strict=True)


def test_unchanged_datasets_are_kept(spark, tmp_path):
    import os

    from spandrel.sources import records, store

    source, folder = tmp_path / "in", str(tmp_path / "model")
    source.mkdir()
    line = lambda k, name: json.dumps({"GlobalId": f"g{k}", "ExpressId": k, "Name": name, "IfcType": "IfcWall"})
    (source / "a.jsonl").write_text(line(1, "one"))
    (source / "b.jsonl").write_text(line(1, "two"))
    empty = spark.createDataFrame([], "src string, dst string, relation string, source string, dataset string")
    built = []

    def build(files):
        built.append(sorted(os.path.basename(f) for f in files))
        rows = records.read(spark, *files)
        t = records.tables(rows)
        return {"elements": t.elements, "properties": t.properties, "quantities": t.quantities, "nodes": records.graph(rows)[0], "edges": empty}

    update = lambda: store.update(spark, folder, [str(source)], build)
    names = lambda: {(r.dataset, r.name) for r in store.read(spark, folder)["elements"].collect()}
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if "elements" in d and f.endswith(".parquet")}
    assert update() == {"built": ["a", "b"], "kept": [], "removed": []} and names() == {("a", "one"), ("b", "two")}
    first = files()
    assert update() == {"built": [], "kept": ["a", "b"], "removed": []} and files() == first
    (source / "b.jsonl").write_text(line(1, "changed"))
    (source / "c.jsonl").write_text(line(1, "new"))
    assert update() == {"built": ["b", "c"], "kept": ["a"], "removed": []}
    assert names() == {("a", "one"), ("b", "changed"), ("c", "new")} and all("dataset=a" not in f for f in files() - first)
    (source / "a.jsonl").unlink()
    assert update() == {"built": [], "kept": ["b", "c"], "removed": ["a"]} and names() == {("b", "changed"), ("c", "new")}
    assert built == [["a.jsonl", "b.jsonl"], ["b.jsonl", "c.jsonl"]] and store.datasets_of(spark, folder) == ["b", "c"]
    assert {r.name for r in store.read(spark, folder, "c")["elements"].collect()} == {"new"}
