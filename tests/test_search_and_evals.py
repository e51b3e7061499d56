"""Ranking, roll-ups, questions, other sources and streams."""

import pytest
from pyspark.sql import functions as F

from spandrel.functions import fuzzy
from spandrel.operators import evals, search
from spandrel.operators.request import Field, Filter
from spandrel.plans import router
from spandrel.sources import cases, step
from spandrel.streaming import windows


def test_fuzzy():
    assert fuzzy.weighted("red bolt", "red bolt") == 100
    assert fuzzy.weighted("red bolt", "bolt red") == pytest.approx(95)
    assert fuzzy.weighted("", "x") == 0
    assert fuzzy.weighted("wall", "a very long description of a wall somewhere") >= 60
    assert fuzzy.ratio("kitten", "sitting") == pytest.approx(2 * 4 / 13 * 100)


def test_ranked_search(spark):
    n = spark.createDataFrame([("E1", "Street tree", "IfcPlant"), ("E2", "Red bolt", "IfcBolt"), ("E3", "Bolt, red", "IfcBoltType")], "id string, label string, class_ string")
    hits = search.fuzzy_nodes(n, "red bolt").orderBy(F.desc("score")).collect()
    assert [h.id for h in hits] == ["E2", "E3"]
    exact = search.element_set(n, "bolt red", ("label", "class_")).collect()
    assert {(r.id, r.exact_fields) for r in exact} == {("E2", 1), ("E3", 1)}
    with pytest.raises(ValueError):
        search.element_set(n, "!!", ("label",))
    page = search.page(search.substring_search(n, "bolt"), 9, 1).collect()
    assert [(r.id, r.rank, r.pages) for r in page] == [("E2", 2, 2)]
    assert search.search(n, "streat tree").first().id == "E1"


def test_roll_up(spark):
    runs = spark.createDataFrame([("p", True, True, True, 100.0, 15), ("p", False, False, True, 180.0, None), ("q", None, True, True, 1.0, 3)], "profile string, answer_correct boolean, route_correct boolean, no_error boolean, duration_ms double, tokens long")
    rows = {r.profile: r for r in evals.roll_up(runs, "profile").collect()}
    p = rows["p"]
    assert (p.answer_correct_rate, p.route_correct_rate, p.avg_duration_ms, p.p95_duration_ms, p.sum_tokens, p.token_coverage_rate) == (0.5, 0.5, 140.0, 180.0, 15, 0.5)
    assert [r.profile for r in evals.leaderboard(runs, "profile", 5).collect()] == ["p", "q"]
    assert evals.combinations(spark, {"router": ["rule", "llm", "rule"], "agent": ["x"]}).count() == 2


@pytest.mark.parametrize(
    "question,intent,class_,level",
    [
        ("How many doors are there on level 2?", "count", "IfcDoor", "level 2"),
        ("List all curtain walls on the ground floor", "list", "IfcCurtainWall", "ground floor"),
        ("Which windows are on storey 2?", "list", "IfcWindow", "level 2"),
        ("Is there any roof?", "count", "IfcRoof", None),
        ("What is the average u-value of windows?", "aggregate", "IfcWindow", None),
        ("Break down doors by fire rating", "group", "IfcDoor", None),
    ],
)
def test_questions_for_the_tables(question, intent, class_, level):
    r = router.route(question)
    assert r.kind == "sql", r
    assert (r.request.intent, r.request.ifc_class, r.request.level) == (intent, class_, level)


def test_question_details():
    r = router.route("What is the total net volume of walls on floor 3?").request
    assert (r.aggregate_op, r.aggregate_field, r.level) == ("sum", Field("quantity", "NetVolume"), "level 3")
    r = router.route("Count elements with property FireRating = EI60").request
    assert r.filters == (Filter("property", "FireRating", "eq", "EI60"),)
    r = router.route("Group doors by level").request
    assert r.group_by == Field("element", "level")
    r = router.route("How many elements have the word curtain in their name?").request
    assert r.filters == (Filter("element", "name", "like", "%curtain%"),)


@pytest.mark.parametrize("question", ["What is adjacent to the kitchen?", "Which walls touch the roof?", "How many chairs are in room 12?", "Tell me a story", "How many doors and windows are there?", "Which spaces are on level 2?", "How many doors are made of oak?"])
def test_questions_for_the_graph(question):
    assert router.route(question).kind == "graph"


def test_cases(spark):
    text = "cases:\n- {id: a, question: q, expected_route: sql, answer: {canonical: '3'}, tags: [x]}\n- {id: b, question: q, expected_route: graph, answer: {canonical: 'no', acceptable: [none]}, tags: [y]}\n- {id: c, question: q, expected_route: sql, answer: {canonical: '1'}, tags: [x, y]}\n"
    d = cases.read(spark, text)
    assert [r.id for r in evals.cases_up_to(d, "b", ("y",)).collect()] == ["b"]
    with pytest.raises(ValueError):
        cases.read(spark, text.replace("graph", "both"))


def test_step(spark, tmp_path):
    text = """ISO-10303-21;\nDATA;\n#1=IFCBUILDINGSTOREY('s1',#9,'Ground',$,$,#3,$,'tag',.ELEMENT.,0.);\n#2=IFCWALL('w1',#9,'It''s (a) wall',$,
 'Basic',#3,#4,'T2',.STANDARD.);\n#5=IFCRELCONTAINEDINSPATIALSTRUCTURE('r',#9,$,$,(#2,#7),#1);\nENDSEC;\n"""
    path = tmp_path / "m.ifc"
    path.write_text(text)
    all_ = step.instances(spark, str(path))
    e = {r.express_id: r for r in step.elements(all_).collect()}
    assert (e[2].ifc_class, e[2].name, e[2].object_type, e[2].tag) == ("IfcWall", "It's (a) wall", "Basic", "T2")
    assert sorted(map(tuple, step.contained(all_).collect())) == [(2, 1), (7, 1)]


def test_streamed_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "view", 1.0), ("2024-01-01 00:50:00", "view", 2.0), ("2024-01-01 01:10:00", "view", 4.0)]
    d = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    d.write.parquet(str(tmp_path / "in"))
    q = windows.counts(windows.stream(spark, str(tmp_path / "in"), d.schema)).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.n, r.total) for r in spark.table("w").collect()) == [(1, 4.0), (2, 3.0)]
    assert windows.counts(d).count() == 2
