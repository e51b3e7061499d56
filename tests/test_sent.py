"""What queries on records send through the driver: few rows, however small Spark takes the written records for."""

import pytest

from spandrel.plans import driver_queries

SF, ORDERS = "/root/testdata/sf0.001", 1500


def broadcasts(spark, run):
    """Rows of each broadcast while something runs."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    rows, done = [], store.executionsList()
    assert store.executionsCount() > before
    for k in range(before, done.size()):
        own = done.apply(k).executionId()
        values, nodes = store.executionMetrics(own), store.planGraph(own).allNodes()
        for n in (nodes.apply(i) for i in range(nodes.size())):
            metrics = n.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if n.name() == "BroadcastExchange" and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    rows.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return rows


@pytest.mark.parametrize("name", ["record_graph", "record_tables", "nested_keys", "answer_totals", "action_storey", "action_classification", "action_find_nodes", "action_aggregate", "action_group"])
def test_records_are_not_sent(spark, name):
    rows = broadcasts(spark, lambda: driver_queries.QUERIES[name](spark, SF).collect())
    assert max(rows, default=0) < ORDERS / 2
