"""Tables of nodes and edges meet by shuffle in every step of the communities, so that none passes the driver."""

from corpusloom.operators import modularity as M


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin")


def test_small_tables_are_not_sent_to_the_driver(spark):
    pairs = [(f"n{i}", f"n{j}") for i in range(6) for j in range(6) if i != j]
    edges = spark.createDataFrame([(0, a, b, 1.0) for a, b in pairs], "part int, src string, dst string, weight double")
    state = spark.createDataFrame([(0, f"n{i}", 5.0, 30.0, f"n{i}") for i in range(6)], "part int, id string, k double, m2 double, community string")
    full = state.select("id", "community")
    again = full.selectExpr("0 as draw", "id", "community")
    members = full.selectExpr("id", "id as participant_id")
    tables = [M._round(edges, state, 1), M.communities(edges, state), M.kept_together(full, again), M.stability(edges.drop("part"), members, full, draws=1, least=1)]
    for many, sent in map(joins, tables):
        assert many and not sent
    # The one row a graph of its whole weight may go along.
    assert joins(M.modularity(edges, state)) == (2, 1)
