import random
from collections import deque

import pytest

from sparkloom.operators import graph
from sparkloom.plans import catalogue

TOPOLOGIES = {
    "linear": [("A", "B"), ("B", "C"), ("C", "D")],
    "branch": [("A", "B"), ("A", "C"), ("A", "D")],
    "converge": [("B", "A"), ("C", "A"), ("D", "A")],
    "cycle": [("A", "B"), ("B", "C"), ("C", "A")],
    "diamond": [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")],
    "shortcut": [("A", "B"), ("B", "C"), ("C", "D"), ("A", "C")],
    "loop": [("A", "A"), ("A", "B")],
    "two_components": [("A", "B"), ("B", "A"), ("C", "D"), ("D", "C"), ("B", "C")],
}


def tables(spark, pairs, names="ABCD"):
    f = spark.createDataFrame([(n, n, f"{n.lower()}.rs", "rust", 1, 10) for n in names], "id string, name string, file_path string, language string, line_start int, line_end int")
    c = spark.createDataFrame([(a, b, 5) for a, b in pairs], "caller_id string, callee_id string, line_number int")
    return c, f


def depths(pairs, start, most):
    seen, todo = {start: 0}, deque([start])
    while todo:
        v = todo.popleft()
        for a, b in pairs:
            if a == v and b not in seen and seen[v] < most:
                seen[b] = seen[v] + 1
                todo.append(b)
    return seen


@pytest.mark.parametrize("name", TOPOLOGIES)
def test_bfs_matches_a_plain_search(spark, name):
    c, f = tables(spark, TOPOLOGIES[name])
    for depth in (0, 1, 3):
        got = dict(graph.bfs(c, f.where("id = 'A'").select("id"), depth).collect())
        assert got == depths(TOPOLOGIES[name], "A", depth)


def test_cycles_levels_and_components(spark):
    assert {n for n in TOPOLOGIES if graph.has_cycles(*tables(spark, TOPOLOGIES[n]))} == {"cycle", "loop", "two_components"}
    assert dict(graph.topological_levels(*tables(spark, TOPOLOGIES["shortcut"])).collect()) == {"A": 0, "B": 1, "C": 2, "D": 3}
    with pytest.raises(ValueError):
        graph.topological_levels(*tables(spark, TOPOLOGIES["cycle"]))
    for limit in (500_000, 0):
        c, f = tables(spark, TOPOLOGIES["two_components"])
        assert dict(graph.strong_components(c, f, limit).collect()) == {"A": "A", "B": "A", "C": "C", "D": "C"}
        assert dict(graph.strong_components(*tables(spark, TOPOLOGIES["linear"]), limit).collect()) == {x: x for x in "ABCD"}
    found = {tuple(r["path"]) for r in graph.cycles(tables(spark, TOPOLOGIES["two_components"])[0]).collect()}
    assert found == {("A", "B"), ("C", "D")}


def test_both_component_methods_agree_on_random_graphs(spark):
    rng = random.Random(4)
    names = [chr(65 + i) for i in range(14)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(22)})
    c, f = tables(spark, pairs, names)
    assert sorted(graph.strong_components(c, f).collect()) == sorted(graph.strong_components(c, f, 0).collect())


def test_callers_callees_chains_and_degrees(spark):
    c, f = tables(spark, TOPOLOGIES["diamond"])
    assert {r["caller"] for r in graph.callers(c, f, "D").collect()} == {"B", "C"}
    assert {r["callee"] for r in graph.callees(c, f, "A").collect()} == {"B", "C"}
    assert {(tuple(r["path"]), r["truncated"]) for r in graph.chains(c, f.where("id = 'A'").select("id"), 3).collect()} == {(("A", "B", "D"), False), (("A", "C", "D"), False)}
    assert {(tuple(r["path"]), r["truncated"]) for r in graph.chains(c, f.where("id = 'A'").select("id"), 1).collect()} == {(("A", "B"), True), (("A", "C"), True)}
    assert [r["id"] for r in graph.most_complex(c, f, 2).collect()] == ["A", "B"]
    assert [r["id"] for r in graph.without_callers(c, f).collect()] == ["A"]
    assert [r["id"] for r in graph.without_callees(c, f).collect()] == ["D"]


def test_trees_and_reports(spark):
    c, f = tables(spark, TOPOLOGIES["cycle"])
    tree = graph.call_tree(c, f, "A", 5)
    assert graph.indented(tree) == "A\n  B\n    C"
    assert graph.call_tree(c, f, "missing", 2) == {}
    assert "Functions: 4" in graph.report(c, f)
    s = graph.stats(c, f).first()
    assert (s.total_functions, s.total_calls, s.languages) == (4, 3, {"rust": 4})


def test_calls_to_unknown_functions(spark):
    c = spark.createDataFrame([("A", None, 1), ("A", "B", 2), ("A", "B", 2), ("A", "Z", 3)], "caller_id string, callee_id string, line_number int")
    _, f = tables(spark, [])
    assert graph.dedup_calls(c).count() == 3
    assert graph.with_endpoints(c, f).count() == 2
    assert graph.stats(c, f).first()["unresolved_calls"] == 1


def call_tables(spark, folder, orders, parts):
    """lineitem and part tables where order k lists the parts orders[k] in line order."""
    lines = [(k, p, 1, i, "N") for k, order in enumerate(orders) for i, p in enumerate(order)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    rows = [(p, f"f{p}", "b", "t", 1) for p in parts]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    return str(folder), {pair for order in orders for pair in zip(order, order[1:], strict=False)}


def test_components_of_all_calls(spark, tmp_path):
    # 1 calls 2 twice and 3 once: the way back from 3 is on the second call only
    orders = [(1, 2), (1, 2), (1, 3), (3, 1), (4, 5), (4, 5), (4, 6), (6, 7, 4), (8, 9)]
    d, pairs = call_tables(spark, tmp_path, orders, range(1, 11))
    reach = {v: set(depths(pairs, v, 99)) for v in range(1, 11)}
    want = {v: min(w for w in reach[v] if v in reach[w]) for v in reach}
    assert dict(catalogue.strong_components_all_calls(spark, d).collect()) == want
    assert want[3] == 1 and want[7] == 4 and want[9] == 9


@pytest.mark.parametrize(("orders", "want"), [([(1, 2), (1, 2), (1, 3), (3, 1)], True), ([(1, 2), (1, 3), (3, 4)], False), ([(1, 1)], True)])
def test_cycle_on_a_second_call_is_found(spark, tmp_path, orders, want):
    d, _ = call_tables(spark, tmp_path, orders, range(1, 5))
    assert catalogue.has_cycle_all_calls(spark, d).first()["has_cycles"] is want


def test_leaves_and_roots_of_all_calls(spark, tmp_path):
    # no line of these calls has l_returnflag 'R'
    d, _ = call_tables(spark, tmp_path, [(1, 2), (2, 3)], range(1, 5))
    assert {r["id"] for r in catalogue.leaf_functions_all_calls(spark, d).collect()} == {1, 4}
    assert {r["id"] for r in catalogue.root_functions_all_calls(spark, d).collect()} == {3, 4}


def test_too_many_levels_are_no_cycle(spark):
    with pytest.raises(RuntimeError, match="levels"):
        graph.peel(*tables(spark, TOPOLOGIES["linear"]), most_levels=3)
    assert graph.peel(*tables(spark, TOPOLOGIES["linear"]), most_levels=4)[1].isEmpty()


def least_of_component(pairs, names):
    reach = {v: set(depths(pairs, v, 999)) for v in names}
    return {v: min(w for w in reach[v] if v in reach[w]) for v in names}


def jobs_of(spark, f):
    """f's result and the number of checkpoints it made."""
    made, cut = [], graph.cut
    graph.cut = lambda df: made.append(1) or cut(df)
    try:
        return f(), len(made)
    finally:
        graph.cut = cut


def test_components_of_long_paths_take_few_rounds(spark):
    # a way of 120 calls into a cycle of 40, and a loop of 3 nodes that calls nothing else
    pairs = [(i, i + 1) for i in range(1, 160)] + [(160, 121)] + [(200, 201), (201, 202), (202, 200)]
    names = [*range(1, 161), 200, 201, 202]
    c = spark.createDataFrame([(a, b, 1) for a, b in pairs], "caller_id long, callee_id long, line_number int")
    f = spark.createDataFrame([(x,) for x in names], "id long")
    got, n = jobs_of(spark, lambda: dict(graph.strong_components(c, f, 0).collect()))
    assert got == {x: 121 if 121 <= x <= 160 else 200 if x >= 200 else x for x in names}
    assert n < 30


def test_components_of_dense_graphs_by_contraction(spark):
    rng = random.Random(7)
    names = list(range(60))
    pairs = {(a, b) for a, b in ((rng.randrange(20), rng.randrange(20)) for _ in range(300)) if a != b}
    pairs |= {(20 + a, 20 + b) for a, b in pairs} | {(3, 25), (7, 50), (50, 51), (51, 52), (52, 50), (52, 53), (59, 0)}
    c = spark.createDataFrame([(a, b, 1) for a, b in sorted(pairs)], "caller_id long, callee_id long, line_number int")
    f = spark.createDataFrame([(x,) for x in names], "id long")
    assert graph.thinned(graph.edges(c).select("src", "dst")).count() < len(pairs) / 2
    for most in (0, 20):
        assert dict(graph.strong_components(c, f, most).collect()) == least_of_component(pairs, names)


def test_levels_write_only_what_has_none(spark):
    c, f = tables(spark, [(a, b) for a, b in zip("ABCDEF", "BCDEFG", strict=True)], "ABCDEFGH")
    rows, cut = [], graph.cut
    graph.cut = lambda df: rows.append(cut(df)) or rows[-1]
    try:
        levels, left = graph.peel(c, f, tables=2)
        ends, _ = graph.peel(c)
    finally:
        graph.cut = cut
    want = {x: i for i, x in enumerate("ABCDEFG")}
    assert dict(levels.collect()) == want | {"H": 0} and left.isEmpty() and dict(ends.collect()) == want
    states = [t.count() for t in rows if t.columns == ["id", "needs"]]
    assert states == [8, 6, 5, 4, 3, 2, 1, 0, 7, 6, 5, 4, 3, 2, 1, 0]
