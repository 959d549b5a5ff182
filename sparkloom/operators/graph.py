"""Call-graph queries over functions (id, name, file_path, language, ...) and calls (caller_id, callee_id, line_number, ...).

Everything is a join or an aggregate on node ids. Traversals keep a frontier and drop what was seen
by anti-join, one job per level; their plans are cut by checkpoints, so depth does not grow them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def edges(calls: DataFrame) -> DataFrame:
    """Resolved calls as src, dst, line."""
    return calls.where("callee_id is not null").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), F.col("line_number").alias("line"))


def dealt(df: DataFrame, column: str) -> DataFrame:
    """df partitioned by a column into a number of parts that adaptive execution does not change."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def held(df: DataFrame) -> DataFrame:
    """cut() of what dealt() has made, whose partitioning stays known, so that joins on the column ship the other side only.

    An adaptive plan tells a checkpoint no partitioning; the setting is off while this one is planned and run."""
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return cut(df)
    finally:
        conf.set(key, before)


def find_by_name(functions: DataFrame, name: str) -> DataFrame:
    return functions.where(F.col("name") == name)


def find_by_file(functions: DataFrame, path: str) -> DataFrame:
    return functions.where(F.col("file_path") == path)


def dedup_calls(calls: DataFrame) -> DataFrame:
    """One row per caller, callee and line."""
    return calls.dropDuplicates(["caller_id", "callee_id", "line_number"])


def with_endpoints(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls both of whose ends are known functions."""
    ids = functions.select("id").distinct()
    return calls.join(ids.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi").join(ids.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi")


def neighbours(calls: DataFrame, functions: DataFrame, targets: DataFrame, direction: str) -> DataFrame:
    """The callers or callees of every function in targets (id), with the line of the call."""
    mine, other = ("callee_id", "caller_id") if direction == "callers" else ("caller_id", "callee_id")
    near = calls.where("callee_id is not null").join(targets.select(F.col("id").alias(mine)), mine, "left_semi")
    f = functions.select(F.col("id").alias(other), "name", "file_path", "line_start", "line_end", "language")
    return near.select(F.col(mine).alias("target_id"), other, "line_number").join(f, other).withColumnRenamed(other, "id")


def callers(calls: DataFrame, functions: DataFrame, symbol: str) -> DataFrame:
    """Callers of all overloads of a symbol: caller, caller_file, caller_line, target."""
    found = neighbours(calls, functions, find_by_name(functions, symbol), "callers")
    return found.select(F.col("name").alias("caller"), F.col("file_path").alias("caller_file"), F.col("line_number").alias("caller_line"), F.lit(symbol).alias("target"))


def callees(calls: DataFrame, functions: DataFrame, symbol: str) -> DataFrame:
    """Callees of all overloads of a symbol: callee, callee_file, callee_line, caller."""
    found = neighbours(calls, functions, find_by_name(functions, symbol), "callees")
    return found.select(F.col("name").alias("callee"), F.col("file_path").alias("callee_file"), F.col("line_start").alias("callee_line"), F.lit(symbol).alias("caller"))


def bfs(calls: DataFrame, start: DataFrame, depth: int, direction: str = "callees") -> DataFrame:
    """id and the least depth (0 for the start) of every function within `depth` calls of start (id)."""
    e = edges(calls).select("src", "dst").distinct()
    if direction == "callers":
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seen = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for k in range(1, depth + 1):
        step = e.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def chains(calls: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """Simple call paths from start (id) that end at a leaf or at max_depth: path, truncated."""
    e = edges(calls).select("src", "dst").distinct()
    open_ = cut(start.select(F.array("id").alias("path")).distinct())
    done = None
    for k in range(max_depth + 1):
        last = open_.withColumn("src", F.element_at("path", -1))
        grown = last.join(e, "src").where(~F.array_contains("path", F.col("dst")))
        ends = last.join(grown.select("path").distinct(), "path", "left_anti").select("path", F.lit(False).alias("truncated"))
        done = ends if done is None else done.unionByName(ends)
        if k == max_depth:
            return done.unionByName(grown.select("path").distinct().withColumn("truncated", F.lit(True)))
        open_ = cut(grown.select(F.concat("path", F.array("dst")).alias("path")))
        if open_.isEmpty():
            break
    return done


def degrees(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions with in_degree, out_degree and their sum. Both counts come from one shuffle."""
    e = edges(calls)
    ends = e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    n = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = functions.join(n, "id", "left").withColumn("in_degree", zero("in_degree")).withColumn("out_degree", zero("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def most_complex(calls: DataFrame, functions: DataFrame, n: int) -> DataFrame:
    return degrees(calls, functions).orderBy(F.desc("degree"), "id").limit(n)


def without_callers(calls: DataFrame, functions: DataFrame) -> DataFrame:
    return functions.join(edges(calls).select(F.col("dst").alias("id")), "id", "left_anti")


def without_callees(calls: DataFrame, functions: DataFrame) -> DataFrame:
    return functions.join(edges(calls).select(F.col("src").alias("id")), "id", "left_anti")


def language_distribution(functions: DataFrame) -> DataFrame:
    return functions.groupBy("language").agg(F.count(F.lit(1)).alias("n_functions"))


def file_distribution(functions: DataFrame) -> DataFrame:
    return functions.groupBy(F.substring_index("file_path", "/", -1).alias("file_name")).agg(F.count(F.lit(1)).alias("n_functions"))


def stats(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: totals, resolved and unresolved calls, and a language -> count map."""
    f = functions.agg(F.count(F.lit(1)).alias("total_functions"), F.countDistinct("file_path").alias("total_files"))
    c = calls.agg(F.count(F.lit(1)).alias("total_calls"), F.count_if(F.col("callee_id").isNotNull()).alias("resolved_calls"), F.count_if(F.col("callee_id").isNull()).alias("unresolved_calls"))
    lang = language_distribution(functions).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n_functions")))).alias("languages"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(f).join(one(c), "k").join(one(lang), "k").drop("k")


def report(calls: DataFrame, functions: DataFrame, top: int = 10) -> str:
    """A text report of the graph, made from aggregates."""
    s = stats(calls, functions).first()
    lines = [f"Functions: {s.total_functions}", f"Files: {s.total_files}", f"Calls: {s.total_calls} ({s.resolved_calls} resolved, {s.unresolved_calls} unresolved)", "Languages:"]
    lines += [f"  {k}: {v}" for k, v in sorted((s.languages or {}).items())]
    lines += ["Most connected:"] + [f"  {r['name']} ({r['degree']})" for r in most_complex(calls, functions, top).collect()]
    return "\n".join(lines)


def peel(calls: DataFrame, nodes: DataFrame | None = None, most_levels: int = 10_000, tables: int = 50) -> tuple[DataFrame, DataFrame]:
    """Kahn's levels of nodes (id; the ends of the calls, if not given) by calls, and the nodes that remain because they lie on or behind a cycle.

    A node's level is the length of the longest path to it. One job per level; RuntimeError if most_levels do not end it."""
    # partitioned by src once: the levels below ship the nodes that become ready, not the calls
    e = held(dealt(edges(calls).select("src", "dst"), "src").dropDuplicates(["src", "dst"]))
    needs = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("needs"))
    every = e.select(F.col("src").alias("id")).distinct().join(needs, "id", "full") if nodes is None else nodes.select("id").distinct().join(needs, "id", "left")
    # the nodes without a level, with the calls to them that are still open; a level writes those that stay
    state = cut(every.select("id", F.coalesce("needs", F.lit(0)).alias("needs")))
    none = state.select("id", F.lit(None).cast("int").alias("level")).limit(0)
    done: list[DataFrame] = []
    for level in range(most_levels + 1):
        ready = state.where("needs = 0").select("id")
        if ready.isEmpty():
            break
        if level == most_levels:
            raise RuntimeError(f"the call graph has more than {most_levels} levels")
        done.append(ready.withColumn("level", F.lit(level)))
        if len(done) > tables:
            done = [cut(union_all(done))]
        met = e.join(ready.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("met"))
        state = cut(state.where("needs > 0").join(met, "id", "left").select("id", (F.col("needs") - F.coalesce("met", F.lit(0))).alias("needs")))
    return union_all(done) if done else none, state.select("id")


def union_all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def has_cycles(calls: DataFrame, functions: DataFrame) -> bool:
    return not peel(calls, functions)[1].isEmpty()


def topological_levels(calls: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """id and level of every function (or of the ends of all calls); ValueError if the graph has a cycle. Order by level, id for a sequence."""
    levels, left = peel(calls, functions)
    if not left.isEmpty():
        raise ValueError("the call graph has a cycle")
    return levels


def tarjan(nodes: list, pairs: list[tuple]) -> dict:
    """Strong component of every node, named by its least member; iterative."""
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    index, low, on, stack, out, count = {}, {}, set(), [], {}, 0
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(after.get(root, ())))]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(after.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    name = min(part)
                    out.update(dict.fromkeys(part, name))
    return out


def reach_min(e: DataFrame, label: DataFrame) -> DataFrame:
    """label (id, low) where low is the least label over all nodes from which id can be reached. Only what moved is sent on."""
    label = label.withColumn("moved", F.lit(True))
    while True:
        step = e.join(label.where("moved").select(F.col("id").alias("src"), "low"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("low").alias("new"))
        label = cut(label.join(step, "id", "left").select("id", F.least("low", F.coalesce("new", "low")).alias("low"), (F.coalesce("new", "low") < F.col("low")).alias("moved")))
        if label.where("moved").isEmpty():
            return label.drop("moved")


def trimmed(e: DataFrame, rounds: int = 3) -> DataFrame:
    """e (src, dst) without calls of nodes that nobody calls and calls to nodes that call nobody: both are on no cycle.

    The nodes are counted first, so that a graph of which a tenth or less would go is not written again."""
    for _ in range(rounds):
        calling, called = e.select(F.col("src").alias("id")).distinct().withColumn("a", F.lit(1)), e.select(F.col("dst").alias("id")).distinct().withColumn("b", F.lit(1))
        n, one_way = calling.join(called, "id", "full").agg(F.count(F.lit(1)), F.count_if(F.col("a").isNull() | F.col("b").isNull())).first()
        if one_way * 10 <= n:
            break
        e = e.join(called.select(F.col("id").alias("src")), "src", "left_semi").join(calling.select(F.col("id").alias("dst")), "dst", "left_semi")
        e = held(dealt(e, "src"))
    return e


def thinned(e: DataFrame) -> DataFrame:
    """At most four calls of every node: to its least and greatest callee, from its least and greatest caller."""
    away = e.groupBy("src").agg(F.min("dst").alias("a"), F.max("dst").alias("b")).select("src", F.explode(F.array("a", "b")).alias("dst"))
    back = e.groupBy("dst").agg(F.min("src").alias("a"), F.max("src").alias("b")).select(F.explode(F.array("a", "b")).alias("src"), "dst")
    return held(dealt(away.unionByName(back), "src").dropDuplicates(["src", "dst"]))


def coloured(e: DataFrame) -> DataFrame:
    """id and component of the strong components of e that hold the least node that reaches them; every e has one at least.

    Every node takes the least id that reaches it; within a colour, what reaches the node of that id is its component."""
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    color = reach_min(e, nodes.withColumn("low", F.col("id")))
    own = lambda k: color.select(F.col("id").alias(k), F.col("low").alias("c" + k))
    inside = e.join(own("src"), "src").join(own("dst"), "dst").where("csrc = cdst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    back = reach_back(held(dealt(inside, "src")), color.select("id", F.when(F.col("id") == F.col("low"), F.col("low")).alias("low")))
    return cut(back.where("low is not null").select("id", F.col("low").alias("component")))


def rings(e: DataFrame, driver_edges: int) -> tuple[DataFrame, DataFrame]:
    """Where every src has one dst: id and component of the nodes on cycles, or the calls among few nodes that hold all cycles.

    Paths are doubled, so a path of n calls takes log2(n) rounds; after each, only ends of paths stay, as every node on
    a cycle is one. When all stay they are on cycles, and when no least id along the paths moves it is the cycle's."""
    at = cut(e.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.col("src").alias("low")))
    n, none = at.count(), e.limit(0)
    while n:
        far = at.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("low").alias("then"))
        both = at.join(far, "to").select("id", F.col("next").alias("to"), F.least("low", "then").alias("low"), (F.col("then") < F.col("low")).alias("moved"))
        both = cut(both)
        stay = cut(both.join(both.select(F.col("to").alias("id")).distinct(), "id", "left_semi"))
        m, moved = stay.count(), not stay.where("moved").isEmpty()
        if m <= driver_edges:
            return none, cut(e.join(stay.select(F.col("id").alias("src")), "src", "left_semi"))
        if m == n and not moved:
            break
        at, n = stay.drop("moved"), m
    return at.select("id", F.col("low").alias("component")), none


def contracted(e: DataFrame, driver_edges: int) -> tuple[list[DataFrame], DataFrame]:
    """Maps (id, component), to be followed one after the other, and the at most driver_edges calls that are left between what they name.

    A graph of many calls is thinned first: what is strongly connected by a few calls of each node is so by all, and becomes
    one node, named by its least. Where that does not halve the calls, all are coloured, and the components found are final."""
    maps, thin = [], True
    while e.count() > driver_edges:
        e = trimmed(e)
        n, per_src = e.count(), e.select("src").distinct().count()
        if n <= driver_edges:
            break
        if per_src == n:
            part, e = rings(e, driver_edges)
            return [*maps, part], e
        few = thinned(e) if thin else e
        thin = thin and few.count() < n / 2
        part = coloured(few if thin else e)
        maps.append(part)
        if thin:
            name = lambda k: part.select(F.col("id").alias(k), F.col("component").alias("c" + k))  # noqa: B023, E731
            both = e.join(name("src"), "src", "left").select(F.coalesce("csrc", "src").alias("src"), "dst").join(name("dst"), "dst", "left").select("src", F.coalesce("cdst", "dst").alias("dst"))
            e = held(dealt(both.where("src <> dst").distinct(), "src"))
            thin = e.count() < n / 2
        else:
            e = cut(e.join(part.select(F.col("id").alias("src")), "src", "left_anti").join(part.select(F.col("id").alias("dst")), "dst", "left_anti"))
            thin = True
    return maps, e


def strong_components(calls: DataFrame, functions: DataFrame, driver_edges: int = 500_000) -> DataFrame:
    """id and component (its least member).

    The edges are counted. Up to driver_edges of them, Tarjan's algorithm runs on the driver. A larger graph is
    made smaller first: by doubled paths if no node calls two others, else by contraction and colouring."""
    e = held(dealt(edges(calls).select("src", "dst").where("src <> dst"), "src").dropDuplicates(["src", "dst"]))
    out = functions.select("id").distinct().withColumn("component", F.col("id"))
    maps, e = contracted(e, driver_edges)
    for part in maps:
        out = out.join(part.select(F.col("id").alias("component"), F.col("component").alias("next")), "component", "left").select("id", F.coalesce("next", "component").alias("component"))
    ends = e.collect()
    of = tarjan(sorted({x for r in ends for x in r}), [tuple(r) for r in ends])
    kind = functions.schema["id"].dataType.simpleString()
    found = functions.sparkSession.createDataFrame([(a, b) for a, b in of.items() if a != b], f"component {kind}, next {kind}")
    return out.join(found, "component", "left").select("id", F.coalesce("next", "component").alias("component"))


def reach_back(e: DataFrame, marks: DataFrame) -> DataFrame:
    """marks (id, low or null) where unmarked nodes take the mark of a marked node that reaches them along e. Only new marks are sent on."""
    marks = marks.withColumn("moved", F.col("low").isNotNull())
    while True:
        step = e.join(marks.where("moved").select(F.col("id").alias("src"), "low"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("low").alias("new"))
        marks = cut(marks.join(step, "id", "left").select("id", F.coalesce("low", "new").alias("low"), (F.col("low").isNull() & F.col("new").isNotNull()).alias("moved")))
        if marks.where("moved").isEmpty():
            return marks.drop("moved")


def cycles(calls: DataFrame, longest: int = 6) -> DataFrame:
    """Elementary cycles of up to `longest` functions, each once, rotated to start at its least id: path, length."""
    e = cut(edges(calls).select("src", "dst").distinct())
    done = e.where("src = dst").select(F.array("src").alias("path"))
    open_ = cut(e.where("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path")))
    for _ in range(2, longest + 1):
        grown = open_.join(e.select(F.col("src").alias("last"), "dst"), "last")
        done = done.unionByName(grown.where("dst = first").select("path"))
        longer = grown.where("dst > first").where(~F.array_contains("path", F.col("dst")))
        open_ = cut(longer.select("first", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path")))
        if open_.isEmpty():
            break
    return done.withColumn("length", F.size("path"))


def render_tree(pairs: list[tuple], names: dict, root, depth: int) -> dict:
    """Nested {name, children} below root by depth-first search with one visited set, as a display."""
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    seen = {root}

    top = {"name": names.get(root, str(root)), "children": []}
    stack = [(top, iter(sorted(after.get(root, ()))), depth)]  # no recursion: a chain may be longer than Python's stack
    while stack:
        tree, rest, left = stack[-1]
        k = next((x for x in rest if x not in seen), None) if left else None
        if k is None:
            stack.pop()
            continue
        seen.add(k)
        tree["children"].append({"name": names.get(k, str(k)), "children": []})
        stack.append((tree["children"][-1], iter(sorted(after.get(k, ()))), left - 1))
    return top


def indented(tree: dict, level: int = 0) -> str:
    lines, stack = [], [(tree, level)]
    while stack:
        node, at = stack.pop()
        lines.append("  " * at + node["name"])
        stack += [(k, at + 1) for k in reversed(node["children"])]
    return "\n".join(lines)


def call_tree(calls: DataFrame, functions: DataFrame, symbol: str, depth: int, direction: str = "callees", most_edges: int = 100_000) -> dict:
    """The nested tree of one symbol; the first overload is the centre; {} if it is unknown.

    Only the edges within `depth` of the centre come to the driver, and are counted before: a display of more than
    most_edges is refused (ValueError), as bfs() gives the same functions as a table of any size."""
    centre = find_by_name(functions, symbol).orderBy("file_path", "line_start", "id").first()
    if centre is None:
        return {}
    start = functions.where(F.col("id") == centre["id"]).select("id")
    near = bfs(calls, start, depth, direction)
    e = edges(calls).select("src", "dst").distinct()
    if direction == "callers":
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    inner = near.where(F.col("depth") < depth).select(F.col("id").alias("src"))
    inner_edges = cut(e.join(inner, "src", "left_semi"))
    n = inner_edges.count()
    if n > most_edges:
        raise ValueError(f"a tree of {n} calls is no display; use bfs, or a smaller depth")
    pairs = [tuple(r) for r in inner_edges.collect()]
    names = dict(functions.join(near.select("id"), "id", "left_semi").select("id", "name").collect())
    return render_tree(pairs, names, centre["id"], depth)


def entities(functions: DataFrame, classes: DataFrame, name: str | None = None) -> DataFrame:
    """Functions and classes in one table with `kind`, optionally of one name."""
    both = functions.withColumn("kind", F.lit("function")).unionByName(classes.withColumn("kind", F.lit("class")), allowMissingColumns=True)
    return both if name is None else both.where(F.col("name") == name)


def class_members(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """class_id and class_name with the row of each member function."""
    m = classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"), F.explode("member_functions").alias("id"))
    return m.join(functions, "id")


def strong_has_cycle(calls: DataFrame) -> bool:
    """Whether any function reaches itself: a loop, or a strong component of more than one."""
    e = edges(calls)
    if not e.where("src = dst").isEmpty():
        return True
    nodes = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    return not strong_components(calls, nodes).where("id <> component").isEmpty()
