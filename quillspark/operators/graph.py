"""Measures of an undirected graph given as edges (src, dst, weight)."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed, discard


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst", *(["weight"] if "weight" in edges.columns else [])).where("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["weight"] if "weight" in edges.columns else [])))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, density of the undirected view (0 with fewer than two nodes)."""
    n, m = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(m).select("nodes", "edges", F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(F.lit(0.0)).alias("density"))  # one row by one row


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree (different neighbours) and centrality, the degree's share of all other nodes."""
    out = both_ways(edges).select("src", "dst").distinct().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return out.crossJoin(out.agg(F.count("*").alias("n"))).select("node", "degree", (F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1))).alias("centrality"))  # one row on the right


def top_central(scores: DataFrame, score: str, k: int = 10) -> DataFrame:
    """The k nodes of highest score, ties by node."""
    return scores.orderBy(F.desc(score), "node").limit(k)


def related(edges: DataFrame, node: str, top: int = 10, directed: bool = False) -> DataFrame:
    """Neighbours of a node (those it points to if ``directed``), heaviest edge first, then by name."""
    e = edges.select("src", "dst", "weight") if directed else both_ways(edges)
    near = e.where(F.col("src") == node).groupBy(F.col("dst").alias("node")).agg(F.max("weight").alias("weight"))
    return near.orderBy(F.desc("weight"), "node").limit(top)


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node): labels spread to neighbours and jump to their
    label's label, until none moves."""
    e = checkpointed(both_ways(edges).select("src", "dst").distinct())
    label = checkpointed(e.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:  # ends: labels only get smaller
        near = e.join(label, e.dst == label.node).groupBy("src").agg(F.min("component").alias("near"))
        moved = label.join(near, label.node == near.src).select("node", "component", F.least("component", "near").alias("to"))
        jump = label.select(F.col("node").alias("to"), F.col("component").alias("far"))
        after = checkpointed(moved.join(jump, "to").select("node", F.least("to", "far").alias("component"), F.col("component").alias("was")))
        discard(label)
        label = after
        if after.where("was <> component").isEmpty():
            discard(e)
            return label.select("node", "component")


def roots(links: DataFrame) -> DataFrame:
    """node, root of links (node, to) that lead from a node to one other and never in a circle.

    Pointer doubling: in every round a node points to where its target points, so a chain of
    n links takes log2(n) rounds; nodes that have arrived at a root are joined no more.
    """
    at = checkpointed(links.select("node", "to", F.lit(True).alias("moved")), "links")
    while not at.where("moved").isEmpty():
        further = at.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumped = at.where("moved").join(further, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
        old, at = at, checkpointed(at.where("not moved").unionByName(jumped), "links")
        discard(old)
    return at.select("node", F.col("to").alias("root"))


def distances(edges: DataFrame, sources: DataFrame, depth: int | None = None, directed: bool = False) -> DataFrame:
    """source, node, distance, via (the smallest node before it on a shortest path), up to ``depth`` steps if it is given."""
    e = checkpointed((edges.select("src", "dst") if directed else both_ways(edges).select("src", "dst")).distinct())
    seen = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("distance"), F.lit(None).cast(sources.schema["node"].dataType).alias("via"))
    front = seen = checkpointed(seen)
    for step in count(1) if depth is None else range(1, depth + 1):  # ends: every front holds new nodes
        reach = front.select("source", F.col("node").alias("src")).join(e, "src").groupBy("source", F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        front = checkpointed(reach.join(seen.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(step).alias("distance"), "via"))
        if front.isEmpty():
            break
        old, seen = seen, checkpointed(seen.unionByName(front))
        discard(old)
    discard(e, *([] if front is seen else [front]))
    return seen


def shortest_path(edges: DataFrame, sources: DataFrame, targets: DataFrame, directed: bool = True) -> DataFrame:
    """path (an array of nodes; no row if there is none): the shortest path from any of
    ``sources`` (node) to any of ``targets``: fewest steps, then the smallest nodes in
    order.  One search from all sources; a node keeps the smallest of its paths."""
    e = checkpointed((edges.select("src", "dst") if directed else both_ways(edges).select("src", "dst")).distinct())
    aims = checkpointed(targets.select("node").distinct())
    front = seen = checkpointed(sources.select("node").distinct().withColumn("path", F.array("node")))
    while True:  # ends: every front holds new nodes
        hit = front.join(aims, "node", "left_semi").orderBy("path").limit(1).select("path")
        if front.isEmpty() or not hit.isEmpty():
            return hit
        reach = front.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("path").alias("before"))
        front = checkpointed(reach.join(seen.select("node"), "node", "left_anti").select("node", F.array_append("before", F.col("node")).alias("path")))
        old, seen = seen, checkpointed(seen.select("node").unionByName(front.select("node")))
        discard(old)


#: Edges (both ways) of a graph that every task may hold, to search it from its share of the nodes.
HELD_EDGES = 2_000_000


def _linked(edges: DataFrame) -> DataFrame:
    """src, dst of every edge both ways, each once, stored."""
    return checkpointed(both_ways(edges).select("src", "dst").distinct(), "edges")


def _per_source(e: DataFrame, measure, schema: str, size: DataFrame | None = None) -> DataFrame | None:
    """``measure(neighbours, source)`` gives rows of every node as a source, in tasks that hold
    the whole graph (as ``_linked`` gives it) as lists of numbers; None if it has too many edges.
    With ``size`` (node, size) the sizes of all nodes are a third argument."""
    if e.count() > HELD_EDGES:
        return None
    held = e.toArrow()  # at most HELD_EDGES rows
    names = sorted(set(held.column("src").to_pylist()))
    number = {n: i for i, n in enumerate(names)}
    near: list[list[int]] = [[] for _ in names]
    for a, b in zip(held.column("src").to_pylist(), held.column("dst").to_pylist(), strict=True):
        near[number[a]].append(number[b])
    more = []
    if size is not None:
        sizes = size.join(e.select(F.col("src").alias("node")), "node", "left_semi").toArrow()  # no more than the edges
        of = dict(zip(sizes.column("node").to_pylist(), sizes.column("size").to_pylist(), strict=True))
        more = [[of[n] for n in names]]
    spark = e.sparkSession
    graph = spark.sparkContext.broadcast((names, near, more))

    def run(batches):
        import pyarrow as pa

        names, near, more = graph.value
        for batch in batches:
            rows = [x for s in batch.column(0).to_pylist() for x in measure(near, s, *more)]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in rows]), pa.array([float(x) for _, x in rows], pa.float64())], names=["node", "x"])

    return spark.range(0, len(names), 1, max(1, min(len(names) // 16, 512))).mapInArrow(run, schema)


def _steps(near: list[list[int]], source: int) -> tuple[list[int], dict[int, int]]:
    """Nodes in the order of a breadth-first search, and their distances."""
    order, far = [source], {source: 0}
    for v in order:
        for w in near[v]:
            if w not in far:
                far[w] = far[v] + 1
                order.append(w)
    return order, far


def _closeness_of(near: list[list[int]], source: int) -> list[tuple[int, float]]:
    far = _steps(near, source)[1]
    r, d = len(far) - 1, sum(far.values())
    return [(source, r / max(len(near) - 1, 1) * r / d if d else 0.0)]


def _dependencies_of(near: list[list[int]], source: int, size: list[int]) -> list[tuple[int, float]]:
    """What every node adds to the paths from one source, itself and the ends counted by size (0 is left out)."""
    order, far = _steps(near, source)
    paths, dep = dict.fromkeys(order, 0.0), dict.fromkeys(order, 0.0)
    paths[source] = 1.0
    for v in order:
        for w in near[v]:
            if far[w] == far[v] + 1:
                paths[w] += paths[v]
    for w in reversed(order):
        for v in near[w]:
            if far[v] == far[w] - 1:
                dep[v] += paths[v] / paths[w] * (size[w] + dep[w])
    return [(v, x * size[source]) for v, x in dep.items() if x and v != source]


def closeness(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """node, closeness: (r / (n - 1)) * (r / sum of distances) for the r nodes reached.  A
    graph of up to ``HELD_EDGES`` edges is searched from each node within tasks, a larger one by joins."""
    kind = edges.schema["src"].dataType.simpleString()
    local = _per_source(_linked(edges), _closeness_of, f"node {kind}, x double") if depth is None else None
    if local is not None:
        return local.select("node", F.round("x", 9).alias("closeness"))
    nodes = both_ways(edges).select(F.col("src").alias("node")).distinct()
    n = nodes.count()
    d = distances(edges, nodes, depth).where("distance > 0").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("r"), F.sum("distance").alias("d"))
    return d.select("node", F.round(F.col("r") / F.lit(max(n - 1, 1)) * F.col("r") / F.col("d"), 9).alias("closeness"))


def betweenness(edges: DataFrame, depth: int | None = None, normalised: bool = True) -> DataFrame:
    """node, betweenness: the share of pairs of other nodes whose shortest paths lead over
    a node (each undirected pair once; ``normalised``: by the number of such pairs).

    Trees that hang on a graph of more than ``FEW_EDGES`` are folded first (see ``_folded``): all
    paths between a node's branches, and from them to the rest of its component, lead over it, so
    they are counted by sizes.  Only what is left is searched as in ``closeness``, every node
    standing for as many as were folded into it.
    """
    kind = edges.schema["src"].dataType.simpleString()
    e = _linked(edges)
    nodes = e.select(F.col("src").alias("node")).distinct()
    one, none = F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("hung")
    if depth is None:
        core, size, nodes = e, nodes.select("node", one), nodes.select("node", none)
        if e.count() > FEW_EDGES:
            folded, core = _folded(e)
            size = checkpointed(folded.where("root = node").select("node", "size"), "nodes")
            t = (F.col("size") - 1).cast("double")
            nodes = folded.select("node", ((t * t - F.col("squares")) / 2 + t * (F.col("total") - F.col("size"))).alias("hung"))
        local = _per_source(core, _dependencies_of, f"node {kind}, x double", size)
        dep = local.groupBy("node").agg((F.sum("x") / 2).alias("b")) if local is not None else _dependencies_by_joins(core, None, size)
    else:
        dep, nodes = _dependencies_by_joins(e, depth, nodes.select("node", one)), nodes.select("node", none)
    n = nodes.agg(F.count("*").alias("n"))
    b = F.col("hung") + F.coalesce("b", F.lit(0.0))
    share = b if not normalised else F.when(F.col("n") > 2, b * 2.0 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(b)
    return nodes.join(dep, "node", "left").crossJoin(n).select("node", F.round(share, 9).alias("betweenness"))  # one row on the right


#: Edges (both ways) up to which a graph is searched from each node as it is.
FEW_EDGES = 5_000
#: Ends of branches are folded as long as they are one of so many edges at least.
FOLDED_OF = 10


def _folded(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with one neighbour are folded into it, round by round, while there are many of them.

    The first table has node, size (nodes folded into it, and itself), squares (the sum of the
    squared sizes of its branches), root (the node that is left where it was folded to in the
    end) and total (nodes of its component); the second the edges that are left (as ``_linked``).
    """
    left = checkpointed(e.select(F.col("src").alias("node")).distinct().select("node", F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("squares")), "nodes")
    gone: list[DataFrame] = []
    while True:  # ends: every round takes a share of the edges
        ends = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"), F.min("dst").alias("to")).where("d = 1").select("node", "to")
        pair = ends.select(F.col("node").alias("to"), F.lit(True).alias("pair"))
        leaf = checkpointed(ends.join(pair, "to", "left").where("pair is null or node > to").join(left, "node").select("node", "to", "size", "squares"), "leaves")
        n = leaf.count()
        if not n or 2 * n * FOLDED_OF < e.count():
            discard(leaf)
            break
        gone.append(leaf)
        more = leaf.groupBy(F.col("to").alias("node")).agg(F.sum("size").alias("s"), F.sum(F.col("size") * F.col("size")).alias("q"))
        old, left = left, checkpointed(left.join(leaf.select("node"), "node", "left_anti").join(more, "node", "left").select("node", (F.col("size") + F.coalesce("s", F.lit(0))).alias("size"), (F.col("squares") + F.coalesce("q", F.lit(0))).alias("squares")), "nodes")
        was, e = e, checkpointed(e.join(leaf.select(F.col("node").alias("src")), "src", "left_anti").join(leaf.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "edges")
        discard(old, was)
    core = left.withColumn("component", F.col("node"))
    if not e.isEmpty():
        core = left.join(components(e), "node", "left").select(*left.columns, F.coalesce("component", "node").alias("component"))
    core = checkpointed(core, "nodes")
    total = checkpointed(core.groupBy("component").agg(F.sum("size").alias("total")), "totals")
    core = checkpointed(core.join(total, "component").select("node", "size", "squares", F.col("node").alias("root"), "total"), "nodes")
    discard(left)
    if not gone:
        return core, e
    hung = reduce(DataFrame.unionByName, gone)
    hung = hung.join(roots(hung.select("node", "to")), "node").select("node", "size", "squares", "root")
    return core.unionByName(hung.join(core.select("root", "total"), "root").select(*core.columns)), e


def _dependencies_by_joins(e: DataFrame, depth: int | None, size: DataFrame) -> DataFrame:
    """node, b: shortest paths are counted forwards and dependencies summed backwards, a
    level of distance at a time, for all sources together; every node counts by its size."""
    nodes = e.select(F.col("src").alias("node")).distinct()
    d = checkpointed(distances(e, nodes, depth).select("source", "node", "distance"))
    far = d.agg(F.max("distance")).collect()[0][0] or 0
    step = checkpointed(d.select("source", F.col("node").alias("src"), F.col("distance").alias("k")).join(e, "src").join(d.select("source", F.col("node").alias("dst"), F.col("distance").alias("k2")), ["source", "dst"]).where("k2 = k + 1").select("source", "src", "dst", "k2"))
    level = d.where("distance = 0").select("source", "node", F.lit(1.0).alias("paths"))
    paths = level
    for k in range(1, far + 1):
        level = checkpointed(step.where(F.col("k2") == k).join(level.withColumnRenamed("node", "src"), ["source", "src"]).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths")))
        paths = paths.unionByName(level)
    paths = checkpointed(paths)
    a, b = paths.select("source", F.col("node").alias("src"), F.col("paths").alias("pa")), paths.select("source", F.col("node").alias("dst"), F.col("paths").alias("pb"))
    ends = size.select(F.col("node").alias("dst"), "size")
    shared = checkpointed(step.join(a, ["source", "src"]).join(b, ["source", "dst"]).join(ends, "dst").select("source", "src", "dst", "k2", "size", (F.col("pa") / F.col("pb")).alias("share")))
    total, below = nodes.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dep")).limit(0), None
    for k in range(far, 0, -1):
        s = shared.where(F.col("k2") == k)
        s = s.withColumn("dep", F.lit(0.0)) if below is None else s.join(below.select("source", F.col("node").alias("dst"), "dep"), ["source", "dst"], "left").na.fill(0.0, ["dep"])
        below = checkpointed(s.groupBy("source", F.col("src").alias("node")).agg(F.sum(F.col("share") * (F.col("size") + F.col("dep"))).alias("dep")))
        total = total.unionByName(below)
    return total.where("source <> node").join(size.withColumnRenamed("node", "source"), "source").groupBy("node").agg((F.sum(F.col("dep") * F.col("size")) / 2).alias("b"))


#: A move must raise the gain by so much of the node's weight.
LEAST_GAIN = 1e-9
#: Rounds in which every node may move; after them ever fewer do in one round.
FREE = 16


def _settled(e: DataFrame, m2: float) -> tuple[DataFrame, bool]:
    """node, community after rounds of local moving on edges (src, dst, weight, both ways;
    a node's own weight is an edge to itself), and whether any node has moved.

    A node wishes for the neighbouring community of largest modularity gain.  Of two
    neighbours that wish, the later one in the round's random order stays if the one leaves
    where the other goes: so neighbours never trade places or run after each other.
    """
    held = checkpointed(e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "nodes")
    label = checkpointed(held.withColumn("community", F.col("node")), "label")
    for turn in count():  # ends: ever fewer nodes move in one turn, and a move alone always gains
        where = label.select(F.col("node").alias("dst"), "community")
        pull = e.where("src <> dst").join(where, "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("w"))
        total = label.groupBy("community").agg(F.sum("k").alias("tot"))
        own = label.select("node", "k", F.col("community").alias("own"))
        offers = pull.join(total, "community").join(own, "node")
        stays = F.col("community") == F.col("own")
        gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0)) / m2
        best = offers.groupBy("node").agg(F.max(F.when(~stays, F.struct(gain.alias("gain"), (-F.hash("community").cast("long")).alias("h"), F.col("community").alias("to")))).alias("best"), F.max(F.when(stays, gain)).alias("now"))
        alone = own.join(total.withColumnRenamed("community", "own"), "own").select("node", "k", "own", (-F.col("k") * (F.col("tot") - F.col("k")) / m2).alias("without"))
        wish = best.join(alone, "node").where(F.col("best.gain") > F.coalesce("now", "without") + LEAST_GAIN * F.col("k"))
        order = F.xxhash64("node", F.lit(turn))
        wish = checkpointed(wish.select("node", "own", F.col("best.to").alias("to"), order.alias("o")), "wishes")
        if wish.isEmpty():
            discard(held, wish)
            return label.select("node", "community"), turn > 0
        mine, theirs = wish.select(F.col("node").alias("src"), "own", "to", "o"), wish.select(F.col("node").alias("dst"), F.col("own").alias("left"), F.col("to").alias("goes"), F.col("o").alias("before"))
        rivals = e.where("src <> dst").join(mine, "src").join(theirs, "dst").where("before < o and (left = to or goes = own)")
        moves = wish.join(rivals.select(F.col("src").alias("node")).distinct(), "node", "left_anti").where(F.pmod(F.hash("node", F.lit(turn)), F.lit(1 + max(0, turn - FREE) // 2)) == 0)
        old, label = label, checkpointed(label.join(moves.select("node", "to"), "node", "left").select("node", "k", F.coalesce("to", "community").alias("community")), "label")
        discard(old, wish)


def communities(edges: DataFrame) -> DataFrame:
    """node, community by modularity, in the manner of Louvain: nodes move to the neighbouring
    community of largest gain until none gains (see ``_settled``); then every community becomes
    one node whose edges are the sums of its members', and the smaller graph is settled in turn,
    until nothing moves.  A community is named by its smallest node."""
    e = both_ways(edges).groupBy("src", "dst").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    e = checkpointed(e, "edges")
    return _coarsened(e, checkpointed(e.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")), "members"))


def communities_of_groups(members: DataFrame) -> DataFrame:
    """node, community as ``communities`` gives them, of the graph in which an edge weighs as many
    groups as its two nodes share (members: node, group); nodes without an edge are left out.

    A group of n has n * (n - 1) / 2 edges, so they are not made where nodes are in the very same
    groups: those are one node from the start, as every partition of largest modularity holds
    them together.  Two of them, of weight k each and w groups, in different communities would
    gain 2 * (w - k * k / m2) by moving to each other's in turn, and that is above 0: m2 is the
    sum of n * (n - 1) over all groups, k of n - 1 over w of them, so k * k < w * m2.
    """
    own = members.where("node is not null").select("node", "group").distinct()
    large = own.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    held = checkpointed(own.join(large, "group").groupBy("node").agg(F.sort_array(F.collect_list("group")).alias("groups")), "nodes")
    one = checkpointed(held.groupBy("groups").agg(F.min("node").alias("community"), F.count("*").cast("double").alias("c")), "nodes")
    member = checkpointed(held.join(one, "groups").select("node", "community"), "members")
    a, b = (one.select(F.col("community").alias(x), F.col("c").alias(f"c_{x}"), F.explode("groups").alias("group")) for x in ("src", "dst"))
    between = a.join(b, "group").where("src <> dst").groupBy("src", "dst").agg(F.sum(F.col("c_src") * F.col("c_dst")).alias("weight"))
    within = one.where("c > 1").select(F.col("community").alias("src"), F.col("community").alias("dst"), (F.col("c") * (F.col("c") - 1) * F.size("groups")).alias("weight"))
    e = checkpointed(between.unionByName(within), "edges")
    discard(held, one)
    return _coarsened(e, member)


def _coarsened(e: DataFrame, member: DataFrame) -> DataFrame:
    """Communities of stored edges (as in ``_settled``) between the nodes that the stored
    ``member`` (node, community) names as communities at the start."""
    m2 = e.agg(F.sum("weight")).first()[0]
    while m2:
        label, moved = _settled(e, m2)
        if not moved:
            break
        a, b = label.select(F.col("node").alias("src"), F.col("community").alias("a")), label.select(F.col("node").alias("dst"), F.col("community").alias("b"))
        merged = checkpointed(e.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")), "edges")
        joined = checkpointed(member.withColumnRenamed("community", "old").join(label.withColumnRenamed("node", "old"), "old").select("node", "community"), "members")
        discard(e, member)
        e, member = merged, joined
    discard(e)
    first = member.groupBy("community").agg(F.min("node").alias("least"))
    return member.join(first, "community").select("node", F.col("least").alias("community"))


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    w = both_ways(edges)
    total = w.agg(F.sum("weight").alias("m2"))
    a, b = label.select(F.col("node").alias("src"), F.col("community").alias("ca")), label.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    inside = w.join(a, "src").join(b, "dst").groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inner"), F.sum("weight").alias("deg"))
    return inside.crossJoin(total).agg(F.sum(F.col("inner") / F.col("m2") - (F.col("deg") / F.col("m2")) ** 2).alias("modularity"))  # one row on the right
