"""Graph analytics on edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import glob_regex, thousandths
from ..session import Growing, cut, parts_for, running_sums, store
from .components import connected_components
from .kernels import strong_components_in_task
from .kernels import structure_matrix as structure_matrix_in_task

__all__ = ["affected", "arch_violations", "bottleneck", "bottleneck_static", "component_metrics", "connected_components", "container_edges", "curvature", "degrees", "event_chains", "hub_threshold", "modularity", "neighbours", "node_status", "pagerank", "personalized_pagerank", "reach", "shortest_paths", "strong_components", "structure_matrix", "transitive_closure"]


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) over distinct edges without self-loops."""
    e = edges.select("src", "dst").where("src != dst").distinct()
    both = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def curvature(edges: DataFrame) -> DataFrame:
    """(src, dst, curvature): 2 - outdegree(src) - indegree(dst), duplicates counted."""
    out = edges.groupBy("src").agg(F.count("*").alias("o"))
    into = edges.groupBy("dst").agg(F.count("*").alias("i"))
    return edges.select("src", "dst").join(out, "src").join(into, "dst").select("src", "dst", (2 - F.col("o") - F.col("i")).alias("curvature"))


def bottleneck(edges: DataFrame) -> DataFrame:
    """(node, score_x1000): how much of a node's distinct callers its distinct callees do not match."""
    d = degrees(edges).where("fan_in > 0")
    return d.select("node", thousandths(F.greatest(F.lit(0.0), 1 - F.col("fan_out") / F.col("fan_in"))).alias("score_x1000"))


def bottleneck_static(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return d.select("node", thousandths(F.log2(F.col("fan_in") + 1) * F.log2(F.col("fan_out") + 1)).alias("score_x1000"))


def coupling_volume(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, volume): (fan_in fan_out)^2 size over sizes (node, size)."""
    return degrees(edges).join(sizes, "node").select("node", (F.pow(F.col("fan_in") * F.col("fan_out"), F.lit(2)) * F.col("size")).cast("bigint").alias("volume"))


def component_metrics(edges: DataFrame, component: DataFrame, abstract: DataFrame | None = None) -> DataFrame:
    """(component, ca, ce, instability, abstractness, distance) over component (node, component) and abstract (node).

    Ca counts the distinct outside nodes that point in, Ce the distinct outside nodes pointed at.
    """
    ends = store(edges.select("src", "dst"), "edges")
    parts = parts_for(ends.count(), edges.sparkSession)
    named = ends.join(component.select(F.col("node").alias("src"), F.col("component").alias("cs")), "src").join(component.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst").where("cs != cd")
    outside = lambda c, node: named.select(F.col(c).alias("component"), node).repartition(parts, "component", node).distinct().groupBy("component")
    ca = outside("cd", "src").agg(F.count("src").alias("ca"))
    ce = outside("cs", "dst").agg(F.count("dst").alias("ce"))
    nodes = component.groupBy("component").agg(F.count("*").alias("nodes"))
    if abstract is None:
        share = nodes.select("component", F.lit(0.0).alias("a"))
    else:
        n = component.join(abstract.select("node").distinct(), "node").groupBy("component").agg(F.count("*").alias("k"))
        share = nodes.join(n, "component", "left").select("component", (F.coalesce("k", F.lit(0)) / F.col("nodes")).alias("a"))
    m = share.join(ca, "component", "left").join(ce, "component", "left").na.fill(0, ["ca", "ce"])
    i = F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(0.0)
    m = m.withColumn("i", i)
    return m.select("component", "ca", "ce", F.round("i", 4).alias("instability"), F.round("a", 4).alias("abstractness"), F.round(F.abs(F.col("a") + F.col("i") - 1), 4).alias("distance"))


def node_status(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(node, status): entry; connected if a resolved edge comes in; uncertain if only unresolved ones do; else orphan. edges: (src, dst, resolved)."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.bool_or("resolved").alias("sure"))
    n = nodes.select("node").join(into, "node", "left").join(entries.select("node").distinct().withColumn("e", F.lit(True)), "node", "left")
    return n.select("node", F.when(F.col("e"), "entry").when(F.col("sure"), "connected").when(F.col("sure").isNotNull(), "uncertain").otherwise("orphan").alias("status"))


def health(status: DataFrame) -> DataFrame:
    """One row: files, entries, connected, orphans, uncertain, and the share of connected files among those that are no entries in hundredths (100 without any)."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    t = status.agg(F.count("*").alias("files"), n("entry").alias("entries"), n("connected").alias("connected"), n("orphan").alias("orphans"), n("uncertain").alias("uncertain"))
    others = F.col("files") - F.col("entries")
    return t.withColumn("health_x100", F.when(others > 0, F.floor(F.col("connected") * 100 / others + 0.5)).otherwise(100).cast("bigint"))


def container_of(path: Column, depth: int = 3) -> Column:
    """The first ``depth`` folders of a path, or as many as it has."""
    folders = F.split(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/")
    return F.array_join(F.slice(folders, 1, depth), "/")


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Who points at the node, by its whole id or as the part after the last colon."""
    return edges.where((F.col("dst") == node) | F.endswith(F.col("dst"), F.lit(f":{node}"))).select("src", "dst").distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth): fewest steps from any seed (node) along the edges; a frontier join per step."""
    e = edges.select("src", "dst").distinct()
    front, step = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0))), 0
    known = Growing(front)
    while depth is None or step < depth:
        step += 1
        new = front.join(e, front.node == e.src).select(F.col("dst").alias("node")).distinct().join(known.df, "node", "left_anti")
        front = cut(new.withColumn("depth", F.lit(step)))
        if front.isEmpty():
            break
        known.add(front)
    return known.df


def affected(edges: DataFrame, changed: DataFrame, depth: int | None = None, tests: str = r"(^|/)(tests?|__tests__)/|\.(test|spec)\.") -> DataFrame:
    """(node, depth, is_test) of what depends on the changed nodes (node), the changed included."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, changed, depth).withColumn("is_test", F.col("node").cast("string").rlike(tests))


def shortest_paths(edges: DataFrame, sources: DataFrame, depth: int = 16) -> DataFrame:
    """(source, node, path): for every source (node) the first of the shortest paths to each node more than one step away."""
    e = edges.select("src", "dst").where("src != dst").distinct()
    front = sources.select(F.col("node").alias("source"), F.col("node").alias("at"), F.array("node").alias("path")).distinct()
    front = cut(front)
    known = Growing(front)
    for _ in range(depth):
        new = front.join(e, front.at == e.src).groupBy("source", F.col("dst").alias("at")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = cut(new.join(known.df, ["source", "at"], "left_anti"))
        if front.isEmpty():
            break
        known.add(front)
    return known.df.where(F.size("path") > 2).select("source", F.col("at").alias("node"), "path")


def arch_violations(edges: DataFrame, rules: list[tuple[str, str, str, bool]]) -> DataFrame:
    """(rule, src, dst) for rules (name, from glob, to glob, transitive)."""
    out = None
    for name, source, target, transitive in rules:
        pairs = transitive_closure(edges) if transitive else edges.select("src", "dst").distinct()
        own = pairs.where(F.col("src").rlike(glob_regex(source)) & F.col("dst").rlike(glob_regex(target))).select(F.lit(name).alias("rule"), "src", "dst")
        out = own if out is None else out.unionByName(own)
    return out


def transitive_closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(src, dst) of all pairs joined by a path, by squaring: as many rounds as the longest shortest path has bits."""
    total = cut(edges.select("src", "dst").distinct())
    n = total.count()
    for _ in range(max_rounds):
        hop = total.select(F.col("src").alias("a"), F.col("dst").alias("m")).join(total.select(F.col("src").alias("m"), F.col("dst").alias("b")), "m").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        total = cut(total.unionByName(hop).distinct())
        more = total.count()
        if more == n:
            return total
        n = more
    raise RuntimeError(f"no closure after {max_rounds} rounds")


def strong_components(edges: DataFrame, max_rounds: int = 100, one_task: int = 200_000) -> DataFrame:
    """(node, component): strongly connected components of two nodes or more, named by their least node.

    A graph of up to ``one_task`` edges goes to one task as a whole. Beyond that,
    colouring: every node takes the least node that reaches it as its colour. Within a colour, what
    reaches the node that gave it is one component; all colours yield theirs in the same round, and
    edges between colours or at found nodes drop out. Nodes that nothing enters or leaves go first.
    """
    rest = cut(edges.select("src", "dst").where("src != dst").distinct())
    if rest.limit(one_task + 1).count() <= one_task:
        return strong_components_in_task(rest.withColumn("g", F.lit(0))).drop("g")
    done = None
    for _ in range(max_rounds):
        n = rest.count()
        while n:  # trim
            rest = cut(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            left = rest.count()
            if left == n:
                break
            n = left
        if not n:
            break
        colour = cut(rest.select(F.col("src").alias("node")).distinct().withColumn("c", F.col("node")))
        moved = colour
        while not moved.isEmpty():
            seen = rest.join(moved, rest.src == moved.node).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("nc"))
            moved = cut(seen.join(colour, "node").where("nc < c").select("node", F.col("nc").alias("c")))
            colour = cut(colour.join(moved.withColumnRenamed("c", "nc"), "node", "left").select("node", F.coalesce("nc", "c").alias("c")))
        inside = rest.join(colour.withColumnsRenamed({"node": "src", "c": "cs"}), "src").join(colour.withColumnsRenamed({"node": "dst", "c": "cd"}), "dst").where("cs = cd").select("src", "dst")
        inside = cut(inside)
        own = reach(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = c").select("node")).select("node")
        found = cut(own.join(colour, "node").select("node", F.col("c").alias("component")))
        done = found if done is None else done.unionByName(found)
        gone = found.select("node")
        rest = cut(inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if done is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    sizes = done.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return done.join(sizes, "component").select("node", "component")


def structure_matrix(edges: DataFrame, group: str = "g", one_task: int = 200_000) -> DataFrame:
    """(group, node, position, level) as ``kernels.structure_matrix`` orders them; a graph of up to ``one_task`` edges goes to one task.

    Beyond that nodes are numbered in their order and strong components are one
    node each. The order takes the least node that waits for none, so a node
    comes in the turn of the greatest one among itself and what it waits for:
    by that one first, which goes ahead of all others of its turn, and these
    are a graph of their own, ordered in the same way. Every node has the path
    of its turns then, and the paths are sorted. A turn of up to ``one_task``
    rows is ordered in a task. Rounds are as many as steps lie on a longest way
    within a turn, so chains of many nodes take long.
    """
    sizes = edges.groupBy(group).agg(F.count("*").alias("_n"))
    large = [r[0] for r in sizes.where((F.col("_n") > one_task) & F.col(group).isNotNull()).select(group).collect()]
    if not large:
        return structure_matrix_in_task(edges, group)
    hit = F.coalesce(F.col(group).isin(large), F.lit(False))
    return structure_matrix_in_task(edges.where(~hit), group).unionByName(_large_matrix(edges.where(hit), group, one_task))


def _large_matrix(edges: DataFrame, group: str, one_task: int) -> DataFrame:
    e = store(edges.select(group, "src", "dst").distinct(), "edges")
    names = e.select(group, F.col("src").alias("node")).unionByName(e.select(group, F.col("dst").alias("node"))).distinct()
    nodes = store(running_sums(names, [], [F.col(group), F.col("node")], id=F.lit(1).cast("bigint")), "nodes")
    at = lambda end, number: nodes.select(group, F.col("node").alias(end), F.col("id").alias(number))
    ids = store(e.join(at("src", "a"), [group, "src"]).join(at("dst", "b"), [group, "dst"]).where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")), "ids")
    strong = store(strong_components(ids, one_task=one_task), "strong")
    home = lambda end: strong.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    within = ids
    if not strong.isEmpty():
        moved = ids.join(home("src"), "src", "left").join(home("dst"), "dst", "left")
        within = store(moved.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst")).where("src != dst").distinct(), "within")
    members = nodes.join(home("id"), "id", "left").select(group, "node", "id", F.coalesce("_id", "id").alias("c"))
    left, done = members.where("id = c").select("c", F.array().cast("array<bigint>").alias("path")), []
    while True:
        turns = _turns(within)
        done.append(left.join(turns, "c", "left_anti").select("c", F.array_append("path", F.col("c")).alias("path"), F.lit(0).cast("bigint").alias("sub")))
        if turns.isEmpty():
            break
        left = store(left.join(turns, "c").select("c", F.array_append("path", F.col("m")).alias("path")).withColumn("h", F.xxhash64("path")), "left")
        own = lambda end: left.select(F.col("c").alias(end), "h", F.element_at("path", -1).alias(f"_{end}"))  # noqa: B023, E731
        within = within.join(own("src"), "src").join(own("dst").drop("h"), "dst").where("_src = _dst").select("h", "src", "dst")
        rows = store(within.unionByName(left.select("h", F.col("c").alias("src"), F.col("c").alias("dst"))), "rows")  # a node without edges is one too
        over = store(rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > one_task).select("h"), "over")
        # turns whose hashes are equal are ordered together, which leaves the order within each as it is
        ready = structure_matrix_in_task(rows.join(over, "h", "left_anti"), "h").select(F.col("node").alias("c"), (F.col("position") + 1).alias("sub"))
        done.append(left.join(store(ready, "ready"), "c").select("c", "path", "sub"))
        if over.isEmpty():
            break
        left, within = left.join(over, "h", "left_semi").select("c", "path"), store(rows.join(over, "h", "left_semi").where("src != dst").select("src", "dst"), "within")
    ordered = done[0]
    for more in done[1:]:
        ordered = ordered.unionByName(more)
    out = running_sums(members.join(ordered, "c"), [group], [F.col("path"), F.col("sub"), F.col("id")], position=F.lit(1).cast("bigint"), level=(F.col("id") == F.col("c")).cast("bigint"))
    return out.select(group, "node", (F.col("position") - 1).alias("position"), (F.col("level") - 1).alias("level"))


def _turns(edges: DataFrame) -> DataFrame:
    """(c, m) of the nodes that wait for a greater one, directly or over others: the greatest."""
    moved = store(edges.groupBy(F.col("dst").alias("c")).agg(F.max("src").alias("m")).where("m > c"), "moved")
    known = moved
    while not moved.isEmpty():
        seen = edges.join(moved, edges.src == moved.c).groupBy("dst").agg(F.max("m").alias("m")).select(F.col("dst").alias("c"), "m")
        moved = store(seen.join(known.select("c", F.col("m").alias("_m")), "c", "left").where("m > coalesce(_m, c)").select("c", "m"), "moved")
        known = store(known.join(moved, "c", "left_anti").unionByName(moved), "known")
    return known


def cycle_records(components: DataFrame) -> DataFrame:
    """(id, size, members): the id is the start of the SHA-1 of the sorted members."""
    g = components.groupBy("component").agg(F.array_sort(F.collect_list(F.col("node").cast("string"))).alias("members"))
    return g.select(F.substring(F.sha1(F.array_join("members", "|").cast("binary")), 1, 12).alias("id"), F.size("members").alias("size"), "members")


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(id, size, members, path) of the strongly connected components of two nodes or more.

    The path is a shortest way round from the least member: the first in the
    order of its nodes. Only edges within components are walked, a step of all
    components at once.
    """
    found = cut(strong_components(edges))
    home = found.select(F.col("node").alias("dst"), F.col("component").alias("_to"))
    inner = edges.select("src", "dst").where("src != dst").distinct().join(found.select(F.col("node").alias("src"), "component"), "src").join(home, "dst").where("component = _to").select("component", "src", "dst")
    inner, records = cut(inner), cycle_records(found)
    ids = found.select("component", "node").groupBy("component").agg(F.array_sort(F.collect_list(F.col("node").cast("string"))).alias("members"))
    start = found.groupBy("component").agg(F.min("node").alias("node"))
    front = start.select("component", F.col("node").alias("at"), F.array(F.col("node").cast("string")).alias("path"), F.col("node").alias("first"))
    seen, rounds = Growing(cut(front.select("component", "at"))), []
    while True:
        step = front.join(inner.withColumnsRenamed({"component": "_c", "src": "_s"}), (F.col("component") == F.col("_c")) & (F.col("at") == F.col("_s")))
        step = cut(step.groupBy("component", "first", F.col("dst").alias("at")).agg(F.min(F.concat("path", F.array(F.col("dst").cast("string")))).alias("path")))
        rounds.append(step.where("at = first").select("component", "path"))
        closed = rounds[-1].select("component")
        front = cut(step.where("at != first").join(seen.df, ["component", "at"], "left_anti").join(closed, "component", "left_anti"))
        if front.isEmpty():
            break
        seen.add(front.select("component", "at"))
    done = rounds[0]
    for more in rounds[1:]:
        done = done.unionByName(more)
    return ids.join(done, "component").join(records, "members").select("id", "size", "members", "path")


def module_ranks(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 500) -> DataFrame:
    """(node, rank): PageRank until the ranks move by less than ``tolerance`` in all and stand (see ``_rank``), over the largest, to six digits."""
    e = edges.select("src", "dst").where("src != dst").distinct().withColumn("w", F.lit(1.0))
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst"))).distinct()
    n = nodes.count()
    ranks = _rank(e, nodes.withColumn("p", F.lit(1.0) / max(1, n)), rounds, damping, tolerance)
    most = ranks.agg(F.max("rank").alias("_most"))
    return ranks.join(F.broadcast(most), F.lit(True)).select("node", F.round(F.col("rank") / F.col("_most"), 6).alias("rank"))  # one row


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds; the rank of nodes without edges out is shared by all."""
    e = edges.select("src", "dst").where("src != dst").distinct()
    weighted = e.withColumn("w", F.lit(1.0))
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst"))).distinct()
    n = nodes.count()
    return _rank(weighted, nodes.withColumn("p", F.lit(1.0) / max(1, n)), rounds, damping, None)


def personalized_pagerank(edges: DataFrame, personal: DataFrame, rounds: int = 50, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank) on weighted edges (src, dst, w); lost and random mass goes to personal (node, boost), uniform where no boost is given."""
    e = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst"))).union(personal.select("node")).distinct()
    boosts = nodes.join(personal.groupBy("node").agg(F.sum("boost").alias("boost")), "node", "left").na.fill(0.0, ["boost"])
    total = boosts.agg(F.sum("boost"), F.count("*")).head()
    p = F.col("boost") / total[0] if total[0] else F.lit(1.0 / max(1, total[1]))
    return _rank(e, boosts.select("node", p.alias("p")), rounds, damping, tolerance)


def _rank(edges: DataFrame, base: DataFrame, rounds: int, damping: float, tolerance: float | None, steady: float = 1e-12) -> DataFrame:
    """Ranks after ``rounds``, or earlier with a tolerance: once they move by less than it in all, and none by more than ``steady`` of the largest.

    Ranks sum to one, so the more nodes there are, the less a movement in all says of the digits of one.
    """
    out = edges.groupBy("src").agg(F.sum("w").alias("t"))
    shares = cut(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("share")))
    base = cut(base.join(out.select(F.col("src").alias("node"), F.lit(False).alias("sink")), "node", "left").na.fill(True, ["sink"]))
    rank = base.select("node", F.col("p").alias("rank"))
    for i in range(rounds):
        given = shares.join(rank, shares.src == rank.node).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        lost = base.where("sink").join(rank, "node").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        new = base.join(given, "node", "left").join(F.broadcast(lost), F.lit(True))
        new = new.select("node", ((1 - damping) * F.col("p") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("p"))).alias("rank"))
        if tolerance is None and i % 5 < 4 and i + 1 < rounds:
            rank = new  # a short plan; cut every fifth round
            continue
        new = cut(new)
        if tolerance is not None:
            step = F.abs(F.col("rank") - F.col("old"))
            moved, most, top = new.join(rank.select("node", F.col("rank").alias("old")), "node").agg(F.sum(step), F.max(step), F.max("rank")).head()
            if (moved or 0.0) < tolerance and (most or 0.0) <= steady * (top or 0.0):
                return new
        rank = new
    return rank


def modularity(edges: DataFrame, community: DataFrame) -> DataFrame:
    """One row, modularity_x1000 of an undirected multigraph under community (node, community)."""
    e = edges.join(community.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(community.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
    ends = e.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), (F.col("cs") == F.col("cd")).cast("int").alias("i")), F.struct(F.col("cd").alias("c"), F.lit(0).alias("i")))).alias("x")).select("x.*")
    per = ends.groupBy("c").agg(F.count("*").alias("d"), F.sum("i").alias("l"))
    total = per.agg(F.sum("d").alias("m2"), F.sum("l").alias("l"), F.sum(F.pow(F.col("d").cast("double"), F.lit(2.0))).alias("dd"))
    return total.select(F.when(F.col("m2") > 0, thousandths(2 * F.col("l") / F.col("m2") - F.col("dd") / (F.col("m2") * F.col("m2").cast("double")))).otherwise(0).alias("modularity_x1000"))


def misplaced(nodes: DataFrame) -> DataFrame:
    """(node, package, dominant): nodes whose package is not the commonest of their community; the first by name on a tie. nodes: (node, package, community)."""
    n = nodes.groupBy("community", "package").agg(F.count("*").alias("n"))
    w = Window.partitionBy("community").orderBy(F.desc("n"), "package")
    top = n.withColumn("k", F.row_number().over(w)).where("k = 1").select("community", F.col("package").alias("dominant"))
    return nodes.join(top, "community").where("package != dominant").select("node", "package", "dominant")


def container_edges(edges: DataFrame, container: DataFrame, labels: int = 3) -> DataFrame:
    """(src, dst, count, labels): edges (src, dst, label) between different containers (node, container), with the first labels."""
    e = edges.join(container.select(F.col("node").alias("src"), F.col("container").alias("cs")), "src").join(container.select(F.col("node").alias("dst"), F.col("container").alias("cd")), "dst").where("cs != cd")
    return e.groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.count("*").alias("count"), F.array_join(F.slice(F.array_sort(F.collect_set("label")), 1, labels), ",").alias("labels"))


def hub_threshold(edges: DataFrame) -> DataFrame:
    """(node, fan_in) of nodes with at least max(5, a quarter of the largest fan-in) edges in."""
    d = degrees(edges)
    top = d.agg(F.greatest(F.lit(5), F.ceil(F.max("fan_in") * 0.25)).alias("least"))
    return d.join(F.broadcast(top), F.lit(True)).where("fan_in >= least").select("node", "fan_in")


def event_chains(emits: DataFrame, listens: DataFrame, hops: int = 3) -> DataFrame:
    """(events): event lists of walks file -> event -> file, each step taking the first event and file by name, up to ``hops`` events; longest first within equal starts."""
    step = emits.join(listens.withColumnRenamed("file", "to"), "event").where("file != to").groupBy("file").agg(F.min(F.struct("event", "to")).alias("s")).select("file", "s.event", "s.to")
    walk = step.select(F.col("file").alias("start"), F.col("to").alias("at"), F.array("event").alias("events"))
    for _ in range(hops - 1):
        nxt = step.select(F.col("file").alias("at"), F.col("event").alias("e"), F.col("to").alias("t"))
        walk = walk.join(nxt, "at", "left").select("start", F.coalesce("t", "at").alias("at"), F.when(F.col("e").isNotNull() & ~F.array_contains("events", F.col("e")), F.array_append("events", F.col("e"))).otherwise(F.col("events")).alias("events"))
    return walk.select(F.array_join("events", ">").alias("events"), F.size("events").alias("length")).distinct()
