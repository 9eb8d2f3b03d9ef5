"""Sequential graph algorithms, one group of a bounded graph at a time in Pandas.

Each takes edges with a group column, so that many graphs run in parallel; a
graph has to fit in one task, which is the nature of these algorithms.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.stratify import components


def _adjacency(pdf: pd.DataFrame) -> dict:
    out: dict = defaultdict(set)
    for a, b in zip(pdf["src"], pdf["dst"], strict=True):
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return {k: sorted(v) for k, v in sorted(out.items())}


def cut_parts(adj: dict) -> tuple[dict, int]:
    """Articulation points with the number of parts that their own component falls into without them, by low links in one walk; and the number of components."""
    order: dict = {}
    low: dict = {}
    parts: dict = {}
    roots = 0
    for root in adj:
        if root in order:
            continue
        roots += 1
        order[root] = low[root] = len(order)
        work = [(root, None, iter(adj[root]))]
        while work:
            node, parent, ahead = work[-1]
            for to in ahead:
                if to not in order:
                    order[to] = low[to] = len(order)
                    work.append((to, node, iter(adj[to])))
                    break
                if to != parent:
                    low[node] = min(low[node], order[to])
            else:
                work.pop()
                if work:
                    up = work[-1][0]
                    low[up] = min(low[up], low[node])
                    if low[node] >= order[up]:  # nothing below reaches above: a part of its own
                        parts[up] = parts.get(up, 0 if up == root else 1) + 1
    return {n: k for n, k in parts.items() if k > 1}, roots


def cut_nodes(adj: dict) -> list:
    """Articulation points."""
    return sorted(cut_parts(adj)[0])


def articulation_points(edges: DataFrame, group: str = "g", nodes: DataFrame | None = None) -> DataFrame:
    """(group, node, severity): cut nodes of each undirected graph; severity is the number of parts left without the node.

    ``nodes`` (group, node) may name nodes without edges, each of which is a part too.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts, components_ = cut_parts(_adjacency(pdf))
        rows = [(pdf[group].iat[0], n, k + components_ - 1) for n, k in sorted(cuts.items())]
        return pd.DataFrame(rows, columns=[group, "node", "severity"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    found = edges.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, node {kinds['src']}, severity long")
    if nodes is None:
        return found
    ends = edges.where("src != dst").select(group, F.explode(F.array("src", "dst")).alias("node"))
    alone = nodes.select(group, "node").distinct().join(ends, [group, "node"], "left_anti").groupBy(group).agg(F.count("*").alias("_alone"))
    return found.join(alone, group, "left").select(group, "node", (F.col("severity") + F.coalesce("_alone", F.lit(0))).alias("severity"))


def max_flow(adj: dict[object, dict[object, int]], sources: list, sinks: list) -> int:
    """Undirected unit-capacity flow from all sources to all sinks, by shortest augmenting paths."""
    room = {a: dict(b) for a, b in adj.items()}
    flow, targets = 0, set(sinks)
    while True:
        before: dict = {s: None for s in sources}
        todo, end = deque(sources), None
        while todo and end is None:
            a = todo.popleft()
            for b, c in room.get(a, {}).items():
                if c > 0 and b not in before:
                    before[b] = a
                    if b in targets:
                        end = b
                        break
                    todo.append(b)
        if end is None:
            return flow
        b = end
        while before[b] is not None:
            a = before[b]
            room[a][b] -= 1
            room.setdefault(b, {})[a] = room.get(b, {}).get(a, 0) + 1
            b = a
        flow += 1


def package_min_cut(edges: DataFrame, group: str = "g") -> DataFrame:
    """(group, a, b, cut): least number of edges that part two packages with a crossing edge. edges: (group, src, dst, ps, pd)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adj: dict = defaultdict(lambda: defaultdict(int))
        home: dict = {}
        for a, b, x, y in zip(pdf["src"], pdf["dst"], pdf["ps"], pdf["pd"], strict=True):
            adj[a][b] += 1
            adj[b][a] += 1
            home[a], home[b] = x, y
        members: dict = defaultdict(list)
        for n, p in sorted(home.items()):
            members[p].append(n)
        pairs = sorted({tuple(sorted(x)) for x in zip(pdf["ps"], pdf["pd"], strict=True) if x[0] != x[1]})
        rows = [(pdf[group].iat[0], a, b, max_flow(adj, members[a], members[b])) for a, b in pairs]
        return pd.DataFrame(rows, columns=[group, "a", "b", "cut"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    return edges.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, a {kinds['ps']}, b {kinds['pd']}, cut long")


def _van_der_corput(n: int) -> float:
    out, base = 0.0, 0.5
    while n:
        out += base * (n & 1)
        n >>= 1
        base /= 2
    return out


def laplacian_quotient(adj: dict, rounds: int = 200) -> float:
    """Rayleigh quotient after power iteration on the graph Laplacian with the constant vector removed: its largest eigenvalue."""
    at = {n: i for i, n in enumerate(adj)}
    lap = np.zeros((len(at), len(at)))
    for a, ends in adj.items():
        for b in ends:
            lap[at[a], at[a]] += 1
            lap[at[a], at[b]] -= 1
    x = np.array([_van_der_corput(i + 1) for i in range(len(at))])
    for _ in range(rounds):
        x = x - x.mean()
        norm = np.linalg.norm(x)
        if norm < 1e-12:
            return 0.0
        x = lap @ (x / norm)
    x = x - x.mean()
    norm = float(x @ x)
    return float(x @ lap @ x / norm) if norm > 1e-24 else 0.0


def spectral_scopes(edges: DataFrame, group: str = "g", least: int = 3, most: int = 100) -> DataFrame:
    """(group, nodes, edges, lambda_x1000, cheeger_x1000) of graphs with 3 to 100 nodes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adj = _adjacency(pdf)
        columns = [group, "nodes", "edges", "lambda_x1000", "cheeger_x1000"]
        if not least <= len(adj) <= most:
            return pd.DataFrame([], columns=columns)
        q = laplacian_quotient(adj)
        return pd.DataFrame([(pdf[group].iat[0], len(adj), len(pdf), int(np.floor(q * 1000 + 0.5)), int(np.floor(np.sqrt(2 * max(0.0, q)) * 1000 + 0.5)))], columns=columns)

    kind = edges.schema[group].dataType.simpleString()
    return edges.groupBy(group).applyInPandas(run, f"{group} {kind}, nodes long, edges long, lambda_x1000 long, cheeger_x1000 long")


def louvain(adj: dict) -> dict:
    """Communities of a simple undirected graph: local moves in sorted order, then the same on the communities; deterministic."""
    weights = {a: {b: 1.0 for b in ends} for a, ends in adj.items()}
    where = {n: n for n in adj}
    while True:
        m2 = sum(sum(w.values()) for w in weights.values())
        if not m2:
            break
        degree = {a: sum(w.values()) for a, w in weights.items()}
        own = {a: a for a in weights}
        total = dict(degree)
        moved_any = moved = True
        first = True
        while moved:
            moved = False
            for a in sorted(weights):
                total[own[a]] -= degree[a]
                links: dict = defaultdict(float)
                for b, w in weights[a].items():
                    if b != a:
                        links[own[b]] += w
                best = max(sorted({own[a], *links}), key=lambda c: (round(links.get(c, 0.0) - degree[a] * total[c] / m2, 12), c == own[a]))
                total[best] += degree[a]
                if best != own[a]:
                    own[a], moved = best, True
            moved_any = moved_any and (not first or moved)
            first = False
        names = {c: min(n for n in own if own[n] == c) for c in set(own.values())}
        where = {n: names[own[c]] for n, c in where.items()}
        if not moved_any:
            break
        merged: dict = defaultdict(lambda: defaultdict(float))
        for a, ends in weights.items():
            for b, w in ends.items():
                merged[names[own[a]]][names[own[b]]] += w
        weights = {a: dict(b) for a, b in merged.items()}
    return where


def communities(edges: DataFrame, group: str = "g") -> DataFrame:
    """(group, node, community) by Louvain in a fixed order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = louvain(_adjacency(pdf))
        return pd.DataFrame([(pdf[group].iat[0], n, c) for n, c in sorted(found.items())], columns=[group, "node", "community"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    return edges.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, node {kinds['src']}, community {kinds['src']}")


def persistence(edges: DataFrame, group: str = "g") -> DataFrame:
    """(group, rep, birth, death, persistence, size): clusters of an undirected graph (src, dst, w) as edges come in from heavy to light.

    Of two clusters that meet, the younger (later born, on a tie the greater root) dies; single nodes never appear.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        weight: dict = defaultdict(int)
        for a, b, w in zip(pdf["src"], pdf["dst"], pdf["w"], strict=True):
            if a != b:
                weight[min(a, b), max(a, b)] += int(w)
        parent: dict = {}
        birth: dict = {}
        size: dict = {}
        rows = []

        def root(n):
            while parent[n] != n:
                parent[n] = n = parent[parent[n]]
            return n

        for (a, b), w in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
            for n in (a, b):
                if n not in parent:
                    parent[n], birth[n], size[n] = n, w, 1
            x, y = root(a), root(b)
            if x == y:
                continue
            if (birth[x], y) < (birth[y], x):
                x, y = y, x  # y is the younger
            if size[y] > 1 and birth[y] - w >= 1:
                rows.append((pdf[group].iat[0], y, birth[y], w, birth[y] - w, size[y]))
            parent[y] = x
            size[x] += size[y]
        for n in sorted(parent):
            if parent[n] == n and size[n] > 1 and birth[n] >= 1:
                rows.append((pdf[group].iat[0], n, birth[n], 0, birth[n], size[n]))
        return pd.DataFrame(rows, columns=[group, "rep", "birth", "death", "persistence", "size"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    return edges.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, rep {kinds['src']}, birth long, death long, persistence long, size long")


def hitting_times(edges: DataFrame, group: str = "g", sweeps: int = 200) -> DataFrame:
    """(group, src, dst, steps_x1000): mean steps of a random walk that takes each of a node's distinct ends alike, by Gauss-Seidel sweeps in sorted order; a node without edges out stays where it is.

    Targets that cannot be reached do not diverge but end at the number of sweeps.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = defaultdict(set)
        names = sorted({*pdf["src"], *pdf["dst"]})
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            out[a].add(b)
        rows = []
        for target in names:
            h = dict.fromkeys(names, 0.0)
            for _ in range(sweeps):
                change = 0.0
                for n in names:
                    if n == target:
                        continue
                    ends = sorted(out.get(n) or {n})
                    new = 1 + sum(h[b] for b in ends) / len(ends)
                    change = max(change, abs(new - h[n]))
                    h[n] = new
                if change < 1e-6:
                    break
            rows += [(pdf[group].iat[0], n, target, int(np.floor(h[n] * 1000))) for n in names if n != target and h[n] > 0]
        return pd.DataFrame(rows, columns=[group, "src", "dst", "steps_x1000"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    return edges.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, src {kinds['src']}, dst {kinds['src']}, steps_x1000 long")


def _components(pdf: pd.DataFrame) -> tuple[list[list], dict, dict]:
    """Strongly connected components (members sorted), the name of each node's text, and the graph by text."""
    text = {str(n): n for n in sorted({*pdf["src"], *pdf["dst"]})}
    graph: dict = {t: {} for t in text}
    for a, b in zip(pdf["src"], pdf["dst"], strict=True):
        if a != b:
            graph[str(a)][str(b)] = False
    return [sorted(p, key=text.get) for p in components(graph)], text, graph


def strong_components_in_task(edges: DataFrame, group: str = "g") -> DataFrame:
    """(group, node, component): strongly connected components of two nodes or more, by their least node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, text, _ = _components(pdf)
        return pd.DataFrame([(pdf[group].iat[0], text[n], text[p[0]]) for p in parts if len(p) > 1 for n in p], columns=[group, "node", "component"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    return edges.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, node {kinds['src']}, component {kinds['src']}")


def structure_matrix(edges: DataFrame, group: str = "g") -> DataFrame:
    """(group, node, position, level): nodes by components in topological order from those nothing enters, ties by least member; one level for each component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, text, graph = _components(pdf)
        home = {n: i for i, p in enumerate(parts) for n in p}
        waits = [0] * len(parts)
        ahead = [{home[b] for a in p for b in graph[a]} - {i} for i, p in enumerate(parts)]
        for ends in ahead:
            for j in ends:
                waits[j] += 1
        ready = [(text[p[0]], i) for i, p in enumerate(parts) if not waits[i]]
        heapq.heapify(ready)
        rows, level = [], 0
        while ready:
            _, i = heapq.heappop(ready)
            for n in parts[i]:
                rows.append((pdf[group].iat[0], text[n], len(rows), level))
            level += 1
            for j in ahead[i]:
                waits[j] -= 1
                if not waits[j]:
                    heapq.heappush(ready, (text[parts[j][0]], j))
        return pd.DataFrame(rows, columns=[group, "node", "position", "level"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    return edges.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, node {kinds['src']}, position long, level long")


def back_edges(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(src, dst) that point from a later to an earlier position of a structure matrix."""
    p = order.select("node", "position")
    e = edges.select("src", "dst").distinct()
    e = e.join(p.withColumnsRenamed({"node": "src", "position": "ps"}), "src").join(p.withColumnsRenamed({"node": "dst", "position": "pt"}), "dst")
    return e.where("ps > pt").select("src", "dst")
