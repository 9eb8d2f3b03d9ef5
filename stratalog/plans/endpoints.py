"""Questions by name over a folder or a map of relations, for the command line and over HTTP.

An endpoint takes relations and text arguments and gives a DataFrame; nothing
is read before its rows are asked for. Relations, as far as an endpoint needs
them: nodes (node, type, status), edges and calls (src, dst), pairs as
``cochange_pairs`` gives them, commits (idx, file), tested (file), truth (concept,
file, role), drift (file, line, kind), functions (file, name, line, loc), exports
(file, name, confidence), memory (id, kind, fingerprint, reason, scope, added,
obsolete), and for two states of the structure ``old_nodes`` and ``old_edges``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cochange as C
from ..operators import diff as D
from ..operators import graph as G
from ..operators import kernels as K
from ..operators import structure as T

Relations = Mapping[str, DataFrame]
ENDPOINTS: dict[str, Callable[..., DataFrame]] = {}


def endpoint(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    ENDPOINTS[f.__name__] = f
    return f


class FolderRelations(dict):
    """Relations below a folder, one Parquet table each, looked up when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder.rstrip("/")

    def __missing__(self, name: str) -> DataFrame:
        self[name] = out = self.spark.read.parquet(f"{self.folder}/{name}")
        return out


def _one(r: Relations, node: str) -> DataFrame:
    some = next(iter(r.values())) if len(r) else r["edges"]
    return some.sparkSession.createDataFrame([(node,)], "node string")


@endpoint
def context(r: Relations, node: str, k: str = "20") -> DataFrame:
    """(section, other, value): a node's status, edges in and out, and closest co-changing files."""
    return T.node_detail(node, r["nodes"], r["edges"], r["pairs"], int(k))


@endpoint
def who_imports(r: Relations, node: str) -> DataFrame:
    return G.neighbours(r["edges"], node)


@endpoint
def who_calls(r: Relations, node: str) -> DataFrame:
    return G.neighbours(r["calls"], node)


@endpoint
def affected(r: Relations, node: str, depth: str = "") -> DataFrame:
    """(node, depth, is_test) of what depends on a node."""
    return G.affected(r["edges"], _one(r, node), int(depth) if depth else None)


@endpoint
def reach(r: Relations, node: str, depth: str = "") -> DataFrame:
    return G.reach(r["edges"], _one(r, node), int(depth) if depth else None)


@endpoint
def rank(r: Relations, k: str = "50") -> DataFrame:
    """(node, rank_x1e6): the first nodes by PageRank."""
    ranks = G.module_ranks(r["edges"])
    return ranks.orderBy(F.desc("rank"), "node").limit(int(k)).select("node", F.floor(F.col("rank") * 1e6 + 0.5).cast("bigint").alias("rank_x1e6"))


@endpoint
def orphans(r: Relations) -> DataFrame:
    return r["nodes"].where("status = 'orphan'").select("node")


@endpoint
def cycles(r: Relations) -> DataFrame:
    """(id, size, members, path) of the strongly connected components; the path is a way round."""
    return G.cycle_paths(r["edges"])


@endpoint
def dsm(r: Relations) -> DataFrame:
    """(node, position, level): the order of a dependency matrix."""
    return G.structure_matrix(r["edges"].withColumn("g", F.lit(0))).drop("g")


@endpoint
def truth_point_for(r: Relations, concept: str) -> DataFrame:
    """(concept, role, file) of who reads and writes a piece of shared state."""
    return r["truth"].where(F.lower("concept") == concept.lower()).select("concept", "role", "file").distinct()


@endpoint
def recent(r: Relations, k: str = "20") -> DataFrame:
    """(file, last, commits): the files changed last."""
    seen = r["commits"].groupBy("file").agg(F.max("idx").alias("last"), F.count_distinct("idx").alias("commits"))
    return seen.orderBy(F.desc("last"), "file").limit(int(k))


@endpoint
def uncovered(r: Relations, critical: str = "") -> DataFrame:
    """(file, fan_in, score) of untested files by what hangs on them."""
    files = r["nodes"].where("type = 'file'").select(F.col("node").alias("file"))
    return T.untested_ranking(files, r["edges"], r["tested"], r["truth"].where("role = 'write'"), bool(critical))


@endpoint
def co_changed(r: Relations, node: str, k: str = "20") -> DataFrame:
    """(b, count, jaccard_x100): what changes with a file."""
    return C.symmetric(r["pairs"]).where(F.col("a") == node).orderBy(F.desc("jaccard_x100"), "b").limit(int(k)).select("b", "count", "jaccard_x100")


@endpoint
def extract_candidates(r: Relations, least: str = "50") -> DataFrame:
    return T.extract_candidates(r["functions"], r["edges"], int(least))


@endpoint
def exports(r: Relations, confidence: str = "") -> DataFrame:
    found = r["exports"].select("file", "name", "confidence")
    return found.where(F.col("confidence") == confidence) if confidence else found


@endpoint
def changes_since(r: Relations) -> DataFrame:
    """(what, key, change): nodes by status and edges that came, went or changed."""
    edge = lambda df: df.select(F.concat_ws(" -> ", "src", "dst").alias("key")).distinct()
    nodes = D.keyed_diff(r["old_nodes"].select(F.col("node").alias("key"), "status"), r["nodes"].select(F.col("node").alias("key"), "status"), ["key"], ["status"])
    edges = D.keyed_diff(edge(r["old_edges"]), edge(r["edges"]), ["key"], [])
    return nodes.select(F.lit("node").alias("what"), "key", "change").unionByName(edges.select(F.lit("edge").alias("what"), "key", "change"))


@endpoint
def drift(r: Relations, kind: str = "") -> DataFrame:
    found = r["drift"].select("file", "line", "kind")
    return found.where(F.col("kind") == kind) if kind else found


@endpoint
def memory_recall(r: Relations, scope: str = "", kind: str = "") -> DataFrame:
    return T.recall(r["memory"], scope or None, kind or None)


@endpoint
def memory_mark(r: Relations, id: str, at: str) -> DataFrame:  # noqa: A002 - the argument's public name
    """The entries with one marked obsolete; whoever asks writes them back."""
    ids = r["memory"].sparkSession.createDataFrame([(id,)], "id string")
    return T.mark_obsolete(r["memory"], ids, F.lit(at).cast(r["memory"].schema["obsolete"].dataType))


@endpoint
def summary(r: Relations) -> DataFrame:
    """(counter, value) of nodes by status and edges."""
    states = r["nodes"].groupBy(F.concat(F.lit("nodes "), F.col("status")).alias("counter")).agg(F.count("*").alias("value"))
    return states.unionByName(r["edges"].agg(F.count("*").alias("value")).select(F.lit("edges").alias("counter"), "value"))


def call(relations: Relations, name: str, limit: int = 1000, **arguments: str) -> tuple[list[dict], bool]:
    """Up to ``limit`` rows of an endpoint, in the order of their values, and whether there are more."""
    if name not in ENDPOINTS:
        raise KeyError(f"no endpoint {name}; there are {', '.join(sorted(ENDPOINTS))}")
    df = ENDPOINTS[name](relations, **arguments)
    rows = df.orderBy(*df.columns).limit(limit + 1).collect()
    return [r.asDict(recursive=True) for r in rows[:limit]], len(rows) > limit


def serve(relations: Relations, host: str = "127.0.0.1", port: int = 0, limit: int = 1000) -> ThreadingHTTPServer:
    """A server that answers ``/name?argument=value`` with JSON; ``serve_forever`` starts it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802 - the library's name
            at = urlsplit(self.path)
            try:
                rows, more = call(relations, at.path.strip("/"), limit, **dict(parse_qsl(at.query)))
                self.answer(200, {"rows": rows, "truncated": more})
            except KeyError as e:
                self.answer(404, {"error": str(e.args[0])})
            except (TypeError, ValueError) as e:
                self.answer(400, {"error": str(e)})

        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body, default=str, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            return

    return ThreadingHTTPServer((host, port), Handler)
