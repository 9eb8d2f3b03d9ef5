"""Endpoints over folders, on the command line and over HTTP."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pytest

from stratalog.operators import graph as G
from stratalog.plans.endpoints import ENDPOINTS, FolderRelations, call, serve
from stratalog.plans.service import main


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("relations")
    spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "src string, dst string").write.parquet(f"{at}/edges")
    spark.createDataFrame([("m1", "note", "f", "why", "all", "t0", None), ("m2", "note", "g", "why", "one", "t0", None)], "id string, kind string, fingerprint string, reason string, scope string, added string, obsolete string").write.parquet(f"{at}/memory")
    return str(at)


def test_call(spark, folder):
    r = FolderRelations(spark, folder)
    assert call(r, "who_imports", node="a") == ([{"src": "c", "dst": "a"}, {"src": "x", "dst": "a"}], False)
    assert [x["node"] for x in call(r, "affected", node="b", depth="1")[0]] == ["a", "b"]
    assert call(r, "reach", limit=2, node="x")[1] is True
    assert [x["id"] for x in call(r, "memory_recall", scope="one")[0]] == ["m2"]
    assert [x["obsolete"] for x in call(r, "memory_mark", id="m1", at="t9")[0]] == ["t9", None]
    with pytest.raises(KeyError):
        call(r, "nothing")
    assert len(ENDPOINTS) >= 20


def test_cycle_paths(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("p", "q"), ("q", "r"), ("r", "s"), ("s", "p"), ("q", "s"), ("x", "p"), ("self", "self")]
    found = {tuple(r["members"]): r["path"] for r in G.cycle_paths(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert found == {("a", "b", "c"): ["a", "b", "a"], ("p", "q", "r", "s"): ["p", "q", "s", "p"]}


def test_http(spark, folder):
    server = serve(FolderRelations(spark, folder))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        got = json.load(urllib.request.urlopen(f"{base}/who_imports?node=a"))
        assert got == {"rows": [{"src": "c", "dst": "a"}, {"src": "x", "dst": "a"}], "truncated": False}
        for path, status in (("nothing", 404), ("who_imports?wrong=1", 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(f"{base}/{path}")
            assert e.value.code == status
    finally:
        server.shutdown()


def test_command_line(spark, folder, capsys):
    assert main(["query", "who_imports", "--data", folder, "--arg", "node=b"]) == 0
    assert json.loads(capsys.readouterr().out) == {"src": "a", "dst": "b"}
    assert main(["query", "nothing", "--data", folder]) == 2 and "there are" in capsys.readouterr().err
