from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import warc as W

from .helpers import LONG

SCHEMA = "page_id long, url string, html string, _id int, payload string, run int, part int"
BIG = "x" * 1500
PAGES = [
    (1, "http://a.org/", None), (2, None, ""), (3, "http://b.org/x\r\nInjected: 1", "short"), (4, "http://b.org/x", "short"), (5, "http://c.org/", BIG), (6, "http://c.org/", BIG), (7, "http://A.org/é", BIG + "é"), (6, "http://c.org/", BIG),
    (None, "http://d.org/", BIG), (None, "http://d.org/", "WARC/1.1\r\n\r\n\r\nWARC-Type: response\n" * 99), (8, "not a url", LONG), (9, "", "line\nline\r\n\r\n\x00\U0001f600"), (10, "http://c.org/", "y" * 999), (11, "http://c.org/", "y" * 999),
]
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


def expected(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    heads: dict = {}
    for i, d in data:
        if len(d) >= 1000 and i is not None:
            heads[d] = max(i, heads.get(d, i))
    out = []
    for i, d in data:
        refers = heads.get(d) if len(d) >= 1000 and i != heads.get(d) else None
        out.append((i, len(d), hashlib.sha1(d).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


def test_hard_pages(spark):
    out = W.archive_and_index(pages(spark))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=repr) == expected(PAGES)
    assert sorted(r["url"] or "" for r in out.collect())[:3] == ["", "", "http://A.org/é"]
    assert W.archive_and_index(pages(spark).where("false")).count() == 0


def test_pages(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    rows = W.archive_and_index(table).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=repr) == expected([(r["page_id"], r["url"], r["html"]) for r in table.collect()])
    history = sorted(rows, key=lambda r: (r["part"], r["rank"]))
    keys = [(r["url_key"], r["captured"]) for r in history]
    assert keys == sorted(keys), "one global order of URL key and time"


def test_archive_holds_the_payloads(spark, tmp_path):
    path = str(tmp_path / "warc")
    own = [r for r in PAGES if r[0] is not None]
    W.write_warc(pages(spark, own), path, records_per_file=3)
    bodies: dict = {}
    for file in Path(path).glob("*.gz"):
        data = file.read_bytes()
        assert b"".join(W.inflate(data, 1000)) == gzip.decompress(data)
        for headers, block in W.records(iter([gzip.decompress(data)[i : i + 777] for i in range(0, len(gzip.decompress(data)), 777)])):
            assert "injected" not in headers
            if headers["warc-type"] == "response":
                bodies[int(headers["warc-page-id"])] = block.partition(b"\r\n\r\n")[2].decode()
    for i, _, html in own:
        if i in bodies:
            assert bodies[i] == (html or "")
    assert set(bodies) == {1, 2, 3, 4, 6, 7, 8, 9, 10, 11}


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree_merges(runs):
    rows = [[(v, i, k) for k, v in enumerate(sorted(run))] for i, run in enumerate(runs)]
    merged = list(W.LoserTree(rows, lambda r: r[0]))
    assert merged == sorted((r for run in rows for r in run), key=lambda r: r[:2]), "stable: earlier runs first"


def test_broken_archives_are_noticed():
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in W.records(iter([whole, whole]))] == [b"abc", b"abc"]
    for broken in (whole[:20], whole[:-6], b"junk\r\n\r\n"):
        with pytest.raises(ValueError):
            list(W.records(iter([broken])))


def test_ids_and_urls_come_back_as_they_were(spark):
    """Blanks, tabs, line ends, percent signs, colons and spaces of other kinds in text ids and URLs."""
    ids = ["a", " a", "a ", " a\t", "a\r\nX: 1", "a\nb", "a%20", "a%", "%25", "a: b", "\u00a0a\u2003", "\x0ba\x85", "<b>", "\u00e9"]
    rows = [(i, f"http://x.org/{i}", BIG) for i in ids]
    table = spark.createDataFrame(rows, "page_id string, url string, html string")
    out = W.archive_and_index(table).collect()
    assert sorted((r["page_id"], r["url"]) for r in out) == sorted((i, u) for i, u, _ in rows)
    assert {r["refers_to"] for r in out} == {None, max(ids, key=lambda i: i.encode())}


def test_coded_headers():
    for text in (" x", "%", "%0D", "%250D", "\r\n\t %"):
        coded = text
        for plain, code in W.CODED:
            coded = coded.replace(plain, code)
        assert not set(coded) & set(" \t\r\n") and W.decoded(coded) == text


def test_large_payloads_get_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FILE_BYTES", 4000)
    table = spark.createDataFrame([(i, "http://x.org/", f"{i}" + "z" * 1000) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    W.write_warc(table, str(tmp_path / "warc"))
    assert len(list((tmp_path / "warc").glob("*.gz"))) >= 13
    assert W.merge_runs(W.capture_runs(spark, str(tmp_path / "warc"))).count() == 40


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_runs_without_local_order(spark, limit, monkeypatch):
    """Both ways of the join; one URL captured very often, over many files and parts."""
    monkeypatch.setattr(W, "BROADCAST_BYTES", limit)
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i % 50}.org/", BIG if i % 7 == 0 else f"p{i}") for i in range(3000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    out = W.archive_and_index(table).collect()
    history = [(r["url_key"], r["captured"], r["page_id"]) for r in sorted(out, key=lambda r: (r["part"], r["rank"]))]
    assert history == sorted(history) and len(history) == 3000
    assert sorted((tuple(r[c] for c in COLUMNS) for r in out), key=repr) == expected(rows)
