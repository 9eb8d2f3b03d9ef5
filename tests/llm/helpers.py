"""Inputs and checks that the tests of this folder share."""

from __future__ import annotations

import re

#: Null, empty, blank, very long and repeated texts, ties, and rows that repeat as a whole.
LONG = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
HARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "two words"), (6, "é中\U0001f600 \x00 odd   text"), (7, LONG), (8, LONG),
    (9, "the same text in several rows, with enough words to have some shingles in it"), (9, "the same text in several rows, with enough words to have some shingles in it"),
    (10, "the same text in several rows, with enough words to have some shingles in it"), (None, "no id"), (None, None), (None, "no id"),
]
#: Columns that clash with names the operators use inside.
CLASHING = "_text string, fp long, key string, node long, n_email string, _row long, _fp string, _words int, _spans int, _items int, label string, path string, host string, score double"


def hard_docs(spark, rows=HARD):
    """documents-like rows with extra columns of clashing names, all null or odd."""
    extra = [c.split() for c in CLASHING.split(", ")]
    schema = f"doc_id long, text string, lang string, source string, n_chars int, {CLASHING}"
    data = [(i, t, None, None if i is None else "s", None if t is None else len(t), *[None] * len(extra)) for i, t in rows]
    return spark.createDataFrame(data, schema)


def empty_docs(spark):
    return hard_docs(spark).where("false")


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def blank_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(ids, links) -> dict:
    """id -> least id reachable over the links, by repeated sweeps."""
    least = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                moved = True
    return least
