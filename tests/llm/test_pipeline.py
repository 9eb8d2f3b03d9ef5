"""Each stage of the corpus pipeline against a brute-force version, over what the stage before kept."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from stratalog.llm import quality_classifier as C
from stratalog.llm.packing import lower_bound, pieces_of
from stratalog.llm.pii import Pseudonyms
from stratalog.llm.queries import PSEUDONYM_KEY

from .helpers import empty_docs, hard_docs
from .test_decontamination import report
from .test_similar import alike_components, shingles


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        docs.append(stage(spark, docs[-1], sf))
    return docs


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_names_and_columns(stages, spark, sf):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "pii", "best-fit packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and [f.dataType for f in df.schema] == [f.dataType for f in stages[0].schema]


def test_quality_stage(stages, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    before, after = rows(stages[0]), rows(stages[1])
    scores = {r["doc_id"]: r["score"] for r in C.quality_scores(stages[0], labels, metadata=("n_chars",)).collect()}
    assert set(after) == {i for i, s in scores.items() if s >= 0.3}
    assert all(after[i] == before[i] for i in after) and 0 < len(after) < len(before)


def test_near_duplicate_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    sets = {i: shingles(r["text"]) for i, r in before.items()}
    root = alike_components(sets, 0.8)
    assert len({root[i] for i in after}) == len(after), "two of one class stayed"
    assert {root[i] for i in after} == set(root.values()), "a class has gone as a whole"
    assert all(after[i] == before[i] for i in after)


def test_decontamination_stage(stages, spark, sf):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = rows(stages[2]), rows(stages[3])
    clean = {r[0] for r in report([(i, r["text"]) for i, r in before.items()], items) if not r[-1]}
    assert set(after) == clean and all(after[i] == before[i] for i in after)


def test_pseudonym_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    own = Pseudonyms(PSEUDONYM_KEY)
    assert set(after) == set(before)
    for i, r in before.items():
        text = own.replace(r["text"])[0]
        assert after[i]["text"] == text and after[i]["n_chars"] == len(text)
        assert (after[i]["lang"], after[i]["source"]) == (r["lang"], r["source"])


def test_packing_stage(stages):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, wanted = stages[5].collect(), Counter()
    for i, r in rows(stages[4]).items():
        ids = np.array([*slow.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, (start, n) in enumerate(pieces_of(len(ids), 2048)):
            wanted[i, piece, start, n, zlib.crc32(ids[start : start + n])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == wanted
    assert len({r["sequence_id"] for r in out}) == lower_bound(Counter(r["length"] for r in out), 2048)


def test_run_is_all_stages(stages, spark, sf):
    digest = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert digest(pipeline.run(spark, sf)) == digest(stages[-1])


def test_hard_and_empty_tables(spark, sf):
    for docs in (hard_docs(spark), empty_docs(spark)):
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() >= 0
