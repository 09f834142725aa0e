"""Each stage on tables with nulls, empty and long texts, repeated rows, repeated ids and columns that clash."""

from __future__ import annotations

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
KEPT = dict(corpus_pipeline.STAGES[:-1])
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _dropped long, id string, kept string, component_id string, n_words string, score string, lang_pred string, contaminated string, th string"


@pytest.fixture(scope="module")
def odd(spark):
    real = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r["text"]][:60]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    clash = [1, *["x"] * 8]
    prose = real[1]["text"]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], *clash) for r in real]
    rows += [
        (9001, None, None, None, None, *clash), (9002, "", "en", None, None, *clash), (9003, " \n\t", None, "s", 3, *clash), (9004, "12345 67890", "en", "s", 11, *clash),
        (9005, item, "en", "s", None, *clash), (9006, item, "en", "s", None, *clash), (None, prose, "en", "s", None, *clash), (None, "no id here at all", None, None, None, *clash),
        (9007, prose, "en", "s", 1, *clash), (9007, prose, "en", "s", 1, *clash), (9008, f"{prose} one more", "en", "s", 1, *clash),
        (9009, (prose + " ") * 400, "en", "s", None, *clash), (9010, prose, None, None, None, *clash), (9010, "another text under the same id", None, None, None, *clash),
    ]
    return spark.createDataFrame(rows, SCHEMA), real[1]["doc_id"]


@pytest.mark.parametrize("name", list(KEPT))
def test_empty_tables(spark, odd, name):
    out = KEPT[name](spark, odd[0].limit(0), SF)
    assert out.columns == corpus_pipeline.COLUMNS and out.count() == 0


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def test_language_stage(spark, odd):
    out = KEPT["language id"](spark, odd[0], SF)
    kept = {k for _, k in ids(out)}
    assert out.columns == corpus_pipeline.COLUMNS and not kept & {9001, 9002, 9003, 9004} and {9007, 9009} <= kept
    assert out.where("doc_id = 9007").count() == 2


def test_exact_stage(spark, odd):
    docs, first = odd
    out = KEPT["exact dedup"](spark, docs, SF)
    kept = ids(out)
    assert out.columns == corpus_pipeline.COLUMNS
    assert (False, first) in kept and (False, 9007) not in kept  # a copy of the first text
    assert sum(not_there for not_there, _ in kept) == 2  # rows without an id are never dropped by id
    assert kept.count((False, 9010)) == 2  # one of the id's rows stays, so both do
    assert [k for _, k in kept if k in (9001, 9002, 9003)] == [9003]  # texts without other signs than white space are equal, and the longest stays


def test_jaccard_stage(spark, odd):
    docs, first = odd
    out = KEPT["n-gram jaccard join"](spark, docs, SF)
    kept = [k for _, k in ids(out)]
    assert first in kept and 9007 not in kept and 9008 not in kept and 9006 not in kept and 9005 in kept
    assert {9001, 9002, 9003} <= set(kept)


def test_decontamination_stage(spark, odd):
    docs, _ = odd
    out = KEPT["benchmark decontamination"](spark, docs, SF)
    kept = [k for _, k in ids(out)]
    assert 9005 not in kept and 9006 not in kept and kept.count(9007) == 2 and {9001, 9002, 9003} <= set(kept) and out.columns == corpus_pipeline.COLUMNS


def test_packing_stage(spark, odd):
    docs, _ = odd
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs.select(*corpus_pipeline.COLUMNS), SF).collect()
    assert {r["length"] for r in pieces if r["doc_id"] in (9001, 9002)} == {1}
    used = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)  # gapless
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 1024 and sum(r["doc_id"] is None for r in pieces) >= 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0).select(*corpus_pipeline.COLUMNS), SF).count() == 0
