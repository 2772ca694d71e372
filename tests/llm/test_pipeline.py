"""The pipeline's stages against plain versions, on whole tables."""

import zlib

import corpus_pipeline
from tests.llm.test_operators import plain_components, plain_repeats

from touchline.llm.shared import settle, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = settle(stage(spark, docs, sf))
        rows = after.collect()
        if name == "quality classifier":
            bad = {r["doc_id"] for r in table(spark, sf, "labels").collect() if r["quality"] == 0 and zlib.crc32(str(r["doc_id"]).encode()) % 5}
            gone = set(before) - {r["doc_id"] for r in rows}
            assert len(gone & bad) > 0.5 * len(bad & set(before)) and len(gone) < 0.3 * len(before)
        elif name == "n-gram Jaccard join":
            assert {r["doc_id"] for r in rows} == {c for _, c in plain_components(before.items()).values()} and len(rows) < len(before)
        elif name == "suffix-array dedup":
            want = plain_repeats(before.items())
            assert all(len(r["text"].encode()) - (want[r["doc_id"]][0] - want[r["doc_id"]][1]) in range(6 * (want[r["doc_id"]][2] + 1)) for r in rows)
            assert all(r["n_chars"] == len(r["text"]) for r in rows) and len(rows) == len(before)
        else:
            assert {r["doc_id"] for r in rows} == set(before)
            assert sum(r["n_tokens"] for r in rows) == sum(len(t.replace("\v", " ").split(None)) for t in before.values())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        docs = after
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, quality string, quality_ string, _text string, kept string, row string, key string, hash string, doc long, tie long, target string, kind string, blob string"


def odd_documents(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties, one very long text, and columns whose names the stages use."""
    prose = "The river went by the old town and nobody looked at it for long, as it was late in the year and cold. "
    rows = [(None, None), (None, prose * 3), (1, ""), (2, " \n\t "), (3, prose * 3), (3, prose * 3), (4, prose * 2 + "It rained."), (5, "word " * 400_000), (5, "another text of that id, which is a document of its own"), (6, "é" * 300)]
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *(f"{k}{n}" for k in ("q", "Q", "t", "k", "r", "y", "h")), 7, 8, *(f"{k}{n}" for k in ("g", "i", "b"))) for n, (i, t) in enumerate(rows)], CLASHING)


def test_stages_of_odd_rows(spark, sf):
    docs = odd_documents(spark)
    known = {tuple(r)[5:] for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            # the columns that only pass through are as they were
            assert {tuple(r)[5:] for r in out.collect()} <= known
        else:
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}


def test_one_of_each_keeps_what_has_no_partner(spark, sf):
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    kept = stage(spark, odd_documents(spark), sf).collect()
    # the repeated row, its copy without an id and the near copy go; all others stay
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept if r["text"] and r["text"].startswith("The river") and "rained" not in r["text"]) == [(3, 306)]
    assert {r["doc_id"] for r in kept} == {None, 1, 2, 3, 5, 6} and sum(r["doc_id"] == 5 for r in kept) == 2
