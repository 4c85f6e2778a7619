"""Every stage of the pipeline on nulls, repeated rows, very long texts, empty tables and clashing columns."""

import pytest
from oracle import SF
from pyspark.sql import functions as F

import corpus_pipeline as P
from vellum.llm import common

LONG = "wort " * 30_000
ROWS = [(1, None, None, None, None), (2, "", "en", "s0", 0), (3, "a b c d e f", "en", "s0", 11), (3, "a b c d e f", "en", "s0", 11), (3, "other words of the same id here", None, "s1", 4), (4, "A b  c d e f", "de", None, 12), (None, "a b c d e f", "de", "s1", 11), (7, LONG, "en", "s1", len(LONG)), (8, "Ünï 漢字 😀 ́x", "en", "s0", 9)]


def documents(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in ("size", "copies", "kept", "keep", "digest", "label", "toxic_score", "toxic_flag", "piece", "length", "offset", "sequence_id", "row_", "id_")})


@pytest.mark.parametrize("n", range(4))
def test_stage(spark, n):
    name, stage = P.STAGES[n]
    docs = documents(spark)
    got = stage(spark, docs, SF)
    rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:20]) for r in got.collect()) if n < 3 else [])
    every = sorted((d is None, d or 0, (t or "")[:20]) for d, t, *_ in ROWS)
    if n < 3:
        assert got.columns == P.COLUMNS
    if name == "toxicity":
        assert rows == every
    if name == "near_dedup":
        every.remove((False, 3, "a b c d e f"))
        every.remove((False, 4, "A b  c d e f"))
        assert rows == every
    if name == "mixing":
        assert set(rows) <= set(every) and {(False, 1, ""), (False, 2, "")} <= set(rows)
        assert all(rows.count(x) <= 2 * every.count(x) for x in rows)
    if name == "packing":
        assert got.where("piece = 0").count() == len(ROWS)
        assert got.where("sequence_id is null or offset is null").count() == 0
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_leaves_only_its_stages(spark):
    before = common.scratch_tables(spark)
    assert P.run(spark, SF).count() > 0
    assert common.scratch_tables(spark) - before == len(P.STAGES)
