"""The corpus pipeline, stage by stage and as a whole."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import check_packing, near_copies_by_brute_force

from marlstone.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, kept = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text").toPandas() if "text" in docs.columns else None
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packed":
            assert docs.columns == corpus_pipeline.COLUMNS
        ids[name], kept[name] = {r[0] for r in docs.select("doc_id").collect()}, before
    good = {r["doc_id"] for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept").collect()}
    assert ids["quality_rules"] == good and ids["known_language"] <= good and len(ids["known_language"]) > 0.98 * len(good)
    frame = kept["one_of_near_copies"].sort_values("doc_id").reset_index(drop=True)
    first = {int(frame.doc_id[i]) for i in near_copies_by_brute_force(list(frame.text))}
    assert ids["one_of_near_copies"] == first and ids["pseudonyms"] == first
    rows = [r.asDict() for r in docs.collect()]
    assert check_packing(list(zip(kept["packed"].doc_id, kept["packed"].text)), rows) < 0.05


def test_run_gives_the_same(spark):
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and whole.count() > 0


def test_null_and_repeated_rows(spark):
    # no three words twice: a text that repeats them fails the base test
    names = "garden river letter window market engine winter bridge kitchen teacher harbour forest".split()
    good = " ".join(f"The {a} near our {b} was quiet before {c} came." for a, b, c in zip(names, names[5:] + names[:5], names[7:] + names[:7]))
    rows = [(None, good, "en", "s", 1), (1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = [(r["doc_id"], r["length"]) for r in docs.collect()]
    assert [d for d, _ in got] == [1]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_stages_with_ties_long_texts_and_clashing_columns(spark):
    """Equal rows tie for the least id; further columns go, whatever their names."""
    names = "garden river letter window market engine winter bridge kitchen teacher harbour forest".split()
    good = " ".join(f"The {a} near our {b} was quiet before {c} came." for a, b, c in zip(names, names[5:] + names[:5], names[7:] + names[:7]))
    long = " ".join(f"{a} {b} and then {c} at {i} again, with the others of the {a}." for i in range(400) for a, b, c in zip(names, names[3:] + names[:3], names[i % 12 :] + names[: i % 12]))
    rows = [(7, good, "en", "s", 1), (5, good.upper().lower(), "en", "t", 1), (5, good, "en", "t", 1), (8, good + " One more of these sentences ends it here.", "en", "s", 2), (9, long, "en", "s", 3), (9, long, "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("clash") for c in ("key", "root", "__key", "__hits", "__raw", "__rank", "k", "start", "n_email", "size")})
    for name, stage in corpus_pipeline.STAGES[2:]:
        docs = stage(spark, docs, SF)
        if name != "packed":
            assert docs.columns == corpus_pipeline.COLUMNS
            assert sorted(r["doc_id"] for r in docs.collect()) == ([5, 9] if near_copies_by_brute_force([good, rows[3][1]]) == [0, 0] else [5, 8, 9])
    assert {r["doc_id"] for r in docs.collect()} >= {5, 9} and docs.filter("doc_id = 9").count() > 1
