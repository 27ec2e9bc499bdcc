"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing columns: for every operator and stage."""

import pytest

import corpus_pipeline
from rillmill.llm import fingerprints, html_extract, license_scan, line_dedup, ngram_join, packing, quality_bayes, quality_rules, source_mixing, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _doc string, _n int, _set int, _host int, posterior int, TEXT string"
LONG = " ".join(f"word{i % 5000}" for i in range(60000))
ROWS = [
    (1, "Released under the MIT License.", "en", "src1", 31, "x", 1, 1, 1, 1, "other"),
    (1, "Released under the MIT License.", "en", "src1", 31, "x", 1, 1, 1, 1, "other"),
    (None, "A text whose id is null, but whose words are many.", "en", "src1", 50, None, None, None, None, None, None),
    (2, None, "en", "src1", None, "x", 1, 1, 1, 1, None),
    (3, "", None, None, 0, "x", 1, 1, 1, 1, None),
    (4, "  \n\t ", "de", None, 5, "x", 1, 1, 1, 1, None),
    (5, LONG, None, "src2", len(LONG), "x", 1, 1, 1, 1, None),
    (6, LONG + " end", "fr", "src2/path/more", None, "x", 1, 1, 1, 1, None),
    (7, "one", "fr", "src2", 3, "x", 1, 1, 1, 1, None),
    (8, "you are a stupid idiot, moron and scum", "en", "src3", 38, "x", 1, 1, 1, 1, None),
]
LABELS = "doc_id bigint, quality int, toxic int, TOXIC string"
LABELLED = [(1, 1, 0, "a"), (1, 1, 0, "a"), (8, 0, 1, "a"), (None, 1, 1, None), (7, None, None, None), (5, 1, 0, None)]


def tables(spark, rows, labels):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)


OPERATORS = {
    "op1": lambda d, lab: license_scan.license_scan(d),
    "op3": lambda d, lab: quality_rules.score_quality(d, lab),
    "op4": lambda d, lab: source_mixing.mix(d),
    "op4_all": lambda d, lab: source_mixing.mix(d, keep_all=True),
    "op5": lambda d, lab: line_dedup.dedup_lines(d),
    "op6": lambda d, lab: fingerprints.document_fingerprints(d),
    "op7": lambda d, lab: toxicity.score_toxicity(d, lab),
    "op8": lambda d, lab: ngram_join.similar_documents(d),
    "op8_keep": lambda d, lab: ngram_join.keep_one_of_each_group(d),
    "op9": lambda d, lab: packing.pack(d),
    "op10": lambda d, lab: quality_bayes.quality_posteriors(d, lab),
    "op10_all": lambda d, lab: quality_bayes.quality_posteriors(d, lab, keep_all=True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_nulls_only(spark, name):
    assert OPERATORS[name](*tables(spark, [], [])).collect() == []
    nulls = [tuple([None] * 11), tuple([None] * 11)]
    OPERATORS[name](*tables(spark, nulls, [(None, None, None, None)])).collect()


def test_scores_have_a_row_for_each_row(spark):
    d, lab = tables(spark, ROWS, LABELLED)
    for name, column in (("op3", "probability"), ("op7", "probability"), ("op10", "posterior")):
        rows = OPERATORS[name](d, lab).collect()
        assert len(rows) == len(ROWS)
        by_id = {r["doc_id"]: r[column] for r in rows}
        assert by_id[2] == by_id[3] == by_id[4] == 0.0
        assert len({r[column] for r in rows if r["doc_id"] == 1}) == 1


def test_without_labels(spark):
    d, lab = tables(spark, ROWS, [])
    assert {r["probability"] for r in OPERATORS["op3"](d, lab).collect()} == {0.0, 0.5}
    assert {r["probability"] for r in OPERATORS["op7"](d, lab).collect()} == {0.0}
    assert len(OPERATORS["op10"](d, lab).collect()) == len(ROWS)


def test_license_of_repeated_rows(spark):
    rows = OPERATORS["op1"](*tables(spark, ROWS, [])).collect()
    assert [tuple(r) for r in rows] == [(1, "MIT", 1, 0)] * 2


def test_mixing_takes_no_blank_rows_and_keeps_columns(spark):
    d, lab = tables(spark, ROWS, [])
    out = OPERATORS["op4"](d, lab).collect()
    assert {r["doc_id"] for r in out} <= {1, None, 5, 6, 7, 8}
    every = OPERATORS["op4_all"](d, lab).collect()
    assert sorted((str(r["doc_id"]), r["_epoch"]) for r in every) == sorted((str(r["doc_id"]), r["_epoch"]) for r in out)


def test_line_dedup_keeps_what_has_no_identity(spark):
    out = OPERATORS["op5"](*tables(spark, ROWS, [])).collect()
    assert len(out) == len(ROWS)  # the repeated row is one document with itself, and no run repeats
    assert out[0].__fields__ == [f.split()[0] for f in SCHEMA.split(", ")]


def test_fingerprints_of_blank_rows_are_null(spark):
    rows = OPERATORS["op6"](*tables(spark, ROWS, [])).collect()
    assert len(rows) == len(ROWS)
    assert {r["doc_id"] for r in rows if r["signature"] is None} == {2, 3, 4}


def test_near_copies(spark):
    d, lab = tables(spark, ROWS, [])
    assert sorted(tuple(r) for r in OPERATORS["op8"](d, lab).collect()) == [(5, 5, 1), (6, 5, 1)]
    kept = OPERATORS["op8_keep"](d, lab).collect()
    assert len(kept) == len(ROWS) - 1 and 6 not in {r["doc_id"] for r in kept}


def test_packing_places_every_word_once(spark):
    rows = OPERATORS["op9"](*tables(spark, ROWS, [])).collect()
    placed = {}
    for r in rows:
        placed[r["doc_id"]] = placed.get(r["doc_id"], 0) + r["n_tokens"]
    assert placed == {1: 10, None: 11, 5: 60000, 6: 60001, 7: 1, 8: 8}
    room = {}
    for r in rows:
        room.setdefault(r["window_id"], []).append((r["window_offset"], r["n_tokens"]))
    for spans in room.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= packing.WINDOW


def test_html_pages(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "<p>" + "word " * 30, None), (3, "<script>" + "x" * 100000, "b"), (4, "<p>" + LONG, "b"), (4, "<p>" + LONG, "b")]
    out = html_extract.extract_html(spark.createDataFrame(rows, "page_id bigint, html string, HTML string")).collect()
    assert len(out) == 6
    by_id = {r["page_id"]: r for r in out}
    assert by_id[1]["text"] == by_id[2]["text"] == by_id[3]["text"] == "" and by_id[4]["text"] == LONG
    assert html_extract.extract_html(spark.createDataFrame([], "page_id bigint, html string")).collect() == []


def test_every_stage(spark, tmp_path):
    d, lab = tables(spark, ROWS, LABELLED)
    lab.toDF("doc_id", "quality", "toxic", "extra").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        got = out.collect()
        empty = stage(spark, d.limit(0), str(tmp_path)).collect()
        assert empty == []
        if name != "packing":
            assert out.columns == d.columns
            assert len(got) <= len(ROWS) * source_mixing.PRODUCTION.max_epochs
