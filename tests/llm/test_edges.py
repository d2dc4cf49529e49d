"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator
and every stage of the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import exact_dedup, html_extract, language_id, line_dedup, mixing, ngram_join, packing, pii, quality, substring_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ENGLISH = "the house and the garden were quiet while the people walked to the river and back again"
LONG = " ".join(f"word{i % 977} and the" for i in range(40_000))
ROWS = [
    (1, ENGLISH, "en", "web", None), (1, ENGLISH, "en", "web", None), (2, ENGLISH, None, None, 5), (3, None, "en", "web", None), (4, "", "en", "web", 0), (5, " \n\t ", "en", None, 5),
    (6, LONG, "en", "books", None), (7, LONG + " tail", "en", "books", None), (None, ENGLISH + " once more", "en", "web", None), (None, None, None, None, None), (8, "12345 67890", "en", "web", None), (9, "a", "en", "web", None),
]
CLASH = ("p", "key", "size", "rid", "gid", "digit", "rest", "shard", "h", "n", "e", "bin", "copies", "least", "n_lines", "n_dropped", "__rid", "__copies", "__copy", "__gone", "x0", "narrow", "wide", "keep", "block", "units", "root", "v", "a", "b", "rate", "w", "tokens")

OPERATORS = {
    "packing": packing.pack, "language_id": language_id.identify, "pii": pii.find_pii, "exact": exact_dedup.exact_duplicates, "ngram": ngram_join.similar_documents, "ngram_pairs": ngram_join.similar_pairs, "quality": quality.reject_outliers,
    "scores": quality.score, "mixing": mixing.copies_table, "mix_rows": mixing.mix_sources, "substring": substring_dedup.repeated_passages, "lines": line_dedup.dedup_lines, "keep_known": language_id.keep_known,
    "near": ngram_join.drop_near_copies, "lines_routed": lambda d: line_dedup.dedup_lines(d, resident_bytes=-1), "exact_shuffled": lambda d: exact_dedup.exact_duplicates(d, broadcast_bytes=-1),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, docs, name):
    small = docs.where("text is null or length(text) < 1000")
    more = small
    for i, c in enumerate(CLASH):
        more = more.withColumn(c, F.lit(f"x{i}"))
    want = OPERATORS[name](small)
    got = OPERATORS[name](more)
    assert rows(got, *want.columns) == rows(want)


@pytest.mark.parametrize("name", OPERATORS)
def test_all_null_rows(spark, name):
    out = OPERATORS[name](spark.createDataFrame([(None,) * 5] * 3, DOCS)).count()
    assert out == {"language_id": 3, "lines": 3, "lines_routed": 3, "near": 3, "scores": 3, "mixing": 1, "mix_rows": 3}.get(name, 0)


def test_exact(docs):
    assert rows(exact_dedup.exact_duplicates(docs)) == [(1, 1, 3), (1, 1, 3), (2, 1, 3)]


def test_ngram_pairs(docs):
    found = rows(ngram_join.similar_pairs(docs), "doc_id", "match_id")
    assert found == [(1, 2), (6, 7)]


def test_near_copies_keep_the_first_and_rows_without_an_id(docs):
    kept = sorted((r.doc_id for r in ngram_join.drop_near_copies(docs).collect()), key=lambda x: (x is not None, x))
    assert kept == [None, None, 1, 1, 3, 4, 5, 6, 8, 9]


def test_substring(docs):
    found = {r.doc_id for r in substring_dedup.repeated_passages(docs).where("later").collect()}
    assert found == {6, 7}


def test_packing_takes_every_word_once(docs):
    got = {(r.doc_id, r.n) for r in packing.pack(docs).groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()}
    words = len(ENGLISH.split())
    assert got == {(1, 2 * words), (2, words), (6, 120_000), (7, 120_001), (8, 2), (9, 1), (None, words + 2)}


def test_language_of_what_has_no_letters(docs):
    out = {(r.doc_id, r.keep) for r in language_id.identify(docs).collect()}
    assert {(3, False), (4, False), (5, False), (8, False), (6, True), (1, True)} <= out


def test_without_labels_texts_with_letters_stay(spark):
    out = language_id.identify(spark.createDataFrame([(1, "some words"), (2, "12")], "doc_id bigint, text string"))
    assert rows(out, "doc_id", "language", "keep") == [(1, None, True), (2, None, False)]


def test_quality_keeps_only_texts_with_words(docs):
    assert {r.doc_id for r in quality.score(docs).where("distance is null").collect()} == {3, 4, 5, None}


def test_mixing_decides_equal_rows_alike(docs):
    out = mixing.mix_sources(docs, budget=2.5)
    n = out.groupBy("doc_id").count().collect()
    assert next(r["count"] for r in n if r.doc_id == 1) % 2 == 0
    assert out.columns == docs.columns


def test_html(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p"), (4, "<html><body><p>" + "word " * 30_000), (None, "<p>x</p>"), (4, "<div><p>a<b>c</p></div></span>")], "page_id bigint, html string")
    model = html_extract.train([], rounds=1)
    out = {(r.page_id, r.n_blocks): r for r in html_extract.extract(pages.withColumn("text", F.lit("clash")).withColumn("labels", F.lit(1)), model).collect()}
    assert out[1, 0].text is None and out[2, 0].text == "" and out[4, 1].n_blocks == 1 and (None, 1) in out and (4, 2) in out
    assert html_extract.extract(pages.limit(0), model).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    """Every stage takes whatever documents there are, and all but the last keep the columns."""
    clash = docs.withColumn("key", F.lit("k")).withColumn("__rid", F.lit("k")).withColumn("n_lines", F.lit("k"))
    for df in (docs, docs.limit(0), clash, spark.createDataFrame([(None,) * 5] * 2, DOCS)):
        out = stage(spark, df, "")
        out.collect()
        if (name, stage) != corpus_pipeline.STAGES[-1]:
            assert out.columns == df.columns
