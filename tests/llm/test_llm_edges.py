"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolesift.llm.bpe import decode_ids, encode_and_decode, encode_texts, round_trip
from rolesift.llm.decontamination import decontaminate
from rolesift.llm.exact_dedup import exact_duplicates
from rolesift.llm.filtering import free_name
from rolesift.llm.jaccard_join import near_duplicates
from rolesift.llm.language_id import identify_languages, with_language
from rolesift.llm.line_dedup import drop_boilerplate
from rolesift.llm.quality import score_quality
from rolesift.llm.sharding import even_tree, shard_documents
from rolesift.llm.simhash import simhash_duplicates
from rolesift.llm.token_alignment import align_tokens
from rolesift.llm.toxicity import score_toxicity
from rolesift.llm.url_filter import UrlRule, judge_urls

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
LONG = "very long text " * 20_000
CLASHING = (
    "id row digest sha n_bytes chunk key word token node n tokens prefix component kept score held_out predicted "
    "lang_pred __lang_pred __score __id_key __text_key text_digest draw _id _slice shard slot token_ids decoded window w"
).split()
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en"),
    (1, "the quick brown fox jumps over the lazy dog", "en"),
    (1, "another text under the same id", "en"),
    (None, "the quick brown fox jumps over the lazy dog", None),
    (None, None, None),
    (2, None, "en"),
    (3, "", "de"),
    (4, " \n\t ", "de"),
    (5, "12 34 !?", "fr"),
    (6, LONG, "en"),
    (7, LONG.replace(" ", "\n"), None),
    (8, "日本語 été \U0001f600", "ja"),
    (9, "x" * 100_000, "xx"),
]
OPERATORS = {
    "op1": lambda d, lab: identify_languages(d),
    "op3": lambda d, lab: score_toxicity(d, lab),
    "op4": lambda d, lab: decontaminate(d, d.sparkSession.createDataFrame([(1, "quick brown fox"), (None, None)], "item_id long, text string")),
    "op5": lambda d, lab: drop_boilerplate(d, "source"),
    "op6": lambda d, lab: near_duplicates(d),
    "op7": lambda d, lab: exact_duplicates(d),
    "op8": lambda d, lab: score_quality(d, lab),
    "op9": lambda d, lab: round_trip(d, RANKS, PATTERN),
    "op10": lambda d, lab: shard_documents(d, even_tree(24), even_tree(25)),
    "op11": lambda d, lab: align_tokens(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")),
    "op13": lambda d, lab: simhash_duplicates(d),
}


def documents(spark, rows=ROWS):
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    base = base.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return base.select("*", *[F.lit(None if i % 3 else "clash").cast("string").alias(c) for i, c in enumerate(CLASHING)])


def labels(spark, rows=((1, 1, 0), (6, 1, 1), (9, 0, 1), (None, 1, 1), (3, None, None), (999, 1, 1), (6, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def results(spark):
    return {name: run(documents(spark), labels(spark)).collect() for name, run in OPERATORS.items()}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row_whatever_it_holds(results, name):
    assert sorted(str(r.doc_id) for r in results[name]) == sorted(str(i) for i, _, _ in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](documents(spark, []), labels(spark, [])).collect() == []
    some = OPERATORS[name](documents(spark), labels(spark, [])).collect()
    assert len(some) == len(ROWS)


def test_languages_of_odd_texts(results):
    said = {r.doc_id: r.lang_pred for r in results["op1"] if r.doc_id not in (None, 1)}
    assert {said[i] for i in (2, 3, 4, 5)} == {"und"}
    assert said[6] == said[7] != "und" and said[8] != "und"
    assert all(0 <= r.score <= 1 for r in results["op1"])


def test_language_columns_are_replaced(spark):
    out = with_language(documents(spark), out=("lang_pred", "score"))
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", *CLASHING])
    assert out.filter("lang_pred = 'und'").count() == 5 and dict(out.dtypes)["score"] == "double"


def test_scores_of_equal_and_empty_texts(results):
    for op in ("op3", "op8"):
        empty = {r.score for r in results[op] if r.doc_id in (2, 3)}
        assert len(empty) == 1 and all(0 <= r.score <= 1 for r in results[op])


def test_contamination_of_repeated_rows(results):
    assert sorted(r.n_hit for r in results["op4"] if r.doc_id == 1) == [0, 3, 3]
    assert [(r.n_words, r.n_hit) for r in results["op4"] if r.doc_id == 6] == [(60_000, 0)]
    assert {r.items_sha256 for r in results["op4"] if r.n_hit == 0} == {hashlib.sha256(b"").hexdigest()}


def test_lines_of_odd_rows(results):
    # the only site has 13 pages; one line stands on three of them
    of = {}
    for r in results["op5"]:
        of.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_dropped))
    assert sorted(of[1]) == [("", 1, 1), ("", 1, 1), ("another text under the same id", 1, 0)]
    assert sorted(of[None], key=str) == [("", 1, 1), (None, 0, 0)]
    assert of[2] == [(None, 0, 0)] and of[3] == [("", 0, 0)] and of[4] == [(" \n\t ", 0, 0)]
    assert of[6] == [(LONG, 1, 0)] and of[7][0][0].count("very") == 0 or of[7][0][1] == 60_000


def test_components_of_odd_rows(results):
    of = {}
    for r in results["op6"]:
        of.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert sorted(of[1]) == [(2, 1, True), (5, 1, False), (5, 1, True)]
    assert sorted(of[None], key=str) == [(0, None, True), (5, 1, False)]
    assert of[2] == [(0, 2, True)] and of[3] == [(0, 3, True)] and of[4] == [(0, 4, True)]
    assert of[6] == [(3, 6, True)] and of[7] == [(3, 6, False)] and of[9] == [(1, 9, True)]


def test_duplicates_of_odd_rows(results):
    of = {}
    for r in results["op7"]:
        of.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert sorted(of[1]) == [(1, 1, True), (1, 3, False), (1, 3, True)]
    assert sorted(of[None], key=str) == [(1, 3, False), (2, 3, False)]
    assert of[2] == [(2, 3, True)] and of[3] == [(2, 3, False)] and of[4] == [(4, 1, True)]
    assert of[6] == [(6, 2, True)] and of[7] == [(6, 2, False)]


def test_slots_of_repeated_rows(results):
    slots = {}
    for r in results["op10"]:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in results["op10"] if r.doc_id == 1}) == 1


def test_urls_of_odd_rows(spark):
    rows = [(None, None), (1, "http://a.net/"), (1, "http://a.net/"), (2, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns(
        {c: F.lit("clash") for c in ("id", "host", "path", "rule", "verdict")}
    )
    rule = [UrlRule("net", "/", "allow"), UrlRule("net", "/", "block")]
    got = sorted(((r.page_id, r.host, r.rule, r.verdict) for r in judge_urls(pages, rule).collect()), key=str)
    assert got == [(1, "a.net", "net/", "block"), (1, "a.net", "net/", "block"), (2, "", None, "allow"), (None, "", None, "allow")]
    assert judge_urls(pages.limit(0), rule).collect() == []


def test_token_ids_replace_a_column_and_keep_the_rest(spark):
    out = encode_texts(documents(spark), RANKS, PATTERN)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", *CLASHING])
    assert out.filter("text is null and size(token_ids) = 0").count() == 2


def test_free_names():
    assert free_name(["A", "a_"], "a") == "a__" and free_name([], "a") == "a"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(1, "quick brown fox"), (None, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


STAGE_KEEPS = {
    "language_id": [1, 1, 1, 6, 7, 8, 9, None],
    "exact_dedup": [1, 1, 2, 4, 5, 6, 8, 9],
    "near_dedup": [1, 1, 2, 3, 4, 5, 6, 8, 9, None],
    "decontamination": [1, 2, 3, 4, 5, 6, 7, 8, 9, None],
    "byte_bpe": [i for i, _, _ in ROWS],
}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, sf_dir, name, stage):
    docs = documents(spark)
    out = stage(spark, docs, sf_dir)
    if name != "byte_bpe":
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(STAGE_KEEPS[name], key=str)
    assert stage(spark, documents(spark, []), sf_dir).collect() == []


def test_no_benchmark_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate(documents(spark), none).collect()
    assert len(found) == len(ROWS) and not any(r.contaminated or r.n_items for r in found)


@pytest.mark.parametrize("ids, lang", [(range(1, 30), None), ([i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 3 == 1], "en"), ([i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 3 == 1], "blank")])
def test_first_stage_keeps_clean_documents_without_any_profile(spark, ids, lang):
    ids = list(ids)
    rows = [(i, f"a clean text {i}", lang) for i in ids] + ([(1, "12", lang)] if lang == "blank" else []) + [(ids[0], None, lang), (ids[0], "12 !? \u3000", lang), (ids[0], "\u65e5\u672c", lang)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.known_language(spark, docs, "").collect()
    assert sorted(r.text for r in kept) == sorted([f"a clean text {i}" for i in ids] + ["\u65e5\u672c"])
    assert {r.lang_pred for r in with_language(docs).collect()} == {"und"}


def test_encoding_and_decoding_in_one_pass_equals_both(spark):
    """Also with columns that have the names of the result, and for a table without rows."""
    docs = documents(spark).drop("decoded").withColumns({"token_ids": F.lit("x"), "decoded_sha256": F.lit(1)})
    both = decode_ids(encode_texts(docs, RANKS, PATTERN), RANKS, PATTERN)
    both = both.drop("text", "decoded_sha256").withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")
    once = encode_and_decode(docs, RANKS, PATTERN)
    assert sorted(once.columns) == sorted(both.columns)
    order = sorted(both.columns)
    assert sorted(map(repr, once.select(order).collect())) == sorted(map(repr, both.select(order).collect()))
    assert encode_and_decode(docs.limit(0), RANKS, PATTERN).count() == 0
