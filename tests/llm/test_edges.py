"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import public_tokenizers
import pytest

import corpus_pipeline
from tillscope.llm import (
    hamming_topk,
    html_extract,
    language_id,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    secrets,
    sharding,
    simhash,
)

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score double, size int, base string, found string, start string, shard string, kept string, row string, key string, __text string"
)
EXTRA = (0.5, 7, "b", "f", "s", "x", "k", "r", "y", "t")
LONG = "Lorem ipsum dolor sit amet " * 40_000


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        _row(1, None),
        _row(2, ""),
        _row(3, " \n\t "),
        _row(4, "123 !!! 456"),
        _row(5, LONG, "la", None),
        _row(6, "the same words here", None, "b"),
        _row(7, "the same words here", "en", "b"),
        _row(7, "the same words here", "en", "b"),
        _row(None, "no id at all in this row", None, None),
        _row(None, None, None, None),
        _row(8, "naïve façade 😀 ça".encode("utf-16", "surrogatepass").decode("utf-16"), "fr", "c"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None) for i in range(9)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "languages": language_id.languages,
    "rules": quality_rules.apply_rules,
    "secrets": secrets.secret_spans,
    "packing": lambda docs: packing.pack_documents(docs, VOCABULARY),
    "mixing": mixing.mixed_documents,
    "sharding": sharding.shard_documents,
    "simhash": simhash.near_duplicates,
}
ONE_ROW_EACH = {"languages", "rules", "secrets", "mixing", "sharding", "simhash"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd):
    rows = OPERATORS[name](odd).collect()
    if name in ONE_ROW_EACH:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    else:
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.collect()}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty):
    assert OPERATORS[name](empty).collect() == []


def test_scores_of_odd_rows(odd, labels):
    network = quality_classifier.fit(odd, labels)
    rows = quality_classifier.score(odd, network).collect()
    assert len(rows) == 11
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[1] == by[2]


def test_languages_without_a_letter_are_undetermined(odd):
    by = {r["doc_id"]: r for r in language_id.languages(odd).collect() if r["doc_id"] is not None}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (1, 2, 3, 4))


def test_no_known_language_and_no_label(spark, odd, empty):
    none = odd.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in language_id.languages(none).collect()} == {"und"}
    unlabelled = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    network = quality_classifier.fit(odd, unlabelled)
    assert quality_classifier.score(odd, network).count() == 11
    assert quality_classifier.score(empty, network).count() == 0


def test_pages(spark):
    schema = "page_id long, url string, html string, host string, part int, text string"
    rows = [(1, None, None, "h", 1, "t"), (2, "http://a/x", "", "h", 1, "t"), (2, "http://a/x", "<p>one", "h", 1, "t"), (None, "http://a/y", "<p>two", None, None, None)]
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_extract.extract(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", "", 0), ("2", "", 0), ("2", "one", 3), ("None", "two", 3)]
    assert html_extract.extract(spark.createDataFrame([], schema)).collect() == []


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, id string"
    rows = [(0, None, 1, "c", "i"), (100, [1.0, None, -1.0], 1, "c", "i"), (100, [1.0, None, -1.0], 1, "c", "i"), (5, [1.0] * 80, 1, "c", "i"), (None, [1.0], 1, "c", "i")]
    got = hamming_topk.every_hundredth(spark.createDataFrame(rows, schema)).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 100, 1), (0, 2, 5, 64), (100, 1, 0, 1), (100, 2, 5, 63)]
    assert hamming_topk.every_hundredth(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("kind", ["int", "string", "bigint"])
def test_ids_of_any_type_are_searched(spark, kind):
    rows = [(i, (i * 2654435761) % 2**62) for i in range(60)] + [(None, 5)]
    coded = spark.createDataFrame(rows, "id long, code long").selectExpr(f"cast(id as {kind}) as id", "code")
    got = hamming_topk.top_k(coded, coded.where("cast(id as int) in (3, 30)"), 4).collect()
    plain = {i: c for i, c in rows if i is not None}
    for q in (3, 30):
        order = sorted(((plain[q] ^ c).bit_count(), str(i) if kind == "string" else i) for i, c in plain.items() if i != q)[:4]
        assert [(r["distance"], r["id"]) for r in sorted(got, key=lambda r: r["rank"]) if str(r["query_id"]) == str(q)] == order


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(name, stage, spark, odd, empty, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    made = stage(spark, odd, str(tmp_path))
    if stage is not corpus_pipeline.pack:
        assert made.columns == odd.columns
        assert made.dtypes == odd.dtypes
        for r in made.collect():
            assert r["base"] == "b" and r["row"] == "r"
    else:
        assert made.count() >= 11
    assert stage(spark, empty, str(tmp_path)).collect() == []
