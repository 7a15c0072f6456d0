"""Stages of the pipeline on their own, and the chain on odd rows."""

import pytest

import corpus_pipeline
from matchloom.llm import secret_index

KIND = "doc_id long, text string, lang string, source string, n_chars long"
LEARNT = {"en": "the thing was in the hand of that other", "de": "der die das und nicht mit dem anderen", "fr": "le chat est dans la maison avec vous"}


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(100 + i, f"{text} {i}", lang, "s", 9) for lang, text in LEARNT.items() for i in range(30)]
    return [(100 * k + i, t, y, s, n) for k, (i, t, y, s, n) in enumerate(rows)]


def test_language_stage_decides(spark, taught):
    even = " ".join(w for ws in zip(*(t.split() for t in LEARNT.values())) for w in ws)
    odd = [
        (1, None, None, "s", None),
        (2, "12 34 !!", "en", "s", 8),
        (3, LEARNT["de"], None, "s", 9),
        (4, LEARNT["fr"], "en", "s", 9),
        (5, even, "en", "s", 9),
        (None, LEARNT["en"], "en", None, 9),
    ]
    docs = spark.createDataFrame(taught + odd, KIND)
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert 1 not in got and 2 not in got and got[3] == "de" and got[4] == "fr" and got[None] == "en"
    assert got.get(5, "en") == "en"
    assert {i for i, *_ in taught} <= set(got)


def test_language_stage_keeps_documents_of_known_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, small)
    assert kept.count() == docs.where("text is not null and lang is not null").count()


def test_secrets_stage_redacts_what_is_found(spark):
    texts = ["token = abcdef123456 rest", "no secret", None, "é password:hunter22 AKIA" + "Z" * 20]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], KIND)
    got = {r["doc_id"]: r for r in corpus_pipeline.remove_secrets(spark, docs, "").collect()}
    for i, text in enumerate(texts):
        want, last = "", 0
        for a, b, _ in secret_index.brute_force(text):
            want, last = want + text[last:a] + "<secret>", b
        assert got[i]["text"] == (None if text is None else want + text[last:]) and got[i]["n_chars"] == (None if text is None else len(got[i]["text"]))


def test_the_chain_on_odd_rows_and_none(spark, taught, tmp_path):
    long = " ".join(f"the hand {i} of that" for i in range(20_000))
    odd = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, LEARNT["en"] + " token = abcdef123456", "en", "s", 9),
        (4, LEARNT["en"] + " token = abcdef123456", "en", "s", 9),
        (4, LEARNT["en"] + " token = abcdef123456", "en", "s", 9),
        (5, long, "en", "s", 9),
        (None, LEARNT["de"] + " so", "de", "s", 9),
        (None, None, "de", "s", 9),
    ]
    docs = spark.createDataFrame(taught + odd, KIND)
    labels = spark.createDataFrame([(100, 1, 0), (3, 1, 0), (None, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for name, rows in (("rows", docs), ("none", docs.where("false"))):
        folder = f"{tmp_path}/{name}"
        rows.withColumn("extra", rows["lang"]).withColumn("n", rows["n_chars"]).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
        got = out.collect()
        if name == "none":
            assert not got
            continue
        ids = [r["doc_id"] for r in got]
        assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
        assert {3, 5, None} <= set(ids) and not {1, 2, 4} & set(ids) and ids.count(None) == 1 and ids.count(3) == 1
