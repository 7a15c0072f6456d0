"""From raw documents to token ids: language labels, near-duplicates, secrets, mixing, encoding.

Each stage takes the documents that the one before it kept, written as Parquet and read again. All but the last
return the columns of ``documents``; a stage's decisions are in which rows it returns, and in their texts.

Edge cases: null texts and texts without a letter go in the first stage; equal and repeated rows become one; null ids
are kept, after all others; very long texts are read whole; columns but those of ``documents`` are dropped; an empty
table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import bpe_codec, langid_crf, mixture, secret_index, simhash_ball
from matchloom.llm._common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates: sets of five-word shingles of a likeness of 0.8; candidates meet in 16 SimHash tables of 32 bits.
NEAR = {"find": simhash_ball.near_texts, "words": 5, "least": 0.8}
#: Of the expected tokens of toxic documents a twentieth stays; no document is repeated, others stay whole.
KEEP, MAX_RATE = {"toxic": 0.05}, 1.0
#: A text of which no language has this part of the expected words is in none; from this score on it is sure. Of 4,000
#: documents with a known language one scores under 0.5, none under 0.45, and 998 in 1,000 agree with it.
LEAST_SCORE, SURE = 0.4, 0.9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Label texts: documents in no language (null, without a letter, or of a low score) go; a null label, and one that
    a sure prediction contradicts, becomes the predicted one."""
    model = langid_crf.train(langid_crf.training_rows(docs, F.lit(True)))
    found = langid_crf.label(docs.select(*COLUMNS), model)
    found = found.where((F.col("lang_pred") != langid_crf.UND) & (F.col("score") >= LEAST_SCORE))
    said = F.when(F.col("lang").isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(F.col("lang"))
    return found.withColumn("lang", said).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest id."""
    return simhash_ball.keep_one(docs.select(*COLUMNS), **NEAR)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; lengths follow."""
    return secret_index.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by the rates that the mixture fits to the targets."""
    return mixture.resample(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), keep=KEEP, max_rate=MAX_RATE)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text."""
    raw = bpe_codec.vocabulary(bpe_codec.RANKS)
    coded = bpe_codec.there_and_back(docs.select("doc_id", "lang", "source", "text"), raw, bpe_codec.split_pattern(), decoded=False)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", remove_secrets),
    ("mixing", mix_domains),
    ("encoding", encode_texts),
]

#: Language models, fingerprints and merges aren't expressed in SQL. Tests hold near-duplicates against all pairs, secrets
#: against Python's regular expressions, encoding against its library, rates against the optimum, languages against labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
