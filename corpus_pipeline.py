"""The corpus pipeline: toxic documents go, copies go, near copies go, sources are mixed, texts become tokens.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm.bpe_trie import encode_decode
from noticelake.llm.common import load, materialize
from noticelake.llm.exact_dedup import exact_dedup
from noticelake.llm.minhash import near_dedup
from noticelake.llm.mixing import mix
from noticelake.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return drop_toxic(docs, load(spark, sf_dir, "labels"))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of docs but those whose doc_id and text (null as empty) are in dropped (doc_id, text_sha256).

    One identifier may stand on different texts, so identifiers alone do not say which row goes.
    """
    keyed = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    gone = dropped.select("doc_id", F.col("text_sha256").alias("_sha")).distinct()
    return keyed.join(gone.hint("merge"), ["doc_id", "_sha"], "left_anti").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays. Rows without an id stay."""
    return without(docs, exact_dedup(docs, keep="largest").filter("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return without(docs, near_dedup(docs, words=5, percent=80, with_sha=True).filter("not kept"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed by the square root of their sizes; a document may come several times or not at all."""
    return mix(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every copy."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mixing), ("BPE", tokens)]

#: the classifier, the near copies and the tokenizer have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents.

    Nulls in any column pass through (a null text is an empty one); empty and repeated rows count as the stages say;
    texts are taken whole; an empty table gives no rows; further columns of documents are left out.
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
