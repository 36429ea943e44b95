"""A corpus pipeline over `documents`: toxicity, near-duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on every row it gets, and all but the last return the columns of documents
(further columns are dropped, whatever their names). Null texts count as empty ones; null doc_ids are kept; an empty table
stays empty. What each stage does about ties and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe_codec, minhash, mixing, suffix_dedup, toxicity
from weftline.llm.common import table
from weftline.session import materialize, shipped

#: passages of more words than that which other documents hold too are cut
PASSAGE = 50
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on their labels, does not call toxic (score under 0.5).

    Equal texts get equal scores; without labels of both classes the score is the share of toxic ones.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; documents without words all stay.

    Rows that repeat a doc_id and its text are one document.
    """
    return minhash.survivors(docs.select(*COLUMNS)).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its passages of over 50 words that another document holds too; n_chars is counted anew.

    All occurrences are cut, the first as well; passages that only recur within one document stay. Whole words are cut,
    so no character is broken.
    """
    return suffix_dedup.cleaned(docs, PASSAGE, keep=("lang", "source")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in mixed order: files hold ranges of the stream one after another, each file in its order.

    Repeated rows are separate rows of the stream, in any order among themselves.
    """
    mixed = mixing.mix(docs, mixing.WEIGHTS, keep=["text", "lang", "n_chars"])
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256, round_trip, part, row of every document.

    part and row: the document's file and its place there, which order the mixed stream however files are split or put
    together while reading; null where the documents don't come from files. Repeated rows give repeated results.
    """
    try:
        docs = docs.select("doc_id", "text", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("part"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # not a scan of files
        docs = docs.select("doc_id", "text", F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("row"))
    return bpe_codec.tokenized(docs, keep=("part", "row"))


STAGES = [(name, shipped(f)) for name, f in (("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("mixing", mix_sources), ("tokens", tokenize))]

#: string kernels, component search and tokenizers have no SQL form; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
