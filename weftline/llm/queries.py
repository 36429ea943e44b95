"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe_codec, collision_ann, jaccard_join, katz, minhash, mixing, quality, resampling, suffix_dedup, syncmers, token_counts, toxicity, wand
from weftline.llm.common import table
from weftline.session import shipped

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("component")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.WEIGHTS)


def op6_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return collision_ann.neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: shipped(f) for f in (op1_suffix_dedup, op2_syncmers, op3_minhash, op4_toxicity, op5_mixing, op6_collision_ann, op7_bpe_codec, op8_token_counts, op9_katz, op10_quality, op11_wand, op12_resampling, op13_jaccard_join)}


def oracles() -> dict[str, str]:
    found = {"op3_minhash": minhash.ORACLE, "op5_mixing": mixing.oracle(mixing.WEIGHTS), "op11_wand": wand.ORACLE, "op12_resampling": resampling.ORACLE, "op13_jaccard_join": jaccard_join.ORACLE}
    return found if corpus_pipeline.ORACLE_SQL is None else found | {"pipeline": corpus_pipeline.ORACLE_SQL}
