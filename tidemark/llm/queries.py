"""The corpus queries over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fertility, langid, merkle, oddsketch, packing, pieces, pii, secrets, shards, simhash, toxicity, trie, voronoi
from tidemark.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_all(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op2_fertility")
def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(read(spark, sf_dir, "documents"))


@query("op3_secrets", secrets.secret_sql())
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(read(spark, sf_dir, "documents"))


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_all(read(spark, sf_dir, "documents"))


@query("op5_shards", shards.shard_sql())
def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(read(spark, sf_dir, "documents"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(read(spark, sf_dir, "documents"))


@query("op7_personal")
def op7_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


@query("op8_neighbours", voronoi.top_k_sql())
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op9_pieces")
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(spark, sf_dir, "documents"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query("op11_manifest", merkle.prove_sql())
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove(read(spark, sf_dir, "documents"))


@query("op12_oddsketch", oddsketch.near_copies_sql())
def op12_oddsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_copies(read(spark, sf_dir, "documents"))


@query("op13_trie", trie.trie_sql())
def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))
