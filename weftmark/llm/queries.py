"""Registered queries of the operators, over whole tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.llm import sql
from weftmark.session import workspace

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftmark.llm.token_files import token_digests, write_token_files

    path = workspace(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_digests(spark, path)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftmark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftmark.llm.simhash import fingerprint_text, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_text().alias("fingerprint"), "component_id")


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftmark.llm.mixing import mix_by_source

    return mix_by_source(table(spark, sf_dir, "documents"))


@query("mixing_overlaps")
def mixing_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document belongs to its source and to its language, so the words of a pattern are routed to both by the flow."""
    from weftmark.llm.mixing import mix_by_sources

    docs = table(spark, sf_dir, "documents")
    named = F.array_compact(F.array(F.concat(F.lit("source:"), "source"), F.concat(F.lit("lang:"), "lang")))
    return mix_by_sources(docs.select("doc_id", "text", named.alias("sources")))


@query("op8_substrings")
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftmark.llm.substrings import repeat_digests

    return repeat_digests(table(spark, sf_dir, "documents"))


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftmark.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftmark.llm.quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftmark.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op4_kmeans_tree")
def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftmark.llm.ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query("op6_voronoi_join")
def op6_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftmark.llm.voronoi import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


@query("op13_centroids", sql.CENTROIDS)
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftmark.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


@query("op11_merkle_manifest", sql.MERKLE)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftmark.llm.merkle import audit_altered

    return audit_altered(table(spark, sf_dir, "documents"))


@query("op12_minhash", sql.MINHASH)
def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftmark.llm.minhash import keep_first

    return keep_first(table(spark, sf_dir, "documents"))
