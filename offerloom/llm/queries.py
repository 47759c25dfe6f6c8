"""One query per corpus operator, over its whole table with production parameters."""
from pyspark.sql import functions as F

from ..storage import ship
from . import conversations, extraction, fingerprints, mixing, packing, pieces, privacy, quality, rules, secrets, simhash, suffixes, whitening
from .oracles import OP2, OP9, OP11

QUERIES: dict = {}
ORACLES: dict = {"op2_suffix_array_dedup": OP2, "op9_source_mixing": OP9, "op11_conversation_repair": OP11}


def _query(fn):
    def run(spark, sf_dir):
        ship(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return run


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_document_fingerprints(spark, sf_dir):
    return fingerprints.edited_likeness(_documents(spark, sf_dir)).withColumns({
        c: fingerprints.as_hex(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


@_query
def op2_suffix_array_dedup(spark, sf_dir):
    return suffixes.digest(suffixes.dedup(_documents(spark, sf_dir)))


@_query
def op3_html_extraction(spark, sf_dir):
    return extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query
def op4_quality_classifier(spark, sf_dir):
    return quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query
def op5_personal_data(spark, sf_dir):
    return privacy.digest(privacy.find(_documents(spark, sf_dir)))


@_query
def op6_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.find(_documents(spark, sf_dir)))


@_query
def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir))


@_query
def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(_documents(spark, sf_dir)).select(
        "doc_id", simhash.unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


@_query
def op9_source_mixing(spark, sf_dir):
    return mixing.mix(_documents(spark, sf_dir))


@_query
def op10_quality_rules(spark, sf_dir):
    return rules.judge(_documents(spark, sf_dir))


@_query
def op11_conversation_repair(spark, sf_dir):
    return conversations.digest(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@_query
def op12_sentencepiece(spark, sf_dir):
    return pieces.digest(pieces.round_trip(_documents(spark, sf_dir).select("doc_id", "text")))


@_query
def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
