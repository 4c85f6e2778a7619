"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, embedding_dedup, fingerprint, license_scan, mixing, near_dedup, packing, toxicity, url_filter, warc
from .common import scratch_path, written
from .sql import ORACLES  # noqa: F401

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.tiktoken"

URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: Hosts blocked where no rule fits.
URL_LIST = ["cheap-pills.example.com", "spam-farm.example.org"]

#: A conversation whose texts are made of control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    listed = spark.createDataFrame([(x,) for x in URL_LIST], "rule string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, listed)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], turns.schema)
    path, pattern = tokenizer_path(BYTE_TOKENIZER), tokenizer_pattern()
    return chat_format.read_back(chat_format.format_chats(turns.union(more), path, pattern), path, pattern)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, lexicon, score_col="score", flag_col="predicted")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))
    digests = written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    placed = packing.pack(digests)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_toxicity": op4_toxicity,
    "op5_license_scans": op5_license_scans,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_warc": op10_warc,
    "pipeline": pipeline,
}
