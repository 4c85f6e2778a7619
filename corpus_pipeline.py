"""From documents to packed training sequences: toxicity, near duplicates, mixing, packing.

Defined cases, for every stage: null ids, texts, languages and sources are kept as they are and handled as the operators
say (a null text is an empty one); of an empty table a stage gives an empty one; columns other than COLUMNS are dropped,
whatever their names; repeated rows are rows of their own, but near_dedup keeps one of them. The last stage's rows are
pieces, not documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import mixing, near_dedup, packing, toxicity
from vellum.llm.common import clean_up, scratch_path, scratch_tables, written
from vellum.llm.queries import WORD_TOKENIZER, table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. The lexicon learns from this stage's own labelled documents."""
    lexicon = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), lexicon).where("toxic_flag = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a similarity of 0.8, the one with the smallest id stays; documents without words, and null ids, stay."""
    return near_dedup.deduplicated(docs.select(*COLUMNS), k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows that share an id are documents of their own if their sources or sizes differ, else taken alike."""
    key = ["doc_id", "source", "size"]
    mixed = mixing.mix(docs.select(*COLUMNS)).groupBy(*key).agg(F.max("copies").alias("copies")).where("copies > 0")
    mixed = mixed.select(*[F.col(c).alias(f"mixed_{c}") for c in key], "copies")
    own = docs.select(*COLUMNS, mixing.size_of(F.col("text")).alias("size"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"mixed_{c}"))
    return own.join(mixed, same).select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its place in the packed sequences."""
    pieces = packing.encode_pieces(docs, tokenizer_path(WORD_TOKENIZER))
    digests = written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packing.pack(digests)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokens and a fitted lexicon have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        mark = scratch_tables(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        clean_up(spark, since=mark)  # what the stage wrote on its way
        docs = spark.read.parquet(path)
    return docs
