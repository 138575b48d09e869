"""Corpus pipeline over documents: language ID, n-gram Jaccard join, suffix-array dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents.

Defined cases: an empty table passes through all stages; rows without an id, and rows that share one, are documents of
their own unless their texts are near duplicates; null and letterless texts go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.bpe import bpe_digests
from weft.llm.common import crc_mod, materialize
from weft.llm.jaccard import jaccard_sets
from weft.llm.langid import identify, train_on
from weft.llm.mixing import mix_sources
from weft.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that op8 calls `und` (null, or without a letter), and no others: mixed text stays; learns as op8 does."""
    docs = docs.select(*COLUMNS)
    model = train_on(docs.where(F.expr(crc_mod("doc_id", 5)) != 0))
    return identify(docs, model).where(F.col("lang_pred") != "und").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked ones: that of least id (nulls last). Blank texts are linked with nothing and stay.

    Rows are told apart by id and a hash of the other columns, so null or repeated ids do no harm.
    """
    docs = docs.select(*COLUMNS)
    mark = F.xxhash64(*COLUMNS[1:])
    table, sets = jaccard_sets(docs, mark=mark)
    first = table.join(sets.where("no = component").select("sid", "rep"), "sid").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    keep = first.groupBy("sid").agg(F.min("doc_id").alias("kept_id"), F.min("mark").alias("kept_mark")).select("kept_id", "kept_mark", F.lit(False).alias("blank"))
    keep = keep.union(table.where("sid is null").select("doc_id", "mark", F.lit(True)).distinct())
    marked = docs.withColumn("mark", mark)
    kept = marked.join(keep, marked["doc_id"].eqNullSafe(keep["kept_id"]) & (marked["mark"] == keep["kept_mark"]))
    own = F.when(F.col("blank"), F.monotonically_increasing_id())
    return kept.withColumn("own", own).dropDuplicates(["doc_id", "mark", "own"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts (halves of characters too); documents that become empty go. Null ids do no harm."""
    cut = remove_repeats(docs.select(*COLUMNS))
    return cut.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))).where("n_removed = 0 or length(text) > 0").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; documents without a source are a source of their own."""
    mixed = mix_sources(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's tokens, and the digest of what they decode to; a row for each copy."""
    import public_tokenizers

    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language id", language_id), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("source mix", source_mix), ("tokens", tokens)]
#: Learning, components and systematic rounding have no SQL here; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
