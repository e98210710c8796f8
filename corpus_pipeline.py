"""The corpus pipeline: language, near duplicates, mixing to weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.llm import op1_mix, op2_pack, op7_language, op8_jaccard
from reelmark.llm.frames import table
from reelmark.plans.joins import measured_join
from reelmark.session import cut_lineage, job, scratch_path

TOKENIZER = "byte_bpe_50k.json"
HAS_LETTER = r"\p{L}"
ROW, BUCKET, BITS = "_row_of_the_stage", "_bucket_of_the_stage", "_bits_of_the_stage"
_POSITION = f"bitmap_bit_position({ROW} + 1)"  # in the bitmap of the row's bucket


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language (no text, no letters) go; a missing label becomes the predicted one.

    Where no label can be learned, so that none can be predicted, it stays null.
    """
    model = op7_language.fit(docs, F.lit(True))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(HAS_LETTER), F.lit(False)))
    judged = op7_language.identify(docs, model).where(F.col("lang_pred") != op7_language.UNKNOWN)
    named = F.col("doc").withField("lang", F.coalesce("doc.lang", "lang_pred"))
    return judged.select(named.alias("doc")).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays; documents without words link with nothing and stay.

    ``docs`` are read from files, as between stages: rows are told apart by their place in these.
    """
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())  # of files: the same rows get the same numbers again
    path = scratch_path(spark, "stay")
    _write_kept(spark, numbered, path)
    # A bit a row is small enough for every task, so the texts stay where they are.
    marked = measured_join(numbered.withColumn(BUCKET, _bucket()), spark.read.parquet(path), BUCKET, "inner")
    byte = F.conv(F.hex(F.substring(F.col(BITS), F.expr(f"CAST({_POSITION} div 8 + 1 AS INT)"), F.lit(1))), 16, 10).cast("int")
    stays = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, CAST({_POSITION} % 8 AS INT))")) != 0, F.lit(False))
    return marked.where(stays).drop(ROW, BUCKET, BITS)


def _bucket() -> Column:
    return F.bitmap_bucket_number(F.col(ROW) + 1)


@job
def _write_kept(spark: SparkSession, numbered: DataFrame, path: str) -> None:
    """Which rows stay, as bitmaps without their empty ends; all other tables of the join go when it ends."""
    found = op8_jaccard.jaccard_components(numbered, key=ROW)
    kept = found.where(F.col("kept")).select(F.col("key").alias(ROW)).withColumn("_at", F.expr(_POSITION))
    bits = kept.groupBy(_bucket().alias(BUCKET)).agg(F.bitmap_construct_agg("_at").alias(BITS), F.max("_at").alias("_last"))
    bits.select(BUCKET, F.substring(F.col(BITS), F.lit(1), F.expr("CAST(_last div 8 + 1 AS INT)")).alias(BITS)).write.parquet(path)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shard by shard, shuffled within each."""
    drawn = op1_mix.mix(docs, op1_mix.words(F.col("text"))).select("doc", F.explode("draws").alias("draw"))
    order = op1_mix.order_key(53, F.col("doc.doc_id"), F.col("draw.pass"))
    rows = drawn.select("doc", F.col("draw.shard").alias("shard"), order.alias("order"))
    return rows.repartition("shard").sortWithinPartitions("shard", "order").select("doc.*")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    return op2_pack.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_documents),
]

#: SQL can't express suffix automata, the tokenizer's merges or the packing; tests/llm compares by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
