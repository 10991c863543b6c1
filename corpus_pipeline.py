"""A corpus from documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its result is written as
Parquet and read again as the next one's docs. Rows are told apart by a key of all their columns: the id and 128 bits
of a hash of the rest. So different texts of one id are different documents in every stage, and so are rows without
an id; rows that are alike in all columns share a verdict, and one of them is left by the near-duplicate stage. Null
texts count as empty. Very long texts pass whole. An empty table gives an empty result. Columns besides those of
``documents`` pass the first four stages, whatever their names but for those that begin with ``_siftline_``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import linededup, mixing, neardup, outliers, packing, workspace

#: No SQL: robust estimates, pivotal rounding and bin packing aren't expressible. The tests have a plain version.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW, NUMBER = "_siftline_row", "_siftline_nr"


def _spelled(name: str) -> Column:
    """A column's value such that no two rows' values, end to end, read alike."""
    value = F.col(f"`{name}`").cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.length(value).cast("string"), F.lit(":"), value))


def _with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of all columns, 128 bits of a hash."""
    return docs.withColumn(ROW, F.md5(F.concat(*map(_spelled, docs.columns)).cast("binary")))


def _once(keyed: DataFrame, counted: DataFrame) -> DataFrame:
    """``keyed`` with one of the rows that are alike; ``counted`` has how many there are of each that matters."""
    return keyed if counted.where(F.col(NUMBER) > 1).isEmpty() else keyed.dropDuplicates([ROW])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go."""
    keyed = _with_row_key(docs)
    rejected = workspace.stage(outliers.outlier_rules(keyed, key=ROW).where(~F.col("kept")).select(ROW), "pipeline-rejected")
    return keyed.join(rejected, ROW, "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in repeated windows of three go; so do documents of which nothing is left."""
    cleaned = linededup.remove_repeated_lines(docs)
    left = cleaned.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the least id: five-word shingles, similarity 0.8."""
    keyed = _with_row_key(docs)
    order = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    groups = neardup.near_duplicates(keyed.select(order.alias(ROW), "text"), ngram=5, similarity=0.8, key=ROW)
    kept = groups.where("kept").groupBy(F.col(ROW)["row"].alias(ROW)).agg(F.count("*").alias(NUMBER))
    kept = workspace.stage(kept, "pipeline-kept")
    return _once(keyed, kept).join(kept.select(ROW), ROW, "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows that are alike share what the mix takes of them."""
    keyed = _with_row_key(docs)
    copies = mixing.mix_sources(keyed, key=ROW).groupBy(ROW).agg(F.sum("copies").alias("_siftline_copies"), F.count("*").alias(NUMBER))
    copies = workspace.stage(copies, "pipeline-copies")
    taken = _once(keyed, copies).join(copies.where("_siftline_copies > 0").select(ROW, "_siftline_copies"), ROW)
    return workspace.numbered(taken, "_siftline_copies", NUMBER).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-duplicates", near_dedup), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = workspace.stage(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        workspace.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
