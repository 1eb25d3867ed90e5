"""A corpus from raw documents to packed sequences, in five stages over whole tables.

quality          the ordinal classifier rejects poor and toxic documents, and those without words
near_duplicates  of documents joined by word 5-shingles with a similarity of 0.8 or more, the one with the smallest id stays
decontaminate    documents that hold a benchmark passage, re-parameterised ones too, go
personal_data    spans of personal data are replaced by marks
pack             documents become packed sequences

Nulls and edge cases are those of the operators. Rows without an id pass near_duplicates as they are. Rows that share an id
are each judged by their own text. Columns beyond those of documents are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.decontaminate import decontaminate as met_items
from faultline.llm.ngram_join import ngram_join
from faultline.llm.ordinal_quality import fit, graded, selected
from faultline.llm.packing import best_fit_packing
from faultline.llm.pii import masked
from faultline.llm.shared import small, stored

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return selected(docs, fit(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of each row that stays, as ids may be missing or shared, and the name of its column, which no column of docs has."""
    row, taken = "_row", {c.lower() for c in docs.columns}
    while row in taken:
        row += "_"
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _numbered(docs)
    named = rows.where("doc_id is not null").select(F.col(row).alias("_row"), "doc_id", "text")
    groups = ngram_join(named.select(F.col("_row").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILARITY_PERCENT)
    others = stored(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_row"), "component_id"), "others")
    linked = stored(others.unionByName(others.select(F.col("component_id").alias("_row"), "component_id").distinct()), "linked")
    linked = stored(named.select("_row", "doc_id").join(small(linked), "_row"), "ids")
    heads = stored(linked.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("head")), "heads")
    gone = stored(linked.join(small(heads), "component_id").where("_row <> head").select(F.col("_row").alias(row)), "gone")
    return rows.join(small(gone), row, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _numbered(docs)
    met = met_items(rows.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(small(stored(met, "met")), row, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = masked(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("pack", pack)]

#: No stage but the first joins can be said in SQL (a trained model, a tokenizer). Tests hold the operators against brute force; of the stages they compare
#: whole rows for near_duplicates and decontaminate on a few cases, else chosen ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
