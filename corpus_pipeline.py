"""The corpus pipeline: toxicity, quality rules, SimHash near-dedup, suffix-array dedup, packing, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common, packing, quality, simhash, suffix_dedup, toxicity
from tesserae.llm.queries import VOCABULARY

#: Columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_FROM, SHINGLE, RADIUS, WINDOW = 0.5, 3, 2, 1024


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance score calls toxic go; the model is fitted on labelled rows among docs that aren't held out."""
    model = toxicity.fit_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs.select(*COLUMNS), model, TOXIC_FROM)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules themselves go, and those of hosts whose shrunk failure rate is too high."""
    verdicts = quality.host_verdicts(common.cut(quality.measures(docs), "measures")).where(~F.col("host_ok")).select("host")
    return quality.filter_rows(docs.select(*COLUMNS), verdicts)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-equal fingerprints stays, the first by (id, null last; place), whatever ids repeat or lack."""
    return simhash.first_rows(docs.select(*COLUMNS), SHINGLE, RADIUS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that stand earlier in the corpus go from the texts; the documents stay, with their new lengths."""
    return suffix_dedup.remove(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, VOCABULARY, WINDOW)


STAGES = [("toxicity", toxic), ("quality_rules", rules), ("simhash_near_dedup", near_copies), ("suffix_array_dedup", substrings), ("packing", pack)]

#: Dictionaries, fingerprints and tokens aren't expressible in SQL; tests hold run() against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs, name)
    return docs
