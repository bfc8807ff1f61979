"""From documents to sampled token sequences, in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import keep_where, materialize, spare, table
from lectern.llm.decontaminate import find_contamination
from lectern.llm.ngram_join import ngram_components
from lectern.llm.piece_sampling import encode_samples
from lectern.llm.quality_model import quality_filter
from lectern.llm.quality_rules import quality_rules


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's threshold."""
    return keep_where(quality_filter(docs, table(spark, sf_dir, "labels")), F.col("quality.kept")).drop("quality")


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; lines that failed are gone from their texts, and n_chars follows."""
    judged = keep_where(quality_rules(docs), F.col("rules.kept"))
    text = F.when(F.col("rules.lost_chars") > 0, F.col("rules.clean_text")).otherwise(F.col("text"))
    judged = judged.withColumn("text", text)
    if "n_chars" in docs.columns:
        judged = judged.withColumn("n_chars", F.when(F.col("rules.lost_chars") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return judged.drop("rules")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: of those with the component's least doc_id, that with the least
    set key and text hash, and of rows that repeat in doc_id and text one. Documents without a word have no component and stay.

    A component whose documents all have a null doc_id keeps one of them; the key is the pair of doc_id and text, so that rows that
    share a doc_id but not the text are told apart. Columns are handed through, whatever their names."""
    found = ngram_components(docs)
    least = found.where(F.col("component").isNotNull() & F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(F.struct("set_key", "id", "text_key")).alias("best"))
    empty = found.where("component is null").select("id", "text_key")
    kept = least.select("best.id", "best.text_key").union(empty).distinct().select(F.col("id").alias("kept_id"), F.col("text_key").alias("kept_text"))
    (key,) = spare(docs, "__text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    stays = keyed.join(kept, keyed["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & (keyed[key] == kept["kept_text"]), "left_semi")
    return stays.dropDuplicates(["doc_id", key]).drop(key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages beyond the contamination rule."""
    return keep_where(find_contamination(docs, table(spark, sf_dir, "benchmark")), ~F.col("contamination.contaminated")).drop("contamination")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each text, with inclusion scores."""
    return encode_samples(docs, k=2, keep=["doc_id"])


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("ngram_jaccard_join", deduplicate),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece_sampling", encode),
]

#: The classifier, the components and the samples are beyond SQL; tests/llm/test_pipeline.py holds rules, deduplication and the stage order against brute force, tests/llm/test_llm.py the operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
