"""Queries of the text problems, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import encoding, language, leakage, lookalike, tokenize
from graphloom.session import table


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of each one-language stretch of every passage."""
    passages, samples = table(spark, sf_dir, "mem_passages"), table(spark, sf_dir, "lang_samples")
    found = language.detect(passages, samples, ["corpus_id", "passage_id"], F.col("normalized_text"), F.col("metadata.language"))
    return found.withColumn("confidence", F.round("confidence", 4))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(p2_segments(spark, sf_dir), ["corpus_id", "passage_id"])


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "mem_passages")
    texts = lookalike.values_of(passages, "corpus_id", "passage_id", F.col("normalized_text"), "normalized_text")
    mentions = passages.select("corpus_id", F.explode("entity_mentions").alias("mention"))
    return texts.unionByName(lookalike.values_of(mentions, "corpus_id", None, F.col("mention"), "entity_mentions"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(_texts(spark, sf_dir)).select(F.col("grp").alias("corpus_id"), F.col("field").alias("field_name"), "key_a", "key_b")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in the classes of equal-looking values, one row per key."""
    return lookalike.lookalike_classes(_texts(spark, sf_dir)).select(F.col("grp").alias("corpus_id"), F.col("field").alias("field_name"), "key", "class_id", "variants")


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling that has an equal-looking other one, with the canonical form of its class."""
    members = lookalike.canonical_members(_texts(spark, sf_dir)).filter("variants > 1")
    return members.select(F.col("grp").alias("corpus_id"), F.col("field").alias("field_name"), "value", "canonical", "variants")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).filter(F.col("literal") > 0).select("doc_id", "item_id")


def p7_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's template under other names or numbers, and no literal copy of it."""
    return leakage.reparameterised(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected documents with the chain that explains them and, where no byte was lost, the original text."""
    clean = [table(spark, sf_dir, "eval_items").select("passage"), table(spark, sf_dir, "lang_samples").select("text")]
    found = encoding.find_garbled(table(spark, sf_dir, "documents"), clean)
    return found.withColumn("gain", F.round("gain", 3))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_restored(spark, sf_dir).select("doc_id").distinct()


QUERIES = {"p2_found": p2_found, "p2_segments": p2_segments, "p5_found": p5_found, "p5_canonical": p5_canonical, "p5_classes": p5_classes, "p6_ids": p6_ids, "p7_found": p7_found, "p7_reparameterised": p7_reparameterised, "p8_found": p8_found, "p8_restored": p8_restored}
# words as the operator sees them: maximal runs of letters or digits without case
_WORDS = "list_transform(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w))"
SQL: dict[str, str] = {
    "p7_found": f"""WITH i AS (SELECT item_id, {_WORDS.format('passage')} AS w FROM eval_items),
d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (x)""",
}
