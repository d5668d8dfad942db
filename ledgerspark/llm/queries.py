"""Queries of this folder, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import leakage, names, tokens, toxicity
from ledgerspark.plans.registry import Registry, table
from ledgerspark.shared import cut

R = Registry()


@R.add("p6_ids")
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


@R.add("p6_round_trip", "select doc_id, coalesce(text, '') as text from documents")
def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text from its ids alone."""
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


@R.add("p6_counts", "select count(*) as n, count(*) filter (text is null or text = '') as n_empty, sum(length(coalesce(text, '')))::bigint as n_chars from documents")
def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as its ids have it: documents, those without any id, and characters."""
    back = tokens.decode(tokens.encode(table(spark, d, "documents")))
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == "").alias("n_empty"), F.sum(F.length("text")).alias("n_chars"))


@R.add("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_spans(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id").distinct()


@R.add("p7_items")
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item that leaked: documents that hold a stretch of it, and the longest stretch in words."""
    spans = leakage.leak_spans(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return spans.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("words").alias("longest"))


@R.add("p7_cleaned")
def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The documents without the stretches, and without the documents that are stretches for the most part."""
    # equal texts hold equal stretches, while doc_id may be null or repeated
    docs = table(spark, d, "documents").withColumn("_key", F.sha2("text", 256))
    spans = cut(leakage.leak_spans(docs, table(spark, d, "benchmark"), id_col="_key"))
    return leakage.without_spans(docs, spans, id_col="_key").select("doc_id", "text")


@R.add("p4_entities")
def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every signature that is somebody's with its entity, named by the smallest id in it, and the entity's size."""
    linked = cut(names.link(table(spark, d, "signatures")).distinct())
    sizes = linked.groupBy("entity").agg(F.min("sig_id").alias("first_sig"), F.count(F.lit(1)).alias("n"))
    return linked.join(sizes, "entity").select("sig_id", "first_sig", "n")


@R.add("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.link(table(spark, d, "signatures")))


@R.add("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    chain = toxicity.fit(docs, table(spark, d, "labels"))
    return toxicity.score(docs, chain).filter("bad").select("doc_id")


@R.add("p8_rates")
def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, bad ones, their share, and the mean of each kind's score."""
    docs = table(spark, d, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels")))
    both = docs.select("doc_id", "source").join(scored, "doc_id")
    kinds = [F.round(F.avg(k), 4).alias(f"mean_{k}") for k in toxicity.KINDS]
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("int")).alias("n_bad"), F.round(F.avg(F.col("bad").cast("int")), 6).alias("rate"), *kinds)
