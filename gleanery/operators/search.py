"""Ranked search, phrases, similar documents and look-ups over scored postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.text import query_phrases, query_tokens, to_fixed

MAX_RESULTS, RARITY_WEIGHT, RARE_DF, COMMON_DF, LEAST_SCORE = 20, 0.5, 100, 10_000, 0.01


def parse_query(spark: SparkSession, query: str) -> tuple[list[str], list[list[str]]]:
    """(distinct tokens, tokens of each phrase of two tokens or more) of one query string."""
    row = spark.createDataFrame([(query,)], "q string").select(query_tokens(F.col("q")).alias("t"), F.transform(query_phrases(F.col("q")), query_tokens).alias("p")).first()
    return list(dict.fromkeys(row["t"])), [list(dict.fromkeys(p)) for p in row["p"] if len(p) > 1]


def search(postings: DataFrame, documents: DataFrame, query: str, max_results: int = MAX_RESULTS) -> DataFrame:
    """Ranked results: ``doc_id``, ``score``, ``matched_terms``, ``total_terms`` and the columns of ``documents``.

    Scores add up over the query's terms, rare terms count 1.5 times. Documents that hold all terms of a phrase
    gain 1.5 times; those that match more of several terms gain up to 1.5 times. With several terms, very
    common terms and very weak postings are skipped. The best ``max_results`` are then looked up in
    ``documents``, so documents missing there shrink the result.
    """
    spark = postings.sparkSession
    tokens, phrases = parse_query(spark, query)
    hits = postings.where(F.col("term").isin(tokens) if tokens else F.lit(False))
    if len(tokens) > 1:
        hits = hits.where((F.col("df") <= COMMON_DF) & (F.col("score") >= LEAST_SCORE))
    weight = F.when(F.col("df") < RARE_DF, 1.0 + RARITY_WEIGHT).otherwise(1.0)
    score, matched = F.sum(F.col("score") * weight), F.count_distinct("term")
    flags = [(F.count_distinct(F.when(F.col("term").isin(p), F.col("term"))) == len(p)).alias(f"phrase{i}") for i, p in enumerate(phrases)]
    found = hits.groupBy("doc_id").agg(score.alias("score"), matched.alias("matched_terms"), *flags)
    total = F.col("score")
    for i in range(len(phrases)):
        total = total * F.when(F.col(f"phrase{i}"), 1.5).otherwise(1.0)
    if len(tokens) > 1:
        total = total * (1.0 + 0.5 * F.col("matched_terms") / len(tokens))
    ranked = found.select("doc_id", to_fixed(F.round(total, 10), 6).alias("score"), "matched_terms", F.lit(len(tokens)).cast("bigint").alias("total_terms"))
    best = ranked.orderBy(F.desc("score"), "doc_id").limit(max_results)
    return documents.join(F.broadcast(best), "doc_id").select(*best.columns, *(c for c in documents.columns if c not in best.columns))


def similar_to(vectors: DataFrame, postings: DataFrame, max_results: int = MAX_RESULTS, top_terms: int = 20) -> DataFrame:
    """Documents that share the first ``top_terms`` terms of each document of ``vectors``: summed scores times the share of terms.

    ``source``, ``doc_id``, ``similarity``, ``matched_terms``; the best ``max_results`` of each source. A term has a bounded
    number of postings, so a source meets ``top_terms`` times that many rows at most.
    """
    wanted = vectors.where(F.col("rank") <= top_terms).select(F.col("doc_id").alias("source"), "term")
    sizes = wanted.groupBy("source").agg(F.count("*").alias("n"))
    hits = postings.join(wanted, "term").where(F.col("doc_id") != F.col("source"))
    found = hits.groupBy("source", "doc_id").agg(F.sum("score").alias("sum"), F.count_distinct("term").alias("matched_terms"))
    similarity = to_fixed(F.round(F.col("sum") * F.col("matched_terms") / F.col("n"), 10), 6)
    scored = found.join(sizes, "source").select("source", "doc_id", similarity.alias("similarity"), "matched_terms")
    best = Window.partitionBy("source").orderBy(F.desc("similarity"), "doc_id")
    return scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= max_results).drop("_n")


def posting_lists(postings: DataFrame, *terms: str) -> DataFrame:
    """Postings of terms by falling score; unknown terms are left out."""
    return postings.where(F.col("term").isin(list(terms))).select("term", "doc_id", "score", "count").orderBy("term", F.desc("score"), "doc_id")


def tolerant(postings: DataFrame) -> DataFrame:
    """Postings with gaps: no count is 1, no score is the ``tfidf``, or 0."""
    return postings.withColumn("score", F.coalesce("score", "tfidf", F.lit(0.0))).withColumn("count", F.coalesce("count", F.lit(1))).drop("tfidf")


def repair_min_idf(postings: DataFrame) -> DataFrame:
    """Least idf 0.001, and weak scores from the counts, for terms found in nearly all documents."""
    weak = F.col("score") < 0.0001
    return postings.withColumn("idf", F.greatest(F.col("idf"), F.lit(0.001))).withColumn("score", F.when(weak, F.col("count") / 1000 * 0.001).otherwise(F.col("score")))


def important_terms(importance: DataFrame, n: int) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "term").limit(n)


def document_details(vectors: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` terms of each document of ``vectors``."""
    return vectors.where(F.col("rank") <= n).select("doc_id", "rank", "term", to_fixed(F.col("tfidf"), 6).alias("tfidf"), "count")
