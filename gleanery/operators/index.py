"""Inverted index: term counts, TF-IDF, postings, importance, document vectors, shards.

``N`` is the number of documents with at least one term. The term frequency's denominator is the number of a
document's terms (``"terms"``), of its raw words (``"words"``) or of its distinct terms (``"distinct"``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import QUERY_STOPWORDS, has_term, raw_tokens, shard_key, terms, to_fixed
from gleanery.operators.blocks import best_postings
from gleanery.operators.rowwise import by_repetition, explode_counts

#: Terms that a join broadcasts at most (some 10 MB). They hold 92 to 93 of 100 postings of the check tables at both sizes.
FREQUENT = 100_000
TOP_POSTINGS, TOP_TERMS, GLOBAL_TERMS, MIN_IMPORTANCE = 500, 50, 10_000, 0.05
#: Boosts of taxonomy levels (fixed values); others count 1.
TAXONOMY_BOOSTS = {"kingdom": 5.0, "phylum": 4.0, "class": 3.0, "order": 2.5, "family": 2.0, "genus": 1.5}


def term_counts(docs: DataFrame, stopwords=QUERY_STOPWORDS, id_col: str = "doc_id", text_col: str = "text", denominator: str = "terms") -> DataFrame:
    """``doc_id``, ``term``, ``count``, ``total`` of every document with a term.

    Terms are counted in the document's own row, so nothing is shuffled but the ids, by which the texts of repeated ids are united.
    """
    return counts_in_rows(united(docs, id_col, text_col), stopwords, denominator)


def united(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text``: one row for each id; the texts of a repeated id are joined by a space."""
    single, several = by_repetition(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    return single.unionByName(several.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text")))


def counts_in_rows(docs: DataFrame, stopwords=QUERY_STOPWORDS, denominator: str = "terms") -> DataFrame:
    """``term_counts`` of a table whose ``doc_id`` is in one row each; columns besides ``text`` stay."""
    others = [c for c in docs.columns if c != "text"]
    kept = docs.select(*others, "text", terms(F.col("text"), stopwords).alias("terms"))
    # the total is a column of its own before the terms are exploded: behind that, it would be computed for every one of them
    size = {"terms": F.size("terms"), "words": F.size(raw_tokens(F.col("text"))), "distinct": F.size(F.array_distinct("terms"))}[denominator]
    return explode_counts(kept.select(*others, size.cast("bigint").alias("total"), "terms"), "terms", "term", "count")


def corpus_size(docs: DataFrame, stopwords=QUERY_STOPWORDS, text_col: str = "text") -> DataFrame:
    """``n_docs``: documents with a term, from their own rows (no shuffle but one number a task); reading ends at the first term."""
    return docs.agg(F.count_if(has_term(F.col(text_col), stopwords)).alias("n_docs"))


def document_frequency(docs: DataFrame, stopwords=QUERY_STOPWORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``term``, ``df``: the number of documents with the term. Counts combine before they are shuffled."""
    found = united(docs, id_col, text_col).select(F.explode(F.array_distinct(terms(F.col("text"), stopwords))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("df"))


def term_weights(counts: DataFrame, size: DataFrame | None = None, log=F.ln, df: DataFrame | None = None) -> DataFrame:
    """``term``, ``df``, ``idf``; ``df`` is ``document_frequency`` where the documents are at hand."""
    n = counts.where("count > 0").agg(F.count_distinct("doc_id").alias("n_docs")) if size is None else size
    by_term = counts.groupBy("term").agg(F.sum(F.when(F.col("count") > 0, 1)).alias("df")) if df is None else df
    idf = log(F.col("n_docs") / F.greatest(F.col("df"), F.lit(1)))
    return by_term.crossJoin(F.broadcast(n)).select("term", "df", idf.alias("idf"))


def tfidf(counts: DataFrame, size: DataFrame | None = None, log=F.ln, by_document: bool = False, df: DataFrame | None = None) -> DataFrame:
    """``counts`` with ``tf``, ``df``, ``idf`` and ``tfidf``; ``size`` is ``corpus_size``, ``df`` is ``document_frequency`` where the documents are at hand.

    The result lies by term, as postings need it, or stays where the documents are (``by_document``), but for rare terms.
    """
    weighted = term_weights(counts, size, log, df)
    tf = F.try_divide(F.col("count").cast("double"), F.col("total").cast("double"))
    joined = join_by_term(counts, weighted) if by_document else counts.join(weighted, "term")
    return joined.withColumn("tf", tf).withColumn("tfidf", F.col("tf") * F.col("idf"))


def join_by_term(rows: DataFrame, weighted: DataFrame, most: int = FREQUENT) -> DataFrame:
    """``rows`` joined with ``weighted`` (``term``, ``df``, ...) by term; only rows of rare terms are shuffled.

    At most ``most`` terms are broadcast: those of a least ``df``, by eighths of its logarithm, at which they are no more than that.
    The rows of all other terms meet theirs by a shuffle, so every row is joined.
    """
    step = F.floor(F.log2(F.greatest(F.col("df"), F.lit(1))) * 8)
    sizes = weighted.groupBy(step.alias("_step")).agg(F.count("*").alias("_n"))
    upwards = sizes.select("_step", F.sum("_n").over(Window.orderBy(F.desc("_step"))).alias("_n"))  # a few hundred rows at most
    least = F.broadcast(upwards.where(F.col("_n") <= most).agg(F.min("_step").alias("_least")))
    placed = weighted.crossJoin(least)
    high = F.coalesce(step >= F.col("_least"), F.lit(False))
    frequent, rare = (F.broadcast(placed.where(high).drop("_least")), placed.where(~high).drop("_least"))
    others = rows.join(frequent.select("term").hint("broadcast"), "term", "left_anti")
    return rows.join(frequent, "term").unionByName(others.join(rare, "term"))


def postings(scored: DataFrame, k: int = TOP_POSTINGS) -> DataFrame:
    """The ``k`` best documents of each term; ties by document. ``row_number`` lets Spark prune early."""
    best = Window.partitionBy("term").orderBy(F.desc("tfidf"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def term_importance(scored: DataFrame, k: int = TOP_POSTINGS) -> DataFrame:
    """``term``, ``df``, ``idf``, ``importance``: the sum of the unrounded scores of the top postings."""
    return importance_of(postings(scored, k))


def importance_of(top: DataFrame) -> DataFrame:
    """``term_importance`` of the top postings themselves."""
    return top.groupBy("term", "df", "idf").agg(F.sum("tfidf").alias("importance"))


def top_postings(docs: DataFrame, k: int = TOP_POSTINGS, stopwords=QUERY_STOPWORDS, id_col: str = "doc_id", text_col: str = "text", log=F.ln) -> DataFrame:
    """``postings(tfidf(term_counts(docs)))`` of all terms, from one reading of the documents (``operators/blocks.py``).

    For a few terms, filter ``postings``: the filter goes down to the counts.
    """
    size = corpus_size(docs, stopwords, text_col)
    if isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return best_postings(united(docs, id_col, text_col), size, k, stopwords, log)
    return postings(tfidf(term_counts(docs, stopwords, id_col, text_col), size, log, df=document_frequency(docs, stopwords, id_col, text_col)), k)


def term_objects(scored: DataFrame, k: int = TOP_POSTINGS) -> DataFrame:
    """Published terms: postings as an array by falling score, with scores to six places."""
    posting = F.struct("rank", "doc_id", to_fixed(F.col("tfidf"), 6).alias("score"), "count")
    listed = postings(scored, k).groupBy("term", "df", "idf").agg(F.array_sort(F.collect_list(posting)).alias("p"), F.sum("tfidf").alias("importance"))
    return listed.select("term", "df", "idf", F.transform("p", lambda p: F.struct(p["doc_id"], p["score"], p["count"])).alias("postings"), "importance", shard_key(F.col("term")).alias("shard"))


def doc_vectors(scored: DataFrame, k: int = TOP_TERMS) -> DataFrame:
    """The ``k`` best terms of each document; ties by term."""
    best = Window.partitionBy("doc_id").orderBy(F.desc("tfidf"), "term")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def doc_norms(scored: DataFrame, k: int = TOP_TERMS) -> DataFrame:
    """``doc_id``, ``total``, ``doc_norm`` over the document's vector, to six places."""
    norm = to_fixed(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))), 6)
    return doc_vectors(scored, k).groupBy("doc_id", "total").agg(norm.alias("doc_norm"))


def doc_objects(scored: DataFrame, k: int = TOP_TERMS) -> DataFrame:
    """Published documents: ``doc_id``, ``total_words``, ``doc_norm`` and ``terms`` by falling weight."""
    item = F.struct("rank", "term", to_fixed(F.col("tfidf"), 6).alias("tfidf"), "count")
    listed = doc_vectors(scored, k).groupBy("doc_id", "total").agg(F.array_sort(F.collect_list(item)).alias("t"), to_fixed(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))), 6).alias("doc_norm"))
    return listed.select("doc_id", F.col("total").alias("total_words"), "doc_norm", F.transform("t", lambda x: F.struct(x["term"], x["tfidf"], x["count"])).alias("terms"))


def global_terms(importance: DataFrame, limit: int = GLOBAL_TERMS, least: float = MIN_IMPORTANCE) -> DataFrame:
    """Terms above ``least`` or among the first ``limit`` admitted in term order, by falling importance.

    A term is admitted while fewer than ``limit`` are, so the first ``limit`` terms always are, and later
    ones by importance. The top ``limit`` of the rest is all that is needed: no total order of all terms.
    """
    first = importance.orderBy("term").limit(limit).select("term")
    admitted = importance.where(F.col("importance") > least).unionByName(importance.where(~(F.col("importance") > least)).join(F.broadcast(first), "term", "left_semi").select(importance.columns))
    return admitted.orderBy(F.desc("importance"), "term").limit(limit)


def shard_stats(scored: DataFrame, key=shard_key) -> DataFrame:
    """Postings and distinct documents of each shard."""
    return scored.groupBy(key(F.col("term")).alias("shard")).agg(F.count("*").alias("term_count"), F.count_distinct("doc_id").alias("doc_count"))


def shard_samples(importance: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` terms of each shard."""
    sharded = importance.select(shard_key(F.col("term")).alias("shard"), "term")
    ranked = sharded.withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy("term")))
    return ranked.where(F.col("rank") <= k)


def corpus_metadata(counts: DataFrame) -> DataFrame:
    """One row: documents with a term, distinct terms, postings, words."""
    return counts.agg(
        F.count_distinct("doc_id").alias("total_documents"), F.count_distinct("term").alias("total_terms"), F.count("*").alias("total_postings"), F.sum("count").alias("total_words")
    )


def boosted_scores(records: DataFrame) -> DataFrame:
    """Postings of taxonomy records: tf times the boosts of the levels and names that contain the word.

    ``records``: ``url``, ``binomial_name``, ``hierarchy`` (label, value) in page order, ``word_counts`` (map).
    All tests are substring tests; a word's level is the first whose value contains it.
    """
    total = F.aggregate(F.map_values("word_counts"), F.lit(0).cast("bigint"), lambda a, b: a + b)
    words = records.select("url", F.coalesce("binomial_name", F.lit("")).alias("binomial_name"), "hierarchy", total.alias("total_words"), F.explode("word_counts").alias("term", "count"))

    def level_value(label: str) -> Column:
        return F.coalesce(F.get(F.filter("hierarchy", lambda h: h["label"] == label), F.lit(0))["value"], F.lit(""))

    def has(text: Column) -> Column:
        return F.contains(F.lower(text), F.col("term"))

    level = F.get(F.filter("hierarchy", lambda h: has(h["value"])), F.lit(0))["label"]
    boost = F.lit(1.0)
    for name, value in TAXONOMY_BOOSTS.items():
        boost = F.when(F.col("taxonomy_level") == name, value).otherwise(boost)
    out = words.select(
        "url", "term", "count", F.try_divide(F.col("count").cast("double"), F.col("total_words").cast("double")).alias("tf"), level.alias("taxonomy_level"),
        has(F.col("binomial_name")).alias("is_binomial"), has(level_value("kingdom")).alias("in_kingdom"), has(level_value("family")).alias("in_family"),
    )
    out = out.withColumn("taxonomy_boost", boost).withColumn("binomial_boost", F.when(F.col("is_binomial"), 4.0).otherwise(1.0))
    out = out.withColumn("position_boost", F.when(F.col("in_kingdom"), 3.0).when(F.col("in_family"), 2.0).otherwise(1.0))
    return out.withColumn("score", F.col("tf") * F.col("taxonomy_boost") * F.col("binomial_boost") * F.col("position_boost")).drop("in_kingdom", "in_family")
