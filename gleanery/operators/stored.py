"""A published index: written once, read by bucket. Searches and look-ups touch only the buckets of their terms and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import to_fixed
from gleanery.operators import index
from gleanery.operators.search import MAX_RESULTS, parse_query, similar_to
from gleanery.operators.search import search as ranked_search
from gleanery.sources.tables import publish

#: Terms and documents are stored in so many buckets of their hash.
BUCKETS = 64


def bucket_of(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def publish_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write postings by bucket of their term, and documents' vectors by bucket of their id.

    The scored counts are computed by term for the postings, and where the documents are for the vectors: neither shuffles them twice.
    """
    counts, size = index.term_counts(docs, id_col=id_col, text_col=text_col), index.corpus_size(docs, text_col=text_col)
    df = index.document_frequency(docs, id_col=id_col, text_col=text_col)
    postings = index.postings(index.tfidf(counts, size, df=df)).select("term", "df", "idf", "doc_id", "rank", to_fixed(F.col("tfidf"), 6).alias("score"), "count", "total")
    publish(postings.withColumn("bucket", bucket_of("term")), f"{path}/postings", "bucket")
    vectors = index.doc_vectors(index.tfidf(counts, size, by_document=True, df=df)).select("doc_id", "rank", "term", "tfidf", "count", "total")
    publish(vectors.withColumn("bucket", bucket_of("doc_id")), f"{path}/documents", "bucket")


class StoredIndex:
    """Search and look-ups over what ``publish_index`` wrote under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._postings = spark.read.parquet(f"{path}/postings")
        self._documents = spark.read.parquet(f"{path}/documents")

    def _read(self, stored: DataFrame, column: str, keys: list, kind: str) -> DataFrame:
        """The rows of some keys: a scan of their buckets, with the keys pushed down."""
        keys = list(dict.fromkeys(keys))
        if not keys:
            return stored.where("false").drop("bucket")
        literal = F.array(*(F.lit(k).cast(kind) for k in keys))
        buckets = [r["b"] for r in self.spark.range(1).select(F.explode(literal).alias("k")).select(bucket_of("k").alias("b")).distinct().collect()]
        return stored.where(F.col("bucket").isin(buckets) & F.col(column).isin(keys)).drop("bucket")

    def postings(self, terms: list[str]) -> DataFrame:
        """Postings of the given terms."""
        return self._read(self._postings, "term", terms, "string")

    def documents(self, ids: list[int]) -> DataFrame:
        """Vectors of the given documents."""
        return self._read(self._documents, "doc_id", ids, "bigint")

    def search(self, query: str, max_results: int = MAX_RESULTS) -> DataFrame:
        """``search.search`` over the buckets of the query's terms; ``total_words`` comes with the postings."""
        tokens, _ = parse_query(self.spark, query)
        postings = self.postings(tokens)
        totals = postings.groupBy("doc_id").agg(F.max("total").alias("total_words"))
        return ranked_search(postings, totals, query, max_results)

    def similar(self, ids: list[int], max_results: int = MAX_RESULTS) -> DataFrame:
        """``search.similar_to`` for the given documents: their buckets, then those of their terms."""
        vectors = self.documents(ids)
        terms = [r["term"] for r in vectors.where("rank <= 20").select("term").distinct().collect()]
        return similar_to(vectors, self.postings(terms), max_results)

    def get_terms(self, terms: list[str]) -> list[Row]:
        """``term``, ``df``, ``postings`` of each known term, in the order asked for."""
        item = F.struct("rank", "doc_id", "score", "count")
        rows = self.postings(terms).groupBy("term", "df").agg(F.array_sort(F.collect_list(item)).alias("postings")).collect()
        found = {r["term"]: r for r in rows}
        return [found[t] for t in terms if t in found]

    def get_documents(self, ids: list[int]) -> list[Row]:
        """``doc_id``, ``total_words``, ``terms`` of each known document, in the order asked for."""
        item = F.struct("rank", "term", "tfidf", "count")
        rows = self.documents(ids).groupBy("doc_id", F.col("total").alias("total_words")).agg(F.array_sort(F.collect_list(item)).alias("terms")).collect()
        found = {r["doc_id"]: r for r in rows}
        return [found[i] for i in ids if i in found]
