"""The map-reduce catalogue: each workload as one declarative plan over (key, value) or a driver table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import to_fixed
from gleanery.operators.lists import in_blocks
from gleanery.operators.mapreduce import map_reduce


def _fields(value):
    return F.split(value, "\\s+")


def max_by_year(readings: DataFrame) -> DataFrame:
    """Highest temperature of each year, from station lines ``id year date temperature flags``."""
    f = _fields(F.col("value"))
    return map_reduce(readings, F.array(F.struct(F.get(f, F.lit(1)).alias("key"), F.get(f, F.lit(3)).cast("bigint").alias("value"))), max_temp=F.max("value")).withColumnRenamed("key", "year")


def max_by_month(readings: DataFrame) -> DataFrame:
    f = _fields(F.col("value"))
    month = F.concat(F.get(f, F.lit(1)), F.lit("-"), F.substring(F.get(f, F.lit(2)), 1, 2))
    return map_reduce(readings, F.array(F.struct(month.alias("key"), F.get(f, F.lit(3)).cast("bigint").alias("value"))), max_temp=F.max("value")).withColumnRenamed("key", "ym")


def mean_word_length(docs: DataFrame, key: str = "key", text: str = "value") -> DataFrame:
    """Mean length of the words of each document, to two places; 0 without words."""
    words = F.filter(F.split(F.col(text), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return docs.select(F.col(key).alias("doc"), to_fixed(F.coalesce(F.try_divide(letters.cast("double"), F.size(words).cast("double")), F.lit(0.0)), 2).alias("avg_len"))


def char_frequency(docs: DataFrame, text: str = "value") -> DataFrame:
    """Occurrences of each character that is no white space.

    Counted in the document first: an array of at most as many entries as the document has characters
    goes through the partial aggregation, never one row per character over the shuffle.
    """
    chars = F.split(F.regexp_replace(F.col(text), "[ \\t\\n\\r\\f\\x0B]+", ""), "")
    return docs.select(F.explode(chars).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


def word_count_clean(docs: DataFrame, text: str = "value") -> DataFrame:
    """Lower-cased words without punctuation."""
    words = F.split(F.regexp_replace(F.lower(F.col(text)), "[^A-Za-z0-9_\\s]", ""), "\\s+")
    return docs.select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def word_count_raw(docs: DataFrame, text: str = "value") -> DataFrame:
    """Words between white space, as they are."""
    return docs.select(F.explode(F.split(F.col(text), "\\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def mean_price(quotes: DataFrame) -> DataFrame:
    q = F.from_json("value", "company string, date string, price double")
    return quotes.select(q.alias("q")).groupBy(F.col("q.company").alias("company")).agg(to_fixed(F.avg("q.price"), 2).alias("avg_price"))


def status_counts(log: DataFrame) -> DataFrame:
    status = F.regexp_extract("value", '"[^"]*"\\s(\\d{3})\\s', 1)
    return log.select(status.alias("status")).where("status <> ''").groupBy("status").agg(F.count("*").alias("n"))


def revenue_by_category(sales: DataFrame) -> DataFrame:
    s = F.from_json("value", "category string, price double, quantity bigint")
    return sales.select(s.alias("s")).groupBy(F.col("s.category").alias("category")).agg(to_fixed(F.sum(F.col("s.price") * F.col("s.quantity")), 2).alias("revenue"))


def tfidf_log10(docs: DataFrame) -> DataFrame:
    """Case-sensitive words between white space, log10, two places; N is the number of documents."""
    words = docs.select("key", F.split("value", "\\s+").alias("words")).select("key", F.size("words").alias("total"), F.explode("words").alias("word"))
    tf = words.groupBy("key", "word", "total").agg(F.count("*").alias("c"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = docs.agg(F.count_distinct("key").alias("n"))
    score = F.col("c") / F.col("total") * F.log10(F.col("n") / F.col("df"))
    return tf.join(df, "word").crossJoin(F.broadcast(n)).select("word", F.col("key").alias("doc"), to_fixed(score, 2).alias("tfidf"))


EMAIL = "(?i)(?<![A-Z0-9_])[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}(?![A-Z0-9_])"


def matching_docs(docs: DataFrame, pattern: str = EMAIL) -> DataFrame:
    """Sorted keys of the documents that a pattern matches, by ``block`` (one, unless they are very many)."""
    found = docs.where(F.col("value").rlike(pattern)).select(F.lit(pattern).alias("pattern"), "key")
    return in_blocks(found, "pattern", F.col("key"), "docs").select("block", F.array_join("docs", ",").alias("docs"))


def inverted_index(docs: DataFrame, key: str = "key", text: str = "value") -> DataFrame:
    """Sorted documents of each lower-cased word, by ``block`` (one, unless they are very many)."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), "\\s+"))
    pairs = docs.select(F.col(key).alias("key"), F.explode(words).alias("word")).where("word <> ''")
    return in_blocks(pairs, "word", F.col("key"), "docs")


def reverse_links(pages: DataFrame) -> DataFrame:
    """Sources of each sink, with a share that falls with their number (fixed values: 0.42 alone, 0.12 of two, 0.04 of more)."""
    edges = pages.select(F.col("key").alias("source"), F.explode(F.split("value", " +")).alias("sink")).where("sink <> ''")
    n = edges.groupBy("sink").agg(F.count("*").alias("n"))
    share = F.when(F.col("n") == 1, 0.42).when(F.col("n") == 2, 0.42 / 3.5).otherwise(0.42 / 10)
    return edges.join(n, "sink").select("sink", "source", to_fixed(share, 2).alias("score")).distinct()


def max_value_by_month(events: DataFrame) -> DataFrame:
    """Highest value of each event type and month."""
    return events.groupBy("event_type", F.date_format("ts", "yyyy-MM").alias("ym")).agg(F.max("value").alias("max_value"))


def revenue_by_priority(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(to_fixed(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("revenue"), F.count("*").alias("n"))
