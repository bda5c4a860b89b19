"""Word n-gram index: counts by url, merge into a global index, look-up by pattern, text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.stem import stem, stem_all
from gleanery.functions.text import QUERY_STOPWORDS, letter_words, ngrams_upto
from gleanery.operators.lists import in_blocks
from gleanery.operators.rowwise import count_by_key


def local_index(docs: DataFrame, url: Column, text: Column, stopwords=QUERY_STOPWORDS, stemmed: bool = True, n: int = 3, holding: str | None = None) -> DataFrame:
    """``term``, ``url``, ``freq`` of the complete 1- to ``n``-grams of each document's words, counted in the document's own row.

    ``holding`` keeps the grams that hold this text, before anything is exploded.
    """

    def grams(rows: DataFrame) -> DataFrame:
        words = rows.select("url", letter_words(F.col("text"), stopwords).alias("words"))
        if stemmed:
            words = words.withColumn("words", stem_all("words"))
        if holding is not None:
            words = words.where(F.contains(F.array_join("words", " "), F.lit(holding)))
        found = ngrams_upto(F.col("words"), n)
        return words.select("url", found.alias("grams") if holding is None else F.filter(found, lambda g: F.contains(g, F.lit(holding))).alias("grams"))

    texts = docs.select(url.cast("string").alias("url"), text.alias("text"))
    return count_by_key(texts, "url", grams, "grams", "term", "freq").select("term", "url", "freq")


def merge(index: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert by (term, url): what ``batch`` says of a url replaces the old count.

    Both are dealt out by term, once, which also serves what groups the result by term.
    """
    both = index.withColumn("_new", F.lit(False)).unionByName(batch.select(*index.columns).withColumn("_new", F.lit(True)))
    new = F.max(F.when(F.col("_new"), F.col("freq")))
    freq = F.when(F.max("_new"), new).otherwise(F.max("freq"))
    return both.repartition("term").groupBy("term", "url").agg(freq.alias("freq")).select(*index.columns)


def term_lines(postings: DataFrame) -> DataFrame:
    """``term`` and ``postings``, the text ``url freq url freq ...`` by falling count, then url: one row for each term, however long.

    Urls of one count are joined first, so what is held at once are the urls of a term and no records of them.
    """
    urls = F.sort_array(F.collect_list("url"))
    # of null parts the text would be null: a posting has a url and a count
    equal = postings.where("url is not null and freq is not null").repartition("term").groupBy("term", "freq").agg(urls.alias("urls"))
    freq = F.concat(F.lit(" "), F.col("freq").cast("string"))
    text = F.concat(F.call_function("array_join", F.col("urls"), F.concat(freq, F.lit(" "))), freq)
    joined = equal.select("term", F.struct((-F.col("freq")).alias("k"), text.alias("text")).alias("part"))
    parts = F.sort_array(F.collect_list("part"))
    return joined.groupBy("term").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("postings"))


def global_index(postings: DataFrame) -> DataFrame:
    """``term``, ``block``, ``postings``: (url, freq) by falling count (as numbers), then url; see ``in_blocks`` for very long lists."""
    item = F.struct((-F.col("freq")).alias("k"), "url", "freq")
    listed = in_blocks(postings, "term", item, "postings")
    return listed.withColumn("postings", F.transform("postings", lambda p: F.struct(p["url"].alias("url"), p["freq"].alias("freq"))))


def to_lines(index: DataFrame) -> DataFrame:
    """Text lines ``term | url freq url freq ...``, one for each block of a term."""
    pairs = F.array_join(F.transform("postings", lambda p: F.concat_ws(" ", p["url"], p["freq"].cast("string"))), " ")
    return index.select(F.concat("term", F.lit(" | "), pairs).alias("line"))


def search_lines(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines (urls included) that the pattern matches, as ``grep`` would."""
    return lines.where(F.col("line").rlike(pattern))


def query_lines(lines: DataFrame, query: str, stopwords=QUERY_STOPWORDS) -> DataFrame:
    """Lines that hold the query's words as the index has them: lower-cased, without stop words, stemmed, joined by one space."""
    row = lines.sparkSession.range(1).select(letter_words(F.lit(query), stopwords).alias("w")).first()
    words = " ".join(stem(w) for w in row["w"])
    return lines.where(F.contains("line", F.lit(words))) if words else lines.where("false")


def parse_local(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of ``term | freq | url`` lines."""
    parts = F.transform(F.split("line", "\\|"), lambda x: F.trim(x))
    parsed = lines.select("line", F.get(parts, F.lit(0)).alias("term"), F.try_to_number(F.get(parts, F.lit(1)), F.lit("999999999999")).cast("bigint").alias("freq"), F.get(parts, F.lit(2)).alias("url"))
    valid = F.coalesce((F.col("term") != "") & F.col("freq").isNotNull() & (F.col("url") != ""), F.lit(False))
    return parsed.where(valid).select("term", "url", "freq"), parsed.where(~valid).select("line")


def parse_global(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of ``term | url freq ...`` lines; an odd number of words rejects a line."""
    parts = F.split("line", "\\|", 2)
    words = F.filter(F.split(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), "\\s+"), lambda w: w != "")
    parsed = lines.select("line", F.trim(F.get(parts, F.lit(0))).alias("term"), words.alias("words"))
    valid = (F.col("term") != "") & (F.size("words") > 0) & (F.size("words") % 2 == 0)
    starts = F.sequence(F.lit(0), F.size("words") - 2, F.lit(2))
    pairs = F.transform(starts, lambda i: F.struct(F.get("words", i).alias("url"), F.get("words", i + 1).alias("freq")))
    rows = parsed.where(valid).select("term", F.explode(pairs).alias("p")).select("term", "p.url", F.expr("try_cast(p.freq as bigint)").alias("freq"))
    return rows, parsed.where(~valid).select("line")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one index and not in the other (``side`` says which), order-insensitive."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def same(a: DataFrame, b: DataFrame, slack_percent: float = 0.0) -> bool:
    """Whether at most ``slack_percent`` of the rows differ."""
    return diff(a, b).count() * 100 <= slack_percent * max(a.count(), b.count(), 1)
